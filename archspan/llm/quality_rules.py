"""Document quality rules run as a short-circuit cascade.

Each rule is a Column that is true when a document passes. The cost (seconds on
a sample) and the rejection rate of every rule are measured, and rules are then
ordered by falling rejection per cost: cheap and selective rules settle most
rejections. The statistics of a rule are computed only for documents that passed the
rules before it: ``cascade_filter`` drops the others between two rules, ``cascade_verdict``
keeps all rows and leaves the statistics that a rejected document no longer needs null,
but for those that the caller wants of every row. The order changes the work and never the
verdict, which is the conjunction of the rules.

Statistics use arrays inside one row and stay on the JVM. Repeated 8-word
windows are found by combining word hashes pairwise (1, 2, 4, then 8 words) and,
only for texts with a repeated window, sorting (hash, position) pairs.

Null text counts as empty and fails the base. Texts of any length are judged whole. Columns
that clash with added ones are replaced. Empty tables give no rows; repeated rows are judged alike.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, without, words

#: Words of a repeated window; the pairwise hashing below is for this value.
WINDOW = 8
#: Rows on which cost and selectivity are measured. They only order the rules.
SAMPLE_ROWS = 256
#: Longer texts are left out of that sample, so that it fits the driver.
SAMPLE_BYTES = 1 << 14

#: Groups of statistics that ``cascade_verdict`` gives for every row unless asked for others.
REPORTED = ("words", "symbols", "lines", "repeats")
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_capitals")
ADDED = (*STATS, "base_failed", "kept", "failed_rule", "_w", "_h", "_s", "_e", "_p", "_t", "_bar")


# The statistics read the text as ``_t``, which is null where they are not asked for; then they are null too.


def _counted(pattern: str) -> Column:
    """Characters of the text inside matches of ``pattern``."""
    return (F.length("_t") - F.length(F.regexp_replace("_t", pattern, ""))).cast("long")


def _add_words(df: DataFrame) -> DataFrame:
    return df.withColumn("_w", F.when(F.col("_t").isNotNull(), words(F.col("_t")))).withColumns(
        {"n_words": F.size("_w").cast("long"), "word_chars": F.length(F.array_join("_w", "")).cast("long")}
    )


def _add_symbols(df: DataFrame) -> DataFrame:
    return df.withColumn("n_symbols", _counted(r"[#*$%&|<>]+"))


def _add_lines(df: DataFrame) -> DataFrame:
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    df = df.withColumn("_h", lines)
    n = F.size("_h").cast("long")
    return df.withColumns({"n_lines": n, "n_dup_lines": n - F.size(F.array_distinct("_h"))}).drop("_h")


def _paired(name: str, gap: int) -> Column:
    shifted = F.slice(F.col(name), F.lit(gap + 1), F.greatest(F.size(name), F.lit(1)))
    return F.zip_with(F.col(name), shifted, lambda a, b: F.xxhash64(a, b))


def _add_repeats(df: DataFrame) -> DataFrame:
    df = df.withColumn("_h", F.when(F.col("_t").isNotNull(), F.transform("_w", lambda w: F.xxhash64(w))))
    for gap in (1, 2, 4):
        df = df.withColumn("_h", _paired("_h", gap))
    whole = F.greatest(F.size("_w") - (WINDOW - 1), F.lit(0))
    df = df.withColumn("_h", F.slice("_h", F.lit(1), whole))
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    # Null where no window repeats: the steps below then do nothing.
    df = df.withColumn("_s", F.when(twice, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    rest = F.slice(F.col("_s"), F.lit(2), F.size("_s"))
    df = df.withColumn("_e", F.zip_with("_s", rest, lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    either = F.zip_with("_e", F.concat(F.array(F.lit(False)), F.slice(F.col("_e"), F.lit(1), F.size("_e") - 1)), lambda a, b: a | b)
    places = F.zip_with("_s", either, lambda s, twin: F.when(twin, s["i"]))
    df = df.withColumn("_p", F.sort_array(F.filter(places, lambda p: p.isNotNull())))
    later = F.slice(F.col("_p"), F.lit(2), F.size("_p"))
    gaps = F.zip_with("_p", later, lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    total = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)
    return df.withColumn("n_repeat_words", F.when(F.col("_t").isNotNull(), F.coalesce(total, F.lit(0)).cast("long"))).drop("_h", "_s", "_e", "_p")


def _add_letters(df: DataFrame) -> DataFrame:
    return df.withColumn("n_letters", _counted(r"\p{L}+"))


def _add_capitals(df: DataFrame) -> DataFrame:
    return df.withColumn("n_capitals", _counted(r"\p{Lu}+"))


_ADD = {"words": _add_words, "symbols": _add_symbols, "lines": _add_lines, "repeats": _add_repeats, "letters": _add_letters, "capitals": _add_capitals}


@dataclass(frozen=True)
class Rule:
    """``passes`` builds a Column over the statistics that ``needs`` names."""

    name: str
    needs: tuple[str, ...]
    passes: Callable[[], Column]


BASE = (
    Rule("base_words", ("words",), lambda: F.col("n_words") >= 20),
    Rule("base_repeats", ("words", "repeats"), lambda: F.col("n_repeat_words") * 100 <= F.col("n_words") * 30),
)

#: Verdict of the method beyond the base. Thresholds lie far from running prose.
RULES = (
    Rule("word_length", ("words",), lambda: F.col("word_chars").between(F.col("n_words") * 2, F.col("n_words") * 20)),
    Rule("symbols", ("words", "symbols"), lambda: F.col("n_symbols") * 4 <= F.col("n_words")),
    Rule("duplicate_lines", ("lines",), lambda: F.col("n_dup_lines") * 2 <= F.col("n_lines")),
    Rule("letters", ("words", "letters"), lambda: F.col("n_letters") * 2 >= F.col("word_chars")),
    Rule("shouting", ("capitals", "letters"), lambda: F.col("n_capitals") * 2 <= F.col("n_letters")),
)


def _ready(df: DataFrame, asked: Column | None = None) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.withColumn("_t", text if asked is None else F.when(asked, text))


def with_statistics(df: DataFrame, groups: tuple[str, ...] = tuple(_ADD)) -> DataFrame:
    """``df`` plus the statistics of ``groups``; repeats need words before them."""
    df = _ready(df)
    for group in groups:
        df = _ADD[group](df)
    return df.drop("_t")


def measure(df: DataFrame, rules: tuple[Rule, ...] = (*BASE, *RULES)) -> list[tuple[str, float, float]]:
    """(rule, seconds on the sample, rejected share) for each rule."""
    few = df.select("text").filter(F.octet_length("text") <= SAMPLE_BYTES).take(SAMPLE_ROWS)
    texts = F.array(*[F.lit(r["text"]) for r in few]).cast("array<string>")
    scratch = Scratch(df.sparkSession)
    sample = scratch.write(df.sparkSession.range(1).select(F.explode(texts).alias("text")), "rule_sample")

    def timed(needs: tuple[str, ...], passes: Column) -> tuple[float, float]:
        plan = with_statistics(sample, needs).agg(F.avg((~passes).cast("double")))
        began = time.perf_counter()
        share = plan.first()[0]
        return time.perf_counter() - began, share or 0.0

    timed((), F.lit(True))
    floor, _ = timed((), F.lit(True))
    found = []
    for rule in rules:
        seconds, share = timed(rule.needs, rule.passes())
        found.append((rule.name, max(seconds - floor, 1e-3), share))
    scratch.drop("rule_sample")
    return found


def ordered(rules: tuple[Rule, ...], measured: list[tuple[str, float, float]]) -> list[Rule]:
    """Rules by falling rejection per cost; the cheaper first among equals."""
    by = {name: (-share / cost, cost, name) for name, cost, share in measured}
    return sorted(rules, key=lambda r: by[r.name])


def cascade_verdict(df: DataFrame, measured: list[tuple[str, float, float]] | None = None, always: tuple[str, ...] = REPORTED) -> DataFrame:
    """All rows with statistics, base_failed, kept and failed_rule.

    failed_rule names the first rule of the measured order that failed (null if
    kept); it is a diagnosis and may differ between runs, kept does not. Statistics
    of groups in ``always`` are of every row, others null behind the rule that failed;
    base_failed is null if its statistics are.
    """
    held = without(df, *ADDED)
    measured = measure(df) if measured is None else measured
    for group in (g for g in _ADD if g in always):
        held = _ADD[group](_ready(held)).drop("_t")
    have = set(always)
    held = held.withColumn("failed_rule", F.lit(None).cast("string"))
    for rule in ordered((*BASE, *RULES), measured):
        alive = F.col("failed_rule").isNull()
        for group in rule.needs:
            if group not in have:
                held = _ADD[group](_ready(held, alive)).drop("_t")
                have.add(group)
        held = held.withColumn("failed_rule", F.when(alive & ~rule.passes(), F.lit(rule.name)).otherwise(F.col("failed_rule")))
    base_failed = ~(BASE[0].passes() & BASE[1].passes())
    return held.withColumns({"base_failed": base_failed, "kept": F.col("failed_rule").isNull()}).drop("_w")


def cascade_filter(df: DataFrame, measured: list[tuple[str, float, float]] | None = None) -> DataFrame:
    """The rows of ``df`` that pass the base and all rules, with its own columns."""
    columns = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ADDED]
    clash = [c for c in df.columns if c.lower() in ADDED]
    held = df.select(*columns, *([F.struct(*[F.col(f"`{c}`") for c in clash]).alias("_clash")] if clash else []))
    measured = measure(df) if measured is None else measured
    have: set[str] = set()
    for rule in ordered((*BASE, *RULES), measured):
        for group in rule.needs:
            if group not in have:
                held = _ADD[group](_ready(held)).drop("_t")
                have.add(group)
        # The row id pins the filter here: pushed below the projections it would
        # repeat their work, or run it for rows that earlier rules dropped.
        held = held.withColumn("_bar", F.monotonically_increasing_id()).filter(rule.passes() & (F.col("_bar") >= 0)).drop("_bar")
    return held.select(*[F.col(f"_clash.`{c}`") if c in clash else F.col(f"`{c}`") for c in df.columns])
