from collections import Counter

from helpers import TOKEN, awkward_rows, documents

from archspan.llm import quality_rules


def expected(text):
    text = text or ""
    words = TOKEN.findall(text)
    lines = [x for x in text.split("\n") if TOKEN.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(spark):
    extra = [(50, "a b c d e f g h " * 3 + "x a b c d e f g h", "en", "s", 1), (51, "| a | b |\n| a | b |\n\n", "en", "s", 1), (52, "w " * 40, "en", "s", 1), (53, "\x0ba\x0cb\rc\td e f", "en", "s", 1)]
    df = documents(spark, awkward_rows() + extra)
    for r in quality_rules.cascade_verdict(df, [(x.name, 1.0, 0.0) for x in (*quality_rules.BASE, *quality_rules.RULES)]).collect():
        want = expected(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_filter_equals_verdict_in_any_order(spark):
    df = documents(spark, clash=("kept", "_w", "N_WORDS"))
    rules = (*quality_rules.BASE, *quality_rules.RULES)
    verdict = sorted(str((r["doc_id"], r["text"])) for r in quality_rules.cascade_verdict(df).filter("kept").collect())
    for order in (rules, rules[::-1]):
        measured = [(r.name, float(i + 1), 0.5) for i, r in enumerate(order)]
        got = quality_rules.cascade_filter(df, measured)
        assert got.columns == df.columns
        assert sorted(str((r["doc_id"], r["text"])) for r in got.collect()) == verdict
        assert {r["kept"] for r in got.collect()} == {"kept"}


def test_order_is_by_rejection_per_cost():
    rules = quality_rules.BASE
    got = quality_rules.ordered(rules, [("base_words", 1.0, 0.1), ("base_repeats", 2.0, 0.5)])
    assert [r.name for r in got] == ["base_repeats", "base_words"]


def test_junk_goes_and_prose_stays(spark):
    prose = " ".join(f"word{i} of text" for i in range(30))
    rows = [(1, prose, "en", "s", 1), (2, " ".join(f"word{i}&&&" for i in range(60)), "en", "s", 1), (3, " | ".join(f"cell{i}" for i in range(60)), "en", "s", 1), (4, " ".join(f"LOUD{'X' * (i % 5)}!!" for i in range(60)), "en", "s", 1)]
    assert [r["doc_id"] for r in quality_rules.cascade_filter(documents(spark, rows)).collect()] == [1]


def test_empty_table(spark):
    assert quality_rules.cascade_filter(documents(spark, [])).collect() == []
    assert quality_rules.cascade_verdict(documents(spark, [])).collect() == []


def test_statistics_stop_at_the_first_failed_rule(spark):
    rules = (*quality_rules.BASE, *quality_rules.RULES)
    measured = [(r.name, float(i + 1), 0.5) for i, r in enumerate(rules)]  # base_words first, shouting last
    rows = {r["doc_id"]: r for r in quality_rules.cascade_verdict(documents(spark, [(1, "few words", "en", "s", 1), (2, " ".join(f"word{i} of text" for i in range(30)), "en", "s", 1)]), measured, always=()).collect()}
    assert (rows[1]["failed_rule"], rows[1]["n_words"]) == ("base_words", 2)
    assert all(rows[1][c] is None for c in quality_rules.STATS if c not in ("n_words", "word_chars"))
    assert rows[2]["kept"] and all(rows[2][c] is not None for c in quality_rules.STATS)
    everything = quality_rules.cascade_verdict(documents(spark), measured).select("doc_id", "text", "kept")
    least = quality_rules.cascade_verdict(documents(spark), measured, always=()).select("doc_id", "text", "kept")
    assert sorted(map(str, everything.collect())) == sorted(map(str, least.collect()))


def test_measuring_reads_a_few_rows_of_any_table(spark):
    found = quality_rules.measure(documents(spark))
    assert [name for name, *_ in found] == [r.name for r in (*quality_rules.BASE, *quality_rules.RULES)]
    assert all(cost > 0 and 0 <= share <= 1 for _, cost, share in found)
