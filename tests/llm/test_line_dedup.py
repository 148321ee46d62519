import random

from helpers import awkward_rows, documents, prose

from archspan.llm import line_dedup


def test_cluster_generalises_variable_words():
    lines = [b"user alice logged in from home today", b"user bob logged in from home today", b"user carol logged in from work today", b"nothing like the others at all here"]
    got = line_dedup.cluster(lines)
    assert got[0] == got[1] == got[2] == b"user <*> logged in from <*> today"
    assert got[3] == lines[3]


def fixture():
    rng = random.Random(6)
    rows = []
    passage = prose(rng, 60)
    for i in range(30):
        lines = [prose(rng, 30), prose(rng, 40)]
        if i % 3 == 0:
            lines.insert(1, passage)
        if i % 5 == 0:
            lines.append(f"Posted by user{i} on 2024-01-{i:02d} in the general forum section")
        rows.append((i, "\n".join(lines), "en", "s", 1))
    return rows, passage


def test_recurring_lines_go_but_the_first(spark):
    rows, passage = fixture()
    got = {r["doc_id"]: r["text"] for r in line_dedup.cleaned(documents(spark, rows, clash=("_k", "dropped"))).collect()}
    texts = {r[0]: r[1] for r in rows}
    for i in range(30):
        lines = texts[i].split("\n")
        want = [x for x in lines if not (i and (x == passage or x.startswith("Posted")))]
        assert got[i].split("\n") == want


def test_many_lines_in_one_leaf_meet_across_tasks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LEAF_LINES", 4)
    rows = [(i, f"the same opening words then {chr(97 + i % 26) * 3} and the rest is equal everywhere", "en", "s", 1) for i in range(40)]
    got = line_dedup.marked(documents(spark, rows)).collect()
    assert sum(len(r["dropped_lines"]) for r in got) == 39


def test_awkward_rows_and_empty_table(spark):
    df = documents(spark, clash=("DROPPED_LINES",))
    assert line_dedup.marked(df).count() == len(awkward_rows())
    assert line_dedup.marked(documents(spark, [])).collect() == []


def test_short_lines_stay(spark):
    rows = [(i, "to be or\nnot", "en", "s", 1) for i in range(9)]
    assert all(r["dropped_lines"] == [] for r in line_dedup.marked(documents(spark, rows)).collect())


def test_long_line_of_two_documents_goes_but_the_first(spark):
    rng = random.Random(3)
    passage, phrase = prose(rng, 60), prose(rng, 20)
    rows = [(i, "\n".join([prose(rng, 30), passage, phrase]), "en", "s", 1) for i in range(2)] + [(5, prose(rng, 60), "en", "s", 1)]
    got = {r["doc_id"]: r["dropped_lines"] for r in line_dedup.marked(documents(spark, rows)).collect()}
    assert got == {0: [], 1: [1], 5: []}


def test_equal_lines_go_whatever_their_share_of_fields(spark):
    equal = "Licensed under CC BY-NC 4.0."
    table = "12 34 56 78 90 sum 1"
    rows = [(i, f"{equal}\n{table}\n{i} {i + 1} {i + 2} {i + 3} {i + 4} sum {i}", "en", "s", 1) for i in range(4)]
    got = {r["doc_id"]: r["dropped_lines"] for r in line_dedup.marked(documents(spark, rows)).collect()}
    assert got == {0: [], 1: [0, 1], 2: [0, 1], 3: [0, 1]}


def plain_templates(lines):
    """The single pass, written plainly: every line against every template."""
    made, member = [], []
    for tokens in (x.split() for x in lines):
        same = [sum(a == b for a, b in zip(m, tokens, strict=True)) for m in made]
        best = max(range(len(made)), key=lambda i: (same[i], -i), default=-1)
        if best < 0 or same[best] < line_dedup.ALIKE * len(tokens):
            best = len(made)
            made.append(tokens[:])
        made[best] = [a if a == b else b"<*>" for a, b in zip(made[best], tokens, strict=True)]
        member.append(best)
    return [b" ".join(made[m]) for m in member]


def hot_leaf(n):
    rng = random.Random(12)
    kinds = [["one", "two", "three", *(rng.choice("abcdefgh") + str(rng.choice("xyz")) for _ in range(9))] for _ in range(60)]
    out = []
    for _ in range(n):
        words = rng.choice(kinds)[:]
        for spot in rng.sample(range(3, 12), rng.randint(0, 5)):
            words[spot] = rng.choice(["<*>", "new", f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"])
        out.append(" ".join(words).encode())
    return list(dict.fromkeys(out))


def test_templates_equal_the_plain_single_pass():
    lines = hot_leaf(1500)
    assert line_dedup.cluster(lines) == plain_templates(lines)


def test_large_leaf_is_clustered_as_by_one_pass(spark):
    lines = hot_leaf(4000)
    assert len(lines) > line_dedup.LEAF_LINES
    rows = spark.createDataFrame([(7, i, 1, x) for i, x in enumerate(lines)], "leaf long, hash long, n long, masked binary").repartition(4)
    got = line_dedup._clustered(rows).collect()
    texts = {r["place"]: bytes(r["template"]) for r in got if r["template"] is not None}
    by = {r["hash"]: texts[r["place"]] for r in got if r["template"] is None}
    assert [by[i] for i in range(len(lines))] == line_dedup.cluster(lines)


def plain_parse(line):
    """Leaf parts, masked line and tokens, written plainly."""
    tokens = line.split()
    masked = [b"<*>" if any(c in b"0123456789@" for c in t) or b"://" in t else t for t in tokens]
    return len(tokens), masked[:3], b" ".join(masked), b" ".join(tokens)


def test_parsing_equals_plain_python(spark):
    rng = random.Random(8)
    parts = ["a", "bc", "1", "x2y", "@", "me@here", "://", "http://z", "a:b", ":/", "::::", "é", "9é", "<*>", " ", "  ", "\t", "\x0b", "\r", "\f", "\xa0", "-", ","]
    texts = ["\n".join(" ".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) + rng.choice(["", " ", "\r"]) for _ in range(rng.randint(0, 4))) for _ in range(400)]
    texts += ["x" * 60_000 + " b c d e", ":" * 60_000 + " b c d e 1", "a b c d " + "y" * 60_000 + "7", None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("doc_id", "cast(cast(doc_id as string) as binary) as _k", "text")
    got, leaves, exact = {}, {}, {}
    for r in line_dedup.parsed(rows).collect():
        got[r["doc_id"], r["line"]] = (bytes(r["masked"]), r["least"])
        leaves.setdefault(r["leaf"], set()).add(r["doc_id"] * 100 + r["line"])
        exact.setdefault(r["exact"], set()).add(r["doc_id"] * 100 + r["line"])
    want, by_leaf, by_exact = {}, {}, {}
    for i, text in enumerate(texts):
        for n, line in enumerate((text or "").encode().split(b"\n")):
            size, head, masked, plain = plain_parse(line)
            if size >= 5:
                want[i, n] = (masked, 2 if size > 50 else 3)
                by_leaf.setdefault((size, tuple(head)), set()).add(i * 100 + n)
                by_exact.setdefault(plain, set()).add(i * 100 + n)
    assert got == want
    assert sorted(map(sorted, leaves.values())) == sorted(map(sorted, by_leaf.values()))
    assert sorted(map(sorted, exact.values())) == sorted(map(sorted, by_exact.values()))


def plain_marked(rows):
    """Lines that each document loses, by the whole method written plainly."""
    import hashlib
    from collections import Counter, defaultdict

    import xxhash

    def key(row):
        return hashlib.md5("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row).encode()).digest()

    def signed(raw):
        h = xxhash.xxh64_intdigest(raw, 42)
        return h - (1 << 64) if h >= 1 << 63 else h

    lines = []  # (row key, doc, line, leaf, masked, plain, least)
    for row in set(rows):
        for n, line in enumerate((row[1] or "").encode().split(b"\n")):
            size, head, masked, plain = plain_parse(line)
            if size >= line_dedup.MIN_TOKENS:
                lines.append((key(row), row[0], n, (size, tuple(head)), masked, plain, 2 if size > 50 else 3))
    # Equal rows count as one document, but each of their lines counts in the order of a leaf.
    weight = Counter(rows)
    count = Counter()
    for row in rows:
        for line in (row[1] or "").encode().split(b"\n"):
            size, head, masked, _ = plain_parse(line)
            if size >= line_dedup.MIN_TOKENS:
                count[(size, tuple(head)), masked] += 1
    assert sum(weight.values()) == len(rows)
    leaves = defaultdict(list)
    for (leaf, masked), n in count.items():
        leaves[leaf].append((-n, signed(masked), masked))
    name = {}
    for leaf, members in leaves.items():
        if -sum(n for n, *_ in members) < (2 if leaf[0] > 50 else 3):
            continue
        ordered = [m for _, _, m in sorted(members)]
        for masked, template in zip(ordered, plain_templates(ordered), strict=True):
            constant = sum(t != b"<*>" for t in template.split())
            if constant >= line_dedup.MIN_TOKENS and constant >= leaf[0] * line_dedup.ALIKE:
                name[leaf, masked] = (leaf, template)
    groups = defaultdict(list)
    least = {}
    for k, doc, n, leaf, masked, plain, need in lines:
        for group in filter(None, (name.get((leaf, masked)), plain)):
            groups[group].append((doc is None, doc or 0, k, n))
            least[group] = need
    lost = defaultdict(set)
    for group, places in groups.items():
        if len({k for _, _, k, _ in places}) >= least[group]:
            for _, _, k, n in sorted(places)[1:]:
                lost[k].add(n)
    return sorted(str((row[0], sorted(lost[key(row)]))) for row in rows)


def test_marked_lines_equal_brute_force(spark):
    rng = random.Random(17)
    kinds = [[rng.choice("pqrstuvw") + rng.choice("aeiou") for _ in range(rng.choice([4, 5, 6, 8, 8, 8, 60]))] for _ in range(12)]
    for kind in kinds[6:]:
        kind[:3] = ["one", "two", "three"]

    def line():
        words = rng.choice(kinds)[:]
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(["n" + str(rng.randrange(50)), "alpha", "beta", "gamma"])
        return " ".join(words)

    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 6)))) for i in range(120)]
    rows += [(3, "\n".join(line() for _ in range(4))), (None, "\n".join(line() for _ in range(4))), rows[0], rows[0], (500, None), (501, "")]
    got = line_dedup.marked(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = plain_marked(rows)
    assert sorted(str((r["doc_id"], r["dropped_lines"])) for r in got.collect()) == want
    assert sum("[]" not in x for x in want) > 60
