"""Problems 1 to 5: grouping, overlap, near-duplicates, splits and copies, against brute force on small tables."""

import json
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from twinloom.llm import canonical_dups, contraction, cross_split, near_dup, plain, split_assign

BANK = "language string, human_origin_id string, human_code_sha256 string, candidate_code_sha256 string, label string"


def closure(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_contract_matches_closure(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100, i) for i in range(101, 140)] + [(i, i + 1) for i in range(200, 230)]
    rows = [*edges, (5, None), (None, None), (7, 7), *[(b, a) for a, b in edges[:10]]]
    got = {r.node: r.group_id for r in contraction.consolidate(spark.createDataFrame(rows, "a bigint, b bigint")).collect()}
    want = closure({x for e in edges for x in e if e[0] != e[1]}, edges)
    assert got == want


def test_contract_empty(spark):
    assert contraction.consolidate(spark.createDataFrame([], "a string, b string")).collect() == []


def test_origin_groups_notation_and_scope(spark):
    d = lambda i: f"{i:064x}"
    rows = [
        ("c", "A//x.c", d(10), d(11), "t"),
        ("c", "./b/y.c", " SHA256:" + d(11).upper(), d(12), "t"),
        ("c", "a/x.c", d(10), d(11), "t"),
        ("c", "z\\z.c", d(12), None, "t"),
        ("java", "q/q.java", d(10), d(12), "t"),
        ("c", "alone.c", d(99), None, "t"),
        ("c", "nothing.c", None, None, "t"),
        ("c", "empty.c", "", " ", "t"),
        (None, "n.c", d(10), d(10), "t"),
        ("c", None, d(10), d(10), "t"),
    ]
    got = {tuple(r) for r in contraction.origin_groups(spark.createDataFrame(rows, BANK)).collect()}
    assert got == {("c", "a/x.c", "a/x.c"), ("c", "a/x.c", "b/y.c"), ("c", "a/x.c", "z/z.c")}


def test_shared_key_edges_link_a_hot_key_with_few_edges(spark):
    members = spark.range(3000).select(F.lit("k").alias("key"), F.col("id").alias("node"))
    edges = contraction.shared_key_edges(members)
    assert edges.count() < 3000
    groups = contraction.consolidate(edges)
    assert groups.count() == 3000 and groups.select("group_id").distinct().collect()[0][0] == 0


def brute_spans(docs, m):
    seen = {tuple(t[k : k + j]) for _, s, t in docs if s and t for k in range(len(t)) for j in range(1, len(t) - k + 1) if None not in t[k : k + j]}
    longest = lambda t, k: max((j for j in range(len(t) - k + 1) if tuple(t[k : k + j]) in seen), default=0)
    return {(i, k, n) for i, s, t in docs if s is False and t for k in range(len(t)) if (n := longest(t, k)) >= m}


@pytest.mark.parametrize("width", [1, 4, 40])
def test_shared_spans_against_brute_force(spark, monkeypatch, width):
    """Spans of unequal lengths, with the nearest reference suffix in the same or in another partition."""
    monkeypatch.setattr(cross_split, "shuffle_width", lambda _: width)
    rnd = random.Random(3)
    docs = [(i, rnd.random() < 0.5, [rnd.choice("abc") for _ in range(rnd.randrange(0, 12))]) for i in range(40)] + [(90, None, ["a"] * 9), (91, False, None), (92, False, ["a", None, "a", "b"])]
    docs += [(100, True, [f"t{k}" for k in range(30)]), (101, False, [f"t{k}" for k in range(3, 29)] + ["u"]), (102, False, ["v", *[f"t{k}" for k in range(7)], "t9", "t10"])]
    df = spark.createDataFrame(docs, "id int, seen boolean, tokens array<string>")
    for m in (1, 4):
        want = brute_spans(docs, m)
        assert {tuple(r) for r in cross_split.shared_spans(df, m).collect()} == want
        got = {r.id: (r.covered_tokens, r.n_spans) for r in cross_split.coverage(df, m).collect()}
        covered = {i: sorted({k + j for d, k, n in want if d == i for j in range(n)}) for i in {d for d, _, _ in want}}
        assert {i: c for i, (c, _) in got.items()} == {i: len(c) for i, c in covered.items()}
        assert all(n <= 1 + sum(y - x > 1 for x, y in zip(covered[i], covered[i][1:], strict=False)) + len(covered[i]) for i, (_, n) in got.items())


def test_shared_spans_beyond_the_written_length(spark, monkeypatch):
    monkeypatch.setattr(cross_split, "LONGEST", 4)
    df = spark.createDataFrame([(1, True, [f"t{k}" for k in range(20)]), (2, False, ["x", *[f"t{k}" for k in range(2, 18)], "y"])], "id int, seen boolean, tokens array<string>")
    assert [tuple(r) for r in cross_split.coverage(df, 2).collect()] == [(2, 1, 16, 18)]


def test_leaked_pairs(spark):
    schema = "pair_id bigint, side string, llm_source string, language string, human_origin_id string, candidate_origin_id string, human_code_sha256 string, candidate_code_sha256 string, tokens string"
    rows = [
        (1, "train", "g", "c", "a/1.c", "a/2.c", "d1", "d2", "x"),
        (2, "valid", "g", "c", "A\\2.C", "b", "d9", None, "x"),
        (3, "test", None, "java", "a/1.c", "b", "SHA256:D2 ", None, "x"),
        (4, "test", "g", "java", "a/1.c", "a/2.c", "d7", "d8", "x"),
        (5, None, "g", "c", "a/1.c", "a/1.c", "d1", "d1", "x"),
        (6, "valid", "g", "c", "new", "new", "d7", None, "x"),
        (7, "test", "g", None, "a/1.c", "a/1.c", None, None, "x"),
    ]
    assert {tuple(r) for r in cross_split.leaked_pairs(spark.createDataFrame(rows, schema)).collect()} == {("valid", "g", 2), ("test", None, 3)}
    assert cross_split.leaked_pairs(spark.createDataFrame([], schema)).collect() == []


def brute_near(rows, threshold=0.6):
    form = lambda s: re.sub("[^a-z0-9]", "", (s or "").lower())
    sets = lambda s: {s[i : i + 8] for i in range(len(s) - 7)}
    recs = {i: (sets(form(h)), sets(form(m))) for i, h, m in rows if form(h) and form(m)}
    like = lambda a, b: bool(a | b) and len(a & b) / len(a | b) >= threshold
    edges = [(a, b) for a in recs for b in recs if a < b and like(recs[a][0], recs[b][0]) and like(recs[a][1], recs[b][1])]
    groups = closure(recs, edges)
    size = defaultdict(int)
    for g in groups.values():
        size[g] += 1
    return {(g, i) for i, g in groups.items() if size[g] > 1}


def code(rnd, n):
    return " ".join(f"{rnd.choice(['int', 'for', 'x', 'while'])} {rnd.choice(['harbor', 'ledger', 'joint', 'quill'])}{rnd.randrange(40)} = {rnd.randrange(9999)};" for _ in range(n))


def edited(rnd, s, share):
    words = s.split(" ")
    return " ".join(w if rnd.random() > share else f"edit{rnd.randrange(999)}" for w in words)


@pytest.mark.parametrize("seed", [4, 5])
def test_near_duplicates_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows, k = [], 0
    for _ in range(12):
        h, m = code(rnd, rnd.randrange(2, 25)), code(rnd, rnd.randrange(2, 25))
        for _ in range(rnd.randrange(1, 6)):
            share = rnd.choice([0, 0.02, 0.05, 0.1, 0.2])
            rows.append((k, edited(rnd, h, share), edited(rnd, m, share).upper()))
            k += 1
    rows += [(900, None, "abcdefghijk"), (901, "", "abcdefghijk"), (902, "?!", "abcdefghijk"), (903, "abc", "abcdefghijk"), (904, "abc", "abcdefghijk")]
    rows += [(905, "abcdefgh", "abcdefgh"), (906, "ABCDEFGH", "abc defgh"), (907, "a" * 50_000, "b" * 50_000), (908, "a" * 49_000, "b" * 50_000)]
    df = spark.createDataFrame([(*r, 1, "h") for r in [*rows, rows[0]]], "record_id bigint, human_src string, llm_src string, side int, hk string")
    assert {tuple(r) for r in near_dup.near_duplicates(df).collect()} == brute_near(rows)


@pytest.mark.parametrize("hot", [10**9, 3])
def test_near_duplicates_of_large_families(spark, monkeypatch, hot):
    """Tokens set aside and chained, or spread by salt: the same groups."""
    monkeypatch.setattr(near_dup, "RUN", 2)
    monkeypatch.setattr(near_dup, "HOT", hot)
    rnd = random.Random(11)
    h, m = code(rnd, 12), code(rnd, 12)
    rows = [(i, edited(rnd, h, rnd.choice([0.01, 0.05, 0.15])), edited(rnd, m, rnd.choice([0.01, 0.05, 0.15]))) for i in range(40)]
    rows += [(50 + i, h, code(rnd, 6)) for i in range(6)] + [(60 + i, code(rnd, 6), m) for i in range(6)]
    df = spark.createDataFrame(rows, "record_id bigint, human_src string, llm_src string")
    assert {tuple(r) for r in near_dup.near_duplicates(df).collect()} == brute_near(rows)


def test_candidates_do_not_depend_on_shards(spark, monkeypatch):
    rnd = random.Random(12)
    rows = [(i, edited(rnd, h, 0.05), edited(rnd, m, 0.05)) for i, (h, m) in enumerate([(code(rnd, 9), code(rnd, 9))] * 6 + [(code(rnd, 12), code(rnd, 12)) for _ in range(12)])]
    df = spark.createDataFrame(rows, "record_id bigint, human_src string, llm_src string")
    texts = near_dup._texts(df.select("record_id", "human_src", "llm_src"))
    got = []
    for n in (1, 3, 24):
        monkeypatch.setattr(near_dup, "shard_counts", lambda *_, n=n: {0: n, 1: n + 1})
        got.append({tuple(r) for r in near_dup.group_pairs(near_dup.shared_counts(texts)).collect()})
    assert got[0] and got[0] == got[1] == got[2]


@pytest.mark.parametrize("members", [1, 64])
def test_groups_of_identical_prefix_and_size(spark, monkeypatch, members):
    """Texts that differ in their most frequent substrings only are one group; large groups are settled by their least member first."""
    monkeypatch.setattr(near_dup, "MEMBERS", members)
    rnd = random.Random(13)
    head, common = code(rnd, 14), [code(rnd, 6) for _ in range(3)]
    rows = [(i, head + common[i % 3], head + common[(i + 1) % 3]) for i in range(9)] + [(100 + i, common[i % 3], common[i % 2] + f" x{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "record_id bigint, human_src string, llm_src string")
    assert {tuple(r) for r in near_dup.near_duplicates(df).collect()} == brute_near(rows)


def test_chance_pairs_are_not_sent(spark, monkeypatch):
    """Of texts that share a few words by chance few counts leave their tasks; near copies are found over several blocks and waves."""
    monkeypatch.setattr(near_dup, "BLOCK_TOKENS", 400)
    rnd = random.Random(14)
    words = ["".join(rnd.choices("abcdefghij", k=24)) for _ in range(150)]
    texts = [(" ".join(rnd.sample(words, 30)), " ".join(rnd.sample(words, 30))) for _ in range(40)]
    rows = [(i, h, m) for i, (h, m) in enumerate(texts)] + [(100 + i, edited(rnd, h, 0.03), edited(rnd, m, 0.03)) for i, (h, m) in enumerate(texts[:5])]
    df = spark.createDataFrame(rows, "record_id bigint, human_src string, llm_src string")
    found = near_dup.shared_counts(near_dup._texts(df)).where("b is not null")
    counts = found.where(f"shared < {near_dup._CERTAIN}").collect()
    assert counts and all(r.shared >= near_dup.part_least(r.n) for r in counts)
    assert len(counts) < 2 * 45 * 44 // 2 // 4  # a quarter of the pairs of texts; 1,190 if all counts were sent
    assert {tuple(r) for r in near_dup.near_duplicates(df).collect()} == brute_near(rows) == {(i, j) for i in range(5) for j in (i, 100 + i)}


def test_limits_admit_every_partner():
    """A substring at place pos counts for each partner that the prefix lemma allows it for."""
    for n in (1, 7, 40, 333):
        k = int(near_dup.least_overlap(n))
        pos = near_dup.np.arange(n)
        limits = near_dup.partner_limits(near_dup.np.full(n, n), pos).astype(int)
        for m in range(max(1, math.ceil(0.6 * n)), int(n / 0.6) + 1):
            need = math.ceil(0.375 * (n + m) - 1e-9)
            assert all(m * 128 <= limits[p] * n for p in pos if p < n - need + k)


def test_near_duplicates_empty(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "record_id bigint, human_src string, llm_src string")).collect() == []


@pytest.mark.parametrize(("seeds", "hops"), [(64, 4), (3, 1), (1, 2), (10**9, 0)])
def test_components_against_closure(spark, seeds, hops):
    rnd = random.Random(6)
    edges = [(f"n{rnd.randrange(80):03}", f"n{rnd.randrange(80):03}") for _ in range(60)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(40)] + [("lone", "lone"), ("half", None), (None, None)]
    edges += [("hub", f"s{i:02}") for i in range(30)]
    got = {r.node: r.root for r in split_assign.components(spark.createDataFrame(edges, "a string, b string"), seeds, hops).collect()}
    edges = [(a, b or a) for a, b in edges if a]
    want = closure({x for e in edges for x in e}, edges)
    assert {frozenset(n for n in got if got[n] == g) for g in set(got.values())} == {frozenset(n for n in want if want[n] == g) for g in set(want.values())}


def test_splits(spark):
    rnd = random.Random(7)
    rows = [(i, f"c{rnd.randrange(150)}", f"c{rnd.randrange(150)}" if rnd.random() < 0.2 else None, rnd.choice(["g", "h", None])) for i in range(3000)]
    rows = [(i, a, b or a, s) for i, a, b, s in rows] + [(5000, None, "c1", "g"), (5001, None, None, "g")]
    shares = [("train", 0.8), ("valid", 0.1), ("test", 0.1)]
    df = spark.createDataFrame(rows, "id bigint, a string, b string, source string")
    got = {r.id: r.split for r in split_assign.assign_splits(df, shares).collect()}
    assert got.keys() == {r[0] for r in rows}
    side = {}
    for i, a, b, _ in rows:
        for c in (a, b):
            if c:
                assert side.setdefault(c, got[i]) == got[i]
    assert split_assign.assign_splits(spark.createDataFrame([], df.schema), shares).collect() == []


def test_splits_near_targets_by_source(spark):
    rows = [(i, f"c{i % 700}", f"c{i % 700}", f"g{(i * 7) % 4}") for i in range(14_000)]
    shares = [("train", 0.8), ("valid", 0.1), ("test", 0.1)]
    out = split_assign.assign_splits(spark.createDataFrame(rows, "id bigint, a string, b string, source string"), shares)
    n = out.join(spark.createDataFrame([(r[0], r[3]) for r in rows], "id bigint, source string"), "id").groupBy("source", "split").count().collect()
    for r in n:
        assert abs(r["count"] / 3500 - dict(shares)[r.split]) < 0.01


def brute_copies(recs):
    form = lambda s: re.sub("[^a-z0-9]", "", (s or "").lower())
    sets = defaultdict(set)
    for i, h, m in recs:
        if form(h) and form(m):
            sets[form(h), form(m)].add(i)
    return {(min(s), i, len(s)) for s in sets.values() for i in s}


def test_copies(spark):
    rnd = random.Random(8)
    recs = [(i, rnd.choice(["int a;", "INT  a", "int b", "", None, "x" * 30_000]), rnd.choice(["return 1", "Return\n1;", "return 2", "!!"])) for i in range(300)]
    recs += [(i, "Hot  code", "hot CODE") for i in range(1000, 1400)]
    df = spark.createDataFrame([*recs, recs[0]], "record_id bigint, human_src string, llm_src string")
    lines = [
        (2000, json.dumps({"llm_src": "hot-code", "human_src": "hotcode", "extra": 1})),
        (2001, ""),
        (2002, "{oops"),
        (2003, "[1]"),
        (2004, json.dumps({"human_src": "hot code"})),
        (2005, json.dumps({"human_src": "hot code", "llm_src": None})),
        (2006, None),
        (2007, json.dumps({"human_src": 5, "llm_src": "hot code"})),
    ]
    canon = canonical_dups.canonical(df).unionByName(canonical_dups.canonical(spark.createDataFrame(lines, "record_id bigint, line string")))
    got = {tuple(r) for r in canonical_dups.copies(canon).collect()}
    assert got == brute_copies([*recs, (2000, "hot code", "hot code")])


def test_copies_empty(spark):
    assert canonical_dups.copies(canonical_dups.canonical(spark.createDataFrame([], "record_id bigint, human_src string, llm_src string"))).collect() == []


def test_parse_line():
    assert plain.parse_line('{"human_src": "a", "llm_src": "b", "x": [1]}') == ("a", "b")
    assert [plain.parse_line(x) for x in (None, " ", "null", '"s"', '{"human_src": "a"}')] == [None] * 5


def test_equal_digests_of_unlike_texts(spark):
    forms = [(b"a", b"x"), (b"b", b"x"), (b"b", b"y")]
    rows = [(b"one", i, *forms[i % 3]) for i in range(600)] + [(b"two", 900, b"a", b"z"), (b"six", 901, b"a", b"w"), (b"six", 902, b"a", b"w")]
    got = canonical_dups.copies(spark.createDataFrame(rows, "digest binary, record_id bigint, human binary, llm binary").repartition(8)).collect()
    assert sorted(map(tuple, got)) == sorted([(i % 3, i, 200) for i in range(600)] + [(900, 900, 1), (901, 901, 2), (901, 902, 2)])


def test_rows_of_pooled_sources_count_as_placed(spark, monkeypatch):
    monkeypatch.setattr(split_assign, "LARGE", 3)
    big = [(i, "big", "big", "s0" if i == 0 else None if i == 1 else f"small{i}") for i in range(60)]
    rows = [*big, *((100 + i, f"c{i}", f"c{i}", f"s{i % 3}") for i in range(60))]
    out = split_assign.assign_splits(spark.createDataFrame(rows, "id bigint, a string, b string, source string"), [("train", 0.5), ("test", 0.5)])
    n = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert n == {"train": 60, "test": 60}
