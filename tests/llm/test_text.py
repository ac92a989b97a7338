"""Problems 6 to 8: filling containers, leak search and garbled text."""

import random
from collections import Counter

import pytest

from twinloom.llm import leak_search, mojibake, packing


def optimum(sizes, capacity):
    """Least number of containers by exhaustive search."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                place(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def used(patterns):
    out = Counter()
    for p, times in patterns:
        for s, m in p.items():
            out[s] += m * times
    return dict(out)


@pytest.mark.parametrize("seed", range(40))
def test_reduction_keeps_the_optimum(seed):
    rnd = random.Random(seed)
    capacity = rnd.randrange(6, 30)
    counts = Counter(rnd.randrange(1, capacity + 1) for _ in range(rnd.randrange(1, 9)))
    sizes = sorted(counts.elements(), reverse=True)
    fixed, left = packing.reduce_instance(dict(counts), capacity)
    assert all(sum(s * m for s, m in p.items()) <= capacity for p, _ in fixed)
    n = sum(t for _, t in fixed)
    assert n + optimum(sorted(Counter(left).elements(), reverse=True), capacity) == optimum(sizes, capacity)
    whole = packing.pack(dict(counts), capacity)
    assert used(whole) == dict(counts) and all(sum(s * m for s, m in p.items()) <= capacity for p, _ in whole)


def test_fill_containers(spark):
    rnd = random.Random(1)
    sizes = [(i, rnd.choice([0, 7, 7, 7, rnd.randrange(1, 100), 250])) for i in range(600)]
    rows = packing.fill_containers(spark.createDataFrame([*sizes, (3, 50)], "doc_id bigint, n_tokens bigint"), 100).collect()
    room = Counter()
    whole = Counter()
    for r in rows:
        room[r.container_id] += r.n_tokens
        whole[r.doc_id] += r.n_tokens
    want = Counter(dict(sizes))
    want[3] += 50
    assert max(room.values()) <= 100 and {k: v for k, v in whole.items() if v} == {k: v for k, v in want.items() if v}
    assert len(rows) == 601 + sum(2 for _, n in sizes if n == 250)
    assert len(room) <= -(-sum(want.values()) // 100) + 2
    assert packing.fill_containers(spark.createDataFrame([], "doc_id bigint, n_tokens bigint")).collect() == []


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world", 9), (2, "", 9), (3, None, 9), (4, "x" * 20_000, 9)], "doc_id bigint, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in packing.token_counts(df).collect()}
    assert got[2] == got[3] == 0 and 1 < got[1] < 6 and got[4] > 100


def brute_leaks(docs, items, m):
    win = {}
    for i, t in items:
        w = leak_search.words(t)
        for k in range(len(w) - m + 1):
            win.setdefault(tuple(w[k : k + m]), set()).add(i)
    return {(d, i) for d, t in docs for w in [leak_search.words(t)] for k in range(len(w) - m + 1) for i in win.get(tuple(w[k : k + m]), ())}


@pytest.mark.parametrize("m", [2, 4, 13])
def test_leaks_against_brute_force(spark, m):
    rnd = random.Random(m)
    word = lambda: rnd.choice(["ab", "Ab", "c", "dé", "e_f", "7"])
    items = [(i, " ".join(word() for _ in range(rnd.randrange(0, 30)))) for i in range(15)] + [(90, None), (91, "")]
    docs = [(i, ", ".join(word() for _ in range(rnd.randrange(0, 60)))) for i in range(40)] + [(80, items[3][1]), (81, None), (82, ""), (83, "ab " * 20_000)]
    d, q = spark.createDataFrame([(*x, 0) for x in [*docs, docs[0]]], "doc_id bigint, text string, item_id int"), spark.createDataFrame([*items, items[0]], "item_id bigint, text string")
    want = brute_leaks(docs, items, m)
    assert sorted(map(tuple, leak_search.find_leaks(d, q, m).collect())) == sorted(want)
    assert {tuple(r) for r in leak_search.find_leaks(d, q, m, patterns_a_pass=5).collect()} == want
    assert leak_search.find_leaks(d.limit(0), q, m).collect() == [] and leak_search.find_leaks(d, q.limit(0), m).collect() == []


TEXTS = [
    "Der Präsident überträgt die Straße für größere Büros – „sehr gut“",
    "Señor presidente, la reparación seguirá mañana según la comisión; ¿por qué?",
    "Le député relève où la forêt s’avère coûteuse après l’été à Besançon",
    "The café’s naïve rôle – £45 and €90, “quite” so",
]


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(9)
    return [(i, " ".join(rnd.sample(TEXTS[i % 4].split(" "), 8)) + f" {i}") for i in range(2000)]


def test_chains_restore_garbled_words():
    for word in "Präsident señor coûteuse café’s „sehr – €90,".split(" "):
        for chain, bad in mojibake.garble(word).items():
            assert mojibake.chains(bad).get(chain, word) == word


def test_found_and_restored(spark, corpus):
    bad = {}
    for k, (wrong, right) in enumerate([("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp1251", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8"), ("cp437", "cp1252"), ("cp1251", "cp1252")]):
        for j in range(4):
            text = TEXTS[j].replace("„", "").replace("“", "")
            bad[10_000 + 4 * k + j] = (text, " ".join(mojibake.garble(w).get((wrong, right), w) for w in text.split(" ")))
    # words kept on purpose: other scripts and capitals, seen in the corpus
    plain = [(i, t + (" СОЮЗ Łódka São" if i % 10 == 0 else "")) for i, t in corpus]
    rows = [*plain, *((i, g) for i, (_, g) in bad.items()), (20_000, "daf�r ist"), (20_001, None), (20_002, ""), (20_003, "plain ascii"), (20_004, "café decomposed"), (20_005, "é" * 30_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, words int")
    got = {r.doc_id: r for r in mojibake.repair(df).collect()}
    assert set(got) == set(bad) | {20_000}
    assert got[20_000].n_lost == 1
    right = sum(got[i].restored == t for i, (t, _) in bad.items())
    assert right >= 0.8 * len(bad)


def test_garbled_into_a_common_character(spark, corpus):
    """A garbled character that is common itself (German sz) doesn't spare a word from being scored; words that can be read as UTF-8 by chance are trained on."""
    german = [(30_000 + i, f"Die Straße weiß, daß der große Fußweg heißt, gemäß Maß {i}") for i in range(2000)]
    clean = [(40_000 + i, f"la cámara láctea dio la página {i}") for i in range(40)] + [(50_000 + i, f"l’été de l’élection, m’écrivent {i}") for i in range(200)]
    bad = {60_000: ("la cßmara", "la cámara"), 60_001: ("dio lßctea", "dio láctea"), 60_002: ("la pßgina", "la página"), **{60_010 + i: ("lÆΘtΘ de lÆΘlection,", "l’été de l’élection,") for i in range(9)}}
    df = spark.createDataFrame([*corpus, *german, *clean, *((i, g) for i, (g, _) in bad.items())], "doc_id bigint, text string")
    assert {r.doc_id: r.restored for r in mojibake.repair(df).collect()} == {i: t for i, (_, t) in bad.items()}


def test_unseen_characters_have_no_counts():
    model = mojibake.Model(mojibake.gram_counts({"é": 5}) | {mojibake._slot(1, "D\x90"): 1000})  # another gram's slot
    assert model.count("D\x90") == 0 and model.count("é\x03") == 5


def test_no_clean_records(spark):
    schema = "doc_id bigint, text string"
    assert mojibake.garbled_words(spark.createDataFrame([], schema)).collect() == []
    assert mojibake.garbled_words(spark.createDataFrame([(1, None), (2, "abc")], schema)).collect() == []


def test_margin_separates():
    bins = {(False, -2): 1000, (False, 8): 1, (True, 30): 500, (True, 4): 5}
    assert 4.0 < mojibake.choose_margin(bins) <= 15.0
    assert mojibake.choose_margin({}) == 6.0
