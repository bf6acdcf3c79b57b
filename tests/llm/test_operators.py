"""Edge cases of the training-data operators, against brute force where there is one."""

import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylake.llm import abuse, boilerplate, capping, near_duplicates, neighbours, overlap, packing, pair_quality, queries, splitting, tokenize
from quarrylake.llm.common import WordHashes

SMALL = "/root/testdata/sf0.001"
WORDS = [a + b for a in "alpha beta gamma delta kappa sigma omega".split() for b in "one two three four five six".split()]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- caps ---------------------------------------------------------------------


def test_cap_equals_brute_force_with_a_hot_contributor(spark):
    rnd = random.Random(1)
    data = [("hot" if i % 3 == 0 else f"c{rnd.randrange(20)}", rnd.choice([None, 1, 2, 3, -5, 10**9]), i, "x") for i in range(900)] + [(None, 1, 5000, "x")]
    d = spark.createDataFrame(data, "who string, s long, id long, position string")
    want = set()
    for who in {x[0] for x in data} - {None}:
        ordered = sorted((x for x in data if x[0] == who), key=lambda x: (x[1] is None, -(x[1] or 0), x[2]))
        want |= {x[2] for x in ordered[7:]}
    got = [r["id"] for r in capping.beyond_cap(d, "who", "s", "id", cap=7).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert capping.beyond_cap(d.limit(0), "who", "s", "id").count() == 0
    # a share of 1 % of 901 rows is 9 rows
    assert capping.beyond_cap(d, "who", "s", "id", cap=None, share=0.01).groupBy("contributor").count().count() > 1


def test_cap_by_share_of_the_same_kind(spark):
    # ten rows: kind a has six with a contributor, kind b three; a share of 0.34 is two rows of a and one of b
    data = [("a", "x", i, i) for i in range(5)] + [("a", "y", 9, 5), ("b", "x", 1, 6), ("b", "x", 2, 7), ("b", "z", 3, 8), ("a", None, 3, 9)]
    d = spark.createDataFrame(data, "kind string, who string, s long, id long")
    got = sorted((r["contributor_kind"], r["id"]) for r in capping.beyond_cap(d, "who", "s", "id", cap=None, share=0.34, kind="kind").collect())
    assert got == [("a", 0), ("a", 1), ("a", 2), ("b", 6)]
    both = sorted((r["contributor_kind"], r["id"]) for r in capping.beyond_cap(d, "who", "s", "id", cap=1, share=0.34, kind="kind").collect())
    assert both == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 6)]


def test_contributor_names(spark):
    s = ["https://WWW.A.example:443/x?y", " http://a.example", "A.example ", "", "  ", None, "scans/B.pdf"]
    got = [r["w"] for r in spark.createDataFrame([(x,) for x in s], "s string").select(capping.source_contributor(F.col("s")).alias("w")).collect()]
    assert got == ["a.example"] * 3 + [None, None, None, "scans/b.pdf"]
    a = [" The  Cat ", "Unknown", "[deleted]", "", None, "anonymous"]
    got = [r["w"] for r in spark.createDataFrame([(x,) for x in a], "s string").select(capping.author_contributor(F.col("s")).alias("w")).collect()]
    assert got == ["the cat"] + [None] * 5


# ---- splitting ----------------------------------------------------------------


@pytest.mark.parametrize("seed", range(30))
def test_pieces_cover_the_text(seed):
    rnd = random.Random(seed)
    text = "".join(rnd.choice(["word ", "a", "b. ", "\n", "\r\n\r\n", "\n \n", " ", "x" * rnd.randrange(1, 90), "! ", "é"]) for _ in range(200))
    pieces, boundary = splitting.split_text(text, 60, 15)
    assert "".join(text[s + k : e] for s, e, k in pieces) == text
    assert all(splitting.trimmed_length(text, s, e) <= 60 and 0 <= k <= 15 for s, e, k in pieces)
    cuts = {"paragraph": r"\r?\n(?:[ \t]*\r?\n)+", "line": r"\r?\n", "sentence": r"\r?\n|(?<=[.!?])[ \t]+", "word": r"[ \t\r\n]+"}
    fits = [n for n, p in cuts.items() if max(len(x.strip(splitting.BLANK)) for x in re.split(p, text)) <= 60]
    assert boundary == (fits[0] if fits else "none")


def test_split_nulls_blanks_and_long(spark):
    d = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "  \n" * 3000, 0), (4, "x" * 5000, 0), (4, "x" * 5000, 0), (5, "short", 0)], "id long, body string, piece int")
    got = splitting.split_items(d, "section", "id", "body")
    assert {r["item_id"] for r in got.collect()} == {4} and got.where("piece_index = 0").count() == 2
    assert got.select("boundary").distinct().first()[0] == "none"
    assert splitting.split_items(d.limit(0), "section", "id", "body").count() == 0


# ---- overlap of splits ----------------------------------------------------------


def test_overlaps_equal_brute_force(spark):
    rnd = random.Random(2)
    base = [[rnd.choice(WORDS) for _ in range(rnd.randrange(1, 12))] for _ in range(40)]

    def edited():
        w = list(rnd.choice(base))
        if rnd.random() < 0.6:
            w[rnd.randrange(len(w))] = rnd.choice(WORDS)
        return " ".join(w) if rnd.random() < 0.5 else " ".join(w).upper().replace("A", "Á")

    left = [(i, rnd.choice([edited(), edited(), None, "", "?!"]), "q") for i in range(150)]
    right = [(i + 1000, edited(), "q") for i in range(80)]
    a, b = spark.createDataFrame(left, "k long, q string, word string"), spark.createDataFrame(right, "k long, q string, word string")
    want = set()
    for i, x, _ in left:
        for j, y, _ in right:
            u, v = overlap.words_of(x), overlap.words_of(y)
            if u and v and 10 * len(u & v) >= 7 * len(u | v):
                want.add((i, j))
    got = [(r["left_key"], r["right_key"]) for r in overlap.set_overlaps(a, b, "k", "q", 0.7).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert overlap.set_overlaps(a.limit(0), b, "k", "q").count() == 0


def test_frequent_words_are_split(spark, monkeypatch):
    rnd = random.Random(23)
    texts = [" ".join(["hot", *(f"w{rnd.randrange(8)}" for _ in range(rnd.randrange(1, 6)))]) for _ in range(120)]
    a = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:70])], "k long, q string")
    b = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts[70:])], "k long, q string")
    whole = rows(overlap.set_overlaps(a, b, "k", "q", 0.7))
    monkeypatch.setattr(overlap, "PAIRS_A_TASK", 5)
    assert rows(overlap.set_overlaps(a, b, "k", "q", 0.7)) == whole and len(whole) > 10


# ---- near-duplicates --------------------------------------------------------------


def test_probminhash_estimates_jaccard():
    rng = np.random.default_rng(4)
    common, a, b = (rng.integers(1, 2**63, n, dtype=np.uint64) for n in (300, 100, 100))
    row = np.repeat([0, 1], [400, 400])
    sig = near_duplicates.probminhash(row, np.concatenate([common, a, common, b]), 2, 2048)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.05
    # weights: an item of weight 3 wins three times as often
    sig = near_duplicates.probminhash(np.zeros(2, int), np.array([5, 6], np.uint64), 1, 4096, np.array([3.0, 1.0]))
    assert abs((sig[0] == 5).mean() - 0.75) < 0.04


@pytest.mark.parametrize("cell", [1500, 60])
def test_blocks_of_a_large_cell_meet(spark, monkeypatch, cell):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(150, 64))
    v[50:] = v[0] + 0.05 * rng.normal(size=(100, 64))  # a shared direction fills one cell
    d = spark.createDataFrame([(2 * i, [float(y) for y in x]) for i, x in enumerate(v)], "id long, v array<double>")
    coded = neighbours.codes(d, "id", "v")

    def lists():
        out = {}
        for r in neighbours.edges(neighbours.neighbour_graph(coded, rounds=0, cell=cell)).orderBy(F.desc("sim")).collect():
            out.setdefault(r["key"], []).append(r["sim"])
        return out

    whole = lists()
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    cut = lists()
    # no list gets worse
    assert set(cut) == set(whole) and all(len(cut[k]) >= len(whole[k]) and all(a >= b - 1e-4 for a, b in zip(cut[k], whole[k])) for k in whole)


def test_near_duplicates(spark):
    rnd = random.Random(5)
    text = [" ".join(rnd.choice(WORDS) + str(rnd.randrange(99)) for _ in range(80)) for _ in range(30)]
    docs, n = [], 0
    for t in text:
        for copy in range(3):
            w = t.split(" ")
            if copy == 1:
                w[rnd.randrange(80)] = "changed"
            docs.append((n, " ".join(w).title() if copy == 2 else " ".join(w), "b"))
            n += 1
    docs += [(900, None, "b"), (901, "", "b"), (902, "too short", "b"), (903, "too short", "b")]
    d = spark.createDataFrame(docs, "doc_id long, text string, band string")
    sets = {k: set(zip(w, w[1:], w[2:])) for k, t, _ in docs for w in [(t or "").lower().split()] if len(w) >= 20}
    want = {(i, j) for i in sets for j in sets if i < j and 10 * len(sets[i] & sets[j]) >= 6 * len(sets[i] | sets[j])}
    got = rows(near_duplicates.near_duplicate_pairs(d, "doc_id", "text"))
    assert got == sorted(want) and len(got) == 90
    assert near_duplicates.near_duplicate_pairs(d.limit(0), "doc_id", "text").count() == 0
    groups = near_duplicates.near_duplicate_groups(d, "doc_id", "text").collect()
    assert len(groups) == len(docs) and {r["group_id"] for r in groups if r["doc_id"] < 3} == {0}
    assert all(r["group_id"] is None for r in groups if r["doc_id"] in (900, 901, 902, 903))


def test_a_band_of_very_many_classes_is_split(spark, monkeypatch):
    rnd = random.Random(21)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(60)]
    docs = [(i, " ".join([*base, f"x{i}", f"y{i}"])) for i in range(40)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    whole = rows(near_duplicates.near_duplicate_pairs(d, "doc_id", "text"))
    monkeypatch.setattr(near_duplicates, "BAND_BLOCK", 7)
    assert rows(near_duplicates.near_duplicate_pairs(d, "doc_id", "text")) == whole == [(i, j) for i in range(40) for j in range(i + 1, 40)]


def _exact_probability_jaccard(x, y):
    items = set(x) | set(y)
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in items) for i in set(x) & set(y))


def test_weighted_shingles_equal_exact_probability_jaccard(spark):
    rnd = random.Random(22)
    docs = []
    for i in range(12):
        words = [f"a{rnd.randrange(200)}" for _ in range(30)]
        docs.append((2 * i, " ".join(words * 3)))
        docs.append((2 * i + 1, " ".join(words * rnd.choice([2, 3, 4]) + [f"b{rnd.randrange(200)}" for _ in range(rnd.randrange(25))])))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    counts = {}
    for k, t in docs:
        w = t.split()
        counts[k] = {}
        for g in zip(w, w[1:], w[2:]):
            counts[k][g] = counts[k].get(g, 0) + 1
    want = {(i, j): s for i, _ in docs for j, _ in docs if i < j and (s := _exact_probability_jaccard(counts[i], counts[j])) >= 0.6}
    verified, members = near_duplicates.near_duplicate_classes(d, "doc_id", "text", weighted=True)
    got = {(r["low"], r["high"]): r["similarity"] for r in verified.collect()}
    assert set(got) == set(want) and len(want) > 3 and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    assert members.count() == 24


def test_long_chains_are_connected(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "low long, high long")
    got = {r["key"]: r["root"] for r in near_duplicates.connected(links).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and got[1001] == 1000


def test_pairs_of_one_common_band_are_verified(spark):
    rng = random.Random(12)
    data = []
    for i in range(700):
        words = ["w%d" % rng.randrange(10**6) for _ in range(90)]
        other = words[:68] + ["w%d" % rng.randrange(10**6) for _ in range(22)]  # similarity 66 / 110
        data += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    row, item, _ = near_duplicates.shingle_hashes([t for _, t in data], WordHashes(), 20)
    bands = near_duplicates.band_hashes(near_duplicates.probminhash(row, item, len(data), 208), 52, 4)
    agree = (bands[::2] == bands[1::2]).sum(axis=1)
    assert (agree == 1).any()
    d = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(near_duplicates.near_duplicate_pairs(d, "doc_id", "text")) == [(2 * i, 2 * i + 1) for i in np.flatnonzero(agree).tolist()]


# ---- vectors ------------------------------------------------------------------------


def test_similar_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 64))
    data = [(i, [float(x) for x in v], "c") for i, v in enumerate(base)] + [(1000 + i, [float(x) for x in base[i] + rng.normal(size=64) * 0.2], "c") for i in range(100)]
    data += [(2000, None, "c"), (2001, [0.0] * 64, "c"), (2002, [1.0] * 10, "c"), (2003, [float("nan")] * 64, "c"), (2004, data[0][1], "c")]
    d = spark.createDataFrame(data, "id long, v array<float>, code string")
    ok = [(i, np.array(v)) for i, v, _ in data if v and len(v) == 64 and np.isfinite(v).all() and any(v)]
    want = {(i, j) for i, x in ok for j, y in ok if i < j and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9}
    got = {(r["low"], r["high"]) for r in neighbours.similar_pairs(d, "id", "v").collect()}
    assert got == want and (0, 2004) in got
    assert neighbours.similar_pairs(d.limit(0), "id", "v").count() == 0
    top = neighbours.nearest(d, "id", "v", k=10, rows_a_block=150, queries_a_block=9).collect()
    exact = {(r["query_id"], r["id"]) for r in top}
    found = {(r["query_id"], r["id"]) for r in neighbours.search(d, "id", "v").collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    names = [i for i, _ in ok]
    x = np.stack([v / np.linalg.norm(v) for _, v in ok])
    for q in {r["query_id"] for r in top}:
        mine = [r["id"] for r in sorted((r for r in top if r["query_id"] == q), key=lambda r: r["rank"])]
        s = x @ x[names.index(q)]
        s[names.index(q)] = -2
        assert len(set(mine) & {names[i] for i in np.argsort(-s)[:10]}) >= 9
    assert {r["query_id"] for r in top} == {i for i in names if i % 20 == 0}


def _random_vectors(spark, rng, n):
    v = rng.normal(size=(n, 12)) @ rng.normal(size=(12, 64)) + 0.3 * rng.normal(size=(n, 64))  # of few directions, as embeddings are
    return v / np.linalg.norm(v, axis=1, keepdims=True), spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "id long, v array<float>")


def test_no_pair_of_a_crowd_is_lost(spark):
    rng = np.random.default_rng(10)
    crowd = rng.normal(size=64) + 0.02 * rng.normal(size=(60, 64))
    d = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(np.concatenate([crowd, rng.normal(size=(500, 64))]))], "id long, v array<float>")
    got = [(r["low"], r["high"]) for r in neighbours.similar_pairs(d, "id", "v").collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i in range(60) for j in range(i + 1, 60)}  # 1,770 pairs


def test_metric_join_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(13)
    base = rng.normal(size=(20, 64))
    v = np.repeat(base, 30, axis=0) + 0.3 * rng.normal(size=(600, 64))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = spark.createDataFrame([(2 * i, [float(y) for y in x]) for i, x in enumerate(v)], "key long, v array<float>")
    monkeypatch.setattr(neighbours, "BLOCK", 25)
    got = {(r["a"] // 2, r["b"] // 2) for r in neighbours._metric_join(d, 0.9, rows_a_pivot=40).collect()}
    sure = {(int(i), int(j)) for i, j in np.argwhere(u @ u.T >= 0.9001) if i < j}
    assert sure <= got and all(u[i] @ u[j] > 0.8999 for i, j in got) and len(sure) > 1000


def test_copies_of_a_vector(spark):
    rng = np.random.default_rng(14)
    x, y = ([float(z) for z in rng.normal(size=64)] for _ in range(2))
    near = [z + 0.01 for z in x]
    d = spark.createDataFrame([(i, x) for i in range(40)] + [(40, near), (41, near), (42, y), (43, None)], "id long, v array<float>")
    got = [(r["low"], r["high"]) for r in neighbours.similar_pairs(d, "id", "v").collect()]
    assert sorted(got) == [(i, j) for i in range(42) for j in range(i + 1, 42)]
    top = neighbours.search(d, "id", "v").collect()
    assert len([r for r in top if r["query_id"] == 0]) == 10 and all(r["cosine"] == 1.0 for r in top if r["query_id"] in (0, 20)) and {r["query_id"] for r in top} == {0, 20, 40}
    # a number of the other kind is another collection
    two = d.where("id < 4").withColumn("kind", (F.col("id") > 1).cast("int"))
    assert sorted((r["kind"], r["low"], r["high"]) for r in neighbours.similar_pairs(two, "id", "v", "kind").collect()) == [(0, 0, 1), (1, 2, 3)]


def test_rounds_improve_the_lists_until_they_settle(spark):
    u, d = _random_vectors(spark, np.random.default_rng(11), 3000)
    coded, log = neighbours.codes(d.withColumn("id", F.col("id") * 2), "id", "v"), []
    truth = np.argsort(-(u @ u.T), axis=1)[:, 1:11]

    def recall(rounds, log=None):
        lists = {}
        for r in neighbours.edges(neighbours.neighbour_graph(coded, tables=1, cell=100, rounds=rounds, log=log)).collect():
            lists.setdefault(r["key"] // 2, set()).add(r["other"] // 2)
        assert len(lists) == 3000 and all(0 < len(x) <= neighbours.K for x in lists.values())
        return np.mean([len(lists[i] & set(truth[i].tolist())) / 10 for i in range(3000)])

    first, last = recall(0), recall(None, log)
    assert last > first + 0.3 and last > 0.75 and log[-1][2] < 0.01 * 3000 and [x[0] for x in log] == list(range(1, len(log) + 1))


def test_greedy_search_for_rows_outside_the_graph(spark):
    u, d = _random_vectors(spark, np.random.default_rng(12), 3000)
    coded = neighbours.codes(d.withColumn("id", F.col("id") * 2), "id", "v")
    graph = neighbours.neighbour_graph(coded.where("key < 5900"), cell=300)
    found = neighbours.graph_search(graph, coded.where("key >= 5900").select("key", "code"), 40).collect()
    truth = np.argsort(-(u[2950:] @ u[:2950].T), axis=1)[:, :10]
    got = {}
    for r in found:
        got.setdefault(r["key"] // 2, set()).add(r["other"] // 2)
    assert np.mean([len(got[2950 + i] & set(t.tolist())) / 10 for i, t in enumerate(truth)]) >= 0.9


# ---- tokens ---------------------------------------------------------------------------


def test_tokens_equal_the_public_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenize.vocabulary_path())
    t.encode_special_tokens = True
    rnd = random.Random(7)
    texts = ["", " ", "<|endoftext|>", "naïve café 😀 ​\x00", "a" * 3000, "  \n\n\t x", "it's they'LL", "日本語" * 50, "٣٤"] + ["".join(rnd.choice(string.printable + "éñ€") for _ in range(rnd.randrange(200))) for _ in range(200)]
    texts += ["a" * 20_000, "".join(rnd.choice(string.ascii_letters) for _ in range(30_000)), "é😀" * 5000, "12345" * 4000]
    enc = tokenize.PrefixEncoder(tokenize.vocabulary_path())
    offsets, ids = enc.encode_batch(texts + [None])
    got = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)] + [[]]
    # words one by one and words in blocks have the same ids
    words = [w for w in {x for text in texts for x in enc.find(text)} if len(w) < 2000]
    alone = tokenize.PrefixEncoder(tokenize.vocabulary_path())
    alone.LONG = 1
    assert all(np.array_equal(p, q) for p, q in zip(enc.encode_batch(words), alone.encode_batch(words)))
    # a part of another token that has the hash of a token is not taken for it
    broken = tokenize.PrefixEncoder(tokenize.vocabulary_path())
    broken.bytes[:, 0] ^= 1
    assert broken.bytes[300, 0] != enc.bytes[300, 0]
    with pytest.raises(Exception):
        got = broken.encode_batch(["Zxqv"])
        assert got[1].tolist() == enc.encode_batch(["Zxqv"])[1].tolist()
    d = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "hi", 1), (3, "hi", 1)], "doc_id long, text string, ids int")
    out = [(r["doc_id"], list(r["ids"])) for r in tokenize.encode(d, "doc_id", "text").orderBy("doc_id").collect()]
    assert out == [(1, []), (2, []), (3, [5303]), (3, [5303])]
    assert tokenize.encode(d.limit(0), "doc_id", "text").count() == 0


# ---- packing ----------------------------------------------------------------------------


def test_fill_keeps_rules():
    rnd = random.Random(8)
    sizes = [rnd.randrange(1, 100) for _ in range(2000)]
    clusters = [rnd.choice([None, rnd.randrange(300)]) for _ in sizes]
    sources = [rnd.choice([*"abcdefghijklmnopqrstuvwxyz", None]) for _ in sizes]
    bins, rules = packing.fill(sizes, sources, clusters, 100)
    assert sorted(i for b in bins for i in b) == list(range(2000))
    loads = [sum(sizes[i] for i in b) for b in bins]
    assert max(loads) <= 100 and sum(loads) / len(loads) > 97
    for b in bins:
        found = packing.conflict_of(b, sources, clusters)
        assert {"copy"} & set(found) <= ({"copy"} if "none" in [rules[i] for i in b] else set())
        assert all(rules[i] == "both" for i in b) is False or set(found) == {"none"}
    assert packing.fill([], [], []) == ([], [])


def test_fill_with_a_thousand_copies():
    rnd = random.Random(9)
    sizes = [50] * 1000 + [rnd.randrange(10, 800) for _ in range(9000)]
    clusters = [7] * 1000 + [None] * 9000
    sources = [rnd.choice("abcdefghijklmnopqrstuvwx") if rnd.random() < 0.67 else "hot" for _ in sizes]  # a source with a third of all
    bins, rules = packing.fill(sizes, sources, clusters)
    assert sum(sizes) / (2048 * len(bins)) >= 0.98
    # no two copies meet, as there are more containers than copies
    assert all("copy" not in packing.conflict_of(b, sources, clusters) for b in bins)
    # where there is nothing but copies, they are packed nevertheless, and counted
    only, _ = packing.fill([10] * 1000, ["a"] * 1000, [1] * 1000, 100)
    assert len(only) == 100 and sum(packing.conflict_of(b, ["a"] * 1000, [1] * 1000).count("copy") for b in only) == 900


def test_pack(spark):
    d = spark.createDataFrame([(1, "word " * 5000, "s", 0), (2, None, "s", 0), (3, "", None, 0), (4, "short text", None, 0)], "doc_id long, text string, source string, size int")
    got = packing.pack(d, "doc_id", "text", "source", shards=2).collect()
    parts = sorted((r["part"], r["token_start"], r["n_tokens"]) for r in got if r["doc_id"] == 1)
    assert [p for p, _, _ in parts] == list(range(len(parts))) and all(s == 2048 * p for p, s, _ in parts) and all(n == 2048 for _, _, n in parts[:-1])
    assert {r["doc_id"] for r in got} == {1, 4}
    line = " ".join(f"w{i}" for i in range(60))
    few = spark.createDataFrame([(i, line if i < 5 else f"{line} x{i}" if i < 8 else f"other text {i} of its own " * 9, f"s{i}") for i in range(40)], "doc_id long, text string, source string")
    out = packing.pack(few, "doc_id", "text", "source", shards=1)
    at = {r["doc_id"]: r["container"] for r in out.collect()}
    one = packing.conflicts(out).first()
    assert len(at) == 40 and one["n_rows"] == 40 and one["n_containers"] == len(set(at.values())) and one["n_copies"] == sum(r["conflict"] == "copy" for r in out.collect())
    assert packing.pack(few, "doc_id", "text", "source", rows_a_shard=10).count() == 40
    assert packing.pack(d.limit(0), "doc_id", "text", "source").count() == 0


# ---- pages ---------------------------------------------------------------------------------

ARTICLE = ["Title of the page", "A first paragraph, long enough to count, with commas and a full stop.", "A second paragraph that says a little more about the matter at hand."]
MENU = ["Home", "Search", "Sign in"]


def page(n):
    html = "<html><head><title>Title of the page</title></head><body><nav>" + "".join(f"<li><a href='x'>{m}</a></li>" for m in MENU) + "</nav><div class='c'><h1>" + ARTICLE[0] + "</h1>" + "".join(f"<p>{t} {n}.</p>" for t in ARTICLE[1:]) + "</div></body></html>"
    return html, "\n".join(MENU + [ARTICLE[0]] + [f"{t} {n}." for t in ARTICLE[1:]])


def test_pages(spark):
    data = [(i, *page(i), None, "m") for i in range(10)] + [(50, None, page(3)[1], "Title of the page", "m"), (51, "<div><p>broken", None, None, "m"), (52, "", "Home\nSearch", None, "m"), (53, None, None, None, "m")]
    d = spark.createDataFrame(data, "id long, html string, text string, title string, main string")
    got = {}
    for r in boilerplate.label_lines(d, "id", "html", "text", "title").collect():
        got.setdefault(r["id"], {})[r["line_no"]] = r["main"]
    for i in [*range(10), 50]:
        assert [got[i][n] for n in range(1, 7)] == [False] * 3 + [True] * 3
    assert got[52] == {1: False, 2: False} and 51 not in got and 53 not in got
    assert boilerplate.label_lines(d.limit(0), "id", "html", "text", "title").count() == 0


def test_lines_far_apart_and_very_long_ones():
    blocks = [f"Paragraph number {i} of the page, long enough to count, with a full stop." for i in range(40)]
    html = "<body><div class='c'>" + "".join(f"<p>{t}</p>" for t in blocks) + "</div></body>"
    # the text lacks thirty blocks in a row; what follows is found all the same
    lines = [blocks[0], *blocks[31:]]
    assert boilerplate.main_lines(html, "\n".join(lines), None, {}) == [True] * 10
    long = "menu " * 200
    assert boilerplate.folded(long) == boilerplate.folded(long.upper()) and len(boilerplate.folded(long)) < 60
    assert boilerplate.main_lines(html, long + "\n" + blocks[0], None, {boilerplate.folded(long): False}) == [False, True]


# ---- broken pairs ------------------------------------------------------------------------------


def test_defects(spark):
    bank = spark.read.parquet("/root/testdata/sf0.01/question_bank.parquet").selectExpr("row_no", "question q", "expected_answer_summary a", "lang defect")
    q = bank.where("row_no = 1").first()["q"]
    odd = [(10**6 + i, q, a, "x") for i, a in enumerate([None, "", "<p></p>", q, q.upper(), "Je refuse de répondre, demandez à quelqu'un d'autre."])] + [(2 * 10**6, None, None, "x"), (2 * 10**6 + 1, None, "*NONE", "x")]
    both = bank.unionByName(spark.createDataFrame(odd, bank.schema))
    got = {r["row_no"]: r["defect"] for r in pair_quality.find_defects(both, "row_no", "q", "a").collect()}
    assert [got.get(10**6 + i) for i in range(6)] == ["empty"] * 3 + ["copies_question"] * 2 + ["refusal"]
    assert got[2 * 10**6] == "empty" and 2 * 10**6 + 1 not in got
    assert 0.05 < len(got) / both.count() < 0.2
    assert pair_quality.find_defects(bank.limit(0), "row_no", "q", "a").count() == 0


def test_defect_model_on_held_out_examples(spark, tmp_path):
    bank = spark.read.parquet("/root/testdata/sf0.01/question_bank.parquet").collect()
    pairs = [(r["question"], r["expected_answer_summary"]) for r in bank]
    model = pair_quality.fit_model(pairs[:1500])
    rng = np.random.default_rng(99)
    sound = [(q, a, pair_quality._language(q)) for q, a in pairs[1500:] if q and a and len(a) > 80 and a.strip().endswith(".") and pair_quality._language(q) and pair_quality._language(q) == pair_quality._language(a)]
    broken = pair_quality.broken_examples(sound, rng)
    which, _ = model.defects([q for q, _, _ in broken], [a for _, a, _ in broken], WordHashes())
    assert np.mean(which == [d for _, _, d in broken]) > 0.93
    # a saved model says the same
    pair_quality.save(model, str(tmp_path / "pairs.npz"))
    again, _ = pair_quality.load(str(tmp_path / "pairs.npz")).defects([q for q, _, _ in broken], [a for _, a, _ in broken], WordHashes())
    assert np.array_equal(which, again)


# ---- abuse ---------------------------------------------------------------------------------------


def test_abuse(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", F.lit("z").alias("category"))
    labels = spark.read.parquet("/root/testdata/sf0.1/review_labels.parquet")
    chain = abuse.fitted_chain(docs, labels, "doc_id", "text", "label")
    more = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "y0u 4r3 such a fuck1ng 1d10t"), (10**6 + 3, "You are such a s t u p i d idiot."), (10**6 + 4, "Profanity such as idiot or porn is masked by the filter; the list is kept in X."), (10**6 + 5, "I hate immigrants, deport every last one of this vermin"), (10**6 + 6, "Frее хxx pоrn movies for adults")]
    # sentences that no example phrase resembles
    more += [(10**6 + 7, "y0u 4r3 n0th1ng but 4 w0rthl3$$ 1d10t"), (10**6 + 8, "Y o u w o r t h l e s s idiot."), (10**6 + 9, "The word filter rejects postings that contain terms such as idiot or porn; the list is kept in X."), (10**6 + 10, "All immigrants are vermin and should be driven out"), (10**6 + 11, "Frее hardcоrе pоrn with hоrny men, no sign-up")]
    odd = spark.createDataFrame([(k, t, "z") for k, t in more], docs.schema)
    got = {r["doc_id"]: (r["category"], r["score"]) for r in abuse.apply_chain(chain, odd, "doc_id", "text").collect()}
    assert len(got) == len(more) and got[10**6] == (None, 0.0) and got[10**6 + 1] == (None, 0.0)
    assert [got[10**6 + i][0] for i in range(2, 12)] == ["abusive", "abusive", None, "hateful", "sexual"] * 2
    abuse.save(chain, str(tmp_path / "chain.npz"))
    again = {r["doc_id"]: (r["category"], r["score"]) for r in abuse.apply_chain(abuse.load(str(tmp_path / "chain.npz")), odd, "doc_id", "text").collect()}
    assert again == got
    few = docs.where("doc_id % 10 = 0")
    flagged = {r["doc_id"]: r["category"] for r in abuse.apply_chain(chain, few, "doc_id", "text").where("category is not null").collect()}
    assert 0.01 < len(flagged) / few.count() < 0.06
    assert abuse.scores(docs.limit(0), labels.limit(0), "doc_id", "text", "label").count() == 0


def test_abuse_is_learned_from_labels():
    """Half of the few labels (about 25 documents of the three categories) teach, the other half judge."""
    import pyarrow.parquet as pq

    text = dict(zip(*(c.to_pylist() for c in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).columns)))
    names = [(r["doc_id"], r["label"]) for r in pq.read_table("/root/testdata/sf0.1/review_labels.parquet").to_pylist() if r["doc_id"] in text]
    held = {k for k, _ in names if k % 2}
    chain = abuse.train([(text[k], c) for k, c in names if k not in held], [t for k, t in text.items() if k % 5 == 0])
    judged = sorted({k for k in held if {c for j, c in names if j == k} <= {"hateful", "sexual", "clean"}})
    p = chain.documents([text[k] for k in judged], abuse.Words(chain.lexicon)) / chain.thresholds
    bad = np.array([any(c in abuse.CATEGORIES for j, c in names if j == k) for k in judged])
    assert (p.max(axis=1) >= 1)[bad].mean() > 0.4 and (p.max(axis=1) >= 1)[~bad].mean() < 0.03 and bad.sum() > 10


def _plain(text):
    return " ".join(re.findall(r"\w+", text.lower()))


def test_no_text_of_the_tables_in_the_examples():
    import ahocorasick
    import pyarrow.parquet as pq

    said = [s for s, _ in abuse.seed_phrases()] + [s for by in abuse.PHRASES.values() for x in by.values() for s in x]
    said += [s for parts in pair_quality.REFUSALS.values() for x in parts for s in x] + [s for x in pair_quality.REMARKS.values() for s in x] + list(pair_quality.LEAD_INS.values())
    parts = {p for s in said for x in re.split(r"\{\w\}", s) if len((p := _plain(x)).split()) >= 3}
    found = ahocorasick.Automaton()
    for p in parts:
        found.add_word(f" {p} ", p)
    found.make_automaton()
    for table, column in (("documents", "text"), ("question_bank", "expected_answer_summary")):
        for t in pq.read_table(f"/root/testdata/sf0.1/{table}.parquet", columns=[column])[column].to_pylist():
            assert not t or not list(found.iter(f" {_plain(t)} "))
    assert len(parts) > 200


def test_bounded_sample_of_any_table(spark):
    from quarrylake.llm.linear import bounded_sample

    d = spark.range(20_000).withColumn("word", F.lit(None).cast("string"))
    few = bounded_sample(d, "id", 500)
    assert 400 < len(few) < 620 and [r["id"] for r in few] == [r["id"] for r in bounded_sample(d.repartition(7), "id", 500)]
    assert len(bounded_sample(d.limit(0), "id", 5)) == 0 and len(bounded_sample(spark.range(3), "id", 50)) == 3
    same = bounded_sample(spark.range(1000).select(F.lit(1).alias("id")), "id", 10)
    assert len(same) <= 15


# ---- queries ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    got = df.collect()
    assert len(got) == len({str(r) for r in got}) or name == "p8_ids"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SMALL}/{f}'")
    columns = sorted(queries.QUERIES[name](spark, SMALL).columns)
    want = sorted(tuple(r) for r in con.execute(f"select {', '.join(columns)} from ({queries.SQL[name]})").fetchall())
    assert rows(queries.QUERIES[name](spark, SMALL).select(*columns)) == want


def test_slices_of_a_round_are_the_round_and_lists_come_back_as_stored(spark):
    sizes = np.array([3, 0, 16, 1])
    entries = np.zeros(20, neighbours._ENTRY)
    entries["other"], entries["sim"], entries["fresh"] = np.arange(20) * 10**15, np.linspace(-1, 1, 20), np.arange(20) % 2
    stored = neighbours._blobs(np.concatenate([[0], np.cumsum(sizes)]), entries)
    assert stored[0].as_py()[-3:] == bytes([0, 1, 0])  # the last bytes of the three entries
    got, back = neighbours._entries(stored)
    assert got.tolist() == sizes.tolist() and (back == entries).all()
    v = np.random.default_rng(4).normal(size=(300, 64))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    graph = neighbours.neighbour_graph(neighbours.codes(df, "id", "v").select("key", "code"), tables=1, cell=100, rounds=0)
    meet = lambda *slices: sorted((r["at"], r["key"], r["fresh"]) for r in neighbours._meetings(graph, 1, 4, *slices).collect())
    parts = [meet(i, 3) for i in range(3)]
    assert sorted(sum(parts, [])) == meet() and all(parts)


def test_largest_of_strips_are_the_largest(spark):
    random = np.random.default_rng(8)
    for n in (1, 5, 97, 101, 3001):
        sims = np.round(random.normal(size=(40, n)).astype(np.float32), 2)
        few = min(6, n)
        got = neighbours._largest(sims, few)
        assert all(len(set(row)) == few for row in got.tolist())
        assert (np.sort(np.take_along_axis(sims, got, axis=1)) == np.sort(sims)[:, -few:]).all()


def test_rows_that_meet_bring_their_codes_and_hubs_are_spread_over_tasks(spark):
    v = np.random.default_rng(4).normal(size=(300, 64))
    v[::2] = v[0] + v[::2] / 10  # keys of one kind near a centre
    v[0] *= 3
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    graph = neighbours.neighbour_graph(neighbours.codes(df, "id", "v").select("key", "code"), tables=1, cell=100, rounds=0)
    own = {r["key"]: (bytes(r["code"]), r["bar"]) for r in graph.collect()}
    meet = lambda hubs: neighbours._meetings(graph, 1, 4, hubs=hubs).collect()
    whole = meet(None)
    assert whole and all((bytes(r["code"]), r["bar"]) == own[r["key"]] for r in whole)
    links = {}
    for r in graph.collect():
        for e in neighbours._entries(pa.array([r["picks"]], pa.binary()))[1]["other"].tolist():
            links[e] = links.get(e, 0) + 1
    assert neighbours._hubs(graph, max(links.values())) is None
    hubs = neighbours._hubs(graph, 8)
    assert {r["at"]: r["tasks"] for r in hubs.collect()} == {k: -(-n // 8) for k, n in links.items() if n > 8}
    spread = meet(hubs)
    plain = lambda found: sorted((r["at"], r["key"], r["fresh"]) for r in found)
    assert plain(spread) == plain(whole) and {r["task"] for r in whole} == {0} and len({r["task"] for r in spread}) > 1


def test_codes_leave_out_the_vectors_that_are_not_usable(spark):
    good = [0.5] * 64
    odd = [good, None, good[1:], [], [0.0] * 64, [None, *good[1:]], [float("nan"), *good[1:]], [float("inf"), *good[1:]], [1e300, -1e300, *good[2:]], [-0.0] * 63 + [1e-300]]
    df = spark.createDataFrame(list(enumerate(odd)), "id long, v array<double>").coalesce(1)
    want = sorted(r["id"] for r in df.where(neighbours.usable(df["v"])).collect())
    assert sorted(r["key"] for r in neighbours.codes(df, "id", "v").collect()) == want == [0, 8, 9]


def test_shingles_of_a_batch_are_those_of_its_words(monkeypatch):
    odd = ["", None, "one", "a b c d e f", "A B c D e\tF g", "x " * 40, "İstanbul ΑΣ ΣΑΣ. ΑΣ", "日本語 １２３ ½²", "a_b__c \U0001f600 é ź y", "l" * 3000 + " m n o p"]
    random_ = random.Random(5)
    texts = odd + ["".join(chr(random_.choice([random_.randrange(32, 127), random_.randrange(32, 0x3000), 32])) for _ in range(150)) for _ in range(200)] + [None, ""]
    for points in (near_duplicates.POINTS, 500):  # many texts at once, few at once
        monkeypatch.setattr(near_duplicates, "POINTS", points)
        for size, least in ((3, 4), (5, 5)):
            row, item, times = near_duplicates.shingle_hashes(texts, WordHashes(), least, size)
            row_, item_, times_ = near_duplicates.batch_shingles(texts, least, size)
            assert (row == row_).all() and len(row)
            assert (np.bincount(row, times) == np.bincount(row_, times_)).all()
            assert len(np.unique(item)) == len(np.unique(item_))
    assert all(len(x) == 0 for x in near_duplicates.batch_shingles(["a b", None, ""], 3))
    assert near_duplicates.hashed_words([])[1].tolist() == []


def test_few_long_words_are_encoded_one_by_one(monkeypatch):
    path = tokenize.vocabulary_path()
    letters = random.Random(6)
    words = ["".join(letters.choice("abcdeENDS-=. ").strip() or "-" for _ in range(n)) for n in (64, 65, 90, 200, 400)] + ["-" * 300, "=" * 64, "short", "日本" * 40]
    some = tokenize.PrefixEncoder(path)
    alone = []
    monkeypatch.setattr(some, "_encode_long", lambda w, one=some._encode_long: alone.append(w) or one(w))
    got = some.encode_batch(words)
    assert alone and all(len(w) < tokenize.PrefixEncoder.LONG for w in alone)
    blocks = tokenize.PrefixEncoder(path)
    monkeypatch.setattr(blocks, "SCARCE", 0)
    want = blocks.encode_batch(words)
    assert all(np.array_equal(x, y) for x, y in zip(got, want))
    assert np.diff(want[0]).tolist() == some.count_batch(words).tolist()
