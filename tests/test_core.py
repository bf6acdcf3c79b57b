"""Hand-made rows for the core operators, and the registered SQL on the small tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrylake.functions import scores as S
from quarrylake.functions import text as T
from quarrylake.operators import dedupe, evaluation, html, quality, retrieval, structure, trace, vectors
from quarrylake.plans import catalogue
from quarrylake.sources import store
from quarrylake.streaming import trace_stream

SMALL = "/root/testdata/sf0.001"


def column(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "f, value, want",
    [
        (T.collapse_whitespace, "a\r\n\r\n\r\n b\t\tc ", "a\n\nb c"),
        (T.fold, "  Él  ÑANDÚ\n", "el nandu"),
        (T.slug, "Éste (uno) 2!", "este-uno-2"),
        (T.slug, "¿?", "item"),
        (lambda c: T.snippet(c, 5), "abcdefgh", "abcde…"),
        (lambda c: T.snippet(c, 50), " a\nb ", "a b"),
        (T.decode_entities, "&lt;b&gt; &amp;amp;", "<b> &amp;"),
        (T.normalize_url, "HTTP://A.example/x/?view=kc&y#z", "http://a.example/x"),
        (T.normalize_question, "Q12: How?  Answer: so", "How?"),
        (T.normalize_version, " v 7.4 ", "7.4"),
        (T.normalize_version, "  ", None),
        (T.redact, 'token = "abc", Authorization: Bearer zzz', 'token=[REDACTED], Authorization: [REDACTED]'),
        (T.section_kind, "Parámetros y Sintaxis", "syntax"),
        (T.normalize_passage, "A  b\n\nX > Y > Z\n\na B\n\nParent topic: q", "A b"),
        (T.token_hint, "abcde", 2),
        (T.slug, None, "item"),
        (T.fold, "Ångström ÇA ἀρχή ѝ", "angstrom ca αρχη и"),
        (T.clean_answer, "Answer: x  y\n\n z\nComments", "x y\nz"),
        (T.clean_label, "<b>a</b>  b", "a b"),
        (lambda c: T.compact(c, 100), "programs 1) a b 2) A B", "programs a b"),
        (lambda c: T.compact(c, 100), "word Word", "word"),
        (T.redact, None, None),
    ],
)
def test_text(spark, f, value, want):
    assert column(spark, value, f) == want


def test_paths(spark):
    good = spark.createDataFrame([("a/b.txt",), ("/a",), ("a/../b",), ("c:x",), ("a..b/c",)], "p string")
    assert [r["p"] for r in good.where(T.is_safe_relative(F.col("p"))).collect()] == ["a/b.txt", "a..b/c"]


def test_numbers(spark):
    assert column(spark, -2.5, lambda c: S.round_half_up(c, 0), "double") == -2.0
    assert column(spark, [1.0, 4.0, 2.0, 3.0], S.upper_median, "array<double>") == 3.0
    assert column(spark, 0.0, S.sigmoid, "double") == 0.5
    assert abs(column(spark, 1.0, S.gelu, "double") - 0.841192) < 1e-6


def test_dedupe(spark):
    d = spark.createDataFrame([(1, "a", "k1", "q1", "s"), (2, "a", "k2", "q2", "s"), (3, "b", "k3", "q2", "s")], "n int, id string, k string, q string, src string")
    assert [(r["n"], r["unique_id"]) for r in dedupe.unique_ids(d, "id", "n").orderBy("n").collect()] == [(1, "a"), (2, "a-2"), (3, "b")]
    # 2 falls to 1, so its question is not seen and 3 stays
    assert {r["n"] for r in dedupe.seen_set(d, ["id", "q"], "n").collect()} == {1, 3}
    held = spark.createDataFrame([("zz", "q2")], "k string, q string")
    assert {r["n"] for r in dedupe.exclude_held_out(d, held, ["k", "q"]).collect()} == {1}
    new = spark.createDataFrame([(9, "a", "k9", "q9", "s")], d.schema)
    assert sorted(r["n"] for r in dedupe.merge_by_key(d, new, "id").collect()) == [3, 9]
    assert dedupe.first_per_key(d, ["id"], [F.desc("n")]).count() == 2


def test_seen_set_decides_long_chains(spark):
    # every row shares a key with the one before, so each round decides two
    d = spark.createDataFrame([(i, f"a{i}", f"a{i + 1}") for i in range(24)], "n int, a string, b string").select("n", F.col("a").alias("k1"), F.col("b").alias("k2"))
    d = d.withColumn("k1", F.concat(F.lit("x"), (F.col("n") / 2).cast("int").cast("string"))).withColumn("k2", F.concat(F.lit("y"), ((F.col("n") + 1) / 2).cast("int").cast("string")))
    assert [r["n"] for r in dedupe.seen_set(d, ["k1", "k2"], "n").orderBy("n").collect()] == list(range(0, 24, 2))


def test_columns_of_questions(spark):
    from quarrylake.functions import questions as Q

    rows = [("What is  this?", "Yes.", "x"), ("SBMJOB fails with an error", "can you relate it to X", None), ("what are the fields and", "B, C", ""), (None, None, None), ("Home", "short", "Answer: B")]
    d = spark.createDataFrame(rows, "q string, a string, r string")
    q, a = F.col("q"), F.col("a")
    got = d.select(Q.looks_like_question(q), Q.breaks_off(q), Q.answer_quality(a, F.col("r")), Q.is_usable_answer(a), Q.is_unanswered_prompt(a), Q.is_answer_line(a), Q.is_noise(q, a, ["geometry"])).collect()
    assert [r[0] for r in got] == [True, True, True, False, False] and [r[1] for r in got] == [False, False, True, False, False]
    assert [r[2] for r in got] == ["answered", "answered", "multiple-choice", "question-only", "multiple-choice"]
    assert [r[3] for r in got] == [True, True, False, False, True] and [bool(r[4]) for r in got] == [False, True, False, False, False]
    assert [r[5] for r in got] == [False, True, False, False, False] and [r[6] for r in got] == [False, False, True, False, False]
    x = d.select(T.string_list(F.lit('["a"]')), T.string_list(F.lit("{")), T.split_list(F.lit("a, b,,a")), T.in_chunks(F.array(F.lit(1), F.lit(2), F.lit(3)), 2), T.topic_path(F.lit("http://h/../topic/../a/b.html?x#y")), T.topic_path(F.lit("z")), T.join_unique(F.array(F.lit("a  b"), F.lit("A b"), F.lit("c")), 4), T.combine_evidence(F.lit("Lead text"), F.lit("TEXT")), T.fold_words(F.lit("Ｆull-ﬁx_1")), T.has_loopback(F.lit('{"a": [{"docsUrl": "http://127.0.0.1:9/x"}]}')), T.has_loopback(F.lit('{"note": "http://127.0.0.1"}')), T.is_thin(F.lit("x" * 130), F.lit("Site"), "site"), T.is_shell(F.lit("<TITLE>Site</title><div id=root_container>"), "site", "root_container")).first()
    assert tuple(x) == (["a"], [], ["a", "b"], [[1, 2], [3]], "a/b.html", "", "a b…", "Lead text", "full fix_1", True, False, True, True)
    u = d.select(T.content_urls("http://b", F.lit("p"), F.lit("t x"), F.lit("7.4")), T.content_urls("http://b", F.lit(""), F.lit(None).cast("string"), F.lit("7.4"))).first()
    assert list(u[0]) == ["http://b/content/p?parsebody=true&lang=en", "http://b/content/7.4?topic=t%20x&parsebody=true&lang=en"] and list(u[1]) == []


def test_seen_set_equals_one_reader(spark):
    rng = np.random.default_rng(9)
    data = [(i, int(a), int(b) if b else None) for i, (a, b) in enumerate(rng.integers(0, 40, (200, 2)))]
    seen, want = [set(), set()], set()
    for n, a, b in data:
        if a not in seen[0] and (b is None or b not in seen[1]):
            want.add(n)
            seen[0].add(a)
            seen[1].add(b)
    d = spark.createDataFrame(data, "n int, a int, b int")
    assert {r["n"] for r in dedupe.seen_set(d, ["a", "b"], "n").collect()} == want
    assert dedupe.seen_set(d.limit(0), ["a", "b"], "n").count() == 0


def test_sections_and_chunks(spark):
    text = "Intro line\nSYNTAX\na(b)\n\nNotes\nbe careful\nEXAMPLES"
    d = spark.createDataFrame([(1, text), (2, "no heading here"), (3, None), (4, "")], "id long, t string")
    got = [(r["id"], r["section_kind"], r["body"], r["start_line"], r["end_line"]) for r in structure.sections(d, "id", "t").orderBy("id", "section_index").collect()]
    assert got[:3] == [(1, "syntax", "a(b)", 2, 4), (1, "notes", "be careful", 5, 6), (1, "examples", "EXAMPLES", 7, 7)]
    assert got[3] == (2, "description", "no heading here", 1, 1)
    assert structure.split_chunks("") == [""]
    long = "\n\n".join("word " * 100 for _ in range(10))
    parts = structure.split_chunks(long, 600)
    assert max(map(len, parts)) <= 600 and "".join(parts).count("word") == 1000
    assert structure.atomic_entries("CRTX (Create X) command\nABC\nshort meaning") == ["CRTX (Create X) command", "ABC short meaning"]
    assert structure.chunks(d, "id", "t").count() == 4
    q = spark.createDataFrame([(1, "How do I start the server today? It fails with an error now. Ok?")], "id long, q string")
    assert [r["perspective"] for r in structure.query_perspectives(q, "id", "q").orderBy("perspective").collect()] == [0, 1, 2]


def test_html(spark):
    page = '<html lang="es"><head><title>T</title><meta name="version" content="7.4"></head><body><nav>menu</nav><div class="breadcrumb"><a>A</a></div><h1>Head</h1><p>one<br>two</p><ul><li>x</li></ul><table><tr><td>a</td><td>b</td></tr></table><script>no()</script><p>open'
    title, product, version, lang, crumbs, text = html.read_page(page)
    assert (title, version, lang, crumbs) == ("Head", "7.4", "es", ["A"])
    assert "- x" in text and "a | b" in text and "menu" not in text and "no()" not in text and text.endswith("open")
    assert html.read_page(None)[0] == ""
    # a stray void tag hides nothing, void tags do not keep the trail open
    assert html.read_page("<frame src=x><p>hello")[5] == "hello"
    assert html.read_page('<div class="breadcrumb"><img><br><a>A</a></div><a>Later</a>')[4] == ["A"]
    assert html.read_page("<body><h2>H</h2><ul><li>one<li>two <b>x</b></ul><pre> a\n  b</pre><p>use<code>c</code></p><table><tr><th>k<td>v</table></body>")[5] == "H\n\nH\n\n- one\n\n- two x\n\na\nb\n\nuse c\n\nk | v"
    assert html.plain_text("<p>a</p><pre>x\n y</pre>b<script>s</script>") == "a\nx\ny\nb" and html.fragment_text("<p>a<br>b</p>c") == "a\nb\nc"
    asked = "<h2>What is A?</h2><h3>Answer:</h3><p>it is a letter</p><h2>About</h2><p>no</p><form><h3>How do I stop it?</h3><p>Press stop.</p></form>"
    assert html.heading_questions(asked) == [("What is A?", "it is a letter"), ("How do I stop it?", "Press stop.")]
    panel = '<div class="panel panel-default"><div class="panel-body"><p class="name">Answer / {0}</p>Use the {0} command now <table class="marking"><tr><td>Is This Answer Correct ? </td><td>{1} Yes </td><td>1 No</td></tr></table></div></div>'
    voted = html.voted_answers('<p class="question">How to end a job?</p>' + panel.format("bob", 2) + panel.format("eve", 5) + panel.format("tom", 1), most=2)
    assert voted == [("How to end a job?", "Use the eve command now", "eve", 5, 1), ("How to end a job?", "Use the bob command now", "bob", 2, 1)]
    q = html.questions(spark.createDataFrame([(1, asked), (2, None), (3, "<p>nothing")], "id long, h string"), "id", "h").collect()
    assert sorted((r["id"], r["question"], r["quality"], r["error"]) for r in q) == [(1, "How do I stop it?", "partial", None), (1, "What is A?", "answered", None)]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "source string, target string")
    assert {(r["page"], r["depth"]) for r in html.reachable(edges, spark.createDataFrame([("a",)], "page string")).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    d = spark.createDataFrame([(1, page), (2, None), (3, "<a href=\"u\">")], "id long, h string")
    assert html.extract(d, "id", "h").count() == 2
    assert [r["href"] for r in html.links(d, "id", "h").collect()] == ["u"]
    assert [r["href"] for r in html.links(spark.createDataFrame([(1, "<a class=x href='v'>")], "id long, h string"), "id", "h").collect()] == ["v"]


@pytest.mark.parametrize("blocks", [(50_000, 2_000), (13, 2)])
def test_block_search_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(vectors, "ROWS_A_BLOCK", blocks[0])
    monkeypatch.setattr(vectors, "QUERIES_A_BLOCK", blocks[1])
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 4))
    d = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)] + [(99, None), (98, [1.0]), (97, [float("nan")] * 4), (96, [0.0] * 4), (80, [float("inf")] * 4)], "id long, v array<double>")
    got = {}
    for r in vectors.block_search(d, d.where("id % 20 = 0"), "id", "v", "id", "v", 3, 4).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["rid"]))
    for q in (0, 20, 40):
        s = [(-round(float(v[q] @ x), 6), i) for i, x in enumerate(v) if i != q]
        assert [i for _, i in sorted(got[q])] == [i for _, i in sorted(s)[:3]]


def test_cosine_of_vectors_of_any_length(spark):
    d = spark.createDataFrame([(0, [3.0, 0.0]), (1, [10.0, 10.0]), (2, [0.0, 0.1])], "id long, v array<double>")
    got = {r["rid"]: r["sim"] for r in vectors.block_search(d, d.where("id = 0"), "id", "v", "id", "v", None, 2, unit=True).collect()}
    assert got == {1: 0.707107, 2: 0.0}
    chunks = spark.createDataFrame([(1, "d", 0), (2, "d", 1)], "chunk long, document string, chunk_index int")
    content = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.2)], "qid long, rid long, sim double")
    title = spark.createDataFrame([(0, "d", 0.5)], "qid long, rid string, sim double")
    assert {r["chunk"]: r["sim"] for r in vectors.facet_similarity(content, title, chunks).collect()} == {1: 0.5, 2: 0.2}


@pytest.mark.parametrize("name", ["facet_similarity", "search_scope"])
def test_best_documents_leave_the_tasks_not_all_pairs(spark, monkeypatch, name):
    def all_pairs(*args, **kwargs):
        raise AssertionError("a row for every pair")

    monkeypatch.setattr(vectors, "block_search", all_pairs)
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0


def test_best_documents_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BEST_ROWS", 60)
    monkeypatch.setattr(vectors, "BEST_QUERIES", 4)
    monkeypatch.setattr(vectors, "BEST_AT_ONCE", 2)
    rng = np.random.default_rng(3)
    content = [(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(200)] + [(5, [1.0, 1.0, 1.0]), (6, None), (7, [float("nan"), 1.0, 1.0])]
    chunks = [(i, None if i % 50 == 7 else f"d{i % 40:02d}", 0 if i % 3 else i) for i in range(200)] + [(8, "d39", 0)]
    titles = [(f"d{i % 45:02d}", rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(60)] + [("d01", [0.0, 0.0, 0.0])]
    d = spark.createDataFrame(content, "chunk long, v array<double>")
    rows = vectors.facet_rows(d, spark.createDataFrame(titles, "document string, v array<double>"), spark.createDataFrame(chunks, "chunk long, document string, chunk_index int"), 3)
    got = vectors.best_documents(rows, d.where("chunk % 10 = 5").withColumnRenamed("chunk", "qid"), 6, 3, 260).collect()

    fine = lambda v: v is not None and np.isfinite(v).all() and np.any(v)
    cosine = lambda x, y: round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 6)
    want = []
    for qid in range(5, 200, 10):
        best: dict = {}
        for asked in (v for c, v in content if c == qid and fine(v)):
            for chunk, document, index in chunks:
                for v in (v for c, v in content if c == chunk != qid and fine(v)):
                    named = [t for n, t in titles if n == document is not None and index == 0 and fine(t)]
                    best[document] = max([best.get(document, -2), cosine(asked, v)] + [cosine(asked, t) for t in named])
        want += [(qid, *e) for e in sorted(best.items(), key=lambda e: (-e[1], e[0] is None, e[0] or ""))[:6]]
    assert sorted(map(str, want)) == sorted(str((r["qid"], r["document"], r["sim"] + 0.0)) for r in got)


def test_retrieval(spark):
    sims = spark.createDataFrame([(1, 0, 7, 0.5), (1, 1, 7, 0.9), (1, 0, 8, 0.6)], "question int, perspective int, document int, sim double")
    got = {r["document"]: (r["primary"], r["median"], r["score"]) for r in retrieval.document_scores(sims).collect()}
    assert got[7] == (0.5, 0.9, 61.2) and got[8] == (0.6, 0.6, 60.0)
    lists = spark.createDataFrame([(1, 0, "c", 5, 0.9, 1.0), (1, 0, "c", 6, 0.8, 1.0), (1, 1, "c", 5, 0.7, 0.35)], "question int, perspective int, facet string, chunk int, sim double, weight double")
    got = {r["chunk"]: r["rrf"] for r in retrieval.reciprocal_rank_fusion(lists).collect()}
    assert abs(got[5] - (1 / 41 + 0.35 / 41)) < 1e-12 and abs(got[6] - 1 / 42) < 1e-12
    rows = spark.createDataFrame([(1, 1, 0.9, 0.1, -3.0, None, 1, [1.0, 0.0]), (1, 2, 0.1, 0.2, 1.5, 0.3, 2, [0.0, 1.0]), (1, 3, 0.1, 0.2, -4.0, 0.3, 2, [0.0, 1.0])], "question int, chunk int, direct double, rrf double, logit double, title double, topic int, vector array<double>")
    placed = retrieval.consensus(rows)
    assert placed.where("place = 1").first()["chunk"] == 2
    gate = retrieval.support_gate(placed).first()
    assert gate["supported"] and gate["confidence"] == "high" and gate["top"] == 2
    extra = placed.select("question", F.col("chunk").alias("item"), F.col("chunk").alias("document"), F.lit(0).alias("chunk_index"), F.lit(False).alias("span"), "topic", "logit", "direct", "title", "vector", "place", F.lit(500).alias("length"), F.array(F.lit(0.5)).alias("coverage"))
    # 1 is far below the top but covers something, 3 has the topic of 2
    assert [r["item"] for r in retrieval.select_responses(extra).orderBy("pick").collect()] == [2, 1]
    assert [r["item"] for r in retrieval.select_responses(extra.withColumn("coverage", F.array(F.lit(0.1)))).collect()] == [2]
    scored = spark.createDataFrame([(1, 10, 1, "a", 0.5), (1, 11, 2, "b", 0.9)], "question int, document int, topic int, version string, score double")
    out = retrieval.scope_expansion(scored, spark.createDataFrame([(1, "a")], "question int, version string")).collect()
    assert len(out) == 2 and all(r["expanded"] for r in out)


def test_choice_of_passages(spark):
    schema = "question int, item string, document string, chunk_index int, span boolean, topic string, logit double, direct double, title double, vector array<double>, place int, length int, coverage array<double>"
    rows = [
        (1, "a", "d1", 1, False, "t1", 2.0, 0.9, None, [1.0, 0.0, 0.0], 1, 50, [0.5, 0.0]), (1, "b", "d1", 2, False, "t1", 1.9, 0.9, None, [1.0, 0.1, 0.0], 2, 400, [0.5, 0.0]),
        (1, "c", "d1", 0, False, "t1", 0.1, 0.9, None, [0.9, 0.2, 0.0], 3, 300, [0.1, 0.0]), (1, "e", "d2", 0, False, "t2", 1.5, 0.8, None, [0.0, 1.0, 0.0], 4, 300, [0.0, 0.0]),
        (1, "f", "d3", 0, False, "t3", 1.5, 0.8, None, [0.0, 0.0, 1.0], 5, 300, [0.0, 0.9]), (1, "g", "d4", 0, False, "t4", 1.9, 0.1, None, [0.5, 0.5, 0.5], 6, 300, [0.0, 0.9]),
    ]
    got = retrieval.select_responses(spark.createDataFrame(rows, schema)).orderBy("pick").collect()
    # the longer passage of the first document, with its first chunk; then what covers more; the third lies too far below
    assert [(r["item"], r["lead"]) for r in got] == [("b", "c"), ("f", None)]
    logits = spark.createDataFrame([(1, 0, 1, 2.0), (1, 0, 2, 0.0), (1, 0, 3, -1.0), (1, 1, 1, 0.0), (1, 1, 2, 0.0)], "question int, perspective int, chunk int, logit double")
    w = {r["perspective"]: r for r in retrieval.perspective_weights(logits).collect()}
    assert w[0]["median"] == 0.0 and abs(w[0]["spread"] - (5 / 3) ** 0.5) < 1e-9 and abs(w[0]["weight"] - (1 - np.exp(-2))) < 1e-9 and (w[1]["spread"], w[1]["weight"]) == (1.0, 0.0)
    parts = spark.createDataFrame([([("A", "Text one"), ("Text", "text two"), ("U", "")], True, "7.4", "7.5"), (None, True, None, None), ([("T", "b")], False, None, None)], "p array<struct<title:string,body:string>>, s boolean, v string, a string")
    got = [r[0] for r in parts.select(retrieval.render_answer(F.col("p"), F.col("s"), F.col("v"), F.col("a"))).collect()]
    assert got[0].startswith("A: Text one\n\n- text two\n\nThis is documented for version 7.4;") and got[0].endswith("7.5.") and got[1] == got[2] == retrieval.NO_EVIDENCE
    c = spark.createDataFrame([(False, 3, 3), (True, 2, 1), (True, 1, 1)], "s boolean, e int, r int")
    assert [r[0] for r in c.select(retrieval.coverage_status(F.col("s"), F.col("e"), F.col("r"))).collect()] == ["thin", "complete", "partial"]


def test_evaluation(spark):
    s = spark.createDataFrame([(1, 5, 0.9, False), (1, 6, 0.8, True), (2, 5, 0.7, True)], "question int, chunk int, sim double, relevant boolean")
    m = evaluation.ranking_metrics(evaluation.target_ranks(s)).first()
    assert (m["n"], m["top1"], m["mrr"], m["median_rank"]) == (2, 0.5, 0.75, 1)
    assert [r["chunk"] for r in evaluation.hard_negatives(s).collect()] == [5]
    assert evaluation.grounding(s, 0.8).count() == 1
    c = spark.createDataFrame([(["yes"], ["proof"], ["no"], "Yes it is", "the PROOF"), ([], ["proof"], [], "Yes", "proof"), (["a"], ["b"], ["c"], None, None)], "answer_must_contain_any array<string>, evidence_must_contain_any array<string>, forbidden_any array<string>, a string, e string")
    assert [(r["score"], r["passed"]) for r in evaluation.case_scores(c, "a", "e").collect()] == [(1.0, True), (0.55, False), (0.15, False)]
    order = evaluation.park_miller_order(20, 42)
    assert sorted(order) == list(range(20)) and order == evaluation.park_miller_order(20, 42) != list(range(20))
    d = spark.range(0, 50)
    assert [r["id"] for r in evaluation.rotating_window(d, "id", 47, 5).orderBy("turn").collect()] == [47, 48, 49, 0, 1]


def test_quality_of_an_empty_table(spark):
    empty = spark.read.parquet(f"{SMALL}/document_records.parquet").limit(0)
    gate = {r["name"]: r["ok"] for r in quality.quality_gate(empty).collect()}
    assert gate["documents"] is False and gate["stub_rate"] is False and gate["exact_duplicates"] is True
    assert quality.sparse_categories(empty).count() == 0


def test_trace_and_stream(spark, tmp_path):
    e = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.json(str(tmp_path / "in"))
    stream = trace_stream.counts(trace_stream.read_trace(spark, str(tmp_path / "in")), late="0 seconds")
    q = trace_stream.write_counts(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = trace.windowed(e, "ts", "event_type")
    assert got.count() > 0 and got.exceptAll(want).count() == 0  # the last windows stay open
    assert trace.search_then_read(e.limit(0), "event_type", "user_id", "view", "click").first()["rate"] == 0


def test_store(spark, tmp_path):
    d = spark.createDataFrame([("a", "7.4"), ("b", "7.5")], "id string, version string")
    store.write_pack({"documents": d}, str(tmp_path / "pack"), {"documents": "version"})
    back = store.table(spark, str(tmp_path / "pack"), "documents")
    assert store.point_read(back, "id", "b").first()["version"] in ("7.5", 7.5)
    (tmp_path / "m.json").write_text('{"corpusVersion": "1", "documents": [{"id": "x", "title": "t"}]}')
    assert store.manifests(spark, [str(tmp_path / "m.json"), str(tmp_path / "none.json")]).first()["id"] == "x"
    with pytest.raises(FileNotFoundError):
        store.manifests(spark, [str(tmp_path / "none.json")])
    (tmp_path / "t.jsonl").write_text('{"tool": "read"}\n\nbroken{\n')
    rows = store.trace_lines(spark, str(tmp_path / "t.jsonl"), "tool string").collect()
    assert sorted(r["corrupt"] for r in rows) == [False, True]
    store.append_trace(spark.createDataFrame([("pwd=x q",)], "q string"), str(tmp_path / "log"), "q")
    assert spark.read.json(str(tmp_path / "log")).first()["preview"] == "pwd=[REDACTED] q"


def test_trace_tail_rotation_and_reports(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    for f, n in (("a.jsonl", range(3)), ("b.jsonl", range(3, 6))):
        (folder / f).write_text("".join('{"n": %d}\n' % i for i in n) + "broken{\n\n")
        os.utime(folder / f, (n[0] + 1, n[0] + 1))
    last, counts = store.trace_tail(spark, str(folder), "n int", 4)
    assert [r["n"] for r in last.collect()] == [2, 3, 4, 5] and tuple(counts.first()) == (8, 2, 2)
    assert store.rotate(spark, str(folder), most_files=1) == ["a.jsonl"] and [p.name for p in folder.iterdir()] == ["b.jsonl"]
    d = spark.createDataFrame([("a|b", 1), (None, 2)], "x string, n int")
    assert store.markdown(d, "T").split("\n")[2:] == ["| x | n |", "| --- | --- |", "| a\\|b | 1 |", "|  | 2 |"]
    store.write_report({"one": d}, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/one")).count() == 2
    events = spark.createDataFrame([("s", None, ["1", "2"], None, [("version", "7.4")]), ("s", None, ["9"], None, None), ("r", "2", None, None, None), ("r", None, None, "5", [("version", "7.5"), ("category", "c")])], "tool string, id string, followedReadCandidateIds array<string>, topResultId string, scopeExpansions array<struct<kind:string,requestedScope:string>>")
    assert tuple(trace.followed_searches(events, "tool", "s", "r").first()) == (2, 1, 50.0, 50.0)
    assert {(r["kind"], r["scope"], r["n"]) for r in trace.expansions(events).collect()} == {("version", None, 2), ("version", "7.4", 1), ("version", "7.5", 1), ("category", None, 1), ("category", "c", 1)}


def test_read_sections_and_seeded_sample(spark):
    d = spark.createDataFrame([(1, "a\nb"), (2, "c"), (3, " ")], "id long, t string")
    found = structure.sections(d.where("id = 2"), "id", "t")
    assert sorted((r["id"], r["section_kind"], r["end_line"]) for r in structure.read_sections(d, found, "id", "t").collect()) == [(1, "generic", 2), (2, "description", 1)]
    got = [r["id"] for r in evaluation.seeded_sample(spark.range(20), "id", 42, 20).orderBy("turn").collect()]
    assert got == evaluation.park_miller_order(20, 42)
    v = structure.assist_perspectives(spark.createDataFrame([(1, "How do I end it?", "CL", "ENDJOB"), (2, " ", None, None), (3, "Why?", None, None)], "k int, q string, l string, c string"), "k", "q", "l", "c").orderBy("k", "perspective").collect()
    assert [(r["k"], r["query"]) for r in v] == [(1, "How do I end it?\n\nCode context:\nENDJOB"), (1, "How do I end it?\n\nLanguage or environment hint: CL\n\nCode context:\nENDJOB"), (1, "How do I end it?"), (1, "ENDJOB"), (3, "Why?")]


def _same(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    def norm(df):
        df = df[sorted(df.columns)]
        df = pd.DataFrame({c: [("NULL" if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)) else repr(round(float(x), 6)) if isinstance(x, (int, float, np.number)) else str(x)) for x in df[c]] for c in df})
        return df.sort_values(list(df.columns)).reset_index(drop=True)

    return norm(a).equals(norm(b))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SMALL}/{f}'")
    assert _same(catalogue.QUERIES[name](spark, SMALL).toPandas(), con.execute(catalogue.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_runs(spark, name):
    rows = catalogue.QUERIES[name](spark, SMALL).count()
    assert rows > 0 or name == "source_questions"


@pytest.mark.parametrize("name", ["document_score", "version_expansion", "feedback_mining", "ir_metrics"])
def test_query_looks_past_the_lists(spark, monkeypatch, name):
    whole = catalogue.QUERIES[name](spark, SMALL).toPandas()
    for f in (catalogue._top, catalogue._labelled, catalogue._lists):
        monkeypatch.setattr(f, "__defaults__", (2,))
    monkeypatch.setattr(catalogue, "LIST", 2)
    assert _same(catalogue.QUERIES[name](spark, SMALL).toPandas(), whole)


def test_question_bank_and_contents(spark):
    from quarrylake.operators import qabank, toc

    text = "1. What is A?\nAnswer: it is a letter\nof the alphabet\n2) How do I stop it\nquickly?\nPress stop."
    assert qabank.parse_numbered(text) == [("1", "What is A?", "it is a letter\nof the alphabet"), ("2", "How do I stop it quickly? Press stop.", "")]
    assert qabank.parse_numbered("3. How do I stop it\nquickly?\nPress the stop key.") == [("3", "How do I stop it quickly?", "Press the stop key.")]
    assert qabank.parse_marked("How does it work?\nAnswer:\nIt works by itself.\nMore of it.\nWhat else is there?") == [("1", "How does it work?", "It works by itself.\nMore of it.")]
    assert qabank.parse_coded("QL40158 What is a subfile? AL40158 A list on a display. QL40159 Define job queue AL40159 Place for jobs") == [("QL40158", "What is a subfile?", "A list on a display."), ("QL40159", "Define job queue", "Place for jobs")]
    assert [x[1] for x in qabank.parse_items(text)] == ["What is A?", "How do I stop it quickly? Press stop."]
    found = spark.createDataFrame([("web", "1", "Q1: How does SBMJOB use a job queue?", "Answer: *NONE"), ("web", "2", "What is it?", None)], "source string, ordinal string, question string, answer string")
    cases = {r["id"]: r for r in qabank.make_cases(found).collect()}
    one = cases["qb-web-1-how-does-sbmjob-use-a-job-queue"]
    assert (one["question"], one["expected_answer_summary"], one["extraction_quality"], one["lang"]) == ("How does SBMJOB use a job queue?", "*NONE", "answered", "CLLE") and one["answer_must_contain_any"][:2] == ["job queue", "*NONE"]
    assert cases["qb-web-2-what-is-it"]["extraction_quality"] == "question-only"
    d = spark.createDataFrame([(1, "Use CRTX with *NONE and the Letter", "letter? Crtx")], "k int, a string, q string")
    assert qabank.terms(d, "k", "a", "q").first()["terms"] == ["CRTX", "*NONE", "NONE", "Letter"]
    a = spark.createDataFrame([("What is  É?", 1), ("", 2)], "q string, n int")
    b = spark.createDataFrame([("what is e", 1), ("Other?", 2)], "q string, n int")
    assert sorted((r["q"], r["n"]) for r in qabank.merge_questions(a, b, "q", "n").collect()) == [("Other?", 2), ("What is  É?", 1)]
    nodes = spark.createDataFrame([(1, None, "Root"), (2, 1, "Sub"), (3, 2, "Leaf"), (4, None, "Other")], "id int, parent int, label string")
    flat = toc.flatten(nodes)
    assert {r["id"]: r["path"] for r in flat.collect()}[3] == ["Root", "Sub", "Leaf"]
    assert {r["id"] for r in flat.where(toc.in_scope(F.col("path"), ["root > sub"], ["leaf"])).collect()} == {2}
    assert {r["id"]: r["ids"] for r in flat.collect()}[3] == [1, 2, 3]
    assert {r["id"] for r in flat.where(toc.in_scope(F.col("path"), [], [], ["^oth"], F.col("ids"), [2])).collect()} == {2, 3, 4}
    chain = spark.createDataFrame([(i, i - 1 if i else None, "n") for i in range(35)] + [(99, 99, "loop")], "id int, parent int, label string")
    assert toc.flatten(chain).agg(F.max("level"), F.count("*")).first() == (34, 35)
    t = spark.createDataFrame([(i, "ab"[i % 2 if i < 6 else 0]) for i in range(10)], "id int, g string")
    assert [r["id"] for r in toc.balanced(t, "g", "id", 4, F.col("id") == 9).collect()] == [9, 0, 1, 2]


def test_compact(spark):
    body = "First sentence here. Second one; third part is long"
    assert column(spark, body, lambda c: T.compact(c, 30)) == "First sentence here.…"
    assert column(spark, body, lambda c: T.compact(c, 100)) == body
    assert column(spark, ["b", "A", "a", "B"], T.distinct_ignoring_case, "array<string>") == ["b", "A"]


def test_engine(spark):
    from quarrylake.engine import Corpus

    c = Corpus(spark, SMALL)
    hits = c.search("Why does the message appear when the job ends? I changed the queue before that.", limit=5).collect()
    assert [h["place"] for h in hits] == [1, 2, 3, 4, 5] and all(a["score"] >= b["score"] for a, b in zip(hits, hits[1:])) and all(-100 <= h["score"] <= 100 for h in hits)
    first = hits[0]["document_id"]
    assert c.read(first).count() >= 1 and c.sections(first).count() >= 0 and c.related(first).count() <= 5
    assert c.search("Where is the object stored?", version="7.4").count() > 0
    with pytest.raises(ValueError):
        c.search("x" * 20_000)
    with pytest.raises(ValueError):
        c.assist("  ")
    assert set(c.quality_report()) >= {"gate", "vectors"} and c.trace_report()["rates"].count() == 1
    assert {r["metric"]: r["n"] for r in c.pack_diagnostics().collect()}["documents"] == c.table("document_records").count()
    assert c.report_query("Where is the object stored?", expected_title="no such title")["pass"] is False and set(c.categories()) == {"by_category", "by_doc_version", "by_source_kind"}
    title = c.search("Where is the object stored?", limit=1).first()["title"]
    wanted = [{"name": "a", "query": "Where is the object stored?", "first_title": title}, {"name": "b", "query": "Where is the object stored?", "contains_title": "no such title"}]
    assert {r["name"]: r["reason"] for r in c.golden(wanted).collect()} == {"a": None, "b": "a title is missing"}


def test_answers(spark):
    """A small corpus in which the words decide: one document answers, one is of another version."""
    from quarrylake.engine import Corpus, hashing_embedder

    embed = hashing_embedder(64)
    texts = [("d1", "7.4", "t1", "Ending a job", "To end a job use the end job command with the controlled option."), ("d2", "7.5", "t2", "Printing a list", "To print a list use the print list command."), ("d3", "7.4", "t3", "Saving a file", "To save a file use the save file command on a tape."), ("d4", "7.3", "t1", "Ending a job", "To end a job use the end job command without options.")]
    vec = lambda t: [float(x) for x in embed([t])[0]]
    tables = {
        "chunks": spark.createDataFrame([(i, d, 0, b) for i, (d, _, _, _, b) in enumerate(texts)], "chunk_id long, document_id string, chunk_index int, body string"),
        "chunk_vectors": spark.createDataFrame([(i, [7 * x for x in vec(x[4])]) for i, x in enumerate(texts)] + [(77, [float("nan")] * 64)], "chunk_id long, vector array<double>"),
        "document_vectors": spark.createDataFrame([(d, vec(t)) for d, _, _, t, _ in texts], "document_id string, title_vector array<double>"),
        "document_records": spark.createDataFrame([(i, d, t, v, "c", ["x"], k) for i, (d, v, k, t, _) in enumerate(texts)], "record_no long, id string, title string, doc_version string, category string, breadcrumbs array<string>, canonical_topic_key string"),
    }
    c = Corpus(spark, "", embed)
    c.table = tables.get
    asked = "use the end job command to end a job"
    texts = [(1, asked, None), (2, asked, "7.3"), (3, asked, "7.4"), (4, asked, "7.5"), (5, "quantum physics of distant galaxies", None), (9, "print a list use the print list command", None), (11, None, None)]
    many = spark.createDataFrame([(n, t, None, None, v) for n, t, v in texts], "question long, text string, language string, code string, version string")
    got = {r["question"]: r for r in c.answers(many).collect()}
    assert got[1]["supported"] and got[1]["citations"][0] in ("d1", "d4") and got[1]["answer"].startswith("Ending a job: To end a job") and got[1]["confidence"] == "high"
    # the asked version goes first; for a version that has nothing good enough another one is named
    assert got[2]["citations"][0] == "d4" and got[3]["citations"][0] == "d1"
    assert got[4]["citations"][0] in ("d1", "d4") and "version 7.5" in got[4]["answer"]
    assert not got[5]["supported"] and got[5]["answer"] == retrieval.NO_EVIDENCE and got[5]["coverage"] == "thin"
    assert got[9]["supported"] and got[9]["citations"][0] == "d2" and not got[11]["supported"] and got[11]["citations"] == []
    one = c.ask("context", asked, category="none")
    assert one["supported"] is False and one["reads"] == []
    assert c.compare_versions(asked, ["7.3", "7.4", "9.9"]) == {"7.3": "d4", "7.4": "d1", "9.9": None}


def test_engine_finds_a_small_version_and_category(spark):
    from quarrylake.engine import Corpus

    last = 600  # the only chunk of its version and category, and the one farthest from the question
    n = range(last + 1)
    tables = {
        "chunk_vectors": spark.createDataFrame([(i, [1.0, 0.0] if i < last else [0.0, 1.0]) for i in n], "chunk_id long, vector array<double>"),
        "chunks": spark.createDataFrame([(i, f"d{i}", 0, "text") for i in n], "chunk_id long, document_id string, chunk_index int, body string"),
        "document_records": spark.createDataFrame([(i, f"d{i}", "t", "7.5" if i < last else "7.3", "a" if i < last else "b", "k") for i in n], "record_no long, id string, title string, doc_version string, category string, canonical_topic_key string"),
        "document_vectors": spark.createDataFrame([("none", [1.0, 1.0])], "document_id string, title_vector array<double>"),
    }
    c = Corpus(spark, "", lambda texts: np.array([[1.0, 0.0]] * len(texts)), 2)
    c.table = tables.get
    assert [r["document_id"] for r in c.search("Where is it?", category="b").collect()] == ["d600"]
    assert c.compare_versions("Where is it?", ["7.3"]) == {"7.3": "d600"}


def test_folders_keep_two_digits(spark):
    import hashlib

    # names of 4096 x 256 + 1 files had folders of three digits
    files = spark.range(4096 * 256 + 1).select(F.concat(F.lit("x/"), F.lpad(F.hex(F.col("id") % 3), 4, "0")).alias("p"), F.lit("AB").alias("s"))
    want = hashlib.sha256(b"".join(b"x/000%d\x00ab\n" % i for i in range(3))).hexdigest()
    assert [tuple(r) for r in quality.folder_digest(files, "p", "s").collect()] == [("00", want, 3)]


def test_whole_passages(spark):
    from quarrylake.operators import scoring

    q = spark.createDataFrame([("a b", "x " * 1500 + "a b")], "q string, p string")
    assert scoring.rerank(q, "q", "p", scoring.word_overlap).first()["logit"] == 4.0


def test_models_as_plug_ins(spark):
    from quarrylake.engine import hashing_embedder
    from quarrylake.operators import scoring

    d = spark.createDataFrame([(1, "some words"), (2, " "), (3, None)], "k int, t string")
    e = scoring.embed_texts(d, "k", "t", hashing_embedder).collect()
    assert [r["k"] for r in e] == [1] and abs(np.linalg.norm(e[0]["vector"]) - 1) < 1e-6
    v = spark.createDataFrame([(1, [1.0, 2.5]), (2, None)], "k int, vector array<float>")
    back = scoring.from_bytes(scoring.to_bytes(v, "vector").drop("vector"), "blob").orderBy("k").collect()
    assert back[0]["vector"] == [1.0, 2.5] and back[1]["vector"] is None and bytes(back[0]["blob"])[:4] == b"\x00\x00\x80\x3f"
    q = spark.createDataFrame([("a b", "b a c"), ("a b", ""), ("a b", "x")], "q string, p string")
    got = {r["p"]: r["logit"] for r in scoring.rerank(q, "q", "p", scoring.word_overlap).collect()}
    assert got == {"b a c": 4.0, "x": -4.0}
    rows = spark.createDataFrame([(1, 1, 2.0, "a", "b"), (1, 2, 0.4, "b", "b"), (1, 3, 0.6, "b", "b")], "question int, place int, logit double, version string, asked string")
    assert [r["logit"] for r in scoring.preferred_version(rows, "asked").orderBy("place").collect()] == [0.6, 2.0, 0.4]
    assert column(spark, "http://LOCALHOST:11/x", T.is_loopback) is True and column(spark, "http://a.example", T.is_loopback) is False and column(spark, None, T.is_loopback) is False
