"""Queries of the training-data operators: name to callable(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.llm import abuse, boilerplate, capping, near_duplicates, neighbours, overlap, packing, pair_quality, splitting, tokenize
from quarrylake.llm.common import read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    lines = boilerplate.label_lines(read(spark, d, "raw_pages"), "page_id", "html", "text", "title")
    return lines.where("not main").select("page_id", "line_no")


def p1_main(spark: SparkSession, d: str) -> DataFrame:
    """The title and article lines of each page, in order."""
    lines = boilerplate.label_lines(read(spark, d, "raw_pages"), "page_id", "html", "text", "title")
    return lines.where("main").select("page_id", "line_no", "line")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    who = capping.question_bank_contributors(read(spark, d, "question_bank"))
    return capping.beyond_cap(who, "contributor", "score", "row_no", cap=25, kind="contributor_kind").select("contributor_kind", "row_no")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(read(spark, d, "document_sections"), "section", "section_id", "body").unionByName(
        splitting.split_items(read(spark, d, "chunks"), "chunk", "chunk_id", "body")
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("piece_index = 0").select("item_kind", "item_id", "boundary")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).select("item_kind", "item_id", "piece_index", "start_pos", "end_pos", "shared", "piece")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = read(spark, d, "chunk_vectors").select(F.col("chunk_id").alias("id"), F.col("vector").alias("v"), F.lit(0).alias("kind"))
    titles = read(spark, d, "document_vectors").select(F.col("doc_id").alias("id"), F.col("title_vector").alias("v"), F.lit(1).alias("kind"))
    pairs = neighbours.similar_pairs(chunks.unionByName(titles), "id", "v", "kind", 0.9)
    return pairs.select(F.when(F.col("kind") == 0, "chunk").otherwise("title").alias("field_name"), F.col("low").alias("low_id"), F.col("high").alias("high_id"))


def p4_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar rows of every row whose id is divisible by 20."""
    chunks = neighbours.nearest(read(spark, d, "chunk_vectors"), "chunk_id", "vector").withColumn("field_name", F.lit("chunk"))
    titles = neighbours.nearest(read(spark, d, "document_vectors"), "doc_id", "title_vector").withColumn("field_name", F.lit("title"))
    return chunks.unionByName(titles).select("field_name", "query_id", "id", "cosine", F.col("rank").cast("long").alias("rank"))


def p4_search(spark: SparkSession, d: str) -> DataFrame:
    """The same by greedy search of the neighbour graph; recall is in the README."""
    chunks = neighbours.search(read(spark, d, "chunk_vectors"), "chunk_id", "vector").withColumn("field_name", F.lit("chunk"))
    titles = neighbours.search(read(spark, d, "document_vectors"), "doc_id", "title_vector").withColumn("field_name", F.lit("title"))
    return chunks.unionByName(titles).select("field_name", "query_id", "id", "cosine", F.col("rank").cast("long").alias("rank"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row a document with its group of versions of one text."""
    return near_duplicates.near_duplicate_groups(read(spark, d, "documents"), "doc_id", "text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_duplicates.near_duplicate_pairs(read(spark, d, "documents"), "doc_id", "text", 0.6, 20)
    return pairs.select(F.col("low").alias("low_doc_id"), F.col("high").alias("high_doc_id"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pair_quality.find_defects(read(spark, d, "question_bank"), "row_no", "question", "expected_answer_summary").select("row_no", "defect")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    train, held = overlap.split_sides(read(spark, d, "qa_cases"), read(spark, d, "eval_cases"))
    pairs = overlap.set_overlaps(train, held, "case_no", "question", 0.7)
    return pairs.select(F.least("left_key", "right_key").alias("low_case_no"), F.greatest("left_key", "right_key").alias("high_case_no"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    train, held = overlap.split_sides(read(spark, d, "qa_cases"), read(spark, d, "eval_cases"))
    return overlap.overlap_report(overlap.set_overlaps(train, held, "case_no", "question", 0.7), held)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(read(spark, d, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read(spark, d, "documents"), "doc_id", "text", "source")


def p9_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are and how many rows break a rule."""
    return packing.conflicts(p9_containers(spark, d))


def _abuse(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scores(read(spark, d, "documents"), read(spark, d, "review_labels"), "doc_id", "text", "label")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _abuse(spark, d).where("category is not null").select("doc_id", "category")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _abuse(spark, d)


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(_abuse(spark, d), read(spark, d, "documents"), "doc_id", "source")


_ALL = (p1_found, p1_main, p2_found, p3_found, p3_pieces, p4_found, p4_nearest, p4_search, p5_found, p5_groups, p6_found, p7_found, p7_report, p8_ids, p9_containers, p9_conflicts, p10_found, p10_scores, p10_rates)
QUERIES = {f.__name__: f for f in _ALL}

_HOST = r"regexp_extract(lower(trim(source)), '^https?://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)', 1)"
_AUTHOR = r"lower(trim(regexp_replace(extraction.author, '[ \t\n\r\f]+', ' ', 'g')))"
_CUT = r"list_max(list_transform(regexp_split_to_array(body, '{0}'), lambda x: length(trim(x, ' ' || chr(9) || chr(10) || chr(13))))) <= 1800"
_LONG = "length(trim(body, ' ' || chr(9) || chr(10) || chr(13))) > 1800"
# SQL has no lookbehind: sentence ends are marked by a character first
_SENTENCE = r"list_max(list_transform(regexp_split_to_array(regexp_replace(body, '([.!?])[ \t]+', '\1' || chr(10), 'g'), '\r?\n'), lambda x: length(trim(x, ' ' || chr(9) || chr(10) || chr(13))))) <= 1800"
_LEVEL = f"CASE WHEN {_CUT.replace('{0}', chr(92) + 'r?' + chr(92) + 'n(?:[ ' + chr(92) + 't]*' + chr(92) + 'r?' + chr(92) + 'n)+')} THEN 'paragraph' WHEN {_CUT.replace('{0}', chr(92) + 'r?' + chr(92) + 'n')} THEN 'line' WHEN {_SENTENCE} THEN 'sentence' WHEN {_CUT.replace('{0}', '[ ' + chr(92) + 't' + chr(92) + 'r' + chr(92) + 'n]+')} THEN 'word' ELSE 'none' END"
_OK = "vector IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0"

#: Equivalent SQL of the queries that SQL can say.
SQL = {
    "p2_found": f"""WITH c AS (
  SELECT 'source' AS contributor_kind, row_no, extraction.answer_score AS s, nullif(CASE WHEN {_HOST} <> '' THEN {_HOST} ELSE lower(trim(source)) END, '') AS who FROM question_bank
  UNION ALL SELECT 'author', row_no, extraction.answer_score, CASE WHEN {_AUTHOR} NOT IN ('', 'anonymous', '[deleted]', 'unknown') THEN {_AUTHOR} END FROM question_bank)
SELECT contributor_kind, row_no FROM c WHERE who IS NOT NULL QUALIFY row_number() OVER (PARTITION BY contributor_kind, who ORDER BY s DESC NULLS LAST, row_no) > 25""",
    "p3_found": f"""SELECT 'section' AS item_kind, section_id AS item_id, {_LEVEL} AS boundary FROM document_sections WHERE {_LONG}
UNION ALL SELECT 'chunk', chunk_id, {_LEVEL} FROM chunks WHERE {_LONG}""",
    "p4_found": f"""WITH v AS (SELECT 'chunk' AS field_name, chunk_id AS id, vector::DOUBLE[] AS v FROM chunk_vectors WHERE {_OK}
  UNION ALL SELECT 'title', doc_id, title_vector::DOUBLE[] FROM document_vectors WHERE {_OK.replace("vector", "title_vector")})
SELECT a.field_name, a.id AS low_id, b.id AS high_id FROM v a JOIN v b ON a.field_name = b.field_name AND a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.9""",
    "p4_nearest": f"""WITH v AS (SELECT 'chunk' AS field_name, chunk_id AS id, vector::DOUBLE[] AS v FROM chunk_vectors WHERE {_OK}
  UNION ALL SELECT 'title', doc_id, title_vector::DOUBLE[] FROM document_vectors WHERE {_OK.replace("vector", "title_vector")}),
s AS (SELECT q.field_name, q.id AS query_id, r.id, round(list_cosine_similarity(q.v, r.v), 6) AS cosine FROM v q JOIN v r ON q.field_name = r.field_name AND q.id % 20 = 0 AND q.id <> r.id)
SELECT field_name, query_id, id, cosine, row_number() OVER (PARTITION BY field_name, query_id ORDER BY cosine DESC, id) AS rank FROM s QUALIFY rank <= 10""",
    "p5_found": """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 20),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS low_doc_id, b.doc_id AS high_doc_id, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT low_doc_id, high_doc_id FROM c JOIN n x ON x.doc_id = low_doc_id JOIN n y ON y.doc_id = high_doc_id WHERE c >= 0.6 * (x.n + y.n - c)""",
    "p7_found": """WITH q AS (SELECT case_no, CASE WHEN split_name = 'train' THEN 0 ELSE 1 END AS side, question FROM qa_cases UNION ALL SELECT case_no, 1, question FROM eval_cases),
w AS (SELECT DISTINCT case_no, side, unnest(regexp_extract_all(strip_accents(lower(question)), '[\\p{L}\\p{N}_]+')) AS w FROM q), n AS (SELECT case_no, count(*) AS n FROM w GROUP BY 1),
c AS (SELECT a.case_no AS t, b.case_no AS e, count(*) AS c FROM w a JOIN w b ON a.w = b.w AND a.side = 0 AND b.side = 1 GROUP BY ALL)
SELECT least(t, e) AS low_case_no, greatest(t, e) AS high_case_no FROM c JOIN n x ON x.case_no = t JOIN n y ON y.case_no = e WHERE c * 10 >= 7 * (x.n + y.n - c)""",
}
