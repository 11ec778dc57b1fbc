"""Chunking, extraction and vector search over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexloom.operators import build, extract, text, vectors
from codexloom.runtime import table


def chunk_sections(spark: SparkSession, sf: str) -> DataFrame:
    return text.chunk_sections(build.sections(spark, sf))


def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return text.chunk_fixed(build.sections(spark, sf), 512, 256)


def islands_definitions(spark: SparkSession, sf: str) -> DataFrame:
    """Definitions of all documents: a line that opens a quotation, and what follows."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    d = d.where("trim(text) != ''")
    return extract.islands(d, F.col("text").startswith("“"))


def classify_ops(spark: SparkSession, sf: str) -> DataFrame:
    s = build.sections(spark, sf).where("text IS NOT NULL")
    return s.groupBy(extract.classify_op(F.col("text")).alias("op")).agg(F.count(F.lit(1)).alias("n"))


def grounding_recall(spark: SparkSession, sf: str) -> DataFrame:
    """How far each answer's words are found in its context blocks."""
    a = table(spark, sf, "answers").select("answer_id", "answer", F.array_join(F.transform("context_blocks", lambda b: F.coalesce(b["text"], F.lit(""))), "\n").alias("src")).dropDuplicates(["answer_id"])
    return a.select("answer_id", F.round(text.grounding(F.col("answer"), F.col("src")), 6).alias("grounding"))


def term_subphrases(spark: SparkSession, sf: str) -> DataFrame:
    return build.filings(spark, sf).select("name").distinct().select("name", F.explode(text.subphrases(F.col("name"))).alias("phrase")).distinct()


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return vectors.top_k(e.where("vec_id % 50 = 0"), e, 10).select("qid", "id", F.round("score", 5).alias("score"), "rank")


def dense_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """First three labels among thirty hits, a label standing for the hit's node."""
    e = table(spark, sf, "embeddings")
    hits = vectors.top_k(e.where("vec_id % 50 = 0"), e, 30).join(e.select(F.col("vec_id").alias("id"), "label"), "id")
    return vectors.first_nodes(hits, F.col("label"), 3)


def greedy_dedup(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return vectors.greedy_keep(e.select(F.col("vec_id").alias("id")), vectors.similar_pairs(e, 0.92))


QUERIES = {f.__name__: f for f in (chunk_sections, chunk_fixed, islands_definitions, classify_ops, grounding_recall, term_subphrases, vector_topk, dense_seeds, greedy_dedup)}

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in text.STOP_WORDS)
_SEC = "WITH sec AS (SELECT DISTINCT id, document_id, level, pos, text FROM sections), w AS (SELECT id, document_id, pos, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM sec WHERE text IS NOT NULL)"
_TOP = """WITH s AS (SELECT q.vec_id AS qid, c.vec_id AS id, c.label, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 10) AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)"""
ORACLE = {
    "chunk_sections": _SEC + ", k AS (SELECT id, w, unnest(range(0, len(w), 512)) AS a0 FROM w WHERE len(w) > 0) SELECT CASE WHEN len(w) > 512 THEN id || '::p' || CAST(a0 / 512 AS BIGINT) ELSE id END AS id, id AS section_id, array_to_string(w[a0 + 1:a0 + 512], ' ') AS text FROM k",
    "chunk_fixed": _SEC + """, d AS (SELECT document_id, flatten(list(w ORDER BY pos, id)) AS w, flatten(list(list_transform(w, lambda x: id) ORDER BY pos, id)) AS s FROM w WHERE len(w) > 0 GROUP BY document_id),
k AS (SELECT *, unnest(range(0, greatest(len(w) - 256, 1), 256)) AS a0 FROM d) SELECT document_id || '::chunk' || CAST(a0 / 256 AS BIGINT) AS id, document_id, s[a0 + 1] AS section_id, array_to_string(w[a0 + 1:a0 + 512], ' ') AS text FROM k""",
    "islands_definitions": """WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL),
i AS (SELECT *, sum(CASE WHEN starts_with(text, '“') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM l WHERE trim(text) <> '')
SELECT doc_id, CAST(island AS BIGINT) AS island, string_agg(text, chr(10) ORDER BY pos) AS text FROM i WHERE island > 0 GROUP BY doc_id, island""",
    "classify_ops": "WITH sec AS (SELECT DISTINCT id, text, document_id, level, pos, number, title FROM sections) SELECT CASE WHEN regexp_matches(text, '(?is)amended by (?:deleting|replacing)|by replacing the text in the proviso') THEN 'replace' WHEN regexp_matches(text, 'amended by (?:inserting|adding)') THEN 'insert' ELSE 'restate' END AS op, count(*) AS n FROM sec WHERE text IS NOT NULL GROUP BY 1",
    "grounding_recall": f"""WITH a AS (SELECT answer_id, any_value(answer) AS answer, any_value(array_to_string(list_transform(context_blocks, lambda b: coalesce(b.text, '')), chr(10))) AS src FROM answers GROUP BY answer_id),
g AS (SELECT answer_id, list_filter(list_distinct(regexp_extract_all(lower(coalesce(answer, '')), '[a-z0-9.$%()]+')), lambda w: len(w) > 2 AND w NOT IN ({_STOP})) AS c, list_distinct(regexp_extract_all(lower(coalesce(src, '')), '[a-z0-9.$%()]+')) AS t FROM a)
SELECT answer_id, round(CASE WHEN len(c) = 0 THEN 1.0 ELSE len(list_intersect(c, t)) / len(c) END, 6) AS grounding FROM g""",
    "term_subphrases": """WITH n AS (SELECT DISTINCT name, string_split_regex(trim(name), '\\s+') AS w FROM filings), k AS (SELECT name, w, unnest(range(2, len(w))) AS k FROM n WHERE len(w) >= 3),
i AS (SELECT name, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM k) SELECT DISTINCT name, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM i""",
    "vector_topk": _TOP + " SELECT qid, id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10",
    "dense_seeds": _TOP + ", n AS (SELECT qid, label AS node, min(rank) AS first FROM r WHERE rank <= 30 GROUP BY qid, label) SELECT * FROM (SELECT qid, node, CAST(row_number() OVER (PARTITION BY qid ORDER BY first) AS INTEGER) AS rank FROM n) WHERE rank <= 3",
    "greedy_dedup": """WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v), p AS (SELECT b.rn, list(a.id) AS near FROM n a JOIN n b ON a.id < b.id AND round(list_dot_product(a.e, b.e) / (a.n * b.n), 10) >= 0.92 GROUP BY b.rn),
s AS (SELECT v.rn, v.id, coalesce(p.near, []) AS near FROM v LEFT JOIN p USING (rn)),
f AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT s.rn, CASE WHEN list_has_any(kept, near) THEN kept ELSE list_append(kept, id) END FROM f JOIN s ON s.rn = f.rn + 1)
SELECT v.id, list_contains((SELECT arg_max(kept, rn) FROM f), v.id) AS kept FROM v""",
}
