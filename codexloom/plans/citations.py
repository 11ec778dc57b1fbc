"""Citations of the stored answers against the graph and the text of their day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexloom.operators import build, citations, seeding, temporal
from codexloom.plans import answers as path
from codexloom.plans.retrieval import A as _A
from codexloom.plans.temporal import amend_operations, folded, nodes_of
from codexloom.plans.text_sql import WORD_SQL as _W
from codexloom.plans.text_sql import grounding_sql
from codexloom.runtime import cut_lineage, table


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    s = build.sections(spark, sf).select("id", F.lit("Section").alias("node_type"), "document_id", "number", F.lit(None).cast("string").alias("term"))
    d = build.definitions(spark, sf).select("id", F.lit("Definition").alias("node_type"), "document_id", F.lit(None).cast("string").alias("number"), "term")
    return s.unionByName(d).dropDuplicates(["id"])


def _asserted(spark: SparkSession, sf: str) -> DataFrame:
    """Every citation that an answer lists or brackets, once."""
    a = table(spark, sf, "answers").drop("loaded_at").dropDuplicates(["answer_id"])
    own = seeding.agreements(a.select(F.col("answer_id").alias("qid"), "question"), path.companies(spark, sf)).withColumnRenamed("qid", "answer_id")
    said = F.array_union(F.coalesce("citations", F.array().cast("array<string>")), F.filter(F.coalesce(citations.bracketed(F.col("answer")), F.array().cast("array<string>")), lambda c: citations.is_shaped(c)))
    return a.join(own, "answer_id", "left").select("answer_id", "path", "as_of", "answer", "agreement_id", F.explode(said).alias("citation")).where("citation IS NOT NULL")


def _checks(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _nodes(spark, sf)
    asserted = cut_lineage(_asserted(spark, sf))
    asked = citations.resolve(asserted, nodes).where("node_id IS NOT NULL").select("node_id", "as_of").distinct()
    known = nodes_of(spark, sf)
    told = temporal.fold(known, amend_operations(spark, sf), asked.join(known.select("node_id"), "node_id", "left_semi"))
    return citations.check(asserted, nodes, told.select("node_id", "as_of", "text", "status"))


def citation_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Every citation with the node it names, its status on the day, and how well it is grounded."""
    return _checks(spark, sf).select("answer_id", "citation", "node_id", "status", "claimed", "late", "grounding")


def citation_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and rates of each path."""
    return citations.rates(_checks(spark, sf), ["path"])


def citation_means(spark: SparkSession, sf: str) -> DataFrame:
    """Means of the answers' own rates by path, nulls skipped."""
    per = citations.rates(_checks(spark, sf), ["path", "answer_id"])
    return per.groupBy("path").agg(F.count(F.lit(1)).alias("answers"), *[F.round(F.avg(c), 6).alias(c) for c in ("resolvable_rate", "versioned_rate", "version_ok_rate", "verified_rate", "grounding")])


def context_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of each answer's context, in the context's order; ids without one are skipped."""
    a = table(spark, sf, "answers").select("answer_id", "context_ids").dropDuplicates(["answer_id"]).select("answer_id", F.posexplode("context_ids").alias("pos", "id"))
    c = table(spark, sf, "chunks").groupBy("id").agg(F.min("section_hint").alias("section_hint"), F.max(F.length("text")).alias("chars"))
    return a.join(c, "id").select("answer_id", "pos", "id", "section_hint", "chars")


QUERIES = {f.__name__: f for f in (citation_checks, citation_verify, citation_means, context_chunks)}

_SAY = lambda x: f"array_to_string(regexp_extract_all(lower({x}), '{_W}'), ' ')"
_DEF = r"""(?i)definition of\s+[“"'']\s*([^”"'']{2,60}?)\s*[”"'']"""
#: The look-aheads of bare numbers are left out: no citation of the tables is one.
_SEC = r"§\s*(\d{1,2}\.\d{1,2}(?:\([a-z0-9ivx]{1,4}\))*)"
_CTES = rf"""ans AS (SELECT answer_id, any_value(path) AS path, any_value(question) AS question, any_value(as_of) AS as_of, any_value(answer) AS answer, any_value(citations) AS citations FROM answers GROUP BY answer_id),
comp AS (SELECT phrase, min(agreement_id) AS agreement_id FROM (SELECT {_SAY("regexp_replace(name, '\\s+Credit Agreement\\s*$', '')")} AS phrase, agreement_id FROM filings WHERE doc_type = 'base') WHERE phrase <> '' GROUP BY phrase HAVING count(DISTINCT agreement_id) = 1),
said AS (SELECT answer_id, ' ' || {_SAY("question")} || ' ' AS t FROM ans),
agr AS (SELECT answer_id, arg_min(agreement_id, (strpos(t, ' ' || phrase || ' '), -len(phrase), agreement_id)) AS agreement_id FROM said JOIN comp ON contains(t, ' ' || phrase || ' ') GROUP BY answer_id),
ct AS (SELECT answer_id, path, as_of, answer, agreement_id, unnest(list_distinct(citations)) AS citation FROM ans LEFT JOIN agr USING (answer_id)),
cp AS (SELECT *, regexp_extract(citation, '{_DEF}', 1) AS t, regexp_extract(citation, '{_SEC}', 1) AS n, agreement_id || '.base' AS b,
  agreement_id || '.' || CASE WHEN list_position(['first','second','third','fourth','fifth','sixth','seventh','eighth','ninth','tenth'], regexp_extract(lower(split_part(citation, '§', 1)), '^(\w+) amendment', 1)) > 0 THEN 'amendment_' || list_position(['first','second','third','fourth','fifth','sixth','seventh','eighth','ninth','tenth'], regexp_extract(lower(split_part(citation, '§', 1)), '^(\w+) amendment', 1)) ELSE 'base' END AS d FROM ct WHERE citation IS NOT NULL),
res AS (SELECT answer_id, path, as_of, answer, citation, CASE WHEN t <> '' THEN coalesce((SELECT id FROM def WHERE id = b || '::def::' || t), (SELECT min(id) FROM def WHERE def.document_id = b AND lower(def.term) = lower(cp.t)))
  WHEN n <> '' THEN coalesce((SELECT min(id) FROM sec WHERE id = d || '::' || n), (SELECT min(id) FROM sec WHERE id = b || '::' || n)) END AS node_id FROM cp),
asked AS (SELECT DISTINCT node_id, as_of FROM res WHERE node_id IN (SELECT node_id FROM ver))"""
_CHECKS = (
    folded(_CTES)
    + rf""", ck AS (SELECT r.*, f.status, CASE WHEN contains(lower(citation), 'as originally executed') THEN 'original' WHEN contains(lower(citation), 'as amended by') OR contains(lower(citation), 'proviso added by') THEN 'amended' WHEN contains(lower(citation), 'dated ') THEN 'original' END AS claimed,
  coalesce(len(list_filter(regexp_extract_all(citation, '(?:effective|dated)\s+(\d{{4}}-\d{{2}}-\d{{2}})', 1), lambda x: TRY_CAST(x AS DATE) > r.as_of)) > 0, false) AS late,
  CASE WHEN f.text IS NOT NULL AND r.answer IS NOT NULL THEN round({grounding_sql("r.answer", "f.text")}, 6) END AS grounding
  FROM (SELECT answer_id, path, as_of, answer, citation, node_id FROM res) r LEFT JOIN (SELECT node_id, as_of, text, status FROM folded) f ON f.node_id = r.node_id AND f.as_of IS NOT DISTINCT FROM r.as_of),
v AS (SELECT *, claimed IS NOT NULL AND (claimed = status OR (claimed = 'amended' AND status = 'added')) AS ok FROM ck)
"""
)
_RATES = """count(*) AS citations, count(*) AS "real", count(*) FILTER (WHERE node_id IS NULL) AS unresolvable, round(count(*) FILTER (WHERE node_id IS NOT NULL) / count(*), 3) AS resolvable_rate, round(count(*) FILTER (WHERE claimed IS NOT NULL AND node_id IS NOT NULL) / count(*), 3) AS versioned_rate,
round(count(*) FILTER (WHERE ok AND node_id IS NOT NULL) / nullif(count(*) FILTER (WHERE claimed IS NOT NULL AND node_id IS NOT NULL), 0), 3) AS version_ok_rate, round(count(*) FILTER (WHERE ok AND node_id IS NOT NULL) / count(*), 3) AS verified_rate, count(*) FILTER (WHERE late) AS late, round(avg(grounding), 3) AS grounding, count(*) FILTER (WHERE grounding < 0.3) AS weak"""
ORACLE = {
    "citation_checks": _CHECKS + "SELECT answer_id, citation, node_id, status, claimed, late, grounding FROM ck",
    "citation_verify": _CHECKS + f"SELECT path, {_RATES} FROM v GROUP BY path",
    "citation_means": _CHECKS + f", p AS (SELECT path, answer_id, {_RATES} FROM v GROUP BY path, answer_id) SELECT path, count(*) AS answers, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("resolvable_rate", "versioned_rate", "version_ok_rate", "verified_rate", "grounding")) + " FROM p GROUP BY path",
    "context_chunks": "WITH a AS (SELECT answer_id, any_value(context_ids) AS c FROM answers GROUP BY answer_id), x AS (SELECT answer_id, unnest(range(len(c))) AS pos, unnest(c) AS id FROM a), k AS (SELECT id, min(section_hint) AS section_hint, max(len(text)) AS chars FROM chunks GROUP BY id) SELECT answer_id, CAST(pos AS INTEGER) AS pos, id, section_hint, CAST(chars AS INTEGER) AS chars FROM x JOIN k USING (id)",
}
