"""The audit of cross-references over all sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexloom.operators import audit, build, models
from codexloom.plans.graph import BASE as _GRAPH
from codexloom.plans.text_sql import grounding_sql


def audit_families(spark: SparkSession, sf: str) -> DataFrame:
    f = audit.families(build.sections(spark, sf))
    return f.select("document_id", "family", F.length("text").alias("chars"), F.md5("text").alias("text"))


def audit_dangling(spark: SparkSession, sf: str) -> DataFrame:
    return audit.dangling(build.sections(spark, sf))


def audit_provisos(spark: SparkSession, sf: str) -> DataFrame:
    """Sections that refer to another beside a proviso or exception, and whether its family has one."""
    s = build.sections(spark, sf)
    claim = s.where(F.col("text").rlike(r"(?i)\b(?:proviso|provided that|except)\b"))
    fam = audit.families(s).where("trim(text) != ''").select("document_id", "family", F.contains(F.lower("text"), F.lit("provided")).alias("has_proviso"))
    return audit.referring(s).join(claim.select(F.col("id").alias("src")), "src", "left_semi").join(fam, ["document_id", "family"]).select("src", "document_id", "family", "has_proviso")


def audit_precedence(spark: SparkSession, sf: str) -> DataFrame:
    return audit.precedence(build.sections(spark, sf)).select("id", "clause", F.array_join("overrides", " ").alias("overrides"))


def audit_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty references whose sentence shares the fewest words with its target."""
    return audit.mismatches(build.sections(spark, sf), models.lexical_scorer)


def audit_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of each kind of finding, by agreement."""
    s = build.sections(spark, sf)
    agreement = F.substring_index("id", ".", 1).alias("agreement_id")
    parts = [
        s.select(agreement, F.lit("section").alias("kind")), audit.mentions(s).select(agreement, F.lit("mention").alias("kind")), audit.dangling(s).select(agreement, F.lit("dangling").alias("kind")),
        audit.precedence(s).select(agreement, F.lit("precedence").alias("kind")), s.where("coalesce(trim(text), '') = ''").select(agreement, F.lit("empty").alias("kind")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    n = lambda k: F.count_if(F.col("kind") == k)
    return every.groupBy("agreement_id").agg(n("section").alias("sections"), n("mention").alias("mentions"), n("dangling").alias("dangling"), n("precedence").alias("precedence"), n("empty").alias("no_text"))


def block_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """The audit of each agreement in words, for questions about conflicts."""
    s = build.sections(spark, sf)
    return audit.conflict_block(audit.precedence(s), s, audit_summary(spark, sf).select("agreement_id", "mentions", "dangling")).select("agreement_id", "text", F.array_join("node_ids", " ").alias("nodes"))


QUERIES = {f.__name__: f for f in (audit_families, audit_dangling, audit_provisos, audit_precedence, audit_mismatches, audit_summary, block_conflicts)}

#: The engine's regular expressions look neither back nor ahead, so mentions of regulations are
#: renamed first, and a number must be followed by something else than a digit.
_PAT = r"Sections?\s+(\d{1,2}\.\d{2}(?:\([a-z0-9]+\))?)"
_CTES = (
    _GRAPH
    + rf""", fam AS (SELECT document_id, split_part(number, '(', 1) AS family, string_agg(coalesce(text, ''), chr(10) ORDER BY id) AS text FROM sec GROUP BY ALL),
amn AS (SELECT id, document_id, number AS own, text, unnest(range(len(m))) AS k, unnest(v) AS number, unnest(st) AS start, unnest(list_transform(m, lambda x: len(x))) AS n FROM (SELECT *, list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(gap[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0)) AS st FROM
  (SELECT *, regexp_extract_all(text, '{_PAT}') AS m, regexp_extract_all(text, '{_PAT}', 1) AS v, string_split_regex(text, 'Sections?\s+(?:\d{{1,2}}\.\d{{2}}(?:\([a-z0-9]+\))?)') AS gap FROM sec WHERE text IS NOT NULL))),
ment AS (SELECT * FROM amn WHERE NOT regexp_matches(substr(text, CAST(start + n AS BIGINT) + 1, 1), '^\d') AND right(left(text, CAST(start AS BIGINT)), 11) <> 'Regulation '
  AND NOT (regexp_matches(substr(text, CAST(start + n AS BIGINT) + 1, 40), '(?i)^\s*(?:of|under)\s+(?:the|any|such|each)\s+') AND NOT regexp_matches(substr(text, CAST(start + n AS BIGINT) + 1, 40), '(?i)^\s*(?:of|under)\s+(?:the|any|such|each)\s+Credit Agreement'))),
sent AS (SELECT *, left(replace(trim(regexp_extract(left(text, CAST(start AS BIGINT)), '(?s)^(?:.*(?:\. |\n))?(.*)$', 1) || substr(text, CAST(start AS BIGINT) + 1, n) || CASE WHEN contains(substr(text, CAST(start + n AS BIGINT) + 1), '. ') THEN split_part(substr(text, CAST(start + n AS BIGINT) + 1), '. ', 1) || '.' ELSE substr(text, CAST(start + n AS BIGINT) + 1) END, ' '), chr(10), ' '), 700) AS sentence FROM ment),
refer AS (SELECT id AS src, document_id, split_part(number, '(', 1) AS family, arg_min(sentence, k) AS sentence FROM sent WHERE split_part(number, '(', 1) <> split_part(own, '(', 1) GROUP BY ALL),
dang AS (SELECT m.id, m.number, count(*) AS mentions FROM ment m WHERE NOT EXISTS (SELECT 1 FROM sec s WHERE s.document_id = m.document_id AND split_part(s.number, '(', 1) = split_part(m.number, '(', 1)) GROUP BY ALL),
pf AS (SELECT id, document_id, text, regexp_extract(text, '{audit.PRECEDENCE}') AS m FROM sec WHERE regexp_matches(text, '{audit.PRECEDENCE}')),
pc AS (SELECT id, document_id, left(replace(trim(regexp_extract(left(text, strpos(text, m) - 1), '(?s)^(?:.*(?:\. |\n))?(.*)$', 1) || m || CASE WHEN contains(substr(text, strpos(text, m) + len(m)), '. ') THEN split_part(substr(text, strpos(text, m) + len(m)), '. ', 1) || '.' ELSE substr(text, strpos(text, m) + len(m)) END, ' '), chr(10), ' '), 500) AS clause FROM pf),
prec AS (SELECT *, list_distinct(regexp_extract_all(clause, '{_PAT}', 1)) AS dn, list_filter(regexp_extract_all(clause, '{_PAT}', 1), lambda x, i: list_position(regexp_extract_all(clause, '{_PAT}', 1), x) = i) AS overrides FROM pc),
summ AS (SELECT split_part(id, '.', 1) AS agreement_id, count(*) FILTER (WHERE k = 's') AS sections, count(*) FILTER (WHERE k = 'm') AS mentions, count(*) FILTER (WHERE k = 'd') AS dangling, count(*) FILTER (WHERE k = 'p') AS precedence, count(*) FILTER (WHERE k = 'e') AS no_text
  FROM (SELECT id, 's' AS k FROM sec UNION ALL SELECT id, 'm' FROM ment UNION ALL SELECT id, 'd' FROM dang UNION ALL SELECT id, 'p' FROM prec UNION ALL SELECT id, 'e' FROM sec WHERE coalesce(trim(text), '') = '') GROUP BY 1)
"""
)
ORACLE = {
    "audit_families": _CTES + "SELECT document_id, family, CAST(len(text) AS INTEGER) AS chars, md5(text) AS text FROM fam",
    "audit_dangling": _CTES + "SELECT id, number, mentions FROM dang",
    "audit_provisos": _CTES + r"SELECT r.src, r.document_id, r.family, contains(lower(f.text), 'provided') AS has_proviso FROM refer r JOIN fam f USING (document_id, family) JOIN sec s ON s.id = r.src AND regexp_matches(s.text, '(?i)\b(?:proviso|provided that|except)\b') WHERE trim(f.text) <> ''",
    "audit_precedence": _CTES + "SELECT id, clause, array_to_string(overrides, ' ') AS overrides FROM prec",
    "audit_mismatches": _CTES + f", sc AS (SELECT r.src, r.document_id || '::' || r.family AS dst, r.sentence, round({grounding_sql('r.sentence', 'left(f.text, 1200)')}, 6) AS score, replace(left(f.text, 300), chr(10), ' ') AS snippet, r.family FROM refer r JOIN fam f USING (document_id, family) WHERE trim(f.text) <> '') SELECT src, dst, sentence, score, snippet FROM sc ORDER BY score, src, family LIMIT 20",
    "audit_summary": _CTES + "SELECT * FROM summ",
}
