"""Graph construction and traversal over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexloom.operators import build, extract, graph
from codexloom.runtime import cut_lineage, table

HOP_TYPES = ("REFERENCES", "DEPENDS_ON", "EXCEPTION_TO")


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return cut_lineage(build.vertices(spark, sf)), cut_lineage(build.edges(spark, sf))


def links(spark: SparkSession, sf: str, around: DataFrame, limit: int | None = 6) -> tuple[DataFrame, DataFrame]:
    """Hop neighbours and siblings of the nodes of ``around`` alone."""
    v, e = _graph(spark, sf)
    front = around.select("node")
    return graph.hop_neighbors(v, e, HOP_TYPES, front, limit), graph.sibling_neighbors(v, e, limit, front)


def graph_contains(spark: SparkSession, sf: str) -> DataFrame:
    return extract.containment(build.outline(spark, sf))


def graph_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return extract.mentions(build.sections(spark, sf)).select("id", "k", "number", "start", "evidence")


def graph_references(spark: SparkSession, sf: str) -> DataFrame:
    """Each pair once, with the evidence of its last mention."""
    r = build.references(build.sections(spark, sf)).withColumn("edge_key", F.lit("REFERENCES"))
    return graph.upsert(r).select("src", "dst", "evidence")


def graph_exceptions(spark: SparkSession, sf: str) -> DataFrame:
    return extract.exceptions(build.sections(spark, sf))


def graph_term_mentions(spark: SparkSession, sf: str) -> DataFrame:
    d = build.definitions(spark, sf)
    return extract.term_mentions(d.select(F.col("id").alias("key"), F.col("document_id").alias("scope"), "text"), d.select(F.col("document_id").alias("scope"), "term"))


def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return build.edges(spark, sf).select("src", "dst", "edge_key", "edge_type")


def graph_section_terms(spark: SparkSession, sf: str) -> DataFrame:
    return build.section_terms(spark, sf)


def graph_schema_counts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.schema_counts(*_graph(spark, sf))


def graph_hops(spark: SparkSession, sf: str) -> DataFrame:
    v, e = _graph(spark, sf)
    return graph.hop_neighbors(v, e, HOP_TYPES, limit=8)


def graph_siblings(spark: SparkSession, sf: str) -> DataFrame:
    v, e = _graph(spark, sf)
    return graph.sibling_neighbors(v, e, 6)


def graph_dependents(spark: SparkSession, sf: str) -> DataFrame:
    return graph.inbound_dependents(build.edges(spark, sf))


def graph_degree_band(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degree_band(build.edges(spark, sf), 3, 25)


def graph_amended_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return build.amend_edges(spark, sf).select(F.col("dst").alias("node")).distinct()


def graph_reference_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Two steps along references and dependencies from every gold node of every question."""
    q = table(spark, sf, "holdout_hard_set").select(F.explode("gold").alias("root")).distinct()
    e = graph.of_types(build.edges(spark, sf), ("REFERENCES", "DEPENDS_ON")).select("src", "dst")
    return graph.closure(cut_lineage(e), q, 2)


def graph_reachable(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes within three steps either way of each question's entry nodes, over all edges but amendments."""
    q = table(spark, sf, "mini_eval_set").select(F.explode("entry").alias("root")).distinct()
    e = graph.both_ways(cut_lineage(build.edges(spark, sf).where("edge_type != 'AMENDS'")))
    return graph.closure(e, q, 3)


def graph_edge_asserts(spark: SparkSession, sf: str) -> DataFrame:
    """Per question of the small set: the share of its asserted edges that exist."""
    q = table(spark, sf, "mini_eval_set").select("id", "edge_asserts").distinct().select("id", F.posexplode("edge_asserts").alias("k", "a"))
    want = q.select("id", "k", F.col("a")[0].alias("src"), F.col("a")[1].alias("edge_type"), F.col("a")[2].alias("dst"))
    have = build.edges(spark, sf).select("src", "edge_type", "dst", F.lit(1).alias("hit")).distinct()
    return want.join(have, ["src", "edge_type", "dst"], "left").groupBy("id").agg(F.count(F.lit(1)).alias("asserted"), F.avg(F.coalesce("hit", F.lit(0))).alias("edge_recall"))


def graph_dangling(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions of sections that exist neither themselves nor as parent or child."""
    sec = build.sections(spark, sf)
    m = extract.mentions(sec).select("id", "document_id", "number", F.substring_index("number", "(", 1).alias("parent"))
    known = sec.select("document_id", F.substring_index("number", "(", 1).alias("parent")).distinct()
    return m.join(known, ["document_id", "parent"], "left_anti").groupBy("id", "number").agg(F.count(F.lit(1)).alias("mentions"))


def graph_section_seed(spark: SparkSession, sf: str) -> DataFrame:
    """The sections that the citations of each stored answer lead to, or their nearest ancestors."""
    a = table(spark, sf, "answers").select("answer_id", F.substring_index(F.get("context_ids", F.lit(0)), "::", 1).alias("doc"), "citations").dropDuplicates(["answer_id"])
    n = a.select("answer_id", "doc", F.explode("citations").alias("c")).withColumn("number", F.regexp_extract("c", r"§\s*(\d{1,2}\.\d{1,2}(?:\([a-z0-9]+\))*)", 1)).where("number != '' AND doc IS NOT NULL").distinct()
    n = n.select(F.col("answer_id").alias("key"), F.concat("doc", F.lit("::"), F.col("number")).alias("number")).distinct()
    s = build.sections(spark, sf).select("id", F.col("id").alias("number"))
    return graph.section_seed(n, s)


def graph_dfs(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered search, three deep and 25 wide, from the entry nodes of the small set."""
    q = table(spark, sf, "mini_eval_set").select("id", "entry").distinct().select(F.col("id").alias("qid"), F.posexplode("entry").alias("pos", "node"))
    v, e = _graph(spark, sf)
    return graph.ordered_dfs(q, e, v.where(F.col("node_type").isin(*graph.TEXT_TYPES)).select("id"))


QUERIES = {f.__name__: f for f in (graph_contains, graph_mentions, graph_references, graph_exceptions, graph_term_mentions, graph_section_terms, graph_edges, graph_schema_counts, graph_hops, graph_siblings, graph_dependents, graph_degree_band, graph_amended_nodes, graph_reference_closure, graph_reachable, graph_edge_asserts, graph_dangling, graph_section_seed, graph_dfs)}

#: The graph as common table expressions; each query below starts from them.
BASE = r"""
WITH RECURSIVE sec AS (SELECT DISTINCT id, number, title, text, document_id, level, pos FROM sections),
fil AS (SELECT DISTINCT id, name FROM filings),
ver AS (SELECT DISTINCT version_id, node_id, text, citation, status, effective_date, recorded_at FROM effective),
run AS (SELECT id, document_id, level, pos,
    last_value(CASE WHEN level = 'article' THEN id END IGNORE NULLS) OVER w AS art,
    last_value(CASE WHEN level <> 'subsection' THEN level || '|' || id END IGNORE NULLS) OVER w AS top
  FROM sec WINDOW w AS (PARTITION BY document_id ORDER BY pos, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
contains_ AS (SELECT CASE WHEN level = 'article' THEN document_id WHEN level = 'section' THEN coalesce(art, document_id)
    ELSE coalesce(CASE WHEN top LIKE 'section|%' THEN substr(top, 9) END, art, document_id) END AS src, id AS dst, CAST(pos AS BIGINT) AS seq FROM run),
cut AS (SELECT id, document_id, text, regexp_extract_all(text, 'Section\s+([0-9]{1,2}\.[0-9]{2}(?:\([a-z]\))*)') AS m,
    regexp_extract_all(text, 'Section\s+([0-9]{1,2}\.[0-9]{2}(?:\([a-z]\))*)', 1) AS num,
    string_split_regex(text, 'Section\s+(?:[0-9]{1,2}\.[0-9]{2}(?:\([a-z]\))*)') AS gap FROM sec WHERE text IS NOT NULL),
flat AS (SELECT id, document_id, text, unnest(range(len(m))) AS k, unnest(m) AS m, unnest(num) AS number, unnest(gap[1:len(m)]) AS gap FROM cut WHERE len(m) > 0),
mention AS (SELECT id, document_id, text, k, number, len(m) AS n, sum(len(gap) + len(m)) OVER (PARTITION BY id ORDER BY k) - len(m) AS start FROM flat),
men AS (SELECT id, document_id, k, number, start, substr(text, CAST(greatest(start - 60, 0) AS BIGINT) + 1, CAST(start + n + 20 - greatest(start - 60, 0) AS BIGINT)) AS evidence FROM mention),
ref AS (SELECT m.id AS src, coalesce(s.id, p.id) AS dst, m.k, m.evidence FROM men m
  LEFT JOIN sec s ON s.document_id = m.document_id AND s.number = m.number
  LEFT JOIN sec p ON p.document_id = m.document_id AND p.number = split_part(m.number, '(', 1)
  WHERE coalesce(s.id, p.id) IS NOT NULL AND coalesce(s.id, p.id) <> m.id),
exc AS (SELECT c.id AS src, p.id AS dst, right(rtrim(p.text), 120) AS evidence FROM sec c JOIN sec p ON c.level = 'subsection' AND c.document_id = p.document_id AND p.number = split_part(c.number, '(', 1)
  WHERE regexp_matches(p.text, ':\s*$') AND regexp_matches(p.text, '(?i)\b(?:except|other than)\b')),
def AS (SELECT node_id AS id, split_part(node_id, '::def::', 1) AS document_id, split_part(node_id, '::def::', 2) AS term, arg_min(text, (effective_date, version_id)) AS text
  FROM ver WHERE contains(node_id, '::def::') GROUP BY node_id),
occ AS (SELECT d.id AS key, t.term, regexp_matches(d.text, '(^|[^\w])' || t.term || '($|[^\w])') AS hit FROM def d JOIN def t ON t.document_id = d.document_id),
am AS (SELECT split_part(node_id, '.', 1) || '.amendment_' || list_position(['First','Second','Third','Fourth','Fifth','Sixth','Seventh','Eighth','Ninth','Tenth'], regexp_extract(citation, 'as amended by (\w+) Amendment', 1)) AS src,
    node_id AS dst, effective_date, version_id FROM ver WHERE status <> 'original' AND regexp_matches(citation, 'as amended by (?:First|Second|Third|Fourth|Fifth|Sixth|Seventh|Eighth|Ninth|Tenth) Amendment')),
edge AS (SELECT DISTINCT * FROM (
  SELECT src, dst, 'CONTAINS' AS edge_key, 'CONTAINS' AS edge_type FROM contains_
  UNION ALL SELECT src, dst, 'REFERENCES', 'REFERENCES' FROM ref UNION ALL SELECT src, dst, 'EXCEPTION_TO', 'EXCEPTION_TO' FROM exc
  UNION ALL SELECT d.document_id || '::1.01', d.id, 'DEFINES', 'DEFINES' FROM def d WHERE d.document_id || '::1.01' IN (SELECT id FROM sec)
  UNION ALL SELECT key, split_part(key, '::def::', 1) || '::def::' || term, 'DEPENDS_ON', 'DEPENDS_ON' FROM occ WHERE hit AND key <> split_part(key, '::def::', 1) || '::def::' || term
  UNION ALL SELECT s.id, d.id, 'REFERENCES', 'REFERENCES' FROM sec s JOIN def d ON d.document_id = s.document_id AND s.level <> 'article' AND NOT starts_with(s.number, '1.01') AND regexp_matches(s.text, '(^|[^\w])' || d.term || '($|[^\w])')
  UNION ALL SELECT src, dst, 'AMENDS::' || effective_date, 'AMENDS' FROM am)),
vert AS (SELECT id, min(node_type) AS node_type FROM (SELECT id, 'Document' AS node_type FROM fil UNION ALL SELECT id, 'Section' FROM sec UNION ALL SELECT id, 'Definition' FROM def) GROUP BY id)
"""
_BOTH = "(SELECT src AS node, dst AS neighbor, edge_type FROM edge UNION ALL SELECT dst, src, edge_type FROM edge)"
ORACLE = {
    "graph_contains": BASE + "SELECT src, dst, seq FROM contains_",
    "graph_mentions": BASE + "SELECT id, CAST(k AS INTEGER) AS k, number, CAST(start AS BIGINT) AS start, evidence FROM men",
    "graph_references": BASE + "SELECT src, dst, arg_max(evidence, k) AS evidence FROM ref GROUP BY src, dst",
    "graph_exceptions": BASE + "SELECT src, dst, evidence FROM exc",
    "graph_term_mentions": BASE + "SELECT DISTINCT key, term FROM occ WHERE hit",
    "graph_section_terms": BASE + r"SELECT DISTINCT s.id AS src, d.id AS dst FROM sec s JOIN def d ON d.document_id = s.document_id AND s.level <> 'article' AND NOT starts_with(s.number, '1.01') AND regexp_matches(s.text, '(^|[^\w])' || d.term || '($|[^\w])')",
    "graph_edges": BASE + "SELECT src, dst, edge_key, edge_type FROM edge",
    "graph_schema_counts": BASE + "SELECT s.node_type AS src_type, e.edge_type, d.node_type AS dst_type, count(*) AS n FROM edge e JOIN vert s ON s.id = e.src JOIN vert d ON d.id = e.dst GROUP BY ALL",
    "graph_hops": BASE + f", h AS (SELECT DISTINCT node, neighbor FROM {_BOTH} b JOIN vert v ON v.id = b.neighbor AND v.node_type IN ('Section', 'Definition') WHERE edge_type IN ('REFERENCES', 'DEPENDS_ON', 'EXCEPTION_TO')) SELECT * FROM (SELECT node, neighbor, CAST(row_number() OVER (PARTITION BY node ORDER BY neighbor) AS INTEGER) AS rank FROM h) WHERE rank <= 8",
    "graph_siblings": BASE + ", c AS (SELECT DISTINCT src, dst FROM edge WHERE edge_type = 'CONTAINS'), h AS (SELECT DISTINCT a.dst AS node, b.dst AS neighbor FROM c a JOIN c b ON a.src = b.src AND a.dst <> b.dst JOIN vert v ON v.id = b.dst AND v.node_type = 'Section') SELECT * FROM (SELECT node, neighbor, CAST(row_number() OVER (PARTITION BY node ORDER BY neighbor) AS INTEGER) AS rank FROM h) WHERE rank <= 6",
    "graph_dependents": BASE + "SELECT DISTINCT dst AS node, src AS dependent FROM edge WHERE edge_type IN ('REFERENCES', 'DEPENDS_ON')",
    "graph_degree_band": BASE + "SELECT dst AS node, count(DISTINCT src) AS inbound FROM edge WHERE edge_type IN ('REFERENCES', 'DEPENDS_ON') GROUP BY dst HAVING count(DISTINCT src) BETWEEN 3 AND 25",
    "graph_amended_nodes": BASE + "SELECT DISTINCT dst AS node FROM am",
    "graph_reference_closure": BASE + """, root AS (SELECT DISTINCT unnest(gold) AS root FROM holdout_hard_set), d AS (SELECT src, dst FROM edge WHERE edge_type IN ('REFERENCES', 'DEPENDS_ON')),
s1 AS (SELECT DISTINCT root, dst AS node FROM root JOIN d ON src = root WHERE dst <> root), s2 AS (SELECT DISTINCT s1.root, dst AS node FROM s1 JOIN d ON src = s1.node WHERE dst <> s1.root)
SELECT root, node, min(depth) AS depth FROM (SELECT *, 1 AS depth FROM s1 UNION ALL SELECT *, 2 FROM s2) GROUP BY root, node""",
    "graph_reachable": BASE + """, e AS (SELECT src, dst FROM edge WHERE edge_type <> 'AMENDS' UNION SELECT dst, src FROM edge WHERE edge_type <> 'AMENDS'), root AS (SELECT DISTINCT unnest(entry) AS root FROM mini_eval_set),
s1 AS (SELECT DISTINCT root, dst AS node FROM root JOIN e ON src = root WHERE dst <> root), s2 AS (SELECT DISTINCT s1.root, dst AS node FROM s1 JOIN e ON src = s1.node WHERE dst <> s1.root), s3 AS (SELECT DISTINCT s2.root, dst AS node FROM s2 JOIN e ON src = s2.node WHERE dst <> s2.root)
SELECT root, node, min(depth) AS depth FROM (SELECT *, 1 AS depth FROM s1 UNION ALL SELECT *, 2 FROM s2 UNION ALL SELECT *, 3 FROM s3) GROUP BY root, node""",
    "graph_edge_asserts": BASE + """, q AS (SELECT DISTINCT id, edge_asserts FROM mini_eval_set), a AS (SELECT id, unnest(edge_asserts) AS a FROM q)
SELECT id, count(*) AS asserted, avg(CASE WHEN EXISTS (SELECT 1 FROM edge e WHERE e.src = a[1] AND e.edge_type = a[2] AND e.dst = a[3]) THEN 1.0 ELSE 0.0 END) AS edge_recall FROM a GROUP BY id""",
    "graph_dangling": BASE + "SELECT m.id, m.number, count(*) AS mentions FROM men m WHERE NOT EXISTS (SELECT 1 FROM sec s WHERE s.document_id = m.document_id AND split_part(s.number, '(', 1) = split_part(m.number, '(', 1)) GROUP BY ALL",
    "graph_section_seed": BASE + r""", a AS (SELECT answer_id, any_value(context_ids) AS ids, any_value(citations) AS cs FROM answers GROUP BY answer_id), q AS (SELECT DISTINCT answer_id AS key, split_part(ids[1], '::', 1) AS doc, regexp_extract(c, '§\s*(\d{1,2}\.\d{1,2}(?:\([a-z0-9]+\))*)', 1) AS n FROM (SELECT answer_id, ids, unnest(cs) AS c FROM a WHERE ids[1] IS NOT NULL))
SELECT key, doc || '::' || n AS number, arg_max(s.id, len(s.id)) AS node FROM q JOIN sec s ON n <> '' AND s.document_id = doc AND (doc || '::' || n = s.id OR starts_with(doc || '::' || n, s.id || '(')) GROUP BY key, doc, n""",
}
