"""Question sets over the tables: quotas, gold, excerpts, clusters, and progress by schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexloom.operators import build, evalset, extract, graph, metrics
from codexloom.plans.graph import BASE as _GRAPH
from codexloom.plans.retrieval import category
from codexloom.plans.temporal import OPS as _OPS
from codexloom.plans.temporal import amend_operations, folded, nodes_of
from codexloom.operators import temporal
from codexloom.runtime import cut_lineage, table

#: Questions of a pack, and the weight of each kind in it.
BUDGET, WEIGHTS = 60, {"as_of_temporal": 3.0, "amendment_evolution": 2.0, "multi_amendment_aggregation": 2.0, "definition_dependents": 2.0, "conflict_precedence": 1.0, "false_premise": 1.0}
#: What each version of the schema can follow, in the order in which it grew.
VERSIONS = {"v1": ("CONTAINS",), "v2": ("CONTAINS", "REFERENCES"), "v3": ("CONTAINS", "REFERENCES", "DEPENDS_ON", "DEFINES", "EXCEPTION_TO"), "v4": ("CONTAINS", "REFERENCES", "DEPENDS_ON", "DEFINES", "EXCEPTION_TO", "AMENDS")}
REACH = 2


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "holdout_hard_set").select("id", category(F.col("category")).alias("category"), "question", "as_of", "gold").dropDuplicates(["id"])


def eval_pack(spark: SparkSession, sf: str) -> DataFrame:
    """A pack of BUDGET questions by quota of kind, three of an agreement at most in each."""
    q = _questions(spark, sf).select(F.col("category").alias("archetype"), F.substring_index(F.get("gold", F.lit(0)), ".", 1).alias("prefix"), "id")
    quotas = spark.createDataFrame(list(evalset.allocate(BUDGET, WEIGHTS).items()), "archetype string, quota int")
    return evalset.pick(q, quotas).select("archetype", "prefix", "id", "rank")


def gold_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Gold nodes that have a version, joined, and how many have none."""
    nodes = build.versions(spark, sf).select(F.col("node_id").alias("id"))
    return evalset.valid_gold(_questions(spark, sf), nodes).select("id", "category", F.array_join("gold", " ").alias("gold"), "missing")


def gold_dependents(spark: SparkSession, sf: str) -> DataFrame:
    got = evalset.with_dependents(_questions(spark, sf).select("id", "category", "gold"), graph.inbound_dependents(build.edges(spark, sf)), "definition_dependents")
    return got.select("id", "category", F.array_join("gold", " ").alias("gold"))


def gold_context(spark: SparkSession, sf: str) -> DataFrame:
    q = _questions(spark, sf)
    asked = q.select("as_of", F.explode("gold").alias("node_id")).distinct().join(nodes_of(spark, sf).select("node_id"), "node_id", "left_semi").select("node_id", "as_of")
    told = temporal.fold(nodes_of(spark, sf), amend_operations(spark, sf), asked)
    return evalset.gold_context(q, told).select("id", "pos", "node", F.md5("text").alias("text"))


def excerpts(spark: SparkSession, sf: str) -> DataFrame:
    """Each node's original text and operations, as a digest."""
    return evalset.excerpt(nodes_of(spark, sf), amend_operations(spark, sf)).select("node_id", "operations", F.length("text").alias("chars"), F.md5("text").alias("text"))


def cluster_mates(spark: SparkSession, sf: str) -> DataFrame:
    """Up to three provisions under one parent that do not refer to each other."""
    c = extract.containment(build.sections(spark, sf)).select(F.col("src").alias("cluster"), F.col("dst").alias("node")).distinct()
    e = build.edges(spark, sf).where("edge_type IN ('REFERENCES', 'DEPENDS_ON', 'EXCEPTION_TO')")
    return evalset.edge_free(c, e)


def vector_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Average linkage inside each label."""
    return evalset.clusters(table(spark, sf, "embeddings").select("label", "vec_id", "embedding"), "label")


def schema_progression(spark: SparkSession, sf: str) -> DataFrame:
    """Per version of the schema: mean score of the small set's questions, over what can be scored.

    A question scores by the share of its asserted edges that the version has, and by the
    share of its gold within REACH steps of its entry nodes, either way.
    """
    q = table(spark, sf, "mini_eval_set").select("id", "entry", "gold", "edge_asserts").dropDuplicates(["id"])
    e = cut_lineage(build.edges(spark, sf))
    entry = q.select("id", F.explode("entry").alias("root"))
    want = q.select("id", F.posexplode("edge_asserts").alias("k", "a")).select("id", "k", F.col("a")[0].alias("src"), F.col("a")[1].alias("edge_type"), F.col("a")[2].alias("dst"))
    gold = q.select("id", F.explode("gold").alias("node")).distinct()
    out = None
    for name, types in VERSIONS.items():
        own = graph.of_types(e, types)
        hit = want.join(own.select("src", "edge_type", "dst", F.lit(1).alias("hit")).distinct(), ["src", "edge_type", "dst"], "left").groupBy("id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("edges"))
        near = graph.closure(graph.both_ways(own), entry.select("root").distinct(), REACH).select("root", "node").unionByName(entry.select("root", F.col("root").alias("node")).distinct())
        got = entry.join(near, "root").select("id", "node", F.lit(1).alias("hit")).distinct()
        reach = gold.join(got, ["id", "node"], "left").groupBy("id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("reach"))
        s = q.select("id").join(hit, "id", "left").join(reach, "id", "left")
        score = (F.coalesce("edges", F.lit(0.0)) + F.coalesce("reach", F.lit(0.0))) / (F.col("edges").isNotNull().cast("int") + F.col("reach").isNotNull().cast("int"))
        row = s.withColumn("score", F.when(F.coalesce("edges", "reach").isNotNull(), score)).agg(F.count("score").alias("questions"), F.round(F.avg("edges"), 6).alias("edges"), F.round(F.avg("reach"), 6).alias("reach"), F.round(F.avg("score"), 6).alias("score")).withColumn("version", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


QUERIES = {f.__name__: f for f in (eval_pack, gold_valid, gold_dependents, gold_context, excerpts, cluster_mates, vector_clusters, schema_progression)}

_Q = "WITH q AS (SELECT id, any_value(regexp_replace(lower(trim(category)), '[ -]+', '_', 'g')) AS category, any_value(as_of) AS as_of, any_value(gold) AS gold FROM holdout_hard_set GROUP BY id)"
_WITH = lambda base: base.rstrip().rstrip(",") + ", " + _Q[5:]
_QUOTA = " UNION ALL ".join(f"SELECT '{k}' AS archetype, {v} AS quota" for k, v in evalset.allocate(BUDGET, WEIGHTS).items())
_TYPES = lambda v: "(" + ", ".join(f"'{t}'" for t in VERSIONS[v]) + ")"
_PROGRESS = "\nUNION ALL ".join(
    f"""SELECT '{v}' AS version, count(score) AS questions, round(avg(edges), 6) AS edges, round(avg(reach), 6) AS reach, round(avg(score), 6) AS score FROM (SELECT x.edges, y.reach, CASE WHEN x.edges IS NULL THEN y.reach WHEN y.reach IS NULL THEN x.edges ELSE (x.edges + y.reach) / 2 END AS score FROM mq
  LEFT JOIN (SELECT id, avg(CASE WHEN EXISTS (SELECT 1 FROM edge e WHERE e.edge_type IN {_TYPES(v)} AND e.src = a[1] AND e.edge_type = a[2] AND e.dst = a[3]) THEN 1.0 ELSE 0.0 END) AS edges FROM want GROUP BY id) x USING (id)
  LEFT JOIN (SELECT g.id, avg(CASE WHEN r.node IS NULL THEN 0.0 ELSE 1.0 END) AS reach FROM gold g LEFT JOIN (SELECT DISTINCT e.id, b.node FROM ent e JOIN (
    SELECT root, root AS node FROM ent UNION SELECT a.src, a.dst FROM bw a WHERE a.edge_type IN {_TYPES(v)} UNION SELECT a.src, b.dst FROM bw a JOIN bw b ON b.src = a.dst AND a.edge_type IN {_TYPES(v)} AND b.edge_type IN {_TYPES(v)}) b ON b.root = e.root) r ON r.id = g.id AND r.node = g.node GROUP BY g.id) y USING (id))"""
    for v in VERSIONS
)
ORACLE = {
    "eval_pack": _Q + f", c AS (SELECT category AS archetype, split_part(gold[1], '.', 1) AS prefix, id FROM q), p AS (SELECT *, row_number() OVER (PARTITION BY archetype, prefix ORDER BY id) AS p FROM c), r AS (SELECT archetype, prefix, id, CAST(row_number() OVER (PARTITION BY archetype ORDER BY id) AS INTEGER) AS rank FROM p WHERE p <= 3) SELECT r.* FROM r JOIN ({_QUOTA}) USING (archetype) WHERE rank <= quota",
    "gold_valid": _Q + ", e AS (SELECT id, category, unnest(range(len(gold))) AS pos, unnest(gold) AS node FROM q), k AS (SELECT e.*, node IN (SELECT node_id FROM effective) AS hit FROM e) SELECT q.id, q.category, coalesce((SELECT string_agg(node, ' ' ORDER BY pos) FROM k WHERE k.id = q.id AND hit), '') AS gold, (SELECT count(*) FROM k WHERE k.id = q.id AND NOT hit) AS missing FROM q WHERE q.category = 'false_premise' OR EXISTS (SELECT 1 FROM k WHERE k.id = q.id AND hit)",
    "gold_dependents": _WITH(_GRAPH) + ", dep AS (SELECT dst AS node, list(DISTINCT src ORDER BY src) AS deps FROM edge WHERE edge_type IN ('REFERENCES', 'DEPENDS_ON') GROUP BY dst) SELECT q.id, q.category, array_to_string(CASE WHEN q.category = 'definition_dependents' AND len(gold) > 0 THEN list_prepend(gold[1], list_filter(coalesce(deps, []), lambda x: x <> gold[1])) ELSE gold END, ' ') AS gold FROM q LEFT JOIN dep ON dep.node = gold[1]",
    "gold_context": folded() + ", " + _Q[5:] + ", g AS (SELECT id, as_of, unnest(range(len(gold[1:8]))) AS pos, unnest(gold[1:8]) AS node FROM q) SELECT g.id, CAST(pos AS INTEGER) AS pos, node, md5(left(f.text, 1800)) AS text FROM g JOIN folded f ON f.node_id = node AND f.as_of IS NOT DISTINCT FROM g.as_of",
    "excerpts": _OPS + ", x AS (SELECT n.node_id, (SELECT count(*) FROM ops o WHERE o.node_id = n.node_id) AS operations, concat_ws(chr(10), left(coalesce(n.v[3], ''), 1800), (SELECT string_agg('[' || instrument || ' ' || kind || ' ' || eff || '] ' || left(coalesce(new_text, ''), 600), chr(10) ORDER BY eff, seq) FROM ops o WHERE o.node_id = n.node_id)) AS text FROM nodes n) SELECT node_id, operations, CAST(len(text) AS INTEGER) AS chars, md5(text) AS text FROM x",
    "schema_progression": _GRAPH + f""", mq AS (SELECT id, any_value(entry) AS entry, any_value(gold) AS gold, any_value(edge_asserts) AS ea FROM mini_eval_set GROUP BY id), want AS (SELECT id, unnest(ea) AS a FROM mq), ent AS (SELECT DISTINCT id, unnest(entry) AS root FROM mq), gold AS (SELECT DISTINCT id, unnest(gold) AS node FROM mq), bw AS (SELECT src, dst, edge_type FROM edge UNION SELECT dst, src, edge_type FROM edge)
{_PROGRESS}""",
}
