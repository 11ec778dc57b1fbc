"""Amendments over time: status, folded text, catalogue, lattice and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexloom.operators import build, extract, temporal
from codexloom.runtime import cut_lineage, table


def amend_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Each amending version as an operation, its kind taken from its words and status."""
    v = build.versions(spark, sf).where("status != 'original'")
    kind = F.when(F.col("status") == "added", "insert").otherwise(extract.classify_op(F.substring("text", 1, 240)))
    inst = F.regexp_extract("citation", r"as amended by (\w+ Amendment)", 1)
    return v.select("node_id", F.col("effective_date").alias("eff"), F.col("version_id").alias("seq"), kind.alias("kind"), F.coalesce(inst, F.lit("")).alias("instrument"), F.col("text").alias("new_text"))


def nodes_of(spark: SparkSession, sf: str) -> DataFrame:
    v = build.versions(spark, sf)
    first = v.groupBy("node_id").agg(F.min(F.when(F.col("status") == "original", F.struct("effective_date", "version_id", "text"))).alias("v"))
    return first.select("node_id", F.expr("substring_index(node_id, '::', -1)").alias("label"), F.col("v.text").alias("base_text"), F.coalesce(F.concat(F.lit("as originally executed ("), F.col("v.effective_date").cast("string"), F.lit(")")), F.lit("not in the original")).alias("origin"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "holdout_hard_set").select("as_of", F.explode("gold").alias("node_id")).distinct()
    return q.join(nodes_of(spark, sf).select("node_id"), "node_id", "left_semi").select("node_id", "as_of")


def asof_ops_before(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.ops_before(amend_operations(spark, sf), _asked(spark, sf)).select("node_id", "as_of", "eff", "seq", "kind", "instrument")


def asof_status(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.status_on(amend_operations(spark, sf), _asked(spark, sf))


def asof_fold_text(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.fold(nodes_of(spark, sf), amend_operations(spark, sf), _asked(spark, sf))


def asof_lattice(spark: SparkSession, sf: str) -> DataFrame:
    """Every node on its own lattice of days: operations, status, and what must never be."""
    ops = amend_operations(spark, sf)
    days = temporal.lattice_days(ops)
    return temporal.check_lattice(temporal.fold(nodes_of(spark, sf), ops, days), temporal.status_on(ops, days))


def asof_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The text and citation of a node the day before, on and after each of its amendment days."""
    ops = amend_operations(spark, sf)
    days = ops.select("node_id", "eff").distinct()
    asked = days.select("node_id", F.explode(F.array(F.date_sub("eff", 1), "eff", F.date_add("eff", 1))).alias("as_of")).distinct()
    return temporal.check_windows(days, cut_lineage(temporal.fold(nodes_of(spark, sf), ops, asked)))


def asof_mixed_vintage(spark: SparkSession, sf: str) -> DataFrame:
    """Provisions that use one amended since they were last amended, with its status around that day."""
    ops = amend_operations(spark, sf)
    last = ops.groupBy("node_id").agg(F.max("eff").alias("eff"))
    uses = build.edges(spark, sf).where("edge_type IN ('DEPENDS_ON', 'REFERENCES')").select("src", "dst").distinct()
    a, b = last.toDF("src", "src_eff"), last.toDF("dst", "dst_eff")
    mixed = uses.join(b, "dst").join(a, "src", "left").where("src_eff IS NULL OR src_eff < dst_eff")
    asked = mixed.select(F.col("dst").alias("node_id"), F.explode(F.array(F.date_sub("dst_eff", 1), "dst_eff")).alias("as_of")).distinct()
    told = cut_lineage(temporal.fold(nodes_of(spark, sf), ops, asked).select("node_id", "as_of", "status"))
    at = lambda k, name: told.select(F.col("node_id").alias("dst"), F.date_add("as_of", k).alias("dst_eff"), F.col("status").alias(name))
    return mixed.join(at(1, "before"), ["dst", "dst_eff"]).join(at(0, "after"), ["dst", "dst_eff"]).select("src", "dst", "src_eff", "dst_eff", "before", "after")


def amended_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Each amended node with its operations, oldest first."""
    o = F.array_sort(F.collect_list(F.struct("eff", "seq", "kind")))
    line = F.array_join(F.transform("o", lambda x: F.concat(x["eff"].cast("string"), F.lit(" "), x["kind"])), "; ")
    return amend_operations(spark, sf).groupBy("node_id").agg(o.alias("o")).select("node_id", F.size("o").alias("operations"), line.alias("history"))


def amendment_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.catalog(amend_operations(spark, sf))


def amendment_versions_ok(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the small set's version checks whose node has the status expected then."""
    q = table(spark, sf, "mini_eval_set").select("id", "version_checks").distinct().select("id", F.explode("version_checks").alias("c"))
    asked = q.select("id", F.col("c.node").alias("node_id"), F.col("c.as_of").alias("as_of"), F.col("c.status").alias("want"))
    got = temporal.fold(nodes_of(spark, sf), amend_operations(spark, sf), asked.select("node_id", "as_of").distinct()).select("node_id", "as_of", "status")
    j = asked.alias("q").join(got.alias("g"), (F.col("q.node_id") == F.col("g.node_id")) & F.col("q.as_of").eqNullSafe(F.col("g.as_of")))
    return j.groupBy("id").agg(F.count(F.lit(1)).alias("checks"), F.avg((F.col("status") == F.col("want")).cast("double")).alias("version_ok"))


QUERIES = {f.__name__: f for f in (asof_ops_before, asof_status, asof_fold_text, asof_lattice, asof_windows, asof_mixed_vintage, amended_operations, amendment_catalog, amendment_versions_ok)}

from codexloom.plans.graph import BASE as _GRAPH  # noqa: E402

OPS = (
    _GRAPH
    + r""", ops AS (SELECT node_id, effective_date AS eff, version_id AS seq, CASE WHEN status = 'added' THEN 'insert'
    WHEN regexp_matches(left(text, 240), '(?is)amended by (?:deleting|replacing)|by replacing the text in the proviso') THEN 'replace'
    WHEN regexp_matches(left(text, 240), 'amended by (?:inserting|adding)') THEN 'insert' ELSE 'restate' END AS kind,
    coalesce(regexp_extract(citation, 'as amended by (\w+ Amendment)', 1), '') AS instrument, text AS new_text FROM ver WHERE status <> 'original'),
nodes AS (SELECT node_id, split_part(node_id, '::', -1) AS label, min((effective_date, version_id, text)) FILTER (WHERE status = 'original') AS v FROM ver GROUP BY node_id),
asked AS (SELECT DISTINCT node_id, as_of FROM (SELECT unnest(gold) AS node_id, as_of FROM holdout_hard_set) WHERE node_id IN (SELECT node_id FROM ver)),
hit AS (SELECT a.node_id, a.as_of, o.eff, o.seq, o.kind, o.instrument, o.new_text, row_number() OVER (PARTITION BY a.node_id, a.as_of ORDER BY o.eff, o.seq) AS rn
  FROM asked a JOIN ops o ON o.node_id = a.node_id AND (a.as_of IS NULL OR o.eff <= a.as_of))
"""
)
_SURGICAL = """(trim(n) = '' OR (trim(t) <> '' AND (len(n) < greatest(400, CAST(floor(0.4 * len(t)) AS BIGINT))
 OR (regexp_matches(left(lower(n), 240), 'by replacing|by deleting|by inserting|is hereby amended|amended by replacing|replacing the text in the proviso') AND len(n) < len(t)))))"""
_FOLD = f""", f AS (
  SELECT a.node_id, a.as_of, CAST(0 AS BIGINT) AS rn, coalesce(x.v[3], '') AS t, coalesce(x.v[3], '') AS base, 'original' AS status, CAST([] AS VARCHAR[]) AS notes FROM asked a JOIN nodes x ON x.node_id = a.node_id
  UNION ALL
  SELECT node_id, as_of, rn, CASE WHEN kind = 'restate' AND NOT s THEN n WHEN kind = 'insert' THEN CASE WHEN t = '' THEN n ELSE t || chr(10) || n END ELSE t END, base,
    CASE WHEN kind = 'insert' AND base = '' THEN 'added' ELSE 'amended' END,
    CASE WHEN (kind = 'restate' AND NOT s) OR kind = 'insert' THEN CASE WHEN len(notes) = 0 THEN ['[as amended by ' || stamp || ']'] ELSE notes END
      ELSE list_append(notes, '[' || CASE WHEN kind = 'restate' THEN 'proviso/restate' ELSE kind END || ' per ' || stamp || ': ' || n || ']') END
  FROM (SELECT f.node_id, f.as_of, h.rn, f.t, f.base, f.notes, h.kind, h.new_text AS n, h.instrument || ' (effective ' || h.eff || ')' AS stamp, {_SURGICAL.replace("(n)", "(h.new_text)").replace("(t)", "(f.t)")} AS s
    FROM f JOIN hit h ON h.node_id = f.node_id AND h.as_of IS NOT DISTINCT FROM f.as_of AND h.rn = f.rn + 1)),
folded AS (SELECT f.node_id, f.as_of, CASE WHEN len(notes) > 0 THEN t || chr(10) || array_to_string(notes, chr(10)) ELSE t END AS text, f.status,
  x.label || ', ' || coalesce('as amended by ' || h.instrument || ' (effective ' || h.eff || ')', 'as originally executed (' || x.v[1] || ')', 'not in the original') AS citation
FROM f JOIN nodes x ON x.node_id = f.node_id LEFT JOIN hit h ON h.node_id = f.node_id AND h.as_of IS NOT DISTINCT FROM f.as_of AND h.rn = f.rn
QUALIFY f.rn = max(f.rn) OVER (PARTITION BY f.node_id, f.as_of))"""
_ASKED = "asked AS (SELECT DISTINCT node_id, as_of FROM (SELECT unnest(gold) AS node_id, as_of FROM holdout_hard_set) WHERE node_id IN (SELECT node_id FROM ver))"


def folded(asked: str = _ASKED) -> str:
    """The common table expressions up to ``folded`` (node_id, as_of, text, status, citation) for ``asked``."""
    return OPS.replace(_ASKED, asked) + _FOLD


_NODE = "node_id IN (SELECT node_id FROM nodes)"
_AROUND = "SELECT DISTINCT node_id, CAST(eff + CAST(unnest([-1, 0, 1]) AS INTEGER) AS DATE) AS as_of FROM ops"
ORACLE = {
    "asof_ops_before": OPS + "SELECT node_id, as_of, eff, seq, kind, instrument FROM hit",
    "asof_status": OPS + "SELECT a.node_id, a.as_of, count(h.seq) AS n_ops, arg_max(h.instrument, h.rn) AS last_instrument FROM asked a LEFT JOIN hit h ON h.node_id = a.node_id AND h.as_of IS NOT DISTINCT FROM a.as_of GROUP BY a.node_id, a.as_of",
    "asof_fold_text": folded() + " SELECT * FROM folded",
    "amendment_catalog": OPS + "SELECT eff, instrument, count(*) AS ops, string_agg(DISTINCT node_id || ' (' || kind || ')', '; ' ORDER BY node_id || ' (' || kind || ')') AS targets FROM ops GROUP BY eff, instrument",
    "asof_lattice": folded(f"asked AS ({_AROUND} UNION SELECT DISTINCT node_id, unnest([DATE '1900-01-01', DATE '2100-01-01']) FROM ops)")
    + """, c AS (SELECT node_id, as_of, status, count(seq) AS n_ops FROM folded LEFT JOIN hit USING (node_id, as_of) GROUP BY ALL)
SELECT c.node_id, c.as_of, n_ops, c.status, coalesce(n_ops < max(n_ops) OVER w OR (c.status = 'original' AND max(CASE WHEN c.status <> 'original' THEN 1 ELSE 0 END) OVER w = 1), false) AS reverts,
  coalesce(len(list_filter(regexp_extract_all(f.citation, '(?:effective|dated)\\s+(\\d{4}-\\d{2}-\\d{2})', 1), lambda d: TRY_CAST(d AS DATE) > c.as_of)) > 0, false) AS late
FROM c JOIN folded f USING (node_id, as_of) WINDOW w AS (PARTITION BY c.node_id ORDER BY c.as_of ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "asof_windows": folded(f"asked AS ({_AROUND})")
    + """, d AS (SELECT DISTINCT node_id, eff FROM ops) SELECT d.node_id, d.eff, c.status, p.text IS DISTINCT FROM c.text AS changes, c.text IS DISTINCT FROM n.text AS changes_again, p.citation IS DISTINCT FROM c.citation AS cites_anew, contains(c.citation, CAST(d.eff AS VARCHAR)) AS cites_day
FROM d JOIN folded p ON p.node_id = d.node_id AND p.as_of = d.eff - 1 JOIN folded c ON c.node_id = d.node_id AND c.as_of = d.eff JOIN folded n ON n.node_id = d.node_id AND n.as_of = d.eff + 1""",
    "asof_mixed_vintage": folded("l AS (SELECT node_id, max(eff) AS eff FROM ops GROUP BY node_id), mixed AS (SELECT DISTINCT e.src, e.dst, a.eff AS src_eff, b.eff AS dst_eff FROM edge e JOIN l b ON b.node_id = e.dst LEFT JOIN l a ON a.node_id = e.src WHERE e.edge_type IN ('DEPENDS_ON', 'REFERENCES') AND (a.eff IS NULL OR a.eff < b.eff)), asked AS (SELECT DISTINCT dst AS node_id, CAST(dst_eff + CAST(unnest([-1, 0]) AS INTEGER) AS DATE) AS as_of FROM mixed)")
    + " SELECT m.*, p.status AS before, c.status AS after FROM mixed m JOIN folded p ON p.node_id = m.dst AND p.as_of = m.dst_eff - 1 JOIN folded c ON c.node_id = m.dst AND c.as_of = m.dst_eff",
    "amended_operations": OPS + "SELECT node_id, CAST(count(*) AS INTEGER) AS operations, string_agg(eff || ' ' || kind, '; ' ORDER BY eff, seq) AS history FROM ops GROUP BY node_id",
    "amendment_versions_ok": OPS
    + """, q AS (SELECT id, unnest(version_checks) AS c FROM (SELECT DISTINCT id, version_checks FROM mini_eval_set)),
l AS (SELECT id, c.status AS want, c.node AS node, c.as_of AS as_of, (SELECT arg_max(kind, (eff, seq)) FROM ops o WHERE o.node_id = c.node AND (c.as_of IS NULL OR o.eff <= c.as_of)) AS k FROM q),
g AS (SELECT id, want, CASE WHEN k IS NULL THEN 'original' WHEN k = 'insert' AND coalesce((SELECT v[3] FROM nodes n WHERE n.node_id = node), '') = '' THEN 'added' ELSE 'amended' END AS got FROM l)
SELECT id, count(*) AS checks, avg(CASE WHEN want = got THEN 1.0 ELSE 0.0 END) AS version_ok FROM g GROUP BY id""",
}
