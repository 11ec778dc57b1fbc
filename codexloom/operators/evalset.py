"""Making and checking question sets: quotas, gold, excerpts, and clusters of provisions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexloom.runtime import shipped

#: Characters of an operation in an excerpt, of a definition, and of an original text.
OP_CHARS, DEFINITION_CHARS, TEXT_CHARS = 600, 1500, 1800
#: Rows of one group that are clustered in one task; more are an error and not a cut.
CLUSTERED = 4096


def allocate(budget: int, weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers that add up to ``budget`` in proportion to ``weights``.

    Shares are rounded, and what rounding leaves over or short goes one by one to the
    heaviest (ties by name); nothing falls below 0.
    """
    whole = sum(weights.values())
    if whole <= 0 or budget <= 0:
        return dict.fromkeys(weights, 0)
    out = {k: round(budget * w / whole) for k, w in weights.items()}
    order = sorted(weights, key=lambda k: (-weights[k], k))
    i = 0
    while (drift := budget - sum(out.values())) != 0:
        k = order[i % len(order)]
        if drift > 0 or out[k] > 0:
            out[k] += 1 if drift > 0 else -1
        i += 1
    return out


def pick(candidates: DataFrame, quotas: DataFrame, per_prefix: int = 3) -> DataFrame:
    """``candidates`` (archetype, prefix, id, ...) up to each archetype's quota, in order of id.

    At most ``per_prefix`` of a prefix count in each archetype. ``quotas`` (archetype, quota).
    """
    first = candidates.withColumn("_p", F.row_number().over(Window.partitionBy("archetype", "prefix").orderBy("id"))).where(F.col("_p") <= per_prefix)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("archetype").orderBy("id")))
    return ranked.join(F.broadcast(quotas), "archetype").where(F.col("rank") <= F.col("quota")).drop("_p", "quota")


def overshoot(made: DataFrame, budget: int, more: int = 15) -> DataFrame:
    """The first ``budget + more`` rows of ``made`` (seq, ...): where generation stops."""
    return made.orderBy("seq").limit(budget + more)


def valid_gold(questions: DataFrame, nodes: DataFrame, false_premise: str = "false_premise") -> DataFrame:
    """(id, category, gold, missing): gold nodes that exist, and how many don't.

    Questions without any existing gold node are dropped, but for those about a false premise.
    """
    each = questions.select("id", "category", F.posexplode_outer("gold").alias("pos", "node")).join(nodes.select(F.col("id").alias("node"), F.lit(1).alias("hit")).distinct(), "node", "left")
    gold = F.array_sort(F.collect_list(F.when(F.col("hit") == 1, F.struct("pos", "node"))))
    out = each.groupBy("id", "category").agg(F.transform(gold, lambda x: x["node"]).alias("gold"), F.count_if(F.col("node").isNotNull() & F.col("hit").isNull()).alias("missing"))
    return out.where((F.size("gold") > 0) | (F.col("category") == false_premise))


def with_dependents(questions: DataFrame, inbound: DataFrame, archetype: str) -> DataFrame:
    """``questions`` (id, category, gold) whose gold becomes its first node and all that depends on it.

    Only those of ``archetype`` change; the dependents follow in order of id.
    """
    deps = inbound.groupBy("node").agg(F.array_sort(F.collect_set("dependent")).alias("deps"))
    j = questions.withColumn("_n", F.get("gold", F.lit(0))).join(deps.withColumnRenamed("node", "_n"), "_n", "left")
    more = F.array_union(F.array("_n"), F.coalesce("deps", F.array().cast("array<string>")))
    return j.withColumn("gold", F.when((F.col("category") == archetype) & F.col("_n").isNotNull(), more).otherwise(F.col("gold"))).drop("_n", "deps")


def excerpt(nodes: DataFrame, ops: DataFrame) -> DataFrame:
    """(node_id, operations, text): original text with every operation under it, clipped.

    ``nodes`` (node_id, base_text), ``ops`` as in ``temporal``.
    """
    line = F.concat(F.lit("["), "instrument", F.lit(" "), "kind", F.lit(" "), F.col("eff").cast("string"), F.lit("] "), F.substring(F.coalesce("new_text", F.lit("")), 1, OP_CHARS))
    per = ops.groupBy("node_id").agg(F.count(F.lit(1)).alias("operations"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("eff", "seq", line.alias("l")))), lambda x: x["l"]), "\n").alias("ops"))
    body = F.substring(F.coalesce("base_text", F.lit("")), 1, TEXT_CHARS)
    return nodes.join(per, "node_id", "left").select("node_id", F.coalesce("operations", F.lit(0)).alias("operations"), F.concat_ws("\n", body, "ops").alias("text"))


def gold_context(questions: DataFrame, told: DataFrame, first: int = 8) -> DataFrame:
    """(id, pos, node, text): the first gold nodes of each question with their text of the day, clipped.

    ``questions`` (id, as_of, gold), ``told`` (node_id, as_of, text).
    """
    g = questions.select("id", F.col("as_of").alias("_d"), F.posexplode(F.slice("gold", 1, first)).alias("pos", "node"))
    j = g.join(told, (F.col("node") == F.col("node_id")) & F.col("_d").eqNullSafe(F.col("as_of")))
    return j.select("id", "pos", "node", F.substring("text", 1, TEXT_CHARS).alias("text"))


def edge_free(clusters: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """(cluster, node, pos): up to ``most`` members of each cluster with no edge between them.

    Members are taken in order of id, each only if no edge joins it to one taken before. Only
    edges inside a cluster are gathered; the pass over a cluster stops at ``most``.
    """
    pairs = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    a, b = clusters.select(F.col("cluster").alias("_c"), F.col("node").alias("src")), clusters.select(F.col("cluster").alias("_e"), F.col("node").alias("dst"))
    inside = pairs.join(a, "src").join(b, "dst").where("_c = _e AND src != dst").groupBy(F.col("_c").alias("cluster"), F.col("src").alias("node")).agg(F.collect_set("dst").alias("near"))
    rows = clusters.join(inside, ["cluster", "node"], "left").groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("node", F.coalesce("near", F.array().cast("array<string>")).alias("near")))).alias("m"))
    kind = "array<string>"
    take = F.aggregate("m", F.array().cast(kind), lambda out, x: F.when((F.size(out) >= most) | F.arrays_overlap(out, x["near"]), out).otherwise(F.array_append(out, x["node"])))
    return rows.select("cluster", F.posexplode(take).alias("pos", "node"))


def average_linkage(m: np.ndarray, k: int) -> np.ndarray:
    """The cluster of each row when average linkage by cosine distance stops at ``k`` clusters.

    Chains of nearest neighbours find the merges, each with distances updated by size, so
    the work is quadratic; clusters are numbered by their first row.
    """
    n = len(m)
    if n <= k:
        return np.arange(n)
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), np.ones(n, dtype=bool)
    merges, chain = [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.nonzero(alive)[0][0])]
        while True:
            a = chain[-1]
            row = np.where(alive, d[a], np.inf)
            b = int(row.argmin())
            # The one before in the chain wins ties, or the chain would never end.
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        merges.append((float(d[a, b]), a, b))
        new = (d[a] * size[a] + d[b] * size[b]) / (size[a] + size[b])
        d[a], d[:, a] = new, new
        d[a, a] = np.inf
        size[a] += size[b]
        alive[b] = False
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    for _, a, b in sorted(merges, key=lambda x: x[0])[: n - k]:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    first = [find(i) for i in range(n)]
    number = {r: c for c, r in enumerate(dict.fromkeys(first))}
    return np.array([number[r] for r in first])


def clusters(vectors: DataFrame, by: str, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(by, id, cluster): average linkage inside each group, min(48, max(2, n / 8)) clusters.

    A group of more than CLUSTERED rows raises an error: average linkage needs all its
    distances at once, so larger sets must be grouped first.
    """
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > CLUSTERED:
            raise ValueError(f"a group of {len(pdf)} rows is too large for average linkage; group it first")
        pdf = pdf.sort_values(id_col)
        got = average_linkage(np.array(pdf[vec].tolist(), dtype=np.float64), min(48, max(2, len(pdf) // 8)))
        return pdf[[by, id_col]].assign(cluster=got)

    return vectors.where(F.col(vec).isNotNull()).select(by, id_col, vec).transform(shipped).groupBy(by).applyInPandas(run, f"`{by}` {kinds[by]}, `{id_col}` {kinds[id_col]}, cluster int")


def conditions(questions: DataFrame, grid: dict[str, dict[str, bool]]) -> DataFrame:
    """``questions`` once for each condition of ``grid``, whose flags become columns."""
    flags = sorted({f for c in grid.values() for f in c})
    rows = [(name, *[bool(c.get(f, False)) for f in flags]) for name, c in grid.items()]
    table = questions.sparkSession.createDataFrame(rows, "condition string" + "".join(f", `{f}` boolean" for f in flags))
    return questions.crossJoin(F.broadcast(table))


def unknown_gold(gold: Column, known: Column) -> Column:
    """Gold ids that are not among ``known``; empty where gold is a subset."""
    return F.array_except(gold, known)
