"""Typed property multigraph as two frames, and the hops over it.

``vertices`` (id, node_type, ...) and ``edges`` (src, dst, edge_key, edge_type, seq, ...).
Every hop is an equi-join of a frontier with edges, so it scales with the frontier and
not with the graph; all orders end in an id, so results don't depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexloom.runtime import cut_lineage, shipped

TEXT_TYPES = ("Section", "Definition")


def edge_kind(edge_type: Column, edge_key: Column) -> Column:
    """The edge's type, else the prefix of its key (for graphs that lack the column)."""
    return F.coalesce(edge_type, F.substring_index(edge_key, "::", 1))


def upsert(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst, edge_key), with the attributes that came last by ``seq``."""
    rest = [c for c in edges.columns if c not in ("src", "dst", "edge_key")]
    last = edges.groupBy("src", "dst", "edge_key").agg(F.max(F.struct("seq", *[c for c in rest if c != "seq"])).alias("_e"))
    return last.select("src", "dst", "edge_key", *[F.col(f"_e.{c}").alias(c) for c in rest])


def of_types(edges: DataFrame, types: Iterable[str]) -> DataFrame:
    return edges.where(F.col("edge_type").isin(*types))


def schema_counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges by (type of source, edge type, type of target)."""
    s = vertices.select(F.col("id").alias("src"), F.col("node_type").alias("src_type"))
    d = vertices.select(F.col("id").alias("dst"), F.col("node_type").alias("dst_type"))
    pairs = edges.groupBy("src", "dst", "edge_type").agg(F.count(F.lit(1)).alias("c"))
    return pairs.join(s, "src").join(d, "dst").groupBy("src_type", "edge_type", "dst_type").agg(F.sum("c").alias("n"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "edge_type").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type"))


def first_k(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def hop_neighbors(vertices: DataFrame, edges: DataFrame, types: Iterable[str], frontier: DataFrame | None = None, limit: int | None = 8) -> DataFrame:
    """(node, neighbor, rank): one hop both ways, text nodes only, ``limit`` by id."""
    e = both_ways(of_types(edges, types)).withColumnsRenamed({"src": "node", "dst": "neighbor"}).select("node", "neighbor").distinct()
    if frontier is not None:
        e = e.join(frontier.select("node").distinct(), "node", "left_semi")
    text = vertices.where(F.col("node_type").isin(*TEXT_TYPES)).select(F.col("id").alias("neighbor"))
    return first_k(e.join(text, "neighbor", "left_semi"), ["node"], ["neighbor"], limit or 2**31 - 1).select("node", "neighbor", "rank")


def sibling_neighbors(vertices: DataFrame, edges: DataFrame, limit: int | None = 6, frontier: DataFrame | None = None) -> DataFrame:
    """(node, neighbor, rank): sections under the same parent, the next ``limit`` by id.

    Children are numbered under their parent, and the first ``limit + 1`` of each parent
    are joined to all its children, so no parent's pairs are listed in full. Without a
    limit they are; then ``frontier`` (node) should name the few nodes that are asked for.
    """
    section = vertices.where("node_type = 'Section'").select(F.col("id").alias("dst"))
    own = edges.where("edge_type = 'CONTAINS'").select("src", "dst").distinct()
    kids = own.withColumnRenamed("dst", "node")
    if frontier is not None:
        kids = kids.join(frontier.select("node").distinct(), "node", "left_semi")
    under = own.join(section, "dst", "left_semi")
    heads = (first_k(under, ["src"], ["dst"], limit + 1) if limit else under).select("src", F.col("dst").alias("neighbor"))
    pairs = kids.join(heads, "src").where("node != neighbor").select("node", "neighbor").distinct()
    return first_k(pairs, ["node"], ["neighbor"], limit or 2**31 - 1).select("node", "neighbor", "rank")


def inbound_dependents(edges: DataFrame, types: Iterable[str] = ("REFERENCES", "DEPENDS_ON")) -> DataFrame:
    """(node, dependent): distinct sources of references and dependencies into a node."""
    return of_types(edges, types).select(F.col("dst").alias("node"), F.col("src").alias("dependent")).distinct()


def degree_band(edges: DataFrame, low: int = 3, high: int = 25, only: str | None = None) -> DataFrame:
    """(node, inbound) of the nodes with so many dependents."""
    n = inbound_dependents(edges).groupBy("node").agg(F.count(F.lit(1)).alias("inbound")).where(F.col("inbound").between(low, high))
    return n.where(F.col("node").contains(only)) if only else n


def amends_targets(edges: DataFrame) -> DataFrame:
    """(source_sec_id, target): what each amending clause amends."""
    return edges.where("edge_type = 'AMENDS' AND source_sec_id IS NOT NULL").select("source_sec_id", F.col("dst").alias("target")).distinct()


def closure(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth): nodes reached from each root along the edges, root excluded.

    A round joins only the newest frontier and drops what was seen; each round is
    written out, so the plan doesn't grow with the depth.
    """
    e = edges.select("src", "dst").distinct()
    seen = roots.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("depth")).distinct()
    frontier = seen
    for d in range(1, depth + 1):
        nxt = frontier.join(e, frontier["node"] == e["src"]).select("root", F.col("dst").alias("node")).distinct()
        frontier = cut_lineage(nxt.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
        if d < depth and frontier.isEmpty():
            break
    return seen.where("depth > 0")


def section_seed(numbers: DataFrame, sections: DataFrame) -> DataFrame:
    """(key, number, node): the section of a cited number, or its nearest ancestor.

    ``numbers`` (key, number), ``sections`` (id, number). All ancestors of a number are
    tried in one join, the longest that exists wins.
    """
    n = F.size(F.split("number", r"\("))
    tries = numbers.withColumn("k", F.explode(F.sequence(n, F.lit(1)))).withColumn("try", F.expr("array_join(slice(split(number, '[(]'), 1, k), '(')"))
    s = sections.select(F.col("id"), F.col("number").alias("try"))
    hit = tries.join(s, "try").groupBy("key", "number").agg(F.max(F.struct(F.col("k"), F.col("id"))).alias("m"))
    return hit.select("key", "number", F.col("m.id").alias("node"))


def resolve_mentions(mentions: DataFrame, sections: DataFrame) -> DataFrame:
    """``mentions`` (document_id, number, ...) with ``dst``: exact section, else parent."""
    s = sections.select("document_id", "number", F.col("id").alias("_sid"))
    parent = s.select("document_id", F.col("number").alias("_parent"), F.col("_sid").alias("_pid"))
    m = mentions.join(s, ["document_id", "number"], "left").withColumn("_parent", F.substring_index("number", "(", 1))
    return m.join(parent, ["document_id", "_parent"], "left").withColumn("dst", F.coalesce("_sid", "_pid")).drop("_sid", "_pid", "_parent")


def ordered_dfs(starts: DataFrame, edges: DataFrame, keep: DataFrame, max_depth: int = 3, max_nodes: int = 25) -> DataFrame:
    """(qid, node, pos): the ordered depth-limited search from each question's starts.

    Depth-first over out-edges in ``seq`` order, with inbound exceptions first, each node
    visited when popped, until ``max_nodes`` nodes of ``keep`` (id) are out. This is not
    the ball of that radius: a node first popped at the last depth is not expanded. The
    edges within reach are gathered by joins per question; the walks run over them one
    question after another, and ``max_depth`` hops bound what a question holds.
    """
    out = edges.where("edge_type != 'AMENDS'").select("src", "dst", F.lit(1).alias("side"), "seq")
    back = edges.where("edge_type = 'EXCEPTION_TO'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0).alias("side"), "seq")
    held = keep.select(F.col("id").alias("dst"), F.lit(True).alias("kept")).distinct()
    e = cut_lineage(out.unionByName(back).distinct().join(held, "dst", "left"))
    cols = ["qid", "src", "dst", "side", "seq", "kept", "start"]
    front = starts.select("qid", F.col("node").alias("src")).distinct()
    first = starts.select("qid", F.lit(None).cast("string").alias("src"), F.col("node").alias("dst"), F.lit(0).alias("side"), F.col("pos").cast("long").alias("seq"), F.col("pos").cast("int").alias("start"))
    # A node is expanded at one step only, so no edge of a question comes twice.
    seen, rows = front, first.join(held, "dst", "left").select(*cols)
    for d in range(max_depth):
        step = front.join(e, "src")
        rows = rows.unionByName(step.withColumn("start", F.lit(None).cast("int")).select(*cols))
        if d + 1 < max_depth:
            front = cut_lineage(step.select("qid", F.col("dst").alias("src")).distinct().join(seen, ["qid", "src"], "left_anti"))
            seen = seen.unionByName(front)
    rows = rows.repartition("qid").sortWithinPartitions("qid", "side", F.asc_nulls_last("seq"), F.asc_nulls_last("dst"))

    def walk(rows: list[tuple]) -> list[str]:
        nexts: dict[str, list[str]] = {}
        for src, dst, _, _ in rows:
            if src is not None:
                nexts.setdefault(src, []).append(dst)
        kept = {dst for _, dst, k, _ in rows if k}
        first = [dst for _, dst, _, at in sorted((r for r in rows if r[3] is not None), key=lambda r: r[3])]
        stack, visited, result = [(n, 0) for n in reversed(first)], set(), []
        while stack and len(result) < max_nodes:
            node, depth = stack.pop()
            if node in visited:
                continue
            visited.add(node)
            if node in kept:
                result.append(node)
            if depth < max_depth:
                stack += [(d, depth + 1) for d in reversed(nexts.get(node, [])) if d not in visited]
        return result

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(of: list[tuple[str, list[str]]]) -> pa.RecordBatch:
            flat = [(q, n, k) for q, nodes in of for k, n in enumerate(nodes)]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))], ["qid", "node", "pos"])

        qid, own, done = None, [], []
        for rb in batches:
            for q, *row in zip(*[c.to_pylist() for c in rb.columns]):
                if own and q != qid:
                    done.append((qid, walk(own)))
                    own = []
                qid = q
                own.append(row)
            if done:
                yield found(done)
                done = []
        if own:
            yield found([(qid, walk(own))])

    return rows.select("qid", "src", "dst", "kept", "start").transform(shipped).mapInArrow(run, "qid string, node string, pos int")
