"""Blocks of context that no single provision holds: lists and histories read off the graph.

Each function gives one row per question or agreement with the block's ``citation`` and
``text`` and the nodes that it covers, in order. Lists inside a block are put together by
ordered aggregation, so their order doesn't depend on the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexloom.operators import temporal

BLOCK = "struct<citation:string,text:string,node_ids:array<string>,reserved:boolean>"
#: What made blocks are cited as. Fixed values.
TITLES = {
    "catalogue": "Amendment catalog (all AMENDS edges)",
    "roster": "Party roster (all PARTY_TO edges)",
    "components": "Component changes (definitions this term is computed from)",
    "history": "Change history (all AMENDS edges on relevant provisions)",
    "conflicts": "Cross-reference audit (offline, all REFERENCES edges checked)",
}
#: Characters of an amendment's text in a history, and of a provision's body in the prompt.
SNIPPET, BODY = 400, 3500


def ordered(by: list, value: Column, sep: str = "\n") -> Column:
    """The distinct values of a group in the order of ``by``, joined."""
    rows = F.array_sort(F.collect_set(F.struct(*[b.alias(f"o{k}") if isinstance(b, Column) else F.col(b).alias(f"o{k}") for k, b in enumerate(by)], value.alias("v"))))
    return F.array_join(F.transform(rows, lambda x: x["v"]), sep)


def catalogue(ops: DataFrame, labels: DataFrame, group: str) -> DataFrame:
    """(group, operations, text, node_ids): every operation, by instrument, in order of time.

    ``ops`` (group, node_id, eff, seq, kind, instrument), ``labels`` (node_id, label).
    """
    rows = ops.join(labels, "node_id")
    per = rows.groupBy(group, "eff", "instrument").agg(F.count(F.lit(1)).alias("n"), ordered(["label", "seq"], F.concat(F.lit("  "), "label", F.lit(" ("), "kind", F.lit(")"))).alias("list"), F.array_sort(F.collect_set("node_id")).alias("ids"))
    head = F.concat("instrument", F.lit(" — effective "), F.col("eff").cast("string"), F.lit(" — "), F.col("n").cast("string"), F.lit(" operations:\n"), "list")
    out = per.groupBy(group).agg(F.sum("n").alias("operations"), ordered(["eff", "instrument"], head, "\n\n").alias("body"), F.array_sort(F.collect_list(F.struct("eff", "instrument", "ids"))).alias("ids"))
    ids = F.array_distinct(F.flatten(F.transform("ids", lambda x: x["ids"])))
    return out.select(group, "operations", F.concat(F.lit("Amendment operations in all: "), F.col("operations").cast("string"), F.lit(".\n\n"), "body").alias("text"), ids.alias("node_ids"))


def dependents(roots: DataFrame, inbound: DataFrame, labels: DataFrame) -> DataFrame:
    """(qid, node, citation, text, node_ids): all that depends on each definition of ``roots``.

    ``roots`` (qid, node, term), ``inbound`` (node, dependent).
    """
    d = roots.join(inbound, "node").join(labels.select(F.col("node_id").alias("dependent"), "label"), "dependent")
    line = F.concat("label", F.lit("  ["), "dependent", F.lit("]"))
    out = d.groupBy("qid", "node", "term").agg(ordered(["dependent"], line).alias("text"), F.array_sort(F.collect_set("dependent")).alias("ids"))
    return out.select("qid", "node", F.concat(F.lit("Provisions that depend on “"), "term", F.lit("” (inbound graph edges)")).alias("citation"), "text", F.array_union(F.array("node"), "ids").alias("node_ids"))


def components(roots: DataFrame, uses: DataFrame, ops: DataFrame, labels: DataFrame) -> DataFrame:
    """(qid, node, component, text): the latest change on the day to each term that a root uses.

    ``roots`` (qid, node, as_of), ``uses`` (src, dst) of dependencies between definitions,
    ``ops`` as in ``temporal``.
    """
    pair = roots.join(uses.select(F.col("src").alias("node"), F.col("dst").alias("component")).distinct(), "node").where("node != component")
    got = pair.join(ops.withColumnRenamed("node_id", "component"), "component").where(temporal.counts_on(F.col("eff"), F.col("as_of")))
    last = got.groupBy("qid", "node", "component").agg(F.max(F.struct("eff", "seq", "kind", "instrument")).alias("o"))
    named = last.join(labels.select(F.col("node_id").alias("node"), F.col("label").alias("of")), "node").join(labels.select(F.col("node_id").alias("component"), "label"), "component")
    line = F.concat(F.lit("- "), "of", F.lit(" is computed from "), "label", F.lit(", which "), F.col("o.instrument"), F.lit(" changed ("), F.col("o.kind"), F.lit(", effective "), F.col("o.eff").cast("string"), F.lit("); this applies wherever the first is used."))
    return named.select("qid", "node", "component", line.alias("text"))


def histories(roots: DataFrame, uses: DataFrame, ops: DataFrame, labels: DataFrame) -> DataFrame:
    """(qid, operations, text): every operation in force on each root and the terms it uses.

    ``roots`` (qid, node, as_of, rank), ``uses`` (src, dst). A provision that is both root and
    component counts as root.
    """
    own = roots.select("qid", "as_of", F.col("rank"), F.col("node").alias("root"), "node", F.lit(0).alias("far"))
    via = roots.join(uses.select(F.col("src").alias("node"), F.col("dst").alias("used")).distinct(), "node").select("qid", "as_of", "rank", F.col("node").alias("root"), F.col("used").alias("node"), F.lit(1).alias("far"))
    once = own.unionByName(via).groupBy("qid", "as_of", "node").agg(F.min(F.struct("rank", "far", "root")).alias("m"))
    got = once.join(ops.withColumnRenamed("node_id", "node"), "node").where(temporal.counts_on(F.col("eff"), F.col("as_of")))
    named = got.join(labels.select(F.col("node_id").alias("node"), "label"), "node").join(labels.select(F.col("node_id").alias("_r"), F.col("label").alias("of")), F.col("m.root") == F.col("_r"))
    snippet = F.substring(F.regexp_replace(F.trim(F.coalesce("new_text", F.lit(""))), "\n", " "), 1, SNIPPET)
    rel = F.when(F.col("m.far") == 1, F.concat(F.lit(" — a component that "), "of", F.lit(" relies on"))).otherwise("")
    line = F.concat(F.lit("- "), "label", rel, F.lit(": "), "kind", F.lit(" by "), "instrument", F.lit(", effective "), F.col("eff").cast("string"), F.lit(". Change: "), snippet)
    return named.groupBy("qid").agg(F.count(F.lit(1)).alias("operations"), ordered([F.col("m.rank"), F.col("m.far"), "node", "eff", "seq"], line).alias("text"))


def roster(parties: DataFrame) -> DataFrame:
    """(document_id, parties, text, node_ids): each party with its roles, in order of name.

    ``parties`` (node_id, name, role, document_id), one row per role.
    """
    per = parties.groupBy("document_id", "name").agg(F.array_join(F.array_sort(F.collect_set("role")), ", ").alias("roles"), F.min("node_id").alias("id"))
    rows = F.array_sort(F.collect_list(F.struct("name", "roles", "id")))
    out = per.groupBy("document_id").agg(rows.alias("r"))
    line = lambda x: F.concat(F.lit("- "), x["name"], F.lit(" — "), x["roles"])
    return out.select("document_id", F.size("r").alias("parties"), F.array_join(F.transform("r", line), "\n").alias("text"), F.array_distinct(F.transform("r", lambda x: x["id"])).alias("node_ids"))


def bodies(nodes: DataFrame, ops: DataFrame, split: bool = False) -> DataFrame:
    """(qid, node, part, citation, text): the blocks of each node's text as of its day.

    ``nodes`` (qid, node, as_of, citation, text). With ``split``, what an amendment inserted
    comes first, as blocks of its own, and is cut out of the body.
    """
    if not split:
        return nodes.select("qid", "node", F.lit(0).alias("part"), "citation", "text")
    ins = nodes.select("qid", "node", "as_of").join(ops.where("kind = 'insert' AND new_text != ''").withColumnRenamed("node_id", "node"), "node").where(temporal.counts_on(F.col("eff"), F.col("as_of")))
    ins = ins.groupBy("qid", "node").agg(F.array_sort(F.collect_list(F.struct("eff", "seq", "instrument", "new_text"))).alias("ins"))
    both = nodes.join(ins, ["qid", "node"], "left").withColumn("ins", F.coalesce("ins", F.array().cast("array<struct<eff:date,seq:bigint,instrument:string,new_text:string>>")))
    rest = F.aggregate("ins", F.col("text"), lambda t, o: F.replace(t, F.concat(F.lit("\n"), o["new_text"]), F.lit("")))
    own = F.transform("ins", lambda o: F.struct(F.concat("citation", F.lit(" — PROVISO added by "), o["instrument"], F.lit(" (effective "), o["eff"].cast("string"), F.lit(")")).alias("citation"), o["new_text"].alias("text")))
    return both.select("qid", "node", F.posexplode(F.concat(own, F.array(F.struct(F.col("citation"), rest.alias("text"))))).alias("part", "b")).select("qid", "node", "part", "b.citation", "b.text")
