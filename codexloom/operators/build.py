"""The legal graph from the domain tables: vertices and edges of all types.

Vertices are documents, sections, definitions, parties of cover pages and exhibits that
amendments make. The tables hold no cover page and amend no exhibit, so over them the
last two are empty; over parsed filings they are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexloom.operators import amendments, extract, graph
from codexloom.runtime import cut_lineage, table


def sections(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sections").select("id", "number", "title", "text", "document_id", "level", "pos").distinct()


def outline(spark: SparkSession, sf: str) -> DataFrame:
    """The sections without their texts, so that telling repeated rows apart moves no text."""
    return table(spark, sf, "sections").select("id", "number", "document_id", "level", "pos").distinct()


def _told(spark: SparkSession, sf: str) -> DataFrame:
    """The sections as delivered, repeats and all: for edges, which come together by key, so that no text is moved."""
    return table(spark, sf, "sections").select("id", "number", "text", "document_id", "level")


def filings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "filings").select("id", "name", "doc_type", "doc_date", "amendment_number", "agreement_id").distinct()


def versions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "effective").distinct()


def definitions(spark: SparkSession, sf: str) -> DataFrame:
    """(id, document_id, term, text): each defined term with its first text."""
    v = versions(spark, sf).where(F.col("node_id").contains("::def::"))
    first = v.groupBy("node_id").agg(F.min(F.struct("effective_date", "version_id", "text")).alias("v"))
    return first.select(F.col("node_id").alias("id"), F.substring_index("node_id", "::def::", 1).alias("document_id"), F.expr("substring_index(node_id, '::def::', -1)").alias("term"), F.col("v.text").alias("text"))


def parties(spark: SparkSession, sf: str) -> DataFrame:
    return amendments.parties(sections(spark, sf).where(F.endswith("id", F.lit("::preamble"))).select("document_id", "text"))


def clauses(spark: SparkSession, sf: str) -> DataFrame:
    """The amending clauses of all amendments with the nodes that they amend."""
    return amendments.resolve_targets(amendments.amend_ops(table(spark, sf, "sections").where("document_id NOT LIKE '%.base'")), outline(spark, sf).select("id"))


def vertices(spark: SparkSession, sf: str, defs: DataFrame | None = None, said: DataFrame | None = None) -> DataFrame:
    """All vertices; ``defs`` and ``said`` are ``definitions`` and ``clauses`` where the caller has them already."""
    defs, said = definitions(spark, sf) if defs is None else defs, clauses(spark, sf) if said is None else said
    d = filings(spark, sf).select("id", F.lit("Document").alias("node_type"), F.col("name").alias("label")).dropDuplicates(["id"])
    s = outline(spark, sf).select("id", F.lit("Section").alias("node_type"), F.concat(F.lit("§"), F.col("number")).alias("label"))
    t = defs.select("id", F.lit("Definition").alias("node_type"), F.concat(F.lit("definition of “"), F.col("term"), F.lit("” (§1.01)")).alias("label"))
    p = parties(spark, sf).select(F.col("node_id").alias("id"), F.lit("Party").alias("node_type"), F.col("name").alias("label")).dropDuplicates(["id"])
    x = said.where("target_kind = 'exhibit'").select(F.col("node_id").alias("id"), F.lit("Exhibit").alias("node_type"), F.concat(F.lit("Exhibit "), F.col("target")).alias("label")).distinct()
    return d.unionByName(s).unionByName(t).unionByName(p).unionByName(x)


def amend_edges(spark: SparkSession, sf: str, said: DataFrame | None = None) -> DataFrame:
    """AMENDS from the amendment's filing to the node, one per version it made, with the clause that says so."""
    v = versions(spark, sf).where("status != 'original'")
    name = F.regexp_extract("citation", r"as amended by (\w+) Amendment", 1)
    number = F.array_position(F.array(*[F.lit(o) for o in extract.ORDINALS]), name)
    base = F.substring_index("node_id", ".", 1)
    made = v.where(number > 0).select(F.concat(base, F.lit(".amendment_"), number.cast("string")).alias("src"), F.col("node_id").alias("dst"), F.concat(F.lit("AMENDS::"), F.col("effective_date").cast("string")).alias("edge_key"), F.lit("AMENDS").alias("edge_type"), F.col("version_id").alias("seq"))
    said = clauses(spark, sf) if said is None else said
    said = said.select(F.col("document_id").alias("src"), F.col("node_id").alias("dst"), "source_sec_id")
    return made.join(said, ["src", "dst"], "left")


def edges(spark: SparkSession, sf: str, defs: DataFrame | None = None, said: DataFrame | None = None) -> DataFrame:
    """(src, dst, edge_key, edge_type, seq, source_sec_id), one edge per key; ``defs`` and ``said`` as for ``vertices``."""
    # Definitions are read five times below.
    sec, slim, defs = _told(spark, sf), outline(spark, sf), cut_lineage(definitions(spark, sf)) if defs is None else defs

    def typed(df: DataFrame, kind: str, seq) -> DataFrame:  # noqa: ANN001
        return df.select("src", "dst", F.lit(kind).alias("edge_key"), F.lit(kind).alias("edge_type"), seq.cast("long").alias("seq"))

    contains = typed(extract.containment(slim), "CONTAINS", F.col("seq"))
    refs = references(sec, slim)
    defines = defs.select(F.concat("document_id", F.lit("::1.01")).alias("src"), F.col("id").alias("dst")).join(slim.select(F.col("id").alias("src")), "src", "left_semi")
    uses = extract.term_mentions(defs.select(F.col("id").alias("key"), F.col("document_id").alias("scope"), "text"), defs.select(F.col("document_id").alias("scope"), "term"))
    uses = uses.select(F.col("key").alias("src"), F.concat(F.substring_index("key", "::def::", 1), F.lit("::def::"), F.col("term")).alias("dst")).where("src != dst")
    # References to definitions come after those to sections.
    named = typed(section_terms(spark, sf, defs), "REFERENCES", F.lit(1 << 20))
    parts = [contains, typed(refs, "REFERENCES", F.col("seq")), named, typed(extract.exceptions(sec), "EXCEPTION_TO", F.lit(0)), typed(defines, "DEFINES", F.lit(0)), typed(uses, "DEPENDS_ON", F.lit(0)), amendments.party_edges(parties(spark, sf)), amend_edges(spark, sf, said)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return graph.upsert(out)


def section_terms(spark: SparkSession, sf: str, definitions_: DataFrame | None = None) -> DataFrame:
    """(src, dst): operative sections and the definitions of their document whose terms they use."""
    defs = definitions(spark, sf) if definitions_ is None else definitions_
    sec, defs = _told(spark, sf), defs.select(F.col("document_id").alias("scope"), "term", F.col("id").alias("dst"))
    own = sec.where("level != 'article' AND NOT startswith(number, '1.01')")
    used = extract.term_mentions(own.select(F.struct("id", "document_id").alias("key"), F.col("document_id").alias("scope"), "text"), defs.select("scope", "term"))
    return used.select(F.col("key.id").alias("src"), F.col("key.document_id").alias("scope"), "term").join(defs, ["scope", "term"]).select("src", "dst").distinct()


def references(sec: DataFrame, slim: DataFrame | None = None) -> DataFrame:
    """(src, dst, seq, evidence) of each mention in ``sec`` that resolves to another section of ``slim``."""
    m = extract.mentions(sec).withColumnRenamed("id", "src")
    return graph.resolve_mentions(m, sec if slim is None else slim).where("dst IS NOT NULL AND dst != src").select("src", "dst", F.col("k").alias("seq"), "evidence")
