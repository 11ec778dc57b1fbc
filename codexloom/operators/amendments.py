"""Amending operations out of the text of amendments, and the parties of a cover page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexloom.operators import extract

_TERM = r"[“\"]([^”\"]+)[”\"]"
_NUMBER = r"(\d{1,2}\.\d{1,2}(?:\([a-z0-9]+\))*)"
#: What an amending clause looks like, in order of priority: (kind of target, whether it always
#: inserts, pattern with the target captured). Fixed values, but for the last, which is how
#: the clauses of this project's tables begin.
CLAUSES = [
    ("definition", True, rf"{_TERM}\s+means\b"),
    ("definition", False, rf"(?is)clause\s+\([^)]+\)\s+of the definition of {_TERM}.{{0,120}}?is hereby (?:amended|added|deleted)"),
    ("definition", False, rf"(?is)(?:the )?definition of {_TERM}.{{0,120}}?is hereby (?:amended|added|deleted)"),
    ("section", False, r"(?i)Section ([\d.]+(?:\([a-z0-9]+\))*) of the Credit Agreement is hereby (?:amended|added|deleted|restated)"),
    ("section", True, rf"(?i)inserting the following new Section\s+{_NUMBER}"),
    ("exhibit", False, r"(?is)Exhibit ([A-Z])\b.{0,80}?is hereby (?:amended|restated)"),
    ("section", False, rf"Section {_NUMBER} of the Credit Agreement is amended\b"),
]
BATCH, PLAIN = 0, 3
#: The clause that inserts a batch of definitions, and the section it amends. Fixed values.
_BATCH = r"(?i)Section 1\.01 of the Credit Agreement is hereby amended by inserting the following definitions?"
_BATCH_TARGET = "1.01"
_NEW_TEXT = r"(?s)^.*?(?:follows|thereof|the following|order|below)\s*[:.]"
_IN_DEFINITION = r"(?i)definition of [“\"][^”\"]+[”\"]\s+in\s+$"
#: Characters from a clause's start that tell its operation, and of its text where none is marked.
TOLD, UNMARKED = 240, 2000


def _new_text(after: Column) -> Column:
    marked = F.regexp_replace(after, _NEW_TEXT, "")
    return F.trim(F.when(after.rlike(_NEW_TEXT), marked).otherwise(F.substring(after, 1, UNMARKED)))


def amend_ops(sections: DataFrame, patterns: list[tuple[str, bool, str]] = CLAUSES) -> DataFrame:
    """(document_id, target_kind, target, op, new_text, source_sec_id) of amending clauses.

    ``sections`` (id, number, level, document_id, pos, text). Only sections of the first
    article and sections that say they amend something are read, however often they are
    delivered. Of several clauses of a
    document with one target, the first counts, by section, pattern and place; a target
    loses the punctuation that recognition left behind it. Null texts have no clause.
    """
    opens = F.startswith("number", F.lit("1.")) | F.col("text").rlike(r"^\s*\d+\.\d+\s+Amendment to\b")
    own = sections.where((F.col("level") == "section") & opens & F.col("text").rlike("hereby amended|hereby add|Credit Agreement is amended"))
    own = own.select(F.struct("pos", "id").alias("id"), "document_id", "text")
    # All patterns are matched in one pass over the texts.
    every = extract.matches_of(own, [p for _, _, p in patterns])
    family, start, end = F.col("family"), F.col("start"), F.col("start") + F.col("len")
    window = F.substr("text", (start + 1).cast("int"), F.lit(TOLD))
    before = F.substr("text", (F.greatest(start - 80, F.lit(0)) + 1).cast("int"), F.least(start, F.lit(80)).cast("int"))
    batch = F.col("text").rlike(_BATCH)
    is_ = lambda ks: family.isin(*ks) if ks else F.lit(False)
    every = every.where(((family != BATCH) | batch) & ~((family == PLAIN) & (window.rlike(_BATCH) | before.rlike(_IN_DEFINITION))))
    kind = F.element_at(F.array(*[F.lit(k) for k, _, _ in patterns]), family + 1)
    op = F.when(is_([k for k, (_, inserts, _) in enumerate(patterns) if inserts]), "insert").otherwise(extract.classify_op(window))
    new = F.when(family == BATCH, F.col("text")).otherwise(_new_text(F.substr("text", (end + 1).cast("int"), F.length("text"))))
    found = every.select("id", "document_id", kind.alias("target_kind"), F.col("value").alias("target"), op.alias("op"), new.alias("new_text"), "family", "k")
    # A batch amends the section that holds the definitions too.
    held = own.where(batch).select("id", "document_id", F.lit("section").alias("target_kind"), F.lit(_BATCH_TARGET).alias("target"), F.lit("insert").alias("op"), F.col("text").alias("new_text"), F.lit(BATCH).alias("family"), F.lit(1 << 30).alias("k"))
    named = found.unionByName(held).withColumn("target", F.regexp_replace(F.trim("target"), r"[,;.]+$", "")).where("target != ''")
    first = named.groupBy("document_id", "target_kind", "target").agg(F.min(F.struct("id", "family", "k", "op", "new_text")).alias("m"))
    return first.select("document_id", "target_kind", "target", F.col("m.op").alias("op"), F.col("m.new_text").alias("new_text"), F.col("m.id.id").alias("source_sec_id"))


def resolve_targets(ops: DataFrame, nodes: DataFrame) -> DataFrame:
    """``ops`` with ``node_id``, the base document's node that each amends, and ``made``.

    ``nodes`` (id). A target that the base lacks is made by its first operation; ``made``
    says so. The base of ``x.amendment_n`` is ``x.base``.
    """
    base = F.concat(F.regexp_replace("document_id", r"[^.]*$", ""), F.lit("base"))
    mark = F.when(F.col("target_kind") == "definition", "::def::").when(F.col("target_kind") == "exhibit", "::exhibit::").otherwise("::")
    have = nodes.select(F.col("id").alias("node_id"), F.lit(False).alias("made")).distinct()
    return ops.withColumn("node_id", F.concat(base, mark, "target")).join(have, "node_id", "left").withColumn("made", F.coalesce("made", F.lit(True)))


#: A cover page's line of a party, and the party that stands for unnamed lenders. Fixed values.
PARTY_LINE = r"^(.{1,60}?),? as (?:the )?(\p{Lu}.{0,59}?),?$"
OTHER_LENDERS, OTHERS_NAME, OTHERS_ROLE = "Other Lenders", "The Other Lenders Party Hereto", "Lender"
#: Characters behind a party's name in which its short forms are quoted.
ALIAS_REACH = 240


def parties(preambles: DataFrame) -> DataFrame:
    """(document_id, node_id, name, roles, aliases) from the lines of cover pages.

    ``preambles`` (document_id, text). A line may name two parties and two roles. Short
    forms are the name up to its comma and what is quoted behind it, each also without
    apostrophes; a short form that is the role of another party only is dropped.
    """
    line = F.regexp_replace(F.trim("l"), r",+$", "")
    lines = preambles.where("text IS NOT NULL").select("document_id", "text", F.posexplode(F.split("text", "\n")).alias("at", "l")).withColumn("l", line)
    got = lines.where(F.col("l").rlike(PARTY_LINE)).select("document_id", "text", "at", F.regexp_extract("l", PARTY_LINE, 1).alias("names"), F.regexp_extract("l", PARTY_LINE, 2).alias("r"))
    roles = F.transform(F.split("r", " and "), lambda x: F.regexp_replace(F.trim(x), "s+$", ""))
    got = got.select("document_id", "text", "at", roles.alias("roles"), F.posexplode(F.split("names", r" and (?=\p{Lu}{2})")).alias("k", "name")).withColumn("name", F.trim("name"))
    rest = preambles.where(F.contains(F.col("text"), F.lit(OTHER_LENDERS))).select("document_id", "text", F.lit(1 << 30).alias("at"), F.array(F.lit(OTHERS_ROLE)).alias("roles"), F.lit(0).alias("k"), F.lit(OTHERS_NAME).alias("name"))
    both = got.unionByName(rest).where("name != ''").withColumn("short", F.substring_index("name", ",", 1))
    near = F.regexp_extract_all("text", F.concat(F.lit(r"\Q"), "short", F.lit(r"\E[^\n]{0," + str(ALIAS_REACH) + "}")), F.lit(0))
    said = F.flatten(F.transform(near, lambda w: F.regexp_extract_all(w, F.lit(r"“\s*([^”]{2,40})\s*”"), F.lit(1))))
    forms = F.array_union(F.array("short"), F.transform(said, F.trim))
    forms = F.array_sort(F.array_except(F.array_union(forms, F.transform(forms, lambda a: F.regexp_replace(a, "['’]", ""))), F.array("name")))
    every = both.groupBy("document_id").agg(F.array_distinct(F.flatten(F.collect_list("roles"))).alias("all_roles"))
    out = both.withColumn("forms", forms).join(every, "document_id")
    out = out.withColumn("aliases", F.filter("forms", lambda a: ~F.array_contains("all_roles", a) | F.array_contains("roles", a)))
    one = out.groupBy("document_id", "name").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "k", "roles"))), lambda x: x["roles"]))).alias("roles"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"))
    return one.select("document_id", F.concat(F.lit("party::"), "name").alias("node_id"), "name", "roles", "aliases")


def party_edges(found: DataFrame) -> DataFrame:
    """(src, dst, edge_key, edge_type, seq): a party to its document, one edge for each role."""
    rows = found.select(F.col("node_id").alias("src"), F.col("document_id").alias("dst"), F.posexplode("roles").alias("seq", "role"))
    return rows.select("src", "dst", F.concat(F.lit("PARTY_TO::"), "role").alias("edge_key"), F.lit("PARTY_TO").alias("edge_type"), F.col("seq").cast("long").alias("seq"))


def roster_rows(edges: DataFrame) -> DataFrame:
    """(node_id, name, role, document_id) of all PARTY_TO edges, as the roster block takes them."""
    e = edges.where("edge_type = 'PARTY_TO'")
    return e.select(F.col("src").alias("node_id"), F.regexp_replace("src", "^party::", "").alias("name"), F.regexp_replace("edge_key", "^PARTY_TO::", "").alias("role"), F.col("dst").alias("document_id")).distinct()
