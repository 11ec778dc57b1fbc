"""Cross-references audited: what dangles, what provisos are claimed, what overrides what."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexloom.operators import extract

#: A mention of a section that is none of a regulation's. Fixed value.
MENTION = r"(?<!Regulation )Sections?\s+(\d{1,2}\.\d{2}(?:\([a-z0-9]+\))?)(?!\d)"
#: What follows a mention of another document's section, and a claim about a proviso. Fixed values.
OTHER_DOCUMENT = r"(?i)^\s*(?:of|under)\s+(?:the|any|such|each)\s+(?!Credit Agreement)"
PROVISO_CLAIM = r"(?i)(?:first |second |the )provisos? (?:to|of|in) (?:this )?Section\s+(\d{1,2}\.\d{2}(?:\([a-z0-9]+\))?)"
#: Clauses that say which provision controls. Fixed value; the last two openings are how the
#: clauses of this project's tables begin.
PRECEDENCE = r"(?i)notwithstanding anything|in the event of (?:any )?conflict|shall control|shall govern|to the extent of (?:any|such) conflict|notwithstanding section|subject always to section"
CLAUSE, SENTENCE, SNIPPET, TAIL, SCORED = 500, 700, 300, 40, 1200


def sentence_around(text: Column, start: Column, end: Column, most: int) -> Column:
    """The sentence that holds [start, end) of ``text``, from after the last stop or line end."""
    head = F.regexp_extract(F.substr(text, F.lit(1), start.cast("int")), r"(?s)^(?:.*(?:\. |\n))?(.*)$", 1)
    middle = F.substr(text, (start + 1).cast("int"), (end - start).cast("int"))
    rest = F.substr(text, (end + 1).cast("int"), F.length(text))
    tail = F.when(F.contains(rest, F.lit(". ")), F.concat(F.substring_index(rest, ". ", 1), F.lit("."))).otherwise(rest)
    return F.substring(F.replace(F.trim(F.concat(head, middle, tail)), F.lit("\n"), F.lit(" ")), 1, most)


def families(sections: DataFrame) -> DataFrame:
    """(document_id, family, text): each section's text with its subsections', in order of id."""
    fam = F.substring_index("number", "(", 1)
    rows = F.array_sort(F.collect_list(F.struct("id", F.coalesce("text", F.lit("")).alias("t"))))
    return sections.groupBy("document_id", fam.alias("family")).agg(F.array_join(F.transform(rows, lambda x: x["t"]), "\n").alias("text"))


def mentions(sections: DataFrame) -> DataFrame:
    """(id, document_id, text, k, number, start, len): mentions of this document's sections."""
    m = extract.matches(sections, MENTION)
    tail = F.expr(f"substring(text, start + len + 1, {TAIL})")
    return m.where(~tail.rlike(OTHER_DOCUMENT)).withColumnRenamed("value", "number")


def dangling(sections: DataFrame) -> DataFrame:
    """(id, number, mentions): mentions of what exists neither itself nor as parent or child."""
    known = sections.select("document_id", F.substring_index("number", "(", 1).alias("family")).distinct()
    m = mentions(sections).withColumn("family", F.substring_index("number", "(", 1))
    return m.join(known, ["document_id", "family"], "left_anti").groupBy("id", "number").agg(F.count(F.lit(1)).alias("mentions"))


def proviso_claims(sections: DataFrame) -> DataFrame:
    """(id, k, number, claim, verified): claims of a proviso, and whether the family has one.

    Claims about a family without text are left out.
    """
    m = extract.matches(sections, PROVISO_CLAIM).withColumn("family", F.substring_index("value", "(", 1))
    fam = families(sections).where("trim(text) != ''").select("document_id", "family", F.contains(F.lower("text"), F.lit("provided")).alias("verified"))
    claim = F.expr("substring(text, start + 1, len)")
    return m.join(fam, ["document_id", "family"]).select("id", "k", F.col("value").alias("number"), claim.alias("claim"), "verified")


def precedence(sections: DataFrame) -> DataFrame:
    """(id, document_id, clause, overrides): the first clause of each section that overrides another.

    ``overrides`` are the numbers that the clause names, in order.
    """
    pattern = "(" + PRECEDENCE.replace("(?i)", "") + ")"
    m = extract.matches(sections.where(F.col("text").rlike(PRECEDENCE)), "(?i)" + pattern).where("k = 0")
    clause = sentence_around(F.col("text"), F.col("start"), F.col("start") + F.col("len"), CLAUSE)
    named = F.array_distinct(F.regexp_extract_all("clause", F.lit(r"Sections?\s+(\d{1,2}\.\d{2}(?:\([a-z0-9]+\))?)"), F.lit(1)))
    return m.select("id", "document_id", clause.alias("clause")).withColumn("overrides", named)


def referring(sections: DataFrame) -> DataFrame:
    """(src, document_id, number, sentence): each pair of section and family it refers to, with the first sentence.

    References to its own family and to other documents are left out.
    """
    m = mentions(sections.withColumn("own", F.substring_index("number", "(", 1))).withColumn("family", F.substring_index("number", "(", 1))
    own = sections.select("id", F.substring_index("number", "(", 1).alias("own"))
    sentence = sentence_around(F.col("text"), F.col("start"), F.col("start") + F.col("len"), SENTENCE)
    rows = m.join(own, "id").where("family != own").select(F.col("id").alias("src"), "document_id", "family", "k", sentence.alias("sentence"))
    return rows.groupBy("src", "document_id", "family").agg(F.min(F.struct("k", "sentence")).alias("m")).select("src", "document_id", "family", F.col("m.sentence").alias("sentence"))


def mismatches(sections: DataFrame, scorer: Callable[[DataFrame], DataFrame], top: int = 20) -> DataFrame:
    """The ``top`` references whose sentence the target supports least, by ``scorer``."""
    fam = families(sections).where("trim(text) != ''").withColumn("text", F.substring("text", 1, SCORED))
    pairs = referring(sections).join(fam, ["document_id", "family"]).withColumnRenamed("sentence", "question")
    return scorer(pairs).orderBy("score", "src", "family").limit(top).select("src", F.concat("document_id", F.lit("::"), "family").alias("dst"), F.col("question").alias("sentence"), "score", F.replace(F.substring("text", 1, SNIPPET), F.lit("\n"), F.lit(" ")).alias("snippet"))


def conflict_block(clauses: DataFrame, sections: DataFrame, counts: DataFrame, most: int = 8) -> DataFrame:
    """(agreement_id, citation, text, node_ids): an agreement's audit in words.

    ``clauses`` as by ``precedence``, ``counts`` (agreement_id, mentions, dangling). The
    ``most`` clauses that name what they override come first, each with how that begins.
    """
    c = clauses.withColumn("agreement_id", F.substring_index("document_id", ".", 1)).withColumn("named", F.when(F.size("overrides") > 0, 0).otherwise(1))
    first = c.groupBy("agreement_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("named", "id", "clause", "document_id", "overrides"))), 1, most).alias("c"))
    flat = first.select("agreement_id", F.posexplode("c").alias("pos", "c")).select("agreement_id", "pos", F.col("c.id").alias("id"), F.col("c.clause").alias("clause"), F.col("c.document_id").alias("document_id"), F.explode_outer("c.overrides").alias("number"))
    text = sections.select("document_id", "number", F.substring(F.regexp_replace(F.trim("text"), r"\s+", " "), 1, 200).alias("snip"))
    rows = flat.join(text, ["document_id", "number"], "left").groupBy("agreement_id", "pos", "id", "clause").agg(F.array_sort(F.collect_list(F.when(F.col("snip").isNotNull(), F.concat(F.lit("    (overridden §"), "number", F.lit(" provides: “"), "snip", F.lit("…”)"))))).alias("s"))
    line = F.array_join(F.concat(F.array(F.concat(F.lit("- "), "id", F.lit(": “"), F.substring("clause", 1, 240), F.lit("”"))), "s"), "\n")
    body = rows.groupBy("agreement_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"), F.array_sort(F.collect_set("id")).alias("node_ids"))
    head = F.concat(F.lit("Section references checked: "), F.col("mentions").cast("string"), F.lit("; dangling: "), F.col("dangling").cast("string"), F.lit(". Clauses that say which provision controls:\n"))
    return body.join(counts, "agreement_id").select("agreement_id", F.concat(head, "body").alias("text"), "node_ids")
