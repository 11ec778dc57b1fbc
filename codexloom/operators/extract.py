"""Facts out of section and definition texts, inside the JVM wherever offsets allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexloom.runtime import range_of

#: A mention of a section, the number captured. Fixed value.
SECTION_MENTION = r"Section\s+([0-9]{1,2}\.[0-9]{2}(?:\([a-z]\))*)"
ORDINALS = ("First", "Second", "Third", "Fourth", "Fifth", "Sixth", "Seventh", "Eighth", "Ninth", "Tenth")


def _places(f: int) -> Column:
    """The matches of pattern ``f`` as an array, from the columns that hold them."""

    def upto(i: Column) -> Column:
        before = F.aggregate(F.slice(f"_m{f}", 1, i), F.lit(0), lambda s, x: s + F.length(x))
        return F.aggregate(F.slice(f"_g{f}", 1, i + 1), F.lit(0), lambda s, g: s + g) + before

    return F.transform(f"_m{f}", lambda x, i: F.struct(F.lit(f).alias("family"), i.alias("k"), F.get(f"_v{f}", i).alias("value"), upto(i).cast("long").alias("start"), F.length(x).alias("len")))


def matches_of(rows: DataFrame, patterns: list[str]) -> DataFrame:
    """(id, document_id, text, family, k, value, start, len): each match of each pattern, its value captured.

    ``family`` is the pattern's place in the list. Starts come from the lengths of the pieces
    between the matches, summed inside the row, so no row leaves the JVM or its partition.
    """
    own = rows.where(F.col("text").isNotNull()).select("id", "document_id", "text")
    for f, p in enumerate(patterns):
        own = own.withColumns({f"_m{f}": F.regexp_extract_all("text", F.lit(p), F.lit(0)), f"_v{f}": F.regexp_extract_all("text", F.lit(p), F.lit(1)), f"_g{f}": F.transform(F.split("text", p, -1), lambda x: F.length(x))})
    found = [_places(f) for f in range(len(patterns))]
    return own.select("id", "document_id", "text", F.explode(F.concat(*found)).alias("x")).select("id", "document_id", "text", "x.*")


def matches(rows: DataFrame, pattern: str) -> DataFrame:
    """(id, document_id, text, k, value, start, len): each match with its captured value."""
    return matches_of(rows.where(F.col("text").rlike(pattern)), [pattern]).drop("family")


def mentions(sections: DataFrame, pattern: str = SECTION_MENTION, before: int = 60, after: int = 20) -> DataFrame:
    """(id, document_id, k, number, start, evidence): each mention with its surroundings."""
    begin = F.greatest(F.col("start") - before, F.lit(0))
    return matches(sections, pattern).select("id", "document_id", "k", F.col("value").alias("number"), "start", F.substr("text", (begin + 1).cast("int"), (F.col("start") + F.col("len") + after - begin).cast("int")).alias("evidence"))


def classify_op(text: Column) -> Column:
    """replace, insert or restate, by the words of an amending clause.

    A clause that only deletes counts as replace: the first rule takes its words too.
    """
    return (
        F.when(text.rlike(r"(?is)amended by (?:deleting|replacing)|by replacing the text in the proviso"), "replace")
        .when(text.rlike(r"amended by (?:inserting|adding)"), "insert")
        .otherwise("restate")
    )


def containment(sections: DataFrame) -> DataFrame:
    """(src, dst, seq): document, article, section and subsection by running state.

    The last article and section before a row are running maxima of their places. They
    run inside ranges of places, and over the ranges, so a large document is no one task's.
    """
    at = F.struct(F.col("pos").alias("pos"), F.col("id").alias("id"), F.col("level").alias("level"))
    rows = sections.select("id", "document_id", "level", "pos", F.when(F.col("level") == "article", at).alias("a"), F.when(F.col("level") != "subsection", at).alias("s"), range_of(F.col("pos")).alias("b"))
    w = Window.partitionBy("document_id", "b").orderBy("pos", "id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("document_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("document_id", "b").agg(F.max("a").alias("a"), F.max("s").alias("s"))
    ends = ends.select("document_id", "b", F.max("a").over(before).alias("a0"), F.max("s").over(before).alias("s0"))
    run = rows.withColumns({"a": F.max("a").over(w), "s": F.max("s").over(w)}).join(ends, ["document_id", "b"])
    art, sec = F.coalesce("a", "a0"), F.coalesce("s", "s0")
    # A section that opens before the current article belongs to an earlier one.
    under = F.coalesce(F.when(sec["level"] == "section", sec["id"]), art["id"], F.col("document_id"))
    parent = F.when(F.col("level") == "article", F.col("document_id")).when(F.col("level") == "section", F.coalesce(art["id"], F.col("document_id"))).otherwise(under)
    return run.select(parent.alias("src"), F.col("id").alias("dst"), F.col("pos").cast("long").alias("seq"))


def exceptions(sections: DataFrame) -> DataFrame:
    """(src, dst, evidence): subsections of a section whose text excepts and ends with a colon."""
    p = sections.where(F.rtrim(F.regexp_replace("text", r"\s+$", "")).endswith(":") & F.col("text").rlike(r"(?i)\b(?:except|other than)\b")).select(F.col("document_id"), F.col("number").alias("_n"), F.col("id").alias("dst"), F.expr("right(rtrim(text), 120)").alias("evidence"))
    kids = sections.where("level = 'subsection'").select("document_id", F.col("id").alias("src"), F.substring_index("number", "(", 1).alias("_n"))
    return kids.join(p, ["document_id", "_n"]).select("src", "dst", "evidence")


def term_mentions(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, term): defined terms that each text mentions, longer terms masking shorter.

    ``texts`` (key, scope, text), ``terms`` (scope, term). At every word with which a term of
    the scope begins, the runs of as many words as some term has are joined to the terms,
    instead of each text being searched for each term. Of the hits, leftmost and then
    longest win, and none overlaps another.
    """
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}'’-]+"), F.lit(0))
    run = F.regexp_extract_all("term", F.lit(r"[\p{L}\p{N}'’-]+"), F.lit(0))
    named = terms.select("scope", "term", F.array_join(run, " ").alias("run"), F.size(run).alias("n"), F.get(run, F.lit(0)).alias("first")).where("run != ''").distinct()
    known = named.groupBy("scope").agg(F.collect_set("n").alias("lengths"), F.collect_set("first").alias("firsts"))
    # Texts without any first word of a term go no further.
    t = texts.where("text IS NOT NULL").join(known, "scope").select("key", "scope", words.alias("w"), "lengths", "firsts")
    t = t.withColumn("here", F.array_intersect("w", "firsts")).where(F.size("here") > 0).drop("firsts")
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.array_contains("here", F.get("w", i)))
    runs = t.withColumn("i", F.explode(at)).withColumn("n", F.explode("lengths")).where(F.col("i") + F.col("n") <= F.size("w"))
    named = named.select("scope", "term", "run")
    hits = runs.select("key", "scope", "i", "n", F.array_join(F.slice("w", F.col("i") + 1, F.col("n")), " ").alias("run")).join(named, ["scope", "run"])
    per = hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", (-F.col("n")).alias("n"), "term"))).alias("h"))
    first = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("out"))
    kept = F.aggregate("h", first, lambda a, x: F.when(x["i"] >= a["end"], F.struct((x["i"] - x["n"]).cast("int").alias("end"), F.array_append(a["out"], x["term"]).alias("out"))).otherwise(a), lambda a: a["out"])
    return per.select("key", F.explode(kept).alias("term")).distinct()


def islands(paragraphs: DataFrame, is_open: Column, key: str = "doc_id", pos: str = "pos", text: str = "text") -> DataFrame:
    """(key, island, text): each opening paragraph with those that follow it, joined."""
    w = Window.partitionBy(key).orderBy(pos)
    rows = paragraphs.withColumn("island", F.sum(F.when(is_open, 1).otherwise(0)).over(w)).where("island > 0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda x: x[text]), "\n")
    return rows.groupBy(key, "island").agg(joined.alias("text"))
