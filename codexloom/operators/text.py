"""Chunking and word measures over texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexloom.runtime import running_sum, skew_join

#: Words that carry no content in grounding. Fixed values.
STOP_WORDS = tuple(
    "a an and are as at be been but by can did do does for from had has have how i if in into is it it's its may must no not of on or shall should such than that the their them then there these this to under was were what when which who will with would you your".split()
)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def windows(n: Column, size: int, overlap: int) -> Column:
    """Starts of word windows: steps of size - overlap below max(n - overlap, 1)."""
    return F.sequence(F.lit(0), F.greatest(n - overlap, F.lit(1)) - 1, F.lit(size - overlap))


def chunk_sections(sections: DataFrame, most: int = 512) -> DataFrame:
    """(id, section_id, text): one chunk per section with text, long ones in parts."""
    s = sections.select(F.col("id").alias("section_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    parts = s.select("section_id", F.size("w").alias("n"), "w", F.posexplode(windows(F.size("w"), most, 0)).alias("k", "at"))
    name = F.when(F.col("n") > most, F.concat("section_id", F.lit("::p"), F.col("k"))).otherwise(F.col("section_id"))
    return parts.select(name.alias("id"), "section_id", F.array_join(F.slice("w", F.col("at") + 1, F.lit(most)), " ").alias("text"))


def chunk_fixed(sections: DataFrame, size: int = 512, overlap: int = 256) -> DataFrame:
    """(id, document_id, section_id, text): word windows over each document's sections.

    Sections get the number of their first word by a prefix sum of lengths; each word
    then goes to the windows that cover it. ``section_id`` is that of the first word.
    """
    step = size - overlap
    s = sections.select("document_id", "id", "pos", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    lens = s.select("document_id", "id", F.size("w").cast("long").alias("n"), "pos")
    first = running_sum(lens, "document_id", "pos", ["pos", "id"], "n", "first").select("document_id", "id", "first")
    total = s.groupBy("document_id").agg(F.sum(F.size("w")).alias("n"))
    at = s.join(skew_join(first, total, ["document_id"]), ["document_id", "id"])
    last = F.floor((F.greatest(F.col("n") - overlap, F.lit(1)) - 1) / step)
    # A section goes to its windows as slices, never as single words.
    lo = F.greatest(F.ceil((F.col("first") - size + 1) / step), F.lit(0))
    hi = F.least(F.floor((F.col("first") + F.size("w") - 1) / step), last)
    cut = at.where(lo <= hi).withColumn("k", F.explode(F.sequence(lo, hi)))
    begin = F.greatest(F.col("k") * step - F.col("first"), F.lit(0)).cast("int")
    end = F.least(F.col("k") * step + size - F.col("first"), F.size("w").cast("long")).cast("int")
    part = cut.select("document_id", "k", "first", "id", F.array_join(F.slice("w", begin + 1, end - begin), " ").alias("t"), begin.alias("b")).where("t != ''")
    g = part.groupBy("document_id", "k").agg(F.array_sort(F.collect_list(F.struct("first", "id", "t"))).alias("x"))
    return g.select(F.concat("document_id", F.lit("::chunk"), "k").alias("id"), "document_id", F.col("x")[0]["id"].alias("section_id"), F.array_join(F.transform("x", lambda p: p["t"]), " ").alias("text"))


def content_words(text: Column) -> Column:
    all_ = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9.$%()]+"), F.lit(0)))
    return F.filter(all_, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


def said(source: Column) -> Column:
    """The words of a source that claims are held against, each once."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(source, F.lit(""))), F.lit(r"[a-z0-9.$%()]+"), F.lit(0)))


def grounding(claim: Column, source: Column) -> Column:
    """Share of the claim's content words that the source has; 1 if it has none."""
    return grounding_in(claim, said(source))


def grounding_in(claim: Column, target: Column) -> Column:
    """As ``grounding``, of the source's words as by ``said``."""
    c = content_words(claim)
    return F.when(F.size(c) == 0, 1.0).otherwise(F.size(F.array_intersect(c, target)) / F.size(c))


def subphrases(term: Column) -> Column:
    """Contiguous runs of at least two words of a term of three or more, longest first."""
    w = F.split(F.trim(term), r"\s+")
    n = F.size(w)
    runs = F.flatten(F.transform(F.sequence(n - 1, F.lit(2), F.lit(-1)), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))))
    return F.when(n >= 3, runs).otherwise(F.array().cast("array<string>"))
