"""Splitting oversized items at natural boundaries, by ranges of bytes.

A text is read in ranges of RANGE bytes with a halo on both sides, whether it is a table's
or a file's; no worker needs all of it. Each worker decodes its range, counts the
characters that begin in it and lists the boundaries that lie in it, with their strength.
Prefix sums of the ranges' characters turn them into offsets in the item, the boundary
tables are stitched by (item, range), and items of several SEGMENTs are cut at the strongest
boundary near the start of each, so that the choice of cuts runs over bounded tables. Prefix
sums of the pieces per segment number them. Pieces are then cut out of the ranges that hold
them, by offset. The text of an item of one range never leaves the task that reads it.

Piece i + 1 starts exactly ``overlap`` characters before the end of piece i, so the
item is the pieces' concatenation without those overlaps. A piece ends at the strongest
boundary in the second half of its room, the last of equals; where there is none, at
the limit. No piece is longer than ``max_chars``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexloom.runtime import cut_lineage, ship, shipped

#: Bytes per range, of its halos, and per segment (of several ranges).
RANGE, HALO, SEGMENT = 65_536, 1024, 1_048_576

#: Strength of a boundary: paragraph, line, sentence or clause, list opening, part, word.
PARAGRAPH, LINE, SENTENCE, OPENING, PART, WORD = 6, 5, 4, 3, 2, 1
_BOUNDARY = re.compile(
    r"(?P<p6>\n[ \t\r]*\n\s*)|(?P<p5>\n[ \t]*)"
    r"|(?P<p4>(?:[.!?][\"”’')\]]{0,3}|;(?: and| or)?)[^\S\n]+(?=\([a-z0-9ivx]{1,4}\)|[A-ZÀ-Þ“\"(\[§])|[。！？])"
    r"|(?P<p3>:[^\S\n]+(?=\([a-z0-9ivx]{1,4}\)|[A-Z]))|(?P<p2>[,;:][^\S\n]+)|(?P<p1>[^\S\n]+)"
)
_ABBREVIATION = re.compile(r"(?:\b(?:No|Nos|Sec|Art|Inc|Ltd|Co|Corp|Mr|Ms|Dr|St|vs|cf|e\.g|i\.e|a\.m|p\.m|Ziff|Abs|Nr)|\b[A-Z])\.$")


def boundaries(text: str, offset: int, first: int, last: int) -> list[int]:
    """The boundaries of ``text`` in [first, last), each as offset * 8 + strength.

    ``text`` starts at ``offset`` of its item. A cut at the offset lies behind the
    separator, so that a piece keeps it and the next one starts with text.
    """
    out = []
    for m in _BOUNDARY.finditer(text):
        at = offset + m.end()
        if not first <= at < last:
            continue
        # The groups stand in the pattern from the strongest to the weakest.
        strength = 7 - m.lastindex
        if strength == SENTENCE and _ABBREVIATION.search(text, max(0, m.start() - 8), m.start() + 1):
            strength = WORD
        out.append(at * 8 + strength)
    return out


def choose_cuts(length: int, cuts: list[int] | np.ndarray, max_chars: int, overlap: int, start: int = 0) -> list[tuple[int, int]]:
    """(start, end) of the pieces of [start, length) given sorted cuts (offset * 8 + strength)."""
    if max_chars < 1:
        raise ValueError("max_chars must be at least 1")
    cuts = np.asarray(cuts, dtype=np.int64)
    # The strongest, and of equals the last, is the largest of these.
    ranked = (cuts & 7) << 58 | cuts >> 3
    overlap = max(0, min(overlap, max_chars // 2))
    out, at = [], start
    while length - at > max_chars:
        low, high = at + max(max_chars // 2, overlap + 1), at + max_chars
        k, j = np.searchsorted(cuts, (low * 8, (high + 1) * 8))
        end = high if k == j else int(ranked[k:j].max()) & ((1 << 58) - 1)
        out.append((at, end))
        at = end - overlap
    out.append((at, length))
    return out


def oversized(items: DataFrame, limits: DataFrame, kind: str = "item_kind", source: str = "source", text: str = "text") -> DataFrame:
    """``items`` whose text is longer than the limit of their kind and source.

    Kinds and sources match regardless of case and outer blanks. Items of a kind or
    source without a limit, and null texts, are never oversized. Adds ``max_chars`` and
    ``overlap_chars``; ``limits`` is a table of settings and is broadcast.
    """
    norm = lambda c: F.lower(F.btrim(c))
    lim = limits.groupBy(norm(F.col("item_kind")).alias("_kind"), norm(F.col("source")).alias("_source")).agg(F.min("max_chars").alias("max_chars"), F.min("overlap_chars").alias("overlap_chars"))
    own = items.drop("max_chars", "overlap_chars")
    return own.join(F.broadcast(lim), (norm(own[kind]) == F.col("_kind")) & (norm(own[source]) == F.col("_source"))).where(F.length(text) > F.col("max_chars")).drop("_kind", "_source")


# ------------------------------------------------------------------ ranges of bytes
def _ranges(length: Column, size: int) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.floor((length - 1) / size), F.lit(0)).cast("int"))


def ranges_of(items: DataFrame, keys: list[str], text: str = "text", size: int = RANGE, halo: int = HALO) -> DataFrame:
    """One row per range of each item's bytes: keys, limits, r, lo, and ``body`` with its halos."""
    raw = F.col(text).cast("binary")
    rows = items.select(*keys, "max_chars", "overlap_chars", raw.alias("_t"), F.octet_length(text).alias("n")).withColumn("r", F.explode(_ranges(F.col("n"), size)))
    lo = F.greatest(F.col("r") * size - halo, F.lit(0))
    hi = F.least((F.col("r") + 1) * size + halo, F.col("n"))
    return rows.select(*keys, "max_chars", "overlap_chars", "r", lo.cast("long").alias("lo"), F.substr("_t", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("body"))


def file_ranges(spark: SparkSession, paths: list[str], size: int = RANGE, halo: int = HALO) -> DataFrame:
    """(path, r, lo, body) of files that all workers can open, each row read by itself.

    Only sizes are looked up on the driver. A repeated path counts once.
    """
    ship(spark)
    plan = spark.createDataFrame([(p, os.path.getsize(p)) for p in dict.fromkeys(paths)], "path string, n long")
    plan = plan.withColumn("r", F.explode(_ranges(F.col("n"), size))).repartition("path", "r")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, n, r in zip(pdf["path"], pdf["n"], pdf["r"]):
                lo, hi = max(0, r * size - halo), min(n, (r + 1) * size + halo)
                with open(path, "rb") as f:
                    f.seek(lo)
                    out.append((path, r, lo, f.read(hi - lo)))
            yield pd.DataFrame(out, columns=["path", "r", "lo", "body"])

    return plan.transform(shipped).mapInPandas(run, "path string, r int, lo long, body binary")


def decode_range(body: bytes, lo: int, r: int, size: int) -> tuple[str, str, str]:
    """The halo before, the characters that begin in range ``r``, and the halo after.

    A character belongs to the range that holds its first byte. Bytes that are no UTF-8
    become replacement characters, one and the same way whenever the range is read.
    """

    def first_at(i: int) -> int:
        i = max(0, min(i, len(body)))
        while i < len(body) and body[i] & 0xC0 == 0x80:
            i += 1
        return i

    a, b = first_at(r * size - lo) if r else 0, first_at((r + 1) * size - lo)
    return body[first_at(0) if r else 0 : a].decode("utf-8", "replace"), body[a:b].decode("utf-8", "replace"), body[b:].decode("utf-8", "ignore")


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def boundary_table(ranges: DataFrame, keys: list[str], size: int = RANGE) -> DataFrame:
    """(keys, limits, r, chars, cuts): characters of each range, and its boundaries from its start.

    A range lists the boundaries that end in it; one that starts in the range before is
    seen whole because of the halo. Repeated deliveries of a range collapse.
    """
    names = [*keys, "max_chars", "overlap_chars", "r"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            chars, cuts = [], []
            for body, lo, r in zip(pdf["body"], pdf["lo"], pdf["r"]):
                before, own, after = decode_range(body, int(lo), int(r), size)
                chars.append(len(own))
                cuts.append(np.array(boundaries(before + own + after, -len(before), 0, len(own)), dtype=np.int64))
            yield pdf[names].assign(chars=chars, cuts=cuts)

    return ranges.transform(shipped).mapInPandas(run, _kinds(ranges, names) + ", chars long, cuts array<long>").dropDuplicates([*keys, "r"])


def offsets(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, r, base, total): where each range begins, by prefix sums of characters."""
    w = Window.partitionBy(*keys)
    run = F.sum("chars").over(w.orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    return table.select(*keys, "r", "chars").select(*keys, "r", (run - F.col("chars")).alias("base"), F.sum("chars").over(w).alias("total"))


def piece_table(table: DataFrame, at: DataFrame, keys: list[str], size: int = RANGE, segment: int = SEGMENT) -> DataFrame:
    """(keys, piece_no, piece_start, piece_end) for each item of the boundary table.

    ``at`` are the ranges' offsets. A segment starts at the strongest boundary (the first of
    equals) of its first range, less the overlap, and runs to the start of the next one. Its
    cuts are chosen from its own ranges and that next range, a bounded number of offsets,
    whatever the item's length. Numbers are prefix sums of the pieces per segment.
    """
    per = max(1, segment // size)
    opens = (F.col("r") % per == 0) & (F.col("r") > 0)
    rows = table.join(at, [*keys, "r"]).withColumn("cuts", F.transform("cuts", lambda c: c + F.col("base") * 8))
    best = F.array_max(F.transform("cuts", lambda c: F.struct((c % 8).alias("s"), (-F.shiftright(c, 3)).alias("a"))))
    rows = rows.withColumn("first", F.when(opens, F.coalesce(-best["a"], F.col("base"))))
    seg = F.floor(F.col("r") / per).cast("int")
    # The opening range serves its own segment and, as its tail, the one before.
    rows = rows.withColumn("seg", F.explode(F.when(opens, F.array(seg - 1, seg)).otherwise(F.array(seg))))
    rows = rows.groupBy(*keys, "max_chars", "overlap_chars", "seg").agg(
        F.max("total").alias("n"),
        F.min(F.when(F.floor(F.col("r") / per) == F.col("seg"), F.col("first"))).alias("begins"),
        F.max(F.when(F.floor(F.col("r") / per) > F.col("seg"), F.col("first"))).alias("ends"),
        F.array_sort(F.flatten(F.collect_list("cuts"))).alias("cuts"),
    )
    rows = rows.select(*keys, "max_chars", "overlap_chars", "seg", F.coalesce("begins", F.lit(0)).alias("begins"), F.coalesce("ends", "n").alias("ends"), "cuts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for *key, most, over, no, first, last, cuts in pdf.itertuples(index=False):
                cuts = np.asarray(cuts, dtype=np.int64)
                inside = cuts[(cuts >> 3 > first) & (cuts >> 3 <= last)]
                over = max(0, min(over, most // 2))
                spans = choose_cuts(last, inside, most, over, max(0, first - over) if no else first)
                out.append((*key, no, len(spans), [s for s, _ in spans], [e for _, e in spans]))
            if out:
                yield pd.DataFrame(out, columns=[*keys, "seg", "c", "s", "e"])

    done = cut_lineage(rows.transform(shipped).mapInPandas(run, _kinds(table, keys) + ", seg int, c long, s array<long>, e array<long>"))
    before = F.sum("c").over(Window.partitionBy(*keys).orderBy("seg")) - F.col("c")
    base = done.select(*keys, "seg", "c").select(*keys, "seg", before.alias("b"))
    flat = done.join(base, [*keys, "seg"]).select(*keys, "b", F.posexplode(F.arrays_zip("s", "e")).alias("k", "x"))
    return flat.select(*keys, (F.col("b") + F.col("k") + 1).cast("int").alias("piece_no"), F.col("x.s").alias("piece_start"), F.col("x.e").alias("piece_end"))


def emit(pieces: DataFrame, ranges: DataFrame, at: DataFrame, keys: list[str], size: int = RANGE) -> DataFrame:
    """``pieces`` with their text, each cut from the ranges that it lies in.

    The ranges of a piece's ends are looked up by merging both in the order of offsets.
    """
    marks = at.select(*keys, F.col("base").alias("p"), F.lit(0).alias("o"), "r", F.lit(None).cast("int").alias("piece_no"), F.lit(None).cast("boolean").alias("opens"))
    ends = pieces.select(*keys, "piece_no", F.explode(F.array(F.struct(F.col("piece_start").alias("p"), F.lit(True).alias("opens")), F.struct((F.col("piece_end") - 1).alias("p"), F.lit(False).alias("opens")))).alias("x"))
    ends = ends.select(*keys, F.col("x.p").alias("p"), F.lit(1).alias("o"), F.lit(None).cast("int").alias("r"), "piece_no", F.col("x.opens").alias("opens"))
    w = Window.partitionBy(*keys).orderBy("p", "o", "r").rowsBetween(Window.unboundedPreceding, 0)
    found = marks.unionByName(ends).withColumn("r", F.last("r", ignorenulls=True).over(w)).where("piece_no IS NOT NULL")
    reach = found.groupBy(*keys, "piece_no").agg(F.min("r").alias("r0"), F.max("r").alias("r1"))
    parts = pieces.join(reach, [*keys, "piece_no"]).withColumn("r", F.explode(F.sequence("r0", "r1"))).join(at.drop("total"), [*keys, "r"])
    parts = parts.groupBy(*keys, "r").agg(F.first("base").alias("base"), F.collect_list(F.struct("piece_no", "piece_start", "piece_end")).alias("ps"))
    bodies = ranges.select(*keys, "r", "lo", "body").dropDuplicates([*keys, "r"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for *key, r, base, ps, lo, body in pdf[[*keys, "r", "base", "ps", "lo", "body"]].itertuples(index=False):
                own = decode_range(body, int(lo), int(r), size)[1]
                for p in ps:
                    s, e = p["piece_start"], p["piece_end"]
                    out.append((*key, r, p["piece_no"], s, e, own[max(0, s - base) : max(0, e - base)]))
            if out:
                yield pd.DataFrame(out, columns=[*keys, "r", "piece_no", "piece_start", "piece_end", "part"])

    got = parts.join(bodies, [*keys, "r"]).transform(shipped).mapInPandas(run, _kinds(parts, keys) + ", r int, piece_no int, piece_start long, piece_end long, part string")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "part"))), lambda x: x["part"]), "")
    return got.groupBy(*keys, "piece_no", "piece_start", "piece_end").agg(text.alias("piece"))


def _pieces_of_ranges(ranges: DataFrame, keys: list[str], with_text: bool, size: int, segment: int) -> DataFrame:
    table = cut_lineage(boundary_table(ranges, keys, size))
    at = cut_lineage(offsets(table, keys))
    pieces = piece_table(table, at, keys, size, segment)
    return emit(cut_lineage(pieces), ranges, at, keys, size) if with_text else pieces


def _pieces_at_once(items: DataFrame, keys: list[str], text: str, with_text: bool) -> DataFrame:
    """The pieces of items of one range, cut where they are read."""
    cols = [*keys, "piece_no", "piece_start", "piece_end", *(["piece"] if with_text else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for *key, most, over, t in pdf.itertuples(index=False):
                for k, (s, e) in enumerate(choose_cuts(len(t), boundaries(t, 0, 0, len(t)), most, over)):
                    out.append((*key, k + 1, s, e, t[s:e]) if with_text else (*key, k + 1, s, e))
            yield pd.DataFrame(out, columns=cols)

    schema = _kinds(items, keys) + ", piece_no int, piece_start long, piece_end long" + (", piece string" if with_text else "")
    return items.select(*keys, "max_chars", "overlap_chars", text).transform(shipped).mapInPandas(run, schema)


def split_items(items: DataFrame, limits: DataFrame, keep: list[str], with_text: bool = True, kind: str = "item_kind", source: str = "source", text: str = "text", size: int = RANGE, halo: int = HALO, segment: int = SEGMENT) -> DataFrame:
    """The pieces of all oversized ``items``: ``keep`` columns, piece_no, offsets, piece.

    Offsets count characters from 0. Repeated deliveries of an item (same kept columns
    and text) give its pieces once; items that differ in text are split each. Null
    values in kept columns are kept. ``piece`` is left out without ``with_text``.
    """
    big = oversized(items, limits, kind, source, text)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in keep]
    uid = F.concat(F.hex(F.xxhash64(*named, F.col(text), "max_chars")), F.hex(F.xxhash64(F.col(text), "overlap_chars", *reversed(named))))
    carried = [F.col(c).alias(f"_k_{c}") for c in keep]
    big = big.select(uid.alias("_uid"), *carried, "max_chars", "overlap_chars", F.col(text).alias("_text"))
    keys = ["_uid", *[f"_k_{c}" for c in keep], "_max", "_over"]
    flat = big.withColumns({"_max": F.col("max_chars"), "_over": F.col("overlap_chars")})
    short, long = flat.where(F.octet_length("_text") <= size), flat.where(F.octet_length("_text") > size)
    once = _pieces_at_once(short, keys, "_text", with_text).dropDuplicates(["_uid", "piece_no"])
    slim = long.drop("_text").dropDuplicates(["_uid"]).select(*keys)
    many = _pieces_of_ranges(ranges_of(long, ["_uid"], "_text", size, halo), ["_uid"], with_text, size, segment).join(slim, "_uid")
    out = once.unionByName(many.select(once.columns))
    return out.select(*[F.col(f"_k_{c}").alias(c) for c in keep], "piece_no", "piece_start", "piece_end", *(["piece"] if with_text else []), F.col("_max").alias("max_chars"), F.col("_over").alias("overlap_chars"))


def split_files(spark: SparkSession, paths: list[str], max_chars: int, overlap: int, size: int = RANGE, halo: int = HALO, segment: int = SEGMENT) -> DataFrame:
    """(path, piece_no, piece_start, piece_end, piece) of UTF-8 files, offsets in characters.

    A file is never loaded whole: each range of bytes is read where it is needed. An empty
    file is one empty piece.
    """
    raw = file_ranges(spark, paths, size, halo).withColumns({"max_chars": F.lit(max_chars), "overlap_chars": F.lit(overlap)})
    return _pieces_of_ranges(raw, ["path"], True, size, segment)
