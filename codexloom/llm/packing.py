"""Filling fixed-capacity containers: harmonic packing in independent shards.

A document of size s belongs to class k, the number of such documents that a container
of capacity C holds (C / (k + 1) < s <= C / k). Documents are spread by a hash of their
id over shards of about FILL containers each, and every shard is packed on its own, without
any look at the others: class by class, k ascending, each container gets exactly k
documents of class k, and then, into the room that the classes' bounds leave, the
largest documents of later classes that still fit. So only a shard's last container is
left with much room, at every size of the corpus.

The plain method packs classes apart, which leaves the room that the class bounds and each
class's last container leave; ``extend=False`` gives it, for comparison.

A document larger than C is cut into full containers of its own, and its rest is packed
like a document of that size. No other document is cut.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexloom.runtime import shipped

#: Full containers that a shard's documents would fill on average. Its last container, the
#: only one with much room, is then about a thousandth. A shard's task holds only sizes and
#: ids; of documents that take no room there are at most SHARD to a shard on average.
FILL, SHARD = 1000, 200_000


def harmonic(sizes: np.ndarray, capacity: int, extend: bool = True) -> tuple[np.ndarray, int]:
    """The container of each size (all <= capacity, in descending order), and their number.

    Sizes of 0 count as 1. Without ``extend`` a container takes its own class only.
    """
    least = np.maximum(sizes, 1)
    stacks: dict[int, list[int]] = {}
    for i in range(len(least) - 1, -1, -1):
        stacks.setdefault(int(least[i]), []).append(i)
    left = sorted(stacks)
    out, n = np.full(len(sizes), -1, dtype=np.int64), 0

    def take(most: int) -> tuple[int, int] | None:
        """The largest document that is left and no larger than ``most``."""
        at = bisect_right(left, most) - 1
        if at < 0:
            return None
        size = left[at]
        i = stacks[size].pop()
        if not stacks[size]:
            del left[at]
        return i, size

    while left:
        k, room = capacity // left[-1], capacity
        low = capacity // (k + 1)
        for _ in range(k):
            # The class's own documents first, k of them at most.
            if not left or left[-1] <= low:
                break
            i, size = take(left[-1])
            out[i], room = n, room - size
        while extend and left and room >= left[0]:
            i, size = take(room)
            out[i], room = n, room - size
        n += 1
    return out, n


def pack(sizes: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens", shard: int = SHARD, fill: int = FILL, extend: bool = True) -> DataFrame:
    """(id, piece_no, start, end, n_tokens, docs_class, bin) for every row of ``sizes``.

    ``bin`` is unique to a container, ``docs_class`` is k, ``start`` and ``end`` are
    offsets in the document. Repeated rows collapse. Null ids are packed like others,
    null and negative sizes count as 0, and a document of size 0 takes the room of 1.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    docs = sizes.select(F.col(id_col).alias("_id"), F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("long").alias("_n")).distinct()
    c = F.lit(capacity).cast("long")
    pieces = docs.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("_n") / c) - 1, F.lit(0)))))
    pieces = pieces.select("_id", (F.col("_p") + 1).cast("int").alias("piece_no"), (F.col("_p") * c).alias("start"), F.least((F.col("_p") + 1) * c, F.col("_n")).alias("end"))
    # Pieces that fill a container need no company.
    rest = F.sum(F.when(F.col("end") - F.col("start") < c, F.greatest(F.col("end") - F.col("start"), F.lit(1))))
    total = pieces.agg(F.greatest(F.ceil(F.count(F.lit(1)) / shard), F.ceil(F.coalesce(rest, F.lit(0)) / (c * fill)), F.lit(1)).alias("_shards"))
    key = F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit("\0")), "piece_no", "end")
    rows = pieces.crossJoin(F.broadcast(total)).withColumn("_key", key).withColumn("_shard", F.pmod("_key", "_shards")).drop("_shards")
    kind = docs.schema["_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(n_tokens=pdf["end"] - pdf["start"]).sort_values(["n_tokens", "_key", "start"], ascending=[False, True, True])
        bins, _ = harmonic(pdf["n_tokens"].to_numpy(), capacity, extend)
        name = [f"{s}-{b}" for s, b in zip(pdf["_shard"], bins)]
        return pdf.assign(docs_class=capacity // np.maximum(pdf["n_tokens"], 1), bin=name)[["_id", "piece_no", "start", "end", "n_tokens", "docs_class", "bin"]]

    out = rows.transform(shipped).groupBy("_shard").applyInPandas(run, f"_id {kind}, piece_no int, start long, end long, n_tokens long, docs_class long, bin string")
    return out.withColumnRenamed("_id", id_col)


def report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, documents' pieces, tokens, and the share of unused room."""
    bins = packed.groupBy("bin").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("c"))
    out = bins.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("c"), F.lit(0)).alias("pieces"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.max("t").alias("fullest"))
    return out.select(F.lit(capacity).alias("capacity_tokens"), "*", F.when(F.col("containers") > 0, F.round(1 - F.col("tokens") / (F.col("containers") * capacity), 6)).alias("unused_share"))
