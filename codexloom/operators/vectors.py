"""Exact vector search over array columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexloom.runtime import cut_lineage, shipped

#: Vectors per block on average; two blocks meet in one task at a time.
BLOCK = 2048
#: Vectors in a block of queries or corpus; tasks at most among which one block of queries
#: meets the corpus; blocks of queries in a task on average; blocks of corpus in a task, and
#: tasks for each core, from which there are more lanes.
MEETING, LANES, HELD, LANE, WAVES = 1024, 64, 8, 256, 4


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalized(v: Column, floor: float = 1e-12) -> Column:
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm(v), F.lit(floor)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _blocks(df: DataFrame, id_col: str, vec: str, size: int, names: tuple[str, str, str]) -> DataFrame:
    n = max(1, math.ceil(df.count() / size))
    return df.where(F.col(vec).isNotNull()).groupBy(F.pmod(F.xxhash64(id_col), F.lit(n)).alias(names[0])).agg(F.collect_list(F.struct(F.col(id_col).cast("long").alias("i"), F.col(vec).alias("v"))).alias(names[1]))


def _pressed(m: np.ndarray) -> bytes:
    """A matrix of doubles as compressed bytes, after the number of its columns."""
    return np.int64(m.shape[1]).tobytes() + pa.compress(np.ascontiguousarray(m, dtype=np.float64).tobytes(), codec="zstd", asbytes=True)


def _unpressed(x: bytes, rows: int) -> np.ndarray:
    n = int(np.frombuffer(x, dtype=np.int64, count=1)[0])
    return np.frombuffer(pa.decompress(memoryview(x)[8:], decompressed_size=8 * rows * n, codec="zstd"), dtype=np.float64).reshape(rows, n)


def packed(df: DataFrame, id_col: str, col: str, size: int = MEETING, model: Callable | None = None) -> DataFrame:
    """(b, i, v): blocks of up to ``size`` vectors, compressed, and their ids as bytes, made where the rows lie.

    ``col`` holds vectors; with a ``model``, as in ``operators.models``, texts, where a null one is empty.
    """
    x = F.coalesce(F.col(col), F.lit("")) if model else F.col(col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("i"), x.alias("x")).where("x IS NOT NULL")

    def block(ids: np.ndarray, vecs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (ids.tobytes(), _pressed(vecs))], ["i", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = model() if model else None
        ids, held = np.zeros(0, dtype=np.int64), None
        for rb in batches:
            if rb.column(0).null_count:
                raise ValueError("a vector has no id")
            for at in range(0, rb.num_rows, size):
                part = rb.slice(at, size)
                m = encode(part.column(1).to_pylist()) if encode else part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                ids, held = np.concatenate([ids, part.column(0).to_numpy()]), np.array(m, dtype=np.float64) if held is None else np.concatenate([held, m])
                if len(ids) >= size:
                    yield block(ids[:size], held[:size])
                    ids, held = ids[size:].copy(), held[size:].copy()
        if len(ids):
            yield block(ids, held)

    return cut_lineage(shipped(rows).mapInArrow(run, "i binary, v binary").select(F.monotonically_increasing_id().alias("b"), "i", "v"))


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of parallel (row, id, score) the first k of each row by score, ties to the lower id, in order of rows."""
    row, ids, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ids, -score, row))
    row = row[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], ids[order][first], score[order][first]


def _single(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``m`` in single precision, and its rows' lengths, infinite where single precision can't hold them."""
    with np.errstate(over="ignore", invalid="ignore"):
        n = np.sqrt(np.einsum("ij,ij->i", m, m))
        return m.astype(np.float32), np.where(n < 1e15, n, np.inf)


def _near(s: np.ndarray, least: np.ndarray, slack: np.ndarray, k: int) -> np.ndarray:
    """Where scores ``s`` that are off by up to ``slack`` may reach ``least``, and the k-th of their row if that is worth its search."""

    def reach(x: np.ndarray, off: np.ndarray) -> np.ndarray:
        # Scores are rounded to 10 digits; what lies so near below the k-th may equal it.
        x = np.where(off < np.inf, x - off, -np.inf) - 1e-10
        return ~(s < (x if s.dtype == np.float64 else np.nextafter(x.astype(np.float32), np.float32(-np.inf)))[:, None])

    near, n = reach(least, slack), s.shape[1]
    if n > k and np.count_nonzero(near) > 4 * k * len(s):
        near &= reach(np.partition(s, n - k, axis=1)[:, n - k].astype(np.float64), 2 * slack)
    return near


def _found(q: tuple, c: tuple, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of all products of ``q`` and ``c`` that may be among the first k of a row.

    Products in single precision tell which; those are then made exactly. ``q`` and ``c``: matrix, and what ``_single`` gives.
    """
    (a, a32, an), (b, b32, bn) = q, c
    # No sum of products in single precision is further off than this, in whatever order it is made.
    slack = an * bn.max(initial=0) * (a.shape[1] + 4) * 2.0**-23
    with np.errstate(over="ignore", invalid="ignore"):
        near = _near(a32 @ b32.T, least, np.where(np.isnan(slack), np.inf, slack), k)
    if 64 * np.count_nonzero(near) > near.size:
        s = a @ b.T
        row, col = np.nonzero(_near(s, least, np.zeros(len(a)), k))
        return row, col, np.round(s[row, col], 10)
    row, col = np.divmod(np.flatnonzero(near), near.shape[1])
    s = [np.einsum("ij,ij->i", a[row[n : n + 4096]], b[col[n : n + 4096]]) for n in range(0, len(row), 4096)]
    return row, col, np.round(np.concatenate([np.zeros(0), *s]), 10)


def top_k(queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding", block: int = MEETING) -> DataFrame:
    """(qid, id, score, rank): the k largest inner products of each query, exactly; ties go to the lower id."""
    return meet(packed(queries, id_col, vec, block), packed(corpus, id_col, vec, block), k)


def meet(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """As ``top_k``, of packed vectors.

    Blocks of queries and corpus meet as matrices, where both are read from the checkpoint
    folder: neither is shuffled with copies or broadcast. A task keeps k rows per query
    of all that it meets, so what is shuffled is k rows per query and lane.
    """
    # A task holds its query blocks in memory, so they are few.
    held = max(1, math.ceil(queries.count() / HELD))
    # As many lanes as all cores need, or as long ones ask for: each adds k rows per query.
    lanes = max(math.ceil(WAVES * corpus.sparkSession.sparkContext.defaultParallelism / held), math.ceil(corpus.count() / LANE))
    q = queries.repartition(held).withColumn("qn", F.monotonically_increasing_id())
    c = corpus.coalesce(max(1, min(LANES, lanes))).select(F.col("i").alias("ci"), F.col("v").alias("c"), F.monotonically_increasing_id().alias("cn"))
    pairs = c.hint("shuffle_replicate_nl").join(q.select("b", F.col("i").alias("qi"), F.col("v").alias("q"), "qn"))
    # A task takes its corpus blocks one after another, and all its query blocks for each, so Python gets a block
    # where it comes first. The number of a row in its partition is in the lower 33 bits.
    nth = lambda n: F.col(n).bitwiseAND(F.lit((1 << 33) - 1))
    sent = [F.when(nth(n) == 0, F.col(x)).alias(x) for n, x in (("cn", "qi"), ("cn", "q"), ("qn", "ci"), ("qn", "c"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple] = {}
        # What was found since, by block of queries; it joins what is kept when it is as much as that may be.
        new: dict[int, list[tuple]] = {}
        asked: dict[int, tuple[np.ndarray, tuple]] = {}
        at, ci, c = None, None, None

        def read(x: pa.Scalar, y: pa.Scalar) -> tuple[np.ndarray, tuple]:
            i = np.frombuffer(x.as_py(), dtype=np.int64)
            m = _unpressed(y.as_py(), len(i))
            return i, (m, *_single(m))

        def keep(b: int) -> None:
            rows = len(asked[b][0])
            got = _best([*([kept[b][0]] if b in kept else []), *new.pop(b)], k)
            n, least = np.bincount(got[0], minlength=rows), np.full(rows, -np.inf)
            least[n >= k] = got[2][np.cumsum(n)[n >= k] - 1]
            kept[b] = (got, least)

        for rb in batches:
            for b, n, *four in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), *rb.columns[2:]):
                if four[0].is_valid:
                    asked[b] = read(*four[:2])
                if four[2].is_valid:
                    at, (ci, c) = n, read(*four[2:])
                if at != n or b not in asked:
                    raise ValueError("blocks came out of order")
                qi, q = asked[b]
                row, col, score = _found(q, c, kept[b][1] if b in kept else np.full(len(qi), -np.inf), k)
                if len(row):
                    new.setdefault(b, []).append((row, ci[col], score))
                    if b not in kept or 2 * sum(len(x[0]) for x in new[b]) > k * len(qi):
                        keep(b)
        for b in list(new):
            keep(b)
        for b, ((row, ids, score), _) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(asked[b][0][row]), pa.array(ids), pa.array(score)], ["qid", "id", "score"])

    got = pairs.select("b", "cn", *sent).transform(shipped).mapInArrow(run, "qid long, id long, score double")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_nodes(ranked: DataFrame, node: Column, k: int) -> DataFrame:
    """(qid, node, rank): hits collapsed to their nodes, the first k distinct by rank."""
    best = ranked.withColumn("node", node).groupBy("qid", "node").agg(F.min("rank").alias("first"))
    w = Window.partitionBy("qid").orderBy("first")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "node", "rank")


def similar_pairs(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vec: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(a, b, cosine), a < b, of all pairs at or above ``threshold``, exactly.

    Blocks meet once each as matrices, as in ``top_k``, so the work grows with the square
    of the vectors; what leaves a meeting is only its pairs. Cosines are rounded to 10 digits.
    """
    rows = vectors.where(F.col(vec).isNotNull()).select(F.col(id_col).cast("long").alias("i"), normalized(F.col(vec)).alias("v")).where("i IS NOT NULL").dropDuplicates(["i"])
    rows = cut_lineage(rows)
    x, y = (_blocks(rows, "i", "v", block, n) for n in (("xb", "x", ""), ("yb", "y", "")))
    last = max(1, math.ceil(rows.count() / block)) - 1
    met = x.withColumn("yb", F.explode(F.sequence(F.col("xb"), F.lit(last).cast("long")))).join(y, "yb")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for xb, yb, xs, ys in zip(pdf["xb"], pdf["yb"], pdf["x"], pdf["y"]):
                xi, yi = np.array([r["i"] for r in xs]), np.array([r["i"] for r in ys])
                s = np.round(np.array([r["v"] for r in xs], dtype=np.float64) @ np.array([r["v"] for r in ys], dtype=np.float64).T, 10)
                m, n = np.nonzero(s >= threshold)
                if xb == yb:
                    m, n = m[xi[m] < yi[n]], n[xi[m] < yi[n]]
                yield pd.DataFrame({"a": np.minimum(xi[m], yi[n]), "b": np.maximum(xi[m], yi[n]), "cosine": s[m, n]})

    return met.select("xb", "yb", "x", "y").transform(shipped).mapInPandas(run, "a long, b long, cosine double")


def max_sim(query: Column, doc: Column) -> Column:
    """Late interaction: for each vector of ``query`` its best inner product with one of ``doc``, summed.

    Both are arrays of vectors; without any vector in either the sum is 0.
    """
    best = F.transform(query, lambda q: F.coalesce(F.array_max(F.transform(doc, lambda d: dot(q, d))), F.lit(0.0)))
    return F.coalesce(F.aggregate(best, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))


def greedy_keep(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, kept): what a pass in id order keeps, dropping whatever resembles a kept one.

    Rounds decide every item whose earlier neighbours are decided; the outcome is that
    of the sequential pass, in as many rounds as the longest chain of decisions.
    """
    e = pairs.select("a", "b")
    state = cut_lineage(ids.select("id").distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while not state.where("kept IS NULL").isEmpty():
        seen = e.join(state.select(F.col("id").alias("a"), F.col("kept").alias("k")), "a").groupBy("b").agg(F.max(F.coalesce("k", F.lit(False))).alias("hit"), F.max(F.col("k").isNull()).alias("open"))
        nxt = state.join(seen, state["id"] == seen["b"], "left")
        verdict = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("hit", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)
        state = cut_lineage(nxt.select("id", verdict.alias("kept")))
    return state
