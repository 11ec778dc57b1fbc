"""Where models would stand: batched encoders and scorers, and what reads their output.

A model is given by a factory that each worker calls once; texts reach it in Arrow
batches. The ones here need no weights: a hashed bag of word parts as encoder, the share
of the question's words that a text has as scorer, and a generator that says nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexloom.operators import text as words
from codexloom.operators import vectors
from codexloom.reports import build_once
from codexloom.runtime import cut_lineage, ship

DIM, BATCH = 256, 32
#: Rates rows with ``question`` and ``text``: the same rows with ``score``.
Scorer = Callable[[DataFrame], DataFrame]


def hashed_encoder() -> Callable[[list[str]], np.ndarray]:
    """Texts to unit vectors: word parts of three letters hashed to DIM places with a sign."""

    known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def parts(w: str) -> tuple[np.ndarray, np.ndarray]:
        """Places and signs of a word's parts; words recur, so they are kept."""
        if w not in known:
            if len(known) > 100_000:
                known.clear()
            h = np.array([zlib.crc32(f" {w} "[k : k + 3].encode()) for k in range(max(1, len(w) - 1))], dtype=np.int64)
            known[w] = (h % DIM, 1 - 2 * (h >> 31))
        return known[w]

    def one(t: str) -> np.ndarray:
        got = [parts(w) for w in re.findall(r"\w+", t.lower())]
        if not got:
            return np.zeros(DIM)
        return np.bincount(np.concatenate([g[0] for g in got]), weights=np.concatenate([g[1] for g in got]), minlength=DIM)

    def encode(texts: list[str]) -> np.ndarray:
        m = np.array([one(t or "") for t in texts]).reshape(len(texts), DIM)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    return encode


def encode(df: DataFrame, text: str, out: str = "embedding", factory: Callable = hashed_encoder) -> DataFrame:
    """``df`` with the unit vector of ``text``; a null text has that of an empty one."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for s in batches:
            yield pd.Series(list(model([t or "" for t in s]))) if len(s) else pd.Series([], dtype=object)

    return df.withColumn(out, F.pandas_udf(run, "array<double>", functionType=F.PandasUDFType.SCALAR_ITER)(F.coalesce(F.col(text), F.lit(""))))


def lexical_scorer(rows: DataFrame) -> DataFrame:
    """``score``: the share of the question's content words that the text has.

    Rows that have the text's words as ``said``, as by ``text.said``, need no text.
    """
    share = words.grounding_in(F.col("question"), F.col("said")) if "said" in rows.columns else words.grounding(F.col("question"), F.col("text"))
    return rows.withColumn("score", F.round(share, 6))


def batched_scorer(factory: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = BATCH) -> Scorer:
    """A scorer from a model of (question, text) pairs, called with ``batch`` pairs at a time."""

    def score(rows: DataFrame) -> DataFrame:
        ship(rows.sparkSession)

        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = factory()
            for q, t in batches:
                pairs = list(zip(q.fillna(""), t.fillna("")))
                got = [s for k in range(0, len(pairs), batch) for s in model(pairs[k : k + batch])]
                yield pd.Series(got, dtype="float64")

        return rows.withColumn("score", F.pandas_udf(run, "double", functionType=F.PandasUDFType.SCALAR_ITER)("question", "text"))

    return score


def nearest_chunks(questions: DataFrame, chunks: DataFrame, k: int, factory: Callable = hashed_encoder, texts: bool = True) -> DataFrame:
    """(qid, question, id, rank, ...): the k chunks nearest to each question, exactly.

    ``questions`` (qid, question, ...), ``chunks`` (id, text, ...). Ties go to the lower key. Without
    ``texts`` of the chunks only their ids are returned, and no text is written down.
    """
    # Keys are hashes of ids, since vectors meet by number.
    keyed = chunks.withColumn("vec_id", F.xxhash64("id"))
    if texts:
        return nearest_rows(questions, cut_lineage(keyed), k, factory)
    return _nearest(questions, cut_lineage(keyed.select("id", "vec_id").distinct()), vectors.packed(keyed, "vec_id", "text", model=factory), k, factory)


def nearest_rows(questions: DataFrame, rows: DataFrame, k: int, factory: Callable = hashed_encoder) -> DataFrame:
    """As ``nearest_chunks``, of ``rows`` (vec_id, text, ...) that have their key, and are the same whenever they are read."""
    return _nearest(questions, rows, vectors.packed(rows, "vec_id", "text", model=factory), k, factory)


def build_index(spark: SparkSession, chunks: DataFrame, path: str, factory: Callable = hashed_encoder) -> DataFrame:
    """The index of ``chunks`` (id, text, ...) at ``path``, encoded and written there unless it is finished already."""
    return build_once(spark, path, lambda: encode(chunks, "text", factory=factory).withColumn("vec_id", F.xxhash64("id")))


def search(questions: DataFrame, index: DataFrame, k: int, factory: Callable = hashed_encoder) -> DataFrame:
    """(qid, question, id, rank, ...): the k entries of an index nearest to each question."""
    return _nearest(questions, index.drop("embedding"), vectors.packed(index, "vec_id", "embedding"), k, factory)


def _nearest(questions: DataFrame, rows: DataFrame, blocks: DataFrame, k: int, factory: Callable) -> DataFrame:
    """As ``search``, of the index's ``rows`` and its vectors' ``blocks``."""
    q = cut_lineage(questions.withColumn("vec_id", F.xxhash64("qid")))
    hits = vectors.meet(vectors.packed(q, "vec_id", "question", model=factory), blocks, k).withColumnsRenamed({"qid": "_q", "id": "_c"})
    return hits.join(q.withColumnRenamed("vec_id", "_q"), "_q").join(rows.withColumnRenamed("vec_id", "_c"), "_c").drop("_q", "_c", "score")


def generate(prompts: DataFrame, prompt: str, factory: Callable[[], Callable[[list[str]], list[str]]], out: str = "answer", batch: int = BATCH) -> DataFrame:
    """``prompts`` with the model's reply to each, ``batch`` at a time; a null prompt gets none."""
    ship(prompts.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for s in batches:
            asked = [k for k, t in enumerate(s) if t is not None]
            replies: list[str | None] = [None] * len(s)
            for at in range(0, len(asked), batch):
                for k, r in zip(asked[at : at + batch], model([s.iloc[k] for k in asked[at : at + batch]])):
                    replies[k] = r
            yield pd.Series(replies, dtype=object)

    return prompts.withColumn(out, F.pandas_udf(run, "string", functionType=F.PandasUDFType.SCALAR_ITER)(prompt))


def json_object(reply: Column) -> Column:
    """The outermost JSON object of a model's reply, fences and talk around it cut off; else null."""
    plain = F.regexp_replace(F.trim(reply), r"```(?:json)?", "")
    got = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    return F.when(got != "", got)


def json_array(reply: Column) -> Column:
    """The outermost JSON array of a model's reply; null if there is none."""
    got = F.regexp_extract(F.regexp_replace(F.trim(reply), r"```(?:json)?", ""), r"(?s)(\[.*\])", 1)
    return F.when(got != "", got)


#: What stands before an answer that follows thoughts without a closing tag. Fixed values.
ANSWER_MARKS = ("final answer:", "answer:", "response:")


def without_thoughts(reply: Column, marks: tuple[str, ...] = ANSWER_MARKS) -> Column:
    """What follows the last closing tag of thoughts; else what follows a mark, if that is a third of the reply or more."""
    tagged = F.trim(F.substring_index(reply, "</think>", -1))
    out = F.trim(reply)
    for m in reversed(marks):
        rest = F.trim(F.regexp_extract(reply, r"(?is)^.*\b" + re.escape(m) + r"(.*)$", 1))
        out = F.when(F.length(rest) * 3 >= F.length(reply), F.when(rest != "", rest).otherwise(out)).otherwise(out)
    return F.when(F.contains(reply, F.lit("</think>")), tagged).otherwise(out)


def verdicts(replies: DataFrame, reply: str, schema: str) -> DataFrame:
    """``replies`` with ``verdict`` parsed by ``schema``; ``failed`` where there is no such object.

    Failed rows have a null verdict, so that null-skipping means leave them out.
    """
    v = F.from_json(json_object(F.col(reply)), schema, {"mode": "PERMISSIVE"})
    some = F.exists(F.map_values(F.from_json(json_object(F.col(reply)), "map<string,string>")), lambda x: x.isNotNull())
    return replies.withColumn("verdict", F.when(some, v)).withColumn("failed", F.col("verdict").isNull())


def quoted_verbatim(quote: Column, source: Column, least: int = 20, most: int = 180) -> Column:
    """Whether a quotation of more than ``least`` characters stands in ``source``, blanks and case aside."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    q = norm(quote)
    return F.coalesce((F.length(q) > least) & F.contains(norm(source), F.substring(q, 1, most)), F.lit(False))


def null_generator(prompt: Column) -> Column:
    """The generator of runs without a model: an empty answer for every prompt."""
    return F.when(prompt.isNotNull() | prompt.isNull(), F.lit(""))
