"""Token counts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Setting of the session for the vocabulary file; every executor must see the path.
SETTING, DEFAULT_FILE = "spark.codexloom.tokenizer", "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The byte-level BPE's public splitting pattern. Fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer stretches without a space are encoded part by part, since BPE over one
#: stretch takes time that grows faster than its length.
STRETCH = 4096


def vocabulary_file(spark: SparkSession) -> str:
    return spark.conf.get(SETTING, None) or os.environ.get("CODEXLOOM_TOKENIZER") or DEFAULT_FILE


@lru_cache(maxsize=4)
def encoding(path: str):  # noqa: ANN201
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str) -> int:
    """Tokens of the whole ``text``; 0 for null."""
    if not text:
        return 0
    text = text.encode("utf-8", "replace").decode("utf-8")
    enc = encoding(path)
    if len(text) <= STRETCH or max(map(len, text.split(" "))) <= STRETCH:
        return len(enc.encode_ordinary(text))
    total, piece = 0, []
    for w in text.split(" "):
        if len(w) > STRETCH:
            total += len(enc.encode_ordinary(" ".join(piece))) + sum(len(enc.encode_ordinary(w[i : i + STRETCH])) for i in range(0, len(w), STRETCH))
            piece = []
        else:
            piece.append(w)
    return total + len(enc.encode_ordinary(" ".join(piece)))


def n_tokens(text: Column, path: str) -> Column:
    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([count_tokens(t, path) for t in s], dtype="int64")

    return counted(text)
