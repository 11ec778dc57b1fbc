"""Near-duplicate records: banded candidates verified by odd sketches.

A record is the set of its words, the distinct runs of a-z and 0-9 after lower-casing,
held as 64-bit hashes. Records with the same words form one class, and all work is on
classes. Two classes are similar when their common words number at least ``threshold``
of the words that occur in either (Jaccard).

Candidates. Bands are keyed by the least words of a class under one fixed min-wise
order, rarest word first (ties by hash). Two similar classes of n and m words have at
least ``o = t / (1 + t) (n + m)`` words in common, so the first ``n - o + k`` words of the
one and the first ``m - o + k`` of the other hold k common words: keys of k words lose no
pair. The smaller class of a pair emits the fewer keys (it is the indexed side), the
larger one probes. A key of one word is used where the word is rare; classes whose key is
shared by many emit keys of more words, until keys are rare. Nothing is capped.

Each key carries the odd sketch of its class's words, 64 parity bits. Every word that only
one class has flips one bit, so a pair whose sketches differ in more bits than the
threshold leaves words is no pair; that is certain, and such pairs leave no row.

Verification. K MinHash samples of a class are folded into an n-bit parity bitmap, its
odd sketch: each sample flips one bit. The bits of two sketches differ in about
``n/2 (1 - exp(-4 K (1 - J) / n))`` places, so their XOR population count tells high
similarities precisely. A count that a pair at the threshold stays over with SIGMAS
standard deviations decides for the pair, one that it stays under decides against it. Only
pairs between the two bounds are checked on their words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexloom.runtime import cut_lineage, shipped, skew_join

THRESHOLD = 0.8
SAMPLES, BITS, SIGMAS = 256, 512, 5.0
#: Classes that may share a band key before the key counts as frequent. Comparing a pair by
#: its parity bits is cheaper than the keys that would keep it from being compared.
FREQUENT = 256
#: Words in a band key at most.
DEEPEST = 3
#: Keys of one class and size bucket at most, which limits the words in a key.
MOST_KEYS = 4000
#: Words whose number of classes is known when keys are made: so many of the commonest.
#: All others count as rare, which any fixed order allows.
RANKED_WORDS = 1 << 16
_LANES = BITS // 64


def words(text: Column) -> Column:
    """Distinct runs of a-z and 0-9; empty for null."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def classes(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rec_id, class_id, words) once for each distinct id and word set, words as hashes.

    Repeated deliveries collapse. Records without any word belong to no class, since
    nothing can be said of their similarity, and are left out.
    """
    w = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("rec_id"), F.array_sort(F.transform(words(F.col(text_col)), lambda x: F.xxhash64(x))).alias("words"))
    return w.where(F.size("words") > 0).withColumn("class_id", F.xxhash64("words")).select("rec_id", "class_id", "words").dropDuplicates(["rec_id", "class_id"])


def _bounds(threshold: float, samples: int, bits: int, sigmas: float) -> tuple[int, int]:
    def expected(differing: float) -> float:
        return bits / 2 * (1 - (1 - 2 / bits) ** (2 * differing))

    mean, spread = samples * (1 - threshold), sigmas * math.sqrt(samples * threshold * (1 - threshold))
    near, far = expected(max(0.0, mean - spread)), expected(min(mean + spread, samples))
    noise = lambda z: sigmas * math.sqrt(max(1.0, z * (1 - z / bits))) / 2
    return math.floor(near - noise(near)), math.ceil(far + noise(far))


def min_xor(threshold: float = THRESHOLD, samples: int = SAMPLES, bits: int = BITS, sigmas: float = SIGMAS) -> int:
    """The XOR population count that a pair at the threshold stays under only beyond ``sigmas``."""
    return _bounds(threshold, samples, bits, sigmas)[0]


def max_xor(threshold: float = THRESHOLD, samples: int = SAMPLES, bits: int = BITS, sigmas: float = SIGMAS) -> int:
    """The XOR population count that a pair at the threshold exceeds only beyond ``sigmas``."""
    return _bounds(threshold, samples, bits, sigmas)[1]


def _flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a batch in one array, and where each list starts."""
    lens = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in lists]) if len(lists) else np.zeros(0, dtype=np.int64)
    return flat.view(np.uint64), np.cumsum(lens) - lens


def odd_sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(class_id, s0, s1, ...): BITS parity bits of each class's MinHash samples, as 64-bit lanes."""
    rng = np.random.default_rng(20240607)
    mult, turn, place = (rng.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(3))
    lane_of = np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for pdf in batches:
        flat, starts = _flat(pdf["words"])
        bit = np.empty((SAMPLES, len(starts)), dtype=np.int64)
        for k in range(SAMPLES if len(starts) else 0):
            x = (flat ^ turn[k]) * mult[k]
            x ^= x >> np.uint64(32)
            least = np.minimum.reduceat(x * place[k], starts)
            bit[k] = ((least * place[k] + lane_of[k]) >> np.uint64(64 - int(math.log2(BITS)))).astype(np.int64)
        cell = bit + np.arange(len(starts)) * BITS
        parity = (np.bincount(cell.ravel(), minlength=len(starts) * BITS) & 1).astype(np.uint8).reshape(len(starts), BITS)
        lanes = np.packbits(parity, axis=1).view(">u8").astype(np.uint64).view(np.int64)
        yield pd.DataFrame({"class_id": pdf["class_id"].to_numpy(), **{f"s{i}": lanes[:, i] for i in range(_LANES)}})


def _bucket(n: int, threshold: float) -> int:
    return int(math.floor(math.log(n) / -math.log(threshold) + 1e-9)) if threshold < 1 else n


def _least_of(bucket: int, threshold: float) -> int:
    """The smallest size of a bucket."""
    return math.ceil(threshold**-bucket - 1e-9) if threshold < 1 else bucket


def _common(n: int, m: int, threshold: float) -> int:
    """The words that similar classes of n and m words have in common at least."""
    return math.ceil(threshold / (1 + threshold) * (n + m) - 1e-9)


def _level_cap(bucket: int, threshold: float, deepest: int) -> int:
    """Words in a key at most, for every pair whose smaller class is of this size bucket."""
    low, high = _least_of(bucket, threshold), math.ceil(_least_of(bucket + 1, threshold) / threshold)
    slack, cap = high - _common(high, math.ceil(threshold * high - 1e-9), threshold), 1
    # No key may have more words than the smallest pair has in common.
    while cap < min(deepest, _common(low, low, threshold)) and math.comb(slack + cap + 1, cap + 1) <= MOST_KEYS:
        cap += 1
    return cap


def _sides(n: int, threshold: float) -> Iterator[tuple[int, bool, int]]:
    """(bucket of the smaller class, whether this one probes, least words in common)."""
    own = _bucket(n, threshold)
    yield own, False, _common(n, n, threshold)
    smallest = math.ceil(threshold * n - 1e-9)
    for b in (own - 1, own):
        if b >= 0 and _least_of(b + 1, threshold) > smallest:
            yield b, True, _common(n, max(smallest, _least_of(b, threshold)), threshold)


def _keys(batches: Iterator[pd.DataFrame], threshold: float, level: int, deepest: int, known: tuple[np.ndarray, np.ndarray], frequent: int) -> Iterator[pd.DataFrame]:
    """Band keys of ``level`` words from each class's rarest-first words.

    At level 1 the words' own counts tell which keys are crowded: those are not made, and
    the class comes out once, marked as ``open``, for the next level.
    """
    hashes, counts = known
    caps: dict[int, int] = {}
    for pdf in batches:
        flat, starts = _flat(pdf["words"])
        at = np.searchsorted(hashes, flat) if len(hashes) else np.zeros(len(flat), dtype=np.int64)
        at = np.minimum(at, max(0, len(hashes) - 1))
        df = np.where(hashes[at] == flat, counts[at], 0) if len(hashes) else np.zeros(len(flat), dtype=np.int64)
        parity = np.uint64(1) << (flat & np.uint64(63))
        sig = np.bitwise_xor.reduceat(parity, starts).view(np.int64) if len(starts) else []
        rows: list[tuple] = []
        for k, (cid, start) in enumerate(zip(pdf["class_id"], starts)):
            end = starts[k + 1] if k + 1 < len(starts) else len(flat)
            n = int(end - start)
            order = np.lexsort((flat[start:end], df[start:end]))
            w, c = flat[start:end][order].view(np.int64).tolist(), df[start:end][order]
            for bucket, probes, least in _sides(n, threshold):
                cap = caps.setdefault(bucket, _level_cap(bucket, threshold, deepest))
                if level > cap:
                    continue
                head, last = w[: n - least + level], level == cap
                if level == 1 and not last:
                    rows += [(cid, n, sig[k], hash((1, bucket, x)), probes, True, False) for x, m in zip(head, c) if m <= frequent]
                    if c[len(head) - 1] > frequent:
                        rows.append((cid, n, sig[k], 0, probes, True, True))
                    continue
                rows += [(cid, n, sig[k], hash((level, bucket, *x)), probes, last, False) for x in combinations(sorted(head), level)]
        cols = ["class_id", "n", "sig", "band", "probes", "last", "open"]
        yield pd.DataFrame(rows, columns=cols).astype({"class_id": "int64", "n": "int32", "sig": "int64", "band": "int64", "probes": "bool", "last": "bool", "open": "bool"})


_KEYS = "class_id long, n int, sig long, band long, probes boolean, last boolean, open boolean"


def bands(sets: DataFrame, threshold: float = THRESHOLD, frequent: int = FREQUENT, deepest: int = DEEPEST) -> DataFrame:
    """(class_id, n, sig, band, probes) from ``sets`` (class_id, words): keys that lose no similar pair.

    Level k emits keys of k words. A key shared by more than ``frequent`` classes is
    dropped at level k only because every class that has it emits level k + 1 too. The
    deepest level of a size bucket keeps all its keys; it is lower for long records,
    of which a class would else emit more than MOST_KEYS keys.
    """
    df = sets.select(F.explode("words").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > frequent)
    top = df.orderBy(F.desc("df"), "h").limit(RANKED_WORDS).toPandas()
    h = top["h"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(h)
    known = (h[order], top["df"].to_numpy(dtype=np.int64)[order])
    todo, parts = sets, []
    for level in range(1, deepest + 1):
        keys = cut_lineage(todo.transform(shipped).mapInPandas(lambda it, lv=level: _keys(it, threshold, lv, deepest, known, frequent), _KEYS))
        made = keys.where("NOT open").drop("open")
        if level == 1:
            parts.append(made)
            deeper = keys.where("open").select("class_id")
        else:
            crowded = cut_lineage(made.where("NOT last").groupBy("band").agg(F.countDistinct("class_id").alias("c")).where(F.col("c") > frequent).select("band"))
            if level == deepest or crowded.isEmpty():
                parts.append(made)
                break
            parts.append(made.join(crowded, "band", "left_anti"))
            deeper = made.join(crowded, "band", "left_semi").select("class_id")
        todo = sets.join(deeper.distinct(), "class_id", "left_semi")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("class_id", "n", "sig", "band", "probes")


def similar_classes(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(class_a, class_b) with class_a < class_b for all similar pairs of ``sets``."""
    sets = cut_lineage(sets.select("class_id", "words").dropDuplicates(["class_id"]))
    keyed = bands(sets, threshold)
    small = keyed.where("NOT probes").select("band", F.col("class_id").alias("c_s"), F.col("n").alias("n_s"), F.col("sig").alias("g_s"))
    large = keyed.where("probes").select("band", F.col("class_id").alias("c_l"), F.col("n").alias("n_l"), F.col("sig").alias("g_l"))
    # What the threshold leaves of words that only one of the two has.
    left_over = F.col("n_s") + F.col("n_l") - 2 * F.ceil(threshold / (1 + threshold) * (F.col("n_s") + F.col("n_l")) - 1e-9)
    pairs = (
        skew_join(large, small, ["band"])
        .where((F.struct("n_s", "c_s") < F.struct("n_l", "c_l")) & (F.col("n_s") >= F.col("n_l") * threshold - 1e-9))
        .where(F.bit_count(F.col("g_s").bitwiseXOR(F.col("g_l"))) <= left_over)
        .select(F.least("c_s", "c_l").alias("class_a"), F.greatest("c_s", "c_l").alias("class_b")).distinct()
    )
    lanes = [f"s{i}" for i in range(_LANES)]
    sketch = cut_lineage(sets.transform(shipped).mapInPandas(odd_sketches, "class_id long, " + ", ".join(f"{x} long" for x in lanes)))
    side = lambda x: sketch.select(F.col("class_id").alias(f"class_{x}"), *[F.col(c).alias(f"{x}{c}") for c in lanes])
    xor = sum((F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in lanes), F.lit(0))
    judged = cut_lineage(pairs.join(side("a"), "class_a").join(side("b"), "class_b").select("class_a", "class_b", xor.alias("x")).where(F.col("x") <= max_xor(threshold)))
    sure = judged.where(F.col("x") < min_xor(threshold)).select("class_a", "class_b")
    border = judged.where(F.col("x") >= min_xor(threshold)).join(sets.toDF("class_a", "w_a"), "class_a").join(sets.toDF("class_b", "w_b"), "class_b")
    common = F.size(F.array_intersect("w_a", "w_b"))
    checked = border.where(common >= threshold * (F.size("w_a") + F.size("w_b") - common) - 1e-9).select("class_a", "class_b")
    return sure.unionByName(checked)


def similar_pairs(records: DataFrame, id_col: str = "id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_a, id_b), id_a < id_b, once for every two ids with similar texts.

    Ids whose words are equal pair up too. Null ids and texts without a word give no
    pair; an id delivered with several texts pairs by any of them.
    """
    rec = cut_lineage(classes(records, id_col, text_col))
    member = rec.select("rec_id", "class_id")
    near = similar_classes(rec, threshold)
    same = rec.select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b")).distinct()
    a, b = member.toDF("m_a", "class_a"), member.toDF("m_b", "class_b")
    pairs = near.unionByName(same).join(a, "class_a").join(b, "class_b").where("m_a != m_b AND (class_a != class_b OR m_a < m_b)")
    return pairs.select(F.least("m_a", "m_b").alias("id_a"), F.greatest("m_a", "m_b").alias("id_b")).distinct()


def groups(records: DataFrame, id_col: str = "id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(rec_id, class_id, copies, links, group_id): one row for each record.

    ``copies`` counts the records with the same words, ``links`` the other classes
    similar to its class, ``group_id`` is the least class id of its connected group.
    """
    rec = cut_lineage(classes(records, id_col, text_col))
    near = cut_lineage(similar_classes(rec, threshold))
    both = near.select("class_a", "class_b").unionByName(near.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")))
    links = both.groupBy("class_a").agg(F.count(F.lit(1)).alias("links")).withColumnRenamed("class_a", "class_id")
    label = connected(both)
    counts = rec.groupBy("class_id").agg(F.count(F.lit(1)).alias("copies"))
    per = counts.join(links, "class_id", "left").join(label, "class_id", "left")
    per = per.select("class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group_id", "class_id").alias("group_id"))
    return rec.select("rec_id", "class_id").join(per, "class_id").select("rec_id", "class_id", "copies", "links", "group_id")


def connected(both: DataFrame) -> DataFrame:
    """(class_id, group_id): least label of each component of the symmetric links.

    Each round takes the least label of the neighbours and then the label of that
    label, which halves long paths; it ends when a round changes nothing.
    """
    label = cut_lineage(both.groupBy("class_a").agg(F.least(F.col("class_a"), F.min("class_b")).alias("group_id")).withColumnRenamed("class_a", "class_id"))
    while True:
        nb = both.join(label, both["class_b"] == label["class_id"]).groupBy("class_a").agg(F.min("group_id").alias("g"))
        step = label.join(nb, label["class_id"] == nb["class_a"]).select("class_id", F.col("group_id").alias("old"), F.least("group_id", "g").alias("group_id"))
        up = label.select(F.col("class_id").alias("group_id"), F.col("group_id").alias("up"))
        step = cut_lineage(step.join(up, "group_id", "left").select("class_id", "old", F.least("group_id", F.coalesce("up", "group_id")).alias("group_id")))
        label = step.select("class_id", "group_id")
        if step.where("old != group_id").isEmpty():
            return label
