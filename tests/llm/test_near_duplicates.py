import random
import re

import pandas as pd
import pytest

from codexloom.llm import near_duplicates as nd

R = "id string, text string"


def brute(rows, t=0.8):
    sets = [(i, frozenset(re.findall("[a-z0-9]+", x.lower()))) for i, x in rows if i is not None and x]
    out = set()
    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if i != j and a and b and 10 * len(a & b) >= 10 * t * len(a | b):
                out.add((min(i, j), max(i, j)))
    return out


def made(n, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rng.shuffle(words)
        else:
            words = rng.sample(vocab, rng.randrange(1, 16))
        rows.append((f"r{i}", " ".join(words)))
    return rows


@pytest.mark.parametrize("frequent", [1, 5, 1000])
def test_bands_and_sketches_lose_no_pair(spark, monkeypatch, frequent):
    monkeypatch.setattr(nd, "bands", lambda s, t, f=frequent, b=nd.bands: b(s, t, f))
    rows = made(250)
    got = {tuple(r) for r in nd.similar_pairs(spark.createDataFrame(rows, R)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("ranked, most, deepest", [(1, 4000, 6), (1 << 16, 5, 6), (1 << 16, 4000, 1)])
def test_no_bound_on_keys_loses_a_pair(spark, monkeypatch, ranked, most, deepest):
    monkeypatch.setattr(nd, "RANKED_WORDS", ranked)
    monkeypatch.setattr(nd, "MOST_KEYS", most)
    monkeypatch.setattr(nd, "bands", lambda s, t, b=nd.bands: b(s, t, 4, deepest))
    rows = made(200, seed=7)
    got = {tuple(r) for r in nd.similar_pairs(spark.createDataFrame(rows, R)).collect()}
    assert got == brute(rows)


def test_sketches_decide_far_from_the_threshold():
    rng = random.Random(4)
    sets = {i: rng.sample(range(10**9), 400) for i in range(3)}
    sets |= {10 + i: sets[i][:396] + rng.sample(range(10**9), 4) for i in range(3)} | {20 + i: sets[i][:250] + rng.sample(range(10**9), 150) for i in range(3)}
    rows = pd.DataFrame({"class_id": list(sets), "words": [[hash(("w", x)) for x in w] for w in sets.values()]})
    got = next(nd.odd_sketches(iter([rows]))).set_index("class_id")
    xor = lambda a, b: sum(bin((int(x) ^ int(y)) & (2**64 - 1)).count("1") for x, y in zip(got.loc[a], got.loc[b]))
    for i in range(3):
        assert xor(i, 10 + i) < nd.min_xor() < nd.max_xor() < xor(i, 20 + i)


def test_nulls_empties_repeats_and_no_rows(spark):
    rows = [("a", "Same words here"), ("a", "Same words here"), ("b", "here SAME words"), ("c", None), (None, "same words here"), ("d", ""), ("e", "!!!"), ("f", "x " * 50_000 + "unique")]
    got = {tuple(r) for r in nd.similar_pairs(spark.createDataFrame(rows, R)).collect()}
    assert got == {("a", "b")}
    assert nd.similar_pairs(spark.createDataFrame([], R)).count() == 0


def test_groups_reach_along_chains(spark):
    base = [f"t{i}" for i in range(20)]
    rows = [(str(k), " ".join(base[: 20 - k] + [f"u{j}" for j in range(k)])) for k in range(6)] + [("z", "alone in here"), ("0b", " ".join(reversed(base)))]
    got = {r.rec_id: r for r in nd.groups(spark.createDataFrame(rows, R)).collect()}
    assert len({got[str(k)].group_id for k in range(6)} | {got["0b"].group_id}) == 1
    assert got["z"].links == 0 and got["z"].group_id != got["0"].group_id
    assert got["0"].copies == 2 and len(got) == 8


def test_sketch_bound_is_looser_than_the_threshold():
    assert nd.max_xor(0.8) < nd.max_xor(0.6) < nd.BITS / 2 + nd.BITS / 8
