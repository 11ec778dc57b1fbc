import random

import pytest

from codexloom.llm import mixing, packing, tokens


@pytest.mark.parametrize("capacity, shard", [(100, 1_000_000), (64, 50), (7, 10), (1, 1000)])
def test_packing_keeps_every_document_whole(spark, capacity, shard):
    rng = random.Random(capacity)
    sizes = [(i, rng.choice([0, 1, 3, rng.randrange(1, 40), rng.randrange(1, 120), 350])) for i in range(400)] + [(None, 5), (401, None)]
    got = packing.pack(spark.createDataFrame(sizes + sizes[:20], "doc_id long, n_tokens int"), capacity, shard=shard).collect()
    bins, docs = {}, {}
    for r in got:
        bins.setdefault(r.bin, []).append(r)
        docs.setdefault(r.doc_id, []).append(r)
    assert all(sum(r.n_tokens for r in b) <= capacity for b in bins.values())
    assert set(docs) == {i for i, _ in sizes}
    for i, n in sizes:
        parts = sorted(docs[i], key=lambda r: r.start)
        assert sum(r.n_tokens for r in parts) == (n or 0)
        assert len(parts) == max(1, -(-(n or 0) // capacity))
        assert [r.start for r in parts] == [k * capacity for k in range(len(parts))]


def test_packing_leaves_little_room_at_scale(spark):
    rng = random.Random(3)
    sizes = spark.createDataFrame([(i, int(rng.lognormvariate(5, 1)) + 1) for i in range(20_000)], "doc_id long, n_tokens int")
    packed = packing.pack(sizes, 8192, fill=50)
    r, plain = packing.report(packed, 8192).first(), packing.report(packing.pack(sizes, 8192, extend=False), 8192).first()
    assert r.unused_share < 0.02 < plain.unused_share and r.fullest <= 8192
    # Shards of about fifty containers, each packed on its own.
    assert packed.selectExpr("split(bin, '-')[0] AS s").distinct().count() > 5


def test_packing_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, n_tokens int")
    assert packing.pack(none, 10).count() == 0
    assert packing.report(packing.pack(none, 10), 10).first().containers == 0


def test_truncated_poisson_has_the_mean():
    for cap in (1, 2, 5):
        for mean in (0.05, 0.5, 0.9 * cap):
            cdf = mixing.truncated_cdf(mean, cap)
            assert abs(sum(1 - p for p in cdf) - mean) < 1e-6 and cdf == sorted(cdf)
    assert mixing.truncated_cdf(3, 3) == [0.0] * 3 and mixing.truncated_cdf(0, 2) == [1.0, 1.0]


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(1)
    docs = [(i, s, rng.randrange(50, 150)) for s, n, o in (("Big Source", 6000, 0), ("small-one", 700, 10_000), ("other", 500, 20_000), (None, 50, 30_000)) for i in range(o, o + n)]
    sizes = spark.createDataFrame(docs, "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("big_source", 0.5, 1), ("small_one", 0.3, 4), ("absent", 0.2, 3)], "source string, target_share double, max_repeats int")
    rates = mixing.solve(sizes, targets)
    got = {r.source: r for r in mixing.shares(sizes, targets, rates).collect()}
    assert abs(got["big_source"].reached_share - 0.625) < 0.02 and abs(got["small_one"].reached_share - 0.375) < 0.02
    assert got["big_source"].most_copies <= 1 and got["small_one"].most_copies <= 4
    assert got["absent"].tokens_used == 0 and got["other"].tokens_used == 0 and got[None].documents == 50
    mix = mixing.mixture(sizes, rates, columns=("n_tokens",))
    again = mixing.mixture(sizes.repartition(7), rates, columns=("n_tokens",))
    assert sorted(map(tuple, mix.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    assert mix.groupBy("source").sum("n_tokens").count() == 2


def test_repeated_deliveries_are_mixed_once(spark):
    docs = [(i, "a", f"t{i}") for i in range(200)]
    df = spark.createDataFrame(docs + docs[:90] + [(3, "a", None)], "doc_id long, source string, text string")
    once = mixing.mixture(spark.createDataFrame(docs, df.schema), {"a": (1.7, 3)}).collect()
    got = mixing.mixture(df, {"a": (1.7, 3)}).collect()
    assert sorted((r.doc_id, r.copy_no) for r in got) == sorted((r.doc_id, r.copy_no) for r in once)
    assert len({(r.doc_id, r.copy_no) for r in got}) == len(got)


def test_mixing_nothing(spark):
    sizes = spark.createDataFrame([], "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    rates = mixing.solve(sizes, targets)
    assert rates == {} and [r.reached_share for r in mixing.shares(sizes, targets, {"a": (0.0, 2)}).collect()] == [0.0]


def test_tokens_of_odd_texts():
    f = tokens.DEFAULT_FILE
    assert tokens.count_tokens(None, f) == 0 and tokens.count_tokens("", f) == 0
    assert tokens.count_tokens("The Borrower shall pay.", f) == len(tokens.encoding(f).encode_ordinary("The Borrower shall pay."))
    assert tokens.count_tokens("<|endoftext|>", f) > 1 and tokens.count_tokens("x" * 200_000, f) > 1000
