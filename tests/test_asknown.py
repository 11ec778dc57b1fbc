import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from codexloom import runtime
from codexloom.operators.asknown import as_known, join_as_known

V = "version_id long, node_id string, text string, status string, effective_date date, recorded_at timestamp_ntz"
E = "qid string, node_id string, as_of date"
D0 = dt.date(2020, 1, 1)


def brute(events, versions):
    out = set()
    for q, n, d in events:
        ok = [v for v in versions if v[1] == n and n is not None and v[4] is not None and (d is None or (v[5] is not None and v[4] <= d and v[5].date() <= d))]
        if ok:
            best = max(ok, key=lambda v: (v[4], v[5] or dt.datetime.min, v[0]))
            out.add((q, n, d, best[0]))
    return out


@pytest.mark.parametrize("days", [1, 7, 90])
def test_against_brute_force(spark, days):
    rng = random.Random(days)
    versions, events = [], []
    for i in range(150):
        day = D0 + dt.timedelta(rng.randrange(400))
        rec = None if rng.random() < 0.05 else dt.datetime(2020, 1, 1, 12) + dt.timedelta(rng.randrange(500))
        versions.append((i, rng.choice(["a", "b", "c", None]), f"t{i}", "s", None if rng.random() < 0.05 else day, rec))
    versions += versions[:20]
    for i in range(200):
        events.append((f"q{i}", rng.choice(["a", "b", "c", "zz", None]), None if rng.random() < 0.1 else D0 + dt.timedelta(rng.randrange(-20, 600))))
    got = join_as_known(spark.createDataFrame(events, E), spark.createDataFrame(versions, V), [], days=days).where("version_id is not null")
    assert {tuple(r) for r in got.collect()} == brute(events, versions)
    assert got.count() == len(brute(events, versions))


def test_ties_take_the_highest_version(spark):
    at = dt.datetime(2020, 2, 1)
    vs = [(1, "a", "x", "s", D0, at), (2, "a", "y", "s", D0, at)]
    got = join_as_known(spark.createDataFrame([("q", "a", dt.date(2020, 2, 1))], E), spark.createDataFrame(vs, V), ["text"])
    assert [(r.version_id, r.text) for r in got.collect()] == [(2, "y")]


def test_empty_tables_and_clashing_names(spark):
    none_v, none_e = spark.createDataFrame([], V), spark.createDataFrame([], E)
    assert as_known(none_e, none_v).count() == 0
    ev = spark.createDataFrame([("q", "a", D0, "mine", "keep")], E + ", text string, _salt string")
    got = join_as_known(ev, none_v, ["text", "status"]).collect()
    assert [(r.text, r._salt, r.version_text, r.status) for r in got] == [("mine", "keep", None, None)]


def test_hot_key_is_split_and_whole(spark):
    big = spark.range(1000).select("id", F.when(F.col("id") < 700, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    look = big.select("k").distinct().withColumn("x", F.length("k"))
    got = runtime.skew_join(big, look, ["k"], hot_rows=100)
    assert got.count() == 1000
    assert got.where("x != length(k)").count() == 0


def test_a_later_record_never_leaks_back(spark):
    vs = [(1, "a", "old", "original", D0, dt.datetime(2020, 1, 2)), (2, "a", "new", "amended", dt.date(2020, 1, 5), dt.datetime(2020, 6, 1))]
    ev = [("q1", "a", dt.date(2020, 5, 31)), ("q2", "a", dt.date(2020, 6, 1)), ("q3", "a", dt.date(2020, 1, 1)), ("q4", "a", None)]
    got = join_as_known(spark.createDataFrame(ev, E), spark.createDataFrame(vs, V), ["status"])
    assert {r.qid: r.status for r in got.collect()} == {"q1": "original", "q2": "amended", "q3": None, "q4": "amended"}
