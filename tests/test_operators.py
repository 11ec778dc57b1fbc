"""Cases that the tables don't reach: ties, thresholds, ordered search, packing."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexloom import runtime
from codexloom.operators import extract, graph, metrics, models, retrieval, seeding, temporal, text, vectors
from codexloom.plans import answers

EDGE = "src string, dst string, edge_key string, edge_type string, seq long"


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, t, t, i) for i, (a, b, t) in enumerate(rows)], EDGE)


# ------------------------------------------------------------- as-of fold
@pytest.mark.parametrize(
    "current, new, want",
    [("x" * 900, "", True), ("x" * 900, "short", True), ("x" * 900, "y" * 400, False), ("x" * 900, "y" * 399, True), ("", "short", False), ("x" * 2000, "y" * 799, True), ("x" * 2000, "y" * 800, False), ("x" * 2000, "by deleting " + "y" * 900, True), ("x" * 500, "by deleting " + "y" * 900, False)],
)
def test_surgical(spark, current, new, want):
    df = spark.createDataFrame([(current, new)], "c string, n string")
    assert df.select(temporal.surgical(F.col("c"), F.col("n"))).first()[0] is want


D1, D2 = dt.date(2020, 1, 1), dt.date(2020, 1, 2)
LONG, TEXT400 = "b" * 2000, "n" * 400


@pytest.mark.parametrize(
    "base, ops, want, status",
    [
        ("old", [], "old", "original"),
        ("old", [(D1, 1, "restate", "A", TEXT400)], TEXT400 + "\n[as amended by A (effective 2020-01-01)]", "amended"),
        (LONG, [(D1, 1, "restate", "A", "by replacing x")], LONG + "\n[proviso/restate per A (effective 2020-01-01): by replacing x]", "amended"),
        (LONG, [(D1, 1, "restate", "A", "")], LONG + "\n[proviso/restate per A (effective 2020-01-01): ]", "amended"),
        ("old", [(D2, 2, "insert", "B", "more"), (D1, 1, "insert", "A", "first")], "old\nfirst\nmore\n[as amended by A (effective 2020-01-01)]", "amended"),
        ("", [(D1, 1, "insert", "A", "new")], "new\n[as amended by A (effective 2020-01-01)]", "added"),
        (None, [(D1, 2, "insert", "B", "two"), (D1, 1, "insert", "A", "one")], "one\ntwo\n[as amended by A (effective 2020-01-01)]", "added"),
        ("old", [(D1, 1, "replace", "A", "x for y"), (D2, 2, "restate", "B", TEXT400)], TEXT400 + "\n[replace per A (effective 2020-01-01): x for y]", "amended"),
        ("old", [(D1, 1, "replace", "A", None)], "old\n[replace per A (effective 2020-01-01): ]", "amended"),
    ],
)
def test_fold(spark, base, ops, want, status):
    n = spark.createDataFrame([("n", "L", base, "as originally executed")], "node_id string, label string, base_text string, origin string")
    o = spark.createDataFrame([("n", *x) for x in ops], "node_id string, eff date, seq long, kind string, instrument string, new_text string")
    got = temporal.fold(n, o, n.select("node_id", F.lit(None).cast("date").alias("as_of"))).first()
    assert (got.text, got.status) == (want, status)


def test_as_of_is_inclusive(spark):
    o = spark.createDataFrame([("a", dt.date(2020, 5, 1), 1, "insert", "I", "x")], "node_id string, eff date, seq long, kind string, instrument string, new_text string")
    asked = spark.createDataFrame([("a", dt.date(2020, 4, 30)), ("a", dt.date(2020, 5, 1)), ("a", None)], "node_id string, as_of date")
    assert {r.as_of: r.n_ops for r in temporal.status_on(o, asked).collect()} == {dt.date(2020, 4, 30): 0, dt.date(2020, 5, 1): 1, None: 1}


# ------------------------------------------------------------- graph
def test_dfs_stops_where_the_ball_goes_on(spark):
    e = edges(spark, ("a", "b", "REFERENCES"), ("a", "c", "REFERENCES"), ("b", "c", "REFERENCES"), ("c", "d", "REFERENCES"))
    keep = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    got = graph.ordered_dfs(spark.createDataFrame([("q", "a", 0)], "qid string, node string, pos int"), e, keep, max_depth=2)
    assert [r.node for r in got.orderBy("pos").collect()] == ["a", "b", "c"]
    ball = graph.closure(e, spark.createDataFrame([("a",)], "root string"), 2)
    assert {r.node for r in ball.collect()} == {"b", "c", "d"}


def test_dfs_takes_inbound_exceptions_first(spark):
    e = edges(spark, ("a", "b", "REFERENCES"), ("x", "a", "EXCEPTION_TO"))
    keep = spark.createDataFrame([(x,) for x in "abx"], "id string")
    got = graph.ordered_dfs(spark.createDataFrame([("q", "a", 0)], "qid string, node string, pos int"), e, keep, 3, 2)
    assert [r.node for r in got.orderBy("pos").collect()] == ["a", "x"]


def test_closure_ends_on_cycles_and_upsert_keeps_the_last(spark):
    e = edges(spark, ("a", "b", "T"), ("b", "a", "T"), ("a", "b", "T"))
    assert [(r.node, r.depth) for r in graph.closure(e, spark.createDataFrame([("a",)], "root string"), 9).collect()] == [("b", 1)]
    assert {(r.src, r.seq) for r in graph.upsert(e).collect()} == {("a", 2), ("b", 1)}


def test_siblings_of_a_large_parent(spark):
    v = spark.createDataFrame([(f"s{i:03}", "Section") for i in range(50)] + [("p", "Document")], "id string, node_type string")
    e = edges(spark, *[("p", f"s{i:03}", "CONTAINS") for i in range(50)])
    got = graph.sibling_neighbors(v, e, 6)
    assert [r.neighbor for r in got.where("node = 's002'").orderBy("rank").collect()] == ["s000", "s001", "s003", "s004", "s005", "s006"]
    assert got.count() == 300


def test_longer_terms_mask_shorter_ones(spark):
    t = spark.createDataFrame([("k", "s", "The Base Rate Loan and the Base Rate; a Loan. Rates"), ("n", "s", None), ("o", "other", "Base Rate")], "key string, scope string, text string")
    terms = spark.createDataFrame([("s", "Base Rate"), ("s", "Base Rate Loan"), ("s", "Loan")], "scope string, term string")
    assert {(r.key, r.term) for r in extract.term_mentions(t, terms).collect()} == {("k", "Base Rate Loan"), ("k", "Base Rate"), ("k", "Loan")}


# ------------------------------------------------------------- packing
def block(n, reserved=False, ids=("a",), cit="c"):
    return {"citation": cit, "text": "x" * n, "node_ids": list(ids), "reserved": reserved}


def test_pack(spark):
    def run(lengths, most):
        df = spark.createDataFrame([([("c", "x" * n) for n in lengths],)], "b array<struct<citation:string,text:string>>")
        return [len(b.text) for b in df.select(retrieval.pack(F.col("b"), most)).first()[0]]

    assert run([400] * 5, 100_000) == [400] * 5
    assert run([10_000], 2000)[0] <= 2000 and len(run([1500] * 3, 2000)) == 2 - (2000 - 1535 - 35 < 180)
    assert run([], 2000) == [] and run([400], 0) == [400]
    assert run([300, 900, 50, 700], 1500) == [300, 900, 50] and run([1500] * 3, 2000) == [1500, 423]


def packed(spark, rows, most):
    df = spark.createDataFrame([("q", rows)], "qid string, blocks array<struct<citation:string,text:string,node_ids:array<string>,reserved:boolean>>")
    return df.select(retrieval.pack_reserved(F.col("blocks"), most)).first()[0]


def test_reserved_blocks_all_stay(spark):
    rows = [block(1500, True, [f"n{i}"]) for i in range(5)] + [block(300, True, ("a", "b"))] + [block(900)]
    got = packed(spark, rows, 1200)
    assert len(got) == 6 and got[0].node_ids == ["a", "b"] and all(b.reserved for b in got)
    # 865 are left for five, and a share is never under 160: 125 for the body, its cut mark included.
    assert [len(b.text) for b in got][:1] == [300] and {len(b.text) for b in got[1:]} == {173 - 35 - 20 + len(retrieval.CUT)}
    assert [(len(b.text), b.reserved) for b in packed(spark, [block(100, True), block(50)], 5000)] == [(100, True), (50, False)]
    assert [len(b.text) for b in packed(spark, [block(100, True), block(50)], 0)] == [100]
    assert packed(spark, None, 500) == [] and packed(spark, [], 500) == []
    assert [b.reserved for b in packed(spark, [block(700, True), block(900), block(10)], 1200)] == [True, False]
    assert retrieval.char_budget() == 35_328


def test_split_budget_shares(spark):
    s = spark.createDataFrame([("q", f"s{i}", i, 1.0) for i in range(9)], "qid string, node string, pos int, score double")
    r = spark.createDataFrame([("q", f"r{i}", i, 1.0) for i in range(9)] + [("z", "r0", 0, 1.0)], "qid string, node string, pos int, score double")
    got = retrieval.split_budget(s, r, 5)
    assert [x.node for x in got.where("qid = 'q'").orderBy("pos").collect()] == ["s0", "s1", "s2", "r0", "r1"]


# ------------------------------------------------------------- vectors, words, measures
def test_top_k_equals_brute_force(spark):
    m = np.random.default_rng(1).normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    got = vectors.top_k(df.where("vec_id % 50 = 0"), df, 5, block=64)
    s = m.astype(float) @ m.astype(float).T
    assert {(r.qid, r.rank): r.id for r in got.collect()} == {(q, k + 1): i for q in range(0, 300, 50) for k, i in enumerate(np.argsort(-s[q], kind="stable")[:5])}


def test_top_k_of_tied_scores_in_small_blocks(spark):
    m = np.random.default_rng(3).integers(-1, 2, size=(200, 3)).astype(float)
    df = spark.createDataFrame([(i * 7 % 200, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>").repartition(5)
    rows = {i * 7 % 200: v for i, v in enumerate(m)}
    for k in (3, 500):
        got = vectors.top_k(df.where("vec_id % 3 = 0"), df, k, block=7)
        want = {(q, r + 1): i for q in range(0, 200, 3) for r, i in enumerate(sorted(rows, key=lambda i: (-rows[q] @ rows[i], i))[:k])}
        assert {(r.qid, r["rank"]): r.id for r in got.collect()} == want


def test_top_k_sends_no_vectors_to_the_driver(spark, tmp_path):
    spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "v"))
    df = spark.read.parquet(str(tmp_path / "v"))  # files tell their size, so that a small side may be broadcast
    plan = vectors.top_k(df, df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_top_k_of_scores_that_single_precision_cannot_tell_apart(spark):
    n = 150
    m = np.array([[1.0, 1e-8 * (i * 37 % n), 0.0] for i in range(n)] + [[1e20, 0.0, 0.0], [float("nan"), 0.0, 0.0], [0.0, 0.0, 0.0]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(0, [0.0, 1.0, 0.0]), (1, [0.5, 0.5, 7.0]), (2, [-1.0, 0.0, 0.0]), (3, [1e-30, 1.0, 0.0])], "vec_id long, embedding array<double>")
    for block in (16, 1024):
        got = {(r.qid, r["rank"]): r.id for r in vectors.top_k(asked, df.where(f"vec_id != {n + 1}"), 4, block=block).collect()}
        v = {q.vec_id: np.round(m @ np.array(q.embedding), 10) for q in asked.collect()}
        want = {(q, k + 1): i for q, s in v.items() for k, i in enumerate(sorted((i for i in range(len(m)) if i != n + 1), key=lambda i: (-s[i], i))[:4])}
        assert got == want
        assert {r.qid for r in vectors.top_k(asked, df, 4, block=block).collect()} == {0, 1, 2, 3}


def test_blocks_of_vectors_are_small_and_few_tasks_share_them(spark):
    df = spark.range(2000).select(F.col("id").alias("vec_id"), F.concat_ws(" ", F.lit("the loan of"), "id", F.lit("bears interest")).alias("text")).coalesce(2)
    blocks = vectors.packed(df, "vec_id", "text", 100, models.hashed_encoder)
    bytes_, vecs = blocks.selectExpr("sum(length(v))", "sum(length(i)) / 8").first()
    assert vecs == 2000 and bytes_ < 2000 * models.DIM * 8 / 3
    # Each task adds k rows for each of its queries to what is shuffled.
    plan = vectors.meet(blocks, blocks, 3)._jdf.queryExecution().optimizedPlan().toString()
    lanes, groups = (int(re.search(rf"Repartition (\d+), {x}", plan)[1]) for x in ("false", "true"))
    assert groups > 1 and lanes * groups < 2 * 4 * spark.sparkContext.defaultParallelism


def test_banded_pairs_and_greedy_pass(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 32))
    m = np.concatenate([base, base + 0.15 * rng.normal(size=base.shape)])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    s = m @ m.T
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if s[i, j] >= 0.92}
    pairs = vectors.similar_pairs(df, 0.92)
    got = {(r.a, r.b) for r in pairs.collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
    kept = []
    for i in range(120):
        if not any((k, i) in got for k in kept):
            kept.append(i)
    assert [r.id for r in vectors.greedy_keep(df.select(F.col("vec_id").alias("id")), pairs).where("kept").orderBy("id").collect()] == kept


def test_chunks_of_short_and_empty_sections(spark):
    s = spark.createDataFrame([("a", "d", 0, "one two three four five"), ("b", "d", 1, None), ("c", "d", 2, "six  seven")], "id string, document_id string, pos int, text string")
    assert [(r.id, r.text) for r in text.chunk_sections(s, 2).orderBy("id").collect()] == [("a::p0", "one two"), ("a::p1", "three four"), ("a::p2", "five"), ("c", "six seven")]
    got = text.chunk_fixed(s, 4, 2).orderBy("id").collect()
    assert [(r.section_id, r.text) for r in got] == [("a", "one two three four"), ("a", "three four five six"), ("a", "five six seven")]


def test_measures(spark):
    df = spark.createDataFrame([("x", True, True), ("x", False, False), ("x", True, False), ("y", True, True)], "g string, a boolean, b boolean")
    got = {r.g: (r.n, r.kappa) for r in metrics.kappa(df, "a", "b", ["g"]).collect()}
    assert got == {"x": (3, 0.4), "y": (1, None)}
    p = spark.createDataFrame([("g", float(i)) for i in range(1, 21)], "g string, v double")
    assert tuple(metrics.percentiles(p, "v", ["g"]).first()) == ("g", 20, 11.0, 20.0)
    r = spark.createDataFrame([(["7.05(a)", "9"], ["7.05", "8"])], "g array<string>, c array<string>").select(*metrics.hierarchical(F.col("g"), F.col("c")))
    assert tuple(r.first()) == (0.5, 0.5)


def test_terms_of_many_words_are_found_and_mask_shorter_ones(spark):
    long = "Fixed Charge Coverage Ratio Testing Period Start Date"
    terms = spark.createDataFrame([("d", long), ("d", "Coverage Ratio"), ("e", "Loan")], "scope string, term string")
    t = spark.createDataFrame([("k", "d", f"From the {long} on each Loan."), ("m", "d", "a Coverage Ratio"), ("n", "e", "any Loan")], "key string, scope string, text string")
    assert {(r.key, r.term) for r in extract.term_mentions(t, terms).collect()} == {("k", long), ("m", "Coverage Ratio"), ("n", "Loan")}


def test_similar_pairs_are_all_pairs_whatever_the_blocks(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 32))
    m = np.concatenate([base + 0.27 * rng.normal(size=base.shape) for _ in range(12)])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(0, m[0].tolist()), (999, None)], "vec_id long, embedding array<double>")
    s = m @ m.T
    want = {(i, j) for i in range(len(m)) for j in range(i + 1, len(m)) if s[i, j] >= 0.92}
    assert len(want) > 1000
    for block in (64, 2048):
        got = [(r.a, r.b) for r in vectors.similar_pairs(df, 0.92, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert vectors.similar_pairs(df.where("false"), 0.92).count() == 0


def test_running_state_over_ranges_of_places(spark):
    rng = random.Random(6)
    rows, want, art, sec = [], [], None, None
    for p in range(9000):
        level = rng.choice(["subsection"] * 30 + ["section"] * 3 + ["article"] if p > 40 else ["subsection", "section"])
        rows.append((f"s{p:05}", "d", level, p))
        if level == "article":
            want.append("d")
            art = sec = f"s{p:05}"
        elif level == "section":
            want.append(art or "d")
            sec = f"s{p:05}"
        else:
            want.append(sec or art or "d")
    df = spark.createDataFrame(rows + [("z", "e", "subsection", None)], "id string, document_id string, level string, pos int")
    got = {r.dst: r.src for r in extract.containment(df).collect()}
    assert [got[r[0]] for r in rows] == want and got["z"] == "e"
    v = df.withColumn("n", F.length("id").cast("long"))
    sums = runtime.running_sum(v, "document_id", "pos", ["pos", "id"], "n", "first", width=100)
    assert {r.id: r["first"] for r in sums.where("document_id = 'd'").collect()} == {r[0]: 6 * k for k, r in enumerate(rows)}


def test_plans_of_the_flagship_stay_small(spark, sf, monkeypatch):
    """The driver holds every plan; each is cut before it is read several times."""
    sizes, cut = [], runtime.cut_lineage

    def seen(df):
        sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        return cut(df)

    for m in (answers, graph, models, seeding, vectors):
        if hasattr(m, "cut_lineage"):
            monkeypatch.setattr(m, "cut_lineage", seen)
    last = answers.answer_context(spark, sf)
    assert max(*sizes, len(last._jdf.queryExecution().optimizedPlan().toString().splitlines())) < 400


def test_the_flat_path_ranks_without_texts(spark, sf):
    lines = answers.baseline_context(spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = [y for x, y in zip(lines, lines[1:]) if "WindowGroupLimit" in x and "pos#" in x]
    assert len(below) == 1 and "question#" in below[0] and " text#" not in below[0]


def test_the_flat_path_takes_one_row_of_equal_ids(spark, tmp_path):
    q = [("q1", "which loans bear interest", None), ("q2", None, None)]
    spark.createDataFrame(q, "id string, question string, as_of date").write.parquet(str(tmp_path / "holdout_hard_set.parquet"))
    rows = [("c1", "loans bear interest", "d", "2.01"), ("c1", "fees", "d", None), ("c2", None, "d", None), ("c3", "which loans", "e", None)]
    spark.createDataFrame(rows, "id string, text string, document_name string, section_hint string").repartition(4).write.parquet(str(tmp_path / "chunks.parquet"))
    got = {r.qid: r for r in answers.baseline_context(spark, str(tmp_path)).collect()}
    assert got["q1"].context_ids == ["c3", "c1"] and "[d]\nfees" in got["q1"].context and "bear" not in got["q1"].context
    assert set(got["q2"].context_ids) == {"c1", "c3"}


def test_nearest_chunks_without_texts_are_the_same(spark):
    q = spark.createDataFrame([("a", "interest on loans"), ("b", None), ("c", "a term")], "qid string, question string")
    chunks = spark.createDataFrame([(f"c{k}", f"loans and term {k} of interest {k % 3}") for k in range(20)], "id string, text string")
    got = [{(r.qid, r.id, r["rank"]) for r in models.nearest_chunks(q, chunks, 4, texts=t).select("qid", "id", "rank").collect()} for t in (True, False)]
    assert got[0] == got[1] and len(got[0]) == 12


def test_ordered_walks_of_many_questions(spark):
    e = spark.createDataFrame([("r", f"n{k}", "CONTAINS", k) for k in range(9)] * 2, "src string, dst string, edge_type string, seq int")
    keep = spark.createDataFrame([(f"n{k}",) for k in range(9)], "id string")
    starts = spark.createDataFrame([(f"q{k}", "r", 0) for k in range(50)] + [("q7", "n8", -1)], "qid string, node string, pos int")
    got = graph.ordered_dfs(starts, e, keep, 2, 3).collect()
    assert {(r.qid, r.pos): r.node for r in got} == {(f"q{k}", i): n for k in range(50) for i, n in enumerate(["n8", "n0", "n1"] if k == 7 else ["n0", "n1", "n2"])}
