"""Citations, cross-references, question sets, model interfaces and reports on small cases."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexloom import reports
from codexloom.__main__ import main
from codexloom.operators import audit, citations, evalset, extract, graph, metrics, models, vectors


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column).first()[0]


# ------------------------------------------------------------- citations
@pytest.mark.parametrize(
    "text, shaped",
    [("Credit Agreement §7.05(a), as amended", True), ("definition of “Loan” (§1.01)", True), ("Exhibit C", True), ("Party roster (all PARTY_TO edges)", True), ("Amendment catalog (all AMENDS edges)", True), ("Output Generation", False), ("§X.XX", False), ("§IV", True), ("§12", True)],
)
def test_shaped(spark, text, shaped):
    assert one(spark, citations.is_shaped(F.col("c")), c=text) is shaped


def test_brackets_documents_and_claims(spark):
    answer = "It is so [Credit Agreement §7.05]. But not [§7.05]; see [Credit Agreement §7.05] and [x]."
    assert one(spark, citations.bracketed(F.col("a")), a=answer) == ["Credit Agreement §7.05", "§7.05"]
    assert [one(spark, citations.document_of(F.col("c")), c=c) for c in ("Third Amendment to it §1.2", "Credit Agreement §1.2, as amended by First Amendment", "Tenth Amendment")] == ["amendment_3", "base", "amendment_10"]
    got = one(spark, citations.claims(F.col("a"), F.col("c")), a="One rule. Two rules [§7.05]. Three.", c="§7.05")
    assert got == ["Two rules  ."]
    assert one(spark, citations.claims(F.col("a"), F.col("c")), a="No mark.", c="§9.9") == ["No mark."]
    assert one(spark, citations.claims(F.col("a"), F.col("c"), whole=False), a="No mark.", c="§9.9") == []


def test_resolution_by_priority(spark):
    nodes = spark.createDataFrame(
        [("a.base::7.05", "Section", "a.base", "7.05", None), ("a.amendment_1::1.2", "Section", "a.amendment_1", "1.2", None), ("a.amendment_1::preamble", "Section", "a.amendment_1", "0", None), ("a.base::def::Lender’s Rate", "Definition", "a.base", None, "Lender’s Rate"), ("a.base::exhibit::C", "Exhibit", "a.base", None, None)],
        "id string, node_type string, document_id string, number string, term string",
    )
    cases = {"Credit Agreement §7.05": "a.base::7.05", "First Amendment §7.05": "a.base::7.05", "First Amendment §1.2": "a.amendment_1::1.2", "First Amendment §0": "a.amendment_1::preamble", "definition of “lender’s RATE” (§1.01)": "a.base::def::Lender’s Rate", "Exhibit C": "a.base::exhibit::C", "Exhibit D": None, "§9.99": None, "nothing": None}
    df = spark.createDataFrame([("a", c) for c in cases] + [(None, "Credit Agreement §7.05")], "agreement_id string, citation string")
    got = {(r.agreement_id, r.citation): r.node_id for r in citations.resolve(df, nodes.unionByName(nodes)).collect()}
    assert {c: got["a", c] for c in cases} == cases and got[None, "Credit Agreement §7.05"] is None


def test_rates_leave_made_blocks_out(spark):
    rows = [("p", "Amendment catalog", None, None, None, False, None), ("p", "§1", "n", "added", "amended", False, 0.5), ("p", "§2", "n", "original", "amended", True, 0.1), ("p", "§3", None, None, "amended", False, None), ("q", "Change history", None, None, None, False, None)]
    got = {r.path: r for r in citations.rates(spark.createDataFrame(rows, "path string, citation string, node_id string, status string, claimed string, late boolean, grounding double"), ["path"]).collect()}
    p = got["p"]
    assert (p.citations, p.real, p.unresolvable, p.resolvable_rate, p.versioned_rate, p.version_ok_rate, p.verified_rate, p.late, p.grounding, p.weak) == (4, 3, 1, 0.667, 0.667, 0.5, 0.333, 1, 0.3, 1)
    assert (got["q"].real, got["q"].resolvable_rate, got["q"].version_ok_rate) == (0, 0.0, None)


# ------------------------------------------------------------- audit
S = "id string, number string, document_id string, text string"


def secs(spark, *rows):
    return spark.createDataFrame([(f"d::{n}", n, "d", t) for n, t in rows], S)


def test_mentions_dangling_and_provisos(spark):
    s = secs(
        spark,
        ("1.02", "See Regulation Section 9.01 and Section 1.1471 of the code. Sections 2.03(a) and Section 2.09 apply. Section 3.01 of the Guarantee."),
        ("2.03", "The second proviso to Section 4.01 controls, and the proviso in Section 2.03 too."), ("2.03(a)", None), ("4.01", "Paid,"), ("4.01(a)", "PROVIDED that it is."), ("5.01", ""),
    )
    got = [(r.id, r.number) for r in audit.mentions(s).orderBy("id", "k").collect()]
    assert got == [("d::1.02", "2.03(a)"), ("d::1.02", "2.09"), ("d::2.03", "4.01"), ("d::2.03", "2.03")]
    assert [(r.number, r.mentions) for r in audit.dangling(s).collect()] == [("2.09", 1)]
    assert {(r.number, r.verified) for r in audit.proviso_claims(s).collect()} == {("4.01", True), ("2.03", False)}
    fam = {r.family: r.text for r in audit.families(s).collect()}
    assert fam["4.01"] == "Paid,\nPROVIDED that it is." and fam["2.03"].endswith("too.\n")


def test_clauses_sentences_and_weakest_references(spark):
    s = secs(spark, ("1.01", "First part. Notwithstanding anything in Section 2.01 or Section 3.01, this one\nshall govern all. Last."), ("2.01", "Rules of margin apply to Section 3.01 loans"), ("3.01", "Nothing alike here"))
    got = audit.precedence(s).first()
    assert got.clause == "Notwithstanding anything in Section 2.01 or Section 3.01, this one shall govern all." and got.overrides == ["2.01", "3.01"]
    weak = audit.mismatches(s, models.lexical_scorer, 2).collect()
    assert len(weak) == 2 and weak[0].score <= weak[1].score and {w.dst for w in weak} <= {"d::2.01", "d::3.01"}
    counts = spark.createDataFrame([("d", 3, 0)], "agreement_id string, mentions long, dangling long")
    block = audit.conflict_block(audit.precedence(s), s, counts).first()
    assert "(overridden §2.01 provides: “Rules of margin" in block.text and block.node_ids == ["d::1.01"]


def test_exceptions_need_the_word_and_the_colon(spark):
    s = spark.createDataFrame(
        [("d::7.05", "7.05", "d", "section", "No sale, except: "), ("d::7.05(a)", "7.05(a)", "d", "subsection", "first"), ("d::7.06", "7.06", "d", "section", "No sale, except cash"), ("d::7.06(a)", "7.06(a)", "d", "subsection", "x"), ("d::7.07", "7.07", "d", "section", "Sales:"), ("d::7.07(a)", "7.07(a)", "d", "subsection", "x"), ("e::7.05(a)", "7.05(a)", "e", "subsection", "other document")],
        "id string, number string, document_id string, level string, text string",
    )
    assert [tuple(r) for r in extract.exceptions(s).collect()] == [("d::7.05(a)", "d::7.05", "No sale, except:")]


# ------------------------------------------------------------- question sets
def test_allocation_adds_up():
    rng = random.Random(3)
    for _ in range(50):
        w = {str(k): rng.choice([0.0, 1.0, rng.random() * 9]) for k in range(8)}
        got = evalset.allocate(rng.randrange(90), w) if sum(w.values()) else {}
        assert all(v >= 0 for v in got.values())
    assert sum(evalset.allocate(88, {"a": 3, "b": 2, "c": 2.5}).values()) == 88 and evalset.allocate(0, {"a": 1}) == {"a": 0}
    assert evalset.allocate(1, {"a": 1, "b": 1, "c": 1}) == {"a": 1, "b": 0, "c": 0}


def test_quotas_gold_and_dependents(spark):
    c = spark.createDataFrame([("x", "p", f"{k:02}") for k in range(9)] + [("x", "q", "99"), ("y", "p", "50")], "archetype string, prefix string, id string")
    quotas = spark.createDataFrame([("x", 4), ("y", 0)], "archetype string, quota int")
    assert [r.id for r in evalset.pick(c, quotas).orderBy("id").collect()] == ["00", "01", "02", "99"]
    q = spark.createDataFrame([("1", "a", ["n", "gone"]), ("2", "false_premise", []), ("3", "a", None), ("4", "a", ["gone"])], "id string, category string, gold array<string>")
    got = {r.id: (r.gold, r.missing) for r in evalset.valid_gold(q, spark.createDataFrame([("n",)], "id string")).collect()}
    assert got == {"1": (["n"], 1), "2": ([], 0)}
    dep = spark.createDataFrame([("n", "z"), ("n", "b")], "node string, dependent string")
    assert {r.id: r.gold for r in evalset.with_dependents(q, dep, "a").collect()} == {"1": ["n", "b", "z"], "2": [], "3": None, "4": ["gone"]}
    assert one(spark, evalset.unknown_gold(F.col("g"), F.col("k")), g=["a", "b"], k=["b"]) == ["a"]
    assert evalset.overshoot(spark.range(50).withColumnRenamed("id", "seq"), 10).count() == 25
    grid = evalset.conditions(q, {"full": {"history": True}, "plain": {}})
    assert grid.count() == 8 and grid.where("condition = 'full' AND history").count() == 4


def test_mates_have_no_edge(spark):
    c = spark.createDataFrame([("c", n) for n in "abcdef"] + [("e", "a")], "cluster string, node string")
    e = spark.createDataFrame([("a", "b"), ("d", "a"), ("c", "c")], "src string, dst string")
    assert [(r.cluster, r.node) for r in evalset.edge_free(c, e).orderBy("cluster", "pos").collect()] == [("c", "a"), ("c", "c"), ("c", "e"), ("e", "a")]


def brute_linkage(m, k):
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    d = 1 - unit @ unit.T
    parts = [[i] for i in range(len(m))]
    while len(parts) > k:
        _, a, b = min((np.mean([[d[x, y] for y in q] for x in p]), i, j) for i, p in enumerate(parts) for j, q in enumerate(parts) if i < j)
        parts[a] += parts.pop(b)
    return {frozenset(p) for p in parts}


def test_average_linkage_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(30, 5))
    for k in (1, 3, 7, 30):
        got = evalset.average_linkage(m, k)
        assert {frozenset(np.nonzero(got == c)[0].tolist()) for c in set(got)} == brute_linkage(m, k)
    df = spark.createDataFrame([("g", i, v.tolist()) for i, v in enumerate(m)] + [("h", 99, [1.0] * 5), ("h", 100, None)], "label string, vec_id long, embedding array<double>")
    got = evalset.clusters(df, "label")
    assert got.where("label = 'g'").select("cluster").distinct().count() == 3 and got.where("label = 'h'").count() == 1


# ------------------------------------------------------------- model interfaces
def test_encoders_and_scorers_run_in_batches(spark):
    df = spark.createDataFrame([("q", "the margin of the loan", "margin"), ("q", None, None)], "id string, question string, text string")
    v = [np.array(r.embedding) for r in models.encode(df, "question").collect()]
    assert abs(np.linalg.norm(v[0]) - 1) < 1e-9 and np.linalg.norm(v[1]) == 0

    def factory():
        return lambda pairs: [float(len(t)) for _, t in pairs]

    assert [r.score for r in models.batched_scorer(factory, 1)(df).orderBy("score").collect()] == [0.0, 6.0]
    chunks = spark.createDataFrame([("a", "margin of a loan"), ("b", "zzz qqq"), ("c", "the margin of the loan")], "id string, text string")
    got = models.nearest_chunks(spark.createDataFrame([("1", "the margin of the loan")], "qid string, question string"), chunks, 2)
    assert [r.id for r in got.orderBy("rank").collect()] == ["c", "a"]


def test_index_generator_and_late_interaction(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "margin of a loan"), ("b", "zzz qqq")], "id string, text string")
    q = spark.createDataFrame([("1", "the margin of the loan"), ("2", None)], "qid string, question string")
    for _ in range(2):
        index = models.build_index(spark, chunks, str(tmp_path / "i"))
    assert models.search(q, index, 1).where("qid = '1'").first().id == "a"

    def factory():
        return lambda texts: [t.upper() for t in texts]

    assert [r.answer for r in models.generate(q, "question", factory).orderBy("qid").collect()] == ["THE MARGIN OF THE LOAN", None]
    v = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[0.5, 0.0], [0.2, 0.7]]), ([], [[1.0, 1.0]]), ([[1.0, 1.0]], [])], "q array<array<double>>, d array<array<double>>")
    assert [round(r[0], 6) for r in v.select(vectors.max_sim(F.col("q"), F.col("d"))).collect()] == [1.2, 0.0, 0.0]


def test_replies_are_taken_apart(spark):
    assert one(spark, models.json_object(F.col("r")), r='Sure:\n```json\n{"a": {"b": 1}}\n``` done') == '{"a": {"b": 1}}'
    assert one(spark, models.json_object(F.col("r")), r="no object") is None and one(spark, models.json_array(F.col("r")), r="x [1, [2]] y") == "[1, [2]]"
    assert one(spark, models.without_thoughts(F.col("r")), r="<think>a</think> b </think> It is so.") == "It is so."
    assert one(spark, models.without_thoughts(F.col("r")), r="hm. Final answer: the Agent may pay") == "the Agent may pay"
    assert one(spark, models.without_thoughts(F.col("r")), r="a long text of thoughts that goes on and on for quite a while and then. Answer: no") == "a long text of thoughts that goes on and on for quite a while and then. Answer: no"
    assert one(spark, models.null_generator(F.col("r")), r="x") == ""
    df = spark.createDataFrame([('{"ok": true, "score": 0.5}',), ("broken",), (None,), ("{not json}",)], "r string")
    got = models.verdicts(df, "r", "ok boolean, score double").collect()
    assert [g.failed for g in got] == [False, True, True, True] and got[0].verdict.score == 0.5
    assert one(spark, models.quoted_verbatim(F.col("q"), F.col("s")), q="Shall  pay each\nLender on demand", s="The Borrower shall pay each lender on demand.") is True
    assert one(spark, models.quoted_verbatim(F.col("q"), F.col("s")), q="shall pay", s="shall pay") is False


# ------------------------------------------------------------- measures, reports, command line
def test_arms_hits_and_costs(spark):
    v = spark.createDataFrame([("a", "1", 1.0), ("b", "1", 1.0), ("a", "2", 0.5), ("b", "2", 0.9), ("b", "3", 0.1)], "arm string, q string, value double").withColumn("field", F.lit("f"))
    r = metrics.compare_arms(v, "arm", ["q", "field"], ["field"]).first()
    assert (r.first, r.second, r.n, r.agreement, r.mean_apart, r.most_apart, r.within_tenth) == ("a", "b", 2, 0.5, 0.2, 0.4, 0.5)
    hit = lambda g, c, t: one(spark, metrics.baseline_hit(F.col("g"), F.col("c"), F.col("t")), g=g, c=c, t=t)
    assert hit("d::def::Loan", "near §1.01", "“loan” means") and not hit("d::def::Loan", "near §1.01", "a loan")
    assert hit("d::7.05(a)", "near §7.05", "") and not hit("d::7.05", "near §7.0", "") and not hit("d::7.05", None, None) and hit("d::exhibit::C", None, "see Exhibit C")
    w = spark.createDataFrame([(30_000,), (20_000,)], "words int")
    assert tuple(metrics.indexing_cost(w, 21.8, 1.006).first()) == (100.0, 21.8, 0.006092)


def test_reports_artifacts_and_provenance(spark, tmp_path):
    df = spark.createDataFrame([("b|c", 1.0, ["x"]), (None, None, None)], "name string, v double, xs array<string>")
    assert reports.markdown(df, "T") == "## T\n\n| name | v | xs |\n|---|---|---|\n| - | - | - |\n| b\\|c | 1.0000 | x |\n"
    assert "The first 1 rows." in reports.markdown(df, rows=1)
    made = []

    def make():
        made.append(1)
        return df

    path = str(tmp_path / "a")
    assert reports.build_once(spark, path, make).count() == 2 and reports.build_once(spark, path, make).count() == 2 and len(made) == 1
    rows = {r.setting: r.value for r in reports.provenance(spark, "t", dt.datetime(2020, 1, 1)).collect()}
    assert rows["spark.version"] == spark.version and "spark.sql.session.timeZone" in rows


def test_command_line(spark, sf, capsys):
    assert main(["list"]) == 0 and "graph_edges" in capsys.readouterr().out
    assert main(["run", "no_such", "--data", sf]) == 2
    assert main(["report", "metric_latency", "metric_percentiles", "--data", sf], spark) == 0
    out = capsys.readouterr().out
    assert "## metric_latency" in out and "| graph |" in out


def test_edges_of_legacy_graphs(spark):
    e = spark.createDataFrame([("a", "b", "AMENDS::2020", None), ("a", "c", "REFERENCES", "REFERENCES")], "src string, dst string, edge_key string, edge_type string")
    assert [r[0] for r in e.select(graph.edge_kind(F.col("edge_type"), F.col("edge_key"))).collect()] == ["AMENDS", "REFERENCES"]
