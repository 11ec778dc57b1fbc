"""Amending clauses and parties, on texts of the forms that the tables don't hold."""

import pytest
from pyspark.sql import functions as F

from codexloom.operators import amendments, blocks, seeding

S = "id string, number string, level string, document_id string, pos int, text string"


def ops(spark, *texts, number="1.1", level="section"):
    df = spark.createDataFrame([(f"d.amendment_1::{k}", number, level, "d.amendment_1", k, t) for k, t in enumerate(texts)], S)
    return {(r.target_kind, r.target): (r.op, r.new_text, r.source_sec_id) for r in amendments.amend_ops(df).collect()}


def test_families(spark):
    got = ops(
        spark,
        "Section 7.05(a)(ii) of the Credit Agreement is hereby amended and restated to read as follows: New covenant.",
        "The definition of “Base Rate,” in Section 1.01 is hereby amended by deleting the words “x” thereof: gone.",
        "Clause (b) of the definition of “Loan” in Section 1.01 of the Credit Agreement is hereby amended by inserting the following: more.",
        "Article X of the Credit Agreement is hereby amended by inserting the following new Section 10.23 in its order: Text of it.",
        "Exhibit C to the Credit Agreement is hereby amended and restated as follows: form.",
    )
    assert got[("section", "7.05(a)(ii)")] == ("restate", "New covenant.", "d.amendment_1::0")
    assert got[("definition", "Base Rate")][:2] == ("replace", "gone.")
    assert got[("definition", "Loan")][:2] == ("insert", "more.")
    # The section that holds an amended definition is not itself amended by that clause.
    assert ("section", "1.01") not in got
    assert got[("section", "10.23")] == ("insert", "Text of it.", "d.amendment_1::3")
    assert got[("exhibit", "C")][:2] == ("restate", "form.")


def test_batches_first_wins_and_what_is_read(spark):
    batch = "Section 1.01 of the Credit Agreement is hereby amended by inserting the following definitions in order: “A Term” means x. “B Term” means y."
    got = ops(spark, batch, "Section 2.01 of the Credit Agreement is hereby amended: first.", "Section 2.01 of the Credit Agreement is hereby deleted: second.", None)
    assert {k for k, v in got.items() if v[0] == "insert"} == {("definition", "A Term"), ("definition", "B Term"), ("section", "1.01")}
    assert got[("section", "1.01")][1] == batch and got[("section", "2.01")][2] == "d.amendment_1::1"
    text = "Section 2.01 of the Credit Agreement is hereby amended: x."
    assert ops(spark, text, number="3.4") == {} and ops(spark, text, level="article") == {}
    assert list(ops(spark, "3.4 Amendment to Section 2.01. " + text, number="3.4")) == [("section", "2.01")]


def test_targets_that_the_base_lacks_are_made(spark):
    df = spark.createDataFrame([("d.amendment_1", "section", "2.01"), ("d.amendment_1", "definition", "X"), ("d.amendment_1", "exhibit", "C")], "document_id string, target_kind string, target string")
    got = {r.node_id: r.made for r in amendments.resolve_targets(df, spark.createDataFrame([("d.base::2.01",), ("d.base::2.01",)], "id string")).collect()}
    assert got == {"d.base::2.01": False, "d.base::def::X": True, "d.base::exhibit::C": True}


COVER = "CREDIT AGREEMENT\nACME, INC., as Borrower,\nALPHA BANK and BETA BANK, as Administrative Agents and Swing Line Lenders\nsome text, as lower case\nThe Other Lenders Party Hereto\nACME, INC. (“Acme’s” or the “Borrower” or the “Lender”)"


def test_parties_roster_and_edges(spark):
    df = spark.createDataFrame([("base", COVER), ("none", None), ("blank", "")], "document_id string, text string")
    found = amendments.parties(df)
    got = {r.name: (r.roles, r.aliases) for r in found.collect()}
    assert {n: r for n, (r, _) in got.items()} == {"ACME, INC.": ["Borrower"], "ALPHA BANK": ["Administrative Agent", "Swing Line Lender"], "BETA BANK": ["Administrative Agent", "Swing Line Lender"], "The Other Lenders Party Hereto": ["Lender"]}
    assert got["ACME, INC."][1] == ["ACME", "Acmes", "Acme’s", "Borrower"]
    rows = amendments.roster_rows(amendments.party_edges(found))
    r = blocks.roster(rows).first()
    assert r.parties == 4 and r.text.split("\n")[1] == "- ALPHA BANK — Administrative Agent, Swing Line Lender" and r.node_ids[0] == "party::ACME, INC."


# ------------------------------------------------------------- seeds and blocks
@pytest.mark.parametrize("question, want", [("What is §7.10, Sec. 2.1(a)(iv) and Sections 3.04?", ["7.10", "2.1(a)(iv)", "3.04"]), ("Nothing cited in 7.10", [])])
def test_cited_sections(spark, question, want):
    assert spark.createDataFrame([(question,)], "q string").select(F.regexp_extract_all("q", F.lit(seeding.CITED_SECTION), F.lit(1))).first()[0] == want


def test_named_terms(spark):
    d = spark.createDataFrame([("b::def::" + t, "b", t) for t in ("Consolidated Leverage Ratio", "Code", "Agreement", "Term Loan", "Cap", "Permitted Net Loan")], "id string, document_id string, term string")
    q = spark.createDataFrame([("1", "What is the leverage ratio under the agreement?", "b"), ("2", "Does “Code” bind a term loan's code?", "b"), ("3", "the net loan, a Cap and the term loans", "b"), ("4", None, "b"), ("5", "Term Loan", None)], "qid string, question string, document_id string")
    got = {(r.qid, r.node[8:]) for r in seeding.named_terms(q, d).collect()}
    assert got == {("1", "Consolidated Leverage Ratio"), ("2", "Code")}


def test_agreements_and_gates(spark):
    p = spark.createDataFrame([("a1", "Acme Foods"), ("a2", "Acme"), ("a3", "Twin"), ("a4", "twin")], "agreement_id string, company string")
    q = spark.createDataFrame([("1", "Did ACME Foods pay Acme?"), ("2", "Twin pays"), ("3", None)], "qid string, question string")
    assert [tuple(r) for r in seeding.agreements(q, p).collect()] == [("1", "a1")]
    g = spark.createDataFrame([("Which provisions rely on it, and how did amendments affect them?",), (None,)], "q string")
    got = [r.asDict() for r in g.select(*[c.alias(k) for k, c in seeding.gates(F.col("q")).items()]).collect()]
    assert got[0] == {"dependents": True, "parties": False, "amendments": True, "history": True, "conflict": False, "components": True} and not any(got[1].values())


def test_seeds_in_amendments_lead_to_what_they_amend(spark):
    first = spark.createDataFrame([("q", "d.amendment_1::1.1", 0), ("q", "b", 1)], "qid string, node string, pos int")
    am = spark.createDataFrame([("d.amendment_1::1.1", "d.base::2.01"), ("other", "x")], "source_sec_id string, target string")
    assert [r.node for r in seeding.seeds([first], am).orderBy("pos").collect()] == ["d.amendment_1::1.1", "b", "d.base::2.01"]


def test_inserted_text_stands_apart(spark):
    n = spark.createDataFrame([("q", "n", None, "C", "body\nadded\nend")], "qid string, node string, as_of date, citation string, text string")
    o = spark.createDataFrame([("n", "2020-01-01", 1, "insert", "First Amendment", "added")], "node_id string, eff string, seq long, kind string, instrument string, new_text string").withColumn("eff", F.to_date("eff"))
    got = [(r.citation, r.text) for r in blocks.bodies(n, o, split=True).orderBy("part").collect()]
    assert got == [("C — PROVISO added by First Amendment (effective 2020-01-01)", "added"), ("C", "body\nend")]
    assert blocks.bodies(n, o).first().text == "body\nadded\nend"
