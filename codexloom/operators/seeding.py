"""Entry points of questions into the graph, from the words of the question alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexloom.operators import graph, retrieval, text
from codexloom.runtime import cut_lineage

#: A cited section, the number captured: the word, its short form or the sign. Fixed value;
#: the German and Spanish words are this project's own.
CITED_SECTION = r"(?:[Ss]ections?|[Ss]ec\.?|§{1,2}|Ziffer|[Cc]l[aá]usula)\s*(\d{1,2}\.\d{1,2}(?:\([a-z0-9]+\))*)"
#: A term in quotation marks. Fixed value.
QUOTED_TERM = r"[“\"]\s*([^”\"\n]{2,60}?)\s*[”\"]"
#: Terms that nearly every question uses. Fixed values.
GENERIC_TERMS = ("agreement", "borrower", "lender", "person", "agent", "parent", "subsidiary", "section", "date", "code", "board", "officer", "affiliate")
#: Words that carry no topic of their own. Fixed values.
WEAK_WORDS = (
    "consolidated", "permitted", "applicable", "total", "net", "gross", "other", "related", "loan", "credit", "first", "second", "third", "new", "adjusted",
    "aggregate", "eligible", "excluded", "specified", "required", "restricted",
)
WORD = r"[\p{L}\p{N}'’-]+"


def spoken(text_: Column) -> Column:
    """The words of a text in lower case, with single blanks between them."""
    return F.array_join(F.regexp_extract_all(F.lower(text_), F.lit(WORD), F.lit(0)), " ")


def topical_phrases(term: Column) -> Column:
    """Parts of two words or more of a term of three or more, with a word that has a topic."""
    return F.filter(text.subphrases(F.lower(term)), lambda p: F.exists(F.split(p, " "), lambda w: ~w.isin(*WEAK_WORDS)))


def phrase_hits(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(key, phrase, at): every phrase that stands in a text, word by word, and where first.

    ``texts`` (key, scope, text), ``phrases`` (scope, phrase), both in ``spoken`` form; without
    ``scope`` in ``phrases`` they hold for all texts. Runs of as many words as some phrase of the
    scope has are joined to the phrases.
    """
    by = ["scope"] if "scope" in phrases.columns else []
    named = phrases.where("phrase != ''").select(*by, "phrase", F.size(F.split("phrase", " ")).alias("n")).distinct()
    lengths = named.groupBy(*by).agg(F.collect_set("n").alias("lengths"))
    t = texts.where("text != ''").select("key", *by, F.split("text", " ").alias("w"))
    # Without a scope the lengths are one row, and no key would spread the texts.
    t = t.join(lengths, "scope") if by else t.crossJoin(F.broadcast(lengths))
    runs = t.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("w") - 1))).withColumn("n", F.explode("lengths")).where(F.col("i") + F.col("n") <= F.size("w"))
    runs = runs.select("key", *by, "i", F.array_join(F.slice("w", F.col("i") + 1, F.col("n")), " ").alias("phrase"))
    return runs.join(named.drop("n"), [*by, "phrase"]).groupBy("key", "phrase").agg(F.min("i").alias("at"))


def agreements(questions: DataFrame, parties: DataFrame) -> DataFrame:
    """(qid, agreement_id): the agreement whose borrower a question names first.

    ``questions`` (qid, question), ``parties`` (agreement_id, company). A company with
    several agreements names none of them; of two at one place the longer name counts.
    """
    own = parties.select(spoken(F.col("company")).alias("phrase"), "agreement_id").where("phrase != ''").groupBy("phrase").agg(F.min("agreement_id").alias("agreement_id"), F.count_distinct("agreement_id").alias("n")).where("n = 1")
    said = questions.select(F.col("qid").alias("key"), spoken(F.col("question")).alias("text"))
    hits = phrase_hits(said, own.select("phrase")).join(own, "phrase")
    first = hits.groupBy("key").agg(F.min(F.struct("at", (-F.length("phrase")).alias("n"), "agreement_id")).alias("m"))
    return first.select(F.col("key").alias("qid"), F.col("m.agreement_id").alias("agreement_id"))


def cited(questions: DataFrame, sections: DataFrame) -> DataFrame:
    """(qid, node, pos): the sections that a question cites, or their nearest ancestors.

    ``questions`` (qid, question, document_id) with the document that holds the sections,
    ``sections`` (id, number, document_id).
    """
    n = questions.select("qid", "document_id", F.posexplode(F.regexp_extract_all("question", F.lit(CITED_SECTION), F.lit(1))).alias("pos", "number"))
    keyed = n.select(F.struct("qid", "pos").alias("key"), F.concat("document_id", F.lit("::"), "number").alias("number"))
    return graph.section_seed(keyed, sections.select("id", F.concat("document_id", F.lit("::"), "number").alias("number"))).select("key.qid", "node", "key.pos")


def named_terms(questions: DataFrame, definitions: DataFrame) -> DataFrame:
    """(qid, node, pos): the defined terms that a question names, longer terms first.

    ``questions`` (qid, question, document_id), ``definitions`` (id, document_id, term). A
    term in quotation marks counts even where it is generic; others must have more than
    three characters, be no generic word, and stand in the question whole or by a
    topical part. The terms are those of the question's own document.
    """
    d = definitions.where(F.length("term") > 3).select(F.col("document_id").alias("scope"), "id", "term", spoken(F.col("term")).alias("whole"), F.transform(topical_phrases(F.col("term")), spoken).alias("parts"))
    d = d.select("scope", "id", "term", "whole", F.explode(F.array_union(F.array("whole"), "parts")).alias("phrase")).where(~F.lower("term").isin(*GENERIC_TERMS))
    said = questions.select(F.struct("qid", "document_id").alias("key"), F.col("document_id").alias("scope"), spoken(F.col("question")).alias("text"))
    plain = phrase_hits(said, d.select("scope", "phrase")).select("key.qid", F.col("key.document_id").alias("scope"), "phrase").join(d, ["scope", "phrase"]).select("qid", "id", "term")
    quoted = questions.select("qid", F.col("document_id").alias("scope"), F.explode(F.regexp_extract_all("question", F.lit(QUOTED_TERM), F.lit(1))).alias("q"))
    exact = definitions.where(F.length("term") > 3).select(F.col("document_id").alias("scope"), "id", "term", F.lower("term").alias("low"))
    by_name = quoted.withColumn("low", F.lower("q")).join(exact, ["scope", "low"]).select("qid", "id", "term")
    return plain.unionByName(by_name).distinct().select("qid", F.col("id").alias("node"), (-F.length("term")).alias("pos"))


def seeds(parts: list[DataFrame], amends: DataFrame) -> DataFrame:
    """(qid, node, pos): ``parts`` in order of priority, then what seeds in amendments amend.

    ``amends`` (source_sec_id, target): a clause of an amendment leads to what it changes.
    """
    first = cut_lineage(retrieval.ordered_union(parts))
    led = first.join(amends, F.col("node") == F.col("source_sec_id")).groupBy("qid", F.col("target").alias("node")).agg(F.min("pos").alias("pos"))
    return retrieval.ordered_union([first, led])


#: What a question asks for, by its words in lower case. Fixed values.
GATES = {
    "dependents": r"\bdepend|\brel(?:ies|y) on|\breference or depend",
    "parties": r"\bpart(?:y|ies)\b|\bwho (?:are|is)\b|\brole",
    "amendments": r"amend",
    "history": r"chang|amend|trace|evolv|restructur|modif|history",
    "conflict": r"conflict|inconsisten|contradict|cross.?ref|does not say",
}
_CHANGES, _EFFECTS = r"\b(?:chang\w*|amend\w*|evolv\w*|modif\w*)\b", r"\b(?:rely|relies|relied|depend\w*|affect\w*)\b"


def gates(question: Column) -> dict[str, Column]:
    """Flags of a question that call for a block of their own; null questions call for none."""
    low = F.lower(F.coalesce(question, F.lit("")))
    return {k: low.rlike(p) for k, p in GATES.items()} | {"components": low.rlike(_CHANGES) & low.rlike(_EFFECTS)}


def ranked_first(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
