"""Citations of answers: what they name, which version they claim, and whether that holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexloom.operators import metrics, text
from codexloom.operators.extract import ORDINALS

#: What stands in brackets, and what a citation names. Fixed values.
BRACKETS = r"\[([^\[\]]{4,300}?)\]"
SECTION = r"§\s*(\d{1,2}\.\d{1,2}(?:\([a-z0-9ivx]{1,4}\))*|\d{1,2}(?!\.)|[IVX]{1,4}(?![.\w]))"
DEFINITION = r"(?i)definition of\s+[“\"']\s*([^”\"']{2,60}?)\s*[”\"']"
EXHIBIT = r"Exhibit\s+([A-Z])\b"
#: Heads of citations of blocks that no single provision holds. The last two are made by the
#: pipeline as well, and are counted here with the others.
SYNTHETIC = ("Amendment catalog", "Change history", "Cross-reference audit", "Provisions that depend on", "Party roster", "Component changes")
#: The share of a claim's words that the cited text must have.
FLOOR = 0.3
_SENTENCE = r"(?<=[.;:])\s+|\n"


def is_synthetic(c: Column) -> Column:
    out = F.lit(False)
    for p in SYNTHETIC:
        out = out | F.startswith(c, F.lit(p))
    return out


def is_shaped(c: Column) -> Column:
    """Whether a bracket names a provision, definition, exhibit or made block at all."""
    return is_synthetic(c) | c.rlike(SECTION) | c.rlike(DEFINITION) | c.rlike(EXHIBIT)


def bracketed(answer: Column) -> Column:
    """The distinct contents of an answer's brackets, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(BRACKETS), F.lit(1)), F.trim))


def document_of(c: Column) -> Column:
    """``amendment_n`` if the citation's head, before the section, begins with an ordinal amendment; else ``base``."""
    head = F.lower(F.substring_index(c, "§", 1))
    out = F.lit("base")
    for k, o in reversed(list(enumerate(ORDINALS))):
        out = F.when(F.startswith(head, F.lit(o.lower() + " amendment")), F.lit(f"amendment_{k + 1}")).otherwise(out)
    return out


def _plain(term: Column) -> Column:
    return F.replace(F.lower(term), F.lit("’"), F.lit("'"))


def resolve(citations: DataFrame, nodes: DataFrame) -> DataFrame:
    """``citations`` (agreement_id, citation, ...) with ``node_id``, null if nothing real is named.

    ``nodes`` (id, node_type, document_id, number, term). A definition is found by its exact
    term, else by it without regard to case and apostrophes; an exhibit in the base
    document; a section in the document that the citation names, else in the base,
    number 0 being the preamble. Each step is a join by key.
    """
    c = F.col("citation")
    term, exhibit, number = F.regexp_extract(c, DEFINITION, 1), F.regexp_extract(c, EXHIBIT, 1), F.regexp_extract(c, SECTION, 1)
    own = citations.withColumns({"_t": F.trim(term), "_b": F.concat("agreement_id", F.lit(".base"))}).withColumn("_d", F.concat("agreement_id", F.lit("."), document_of(c)))
    kind = F.when(F.col("_t") != "", "d").when(exhibit != "", "e").when(number != "", "s")
    own = own.withColumns({"_k": kind, "_exact": F.when(kind == "d", F.concat("_b", F.lit("::def::"), "_t")).when(kind == "e", F.concat("_b", F.lit("::exhibit::"), exhibit)).when(kind == "s", F.concat("_d", F.lit("::"), number)), "_low": F.when(kind == "d", _plain(F.col("_t"))), "_base": F.when(kind == "s", F.concat("_b", F.lit("::"), number)), "_pre": F.when((kind == "s") & (number == "0"), F.concat("_d", F.lit("::preamble")))})
    ids = nodes.select("id").distinct()
    terms = nodes.where("node_type = 'Definition'").groupBy(F.col("document_id").alias("_td"), _plain(F.col("term")).alias("_tl")).agg(F.min("id").alias("_by_term"))
    numbers = nodes.where("node_type = 'Section'").groupBy(F.col("document_id").alias("_nd"), F.col("number").alias("_nn")).agg(F.min("id").alias("_by_number"))
    out = own
    for k in ("_exact", "_base", "_pre"):
        hit = ids.select(F.col("id").alias(f"{k}_id"))
        out = out.join(hit, out[k] == hit[f"{k}_id"], "left")
    out = out.join(terms, (out["_b"] == terms["_td"]) & (out["_low"] == terms["_tl"]), "left")
    out = out.withColumn("_num", F.when(F.col("_k") == "s", number)).join(numbers, (F.col("_d") == F.col("_nd")) & (F.col("_num") == F.col("_nn")), "left")
    node = F.coalesce("_exact_id", "_base_id", "_pre_id", "_by_term", "_by_number")
    return out.withColumn("node_id", node).select(*citations.columns, "node_id")


def version_holds(claimed: Column, status: Column) -> Column:
    """Whether a claimed status is the true one; what was added may be called amended."""
    return claimed.isNotNull() & ((claimed == status) | ((claimed == "amended") & (status == "added")))


def claims(answer: Column, citation: Column, whole: bool = True) -> Column:
    """The sentences of an answer that carry a citation, without it.

    With ``whole`` an answer that carries none is one claim as it stands: its citations are
    listed beside it and not inside.
    """
    mark = F.concat(F.lit("["), citation, F.lit("]"))
    said = F.filter(F.split(answer, _SENTENCE), lambda s: F.contains(s, F.substring(citation, 1, 60)))
    said = F.transform(said, lambda s: F.replace(s, mark, F.lit(" ")))
    return F.when(F.size(said) == 0, F.array(answer)).otherwise(said) if whole else said


def grounding(answer: Column, citation: Column, source: Column, whole: bool = True) -> Column:
    """The best share of a claim's words that the cited text has; null without a claim."""
    return F.array_max(F.transform(claims(answer, citation, whole), lambda s: text.grounding(s, source)))


def rates(checks: DataFrame, by: list[str]) -> DataFrame:
    """Counts and rates of checked citations for each group; made blocks are in no rate.

    ``checks`` has citation, node_id, status, claimed, late and grounding. Rates of groups
    without a citation are 0, those of claims or groundings without any are null.
    """
    c = checks.withColumns({"_real": ~is_synthetic(F.col("citation")), "_ok": version_holds(F.col("claimed"), F.col("status"))})
    real = lambda x: F.count_if(F.col("_real") & x)
    n = F.greatest(F.count_if("_real"), F.lit(1))
    said, found = F.col("claimed").isNotNull() & F.col("node_id").isNotNull(), F.col("node_id").isNotNull()
    return c.groupBy(*by).agg(
        F.count(F.lit(1)).alias("citations"), F.count_if(F.col("_real")).alias("real"), real(~found).alias("unresolvable"), F.round(real(found) / n, 3).alias("resolvable_rate"), F.round(real(said) / n, 3).alias("versioned_rate"),
        F.round(F.when(real(said) > 0, real(said & F.col("_ok")) / real(said)), 3).alias("version_ok_rate"), F.round(real(found & F.col("_ok")) / n, 3).alias("verified_rate"), real(F.col("late")).alias("late"),
        F.round(F.avg(F.when(F.col("_real"), F.col("grounding"))), 3).alias("grounding"), real(F.col("grounding") < FLOOR).alias("weak"),
    )


def check(asserted: DataFrame, nodes: DataFrame, told: DataFrame) -> DataFrame:
    """Each row of ``asserted`` (answer, as_of, agreement_id, citation, ...) judged.

    ``told`` (node_id, as_of, text, status) are the provisions as of the days asked for.
    """
    got = resolve(asserted, nodes).alias("a")
    t = told.select(F.col("node_id").alias("_n"), F.col("as_of").alias("_d"), F.col("text").alias("_text"), "status")
    j = got.join(t, (F.col("node_id") == F.col("_n")) & F.col("as_of").eqNullSafe(F.col("_d")), "left").drop("_n", "_d")
    ground = F.when(F.col("_text").isNotNull(), F.round(grounding(F.col("answer"), F.col("citation"), F.col("_text")), 6))
    return j.withColumns({"claimed": metrics.citation_status(F.col("citation")), "late": metrics.anachronism(F.col("citation"), F.col("as_of")).isNotNull(), "grounding": ground}).drop("_text")
