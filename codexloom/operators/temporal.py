"""Text in force on a day: ordered amendment operations folded over the original text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A restatement shorter than this, or than this share of the text, only annotates it.
SHORT_TEXT, SHORT_SHARE = 400, 0.4
#: What an instruction to edit says at its head. Fixed values.
EDIT_PHRASES = ("by replacing", "by deleting", "by inserting", "is hereby amended", "amended by replacing", "replacing the text in the proviso")


def counts_on(effective: Column, as_of: Column) -> Column:
    """Inclusive; a null day means the latest state."""
    return as_of.isNull() | (effective <= as_of)


def surgical(current: Column, new: Column) -> Column:
    """Whether a restatement is an instruction to edit and not the new text itself.

    Blank new text is, blank current text never; else short new text is, and so is an
    edit instruction in the first 240 characters of a text shorter than the current one.
    """
    few = F.greatest(F.lit(SHORT_TEXT), (F.lit(SHORT_SHARE) * F.length(current)).cast("int"))
    told = F.substring(F.lower(new), 1, 240).rlike("|".join(EDIT_PHRASES))
    return F.when(F.trim(new) == "", True).when(F.trim(current) == "", False).when(F.length(new) < few, True).otherwise(told & (F.length(new) < F.length(current)))


def ops_before(ops: DataFrame, as_of: DataFrame) -> DataFrame:
    """(node_id, as_of, op): ``ops`` (node_id, eff, seq, ...) in force for each asked pair."""
    return as_of.join(ops, "node_id").where(counts_on(F.col("eff"), F.col("as_of")))


def fold(nodes: DataFrame, ops: DataFrame, asked: DataFrame) -> DataFrame:
    """(node_id, as_of, text, status, citation) for each pair of ``asked``.

    ``nodes`` (node_id, label, base_text, origin), ``ops`` (node_id, eff, seq, kind,
    instrument, new_text). Operations apply by (eff, seq): a restatement replaces the
    text unless it is surgical, an insertion appends, anything else adds a note; the
    first operation is stamped if nothing else was noted, and the citation names the
    last. The fold is one expression per row over the ordered operations of a node.
    """
    got = ops_before(ops, asked).groupBy("node_id", "as_of").agg(F.array_sort(F.collect_list(F.struct("eff", "seq", "kind", "instrument", "new_text"))).alias("ops"))
    rows = asked.join(nodes, "node_id", "left").join(got.withColumnRenamed("as_of", "_d").withColumnRenamed("node_id", "_n"), (F.col("node_id") == F.col("_n")) & F.col("as_of").eqNullSafe(F.col("_d")), "left").drop("_n", "_d")
    base = F.coalesce("base_text", F.lit(""))
    state = "struct<text:string,status:string,notes:array<string>>"
    start = F.struct(base.alias("text"), F.lit("original").alias("status"), F.array().cast("array<string>").alias("notes")).cast(state)

    def step(a: Column, o: Column) -> Column:
        stamp = F.concat(o["instrument"], F.lit(" (effective "), o["eff"].cast("string"), F.lit(")"))
        new = F.coalesce(o["new_text"], F.lit(""))
        edits = surgical(a["text"], new)
        whole = (o["kind"] == "restate") & ~edits
        adds = o["kind"] == "insert"
        text = F.when(whole, new).when(adds, F.when(a["text"] == "", new).otherwise(F.concat(a["text"], F.lit("\n"), new))).otherwise(a["text"])
        status = F.when(adds & (base == ""), F.lit("added")).otherwise(F.lit("amended"))
        name = F.when(o["kind"] == "restate", F.lit("proviso/restate")).otherwise(o["kind"])
        noted = F.when(whole | adds, a["notes"]).otherwise(F.array_append(a["notes"], F.concat(F.lit("["), name, F.lit(" per "), stamp, F.lit(": "), new, F.lit("]"))))
        notes = F.when(F.size(noted) == 0, F.array(F.concat(F.lit("[as amended by "), stamp, F.lit("]")))).otherwise(noted)
        return F.struct(text.alias("text"), status.alias("status"), notes.alias("notes")).cast(state)

    ops_ = F.coalesce("ops", F.array().cast("array<struct<eff:date,seq:bigint,kind:string,instrument:string,new_text:string>>"))
    out = rows.withColumn("s", F.aggregate(ops_, start, step)).withColumn("last", F.element_at("ops", -1))
    text = F.when(F.size("s.notes") > 0, F.concat("s.text", F.lit("\n"), F.array_join("s.notes", "\n"))).otherwise(F.col("s.text"))
    cited = F.when(F.col("last").isNotNull(), F.concat(F.lit(", as amended by "), F.col("last.instrument"), F.lit(" (effective "), F.col("last.eff").cast("string"), F.lit(")"))).otherwise(F.concat(F.lit(", "), F.col("origin")))
    return out.select("node_id", "as_of", text.alias("text"), F.col("s.status").alias("status"), F.concat("label", cited).alias("citation"))


def status_on(ops: DataFrame, asked: DataFrame) -> DataFrame:
    """(node_id, as_of, n_ops, last_instrument): the fold's counts without its text."""
    got = ops_before(ops, asked).groupBy("node_id", "as_of").agg(F.count(F.lit(1)).alias("n_ops"), F.max_by("instrument", F.struct("eff", "seq")).alias("last_instrument"))
    out = asked.alias("a").join(got.alias("g"), (F.col("a.node_id") == F.col("g.node_id")) & F.col("a.as_of").eqNullSafe(F.col("g.as_of")), "left")
    return out.select("a.node_id", "a.as_of", F.coalesce("g.n_ops", F.lit(0)).alias("n_ops"), "g.last_instrument")


def catalog(ops: DataFrame) -> DataFrame:
    """(eff, instrument, ops, targets): what each instrument changed, targets in order."""
    t = F.array_join(F.array_sort(F.collect_set(F.concat("node_id", F.lit(" ("), "kind", F.lit(")")))), "; ")
    return ops.groupBy("eff", "instrument").agg(F.count(F.lit(1)).alias("ops"), t.alias("targets"))


#: Days before and after all that can be asked for.
FIRST_DAY, LAST_DAY = "1900-01-01", "2100-01-01"


def lattice_days(ops: DataFrame) -> DataFrame:
    """(node_id, as_of): each node's effective days with the days around them, and two far ones."""
    far = F.array(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date"))
    days = F.concat(F.array(F.date_sub("eff", 1), F.col("eff"), F.date_add("eff", 1)), far)
    return ops.select("node_id", F.explode(days).alias("as_of")).distinct()


def check_lattice(folded: DataFrame, counted: DataFrame) -> DataFrame:
    """(node_id, as_of, n_ops, status, reverts, late) from the folds and counts of a lattice.

    ``reverts`` is true where a node has fewer operations than on an earlier day, or is
    original again after it was amended; ``late`` where its citation names a later day.
    Neither must ever be.
    """
    w = Window.partitionBy("node_id").orderBy("as_of").rowsBetween(Window.unboundedPreceding, -1)
    rows = folded.join(counted.select("node_id", "as_of", "n_ops"), ["node_id", "as_of"])
    fewer = F.col("n_ops") < F.max("n_ops").over(w)
    again = (F.col("status") == "original") & F.max(F.col("status") != "original").over(w)
    days = F.transform(F.regexp_extract_all("citation", F.lit(r"(?:effective|dated)\s+(\d{4}-\d{2}-\d{2})"), F.lit(1)), lambda d: F.try_to_date(d))
    late = F.exists(days, lambda d: d > F.col("as_of"))
    return rows.select("node_id", "as_of", "n_ops", "status", F.coalesce(fewer | again, F.lit(False)).alias("reverts"), F.coalesce(late, F.lit(False)).alias("late"))


def check_windows(days: DataFrame, folded: DataFrame) -> DataFrame:
    """(node_id, eff, status, changes, changes_again, cites_anew, cites_day) around each day of ``days``.

    Text and citation must change on the day itself, and again the day after only if
    another operation takes effect then; the citation must name the day.
    """
    at = lambda k, x: folded.select("node_id", F.date_add("as_of", k).alias("eff"), F.col("text").alias(f"{x}_t"), F.col("citation").alias(f"{x}_c"), F.col("status").alias(f"{x}_s"))
    j = days.join(at(1, "p"), ["node_id", "eff"]).join(at(0, "c"), ["node_id", "eff"]).join(at(-1, "n"), ["node_id", "eff"])
    return j.select("node_id", "eff", F.col("c_s").alias("status"), (~F.col("p_t").eqNullSafe(F.col("c_t"))).alias("changes"), (~F.col("c_t").eqNullSafe(F.col("n_t"))).alias("changes_again"), (~F.col("p_c").eqNullSafe(F.col("c_c"))).alias("cites_anew"), F.contains("c_c", F.col("eff").cast("string")).alias("cites_day"))
