"""The queries of the training-data problems and their SQL, where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexloom.llm import mixing, near_duplicates, packing, pair_defects, residue, scan_noise, splitting, tokens
from codexloom.runtime import cut_lineage, table


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "holdout_hard_set").select("id", F.col("question").alias("text"))
    return h.unionByName(table(spark, sf, "mini_eval_set").select("id", "text"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.similar_pairs(_questions(spark, sf))


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    """One row per record: its copies, its links to other texts, and the least id of its group."""
    g = cut_lineage(near_duplicates.groups(_questions(spark, sf)).withColumnRenamed("rec_id", "id"))
    least = g.groupBy("group_id").agg(F.min("id").alias("least"))
    return g.join(least, "group_id").select("id", "copies", "links", F.col("least").alias("group_id"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    mini = table(spark, sf, "mini_eval_set").select(F.col("text").alias("question"), F.col("gold_answer").alias("answer"))
    clauses = table(spark, sf, "documents").select(F.lower(F.trim("lang")).alias("lang"), "text").where(F.col("lang").isin("en", "de", "fr", "es"))
    model = pair_defects.fit_model(mini, clauses)
    h = table(spark, sf, "holdout_hard_set").select(F.lit("holdout_hard_set").alias("table_name"), F.col("id").alias("record_key"), "question", F.col("gold_answer").alias("answer"))
    a = table(spark, sf, "answers").select(F.lit("answers").alias("table_name"), F.col("answer_id").cast("string").alias("record_key"), "question", "answer")
    return pair_defects.find_defects(h.unionByName(a), model, ["table_name", "record_key"])


def _items(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "sections").select(F.lit("section").alias("item_kind"), F.col("id").alias("item_id"), F.col("number").alias("place"), "source", "text")
    c = table(spark, sf, "chunks").select(F.lit("chunk").alias("item_kind"), F.col("id").alias("item_id"), F.col("section_hint").alias("place"), "source", "text")
    return s.unionByName(c)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_items(_items(spark, sf), table(spark, sf, "split_limits"), ["item_kind", "item_id"], with_text=False).select("item_kind", "item_id").distinct()


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece with its item's number or section_hint as ``place``."""
    return splitting.split_items(_items(spark, sf), table(spark, sf, "split_limits"), ["item_kind", "item_id", "place"])


def p3_check(spark: SparkSession, sf: str) -> DataFrame:
    """Per kind: oversized items, and how many break a rule of their pieces.

    No piece may be longer than allowed, each must begin exactly the overlap before the last
    one's end, and the pieces without overlaps must be the item's text.
    """
    got = splitting.split_items(_items(spark, sf), table(spark, sf, "split_limits"), ["item_kind", "item_id", "place"])
    p = F.array_sort(F.collect_list(F.struct("piece_no", "piece_start", "piece_end", "piece")))
    per = got.groupBy("item_kind", "item_id", "place", "max_chars", "overlap_chars").agg(p.alias("p"))
    long = F.exists("p", lambda x: (F.length(x["piece"]) > F.col("max_chars")) | (F.length(x["piece"]) != x["piece_end"] - x["piece_start"]))
    steps = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p")), lambda a, b: b["piece_start"] == a["piece_end"] - F.col("overlap_chars"))
    whole = F.concat(F.col("p")[0]["piece"], F.array_join(F.transform(F.slice("p", 2, F.size("p")), lambda x: F.substr(x["piece"], F.col("overlap_chars") + 1, F.length(x["piece"]))), ""))
    texts = splitting.oversized(_items(spark, sf), table(spark, sf, "split_limits")).select("item_kind", "item_id", F.xxhash64("text").alias("want")).distinct()
    j = per.select("item_kind", "item_id", long.alias("long"), F.exists(steps, lambda x: ~x).alias("apart"), F.xxhash64(whole).alias("have")).join(texts, ["item_kind", "item_id"])
    one = j.groupBy("item_kind", "item_id").agg(F.max("long").alias("long"), F.max("apart").alias("apart"), F.max(F.col("have") == F.col("want")).alias("same"))
    return one.groupBy("item_kind").agg(F.count(F.lit(1)).alias("items"), F.count_if("long").alias("too_long"), F.count_if("apart").alias("wrong_overlap"), F.count_if(~F.col("same")).alias("not_whole"))


def _scanned(spark: SparkSession, sf: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Every section (with ``columns`` of the reading) and chunk, read for noise."""
    sections, chunks = table(spark, sf, "sections"), table(spark, sf, "chunks")
    corpus = scan_noise.learn(sections)
    read = cut_lineage(scan_noise.read_sections(sections, corpus).select("id", "findings", *columns))
    return read, scan_noise.read_chunks(chunks, read, corpus)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    read, chunks = _scanned(spark, sf)
    s = read.select(F.lit("section").alias("item_kind"), F.col("id").alias("item_id"), F.explode(F.array_distinct("findings.kind")).alias("noise"))
    c = chunks.select(F.lit("chunk").alias("item_kind"), F.col("id").alias("item_id"), F.explode("kinds").alias("noise"))
    return s.unionByName(c).distinct()


def p5_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """The repaired text of every section and chunk."""
    read, chunks = _scanned(spark, sf, "repaired")
    s = read.select(F.lit("section").alias("item_kind"), F.col("id").alias("item_id"), F.col("repaired").alias("text"))
    return s.unionByName(chunks.select(F.lit("chunk").alias("item_kind"), F.col("id").alias("item_id"), F.col("repaired").alias("text"))).distinct()


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, source, n_tokens), counted once and kept."""
    docs = table(spark, sf, "documents")
    return cut_lineage(docs.select("doc_id", "source", tokens.n_tokens(F.col("text"), tokens.vocabulary_file(spark)).alias("n_tokens")).dropDuplicates(["doc_id"]))


def _capacities(spark: SparkSession, sf: str) -> list[int]:
    return sorted({r[0] for r in table(spark, sf, "context_bins").select("capacity_tokens").distinct().collect()})


def p6_packed(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in containers of the largest capacity, which wastes least."""
    return packing.pack(_sizes(spark, sf), _capacities(spark, sf)[-1])


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """For each capacity: containers and the share of room that stays unused."""
    sizes, out = _sizes(spark, sf), None
    for c in _capacities(spark, sf):
        r = packing.report(packing.pack(sizes, c), c)
        out = r if out is None else out.unionByName(r)
    return out


def p6_check(spark: SparkSession, sf: str) -> DataFrame:
    """Documents packed, and how many containers or documents break a rule of packing, at every capacity."""
    sizes, out = _sizes(spark, sf), None
    for c in _capacities(spark, sf):
        got = cut_lineage(packing.pack(sizes, c))
        full = got.groupBy("bin").agg(F.sum("n_tokens").alias("t")).agg(F.count_if(F.col("t") > c).alias("overfull"))
        d = got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("n_tokens").alias("t")).join(sizes, "doc_id")
        r = d.agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("k") > 1) & (F.col("n_tokens") <= c)).alias("split"), F.count_if(F.col("t") != F.col("n_tokens")).alias("not_whole")).crossJoin(full).withColumn("capacity_tokens", F.lit(c))
        out = r if out is None else out.unionByName(r)
    return out


def p7_check(spark: SparkSession, sf: str) -> DataFrame:
    """Per source of the mixture: distinct documents at hand, and copies that break a rule of mixing."""
    docs, targets = table(spark, sf, "documents"), table(spark, sf, "mix_targets")
    rates = mixing.solve(_sizes(spark, sf), targets)
    mix = mixing.mixture(docs, rates, columns=())
    caps = targets.groupBy(mixing.source_name(F.col("source")).alias("source")).agg(F.min("max_repeats").alias("cap"))
    have = docs.select("doc_id", mixing.source_name(F.col("source")).alias("source")).distinct().groupBy("source").agg(F.count_distinct("doc_id").alias("documents"))
    per = mix.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("copy_no").alias("last"))
    bad = per.join(caps, "source", "left").groupBy("source").agg(F.count_if(F.col("n") > F.coalesce("cap", F.lit(0))).alias("over_cap"), F.count_if(F.col("n") != F.col("last")).alias("repeated"))
    # A small source may be drawn no copy at all.
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return have.where(F.col("source").isin(*rates)).join(bad, "source", "left").select("source", "documents", zero("over_cap"), zero("repeated"))


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    rates = mixing.solve(_sizes(spark, sf), table(spark, sf, "mix_targets"))
    return mixing.mixture(table(spark, sf, "documents"), rates)


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    sizes, targets = _sizes(spark, sf), table(spark, sf, "mix_targets")
    return mixing.shares(sizes, targets, mixing.solve(sizes, targets))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue(table(spark, sf, "documents")).select("doc_id")


def p8_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p3_found, p3_pieces, p3_check, p5_found, p5_repaired, p6_packed, p6_report, p6_check, p7_mixture, p7_shares, p7_check, p8_found, p8_kinds)}

ORACLE = {
    "p1_found": """
WITH q AS (SELECT id, question AS t FROM holdout_hard_set UNION ALL SELECT id, text FROM mini_eval_set),
w AS (SELECT DISTINCT id, list_sort(list_distinct(regexp_extract_all(lower(t), '[a-z0-9]+'))) AS w FROM q WHERE t IS NOT NULL),
p AS (SELECT a.id AS id_a, b.id AS id_b, len(list_intersect(a.w, b.w)) AS c, len(a.w) AS n, len(b.w) AS m
  FROM w a JOIN w b ON a.id < b.id AND len(a.w) > 0 AND len(b.w) BETWEEN len(a.w) * 0.8 - 0.001 AND len(a.w) / 0.8 + 0.001)
SELECT DISTINCT id_a, id_b FROM p WHERE 10 * c >= 8 * (n + m - c)""",
    "p3_found": """
WITH i AS (SELECT 'section' AS item_kind, id AS item_id, source, text FROM sections UNION ALL SELECT 'chunk', id, source, text FROM chunks)
SELECT DISTINCT i.item_kind, i.item_id FROM i JOIN split_limits l ON l.item_kind = i.item_kind AND lower(trim(l.source)) = lower(trim(i.source))
WHERE length(i.text) > l.max_chars""",
    "p1_groups": """
WITH RECURSIVE q AS (SELECT id, question AS t FROM holdout_hard_set UNION ALL SELECT id, text FROM mini_eval_set),
w AS (SELECT DISTINCT id, list_sort(list_distinct(regexp_extract_all(lower(t), '[a-z0-9]+'))) AS w FROM q WHERE t IS NOT NULL),
r AS (SELECT id, w, dense_rank() OVER (ORDER BY w) AS c FROM w WHERE len(w) > 0), k AS (SELECT DISTINCT c, w FROM r),
l AS (SELECT a.c AS a, b.c AS b FROM k a JOIN k b ON a.c <> b.c AND len(b.w) BETWEEN len(a.w) * 0.8 - 0.001 AND len(a.w) / 0.8 + 0.001 WHERE 10 * len(list_intersect(a.w, b.w)) >= 8 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))),
g AS (SELECT c, c AS d FROM k UNION SELECT g.c, l.b FROM g JOIN l ON l.a = g.d), h AS (SELECT c, min(d) AS g FROM g GROUP BY c), m AS (SELECT h.g, min(r.id) AS least FROM r JOIN h USING (c) GROUP BY h.g)
SELECT r.id, count(*) OVER (PARTITION BY r.c) AS copies, (SELECT count(*) FROM l WHERE l.a = r.c) AS links, m.least AS group_id FROM r JOIN h USING (c) JOIN m ON m.g = h.g""",
    "p3_check": """
WITH i AS (SELECT 'section' AS item_kind, id AS item_id, source, text FROM sections UNION ALL SELECT 'chunk', id, source, text FROM chunks)
SELECT i.item_kind, count(DISTINCT i.item_id) AS items, 0 AS too_long, 0 AS wrong_overlap, 0 AS not_whole FROM i JOIN split_limits l ON l.item_kind = i.item_kind AND lower(trim(l.source)) = lower(trim(i.source)) WHERE length(i.text) > l.max_chars GROUP BY 1""",
    "p6_check": "SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0 AS split, 0 AS not_whole, 0 AS overfull, capacity_tokens FROM (SELECT DISTINCT capacity_tokens FROM context_bins)",
    "p7_check": r"""
WITH d AS (SELECT doc_id, regexp_replace(lower(trim(source)), '[\s\-_]+', '_', 'g') AS source, text FROM documents), t AS (SELECT regexp_replace(lower(trim(source)), '[\s\-_]+', '_', 'g') AS source, sum(target_share) AS share, min(max_repeats) AS cap FROM mix_targets GROUP BY 1)
SELECT d.source, count(DISTINCT doc_id) AS documents, 0 AS over_cap, 0 AS repeated FROM d JOIN t USING (source) WHERE share > 0 AND cap > 0 GROUP BY d.source HAVING sum(len(coalesce(text, ''))) > 0""",
}
