"""What retrieval and answers are worth: packing and metrics over stored answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexloom.operators import build, metrics, retrieval, text
from codexloom.runtime import table

BUDGET = 1200


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "answers").drop("loaded_at").dropDuplicates(["answer_id"])


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    """(id, gold) of both question sets."""
    h = table(spark, sf, "holdout_hard_set").select("id", "gold")
    return h.unionByName(table(spark, sf, "mini_eval_set").select("id", "gold")).dropDuplicates(["id"])


def category(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[ -]+", "_")


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """Each answer with the gold of its question and its measures."""
    a = _answers(spark, sf).join(_gold(spark, sf), "id")
    found = F.coalesce("context_ids", F.array().cast("array<string>"))
    recall, precision = metrics.hierarchical(F.col("gold"), found)
    return a.select("answer_id", "id", "path", "tag", "latency_s", "gold", found.alias("found"), recall.alias("recall"), precision.alias("precision"), metrics.exact_recall(F.col("gold"), found).alias("exact"))


def metric_context(spark: SparkSession, sf: str) -> DataFrame:
    """Hierarchical recall and precision, and exact recall, of each answer's context."""
    return _judged(spark, sf).select("answer_id", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"), F.round("exact", 6).alias("exact"))


def metric_ranking(spark: SparkSession, sf: str) -> DataFrame:
    j = _judged(spark, sf)
    m = metrics.ranking(F.col("gold"), F.col("found"))
    return j.groupBy("path").agg(*[F.round(F.avg(c), 6).alias(f"{n}_at_10") for n, c in m.items()])


def metric_by_path(spark: SparkSession, sf: str) -> DataFrame:
    """Null-skipping means per path, and those of tagged runs alone."""
    named = F.col("tag").isNotNull()
    return _judged(spark, sf).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg(F.when(named, F.col("recall"))), 6).alias("tagged_recall"), F.count_if(named).alias("tagged"))


def metric_by_category(spark: SparkSession, sf: str) -> DataFrame:
    """Per category, however spelled: questions, answers, and the share fully recalled."""
    q = table(spark, sf, "holdout_hard_set").select("id", category(F.col("category")).alias("category")).dropDuplicates(["id"])
    j = _judged(spark, sf).join(q, "id")
    return j.groupBy("category").agg(F.count(F.lit(1)).alias("answers"), F.count_if(F.col("exact") == 1).alias("whole"), F.round(F.avg("exact"), 6).alias("mean_exact"))


def metric_latency(spark: SparkSession, sf: str) -> DataFrame:
    a = _answers(spark, sf)
    return a.groupBy("path").agg(F.count("latency_s").alias("n"), F.round(F.avg("latency_s"), 6).alias("mean"), F.round(F.median("latency_s"), 6).alias("median"), F.min("latency_s").alias("least"), F.max("latency_s").alias("most"))


def metric_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.percentiles(_answers(spark, sf), "latency_s", ["path"])


def metric_citation_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Share of citations of a subsection, and citations that state a version."""
    c = _answers(spark, sf).select("path", F.explode("citations").alias("c"))
    return c.groupBy("path").agg(F.count(F.lit(1)).alias("citations"), F.round(F.avg(F.col("c").rlike(r"§[0-9.]+\(").cast("double")), 6).alias("subsection_rate"), F.count_if(metrics.citation_status(F.col("c")) == "amended").alias("amended"))


def metric_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement and kappa of the two paths on whether a question was wholly recalled."""
    j = _judged(spark, sf).groupBy("id").agg(F.max(F.when(F.col("path") == "graph", F.col("exact") == 1)).alias("graph"), F.max(F.when(F.col("path") == "baseline", F.col("exact") == 1)).alias("baseline"))
    return metrics.kappa(j.withColumn("field", F.lit("wholly_recalled")), "graph", "baseline", ["field"]).select("field", "n", F.round("agreement", 6).alias("agreement"), "kappa")


def metric_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.pearson(_judged(spark, sf), "recall", "precision", ["path"])


def metric_flips(spark: SparkSession, sf: str) -> DataFrame:
    """For each path and two runs: questions that the second loses and gains against the first."""
    j = _judged(spark, sf).where("tag IS NOT NULL").groupBy("path", "id", "tag").agg(F.max(F.col("exact") == 1).alias("ok"))
    base = j.select("path", "id", F.col("tag").alias("base_tag"), F.col("ok").alias("base"))
    return j.join(base, ["path", "id"]).where("tag != base_tag").groupBy("path", "base_tag", "tag").agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("base") & ~F.col("ok")).alias("regressions"), F.count_if(~F.col("base") & F.col("ok")).alias("gains"))


def metric_arms(spark: SparkSession, sf: str) -> DataFrame:
    """How far two runs agree on each measure of a question: equal, apart by how much, within a tenth."""
    j = _judged(spark, sf).where("tag IS NOT NULL").groupBy("path", "id", "tag").agg(*[F.avg(c).alias(c) for c in ("recall", "precision", "exact")])
    long = j.unpivot(["path", "id", "tag"], ["recall", "precision", "exact"], "field", "value").where("value IS NOT NULL")
    return metrics.compare_arms(long, "tag", ["path", "id", "field"], ["path", "field"])


def metric_differs(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that both paths answer, and how many of them differently."""
    a = _answers(spark, sf).groupBy("id").agg(F.array_sort(F.collect_set(F.when(F.col("path") == "graph", F.trim("answer")))).alias("g"), F.array_sort(F.collect_set(F.when(F.col("path") == "baseline", F.trim("answer")))).alias("b"))
    both = a.where((F.size("g") > 0) & (F.size("b") > 0))
    return both.agg(F.count(F.lit(1)).alias("questions"), F.count_if(~F.arrays_overlap("g", "b")).alias("differ"))


def metric_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Share of whole recalls of each kind of question, one column for each path."""
    q = table(spark, sf, "holdout_hard_set").select("id", category(F.col("category")).alias("category")).dropDuplicates(["id"])
    j = _judged(spark, sf).join(q, "id").withColumn("ok", (F.col("exact") == 1).cast("double"))
    return j.groupBy("category").pivot("path", ["graph", "baseline"]).agg(F.round(F.avg("ok"), 6))


def metric_headline(spark: SparkSession, sf: str) -> DataFrame:
    """Whole recalls out of answers, and mean measures, by run and path."""
    return _judged(spark, sf).groupBy(F.coalesce("tag", F.lit("none")).alias("run"), "path").agg(F.count_if(F.col("exact") == 1).alias("k"), F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg("recall"), F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(F.avg("precision"), F.lit(0.0)), 6).alias("precision"))


def metric_winner(spark: SparkSession, sf: str) -> DataFrame:
    """The run with the best recall and then rank at ten, of each path; ties by name."""
    j = _judged(spark, sf).where("tag IS NOT NULL")
    m = metrics.ranking(F.col("gold"), F.col("found"))
    r = j.groupBy("path", "tag").agg(F.round(F.avg(m["recall"]), 6).alias("r"), F.round(F.avg(m["mrr"]), 6).alias("m"))
    best = r.groupBy("path").agg(F.max(F.struct("r", "m", "tag")).alias("b"))
    return best.select("path", F.col("b.tag").alias("winner"), F.col("b.r").alias("recall_at_10"), F.col("b.m").alias("mrr_at_10"))


def metric_clustered(spark: SparkSession, sf: str) -> DataFrame:
    """By question set and path: recall (1 without gold) and the share of context that is gold."""
    named = F.when(F.startswith("id", F.lit("hh_")), "holdout").otherwise("mini")
    j = _judged(spark, sf)
    hits = F.size(F.filter("gold", lambda g: F.exists("found", lambda c: metrics.related(g, c))))
    p = F.when(F.size("found") > 0, F.least(hits / F.size("found"), F.lit(1.0))).otherwise(0.0)
    return j.groupBy(named.alias("question_set"), "path").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("recall", F.lit(1.0))), 6).alias("recall"), F.round(F.avg(p), 6).alias("precision"))


def metric_baseline_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Per path: gold nodes that the context's blocks name as a flat index would show them."""
    a = _answers(spark, sf).join(_gold(spark, sf), "id").where("context_blocks IS NOT NULL")
    hit = F.size(F.filter("gold", lambda g: F.exists("context_blocks", lambda b: metrics.baseline_hit(g, b["citation"], b["text"]))))
    unit = F.size(F.filter("context_blocks", lambda b: F.exists("gold", lambda g: metrics.baseline_hit(g, b["citation"], b["text"]))))
    s = a.where(F.size("gold") > 0).select("path", (hit / F.size("gold")).alias("r"), F.when(F.size("context_blocks") > 0, unit / F.size("context_blocks")).alias("p"))
    return s.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 6).alias("recall"), F.round(F.avg("p"), 6).alias("precision"))


def metric_indexing(spark: SparkSession, sf: str) -> DataFrame:
    """Words and pages of 500 words per filing."""
    s = build.sections(spark, sf).groupBy("document_id").agg(F.sum(F.size(text.words(F.col("text"))).cast("long")).alias("words"))
    return s.select("document_id", "words", F.round(F.col("words") / 500, 4).alias("pages"))


def rerank_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The three blocks of each answer that say most of its question's words."""
    b = _answers(spark, sf).select(F.col("answer_id").alias("qid"), "question", F.posexplode("context_blocks").alias("pos", "b"))
    s = b.select("qid", "pos", F.round(text.grounding(F.col("question"), F.col("b.text")), 6).alias("score"))
    return retrieval.rerank(s, 3)


def pack_blocks(spark: SparkSession, sf: str) -> DataFrame:
    a = _answers(spark, sf).select("answer_id", retrieval.pack(F.col("context_blocks"), BUDGET).alias("p"))
    return a.select("answer_id", F.size("p").alias("blocks"), F.coalesce(F.aggregate("p", F.lit(0), lambda s, b: s + F.length(b["text"])), F.lit(0)).alias("chars"))


QUERIES = {f.__name__: f for f in (metric_context, metric_ranking, metric_by_path, metric_by_category, metric_latency, metric_percentiles, metric_citation_rates, metric_agreement, metric_correlation, metric_flips, metric_arms, metric_differs, metric_pivot, metric_headline, metric_winner, metric_clustered, metric_baseline_hits, metric_indexing, rerank_blocks, pack_blocks)}

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in text.STOP_WORDS)
A = """WITH ans AS (SELECT answer_id, any_value(path) AS path, any_value(id) AS id, any_value(question) AS question, any_value(as_of) AS as_of, any_value(citations) AS citations, any_value(context_ids) AS context_ids, any_value(context_blocks) AS context_blocks, any_value(latency_s) AS latency_s, any_value(tag) AS tag FROM answers GROUP BY answer_id),
gold AS (SELECT id, any_value(gold) AS gold FROM (SELECT id, gold FROM holdout_hard_set UNION ALL SELECT id, gold FROM mini_eval_set) GROUP BY id),
j AS (SELECT a.answer_id, a.id, a.path, a.tag, g.gold, coalesce(a.context_ids, []) AS found FROM ans a JOIN gold g USING (id)),
m AS (SELECT *, CASE WHEN len(gold) > 0 THEN len(list_filter(gold, lambda g: len(list_filter(found, lambda c: c = g OR starts_with(c, g || '(') OR starts_with(g, c || '('))) > 0)) / len(gold) END AS recall,
  CASE WHEN len(found) > 0 THEN len(list_filter(found, lambda c: len(list_filter(gold, lambda g: c = g OR starts_with(c, g || '(') OR starts_with(g, c || '('))) > 0)) / len(found) ELSE 0.0 END AS "precision",
  CASE WHEN len(gold) > 0 THEN len(list_intersect(gold, found)) / len(list_distinct(gold)) ELSE 1.0 END AS exact FROM j)
"""
ORACLE = {
    "metric_context": A + 'SELECT answer_id, round(recall, 6) AS recall, round("precision", 6) AS "precision", round(exact, 6) AS exact FROM m',
    "metric_ranking": A + """, t AS (SELECT path, list_distinct(gold) AS g, found, list_filter(found, lambda x, i: list_position(found, x) = i)[1:10] AS top FROM j),
h AS (SELECT path, g, list_filter(list_transform(top, lambda x, i: CASE WHEN list_contains(g, x) THEN i END), lambda r: r IS NOT NULL) AS h FROM t),
s AS (SELECT path, CASE WHEN len(g) > 0 THEN len(h) / len(g) ELSE 0.0 END AS r, CASE WHEN len(h) > 0 THEN 1.0 / list_min(h) ELSE 0.0 END AS mrr,
  CASE WHEN len(g) > 0 THEN coalesce(list_sum(list_transform(h, lambda x: 1 / log2(x + 1))), 0.0) / list_sum(list_transform(range(1, least(len(g), 10) + 1), lambda x: 1 / log2(x + 1))) ELSE 0.0 END AS n FROM h)
SELECT path, round(avg(r), 6) AS recall_at_10, round(avg(mrr), 6) AS mrr_at_10, round(avg(n), 6) AS ndcg_at_10 FROM s GROUP BY path""",
    "metric_by_path": A + 'SELECT path, count(*) AS n, round(avg(recall), 6) AS recall, round(avg("precision"), 6) AS "precision", round(avg(recall) FILTER (WHERE tag IS NOT NULL), 6) AS tagged_recall, count(tag) AS tagged FROM m GROUP BY path',
    "metric_by_category": A + ", q AS (SELECT id, any_value(regexp_replace(lower(trim(category)), '[ -]+', '_', 'g')) AS category FROM holdout_hard_set GROUP BY id) SELECT category, count(*) AS answers, count(*) FILTER (WHERE exact = 1) AS whole, round(avg(exact), 6) AS mean_exact FROM m JOIN q USING (id) GROUP BY category",
    "metric_latency": A + "SELECT path, count(latency_s) AS n, round(avg(latency_s), 6) AS mean, round(median(latency_s), 6) AS median, min(latency_s) AS least, max(latency_s) AS most FROM ans GROUP BY path",
    "metric_percentiles": A + ", r AS (SELECT path, latency_s, row_number() OVER (PARTITION BY path ORDER BY latency_s) - 1 AS k, count(*) OVER (PARTITION BY path) AS n FROM ans WHERE latency_s IS NOT NULL) SELECT path, n, max(latency_s) FILTER (WHERE k = CAST(floor(n / 2) AS BIGINT)) AS p50, max(latency_s) FILTER (WHERE k = least(n - 1, CAST(round_even(n * 0.95, 0) AS BIGINT))) AS p95 FROM r GROUP BY path, n",
    "metric_citation_rates": A + ", c AS (SELECT path, unnest(citations) AS c FROM ans) SELECT path, count(*) AS citations, round(avg(CASE WHEN regexp_matches(c, '§[0-9.]+\\(') THEN 1.0 ELSE 0.0 END), 6) AS subsection_rate, count(*) FILTER (WHERE lower(c) NOT LIKE '%as originally executed%' AND (lower(c) LIKE '%as amended by%' OR lower(c) LIKE '%proviso added by%')) AS amended FROM c GROUP BY path",
    "metric_agreement": A + """, p AS (SELECT id, max(CASE WHEN path = 'graph' THEN CAST(exact = 1 AS INTEGER) END) AS g, max(CASE WHEN path = 'baseline' THEN CAST(exact = 1 AS INTEGER) END) AS b FROM m GROUP BY id),
k AS (SELECT count(*) AS n, avg(CAST(g = b AS INTEGER)) AS po, avg(g) AS a, avg(b) AS b FROM p WHERE g IS NOT NULL AND b IS NOT NULL)
SELECT 'wholly_recalled' AS field, n, round(po, 6) AS agreement, CASE WHEN a * b + (1 - a) * (1 - b) < 1 THEN round((po - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 3) END AS kappa FROM k""",
    "metric_correlation": A + 'SELECT path, count(*) AS n, round(corr(recall, "precision"), 6) AS pearson FROM m WHERE recall IS NOT NULL GROUP BY path',
    "metric_flips": A + ", t AS (SELECT path, id, tag, max(CAST(exact = 1 AS INTEGER)) AS ok FROM m WHERE tag IS NOT NULL GROUP BY ALL) SELECT t.path, n.tag AS base_tag, t.tag, count(*) AS questions, count(*) FILTER (WHERE n.ok = 1 AND t.ok = 0) AS regressions, count(*) FILTER (WHERE n.ok = 0 AND t.ok = 1) AS gains FROM t JOIN t n ON n.id = t.id AND n.path = t.path AND n.tag <> t.tag GROUP BY ALL",
    "metric_arms": A + """, t AS (SELECT path, id, tag, avg(recall) AS recall, avg("precision") AS "precision", avg(exact) AS exact FROM m WHERE tag IS NOT NULL GROUP BY ALL), u AS (SELECT path, id, tag, field, value FROM (UNPIVOT t ON recall, "precision", exact INTO NAME field VALUE value))
SELECT a.path, a.field, a.tag AS first, b.tag AS second, count(*) AS n, round(avg(CASE WHEN abs(a.value - b.value) < 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS agreement, round(avg(abs(a.value - b.value)), 6) AS mean_apart, round(max(abs(a.value - b.value)), 6) AS most_apart, round(avg(CASE WHEN abs(a.value - b.value) <= 0.1 + 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS within_tenth FROM u a JOIN u b ON a.path = b.path AND a.id = b.id AND a.field = b.field AND a.tag < b.tag GROUP BY ALL""",
    "metric_differs": A + ", g AS (SELECT id, list(DISTINCT trim(answer, ' ')) FILTER (WHERE path = 'graph' AND answer IS NOT NULL) AS g, list(DISTINCT trim(answer, ' ')) FILTER (WHERE path = 'baseline' AND answer IS NOT NULL) AS b FROM (SELECT answer_id, any_value(id) AS id, any_value(path) AS path, any_value(answer) AS answer FROM answers GROUP BY answer_id) GROUP BY id) SELECT count(*) AS questions, count(*) FILTER (WHERE NOT list_has_any(g, b)) AS differ FROM g WHERE len(g) > 0 AND len(b) > 0",
    "metric_pivot": A + ", q AS (SELECT id, any_value(regexp_replace(lower(trim(category)), '[ -]+', '_', 'g')) AS category FROM holdout_hard_set GROUP BY id) SELECT category, round(avg(CAST(exact = 1 AS INTEGER)) FILTER (WHERE path = 'graph'), 6) AS graph, round(avg(CAST(exact = 1 AS INTEGER)) FILTER (WHERE path = 'baseline'), 6) AS baseline FROM m JOIN q USING (id) GROUP BY category",
    "metric_headline": A + 'SELECT coalesce(tag, \'none\') AS run, path, count(*) FILTER (WHERE exact = 1) AS k, count(*) AS n, round(coalesce(avg(recall), 0), 6) AS recall, round(coalesce(avg("precision"), 0), 6) AS "precision" FROM m GROUP BY ALL',
    "metric_winner": A + """, t AS (SELECT path, tag, list_distinct(gold) AS g, list_filter(found, lambda x, i: list_position(found, x) = i)[1:10] AS top FROM j WHERE tag IS NOT NULL), h AS (SELECT path, tag, g, list_filter(list_transform(top, lambda x, i: CASE WHEN list_contains(g, x) THEN i END), lambda r: r IS NOT NULL) AS h FROM t),
r AS (SELECT path, tag, round(avg(CASE WHEN len(g) > 0 THEN len(h) / len(g) ELSE 0.0 END), 6) AS r, round(avg(CASE WHEN len(h) > 0 THEN 1.0 / list_min(h) ELSE 0.0 END), 6) AS m FROM h GROUP BY ALL), b AS (SELECT path, max((r, m, tag)) AS b FROM r GROUP BY path) SELECT path, b[3] AS winner, b[1] AS recall_at_10, b[2] AS mrr_at_10 FROM b""",
    "metric_clustered": A + "SELECT CASE WHEN starts_with(id, 'hh_') THEN 'holdout' ELSE 'mini' END AS question_set, path, count(*) AS n, round(avg(coalesce(recall, 1.0)), 6) AS recall, round(avg(CASE WHEN len(found) > 0 THEN least(len(list_filter(gold, lambda g: len(list_filter(found, lambda c: c = g OR starts_with(c, g || '(') OR starts_with(g, c || '('))) > 0)) / len(found), 1.0) ELSE 0.0 END), 6) AS \"precision\" FROM m GROUP BY ALL",
    "metric_baseline_hits": A + r""", b AS (SELECT a.answer_id, a.path, g.gold, a.context_blocks AS bl FROM ans a JOIN gold g USING (id) WHERE a.context_blocks IS NOT NULL AND len(g.gold) > 0), p AS (SELECT answer_id, path, g, i, CASE WHEN contains(g, '::def::') THEN contains(lower(coalesce(x.text, '')), '“' || lower(split_part(g, '::def::', 2)) || '”') OR contains(lower(coalesce(x.citation, '')), '“' || lower(split_part(g, '::def::', 2)) || '”')
  ELSE coalesce(h <> '' AND (h = n OR starts_with(h, n || '(') OR starts_with(n, h || '(')), false) END AS hit FROM (SELECT answer_id, path, unnest(gold) AS g, bl FROM b) y, LATERAL (SELECT unnest(range(len(bl))) AS i, unnest(bl) AS x), LATERAL (SELECT regexp_extract(coalesce(x.citation, ''), '§\s*(\d{1,2}\.\d{1,2}(?:\([a-z0-9]+\))*)', 1) AS h, split_part(g, '::', 2) AS n))
SELECT path, count(*) AS n, round(avg(r), 6) AS recall, round(avg(p), 6) AS "precision" FROM (SELECT b.path, coalesce((SELECT count(DISTINCT g) FROM p WHERE p.answer_id = b.answer_id AND hit), 0) / len(list_distinct(gold)) AS r, CASE WHEN len(bl) > 0 THEN (SELECT count(DISTINCT i) FROM p WHERE p.answer_id = b.answer_id AND hit) / len(bl) END AS p FROM b) GROUP BY path""",
    "metric_indexing": "WITH sec AS (SELECT DISTINCT id, number, title, text, document_id, level, pos FROM sections), w AS (SELECT document_id, coalesce(sum(len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> ''))), 0) AS words FROM sec GROUP BY document_id) SELECT document_id, CAST(words AS BIGINT) AS words, round(words / 500, 4) AS pages FROM w",
    "rerank_blocks": A + f""", b AS (SELECT answer_id AS qid, question, unnest(range(len(context_blocks))) AS pos, unnest(context_blocks) AS b FROM ans),
g AS (SELECT qid, pos, list_filter(list_distinct(regexp_extract_all(lower(question), '[a-z0-9.$%()]+')), lambda w: len(w) > 2 AND w NOT IN ({_STOP})) AS c, list_distinct(regexp_extract_all(lower(coalesce(b.text, '')), '[a-z0-9.$%()]+')) AS t FROM b),
s AS (SELECT qid, CAST(pos AS INTEGER) AS pos, round(CASE WHEN len(c) = 0 THEN 1.0 ELSE len(list_intersect(c, t)) / len(c) END, 6) AS score FROM g)
SELECT * FROM (SELECT qid, pos, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS INTEGER) AS rank FROM s) WHERE rank <= 3""",
    "pack_blocks": "WITH RECURSIVE" + A[4:] + f""", b AS (SELECT answer_id, unnest(range(1, len(context_blocks) + 1)) AS k, unnest(context_blocks) AS b FROM ans),
f AS (SELECT answer_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, false AS done, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS chars FROM ans
  UNION ALL SELECT answer_id, k, CASE WHEN stop THEN used ELSE used + hdr + l + 34 END, stop, CASE WHEN stop THEN n ELSE n + 1 END, CASE WHEN stop THEN chars ELSE chars + l END
  FROM (SELECT f.answer_id, b.k, f.used, f.n, f.chars, len(coalesce(b.b.citation, '')) AS hdr, f.done OR {BUDGET} - f.used - len(coalesce(b.b.citation, '')) - 34 < 180 AS stop,
    CASE WHEN len(coalesce(b.b.text, '')) > {BUDGET} - f.used - len(coalesce(b.b.citation, '')) - 34 THEN len(regexp_replace(left(coalesce(b.b.text, ''), {BUDGET} - f.used - len(coalesce(b.b.citation, '')) - 54), '\\s+$', '')) + 13 ELSE len(coalesce(b.b.text, '')) END AS l
    FROM f JOIN b ON b.answer_id = f.answer_id AND b.k = f.k + 1) x)
SELECT answer_id, CAST(arg_max(n, k) AS INTEGER) AS blocks, CAST(arg_max(chars, k) AS INTEGER) AS chars FROM f GROUP BY answer_id""",
}
