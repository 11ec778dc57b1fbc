"""From question to context: seeds, expansion, search, blocks and the packed prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexloom.operators import amendments, blocks, build, graph, metrics, models, retrieval, seeding, vectors
from codexloom.operators import text as words
from codexloom.operators.asknown import as_known
from codexloom.plans.graph import HOP_TYPES, links
from codexloom.plans.temporal import OPS as _OPS_SQL
from codexloom.plans.temporal import amend_operations
from codexloom.runtime import cut_lineage, skew_join, table

#: Provisions to expand around, candidates kept of them, and steps to terms that a term uses.
TOP_N, KEEP, CLOSURE, TOP_K, HOPS = 6, 8, 1, 10, 6


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, question, as_of) of the large set, each once."""
    return table(spark, sf, "holdout_hard_set").select(F.col("id").alias("qid"), "question", "as_of").dropDuplicates(["qid"])


def companies(spark: SparkSession, sf: str) -> DataFrame:
    f = build.filings(spark, sf).where("doc_type = 'base'")
    return f.select("agreement_id", F.regexp_replace("name", r"\s+Credit Agreement\s*$", "").alias("company"))


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    """The questions with the base document of the agreement that they name, if any."""
    q = _questions(spark, sf)
    own = seeding.agreements(q, companies(spark, sf))
    return q.join(own, "qid", "left").withColumn("document_id", F.concat("agreement_id", F.lit(".base")))


def _amends(spark: SparkSession, sf: str, said: DataFrame | None = None) -> DataFrame:
    return graph.amends_targets(build.amend_edges(spark, sf, said))


def _seeds(spark: SparkSession, sf: str, placed: DataFrame | None = None, dense: int = 0, defs: DataFrame | None = None, said: DataFrame | None = None) -> DataFrame:
    q = cut_lineage(_placed(spark, sf)) if placed is None else placed
    defs = build.definitions(spark, sf) if defs is None else defs
    parts = [seeding.cited(q, build.outline(spark, sf)), seeding.named_terms(q, defs)]
    # What is near comes last; where it lies in an amendment, what that amends follows.
    return seeding.seeds([*parts, *([_dense(spark, sf, q, dense, defs)] if dense else [])], _amends(spark, sf, said))


def _dense(spark: SparkSession, sf: str, q: DataFrame, k: int, defs: DataFrame) -> DataFrame:
    """(qid, node, pos): the first k provisions among the 3k chunks nearest to each question."""
    hits = models.nearest_chunks(q.select("qid", "question").where("question IS NOT NULL"), _chunks(spark, sf).select("id", "text"), 3 * k, texts=False)
    known = build.outline(spark, sf).select("id").unionByName(defs.select("id")).distinct()
    own = hits.withColumn("node", F.regexp_replace("id", r"::p\d+$", "")).drop("id").join(known.withColumnRenamed("id", "node"), "node", "left_semi")
    return vectors.first_nodes(own, F.col("node"), k).select("qid", "node", F.col("rank").alias("pos"))


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return build.vertices(spark, sf).select(F.col("id").alias("node_id"), "label").dropDuplicates(["node_id"])


def question_agreements(spark: SparkSession, sf: str) -> DataFrame:
    return seeding.agreements(_questions(spark, sf), companies(spark, sf))


def question_gates(spark: SparkSession, sf: str) -> DataFrame:
    return _questions(spark, sf).select("qid", *[c.alias(k) for k, c in seeding.gates(F.col("question")).items()])


def amend_ops(spark: SparkSession, sf: str) -> DataFrame:
    """Every amending clause, its target resolved in the agreement's base document."""
    return build.clauses(spark, sf).select("document_id", "target_kind", "target", "op", "source_sec_id", "node_id", "made", F.md5("new_text").alias("new_text"))


def seeds_union(spark: SparkSession, sf: str) -> DataFrame:
    return _seeds(spark, sf)


def seeds_expanded(spark: SparkSession, sf: str) -> DataFrame:
    seeds = cut_lineage(_seeds(spark, sf))
    hops, _ = links(spark, sf, seeds)
    return retrieval.expand(seeds, hops, HOPS)


def stage2_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Siblings and neighbours of the first seeds that are no seeds themselves."""
    seeds = cut_lineage(_seeds(spark, sf))
    hops, siblings = links(spark, sf, seeds, limit=None)
    near = retrieval.stage2(seeds.where(F.col("pos") < TOP_N), siblings, hops)
    return near.join(seeds.select("qid", "node"), ["qid", "node"], "left_anti")


def _roots(seeds: DataFrame, defs: DataFrame) -> DataFrame:
    """The defined terms among the seeds: (qid, node, pos, term)."""
    d = defs.select(F.col("id").alias("node"), "term")
    return seeds.join(d, "node").select("qid", "node", "pos", "term")


def block_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    ops = amend_operations(spark, sf).withColumn("agreement_id", F.substring_index("node_id", ".", 1))
    got = blocks.catalogue(ops, _labels(spark, sf), "agreement_id")
    return got.select("agreement_id", "operations", "text", F.array_join("node_ids", " ").alias("nodes"))


def block_dependents(spark: SparkSession, sf: str) -> DataFrame:
    """Everything that depends on each provision or defined term."""
    v = build.vertices(spark, sf).where(F.col("node_type").isin(*graph.TEXT_TYPES))
    roots = v.select(F.lit("").alias("qid"), F.col("id").alias("node"), F.col("label").alias("term")).dropDuplicates(["node"])
    got = blocks.dependents(roots, graph.inbound_dependents(build.edges(spark, sf)), _labels(spark, sf))
    return got.select("node", "citation", "text", F.array_join("node_ids", " ").alias("nodes"))


def block_components(spark: SparkSession, sf: str) -> DataFrame:
    """Changes to what each question's gold nodes refer to or are computed from."""
    gold = table(spark, sf, "holdout_hard_set").select(F.col("id").alias("qid"), "as_of", F.explode("gold").alias("node")).distinct()
    uses = build.edges(spark, sf).where("edge_type IN ('REFERENCES', 'DEPENDS_ON')").select("src", "dst")
    return blocks.components(gold, uses, amend_operations(spark, sf), _labels(spark, sf))


def _history_uses(edges: DataFrame) -> DataFrame:
    return edges.where("edge_type IN ('REFERENCES', 'DEPENDS_ON') AND contains(dst, '::def::')").select("src", "dst")


def block_history(spark: SparkSession, sf: str) -> DataFrame:
    """Operations in force on the first three seeds of each question and the terms they use."""
    placed = cut_lineage(_placed(spark, sf))
    seeds = _seeds(spark, sf, placed).where("pos < 3").join(placed.select("qid", "as_of"), "qid").select("qid", "node", "as_of", F.col("pos").alias("rank"))
    return blocks.histories(cut_lineage(seeds), _history_uses(build.edges(spark, sf)), amend_operations(spark, sf), _labels(spark, sf))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """(version_id, text, citation) of the versions that have a text."""
    v = table(spark, sf, "effective").groupBy("version_id").agg(F.max("text").alias("text"), F.max("citation").alias("citation"))
    return cut_lineage(v.where("text IS NOT NULL AND trim(text) != ''"))


def _known(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    """``rows`` (qid, node, as_of, ...) with ``version_id``, the version known on the day; rows without one are dropped."""
    # Both sides are read several times below, so their plans end here and stay small.
    rows = cut_lineage(rows)
    known = cut_lineage(as_known(rows, table(spark, sf, "effective"), "node"))
    return skew_join(rows, known.withColumnRenamed("node_id", "node"), ["node", "as_of"])


def _text_as_of(spark: SparkSession, sf: str, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` (qid, node, as_of, ...) with the text and citation known on the day.

    A text goes once to each task that needs it and is never shuffled with the rows.
    """
    return _known(spark, sf, rows).join(texts, "version_id")


def _one(block: DataFrame, order: int, ids: Column) -> DataFrame:
    return block.select("qid", F.lit(order).alias("grp"), F.lit(0).cast("long").alias("pos"), F.lit(0).alias("part"), F.struct(F.col("citation"), F.col("text"), ids.cast("array<string>").alias("node_ids"), F.lit(True).alias("reserved")).alias("b"))


def answer_blocks(spark: SparkSession, sf: str, scorer: models.Scorer | None = None, history: bool = False, conflicts: DataFrame | None = None, split: bool = False, dense: int = 5) -> DataFrame:
    """(qid, question, as_of, blocks): all blocks of each question in the order of packing.

    Reserved are the lists that the question calls for, its seeds and the terms they are
    computed from, and the best siblings and neighbours of seeds and of the ranked
    provisions, half each. The ranked provisions and the other neighbours fill the rest.
    ``scorer`` rates (question, text); without one the share of the question's words counts.
    ``dense`` provisions near to the question are seeds too, after those that it names.
    """
    score = scorer or models.lexical_scorer
    placed = cut_lineage(_placed(spark, sf))
    q = placed.select("qid", "question", "as_of", "agreement_id")
    # What vertices, edges and seeds are all made of.
    defs, said = cut_lineage(build.definitions(spark, sf)), cut_lineage(build.clauses(spark, sf).drop("new_text"))
    v, e, texts = cut_lineage(build.vertices(spark, sf, defs, said)), cut_lineage(build.edges(spark, sf, defs, said)), _texts(spark, sf)
    seeds = cut_lineage(_seeds(spark, sf, placed, dense, defs, said))
    roots = cut_lineage(_roots(seeds, defs))
    uses = e.where("edge_type = 'DEPENDS_ON'").select("src", "dst")
    closed = roots.join(graph.closure(uses, roots.select(F.col("node").alias("root")).distinct(), CLOSURE).select("root", F.col("node").alias("dep")), F.col("node") == F.col("root")).select("qid", F.col("dep").alias("node"), "pos")
    closed = cut_lineage(closed)
    hops = graph.hop_neighbors(v, e, HOP_TYPES, seeds.select("node"), limit=HOPS)
    start = cut_lineage(retrieval.ordered_union([retrieval.expand(seeds, hops, HOPS), closed]))
    text = v.where(F.col("node_type").isin(*graph.TEXT_TYPES)).select("id")
    walked = graph.ordered_dfs(start, e, text, max_depth=2, max_nodes=40)
    day = q.select("qid", "question", "as_of")
    when = q.select("qid", "as_of")

    def scored(rows: DataFrame) -> DataFrame:
        """``rows`` (qid, node, pos, ...) that have a text on their day, rated by it; the texts stay behind."""
        asked = _known(spark, sf, rows.join(when, "qid")).drop("as_of").join(q.select("qid", "question"), "qid").join(texts.select("version_id", "text"), "version_id")
        return cut_lineage(score(asked).select(*rows.columns, "score"))

    ranked = cut_lineage(retrieval.rerank(scored(walked.select("qid", "node", "pos")), TOP_K).select("qid", "node", "rank"))
    # Second stage: two pools of candidates, each with its own share of what is kept.
    evidence = ranked.select("qid", "node").unionByName(seeds.select("qid", "node")).distinct()

    centres = [seeds.where(F.col("pos") < TOP_N).select("qid", "node"), ranked.where(F.col("rank") <= TOP_N).select("qid", "node")]
    centres = cut_lineage(centres[0].withColumn("pool", F.lit(0)).unionByName(centres[1].withColumn("pool", F.lit(1))))
    around = cut_lineage(centres.select("node").distinct())
    hubs, mates = graph.hop_neighbors(v, e, HOP_TYPES, around, limit=None), graph.sibling_neighbors(v, e, limit=None, frontier=around)
    # No centre is its own candidate: all of them are evidence. What both pools hold is rated once.
    near = mates.select("node", "neighbor").unionByName(hubs.select("node", "neighbor"))
    found = centres.join(near, "node").groupBy("qid", F.col("neighbor").alias("node")).agg(F.min("pool").alias("low"), F.max("pool").alias("high"))
    pooled = scored(found.join(evidence, ["qid", "node"], "left_anti")).withColumn("pos", F.col("node"))
    picked = cut_lineage(retrieval.split_budget(pooled.where("low = 0"), pooled.where("high = 1"), KEEP))
    # Bodies: seeds and their terms, then the second stage, then what fills.
    forced = retrieval.ordered_union([seeds.select("qid", "node", "pos"), closed])
    filler = retrieval.ordered_union([ranked.select("qid", "node", F.col("rank").alias("pos")), start])
    grouped = forced.withColumn("grp", F.lit(10)).unionByName(picked.withColumn("grp", F.lit(11))).unionByName(filler.withColumn("grp", F.lit(12)))
    first = grouped.groupBy("qid", "node").agg(F.min(F.struct("grp", "pos")).alias("m")).select("qid", "node", "m.grp", "m.pos").join(when, "qid")
    ops = amend_operations(spark, sf)
    ops = cut_lineage(ops if history or split else ops.drop("new_text"))
    told = _text_as_of(spark, sf, first, texts)
    if split:
        told = cut_lineage(told)
        body = blocks.bodies(told, ops, split).join(told.select("qid", "node", "grp", "pos"), ["qid", "node"])
    else:
        body = told.withColumn("part", F.lit(0))
    rows = body.select("qid", "grp", F.col("pos").cast("long").alias("pos"), "part", F.struct(F.col("citation"), retrieval.clip(F.col("text"), blocks.BODY).alias("text"), F.array("node").alias("node_ids"), (F.col("grp") < 12).alias("reserved")).alias("b"))
    gate, labels = seeding.gates(F.col("question")), cut_lineage(v.select(F.col("id").alias("node_id"), "label").dropDuplicates(["node_id"]))
    asks = lambda k: q.where(gate[k]).select("qid")
    deps = blocks.dependents(roots.join(asks("dependents"), "qid", "left_semi"), graph.inbound_dependents(e), labels)
    cat = blocks.catalogue(ops.withColumn("agreement_id", F.substring_index("node_id", ".", 1)), labels, "agreement_id")
    cat = q.where(gate["amendments"]).select("qid", "agreement_id").join(cat, "agreement_id").withColumn("citation", F.lit(blocks.TITLES["catalogue"]))
    comp = blocks.components(roots.join(q.where(gate["components"]).select("qid", "as_of"), "qid").select("qid", "node", "as_of"), uses, ops, labels)
    comp = comp.groupBy("qid").agg(blocks.ordered(["node", "component"], F.col("text")).alias("text")).withColumn("citation", F.lit(blocks.TITLES["components"]))
    parts = [rows, _one(deps, 0, F.col("node_ids")), _one(cat, 2, F.col("node_ids")), _one(comp, 3, F.array())]
    own = e.where("edge_type = 'PARTY_TO'")
    roster = blocks.roster(amendments.roster_rows(own)).withColumn("agreement_id", F.substring_index("document_id", ".", 1))
    people = q.where(gate["parties"]).select("qid", "agreement_id").join(roster, "agreement_id").withColumn("citation", F.lit(blocks.TITLES["roster"]))
    parts.append(_one(people, 1, F.col("node_ids")))
    if history:
        back = seeds.where("pos < 3").join(q.where(gate["history"]).select("qid", "as_of"), "qid").select("qid", "node", "as_of", F.col("pos").alias("rank"))
        past = blocks.histories(back, _history_uses(e), ops, labels).withColumn("citation", F.lit(blocks.TITLES["history"]))
        parts.append(_one(past, 4, F.array()))
    if conflicts is not None:
        clash = q.where(gate["conflict"]).select("qid", "agreement_id").join(conflicts, "agreement_id").withColumn("citation", F.lit(blocks.TITLES["conflicts"]))
        parts.append(_one(clash, 5, F.array()))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.withColumn("b", F.col("b").cast(blocks.BLOCK))
    packed = every.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("grp", "pos", "part", "b"))), lambda x: x["b"]).alias("blocks"))
    return day.join(packed, "qid", "left").withColumn("blocks", F.coalesce("blocks", F.array().cast(f"array<{blocks.BLOCK}>")))


def answer_context(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: for every question the packed context, its nodes, citations and prompt.

    No model answers; that is a stub. A question without any block has an empty context.
    """
    p = answer_blocks(spark, sf).withColumn("p", retrieval.pack_reserved(F.col("blocks"), retrieval.char_budget()))
    return p.select("qid", retrieval.ids_of(F.col("p")).alias("context_ids"), F.transform("p", lambda b: b["citation"]).alias("citations"), retrieval.prompt(F.col("question"), F.col("as_of"), retrieval.context(F.col("p"))).alias("prompt"), F.lit("").alias("answer"))


def baseline_context(spark: SparkSession, sf: str) -> DataFrame:
    """The flat path: the 30 nearest chunks of each question, the best 10 of them, packed."""
    q = _questions(spark, sf)
    # Of equal ids always the same row, so that nothing is written down; one shuffle by key serves rating and packing.
    rows = table(spark, sf, "chunks").where("text IS NOT NULL").withColumn("vec_id", F.xxhash64("id")).repartition("vec_id")
    chunks = rows.groupBy("vec_id", "id").agg(F.min(F.struct("text", "document_name", "section_hint")).alias("c")).select("vec_id", "id", "c.*")
    found = models.nearest_rows(q.select("qid", "question"), chunks.select("vec_id", "text", words.said(F.col("text")).alias("said"), F.col("vec_id").alias("key")), 30)
    # Ranked without their texts: only those of the best are moved to their question.
    scored = models.lexical_scorer(found.withColumnRenamed("rank", "pos")).select("qid", "key", "pos", "score")
    best = retrieval.rerank(scored, TOP_K).join(chunks.withColumnRenamed("vec_id", "key"), "key")
    cited = F.concat("document_name", F.coalesce(F.concat(F.lit(", near §"), "section_hint"), F.lit("")))
    packed = best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.struct(cited.alias("citation"), F.col("text"), F.array("id").alias("node_ids"), F.lit(False).alias("reserved")).alias("b")))).alias("r"))
    packed = packed.select("qid", F.transform("r", lambda x: x["b"]).alias("blocks")).withColumn("p", retrieval.pack_reserved(F.col("blocks"), retrieval.char_budget()))
    return q.join(packed, "qid", "left").select("qid", retrieval.ids_of(F.col("p")).alias("context_ids"), retrieval.context(F.col("p")).alias("context"), F.lit("").alias("answer"))


#: Ways to cut sections into chunks that are compared: words, and overlap; none is by section.
CUTS = {"fixed_512_256": (512, 256), "fixed_256_64": (256, 64), "sections_512": (512, None)}


def chunking_recall(spark: SparkSession, sf: str) -> DataFrame:
    """For each way of chunking: chunks, and the share of gold among the best ten of the thirty nearest."""
    sec = build.sections(spark, sf)
    q = table(spark, sf, "mini_eval_set").select(F.col("id").alias("qid"), F.col("text").alias("question"), "gold").where("size(gold) > 0").dropDuplicates(["qid"])
    q = cut_lineage(q)
    number, out = sec.select(F.col("id").alias("section_id"), "number").dropDuplicates(["section_id"]), None
    for name, (size, overlap) in CUTS.items():
        made = words.chunk_sections(sec, size) if overlap is None else words.chunk_fixed(sec, size, overlap)
        made = cut_lineage(made.join(number, "section_id", "left").select("id", "text", F.concat(F.lit("near §"), "number").alias("citation")))
        near = models.nearest_chunks(q, made, 30).withColumnRenamed("rank", "pos")
        # What a chunk shows is told before the ranking, so that no text is shuffled for it.
        shown = models.lexical_scorer(near).withColumn("shown", F.filter("gold", lambda g: metrics.baseline_hit(g, F.col("citation"), F.col("text"))))
        best = retrieval.rerank(shown.select("qid", "pos", "score", "shown"), TOP_K)
        got = q.join(best.groupBy("qid").agg(F.flatten(F.collect_list("shown")).alias("c")), "qid", "left")
        hit = F.size(F.filter("gold", lambda g: F.array_contains("c", g)))
        row = got.agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(F.coalesce(hit, F.lit(0)) / F.size("gold")), 6).alias("recall_at_10")).crossJoin(made.agg(F.count(F.lit(1)).alias("chunks"))).withColumn("chunking", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def structure_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Structure alone: what the ordered search from the seeds reaches, the best ten, the first three seeds before them."""
    seeds = cut_lineage(_seeds(spark, sf))
    v, e = cut_lineage(build.vertices(spark, sf)), cut_lineage(build.edges(spark, sf))
    walked = graph.ordered_dfs(seeds, e, v.where(F.col("node_type").isin(*graph.TEXT_TYPES)).select("id"))
    day = cut_lineage(_questions(spark, sf))
    known = _text_as_of(spark, sf, walked.join(day, "qid"), _texts(spark, sf))
    best = retrieval.rerank(models.lexical_scorer(known), TOP_K).select("qid", "node", F.col("rank").alias("pos"))
    return retrieval.ordered_union([seeds.where("pos < 3"), best])


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("id", "text", "document_name", "section_hint").where("text IS NOT NULL").dropDuplicates(["id"])


QUERIES = {f.__name__: f for f in (question_agreements, question_gates, amend_ops, seeds_union, seeds_expanded, stage2_candidates, block_catalogue, block_dependents, block_components, block_history, answer_context, baseline_context, chunking_recall, structure_seeds)}

_W = r"[\p{L}\p{N}''’-]+"
_SAY = lambda x: f"array_to_string(regexp_extract_all(lower({x}), '{_W}'), ' ')"
_CITE = seeding.CITED_SECTION
_GENERIC = ", ".join(f"'{x}'" for x in seeding.GENERIC_TERMS)
_WEAK = ", ".join(f"'{x}'" for x in seeding.WEAK_WORDS)
#: The clauses that amend in the tables; the other families are tested on texts of their form.
_CLAUSE = r"""am0 AS (SELECT id, document_id, pos, text, unnest(regexp_extract_all(text, 'Section (\d{1,2}\.\d{1,2}(?:\([a-z0-9]+\))*) of the Credit Agreement is amended\b', 1)) AS target, unnest(regexp_extract_all(text, 'Section (\d{1,2}\.\d{1,2}(?:\([a-z0-9]+\))*) of the Credit Agreement is amended\b')) AS m,
  unnest(range(len(regexp_extract_all(text, 'Section (\d{1,2}\.\d{1,2}(?:\([a-z0-9]+\))*) of the Credit Agreement is amended\b')))) AS k FROM sec WHERE document_id NOT LIKE '%.base' AND level = 'section' AND (starts_with(number, '1.') OR regexp_matches(text, '^\s*\d+\.\d+\s+Amendment to\b'))),
am1 AS (SELECT *, substr(text, strpos(text, m), 240) AS win, substr(text, strpos(text, m) + len(m)) AS aft, row_number() OVER (PARTITION BY document_id, target ORDER BY pos, id, k) AS rk FROM am0),
aop AS (SELECT document_id, 'section' AS target_kind, target, CASE WHEN regexp_matches(win, '(?is)amended by (?:deleting|replacing)|by replacing the text in the proviso') THEN 'replace' WHEN regexp_matches(win, 'amended by (?:inserting|adding)') THEN 'insert' ELSE 'restate' END AS op, id AS source_sec_id,
  regexp_replace(document_id, '[^.]*$', '') || 'base::' || target AS node_id, md5(trim(CASE WHEN regexp_matches(aft, '(?s)^.*?(?:follows|thereof|the following|order|below)\s*[:.]') THEN regexp_replace(aft, '(?s)^.*?(?:follows|thereof|the following|order|below)\s*[:.]', '') ELSE substr(aft, 1, 2000) END, ' ')) AS new_text FROM am1 WHERE rk = 1)"""
_SEEDS = (
    _OPS_SQL
    + rf""", qq AS (SELECT id AS qid, any_value(question) AS question, any_value(as_of) AS as_of FROM holdout_hard_set GROUP BY id),
comp AS (SELECT phrase, min(agreement_id) AS agreement_id FROM (SELECT {_SAY("regexp_replace(name, '\\s+Credit Agreement\\s*$', '')")} AS phrase, agreement_id FROM filings WHERE doc_type = 'base') WHERE phrase <> '' GROUP BY phrase HAVING count(DISTINCT agreement_id) = 1),
said AS (SELECT qid, ' ' || {_SAY("question")} || ' ' AS t FROM qq),
agr AS (SELECT qid, arg_min(agreement_id, (strpos(t, ' ' || phrase || ' '), -len(phrase), agreement_id)) AS agreement_id FROM said JOIN comp ON contains(t, ' ' || phrase || ' ') GROUP BY qid),
pl AS (SELECT q.*, t, agreement_id, agreement_id || '.base' AS document_id FROM qq q JOIN said USING (qid) LEFT JOIN agr USING (qid)),
qn AS (SELECT qid, document_id, unnest(regexp_extract_all(question, '{_CITE}', 1)) AS number, unnest(range(len(regexp_extract_all(question, '{_CITE}', 1)))) AS k FROM pl),
cited AS (SELECT n.qid, arg_max(s.id, len(s.number)) AS node, 0 AS prio, n.k AS pos FROM qn n JOIN sec s ON s.document_id = n.document_id AND (s.number = n.number OR starts_with(n.number, s.number || '(')) GROUP BY n.qid, n.k),
dw AS (SELECT id, document_id, term, string_split(lower(term), ' ') AS w FROM def WHERE len(term) > 3),
dp AS (SELECT id, document_id, term, {_SAY("unnest(list_prepend(lower(term), list_filter(flatten(list_transform(range(2, len(w)), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))), lambda p: len(list_filter(string_split(p, ' '), lambda x: x NOT IN (" + _WEAK + "))) > 0)))")} AS phrase FROM dw WHERE lower(term) NOT IN ({_GENERIC})),
named AS (SELECT DISTINCT qid, id AS node, 1 AS prio, -len(term) AS pos FROM (SELECT p.qid, d.id, d.term FROM pl p JOIN dp d ON d.document_id = p.document_id AND contains(p.t, ' ' || d.phrase || ' ')
  UNION ALL SELECT p.qid, d.id, d.term FROM (SELECT qid, document_id, unnest(regexp_extract_all(question, '[“"]\s*([^”"\n]{{2,60}}?)\s*[”"]', 1)) AS x FROM pl) p JOIN dw d ON d.document_id = p.document_id AND lower(d.term) = lower(p.x))),
u AS (SELECT qid, node, min((prio, pos)) AS at_ FROM (SELECT * FROM cited UNION ALL SELECT * FROM named) GROUP BY qid, node),
seed AS (SELECT qid, node, CAST(row_number() OVER (PARTITION BY qid ORDER BY at_, node) - 1 AS INTEGER) AS pos FROM u),
hp AS (SELECT node, neighbor, row_number() OVER (PARTITION BY node ORDER BY neighbor) AS rank FROM (SELECT DISTINCT b.node, b.neighbor FROM (SELECT src AS node, dst AS neighbor, edge_type FROM edge UNION ALL SELECT dst, src, edge_type FROM edge) b JOIN vert v ON v.id = b.neighbor AND v.node_type IN ('Section', 'Definition') WHERE b.edge_type IN ('REFERENCES', 'DEPENDS_ON', 'EXCEPTION_TO')) x),
sb AS (SELECT DISTINCT a.dst AS node, b.dst AS neighbor FROM edge a JOIN edge b ON a.edge_type = 'CONTAINS' AND b.edge_type = 'CONTAINS' AND a.src = b.src AND a.dst <> b.dst JOIN vert v ON v.id = b.dst AND v.node_type = 'Section'),
lab AS (SELECT id AS node_id, any_value(label) AS label FROM (SELECT id, name AS label FROM fil UNION ALL SELECT id, '§' || number FROM sec UNION ALL SELECT id, 'definition of “' || term || '” (§1.01)' FROM def) GROUP BY id)
"""
)
_DEP = "SELECT src, dst FROM edge WHERE edge_type IN ('REFERENCES', 'DEPENDS_ON')"
ORACLE = {
    "question_agreements": _SEEDS + "SELECT qid, agreement_id FROM agr",
    "question_gates": "WITH q AS (SELECT id AS qid, lower(any_value(question)) AS x FROM holdout_hard_set GROUP BY id) SELECT qid, "
    + ", ".join(f"coalesce(regexp_matches(x, '{p}'), false) AS {k}" for k, p in seeding.GATES.items())
    + r", coalesce(regexp_matches(x, '\b(?:chang\w*|amend\w*|evolv\w*|modif\w*)\b') AND regexp_matches(x, '\b(?:rely|relies|relied|depend\w*|affect\w*)\b'), false) AS components FROM q",
    "amend_ops": _SEEDS + ", " + _CLAUSE + " SELECT document_id, target_kind, target, op, source_sec_id, node_id, node_id NOT IN (SELECT id FROM sec) AS made, new_text FROM aop",
    "seeds_union": _SEEDS + "SELECT qid, node, pos FROM seed",
    "seeds_expanded": _SEEDS + ", e AS (SELECT qid, node, pos, 0 AS k FROM seed UNION ALL SELECT s.qid, h.neighbor, s.pos, h.rank FROM seed s JOIN hp h ON h.node = s.node AND h.rank <= 6), b AS (SELECT qid, node, min((pos, k)) AS at_ FROM e GROUP BY qid, node) SELECT qid, node, CAST(row_number() OVER (PARTITION BY qid ORDER BY at_, node) - 1 AS INTEGER) AS pos FROM b",
    "stage2_candidates": _SEEDS + "SELECT DISTINCT s.qid, n.neighbor AS node FROM seed s JOIN (SELECT node, neighbor FROM hp UNION SELECT node, neighbor FROM sb) n ON n.node = s.node AND s.pos < 6 WHERE NOT EXISTS (SELECT 1 FROM seed z WHERE z.qid = s.qid AND z.node = n.neighbor)",
    "block_catalogue": _SEEDS
    + """, r AS (SELECT split_part(o.node_id, '.', 1) AS agreement_id, o.*, l.label FROM ops o JOIN lab l USING (node_id)),
i AS (SELECT agreement_id, eff, instrument, count(*) AS n, string_agg('  ' || label || ' (' || kind || ')', chr(10) ORDER BY label, seq) AS l FROM r GROUP BY ALL),
ids AS (SELECT agreement_id, node_id, min((eff, instrument)) AS m FROM r GROUP BY ALL)
SELECT agreement_id, CAST(sum(n) AS BIGINT) AS operations, 'Amendment operations in all: ' || sum(n) || '.' || chr(10) || chr(10) || string_agg(instrument || ' — effective ' || eff || ' — ' || n || ' operations:' || chr(10) || l, chr(10) || chr(10) ORDER BY eff, instrument) AS text,
  (SELECT string_agg(node_id, ' ' ORDER BY m, node_id) FROM ids x WHERE x.agreement_id = i.agreement_id) AS nodes FROM i GROUP BY agreement_id""",
    "block_dependents": _SEEDS + ", dep AS (SELECT DISTINCT e.dst AS node, e.src AS dependent, l.label FROM edge e JOIN lab l ON l.node_id = e.src WHERE edge_type IN ('REFERENCES', 'DEPENDS_ON')) SELECT node, 'Provisions that depend on “' || d.label || '” (inbound graph edges)' AS citation, string_agg(dep.label || '  [' || dependent || ']', chr(10) ORDER BY dependent) AS text, node || ' ' || string_agg(dependent, ' ' ORDER BY dependent) AS nodes FROM dep JOIN lab d ON d.node_id = node JOIN vert v ON v.id = node AND v.node_type IN ('Section', 'Definition') GROUP BY node, d.label",
    "block_components": _SEEDS
    + f""", g AS (SELECT DISTINCT id AS qid, as_of, unnest(gold) AS node FROM holdout_hard_set), c AS (SELECT DISTINCT qid, as_of, node, dst AS component FROM g JOIN ({_DEP}) ON src = node WHERE dst <> node),
o AS (SELECT qid, node, component, max((eff, seq, kind, instrument)) AS o FROM c JOIN ops ON node_id = component AND (as_of IS NULL OR eff <= as_of) GROUP BY ALL)
SELECT qid, node, component, '- ' || a.label || ' is computed from ' || b.label || ', which ' || o[4] || ' changed (' || o[3] || ', effective ' || o[1] || '); this applies wherever the first is used.' AS text FROM o JOIN lab a ON a.node_id = node JOIN lab b ON b.node_id = component""",
    "block_history": _SEEDS
    + r""", r AS (SELECT s.qid, p.as_of, s.pos AS rank, s.node FROM seed s JOIN qq p USING (qid) WHERE s.pos < 3), us AS (SELECT DISTINCT src, dst FROM edge WHERE edge_type IN ('REFERENCES', 'DEPENDS_ON') AND contains(dst, '::def::')),
b AS (SELECT qid, as_of, node, min((rank, far, root)) AS m FROM (SELECT qid, as_of, rank, 0 AS far, node AS root, node FROM r UNION ALL SELECT qid, as_of, rank, 1, node, dst FROM r JOIN us ON src = node) GROUP BY qid, as_of, node)
SELECT qid, count(*) AS operations, string_agg('- ' || l.label || CASE WHEN m[2] = 1 THEN ' — a component that ' || z.label || ' relies on' ELSE '' END || ': ' || kind || ' by ' || instrument || ', effective ' || eff || '. Change: ' || left(replace(trim(coalesce(new_text, ''), ' '), chr(10), ' '), 400), chr(10) ORDER BY m[1], m[2], node, eff, seq) AS text
FROM b JOIN ops o ON o.node_id = node AND (as_of IS NULL OR eff <= as_of) JOIN lab l ON l.node_id = node JOIN lab z ON z.node_id = m[3] GROUP BY qid""",
}
