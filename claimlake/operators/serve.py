"""Serving: ranked relations, listings, counts, audits, report cases, deletes and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimlake.functions import columns as C

# Dimensions in the order in which a report looks for reconciled cases.
CASE_ORDER = "consolidation vintage price_basis publication adjustment aggregation period".split()
# Currency names, which are notation and not scale.
CURRENCY_WORDS = "rs inr usd us eur gbp".split()
# Units whose facts compare with nothing in other documents.
INCOMPARABLE = "count unknown".split()


def support(facts: DataFrame) -> DataFrame:
    """``(concept_id, n)``: facts of each concept."""
    return facts.where(F.length("concept_id") > 0).groupBy("concept_id").agg(F.count("*").alias("n"))


def top_concepts(concepts: DataFrame, facts: DataFrame, limit: int) -> DataFrame:
    """Concepts by facts, those without facts included; ties by id."""
    counted = concepts.join(support(facts), "concept_id", "left").withColumn("n_facts", F.coalesce("n", F.lit(0)))
    return counted.select("concept_id", "label", "n_facts").orderBy(F.desc("n_facts"), "concept_id").limit(limit)


def documents_listing(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """Documents with their number of facts, latest load first; ties by id."""
    counts = facts.groupBy("doc_id").agg(F.count("*").alias("n_facts"))
    listed = documents.join(counts, "doc_id", "left").withColumn("n_facts", F.coalesce("n_facts", F.lit(0)))
    return listed.select("doc_id", "title", "collection", "n_pages", "ingested_at", "n_facts").orderBy(F.desc("ingested_at"), "doc_id")


def words(key: Column) -> Column:
    return F.size(F.split(key, " "))


def joined_relations(relations: DataFrame, facts: DataFrame, documents: DataFrame) -> DataFrame:
    """The star join of relations with both facts, both documents and both concepts' support, and the rank ``weight``.

    Facts are narrowed to what ranking and filters read before they meet the relations.
    """
    docs = documents.select("doc_id", "collection")
    sup = support(facts)
    f = facts.select("fact_id", "doc_id", "page_no", "metric_key", "concept_id").join(docs, "doc_id").join(sup, "concept_id", "left")
    side = lambda p: f.select(*(F.col(c).alias(f"{p}_{c}") for c in ("fact_id", "doc_id", "page_no", "metric_key", "n", "collection")))
    joined = relations.join(side("l"), F.col("left_id") == F.col("l_fact_id")).join(side("r"), F.col("right_id") == F.col("r_fact_id"))
    reach = lambda p: F.least(F.coalesce(f"{p}_n", F.lit(1)), F.lit(12)) * F.least(words(F.coalesce(f"{p}_metric_key", F.lit(""))), F.lit(3))
    return joined.withColumn("weight", F.col("confidence") * reach("l") * reach("r"))


def ranked(joined: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of relations by weight, then confidence, then id."""
    return joined.orderBy(F.desc("weight"), F.desc("confidence"), "relation_id").offset(offset).limit(limit)


def filtered(joined: DataFrame, kind: str | None = None, collection: str | None = None, cross_document: bool | None = None, dimension: str | None = None, fact_id: str | None = None) -> DataFrame:
    """Only the filters given are applied."""
    if kind is not None:
        joined = joined.where(F.col("relation") == kind)
    if collection is not None:
        joined = joined.where(F.col("l_collection") == collection)
    if cross_document is not None:
        differs = F.col("l_doc_id") != F.col("r_doc_id")
        joined = joined.where(differs if cross_document else ~differs)
    if dimension is not None:
        joined = joined.where(F.array_contains("dimensions", dimension))
    if fact_id is not None:
        joined = joined.where((F.col("left_id") == fact_id) | (F.col("right_id") == fact_id))
    return joined


def relation_counts(relations: DataFrame, facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Relations of each kind and collection of the left document."""
    of = facts.select("fact_id", "doc_id").join(documents.select("doc_id", "collection"), "doc_id").select(F.col("fact_id").alias("left_id"), "collection")
    return relations.join(of, "left_id").groupBy("collection", "relation").agg(F.count("*").alias("n"))


def stats(documents: DataFrame, pages: DataFrame, facts: DataFrame, concepts: DataFrame, relations: DataFrame) -> DataFrame:
    """``(measure, n)`` of every table, relation kind and collection."""
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n")
    out = count(documents, "documents")
    for name, df in (("pages", pages), ("facts", facts), ("concepts", concepts), ("relations", relations)):
        out = out.unionByName(count(df, name))
    out = out.unionByName(relations.groupBy(F.concat(F.lit("relation "), "relation").alias("measure")).agg(F.count("*").alias("n")))
    return out.unionByName(documents.groupBy(F.concat(F.lit("collection "), "collection").alias("measure")).agg(F.count("*").alias("n")))


def diagnostics(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """The self-audit: facts without a period, with one-word metrics, with units that compare with nothing; reordered pages."""
    audit = facts.agg(
        F.count("*").alias("n_facts"),
        F.count_if(F.length(F.coalesce("period_label", F.lit(""))) == 0).alias("no_period"),
        F.count_if(~F.coalesce("metric_key", F.lit("")).contains(" ")).alias("one_word_metric"),
        F.count_if(F.col("unit").isin(INCOMPARABLE)).alias("incomparable_unit"),
    )
    return audit.crossJoin(F.broadcast(pages.agg(F.count_if(F.col("n_columns") > 1).alias("reordered_pages"), F.count("*").alias("n_pages"))))


def weakest_contradictions(relations: DataFrame, facts: DataFrame, limit: int = 3) -> DataFrame:
    """Contradictions with the shortest metric, the most confident first among equals."""
    keys = facts.select(F.col("fact_id").alias("left_id"), "metric_key")
    found = relations.where("relation = 'contradicts'").join(keys, "left_id").withColumn("n_chars", F.length("metric_key"))
    return found.select("relation_id", "metric_key", "n_chars", "confidence").orderBy("n_chars", F.desc("confidence"), "relation_id").limit(limit)


def delete_documents(gone: DataFrame, facts: DataFrame, relations: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts, relations and pages that remain once documents ``gone(doc_id)`` are deleted; concepts stay."""
    kept = facts.join(gone, "doc_id", "left_anti")
    dead = facts.join(gone, "doc_id", "left_semi").select("fact_id")
    left = relations.join(dead.withColumnRenamed("fact_id", "left_id"), "left_id", "left_anti").join(dead.withColumnRenamed("fact_id", "right_id"), "right_id", "left_anti")
    return kept, left, pages.join(gone, "doc_id", "left_anti")


def content_dedup(documents: DataFrame) -> DataFrame:
    """The first load of each content, across collections: ``(sha256, doc_id, ingested_at)``; ties by id."""
    return documents.where("sha256 is not null").groupBy("sha256").agg(F.min(F.struct("ingested_at", "doc_id")).alias("f")).select("sha256", "f.doc_id", "f.ingested_at")


def unseen(arriving: DataFrame, stored: DataFrame) -> DataFrame:
    """Arriving documents whose bytes are not stored yet, each content once."""
    return arriving.join(stored.select("sha256").distinct(), "sha256", "left_anti").dropDuplicates(["sha256"])


def export_slices(joined: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """The best relations of each kind for export, those across documents first: ``(relation, place, relation_id)``."""
    across = (F.col("l_doc_id") != F.col("r_doc_id")).cast("int")
    w = Window.partitionBy("relation").orderBy(F.desc(across), F.desc("weight"), F.desc("confidence"), "relation_id")
    size = F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv))
    return joined.withColumn("place", F.row_number().over(w)).where(F.col("place") <= F.element_at(size, F.col("relation"))).select("relation", "place", "relation_id")


def clarity() -> Column:
    """How clear a conflict reads: 1 across documents, 2 on other pages of one document, 0 on one page, 3 where unknown."""
    one_doc = F.col("l_doc_id") == F.col("r_doc_id")
    return F.when(F.col("l_doc_id").isNull() | F.col("r_doc_id").isNull(), 3).when(~one_doc, 1).when(F.col("l_page_no") == F.col("r_page_no"), 0).otherwise(2)


def scale_words(display: Column) -> Column:
    """Words of a display that are no currency, in order: what tells its scale and unit."""
    words = F.transform(F.split(F.trim(display), r"[\s\u00a0\u2009\u202f]+"), F.lower)
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w.rlike(r"^\p{L}+$") & ~w.isin(CURRENCY_WORDS))))


def _by_rank() -> list[Column]:
    return [F.desc("weight"), F.desc("confidence"), F.col("relation_id")]


def report_corroboration(joined: DataFrame, facts: DataFrame, pool: int = 40) -> DataFrame:
    """The corroboration to show: of the best across documents, a value bridge in other scale words, else a bridge, else the first."""
    best = ranked(filtered(joined, "corroborates", cross_document=True), pool)
    shown = facts.select("fact_id", "display")
    with_display = best.join(shown.select(F.col("fact_id").alias("left_id"), F.col("display").alias("ld")), "left_id").join(shown.select(F.col("fact_id").alias("right_id"), F.col("display").alias("rd")), "right_id")
    differs = F.when((F.col("basis") == "value_bridge") & (scale_words(F.col("ld")) != scale_words(F.col("rd"))), 0).when(F.col("basis") == "value_bridge", 1).otherwise(2)
    return with_display.withColumn("choice", differs).orderBy("choice", *_by_rank()).limit(1).select("relation_id", "choice")


def _with_plausible(joined: DataFrame, facts: DataFrame) -> DataFrame:
    """Adds ``plausible``: both values are known, not zero, and within a ratio of five."""
    v = facts.select("fact_id", F.abs("value").alias("v"))
    valued = joined.join(v.toDF("left_id", "lv"), "left_id", "left").join(v.toDF("right_id", "rv"), "right_id", "left")
    near = (F.col("lv") > 0) & (F.col("rv") > 0) & (F.greatest("lv", "rv") <= F.least("lv", "rv") * 5)
    return valued.withColumn("plausible", F.coalesce(near, F.lit(False)))


def _clearest() -> list[Column]:
    """In one wording first, then the clearest, then by rank."""
    return [F.desc(F.col("l_metric_key").eqNullSafe(F.col("r_metric_key"))), clarity(), *_by_rank()]


def report_contradiction(joined: DataFrame, facts: DataFrame, pool: int = 60) -> DataFrame:
    """The contradiction to show: of the best across documents, or of all where there is none, a plausible and clear one."""
    kind = filtered(joined, "contradicts").withColumn("across", (F.col("l_doc_id") != F.col("r_doc_id")).cast("int"))
    best = kind.orderBy(F.desc("across"), *_by_rank()).limit(pool)
    return _with_plausible(best, facts).orderBy(F.desc("across"), F.desc("plausible"), *_clearest()).limit(1).select("relation_id", "across")


def report_reconciled(joined: DataFrame, facts: DataFrame, top: int = 3, pool: int = 60) -> DataFrame:
    """Up to three reconciled pairs, for the first dimensions that have one: plausible pairs differing on it alone go first.

    A pair shown for one dimension is not shown for a later one, which then goes without.
    """
    place = F.create_map(*(F.lit(x) for i, d in enumerate(CASE_ORDER) for x in (d, i)))
    rows = filtered(joined, "reconciled_by_context").withColumn("dimension", F.explode(F.array_distinct("dimensions")))
    rows = rows.withColumn("place", F.try_element_at(place, F.col("dimension"))).where("place is not null")
    rows = rows.withColumn("rk", F.row_number().over(Window.partitionBy("place").orderBy(*_by_rank()))).where(F.col("rk") <= pool)
    tier = F.when(F.col("plausible") & (F.size("dimensions") == 1), 0).when(F.col("plausible"), 1).otherwise(2)
    chosen = _with_plausible(rows, facts).withColumn("n", F.row_number().over(Window.partitionBy("place").orderBy(tier, *_clearest()))).where("n = 1")
    once = chosen.groupBy("relation_id").agg(F.min(F.struct("place", "dimension")).alias("p")).select("relation_id", "p.*")
    return once.orderBy("place").limit(top).select("dimension", "relation_id")


def fact_json(facts: DataFrame) -> DataFrame:
    """Facts as nested objects in JSON, value offsets counted within the evidence."""
    context = F.map_from_entries(F.array_sort(F.map_entries(F.coalesce("context", F.create_map().cast("map<string,string>")))))
    body = F.struct(
        F.col("fact_id").alias("id"),
        F.struct("doc_id", "page_no").alias("source"),
        F.struct("metric", "subject", "display", "unit").alias("claim"),
        F.struct(F.col("evidence").alias("text"), (F.col("value_start") - F.col("char_start")).alias("value_start"), (F.col("value_end") - F.col("char_start")).alias("value_end")).alias("evidence"),
        F.struct(F.col("period_label").alias("label"), F.col("period_kind").alias("kind")).alias("period"),
        context.alias("context"),
    )
    return facts.select("fact_id", F.to_json(body).alias("body"))


def other_sides(fact_ids: DataFrame | None, relations: DataFrame, facts: DataFrame) -> DataFrame:
    """For each wanted fact (every fact for None) its relations with the fact on the other side: ``(fact_id, relation_id, relation, other_id, other_display)``."""
    ends = relations.select("relation_id", "relation", F.explode(F.array(F.struct(F.col("left_id").alias("fact_id"), F.col("right_id").alias("other_id")), F.struct(F.col("right_id").alias("fact_id"), F.col("left_id").alias("other_id")))).alias("e")).select("relation_id", "relation", "e.*")
    wanted = ends if fact_ids is None else ends.join(fact_ids.distinct(), "fact_id", "left_semi")
    return wanted.join(facts.select(F.col("fact_id").alias("other_id"), F.col("display").alias("other_display")), "other_id").select("fact_id", "relation_id", "relation", "other_id", "other_display")


def refiner_candidates(facts: DataFrame, generic: list[str], limit: int = 200) -> DataFrame:
    """Weak facts a refiner should look at: unsure, thinly or generically named, or undated; the weakest first."""
    key = F.coalesce("metric_key", F.lit(""))
    vague = F.size(F.array_except(F.split(key, " "), F.array(*map(F.lit, generic)))) == 0
    weak = facts.withColumn("n_words", F.when(F.length(key) > 0, words(key)).otherwise(0)).where((F.col("confidence") < 0.85) | (F.col("n_words") < 2) | (F.length(F.coalesce("period_label", F.lit(""))) == 0) | vague)
    return weak.orderBy("n_words", "confidence", "fact_id").limit(limit).select("fact_id", "n_words", "confidence")


def alias_votes(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored votes and one more for each pair of this run: ``(left_key, right_key, votes)``."""
    one = new.select("left_key", "right_key", F.lit(1).cast("long").alias("votes"))
    return stored.select("left_key", "right_key", F.col("votes").cast("long").alias("votes")).unionByName(one).groupBy("left_key", "right_key").agg(F.sum("votes").alias("votes"))


def promoted(votes: DataFrame, least: int = 2) -> DataFrame:
    return votes.where(F.col("votes") >= least).select("left_key", "right_key")
