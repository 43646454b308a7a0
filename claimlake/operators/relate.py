"""Relating facts: blocked self-joins and the context-first classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimlake.functions import columns as C
from claimlake.plans.scratch import Scratch

#: A block keeps its most confident facts, which bounds its pairs (24,090) whatever the skew of concepts.
BLOCK_CAP = 220
#: Two phrases this alike name one measure; shorter phrases than that many words are too generic for a conflict.
SAME_METRIC, CONFLICT_WORDS = 0.85, 2
BRIDGE_WORDS, ALIAS_VOTES = 6, 2
MONTHS_MATTER = 3
# Vintages that are not settled.
UNSETTLED = "projection estimate advance_estimate provisional revised target".split()
# Words too generic to tie two phrases, and suffixes that derive a measure from another.
GENERIC = "total net gross value amount number share rate growth income year change level index figure overall".split()
DERIVED = "growth rate level change averaged average".split()
# How values of context dimensions read.
READABLE = {
    "consolidation": {"standalone": "a standalone basis", "consolidated": "a consolidated basis"},
    "price_basis": {"real": "real terms", "nominal": "nominal terms"},
    "vintage": {"advance_estimate": "an advance estimate", "provisional": "a provisional figure", "revised": "a revised estimate", "projection": "a projection", "estimate": "an estimate", "target": "a target", "actual": "an actual outturn"},
    "adjustment": {"adjusted": "an adjusted figure", "restated": "a restated figure", "pro_forma": "a pro forma figure", "excluding": "an exclusive basis", "including": "an inclusive basis"},
    "aggregation": {"average": "an average", "median": "a median", "annualised": "an annualised figure", "per_capita": "a per-capita figure", "cumulative": "a cumulative total", "seasonally_adjusted": "a seasonally adjusted figure"},
    "comparison": {"yoy": "a year-on-year comparison", "qoq": "a sequential comparison", "cagr": "a compound annual rate"},
}

SIDE = ["fact_id", "doc_id", "page_no", "subject", "subject_key", "subject_source", "metric", "metric_key", "concept_id", "value", "unit", "display", "precision", "period_label", "period_start", "period_end", "context", "confidence", "published_on", "doc_label"]


def pool(facts: DataFrame, documents: DataFrame, columns: list[str] = SIDE) -> DataFrame:
    """Facts that may be compared, with what the classifier needs of their documents. Facts need a value."""
    docs = documents.select("doc_id", "collection", "published_on", C.short_label(F.col("title"), F.col("filename")).alias("doc_label"))
    kept = facts.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return kept.join(docs, "doc_id").select("collection", *columns)


def top_of_blocks(facts: DataFrame, cap: int | None = BLOCK_CAP) -> DataFrame:
    """The ``cap`` most confident facts of each (collection, concept, unit), ranked by ``rk``; ties by id.

    Spark pushes the rank limit below the shuffle, so a hot block sends at most ``cap`` rows from each task. With
    ``None`` no fact is left out: the exact way, whose pairs grow with the square of a block (:func:`beyond_cap` tells
    what the default leaves out).
    """
    w = Window.partitionBy("collection", "concept_id", "unit").orderBy(F.desc("confidence"), "fact_id")
    ranked = facts.where(F.length("concept_id") > 0).withColumn("rk", F.row_number().over(w))
    return ranked if cap is None else ranked.where(F.col("rk") <= cap)


def beyond_cap(facts: DataFrame, cap: int = BLOCK_CAP) -> DataFrame:
    """``(collection, concept_id, unit, n_facts, n_left_out, n_pairs_left_out)`` of the blocks that ``cap`` cuts.

    Pairs are counted before subjects are compared. Counts alone cross the shuffle.
    """
    n, pairs = F.col("n_facts"), lambda c: c * (c - 1) / 2
    blocks = facts.where(F.length("concept_id") > 0).groupBy("collection", "concept_id", "unit").agg(F.count("*").alias("n_facts")).where(n > cap)
    return blocks.withColumns({"n_left_out": n - cap, "n_pairs_left_out": (pairs(n) - pairs(F.lit(cap))).cast("long")})


def key_pairs(blocked: DataFrame) -> DataFrame:
    """``(l_metric_key, r_metric_key)`` of different keys that share a block, each once, from the blocks' distinct keys."""
    keys = blocked.select("collection", "concept_id", "unit", "metric_key").distinct()
    left, right = keys.withColumnRenamed("metric_key", "l_metric_key"), keys.withColumnRenamed("metric_key", "r_metric_key")
    return left.join(right, ["collection", "concept_id", "unit"]).where("l_metric_key <> r_metric_key").select("l_metric_key", "r_metric_key").distinct()


def _sides(facts: DataFrame, keys: list[str], extra: list[str]) -> tuple[DataFrame, DataFrame]:
    side = lambda p: facts.select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in [*SIDE, *extra]))
    return side("l"), side("r")


def same_subject() -> Column:
    """Subjects named in sentences must agree; those of documents never veto."""
    both = (F.col("l_subject_source") == "sentence") & (F.col("r_subject_source") == "sentence")
    return F.coalesce(~both | F.col("l_subject_key").eqNullSafe(F.col("r_subject_key")), F.lit(True))


def concept_pairs(blocked: DataFrame) -> DataFrame:
    """Ordered pairs within a block: an equi self-join on the block with a rank predicate."""
    keys = ["collection", "block_concept", "block_unit"]
    named = blocked.withColumns({"block_concept": F.col("concept_id"), "block_unit": F.col("unit")})
    left, right = _sides(named, keys, ["rk"])
    return left.join(right, keys).where((F.col("l_rk") < F.col("r_rk")) & same_subject()).drop("block_concept", "block_unit")


def differing(left: Column, right: Column) -> Column:
    """Dimensions, in order, in which two context maps differ; one that only one side states differs."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(left, empty), F.coalesce(right, empty)
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    return F.filter(keys, lambda k: ~F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k)))


def _unsettled(context: Column) -> Column:
    return F.coalesce(F.try_element_at(context, F.lit("vintage")).isin(UNSETTLED), F.lit(False))


def with_differences(pairs: DataFrame) -> DataFrame:
    """Adds ``period_rel``, ``agree``, ``gap`` and ``dims``, the recorded reasons why the two figures may differ."""
    p = lambda side, c: F.col(f"{side}_{c}")
    rel = C.period_relation(p("l", "period_label"), p("l", "period_start"), p("l", "period_end"), p("r", "period_label"), p("r", "period_start"), p("r", "period_end"))
    staged = pairs.withColumns({"period_rel": rel, "context_dims": differing(p("l", "context"), p("r", "context")), "agree": C.values_agree(p("l", "value"), p("l", "precision"), p("r", "value"), p("r", "precision")), "gap": C.value_gap(p("l", "value"), p("r", "value"))})
    period = F.when(~F.col("period_rel").isin("same", "contains", "within"), F.array(F.lit("period"))).otherwise(F.array().cast("array<string>"))
    apart = C.months_apart(p("l", "published_on"), p("r", "published_on")) >= MONTHS_MATTER
    published = (_unsettled(p("l", "context")) | _unsettled(p("r", "context"))) & F.coalesce(apart, F.lit(False)) & ~F.array_contains("context_dims", "vintage")
    late = F.when(published, F.array(F.lit("publication"))).otherwise(F.array().cast("array<string>"))
    return staged.withColumn("dims", F.concat(period, F.col("context_dims"), late)).drop("context_dims")


def key_vectors(facts: DataFrame) -> DataFrame:
    """Each distinct metric key with its words weighted by inverse document frequency over distinct keys."""
    from claimlake.operators import concepts

    keys = facts.select("metric_key").where(F.length("metric_key") > 0).distinct()
    return concepts.weighted_keys(keys)


def similarity(left: Column, right: Column) -> Column:
    """Cosine of two weighted keys (structs ``key, weights, norm``) plus a bonus for a shared last word, at most 1."""
    shared = F.array_intersect(F.map_keys(left["weights"]), F.map_keys(right["weights"]))
    dot = F.aggregate(F.array_sort(shared), F.lit(0.0), lambda acc, t: acc + F.element_at(left["weights"], t))
    head = lambda k: F.element_at(F.split(k, " "), -1)
    score = dot / F.sqrt(left["norm"] * right["norm"]) + F.when(head(left["key"]) == head(right["key"]), 0.05).otherwise(0.0)
    return F.when(F.size(shared) == 0, 0.0).otherwise(F.least(score, F.lit(1.0)))


def with_same_metric(pairs: DataFrame, vectors: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds ``same_metric``: both phrases have two words or more and are equal or alike.

    Likeness is computed once for each of ``keys`` (:func:`key_pairs`), not for each pair of facts.
    """
    n_words = lambda k: F.size(F.split(k, " "))
    v = vectors.select(F.struct("key", "weights", "norm").alias("v"))
    scored = keys.join(v.withColumnRenamed("v", "lv"), F.col("l_metric_key") == F.col("lv.key")).join(v.withColumnRenamed("v", "rv"), F.col("r_metric_key") == F.col("rv.key"))
    scored = scored.select("l_metric_key", "r_metric_key", similarity(F.col("lv"), F.col("rv")).alias("alike"))
    joined = pairs.join(scored, ["l_metric_key", "r_metric_key"], "left")
    long = F.least(n_words(F.col("l_metric_key")), n_words(F.col("r_metric_key"))) >= CONFLICT_WORDS
    same = (F.col("l_metric_key") == F.col("r_metric_key")) | F.coalesce(F.col("alike") >= SAME_METRIC, F.lit(False))
    return joined.withColumn("same_metric", F.coalesce(long & same, F.lit(False)))


def classify(pairs: DataFrame) -> DataFrame:
    """Relations of compared pairs: ``(relation_id, left_id, right_id, relation, confidence, dimensions, basis, ...)``.

    Context goes first, disagreement last; pairs that are not comparable give no row. Extra columns of the pairs stay.
    """
    nested = F.col("period_rel").isin("contains", "within")
    only_period = F.size(F.array_except("dims", F.array(F.lit("period"), F.lit("publication")))) == 0
    whole = F.when(F.col("period_rel") == "contains", F.abs("l_value")).otherwise(F.abs("r_value"))
    part = F.when(F.col("period_rel") == "contains", F.abs("r_value")).otherwise(F.abs("l_value"))
    fits = part <= whole * 1.001
    none = F.size("dims") == 0
    labelled = (F.length(F.coalesce("l_period_label", F.lit(""))) > 0) | (F.length(F.coalesce("r_period_label", F.lit(""))) > 0)
    rival = F.col("same_metric") & ~((F.col("l_doc_id") == F.col("r_doc_id")) & (F.col("l_page_no") == F.col("r_page_no")))
    relation = (
        F.when((F.col("l_unit") != F.col("r_unit")) | ~labelled, None)
        .when(nested & only_period, "part_of")
        .when(none & F.col("agree"), "corroborates")
        .when(none & rival, "contradicts")
        .when(none, None)
        .when(F.col("agree"), "consistent_across_context")
        .otherwise("reconciled_by_context")
    )
    weight = (
        F.when(F.col("relation") == "part_of", F.when(fits, 0.9).otherwise(0.7))
        .when(F.col("relation") == "corroborates", 1.0)
        .when(F.col("relation") == "contradicts", 0.9)
        .when(F.col("relation") == "consistent_across_context", 0.8)
        .otherwise(0.85)
    )
    dims = F.when(F.col("relation") == "part_of", F.array(F.lit("period"))).when(nested & (F.size("dims") > 0), F.concat(F.array(F.lit("period scope")), F.col("dims"))).otherwise(F.col("dims"))
    told = pairs.withColumn("relation", relation).where("relation is not null")
    told = told.withColumns({"confidence": C.round3(F.least("l_confidence", "r_confidence") * weight), "dimensions": dims, "basis": F.lit("concept"), "fits": fits})
    return told.withColumns({"left_id": F.col("l_fact_id"), "right_id": F.col("r_fact_id"), "relation_id": C.relation_id(F.col("l_fact_id"), F.col("r_fact_id"), F.col("relation"), F.col("basis"))})


def _readable(dimension: Column, value: Column) -> Column:
    table = F.create_map(*(F.lit(x) for d, vs in READABLE.items() for v, said in vs.items() for x in (f"{d}|{v}", said)))
    return F.coalesce(F.try_element_at(table, F.concat_ws("|", dimension, value)), value, F.lit("no stated basis"))


def explain(related: DataFrame, label: Column) -> DataFrame:
    """Adds ``explanation``, a sentence or two a reader can check against the pages cited. ``label`` names the concept."""
    t, f = F.concat, F.lit
    cite = lambda s: t(F.col(f"{s}_doc_label"), f(" p."), F.col(f"{s}_page_no").cast("string"))
    subject = F.when(F.col("l_subject_key").eqNullSafe(F.col("r_subject_key")), F.col("l_subject")).otherwise(t("l_subject", f("/"), "r_subject"))
    name = F.when(F.col("l_metric_key") == F.col("r_metric_key"), F.col("l_metric")).otherwise(F.coalesce(label, F.col("l_metric")))
    clause = F.when(F.length(F.coalesce("l_period_label", f(""))) > 0, t(f(" in "), "l_period_label")).otherwise("")
    size = F.greatest(F.abs("l_value"), F.abs("r_value"), f(1e-12))
    gap = F.when(F.col("l_unit").isin("percent", "percentage_point"), t(C.fixed2(F.col("gap")), f(" percentage points"))).otherwise(t(C.fixed2(F.lit(100.0) * F.col("gap") / size), f("%")))
    one_doc = F.col("l_doc_label") == F.col("r_doc_label")
    first, second = F.when(one_doc, f("the first statement")).otherwise(F.col("l_doc_label")), F.when(one_doc, f("the second")).otherwise(F.col("r_doc_label"))
    unstated = f("an unstated period")

    def reason(d: Column) -> Column:
        dated = lambda s: F.coalesce(F.nullif(F.col(f"{s}_period_label"), f("")), unstated)
        stated = lambda s: F.when(d == "publication", F.col(f"{s}_published_on").cast("string")).otherwise(_readable(d, F.try_element_at(F.col(f"{s}_context"), d)))
        left, right = (F.when(d == "period", dated(s)).otherwise(stated(s)) for s in ("l", "r"))
        verb = F.when(d == "period", f(" covers ")).otherwise(f(" reports "))
        return t(first, verb, left, f(" while "), second, verb, right)

    holds = F.col("period_rel") == "contains"
    inner = lambda c: F.when(holds, F.col(f"r_{c}")).otherwise(F.col(f"l_{c}"))
    outer = lambda c: F.when(holds, F.col(f"l_{c}")).otherwise(F.col(f"r_{c}"))
    inner_cite, outer_cite = F.when(holds, cite("r")).otherwise(cite("l")), F.when(holds, cite("l")).otherwise(cite("r"))
    sits = t(inner("period_label"), f(" sits inside "), outer("period_label"))
    note = F.when(F.col("fits"), f("The component does not exceed the total, as expected.")).otherwise(f("The component exceeds the total it sits inside, which one of the two figures cannot survive."))
    reasons = t(F.when(F.col("period_rel").isin("contains", "within"), t(sits, f("; "))).otherwise(""), F.array_join(F.transform("dims", reason), "; "))
    said = (
        F.when(F.col("relation") == "part_of", t(sits, f(", so "), inner("display"), f(" ("), inner_cite, f(") is a component of "), outer("display"), f(" ("), outer_cite, f(") for "), name, f(" of "), subject, f(". "), note))
        .when(F.col("relation") == "corroborates", t(cite("l"), f(" and "), cite("r"), f(" both report "), name, f(" for "), subject, clause, f(": "), "l_display", f(" and "), "r_display", f(". They differ by "), gap, f(", inside the tolerance implied by the precision each document states.")))
        .when(F.col("relation") == "contradicts", t(name, f(" for "), subject, clause, f(" is reported as "), "l_display", f(" by "), cite("l"), f(" and "), "r_display", f(" by "), cite("r"), f(". No difference in period, basis, vintage or adjustment was found between the two statements, and the gap of "), gap, f(" is larger than their stated precision allows.")))
        .when(F.col("relation") == "consistent_across_context", t("l_display", f(" ("), cite("l"), f(") and "), "r_display", f(" ("), cite("r"), f(") agree on "), name, f(" for "), subject, f(" even though they are stated differently: "), reasons, f(".")))
        .otherwise(t("l_display", f(" ("), cite("l"), f(") and "), "r_display", f(" ("), cite("r"), f(") both report "), name, f(" for "), subject, f(" and differ by "), gap, f(", but they are not in conflict: "), reasons, f(".")))
    )
    return related.withColumn("explanation", said)


def bridgeable(left: Column, right: Column) -> Column:
    """Whether two metric keys may name one measure: a specific word in common, and not one head with rival modifiers."""
    generic = F.array(*map(F.lit, GENERIC))
    a, b = F.split(left, " "), F.split(right, " ")

    def head(words: Column) -> Column:
        core = F.filter(words, lambda w: ~w.isin(DERIVED))
        return F.element_at(F.when(F.size(core) > 0, core).otherwise(words), -1)

    shared = F.size(F.array_except(F.array_intersect(a, b), generic)) > 0
    only = lambda x, y: F.size(F.array_except(F.array_except(x, y), generic)) > 0
    return (F.length(left) > 0) & (F.length(right) > 0) & shared & ~((head(a) == head(b)) & only(a, b) & only(b, a))


#: The columns of facts that counts of bridges read.
COUNTED = ["fact_id", "doc_id", "subject_key", "subject_source", "metric_key", "concept_id", "value", "unit", "precision", "period_label", "confidence"]
#: The columns that name a block of bridges, and the pairs of facts that one task compares before a link is split.
BRIDGE_BLOCK = ["collection", "k_subject", "k_unit", "k_period", "k_value"]
LINK_PAIRS = 4_000_000
#: So many cells of blocks are broadcast (an estimated 100 to 200 MB); more of them meet by sorting.
HELD_CELLS = 1_000_000


def usable() -> Column:
    """Whether bridges may tie a fact: unit, period and value tell something, few words name it."""
    return ~F.col("unit").isin("count", "unknown") & (F.length("period_label") > 0) & (F.col("value") != 0) & (F.size(F.split("metric_key", " ")) <= BRIDGE_WORDS) & (F.length("metric_key") > 0) & F.col("confidence").isNotNull()


def _bridge_blocks(facts: DataFrame) -> DataFrame:
    """Facts that bridges may tie, with their block: collection, sentence subject, unit, period, value at three figures."""
    subject = F.when(F.col("subject_source") == "sentence", F.coalesce("subject_key", F.lit(""))).otherwise("")
    return facts.where(usable()).withColumns({"k_subject": subject, "k_unit": F.col("unit"), "k_period": F.col("period_label"), "k_value": C.bridge_bucket(F.col("value"))})


def bridgeable_keys(keys: DataFrame) -> DataFrame:
    """``(a_key, b_key)`` of distinct ``keys(metric_key)`` that may name one measure, the smaller first, a key with itself too.

    An equi-join on specific words, of wordings and never of facts.
    """
    specific = F.array_distinct(F.array_except(F.split("metric_key", " "), F.array(*map(F.lit, GENERIC))))
    words = keys.select("metric_key", F.explode(specific).alias("word"))
    pairs = words.withColumnRenamed("metric_key", "a_key").join(words.withColumnRenamed("metric_key", "b_key"), "word").where("a_key <= b_key").select("a_key", "b_key").distinct()
    return pairs.where(bridgeable(F.col("a_key"), F.col("b_key")))


def _links(cells: DataFrame) -> DataFrame:
    """Pairs of ``cells(*BRIDGE_BLOCK, metric_key, n)`` of one block whose keys may name one measure, with the facts of each."""
    # the count keeps the wordings' plan that of the cells, which then run once
    pairs = bridgeable_keys(cells.groupBy("metric_key").agg(F.sum("n").alias("n")).where("n > 0"))
    side = lambda p: cells.select(*BRIDGE_BLOCK, F.col("metric_key").alias(f"{p}_key"), F.col("n").alias(f"{p}_n"))
    return side("a").join(pairs, "a_key").join(side("b"), [*BRIDGE_BLOCK, "b_key"])


def value_bridge(facts: DataFrame) -> DataFrame:
    """Corroborations across concepts and documents: differently worded facts that state one value.

    Candidates share collection, sentence subject, unit, period, the value at three significant figures and a word that
    is specific, so that round values of common periods do not bring all their facts together. Which wordings may meet is
    judged once for each pair of wordings; facts then meet by block and pair of wordings, large ones in several tasks.
    """
    keyed = _bridge_blocks(facts)
    links = _links(keyed.groupBy(*BRIDGE_BLOCK, "metric_key").agg(F.count("*").alias("n")))
    links = links.select(*BRIDGE_BLOCK, "a_key", "b_key", F.ceil(F.col("a_n") * F.col("b_n") / LINK_PAIRS).alias("parts"))
    # rounded for each fact, which keeps their order, and not for each pair
    weighed = F.col("confidence") * 0.9
    keyed = keyed.withColumn("bridged", F.when(F.col("confidence").between(-7.0, 7.0), C.round3(weighed)).otherwise(F.round(weighed, 3)))
    carried = [*SIDE, "bridged"]

    def side(p: str, part: Column) -> DataFrame:
        own = keyed.select(*BRIDGE_BLOCK, F.col("metric_key").alias(f"{p}_key"), *(F.col(c).alias(f"{p}_{c}") for c in carried))
        # the hash goes first, for rows are sorted by it in one comparison; the columns behind it decide
        return own.join(links, [*BRIDGE_BLOCK, f"{p}_key"]).withColumn("part", part).drop("parts").withColumn("link", F.xxhash64(*BRIDGE_BLOCK, "a_key", "b_key", "part"))

    left, right = side("a", F.pmod(F.xxhash64("a_fact_id"), F.col("parts"))), side("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    first = (a("confidence") > b("confidence")) | ((a("confidence") == b("confidence")) & (a("fact_id") < b("fact_id")))
    fits = ~a("concept_id").eqNullSafe(b("concept_id")) & (a("doc_id") != b("doc_id")) & ((F.col("a_key") < F.col("b_key")) | first)
    pairs = left.join(right, ["link", *BRIDGE_BLOCK, "a_key", "b_key", "part"]).where(fits & C.values_agree(a("value"), a("precision"), b("value"), b("precision")))
    pairs = pairs.select("collection", *(F.when(first, x(c)).otherwise(y(c)).alias(f"{p}_{c}") for p, x, y in (("l", a, b), ("r", b, a)) for c in carried))
    basis = F.lit("value_bridge")
    found = pairs.withColumns({"relation": F.lit("corroborates"), "basis": basis, "dimensions": F.array(F.lit("metric wording")), "confidence": F.least("l_bridged", "r_bridged"), "left_id": F.col("l_fact_id"), "right_id": F.col("r_fact_id")}).drop("l_bridged", "r_bridged")
    said = F.concat("l_doc_label", F.lit(" p."), F.col("l_page_no").cast("string"), F.lit(' reports "'), "l_metric", F.lit('" as '), "l_display", F.lit(" and "), "r_doc_label", F.lit(" p."), F.col("r_page_no").cast("string"), F.lit(' reports "'), "r_metric", F.lit('" as '), "r_display", F.lit(". The wording differs, but both are stated for "), "l_subject", F.lit(" in "), "l_period_label", F.lit(" in the same unit and agree to within the precision each states, so they are the same measure reported two ways."))
    return found.withColumns({"relation_id": C.relation_id(F.col("left_id"), F.col("right_id"), F.col("relation"), basis), "explanation": said})


def alias_candidates(bridges: DataFrame, votes: int = ALIAS_VOTES) -> DataFrame:
    """Pairs of metric keys that that many bridges of one run tie: ``(left_key, right_key, n)``."""
    keys = bridges.select(F.least("l_metric_key", "r_metric_key").alias("left_key"), F.greatest("l_metric_key", "r_metric_key").alias("right_key"))
    return keys.groupBy("left_key", "right_key").agg(F.count("*").alias("n")).where(F.col("n") >= votes)


def alias_counts(facts: DataFrame, votes: int = ALIAS_VOTES) -> DataFrame:
    """:func:`alias_candidates` of the bridges of ``facts``, exactly, without making the bridges.

    Facts that a bridge cannot tell apart are counted as one cell. Bridges of two wordings are the pairs of their cells of
    different concepts, less those within one document. Facts are read once, and what several steps read is written.
    """
    scratch, same = Scratch(facts.sparkSession, "aliases"), ["concept_id", "value", "precision"]
    cell = F.collect_list(F.struct("metric_key", *same, "n")).alias("cells")
    # hashes go first, for rows are sorted by them in one comparison; the columns behind them decide
    place, hashed = ["place", "doc_id", *BRIDGE_BLOCK], F.xxhash64(*BRIDGE_BLOCK).alias("hashed")
    _, placed = scratch.write(_bridge_blocks(facts).select(F.xxhash64("doc_id", *BRIDGE_BLOCK).alias("place"), "doc_id", *BRIDGE_BLOCK, "metric_key", *same))
    # a block has as many cells as its wordings, concepts and precisions give, whatever the number of its facts
    by_block = placed.groupBy(*BRIDGE_BLOCK, "metric_key", *same).agg(F.count("*").alias("n"))
    _, blocks, seen = scratch.write_observing(by_block.groupBy(hashed, *BRIDGE_BLOCK).agg(cell).select(F.monotonically_increasing_id().alias("block"), "cells"), n=F.sum(F.size("cells")))
    keys = blocks.select("block", F.explode(F.array_distinct(F.col("cells.metric_key"))).alias("metric_key"))
    _, pairs = scratch.write(bridgeable_keys(keys.select("metric_key").distinct()))

    how = "broadcast" if (seen["n"] or 0) <= HELD_CELLS else "merge"
    side = lambda p: blocks.select("block", F.explode("cells").alias(p)).withColumn(f"{p}_key", F.col(f"{p}.metric_key")).hint(how)
    links = keys.withColumnRenamed("metric_key", "a_key").join(pairs, "a_key").join(keys.withColumnRenamed("metric_key", "b_key").hint(how), ["block", "b_key"])
    met = links.join(side("a"), ["block", "a_key"]).join(side("b"), ["block", "b_key"])
    # most facts are alone with their document in their block
    _, shared = scratch.write(placed.groupBy("place").agg(F.count("*").alias("n")).where("n > 1").select("place"))
    docs = placed.join(shared, "place", "left_semi").groupBy(*place, "metric_key", *same).agg(F.count("*").alias("n")).groupBy(*place).agg(cell)
    within = docs.select("cells", F.explode("cells").alias("a")).select("a", F.explode("cells").alias("b"))
    within = within.withColumns({"a_key": F.col("a.metric_key"), "b_key": F.col("b.metric_key")}).where("a_key <= b_key").join(pairs, ["a_key", "b_key"])

    def paired(of: DataFrame, sign: int) -> DataFrame:
        a, b = F.col("a"), F.col("b")
        apart = of.where(~a["concept_id"].eqNullSafe(b["concept_id"]) & C.values_agree(a["value"], a["precision"], b["value"], b["precision"]))
        return apart.select("a_key", "b_key", (a["n"] * b["n"] * sign).alias("n"))

    total = paired(met, 1).unionByName(paired(within, -1)).groupBy("a_key", "b_key").agg(F.sum("n").alias("n"))
    # cells of one wording meet twice
    once = F.when(F.col("a_key") == F.col("b_key"), F.shiftright("n", 1)).otherwise(F.col("n"))
    return total.select(F.col("a_key").alias("left_key"), F.col("b_key").alias("right_key"), once.alias("n")).where(F.col("n") >= votes)


RELATION = ["relation_id", "left_id", "right_id", "relation", "confidence", "explanation", "dimensions", "basis"]


def link(facts: DataFrame, documents: DataFrame, concepts: DataFrame, new: DataFrame | None = None, cap: int | None = BLOCK_CAP) -> tuple[DataFrame, DataFrame]:
    """Relations of all facts and the alias votes of this run; see :func:`top_of_blocks` for ``cap``.

    With ``new`` (``fact_id``) only relations that touch one of these facts come out, which is what an incremental
    ingest adds; an empty ``new`` adds nothing. Alias votes count over the whole pool either way.
    """
    from claimlake.operators import concepts as K

    p = pool(facts, documents)
    blocked = top_of_blocks(p, cap)
    vectors = K.weighted_keys(p.select("metric_key").where(F.length("metric_key") > 0).distinct())
    pairs = with_same_metric(with_differences(concept_pairs(blocked)), vectors, key_pairs(blocked))
    labels = concepts.select(F.col("concept_id").alias("l_concept_id"), F.col("label").alias("concept_label")).dropDuplicates(["l_concept_id"])
    judged = explain(classify(pairs).join(labels, "l_concept_id", "left"), F.col("concept_label"))
    bridges = value_bridge(p)
    found = judged.select(*RELATION).unionByName(bridges.select(*RELATION)).dropDuplicates(["relation_id"])
    if new is not None:
        ids = new.select(F.col("fact_id").alias("touched")).distinct()
        touching = found.join(ids, F.col("left_id") == F.col("touched"), "left_semi").unionByName(found.join(ids, F.col("right_id") == F.col("touched"), "left_semi"))
        found = touching.dropDuplicates(["relation_id"])
    return found, alias_candidates(bridges)
