"""Queries over the claim tables, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimlake.functions import columns as C, udfs as U
from claimlake.operators import concepts as K, relate as R, serve as S
from claimlake.plans.scratch import Scratch
from claimlake.sources import claims as T
from claimlake.sources.tables import table

SIZES = {"corroborates": 8, "contradicts": 8, "reconciled_by_context": 10, "part_of": 5, "consistent_across_context": 5}

#: Common tables of the SQL: each key once, by the same rules as claimlake.sources.claims.
BASE = """WITH f AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY recorded_at) rn FROM facts WHERE fact_id IS NOT NULL) WHERE rn = 1),
r AS (SELECT * EXCLUDE (rn) REPLACE (lower(trim(relation)) AS relation) FROM (SELECT *, row_number() OVER (PARTITION BY relation_id ORDER BY recorded_at) rn FROM relations WHERE relation_id IS NOT NULL) WHERE rn = 1 AND left_id IS NOT NULL AND right_id IS NOT NULL),
d AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at DESC) rn FROM source_documents WHERE doc_id IS NOT NULL) WHERE rn = 1),
p AS (SELECT DISTINCT * FROM pages),
keys AS (SELECT DISTINCT metric_key FROM f WHERE metric_key <> ''),
df AS (SELECT token, count(*) df FROM (SELECT DISTINCT metric_key, unnest(string_split(metric_key, ' ')) token FROM keys) GROUP BY 1),
idf AS (SELECT token, df, ln(greatest((SELECT count(*) FROM keys), 4) / (df + 1)) + 1.0 idf FROM df),
words AS (SELECT DISTINCT metric_key, unnest(string_split(metric_key, ' ')) token FROM keys),
norm AS (SELECT metric_key, sum(idf * idf) n FROM words JOIN idf USING (token) GROUP BY 1),
dots AS (SELECT a.metric_key left_key, b.metric_key right_key, sum(idf * idf) dot FROM words a JOIN words b USING (token) JOIN idf USING (token) WHERE a.metric_key <> b.metric_key GROUP BY 1, 2),
alike AS (SELECT left_key, right_key, least(1.0, dot / sqrt(x.n * y.n) + CASE WHEN list_extract(string_split(left_key, ' '), -1) = list_extract(string_split(right_key, ' '), -1) THEN 0.05 ELSE 0 END) score
  FROM dots JOIN norm x ON x.metric_key = left_key JOIN norm y ON y.metric_key = right_key),
po AS (SELECT f.*, collection, published_on, CASE WHEN length(nm) <= 52 THEN nm ELSE regexp_replace(regexp_replace(substr(nm, 1, 52), '\\s\\S*$', ''), '[,;:\\s]+$', '') || '…' END doc_label
  FROM f JOIN (SELECT doc_id, collection, published_on, CASE WHEN length(trim(coalesce(title, ''))) > 0 THEN trim(regexp_replace(title, '\\s+', ' ', 'g')) ELSE filename END nm FROM d) USING (doc_id)
  WHERE f."value" IS NOT NULL AND NOT isnan(f."value")),
blocked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection, concept_id, unit ORDER BY confidence DESC, fact_id) rk FROM po WHERE concept_id <> '') WHERE rk <= 220),
pairs AS (SELECT a, b FROM (SELECT blocked a, collection, concept_id, unit, rk, subject_source, subject_key FROM blocked) x JOIN (SELECT blocked b, collection, concept_id, unit, rk, subject_source, subject_key FROM blocked) y USING (collection, concept_id, unit)
  WHERE x.rk < y.rk AND coalesce(NOT (x.subject_source = 'sentence' AND y.subject_source = 'sentence') OR x.subject_key IS NOT DISTINCT FROM y.subject_key, true)),
rel AS (SELECT a, b, CASE
    WHEN coalesce(a.period_label, '') <> '' AND a.period_label = b.period_label THEN 'same'
    WHEN coalesce(a.period_label, '') = '' OR coalesce(b.period_label, '') = '' THEN 'unknown'
    WHEN a.period_start IS NULL OR a.period_end IS NULL OR b.period_start IS NULL OR b.period_end IS NULL THEN 'different'
    WHEN a.period_start <= b.period_start AND b.period_end <= a.period_end THEN 'contains'
    WHEN b.period_start <= a.period_start AND a.period_end <= b.period_end THEN 'within'
    WHEN a.period_start <= b.period_end AND b.period_start <= a.period_end THEN 'overlaps' ELSE 'disjoint' END period_rel,
  abs(a."value" - b."value") gap,
  abs(a."value" - b."value") <= greatest(greatest(a.precision, b.precision) * 0.5, greatest(abs(a."value"), abs(b."value"), 1e-12) * 0.001) agree,
  list_filter(['adjustment', 'aggregation', 'comparison', 'consolidation', 'price_basis', 'vintage'], lambda k: a.context[k] IS DISTINCT FROM b.context[k]) cd FROM pairs),
diff AS (SELECT *, list_concat(list_concat(CASE WHEN period_rel IN ('same', 'contains', 'within') THEN [] ELSE ['period'] END, cd),
    CASE WHEN NOT list_contains(cd, 'vintage') AND (coalesce(a.context['vintage'] IN ('projection', 'estimate', 'advance_estimate', 'provisional', 'revised', 'target'), false) OR coalesce(b.context['vintage'] IN ('projection', 'estimate', 'advance_estimate', 'provisional', 'revised', 'target'), false))
      AND coalesce(abs((year(a.published_on) - year(b.published_on)) * 12 + month(a.published_on) - month(b.published_on)) >= 3, false) THEN ['publication'] ELSE [] END) dims FROM rel),
same AS (SELECT diff.*, coalesce(least(len(string_split(a.metric_key, ' ')), len(string_split(b.metric_key, ' '))) >= 2 AND (a.metric_key = b.metric_key OR coalesce(score >= 0.85, false)), false) same_metric
  FROM diff LEFT JOIN alike ON left_key = a.metric_key AND right_key = b.metric_key),
judged AS (SELECT *, CASE
    WHEN a.unit <> b.unit OR (coalesce(a.period_label, '') = '' AND coalesce(b.period_label, '') = '') THEN NULL
    WHEN period_rel IN ('contains', 'within') AND len(list_filter(dims, lambda x: x NOT IN ('period', 'publication'))) = 0 THEN 'part_of'
    WHEN len(dims) = 0 AND agree THEN 'corroborates'
    WHEN len(dims) = 0 AND same_metric AND NOT (a.doc_id = b.doc_id AND a.page_no = b.page_no) THEN 'contradicts'
    WHEN len(dims) = 0 THEN NULL
    WHEN agree THEN 'consistent_across_context' ELSE 'reconciled_by_context' END kind,
  CASE WHEN period_rel = 'contains' THEN abs(b."value") <= abs(a."value") * 1.001 ELSE abs(a."value") <= abs(b."value") * 1.001 END fits FROM same),
weighed AS (SELECT *, least(a.confidence, b.confidence) * CASE kind WHEN 'part_of' THEN CASE WHEN fits THEN 0.9 ELSE 0.7 END WHEN 'corroborates' THEN 1.0 WHEN 'contradicts' THEN 0.9 WHEN 'consistent_across_context' THEN 0.8 ELSE 0.85 END::DOUBLE x,
  CASE WHEN kind = 'part_of' THEN ['period'] WHEN period_rel IN ('contains', 'within') AND len(dims) > 0 THEN list_concat(['period scope'], dims) ELSE dims END dimensions FROM judged WHERE kind IS NOT NULL),
bridge AS (SELECT *, CASE WHEN e >= 3 THEN round_even("value" / pow(10.0, e - 3), 0) * pow(10.0, e - 3) ELSE round_even("value" * pow(10.0, 3 - e), 0) / pow(10.0, 3 - e) END bucket,
    CASE WHEN subject_source = 'sentence' THEN coalesce(subject_key, '') ELSE '' END ks
  FROM (SELECT *, CASE WHEN abs("value") >= 1 THEN length(CAST(CAST(floor(abs("value")) AS HUGEINT) AS VARCHAR)) ELSE 0 END e FROM po
    WHERE unit NOT IN ('count', 'unknown') AND period_label <> '' AND "value" <> 0 AND metric_key <> '' AND len(string_split(metric_key, ' ')) <= 6)),
gen AS (SELECT ['total','net','gross','value','amount','number','share','rate','growth','income','year','change','level','index','figure','overall'] g, ['growth','rate','level','change','averaged','average'] dv),
bw AS (SELECT metric_key, string_split(metric_key, ' ') w, list_filter(string_split(metric_key, ' '), lambda t: NOT list_contains(dv, t)) core FROM keys, gen),
bp AS (SELECT a, b FROM (SELECT bridge a, collection, ks, unit, period_label, bucket FROM bridge) x JOIN (SELECT bridge b, collection, ks, unit, period_label, bucket FROM bridge) y USING (collection, ks, unit, period_label, bucket)
  JOIN bw wa ON wa.metric_key = a.metric_key JOIN bw wb ON wb.metric_key = b.metric_key, gen
  WHERE a.concept_id IS DISTINCT FROM b.concept_id AND a.doc_id <> b.doc_id AND (a.confidence > b.confidence OR (a.confidence = b.confidence AND a.fact_id < b.fact_id))
    AND len(list_filter(list_intersect(wa.w, wb.w), lambda t: NOT list_contains(g, t))) > 0
    AND NOT (list_extract(CASE WHEN len(wa.core) > 0 THEN wa.core ELSE wa.w END, -1) = list_extract(CASE WHEN len(wb.core) > 0 THEN wb.core ELSE wb.w END, -1)
      AND len(list_filter(wa.w, lambda t: NOT list_contains(wb.w, t) AND NOT list_contains(g, t))) > 0 AND len(list_filter(wb.w, lambda t: NOT list_contains(wa.w, t) AND NOT list_contains(g, t))) > 0)
    AND abs(a."value" - b."value") <= greatest(greatest(a.precision, b.precision) * 0.5, greatest(abs(a."value"), abs(b."value"), 1e-12) * 0.001)),
sup AS (SELECT concept_id, count(*) n FROM f WHERE concept_id <> '' GROUP BY 1),
fx AS (SELECT f.*, d.collection, sup.n FROM f JOIN d USING (doc_id) LEFT JOIN sup USING (concept_id)),
star AS (SELECT r.*, l.doc_id l_doc_id, x.doc_id r_doc_id, l.page_no l_page_no, x.page_no r_page_no, l.metric_key l_metric_key, x.metric_key r_metric_key, l.collection l_collection, l.display ld, x.display rd, l."value" lv, x."value" rv,
  r.confidence * (least(coalesce(l.n, 1), 12) * least(len(string_split(coalesce(l.metric_key, ''), ' ')), 3)) * (least(coalesce(x.n, 1), 12) * least(len(string_split(coalesce(x.metric_key, ''), ' ')), 3)) weight
  FROM r JOIN fx l ON l.fact_id = r.left_id JOIN fx x ON x.fact_id = r.right_id)
"""  # fmt: skip
#: Three decimals on the exact binary value, halves to even, as claimlake.functions.columns.round3.
ROUNDED = "((q // 1152921504606846976 + CASE WHEN q % 1152921504606846976 > 576460752303423488 OR (q % 1152921504606846976 = 576460752303423488 AND (q // 1152921504606846976) % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / 1000.0)"
QUOTIENT = "CAST(CAST({x} * 1152921504606846976.0::DOUBLE AS BIGINT) AS HUGEINT) * 1000"
RID = "substr(sha1(concat_ws('|', least({a}, {b}), greatest({a}, {b}), {k}, {basis})), 1, 16)"

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    """Register a query with its SQL; without SQL it is tested against brute force."""

    def add(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def _pool(spark: SparkSession, root: str) -> DataFrame:
    return R.pool(T.facts(spark, root), T.documents(spark, root))


def _pairs(spark: SparkSession, root: str) -> DataFrame:
    p = _pool(spark, root)
    return R.with_differences(R.concept_pairs(R.top_of_blocks(p)))


def _judged(spark: SparkSession, root: str) -> DataFrame:
    blocked = R.top_of_blocks(_pool(spark, root))
    return R.with_same_metric(R.with_differences(R.concept_pairs(blocked)), K.weighted_keys(_keys(spark, root)), R.key_pairs(blocked))


def _classified(spark: SparkSession, root: str) -> DataFrame:
    return R.classify(_judged(spark, root))


def _explained(spark: SparkSession, root: str) -> DataFrame:
    labels = T.concepts(spark, root).select(F.col("concept_id").alias("l_concept_id"), F.col("label").alias("concept_label")).dropDuplicates(["l_concept_id"])
    return R.explain(_classified(spark, root).join(labels, "l_concept_id", "left"), F.col("concept_label"))


def _keys(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "facts", "metric_key").where(F.length("metric_key") > 0).distinct()


def _star(spark: SparkSession, root: str) -> DataFrame:
    return S.joined_relations(T.relations(spark, root), T.facts(spark, root), T.documents(spark, root))


@query(BASE + "SELECT fact_id, doc_id, metric, \"value\", unit, recorded_at FROM f")
def facts_dedup(spark, root):
    return T.facts(spark, root, "doc_id", "metric", "value", "unit").select("fact_id", "doc_id", "metric", "value", "unit", "recorded_at")


@query("SELECT DISTINCT fact_id, substr(sha1(concat_ws('|', doc_id, page_no, value_start, value_end, metric)), 1, 16) AS derived_id FROM facts WHERE fact_id IS NOT NULL")
def fact_ids(spark, root):
    f = table(spark, root, "facts", "fact_id", "doc_id", "page_no", "value_start", "value_end", "metric").where("fact_id is not null")
    return f.select("fact_id", C.fact_id(*(F.col(c) for c in ("doc_id", "page_no", "value_start", "value_end", "metric"))).alias("derived_id")).distinct()


@query(BASE + "SELECT a.fact_id left_id, b.fact_id right_id, a.collection, a.concept_id, a.unit FROM pairs")
def concept_pairs(spark, root):
    pairs = R.concept_pairs(R.top_of_blocks(_pool(spark, root)))
    return pairs.select(F.col("l_fact_id").alias("left_id"), F.col("r_fact_id").alias("right_id"), "collection", F.col("l_concept_id").alias("concept_id"), F.col("l_unit").alias("unit"))


@query(BASE + "SELECT fact_id, collection, concept_id, unit, rk FROM blocked")
def block_topk(spark, root):
    return R.top_of_blocks(_pool(spark, root)).select("fact_id", "collection", "concept_id", "unit", F.col("rk").cast("long").alias("rk"))


@query(BASE + """SELECT collection, concept_id, unit, count(*) n_facts, count(*) - 20 n_left_out, CAST((count(*) * (count(*) - 1) - 20 * 19) // 2 AS BIGINT) n_pairs_left_out
  FROM po WHERE concept_id <> '' GROUP BY 1, 2, 3 HAVING count(*) > 20""")
def block_losses(spark, root):
    """What a cap of 20 facts a block would leave out."""
    return R.beyond_cap(_pool(spark, root), 20)


@query(BASE + "SELECT period_rel, a.period_kind left_kind, b.period_kind right_kind, count(*) n FROM rel GROUP BY ALL")
def period_relation(spark, root):
    kinds = T.facts(spark, root, "period_kind").select("fact_id", "period_kind")
    pairs = _pairs(spark, root).select("l_fact_id", "r_fact_id", "period_rel")
    pairs = pairs.join(kinds.toDF("l_fact_id", "left_kind"), "l_fact_id")
    pairs = pairs.join(kinds.toDF("r_fact_id", "right_kind"), "r_fact_id")
    return pairs.groupBy("period_rel", "left_kind", "right_kind").agg(F.count("*").alias("n"))


@query(BASE + "SELECT a.fact_id left_id, b.fact_id right_id FROM pairs WHERE a.period_start <= b.period_end AND b.period_start <= a.period_end")
def period_overlap(spark, root):
    pairs = R.concept_pairs(R.top_of_blocks(_pool(spark, root)))
    meet = (F.col("l_period_start") <= F.col("r_period_end")) & (F.col("r_period_start") <= F.col("l_period_end"))
    return pairs.where(meet).select(F.col("l_fact_id").alias("left_id"), F.col("r_fact_id").alias("right_id"))


@query(BASE + "SELECT a.fact_id left_id, b.fact_id right_id, agree, gap FROM rel")
def values_agree(spark, root):
    return _pairs(spark, root).select(F.col("l_fact_id").alias("left_id"), F.col("r_fact_id").alias("right_id"), "agree", "gap")


@query(BASE + "SELECT a.fact_id left_id, b.fact_id right_id, array_to_string(dims, ',') dims FROM diff")
def context_differences(spark, root):
    return _pairs(spark, root).select(F.col("l_fact_id").alias("left_id"), F.col("r_fact_id").alias("right_id"), F.array_join("dims", ",").alias("dims"))


@query(BASE + "SELECT a.fact_id left_id, b.fact_id right_id, same_metric FROM same")
def same_metric(spark, root):
    pairs = _judged(spark, root)
    return pairs.select(F.col("l_fact_id").alias("left_id"), F.col("r_fact_id").alias("right_id"), "same_metric")


@query(BASE + f"SELECT a.fact_id left_id, b.fact_id right_id, kind relation, {ROUNDED} confidence, array_to_string(dimensions, ',') dimensions, {RID.format(a='a.fact_id', b='b.fact_id', k='kind', basis=chr(39) + 'concept' + chr(39))} relation_id FROM (SELECT *, {QUOTIENT.format(x='x')} q FROM weighed)")
def classify_relations(spark, root):
    return _classified(spark, root).select("left_id", "right_id", "relation", "confidence", F.array_join("dimensions", ",").alias("dimensions"), "relation_id")


_CITE = "{s}.doc_label || ' p.' || {s}.page_no"
_READ = "CASE " + " ".join(f"WHEN k = '{d}' AND v = '{v}' THEN '{said}'" for d, vs in R.READABLE.items() for v, said in vs.items()) + " ELSE coalesce(v, 'no stated basis') END"
_NAME = "CASE WHEN a.metric_key = b.metric_key THEN a.metric ELSE coalesce(c.label, a.metric) END"
_SUBJECT = "CASE WHEN a.subject_key IS NOT DISTINCT FROM b.subject_key THEN a.subject ELSE a.subject || '/' || b.subject END"
_CLAUSE = "CASE WHEN coalesce(a.period_label, '') <> '' THEN ' in ' || a.period_label ELSE '' END"
_GAP = "CASE WHEN a.unit IN ('percent', 'percentage_point') THEN printf('%.2f', gap) || ' percentage points' ELSE printf('%.2f', gap * 100.0 / greatest(abs(a.\"value\"), abs(b.\"value\"), 1e-12)) || '%' END"


@query(BASE + f"""SELECT a.fact_id left_id, b.fact_id right_id, kind relation, CASE kind
  WHEN 'corroborates' THEN {_CITE.format(s='a')} || ' and ' || {_CITE.format(s='b')} || ' both report ' || {_NAME} || ' for ' || {_SUBJECT} || {_CLAUSE} || ': ' || a.display || ' and ' || b.display || '. They differ by '
  WHEN 'contradicts' THEN {_NAME} || ' for ' || {_SUBJECT} || {_CLAUSE} || ' is reported as ' || a.display || ' by ' || {_CITE.format(s='a')} || ' and ' || b.display || ' by ' || {_CITE.format(s='b')} || '. No'
  WHEN 'part_of' THEN CASE WHEN period_rel = 'contains' THEN b.period_label || ' sits inside ' || a.period_label || ', so ' || b.display || ' (' || {_CITE.format(s='b')} || ') is a component of ' || a.display || ' (' || {_CITE.format(s='a')}
     ELSE a.period_label || ' sits inside ' || b.period_label || ', so ' || a.display || ' (' || {_CITE.format(s='a')} || ') is a component of ' || b.display || ' (' || {_CITE.format(s='b')} END || ') for ' || {_NAME} || ' of ' || {_SUBJECT} || '. '
  ELSE a.display || ' (' || {_CITE.format(s='a')} || ') and ' || b.display || ' (' || {_CITE.format(s='b')} || ')' END opening
  FROM weighed LEFT JOIN (SELECT concept_id, any_value(label) AS label FROM concepts GROUP BY 1) c ON c.concept_id = a.concept_id""")
def explanations(spark, root):
    """The openings of explanations, which is what its SQL states; ``explanations_whole`` gives the whole texts."""
    told = _explained(spark, root)
    cut = {"corroborates": r"(?s)^(.*They differ by ).*$", "contradicts": r"(?s)^(.*?\. No) difference in period.*$", "part_of": r"(?s)^(.*\. )The component .*$"}
    opening = F.when(F.col("relation").isin("consistent_across_context", "reconciled_by_context"), F.regexp_replace("explanation", r"(?s)^(.*?\)) (?:agree on|both report) .*$", "$1"))
    for kind, pattern in cut.items():
        opening = opening.when(F.col("relation") == kind, F.regexp_replace("explanation", pattern, "$1"))
    return told.select("left_id", "right_id", "relation", opening.alias("opening"))


@query(None)
def explanations_whole(spark, root):
    """The whole explanation of every classified pair: gap, reasons and notes included."""
    return _explained(spark, root).select("left_id", "right_id", "relation", "explanation")


@query(BASE + f"SELECT a.fact_id left_id, b.fact_id right_id, {ROUNDED} confidence FROM (SELECT a, b, {QUOTIENT.format(x='(least(a.confidence, b.confidence) * 0.9::DOUBLE)')} q FROM bp)")
def value_bridge(spark, root):
    return R.value_bridge(_pool(spark, root)).select("left_id", "right_id", "confidence")


@query(BASE + """, kp AS (SELECT DISTINCT least(a.metric_key, b.metric_key) l, greatest(a.metric_key, b.metric_key) g FROM keys a, keys b WHERE a.metric_key < b.metric_key AND EXISTS (SELECT 1 FROM words x JOIN words y USING (token) WHERE x.metric_key = a.metric_key AND y.metric_key = b.metric_key))
  SELECT l left_key, kp.g right_key, len(list_filter(list_intersect(wa.w, wb.w), lambda t: NOT list_contains(gen.g, t))) > 0
    AND NOT (list_extract(CASE WHEN len(wa.core) > 0 THEN wa.core ELSE wa.w END, -1) = list_extract(CASE WHEN len(wb.core) > 0 THEN wb.core ELSE wb.w END, -1)
      AND len(list_filter(wa.w, lambda t: NOT list_contains(wb.w, t) AND NOT list_contains(gen.g, t))) > 0 AND len(list_filter(wb.w, lambda t: NOT list_contains(wa.w, t) AND NOT list_contains(gen.g, t))) > 0) ok
  FROM kp JOIN bw wa ON wa.metric_key = l JOIN bw wb ON wb.metric_key = kp.g, gen""")
def bridgeable(spark, root):
    pairs = K.candidate_pairs(_keys(spark, root)).select("left_key", "right_key")
    return pairs.withColumn("ok", R.bridgeable(F.col("left_key"), F.col("right_key")))


@query(BASE + "SELECT least(a.metric_key, b.metric_key) left_key, greatest(a.metric_key, b.metric_key) right_key, count(*) n FROM bp GROUP BY 1, 2 HAVING count(*) >= 2")
def alias_candidates(spark, root):
    return R.alias_candidates(R.value_bridge(_pool(spark, root)))


@query(BASE + ", c AS (SELECT least(a.metric_key, b.metric_key) left_key, greatest(a.metric_key, b.metric_key) right_key, count(*) n FROM bp GROUP BY 1, 2 HAVING count(*) >= 2) SELECT left_key, right_key, CAST(1 + n % 2 AS BIGINT) votes FROM c")
def alias_votes(spark, root):
    new = alias_candidates(spark, root)
    stored = new.where(F.col("n") % 2 == 1).select("left_key", "right_key", F.lit(1).alias("votes"))
    return S.alias_votes(stored, new)


@query(BASE + ", c AS (SELECT least(a.metric_key, b.metric_key) left_key, greatest(a.metric_key, b.metric_key) right_key, count(*) n FROM bp GROUP BY 1, 2 HAVING count(*) >= 2) SELECT left_key, right_key FROM c WHERE n % 2 = 1")
def alias_promotion(spark, root):
    return S.promoted(alias_votes(spark, root))


# Few facts of different wordings agree on period and three figures; by the digits of their values alone, many do.
COARSE = BASE.replace("blocked AS (", """po AS (SELECT * REPLACE (CASE WHEN "value" = 0 THEN 0.0::DOUBLE ELSE (100 * length(CAST(CAST(floor(abs("value")) AS HUGEINT) AS VARCHAR)))::DOUBLE END AS "value", CASE WHEN period_label <> '' THEN 'any' END AS period_label) FROM fine),
blocked AS (""", 1).replace("po AS (SELECT f.*", "fine AS (SELECT f.*", 1)  # fmt: skip


def _coarse(pool: DataFrame) -> DataFrame:
    digits = F.length(F.floor(F.abs("value")).cast("decimal(38,0)").cast("string"))
    period = F.when(F.length("period_label") > 0, "any")
    return pool.withColumns({"value": F.when(F.col("value") == 0, 0.0).otherwise(100.0 * digits), "period_label": period})


def _coarse_counts(spark: SparkSession, root: str) -> DataFrame:
    """Counts of coarse bridges, which tie the same facts as fine ones: coarse periods and values are empty or 0 where fine ones are."""
    return R.alias_counts(_coarse(R.pool(T.facts_where(spark, root, R.usable(), *R.COUNTED), T.documents(spark, root), R.COUNTED)))


_COARSE_VOTES = ", c AS (SELECT least(a.metric_key, b.metric_key) left_key, greatest(a.metric_key, b.metric_key) right_key, count(*) n FROM bp GROUP BY 1, 2 HAVING count(*) >= 2) "


@query(COARSE + f"SELECT a.fact_id left_id, b.fact_id right_id, {ROUNDED} confidence FROM (SELECT a, b, {QUOTIENT.format(x='(least(a.confidence, b.confidence) * 0.9::DOUBLE)')} q FROM bp)")
def value_bridge_coarse(spark, root):
    return R.value_bridge(_coarse(_pool(spark, root))).select("left_id", "right_id", "confidence")


@query(COARSE + _COARSE_VOTES + "SELECT left_key, right_key, n FROM c")
def alias_candidates_coarse(spark, root):
    return _coarse_counts(spark, root)


@query(COARSE + _COARSE_VOTES + "SELECT left_key, right_key, CAST(1 + n % 2 AS BIGINT) votes FROM c")
def alias_votes_coarse(spark, root):
    _, new = Scratch(spark, "votes").write(_coarse_counts(spark, root))
    stored = new.where(F.col("n") % 2 == 1).select("left_key", "right_key", F.lit(1).alias("votes"))
    return S.alias_votes(stored, new)


@query(COARSE + _COARSE_VOTES + "SELECT left_key, right_key FROM c WHERE n % 2 = 1")
def alias_promotion_coarse(spark, root):
    return S.promoted(alias_votes_coarse(spark, root))


@query(BASE + "SELECT token, df FROM df")
def token_frequency(spark, root):
    return K.token_frequency(_keys(spark, root))


@query(BASE + "SELECT token, round(idf, 6) idf FROM idf")
def idf(spark, root):
    return K.token_idf(_keys(spark, root)).select("token", F.round("idf", 6).alias("idf"))


@query(BASE + "SELECT left_key, right_key, round(score, 6) score FROM alike WHERE left_key < right_key")
def concept_similarity(spark, root):
    return K.candidate_pairs(_keys(spark, root)).select("left_key", "right_key", F.round("score", 6).alias("score"))


@query(BASE + "SELECT left_key, right_key FROM alike WHERE left_key < right_key AND score >= 0.62")
def concept_candidates(spark, root):
    return K.candidate_pairs(_keys(spark, root)).where(F.col("score") >= K.JOINS).select("left_key", "right_key")


@query(BASE + "SELECT collection, count(*) n_facts, count(DISTINCT doc_id) n_docs FROM f JOIN d USING (doc_id) GROUP BY 1")
def facts_by_collection(spark, root):
    joined = T.facts(spark, root, "doc_id").join(T.documents(spark, root, "collection"), "doc_id")
    return joined.groupBy("collection").agg(F.count("*").alias("n_facts"), F.count_distinct("doc_id").alias("n_docs"))


@query(BASE + "SELECT fact_id, confidence FROM f ORDER BY confidence DESC, fact_id LIMIT 200")
def facts_topk(spark, root):
    return T.facts(spark, root, "confidence").select("fact_id", "confidence").orderBy(F.desc("confidence"), "fact_id").limit(200)


@query(BASE + "SELECT relation_id, relation, weight FROM star ORDER BY weight DESC, confidence DESC, relation_id LIMIT 50 OFFSET 25")
def relations_ranked(spark, root):
    return S.ranked(_star(spark, root), 50, 25).select("relation_id", "relation", "weight")


@query(BASE + "SELECT relation_id, l_collection collection FROM star WHERE relation = 'reconciled_by_context' AND l_doc_id <> r_doc_id AND list_contains(dimensions, 'vintage')")
def relations_filtered(spark, root):
    return S.filtered(_star(spark, root), "reconciled_by_context", cross_document=True, dimension="vintage").select("relation_id", F.col("l_collection").alias("collection"))


@query(BASE + "SELECT d.collection, relation, count(*) n FROM r JOIN f ON f.fact_id = left_id JOIN d USING (doc_id) GROUP BY 1, 2")
def relation_counts(spark, root):
    return S.relation_counts(T.relations(spark, root), T.facts(spark, root, "doc_id"), T.documents(spark, root, "collection"))


@query(BASE + """SELECT 'documents' measure, count(*) n FROM d UNION ALL SELECT 'pages', (SELECT count(DISTINCT (doc_id, page_no)) FROM pages) UNION ALL SELECT 'facts', (SELECT count(*) FROM f) UNION ALL SELECT 'concepts', (SELECT count(*) FROM concepts)
  UNION ALL SELECT 'relations', (SELECT count(*) FROM r) UNION ALL SELECT 'relation ' || relation, count(*) FROM r GROUP BY relation UNION ALL SELECT 'collection ' || collection, count(*) FROM d GROUP BY collection""")
def stats(spark, root):
    return S.stats(T.documents(spark, root, "collection"), T.pages(spark, root), T.facts(spark, root, "doc_id"), T.concepts(spark, root), T.relations(spark, root))


@query(BASE + "SELECT concept_id, n FROM sup")
def concept_support(spark, root):
    return S.support(T.facts(spark, root, "concept_id"))


@query(BASE + "SELECT concept_id, label, coalesce(n, 0) n_facts FROM concepts LEFT JOIN sup USING (concept_id) ORDER BY n_facts DESC, concept_id LIMIT 100")
def top_concepts(spark, root):
    return S.top_concepts(T.concepts(spark, root), T.facts(spark, root, "concept_id"), 100)


@query(BASE + "SELECT doc_id, title, collection, n_pages, ingested_at, coalesce(n, 0) n_facts FROM d LEFT JOIN (SELECT doc_id, count(*) n FROM f GROUP BY 1) USING (doc_id)")
def documents_listing(spark, root):
    return S.documents_listing(T.documents(spark, root), T.facts(spark, root, "doc_id"))


@query(BASE + "SELECT (SELECT count(*) FROM f) n_facts, (SELECT count(*) FROM f WHERE coalesce(period_label, '') = '') no_period, (SELECT count(*) FROM f WHERE NOT contains(coalesce(metric_key, ''), ' ')) one_word_metric, (SELECT count(*) FROM f WHERE unit IN ('count', 'unknown')) incomparable_unit, (SELECT count(*) FROM p WHERE n_columns > 1) reordered_pages, (SELECT count(*) FROM p) n_pages")
def diagnostics(spark, root):
    return S.diagnostics(T.facts(spark, root, "period_label", "metric_key", "unit"), T.pages(spark, root))


@query(BASE + "SELECT relation_id, metric_key, CAST(length(metric_key) AS INTEGER) n_chars, r.confidence FROM r JOIN f ON f.fact_id = left_id WHERE relation = 'contradicts' ORDER BY n_chars, r.confidence DESC, relation_id LIMIT 3")
def weakest_contradictions(spark, root):
    return S.weakest_contradictions(T.relations(spark, root, "confidence"), T.facts(spark, root, "metric_key"))


@query(BASE + ", gone AS (SELECT doc_id FROM d WHERE deleted_at IS NOT NULL), kf AS (SELECT * FROM f WHERE doc_id NOT IN (SELECT doc_id FROM gone) OR doc_id IS NULL), dead AS (SELECT fact_id FROM f WHERE doc_id IN (SELECT doc_id FROM gone)) SELECT 'facts' kept, count(*) n FROM kf UNION ALL SELECT 'relations', (SELECT count(*) FROM r WHERE left_id NOT IN (SELECT fact_id FROM dead) AND right_id NOT IN (SELECT fact_id FROM dead)) UNION ALL SELECT 'pages', (SELECT count(*) FROM p WHERE doc_id NOT IN (SELECT doc_id FROM gone))")
def delete_document(spark, root):
    gone = T.documents(spark, root, "deleted_at").where("deleted_at is not null").select("doc_id")
    kept = S.delete_documents(gone, T.facts(spark, root, "doc_id"), T.relations(spark, root), T.pages(spark, root))
    out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kept"), "n") for name, df in zip(("facts", "relations", "pages"), kept)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT sha256, arg_min(doc_id, (ingested_at, doc_id)) doc_id, min(ingested_at) ingested_at FROM source_documents WHERE sha256 IS NOT NULL GROUP BY 1")
def content_dedup(spark, root):
    return S.content_dedup(table(spark, root, "source_documents"))


_INCREMENTAL = BASE + f""", nw AS (SELECT fact_id FROM f JOIN d USING (doc_id) WHERE year(ingested_at) >= 2025),
  allr AS (SELECT {RID.format(a='a.fact_id', b='b.fact_id', k='kind', basis=chr(39) + 'concept' + chr(39))} relation_id, kind relation, a.fact_id l, b.fact_id g FROM weighed
    UNION SELECT {RID.format(a='a.fact_id', b='b.fact_id', k=chr(39) + 'corroborates' + chr(39), basis=chr(39) + 'value_bridge' + chr(39))}, 'corroborates', a.fact_id, b.fact_id FROM bp)
  SELECT relation_id, relation FROM allr WHERE l IN (SELECT fact_id FROM nw) OR g IN (SELECT fact_id FROM nw)"""


@query(_INCREMENTAL)
def incremental_link(spark, root):
    facts, docs = T.facts(spark, root), T.documents(spark, root)
    new = facts.join(docs.where(F.year("ingested_at") >= 2025), "doc_id", "left_semi").select("fact_id")
    return R.link(facts, docs, T.concepts(spark, root), new)[0].select("relation_id", "relation")


@query(BASE + ", e AS (SELECT relation, relation_id, row_number() OVER (PARTITION BY relation ORDER BY (l_doc_id <> r_doc_id) DESC, weight DESC, confidence DESC, relation_id) place FROM star) SELECT * FROM e WHERE place <= CASE relation WHEN 'corroborates' THEN 8 WHEN 'contradicts' THEN 8 WHEN 'reconciled_by_context' THEN 10 ELSE 5 END")
def export_slices(spark, root):
    return S.export_slices(_star(spark, root), SIZES).select("relation", F.col("place").cast("long").alias("place"), "relation_id")


_SCALES = "list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(trim({c}), '[\\s\\x{{00a0}}\\x{{2009}}\\x{{202f}}]+'), lambda w: lower(w)), lambda w: regexp_matches(w, '^\\p{{L}}+$') AND w NOT IN ('rs', 'inr', 'usd', 'us', 'eur', 'gbp'))))"
_PLAUSIBLE = "coalesce(abs(lv) > 0 AND abs(rv) > 0 AND greatest(abs(lv), abs(rv)) <= least(abs(lv), abs(rv)) * 5, false)"
_CLEAR = "(l_metric_key IS NOT DISTINCT FROM r_metric_key) DESC, CASE WHEN l_doc_id <> r_doc_id THEN 1 WHEN l_page_no = r_page_no THEN 0 ELSE 2 END, weight DESC, confidence DESC, relation_id"


@query(BASE + f", best AS (SELECT * FROM star WHERE relation = 'corroborates' AND l_doc_id <> r_doc_id ORDER BY weight DESC, confidence DESC, relation_id LIMIT 40) SELECT relation_id, CASE WHEN basis = 'value_bridge' AND {_SCALES.format(c='ld')} <> {_SCALES.format(c='rd')} THEN 0 WHEN basis = 'value_bridge' THEN 1 ELSE 2 END choice FROM best ORDER BY choice, weight DESC, confidence DESC, relation_id LIMIT 1")
def report_case1(spark, root):
    return S.report_corroboration(_star(spark, root), T.facts(spark, root, "display"))


@query(BASE + f", best AS (SELECT *, CAST(l_doc_id <> r_doc_id AS INTEGER) across FROM star WHERE relation = 'contradicts' ORDER BY across DESC, weight DESC, confidence DESC, relation_id LIMIT 60) SELECT relation_id, across FROM best ORDER BY across DESC, {_PLAUSIBLE} DESC, {_CLEAR} LIMIT 1")
def report_case2(spark, root):
    return S.report_contradiction(_star(spark, root), T.facts(spark, root, "value"))


@query(BASE + f""", x AS (SELECT *, unnest(list_distinct(dimensions)) dimension FROM star WHERE relation = 'reconciled_by_context'),
  y AS (SELECT *, list_position(['consolidation','vintage','price_basis','publication','adjustment','aggregation','period'], dimension) place FROM x),
  t AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY weight DESC, confidence DESC, relation_id) rk FROM y WHERE place > 0),
  z AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY CASE WHEN {_PLAUSIBLE} AND len(dimensions) = 1 THEN 0 WHEN {_PLAUSIBLE} THEN 1 ELSE 2 END, {_CLEAR}) k FROM t WHERE rk <= 60),
  w AS (SELECT relation_id, min(place) place, arg_min(dimension, place) dimension FROM z WHERE k = 1 GROUP BY 1) SELECT dimension, relation_id FROM w ORDER BY place LIMIT 3""")
def report_case3(spark, root):
    return S.report_reconciled(_star(spark, root), T.facts(spark, root, "value"))


@query(BASE + "SELECT fact_id, metric, CAST(value_start - char_start AS INTEGER) v_start, CAST(value_end - char_start AS INTEGER) v_end, context['vintage'] vintage FROM f")
def fact_json(spark, root):
    schema = "id string, claim struct<metric: string>, evidence struct<value_start: int, value_end: int>, context map<string, string>"
    read = S.fact_json(T.facts(spark, root)).select("fact_id", F.from_json("body", schema).alias("b"))
    return read.select("fact_id", "b.claim.metric", F.col("b.evidence.value_start").alias("v_start"), F.col("b.evidence.value_end").alias("v_end"), F.try_element_at("b.context", F.lit("vintage")).alias("vintage"))


@query(BASE + ", hub AS (SELECT i FROM (SELECT left_id i FROM r UNION ALL SELECT right_id FROM r) GROUP BY 1 HAVING count(*) >= 10), e AS (SELECT left_id fact_id, relation_id, relation, right_id other_id FROM r UNION ALL SELECT right_id, relation_id, relation, left_id FROM r) SELECT e.fact_id, relation_id, relation, other_id, display other_display FROM e JOIN f ON f.fact_id = other_id WHERE e.fact_id IN (SELECT i FROM hub)")
def fact_detail(spark, root):
    """Details of hub facts (ten relation ends or more), as its SQL has it; ``fact_detail_every`` asks for all facts."""
    rel = T.relations(spark, root)
    ends = rel.select(F.explode(F.array("left_id", "right_id")).alias("fact_id")).groupBy("fact_id").count().where("count >= 10").select("fact_id")
    return S.other_sides(ends, rel, T.facts(spark, root, "display"))


@query(None)
def fact_detail_every(spark, root):
    """Details of every fact that a relation names, however few relations it has."""
    return S.other_sides(None, T.relations(spark, root), T.facts(spark, root, "display"))


@query(BASE + ", g AS (SELECT *, CASE WHEN coalesce(metric_key, '') = '' THEN 0 ELSE len(string_split(metric_key, ' ')) END nw FROM f) SELECT fact_id, CAST(nw AS INTEGER) n_words, confidence FROM g, gen WHERE confidence < 0.85 OR nw < 2 OR coalesce(period_label, '') = '' OR len(list_filter(string_split(coalesce(metric_key, ''), ' '), lambda t: NOT list_contains(g, t))) = 0 ORDER BY nw, confidence, fact_id LIMIT 200".replace("g AS (SELECT *", "ga AS (SELECT *").replace("FROM g, gen", "FROM ga, gen"))
def refiner_candidates(spark, root):
    return S.refiner_candidates(T.facts(spark, root, "metric_key", "confidence", "period_label"), R.GENERIC)


@query("SELECT DISTINCT period_start, year(period_start) + CASE WHEN month(period_start) >= 4 THEN 1 ELSE 0 END fy, CAST((month(period_start) + 8) % 12 // 3 + 1 AS INTEGER) fq FROM facts WHERE period_start IS NOT NULL")
def fiscal_year(spark, root):
    days = table(spark, root, "facts", "period_start").where("period_start is not null").distinct()
    return days.select("period_start", C.fiscal_year(F.col("period_start")).cast("long").alias("fy"), C.fiscal_quarter(F.col("period_start")).alias("fq"))


@query("SELECT DISTINCT subject, trim(regexp_replace(regexp_replace(regexp_replace(lower(subject), '\\b(limited|ltd|pvt|private|inc|incorporated|corp|corporation|plc|llp|llc|company|co)\\b\\.?', '', 'g'), '[^\\w\\s]+', ' ', 'g'), '\\s+', ' ', 'g')) subject_key FROM source_documents WHERE subject IS NOT NULL")
def subject_key(spark, root):
    return table(spark, root, "source_documents", "subject").where("subject is not null").distinct().select("subject", U.subject_key("subject").alias("subject_key"))


@query("""WITH w AS (SELECT DISTINCT metric, list_transform(string_split(trim(regexp_replace(lower(metric), '\\s+', ' ', 'g')), ' '), lambda x: regexp_replace(x, '^[.,;:()\\[\\]''"]+|[.,;:()\\[\\]''"]+$', '', 'g')) ws FROM facts WHERE metric IS NOT NULL),
  s AS (SELECT metric, list_transform(ws, lambda x: CASE WHEN length(x) > 3 AND x LIKE '%s' AND x NOT LIKE '%ss' THEN x[:-2] ELSE x END) ws FROM w)
  SELECT metric, array_to_string(list_filter(ws, lambda x: x <> '' AND x NOT IN ('of','from','in','on','for','to','and','&','per','by','the','a')), ' ') metric_key FROM s""")
def metric_key(spark, root):
    return table(spark, root, "facts", "metric").where("metric is not null").distinct().select("metric", U.metric_key("metric").alias("metric_key"))


@query("SELECT DISTINCT title, filename, CASE WHEN length(nm) <= 24 THEN nm ELSE regexp_replace(regexp_replace(substr(nm, 1, 24), '\\s\\S*$', ''), '[,;:\\s]+$', '') || '…' END short_label FROM (SELECT title, filename, CASE WHEN length(trim(coalesce(title, ''))) > 0 THEN trim(regexp_replace(title, '\\s+', ' ', 'g')) ELSE filename END nm FROM source_documents)")
def short_label(spark, root):
    return table(spark, root, "source_documents", "title", "filename").distinct().withColumn("short_label", C.short_label(F.col("title"), F.col("filename"), 24))


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) text FROM documents WHERE text IS NOT NULL")
def collapse_ws(spark, root):
    return table(spark, root, "documents", "doc_id", "text").where("text is not null").select("doc_id", C.collapse_ws(F.col("text")).alias("text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql is not None}
