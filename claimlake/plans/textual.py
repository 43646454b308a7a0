"""Queries of the text and layout kernels.

Regex kernels with offsets have no SQL form, so most of these render rows of the driver's tables as text or geometry, run
the kernel on it, and are compared with SQL that takes the same values from the tables without any parsing.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimlake.functions import columns as C, udfs as U
from claimlake.operators import concepts as K, layout as L, refine as RF, search as FT
from claimlake.sources import claims as T
from claimlake.plans.spread import spread
from claimlake.sources.tables import table

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


# --- periods -----------------------------------------------------------------------------------------------------

PERIODS = "SELECT DISTINCT period_label, period_kind, period_start, period_end FROM facts WHERE period_kind IN ('fy', 'half', 'quarter', 'cy', 'month') AND period_start IS NOT NULL AND period_label IS NOT NULL"


def _stated(spark: SparkSession, root: str) -> DataFrame:
    """Distinct periods of the facts, each in a phrase as filings write it."""
    kinds = F.col("period_kind").isin("fy", "half", "quarter", "cy", "month") & F.col("period_start").isNotNull() & F.col("period_label").isNotNull()
    rows = table(spark, root, "facts", "period_label", "period_kind", "period_start", "period_end").where(kinds).distinct()
    return rows.withColumn("said", F.when(F.col("period_kind") == "month", F.concat(F.lit("in "), F.date_format("period_start", "MMMM yyyy"))).otherwise(F.concat(F.lit("for "), "period_label")))


@query(PERIODS)
def find_periods(spark, root):
    p = _stated(spark, root).select(F.inline(U.find_periods("said")))
    return p.select(F.col("label").alias("period_label"), F.col("kind").alias("period_kind"), F.col("start").alias("period_start"), F.col("end").alias("period_end"))


@query(f"""SELECT period_label, CASE WHEN period_label LIKE '%FY%' THEN regexp_replace(period_label, '\\d+$', '') || (year(period_end) - CASE WHEN month(period_end) >= 4 THEN 0 ELSE 1 END)
    WHEN period_kind = 'cy' THEN 'CY' || (year(period_start) - 1) ELSE (CAST(substr(period_label, 1, 4) AS INTEGER) - 1) || substr(period_label, 5) END earlier_label,
  CAST(period_start - INTERVAL 1 YEAR AS DATE) earlier_start FROM ({PERIODS})""")
def shift_back(spark, root):
    p = _stated(spark, root).select("period_label", F.inline(U.earlier_periods("said")))
    return p.select("period_label", F.col("label").alias("earlier_label"), F.col("start").alias("earlier_start"))


@query("""SELECT DISTINCT 'Q' || CAST((month(d) + 8) % 12 // 3 + 1 AS INTEGER) || ' FY' || (year(d) + CASE WHEN month(d) >= 4 THEN 1 ELSE 0 END) AS label, CAST(date_trunc('quarter', d) AS DATE) period_start, CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) period_end FROM (SELECT CAST(o_orderdate AS DATE) d FROM orders)""")
def period_bounds(spark, root):
    d = table(spark, root, "orders", "o_orderdate").select(F.to_date("o_orderdate").alias("d")).distinct()
    said = F.format_string("Q%d FY%02d revenue", C.fiscal_quarter(F.col("d")), C.fiscal_year(F.col("d")) % 100)
    return d.select(said.alias("said")).distinct().select(F.inline(U.find_periods("said"))).select("label", F.col("start").alias("period_start"), F.col("end").alias("period_end"))


# --- quantities --------------------------------------------------------------------------------------------------

CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"


def _grouped(whole: Column) -> Column:
    return F.format_number(whole, 0)


@query(f"SELECT o_orderkey, 'USD' unit, {CENTS} cents, 1 n FROM orders")
def find_quantities(spark, root):
    o = table(spark, root, "orders", "o_orderkey", "o_totalprice").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    said = F.concat(F.lit("The order was booked at US$ "), _grouped(F.floor(F.col("cents") / 100)), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"), F.lit(" in FY2024."))
    q = o.select("o_orderkey", U.find_quantities(said).alias("q"))
    return q.select("o_orderkey", F.col("q")[0]["unit"].alias("unit"), F.round(F.col("q")[0]["value"] * 100).cast("long").alias("cents"), F.size("q").alias("n"))


UNITS4 = ["Revenue (₹ Cr)", "Revenue (US$ million)", "Inflation (per cent)", "Order book"]


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'INR' WHEN 1 THEN 'USD' END currency, CASE p_size % 4 WHEN 0 THEN 1e7 WHEN 1 THEN 1e6 ELSE 1.0 END::DOUBLE scale, p_size % 4 = 2 percent FROM part")
def unit_context(spark, root):
    p = table(spark, root, "part", "p_partkey", "p_size")
    said = F.array(*map(F.lit, UNITS4))[F.col("p_size") % 4]
    return p.select("p_partkey", U.declared_unit(said).alias("d")).select("p_partkey", "d.currency", "d.scale", "d.percent")


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 1000 AS counted FROM lineitem")
def span_mask(spark, root):
    """Numbers inside period mentions are no quantities."""
    li = spread(table(spark, root, "lineitem", "l_orderkey", "l_linenumber", "l_quantity"))
    said = F.concat(F.lit("In FY2024 and 2024-25 the depot moved "), _grouped(F.col("l_quantity").cast("long") * 1000), F.lit(" parcels by March 31, 2024."))
    q = li.select("l_orderkey", "l_linenumber", U.find_quantities(said).alias("q")).where(F.size("q") == 1)
    return q.select("l_orderkey", "l_linenumber", F.col("q")[0]["value"].cast("long").alias("counted"))


# --- kernels over the pages themselves ---------------------------------------------------------------------------

def _pages(spark: SparkSession, root: str) -> DataFrame:
    return spread(T.pages(spark, root).select("doc_id", "page_no", "text")).where("text is not null")


@query()
def quantities_pages(spark, root):
    """Every quantity of every page, with its place."""
    return _pages(spark, root).select("doc_id", "page_no", F.inline(U.page_quantities("text")))


@query()
def periods_pages(spark, root):
    return _pages(spark, root).select("doc_id", "page_no", F.inline(U.find_periods("text")))


@query()
def qualifiers_pages(spark, root):
    return _pages(spark, root).select("doc_id", "page_no", F.inline(U.find_qualifiers("text")))


@query()
def units_pages(spark, root):
    return _pages(spark, root).select("doc_id", "page_no", F.inline(U.units("text")))


@query()
def declared_units_pages(spark, root):
    """What each line of every page declares, lines counted from 0."""
    lines = _pages(spark, root).select("doc_id", "page_no", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "page_no", "line_no", U.declared_unit("line").alias("d")).select("doc_id", "page_no", "line_no", "d.*")


@query()
def normalised_pages(spark, root):
    return _pages(spark, root).select("doc_id", "page_no", U.normalise_text("text").alias("text"))


# --- qualifiers --------------------------------------------------------------------------------------------------

PHRASES = {"AUTOMOBILE": ("consolidation", "standalone", "on a standalone basis"), "BUILDING": ("vintage", "advance_estimate", "first advance estimates"), "FURNITURE": ("price_basis", "real", "at constant prices"), "MACHINERY": ("comparison", "yoy", "year-on-year"), "HOUSEHOLD": ("aggregation", "per_capita", "per capita")}


def _phrase(segment: Column) -> Column:
    known = F.create_map(*(F.lit(x) for s, (_, _, said) in PHRASES.items() for x in (s, said)))
    return F.coalesce(F.try_element_at(known, F.upper(segment)), F.lit("net of"))


def _case(k: int, default: str) -> str:
    return "CASE upper(c_mktsegment) " + " ".join(f"WHEN '{s}' THEN '{v[k]}'" for s, v in PHRASES.items()) + f" ELSE '{default}' END"


@query(f"SELECT c_custkey, {_case(0, 'adjustment')} dimension, {_case(1, 'excluding')} \"value\" FROM customer")
def find_qualifiers(spark, root):
    c = table(spark, root, "customer", "c_custkey", "c_mktsegment")
    said = F.concat(F.lit("The figure, "), _phrase(F.col("c_mktsegment")), F.lit(", was 5 percent."))
    return c.select("c_custkey", F.inline(U.find_qualifiers(said))).select("c_custkey", "dimension", "value")


@query(f"SELECT c_custkey, {_case(1, 'excluding')} first_value FROM customer")
def as_context(spark, root):
    """One value for each dimension: the first mention wins."""
    c = table(spark, root, "customer", "c_custkey", "c_mktsegment")
    said = F.concat(F.lit("Stated "), _phrase(F.col("c_mktsegment")), F.lit(" and restated, consolidated, revised, nominal, qoq, median."))
    own = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for s, (d, _, _) in PHRASES.items() for x in (s, d))), F.upper("c_mktsegment")), F.lit("adjustment"))
    return c.select("c_custkey", U.context_said(said).alias("context"), own.alias("own")).select("c_custkey", F.col("context")[F.col("own")].alias("first_value"))


# --- facts -------------------------------------------------------------------------------------------------------

AMOUNT = "(c_custkey * 7919 % 900000 + 1000)"


def _amount(c: Column) -> Column:
    return c * 7919 % 900000 + 1000


def _fy(c: Column) -> Column:
    return (c % 9 + 16).cast("int")


def _facts(rows: DataFrame, said: Column, *keep: str) -> DataFrame:
    return rows.select(*keep, F.posexplode(U.facts_on_page(said, F.lit("Orrin Mills"))).alias("ord", "f")).select(*keep, "ord", "f.*")


@query(f"SELECT c_custkey, 0 ord, 'revenue from operations' metric, CAST({AMOUNT} AS BIGINT) * 10000 amount, 'INR' unit, 'FY' || (2016 + c_custkey % 9) period_label, CASE WHEN c_custkey % 2 = 0 THEN 'standalone' ELSE 'consolidated' END consolidation, 0.95::DOUBLE confidence FROM customer")
def extract_facts(spark, root):
    c = table(spark, root, "customer", "c_custkey")
    a = _amount(F.col("c_custkey"))
    basis = F.when(F.col("c_custkey") % 2 == 0, "standalone").otherwise("consolidated")
    said = F.concat(F.lit("The revenue from operations on "), basis, F.lit(" basis for FY"), _fy(F.col("c_custkey")).cast("string"), F.lit(" stood at ₹ "), _grouped(F.floor(a / 100)), F.lit("."), F.lpad((a % 100).cast("string"), 2, "0"), F.lit(" million."))
    f = _facts(c, said, "c_custkey")
    return f.select("c_custkey", "ord", "metric", F.round("value").cast("long").alias("amount"), "unit", "period_label", F.element_at("context", F.lit("consolidation")).alias("consolidation"), "confidence")


@query(f"SELECT c_custkey, 0 ord, {AMOUNT} crore, 'FY' || (2016 + c_custkey % 9) period_label FROM customer UNION ALL SELECT c_custkey, 1, {AMOUNT} - 500, 'FY' || (2015 + c_custkey % 9) FROM customer")
def period_attribution(spark, root):
    c, a = table(spark, root, "customer", "c_custkey"), _amount(F.col("c_custkey"))
    y = _fy(F.col("c_custkey"))
    said = F.concat(F.lit("Revenue for FY"), y.cast("string"), F.lit(" stood at ₹"), _grouped(a), F.lit(" crore as against ₹"), _grouped(a - 500), F.lit(" crore for FY"), (y - 1).cast("string"), F.lit("."))
    return _facts(c, said, "c_custkey").select("c_custkey", "ord", F.round(F.col("value") / 1e7).cast("long").alias("crore"), "period_label")


@query("SELECT c_custkey, 0 ord, 'consolidated' consolidation FROM customer UNION ALL SELECT c_custkey, 1, 'standalone' FROM customer")
def qualifier_attribution(spark, root):
    c, a = table(spark, root, "customer", "c_custkey"), _amount(F.col("c_custkey"))
    said = F.concat(F.lit("Total income on a consolidated basis was ₹"), a.cast("string"), F.lit(" crore in FY24, while the net profit of the parent on a standalone basis was ₹"), (a - 7).cast("string"), F.lit(" crore."))
    return _facts(c, said, "c_custkey").select("c_custkey", "ord", F.element_at("context", F.lit("consolidation")).alias("consolidation"))


@query("""WITH f AS (SELECT DISTINCT fact_id, evidence e, label_start ls, label_end le, value_start - char_start vs, value_end - char_start ve FROM facts WHERE label_start IS NOT NULL AND label_end IS NOT NULL AND evidence IS NOT NULL AND fact_id IS NOT NULL),
  g AS (SELECT fact_id, CASE WHEN le <= vs THEN CAST(vs - le AS DOUBLE) WHEN ls >= ve THEN CAST(ls - ve AS DOUBLE) * 1.1::DOUBLE ELSE 0.0::DOUBLE END gap,
    length(replace(substr(e, 1, ls), ')', '')) - length(replace(substr(e, 1, ls), '(', '')) = length(replace(substr(e, 1, vs), ')', '')) - length(replace(substr(e, 1, vs), '(', '')) level FROM f)
  SELECT fact_id, CASE WHEN level THEN gap ELSE gap * 4.0::DOUBLE END distance FROM g""")
def span_distance(spark, root):
    """How far a fact's label stands from its value, asides farther."""
    f = table(spark, root, "facts", "fact_id", "evidence", "label_start", "label_end", "value_start", "value_end", "char_start")
    f = f.dropna(subset=["label_start", "label_end", "evidence", "fact_id"]).distinct()
    return f.select("fact_id", U.span_distance("evidence", "label_start", "label_end", F.col("value_start") - F.col("char_start"), F.col("value_end") - F.col("char_start")).alias("distance"))


BASES = ["GDP", "gross output", "total income", "net sales"]


@query("SELECT s_suppkey, CASE s_suppkey % 4 " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(BASES)) + " END base FROM supplier")
def denominator(spark, root):
    s = table(spark, root, "supplier", "s_suppkey")
    base = F.array(*map(F.lit, BASES))[(F.col("s_suppkey") % 4).cast("int")]
    said = F.concat(F.lit("The deficit declined to "), (F.col("s_suppkey") % 90 + 10).cast("string"), F.lit(" percent of "), base, F.lit(" in FY25."))
    return s.select("s_suppkey", U.denominator(said).alias("base"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'freight revenue' WHEN 1 THEN 'freight revenue growth' ELSE 'express parcels' END metric FROM part")
def metric_phrase(spark, root):
    p = table(spark, root, "part", "p_partkey", "p_size")
    n = (F.col("p_size") + 100).cast("string")
    said = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("The freight revenue stood at ₹"), n, F.lit(" crore in FY24."))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("Orrin's freight revenue grew by "), n, F.lit(" percent in FY24."))).otherwise(F.concat(F.lit("It carried "), n, F.lit(" million express parcels in FY24.")))
    return _facts(p, said, "p_partkey").select("p_partkey", "metric")


@query()
def extract_facts_pages(spark, root):
    """Facts of all pages as they are, with the subjects of their documents."""
    return U.extract_facts(table(spark, root, "pages", "doc_id", "page_no", "text"), T.documents(spark, root, "subject", "title")).select("fact_id", "doc_id", "page_no", "metric", "value", "unit", "period_label", "confidence")


@query("SELECT count(*) n_pages, 0::BIGINT n_bad FROM (SELECT DISTINCT doc_id, page_no FROM pages)")
def grounded_facts(spark, root):
    """Pages with a fact whose evidence or display is not the text at its offsets: none."""
    p = spread(table(spark, root, "pages", "doc_id", "page_no", "text"), "doc_id", "page_no")
    f = U.facts_on_page("text", F.lit("x"))
    bad = lambda x: (F.col("text").substr(x["char_start"] + 1, x["char_end"] - x["char_start"]) != x["evidence"]) | (F.trim(F.regexp_replace(F.col("text").substr(x["value_start"] + 1, x["value_end"] - x["value_start"]), r"^\s+|\s+$", "")) != x["display"])
    judged = p.select("doc_id", "page_no", "text", f.alias("f")).select("doc_id", "page_no", F.exists("f", bad).alias("bad"))
    return judged.groupBy("doc_id", "page_no").agg(F.bool_or("bad").alias("bad")).agg(F.count("*").alias("n_pages"), F.count_if("bad").alias("n_bad"))


# --- text --------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name || ' - ' || c_mktsegment || '...' AS text FROM customer")
def normalise_text(spark, root):
    c = table(spark, root, "customer", "c_custkey", "c_name", "c_mktsegment")
    raw = F.concat(F.lit("  "), "c_name", F.lit("  –\t"), F.lit("​"), "c_mktsegment", F.lit("… \n"))
    return c.select("c_custkey", U.normalise_text(raw).alias("text"))


@query("""SELECT s_suppkey, unnest([0, 1, 2]) ord, unnest(['sentence', 'sentence', 'row']) kind, unnest(['Rs. 8,142 crore was reported by Mr. ' || s_name || '.', 'The next sentence (No. ' || s_suppkey || ') starts here.', 'Term loan ' || (s_suppkey + 100) || ' ' || (s_suppkey + 26)]) AS text FROM supplier""")
def units(spark, root):
    s = table(spark, root, "supplier", "s_suppkey", "s_name")
    page = F.concat(F.lit("Rs. 8,142 crore was reported by Mr. "), "s_name", F.lit(". The next sentence (No. "), F.col("s_suppkey").cast("string"), F.lit(") starts here.\n\nTerm loan "), (F.col("s_suppkey") + 100).cast("string"), F.lit(" "), (F.col("s_suppkey") + 26).cast("string"))
    u = s.withColumn("page", page).select("s_suppkey", "page", F.posexplode(U.units("page")).alias("ord", "u"))
    return u.select("s_suppkey", "ord", "u.kind", F.col("page").substr(F.col("u.at") + 1, F.col("u.to") - F.col("u.at")).alias("text"))


@query("SELECT count(*) n_pages, 0::BIGINT n_bad FROM (SELECT DISTINCT doc_id, page_no FROM pages)")
def verify_units(spark, root):
    """Pages whose units overlap, run backwards or hold outer white space: none."""
    p = T.pages(spark, root).select("text", U.units("text").alias("u"))
    piece = lambda u: F.col("text").substr(u["at"] + 1, u["to"] - u["at"])
    bad = F.exists("u", lambda u: (u["to"] <= u["at"]) | (piece(u) != F.regexp_replace(piece(u), r"^\s+|\s+$", "")))
    order = F.exists(F.zip_with(F.slice("u", 1, F.greatest(F.size("u") - 1, F.lit(0))), F.slice("u", 2, F.greatest(F.size("u") - 1, F.lit(0))), lambda a, b: a["to"] > b["at"]), lambda x: x)
    return p.agg(F.count("*").alias("n_pages"), F.count_if(bad | order).alias("n_bad"))


_BLANKS = "string_split(trim(regexp_replace(evidence, '[\\s\\p{Z}]+', ' ', 'g')), ' ')"
_ROW = f"len(list_filter({_BLANKS}, lambda w: regexp_matches(w, '^[(\\[]?[₹$€£]?-?[\\p{{Nd}},]+(\\.\\p{{Nd}}+)?\\)?%?$'))) >= 2 AND len({_BLANKS}) >= 2 AND NOT regexp_matches(evidence, '[.!?][\\s\\p{{Z}}]')"


@query(f"SELECT fact_id, bool_or({_ROW}) is_row FROM facts WHERE evidence IS NOT NULL AND fact_id IS NOT NULL GROUP BY 1")
def unit_kind(spark, root):
    f = table(spark, root, "facts", "fact_id", "evidence").where("evidence is not null and fact_id is not null").distinct().select("fact_id", U.is_row("evidence").alias("row"))
    return f.groupBy("fact_id").agg(F.bool_or("row").alias("is_row"))


@query("""SELECT DISTINCT metric, NOT regexp_matches(trim(metric), '^[(+\\-]?[₹$€£]?\\s?\\d[\\d,]*\\.?\\d*\\)?\\s?%?$') AND len(w) BETWEEN 1 AND 12 AND length(regexp_replace(regexp_replace(metric, '\\s', '', 'g'), '[^\\p{L}]', '', 'g')) / greatest(length(regexp_replace(metric, '\\s', '', 'g')), 1) >= 0.6 AND len(list_filter(w, lambda x: regexp_matches(x, '^\\p{L}{3,}'))) > 0 caption
  FROM (SELECT metric, list_filter(string_split(trim(regexp_replace(metric, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') w FROM facts WHERE metric IS NOT NULL)""")
def is_label(spark, root):
    return table(spark, root, "facts", "metric").where("metric is not null").distinct().select("metric", U.is_caption("metric").alias("caption"))


@query("SELECT DISTINCT metric, CAST(len(list_filter(string_split(trim(regexp_replace(metric, '\\s+', ' ', 'g')), ' '), lambda x: regexp_matches(x, '^\\p{L}{3,}$'))) AS INTEGER) content_words FROM facts WHERE metric IS NOT NULL")
def phrase_quality(spark, root):
    return table(spark, root, "facts", "metric").where("metric is not null").distinct().select("metric", U.content_words("metric").alias("content_words"))


@query("SELECT metric, CAST(len(regexp_extract_all(metric, '[A-Za-z][A-Za-z.''’&-]*|[^\\sA-Za-z]')) AS INTEGER) n_tokens FROM (SELECT DISTINCT metric FROM facts WHERE metric IS NOT NULL)")
def metric_tokens(spark, root):
    return table(spark, root, "facts", "metric").where("metric is not null").distinct().select("metric", F.size(U.metric_tokens("metric")).alias("n_tokens"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END meta_date FROM orders")
def meta_date(spark, root):
    from claimlake.sources.binary import meta_date as read

    o = table(spark, root, "orders", "o_orderkey", "o_orderdate")
    raw = F.when(F.col("o_orderkey") % 5 == 0, "D:20231399").otherwise(F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("103000+05'30'")))
    return o.select("o_orderkey", read(raw).alias("meta_date"))


@query()
def detect_subject(spark, root):
    return U.detect_subjects(T.pages(spark, root), T.documents(spark, root, "title"))


# --- concepts ----------------------------------------------------------------------------------------------------


@query()
def assign_concepts(spark, root):
    return K.assign_concepts(table(spark, root, "facts", "metric_key", "metric", "recorded_at", "fact_id")).select("metric_key", "concept_id")


@query()
def concept_labels(spark, root):
    return K.assign_concepts(table(spark, root, "facts", "metric_key", "metric", "recorded_at", "fact_id")).select("concept_id", "canonical_key", "label").distinct()


@query()
def concept_merge(spark, root):
    facts = table(spark, root, "facts", "metric_key", "metric", "recorded_at", "fact_id")
    keys = facts.select("metric_key").where(F.length("metric_key") > 0).distinct()
    close = K.candidate_pairs(keys).where("score >= 0.9").select("left_key", "right_key")
    return K.merge_concepts(K.assign_concepts(facts), close)


# --- search ------------------------------------------------------------------------------------------------------

INDEX = """WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY recorded_at) rn FROM facts WHERE fact_id IS NOT NULL) WHERE rn = 1),
  t AS (SELECT fact_id, 'metric' field, metric AS x FROM f UNION ALL SELECT fact_id, 'evidence', evidence FROM f UNION ALL SELECT fact_id, 'subject', subject FROM f),
  i AS (SELECT fact_id, field, unnest(list_filter(string_split(lower(regexp_replace(x, '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '')) token FROM t)"""


@query(INDEX + " SELECT token, field, count(*) n, count(DISTINCT fact_id) n_facts FROM i GROUP BY 1, 2")
def fts_index(spark, root):
    postings = FT.plain_index(T.facts(spark, root, *FT.COLUMNS))
    return postings.groupBy("token", "field").agg(F.count("*").alias("n"), F.count_distinct("fact_id").alias("n_facts"))


@query(INDEX + " SELECT fact_id FROM i GROUP BY 1 HAVING (bool_or(token = 'haulage') OR bool_or(field = 'metric' AND token LIKE 'parc%')) AND bool_or(token = 'growth' OR token = 'stood') AND NOT bool_or(token = 'grain')")
def search_facts(spark, root):
    return FT.search(FT.plain_index(T.facts(spark, root, *FT.COLUMNS)), "(haulag* OR metric:parc*) AND (growth OR stood) NOT grain")


@query()
def fts_index_stemmed(spark, root):
    """As ``fts_index`` over the stemmed index, which searches are meant for."""
    postings = FT.index(T.facts(spark, root, *FT.COLUMNS))
    return postings.groupBy("token", "field").agg(F.count("*").alias("n"), F.count_distinct("fact_id").alias("n_facts"))


@query()
def search_facts_stemmed(spark, root):
    """Words in any of their forms, on the stemmed index."""
    return FT.search(FT.index(T.facts(spark, root, *FT.COLUMNS)), "(haulage OR metric:parcels) AND (growth OR standing OR stood) NOT grains")


@query()
def refiner_stats(spark, root):
    """A refinement by a stub client that quotes the evidence and proposes a period."""
    facts = T.facts(spark, root, "doc_id", "page_no", "metric", "metric_key", "evidence", "value", "confidence", "period_label", "period_kind", "period_start", "period_end", "context", "extractor")

    def client(rows):
        return [{"fact_id": r[0], "metric": r[1], "period": "FY24", "context": {"vintage": "actual"}, "evidence_quote": r[2], "usable": len(r[1] or "") > 3} for r in rows]

    return RF.refiner_stats(facts, RF.refine(facts, T.pages(spark, root), client))


# --- layout ------------------------------------------------------------------------------------------------------

def _lines(spark: SparkSession, root: str) -> DataFrame:
    """Two-column pages of suppliers: a line each, in the order in which a naive scan meets them."""
    s = table(spark, root, "supplier", "s_suppkey", "s_name")
    n = F.col("s_suppkey")
    k = n % 40
    x0 = F.when(k % 2 == 0, 60.0).otherwise(320.0)
    y0 = 100.0 + F.floor(k / 2) * 14.0
    return s.select(F.concat(F.lit("doc"), F.floor(n / 400).cast("string")).alias("doc_id"), F.floor(n % 400 / 40).cast("int").alias("page_no"), F.lit(600.0).alias("page_w"), F.lit(800.0).alias("page_h"), k.cast("int").alias("line_no"), x0.alias("x0"), y0.alias("y0"), (x0 + 220.0).alias("x1"), (y0 + 11.0).alias("y1"), F.concat(F.lit("supplier of goods "), "s_name").alias("text"))


KEY = "SELECT s_suppkey, s_name, 'doc' || (s_suppkey // 400) doc_id, CAST(s_suppkey % 400 // 40 AS INTEGER) page_no, CAST(s_suppkey % 40 AS INTEGER) line_no FROM supplier"


@query(f"SELECT doc_id, page_no, count(*) n_lines FROM ({KEY}) GROUP BY 1, 2")
def scan_lines(spark, root):
    noise = _lines(spark, root).where("line_no = 0").withColumns({"line_no": F.lit(99), "text": F.lit(" ​. ")})
    return L.scan_lines(_lines(spark, root).unionByName(noise)).groupBy("doc_id", "page_no").agg(F.count("*").alias("n_lines"))


@query(f"SELECT DISTINCT doc_id, page_no, CASE WHEN n = 1 THEN NULL ELSE 300.0 END::DOUBLE middle FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, page_no) n FROM ({KEY})) WHERE n > 1")
def find_gutter(spark, root):
    return L.gutters(_lines(spark, root)).select("doc_id", "page_no", (F.round(F.col("middle") / 10) * 10).alias("middle"))


@query(f"SELECT doc_id, page_no, line_no, CAST(line_no // 2 + CASE WHEN line_no % 2 = 1 THEN (n + 1) // 2 ELSE 0 END AS INTEGER) place, 2 n_columns FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, page_no) n FROM ({KEY}))")
def reading_order(spark, root):
    return L.reading_order(_lines(spark, root)).select("doc_id", "page_no", "line_no", "place", "n_columns")


@query(f"SELECT doc_id, page_no, string_agg(CASE WHEN line_no % 2 = 0 THEN 'supplier of goods ' || s_name END, ' ' ORDER BY line_no) || chr(10) || chr(10) || string_agg(CASE WHEN line_no % 2 = 1 THEN 'supplier of goods ' || s_name END, ' ' ORDER BY line_no) AS text, 2 n_columns FROM ({KEY}) GROUP BY 1, 2")
def paragraphs(spark, root):
    return L.pages_from_lines(_lines(spark, root)).select("doc_id", "page_no", "text", "n_columns")


@query("SELECT CAST(s_suppkey AS VARCHAR) doc_id, s_suppkey || '. ' || s_name || ' 1,234' AS text, 2 n_cells FROM supplier")
def visual_lines(spark, root):
    """A number, a name a little to the right and a figure far to the right make one line of two cells."""
    s = table(spark, root, "supplier", "s_suppkey", "s_name")
    piece = lambda i, x0, x1, text: F.struct(F.lit(i).alias("line_no"), F.lit(x0).alias("x0"), F.lit(100.0 + i / 10).alias("y0"), F.lit(x1).alias("x1"), F.lit(111.0).alias("y1"), text.alias("text"))
    pieces = F.array(piece(0, 60.0, 80.0, F.concat(F.col("s_suppkey").cast("string"), F.lit("."))), piece(1, 83.0, 200.0, F.col("s_name")), piece(2, 300.0, 340.0, F.lit("1,234")))
    lines = s.select(F.col("s_suppkey").cast("string").alias("doc_id"), F.lit(1).alias("page_no"), F.lit(600.0).alias("page_w"), F.lit(800.0).alias("page_h"), F.inline(pieces))
    return L.visual_rows(lines).select("doc_id", "text", "n_cells")


@query(f"SELECT doc_id, page_no, count(*) n_cells, 0::BIGINT n_bad FROM ({KEY}) GROUP BY 1, 2")
def cells(spark, root):
    """Cells of each page and those that are not the page's text at their place: none."""
    p = L.pages_from_lines(_lines(spark, root))
    bad = lambda c: F.col("text").substr(c["at"] + 1, c["to"] - c["at"]) != c["text"]
    return p.select("doc_id", "page_no", F.size("cells").cast("long").alias("n_cells"), F.size(F.filter("cells", bad)).cast("long").alias("n_bad"))


def _tiles(spark: SparkSession, root: str) -> DataFrame:
    """Tables of parts: a header row, then rows of a caption and two numbers, ten parts to a page."""
    p = table(spark, root, "part", "p_partkey", "p_size")
    n = F.col("p_partkey")
    doc, page, k = F.concat(F.lit("t"), F.floor(n / 1000).cast("string")), F.floor(n % 1000 / 10).cast("int"), n % 10
    y = 140.0 + k * 30.0
    piece = lambda i, x0, x1, at, text: F.struct(F.lit(i).alias("i"), F.lit(x0).alias("x0"), F.lit(x1).alias("x1"), at.alias("y0"), text.alias("text"))
    body = F.array(piece(0, 60.0, 140.0, y, F.concat(F.lit("1,"), F.lpad((F.col("p_size") + 100).cast("string"), 3, "0"))), piece(1, 60.0, 140.0, y + 12.0, F.concat(F.lit("Orders of part "), F.col("p_partkey").cast("string"))))
    heads = F.when(k == 0, F.array(piece(2, 60.0, 140.0, F.lit(110.0), F.lit("FY24 consolidated")))).otherwise(F.array().cast("array<struct<i:int,x0:double,x1:double,y0:double,text:string>>"))
    rows = p.select(doc.alias("doc_id"), page.alias("page_no"), (k * 3).cast("int").alias("base"), F.explode(F.concat(body, heads)).alias("e"))
    return rows.select("doc_id", "page_no", F.lit(600.0).alias("page_w"), F.lit(800.0).alias("page_h"), (F.col("base") + F.col("e.i")).alias("line_no"), "e.x0", "e.y0", "e.x1", (F.col("e.y0") + 10.0).alias("y1"), "e.text")


TILE = "SELECT p_partkey, p_size, 't' || (p_partkey // 1000) doc_id, CAST(p_partkey % 1000 // 10 AS INTEGER) page_no, CAST(p_partkey % 10 AS INTEGER) k FROM part"


@query(f"SELECT doc_id, page_no, '1,' || lpad(CAST(p_size + 100 AS VARCHAR), 3, '0') AS \"value\", 'Orders of part ' || p_partkey caption FROM ({TILE})")
def label_for(spark, root):
    c = L.cells(L.pages_from_lines(_tiles(spark, root)))
    return L.captions(c).join(c.select("doc_id", "page_no", F.col("cell_no").alias("v_cell_no"), F.col("text").alias("value")), ["doc_id", "page_no", "v_cell_no"]).select("doc_id", "page_no", "value", "caption")


@query(f"SELECT doc_id, page_no, '1,' || lpad(CAST(p_size + 100 AS VARCHAR), 3, '0') AS \"value\", 'FY24 consolidated' header FROM ({TILE}) WHERE 20 + 30 * k <= 160")
def column_headers(spark, root):
    c = L.cells(L.pages_from_lines(_tiles(spark, root)))
    found = L.column_headers(c).where("header = 'FY24 consolidated'")
    return found.join(c.select("doc_id", "page_no", F.col("cell_no").alias("v_cell_no"), F.col("text").alias("value")), ["doc_id", "page_no", "v_cell_no"]).select("doc_id", "page_no", "value", "header")


@query(f"SELECT doc_id, page_no, count(*) n FROM ({TILE}) GROUP BY 1, 2")
def cell_at(spark, root):
    """Each number's span, found again in the page's text, lies in its own cell."""
    p = L.pages_from_lines(_tiles(spark, root))
    c = L.cells(p)
    spans = c.where("numeric").select("doc_id", "page_no", F.col("at").alias("span_at"), F.col("to").alias("span_to"), F.col("cell_no").alias("own"))
    hit = L.cell_at(spans.drop("own"), c).join(spans, ["doc_id", "page_no", "span_at", "span_to"]).where("own = cell_no")
    return hit.groupBy("doc_id", "page_no").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, page_no, CAST(page_no + 1 AS VARCHAR) printed_label FROM ({KEY}) GROUP BY 1, 2")
def printed_label(spark, root):
    lines = _lines(spark, root)
    foot = lines.where("line_no = 0").withColumns({"line_no": F.lit(99), "y0": F.lit(770.0), "y1": F.lit(780.0), "text": F.concat(F.lit("page "), (F.col("page_no") + 1).cast("string"))})
    return L.pages_from_lines(lines.unionByName(foot)).select("doc_id", "page_no", "printed_label")


@query("SELECT DISTINCT fact_id, len(list_filter(string_split(trim(regexp_replace(evidence, '[\\s\\p{Z}]+', ' ', 'g')), ' '), lambda w: regexp_matches(w, '^[(\\[]?[₹$€£]?-?[\\p{Nd},]+(\\.\\p{Nd}+)?\\)?%?$'))) >= 2 tabular FROM facts WHERE evidence IS NOT NULL AND fact_id IS NOT NULL")
def is_tabular(spark, root):
    f = table(spark, root, "facts", "fact_id", "evidence").where("evidence is not null and fact_id is not null").distinct()
    return f.select("fact_id", U.is_tabular("evidence").alias("tabular")).distinct()


@query(f"SELECT doc_id, page_no, line_no % 2 side, CASE WHEN line_no % 2 = 0 THEN 280.0 ELSE 540.0 END::DOUBLE edge FROM ({KEY}) GROUP BY ALL")
def right_edges(spark, root):
    """Right margin of each side: the nearest-rank 90th percentile of where lines end."""
    x = _lines(spark, root).groupBy("doc_id", "page_no", (F.col("line_no") % 2).alias("side")).agg(F.array_sort(F.collect_list("x1")).alias("xs"))
    return x.select("doc_id", "page_no", "side", U.right_edge("xs").alias("edge"))


@query(f"SELECT doc_id, page_no, line_no % 2 side, count(*) >= 4 prose FROM ({KEY}) GROUP BY ALL")
def text_column(spark, root):
    """Whether each side reads like prose: four lines or more, a quarter of them wide."""
    x = _lines(spark, root).groupBy("doc_id", "page_no", (F.col("line_no") % 2).alias("side"))
    x = x.agg(F.collect_list(F.struct("x0", "x1")).alias("xs"))
    return x.select("doc_id", "page_no", "side", U.is_prose("xs.x0", "xs.x1").alias("prose"))


@query("SELECT c_custkey, n ord, 'FY' || (2016 + c_custkey % 9 - n) period_label, CASE n WHEN 0 THEN 'consolidated' ELSE 'standalone' END consolidation, 'parcel shipments' metric FROM customer, (VALUES (0), (1)) t(n)")
def header_context(spark, root):
    """Bare numbers of a table take period and basis from the headers above their columns, and their metric from the row."""
    c, year = table(spark, root, "customer", "c_custkey"), _fy(F.col("c_custkey"))
    heads = [F.concat(F.lit("FY"), (year - n).cast("string"), F.lit(f" {basis}")) for n, basis in enumerate(("consolidated", "standalone"))]
    return _table_facts(c, heads, F.lit("Parcel shipments")).select("c_custkey", "ord", "period_label", F.element_at("context", F.lit("consolidation")).alias("consolidation"), F.lower("metric").alias("metric"))


@query("""SELECT c_custkey, n ord, m || lower(c_mktsegment) metric, upper(m[1]) || m[2:] || lower(c_mktsegment) label_text
  FROM customer, (VALUES (0, 'express parcels of '), (1, 'shared trucks of ')) t(n, m)""")
def caption_recovery(spark, root):
    """Numbers whose row names nothing take the captions in the line beside them."""
    c = spread(table(spark, root, "customer", "c_custkey", "c_mktsegment"))
    captions = [F.concat(F.lit(f"{what} of "), F.lower("c_mktsegment")) for what in ("Express parcels", "Shared trucks")]
    return _table_facts(c, [F.lit("FY24"), F.lit("FY23")], F.lit("+ +"), captions).select("c_custkey", "ord", F.lower("metric").alias("metric"), "label_text")


def _table_facts(rows: DataFrame, heads: list[Column], stub: Column, captions: list[Column] | None = None) -> DataFrame:
    """Facts of a table per customer, one row and two columns of numbers, laid out and extracted with its cells.

    Tables of a batch that are equal are laid out and read once.
    """
    from pyspark.sql import types as S

    from claimlake.functions import facts as X, layout as G

    kind = S.ArrayType(U.FACT)

    def read(tops: tuple, name: str, below: tuple | None) -> list[dict]:
        lines = [G.Line(290, 100, 380, 110, tops[0]), G.Line(410, 100, 500, 110, tops[1]), G.Line(60, 140, 180, 150, name), G.Line(310, 140, 360, 150, "12,345"), G.Line(430, 140, 480, 150, "67,890")]
        if below is not None:
            lines += [G.Line(290, 152, 380, 162, below[0]), G.Line(410, 152, 500, 162, below[1])]
        page, _, cells = G.page_from_lines(lines, 600, 800)
        facts = [U._flat(f) for f in X.facts_on_page(page, "Orrin", cells)]
        return [f | {"context": list(f["context"].items())} for f in facts]

    @F.arrow_udf(kind)
    def told(tops: pa.Array, names: pa.Array, below: pa.Array) -> pa.Array:
        return U.each_once(read, kind, tops, names, below)

    below = F.array(*captions) if captions else F.lit(None).cast("array<string>")
    facts = F.posexplode(told(F.array(*heads), stub, below)).alias("ord", "f")
    return rows.select("c_custkey", facts).select("c_custkey", "ord", "f.*")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
