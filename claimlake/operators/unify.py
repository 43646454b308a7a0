"""Quantities recorded in different units.

Every value is read from its text and converted exactly. Where the text has no unit, a calibrated tree ensemble predicts
unit and scale from magnitude, source, category and neighbouring fields. A confident prediction is the result; only
uncertain records are reviewed, and the review takes the unit that is declared for the record: in its evidence, with the
mention, or nearest above its row on the page. What is declared is no feature of the ensemble.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from claimlake.functions import units as U
from claimlake.plans.sample import smallest_hashes
from claimlake.plans.scratch import Scratch
from claimlake.plans.spread import spread

#: Labelled records without a written unit that the classifier is fitted on, of which a third calibrates it, and records
#: whose written unit is hidden for fitting. Every record without a unit is classified.
TRAIN, HIDDEN = 12_000, 4_000
#: With fewer labelled records nothing is predicted and every record without a unit goes to review.
LEAST_TRAIN = 9
TREES, DEPTH, CATEGORIES = 20, 10, 48
#: A prediction is confident where held-out records at its probability are right at least this often.
RIGHT = 0.995
#: Values agree up to the rounding of doubles.
SAME = 1e-9

RECORD = (
    "record_table string, record_id string, arrived timestamp_ntz, doc_id string, page_no int, at int, value double, unit string, category string, digits double,"
    "mantissa long, decimals int, scale long, scaled boolean, code string, base_value long, in_row boolean, declared string"
)


def fact_records(facts: DataFrame) -> DataFrame:
    """Facts in the common form; ``context`` is the evidence, ``shift`` its place on the page."""
    return facts.select(
        F.lit("facts").alias("record_table"), F.col("fact_id").alias("record_id"), F.col("recorded_at").cast("timestamp_ntz").alias("arrived"), "doc_id", "page_no", F.col("value_start").alias("at"),
        F.col("display").alias("written"), "value", "unit", F.col("metric_key").alias("category"), F.col("precision").alias("digits"), F.col("evidence").alias("context"), F.col("char_start").alias("shift"), F.lit(None).cast("string").alias("said"),
    )


def quantity_records(quantities: DataFrame) -> DataFrame:
    """Raw mentions in the common form; ``said`` is the unit declared for their table."""
    return quantities.select(
        F.lit("quantities").alias("record_table"), F.col("quantity_id").cast("string").alias("record_id"), F.lit(None).cast("timestamp_ntz").alias("arrived"), "doc_id", "page_no", F.col("value_start").alias("at"),
        F.col("raw").alias("written"), "value", "unit", F.lit(None).cast("string").alias("category"), F.col("precision").alias("digits"), F.lit(None).cast("string").alias("context"), F.lit(None).cast("int").alias("shift"), F.col("unit_context").alias("said"),
    )


#: Integers from this size on are kept as null.
BOUND = 1 << 62
READ = ["mantissa", "decimals", "scale", "scaled", "code", "base_value", "in_row", "declared"]


def _bounded(n: int) -> int | None:
    return n if abs(n) < BOUND else None


def _read_one(written: str, context: str | None, shift: float | None, at: float | None, said: str | None) -> tuple | None:
    """The fields READ of one record; None where the text has no number."""
    m = U.read_measure(written)
    if m is None:
        return None
    number = (_bounded(m.mantissa), m.decimals, _bounded(m.scale), m.scaled)
    if m.unit:
        return *number, U.to_code(m.unit, min(m.scale, BOUND)), _bounded(U.to_base(m, m.unit, m.scale)), None, None
    if said:
        d = U.declaration(said.strip().strip("()"))
        return *number, None, None, True, U.to_code(*d) if d else None
    if context and not pd.isna(shift) and not pd.isna(at):
        place = int(at) - int(shift)
        row = next((r for r in U.table_rows(context) if r[0] <= place < r[1]), None)
        return *number, None, None, row is not None, (row[2] or None) if row else None
    return *number, None, None, None, None


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Read the texts of records: the measure, its written unit and value, and what is declared beside it."""
    for batch in batches:
        read = [_read_one(*r) for r in zip(batch["written"], batch["context"], batch["shift"], batch["at"], batch["said"])]
        has = np.array([r is not None for r in read], bool)
        kept = batch.drop(columns=["written", "context", "shift", "said"])[has].reset_index(drop=True)
        yield pd.concat([kept, pd.DataFrame([r for r in read if r], columns=READ, dtype=object)], axis=1)


ROWS = T.ArrayType(T.StructType([T.StructField("row_start", T.IntegerType()), T.StructField("row_end", T.IntegerType()), T.StructField("code", T.StringType())]))


@F.pandas_udf(ROWS)
def page_rows(texts: pd.Series) -> pd.Series:
    """:func:`claimlake.functions.units.table_rows` of a column."""
    return texts.map(lambda t: [{"row_start": a, "row_end": b, "code": c} for a, b, c in U.table_rows(t)])


@F.pandas_udf(T.LongType())
def _convert(mantissa: pd.Series, decimals: pd.Series, scale: pd.Series, code: pd.Series) -> pd.Series:
    out = []
    for m, d, s, c in zip(mantissa, decimals, scale, code):
        out.append(None if pd.isna(m) or pd.isna(s) else _bounded(U.to_base(U.Measure(int(m), int(d), int(s), False, None), U.from_code(c)[0], int(s))))
    return pd.Series(out, dtype="Int64")


def review(records: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``settled``: the code of the unit declared for a record without a written one, or that of a count.

    Pages are read only where neither the evidence nor the mention declares a unit. They are reduced to the places of
    their table rows before the shuffle; texts stay where they are.
    """
    needs = F.col("in_row").isNull() | (F.col("in_row") & F.col("declared").isNull())
    rows = pages.select("doc_id", "page_no", page_rows("text").alias("rows")).where(F.size("rows") > 0).groupBy("doc_id", "page_no").agg(F.min("rows").alias("rows"))
    asked = records.where(needs).join(rows, ["doc_id", "page_no"], "left")
    hit = F.try_element_at(F.filter("rows", lambda r: (r["row_start"] <= F.col("at")) & (F.col("at") < r["row_end"])), F.lit(1))
    asked = asked.withColumn("declared", F.nullif(hit["code"], F.lit(""))).withColumn("in_row", F.coalesce("in_row", hit.isNotNull()))
    every = records.where(~needs).unionByName(asked.select(*records.columns))
    return every.withColumn("settled", F.when(F.col("in_row") & F.col("declared").isNotNull(), F.col("declared")).otherwise(COUNT))


#: The code of a plain count.
COUNT = U.to_code(("count", 1, 1), 1)


def _index(values: list[str], c: Column) -> Column:
    """Place of ``c`` in ``values`` from 1, 0 where it is none of them."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, values)), c), F.lit(0)).cast("double")


def _features(records: DataFrame) -> DataFrame:
    """Features of records. Where a unit is written, it and its scale are hidden, as in a row of a table."""
    log = lambda c: F.log10(F.greatest(F.abs(c), F.lit(1e-9)))
    tenths = lambda c: F.coalesce(F.round(F.nanvl(c, F.lit(None)), 3), F.lit(-9.0))
    hidden = F.col("code").isNotNull()
    stored = F.lower(F.split(F.trim(F.coalesce("unit", F.lit(""))), "[ _]")[0])
    common = ["", "unknown", "percent", "count", "inr", "usd", "eur", "gbp", "tonne", "ratio", "day", "percentage_point", "kg", "nos", "bps", "%", "₹", "$", "us$", "rs.", "rs", "€", "£", "mt", "units", "number", "lakh", "mn", "million"]
    size = log(F.col("mantissa").cast("double")) - F.col("decimals")
    own = F.when(hidden, 0.0).otherwise(log(F.col("scale").cast("double")))
    return records.select(
        "*",
        _index(common, stored).alias("f_stored"),
        F.pmod(F.xxhash64(F.element_at(F.split(F.coalesce("category", F.lit("")), " "), -1)), F.lit(CATEGORIES)).cast("double").alias("f_category"),
        F.when(F.col("record_table") == "facts", 1.0).otherwise(0.0).alias("f_source"),
        (hidden | F.coalesce("in_row", F.lit(False))).cast("double").alias("f_row"),
        size.alias("f_magnitude"),
        F.col("decimals").cast("double").alias("f_decimals"),
        (F.col("mantissa") < 0).cast("double").alias("f_negative"),
        own.alias("f_scale"),
        (tenths(F.log10("digits") + F.col("decimals")) - own).alias("f_digits"),
        (tenths(F.log10(F.abs("value")) - size) - own).alias("f_ratio"),
    )


#: The stored unit, the last word of the metric, the table, whether the record stands in a row, magnitude, decimals, sign
#: and written scale, and, per unit of the number, the size of the last digit and the stored value.
FEATURES = ["f_stored", "f_category", "f_source", "f_row", "f_magnitude", "f_decimals", "f_negative", "f_scale", "f_digits", "f_ratio"]


def _isotonic(score: np.ndarray, right: np.ndarray) -> float:
    """Least score from which on the isotonic fit of ``right`` by ``score`` reaches RIGHT; above 1 where none does."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, r in zip(score[order], right[order]):
        blocks.append([r, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            r2, n2, _ = blocks.pop()
            blocks[-1][0] += r2
            blocks[-1][1] += n2
    return next((b[2] for b in blocks if b[0] / b[1] >= RIGHT), 2.0)


def fit_missing_units(features: DataFrame, n_bare: int, n_written: int) -> tuple[RandomForestClassificationModel, list[str], float] | None:
    """Fit on records whose unit and scale are known: declared beside them, a count in a sentence, or written and hidden.

    At most TRAIN records without a written unit and HIDDEN with one, those with the smallest hash of their id. Returns
    the model, the codes that its classes stand for and the threshold, calibrated on records without a written unit;
    None where fewer than two codes or LEAST_TRAIN of these are known.
    """
    spark = features.sparkSession
    whole = F.col("mantissa").isNotNull() & F.col("scale").isNotNull()
    unscaled = F.when(F.col("scaled"), F.regexp_replace("declared", r"\|\d+$", "|1")).otherwise(F.col("declared"))
    label = F.coalesce("code", F.when(F.col("in_row"), unscaled).when(~F.col("in_row"), COUNT))
    known = features.where(whole).select("record_table", "record_id", F.col("code").isNotNull().alias("hidden"), label.alias("label"), *FEATURES).where("label is not null")
    key = F.concat_ws("#", "record_table", "record_id")
    bare = smallest_hashes(known.where("not hidden"), key, TRAIN, n_bare).collect()
    written = smallest_hashes(known.where("hidden"), key, HIDDEN, n_written).collect()
    names = sorted({r["label"] for r in bare + written})
    if len(names) < 2 or len(bare) < LEAST_TRAIN:
        return None
    names += [f"none {i}" for i in range(len(names), 3)]  # with two classes the model would hold a summary that no task can be sent
    known_classes = {"ml_attr": {"type": "nominal", "name": "label", "vals": names}}
    sample = [(i % 3 == 0, r) for i, r in enumerate(bare)] + [(False, r) for r in written]
    data = spark.createDataFrame([(float(names.index(r["label"])), held, *(r[f] for f in FEATURES)) for held, r in sample], ["label", "held", *FEATURES]).repartition(4)
    data = data.withColumn("label", F.col("label").alias("label", metadata=known_classes))
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(data)
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=7, cacheNodeIds=False).fit(assembled.where("not held"))
    held = model.transform(assembled.where("held")).select((F.col("prediction") == F.col("label")).cast("double").alias("right"), F.array_max(vector_to_array("probability")).alias("p")).collect()
    threshold = _isotonic(np.array([r["p"] for r in held]), np.array([r["right"] for r in held]))
    return model, names, threshold


def _predicted(features: DataFrame, fitted: tuple[RandomForestClassificationModel, list[str], float] | None) -> DataFrame:
    """Adds ``predicted``, the code of a confident prediction. Records of unknown surroundings have none."""
    seen = F.col("in_row").isNotNull() & F.col("mantissa").isNotNull() & F.col("scale").isNotNull()
    unknown = features.where(~seen).withColumn("predicted", F.lit(None).cast("string"))
    if not fitted:
        return features.withColumn("predicted", F.lit(None).cast("string"))
    model, names, threshold = fitted
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features.where(seen)))
    sure = F.array_max(vector_to_array("probability")) >= threshold
    code = F.when(sure, F.array(*map(F.lit, names))[F.col("prediction").cast("int")])
    return scored.withColumn("predicted", code).select(*unknown.columns).unionByName(unknown)


def unify(facts: DataFrame, quantities: DataFrame, pages: DataFrame) -> DataFrame:
    """Every record in base units: ``(record_table, record_id, value, unit, base_unit, base_value, route)``.

    ``base_value`` is in whole units for money and counts, in thousandths for the rest. ``route`` is *written* (the
    text has a unit), *assigned* (a confident prediction, which settles unit and scale) or *review* (an uncertain one,
    settled by what is declared).

    * Parentheses around the amount mean minus. In review a declared unit holds in table rows only; its scale gives way
      to a scale written with the amount. A number without any unit is a count.
    * Rows sent again count once, by id. Null ids, and texts that are null, empty or without a number, give no row.
    * Missing pages: the record is treated as standing in a sentence unless its evidence shows a row.
    * Empty tables give empty results; other columns are ignored. A result of 2**62 and more, and one of a number that
      large, is null; its unit stands.

    Jobs run while the plan is built: records are read once and written, the sample is fitted, predictions are written.
    """
    spark = facts.sparkSession
    written = fact_records(spread(facts, "fact_id")).unionByName(quantity_records(spread(quantities, "quantity_id"))).where(F.col("record_id").isNotNull() & (F.length("written") > 0))
    read = written.mapInPandas(_read, RECORD)
    rest = [c for c in read.columns if c not in ("record_table", "record_id", "arrived")]
    once = read.groupBy("record_table", "record_id").agg(F.min(F.struct("arrived", *rest)).alias("_r")).select("record_table", "record_id", "_r.*")
    scratch = Scratch(spark, "units")
    _, once, n_bare = scratch.write_counting(once, "code is null")
    fitted = fit_missing_units(_features(once), n_bare, once.count() - n_bare)
    _, bare = scratch.write(_predicted(_features(once.where("code is null")), fitted).drop("code", *FEATURES))
    assigned = bare.where("predicted is not null").withColumns({"settled": F.col("predicted"), "route": F.lit("assigned")})
    reviewed = review(bare.where("predicted is null"), spread(pages, "doc_id", "page_no")).withColumn("route", F.lit("review"))
    settled = assigned.unionByName(reviewed)
    factor = F.when(F.col("scaled"), F.col("scale")).otherwise(F.split("settled", r"\|")[3].cast("long"))
    settled = settled.withColumn("base_value", _convert("mantissa", "decimals", factor, "settled")).withColumnRenamed("settled", "code")
    columns = ["record_table", "record_id", "value", "unit", F.split("code", r"\|")[0].alias("base_unit"), "base_value", "route"]
    return once.where("code is not null").withColumn("route", F.lit("written")).select(*columns).unionByName(settled.select(*columns))


def not_in_base(unified: DataFrame) -> DataFrame:
    """Records whose value and unit as stored are not both the base value and the exact name of the base unit."""
    stands = F.when(F.col("base_unit").isin(*U.WHOLE), F.col("base_value").cast("double")).otherwise(F.col("base_value") / 1000.0)
    near = F.abs(F.col("value") - stands) <= SAME * F.greatest(F.abs(stands), F.lit(1e-9))
    same = (F.col("unit") == F.col("base_unit")) & near & ~F.isnan("value")
    return unified.where(~F.coalesce(same, F.lit(False))).select("record_table", "record_id", "base_unit", "base_value")
