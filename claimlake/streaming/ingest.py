"""Incremental ingestion: arriving documents are deduplicated, extracted, and related to what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from claimlake.functions.udfs import CELLS, detect_subjects, extract_facts, subject_key
from claimlake.operators import concepts as K, relate as R, serve
from claimlake.operators.store import Store
from claimlake.plans.scratch import Scratch

#: Documents as they arrive. Pages need ``page_no`` and ``text``; what their layout told may come with them.
PLAIN = "doc_id string, filename string, title string, sha256 string, collection string, subject string, published_on date, ingested_at timestamp_ntz, pages array<struct<page_no: int, text: string>>"
ARRIVING = PLAIN.replace("text: string>>", f"text: string, n_columns: int, printed_label: string, cells: {CELLS}>>")


def _pages(new: DataFrame) -> DataFrame:
    """Pages of arriving documents; where nothing is told of their layout they have one column."""
    pages = new.select("doc_id", F.inline("pages"))
    for name, kind in (("n_columns", "int"), ("printed_label", "string"), ("cells", CELLS)):
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast(kind))
    return pages.withColumn("n_columns", F.coalesce("n_columns", F.lit(1)))


def _documents(new: DataFrame, pages: DataFrame) -> DataFrame:
    """Arriving documents with their subject: as given, else the name most often met in title and pages, else the title."""
    counts = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_pages"))
    detected = detect_subjects(pages, new).select("doc_id", F.col("subject").alias("detected"))
    told = new.drop("pages").join(counts, "doc_id", "left").join(detected, "doc_id", "left")
    told = told.withColumn("subject", F.coalesce(F.nullif(F.trim("subject"), F.lit("")), "detected", "title")).drop("detected")
    return told.withColumn("subject_key", subject_key(F.coalesce("subject", F.lit(""))))


def _merge(store: Store) -> None:
    """Fuse the concepts that promoted aliases tie, in wordings, concepts and facts."""
    words = store.read("wordings")
    merged = K.merge_concepts(words.select("metric_key", "concept_id").distinct(), serve.promoted(store.votes())).where("concept_id <> merged_id")
    if merged.isEmpty():
        return
    fused = lambda df: df.join(merged, "concept_id", "left").withColumn("concept_id", F.coalesce("merged_id", "concept_id")).drop("merged_id")
    store.replace("wordings", fused(words))
    store.replace("concepts", store.read("concepts").join(merged, "concept_id", "left_anti"))
    store.replace("facts", fused(store.read("facts")))


def ingest(store: Store, arriving: DataFrame, lexicon: dict | None = None) -> None:
    """Add a batch of ``arriving`` documents to the store.

    Contents that are stored, whatever their collection, and repeats within the batch add nothing. New facts are
    compared with each other and with the stored facts; relations among stored facts are not derived again. Wordings
    that have a concept keep it; concepts are fused only where aliases are promoted. Running the same batch twice
    changes nothing, votes included, so a batch that failed half-way can be repeated.
    """
    spark = store.spark
    stored = store.read("documents")
    scratch = Scratch(spark, "ingest")
    new = arriving.where("sha256 is not null").dropDuplicates(["sha256"])
    _, new, seen = scratch.write_observing(new if stored is None else serve.unseen(new, stored), n=F.count("*"), batch=F.bit_xor(F.xxhash64("sha256")))
    if not seen["n"]:
        return
    pages = _pages(new)
    _, documents = scratch.write(_documents(new, pages))
    at = new.select("doc_id", F.col("ingested_at").alias("recorded_at"))
    _, found = scratch.write(extract_facts(pages, documents, lexicon).join(at, "doc_id"))
    store.upsert("pages", pages.drop("cells"))
    batch, words = f"{seen['n']}-{seen['batch']}", store.read("wordings")
    _, said = scratch.write(K.wordings(found))
    none = said.withColumn("concept_id", F.lit(None).cast("string"))
    _, assigned = scratch.write(K.fold_concepts(none if words is None else K.add_wordings(words.where(F.col("batch") != batch).drop("batch"), said)))
    known = assigned.select("metric_key", "concept_id")
    _, fresh = scratch.write(found.join(known, "metric_key", "left"))
    store.replace("concepts", assigned.select("concept_id", "canonical_key", "label").dropDuplicates(["concept_id"]))
    store.upsert("wordings", said.join(known, "metric_key").withColumn("batch", F.lit(batch)))
    store.upsert("facts", fresh)
    all_documents = documents if stored is None else stored.unionByName(documents, allowMissingColumns=True)
    relations, aliases = R.link(store.read("facts"), all_documents, store.read("concepts"), fresh.select("fact_id"))
    store.upsert("relations", relations)
    store.vote(aliases, batch)
    _merge(store)
    store.upsert("documents", documents)  # last: a batch counts as stored once all of it is
    scratch.drop(scratch.root)


def stream(spark: SparkSession, source: str, store: Store, checkpoint: str, files_per_trigger: int = 100) -> StreamingQuery:
    """Ingest parquet files that land in ``source`` until all that are there have been taken."""
    arriving = spark.readStream.schema(ARRIVING).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    writer = arriving.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(lambda batch, _: ingest(store, batch)).start()
