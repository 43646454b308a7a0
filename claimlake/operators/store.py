"""A store of claim tables as versioned parquet below one root.

A change writes a new version of a table and then moves its pointer, so a reader sees the old version or the new one
and a lost executor costs a retry, not a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from claimlake.operators import serve
from claimlake.operators.search import index, search

#: Tables and their keys; a row with a key that is stored replaces the stored one.
KEYS = {"documents": ["doc_id"], "pages": ["doc_id", "page_no"], "facts": ["fact_id"], "relations": ["relation_id"], "concepts": ["concept_id"], "wordings": ["metric_key", "metric", "batch"], "aliases": ["left_key", "right_key", "batch"]}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _fs(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self._conf), where

    def version(self, name: str) -> int:
        """The current version of a table, 0 before the first write: the largest that was completed."""
        fs, where = self._fs(f"{self.root}/{name}")
        if not fs.exists(where):
            return 0
        done = [int(s.getPath().getName()[1:]) for s in fs.listStatus(where) if s.getPath().getName().startswith("v") and fs.exists(self._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max(done, default=0)

    def read(self, name: str) -> DataFrame | None:
        v = self.version(name)
        return self.spark.read.parquet(f"{self.root}/{name}/v{v}") if v else None

    def replace(self, name: str, rows: DataFrame) -> None:
        """Write a new version; the one before it stays for readers that have begun, older ones go."""
        v = self.version(name) + 1
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/v{v}")
        fs, old = self._fs(f"{self.root}/{name}/v{v - 2}")
        if v > 2 and fs.exists(old):
            fs.delete(old, True)

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Insert rows, replacing stored ones with the same key. Of rows with one key any one is kept."""
        keys = KEYS[name]
        rows, stored = rows.dropDuplicates(keys), self.read(name)
        self.replace(name, rows if stored is None else stored.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True))

    def vote(self, pairs: DataFrame, batch: str) -> None:
        """A vote of ``batch`` for each pair of metric keys; the same batch votes once, however often it is repeated."""
        self.upsert("aliases", pairs.select("left_key", "right_key").withColumn("batch", F.lit(batch)))

    def votes(self) -> DataFrame:
        """``(left_key, right_key, votes)`` of all batches."""
        return self.read("aliases").groupBy("left_key", "right_key").agg(F.count("*").alias("votes"))

    def delete_documents(self, gone: DataFrame) -> None:
        """Delete documents with their pages, facts and the relations of these facts; concepts and aliases stay."""
        facts, relations, pages, documents = (self.read(t) for t in ("facts", "relations", "pages", "documents"))
        if facts is not None and relations is not None and pages is not None:
            for name, rows in zip(("facts", "relations", "pages"), serve.delete_documents(gone, facts, relations, pages)):
                self.replace(name, rows)
        if documents is not None:
            self.replace("documents", documents.join(gone, "doc_id", "left_anti"))

    def stats(self) -> DataFrame:
        return serve.stats(*(self.read(t) for t in ("documents", "pages", "facts", "concepts", "relations")))

    def relations(self, kind: str | None = None, collection: str | None = None, cross_document: bool | None = None, dimension: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        joined = serve.joined_relations(self.read("relations"), self.read("facts"), self.read("documents"))
        return serve.ranked(serve.filtered(joined, kind, collection, cross_document, dimension), limit, offset)

    def facts(self, q: str | None = None, doc_id: str | None = None, collection: str | None = None, limit: int = 50) -> DataFrame:
        """Facts by confidence; with ``q`` those that match it, whatever the other filters."""
        facts = self.read("facts")
        if q:
            return facts.join(search(index(facts), q), "fact_id", "left_semi").orderBy("fact_id").limit(limit)
        if doc_id is not None:
            facts = facts.where(F.col("doc_id") == doc_id)
        if collection is not None:
            facts = facts.join(self.read("documents").where(F.col("collection") == collection).select("doc_id"), "doc_id", "left_semi")
        return facts.orderBy(F.desc("confidence"), "fact_id").limit(limit)

    def fact_detail(self, fact_id: str) -> DataFrame:
        one = self.spark.createDataFrame([(fact_id,)], "fact_id string")
        return serve.other_sides(one, self.read("relations"), self.read("facts"))

    def concepts(self, limit: int = 100) -> DataFrame:
        return serve.top_concepts(self.read("concepts"), self.read("facts"), limit)

    def aliases(self) -> DataFrame:
        return self.votes().orderBy(F.desc("votes"), "left_key", "right_key")

    def page(self, doc_id: str, page_no: int) -> DataFrame:
        return self.read("pages").where((F.col("doc_id") == doc_id) & (F.col("page_no") == page_no))

    def export(self, where: str) -> None:
        """The export slices as JSON."""
        joined = serve.joined_relations(self.read("relations"), self.read("facts"), self.read("documents"))
        serve.export_slices(joined, {"corroborates": 8, "contradicts": 8, "reconciled_by_context": 10, "part_of": 5, "consistent_across_context": 5}).write.mode("overwrite").json(where)


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
