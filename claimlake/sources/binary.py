"""Binary documents: directory scan, identity by content, and a pluggable decoder into lines."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimlake.operators.layout import LINES

#: A decoder turns the bytes of a file into (page_no, page_w, page_h, line_no, x0, y0, x1, y1, text) rows.
Decoder = Callable[[bytes], Iterable[tuple]]

#: What the metadata of a file tell: its title and its date as written, either None.
Metadata = Callable[[bytes], tuple[str | None, str | None]]


def scan(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """``(doc_id, sha256, filename, collection, content)`` of every file below ``path``; the folder names the collection."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    parts = F.split(F.col("path"), "/")
    sha = F.sha2("content", 256)
    folder = F.try_element_at(parts, F.lit(-2))
    return files.select(F.substring(sha, 1, 12).alias("doc_id"), sha.alias("sha256"), F.element_at(parts, -1).alias("filename"), F.coalesce(F.nullif(folder, F.lit("")), F.lit("default")).alias("collection"), "content")


def decode(files: DataFrame, decoder: Decoder) -> DataFrame:
    """Lines of scanned files. A file that the decoder cannot read gives no lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in LINES.split(", ")]
        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["content"]):
                try:
                    rows = [(doc_id, *r) for r in decoder(content)]
                except ValueError:
                    rows = []
                yield pd.DataFrame(rows, columns=names)

    return files.select("doc_id", "content").mapInPandas(run, LINES)


def describe(files: DataFrame, metadata: Metadata | None) -> DataFrame:
    """``(doc_id, title, published_on)`` as the files' metadata tell, null without any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = [metadata(content) for content in batch["content"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "title": [t for t, _ in told], "raw": [d for _, d in told]})

    if metadata is None:
        return files.select("doc_id", F.lit(None).cast("string").alias("title"), F.lit(None).cast("date").alias("published_on"))
    return files.select("doc_id", "content").mapInPandas(run, "doc_id string, title string, raw string").select("doc_id", "title", meta_date(F.col("raw")).alias("published_on"))


def meta_date(raw: Column) -> Column:
    """The date in a document's metadata: its first eight digits in a row; null where they are no date."""
    return F.try_to_date(F.regexp_extract(raw, r"(\d{8})", 1), "yyyyMMdd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(raw, r"(\d{8})", 1), F.lit("")), F.lit("yyyyMMdd")))


def text_decoder(content: bytes) -> Iterator[tuple]:
    """A decoder for plain text: a page for each form feed, a line for each line of text, 20 points apart."""
    if content.startswith(b"%PDF"):
        raise TypeError("this is a PDF file: give a decoder that reads PDF, the built-in one reads plain text only")
    for page_no, page in enumerate(content.decode("utf-8").split("\f"), 1):
        for n, line in enumerate(page.split("\n")):
            if line.strip():
                yield page_no, 595.0, 842.0, n, 72.0, 72.0 + 20.0 * n, 72.0 + 5.5 * len(line), 83.0 + 20.0 * n, line
