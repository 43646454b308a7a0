"""Command line: ``python -m claimlake ingest|stats|report --store DIR``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F

from claimlake.functions.qualifiers import read_lexicon
from claimlake.operators import report
from claimlake.operators.layout import pages_from_lines, scan_lines
from claimlake.operators.store import Store
from claimlake.sources import binary
from claimlake.streaming.ingest import ingest


def main(argv: list[str] | None = None, spark: SparkSession | None = None, decoder: binary.Decoder = binary.text_decoder, metadata: binary.Metadata | None = None) -> str:
    """Run a command and return what it prints.

    ``decoder`` reads the files; the one for plain text is built in. ``metadata`` tells titles and dates of files. A
    lexicon of qualifiers is read from a JSON file.
    """
    parser = argparse.ArgumentParser(prog="claimlake")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("ingest", "stats", "report"):
        c = commands.add_parser(name)
        c.add_argument("--store", required=True)
        c.add_argument("--collection")
        if name == "ingest":
            c.add_argument("path")
            c.add_argument("--subject")
            c.add_argument("--glob", default="*.txt" if decoder is binary.text_decoder else "*.pdf")
            c.add_argument("--lexicon")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("claimlake").getOrCreate()
    store = Store(spark, args.store)
    if args.command == "ingest":
        files = binary.scan(spark, args.path, args.glob)
        pages = pages_from_lines(scan_lines(binary.decode(files, decoder))).select("doc_id", F.struct("page_no", "text", "n_columns", "printed_label", "cells").alias("p"))
        gathered = pages.groupBy("doc_id").agg(F.collect_list("p").alias("pages"))  # a document's own pages
        told = binary.describe(files, metadata)
        arriving = files.drop("content").join(gathered, "doc_id").join(told, "doc_id", "left").select(
            "doc_id", "filename", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.regexp_replace("filename", r"\.[^.]*$", "")).alias("title"), "sha256",
            F.lit(args.collection).alias("collection") if args.collection else F.col("collection"), F.lit(args.subject).cast("string").alias("subject"),
            "published_on", F.current_timestamp().cast("timestamp_ntz").alias("ingested_at"), "pages",
        )
        lexicon = None
        if args.lexicon:
            with open(args.lexicon, encoding="utf-8") as f:
                lexicon = read_lexicon(f.read())
        ingest(store, arriving, lexicon)
    out = report.render(store, args.collection) if args.command == "report" else "\n".join(f"{r['measure']}\t{r['n']}" for r in store.stats().orderBy("measure").collect())
    print(out)
    return out


if __name__ == "__main__":
    main()
