"""Filling fixed-capacity containers with documents.

Documents are counted in tokens of a public tokenizer where they lie; only ids and counts are shuffled, by hash, into
shards of bounded size. Each shard is packed on line by the sum-of-squares rule: a level array counts partly filled
containers by fill, and an item goes where it makes the sum of the squared counts least. Items above the capacity are
cut into full containers and one rest, which is packed like any other item.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from claimlake.plans.spread import spread

CAPACITY = 2_048
#: Documents to a shard: enough that the containers a shard leaves open are few among those it fills.
SHARD = 50_000
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Characters given to the tokenizer at once, more where no cut is possible.
PART = 100_000
# The property White_Space, which the tokenizer's pattern means by white space.
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Before white space that follows anything else the pattern always splits, so counts of parts add up. A run of white
#: space is one piece but for its last character where text follows; very long ones would exhaust the pattern's stack.
_CUT = re.compile(f"(?<=[^{_BLANK}])(?=[{_BLANK}])")
_RUN = re.compile(f"[{_BLANK}]{{{PART // 2},}}")


@lru_cache(maxsize=2)
def _encoding(folder: str, name: str):
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


# Fixed value: the splitting pattern that goes with the vocabulary files.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_count(text: str | None, folder: str, name: str = VOCABULARY) -> int:
    """Tokens of ``text``, the same whether counted whole or in parts; null and empty texts have none. Special tokens are
    ordinary text."""
    if not text:
        return 0
    encoding = _encoding(folder, name)
    if len(text) <= PART:
        return len(encoding.encode_ordinary(text))
    n, at = 0, 0
    while at < len(text):
        run = _RUN.search(text, at)
        stop = run.start() if run else len(text)
        while at < stop:
            cut = _CUT.search(text, at + PART, stop)
            end = cut.start() if cut else stop
            n += len(encoding.encode_ordinary(text[at:end]))
            at = end
        if run:
            at = run.end() - (run.end() < len(text))
            n += len(encoding._encode_single_piece(text[stop:at]))
    return n


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item (numbered in order of opening), by the sum-of-squares rule; sizes are 1 to ``capacity``.

    With N(h) containers filled to h, moving one from h to h + s changes the sum of squares by 2(N(h+s) - N(h) + 1),
    by 2 N(s) + 1 for a new one, and by 1 - 2 N(h) where it becomes full. Ties go to the fuller container.
    """
    counts = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity)]
    placed, opened = np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        if s == capacity:
            placed[i], opened = opened, opened + 1
            continue
        best, level = 2 * counts[s] + 1, 0
        fits = counts[1 : capacity - s + 1]
        used = np.flatnonzero(fits)
        if len(used):
            gain = 2 * (counts[used + 1 + s] - fits[used]) + 2
            if used[-1] + 1 + s == capacity:
                gain[-1] = 1 - 2 * fits[used[-1]]
            k = len(used) - 1 - int(gain[::-1].argmin())
            if gain[k] <= best:
                level = int(used[k]) + 1
        if level:
            box = open_at[level].pop()
            counts[level] -= 1
        else:
            box, opened = opened, opened + 1
        placed[i] = box
        if level + s < capacity:
            open_at[level + s].append(box)
            counts[level + s] += 1
    return placed


def count_tokens(documents: DataFrame, folder: str, name: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens)`` of every document whose text has a token."""

    @F.pandas_udf(T.LongType())
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: token_count(t, folder, name)).astype("int64")

    return spread(documents.select("doc_id", "text"), "doc_id").where(F.length("text") > 0).select("doc_id", tokens("text").alias("n_tokens")).where("n_tokens > 0")


def fill_containers(sized: DataFrame, capacity: int = CAPACITY, n_documents: int | None = None) -> DataFrame:
    """Place ``sized(doc_id, n_tokens)``: ``(doc_id, piece, first_token, n_tokens, shard, container)``.

    * A document that fits whole is never split: one row, piece 0. A longer one is cut after each ``capacity`` tokens;
      its full pieces have a container each and its rest is packed.
    * Containers are numbered within their shard. Rows whose size is null or below 1 need no place.
    * Repeated ids and copies are items of their own. The result does not depend on how rows were partitioned: shards
      go by the hash of the id and are packed in the order of hash and id. Empty input gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = sized.where("n_tokens > 0")
    n = items.count() if n_documents is None else n_documents
    shards = -(-n // SHARD) or 1
    key = T.StructType([items.schema["doc_id"]])
    long = T.LongType()
    schema = T.StructType([*key.fields, T.StructField("piece", long), T.StructField("first_token", long), T.StructField("n_tokens", long), T.StructField("shard", T.IntegerType()), T.StructField("container", long)])

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id", "n_tokens"], kind="stable")
        size = pdf["n_tokens"].to_numpy(np.int64)
        pieces = -(-size // capacity)
        row = np.repeat(np.arange(len(size)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        n_tokens = np.minimum(size[row] - piece * capacity, capacity)
        return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[row], "piece": piece, "first_token": piece * capacity, "n_tokens": n_tokens, "shard": pdf["shard"].to_numpy()[row], "container": pack(n_tokens, capacity)})

    spread = items.select("doc_id", "n_tokens", F.xxhash64("doc_id").alias("h")).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int"))
    return spread.groupBy("shard").applyInPandas(place, schema)


def breaches(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row of what a placement must be: ``(n_docs, over_full, split_in_vain, with_gaps)``.

    ``over_full`` containers hold more than the capacity, ``split_in_vain`` documents have several pieces though they fit
    whole, ``with_gaps`` documents have pieces that do not follow one another from the first token on; all are 0.
    """
    over = placed.groupBy("shard", "container").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > capacity).alias("over_full"))
    docs = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("m"), F.count_distinct("piece").alias("d"), F.max("piece").alias("last"), F.sum("first_token").alias("starts"), F.min("first_token").alias("first"), F.max(F.struct("first_token", "n_tokens")).alias("end"))
    gaps = (F.col("d") != F.col("m")) | (F.col("last") != F.col("m") - 1) | (F.col("first") != 0) | (F.col("end.first_token") + F.col("end.n_tokens") != F.col("n")) | (F.col("starts") != capacity * F.col("m") * (F.col("m") - 1) / 2)
    seen = docs.agg(F.count("*").alias("n_docs"), F.count_if((F.col("m") > 1) & (F.col("n") <= capacity)).alias("split_in_vain"), F.count_if(gaps).alias("with_gaps"))
    return seen.crossJoin(over).select("n_docs", "over_full", "split_in_vain", "with_gaps")  # one row each


def container_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(containers, tokens, room, utilisation)`` of a placement."""
    boxes = placed.groupBy("shard", "container").agg(F.sum("n_tokens").alias("n"))
    return boxes.agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.sum(F.lit(capacity) - F.col("n")).alias("room"), (F.sum("n") / (F.count("*") * capacity)).alias("utilisation"))
