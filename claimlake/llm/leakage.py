"""Evaluation texts leaking into training text.

The n-grams of all held-out items are hashed into one sorted array that every worker gets; each document is reduced to
normal words once, its n-gram hashes are looked up in that array, and every hit is verified by laying the item along
the document at the offset the hit gives and counting agreeing words.

Why n-grams of six words lose nothing: of a run of ``L >= 20`` words at most ``L // 10`` are replaced, which leaves at
least ``0.9 L`` words in at most ``L // 10 + 1`` pieces, so one piece has six words or more.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from types import MappingProxyType

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from claimlake.plans.scratch import Scratch
from claimlake.plans.spread import spread

#: Words in a row that make a leak, words of which one may be replaced, and the n-gram whose size follows from both.
RUN, PER_REPLACED, GRAM = 20, 10, 6
#: Items are sent to every worker only up to this much text; more are searched in several passes of this size, one at a
#: time. What items share (stock lines, hyphened words) is taken from all items whatever the passes.
ITEM_CHARS = 20_000_000
#: A first line that so many items share is stock.
STOCK = 10

_JOIN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370)])
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|a|font|mark|small|sub|sup|code)(?:\s[^<>]*)?>")
_TAG = re.compile(r"</?[a-z][^<>]*>|<!--.*?-->", re.S)
_BROKEN = re.compile(r"([^\W\d_]+)[-‐]\s*\n\s*([^\W\d_]+)")
_HYPHENED = re.compile(r"[^\W_]+(?:-[^\W_]+)+")
_GROUPED = re.compile(r"(?<=\d)[,.' ](?=\d)")
_WORD = re.compile(r"[^\W_]+")
_QUESTION = re.compile(r"\n\s*question\s*:\s*", re.I)
_ANSWER = re.compile(r"\n\s*answer\s*:.*", re.I | re.S)


def normal_words(text: str, compounds: Mapping[str, tuple[str, ...]] = MappingProxyType({})) -> list[str]:
    """Words of ``text`` without case, punctuation, mark-up, invisible characters and character forms.

    A word broken at a line end is joined. ``compounds`` maps words that items write with hyphens, written in one, to
    their parts, into which they fall wherever they stand, so that all spellings of them agree.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_JOIN)
    text = text.lower()
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text).replace("\xad", "").replace("\u200b", "")
    if "-" in text or "‐" in text:
        text = _BROKEN.sub(r"\1\2", text)
    words = _WORD.findall(_GROUPED.sub("", text))
    if compounds and not compounds.keys().isdisjoint(words):
        words = [w for x in words for w in compounds.get(x, (x,))]
    return words


@dataclass
class ItemIndex:
    """What a worker needs to find items: word numbers, n-gram hashes with their places, and the items' words."""

    words: dict[str, int]
    compounds: Mapping[str, tuple[str, ...]]
    hashes: np.ndarray  # sorted
    places: np.ndarray  # item row, word place for each hash
    items: list[np.ndarray]
    ids: list


_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _hashes(numbers: np.ndarray) -> np.ndarray:
    """Hash of every run of GRAM numbers; 0 where a number is 0 (a word no item has)."""
    n = len(numbers) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x, h, ok = numbers.astype(np.uint64), np.zeros(n, np.uint64), np.ones(n, bool)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            part = x[k : k + n]
            ok &= part > 0
            h = (h ^ (part * _PRIME)) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
    h[~ok | (h == 0)] = 0
    return h


def item_body(text: str, stock: frozenset[str]) -> str:
    """Passage and question of an item, without stock instruction lines, labels and the answer."""
    body = _ANSWER.sub("", "\n" + text)
    lines = [line for line in body.split("\n") if line.strip() not in stock]
    return _QUESTION.sub("\n", "\n" + "\n".join(lines))


def first_line(text: str) -> str:
    return text.strip().split("\n")[0].strip()


def hyphened(text: str) -> dict[str, str]:
    """Words of ``text`` with hyphens: written in one, and their parts with blanks between."""
    return {m.replace("-", ""): m.replace("-", " ") for m in _HYPHENED.findall(text.lower())}


@dataclass(frozen=True)
class Shared:
    """What the items have in common."""

    stock: frozenset[str] = frozenset()
    compounds: Mapping[str, tuple[str, ...]] = field(default_factory=dict)


def shared_by(items: DataFrame) -> Shared:
    """Stock lines and hyphened words of all ``items(id, text)``, counted where they lie.

    What comes back are lines that STOCK items share and distinct hyphened words, a small part of the items' words.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [("line", first_line(t), "") for t in batch["text"]] + [("word", *kv) for t in batch["text"] for kv in hyphened(t).items()]
            yield pd.DataFrame(rows, columns=["kind", "key", "parts"])

    told = items.where(F.length("text") > 0).select("text").mapInPandas(read, "kind string, key string, parts string")
    told = told.groupBy("kind", "key").agg(F.count("*").alias("n"), F.min("parts").alias("parts")).where((F.col("kind") == "word") | (F.col("n") >= STOCK)).collect()
    return Shared(frozenset(r["key"] for r in told if r["kind"] == "line"), {r["key"]: tuple(r["parts"].split()) for r in told if r["kind"] == "word"})


def index_items(rows: Sequence[tuple], shared: Shared) -> ItemIndex:
    """Index ``(item_id, text)`` rows; null ids and null and empty texts are left out."""
    rows = [(i, t) for i, t in rows if i is not None and t]
    numbers: dict[str, int] = {}
    items, hashes, places = [], [], []
    for row, (_, text) in enumerate(rows):
        item = np.array([numbers.setdefault(w, len(numbers) + 1) for w in normal_words(item_body(text, shared.stock), shared.compounds)], np.int64)
        h = _hashes(item)
        items.append(item)
        hashes.append(h)
        places.append(np.stack([np.full(len(h), row), np.arange(len(h))], 1))
    if not items:
        return ItemIndex(numbers, shared.compounds, np.empty(0, np.uint64), np.empty((0, 2), np.int64), [], [])
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    return ItemIndex(numbers, shared.compounds, h[order], np.concatenate(places)[order], items, [i for i, _ in rows])


def longest_run(agree: np.ndarray) -> int:
    """Words of the longest stretch in which at most one word in ``PER_REPLACED`` disagrees; it starts and ends agreeing."""
    at = np.flatnonzero(agree)
    if not len(at):
        return 0
    # stretch from at[i] to at[j]: length L = at[j]-at[i]+1, disagreeing L-(j-i+1), wanted <= L/PER
    score = PER_REPLACED * (np.arange(len(at)) + 1) - (PER_REPLACED - 1) * (at + 1)
    base = PER_REPLACED * np.arange(len(at)) - (PER_REPLACED - 1) * at
    best, lead = 0, []
    # keep starts with falling base: a later start only helps where its base is lower
    low = np.inf
    for i, b in enumerate(base):
        if b < low:
            lead.append(i)
            low = b
    lead_base = -base[lead]
    for j in range(len(at)):
        # first start with base <= score[j]
        k = int(np.searchsorted(lead_base, -score[j]))
        if k < len(lead) and lead[k] <= j:
            best = max(best, int(at[j] - at[lead[k]]) + 1)
    return best


def leaked_items(text: str | None, index: ItemIndex) -> dict[int, int]:
    """Rows of the items that stand in ``text``, with the words of their longest run."""
    if not text or not len(index.hashes):
        return {}
    get = index.words.get
    words = normal_words(text, index.compounds)
    doc = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
    h = _hashes(doc)
    left = np.searchsorted(index.hashes, h)
    hit = np.flatnonzero((h > 0) & (index.hashes[np.minimum(left, len(index.hashes) - 1)] == h))
    if not len(hit):
        return {}
    right = np.searchsorted(index.hashes, h[hit], side="right")
    laid: set[tuple[int, int]] = set()
    for p, a, b in zip(hit.tolist(), left[hit].tolist(), right.tolist()):
        laid.update((int(r), p - int(q)) for r, q in index.places[a:b])
    found: dict[int, int] = {}
    for row, offset in laid:
        item = index.items[row]
        a, b = max(0, -offset), min(len(item), len(doc) - offset)
        if b - a < RUN:
            continue
        n = longest_run(doc[a + offset : b + offset] == item[a:b])
        if n > found.get(row, 0):
            found[row] = n
    return found


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", run: int = RUN) -> DataFrame:
    """``(doc_id, item_id)`` of every document that holds ``run`` words in a row of an item's passage or question.

    Case, punctuation, spacing, line breaks, hyphenation, mark-up and character forms do not count, and one word in
    ten may be replaced. Null and empty texts and items hold nothing; every copy of a document is reported; repeated
    items give one row per item id. Other columns are ignored. No items: no rows.

    The items' size is checked before they are sent: beyond ``ITEM_CHARS`` they go in several passes whose rows are
    written, one index alive at a time; none is dropped and the result is the same. Documents are never shuffled; a
    document of any length is read whole. Jobs that read the items run while the plan is built, with several passes
    those that read the documents too.
    """
    spark = documents.sparkSession
    wanted = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).distinct()
    size = wanted.agg(F.sum(F.length("text"))).first()[0] or 0
    shared = shared_by(wanted)
    documents = spread(documents.select(doc_id, text), doc_id).where(F.length(text) > 0)
    passes = -(-size // ITEM_CHARS) or 1
    schema = documents.select(F.col(doc_id).alias("doc_id")).schema.add("item_id", items.schema[item_id].dataType)
    scratch, found = Scratch(spark, "leaks") if passes > 1 else None, []
    for part in range(passes):
        rows = wanted.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == part).orderBy("id", "text").collect()
        sent = spark.sparkContext.broadcast(index_items([tuple(r) for r in rows], shared))

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = sent.value
            for batch in batches:
                pairs = [(d, index.ids[r]) for d, t in zip(batch.iloc[:, 0], batch.iloc[:, 1]) for r, n in leaked_items(t, index).items() if n >= run]
                yield pd.DataFrame(sorted(set(pairs), key=repr), columns=["doc_id", "item_id"])

        out = documents.mapInPandas(scan, schema)
        if scratch:
            out = scratch.write(out)[1]
            sent.destroy()
        found.append(out)
    return reduce(DataFrame.unionByName, found)
