"""Full-text search: an inverted index of stemmed words and a query language of words, phrases, prefixes and AND, OR, NOT."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from claimlake.functions.stem import stem

COLUMNS = ("metric", "evidence", "subject")
_WORD = re.compile(r"[^\W_]+")


@F.pandas_udf(T.StringType())
def stemmed(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else stem(w))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " "), lambda w: F.length(w) > 0)


def plain_index(facts: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """``(token, fact_id, field, pos)`` of every word of every indexed column, unstemmed. Null texts have no words."""
    parts = F.array(*(F.struct(F.lit(c).alias("field"), words_of(F.col(c)).alias("w")) for c in columns))
    return facts.select("fact_id", F.explode(parts).alias("p")).select("fact_id", "p.field", F.posexplode("p.w").alias("pos", "token"))


def index(facts: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The stemmed index."""
    return plain_index(facts, columns).withColumn("token", stemmed("token"))


class Query:
    """A parsed query: leaves are word lists (phrases) with an optional field and prefix mark; ``test`` joins their flags."""

    def __init__(self, text: str):
        self.leaves: list[tuple[list[str], str | None, bool]] = []
        self._parts = re.findall(r'"[^"]*"|\(|\)|[^\s()"]+(?:"[^"]*")?', text)
        self._at = 0
        self.test = self._any()
        if self._at < len(self._parts):
            raise ValueError(f"cannot read the query at {self._parts[self._at]!r}")

    def _peek(self) -> str | None:
        return self._parts[self._at] if self._at < len(self._parts) else None

    def _any(self):
        tests = [self._all()]
        while self._peek() == "OR":
            self._at += 1
            tests.append(self._all())
        return lambda flags: _fold(tests, flags, lambda a, b: a | b)

    def _all(self):
        tests = [(self._one(), False)]
        while (p := self._peek()) not in (None, "OR", ")"):
            denied = p == "NOT"
            self._at += p in ("AND", "NOT")
            tests.append((self._one(), denied))
        return lambda flags: _fold([(lambda f, t=t, d=d: ~t(f) if d else t(f)) for t, d in tests], flags, lambda a, b: a & b)

    def _one(self):
        p = self._peek()
        if p is None or p == ")":
            raise ValueError("the query ends where a word should stand")
        self._at += 1
        if p == "(":
            inner = self._any()
            if self._peek() != ")":
                raise ValueError("a parenthesis is not closed")
            self._at += 1
            return inner
        field, _, rest = p.partition(":") if ":" in p else (None, "", p)
        prefix = rest.endswith("*")
        words = _WORD.findall(rest.lower())
        if not words:
            raise ValueError(f"no word in {p!r}")
        self.leaves.append(([w if prefix and i == len(words) - 1 else stem(w) for i, w in enumerate(words)], field, prefix))
        k = len(self.leaves) - 1
        return lambda flags: flags[k]


def _fold(tests, flags, join):
    out = tests[0](flags)
    for t in tests[1:]:
        out = join(out, t(flags))
    return out


def search(indexed: DataFrame, text: str) -> DataFrame:
    """``(fact_id)`` of the facts that match. Only postings of the query's words are read and shuffled, reduced to places."""
    q = Query(text)
    token, wanted, flags = F.col("token"), F.lit(False), []
    word_test = lambda w, prefix: token.startswith(w) if prefix else token == w
    places = []
    for words, field, prefix in q.leaves:
        row = []
        for i, w in enumerate(words):
            hit = word_test(w, prefix and i == len(words) - 1)
            if field:
                hit = hit & (F.col("field") == field)
            wanted = wanted | hit
            row.append(F.collect_set(F.when(hit, F.struct("field", F.col("pos") - i))).alias(f"w{len(places)}_{i}"))
        places.append(row)
    grouped = indexed.where(wanted).groupBy("fact_id").agg(*(c for row in places for c in row))
    for k, row in enumerate(places):
        shared = F.col(f"w{k}_0")
        for i in range(1, len(row)):
            shared = F.array_intersect(shared, F.col(f"w{k}_{i}"))
        flags.append(F.size(shared) > 0)
    return grouped.where(q.test(flags)).select("fact_id")
