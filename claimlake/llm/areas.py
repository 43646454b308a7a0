"""Subject areas of each document.

Sentences get an area (or none) from term features whose weights come from the labelled examples and, by expectation
maximisation over all documents, from terms that keep company with them. A chain of calibrated classifiers over the
sentence evidence, the source and the structure of the document then scores label combinations, each link seeing the
labels before it, and beam search decodes the most probable combination, which is the answer.

Nothing is known of any language but what its documents and the examples show: subject words are told from others by
the fewer documents they keep to (their burstiness), and areas of which a language has no example by the groups that
such words form and by how frequent these are.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from claimlake.llm.sentences import sentence_spans
from claimlake.plans.sample import smallest_hashes
from claimlake.plans.scratch import Scratch
from claimlake.plans.spread import spread

#: Documents that the chain is fitted on. Terms, shares and source priors are counted over all documents.
SAMPLE = 4_000
#: A term counts where more sentences than that of all documents have it; documents that a kernel takes at a time.
SELDOM, CHUNK = 3, 2_000
#: An area's least share of a document's sentences is 1 / PARTS.
PARTS = 4
#: Label combinations kept at each link.
BEAM = 6
#: Of examples whose area and language have EXAMPLES or more, every HELD-th is kept from the terms and the chain's links
#: and only calibrates them.
EXAMPLES, HELD = 8, 4
ROUNDS = 5

# Frequent words that tell a language written in Latin letters; scripts tell the others.
FUNCTION_WORDS = {
    "en": "the of and by was with said had at for to from this that is are were on as",
    "de": "im zu von bei und das der die den dem ein eine ist sich auf für mit nach",
    "fr": "sur le les des est et du une dans pour rien sous depuis au que n'est",
    "es": "el los del un una sin ni hay sobre por con las y su que no",
}
SCRIPTS = {"hi": "\u0900-\u097f", "ja": "\u3040-\u30ff", "zh": "\u3400-\u9fff", "th": "\u0e00-\u0e7f", "ar": "\u0600-\u06ff"}
#: A term in more than this share of a language's sentences belongs to no area; without evidence a sentence has none.
COMMON, NONE_BIAS = 0.12, 0.3
#: A term may tell of a subject where it stands in at most this share of the documents that chance would give it, and by
#: so many standard deviations of the sentences that chance lets fall into one document.
KEEPS, SURELY = 0.85, 3.0
#: A term that examples of one area alone have tells of it where this share of its sentences stands in documents that show
#: the area without it too; shorter documents are no evidence.
SUPPORTED, LEAST_SENTENCES = 0.8, 4
#: A term is of no known area where this share of its sentences stands in documents without terms of known areas, and
#: belongs to a group where this share of these stands in documents that hold the group's first term.
LONE, BESIDE = 0.8, 0.6
#: Ridge of the chain's links.
RIDGE = 0.1

_TELL = {w: lang for lang, ws in FUNCTION_WORDS.items() for w in ws.split() if sum(w in x.split() for x in FUNCTION_WORDS.values()) == 1}
_SCRIPT = [(lang, re.compile(f"[{chars}]")) for lang, chars in SCRIPTS.items()]
_TAG = re.compile(r"<(/?)([a-zA-Z][\w-]*)[^<>]*>")
_INLINE = frozenset("b i u em strong span a font mark small sub sup code".split())
_MARK = re.compile(r"(?m)^\s*(?:[-*•·]|\d+[.)]|#+|>)\s+|[*_`]{1,3}(?=\S)|(?<=\S)[*_`]{1,3}")
_LOWER_START = re.compile(r"(\S*)([.!?][\"”»)']*\s+[\"“(«]?)([^\W\d_])")
_ABBREVIATED = re.compile(r"(?:^|[^a-z])(?:cr|inc|ltd|corp|co|p\.a|a\.m|p\.m|etc|u\.s|vs|rs|no)$")
_WORD = re.compile(r"[ऀ-ॿ]+|[㐀-鿿぀-ヿ]+|[฀-๿]+|[^\W\d_]+(?:[-’'][^\W\d_]+)*")
_CJK = re.compile("[฀-๿぀-ヿ㐀-鿿]")


def plain_text(text: str) -> str:
    """``text`` without mark-up; each block element is a unit, and lower-cased texts get capitals to split at."""
    if "<" in text:
        text = _TAG.sub(lambda m: "" if m.group(2).lower() in _INLINE else " " if m.group(2).lower() == "br" else "\n\n", text)
    if "&" in text:
        text = html.unescape(text)
    text = _MARK.sub("", text)
    if text == text.lower() and text != text.upper():
        text = _LOWER_START.sub(lambda m: m.group(0) if _ABBREVIATED.search(m.group(1)) else m.group(1) + m.group(2) + m.group(3).upper(), text)
    return text


def language(sentence: str, words: Sequence[str]) -> str:
    """Language of a sentence by its script, else by its frequent words; English where nothing tells."""
    if not sentence.isascii():
        for lang, script in _SCRIPT:
            if script.search(sentence):
                return lang
    told = [_TELL[w] for w in words if w in _TELL]
    if not told or told.count("en") * 2 >= len(told):
        return "en"
    return max(FUNCTION_WORDS, key=lambda k: (told.count(k), k == "en"))


def sentence_terms(text: str | None) -> list[list[str]]:
    """Words, pairs of words and, in scripts without spaces, pieces of two to four characters, for each sentence.

    Terms of other languages than English carry its mark, so that languages do not share statistics.
    """
    if not text:
        return []
    clean = plain_text(text)
    out = []
    for a, b in sentence_spans(clean):
        words = _WORD.findall(clean[a:b].lower())
        if not words:
            continue
        terms = words + [f"{x} {y}" for x, y in zip(words, words[1:])]
        if _CJK.search(clean, a, b):
            for w in words:
                if len(w) > 2 and _CJK.match(w):
                    terms += [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]
        lang = language(clean[a:b], words)
        out.append(terms if lang == "en" else [f"{lang}:{t}" for t in terms])
    return out


@dataclass
class AreaModel:
    areas: list[str]
    terms: np.ndarray  # sorted numbers of terms
    weights: np.ndarray  # terms x (areas + none)
    chain: list[np.ndarray] = field(default_factory=list)
    calibration: list[tuple[float, float]] = field(default_factory=list)
    sources: dict[str, np.ndarray] = field(default_factory=dict)


LANGUAGES = [*FUNCTION_WORDS, *SCRIPTS]
_BITS = 59


@dataclass
class Chunk:
    """Documents as numbers: sentences of each, terms of each sentence, and the terms, each once a sentence."""

    n: np.ndarray
    sizes: np.ndarray
    terms: np.ndarray  # once placed, places in a vocabulary
    placed: bool = False

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    def known(self, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, place in ``vocabulary``) of the terms that it holds."""
        if self.placed:
            return np.repeat(np.arange(len(self.sizes)), self.sizes), self.terms
        if not len(vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(vocabulary, self.terms), len(vocabulary) - 1)
        there = vocabulary[at] == self.terms
        return np.repeat(np.arange(len(self.sizes)), self.sizes)[there], at[there]

    def narrowed(self, vocabulary: np.ndarray) -> Chunk:
        """The same documents with the terms of ``vocabulary`` alone, as places in it."""
        s, t = self.known(vocabulary)
        return Chunk(self.n, np.bincount(s, minlength=len(self.sizes)).astype(np.int64), t, placed=True)

    def by_document(self) -> dict[str, list[np.ndarray]]:
        """Sizes and terms of each document."""
        ends = np.cumsum(self.n)
        return {"sizes": np.split(self.sizes, ends[:-1]), "terms": np.split(self.terms, np.concatenate([[0], np.cumsum(self.sizes)])[ends[:-1]])}


def term_numbers(terms: Sequence[str]) -> np.ndarray:
    """A number for each term, the same in every process: four bits of its language and 59 of a hash."""
    if not len(terms):
        return np.zeros(0, np.int64)
    hashed = pd.util.hash_array(np.array(terms, dtype=object), categorize=True) & np.uint64((1 << _BITS) - 1)
    return hashed.astype(np.int64) | (np.array([LANGUAGES.index(_language_of(t)) for t in terms], np.int64) << _BITS)


def encode(texts: Sequence[str | None]) -> Chunk:
    """Texts as numbers."""
    by_doc = [[list(dict.fromkeys(x)) for x in sentence_terms(t)] for t in texts]
    flat = [x for d in by_doc for x in d]
    index: dict[str, int] = {}
    places = [index.setdefault(t, len(index)) for x in flat for t in x]
    numbers = term_numbers(list(index))
    return Chunk(np.array([len(d) for d in by_doc], np.int64), np.array([len(x) for x in flat], np.int64), numbers[places] if places else np.zeros(0, np.int64))


def _exact(p: np.ndarray) -> np.ndarray:
    """``p`` in steps of 2**-20, whose sums are exact, so that they do not depend on partitions."""
    return np.rint(p * (1 << 20)) / (1 << 20)


def _sums(t: np.ndarray, p: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(t, p[:, j], size) for j in range(p.shape[1])], 1)


def _evidence(s: np.ndarray, t: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(s, weights[t, k], n) for k in range(weights.shape[1])], 1) if n else np.zeros((0, weights.shape[1]))


def _posterior(evidence: np.ndarray, doc: np.ndarray, n_docs: int, rounds: int = 3) -> np.ndarray:
    """Class probabilities of sentences under a mixture of classes that each document has for itself."""
    k = evidence.shape[1]
    evidence = evidence + np.where(np.arange(k) == k - 1, NONE_BIAS, 0.0)
    base = evidence - evidence.max(1, keepdims=True)
    share = np.full((n_docs, k), 1 / k)
    for _ in range(rounds):
        p = np.exp(base + np.log(share[doc]))
        p /= p.sum(1, keepdims=True)
        share = np.stack([np.bincount(doc, p[:, j], n_docs) for j in range(k)], 1) + 0.15
        share /= share.sum(1, keepdims=True)
    return p if len(base) else base


def _term_weights(counts: np.ndarray, tongue: np.ndarray) -> np.ndarray:
    """Log ratio of a term's rate in a class to its rate overall, within its language; terms that tell nothing get nothing."""
    w = np.zeros_like(counts)
    for lang in np.unique(tongue):
        own = counts[tongue == lang]
        # classes that a language hardly shows borrow its overall rate, so its frequent words do not speak for them
        overall = (own.sum(1, keepdims=True) + 0.05) / (own.sum() + 0.05 * len(own))
        rate = (own + 0.05 + 20 * overall) / (own.sum(0) + 0.05 * len(own) + 20)
        certain = own.sum(1, keepdims=True) / (own.sum(1, keepdims=True) + 2.0)
        w[tongue == lang] = np.clip(np.log(rate / rate.mean(1, keepdims=True)), -3, 3) * certain
    return np.where(w.max(1, keepdims=True) - w.min(1, keepdims=True) < 0.5, 0, w)


def _language_of(term: str) -> str:
    head, mark, _ = term.partition(":")
    return head if mark else "en"


def _classes(s: np.ndarray, t: np.ndarray, n: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = _evidence(s, t, n, weights)
    top = e.max(1, keepdims=True, initial=0)
    p = ((e == top) & (top > 0)).astype(float)
    return p / np.maximum(p.sum(1, keepdims=True), 1), top[:, 0] > 0


def _company(chunk: Chunk, terms: np.ndarray, pure: np.ndarray) -> np.ndarray:
    """For each term the areas that the documents of its sentences show by terms of one area alone."""
    s, t = chunk.known(terms)
    doc = chunk.doc
    p, _ = _classes(s, t, len(doc), pure)
    by_doc = _sums(doc, p, len(chunk.n))
    by_doc /= np.maximum(by_doc.sum(1, keepdims=True), 1)
    return _sums(t, _exact(by_doc)[doc[s]], len(terms))


def _support(chunk: Chunk, terms: np.ndarray, pure: np.ndarray) -> np.ndarray:
    """For each term of one area alone its sentences in documents of LEAST_SENTENCES or more: those in documents that
    show the area in a sentence without the term, and all."""
    s, t = chunk.known(terms)
    doc = chunk.doc
    long = chunk.n[doc[s]] >= LEAST_SENTENCES
    p, _ = _classes(s, t, len(doc), pure)
    shows = _sums(doc, (p > 0).astype(float), len(chunk.n))
    keep = long & pure[t].any(1)
    d, t, area = doc[s[keep]], t[keep], pure[t[keep]].argmax(1)
    pair, at, own = np.unique(d * len(terms) + t, return_inverse=True, return_counts=True)
    told = (p[s[keep], area] > 0).astype(float)
    own = np.bincount(at, told, len(pair))
    return _sums(t, np.stack([shows[d, area] > own[at], np.ones(len(t))], 1).astype(float), len(terms))


def _unexplained(chunk: Chunk, terms: np.ndarray, pure: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, place in ``terms``) in documents few of whose sentences have a term of a known area, and those documents."""
    s, t = chunk.known(terms)
    doc = chunk.doc
    _, told = _classes(s, t, len(doc), pure)
    free = PARTS * np.bincount(doc[told], minlength=len(chunk.n)) < chunk.n
    return s[free[doc[s]]], t[free[doc[s]]], free


def _outside(chunk: Chunk, terms: np.ndarray, pure: np.ndarray) -> np.ndarray:
    """For each term its sentences in unexplained documents, and in all."""
    _, inside, _ = _unexplained(chunk, terms, pure)
    return np.stack([np.bincount(inside, minlength=len(terms)), np.bincount(chunk.known(terms)[1], minlength=len(terms))], 1)


def _beside(chunk: Chunk, terms: np.ndarray, pure: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """For each term its sentences in unexplained documents that hold one of ``seeds``."""
    s, t, _ = _unexplained(chunk, terms, pure)
    doc = chunk.doc[s]
    holds = np.bincount(doc[np.isin(t, seeds)], minlength=len(chunk.n)) > 0
    return np.bincount(t[holds[doc]], minlength=len(terms))[:, None]


def _spread_of(chunk: Chunk, terms: np.ndarray, pure: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Documents of each language and area, and below them unexplained ones of each language and group of terms."""
    s, t = chunk.known(terms)
    doc, k = chunk.doc, pure.shape[1]
    p, _ = _classes(s, t, len(doc), pure)
    by_doc = _sums(doc, p, len(chunk.n))
    by_doc /= np.maximum(by_doc.sum(1, keepdims=True), 1)
    tongue = np.zeros(len(chunk.n), np.int64)
    tongue[doc[s]] = terms[t] >> _BITS
    out = np.zeros((2 * len(LANGUAGES), k))
    np.add.at(out, tongue, _exact(by_doc))
    _, t, free = _unexplained(chunk, terms, pure)
    s, every = chunk.known(terms)
    member = groups[every]
    held = (member >= 0) & free[doc[s]]
    pairs = np.unique(np.stack([doc[s[held]], member[held]], 1), axis=0)
    np.add.at(out, (len(LANGUAGES) + tongue[pairs[:, 0]], pairs[:, 1]), 1)
    return out


def _name_groups(terms: np.ndarray, pure: np.ndarray, topical: np.ndarray, tally: Tally) -> np.ndarray:
    """``pure`` with terms for areas of which a language has no example.

    Documents without a term of any known area are told apart by the company of terms: in each language the most
    frequent term of such documents and the terms that stand beside it make a group, then the most frequent of the
    rest, as many as areas are missing. Groups are named by frequency: the more documents a group has, the more
    frequent the area that it stands for is in languages with examples of all areas.
    """
    tongue, k = terms >> _BITS, pure.shape[1]
    missing = {}
    for lang in np.unique(tongue).tolist():
        has = (pure[tongue == lang, :-1] > 0).any(0)
        if not has.all():
            missing[lang] = np.flatnonzero(~has)
    covered = [i for i in range(len(LANGUAGES)) if i in tongue and i not in missing]
    if not missing or not covered:
        return pure
    outside = tally(partial(_outside, terms=terms, pure=pure), len(terms))
    free = outside[:, 0]
    open_ = topical & (free >= LONE * outside[:, 1]) & (free > SELDOM)
    groups = np.full(len(terms), -1)
    for g in range(max(map(len, missing.values()))):
        seeds = []
        for lang, areas in missing.items():
            left = np.where(open_ & (groups < 0) & (tongue == lang), free, 0)
            if g < len(areas) and left.any():
                seeds.append(int(left.argmax()))
        if not seeds:
            break
        beside = tally(partial(_beside, terms=terms, pure=pure, seeds=np.array(seeds)), len(terms))[:, 0]
        groups[open_ & (groups < 0) & np.isin(tongue, tongue[seeds]) & (beside >= BESIDE * free)] = g
    docs = tally(partial(_spread_of, terms=terms, pure=pure, groups=groups), 2 * len(LANGUAGES))
    usual = docs[covered].sum(0)
    named = pure.copy()
    for lang, areas in missing.items():
        size = docs[len(LANGUAGES) + lang]
        # ties go to the earlier group and the earlier area
        for g, area in zip(np.argsort(-size[: len(areas)], kind="stable"), areas[np.argsort(-usual[areas], kind="stable")]):
            of = (groups == g) & (tongue == lang)
            named[of, area] = 1.0
    return named


def _first(chunk: Chunk, terms: np.ndarray, pure: np.ndarray, wider: np.ndarray) -> np.ndarray:
    """Term counts under the first classes of unlabelled sentences: by terms of one area alone, else by terms that stand
    only in documents of one area, else none. General remarks stand in documents of all areas, so none of their terms
    is telling."""
    s, t = chunk.known(terms)
    p, told = _classes(s, t, len(chunk.sizes), pure)
    q, hinted = _classes(s, t, len(chunk.sizes), wider)
    p = np.where(told[:, None], p, q)
    p[~told & ~hinted, -1] = 1
    return _sums(t, _exact(p)[s], len(terms))


def _expected(chunk: Chunk, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Term counts under the classes that ``weights`` give sentences."""
    s, t = chunk.known(terms)
    p = _posterior(_evidence(s, t, len(chunk.sizes), weights), chunk.doc, len(chunk.n))
    return _sums(t, _exact(p)[s], len(terms))


#: Below it stand sizes of documents, as ``LENGTHS - (sentences * 16 + language)``.
LENGTHS = -100


def term_counts(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each term its sentences and its documents; below 0, sentences of each language at ``-1 - place`` and, below
    LENGTHS, documents with so many sentences of a language."""
    h, n = np.unique(chunk.terms, return_counts=True)
    doc = chunk.doc
    _, place = np.unique(chunk.terms, return_inverse=True)
    pairs = np.unique(place * max(len(chunk.n), 1) + np.repeat(doc, chunk.sizes))
    docs = np.bincount(pairs // max(len(chunk.n), 1), minlength=len(h))
    first = chunk.terms[np.cumsum(chunk.sizes) - chunk.sizes] >> _BITS if len(chunk.sizes) else np.zeros(0, np.int64)
    lang, m = np.unique(first, return_counts=True)
    of, size = np.unique(doc * 16 + first, return_counts=True)
    length, many = np.unique(size * 16 + of % 16, return_counts=True)
    return np.concatenate([-1 - lang, LENGTHS - length, h]), np.concatenate([m, many, n]), np.concatenate([m, many, docs])


def _topical(tongue: np.ndarray, n: np.ndarray, docs: np.ndarray, length: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a term keeps to fewer documents than words do that stand in sentences by chance, and whether it does not;
    of seldom terms neither is certain.

    A term in ``n`` sentences of its language would by chance stand in the sum over documents of one less the chance
    that none of their sentences has it; subject words come again in the documents they stand in.
    """
    out, by_chance = np.zeros(len(n), bool), np.zeros(len(n), bool)
    for lang in np.unique(tongue):
        size, times = length[length % 16 == lang] // 16, many[length % 16 == lang]
        own = tongue == lang
        total = float(size @ times)
        if not total:
            continue
        grid = np.logspace(np.log10(0.5 / total), 0, 200)
        chance = np.array([times @ -np.expm1(size * np.log1p(-min(r, 1 - 1e-12))) for r in grid])
        usual = np.interp(n[own] / total, grid, chance)
        few = docs[own] <= KEEPS * usual
        out[own] = few & (usual - docs[own] >= SURELY * np.sqrt(np.maximum(n[own] - usual, 0) + 1))
        by_chance[own] = ~few & (n[own] - usual >= 1)
    return out, by_chance


#: Sums a step over all documents, given the rows of its result.
Tally = Callable[[Callable[[Chunk], np.ndarray], int], np.ndarray]


def _fit_terms(areas: list[str], labelled: Sequence[tuple[int, Chunk]], counts: tuple[np.ndarray, np.ndarray, np.ndarray], over: Callable[[np.ndarray], Tally]) -> AreaModel:
    """Term weights. ``counts`` are :func:`term_counts` of all documents, ``over`` gives the tally of a vocabulary."""
    k = len(areas) + 1
    h, n, docs = counts
    spoken = np.zeros(len(LANGUAGES))
    of = (h < 0) & (h > LENGTHS)
    spoken[-1 - h[of]] = n[of]
    wide = dict(zip(h[h >= 0].tolist(), zip(n[h >= 0].tolist(), docs[h >= 0].tolist())))
    seen = Counter(t for _, c in labelled for t in c.terms.tolist())
    terms = np.array(sorted({t for t, m in seen.items() if m > 1} | {t for t, m in wide.items() if m[0] > SELDOM}), np.int64)
    size, tally = len(terms), over(terms)
    gold = np.zeros((size, k))
    for area, chunk in labelled:
        np.add.at(gold, (chunk.known(terms)[1], area), 1.0)
    # first round: terms that examples of one area alone have; a sentence without any tells of nothing
    total = gold.sum(1)
    pure = np.zeros((size, k))
    tongue = terms >> _BITS
    seen_in = np.array([wide.get(t, (0, 0)) for t in terms.tolist()]).reshape(size, 2)
    common = seen_in[:, 0] > COMMON * np.maximum(spoken[tongue], 25)
    topical, by_chance = _topical(tongue, *seen_in.T, LENGTHS - h[h < LENGTHS], n[h < LENGTHS])
    topical &= ~common
    sure = (gold.max(1) >= 0.9 * total) & (topical & (total > 0) | ~common & ~by_chance & (total > 1))
    pure[sure, gold[sure].argmax(1)] = np.log1p(total[sure])
    support = tally(partial(_support, terms=terms, pure=pure), size)
    pure[support[:, 0] < SUPPORTED * support[:, 1]] = 0
    pure = _name_groups(terms, pure, topical, tally)
    company = tally(partial(_company, terms=terms, pure=pure), size)
    total = company.sum(1)
    telling = (company.max(1) >= 0.85 * total) & (total >= 3) & ~common
    wider = np.zeros_like(pure)
    wider[telling, company[telling].argmax(1)] = np.log1p(total[telling])
    step = partial(_first, terms=terms, pure=pure, wider=wider)
    for _ in range(ROUNDS):
        weights = _term_weights(3 * gold + tally(step, size), tongue)
        weights[common] = 0
        step = partial(_expected, terms=terms, weights=weights)
    return AreaModel(areas, terms, weights)


def _labelled(examples: Sequence[tuple[str, str]]) -> tuple[list[str], list[tuple[int, Chunk]], list[tuple[int, Chunk]]]:
    """Areas, and the examples as numbers: those to fit on and those held out."""
    areas = sorted({a for a, _ in examples})
    every = [(areas.index(a), encode([text])) for a, text in examples]
    cell = lambda x: (x[0], int(x[1].terms[0]) >> _BITS if len(x[1].terms) else -1)
    size, seen = Counter(map(cell, every)), Counter()
    fit, held = [], []
    for x in every:
        seen[cell(x)] += 1
        (held if size[cell(x)] >= EXAMPLES and seen[cell(x)] % HELD == 0 else fit).append(x)
    return areas, fit, held


def fit_terms(examples: Sequence[tuple[str, str]], texts: Sequence[str]) -> AreaModel:
    """Term weights from ``(area, text)`` examples and unlabelled texts, in memory."""
    areas, labelled, _ = _labelled(examples)
    chunk = encode(texts)
    narrow = lambda terms: partial(lambda own, step, size: step(own), chunk.narrowed(terms))
    return _fit_terms(areas, labelled, term_counts(chunk), narrow)


@dataclass
class Reading:
    """What the sentences of documents tell: their number, how many have each area as their best class, and the sums of
    class probabilities and of their variances."""

    n: np.ndarray
    votes: np.ndarray
    total: np.ndarray
    variance: np.ndarray

    def __add__(self, other: Reading) -> Reading:
        return Reading(*(np.concatenate([a, b]) for a, b in zip(vars(self).values(), vars(other).values())))


def read_documents(chunk: Chunk, model: AreaModel) -> Reading:
    n, doc = chunk.n, chunk.doc
    s, t = chunk.known(model.terms)
    k = len(model.areas) + 1
    if not len(doc):
        return Reading(n, *(np.zeros((len(n), k)) for _ in range(3)))
    p = _posterior(_evidence(s, t, len(doc), model.weights), doc, len(n))
    votes = np.zeros((len(n), k))
    np.add.at(votes, (doc, p.argmax(1)), 1)
    return Reading(n, votes, _sums(doc, p, len(n)), _sums(doc, p * (1 - p), len(n)))


def _features(read: Reading, sources: Sequence, model: AreaModel) -> np.ndarray:
    """Sentence evidence of each area, the source's prior, and the structure of the document."""
    n = np.maximum(read.n, 1)[:, None]
    share, mean = read.votes / n, read.total / n
    none = np.zeros(len(model.areas))
    prior = np.array([model.sources.get(x, none) for x in sources]).reshape(len(n), len(model.areas))
    structure = np.stack([np.log1p(read.n), share[:, -1], (share[:, :-1] > 0).sum(1), share[:, :-1].max(1, initial=0)], 1)
    near = 1 / (1 + np.exp(-24 * (share[:, :-1] - 1 / PARTS)))
    beyond = np.tanh(PARTS * read.votes - n + 0.5)[:, :-1]
    # by how many standard deviations the expected number of sentences passes the least one
    certain = np.tanh((read.total - n / PARTS) / np.sqrt(read.variance + 0.05))[:, :-1]
    return np.hstack([np.ones((len(n), 1)), share[:, :-1], near, beyond, mean[:, :-1], certain, prior, structure])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def _source_priors(counts: dict, labels: dict) -> dict[str, np.ndarray]:
    """How much more often than overall documents of each source have each area, as a logarithm."""
    rate = (np.sum(list(labels.values()), 0) + 1) / (sum(counts.values()) + 2)
    return {s: np.log((labels[s] + 20 * rate) / (counts[s] + 20) / rate) for s in counts if s is not None}


def _told(read: Reading) -> np.ndarray:
    """Areas that a quarter of the sentences have as their best class: labels of the documents that links are fitted on."""
    return (PARTS * read.votes[:, :-1] >= read.n[:, None]) & (read.n[:, None] > 0)


def _fit_links(model: AreaModel, read: Reading, sources: Sequence, fit: Sequence[tuple[int, Chunk]], held: Sequence[tuple[int, Chunk]]) -> AreaModel:
    """Fit the chain on documents and on labelled examples; every third document and the held-out examples calibrate it."""
    x, y = _features(read, sources, model), _told(read)
    apart = np.arange(len(x)) % 3 == 0
    for examples, calibrates in ((fit, False), (held, True)):
        for area, chunk in examples:
            x = np.vstack([x, _features(read_documents(chunk, model), [None], model)])
            y = np.vstack([y, np.arange(len(model.areas)) == area])
            apart = np.append(apart, calibrates)
    for j in range(len(model.areas)):
        z = np.hstack([x, y[:, :j].astype(float)])
        w = _logistic(z[~apart], y[~apart, j].astype(float), RIDGE)
        score = z[apart] @ w
        a = _logistic(np.stack([np.ones(len(score)), score], 1), y[apart, j].astype(float), RIDGE)
        model.chain.append(w)
        model.calibration.append((float(a[0]), float(a[1])))
    return model


def fit_chain(model: AreaModel, examples: Sequence[tuple[str, str]], texts: Sequence[str | None], sources: Sequence) -> AreaModel:
    """Source priors and the chain from texts in memory."""
    read = read_documents(encode(texts), model)
    labels: dict = {}
    for s, row in zip(sources, _told(read)):
        labels[s] = labels.get(s, 0) + row
    if labels:
        model.sources = _source_priors(Counter(sources), labels)
    return _fit_links(model, read, sources, *_labelled(examples)[1:])


def decode(model: AreaModel, x: np.ndarray) -> np.ndarray:
    """Beam search over label combinations: the most probable one for each row of ``x``."""
    rows, k = len(x), len(model.areas)
    labels, logp = np.zeros((rows, 1, k), bool), np.zeros((rows, 1))
    for j in range(k):
        w, (a, b) = model.chain[j], model.calibration[j]
        score = (x @ w[: x.shape[1]])[:, None] + labels[:, :, :j].astype(float) @ w[x.shape[1] :]
        score = np.clip(a + b * score, -30, 30)
        yes, no = -np.log1p(np.exp(-score)), -np.log1p(np.exp(score))
        both, on = np.concatenate([labels, labels], 1), np.concatenate([logp + no, logp + yes], 1)
        both[:, labels.shape[1] :, j] = True
        keep = np.argsort(-on, 1, kind="stable")[:, :BEAM]
        labels, logp = np.take_along_axis(both, keep[:, :, None], 1), np.take_along_axis(on, keep, 1)
    return labels[:, 0]


def _decided(read: Reading, sources: Sequence, model: AreaModel) -> np.ndarray:
    """The decoded combination of each document; one without sentences has no area."""
    return decode(model, _features(read, sources, model)) & (read.n[:, None] > 0)


def classify(texts: Sequence[str | None], sources: Sequence, model: AreaModel) -> list[list[str]]:
    """Areas of each text."""
    if not len(texts):
        return []
    return [[model.areas[j] for j in np.flatnonzero(row)] for row in _decided(read_documents(encode(texts), model), sources, model)]


def _chunks(batches: Iterator[pd.DataFrame], placed: bool = False) -> Iterator[tuple[pd.DataFrame, Chunk]]:
    for batch in batches:
        for at in range(0, len(batch), CHUNK):
            part = batch.iloc[at : at + CHUNK]
            whole = lambda c: np.concatenate([np.zeros(0, np.int64), *part[c]]).astype(np.int64)  # noqa: B023, E731
            yield part, Chunk(part["n"].to_numpy(np.int64), whole("sizes"), whole("terms"), placed)


def _encoded(documents: DataFrame) -> DataFrame:
    """Documents as numbers, one row each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                c = encode(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "source": part["source"].to_numpy(), "n": c.n, **c.by_document()})

    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, source string, n int, sizes array<int>, terms array<bigint>"
    return spread(documents.select("doc_id", "text", "source"), "doc_id").where(F.length("text") > 0).mapInPandas(run, schema)


def _count_all(encoded: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`term_counts` over all documents, seldom terms left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, chunk in _chunks(batches):
            yield pd.DataFrame(dict(zip(("h", "n", "docs"), term_counts(chunk))))

    counted = encoded.drop("doc_id", "source").mapInPandas(run, "h bigint, n bigint, docs bigint").groupBy("h").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    got = counted.where((F.col("n") > SELDOM) | (F.col("h") < 0)).toArrow()
    return tuple(got[c].to_numpy() for c in ("h", "n", "docs"))


def _narrowed(encoded: DataFrame, terms: np.ndarray) -> DataFrame:
    """Documents with the terms of a vocabulary alone, as places in it."""
    shared = encoded.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, chunk in _chunks(batches):
            yield part[["doc_id", "source", "n"]].assign(**chunk.narrowed(shared.value).by_document())

    return encoded.mapInPandas(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, source string, n int, sizes array<int>, terms array<int>")


def _tally(narrowed: DataFrame, k: int) -> Tally:
    """Sums of a step over all documents; what the step knows is broadcast, and tasks send sums of terms."""
    context = narrowed.sparkSession.sparkContext

    def tally(step: Callable[[Chunk], np.ndarray], size: int) -> np.ndarray:
        shared = context.broadcast(step)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = 0
            for _, chunk in _chunks(batches, placed=True):
                sums = sums + shared.value(chunk)
            if not np.isscalar(sums):
                some = np.flatnonzero(sums.any(1))
                yield pd.DataFrame({"i": some, **{f"c{j}": sums[some, j] if j < sums.shape[1] else 0.0 for j in range(k)}})

        schema = ", ".join(["i int", *(f"c{j} double" for j in range(k))])
        got = narrowed.select("n", "sizes", "terms").mapInPandas(run, schema).groupBy("i").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(k))).toArrow()
        shared.destroy()
        out = np.zeros((size, k))
        out[got["i"].to_numpy()] = np.stack([got[f"c{j}"].to_numpy() for j in range(k)], 1)
        return out

    return tally


def _read_all(narrowed: DataFrame, model: AreaModel) -> DataFrame:
    """:func:`read_documents` of all documents: ``(doc_id, source, n, votes, total, variance)``."""
    shared = narrowed.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, chunk in _chunks(batches, placed=True):
            r = read_documents(chunk, shared.value)
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "source": part["source"].to_numpy(), "n": r.n, "votes": list(r.votes), "total": list(r.total), "variance": list(r.variance)})

    return narrowed.mapInPandas(run, f"doc_id {narrowed.schema['doc_id'].dataType.simpleString()}, source string, n int, votes array<double>, total array<double>, variance array<double>")


def _as_reading(part: pd.DataFrame, k: int) -> Reading:
    return Reading(part["n"].to_numpy(np.int64), *(np.array(part[c].tolist(), float).reshape(len(part), k) for c in ("votes", "total", "variance")))


def _chained(read: DataFrame, model: AreaModel, sample: int, fit: Sequence[tuple[int, Chunk]], held: Sequence[tuple[int, Chunk]]) -> AreaModel:
    """Source priors over all documents, and the chain on at most ``sample`` of them, those with the smallest hash of their id."""
    has = [F.count_if((F.col("n") > 0) & (PARTS * F.col("votes")[j] >= F.col("n"))).alias(f"c{j}") for j in range(len(model.areas))]
    rows = read.groupBy("source").agg(F.count("*").alias("m"), *has).collect()
    counts = {r["source"]: r["m"] for r in rows}
    if counts:
        model.sources = _source_priors(counts, {r["source"]: np.array(r[2:], float) for r in rows})
    some = smallest_hashes(read, F.col("doc_id"), sample, sum(counts.values())).toPandas()
    return _fit_links(model, _as_reading(some, len(model.areas) + 1), some["source"].tolist(), fit, held)


def label_documents(documents: DataFrame, examples: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, area)`` of every area that at least a quarter of a document's sentences are about.

    * Null and empty texts, and texts of general remarks only, have no area and no row; every copy is labelled.
    * A document's areas do not depend on other documents once the model is fitted; a tie at exactly a quarter counts.
    * Null sources are allowed. No examples: no rows. Other columns are ignored.

    Texts are read once and cross no shuffle; what is kept of them are numbers of terms, which every round reads. A
    round broadcasts the weights and gathers sums of terms; both grow with the vocabulary, as does the model.
    """
    spark = documents.sparkSession
    schema = documents.select("doc_id").schema.add("area", "string")
    given = [(r[0], r[1]) for r in examples.select("area", "text").where("area is not null and length(text) > 0").orderBy("area", "text").collect()]
    if not given:
        return spark.createDataFrame([], schema)
    areas, labelled, held = _labelled(given)
    scratch = Scratch(spark, "areas")
    path, encoded = scratch.write(_encoded(documents))
    counts, kept = _count_all(encoded), []

    def over(terms: np.ndarray) -> Tally:
        kept[:] = scratch.write(_narrowed(encoded, terms))
        scratch.drop(path)
        return _tally(kept[1], len(areas) + 1)

    model = _fit_terms(areas, labelled, counts, over)
    _, read = scratch.write(_read_all(kept[1], model))
    scratch.drop(kept[0])
    model = _chained(read, model, sample, labelled, held)
    model.terms, model.weights = model.terms[:0], model.weights[:0]
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if not len(part):
                continue
            found = _decided(_as_reading(part, len(shared.value.areas) + 1), part["source"].tolist(), shared.value)
            row, j = np.nonzero(found)
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[row], "area": np.array(shared.value.areas, dtype=object)[j]})

    return read.mapInPandas(run, schema)
