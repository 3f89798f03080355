"""Toxicity by class-conditional Kneser-Ney models.

Words are spelt by two character n-gram models, one of toxic and one of
ordinary text.  Each has its own counts at the longest context and backs off
to one Kneser-Ney model of both classes together, so an expression that is
rare in either class costs the same under both and only real differences
speak.  A document's evidence is the sum, over its distinct words, of the
log-likelihood ratio beyond a margin, normalised by its length; a logistic fit
turns it into a probability.

Because both models share everything below the longest context, the ratio of
a character is one of three constants: that of its n-gram, that of its context,
or 0 where neither class knows the context.  The model is two tables of packed
keys and values, whose size is bounded by the training sample.

Defined cases: null and empty texts, and texts without words, have no evidence
and get the lowest score; without labels of both classes every score is 0;
repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findrift.llm.labelled import logistic, probability, training_sample

#: Bounds of the training sample: documents of each class, documents for calibration,
#: and windows of WINDOW characters, spread evenly, that a longer document is fitted by.
PER_CLASS, CALIBRATION, PER_DOCUMENT, WINDOW = 6000, 6000, 64, 1024
U = np.uint64
ORDER = 6
#: Discounts of classes' counts of 1, 2 and more: what was seen once or twice is nearly ignored.
DISCOUNTS, SHARED_DISCOUNT = (0.99, 1.8, 2.5), 0.75
#: Log-likelihood ratio of a word that counts as chance; power of the length.
MARGIN, LENGTH_POWER = 1.0, 0.8
_WORD = re.compile(r"\w+")
_CACHE = 300_000


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


# --------------------------------------------------------------------------- n-grams as arrays
def grams(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of the longest order that ends in each character and in the end of
    each word: code points in ORDER columns, filled up with 0 on the left; and the
    number of its word."""
    sizes = np.array([len(w) + 2 for w in found], np.int64)
    chars = np.frombuffer("".join(f"\x02{w}\x03" for w in found).encode("utf-32-le", "surrogatepass"), "<u4")
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(np.arange(len(chars)) > first)  # a word's start is only context
    out = np.zeros((len(at), ORDER), np.uint32)
    for back in range(ORDER):
        place = at - back
        held = place >= first[at]
        out[held, ORDER - 1 - back] = chars[place[held]]
    return out, np.repeat(np.arange(len(found)), sizes - 1)


def key_of(x: np.ndarray, length: int | None = None, context: bool = False) -> np.ndarray:
    """64-bit keys of n-grams: of their last ``length`` characters, and without the last of those for ``context``."""
    h = np.zeros(len(x), U)
    for c in range(ORDER if length is None else length, 0, -1):
        if context and c == 1:
            break
        h = (h ^ x[:, ORDER - c].astype(U)) * U(0x9E3779B97F4A7C15)
        h ^= h >> U(29)
    return h * U(0xD6E8FEB86659FD93) ^ (h >> U(32))


class Table:
    """Sorted keys with a value each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values

    def get(self, keys: np.ndarray, otherwise: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(whether known, values)."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.full(len(keys), otherwise)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return known, np.where(known, self.values[at], otherwise)


def _summed(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted different keys, one place of each, and sums of weights."""
    found, place, of = np.unique(keys, return_index=True, return_inverse=True)
    return found, place, *(np.bincount(of, w, len(found)) for w in weights)


def _counted(found: list[str], ordinary: np.ndarray, toxic: np.ndarray, block: int = 20_000) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Keys, code points and counts by class of the different n-grams, a block of words at a time."""
    key, x, own = np.empty(0, U), np.empty((0, ORDER), np.uint32), [np.empty(0), np.empty(0)]
    held: list[tuple] = []
    for a in range(0, len(found) + block, block):
        if a < len(found):
            y, of = grams(found[a:a + block])
            k, place, *c = _summed(key_of(y), *(np.asarray(n[a:a + block], float)[of] for n in (ordinary, toxic)))
            held.append((k, y[place], c))
        if sum(len(h[0]) for h in held) > len(key) or a + block >= len(found):
            every = np.concatenate([key, *(h[0] for h in held)])
            rows = np.concatenate([x, *(h[1] for h in held)])
            both = [np.concatenate([own[k], *(h[2][k] for h in held)]) for k in (0, 1)]
            held.clear()
            key, place, *own = _summed(every, *both)
            x = rows[place]
    return key, x, own


def ratio_tables(found: list[str], ordinary: np.ndarray, toxic: np.ndarray) -> tuple[Table, Table]:
    """Log-likelihood ratios (toxic over ordinary) of n-grams and of contexts,
    from words and the ordinary and toxic documents that hold each."""
    key, x, own = _counted(found, ordinary, toxic)
    size = (x != 0).sum(axis=1)
    # shared model: left continuations of every shorter n-gram, with the sum and
    # the number of kinds of each context; a shorter one backs off to one shorter still
    shared, lower = None, np.zeros(len(x))
    for m in range(1, ORDER):
        longer = x[size > m]
        k, at, seen = _summed(key_of(longer, m), np.ones(len(longer)))
        ends = longer[at]
        ctx = key_of(ends, m, context=True)
        c, _, mass, kinds = _summed(ctx, seen, np.ones(len(seen)))
        here = np.searchsorted(c, ctx)
        below = np.full(len(k), 1 / 1000) if shared is None else shared.get(key_of(ends, m - 1))[1]
        p = (np.maximum(seen - SHARED_DISCOUNT, 0) + SHARED_DISCOUNT * kinds[here] * below) / mass[here]
        shared = Table(k, p)
        mine = size == m + 1  # n-grams whose next shorter one has m characters
        lower[mine] = shared.get(key_of(x[mine], m))[1]

    cut = lambda c: np.array([0.0, *DISCOUNTS])[np.minimum(c, 3).astype(np.int64)]
    ctx = key_of(x, context=True)
    contexts, _, *sums = _summed(ctx, own[0], cut(own[0]), own[1], cut(own[1]))
    here = np.searchsorted(contexts, ctx)
    back, p = [], []
    for k in (0, 1):
        total, freed = sums[2 * k], sums[2 * k + 1]
        with np.errstate(invalid="ignore", divide="ignore"):
            back.append(np.where(total > 0, freed / total, 1.0))
            kept = np.where(own[k] > 0, (own[k] - cut(own[k])) / total[here], 0.0)
        p.append(kept + back[k][here] * lower)
    return Table(key, np.log(p[1] / p[0])), Table(contexts, np.log(back[1] / back[0]))


class Scorer:
    """Evidence of texts; keeps the ratios of words met before, up to a bound."""

    def __init__(self, of_gram: Table, of_context: Table):
        self._gram, self._context, self._known = of_gram, of_context, {}

    def ratios(self, found: list[str]) -> np.ndarray:
        """Log-likelihood ratio of each word."""
        if not found:
            return np.empty(0)
        x, of = grams(found)
        known, r = self._gram.get(key_of(x))
        r[~known] = self._context.get(key_of(x[~known], context=True))[1]
        return np.bincount(of, r, len(found))

    def evidence(self, texts: list[str | None]) -> list[float]:
        out = []
        for a in range(0, len(texts), 64):
            held = [sorted(words(t)) for t in texts[a:a + 64]]  # one order of addition on every worker
            if len(self._known) >= _CACHE:
                self._known.clear()
            new = {w for f in held for w in f if w not in self._known}
            ratio = dict(zip(new, self.ratios(list(new)).tolist(), strict=True))
            short = {w: r for w, r in ratio.items() if len(w) <= 40}
            self._known.update(short)
            get = lambda w, ratio=ratio: self._known[w] if w in self._known else ratio[w]
            out += [sum(max(0.0, get(w) - MARGIN) for w in f) / max(1, len(f)) ** LENGTH_POWER for f in held]
        return out


def features(evidence: np.ndarray) -> np.ndarray:
    return np.log(np.asarray(evidence, float) + 0.01).reshape(-1, 1)


@dataclass
class ToxicityModel:
    tables: object  # broadcast of the two tables, None without labels of both classes
    weights: np.ndarray | None

    def score(self, text: Column) -> Column:
        """Probability that a text is toxic."""
        if self.tables is None:
            return F.lit(0.0)
        return _udf(self.tables, self.weights)(text)


def _udf(tables, weights=None):
    keep: list[Scorer] = []

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not keep:
            keep.append(Scorer(*tables.value))
        for texts in batches:
            e = np.array(keep[0].evidence(texts.tolist()), float)
            yield pd.Series(e if weights is None else probability(features(e), weights))
    return run


def windows(text: str) -> list[str]:
    """The text, or PER_DOCUMENT windows of it where it is longer than they are."""
    if len(text) <= PER_DOCUMENT * WINDOW:
        return [text]
    return [text[a:a + WINDOW] for a in np.linspace(0, len(text) - WINDOW, PER_DOCUMENT).astype(int)]


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2,
        per_class: int = PER_CLASS, calibration: int = CALIBRATION) -> ToxicityModel:
    """Learn from the labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    sample = training_sample(docs, labels, "toxic", folds, held, per_class, calibration)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for y, text in zip(b["y"], b["text"], strict=True):
                for w in {w for part in windows(text) for w in words(part)}:
                    found[w][int(y)] += 1
            yield pd.DataFrame({"word": list(found), "c0": [c[0] for c in found.values()], "c1": [c[1] for c in found.values()]})

    # documents and windows are bounded, and with them the words on the driver
    vocabulary = (sample.where("part = 'fit'").select("y", "text")
                  .mapInPandas(count, "word string, c0 long, c1 long")
                  .groupBy("word").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).toArrow())
    found, c0, c1 = (vocabulary.column(c) for c in ("word", "c0", "c1"))
    c0, c1 = c0.to_numpy(), c1.to_numpy()
    if not c0.any() or not c1.any():
        return ToxicityModel(None, None)
    tables = spark.sparkContext.broadcast(ratio_tables(found.to_pylist(), c0, c1))
    del vocabulary, found, c0, c1
    shown = sample.where("part = 'calibrate'").select("y", _udf(tables)("text").alias("e")).toPandas()
    if len(shown) < 20:  # too few to calibrate with: the fitted documents serve
        shown = sample.select("y", _udf(tables)("text").alias("e")).toPandas()
    return ToxicityModel(tables, logistic(features(shown["e"].to_numpy()), shown["y"].to_numpy(float)))
