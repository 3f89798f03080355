"""Kneser-Ney tables of toxicity against a calculation by hand."""

import math
import random
from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from findrift.llm import queries, toxicity

from . import messy


def grams_by_hand(word):
    """The n-gram of the longest order that ends in each character, and in the word's end."""
    w = f"\x02{word}\x03"
    for i in range(1, len(w)):
        yield w[max(0, i - toxicity.ORDER + 1):i + 1]


def tables_by_hand(counts):
    """Log-likelihood ratios (toxic over ordinary) of n-grams and of contexts,
    from (word, ordinary documents, toxic documents that hold it)."""
    own: tuple[dict[str, int], dict[str, int]] = ({}, {})  # by n-gram of the longest order
    for word, *by_class in counts:
        for gram in grams_by_hand(word):
            for k in (0, 1):
                if by_class[k]:
                    own[k][gram] = own[k].get(gram, 0) + by_class[k]
    # shared model: left continuations of every shorter n-gram, with the sum and
    # the number of kinds of each context
    seen: dict[str, int] = defaultdict(int)
    for gram in own[0].keys() | own[1].keys():
        for n in range(1, len(gram)):
            seen[gram[n:]] += 1
    mass: dict[str, int] = defaultdict(int)
    kinds: dict[str, int] = defaultdict(int)
    for gram, c in seen.items():
        mass[gram[:-1]] += c
        kinds[gram[:-1]] += 1

    @lru_cache(maxsize=200_000)
    def shared(gram: str) -> float:
        ctx = gram[:-1]
        below = shared(gram[1:]) if ctx else 1 / 1000
        total = mass.get(ctx)
        if not total:
            return below
        return (max(seen.get(gram, 0) - toxicity.SHARED_DISCOUNT, 0) + toxicity.SHARED_DISCOUNT * kinds[ctx] * below) / total

    cut = lambda c: toxicity.DISCOUNTS[min(c, 3) - 1]
    total: tuple[dict[str, int], dict[str, int]] = (defaultdict(int), defaultdict(int))
    freed: tuple[dict[str, float], dict[str, float]] = (defaultdict(float), defaultdict(float))
    for k in (0, 1):
        for gram, c in own[k].items():
            total[k][gram[:-1]] += c
            freed[k][gram[:-1]] += cut(c)
    back = lambda k, ctx: freed[k][ctx] / total[k][ctx] if ctx in total[k] else 1.0
    of_context = {ctx: math.log(back(1, ctx) / back(0, ctx)) for ctx in total[0].keys() | total[1].keys()}

    def p(k: int, gram: str) -> float:
        c, ctx = own[k].get(gram, 0), gram[:-1]
        return ((c - cut(c)) / total[k][ctx] if c else 0.0) + back(k, ctx) * shared(gram[1:])

    of_gram = {gram: math.log(p(1, gram) / p(0, gram)) for gram in own[0].keys() | own[1].keys()}
    return of_gram, of_context


def evidence_by_hand(of_gram, of_context, text):
    found = sorted(toxicity.words(text))
    ratio = lambda w: sum(of_gram.get(g, of_context.get(g[:-1], 0.0)) for g in grams_by_hand(w))
    return sum(max(0.0, ratio(w) - toxicity.MARGIN) for w in found) / max(1, len(found)) ** toxicity.LENGTH_POWER


def tables(counts):
    return toxicity.ratio_tables([c[0] for c in counts], np.array([c[1] for c in counts]), np.array([c[2] for c in counts]))


def some_counts(seed, n=400):
    r = random.Random(seed)
    found = {"".join(r.choice("abcdé日_7") for _ in range(r.randrange(1, 12))) for _ in range(n)}
    return [(w, r.randrange(6), r.randrange(6)) for w in sorted(found)]


def test_every_ratio_is_that_of_a_calculation_by_hand():
    counts = [c for c in some_counts(1) if c[1] or c[2]]
    of_gram, of_context = tables_by_hand(counts)
    s = toxicity.Scorer(*tables(counts))
    found = [c[0] for c in counts] + [c[0] for c in some_counts(2)] + ["a", "\U0001f642", "zzzzzzzzzzzz" * 9]
    want = [sum(of_gram.get(g, of_context.get(g[:-1], 0.0)) for g in grams_by_hand(w)) for w in found]
    assert np.allclose(s.ratios(found), want, atol=1e-9)
    texts = [" ".join(random.Random(i).sample(found, 30)) for i in range(150)] + [None, "", " .,"]
    assert np.allclose(s.evidence(texts), [evidence_by_hand(of_gram, of_context, t) for t in texts], atol=1e-9)


def test_ratio_is_small_where_classes_agree():
    s = toxicity.Scorer(*tables([("same", 5, 5), ("bad", 0, 9), ("good", 9, 0)]))
    bad, good, same = s.ratios(["bad", "good", "same"])
    assert bad > 1 and good < -1 and abs(same) < 0.2
    assert s.evidence([None, "", " .,"]) == [0, 0, 0]


def test_words_beyond_the_cache_are_scored_alike(monkeypatch):
    counts = [c for c in some_counts(3) if c[1] or c[2]]
    texts = [" ".join(random.Random(i).sample([c[0] for c in counts], 40)) for i in range(300)]
    want = toxicity.Scorer(*tables(counts)).evidence(texts)
    monkeypatch.setattr(toxicity, "_CACHE", 5)
    assert toxicity.Scorer(*tables(counts)).evidence(texts) == want


def test_long_documents_are_fitted_by_windows():
    text = "".join(chr(97 + i % 26) for i in range(toxicity.PER_DOCUMENT * toxicity.WINDOW + 1))
    parts = toxicity.windows(text)
    assert len(parts) == toxicity.PER_DOCUMENT and {len(p) for p in parts} == {toxicity.WINDOW}
    assert parts[0] == text[:toxicity.WINDOW] and parts[-1] == text[-toxicity.WINDOW:] and toxicity.windows("short") == ["short"]


def test_scores_of_the_query_are_those_of_the_tables(spark):
    docs = messy.labelled(spark)
    model = toxicity.fit(docs, messy.labels(spark))
    e = toxicity.Scorer(*model.tables.value).evidence([r["text"] for r in docs.orderBy("doc_id").collect()])
    want = toxicity.probability(toxicity.features(np.array(e)), model.weights)
    got = queries._judged(docs, model, 4, 2).orderBy("doc_id").select(F.col("score")).collect()
    assert np.allclose([r[0] for r in got], want)
