"""Benchmark decontamination by pigeonhole edit matching.

A test item may differ from a passage by a budget of k edits.  Cut into k + 1
pieces, at least one piece must then occur exactly; an Aho-Corasick automaton
finds all pieces in one pass over a document, and Myers' bit-parallel distance
decides at the places they point to.

Texts are compared in lower case with runs of anything but letters, digits and
``_`` read as one space, and with a space at either end, so that an item is
found as words and not inside of one.

Defined cases: items without a letter or digit match nothing; items of fewer
than SHORTEST characters, which ordinary text has by chance, match only a text
that is nothing else; null and empty texts hold no item; items with equal texts
are reported under each of their ids; repeated rows are judged each; an empty
benchmark flags nothing; an empty table gives an empty result; other columns do
not matter.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findrift.session import scratch_path

#: Edits allowed per character of an item, the shortest piece looked for, and the shortest item looked for in texts.
EDIT_RATE, MIN_PIECE, SHORTEST = 0.08, 10, 12
#: Characters of items in one automaton (some 60 bytes of memory each); larger benchmarks take several passes.
AUTOMATON_CHARS = 4_000_000
_OTHER = re.compile(r"[\W]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def budget(length: int) -> int:
    """Edits allowed for an item: its share of the length, as long as pieces stay long enough."""
    return max(0, min(int(length * EDIT_RATE), length // MIN_PIECE - 1))


def cut(item: str, edits: int) -> list[tuple[int, str]]:
    """(start, piece): edits + 1 pieces of nearly equal length."""
    n = edits + 1
    ends = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


class Pattern:
    """Myers' algorithm: the smallest edit distance of the item to any part of a text."""

    def __init__(self, item: str):
        self.m, self.mask, self.top = len(item), (1 << len(item)) - 1, 1 << (len(item) - 1)
        self.eq: dict[str, int] = defaultdict(int)
        for i, c in enumerate(item):
            self.eq[c] |= 1 << i
        self.eq = dict(self.eq)

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end of the first part of the text with it)."""
        mask, top, get = self.mask, self.top, self.eq.get
        up, down, score = mask, 0, self.m
        least, at = score, 0
        for i, c in enumerate(text, 1):
            eq = get(c, 0)
            x = eq | down
            h = (((eq & up) + up) ^ up) | eq
            hp = down | ~(h | up)
            hm = up & h
            if hp & top:
                score += 1
            elif hm & top:
                score -= 1
            hp <<= 1
            up = ((hm << 1) | ~(x | hp)) & mask
            down = hp & x & mask
            if score < least:
                least, at = score, i
        return least, at


class Matcher:
    def __init__(self, items: list[tuple[object, str]]):
        by_text = defaultdict(list)
        for item_id, text in items:
            if t := normal(text):
                by_text[t].append(item_id)
        self.short = {t: ids for t, ids in by_text.items() if len(t) < SHORTEST}
        self.items = [(f" {t} ", ids, budget(len(t))) for t, ids in sorted(by_text.items()) if len(t) >= SHORTEST]
        found = defaultdict(list)
        for n, (t, _, k) in enumerate(self.items):
            for start, piece in cut(t, k):
                found[piece].append((n, start))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()
        # items met lately, forwards and backwards
        self.pattern = lru_cache(2000)(lambda n, back: Pattern(self.items[n][0][::-1] if back else self.items[n][0]))

    def matches(self, text: str | None) -> Iterator[tuple[list, int, int, int]]:
        """(item ids, distance, start, end) in the normal text: each item's best match."""
        plain = normal(text)
        if not plain:
            return
        if ids := self.short.get(plain):
            yield ids, 0, 0, len(plain)
        if not self.items:
            return
        doc = f" {plain} "
        places: dict[int, set[int]] = defaultdict(set)
        for end, (size, where) in self.automaton.iter(doc):
            for n, start in where:
                places[n].add(end + 1 - size - start)  # where the item would begin
        for n, begins in places.items():
            t, ids, k = self.items[n]
            best = None
            # windows grow to hold the places nearby, so each stretch is tried once
            for first, last in stretches(sorted(begins), len(t)):
                a = max(0, first - k)
                d, at = self.pattern(n, False).best(doc[a:last + len(t) + k])
                if d <= k and (best is None or d < best[0]):
                    best = (d, a + at)
                if d == 0:
                    break
            if best:
                d, z = best
                _, back = self.pattern(n, True).best(doc[max(0, z - len(t) - k):z][::-1])
                # without the spaces put around both
                yield ids, d, min(z - back, len(plain)), min(max(z - 2, 0), len(plain))


def stretches(places: list[int], reach: int) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of sorted places within ``reach`` of their first."""
    i = 0
    while i < len(places):
        first = i
        while i < len(places) and places[i] <= places[first] + reach:
            i += 1
        yield places[first], places[i - 1]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Broadcast]:
    """Items in blocks whose size is checked before they are collected and broadcast."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    chars = items.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    blocks = -(-chars // AUTOMATON_CHARS)
    for b in range(blocks):
        block = [(r["i"], r["t"]) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()]
        yield benchmark.sparkSession.sparkContext.broadcast(block)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, distance,
    start and end of the match in the document's normal text."""
    schema = "doc_id long, item_id long, distance int, start long, end long"
    out = docs.sparkSession.createDataFrame([], schema)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    for items in _blocks(benchmark, item_col, item_text):
        def find(batches: Iterator[pd.DataFrame], items=items) -> Iterator[pd.DataFrame]:
            matcher = Matcher(items.value)
            for b in batches:
                found = [(doc, i, d, s, e) for doc, text in zip(b["doc_id"].astype("Int64"), b["text"], strict=True)
                         for ids, d, s, e in matcher.matches(text) for i in ids]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "distance", "start", "end"]).astype(
                    {"doc_id": "Int64", "item_id": "Int64", "distance": "int32", "start": "int64", "end": "int64"})
        out = out.unionAll(rows.mapInPandas(find, schema))
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                    item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts hold no item, judged row by row where they are.

    Each block of a large benchmark takes a pass of its own over what the blocks
    before it left, so that a worker holds one automaton at a time.
    """
    def test(items: Broadcast):
        @F.pandas_udf("boolean")
        def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            matcher = Matcher(items.value)
            for texts in batches:
                yield pd.Series([next(matcher.matches(t), None) is None for t in texts], dtype=bool)
        return clean

    for n, items in enumerate(_blocks(benchmark, item_col, item_text)):
        if n:
            path = scratch_path(docs.sparkSession, "clean")
            docs.write.parquet(path)
            docs = docs.sparkSession.read.parquet(path)
        docs = docs.where(test(items)(F.col(text_col)))
    return docs
