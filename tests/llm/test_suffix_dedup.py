"""Removal of repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from findrift.llm import queries
from findrift.llm import suffix_dedup as sd

from . import messy

SMALL = {"window": 12, "anchor": 4}
#: Shards of a few strips, slices of a few texts: anchors are dealt over several shards and merged.
TINY = {"shard_bytes": 300, "slice_bytes": 500, "bucket_bytes": 2000, "range_prints": 100}


def brute(rows, window):
    raw = [(i, (t or "").encode()) for i, t in rows]
    n = Counter(t[k:k + window] for _, t in raw for k in range(len(t) - window + 1))
    out = Counter()
    for i, t in raw:
        gone = bytearray(len(t))
        for k in range(len(t) - window + 1):
            if n[t[k:k + window]] > 1:
                gone[k:k + window] = b"\1" * window
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[i, len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()] += 1
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", 1, "c", 2, "g", "0.1", 3) for r in rows], messy.DOCS).repartition(3)


def corpus(seed, n=60, alphabet="ab c", size=40):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    passage = [word(r.randrange(8, 40)) for _ in range(4)]
    rows = [(i, word(r.randrange(size)) + r.choice([*passage, ""]) + word(r.randrange(size))) for i in range(n)]
    rows += [(100, None), (101, ""), (102, "a" * 300), (103, "ab" * 90 + "é" * 40), (104, "日本語🙂" * 9), (None, rows[0][1]), (None, None),
             (3, rows[3][1]), (3, rows[3][1]), (105, "a" * 12), (106, rows[5][1] + "tail"), (107, "xy" * 6)]
    return rows


@pytest.mark.parametrize("shape", [{}, TINY])
def test_equals_brute_force(spark, shape):
    rows = corpus(1)
    got = sd.remove_repeats(frame(spark, rows), **SMALL, **shape)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert Counter(map(tuple, got.collect())) == brute(rows, 12)


def test_common_passage_in_many_contexts_is_merged_across_shards(spark):
    r = random.Random(7)
    word = lambda k: "".join(r.choice("abcdefgh") for _ in range(k))
    hot = word(30)
    rows = [(i, word(25) + hot + word(25)) for i in range(200)] + [(500 + i, word(60)) for i in range(40)]
    got = sd.remove_repeats(frame(spark, rows), **SMALL, **TINY, with_text=True).collect()
    assert Counter(tuple(r)[:5] for r in got) == brute(rows, 12)
    for row in got:
        assert hashlib.sha256(row["kept"]).hexdigest() == row["kept_sha256"]


def test_production_window_on_messy_rows_and_empty_table(spark):
    rows = [(r[0], r[1]) for r in messy.rows()]
    text = messy.words(70, 200)
    rows += [(900, "start " + text[100:299]), (901, text[100:300] + " end"), (902, text)]
    got = sd.remove_repeats(frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == brute(rows, 200)
    assert sd.remove_repeats(messy.empty(spark)).count() == 0


def test_query_on_the_smallest_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries.op13_suffix_dedup(spark, "/root/testdata/sf0.001").collect())) == brute(rows, 200)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=80) | st.text("ab", max_size=200).map(str.encode) | st.integers(0, 700).map(lambda n: b"a" * n))
def test_suffix_array_and_common_prefixes(raw):
    data = np.frombuffer(raw, np.uint8)
    sa = sd.suffix_array(data)
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])

    def shared(a, b):
        return next((k for k, (x, y) in enumerate(zip(raw[a:], raw[b:])) if x != y), min(len(raw) - a, len(raw) - b))
    want = [0, *(min(30, shared(a, b)) for a, b in zip(sa, sa[1:]))][:len(raw)]
    assert sd.common_prefixes(data, sa, 30, 16).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=60).map(str.encode), max_size=5), st.integers(1, 5), st.integers(1, 9))
def test_strips_hold_each_window_once_and_name_it_by_content(texts, anchor, more):
    window = anchor + more
    names = {}
    for k, t in enumerate(texts):
        seen = []
        for key, number, start, n, times in sd.cut([*texts[:k], t], window, anchor):
            for a, s, m, c in zip(key[number == k], start[number == k], n[number == k], times[number == k]):
                assert 1 <= c <= m
                seen += range(s, s + m)
                for p in range(s, s + m):
                    assert names.setdefault(t[p:p + window], a) == a
        assert seen == list(range(max(len(t) - window + 1, 0)))


def test_long_texts_are_cut_into_parts(monkeypatch):
    monkeypatch.setattr(sd, "_LOW", sd.U((1 << 8) - 1))
    t = messy.words(3, 400).encode()
    got = [(s, s + n) for key, number, start, n, times in sd.cut([t], 20, 6) for s, n in zip(start.tolist(), n.tolist())]
    assert [p for a, z in got for p in range(a, z)] == list(range(len(t) - 19))


def test_merging_sorted_lists_finds_what_several_hold():
    r = random.Random(2)
    lists = [sorted({(r.randrange(40), r.randrange(3)) for _ in range(30)}) for _ in range(6)]
    packed = []
    for k, x in enumerate(lists):
        rec = np.zeros(len(x), sd._PRINT)
        rec["one"], rec["two"], rec["at"] = [p[0] for p in x], [p[1] for p in x], k
        packed.append(rec.tobytes())
    times = Counter(p for x in lists for p in x)
    assert [[(int(p["one"]), int(p["two"])) for p in rec] for rec in sd.merge_sorted(packed)] == [[p for p in x if times[p] > 1] for x in lists]
