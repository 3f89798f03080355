"""Nearest neighbours, near duplicates, benchmark decontamination."""

import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from findrift.llm import decontamination, near_duplicates, nearest
from findrift.llm import shingles as sh

from . import messy


def brute(vectors, queries, k):
    out = []
    for q, x in queries:
        c = sorted(((-sum(float(a) * float(b) for a, b in zip(x, y)), i) for i, y in vectors if i != q and len(y) == len(x)))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(c[:k], 1)]
    return sorted(out)


def test_nearest_matches_brute_force_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(0)
    good = [(i, [float(np.float32(v)) for v in rng.normal(size=8)]) for i in range(300)]
    good += [(1000 + i, good[3][1]) for i in range(40)]  # many copies: ties go to smaller ids
    bad = [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [1.0] * 7 + [float("nan")]), (2004, [1.0] * 7 + [None]),
           (2005, [float("inf")] * 8), (None, [9.0] * 8), (2006, [5.0] * 3), (5, good[5][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in good + bad], "vec_id long, embedding array<float>, score string")
    out = nearest.nearest(df, df.where("vec_id % 20 = 0"), 5, query_block=8, row_block=64)
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out.collect())
    want = brute(good + [(2006, [5.0] * 3)], [(i, v) for i, v in good if i % 20 == 0], 5)
    assert [f[:3] for f in found] == [w[:3] for w in want]
    assert all(abs(f[3] - w[3]) < 1e-12 for f, w in zip(found, want))


def test_nearest_of_empty_and_tiny_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert nearest.nearest(df.where("vec_id > 5"), df, 3).count() == 0
    assert [tuple(r)[:3] for r in nearest.nearest(df, df.where("vec_id = 0"), 3).collect()] == [(0, 1, 1)]


def test_int8_bounds_hold():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 16)), rng.normal(size=(60, 16)) * 100
    (qc, qs, qn, qe), (rc, rs, _, re_) = nearest.quantise(x), nearest.quantise(y)
    near = (qc.astype(float) @ rc.T.astype(float)) * qs[:, None] * rs
    assert (np.abs(near - x @ y.T) <= np.outer(qe, np.linalg.norm(y, axis=1)) + np.outer(qn, re_) + 1e-9).all()


def shingle_sets(texts):
    word = lambda t: re.findall(r"\w+", (t or "").lower())
    return [frozenset(tuple(w[j:j + 5]) for j in range(len(w) - 4)) for w in map(word, texts)]


def near_corpus():
    base = [messy.words(i, 90) for i in range(40)]
    out = list(base)
    r = random.Random(5)
    for t in base[:12]:  # copies with one or two words changed
        w = t.split()
        for _ in range(r.randint(1, 2)):
            w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    hot = messy.words(99, 400).split()
    for i in range(60):  # one large group of copies that all differ
        w = list(hot)
        w[r.randrange(400)] = f"edit{i}"
        out.append(" ".join(w))
    return out + [base[0]] * 5 + [base[30][:200] + " " + messy.words(77, 200)] + ["", None, "too short", "too short"]


def test_near_duplicates_match_brute_force(spark):
    texts = near_corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, cls string, label int")
    got = {r["doc_id"]: r for r in near_duplicates.grouped(df).collect()}
    sets, parent = shingle_sets(texts), list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(range(len(texts)), 2):
        same = (texts[a] or "") == (texts[b] or "")
        if same or (sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {i: r["group_id"] for i, r in got.items()} == {i: find(i) for i in range(len(texts))}
    assert all(r["is_kept"] == (r["group_id"] == i) for i, r in got.items())


def test_one_of_each_group_keeps_columns_and_one_row(spark):
    out = near_duplicates.one_of_each_group(messy.docs(spark))
    assert out.columns == messy.docs(spark).columns
    kept = [(r["doc_id"], (r["text"] or "")[:20]) for r in out.collect()]
    assert sorted(k[0] for k in kept if k[0] is not None) == [1, 2, 2, 3, 5, 6, 7, 8, 9]
    assert sum(k[0] is None for k in kept) == 1
    assert near_duplicates.one_of_each_group(messy.empty(spark)).count() == 0


def test_samples_agree_as_often_as_texts_are_similar():
    r, tables, agreed, true = np.random.default_rng(3), near_duplicates.sample_tables(), [], []
    for _ in range(100):
        h, level = r.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2), r.integers(0, 12, 400)
        pick = [np.arange(350), np.concatenate([np.sort(r.choice(350, 300, replace=False)), np.arange(350, 400)])]
        owner = np.repeat([0, 1], [len(p) for p in pick])
        s = near_duplicates.draw(np.concatenate([h[p] for p in pick]), np.concatenate([level[p] for p in pick]), owner, 2, tables)
        w = np.exp(near_duplicates.GRID * level)
        agreed.append((s[0] == s[1]).mean())
        true.append(w[np.intersect1d(*pick)].sum() / w[np.union1d(*pick)].sum())
    assert abs(np.mean(agreed) - np.mean(true)) < 0.02


@settings(max_examples=60, deadline=None)
@given(st.text("ab cd", max_size=24), st.text("ab cd", max_size=60))
def test_myers_matches_dynamic_programming(item, text):
    if not item:
        return
    col = list(range(len(item) + 1))
    best = col[-1]
    for c in text:
        new = [0]
        for i, d in enumerate(item, 1):
            new.append(min(col[i] + 1, new[-1] + 1, col[i - 1] + (c != d)))
        col = new
        best = min(best, col[-1])
    assert decontamination.Pattern(item).best(text)[0] == best


def test_contamination_finds_edited_items_only(spark):
    items = [(1, messy.words(500, 30)), (2, "Short item, ten!"), (3, None), (4, "..."), (None, messy.words(501, 30)), (6, messy.words(500, 30))]
    edited = items[0][1].replace("the", "thx", 1).upper().replace(" ", "\n", 3)
    texts = [messy.words(1, 50) + " " + items[0][1] + " " + messy.words(2, 20), edited, messy.words(3, 500), "", None,
             "xx short ITEM  ten yy", items[4][1][: len(items[4][1]) // 2]]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)] + [(None, texts[1], 9)], "doc_id long, text string, distance int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["item_id"], r["distance"] == 0) for r in decontamination.contamination(docs, bench).collect())
    assert found == [(-1, 1, False), (-1, 6, False), (0, 1, True), (0, 6, True), (1, 1, False), (1, 6, False), (5, 2, True)]
    assert sorted(r["doc_id"] for r in decontamination.clean_documents(docs, bench).collect()) == [2, 3, 4, 6]
    none = bench.where("false")
    assert decontamination.contamination(docs, none).count() == 0
    assert decontamination.clean_documents(docs, none).count() == 8
    assert decontamination.contamination(docs.where("false"), bench).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_contamination_within_the_budget_is_never_missed(seed):
    r = random.Random(seed)
    item = messy.words(seed, 12)
    t = list(decontamination.normal(item))
    for _ in range(decontamination.budget(len(t))):
        i = r.randrange(len(t))
        kind = r.randrange(3)
        if kind == 0:
            t[i] = "z"
        elif kind == 1 and len(t) > 5:
            del t[i]
        else:
            t.insert(i, "z")
    doc = messy.words(seed + 1, 20) + " " + "".join(t) + " " + messy.words(seed + 2, 20)
    assert list(decontamination.Matcher([(1, item)]).matches(doc))


def test_items_are_words_and_short_ones_whole_texts(spark):
    find = lambda items, text: [(ids, d, s, e) for ids, d, s, e in decontamination.Matcher(items).matches(text)]
    short = [(1, "yes"), (2, "B"), (3, "Yes!")]
    assert find(short, "eyesight about") == [] == find(short, "oh yes b")
    assert find(short, " yes. ") == [([1, 3], 0, 0, 3)] and find(short, "b") == [([2], 0, 0, 1)]
    longer = [(1, "cat sat on it")]
    assert find(longer, "A cat sat on it.") == [([1], 0, 2, 15)] and find(longer, "concat sat on items") == []
    docs = spark.createDataFrame([(1, "eyesight about"), (2, "yes")], "doc_id string, text string")
    bench = spark.createDataFrame([("1", "yes"), ("2", "B")], "item_id string, text string")
    assert [tuple(r) for r in decontamination.contamination(docs, bench).collect()] == [(2, 1, 0, 0, 3)]


def distance_anywhere(item, text):
    """Least edit distance of the item to any part of the text, by a table of all windows."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def test_every_window_of_every_text_is_decided_right(spark):
    r = random.Random(8)
    words = [messy.words(900 + i, 1) for i in range(12)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, say(r.randrange(3, 9))) for i in range(25)]

    def damaged(t):
        t = list(t)
        for _ in range(r.randrange(6)):
            t[r.randrange(len(t))] = r.choice("xyz ")
        return "".join(t)
    texts = [(i, f"{say(r.randrange(6))} {damaged(r.choice(items)[1])} {say(r.randrange(6))}") for i in range(60)]
    want = set()
    for d, text in texts:
        for i, item in items:
            t = decontamination.normal(item)
            if len(t) >= decontamination.SHORTEST:
                least = distance_anywhere(f" {t} ", f" {decontamination.normal(text)} ")
                if least <= decontamination.budget(len(t)):
                    want.add((d, i, least))
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(x["doc_id"], x["item_id"], x["distance"]) for x in decontamination.contamination(docs, bench).collect()}
    assert found == want and len(want) > 20
    assert {x["doc_id"] for x in decontamination.clean_documents(docs, bench).collect()} == {d for d, _ in texts} - {d for d, _, _ in want}


def test_large_benchmarks_take_several_passes(spark, monkeypatch):
    items = [(i, messy.words(3000 + i, 20)) for i in range(40)]
    texts = [(i, messy.words(i, 20) + " " + (items[i][1] if i % 3 == 0 else "") + " " + messy.words(i + 99, 10)) for i in range(40)]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "AUTOMATON_CHARS", 1000)
    assert len(list(decontamination._blocks(bench, "item_id", "text"))) > 3
    assert sorted(r["doc_id"] for r in decontamination.contamination(docs, bench).collect()) == list(range(0, 40, 3))
    assert sorted(r["doc_id"] for r in decontamination.clean_documents(docs, bench).collect()) == [i for i in range(40) if i % 3]


def test_a_text_that_repeats_a_piece_is_read_in_linear_time():
    import time
    item = messy.words(77, 30)
    t = f" {decontamination.normal(item)} "
    piece = decontamination.cut(t, decontamination.budget(len(t) - 2))[3][1]
    m, took = decontamination.Matcher([(1, item)]), []
    for n in (4_000, 16_000):
        text = " ".join(f"{piece.strip()} {messy.words(i % 50, 12)}" for i in range(n))
        start = time.perf_counter()
        list(m.matches(text))
        took.append(time.perf_counter() - start)
    assert took[1] < 8 * took[0] + 0.5  # four times the text
    places = sorted({random.Random(1).randrange(10**6) for _ in range(5000)})
    runs = list(decontamination.stretches(places, 300))
    assert all(z - a <= 300 for a, z in runs) and all(z < a for (_, z), (a, _) in zip(runs, runs[1:]))


def test_connections_join_the_same_groups_as_all_pairs(monkeypatch):
    monkeypatch.setattr(near_duplicates, "AGREE", 0.0)
    monkeypatch.setattr(near_duplicates, "TRIED", 3)
    r = np.random.default_rng(12)
    for _ in range(30):
        n = 40
        base = [np.sort(r.choice(10**6, 60, replace=False)).astype(np.uint64) for _ in range(3)]
        sets = []
        for i in range(n):
            b = base[i % 3]
            drop = r.integers(0, 14)
            sets.append(np.unique(np.concatenate([r.choice(b, len(b) - drop, replace=False), r.choice(10**6, drop).astype(np.uint64) + np.uint64(10**7)])))
        features = [(s, r.choice([1.0, 1.5, 2.0], len(s))) for s in sets]
        cls, group = np.arange(n) * 10, np.where(np.arange(n) % 3 == 0, 0, np.arange(n) * 10)  # one group joined before
        group[(np.arange(n) % 3 == 0)] = 0
        stray = group != 0
        sig = np.zeros((n, 2 * near_duplicates.SAMPLES), np.int32)
        links = list(near_duplicates.connect(cls, group, np.flatnonzero(stray), np.arange(n), stray, sig, features))

        def closure(pairs, group=group):
            up = {int(g): int(g) for g in group}

            def root(x):
                while up[x] != x:
                    x = up[x]
                return x
            for a, b in pairs:
                up[max(root(a), root(b))] = min(root(a), root(b))
            return [root(int(g)) for g in group]
        at = {int(c): int(g) for c, g in zip(cls, group)}
        every = []
        for i in np.flatnonzero(stray):
            w, plain = near_duplicates.similarities(*features[i], features)
            for j in range(n):
                inside = np.intersect1d(sets[i], sets[j])
                assert abs(plain[j] - len(inside) / len(np.union1d(sets[i], sets[j]))) < 1e-12
                if max(w[j], plain[j]) >= near_duplicates.THRESHOLD:
                    every.append((int(group[i]), int(group[j])))
        assert closure(every) == closure([(at[a], at[b]) for a, b, *_ in links])
        assert len(links) <= len(set(group.tolist())) - 1


def test_agreement_counts_weighted_or_plain_samples():
    r = np.random.default_rng(5)
    a, b = (r.integers(0, 3, (n, 2 * near_duplicates.SAMPLES)) for n in (90, 70))
    k = near_duplicates.SAMPLES
    want = np.array([[max((x[:k] == y[:k]).sum(), (x[k:] == y[k:]).sum()) for y in b] for x in a])
    assert (near_duplicates.agreement(a, b) == want).all() and (near_duplicates.agreement(a[:9], b[:9]) == want[:9, :9]).all()


def test_blocks_of_a_hub_give_the_groups_of_one_task(spark, monkeypatch):
    texts = near_corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r["doc_id"]: r["group_id"] for r in near_duplicates.grouped(df).collect()}
    monkeypatch.setattr(near_duplicates, "BLOCK", 7)
    assert {r["doc_id"]: r["group_id"] for r in near_duplicates.grouped(df).collect()} == whole


def test_word_hashes_follow_the_words():
    import pyarrow as pa
    texts = ["One two  one.", None, "", "…", "ÉTÉ été", "end", "two"]
    h, n = sh.word_hashes(pa.array(texts))
    assert n.tolist() == [3, 0, 0, 1, 2, 1, 1]
    assert h[0] == h[2] and h[4] == h[5] and h[1] == h[7] and len(set(h.tolist())) == 5


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6])
def test_short_texts_have_few_shingles(n):
    import pyarrow as pa
    h, owner = sh.shingle_hashes(*sh.word_hashes(pa.array([messy.words(1, n), messy.words(2, 7)])), 5)
    assert (owner == 0).sum() == max(0, n - 4) and (owner == 1).sum() == 3


@pytest.mark.parametrize("fold", [True, False])
def test_word_hashes_of_slices_are_those_of_the_whole(fold):
    import pyarrow as pa
    texts = pa.array([messy.words(i, 30).title() + ("\n" if i % 2 else "") for i in range(50)] + [None, "", "x" * 500])
    h, n = sh.word_hashes(texts, sh.SPACED_BYTES, fold)
    parts = [sh.word_hashes(p, sh.SPACED_BYTES, fold) for _, p in sh.text_slices(texts, 400)]
    assert len(parts) > 5 and np.concatenate([p[0] for p in parts]).tolist() == h.tolist()
    assert np.concatenate([p[1] for p in parts]).tolist() == n.tolist() == [len((t.as_py() or "").split()) for t in texts]


def test_samples_of_unrelated_long_texts_differ():
    r, tables = np.random.default_rng(8), near_duplicates.sample_tables()
    base = np.sort(r.integers(0, 1 << 63, 200_000, dtype=np.uint64) * np.uint64(2))
    near = np.sort(np.append(base[4_000:], r.integers(0, 1 << 63, 4_000, dtype=np.uint64) * np.uint64(2)))
    far = np.sort(r.integers(0, 1 << 63, 200_000, dtype=np.uint64) * np.uint64(2))
    sets = [base, near, far]
    owner = np.repeat([0, 1, 2], [len(x) for x in sets])
    s = near_duplicates.draw(np.concatenate(sets), np.full(len(owner), 3), owner, 3, tables)
    assert (s[0] == s[2]).sum() == 0 and (s[0] == s[1]).mean() > 0.85


def test_long_near_copies_are_found_among_unrelated_long_texts(spark):
    base = ["w%d" % i for i in range(400_000)]
    texts = []
    for i in range(4):
        w = random.Random(i).choices(base, k=200_000)
        texts.append(" ".join(w))
        w[::1000] = ["edit"] * 200
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x["group_id"] for x in near_duplicates.grouped(df).collect()}
    assert got == {i: i // 2 * 2 for i in range(8)}


def test_a_large_group_that_hangs_together_by_a_rare_hub(spark):
    base = ["b%d" % i for i in range(204)]  # 200 shingles

    def copy(i, edits):  # one edit changes five shingles
        w, r = list(base), random.Random(i)
        for p in r.sample(range(5, 199, 6), edits):
            w[p] = f"x{i}e{p}"
        return " ".join(w)
    texts = [copy(i, 1 if i % 100 == 50 else 3) for i in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, left, todo = shingle_sets(texts), set(range(1, 1500)), [0]
    while todo:  # brute force: what is connected to the first text
        x = todo.pop()
        near = {y for y in left if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])}
        left -= near
        todo += near
    got = near_duplicates.grouped(df).collect()
    assert not left and {r["group_id"] for r in got} == {0}


def test_a_text_and_its_repeated_copy_are_near_duplicates(spark):
    texts = [t for i in range(12) for t in (messy.words(i, 150), " ".join([messy.words(i, 150)] * (3 if i % 2 else 30)))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in near_duplicates.grouped(df).collect()}
    assert got == {i: i // 2 * 2 for i in range(24)}
