"""Toxicity, quality, token counts, packing, language-model scores."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from findrift.llm import elias_fano, encoding, labelled, ngram_lm, packing, quality, queries, token_counts, toxicity

from . import messy

VOCABULARY = queries.byte_bpe()


def accuracy(scored, want):
    rows = [r for r in scored.collect() if r["held_out"]]
    return sum(r["predicted"] == want(r["doc_id"]) for r in rows) / len(rows)


def test_toxicity_held_out_accuracy_and_messy_rows(spark):
    docs = messy.labelled(spark)
    model = toxicity.fit(docs, messy.labels(spark))
    assert accuracy(queries._judged(docs, model, 4, 2), lambda i: int(i % 4 == 0)) > 0.95
    out = queries._judged(messy.docs(spark), model, 4, 2).collect()
    assert len(out) == len(messy.rows()) and all(0 <= r["score"] <= 1 for r in out)
    assert queries._judged(messy.empty(spark), model, 4, 2).count() == 0


def test_quality_held_out_accuracy_and_messy_rows(spark):
    docs = messy.labelled(spark)
    model = quality.fit(docs, messy.labels(spark), 5, 2)
    rows = queries._judged(docs, model, 5, 2)
    assert accuracy(rows, lambda i: int(i % 5 != 0)) > 0.95
    out = queries._judged(messy.docs(spark), model, 5, 0).collect()
    assert len(out) == len(messy.rows()) and all(0 <= r["score"] <= 1 for r in out)


def test_classifiers_without_labels_keep_everything(spark):
    docs, none = messy.docs(spark), messy.labels(spark).where("false")
    for m, score in ((toxicity, 0.0), (quality, 1.0)):
        assert {r[0] for r in docs.select(m.fit(docs, none).score(F.col("text"))).collect()} == {score}
        assert {r[0] for r in docs.select(m.fit(messy.empty(spark), messy.labels(spark)).score(F.col("text"))).collect()} == {score}


def test_training_sample_is_bounded_and_leaves_the_fold(spark):
    s = labelled.training_sample(messy.labelled(spark), messy.labels(spark), "toxic", 4, 2, 10, 15).collect()
    n = Counter((r["part"], r["y"]) for r in s)
    assert n["fit", 0] == n["fit", 1] == 10 and n["calibrate", 0] + n["calibrate", 1] == 15
    held = {r["text"] for r in messy.labelled(spark).where(labelled.held_out(F.col("doc_id"), 4, 2)).collect()}
    assert not held & {r["text"] for r in s}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_ids_are_those_of_the_tokenizers_file(texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    texts = [*texts, "a  b\n <|endoftext|> don't 12ab\t\t x"]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoding.Encoder(*VOCABULARY).encode(texts)] == want


def test_long_white_space_is_encoded_as_by_the_tokenizers_file():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = encoding.Encoder(*queries.byte_bpe_added())
    for text in (" " * 1_200_000, "\n" * 1_200_000 + "end", "a <|endoftext|> " + " \n\t" * 400_000 + "b c"):
        assert np.array_equal(np.frombuffer(enc.encode([text])[0], "<u4"), tok.encode(text, add_special_tokens=False).ids)


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab \n.1é\u00a0'<|>", max_size=80), st.integers(1, 12))
def test_pieces_of_a_text_have_its_ids(text, size):
    from tokenizers import Tokenizer
    text += " <|endoftext|> x<|endoftext|>y"
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = encoding.Encoder(*queries.byte_bpe_added())
    assert sum(map(enc.ids, encoding.segments(text, size)), []) == tok.encode(text, add_special_tokens=False).ids


def lengths():
    enc = encoding.Encoder(*VOCABULARY)
    return [len(enc.encode([r[1] or ""])[0]) // 4 for r in messy.rows()]


def test_histogram_answers_totals_quantiles_and_truncation(spark):
    n = lengths()
    sums = token_counts.with_suffix_sums(token_counts.length_histogram(messy.docs(spark), VOCABULARY)).cache()
    got = {r["n_tokens"]: r for r in sums.collect()}
    for length, times in Counter(n).items():
        r = got[length]
        assert (r["n_docs"], r["docs_over"], r["tokens_over"]) == (times, sum(x > length for x in n), sum(x for x in n if x > length))
        assert r["truncated_total"] == sum(min(x, length) for x in n)
    for limit in (0, 1, 10, 50, 1000, 10**6):
        assert tuple(token_counts.truncated_total(sums, limit).first()) == (len(n), sum(n), sum(min(x, limit) for x in n))
    assert token_counts.quantile(sums, 0.5).first()[0] == sorted(n)[math.ceil(len(n) / 2) - 1]
    assert token_counts.with_suffix_sums(token_counts.length_histogram(messy.empty(spark), VOCABULARY)).count() == 0


def test_packing_is_gapless_and_whole(spark):
    rows = packing.pack(messy.docs(spark), VOCABULARY, 256).collect()
    enc = encoding.Encoder(*VOCABULARY)
    want = Counter()
    for r in messy.rows():
        ids = np.append(np.frombuffer(enc.encode([r[1] or ""])[0], "<u4"), 0).astype("<u4")
        first = (len(ids) - 1) % 256 + 1
        cuts = [0, *range(first, len(ids) + 1, 256)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(messy.empty(spark), VOCABULARY, 256).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), max_size=12))
def test_plan_places_every_piece_once_and_stays_near_the_bound(counts):
    fill, seen = Counter(), Counter()
    runs = sorted(packing.plan(counts, 60))
    for (n, first, each, seq, offset), nxt in zip(runs, runs[1:] + [None]):
        end = nxt[1] if nxt and nxt[0] == n else counts[n]
        for i in range(first, end):
            s, k = divmod(i - first, each)
            seen[n] += 1
            fill[seq + s] += n
            assert offset + k * n + n <= 60
    assert seen == Counter(counts) and all(v <= 60 for v in fill.values())
    first_fit = []  # first-fit decreasing needs no fewer by more than a few
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        i = next((i for i, v in enumerate(first_fit) if v + n <= 60), None)
        if i is None:
            first_fit.append(n)
        else:
            first_fit[i] += n
    assert len(fill) <= len(first_fit) + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=80), st.lists(st.integers(0, (1 << 64) - 1), max_size=30))
def test_elias_fano_successor(values, asked):
    values = np.sort(np.array(values, np.uint64))
    asked = np.concatenate([np.array(asked, np.uint64), values, values + np.uint64(1)])
    at, same = elias_fano.EliasFano(values).successor(asked)
    want = np.searchsorted(values, asked)
    assert at.tolist() == want.tolist()
    assert same.tolist() == [bool(i < len(values) and values[i] == x) for i, x in zip(want, asked)]


def test_trie_finds_every_ngram_and_no_other():
    r = np.random.default_rng(4)
    pairs = np.unique(r.integers(0, 1 << 63, (3000, 1), dtype=np.uint64) % np.uint64(97) * np.uint64(1 << 40) + r.integers(0, 400, (3000, 1), dtype=np.uint64))
    c, w = pairs >> np.uint64(40), pairs % np.uint64(1 << 40)
    code = r.integers(0, 60000, len(c)).astype(np.uint16)
    t = elias_fano.Trie(c, w, code)
    ac, aw = np.repeat(np.arange(99, dtype=np.uint64), 402), np.tile(np.arange(402, dtype=np.uint64), 99)
    found, got = t.find(ac, aw)
    known = dict(zip(zip(c.tolist(), w.tolist()), code.tolist()))
    assert [(bool(f), int(g)) for f, g in zip(found, got)] == [((k in known), known.get(k, 0)) for k in zip(ac.tolist(), aw.tolist())]


def lm_by_hand(rows):
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"]
    out = [(i is not None and zlib.crc32(str(i).encode()) % 10 == 0, cut(t)) for i, t in rows]
    c, pairs, before, after = Counter(), Counter(), Counter(), Counter()
    for held, t in out:
        if not held:
            c.update(t)
            before.update(["<s>", *t[:-1]])
            pairs.update(zip(["<s>", *t[:-1]], t))
    after.update(v for v, _ in pairs)
    n, types = sum(c.values()), len(c)
    single = lambda w: max(c[w] - 0.5, 0) / n + 0.5 * types / n / (types + 1)

    def p(v, w):
        return (max(pairs[v, w] - 0.75, 0) + 0.75 * after[v] * single(w)) / before[v] if before[v] else single(w)
    return n, [(held, len(t), sum(c[w] > 0 for w in t), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (types + 1))) for w in t),
                sum(math.log10(p(v, w)) for v, w in zip(["<s>", *t[:-1]], t))) for held, t in out]


def test_lm_scores_match_brute_force(spark):
    rows = [(r[0], r[1]) for r in messy.rows()] + [(100 + i, messy.words(i, 200)) for i in range(60)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    n, want = lm_by_hand(rows)
    got = ngram_lm.score_documents(docs).collect()
    key = lambda x: (x[1], x[2], round(x[3], 4))
    got = sorted(((r["held_out"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got), key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-6 * (1 + abs(w[3]))
        assert abs(g[4] - w[4]) <= 3e-4 * w[1] + 1e-3
    assert ngram_lm.score_documents(docs.where("false")).count() == 0


def test_lm_deals_heavy_words_over_shards_and_stays_a_distribution(spark):
    r = random.Random(2)
    texts = [" ".join("the" if i % 2 else "w%d" % r.randrange(300) for i in range(400)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = {x["doc_id"]: x for x in ngram_lm.score_documents(docs).collect()}
    many = {x["doc_id"]: x for x in ngram_lm.score_documents(docs, shard_tokens=800).collect()}
    for i, x in one.items():
        assert (x["n_known"], x["train_tokens"]) == (many[i]["n_known"], many[i]["train_tokens"])
        assert abs(x["base_score"] - many[i]["base_score"]) < 1e-6
        assert abs(x["score"] - many[i]["score"]) < 0.02 * abs(x["score"])
    none = ngram_lm.score_documents(docs.where(labelled.held_out(F.col("doc_id"), 10, 0)))
    assert all(x["train_tokens"] == 0 and x["n_known"] == 0 and x["score"] <= 0 for x in none.collect())


def test_quantised_probabilities_never_grow():
    p = np.concatenate([10.0 ** -np.arange(0, 9.5, 0.013), [0.0]])
    back = ngram_lm.restore(ngram_lm.quantise(p))
    assert (back <= p * (1 + 1e-9)).all() and (back >= p * 0.9995).all()


def test_ids_of_added_tokens_are_those_of_the_tokenizer_at_its_defaults():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x  <|endoftext|>  \n y<|endoftext|", "don't 12ab\t\t x", ""]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(b, "<u4").tolist() for b in encoding.Encoder(*queries.byte_bpe_added()).encode(texts)]
    assert got == want and got[0] == [64, 220, 50256, 275]


def test_queries_encode_added_tokens(spark, tmp_path):
    spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r["n_tokens"] for r in queries.op4_token_counts(spark, str(tmp_path)).collect()] == [4]
    row, = queries.op10_packing(spark, str(tmp_path)).collect()
    assert (row["length"], row["ids_crc32"]) == (5, zlib.crc32(np.asarray([64, 220, 50256, 275, 0], "<u4").tobytes()))


def test_lm_scores_do_not_depend_on_the_size_of_shards(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    r = random.Random(3)  # in training one word always follows "hot"
    texts = {i: " ".join(("hot " + ("w%d" % r.randrange(50) if i in held else "same")) for _ in range(200)) + " w%d" % r.randrange(50) for i in range(200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    scores = [{x["doc_id"]: x["score"] for x in ngram_lm.score_documents(docs, shard_tokens=n).collect()} for n in (10**6, 4000)]
    assert all(math.isfinite(s) for s in scores[1].values())
    assert all(abs(s - scores[1][i]) < 1e-6 * abs(s) for i, s in scores[0].items())


def test_lm_deals_the_start_of_texts_like_a_heavy_word(spark):
    r = random.Random(5)
    texts = {i: " ".join("w%d" % r.randrange(90) for _ in range(r.randrange(3))) for i in range(600)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    scores = [{x["doc_id"]: (x["n_known"], x["score"]) for x in ngram_lm.score_documents(docs, shard_tokens=n).collect()} for n in (10**6, 20)]
    assert scores[0].keys() == scores[1].keys()
    assert all(n == scores[1][i][0] and abs(s - scores[1][i][1]) < 1e-6 * (1 + abs(s)) for i, (n, s) in scores[0].items())
    rows = [(x["doc_id"], x["text"]) for x in docs.collect()]
    _, want = lm_by_hand(rows)
    by_id = {i: w for (i, _), w in zip(rows, want)}
    assert all(abs(s - by_id[i][4]) <= 3e-4 * by_id[i][1] + 1e-3 for i, (_, s) in scores[1].items())


def test_training_sample_has_one_row_of_a_repeated_id(spark):
    docs, labels = messy.labelled(spark), messy.labels(spark)
    more = docs.where("doc_id in (1, 4, 9, 13)").crossJoin(spark.range(50).select(F.lit(1))).select(docs.columns)
    pick = lambda d: sorted(tuple(r) for r in labelled.training_sample(d, labels, "toxic", 4, 2, 400, 400).collect())
    assert pick(docs.unionAll(more)) == pick(docs)
    other = docs.where("doc_id = 1").withColumn("text", F.lit("another text of this id"))
    assert len(pick(docs.unionAll(other))) == len(pick(docs))


def test_quality_groups_hold_windows_only():
    text = "".join(chr(97 + i % 26) * quality.WINDOW for i in range(1000))
    got = quality.shown_windows(text)
    assert len(got) == quality.PER_DOCUMENT and sum(map(len, got)) == quality.PER_DOCUMENT * quality.WINDOW
    assert quality.shown_windows("short") == [b"short"] and quality.shown_windows(None) == []
