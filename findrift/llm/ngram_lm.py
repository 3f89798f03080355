"""Scores of a smoothed n-gram model kept in Elias-Fano tries.

The model is a bigram model with absolute discounting, interpolated with a
discounted unigram model over the words met in training and one unknown word:

    P(w | v) = max(c(v w) - D, 0) / c(v) + B(v) P(w),   B(v) = D N(v .) / c(v)

N(v .) is the number of different successors of v.  Its size grows with the
corpus, so no machine holds it whole.  Documents are gathered in chunks; a
chunk sends each of its different words and word pairs once, with the count
among its training documents, to the shard that the pair's first word belongs
to.  A shard adds the counts up, builds its trie, looks up every pair asked
for, and answers each chunk, which then scores its documents.  Chunks aggregate
before the shuffle, so a frequent word or pair costs one entry a chunk; words
with a large share of all tokens are dealt over several shards by successor; the
numbers of successors that these count are added up, so scores do not depend on it.

Texts are cut at ASCII white space, A-Z lower-cased, and followed by one end
token.  Words are known by 64-bit hashes.

Defined cases: a null or empty text is its end token alone; a null id is not
held out; repeated rows count each; without training documents every word is
unknown and the scores are those of one unknown word; an empty table gives an
empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findrift.llm import shingles as sh
from findrift.llm.elias_fano import Trie
from findrift.llm.labelled import held_out
from findrift.session import scratch_path

U = np.uint64
START, END = U(0x5EED_0000_0000_0001), U(0x5EED_0000_0000_0002)
#: Bytes of text in a chunk, and tokens for which a shard is added; they bound a task's memory.
CHUNK_BYTES, SHARD_TOKENS = 14_000_000, 2_500_000
#: A word (or the start of a text) with this share of all tokens is dealt over as many shards as
#: its count needs, by the upper bits of its successors' hashes; sums over all words are taken in RANGES.
HEAVY, PART_BITS, RANGES = 1 / 512, 16, 64
DISCOUNT, WORD_DISCOUNT = 0.75, 0.5
#: Steps of a quantised value for each halving; values are rounded down, so no probability is overstated.
STEPS = 2048
_CHUNK = "chunk long, tokens binary, words binary, sizes binary, ids array<long>, out array<boolean>, n_tokens long, heavy array<struct<w:long,n:long>>"
_ASK = "shard int, chunk long, ctx binary, sub binary, n binary, k binary, succ binary, c binary"
_ANSWER = "chunk long, shard int, c binary, b binary, a binary, totals array<double>, successors array<struct<w:long,n:long>>"


def quantise(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities; 65535 stands for 0."""
    with np.errstate(divide="ignore"):
        return np.minimum(np.ceil(-np.log2(p) * STEPS - 1e-9), 65535).astype(np.uint16)


def restore(code: np.ndarray) -> np.ndarray:
    return np.where(code == 65535, 0.0, np.exp2(-code.astype(float) / STEPS))


# --------------------------------------------------------------------------- chunks
def _chunks(docs: DataFrame) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def row() -> pa.RecordBatch:
            words = np.concatenate([h[0] for h in held])
            counts = np.concatenate([h[1] for h in held]) + 1
            full = np.empty(len(words) + len(counts), U)
            ends = np.cumsum(counts) - 1
            full[ends] = END
            rest = np.ones(len(full), bool)
            rest[ends] = False
            full[rest] = words
            vocabulary, local, times = np.unique(full, return_inverse=True, return_counts=True)
            # frequent words get small numbers, which compress well
            order = np.argsort(-times, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            vocabulary, times, local = vocabulary[order], times[order], rank[local]
            many = np.flatnonzero(times >= HEAVY / 2 * len(full))
            cols = [pa.array([v]) for v in ((part << 32) + made,)]
            cols += [pa.array([b], pa.binary()) for b in (zstandard.compress(local.astype("<u4").tobytes(), 1), vocabulary.tobytes(), counts.astype("<u4").tobytes())]
            cols += [pa.array([[i for h in held for i in h[2]]], pa.list_(pa.int64())), pa.array([[o for h in held for o in h[3]]], pa.list_(pa.bool_())),
                     pa.array([len(full)], pa.int64()),
                     pa.array([[{"w": int(vocabulary[i].view(np.int64)), "n": int(times[i])} for i in many]
                               + [{"w": int(START), "n": len(counts)}]], pa.list_(pa.struct([("w", pa.int64()), ("n", pa.int64())])))]
            return pa.record_batch(cols, ["chunk", "tokens", "words", "sizes", "ids", "out", "n_tokens", "heavy"])

        for b in batches:
            for at, texts in sh.text_slices(b.column(1)):
                w, n = sh.word_hashes(texts, sh.SPACED_BYTES, fold=False)
                held.append((w, n, b.column(0).slice(at, len(texts)).to_pylist(), b.column(2).slice(at, len(texts)).to_pylist()))
                size += pc.sum(pc.binary_length(texts)).as_py() or 0
                if size >= CHUNK_BYTES:
                    yield row()
                    held, size, made = [], 0, made + 1
        if held:
            yield row()

    return docs.mapInArrow(build, _CHUNK)


class Chunk:
    """Different words and pairs of a chunk in the order they are asked for."""

    def __init__(self, tokens: bytes, words: bytes, sizes: bytes, out: list, shards: int, heavy: dict[int, int]):
        stored = np.frombuffer(words, U)
        order = np.argsort(stored)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.word = np.append(stored[order], START)  # in the order of their hashes
        local = place[np.frombuffer(zstandard.decompress(tokens), "<u4")]
        sizes = np.frombuffer(sizes, "<u4").astype(np.int64)
        self.local, self.starts = local, np.concatenate([[0], np.cumsum(sizes)[:-1]])
        trains = np.repeat(~np.array(out, bool), sizes)
        v = len(self.word)
        key = np.empty(len(local), np.int64)
        key[1:] = local[:-1]
        key[self.starts] = v - 1
        key *= v
        key += local
        pair, pair_of = np.unique(key, return_inverse=True)
        del key
        self.pair_of = pair_of.astype(np.int32)
        del pair_of
        self.first, self.second = (pair // v).astype(np.int32), (pair % v).astype(np.int32)
        self.pair_train = np.bincount(self.pair_of, trains, len(pair)).astype(np.uint32)
        del pair
        # a word's rows: one, or one for each part of a heavy word
        parts = np.ones(v, np.int64)
        for h, m in heavy.items():
            if (i := self.place(h)) is not None:
                parts[i] = m
        self.ctx = np.repeat(np.arange(v), parts)
        base = np.cumsum(parts) - parts
        self.sub = np.arange(len(self.ctx)) - np.repeat(base, parts)
        bits = (self.word[self.second] >> U(64 - PART_BITS)).astype(np.int64)
        row = (base[self.first] + ((bits * parts[self.first]) >> PART_BITS)).astype(np.int32)
        self.row = row
        n = np.bincount(local, trains, v)
        n[-1] = (~np.array(out, bool)).sum()
        self.n = n.astype(np.int64)[self.ctx]
        key = sh.mix(self.word[self.ctx] + self.sub.astype(U) * U(0x9E3779B97F4A7C15))
        shard = (((key >> U(32)) * U(shards)) >> U(32)).astype(np.int64)
        self.rows = np.lexsort((self.sub, self.ctx, shard))  # rows by shard
        self.row_shard = shard[self.rows]
        at = np.empty(len(self.rows), np.int32)
        at[self.rows] = np.arange(len(self.rows))
        at = at[row]
        self.pairs = np.argsort(at, kind="stable").astype(np.int32)  # pairs by shard and row
        self.pair_row = at[self.pairs]

    def place(self, h: int) -> int | None:
        """Number of a word (or of the start) in this chunk."""
        if U(h) == START:
            return len(self.word) - 1
        i = int(np.searchsorted(self.word[:-1], U(h)))
        return i if i < len(self.word) - 1 and self.word[i] == U(h) else None

    def asks(self) -> Iterator[tuple]:
        """(shard, word, part, count, pairs, second words, counts) for each shard."""
        heads = np.flatnonzero(np.diff(self.row_shard, prepend=-1))
        for a, z in zip(heads, np.append(heads[1:], len(self.rows)), strict=True):
            rows = self.rows[a:z]
            p, q = np.searchsorted(self.pair_row, (a, z))
            k = np.bincount(self.pair_row[p:q] - a, minlength=z - a)
            pairs = self.pairs[p:q]
            yield (int(self.row_shard[a]), self.word[self.ctx[rows]], self.sub[rows], self.n[rows], k,
                   self.word[self.second[pairs]], self.pair_train[pairs])


def _six(h: np.ndarray) -> bytes:
    """The upper 48 bits."""
    return np.ascontiguousarray((h >> U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1).astype(U)


def _ask(shards: int, heavy: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                chunk = Chunk(r["tokens"], r["words"], r["sizes"], r["out"], shards, heavy)
                for s, ctx, sub, n, k, succ, c in chunk.asks():
                    yield pa.record_batch([pa.array([s], pa.int32()), pa.array([r["chunk"]]),
                                           *(pa.array([x], pa.binary()) for x in (
                                               ctx.tobytes(), sub.astype("<u2").tobytes(), n.astype("<u4").tobytes(),
                                               k.astype("<u4").tobytes(), _six(succ), c.astype("<u4").tobytes()))],
                                          ["shard", "chunk", "ctx", "sub", "n", "k", "succ", "c"])
    return run


# --------------------------------------------------------------------------- shards
def freed(successors: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Codes of B(v); that of a word met in training is never the code of 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        b = np.where(total > 0, DISCOUNT * successors / total, 1.0)
    return np.minimum(quantise(b), 65534).astype(np.uint16)


def _answer(heavy: dict[int, int]):
    return lambda group: _answered(group, heavy)


def _answered(group: pa.Table, heavy: dict[int, int]) -> pa.Table:
    """Counts, trie and answers of one shard."""
    col = lambda name: [x.as_py() for x in group.column(name)]
    chunks, shard = col("chunk"), group.column("shard")[0].as_py()
    ctx, n, k = ([np.frombuffer(x, t) for x in col(c)] for c, t in (("ctx", U), ("n", "<u4"), ("k", "<u4")))
    sub = [np.frombuffer(x, "<u2") for x in col("sub")]
    rows, pairs = np.cumsum([0, *map(len, ctx)]), np.cumsum([0, *(int(x.sum()) for x in k)])
    word, part = np.concatenate(ctx), np.concatenate(sub)
    key = word + part.astype(U) * U(0x9E3779B97F4A7C15)  # a part of a heavy word is a context of its own in the trie
    asked = np.repeat(key, np.concatenate(k))
    succ = np.concatenate([_from_six(x) for x in col("succ")])
    count = np.concatenate([np.frombuffer(x, "<u4") for x in col("c")]).astype(np.int64)

    keys, first, of_row = np.unique(key, return_index=True, return_inverse=True)
    total = np.bincount(of_row, np.concatenate(n), len(keys))
    # n-grams met in training, each once
    seen = np.flatnonzero(count)
    order = seen[np.lexsort((succ[seen], asked[seen]))]
    new = np.ones(len(order), bool)
    new[1:] = (asked[order][1:] != asked[order][:-1]) | (succ[order][1:] != succ[order][:-1])
    heads = np.flatnonzero(new)
    c = np.add.reduceat(count[order], heads) if len(heads) else np.empty(0)
    g_ctx, g_word = asked[order[heads]], succ[order[heads]]
    owner = np.searchsorted(keys, g_ctx)
    a = quantise(np.maximum(c - DISCOUNT, 0) / total[owner]) if len(heads) else np.empty(0, np.uint16)
    kinds_of = np.bincount(owner, minlength=len(keys))
    trie = Trie(g_ctx, g_word, a)
    found, code = trie.find(asked, succ)
    code = np.where(found, code, np.uint16(65535))
    back = freed(kinds_of, total)  # for heavy words, the parts' numbers are added up first
    dealt = np.flatnonzero(np.isin(word[first], np.array(list(heavy), U)))
    parts = [{"w": int(word[first][i].view(np.int64)), "n": int(kinds_of[i])} for i in dealt]

    # a word's own totals are told by its first part; the start is no word
    own = np.flatnonzero((part[first] == 0) & (word[first] != START) & (total > 0))
    span = (word[first][own] >> U(58)).astype(np.int64)
    totals = np.concatenate([np.bincount(span, total[own], RANGES), np.bincount(span, minlength=RANGES)])
    out = [(ch, shard, total[of_row[r:s]].astype("<u8").tobytes(), back[of_row[r:s]].tobytes(), code[p:q].tobytes(), None, None)
           for ch, r, s, p, q in zip(chunks, rows, rows[1:], pairs, pairs[1:], strict=False)]
    out.append((-1, shard, b"", b"", b"", totals.tolist(), parts))
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()),
             pa.list_(pa.struct([("w", pa.int64()), ("n", pa.int64())]))]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                    names=["chunk", "shard", "c", "b", "a", "totals", "successors"])


# --------------------------------------------------------------------------- scores
def _score(shards: int, heavy: dict[int, int], by_range: np.ndarray, successors: dict[int, int]):
    counts, types = by_range
    n_all, v_all = counts.sum(), types.sum()
    base = lambda c: np.log10((c + 0.1) / (n_all + 0.1 * (v_all + 1)))
    spread = WORD_DISCOUNT * v_all / n_all if n_all else 1.0
    single = lambda c: (np.maximum(c - WORD_DISCOUNT, 0) / max(n_all, 1)) + spread / (v_all + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        answers = {r["shard"]: r for r in right.to_pylist()}
        for r in left.to_pylist():
            ch = Chunk(r["tokens"], r["words"], r["sizes"], r["out"], shards, heavy)
            told = [answers[s] for s in dict.fromkeys(ch.row_shard.tolist())]
            c, b, a = (np.concatenate([np.frombuffer(t[x], kind) for t in told]) for x, kind in (("c", "<u8"), ("b", np.uint16), ("a", np.uint16)))
            count, back = np.empty(len(ch.rows)), np.empty(len(ch.rows))
            count[ch.rows], back[ch.rows] = c, restore(b)
            seen = np.empty(len(ch.pairs))
            seen[ch.pairs] = restore(a)
            of_word = np.zeros(len(ch.word))
            of_word[ch.ctx] = count
            for w, kinds in successors.items():
                if (i := ch.place(w)) is not None:
                    here = ch.ctx == i
                    back[here] = restore(freed(np.array(kinds), count[here]))
            p = seen + back[ch.row] * single(of_word[ch.second])
            token_c = of_word[ch.local]
            each = [np.add.reduceat(x, ch.starts) for x in ((token_c > 0).astype(np.int64), base(token_c), np.log10(p)[ch.pair_of])]
            sizes = np.frombuffer(r["sizes"], "<u4").astype(np.int64)
            out.append(pa.table([pa.array(r["ids"], pa.int64()), pa.array(r["out"], pa.bool_()), pa.array(sizes), *map(pa.array, each)],
                                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]))
        if not out:
            out = [pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()),
                             "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})]
        return pa.concat_tables(out)
    return run


def score_documents(docs: DataFrame, folds: int = 10, held: int = 0, id_col: str = "doc_id", text_col: str = "text",
                    shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       held_out(F.col(id_col), folds, held).alias("out"))
    path = scratch_path(spark, "chunks")
    _chunks(rows).write.parquet(path)
    chunks = spark.read.parquet(path)
    n_tokens = chunks.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    shards = max(1, -(-n_tokens // shard_tokens))
    # at most 1 / HEAVY words can have that share
    many = (chunks.select(F.explode("heavy").alias("h")).groupBy("h.w").agg(F.sum("h.n").alias("n"))
            .where(F.col("n") >= HEAVY * n_tokens).collect())
    heavy = {}
    for r in many:
        parts = min(1 << PART_BITS, -(-r["n"] * shards // n_tokens))
        if parts > 1:
            heavy[r["w"] & 0xFFFF_FFFF_FFFF_FFFF] = int(parts)

    asked = chunks.select("chunk", "tokens", "words", "sizes", "out").mapInArrow(_ask(shards, heavy), _ASK)
    path = scratch_path(spark, "answers")
    # a number of tasks that follows the shards
    asked.repartition(shards, "shard").groupBy("shard").applyInArrow(_answer(heavy), _ANSWER).write.parquet(path)
    answers = spark.read.parquet(path)
    sums = (answers.where("chunk = -1").select(F.posexplode("totals").alias("i", "x"))
            .groupBy("i").agg(F.sum("x").alias("x")).collect())  # 2 x RANGES numbers
    by_range = np.zeros(2 * RANGES)
    for r in sums:
        by_range[r["i"]] = r["x"]
    by_range = by_range.reshape(2, RANGES)
    # one number for each heavy word
    successors = {r["w"] & 0xFFFF_FFFF_FFFF_FFFF: r["n"] for r in answers.where("chunk = -1").select(F.explode("successors").alias("s"))
                  .groupBy("s.w").agg(F.sum("s.n").alias("n")).collect()}
    scored = (chunks.select("chunk", "tokens", "words", "sizes", "ids", "out").groupBy("chunk")
              .cogroup(answers.where("chunk >= 0").select("chunk", "shard", "c", "b", "a").groupBy("chunk"))
              .applyInArrow(_score(shards, heavy, by_range, successors),
                            "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known",
                         F.lit(int(by_range[0].sum())).cast("long").alias("train_tokens"), "base_score", "score")
