"""Near duplicates by consistent weighted sampling.

Documents are sets of five-word shingles weighted by TF-IDF.  Equal texts are
one class.  Each class draws SAMPLES consistent weighted samples, two classes
agreeing on one with the probability of their weighted Jaccard similarity;
bands of samples propose pairs, the samples discard most wrong ones, and the
weighted Jaccard similarity of the whole texts decides.  As many samples without
weights propose and discard pairs likewise.  Linked classes form groups.

Weights: ``(1 + ln tf) * idf`` on a logarithmic grid, with
``idf = 1 + IDF_SHARE * ln(n / df) / ln(n)``, so passages that many documents
share count less, but never so little that copies of one much-copied text come
apart.  A pair whose shingle sets alone reach the threshold counts too.  ``df``
comes from counters by hash over all documents (a table of fixed size).

A bucket of n classes proposes n - 1 pairs, each class with the smallest.  Where
its classes are then in several groups, those outside its largest group (its
hub) are compared with all members of the hub's buckets, in blocks of bounded
size: samples first, then the whole shingle sets, in the task where they meet.
A task passes on only the links that connect groups, so rows grow with the
classes, while every two classes of a bucket that any chain of links does not
connect have been compared.

Defined cases: null and empty texts are one class; texts of fewer than five
words match equal texts only; repeated rows belong to their class; a row with a
null id is in its group, which a row with an id represents if there is one; an
empty table gives an empty result; columns of other names do not matter.
Classes are told apart by a 64-bit hash of the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findrift.llm import shingles as sh
from findrift.session import scratch_path

SHINGLE, THRESHOLD = 5, 0.8
#: Bands of ROWS samples: a pair at the threshold is missed with probability 3e-5.
BANDS, ROWS = 20, 4
SAMPLES = BANDS * ROWS
#: Share of samples that a proposed pair must agree on (five deviations below the threshold).
AGREE = 0.55
IDF_SHARE = 0.5
#: Classes of a block, bytes of their shingles, and how many a class is compared with first.
BLOCK, BLOCK_BYTES, TRIED = 1024, 8_000_000, 32
#: Counters of document frequencies, and the parts they are summed in.
COUNTERS, PARTS = 1 << 20, 64
#: Grid of ln(weight), and levels on it (weights up to 30).
GRID, LEVELS = 0.125, 28
#: Bits of the table that keeps other texts out of the verification's shuffle.
_BITS = 1 << 25
#: Bytes of text that are drawn for at a time, so that their units stay in the cache.
_DRAWN = 400_000
_LEVEL_HASH = np.arange(LEVELS, dtype=sh.U) * sh.U(0xD6E8FEB86659FD93)


# --------------------------------------------------------------------------- document frequencies
def _frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequency of every hash slot, and the number of documents."""
    part = COUNTERS // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(COUNTERS, np.int64), 0
        for b in batches:
            for _, texts in sh.text_slices(b.column(0)):
                h, owner = sh.shingle_hashes(*sh.word_hashes(texts), SHINGLE)
                h, _, _ = sh.unique_in_text(h, owner)
                total += np.bincount((h >> sh.U(64 - 20)).astype(np.int64), minlength=COUNTERS)
                n += len(texts)
        if n:
            yield pa.record_batch([pa.array([*range(PARTS), -1], pa.int32()),
                                   pa.array([*(total[i * part:(i + 1) * part].astype("<i8").tobytes() for i in range(PARTS)),
                                             np.array([n], "<i8").tobytes()], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[p] = sums.get(p, 0) + np.frombuffer(c, "<i8")
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
                              ["part", "counts"])

    schema = "part int, counts binary"
    # parts stream through their task and are added one by one
    rows = docs.mapInArrow(count, schema).repartition(PARTS, "part").mapInArrow(add, schema).collect()
    found = {r["part"]: np.frombuffer(r["counts"], "<i8") for r in rows}  # COUNTERS numbers, whatever the input
    zero = np.zeros(part, np.int64)
    return np.concatenate([found.get(i, zero) for i in range(PARTS)]), int(found[-1][0]) if -1 in found else 0


def idf_grid(df: np.ndarray, n: int) -> np.ndarray:
    """ln(idf) of every slot; a slot's mean load stands for collisions and is taken off."""
    own = np.maximum(1.0, df - df.sum() / COUNTERS)
    return np.log(1 + IDF_SHARE * np.clip(np.log(max(n, 2) / own) / math.log(max(n, 2)), 0, 1)).astype(np.float32)


def weighted_shingles(texts: pa.Array, log_idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, level, text number) of the distinct shingles; weight exp(GRID * level)."""
    h, owner = sh.shingle_hashes(*sh.word_hashes(texts), SHINGLE)
    h, owner, times = sh.unique_in_text(h, owner)
    log_w = np.log1p(np.log(times)) + log_idf[(h >> sh.U(64 - 20)).astype(np.int64)]
    return h, np.minimum(np.rint(log_w / GRID), LEVELS - 1).astype(np.int64), owner


# --------------------------------------------------------------------------- consistent weighted samples
def sample_tables() -> tuple[np.ndarray, np.ndarray]:
    """What each level adds to the weight of the one below it, and a multiplier for each sample."""
    rng = np.random.default_rng(71)
    return (np.diff(np.exp(GRID * np.arange(LEVELS)), prepend=0.0),
            rng.integers(0, 1 << 63, SAMPLES, dtype=sh.U) * sh.U(2) + sh.U(1))


def draw(h: np.ndarray, level: np.ndarray, owner: np.ndarray, n: int, tables) -> np.ndarray:
    """Weighted samples (n x SAMPLES) of n texts."""
    return draw_both(h, level, owner, n, tables)[0]


def draw_both(h: np.ndarray, level: np.ndarray, owner: np.ndarray, n: int, tables) -> tuple[np.ndarray, np.ndarray]:
    """Weighted and plain samples (n x SAMPLES) of n texts; those without shingles stay all ones.

    A shingle of level l stands for the units (shingle, 0) to (shingle, l), unit
    i with the weight that level i adds.  Each unit draws an exponential time
    from a 64-bit hash of its own, at the rate of its weight, and the first one
    is the sample: texts agree on it with the probability of their weighted
    Jaccard similarity, and on equal units only, however long they are.  Units
    of one level have one rate, so the largest hash is the first of them.  Every
    shingle has one unit of level 0; the first of these is the plain sample.
    """
    step, multipliers = tables
    out, plain = (np.full((n, SAMPLES), np.iinfo(np.uint32).max, np.uint32) for _ in range(2))
    if not len(h):
        return out, plain
    units, starts, rows, rates, size = [], [], [], [], 0
    for i in range(int(level.max()) + 1):
        at = np.flatnonzero(level >= i)
        first = np.flatnonzero(np.diff(owner[at], prepend=-1))
        units.append(sh.mix(h[at] + _LEVEL_HASH[i]))
        starts.append(first + size)
        rows.append(owner[at][first])
        rates.append(np.full(len(first), step[i]))
        size += len(at)
    unit, start, row, rate = (np.concatenate(x) for x in (units, starts, rows, rates))
    top, hashed = np.empty((SAMPLES, len(start)), sh.U), np.empty_like(unit)
    for k, m in enumerate(multipliers):
        np.maximum.reduceat(np.multiply(unit, m, out=hashed), start, out=top[k])
    plain[rows[0]] = _folded(top[:, :len(rows[0])]).T
    by_text = np.argsort(row, kind="stable")
    top, row = top[:, by_text], row[by_text]
    time = -np.log(((top >> sh.U(11)).astype(float) + 0.5) * 2.0 ** -53) / rate[by_text]
    heads = np.flatnonzero(np.diff(row, prepend=-1))
    soonest = np.repeat(np.minimum.reduceat(time, heads, axis=1), np.diff(np.append(heads, len(row))), axis=1)
    taken = np.maximum.reduceat(np.where(time == soonest, top, sh.U(0)), heads, axis=1)
    out[row[heads]] = _folded(taken).T
    return out, plain


def _folded(unit: np.ndarray) -> np.ndarray:
    """32 bits of a unit's hash, not all ones."""
    return np.minimum(sh.mix(unit) >> sh.U(32), sh.U(0xFFFF_FFFE)).astype(np.uint32)


def band_keys(samples: np.ndarray, first: int = 1) -> np.ndarray:
    """Keys of the bands, which count from ``first``."""
    h = np.zeros((len(samples), BANDS), sh.U)
    for r in range(ROWS):
        h = h * sh.U(0x9E3779B97F4A7C15) + samples[:, r::ROWS][:, :BANDS] + sh.U(1)
    return sh.mix(h + np.arange(first, first + BANDS, dtype=sh.U) * sh.U(0xD6E8FEB86659FD93)).view(np.int64)


def _signatures(docs: DataFrame, log_idf) -> DataFrame:
    """cls, keys, sig of every text with shingles; the weighted bands and samples, then the plain ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sample_tables()
        for b in batches:
            for at, texts in sh.text_slices(b.column(1), _DRAWN):
                s, plain = draw_both(*weighted_shingles(texts, log_idf.value), len(texts), tables)
                have = np.flatnonzero(s[:, 0] != np.iinfo(np.uint32).max)
                s, plain = s[have], plain[have]
                keys = np.hstack([band_keys(s), band_keys(plain, BANDS + 1)])
                s = np.hstack([s, plain])
                listed = lambda x, n: pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), n)
                yield pa.record_batch([b.column(0).slice(at, len(texts)).take(pa.array(have)),
                                       listed(keys, 2 * BANDS).cast(pa.list_(pa.int64())),
                                       listed(s.view(np.int32), 2 * SAMPLES).cast(pa.list_(pa.int32()))], ["cls", "keys", "sig"])
    return docs.mapInArrow(run, "cls long, keys array<long>, sig array<int>")


# --------------------------------------------------------------------------- pairs
def _shared(sigs: DataFrame) -> DataFrame:
    """key, cls, n, head of the classes in buckets of two or more."""
    entries = sigs.select("cls", F.explode("keys").alias("key"))
    buckets = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("cls").alias("head")).where("n > 1")
    return entries.join(buckets, "key")


def _stars(shared: DataFrame, sigs: DataFrame) -> DataFrame:
    """a < b: each class with the smallest of its buckets, where they agree on enough samples."""
    pairs = shared.where("head < cls").select(F.col("head").alias("a"), F.col("cls").alias("b")).distinct()
    left, right = (sigs.select(F.col("cls").alias(c), F.col("sig").alias(f"s{c}")) for c in "ab")
    same = F.greatest(*(F.expr(f"aggregate(zip_with(slice(sa, {at}, {SAMPLES}), slice(sb, {at}, {SAMPLES}), (x, y) -> IF(x = y, 1, 0)), 0, (s, x) -> s + x)")
                        for at in (1, SAMPLES + 1)))  # weighted or plain
    return pairs.join(left, "a").join(right, "b").where(same >= AGREE * SAMPLES).select("a", "b")


def _open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """hub, cls, group, stray: members of buckets whose classes are in several groups.

    The largest group of a bucket is its hub; buckets of one hub are taken
    together, so a class that shares many of them is there once."""
    here = (shared.where("n > 2").select("key", "cls").join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left")
            .select("key", "cls", F.coalesce("label", "cls").alias("group")))
    hubs = (here.groupBy("key", "group").agg(F.count("*").alias("n")).groupBy("key")
            .agg(F.max(F.struct("n", "group")).alias("top"), F.count("*").alias("groups")).where("groups > 1")
            .select("key", F.col("top.group").alias("hub")))
    return (here.join(hubs, "key").select("hub", "cls", "group").distinct()
            .withColumn("stray", F.col("group") != F.col("hub")))


def agreement(sa: np.ndarray, sb: np.ndarray) -> np.ndarray:
    """Samples on which rows of ``sa`` and ``sb`` agree, weighted or plain ones, whichever are more."""
    if len(sa) * len(sb) <= 4096:
        same = sa[:, None, :] == sb[None, :, :]
        return np.maximum(same[..., :SAMPLES].sum(axis=2), same[..., SAMPLES:].sum(axis=2))
    same = np.zeros((2, len(sa), len(sb)), np.int16)
    for k, (x, y) in enumerate(zip(sa.T, sb.T, strict=True)):
        same[k // SAMPLES] += x[:, None] == y
    return same.max(axis=0)


def similarities(h: np.ndarray, w: np.ndarray, others: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Weighted and plain Jaccard similarity of a sorted shingle set to each of several (none of them empty)."""
    sizes = np.array([len(o[0]) for o in others])
    hb, wb = (np.concatenate([o[k] for o in others]) for k in (0, 1))
    at = np.minimum(np.searchsorted(h, hb), len(h) - 1)
    match = h[at] == hb
    first = np.cumsum(sizes) - sizes
    both = np.add.reduceat(np.where(match, np.minimum(w[at], wb), 0.0), first)
    n = np.add.reduceat(match.astype(np.int64), first)
    return both / (w.sum() + np.add.reduceat(wb, first) - both), n / (len(h) + sizes - n)


def connect(cls: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray, stray: np.ndarray, sig: np.ndarray,
            features: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, float, float]]:
    """(a, b, weighted, plain): similar pairs of a left and a right class, enough of
    them to connect every two groups that any pair of theirs connects.

    Each class tries those that agree with it on enough samples, best first, until
    the groups left have no untried one.  A pair of strays is tried from the smaller."""
    _, joined = np.unique(group, return_inverse=True)  # a number for each group, equal once they are connected
    for at in range(0, len(left), BLOCK):
        part = left[at:at + BLOCK]
        same = agreement(sig[part], sig[right])
        fits = (same >= AGREE * SAMPLES) & (group[part][:, None] != group[right]) & (~stray[right] | (cls[part][:, None] < cls[right]))
        for row in np.flatnonzero(fits.any(axis=1)):
            i, most = part[row], TRIED
            todo = right[fits[row]]
            todo = todo[np.argsort(-same[row][fits[row]], kind="stable")]
            todo = todo[joined[todo] != joined[i]]
            while len(todo):
                now, todo = todo[:most], todo[most:]
                most = min(8 * most, BLOCK)
                w, plain = similarities(*features[i], [features[j] for j in now])
                for k in np.flatnonzero(np.maximum(w, plain) >= THRESHOLD):
                    if joined[now[k]] != joined[i]:
                        joined[joined == joined[now[k]]] = joined[i]
                        a, b = sorted((int(cls[i]), int(cls[now[k]])))
                        yield a, b, float(w[k]), float(plain[k])
                todo = todo[joined[todo] != joined[i]]


_MEMBER = "hub long, i int, j int, side int, cls long, `group` long, stray boolean, sig array<int>, h binary, l binary"


def _connections(open_: DataFrame, sigs: DataFrame, features: DataFrame) -> DataFrame:
    """a, b, weighted, plain: links between groups whose classes share buckets.

    The strays of a hub meet all its members, block by block of bounded rows and
    bytes; what meets is compared where it is, and only links leave the task."""
    member = open_.join(sigs.select("cls", "sig"), "cls").join(features, "cls")
    size = F.octet_length("h").cast("long")
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
    # counted on narrow rows
    counted = (open_.join(features.select("cls", size.alias("size")), "cls").groupBy("hub")
               .agg(F.count_if("stray").alias("na"), F.count("*").alias("nb"), F.sum(F.when(F.col("stray"), F.col("size"))).alias("sa"), F.sum("size").alias("sb"))
               .select("hub", blocks(F.col("na"), F.col("sa")).alias("na"), blocks(F.col("nb"), F.col("sb")).alias("nb")))
    member = member.join(counted, "hub")
    deal = lambda salt, n: F.pmod(F.xxhash64("cls", F.lit(salt)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = ["cls", "group", "stray", "sig", "h", "l"]
    one = (F.col("na") == 1) & (F.col("nb") == 1)
    whole = member.where(one).select("hub", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), *rest)
    left = member.where(~one & F.col("stray")).select("hub", deal(1, F.col("na")).alias("i"), every("nb").alias("j"), F.lit(1).alias("side"), *rest)
    right = member.where(~one).select("hub", every("na").alias("i"), deal(2, F.col("nb")).alias("j"), F.lit(2).alias("side"), *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.exp(GRID * np.arange(256))

        def links(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows)
            cls, group, side = (t.column(c).to_numpy() for c in ("cls", "group", "side"))
            stray = t.column("stray").to_numpy(zero_copy_only=False)
            sig = t.column("sig").combine_chunks().flatten().to_numpy().reshape(len(cls), -1)
            features = [(np.frombuffer(h, sh.U), weight[np.frombuffer(x, np.uint8)])
                        for h, x in zip(t.column("h").to_pylist(), t.column("l").to_pylist(), strict=True)]
            found = list(connect(cls, group, np.flatnonzero(stray & (side != 2)), np.flatnonzero(side != 1), stray, sig, features))
            return pa.record_batch([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))],
                                   names=["a", "b", "weighted", "plain"])

        key, held = None, []
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("hub", "i", "j")])
            heads = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))) if b.num_rows else []
            for a, z in zip(heads, np.append(heads[1:], b.num_rows).astype(int) if len(heads) else [], strict=True):
                here = tuple(keys[:, a].tolist())
                if here != key and held:
                    yield links(held)
                    held = []
                key = here
                held.append(b.slice(a, z - a))
        if held:
            yield links(held)

    return (whole.unionAll(left).unionAll(right).repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
            .mapInArrow(run, "a long, b long, weighted double, plain double"))


def weighted_jaccard(ha: np.ndarray, la: np.ndarray, hb: np.ndarray, lb: np.ndarray) -> tuple[float, float]:
    """Weighted and plain Jaccard similarity of two sorted shingle sets."""
    weight = np.exp(GRID * np.arange(256))
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    both = np.minimum(weight[la[i]], weight[lb[j]]).sum()
    total = weight[la].sum() + weight[lb].sum() - both
    union = len(ha) + len(hb) - len(i)
    return (float(both / total) if union else 1.0), (len(i) / union if union else 1.0)


def _features(docs: DataFrame, wanted: DataFrame, log_idf) -> DataFrame:
    """cls, h, l: sorted shingles and their levels of the classes in ``wanted`` (cls, each once), stored."""
    # which slots of a fixed table of bits these classes use; other texts are kept
    # out of the shuffle by it
    spark = docs.sparkSession
    slot = F.pmod(F.col("cls"), F.lit(_BITS))
    bits = (wanted.select(F.bitmap_bucket_number(slot).alias("_bucket"), F.bitmap_bit_position(slot).alias("_p"))
            .groupBy("_bucket").agg(F.bitmap_construct_agg("_p").alias("_bits")))
    near = (docs.withColumn("_bucket", F.bitmap_bucket_number(slot)).withColumn("_p", F.bitmap_bit_position(slot))
            .join(F.broadcast(bits), "_bucket")  # at most _BITS / 8 bytes = 4 MB
            .where(F.expr("shiftright(ascii(decode(substring(_bits, cast(_p div 8 as int) + 1, 1), 'ISO-8859-1')), cast(_p % 8 as int)) % 2 = 1")))
    # an inner join: a semi join would be moved below the table of bits, before the shuffle it spares
    texts = near.select("cls", "text").join(wanted, "cls").dropDuplicates(["cls"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in sh.text_slices(b.column(1)):
                h, level, owner = weighted_shingles(part, log_idf.value)
                ends = np.searchsorted(owner, np.arange(len(part) + 1))
                cut = [slice(ends[i], ends[i + 1]) for i in range(len(part))]
                yield pa.record_batch([b.column(0).slice(at, len(part)),
                                       pa.array([h[s].tobytes() for s in cut], pa.binary()),
                                       pa.array([level[s].astype(np.uint8).tobytes() for s in cut], pa.binary())], ["cls", "h", "l"])

    path = scratch_path(spark, "features")
    texts.mapInArrow(features, "cls long, h binary, l binary").write.parquet(path)
    return spark.read.parquet(path)


def _links(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs that are similar, with both similarities."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(n) for n in b.schema.names}
            keep, sims = [], []
            for i in range(b.num_rows):
                ha, hb = (np.frombuffer(cols[c][i].as_py(), sh.U) for c in ("ha", "hb"))
                la, lb = (np.frombuffer(cols[c][i].as_py(), np.uint8) for c in ("la", "lb"))
                w, plain = weighted_jaccard(ha, la, hb, lb)
                if max(w, plain) >= THRESHOLD:
                    keep.append(i)
                    sims.append((w, plain))
            at = pa.array(keep, pa.int64())
            yield pa.record_batch([cols["a"].take(at), cols["b"].take(at), pa.array([s[0] for s in sims], pa.float64()),
                                   pa.array([s[1] for s in sims], pa.float64())], ["a", "b", "weighted", "plain"])

    both = pairs
    for c in "ab":
        both = both.join(known.select(F.col("cls").alias(c), F.col("h").alias(f"h{c}"), F.col("l").alias(f"l{c}")), c)
    return both.select("a", "b", "ha", "la", "hb", "lb").mapInArrow(verify, "a long, b long, weighted double, plain double")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that each node of ``edges`` (a, b) is connected to.

    Every round takes the smallest label among a node and its neighbours, then
    that label's own label; each round's table is written to the shared folder.
    """
    def kept(df, name):
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    both = kept(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        new = kept(step.join(jump, "to").select("node", F.col("label").alias("old"), F.least("to", "far").alias("label")), "labels")
        moved = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels


def _linked(rows: DataFrame, sigs: DataFrame, log_idf) -> DataFrame:
    """The label of every linked class."""
    spark = rows.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    shared = kept(_shared(sigs), "shared")
    pairs = kept(_stars(shared, sigs), "pairs")
    wanted = pairs.select(F.col("a").alias("cls")).unionAll(pairs.select("b")).distinct()
    links = kept(_links(pairs, _features(rows, wanted, log_idf)).select("a", "b"), "links")
    labels = components(spark, links)
    open_ = kept(_open(shared, labels), "open")
    if open_.isEmpty():
        return labels
    features = _features(rows, open_.select("cls").distinct(), log_idf)
    more = kept(_connections(open_, sigs, features).select("a", "b"), "links")
    return components(spark, links.unionAll(more)) if not more.isEmpty() else labels


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, class_id (smallest id with an equal text), group_id
    (smallest id of the group), cls and group (their hashes), is_kept (the row
    that stands for its group)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("cls"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df, n = _frequencies(rows.select("text"))
    log_idf = spark.sparkContext.broadcast(idf_grid(df, n))  # COUNTERS numbers
    path = scratch_path(spark, "signatures")
    _signatures(rows.select("cls", "text"), log_idf).dropDuplicates(["cls"]).write.parquet(path)
    classes = _linked(rows, spark.read.parquet(path), log_idf).withColumnRenamed("node", "cls")

    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("cls").alias("cls")))
    by_class = (rows.groupBy("cls").agg(first.alias("first")).join(classes, "cls", "left")
                .withColumn("group", F.coalesce("label", "cls")))
    path = scratch_path(spark, "classes")
    by_class.select("cls", "first", "group").write.parquet(path)
    by_class = spark.read.parquet(path)
    of_group = by_class.groupBy("group").agg(F.min("first").alias("head"))
    table = by_class.join(of_group, "group")
    return (rows.select("doc_id", "cls").join(table, "cls")
            .select("doc_id", F.col("first.id").alias("class_id"), F.col("head.id").alias("group_id"),
                    "cls", "group",
                    ((F.col("cls") == F.col("head.cls")) & F.col("doc_id").eqNullSafe(F.col("head.id"))).alias("is_kept")))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near duplicates: of each group the row of the
    smallest id stays, one of them where that row is repeated."""
    cls = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    kept = (grouped(docs, id_col, text_col).where("is_kept").groupBy(F.col("cls").alias("_c"), F.col("doc_id").alias("_i"))
            .agg(F.count("*").alias("_n")))
    here = lambda t: (cls == t["_c"]) & docs[id_col].eqNullSafe(t["_i"])
    once, more = kept.where("_n = 1"), kept.where("_n > 1")
    single = docs.join(once, here(once), "left_semi")
    every = F.struct(*docs.columns)
    repeated = (docs.join(more, here(more), "left_semi").groupBy(docs[id_col], cls)
                .agg(F.min_by(every, F.to_json(every)).alias("_row")).select("_row.*"))
    return single.unionAll(repeated)
