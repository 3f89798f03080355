"""Alignment of two tokenizers against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from findrift.llm import alignment, encoding, queries

from . import messy

VOCABULARIES = (*queries.byte_bpe_added(), public_tokenizers.path("piece_bpe_32k.model"))


def byte_of_char():
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(VOCABULARIES[2])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=VOCABULARIES[3])
        self.chars = byte_of_char()

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, bytes(self.chars[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode())
             for i, p in ((i, self.b.id_to_piece(i)) for i in self.b.encode(text))]
        want = (" " + text).encode()
        return (a, b) if b"".join(x[1] for x in a) == want == b"".join(x[1] for x in b) else ([], [])


def spans(tokens):
    ends = np.cumsum([len(x[1]) for x in tokens]).tolist()
    return list(zip([0, *ends], ends))


def brute(rows):
    plain, per, count = Plain(), [], Counter()
    for key, text in rows:
        a, b = plain.tokens(text)
        sa, sb = spans(a), spans(b)
        links = [(a[i][0], b[j][0]) for i, (s, e) in enumerate(sa) for j, (t, f) in enumerate(sb) if s < f and t < e]
        count.update(links)
        common = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, start = [], 0
        for c in common:
            groups.append("|".join(",".join(str(x[0]) for x, (s, _) in zip(v, sp) if start <= s < c) for v, sp in ((a, sa), (b, sb))))
            start = c
        per.append((key, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return Counter((k, a, b, g, len(ls), sum(count[x] == top[x[1]] for x in ls), sum(count[x] for x in ls), h) for k, a, b, g, ls, h in per)


TEXTS = [(1, "Hello world, don't  stop\n\nnow  "), (2, " leading and trailing "), (3, None), (4, ""), (5, " "), (6, "a <|endoftext|> b <s> </s> <unk> <0x41>"),
         (7, "naïve ▁ mark"), (8, "日本語 🙂 \x00\x1c\x85 é́"), (9, "x" * 300), (10, "1234567 8.9e10\t\tif (a):\r\n    return"),
         (None, "no id at all"), (2, "the same id"), (2, "the same id"), (11, "　wide blank line"), (12, messy.words(5, 150))]


@pytest.mark.parametrize("shape", [{}, {"segment": 7, "chunk_chars": 60}])
def test_equals_brute_force(spark, shape):
    rows = [(*r, "en", "s", 1, "c", 2, "g", "0.1", 3) for r in TEXTS]
    got = alignment.align_documents(spark.createDataFrame(rows, messy.DOCS).repartition(2), VOCABULARIES, **shape)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == brute(TEXTS)


def test_messy_rows_and_empty_table(spark):
    got = alignment.align_documents(messy.docs(spark), VOCABULARIES).collect()
    assert len(got) == len(messy.rows())
    assert all((r["n_a"] > 0) == (r["groups_sha256"] != "") for r in got)
    assert alignment.align_documents(messy.empty(spark), VOCABULARIES).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 400), max_size=120), st.sets(st.integers(0, 400), max_size=300))
def test_gallop_is_a_lower_bound(x, y):
    short, long = np.array(sorted(x), np.int64), np.array(sorted(y), np.int64)
    assert alignment.gallop(short, long).tolist() == np.searchsorted(long, short).tolist()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n\t.1é日 '", max_size=80), st.integers(1, 12))
def test_pieces_give_the_ids_of_the_whole(text, size):
    plain, pair = _both()
    cut = list(encoding.segments(text, size))
    assert "".join(cut) == text
    one, two = pair.encode([(k == 0, s) for k, s in enumerate(cut)])
    assert sum(one, []) == plain.a.encode(" " + text, add_special_tokens=False).ids
    assert sum(two, []) == plain.b.encode(text)


_MADE = []


def _both():
    if not _MADE:
        _MADE.extend([Plain(), alignment.Pair(*VOCABULARIES)])
    return _MADE


def test_long_runs_are_linear_and_whole():
    r = random.Random(4)
    pair = _both()[1]
    text = " ".join(r.choice(["word", "x" * 40, "été"]) for _ in range(60_000))
    a, b = pair.encode([(True, text)])
    got = alignment.Aligned(np.cumsum(pair.a_size[a[0]]), np.cumsum(pair.b_size[b[0]]))
    assert got.a_common.sum() == got.b_common.sum() >= 60_000
    assert len(got.a) == len(a[0]) + len(b[0]) - got.a_common.sum()
