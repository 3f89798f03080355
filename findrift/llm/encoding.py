"""Encoding whole texts with a public byte-level BPE vocabulary.

The vocabulary comes as a file of ranks (base64 token, rank); its ids are those
of the same vocabulary's ``tokenizers`` file, which the tests hold them
against, at several times the speed.  That file also names the added tokens,
and encodes what the fast pattern matcher gives up on (a run of about a million
blanks).  Long texts are encoded in pieces cut where no token can lie across.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Characters encoded at a time, and those of a piece of a long text.
SLICE_CHARS, SEGMENT_CHARS = 8_000_000, 1_000_000

#: One blank between two other characters always starts a new word.
_SEAM = re.compile(r"(?<=\S) (?=\S)")


def segments(text: str, size: int = SEGMENT_CHARS) -> Iterator[str]:
    """The text in pieces of ``size`` characters and up to the next seam; all but the first start with a blank."""
    at = 0
    while len(text) - at > size and (seam := _SEAM.search(text, at + size)):
        yield text[at:seam.start()]
        at = seam.start()
    yield text[at:]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    Texts are split at the added tokens of the ``tokenizers`` file ``added``,
    which have ids of their own; with ``plain``, or without that file, their
    strings are ordinary text.
    """

    def __init__(self, path: str, pattern: str, added: str | None = None, plain: bool = False):
        import tiktoken
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        special = {}
        if added and not plain:
            with open(added, encoding="utf-8") as f:
                special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self._encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens=special)
        self._file, self._plain, self._slow = added, plain, None

    def ids(self, text: str) -> list[int]:
        """Ids of one piece of text."""
        try:
            return self._encoding.encode(text, allowed_special="all")
        except ValueError:  # the matcher's stack is too small for this text
            if self._file is None:
                raise
            if self._slow is None:
                from tokenizers import Tokenizer
                self._slow = Tokenizer.from_file(self._file)
                self._slow.encode_special_tokens = self._plain
            return self._slow.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[bytes]:
        return [b"".join(np.asarray(self.ids(s), "<u4").tobytes() for s in segments(t)) for t in texts]


def slices(values: pa.Array, other: Iterable) -> Iterator[tuple[list[str], list]]:
    """Texts (null: empty) with their companions, some SLICE_CHARS at a time."""
    texts, keys, size = [], [], 0
    for t, k in zip(values, other, strict=True):
        t = t.as_py() or ""
        texts.append(t)
        keys.append(k)
        size += len(t)
        if size >= SLICE_CHARS:
            yield texts, keys
            texts, keys, size = [], [], 0
    if texts:
        yield texts, keys
