"""Quality by compression with dictionaries of good and bad text.

Two zstandard dictionaries are built from labelled text.  A text is cut into
windows, and each is compressed with both; the difference of the two sizes over
the text's length says which class it resembles, the smaller size over the
length how much it repeats itself.  A logistic fit turns both into a
probability that the text is good.

Defined cases: null and empty texts compress to nothing and get the score of
two equal sizes; without labels of both classes every score is 1; repeated rows
score alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findrift.llm.labelled import logistic, probability, training_sample

#: Bounds of the training sample: documents of each class, documents for
#: calibration, windows taken of one document (evenly spaced).
PER_CLASS, CALIBRATION, PER_DOCUMENT = 4000, 6000, 16
WINDOW, DICTIONARY, LEVEL = 1024, 112_640, 3


def windows(text: str | None) -> list[bytes]:
    b = (text or "").encode()
    return [b[i:i + WINDOW] for i in range(0, len(b), WINDOW)]


def shown_windows(text: str | None) -> list[bytes]:
    """At most PER_DOCUMENT windows of a text, evenly spaced."""
    w = windows(text)
    return [w[i * len(w) // PER_DOCUMENT] for i in range(PER_DOCUMENT)] if len(w) > PER_DOCUMENT else w


def train(documents: list[list[bytes]], size: int = DICTIONARY) -> bytes:
    """A dictionary of documents' windows; the raw windows themselves where they are too few to train one."""
    taken = [w for d in sorted(documents) for w in d]
    order = np.random.default_rng(7).permutation(len(taken))
    taken = [taken[i] for i in order]
    try:
        return zstandard.train_dictionary(size, taken).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(taken)[-size:]


class Compressors:
    def __init__(self, bad: bytes, good: bytes):
        self._two = []
        for raw in (bad, good):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self._two.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False,
                                                      write_checksum=False, write_dict_id=False))

    def features(self, text: str | None) -> tuple[float, float]:
        """(size with the bad dictionary - with the good one) / length; log of the smaller size / length."""
        parts = windows(text)
        if not parts:
            return 0.0, 0.0
        n = sum(map(len, parts))
        bad, good = (sum(len(c.compress(p)) for p in parts) for c in self._two)
        return (bad - good) / n, float(np.log(min(bad, good) / n))


@dataclass
class QualityModel:
    dictionaries: tuple[bytes, bytes] | None
    weights: np.ndarray | None

    def score(self, text: Column) -> Column:
        """Probability that a text is of good quality."""
        if self.dictionaries is None:
            return F.lit(1.0)
        return _udf(self.dictionaries, self.weights)(text)


def _udf(dictionaries, weights=None):
    keep: list[Compressors] = []

    @F.pandas_udf("double" if weights is not None else "array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not keep:
            keep.append(Compressors(*dictionaries))
        for texts in batches:
            x = np.array([keep[0].features(t) for t in texts], float).reshape(-1, 2)
            yield pd.Series(list(x)) if weights is None else pd.Series(probability(x, weights))
    return run


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0,
        per_class: int = PER_CLASS, calibration: int = CALIBRATION) -> QualityModel:
    """Learn from the labelled documents outside the held-out fold."""
    sample = training_sample(docs, labels, "quality", folds, held, per_class, calibration)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "w": [shown_windows(t) for t in b["text"]]})

    def build(key: tuple, shown: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"y": [int(key[0])], "d": [train([[bytes(w) for w in d] for d in shown["w"]])]})

    # one group a class, at most `per_class` documents of PER_DOCUMENT windows each
    made = {r["y"]: bytes(r["d"]) for r in sample.where("part = 'fit'").select("y", "text")
            .mapInPandas(cut, "y int, w array<binary>").groupBy("y").applyInPandas(build, "y int, d binary").collect()}
    if not made.get(0) or not made.get(1):
        return QualityModel(None, None)
    pair = (made[0], made[1])
    shown = sample.where("part = 'calibrate'").select("y", _udf(pair)("text").alias("x")).toPandas()
    if len(shown) < 20:  # too few to calibrate with: the fitted documents serve
        shown = sample.select("y", _udf(pair)("text").alias("x")).toPandas()
    return QualityModel(pair, logistic(np.array(list(shown["x"]), float).reshape(-1, 2), shown["y"].to_numpy(float)))
