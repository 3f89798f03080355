"""Small tables with everything awkward in them."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, cls string, length int, `group` string, score string, _n int"


def words(seed, n, base="the of and inea tion erwh there edon onnt hation shti lyre".split()):
    r = random.Random(seed)
    return " ".join(r.choice(base) + r.choice(["", "s", "er", "ly", "x", "q"]) for _ in range(n))


def rows():
    long = words(1, 30_000)
    texts = {1: words(2, 80), 2: words(3, 120), 3: None, 4: "", 5: "  \n\t ", 6: long, 7: "one", 8: "é ß 日本 🙂\x1c\x85 end",
             9: "x" * 200_000, 10: words(2, 80), 11: words(2, 80) + " tail"}
    out = [(i, t) for i, t in texts.items()] + [(None, words(9, 40)), (None, None), (2, texts[2]), (2, texts[2]), (2, "other text under the same id")]
    return [(i, t, None if i == 1 else "en", "s", None, "c", 1, "g", "0.9", 7) for i, t in out]


def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


def empty(spark):
    return docs(spark).where(F.lit(False))


def labels(spark, n=400):
    return spark.createDataFrame([(i, int(i % 5 != 0), int(i % 4 == 0)) for i in range(n)] + [(None, 1, 1), (7, None, None), (3, 1, 0)],
                                 "doc_id long, quality int, toxic int")


def labelled(spark, n=400):
    """Toxic where id % 4 == 0 (an odd word), poor where id % 5 == 0 (bars between words)."""
    def text(i):
        t = words(i, 60)
        if i % 4 == 0:
            t = t.replace(" ", f" {['moron', 'scumbag', 'trashy'][i % 3]} ", 3)
        return t.replace(" ", " | ") if i % 5 == 0 else t
    return spark.createDataFrame([(i, text(i), "en", "s", 1, "c", 1, "g", "0.9", 7) for i in range(n)], DOCS)
