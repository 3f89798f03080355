"""Sections of answers against the answers' format as one backtracking pattern."""

import random
import re
import time

from pyspark.sql import functions as F

from findrift.operators import prompts as P

STRICT = re.compile(r"(?sa)1\. Vulnerability Description\s*[:：]?\s*(.*?)\s*2\. Potential Risk\s*[:：]?\s*(.*?)\s*3\. Recommended Fix\s*[:：]?\s*(.*?)\s*"
                    r"(?:4\. Final Modified Code.*?\s*)?5\. Additional Notes\s*[:：]?\s*(.*)")
NUMBERED = re.compile(r"(?sia)1\.\s*Vulnerability Description\s*[:：]?\s*(.*?)\s*2\.\s*Potential Risks?\s*[:：]?\s*(.*?)\s*3\.\s*Recommended Fix\s*[:：]?\s*(.*?)\s*"
                      r"(?:4\.\s*Final Modified Code.*?\s*)?5\.\s*(?:Additional Notes|References)\s*[:：]?\s*(.*)")
_LINE = r"(?:^|\n)\s*(?:\d+\.\s*)?"
PLAIN = re.compile(rf"(?sia){_LINE}Vulnerability Description\s*[:：]?\s*(.*?)\s*{_LINE}Potential Risks?\s*[:：]?\s*(.*?)\s*"
                   rf"{_LINE}Recommended Fix\s*[:：]?\s*(.*?)\s*{_LINE}(?:Additional Notes|References)\s*[:：]?\s*(.*)")

#: A number on a line of its own is always part of the heading below it, not text of the section above.
NUMBER_LINE = re.compile(r"\d+\.\s*\n")

PIECES = ["1. Vulnerability Description", "2. Potential Risk", "3. Recommended Fix", "4. Final Modified Code", "5. Additional Notes", "5. References",
          "1.Vulnerability description:", "2.  potential risks：", "3.\t Recommended fix", "Vulnerability Description", "Potential Risks", "Recommended Fix",
          "Additional Notes", "References:", "7. Potential Risk", "\n", "\n\n  ", "  ", ": ", "：", "text", "```python\nx\n```", "\ue000", "\ue0001", "\ue000x", "1.", "#", "$0"]


def by_hand(pattern, text):
    m = pattern.search(text)
    return [g.strip() for g in m.groups()] if m else None


def some_answers(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        if r.random() < 0.6:  # in order, with things in between
            form = r.choice([PIECES[:5], [*PIECES[6:9], *PIECES[3:5]], PIECES[9:13], [PIECES[0], "2. Potential Risks", PIECES[2], PIECES[5]]])
            text = "".join(h + r.choice(["", ":", " : ", "\n"]) + "".join(r.choices(PIECES, k=r.randrange(3))) + r.choice(["\n", " ", "\n \n"]) for h in form)
        else:
            text = "".join(r.choices(PIECES, k=r.randrange(14)))
        out.append(text)
    return out


def frame(spark, texts):
    return spark.createDataFrame([("r", "s", str(i), t) for i, t in enumerate(texts)], "repo string, scan_id string, path string, content string")


def test_sections_are_those_of_the_patterns(spark):
    texts = [*some_answers(1, 1500), "", None]
    df = frame(spark, texts).select("path", *[P.sections(F.col("content"), h).alias(n) for n, h in (
        ("strict", P.STRICT_HEADINGS), ("numbered", P.NUMBERED_HEADINGS), ("plain", P.PLAIN_HEADINGS))])
    hits = 0
    for r in df.collect():
        text = texts[int(r["path"])]
        for name, pattern in (("strict", STRICT), ("numbered", NUMBERED), ("plain", PLAIN)):
            if name == "plain" and NUMBER_LINE.search(text or ""):
                continue
            want = None if text is None else by_hand(pattern, text)
            got = None if r[name] is None else [r[name][n] for n in P.SECTION_NAMES]
            assert got == want, (name, text)
            hits += want is not None
    assert hits > 500


def test_tiers_follow_the_patterns(spark):
    texts = some_answers(2, 600)
    got = {int(r["path"]): r for r in P.sections_relaxed(frame(spark, texts)).collect()}
    strict = {int(r["path"]): r for r in P.sections_strict(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        if NUMBER_LINE.search(t):
            continue
        tier = 1 if by_hand(NUMBERED, t) else 2 if by_hand(PLAIN, t) else 3
        assert got[i]["tier"] == tier
        if tier < 3:
            assert [got[i][n] for n in P.SECTION_NAMES] == by_hand(NUMBERED if tier == 1 else PLAIN, t)
        assert [strict[i][n] for n in P.SECTION_NAMES] == (by_hand(STRICT, t) or [""] * 4)


def test_long_answers_take_linear_time(spark):
    head = "1. Vulnerability Description: v\n2. Potential Risk: r\n3. Recommended Fix: f\n"

    def seconds(n):
        texts = [head + "4. Final Modified Code " * n, head * n, "1. Vulnerability Description\n" * n, "x\n" * n + head, head + "\n" * (20 * n) + "5. Additional",
                 "Vulnerability Description" + "\n \n" * (10 * n) + "x Potential Risk Recommended Fix References"]
        df = frame(spark, texts).cache()
        df.count()
        start = time.perf_counter()
        for h in (P.STRICT_HEADINGS, P.NUMBERED_HEADINGS, P.PLAIN_HEADINGS):
            df.select(P.sections(F.col("content"), h).alias("s")).collect()
        P.sections_strict(df).collect()
        return time.perf_counter() - start

    seconds(100)
    small, large = seconds(5_000), seconds(40_000)  # the last about 1 MB a text
    assert large < 8 * 2 * small + 3
