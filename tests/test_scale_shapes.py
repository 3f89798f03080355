"""Positions, fleet rollup and log upsert: same results in shapes that scale."""

import random
import re

from pyspark.sql import functions as F

from findrift.operators import publish as PB
from findrift.operators import reports as RP
from findrift.plans import catalog

SMOKE = "/root/testdata/sf0.001"


def formatted(df) -> str:
    plan = df._jdf.queryExecution()
    return df.sparkSession._jvm.PythonSQLUtils.explainString(plan, "formatted")


def test_positions_in_a_scan_of_many_parts(spark):
    parts = 100_000
    df = spark.range(2 * parts).select(
        F.lit("r").alias("repo"), F.when(F.col("id") % 1000 == 7, "s2").otherwise("s1").alias("scan_id"),
        (F.shiftleft(F.floor(F.col("id") / 2), 40) + F.shiftleft(F.col("id") % 3, 24) + F.col("id") * 7 % 1000).alias("o"))
    got = RP.ranked(df, ["repo", "scan_id"], "o")
    want = df.groupBy("repo", "scan_id").agg(F.array_sort(F.collect_list("o")).alias("os")).select("repo", "scan_id", F.posexplode("os").alias("p", "o"))
    both = got.join(want, ["repo", "scan_id", "o"]).agg(F.count("*").alias("n"), F.count_if(F.col("rn") == F.col("p") + 1).alias("same")).first()
    assert tuple(both) == (2 * parts, 2 * parts)


def test_positions_of_any_orders_and_small_buckets(spark):
    rnd = random.Random(4)
    rows = [(g, o) for g in "ab" for o in rnd.sample([0, 1, 2, 7, 2**63 - 1, 2**40, *(rnd.randrange(2**62) for _ in range(200))], 150)]
    df = spark.createDataFrame(rows, "g string, o long")
    for bits in (4, 16):
        got = {(r["g"], r["o"]): r["rn"] for r in RP.ranked(df, ["g"], "o", bucket_bits=bits).collect()}
        assert got == {(g, o): 1 + sum(h == g and p < o for h, p in rows) for g, o in rows}
    assert RP.ranked(df.where("false"), ["g"], "o").count() == 0


def test_no_window_of_positions_holds_a_whole_scan(spark):
    windows = re.findall(r"windowspecdefinition\((.*?) ASC", formatted(catalog.w2_file_number(spark, SMOKE)))
    assert windows and all(re.search(r"_[0-4]#", w) or "_2#" in w for w in windows)


def test_fleet_rollup_expands_no_finding(spark):
    assert "Expand" not in formatted(catalog.a11_fleet_rollup(spark, SMOKE))
    rows = [("r1", "semgrep", ["x"], "a", "ERROR"), ("r1", "semgrep", ["x"], "a", "error"), ("r1", "codeql", ["x", "y"], "a", "INFO"), ("r1", "codeql", [], "b", None),
            ("r2", "semgrep", None, "a", "NOTE"), ("r2", None, ["z"], None, "ERROR")]
    df = spark.createDataFrame(rows, "repo string, tool string, vulnerability_class array<string>, path string, severity string")
    cls = F.coalesce(F.get("vulnerability_class", 0), F.lit("N/A"))
    want = (df.withColumn("cls", cls).rollup("repo", "tool", "cls")
            .agg(F.count("*").alias("n"), F.count_distinct(F.struct("repo", "path")).alias("f"), F.count_if(F.upper("severity") == "ERROR").alias("e"), F.grouping_id().alias("l")))
    got = RP.fleet_rollup(df).select("repo", "tool", "cls", "n_findings", "n_files", "n_error", "level")
    assert sorted(map(str, got.collect())) == sorted(str(r).replace("n=", "n_findings=").replace(" f=", " n_files=").replace(" e=", " n_error=").replace(" l=", " level=")
                                                     for r in want.collect())


def test_upsert_moves_no_report_but_those_met_again(spark, monkeypatch):
    rnd = random.Random(6)
    cols = "name string, repo_url string, byClass array<struct<type:string,count:bigint>>, analysis string, note string, seq long"
    keys = ["name", "repo_url", "byClass", "analysis"]

    def rows(n, seq):
        return [(rnd.choice(["a", "b", None]), rnd.choice(["u", None]), rnd.choice([None, [], [("x", 1)], [("x", None)]]), rnd.choice(["", "text " * 50, None]), f"n{seq + i}", seq + i)
                for i in range(n)]
    old, new = rows(80, 0), rows(25, 1000)
    frames = [spark.createDataFrame(x, cols) for x in (old, new)]
    key = lambda r: str(r[:4])
    last = {key(r): r for r in new}
    want = sorted([r for r in old if key(r) not in last] + list(last.values()), key=lambda r: r[5])
    for few in (PB.FEW, 0):  # digests broadcast, or shuffled
        monkeypatch.setattr(PB, "FEW", few)
        got = PB.replace_equal_rows(*frames, keys=keys)
        assert got.columns == cols_of(cols)
        assert [r["seq"] for r in got.orderBy("seq").collect()] == [r[5] for r in want]
    monkeypatch.undo()
    # reports are exchanged only above a semi join with the digests met again
    fresh = spark.createDataFrame([("new", *r[1:]) for r in new], cols)
    plan = formatted(PB.replace_equal_rows(frames[0], fresh, keys=keys))
    exchanges = re.findall(r"\n\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]", plan)
    above = [x for x in exchanges if "analysis" in x]
    assert len(above) <= 3 <= plan.count("LeftSemi")  # either side of the comparison, and repeated new rows


def cols_of(schema):
    return [c.split()[0] for c in re.sub(r"<.*?>+", "", schema).split(", ")]
