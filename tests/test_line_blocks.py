"""Dyadic blocks of lines: exact cover, few rows, deep nesting."""

import math
import random

from pyspark.sql import functions as F

from findrift.operators import syntax as SX


def test_blocks_cover_each_line_once_and_are_few(spark):
    rnd = random.Random(3)
    spans = [(a, z) for a in range(12) for z in range(a, 12)] + [
        (a, a + rnd.choice([0, 1, 5, 63, 64, 1000, 10_000, 10**6])) for a in (rnd.randrange(10**6) for _ in range(200))] + [(0, 2**30), (2**31 - 3, 2**31 - 2)]
    df = spark.createDataFrame(spans, "a int, z int").select("a", "z", SX.line_blocks(F.col("a"), F.col("z")).alias("b"))
    for r in df.collect():
        lines = sorted(((b["number"] << b["level"]) - 1, ((b["number"] + 1) << b["level"]) - 2) for b in r["b"])
        assert lines[0][0] == r["a"] and lines[-1][1] == r["z"]
        assert all(x[1] + 1 == y[0] for x, y in zip(lines, lines[1:]))
        n = r["z"] - r["a"] + 1
        assert len(lines) <= max(1, 2 * math.log2(n))
    points = spark.createDataFrame([(p,) for p in [0, 1, 2, 3, 77, 10**6, 2**31 - 1]], "p int").select("p", SX.blocks_of_line(F.col("p")).alias("b"))
    for r in points.collect():
        assert len(r["b"]) == (r["p"] + 1).bit_length()
        assert all((b["number"] << b["level"]) - 1 <= r["p"] <= ((b["number"] + 1) << b["level"]) - 2 for b in r["b"])


def test_nodes_meet_a_line_exactly_where_they_span_it(spark):
    rnd = random.Random(5)
    nodes = [("r", "p", i, None, "N", a, 0, a + rnd.randrange(40), 5) for i, a in enumerate(rnd.randrange(1, 200) for _ in range(120))]
    nd = spark.createDataFrame(nodes, "repo string, path string, bfs_id int, parent_id int, node_type string, line int, col int, end_line int, end_col int")
    points = spark.createDataFrame([(p,) for p in range(-2, 260)], "p int")
    got = (SX._asking(points, "p").join(SX._by_block(nd), F.col("asked") == F.col("block")).groupBy("p")
           .agg(F.sort_array(F.collect_list("bfs_id")).alias("ids")).collect())
    want = {p: [n[2] for n in nodes if n[5] <= p <= n[7]] for p in range(-2, 260)}
    assert {r["p"]: r["ids"] for r in got} == {p: ids for p, ids in want.items() if ids}


def test_deep_nesting_and_long_bodies(spark):
    depth, body = 20, 10_000
    lines = [f"{'    ' * i}{'class C' if i % 2 else 'def f'}{i}{':' if i % 2 else '():'}" for i in range(depth)]
    lines += [f"{'    ' * depth}x = {i}" for i in range(body)]
    lines += [f"{'    ' * (i + 1)}y = {i}" for i in reversed(range(depth - 1))]
    src = spark.createDataFrame([("r", "deep.py", "\n".join(lines) + "\n")], "repo string, path string, content string")
    nodes = SX.extract_ast_nodes(src)[0].cache()
    per_node = SX._by_block(nodes).groupBy("bfs_id").agg(F.count("*").alias("n"), F.first("line").alias("a"), F.first("end_line").alias("z")).collect()
    assert all(r["n"] <= max(1, 2 * math.log2(r["z"] - r["a"] + 1)) for r in per_node)
    assert max(r["n"] for r in per_node) > 1
    found = spark.createDataFrame([("r", "s", s, "deep.py", s, s) for s in (1, 2, 10, 20, 21, 5000, 10_020, 10_021, 10_030)],
                                  "repo string, scan_id string, ordinal long, path string, start_line int, end_line int")
    got = {r["start_line"]: r["node_line"] for r in SX.map_findings_to_nodes(found, nodes).collect()}
    # the innermost block opened above the line and still open on it
    assert got == {1: 1, 2: 1, 10: 9, 20: 19, 21: 20, 5000: 20, 10_020: 20, 10_021: 19, 10_030: 10}


def test_points_meet_the_best_node_of_a_page(spark):
    """N3 and J6 against the exact blocks: nodes of all three page sizes, odd rows, at most one row for each page."""
    rnd = random.Random(7)
    spans = [rnd.choice([0, 1, 15, 16, 40, 255, 4095, 4096, 70_000, 200_000]) for _ in range(400)]
    rows = [("r", rnd.choice("pq"), i, "N%d" % (i % 3), a, rnd.randrange(20), a + n, rnd.randrange(20, 60))
            for i, n in enumerate(spans) for a in [rnd.randrange(0, 300) if n < 300 else rnd.randrange(0, 140_000)]]
    rows += [("r", "p", None, "X", 1, 0, 9, 99), ("r", "p", 70_000, "Y", 3, 0, None, None), (None, "p", 1, "Z", 1, 0, 9, 99),
             ("r", "p", 5000, "B", 50, 0, 40, 99), ("r", "p", 5001, "C", -3, 0, 40, 99)] + [("r", "q", 70_000 + i, "D", 7, 0, 7, 50) for i in range(30)]
    nodes = spark.createDataFrame(rows, "repo string, path string, bfs_id int, node_type string, line int, col int, end_line int, end_col int")
    points = [("r", "s", i, rnd.choice("pq"), rnd.choice([-1, 0, 3, 7, 255, 256, 4096, 65_535, 65_536, 139_000, rnd.randrange(300)]), rnd.randrange(60)) for i in range(300)]
    points += [("r", "s", 0, "p", None, 1), (None, "s", 1, "p", 3, 1), ("r", "s", 400, "gone", 3, 1), ("r", "s", 401, "p", 3, None), ("r", "s", 402, "p", 250, None)]
    pts = spark.createDataFrame(points, "repo string, scan_id string, ordinal long, path string, line int, col int")
    got = SX.find_node_at(pts, nodes)
    p, n = SX._asking(pts.toDF("repo", "scan_id", "ordinal", "path", "p_line", "p_col"), "p_line"), SX._by_block(nodes)
    want = (p.join(n, (p["repo"] == n["repo"]) & (p["path"] == n["path"]) & (p["asked"] == n["block"]) & (n["col"] <= p["p_col"]) & (p["p_col"] <= n["end_col"]), "left")
            .groupBy(p["repo"], "scan_id", "ordinal", p["path"], "p_line").agg(F.min_by(F.struct("bfs_id", "node_type"), "bfs_id").alias("m"))
            .select("repo", "scan_id", "ordinal", "path", "p_line", "m.bfs_id", "m.node_type"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert got.where("bfs_id is not null").count() > 100
    found = pts.select("repo", "scan_id", "ordinal", "path", F.col("line").alias("start_line"), F.col("col").alias("start_col"), (F.col("line") + F.col("ordinal") % 3).alias("end_line"))
    # the minimal covering node, found by looking at every node
    best = {}
    for f in found.collect():
        if None not in (f["repo"], f["start_line"]):
            # before a null column only what starts on an earlier line, after it only what ends on a later one
            c0 = f["start_col"]
            s, lo = (f["start_line"], 10**9 if c0 is None else c0), (f["start_line"], -10**9 if c0 is None else c0)
            e = (f["end_line"], 0 if c0 is None else c0)
            fits = []
            for repo, path, i, kind, a, c, z, d in rows:
                z, d = a if z is None else z, c if d is None else d
                if (repo, path) == (f["repo"], f["path"]) and a >= 0 and a <= s[0] <= max(a, z):
                    tier = 1 if (a, c) <= lo and e <= (z, d) else 2 if (a, c) <= lo and s <= (z, d) else 3 if c <= s[1] <= d else None
                    if tier:
                        fits.append((tier, z - a if tier < 3 else 0, d - c if tier < 3 else 0, -1 if i is None else i))
            best[f["ordinal"], f["path"], f["start_line"]] = min(fits, default=(None,))[0], (min(fits)[3] if fits else None)
    j6 = {(r["ordinal"], r["path"], r["start_line"]): (r["tier"], -1 if r["tier"] and r["bfs_id"] is None else r["bfs_id"])
          for r in SX.map_findings_to_nodes(found, nodes).collect() if r["repo"] and r["start_line"] is not None}
    assert {k: v for k, v in j6.items() if k in best} == best


def test_pages_are_few_and_a_best_node_leaves_each(spark):
    spans = [(0, 0), (5, 20), (255, 256), (250, 270), (0, 4095), (100, 4195), (100, 4196), (65_535, 65_536), (0, 10_000), (3, 300_000)]
    nodes = spark.createDataFrame([("r", "p", i, "N", a, 0, z, 9) for i, (a, z) in enumerate(spans)],
                                  "repo string, path string, bfs_id int, node_type string, line int, col int, end_line int, end_col int")
    filed = SX._pages(nodes).select("page", F.explode("nodes").alias("n")).groupBy("n.bfs_id").agg(F.count("*").alias("k")).collect()
    assert len(filed) == len(spans) and all(r["k"] <= 17 for r in filed)
    deep = spark.createDataFrame([("r", "p", i, "N", 1, 0, 10_000, 9) for i in range(200)],
                                 "repo string, path string, bfs_id int, node_type string, line int, col int, end_line int, end_col int")
    points = spark.createDataFrame([("r", "s", 1, "p", 77, 3)], "repo string, scan_id string, ordinal long, path string, line int, c int")
    left = SX._best_nodes(points, "line", deep, lambda n: F.when(n["col"] <= F.col("c"), n["bfs_id"]), lambda t, n: t).collect()
    assert len(left) <= len(SX.PAGES) and [r["best"] for r in left if r["best"] is not None] == [0]
