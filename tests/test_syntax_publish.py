"""W4 against a brute-force reading of the reference rule; publish log joins; entry contract."""

import json
import random


from findrift.operators import publish as PB
from findrift.operators import syntax as SX

NODE_SCHEMA = ("repo string, path string, bfs_id int, parent_id int, node_type string, line int, col int, "
               "end_line int, end_col int")


def _brute(nodes, s, e):
    """The reference's tiers over BFS-ordered nodes, finding range (s,0)-(e,0)."""
    le = lambda a, b: a[0] < b[0] or (a[0] == b[0] and a[1] <= b[1])
    best = part = None
    for n in nodes:
        ns, ne = (n[5], n[6]), (n[7], n[8])
        area = (ne[0] - ns[0], ne[1] - ns[1])
        if le(ns, (s, 0)) and le((e, 0), ne):
            if best is None or area < best[0]:
                best = (area, n[2])
        elif le(ns, (s, 0)) and le((s, 0), ne):
            if part is None or area < part[0]:
                part = (area, n[2])
    if best:
        return best[1], 1
    if part:
        return part[1], 2
    for n in nodes:
        if n[5] <= s <= n[7] and n[6] <= 0 <= n[8]:
            return n[2], 3
    return None, None


def test_minimal_cover_matches_brute_force(spark):
    rnd = random.Random(7)
    nodes, finds = [], []
    for f in range(6):
        path = f"f{f}.py"
        for b in range(40):
            ln = rnd.randint(1, 30)
            el = ln + rnd.choice([0, 0, 1, 2, 5])
            nodes.append(("r", path, b, None, "N", ln, rnd.randint(0, 4), el, rnd.randint(0, 8)))
        for k in range(30):
            s = rnd.randint(1, 32)
            finds.append(("r", "s", f * 100 + k, path, s, s + rnd.choice([0, 1, 3])))
    nd = spark.createDataFrame(nodes, NODE_SCHEMA)
    fd = spark.createDataFrame(finds, "repo string, scan_id string, ordinal long, path string, start_line int, end_line int")
    got = {r["ordinal"]: (r["bfs_id"], r["tier"]) for r in SX.map_findings_to_nodes(fd, nd).collect()}
    for (_, _, o, path, s, e) in finds:
        exp = _brute([n for n in nodes if n[1] == path], s, e)
        assert got[o] == exp, (o, got[o], exp)


def test_parse_nodes_and_failures(spark):
    src = spark.createDataFrame([("r", "ok.py", "def f(a):\n    return a\n"), ("r", "bad.py", "def (\n")],
                                "repo string, path string, content string")
    nodes, status = SX.extract_ast_nodes(src)
    st = {r["path"]: r for r in status.collect()}
    assert st["ok.py"]["success"] and not st["bad.py"]["success"] and "invalid syntax" in st["bad.py"]["error_message"]
    rows = sorted(nodes.collect(), key=lambda r: r["bfs_id"])
    assert [r["node_type"] for r in rows][:3] == ["Module", "FunctionDef", "arguments"]
    assert json.loads(rows[1]["fields"])["name"] == "f" and rows[1]["parent_id"] == 0


def test_replace_equal_rows_null_safe(spark):
    cols = "name string, owner string, repo_url string, vulnerabilities bigint, byClass array<struct<type:string,count:bigint>>, " \
           "sastTool string, rerun boolean, analysis string, seq long"
    ex = spark.createDataFrame([("a", None, "u", 1, [], "s", False, "", 1), ("b", "o", "u", 1, [], "s", False, "", 2)], cols)
    new = spark.createDataFrame([("a", None, "u", 1, [], "s", False, "", 10), ("a", None, "u", 1, [], "s", False, "", 11)], cols)
    out = sorted((r["name"], r["seq"]) for r in PB.replace_equal_rows(ex, new).collect())
    assert out == [("a", 11), ("b", 2)]


def test_update_status(spark):
    log = spark.createDataFrame([("d", "o", "r", "u", "url1", "h", 1, True, False)],
                                "date string, owner string, repo string, user_name string, repo_url string, repo_hash string, "
                                "pr_number int, opened boolean, approved boolean")
    upd = spark.createDataFrame([(1, "url1", True, False, 1, 1), (1, "url1", False, True, 2, 2), (2, "url1", True, True, 3, 3),
                                 (None, "url1", True, True, 4, 4)],
                                "pr_number int, repo_url string, approved boolean, opened boolean, ts long, seq long")
    out, err = PB.update_pr_status(log, upd)
    r = out.first()
    assert (r["approved"], r["opened"]) == (False, True)
    assert sorted(e["status_code"] for e in err.collect()) == [400, 404]


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert "a1_merge_findings_by_file" in o


def test_updates_from_pulls(spark):
    pulls = spark.createDataFrame([(1, "u", True, "closed", 5), (2, "u", False, "open", 6), (3, "u", None, None, 7)],
                                  "pr_number int, repo_url string, merged boolean, state string, ts long")
    rows = {r["pr_number"]: (r["approved"], r["opened"]) for r in PB.updates_from_pulls(pulls).collect()}
    assert rows == {1: (True, False), 2: (False, True), 3: (False, False)}
