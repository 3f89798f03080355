"""URL filters, sharding, numbering, the entry and the pipeline."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from findrift.llm import numbering, queries, sharding, url_filter

from . import messy

URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.org", "http://example.org/", "https://a.example.org/es/x", "http://example.org/es",
        "http://example.org/en/1", "http://example.org/en/123?x#y", "http://badexample.org/es/1", "http://x.com/fr/", "http://com/de/1#t",
        "http://x.com/de/1?a=/fr/", "http://x.COM/FR/", "ftp://user@x.net:80/path://q", "http://m.casino-win.example.com/en/1", "http://x.net/casino-winner",
        "http://x.com/fr/free-bets", "http://x.net/?free-bets", "http://x.net/a\nspam-farm"]


def by_hand(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, None, verdict
    hit = sorted(w for w in url_filter.BLOCKED_WORDS if re.search(f"(^|[^0-9a-z]){w}([^0-9a-z]|$)", host + path))
    return host, path, None, hit[0] if hit else None, "block" if hit else "allow"


def test_url_rules_on_awkward_urls(spark):
    rows = [(i, u, "x", "allow") for i, u in enumerate(URLS)] + [(None, URLS[6], "x", "y"), (6, URLS[6], "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    rules = url_filter.rules_table(spark, [*queries.SITE_RULES, *url_filter.default_patterns()])
    got = Counter(tuple(r) for r in url_filter.filter_urls(pages, rules).collect())
    assert got == Counter((i, *by_hand(u)) for i, u, *_ in rows)
    assert url_filter.filter_urls(pages.where("false"), rules).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(pages, rules.where("false")).collect()} == {"allow"}


def test_patterns_without_tokens_and_priorities(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x1"), (2, "http://a.net/y")], "page_id long, url string")
    rules = url_filter.rules_table(spark, [url_filter.pattern_rule("digits", r"[0-9]$", [], "block"), url_filter.pattern_rule("a", r"a\.net", ["a", "net"], "allow", -1)])
    assert {r["page_id"]: (r["pattern"], r["verdict"]) for r in url_filter.filter_urls(pages, rules).collect()} == {1: ("digits", "block"), 2: ("a", "allow")}


def test_jump_hash_moves_rows_to_the_new_shard_only(spark):
    df = spark.range(20_000)
    cols = [sharding.jump_hash(F.col("id"), n).alias(f"s{n}") for n in (1, 7, 8, 9, 70, 71)]
    rows = df.select(*cols).collect()
    assert {r["s1"] for r in rows} == {0}
    for a, b in ((7, 8), (8, 9), (70, 71)):
        moved = [r for r in rows if r[f"s{a}"] != r[f"s{b}"]]
        assert all(r[f"s{b}"] == b - 1 for r in moved)
        assert abs(len(moved) - 20_000 / b) < 5 * (20_000 / b) ** 0.5
    sizes = Counter(r["s8"] for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) < 1.1 * 2500


def test_sharding_of_messy_rows(spark):
    import zlib
    out = sharding.shard_documents(messy.docs(spark), 8, lanes=3).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, None if r[1] is None else zlib.crc32(r[1].encode())) for r in messy.rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert len({(r["doc_id"], r["shard"], r["grown_shard"]) for r in out}) == len({r["doc_id"] for r in out})
    assert all(r["grown_shard"] in (r["shard"], 8) for r in out)
    assert sharding.shard_documents(messy.empty(spark), 8).count() == 0


def test_numbers_are_gapless_for_hot_groups_and_equal_rows(spark):
    r = random.Random(1)
    rows = [("hot", 5)] * 70_000 + [(r.choice("abc"), r.randrange(50)) for _ in range(500)] + [(None, None)] * 3
    out = numbering.numbered(spark.createDataFrame(rows, "g string, x int"), "g", "i", lanes=5)
    stats = {x["g"]: tuple(x)[1:] for x in out.groupBy("g").agg(F.count("*"), F.count_distinct("i"), F.min("i"), F.max("i")).collect()}
    for g, n in Counter(g for g, _ in rows).items():
        if g is not None:
            assert stats[g] == (n, n, 0, n - 1)


def test_pipeline_stages_keep_columns_and_take_effect(spark, tmp_path):
    d = str(tmp_path)
    docs = messy.labelled(spark).unionByName(messy.docs(spark))
    docs.write.parquet(f"{d}/documents.parquet")
    messy.labels(spark).write.parquet(f"{d}/labels.parquet")
    leak = messy.words(7, 60)
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        left[name] = {r["doc_id"] for r in docs.collect()}
        leaked = docs.where((F.col("doc_id") == 7) & (F.length("text") > 50)).count()
        assert leaked == (name != "decontamination")  # the labelled row of that id is the leak
    assert sum(i % 4 == 0 for i in left["toxicity"] if i is not None and 11 < i < 400) < 5
    assert sum(i % 5 == 0 for i in left["quality"] if i is not None and 11 < i < 400) < 5
    packed = corpus_pipeline.pack_sequences(spark, docs, d)
    assert {r["doc_id"] for r in packed.collect()} == left["decontamination"]
    empty = spark.read.parquet(f"{d}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).count() == 0


def test_every_operator_is_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
