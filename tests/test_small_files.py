"""Many small files: the per-key writer and the listing of many folders."""

from pyspark.sql import functions as F

from findrift.session import many_folders
from findrift.sources import files as SRC
from findrift.sources import sinks, tree


def _read(spark, base):
    rows = (spark.read.option("recursiveFileLookup", True).text(base, wholetext=True)
            .select(F.regexp_extract(F.col("_metadata.file_path"), "/(k=.*)/[^/]+$", 1).alias("at"), "value").collect())
    return sorted((r["at"], r["value"]) for r in rows)


def test_text_per_key_is_laid_out_as_sparks_writer_does(spark, tmp_path):
    rows = [("a", "x y", "one"), ("a", "x y", "one"), ("a", "p/q:%=?#{[]^*\"'\\\t\u00e4", "two\nlines"), (None, "n", "three"),
            ("", "n", "three"), ("b", None, None), ("c", "", ""), ("d.e", "}~$&", "four")]
    df = spark.createDataFrame(rows, "k string, j string, t string")
    assert sinks.write_text_per_key(df, ["k", "j"], "t", str(tmp_path / "mine")) == 6
    df.repartition(1).write.partitionBy("k", "j").text(str(tmp_path / "sparks"))
    assert _read(spark, str(tmp_path / "mine")) == _read(spark, str(tmp_path / "sparks"))


def test_no_task_files_are_left(spark, tmp_path):
    df = spark.range(50).select(F.col("id").cast("string").alias("k"), F.lit("t").alias("t"))
    assert sinks.write_text_per_key(df, ["k"], "t", str(tmp_path)) == 50
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["part-00000.txt"] * 50


def test_many_folders_are_listed_in_few_tasks(spark, tmp_path):
    df = spark.range(120).select(F.lit("r").alias("repo"), F.col("id").cast("string").alias("d"), F.lit("x = 1").alias("t"))
    sinks.write_text_per_key(df, ["repo", "d"], "t", str(tmp_path))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "listing")
    found = SRC.read_source_files(spark, str(tmp_path), exts=("txt",))
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setJobGroup("", "")
    assert stages and max(s.numTasks for s in stages if s) <= 4 * spark.sparkContext.defaultParallelism
    assert found.count() == 120


def test_listing_setting_is_put_back(spark):
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    with many_folders(spark):
        assert spark.conf.get(key) != before
    assert spark.conf.get(key) == before


def test_small_files_are_those_of_sparks_reader(spark, tmp_path):
    odd = "p q%=+{[]^ä‣ '"
    for name in ("a/b/x.py", "a/y.pyi", f"{odd}/{odd}.py", "z.py", "a/.hid/x.py", "a/_tmp/x.py", "_k=1/x.py", "a/.x.py", "a/_x.py",
                 "a/empty.py", "a/x.txt", "a/x.py.gz", "a/b/x.py._COPYING_"):
        at = tmp_path / "s" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"" if "empty" in name else f"{name}\r\nä".encode() + b"\xff")
    for glob in ("*.{py,pyi}", "*.py", "*.gz"):
        sparks = (spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=glob).load(str(tmp_path / "s"))
                  .select("_metadata.file_path", "content").collect())
        mine = tree.read_small_files(spark, str(tmp_path / "s"), glob).collect()
        assert sorted((r["file_path"], bytes(r["content"])) for r in mine) == sorted((r[0], bytes(r[1])) for r in sparks) != []
        assert all(r["content"] == (tmp_path / "s" / r["rel"]).read_bytes() for r in mine)


def test_the_driver_holds_no_list_of_small_files(spark, tmp_path):
    df = spark.range(40).select(F.lit("r").alias("repo"), F.col("id").cast("string").alias("d"), F.lit("x = 1").alias("t"))
    sinks.write_text_per_key(df, ["repo", "d"], "t", str(tmp_path))
    for found in (SRC.read_source_files(spark, str(tmp_path), exts=("txt",)), SRC.read_responses(spark, str(tmp_path), glob="*.txt")):
        assert found.count() == 40
        assert not [f for f in found.inputFiles() if f.endswith(".txt")]


def test_a_root_that_is_no_folder_is_left_to_spark(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "x.py").write_text("x = 1\n")
    assert [r["content"] for r in tree.read_small_files(spark, str(tmp_path / "r*"), "*.py").collect()] == [b"x = 1\n"]
    assert tree.read_small_files(spark, str(tmp_path / "r"), "*.md").collect() == []
