"""Scanner output files -> one row per result.

A scan may be sharded into several files (``part``).  Documents come in either
of two forms, and every function here takes both: one row holding a file's
whole text, or rows with a ``seq`` that hold its chunks (``json_chunks``), for
documents of any size.  A whole document is parsed once, straight into its
results (each a VARIANT of its own); chunks are cut into results first.  A
document that is no valid scanner output keeps one row with ``doc_error`` set,
which the adapters turn into a reject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findrift.sources import json_chunks
from findrift.sources.json_chunks import FEW_FILES, listed_files

RAW_SCAN_COLUMNS = ("scan_id", "repo", "tool", "part", "text")


def read_scan_files(spark: SparkSession, path: str, tool: str, repo: str | None = None) -> DataFrame:
    """Read scanner JSON/SARIF files laid out as <repo>/<scan_id>/<file> under ``path``.

    One row per file holding its whole text (``json_chunks.read_scan_chunks`` has
    no such limit).  ``part`` is the file's position among the scan's files by
    name; it is told by the listing alone, one narrow row per file, whose side
    of the join is broadcast while it has at most FEW_FILES rows."""
    df = (spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
          .select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file_path")))
    files = listed_files(spark, path, repo)
    if files.limit(FEW_FILES + 1).count() <= FEW_FILES:
        files = F.broadcast(files)
    return df.join(files, "file_path").select("scan_id", "repo", F.lit(tool).alias("tool"), "part", "text")


MALFORMED_DOCUMENT = ("MALFORMED_DOCUMENT", "scanner output is not a valid document; dropped")
DOC_KEYS = ("scan_id", "repo", "tool", "part")


def _parsed(raw: DataFrame, text: Column, schema: str) -> DataFrame:
    """Documents as ``doc`` by ``schema``, with ``doc_error`` where that fails."""
    doc = F.from_json(text, schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    # a generator of one row: projections above it can't be merged into the parse and repeat it
    return raw.select(*DOC_KEYS, F.explode(F.array(doc)).alias("doc"))


def _error() -> Column:
    return F.when(F.col("doc").isNull() | F.col("doc._bad").isNotNull(), F.lit(MALFORMED_DOCUMENT[0]))


def in_chunks(raw: DataFrame) -> bool:
    return "seq" in raw.columns


def vget(v: Column | str, path: str, typ: str = "string") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, typ)


def native_results(raw: DataFrame) -> DataFrame:
    """``{"results": [...]}`` or a bare list -> (scan_id, repo, tool, part,
    doc_error, pos, r); a document without results gives no row, a broken one
    a row with its error."""
    if in_chunks(raw):
        return json_chunks.native_results(raw, MALFORMED_DOCUMENT[0])
    bare = F.ltrim(F.regexp_replace(F.substring("text", 1, 64), r"\s", " ")).startswith("[")
    text = F.when(bare, F.concat(F.lit('{"results":'), "text", F.lit("}"))).otherwise(F.col("text"))
    # outer: an inferred filter on the array's size would parse the text again
    ex = _parsed(raw, text, "results array<variant>").select(
        *DOC_KEYS, _error().alias("doc_error"), F.posexplode_outer("doc.results").alias("pos", "r"))
    return ex.where(F.col("pos").isNotNull() | F.col("doc_error").isNotNull())


_SARIF = "runs array<struct<tool: variant, results: array<variant>>>"


def sarif_rules(raw: DataFrame) -> DataFrame:
    """S3 rules: one row per ``runs[].tool.driver.rules[]``."""
    if in_chunks(raw):
        _, rules, _ = json_chunks.sarif(raw, F.lit(None), _rule(F.col("x")))
        return rules.select(*DOC_KEYS, "run_pos", "rule_pos", F.col("rule.id").alias("rule_id"), "rule.tags", "rule.help_uri",
                            "rule.default_level", "rule.problem_severity")
    runs = _parsed(raw, F.col("text"), _SARIF).select(*DOC_KEYS, F.posexplode_outer("doc.runs").alias("run_pos", "run"))
    ex = runs.select(*DOC_KEYS, "run_pos",
                     F.posexplode_outer(vget("run.tool", "$.driver.rules", "array<variant>")).alias("rule_pos", "rule"))
    return ex.where(F.col("rule_pos").isNotNull()).select(
        *DOC_KEYS, "run_pos", "rule_pos",
        vget("rule", "$.id").alias("rule_id"),
        vget("rule", "$.properties.tags", "array<string>").alias("tags"),
        vget("rule", "$.helpUri").alias("help_uri"),
        vget("rule", "$.defaultConfiguration.level").alias("default_level"),
        # key present (even if empty) vs absent matters for the level fallback
        F.when(vget("rule", "$.properties", "variant").isNotNull(),
               vget("rule", "$.properties['problem.severity']")).alias("problem_severity"),
    )


def _rule(x: Column) -> Column:
    """Rule fields read from one ``runs[].tool.driver.rules[]`` entry."""
    return F.struct(
        vget(x, "$.id").alias("id"),
        vget(x, "$.properties.tags", "array<string>").alias("tags"),
        vget(x, "$.helpUri").alias("help_uri"),
        vget(x, "$.defaultConfiguration.level").alias("default_level"),
        F.when(vget(x, "$.properties", "variant").isNotNull(),
               vget(x, "$.properties['problem.severity']")).alias("problem_severity"))


def _rules_of(run: Column) -> Column:
    return F.transform(F.coalesce(vget(run["tool"], "$.driver.rules", "array<variant>"), F.array().cast("array<variant>")),
                       _rule)


def _last_wins_map(rules: Column) -> Column:
    """id -> rule, a later entry with the same id replacing an earlier one; no id -> left out.

    Sorted by (id, position), an entry stays if its neighbour has another id."""
    named = F.filter(F.transform(rules, lambda x, i: F.struct(x["id"].alias("id"), i.alias("i"), x.alias("x"))),
                     lambda y: y["id"].isNotNull() & (y["id"] != ""))
    order = lambda a, b: (F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1)
                          .when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0))
    # bound once through a one-element array, so the neighbour test does not sort again
    kept = F.transform(F.array(F.array_sort(named, order)), lambda s: F.filter(
        s, lambda y, i: ~F.coalesce(F.get(s, i + 1)["id"] == y["id"], F.lit(False))))
    return F.map_from_entries(F.transform(F.get(kept, 0), lambda y: F.struct(y["id"], y["x"])))


def _result(r: Column) -> list[Column]:
    """Fields read from one ``runs[].results[]`` entry."""
    loc = "$.locations[0].physicalLocation"
    return [vget(r, "$.ruleId").alias("rule_id"),
            # a list-valued level must not be read as its JSON text
            F.when(vget(r, "$.level", "array<string>").isNull(), vget(r, "$.level")).alias("level_str"),
            vget(r, "$.level", "array<string>").alias("level_arr"),
            vget(r, "$.message.text").alias("message"),
            vget(r, f"{loc}.artifactLocation.uri").alias("uri"),
            vget(r, f"{loc}.region.startLine", "int").alias("start_line"),
            vget(r, f"{loc}.region.endLine", "int").alias("end_line")]


def _sarif_results_of_chunks(chunks: DataFrame, rule_scope: str) -> DataFrame:
    """``sarif_results`` of chunks: rules are a table here (last one of an id wins), joined by id."""
    results, rules, broken = json_chunks.sarif(chunks, F.struct(*_result(F.col("r"))), _rule(F.col("x")))
    scope = [*DOC_KEYS, *(["run_pos"] if rule_scope == "run" else [])]
    last = (rules.where(F.col("rule.id") != "").groupBy(*scope, F.col("rule.id").alias("rule_id"))
            .agg(F.max_by("rule", F.struct("run_pos", "rule_pos")).alias("rule")))
    rows = results.select(*DOC_KEYS, "run_pos", "pos", "v.*").join(last, [*scope, "rule_id"], "left")
    return rows.withColumn("doc_error", F.lit(None).cast("string")).unionByName(
        broken.withColumn("doc_error", F.lit(MALFORMED_DOCUMENT[0])), allowMissingColumns=True)


def sarif_results(raw: DataFrame, rule_scope: str = "file") -> DataFrame:
    """S3 results, one row per ``runs[].results[]`` (first location only), each
    with the rule it names attached; a broken document gives one row with
    ``doc_error``.

    The rule lookup is built inside the document row -- ``file``: one map over
    all runs of the file, later runs win; ``run``: one map per run -- and applied
    before the results are exploded, so there is no second parse, no
    aggregation and no join for rule metadata."""
    if in_chunks(raw):
        return _sarif_results_of_chunks(raw, rule_scope)
    d = _parsed(raw, F.col("text"), _SARIF)
    if rule_scope == "file":
        d = d.select(*DOC_KEYS, _error().alias("doc_error"), F.col("doc.runs").alias("runs"),
                     _last_wins_map(F.flatten(F.transform("doc.runs", _rules_of))).alias("_m"))
        ex = d.select(*DOC_KEYS, "doc_error", "_m", F.posexplode_outer("runs").alias("run_pos", "run"))
    else:
        ex = d.select(*DOC_KEYS, _error().alias("doc_error"), F.posexplode_outer("doc.runs").alias("run_pos", "run"))
        ex = ex.select("*", _last_wins_map(_rules_of(F.col("run"))).alias("_m"))
    with_rule = F.transform("run.results", lambda x: F.struct(
        x.alias("r"), F.try_element_at(F.col("_m"), vget(x, "$.ruleId")).alias("rule")))
    res = (ex.select(*DOC_KEYS, "doc_error", "run_pos", F.posexplode_outer(with_rule).alias("pos", "x"))
           .where(F.col("pos").isNotNull() | F.col("doc_error").isNotNull()))
    return res.select(*DOC_KEYS, "doc_error", "run_pos", "pos", *_result(F.col("x.r")), F.col("x.rule").alias("rule"))


def ordinal(part: Column | str, run_pos: Column | str | int, pos: Column | str) -> Column:
    """Total order of a result inside its scan: (part, run, position) packed in a
    bigint; fails rather than let one field run into the next."""
    c = lambda x: F.lit(x) if isinstance(x, int) else (F.col(x) if isinstance(x, str) else x)
    part, run_pos, pos = (c(x).cast("long") for x in (part, run_pos, pos))
    fits = (part < 1 << 23) & (run_pos < 1 << 16) & (pos < 1 << 24)
    packed = F.shiftleft(part, 40) + F.shiftleft(run_pos, 24) + pos
    return F.when(fits, packed).when(part.isNotNull() & run_pos.isNotNull() & pos.isNotNull(), F.raise_error(
        F.format_string("result (%d, %d, %d) is beyond the range of an ordinal", part, run_pos, pos)).cast("long"))
