"""Prompt and response tables: T3, T3b, T3c, F4, S6, T1, T2a, T2b, A9, J5.

The model call itself is out of scope: ``chat_requests`` produces the batch
request table, ``read_responses`` reads the answers back.  Everything here is
a projection or a regex over one row, so it scales with the number of files
and never groups more than one file's rows together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findrift.functions.columns import decode_key, pystrip
from findrift.sources.tree import read_small_files

# ----------------------------------------------------------------- fixed texts (must equal the reference)
FIX_TITLE = "Refactoring Vulnerable Code Snippet (File Level)"
FIX_TEMPLATE = (
    "The following is a Python source file that contains security vulnerabilities.\n\n"
    "```python\n"
    "{input}\n"
    "```\n\n"
    "Detected vulnerabilities:\n\n"
    "{vulnerabilities}"
    "{context}"
    "Please strictly follow the guidelines below when modifying the code:\n"
    "- Modify **only the vulnerable parts** of the file with **minimal changes**.\n"
    "- Preserve the **original line numbers, indentation, and code formatting** exactly.\n"
    "- **Do not modify any part of the file that is unrelated to the vulnerabilities.**\n"
    "- Output the **entire file**, not just the changed lines.\n"
    "- This code will be used for diff-based automatic patching, so structural changes may cause the patch to fail.\n\n"
    "Output format example:\n"
    "1. Vulnerability Description: ...\n"
    "2. Potential Risk: ...\n"
    "3. Recommended Fix: ...\n"
    "4. Final Modified Code:\n"
    "```python\n"
    "# Entire file content, but only vulnerable parts should be modified minimally\n"
    "...entire code...\n"
    "```\n"
    "5. Additional Notes: (optional)\n"
)
CONTEXT_SECTION = (
    "\n## STRUCTURED CONTEXT (Team-Atlanta Approach)\n\n"
    "The following CUSTOM_CONTEXT.xml provides structured vulnerability information including:\n"
    "- BIT (Bug Information Template) with TRIGGER, STEPS, REPRODUCTION\n"
    "- Detailed CWE classifications and severity levels\n"
    "- Environmental context and mitigation strategies\n\n"
    "```xml\n"
    "{xml}\n"
    "```\n\n"
    "**Use the BIT information above to understand:**\n"
    "1. TRIGGER: What conditions activate this vulnerability\n"
    "2. STEPS: How to locate and review the vulnerable code\n"
    "3. REPRODUCTION: How to verify the issue\n"
    "4. BIT_SEVERITY: The criticality level of this vulnerability\n\n"
)
RETRY_TITLE = "Post-patch File Verification (LLM Re-analysis)"
RETRY_TEMPLATE = (
    "The following is a {lang_name} source file. Please identify and fix any security vulnerabilities.\n\n"
    "```{lang}\n"
    "{input}\n"
    "```\n\n"
    "Please strictly follow the guidelines below when modifying the code:\n"
    "- Modify **only the vulnerable parts** of the file with **minimal changes**.\n"
    "- Preserve the **original line numbers, indentation, and code formatting** exactly.\n"
    "- **Do not modify any part of the file that is unrelated to the vulnerabilities.**\n"
    "- Output the **entire file**, not just the changed lines.\n"
    "- This code will be used for diff-based automatic patching, so structural changes may cause the patch to fail.\n\n"
    "Output format example:\n"
    "1. Vulnerability Description: ...\n"
    "2. Potential Risk: ...\n"
    "3. Recommended Fix: ...\n"
    "4. Final Modified Code:\n"
    "```{lang}\n"
    "{comment} Entire file content, but only vulnerable parts should be modified minimally\n"
    "...entire code...\n"
    "```\n"
    "5. Additional Notes: (optional)\n"
)
RETRY_LANGS = {"javascript": ("JavaScript", "//"), "python": ("Python", "#")}
SYSTEM_MESSAGE = "You are a security code fixer."
DEFAULT_MODEL = "gpt-4o"
TEMPERATURE = 0.3
EMPTY_SNIPPET = ("EMPTY_SNIPPET", "The provided code snippet is empty.")
NO_CODE_BLOCK = ("NO_CODE_BLOCK", "no python code block found")

# ----------------------------------------------------------------- regex patterns (Java + RE2 common subset)
# Code fences, headings and their order must match the answers' agreed format.
CODE_BLOCK = r"(?i)```(?:py|python)\n([\s\S]+?)```"
# Headings of sections 1, 2, 3, (4), 5, in the three forms that answers come in; 4 is no section of its own.
STRICT_HEADINGS = {
    "1": r"1\. Vulnerability Description",
    "2": r"2\. Potential Risk",
    "3": r"3\. Recommended Fix",
    "4": r"4\. Final Modified Code",
    "5": r"5\. Additional Notes",
}
NUMBERED_HEADINGS = {
    "1": r"(?i)1\.\s*+Vulnerability Description",
    "2": r"(?i)2\.\s*+Potential Risks?",
    "3": r"(?i)3\.\s*+Recommended Fix",
    "4": r"(?i)4\.\s*+Final Modified Code",
    "5": r"(?i)5\.\s*+(?:Additional Notes|References)",
}
# on a line of their own; white space is read from its first character only, so that a long run is read once
_OWN_LINE = r"(?i)(?:\A\s*+|(?<=\S)[^\S\n]*+\n\s*+)(?:\d++\.\s*+)?"
PLAIN_HEADINGS = {
    "1": _OWN_LINE + "Vulnerability Description",
    "2": _OWN_LINE + "Potential Risks?",
    "3": _OWN_LINE + "Recommended Fix",
    "5": _OWN_LINE + "(?:Additional Notes|References)",
}
# Label variants of the heading fallback, tried in order per section.
HEADING_LABELS = {
    "vulnerability": ["Vulnerability Description", "Vulnerability"],
    "recommended_fix": ["Recommended Fix", "Fix"],
    "risks": ["Potential Risks?", "Risks?"],
    "references": ["Additional Notes", "References"],
}
SECTION_NAMES = ("vulnerability", "risks", "recommended_fix", "references")


def heading_pattern(label: str) -> str:
    return r"(?si)(?:^|\n)\s*#*\s*" + label + r"\s*[:：]?\s*(.*?)(?:\n\s*#|\z)"


# ----------------------------------------------------------------- T3 / F4
def input_text(tool: Column | None) -> Column:
    """The ``input`` a finding carries, by tool: Semgrep the raw file text;
    CodeQL the readlines() re-join (universal newlines); Snyk the splitlines()
    re-join, stripped."""
    raw = F.col("content")
    codeql = F.regexp_replace(raw, "\r\n?", "\n")
    snyk = pystrip(F.array_join(F.col("lines"), "\n"))
    if tool is None:
        return raw
    return F.when(tool == "codeql", codeql).when(tool == "snykcode", snyk).otherwise(raw)


def _join_or(arr: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.array_join(F.coalesce(arr, F.array().cast("array<string>")), ", "), F.lit("")),
                      F.lit(default))


def vulnerabilities_text() -> Column:
    return F.concat(
        F.lit("Type: "), _join_or(F.col("vulnerability_class"), "Unknown"),
        F.lit("\nCWE: "), _join_or(F.col("cwe"), "N/A"),
        F.lit("\nDescription: "), F.coalesce(F.nullif(F.col("message"), F.lit("")), F.lit("None")),
        F.lit("\nSeverity: "), F.coalesce(F.nullif(F.col("severity"), F.lit("")), F.lit("Unknown")),
        F.lit("\nLocation: "), F.col("start_line").cast("string"), F.lit(" ~ "), F.col("end_line").cast("string"),
        F.lit(" (Only modify this code range)\n\n"))


def _fill(template: str, **parts: Column) -> Column:
    """Template with {name} slots -> concat of literal pieces and columns."""
    pieces: list[Column] = []
    rest = template
    while rest:
        i = rest.find("{")
        j = rest.find("}", i)
        if i < 0 or j < 0 or rest[i + 1:j] not in parts:
            pieces.append(F.lit(rest))
            break
        if i:
            pieces.append(F.lit(rest[:i]))
        pieces.append(parts[rest[i + 1:j]])
        rest = rest[j + 1:]
    return F.concat(*pieces)


def render_prompts(merged: DataFrame, source_files: DataFrame, contexts_xml: DataFrame | None = None,
                   tool_col: str | None = "tool") -> tuple[DataFrame, DataFrame]:
    """T3 + F4: one prompt per merged file; blank input -> rejects (EMPTY_SNIPPET).

    ``contexts_xml`` (repo, scan_id, path, start_line, xml) adds the structured
    context section for the matching (path, start_line)."""
    files = source_files.select("repo", "path", "content", "lines")
    # contexts before texts: what moves for the contexts' keys has no text yet
    if contexts_xml is not None:
        j = merged.join(contexts_xml.select("repo", "scan_id", "path", "start_line", "xml"),
                        ["repo", "scan_id", "path", "start_line"], "left")
    else:
        j = merged.withColumn("xml", F.lit(None).cast("string"))
    j = j.join(files, ["repo", "path"], "left")
    tool = F.col(tool_col) if tool_col and tool_col in merged.columns else None
    inp = F.coalesce(input_text(tool), F.lit(""))
    ctx = F.when(F.col("xml").isNotNull() & (F.col("xml") != ""), _fill(CONTEXT_SECTION, xml=F.col("xml"))).otherwise(F.lit(""))
    prompt = _fill(FIX_TEMPLATE, input=inp, vulnerabilities=vulnerabilities_text(), context=ctx)
    blank = pystrip(inp) == ""
    out = j.where(~blank).select("repo", "scan_id", "path", F.lit("fix").alias("kind"),
                                 F.lit(FIX_TITLE).alias("title"), prompt.alias("prompt"))
    rej = j.where(blank).select("repo", "scan_id", F.lit("prompt").alias("stage"), F.col("path").alias("key"),
                                F.lit(EMPTY_SNIPPET[0]).alias("code"), F.lit(EMPTY_SNIPPET[1]).alias("message"))
    return out, rej


def context_xml(ctx_rows: DataFrame) -> DataFrame:
    """The VULNERABILITY element text of each context (``to_xml``) for prompt embedding."""
    from findrift.operators.context import to_xml_rows
    x = to_xml_rows(ctx_rows)
    body = F.struct(*[c for c in x.columns if c not in ("repo", "scan_id")])
    return x.select("repo", "scan_id", F.col("FILE._path").alias("path"), F.col("RANGE._start").alias("start_line"),
                    F.to_xml(body, {"rowTag": "VULNERABILITY"}).alias("xml"))


def render_retry_prompts(parsed: DataFrame, language: str = "javascript") -> DataFrame:
    """Second-pass prompt over parsed code (language is a parameter)."""
    name, comment = RETRY_LANGS.get(language, (language.capitalize(), "#"))
    t = RETRY_TEMPLATE.replace("{lang_name}", name).replace("{lang}", language).replace("{comment}", comment)
    return parsed.select("repo", "scan_id", "path", F.lit("retry").alias("kind"), F.lit(RETRY_TITLE).alias("title"),
                         _fill(t, input=F.col("code")).alias("prompt"))


def chat_requests(prompts: DataFrame, model: str = DEFAULT_MODEL, temperature: float = TEMPERATURE) -> DataFrame:
    """One batch request body per prompt (system + user message)."""
    body = F.struct(
        F.lit(model).alias("model"),
        F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_MESSAGE).alias("content")),
                F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("messages"),
        F.lit(temperature).alias("temperature"))
    return prompts.select("repo", "scan_id", "path", "kind", F.to_json(body).alias("request"))


# ----------------------------------------------------------------- S6
RESPONSE_LAYOUT = r"([^/]+)/([^/]+)/([^/]+\.md)$"


def read_responses(spark: SparkSession, path: str, layout: str = RESPONSE_LAYOUT, glob: str = "*.md") -> DataFrame:
    """Every ``response_*.md`` under ``path`` (by default <repo>/<scan_id>/file;
    ``layout`` finds the three in a file's path); the finding path is decoded from
    the file name.  Names without the prefix give a null path (reported by callers
    as a parse reject)."""
    df = read_small_files(spark, path, glob).select(F.col("content").cast("string").alias("content"), "file_path")
    repo, scan_id, name = (F.regexp_extract("file_path", layout, i) for i in (1, 2, 3))
    return df.select(repo.alias("repo"), scan_id.alias("scan_id"), name.alias("file_name"), "content").select(
        "repo", "scan_id", decode_key("file_name").alias("path"), "file_name", "content")


# ----------------------------------------------------------------- T1
def extract_code_blocks(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All ```py / ```python blocks (case-insensitive, lazy), each stripped,
    joined by a blank line; none -> rejects row."""
    blocks = F.regexp_extract_all(F.col("content"), F.lit(CODE_BLOCK), 1)
    x = responses.select("repo", "scan_id", "path", blocks.alias("blocks"))
    out = x.where(F.size("blocks") > 0).select(
        "repo", "scan_id", "path", F.array_join(F.transform("blocks", pystrip), "\n\n").alias("code"),
        F.size("blocks").alias("n_blocks"))
    rej = x.where(F.size("blocks") == 0).select(
        "repo", "scan_id", F.lit("parse").alias("stage"), F.col("path").alias("key"),
        F.lit(NO_CODE_BLOCK[0]).alias("code"), F.lit(NO_CODE_BLOCK[1]).alias("message"))
    return out, rej


# ----------------------------------------------------------------- T2a / T2b
#: Put before each heading, with its number; where a text has it, it is followed by an x.
_MARK = "\ue000"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def sections(content: Column, headings: dict[str, str]) -> Column:
    """The four sections of an answer as a struct, null where it lacks a heading.

    Headings are marked and the text is cut at the marks; a few passes over the
    cuts' numbers take the first heading 1, the first 2 after it, then 3 and 5,
    so that all are found; what follows a heading up to the next one taken
    (section 3: or a heading 4 before that) is its section.  Nothing is tried
    twice, so the time is linear in the text.

    A heading that needs a line of its own does not end an empty section before
    it if a later one can: the white space after a heading belongs to it.  A number
    on the line above such a heading belongs to it too."""
    marked = F.replace(content, F.lit(_MARK), F.lit(_MARK + "x"))
    for number, pattern in headings.items():
        marked = F.regexp_replace(marked, pattern, f"{_MARK}{number}$0")
    own_line = "4" not in headings

    def headless(cut: Column, number: str) -> Column:
        own = "^" + number + "(?:" + headings[number].replace(r"\A", "") + r")\s*+[:：]?"
        return F.regexp_replace(cut, own, "")

    def places(cuts: Column, number: str) -> Column:
        at = F.transform(cuts, lambda c, i: F.when((i > 0) & c.startswith(number), i))
        return F.filter(at, lambda i: i.isNotNull())

    def before(at: Column, end: Column) -> Column:
        return F.filter(at, lambda i: i < end)

    def next_of(cuts: Column, at: Column, h: Column, number: str) -> Column:
        after = lambda n: F.array_min(F.filter(at, lambda i: i > h + n))
        if not own_line:
            return after(0)
        return F.when(pystrip(headless(F.get(cuts, h), number)) == "", F.coalesce(after(1), after(0))).otherwise(after(0))

    def text(cuts: Column, number: str, first: Column, last: Column) -> Column:
        """Cuts first..last - 1 put together, without marks and without the heading that opens them."""
        parts = F.transform(F.slice(cuts, first + 1, last - first), lambda c, i: F.when(i == 0, headless(c, number)).otherwise(F.substring(c, 2, 2**31 - 1)))
        return pystrip(F.replace(F.array_join(parts, ""), F.lit(_MARK + "x"), F.lit(_MARK)))

    def of_cuts(cuts: Column) -> Column:
        def found(p: Column) -> Column:
            # headings from which on the rest can still be found
            return _let(before(p["p3"], F.array_max(p["p5"])), lambda p3: _let(before(p["p2"], F.array_max(p3)), lambda p2: _let(
                F.array_min(before(p["p1"], F.array_max(p2))), lambda h1: _let(next_of(cuts, p2, h1, "1"), lambda h2: _let(
                    next_of(cuts, p3, h2, "2"), lambda h3: _let(next_of(cuts, p["p5"], h3, "3"), lambda h5: taken(p, h1, h2, h3, h5)))))))

        def taken(p: Column, h1: Column, h2: Column, h3: Column, h5: Column) -> Column:
            end3 = h5 if own_line else F.coalesce(F.array_min(F.filter(p["p4"], lambda i: (i > h3) & (i < h5))), h5)
            spans = (("1", h1, h2), ("2", h2, h3), ("3", h3, end3), ("5", h5, F.size(cuts)))
            return F.when(h5.isNotNull(), F.struct(*[text(cuts, k, a, z).alias(n) for (k, a, z), n in zip(spans, SECTION_NAMES, strict=True)]))

        return _let(F.struct(*[places(cuts, k).alias(f"p{k}") for k in headings]), found)

    return _let(F.split(marked, _MARK + "(?=[1-5])", -1), of_cuts)


def sections_strict(responses: DataFrame) -> DataFrame:
    """Numbered headings 1/2/3/(4)/5; no match -> four empty strings."""
    c = F.col("content")
    held = F.lit(True)  # plain searches first
    for heading in (h for k, h in STRICT_HEADINGS.items() if k != "4"):
        held = held & c.contains(heading.replace("\\", ""))
    x = responses.select("repo", "scan_id", "path", F.when(held, sections(c, STRICT_HEADINGS)).alias("s"))
    return x.select("repo", "scan_id", "path", *[F.coalesce(f"s.{n}", F.lit("")).alias(n) for n in SECTION_NAMES])


def _grab(label_variants: list[str]) -> Column:
    out = F.lit("")
    for label in reversed(label_variants):
        p = heading_pattern(label)
        out = F.when(F.col("content").rlike(p), pystrip(F.regexp_extract(F.col("content"), p, 1))).otherwise(out)
    return out


def sections_relaxed(responses: DataFrame) -> DataFrame:
    """Numbered pattern, else un-numbered pattern, else per-heading blocks.
    The tier is chosen by *match* (a matched-but-empty section stays empty).

    Both are looked for only in answers that hold the headings they need, in any
    order, and the second only where the first fails."""
    low = F.lower(F.col("content"))
    three = low.contains("vulnerability description") & low.contains("potential risk") & low.contains("recommended fix") \
        & (low.contains("additional notes") | low.contains("references"))
    c = F.col("content")
    x = responses.select("repo", "scan_id", "path", "content", three.alias("three"), F.when(three, sections(c, NUMBERED_HEADINGS)).alias("s1"))
    x = x.withColumn("s2", F.when(F.col("three") & F.col("s1").isNull(), sections(c, PLAIN_HEADINGS)))
    tier = F.when(F.col("s1").isNotNull(), 1).when(F.col("s2").isNotNull(), 2).otherwise(3)
    return x.select("repo", "scan_id", "path", tier.alias("tier"), *[
        F.when(F.col("s1").isNotNull(), F.col(f"s1.{n}")).when(F.col("s2").isNotNull(), F.col(f"s2.{n}"))
         .otherwise(_grab(HEADING_LABELS[n])).alias(n) for n in SECTION_NAMES])


# ----------------------------------------------------------------- A9 / J5
def token_usage(responses: DataFrame) -> DataFrame:
    """Token totals per (repo, scan_id)."""
    return responses.groupBy("repo", "scan_id").agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"))


def attach_sections(file_groups: DataFrame, sections: DataFrame) -> DataFrame:
    """File groups left-join their response sections on (repo, scan_id, path)."""
    return file_groups.join(sections, ["repo", "scan_id", "path"], "left")
