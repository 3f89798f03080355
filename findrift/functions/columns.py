"""Scalar Column -> Column functions (string, array, JSON, hash).

All of these compile to built-in Catalyst expressions, so they stay inside
whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for identical output.
# Severity rank used by the per-file merge: INFO 0 < WARNING 1 < ERROR 2, others -1.
SEVERITY_RANK = {"INFO": 0, "WARNING": 1, "ERROR": 2}
# Report labels for the three counted levels; any other level is shown unchanged.
SEVERITY_LABELS = {"ERROR": "\U0001f6d1 ERROR", "WARNING": "⚠️ WARNING", "NOTE": "\U0001f4a1 NOTE"}

# Characters Python's str.splitlines() treats as line boundaries (besides \n).
_SPLIT_BREAKS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pystrip(c: Column | str) -> Column:
    """Python ``str.strip()``: trims all Unicode whitespace (Spark ``trim`` only trims spaces)."""
    return F.regexp_replace(col(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def split_lines(c: Column | str) -> Column:
    """Python ``str.splitlines()`` as an array: '' -> [], one trailing break dropped.

    One regex split over the text; the split result is bound once (through a
    one-element ``transform``) so the trailing-break test does not re-split."""
    parts = F.split(col(c), _SPLIT_BREAKS, -1)
    return F.when(col(c) == "", F.array().cast("array<string>")).otherwise(F.get(F.transform(
        F.array(parts),
        lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a)), 0))


def read_lines(c: Column | str) -> Column:
    """``readlines()``: line texts with their newline kept (universal newlines)."""
    t = F.regexp_replace(col(c), "\r\n?", "\n")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(
        F.regexp_extract_all(t, F.lit(r"([^\n]*\n|[^\n]+$)"), 1))


# ---------------------------------------------------------------- P1, P2
def normalize_path(raw: Column | str, base: str | None = None) -> Column:
    """Trim, backslash -> slash, strip ``base`` at a '/' boundary, left-strip '/'."""
    p = F.regexp_replace(pystrip(raw), r"\\", "/")
    if base:
        b = base.replace("\\", "/").rstrip("/")
        p = (F.when(p == b, F.lit(""))
             .when(p.startswith(b + "/"), F.substr(p, F.lit(len(b) + 2)))
             .otherwise(p))
    return F.regexp_replace(p, r"^/+", "")


def ensure_list(v: Column | str, path: str) -> Column:
    """Variant field that is absent/null -> [], list -> itself, scalar -> [scalar]."""
    vv = col(v)
    as_arr = F.try_variant_get(vv, path, "array<string>")
    as_str = F.try_variant_get(vv, path, "string")
    return F.coalesce(as_arr, F.when(as_str.isNotNull(), F.array(as_str)), F.array().cast("array<string>"))


# ---------------------------------------------------------------- P3
def slice_text(lines: Column, s: Column, e: Column, sep: str = "\n") -> Column:
    """Lines s..e (1-based, inclusive) joined by ``sep``; caller guards the range."""
    return F.array_join(F.slice(lines, s, e - s + 1), sep)


# ---------------------------------------------------------------- P4 - P7
def cwe_from_tags(tags: Column, tool: str) -> Column:
    """CodeQL keeps tags containing 'cwe-' (case-sensitive); Snyk any case of 'cwe'.
    Keeps the last '/' segment and rewrites 'cwe-' to 'CWE-'."""
    if tool == "codeql":
        keep = lambda t: t.contains("cwe-")
    else:
        keep = lambda t: F.lower(t).contains("cwe")
    return F.transform(F.filter(F.coalesce(tags, F.array().cast("array<string>")), keep),
                       lambda t: F.replace(F.element_at(F.split(t, "/"), -1), F.lit("cwe-"), F.lit("CWE-")))


def cwe_short(c: Column | str) -> Column:
    """Text before the first ':'."""
    return F.split_part(col(c), F.lit(":"), F.lit(1))


def class_from_rule(rule_id: Column | str) -> Column:
    """P5: [rule id after the first '/'] (whole id if there is no '/'), [] if no id."""
    r = col(rule_id)
    return F.when((r.isNull()) | (r == ""), F.array().cast("array<string>")).otherwise(
        F.array(F.regexp_replace(r, r"^[^/]*/", "")))


def references_from_help(help_uri: Column | str) -> Column:
    """[helpUri] if truthy else []."""
    h = col(help_uri)
    return F.when(h.isNotNull() & (h != ""), F.array(h)).otherwise(F.array().cast("array<string>"))


def severity_rank(sev: Column | str) -> Column:
    s = F.upper(col(sev))
    expr = F.lit(-1)
    for name, rank in SEVERITY_RANK.items():
        expr = F.when(s == name, F.lit(rank)).otherwise(expr)
    return expr


# ---------------------------------------------------------------- P8 - P15
def severity_pair(sev: Column | str) -> Column:
    """Upper-cased severity, empty/null -> UNKNOWN."""
    return F.coalesce(F.nullif(F.upper(col(sev)), F.lit("")), F.lit("UNKNOWN"))


def severity_label(sev: Column | str) -> Column:
    """Icon label for ERROR/WARNING/NOTE; other values unchanged; empty -> N/A."""
    s = F.upper(col(sev))
    out = F.when(s.isNull() | (s == ""), F.lit("N/A"))
    for name, label in SEVERITY_LABELS.items():
        out = out.when(s == name, F.lit(label))
    return out.otherwise(s)


def line_label(s: Column | str, e: Column | str) -> Column:
    """P10: 's' or 's~e'."""
    s, e = col(s), col(e)
    return F.when(s == e, s.cast("string")).otherwise(F.concat_ws("~", s.cast("string"), e.cast("string")))


def step_text(path: Column | str, s: Column | str, e: Column | str) -> Column:
    """Review step sentence."""
    s, e, p = col(s), col(e), col(path)
    return F.when(s == e, F.format_string("Review line %s in %s", s, p)).otherwise(
        F.format_string("Review lines %s-%s in %s", s, e, p))


def message_items(msg: Column | str) -> Column:
    """Split on '|' when ' | ' occurs, strip, drop empties; else [msg]."""
    m = F.coalesce(col(msg), F.lit(""))
    pieces = F.filter(F.transform(F.split(m, r"\|", -1), pystrip), lambda x: x != "")
    return F.when(m.contains(" | "), pieces).otherwise(F.array(m))


def trigger_text(trigger: Column | str, msg: Column | str) -> Column:
    """First non-empty stripped '|' piece of the trigger (the stripped trigger
    if none); when that is empty, the stripped message cut at its first '|',
    newline or '. '."""
    t = F.coalesce(col(trigger), F.lit(""))
    first_piece = F.get(F.filter(F.transform(F.split(t, r"\|", -1), pystrip), lambda x: x != ""), 0)
    trig = F.when(t != "", F.coalesce(first_piece, pystrip(t))).otherwise(F.lit(""))
    m = pystrip(F.coalesce(col(msg), F.lit("")))
    cut = pystrip(F.regexp_extract(m, r"^([^|\n]*?)(?:\||\n|\. |$)", 1))
    return F.when((trig == "") & (m != ""), cut).otherwise(trig)


# Path parts dropped when a path is encoded into a response file name (fixed values).
KEY_DROP_PARTS = ("artifacts", "downloaded_repo")
KEY_SEP = "‣"


def encode_key(path: Column | str) -> Column:
    """Response file name for a path: parts joined by the triangle bullet."""
    parts = F.filter(F.split(col(path), "/"), lambda x: ~x.isin(*KEY_DROP_PARTS))
    return F.concat(F.lit("response_"), F.array_join(parts, KEY_SEP), F.lit(".md"))


def decode_key(name: Column | str) -> Column:
    """P14 inverse: null unless the name has the response_ prefix and .md suffix."""
    inner = F.regexp_extract(col(name), r"^response_(.*)\.md$", 1)
    return F.when(col(name).rlike(r"^response_.*\.md$"), F.replace(inner, F.lit(KEY_SEP), F.lit("/")))


def md_cell(s: Column | str, n: int) -> Column:
    """Markdown-safe table cell: escape '|', newline -> space, strip, cut to n with an ellipsis."""
    t = pystrip(F.replace(F.replace(F.coalesce(col(s), F.lit("")), F.lit("|"), F.lit("\\|")),
                          F.lit("\n"), F.lit(" ")))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("…"))).otherwise(t)


# ---------------------------------------------------------------- P16 - P19
def repo_from_url(url: Column | str) -> Column:
    """struct(owner, name, error) from a repository URL: the first two
    segments of the URL path stripped of '/', '.git' removed from the name.
    Fewer than two segments gives an error value, not an exception."""
    path = F.coalesce(F.try_parse_url(col(url), F.lit("PATH")), F.lit(""))
    segs = F.split(F.regexp_replace(path, r"^/+|/+$", ""), "/", -1)
    ok = F.size(segs) >= 2
    owner = F.when(ok, F.get(segs, 0))
    name = F.when(ok, F.regexp_replace(F.get(segs, 1), r"\.git$", ""))
    return F.struct(owner.alias("owner"), name.alias("name"),
                    F.when(~ok, F.lit("invalid repository URL")).alias("error"))


def repo_name_from_url(url: Column | str) -> Column:
    """P16 (summary variant): last segment of the URL path stripped of '/'."""
    path = F.coalesce(F.try_parse_url(col(url), F.lit("PATH")), F.lit(""))
    return F.element_at(F.split(F.regexp_replace(path, r"^/+|/+$", ""), "/", -1), -1)


def upstream_from_url(url: Column | str, host_prefix: str = "https://github.com/") -> Column:
    """P16 (publish variant): struct(owner, name, error) for URLs that start with
    ``host_prefix``; the first two segments after it, error value otherwise."""
    u = col(url)
    rest = F.split(F.substr(u, F.lit(len(host_prefix) + 1)), "/", -1)
    on_host = u.startswith(host_prefix)
    ok = on_host & (F.size(rest) >= 2)
    return F.struct(F.when(ok, F.get(rest, 0)).alias("owner"), F.when(ok, F.get(rest, 1)).alias("name"),
                    F.when(~on_host, F.lit("not a repository host URL"))
                     .when(~ok, F.lit("invalid repository URL")).alias("error"))


def repo_hash(fields: dict[str, Column]) -> Column:
    """sha256 of the JSON object of ``fields`` with keys in sorted order."""
    body = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.sha2(body, 256)


def contains_all(text: Column | str, keywords: Sequence[str]) -> Column:
    """Every keyword is a substring of text."""
    t = col(text)
    out = F.lit(True)
    for k in keywords:
        out = out & t.contains(k)
    return out


def row_parts(parts: Sequence[Column], sep: str = " | ") -> Column:
    """Markdown table row from cells; null cells (optional columns) are left out."""
    return F.concat(F.lit("| "), F.array_join(F.array_compact(F.array(*parts)), sep), F.lit(" |"))
