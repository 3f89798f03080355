"""DuckDB oracle SQL for the registered queries.

Each oracle recomputes the answer straight from the driver's base tables
(pre-registered views) by a different route from the Spark code: no JSON is
built or parsed here, the expected values follow from the recipe formulas.
Arrays are compared as ';'-joined strings.
"""

from __future__ import annotations

# Common CTEs: documents -> files, events -> scanner results (see fixtures.py).
from findrift.plans.fixtures import PART_EVENTS, RUN_EVENTS  # noqa: E402

BASE = r"""
d AS (
  SELECT doc_id, source AS repo,
         'src/' || lang || '/doc_' || CAST(doc_id AS VARCHAR) || '.py' AS path,
         text AS content,
         CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(text, '\n$', ''), chr(10)) END AS lines
  FROM documents),
ev AS (
  SELECT e.event_id, e.user_id, e.event_type, e.ts,
         CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS k,
         d.doc_id, d.repo, d.path, d.lines, CAST(len(d.lines) AS INTEGER) AS n_lines
  FROM events e JOIN d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)),
se AS (
  SELECT *, ['semgrep', 'codeql', 'snykcode'][CAST(event_id % 3 AS INTEGER) + 1] AS tool,
         CAST(1 + user_id % n_lines AS INTEGER) AS start_line
  FROM ev),
sc AS (
  SELECT *, CAST(least(n_lines, start_line + event_id % 3) AS INTEGER) AS end_line,
         repo || '-' || tool AS scan_id,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING'
              WHEN 'signup' THEN 'NOTE' WHEN 'view' THEN 'INFO' ELSE '' END AS severity,
         'Possible ' || event_type || ' issue k=' || CAST(k AS VARCHAR) AS message,
         event_id // @PART@ AS part, (event_id // @RUN@) % 2 AS run_pos
  FROM se),
f AS (
  SELECT repo, scan_id, event_id AS ordinal, tool, path, start_line, end_line,
         array_to_string(list_slice(lines, start_line, end_line), chr(10)) AS snippet, message,
         [event_type] AS vulnerability_class,
         ['CWE-' || CAST(k % 7 AS VARCHAR)] AS cwe, severity,
         ['https://refs.example.org/' || CAST(k % 5 AS VARCHAR)] AS refs,
         event_type, k, user_id, ts
  FROM sc)
"""
BASE = BASE.replace("@PART@", str(PART_EVENTS)).replace("@RUN@", str(RUN_EVENTS))

from findrift.functions import branding as _B  # noqa: E402
from findrift.operators import publish as _PB  # noqa: E402

RANK = "CASE upper(severity) WHEN 'INFO' THEN 0 WHEN 'WARNING' THEN 1 WHEN 'ERROR' THEN 2 ELSE -1 END"


def arr(expr: str) -> str:
    return f"array_to_string({expr}, ';')"


def merge_sql(src: str) -> str:
    """A1 over a CTE ``src`` with finding columns (refs = references)."""
    return f"""
sl AS (SELECT repo, scan_id, path,
              unnest(string_split(regexp_replace(snippet, '\\n$', ''), chr(10))) AS line
       FROM {src} WHERE snippet <> ''),
sg AS (SELECT repo, scan_id, path, string_agg(DISTINCT line, chr(10) ORDER BY line) AS snippet
       FROM sl GROUP BY repo, scan_id, path),
mg AS (SELECT repo, scan_id, path, min(tool) AS tool, min(ordinal) AS first_ordinal, count(*) AS n_findings,
              min(start_line) AS start_line, max(end_line) AS end_line,
              coalesce(string_agg(DISTINCT message, ' | ' ORDER BY message) FILTER (WHERE message <> ''), '') AS message,
              list_sort(list_distinct(flatten(list(vulnerability_class)))) AS vulnerability_class,
              list_sort(list_distinct(flatten(list(cwe)))) AS cwe,
              coalesce(arg_max(upper(severity), ({RANK}, -ordinal)) FILTER (WHERE severity <> ''), '') AS severity,
              list_sort(list_distinct(flatten(list(refs)))) AS refs
       FROM {src} GROUP BY repo, scan_id, path),
merged AS (SELECT mg.*, coalesce(sg.snippet, '') AS snippet
           FROM mg LEFT JOIN sg USING (repo, scan_id, path))
"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n"


A1 = with_(BASE, merge_sql("f")) + f"""
SELECT repo, scan_id, path, tool, first_ordinal, n_findings, start_line, end_line, snippet, message,
       {arr('vulnerability_class')} AS vulnerability_class, {arr('cwe')} AS cwe, severity,
       {arr('refs')} AS "references"
FROM merged
"""

STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"

# Scanner-side view of each result (reject paths, SARIF region/level rules).
SCAN = r"""
sv0 AS (
  SELECT * REPLACE (CASE WHEN tool = 'codeql' AND repo IN ('src0', 'src1') THEN 'shared-codeql' ELSE scan_id END AS scan_id)
  FROM sc),
sv AS (
  SELECT *, CASE WHEN event_id % 50 = 0 THEN 'missing/' || path ELSE path END AS raw_path,
         CAST(CASE WHEN event_id % 50 = 1 THEN n_lines + 1 ELSE start_line END AS INTEGER) AS raw_start,
         row_number() OVER (PARTITION BY repo, scan_id, part ORDER BY event_id) - 1 AS file_pos,
         row_number() OVER (PARTITION BY repo, scan_id, part, run_pos ORDER BY event_id) - 1 AS run_item,
         dense_rank() OVER (PARTITION BY repo, scan_id, part ORDER BY run_pos) - 1 AS run_idx,
         max(part * 2 + run_pos) OVER (PARTITION BY repo, scan_id, part) AS last_run
  FROM sv0),
sarif AS (
  SELECT *, CASE WHEN event_id % 9 = 0 THEN raw_start ELSE end_line END AS raw_end2,
         (part << 40) + (run_idx << 24) + run_item AS ordinal,
         CASE WHEN severity IN ('ERROR', 'WARNING', 'NOTE') AND event_id % 4 <> 0 THEN severity END AS res_level
  FROM sv WHERE tool <> 'semgrep'),
rules(event_type, codeql_cwe, snyk_cwe, help, lvl) AS (VALUES
  ('signup', 'CWE-01', 'CWE-01', 'https://rules.example.org/signup', 'note'),
  ('purchase', 'CWE-02', 'CWE-02;CWE-89', 'https://rules.example.org/purchase', 'warning'),
  ('error', 'CWE-03', 'CWE-03', 'https://rules.example.org/error', 'error'),
  ('view', 'CWE-04', 'CWE-04', '', 'recommendation'),
  ('click', 'CWE-05', 'CWE-05', NULL, 'UNKNOWN'))
"""

SEMGREP_ROWS = f"""
SELECT repo, scan_id, (part << 40) + file_pos AS ordinal, tool, CAST(file_pos AS INTEGER) AS idx,
       raw_path AS path, raw_start AS start_line, end_line,
       CASE WHEN raw_start > 0 AND raw_start <= end_line AND end_line <= n_lines
            THEN array_to_string(list_slice(lines, raw_start, end_line), chr(10)) ELSE '' END AS snippet,
       message, event_type AS vulnerability_class,
       CASE WHEN k % 11 = 0 THEN '' ELSE 'CWE-' || CAST(k % 7 AS VARCHAR) END AS cwe,
       severity, 'https://refs.example.org/' || CAST(k % 5 AS VARCHAR) AS "references"
FROM sv WHERE tool = 'semgrep' AND event_id % 50 <> 0
"""

S2 = with_(BASE, SCAN) + SEMGREP_ROWS

CODEQL_CTE = f"""
cq AS (
  SELECT s.*, r.codeql_cwe, r.help, upper(coalesce(s.res_level, r.lvl)) AS sev2,
         list_slice(lines, raw_start, CASE WHEN raw_end2 > raw_start THEN raw_end2 ELSE raw_start END) AS region
  FROM sarif s JOIN rules r USING (event_type) WHERE tool = 'codeql'),
cq2 AS (
  SELECT *, event_id % 50 <> 0 AS file_exists,
         raw_start BETWEEN 1 AND n_lines AND list_bool_or(list_transform(region, lambda x: {STRIP.format(x='x')} <> '')) AS ok_region
  FROM cq),
cq3 AS (
  SELECT *, row_number() OVER (PARTITION BY repo, scan_id, part ORDER BY run_pos, event_id) - 1 AS kept_idx
  FROM cq2 WHERE NOT file_exists OR coalesce(ok_region, false))
"""

CODEQL_ROWS = f"""
SELECT repo, scan_id, ordinal, tool, CAST(kept_idx AS INTEGER) AS idx, raw_path AS path,
       raw_start AS start_line, CAST(raw_end2 AS INTEGER) AS end_line,
       CASE WHEN file_exists THEN {STRIP.format(x="array_to_string(region, chr(10))")} ELSE '' END AS snippet,
       message, 'error' AS _x, sev2 AS severity, event_type AS vulnerability_class, codeql_cwe AS cwe,
       CASE WHEN event_type = 'error' THEN help || '/run' || CAST(last_run AS VARCHAR) ELSE coalesce(help, '') END AS "references"
FROM cq3
""".replace("message, 'error' AS _x,", "message,")
S3_CODEQL = with_(BASE, SCAN, CODEQL_CTE) + CODEQL_ROWS

SNYK_ROWS = f"""
SELECT s.repo, s.scan_id, s.ordinal, s.tool, CAST(s.run_item AS INTEGER) AS idx, s.raw_path AS path,
       s.raw_start AS start_line, CAST(s.raw_end2 AS INTEGER) AS end_line,
       CASE WHEN s.raw_start >= 1 AND s.raw_end2 >= s.raw_start
            THEN {STRIP.format(x="array_to_string(list_slice(s.lines, s.raw_start, s.raw_end2), chr(10))")} ELSE '' END AS snippet,
       s.message, coalesce(s.res_level, '') AS severity, s.event_type AS vulnerability_class, r.snyk_cwe AS cwe,
       CASE WHEN s.event_type = 'error' THEN r.help || '/run' || CAST(s.part * 2 + s.run_pos AS VARCHAR) ELSE coalesce(r.help, '') END AS "references"
FROM sarif s JOIN rules r USING (event_type)
WHERE s.tool = 'snykcode' AND s.event_id % 50 <> 0
"""
S3_SNYK = with_(BASE, SCAN) + SNYK_ROWS

UNION_CTE = f"""
u AS ({SEMGREP_ROWS} UNION ALL BY NAME {CODEQL_ROWS} UNION ALL BY NAME {SNYK_ROWS})
"""
O4 = with_(BASE, SCAN, CODEQL_CTE, UNION_CTE) + "SELECT * FROM u"
O5 = with_(BASE, SCAN, CODEQL_CTE, UNION_CTE) + """
SELECT repo, path, vulnerability_class AS cls, count(DISTINCT tool) AS n_tools,
       string_agg(DISTINCT tool, ';' ORDER BY tool) AS tools
FROM u GROUP BY repo, path, vulnerability_class
"""

J2 = with_(BASE, SCAN) + """
SELECT s.repo, s.scan_id, s.part, 'py/' || r.event_type AS rule_id, r.codeql_cwe AS cwe,
       CASE WHEN r.event_type = 'error' THEN r.help || '/run' || CAST(s.last_run AS VARCHAR) ELSE coalesce(r.help, '') END AS "references",
       r.lvl AS level
FROM (SELECT DISTINCT repo, scan_id, part, last_run FROM sv WHERE tool = 'codeql') s, rules r
"""

REJECTS = with_(BASE, SCAN, CODEQL_CTE) + """
SELECT repo, scan_id, 'ingest' AS stage, raw_path AS key, 'FILE_NOT_FOUND' AS code, 'File not found: ' || raw_path AS message
FROM sv WHERE tool = 'semgrep' AND event_id % 50 = 0
UNION ALL
SELECT repo, scan_id, 'ingest', raw_path || ':' || CAST(raw_start AS VARCHAR), 'INVALID_REGION',
       'start line outside file or blank region; dropped'
FROM cq2 WHERE file_exists AND NOT coalesce(ok_region, false)
UNION ALL
SELECT repo, scan_id, 'ingest', raw_path, 'SOURCE_MISSING', 'source file missing; dropped'
FROM sv WHERE tool = 'snykcode' AND event_id % 50 = 0
UNION ALL
SELECT 'src' || CAST(item_id % 20 AS VARCHAR), 'src' || CAST(item_id % 20 AS VARCHAR) || '-' || t.tool, 'ingest',
       t.tool || ' part ' || CAST(1000000 + item_id AS VARCHAR), 'MALFORMED_DOCUMENT',
       'scanner output is not a valid document; dropped'
FROM benchmark, (VALUES ('semgrep'), ('codeql'), ('snykcode')) t(tool)
"""

ORACLES: dict[str, str] = {
    "a1_merge_findings_by_file": A1,
    "s2_semgrep_findings": S2,
    "s3_codeql_findings": S3_CODEQL,
    "s3_snyk_findings": S3_SNYK,
    "s2_semgrep_chunks": S2,
    "s3_codeql_chunks": S3_CODEQL,
    "s3_snyk_chunks": S3_SNYK,
    "f2_chunk_rejects": REJECTS,
    "j2_attach_rules": J2,
    "f2_rejects": REJECTS,
    "o4_union_tools": O4,
    "o5_tool_agreement": O5,
}


# --------------------------------------------------------------------------- M2 / M3
SEV_PAIR = "coalesce(nullif(upper(severity), ''), 'UNKNOWN')"
STEP = ("CASE WHEN start_line = end_line THEN 'Review line ' || CAST(start_line AS VARCHAR) || ' in ' || path "
        "ELSE 'Review lines ' || CAST(start_line AS VARCHAR) || '-' || CAST(end_line AS VARCHAR) || ' in ' || path END")

CTX_FLAT = with_(BASE, merge_sql("f")) + f"""
SELECT repo, scan_id, path, start_line,
       path || ':' || CAST(start_line AS VARCHAR) || '-' || CAST(end_line AS VARCHAR) AS id, end_line,
       {SEV_PAIR} AS severity_overall, {SEV_PAIR} AS severity_bit,
       CASE WHEN NOT contains(message, ' | ') THEN message END AS message_text,
       CASE WHEN contains(message, ' | ') THEN array_to_string(list_filter(list_transform(
            string_split(message, '|'), lambda x: {STRIP.format(x='x')}), lambda x: x <> ''), ';') END AS message_items,
       snippet,
       CASE WHEN message <> '' THEN message ELSE 'Vulnerability detected.' END AS trigger,
       {STEP} AS steps,
       'Inspect the indicated code region and verify unsafe data flow or pattern.' AS reproduction,
       {SEV_PAIR} AS bit_severity,
       CASE WHEN len(vulnerability_class) > 0 THEN {arr('vulnerability_class')} END AS classes,
       CASE WHEN len(cwe) > 0 THEN {arr('cwe')} END AS weaknesses,
       CASE WHEN len(refs) > 0 THEN {arr('refs')} END AS "references",
       'Authenticated user may be required depending on route.' AS preconditions,
       'unknown' AS env_node,
       'Apply minimal changes: sanitize inputs, use parameterized APIs, and enforce allowlists.' AS mitigation,
       true AS tracking
FROM merged
"""

A2 = with_(BASE) + """
SELECT repo, scan_id, type, count,
       CAST(row_number() OVER (PARTITION BY repo, scan_id ORDER BY first_seen) AS INTEGER) AS class_pos,
       CAST(sum(count) OVER (PARTITION BY repo, scan_id) AS BIGINT) AS vulnerabilities
FROM (SELECT repo, scan_id, vulnerability_class[1] AS type, count(*) AS count, min(ordinal) AS first_seen
      FROM f WHERE len(vulnerability_class) > 0 GROUP BY repo, scan_id, vulnerability_class[1])
"""

W2 = with_(BASE) + """
SELECT repo, scan_id, path, min(ordinal) AS first_ordinal,
       row_number() OVER (PARTITION BY repo, scan_id ORDER BY min(ordinal)) AS file_no
FROM f GROUP BY repo, scan_id, path
"""

A4 = with_(BASE, merge_sql("f")) + f"""
SELECT repo, scan_id, '{_B.NAME}' AS tool, count(*) AS count, '1970-01-01T00:00:00+00:00' AS generatedAt
FROM merged GROUP BY repo, scan_id
"""

F5 = with_(BASE, merge_sql("f")) + """
SELECT repo, scan_id, path, true AS is_valid, '' AS errors, 'v1.1' AS flavor FROM merged
UNION ALL
SELECT repo, scan_id, path, false, 'SEVERITY@bit is required;BIT is required', 'v1.0' FROM merged
"""

# fixed texts of the rules, in the order in which the recipe breaks them
_RULES = ("VULNERABILITY@id is required", "FILE@path is required", "RANGE@start must be a positive integer", "RANGE@end must be a positive integer",
          "SEVERITY@overall is required", "SEVERITY@bit is required", "MESSAGE is required", "MESSAGES needs at least one ITEM", "SNIPPET is required",
          "BIT is required", "BIT/TRIGGER is required", "BIT/STEPS needs at least one STEP", "BIT/REPRODUCTION is required", "BIT/BIT_SEVERITY is required",
          "CLASSES needs at least one CLASS", "CWE@id is required", "REF@href is required", "PRECONDITIONS needs at least one ITEM")
F5_BROKEN = with_(BASE, merge_sql("f")) + f"""
SELECT repo, scan_id, path, start_line % 19 = 0 AS is_valid,
       CASE WHEN start_line % 19 = 0 THEN '' ELSE ([{", ".join("'" + r + "'" for r in _RULES)}])[start_line % 19] END AS errors
FROM merged
"""

ATTACH = r"""
att AS (
  SELECT f.*, m.repo IS NOT NULL AS matched, m.cwe AS xc, m.refs AS xrefs,
         CASE WHEN m.repo IS NOT NULL THEN coalesce(nullif(upper(m.severity), ''), 'UNKNOWN') END AS xml_bit_severity,
         CASE WHEN m.repo IS NOT NULL THEN CASE WHEN m.message <> '' THEN m.message ELSE 'Vulnerability detected.' END END AS xml_trigger,
         CASE WHEN m.repo IS NOT NULL THEN
              CASE WHEN m.start_line = m.end_line THEN 'Review line ' || CAST(m.start_line AS VARCHAR) || ' in ' || m.path
                   ELSE 'Review lines ' || CAST(m.start_line AS VARCHAR) || '-' || CAST(m.end_line AS VARCHAR) || ' in ' || m.path END END AS xml_steps
  FROM f LEFT JOIN merged m ON f.repo = m.repo AND f.scan_id = m.scan_id AND f.path = m.path AND f.start_line = m.start_line),
ch AS (
  SELECT *, list_transform(list_filter(cwe, lambda c: c <> ''), lambda c: split_part(c, ':', 1)) AS sn
  FROM att),
ch2 AS (
  SELECT *, CASE WHEN len(sn) > 0 AND len(coalesce(xc, [])) > 0 THEN
                   CASE WHEN len(list_intersect(sn, xc)) > 0 THEN list_sort(list_distinct(list_intersect(sn, xc))) ELSE sn END
                 WHEN len(sn) > 0 THEN sn ELSE coalesce(xc, []) END AS chosen
  FROM ch),
w3 AS (
  SELECT repo, scan_id, path, cwe, cnt,
         CAST(row_number() OVER (PARTITION BY repo, scan_id, path ORDER BY cnt DESC, first_seen) AS INTEGER) AS rank
  FROM (SELECT repo, scan_id, path, c.cwe, count(*) AS cnt, min(ordinal * 1000 + c.k) AS first_seen
        FROM ch2, LATERAL (SELECT unnest(chosen) AS cwe, unnest(range(len(chosen))) AS k) c
        GROUP BY repo, scan_id, path, c.cwe)
  QUALIFY rank <= 2)
"""

J3 = with_(BASE, merge_sql("f"), ATTACH) + f"""
SELECT repo, scan_id, ordinal, path, start_line, matched,
       CASE WHEN matched THEN {arr('xc')} END AS xml_cwes, xml_bit_severity, xml_trigger,
       xml_steps, CASE WHEN matched THEN {arr('xrefs')} END AS xml_references
FROM att
"""

A7 = with_(BASE, merge_sql("f"), ATTACH) + """
SELECT repo, scan_id, ordinal, array_to_string(chosen, ', ') AS chosen_cwes FROM ch2
"""

W3 = with_(BASE, merge_sql("f"), ATTACH) + "SELECT * FROM w3"

A3 = with_(BASE, merge_sql("f"), ATTACH) + """
SELECT p.repo, p.scan_id, p.path, n_issues, n_error, n_warning, n_note,
       coalesce(nullif(concat_ws(', ', CASE WHEN n_error > 0 THEN 'E:' || CAST(n_error AS VARCHAR) END,
                                        CASE WHEN n_warning > 0 THEN 'W:' || CAST(n_warning AS VARCHAR) END,
                                        CASE WHEN n_note > 0 THEN 'N:' || CAST(n_note AS VARCHAR) END), ''), '-') AS levels,
       coalesce(nullif(t.top_cwes, ''), '-') AS top_cwes
FROM (SELECT repo, scan_id, path, count(*) AS n_issues,
             count(*) FILTER (WHERE upper(severity) = 'ERROR') AS n_error,
             count(*) FILTER (WHERE upper(severity) = 'WARNING') AS n_warning,
             count(*) FILTER (WHERE upper(severity) = 'NOTE') AS n_note
      FROM f GROUP BY repo, scan_id, path) p
LEFT JOIN (SELECT repo, scan_id, path, string_agg(cwe, ', ' ORDER BY rank) AS top_cwes FROM w3 GROUP BY ALL) t
  USING (repo, scan_id, path)
"""

A6 = with_(BASE, merge_sql("f"), ATTACH) + """
SELECT fl.repo, fl.scan_id, fl.path, file_has_cwe, file_has_ref, scan_has_cwe, scan_has_ref, scan_has_bit
FROM (SELECT repo, scan_id, path, bool_or(len(cwe) > 0) AS file_has_cwe, bool_or(len(refs) > 0) AS file_has_ref
      FROM att GROUP BY ALL) fl
JOIN (SELECT repo, scan_id, bool_or(len(cwe) > 0 OR len(coalesce(xc, [])) > 0) AS scan_has_cwe,
             bool_or(len(refs) > 0) AS scan_has_ref, bool_or(coalesce(xml_bit_severity, '') <> '') AS scan_has_bit
      FROM att GROUP BY ALL) sc USING (repo, scan_id)
"""

A8 = with_(BASE, merge_sql("f"), ATTACH) + """
SELECT repo, scan_id, path,
       coalesce(array_to_string(list_sort(list_distinct(flatten(list(xrefs) FILTER (WHERE matched)))), ';'), '') AS "references",
       CASE WHEN bool_or(matched) THEN 'Authenticated user may be required depending on route.' ELSE '' END AS preconditions
FROM att GROUP BY repo, scan_id, path
"""

A11 = with_(BASE) + """
SELECT repo, tool, coalesce(vulnerability_class[1], 'N/A') AS cls, count(*) AS n_findings,
       count(*) FILTER (WHERE upper(severity) = 'ERROR') AS n_error, count(DISTINCT (repo, path)) AS n_files,
       CASE WHEN count(*) FILTER (WHERE upper(severity) = 'ERROR') > 0 THEN 'failed' ELSE 'passed' END AS status,
       grouping_id(repo, tool, coalesce(vulnerability_class[1], 'N/A')) AS level
FROM f GROUP BY ROLLUP (repo, tool, coalesce(vulnerability_class[1], 'N/A'))
"""

S5 = with_(BASE, merge_sql("f")) + f"""
SELECT repo, scan_id, path, start_line, end_line,
       path || ':' || CAST(start_line AS VARCHAR) || '-' || CAST(end_line AS VARCHAR) AS id,
       {SEV_PAIR} AS severity_overall, {SEV_PAIR} AS severity_bit, {SEV_PAIR} AS bit_severity, snippet,
       CASE WHEN NOT contains(message, ' | ') THEN message END AS message,
       CASE WHEN contains(message, ' | ') THEN array_to_string(list_filter(list_transform(
            string_split(message, '|'), lambda x: {STRIP.format(x='x')}), lambda x: x <> ''), ';') END AS message_items,
       'Inspect the indicated code region and verify unsafe data flow or pattern.' AS reproduction,
       'Authenticated user may be required depending on route.' AS preconditions, 'unknown' AS env_node, 'posix' AS env_os,
       'Apply minimal changes: sanitize inputs, use parameterized APIs, and enforce allowlists.' AS mitigation,
       true AS tracking, CAST(2 AS INTEGER) AS context_before, CAST(3 AS INTEGER) AS context_after,
       CASE WHEN message <> '' THEN message ELSE 'Vulnerability detected.' END AS trigger, {STEP} AS steps,
       CASE WHEN len(vulnerability_class) > 0 THEN {arr('vulnerability_class')} END AS classes,
       CASE WHEN len(cwe) > 0 THEN {arr('cwe')} END AS weaknesses,
       CASE WHEN len(refs) > 0 THEN {arr('refs')} END AS "references"
FROM merged
"""

S5_META = with_(BASE, merge_sql("f")) + f"""
SELECT repo, scan_id, '1970-01-01T00:00:00+00:00' AS "generatedAt", '{_B.NAME}' AS tool, count(*) AS count,
       true AS is_valid, '' AS errors
FROM merged GROUP BY repo, scan_id
"""
T8B = with_(BASE, merge_sql("f")) + """
SELECT repo, scan_id, path, start_line, path || ':' || CAST(start_line AS VARCHAR) || '-' || CAST(end_line AS VARCHAR) AS id,
       end_line, severity AS severity_overall, message, snippet, true AS no_bit
FROM merged
"""
ORACLES.update({
    "s5_context_meta": S5_META,
    "t8b_contexts_minimal": T8B,
    "t8_build_contexts": CTX_FLAT,
    "a2_class_counts": A2,
    "w2_file_number": W2,
    "a4_scan_meta": A4,
    "f5_validate_context": F5,
    "f5_broken_contexts": F5_BROKEN,
    "j3_attach_context": J3,
    "a7_choose_cwes": A7,
    "w3_top_cwes": W3,
    "a3_file_severity_rollup": A3,
    "a6_flags": A6,
    "a8_context_rollup": A8,
    "a11_fleet_rollup": A11,
    "s5_context_roundtrip": S5,
})


# --------------------------------------------------------------------------- M4
from findrift.operators import prompts as _P  # noqa: E402


def lit(s: str) -> str:
    """SQL text literal with newlines as chr(10)."""
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in s.split("\n"))


def fill(template: str, **exprs: str) -> str:
    out, rest = [], template
    while rest:
        i = rest.find("{")
        j = rest.find("}", i)
        if i < 0 or j < 0 or rest[i + 1:j] not in exprs:
            out.append(lit(rest))
            break
        if i:
            out.append(lit(rest[:i]))
        out.append(f"({exprs[rest[i + 1:j]]})")
        rest = rest[j + 1:]
    return " || ".join(out)


NL = "chr(10)"
RESP = rf"""
resp AS (
  SELECT 'src' || CAST(conv_id % 20 AS VARCHAR) AS repo,
         'src' || CAST(conv_id % 20 AS VARCHAR) || '-semgrep' AS scan_id,
         'src/conv_' || CAST(conv_id AS VARCHAR) || '/turn_' || CAST(turn AS VARCHAR) || '.py' AS path,
         CASE WHEN conv_id % 7 = 0 THEN
                'Vulnerability Description: ' || text || {NL} || 'Potential Risks: r' || CAST(turn AS VARCHAR) || {NL}
                || 'Recommended Fix: fix ' || CAST(conv_id AS VARCHAR) || {NL} || 'Final Modified Code:' || {NL}
                || fence || 'Additional Notes: n' || CAST(turn AS VARCHAR)
              WHEN conv_id % 11 = 0 THEN
                '## Vulnerability' || {NL} || text || {NL} || '## Fix' || {NL} || 'fix ' || CAST(conv_id AS VARCHAR)
                || {NL} || '## Risks' || {NL} || 'r' || CAST(turn AS VARCHAR) || {NL} || '## Notes' || {NL} || fence
              ELSE
                '1. Vulnerability Description: ' || text || {NL} || '2. Potential Risk: r' || CAST(turn AS VARCHAR) || {NL}
                || '3. Recommended Fix: fix ' || CAST(conv_id AS VARCHAR) || {NL} || '4. Final Modified Code:' || {NL}
                || fence || '5. Additional Notes: n' || CAST(turn AS VARCHAR)
         END AS content,
         CASE WHEN conv_id % 7 = 0 THEN 2 WHEN conv_id % 11 = 0 THEN 3 ELSE 1 END AS form,
         text AS s_vuln, 'r' || CAST(turn AS VARCHAR) AS s_risk, 'fix ' || CAST(conv_id AS VARCHAR) AS s_fix,
         'n' || CAST(turn AS VARCHAR) AS s_notes, fence AS s_fence,
         CASE WHEN conv_id % 5 <> 0 THEN 'x = ' || CAST(conv_id AS VARCHAR) END AS s_code,
         CAST(length(text) AS BIGINT) AS prompt_tokens, CAST(turn * 10 AS BIGINT) AS completion_tokens,
         CAST(length(text) + turn * 10 AS BIGINT) AS total_tokens
  FROM (SELECT *, CASE WHEN conv_id % 5 = 0 THEN '' ELSE '```python' || {NL} || 'x = ' || CAST(conv_id AS VARCHAR)
                       || {NL} || '```' || {NL} END AS fence FROM conversations))
"""


def q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def groups(pattern: str, src: str = "content") -> list[str]:
    return [STRIP.format(x=f"regexp_extract({src}, {q(pattern)}, {i})") for i in range(1, 5)]


def sections_sql(src_cte: str) -> str:
    """T2a from what the recipe put in: only the numbered form has sections."""
    v = lambda c: f"CASE WHEN form = 1 THEN {STRIP.format(x=c)} ELSE '' END"
    return (f"SELECT repo, scan_id, path, {v('s_vuln')} AS vulnerability, {v('s_risk')} AS risks, "
            f"{v('s_fix')} AS recommended_fix, {v('s_notes')} AS \"references\" FROM {src_cte}")


def relaxed_sql(src_cte: str) -> str:
    """T2b from what the recipe put in: the plain form's fix runs on to the notes
    heading, the heading form has no notes under a known heading."""
    plain_fix = f"s_fix || {NL} || 'Final Modified Code:' || {NL} || s_fence"
    fix = f"CASE WHEN form = 2 THEN {STRIP.format(x=plain_fix)} ELSE s_fix END"
    return (f"SELECT repo, scan_id, path, CAST(form AS INTEGER) AS tier, {STRIP.format(x='s_vuln')} AS vulnerability, s_risk AS risks, "
            f"{fix} AS recommended_fix, CASE WHEN form = 3 THEN '' ELSE s_notes END AS \"references\" FROM {src_cte}")


CODE = """
code AS (SELECT repo, scan_id, path, s_code AS code, CAST(1 AS INTEGER) AS n_blocks FROM resp WHERE s_code IS NOT NULL)
"""

T1 = with_(RESP, CODE) + "SELECT * FROM code"
T1_REJ = with_(RESP, CODE) + f"""
SELECT repo, scan_id, 'parse' AS stage, path AS key, 'NO_CODE_BLOCK' AS code, 'no python code block found' AS message
FROM resp WHERE s_code IS NULL
"""
T2A = with_(RESP) + sections_sql("resp")
T2B = with_(RESP) + relaxed_sql("resp")
A9 = with_(RESP) + """
SELECT repo, scan_id, count(*) AS n_calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
       CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens
FROM resp GROUP BY repo, scan_id
"""
_KEY = "'response_' || array_to_string(list_filter(string_split(path, '/'), lambda x: x NOT IN ('artifacts', 'downloaded_repo')), '‣') || '.md'"
ORACLES["s6_read_responses"] = with_(RESP) + f"SELECT repo, scan_id, path, {_KEY} AS file_name, sha256(content) AS content_sha FROM resp"
P14 = with_(RESP) + f"""
SELECT path, {_KEY} AS file_name, replace(regexp_extract({_KEY}, '^response_(.*)\\.md$', 1), '‣', '/') AS decoded
FROM (SELECT path FROM resp UNION ALL SELECT 'artifacts/downloaded_repo/' || path FROM resp)
"""

VULN_TEXT = ("'Type: ' || coalesce(nullif(array_to_string(vulnerability_class, ', '), ''), 'Unknown') || chr(10) || "
             "'CWE: ' || coalesce(nullif(array_to_string(cwe, ', '), ''), 'N/A') || chr(10) || "
             "'Description: ' || coalesce(nullif(message, ''), 'None') || chr(10) || "
             "'Severity: ' || coalesce(nullif(severity, ''), 'Unknown') || chr(10) || "
             "'Location: ' || CAST(start_line AS VARCHAR) || ' ~ ' || CAST(end_line AS VARCHAR) || "
             "' (Only modify this code range)' || chr(10) || chr(10)")
# the input a file's first finding carries, by tool (the texts hold no carriage returns)
INPUT = f"CASE m.tool WHEN 'snykcode' THEN {STRIP.format(x='array_to_string(d.lines, chr(10))')} ELSE d.content END"
PROMPT_EXPR = fill(_P.FIX_TEMPLATE, input=INPUT, vulnerabilities=VULN_TEXT, context="''")

T3 = with_(BASE, merge_sql("f")) + f"""
SELECT m.repo, m.scan_id, m.path, 'fix' AS kind, {q(_P.FIX_TITLE)} AS title, {PROMPT_EXPR} AS prompt
FROM merged m JOIN d ON m.repo = d.repo AND m.path = d.path
WHERE {STRIP.format(x='d.content')} <> ''
"""
F4 = with_(BASE, merge_sql("f")) + f"""
SELECT m.repo, m.scan_id, 'prompt' AS stage, m.path AS key, 'EMPTY_SNIPPET' AS code,
       'The provided code snippet is empty.' AS message
FROM merged m JOIN d ON m.repo = d.repo AND m.path = d.path WHERE d.doc_id % 13 = 0
"""
_ESC = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_PAD = lambda n, x: f"'{' ' * n}' || {x} || chr(10)"


def _each(lst: str, n: int, head: str, tail: str, item: str) -> str:
    """One line per list entry."""
    return f"array_to_string(list_transform({lst}, lambda x: '{' ' * n}{head}' || {item} || '{tail}' || chr(10)), '')"


_ITEMS = f"list_filter(list_transform(string_split(message, '|'), lambda x: {STRIP.format(x='x')}), lambda x: x <> '')"
_ID = "path || ':' || CAST(start_line AS VARCHAR) || '-' || CAST(end_line AS VARCHAR)"
CONTEXT_XML = " || ".join([
    f"'<VULNERABILITY id=\"' || {_ID} || '\">' || chr(10)",
    _PAD(4, "'<FILE path=\"' || path || '\"/>'"),
    _PAD(4, "'<RANGE start=\"' || CAST(start_line AS VARCHAR) || '\" end=\"' || CAST(end_line AS VARCHAR) || '\"/>'"),
    _PAD(4, f"'<SEVERITY overall=\"' || {SEV_PAIR} || '\" bit=\"' || {SEV_PAIR} || '\"/>'"),
    f"CASE WHEN contains(message, ' | ') THEN {_PAD(4, q('<MESSAGE>'))} || {_PAD(8, q('<MESSAGES>'))} || "
    f"{_each(_ITEMS, 12, '<ITEM>', '</ITEM>', _ESC('x'))} || {_PAD(8, q('</MESSAGES>'))} || {_PAD(4, q('</MESSAGE>'))} "
    f"ELSE {_PAD(4, q('<MESSAGE>') + ' || ' + _ESC('message') + ' || ' + q('</MESSAGE>'))} END",
    _PAD(4, f"'<SNIPPET>' || {_ESC('snippet')} || '</SNIPPET>'"),
    _PAD(4, "'<BIT>'"),
    _PAD(8, f"'<TRIGGER>' || {_ESC(chr(40) + 'CASE WHEN message <> ' + chr(39) * 2 + ' THEN message ELSE ' + q('Vulnerability detected.') + ' END)')} || '</TRIGGER>'"),
    _PAD(8, "'<STEPS>'"), _PAD(12, f"'<STEP>' || {STEP} || '</STEP>'"), _PAD(8, "'</STEPS>'"),
    _PAD(8, "'<REPRODUCTION>Inspect the indicated code region and verify unsafe data flow or pattern.</REPRODUCTION>'"),
    _PAD(8, f"'<BIT_SEVERITY>' || {SEV_PAIR} || '</BIT_SEVERITY>'"), _PAD(4, "'</BIT>'"),
    _PAD(4, "'<CLASSES>'"), _each("vulnerability_class", 8, "<CLASS>", "</CLASS>", "x"), _PAD(4, "'</CLASSES>'"),
    _PAD(4, "'<WEAKNESSES>'"), _each("cwe", 8, '<CWE id="', '"/>', "x"), _PAD(4, "'</WEAKNESSES>'"),
    _PAD(4, "'<REFERENCES>'"), _each("refs", 8, '<REF href="', '"/>', "x"), _PAD(4, "'</REFERENCES>'"),
    _PAD(4, "'<PRECONDITIONS>'"), _PAD(8, "'<ITEM>Authenticated user may be required depending on route.</ITEM>'"), _PAD(4, "'</PRECONDITIONS>'"),
    _PAD(4, "'<ENV>'"), _PAD(8, "'<RUNTIME node=\"unknown\" os=\"posix\"/>'"), _PAD(4, "'</ENV>'"),
    _PAD(4, "'<MITIGATION>'"),
    _PAD(8, "'<SUMMARY>Apply minimal changes: sanitize inputs, use parameterized APIs, and enforce allowlists.</SUMMARY>'"),
    _PAD(4, "'</MITIGATION>'"), _PAD(4, "'<TRACKING></TRACKING>'"), "'</VULNERABILITY>'"])
T3_CONTEXT = with_(BASE, merge_sql("f"), f"mx AS (SELECT *, {CONTEXT_XML} AS xml FROM merged)") + f"""
SELECT repo, scan_id, path, CAST(length(prompt) AS INTEGER) AS prompt_chars, sha256(prompt) AS prompt_sha, true AS has_context
FROM (SELECT m.repo, m.scan_id, m.path, {fill(_P.FIX_TEMPLATE, input=INPUT, vulnerabilities=VULN_TEXT,
                                              context=fill(_P.CONTEXT_SECTION, xml='m.xml'))} AS prompt
      FROM mx m JOIN d ON m.repo = d.repo AND m.path = d.path WHERE {STRIP.format(x='d.content')} <> '')
"""
T3C = with_(BASE, merge_sql("f")) + f"""
SELECT m.repo, m.scan_id, m.path, 'fix' AS kind, 'gpt-4o' AS model, 'You are a security code fixer.' AS system,
       sha256({PROMPT_EXPR}) AS user_sha, '0.3' AS temperature
FROM merged m JOIN d ON m.repo = d.repo AND m.path = d.path
WHERE {STRIP.format(x='d.content')} <> ''
"""
_RETRY = (_P.RETRY_TEMPLATE.replace("{lang_name}", "JavaScript").replace("{lang}", "javascript")
          .replace("{comment}", "//"))
T3B = with_(RESP, CODE) + f"""
SELECT repo, scan_id, path, 'retry' AS kind, {q(_P.RETRY_TITLE)} AS title, {fill(_RETRY, input='code')} AS prompt
FROM code
"""
FILE_RESP = """
fresp AS (
  SELECT repo, scan_id, path,
         '1. Vulnerability Description: ' || message || chr(10) || '2. Potential Risk: r' || CAST(n_findings AS VARCHAR)
         || chr(10) || '3. Recommended Fix: fix ' || path || chr(10) || '4. Final Modified Code:' || chr(10)
         || '```python' || chr(10) || 'x = ' || CAST(first_ordinal AS VARCHAR) || chr(10) || '```' || chr(10)
         || '5. Additional Notes: n' || CAST(start_line AS VARCHAR) AS content,
         1 AS form, message AS s_vuln, 'r' || CAST(n_findings AS VARCHAR) AS s_risk, 'fix ' || path AS s_fix,
         'n' || CAST(start_line AS VARCHAR) AS s_notes, '' AS s_fence
  FROM merged)
"""
FILE_RESP_SOME = FILE_RESP.replace("FROM merged)", "FROM merged WHERE first_ordinal % 4 <> 3)")  # some answers are missing
J5 = with_(BASE, merge_sql("f"), FILE_RESP_SOME) + f"""
SELECT m.repo, m.scan_id, m.path, s.vulnerability, s.risks, s.recommended_fix, s."references"
FROM merged m LEFT JOIN ({sections_sql('fresp')}) s USING (repo, scan_id, path)
"""

ORACLES.update({
    "t1_code_blocks": T1,
    "t1_parse_rejects": T1_REJ,
    "t2a_sections_strict": T2A,
    "t2b_sections_relaxed": T2B,
    "a9_token_usage": A9,
    "p14_key_roundtrip": P14,
    "t3_render_prompts": T3,
    "t3_prompts_with_context": T3_CONTEXT,
    "f4_empty_input_rejects": F4,
    "t3c_chat_requests": T3C,
    "t3b_retry_prompts": T3B,
    "j5_attach_sections": J5,
})


# --------------------------------------------------------------------------- M5
PARSED = r"""
pc AS (
  SELECT repo, repo || '-semgrep' AS scan_id, path, doc_id, lines, content,
         CASE WHEN doc_id % 3 = 0 THEN array_to_string(list_transform(lines, lambda x, i:
                   CASE WHEN i = 1 + doc_id % len(lines) THEN 'fixed_' || CAST(doc_id AS VARCHAR) ELSE x END), chr(10))
              ELSE content END AS code
  FROM d),
bench AS (
  SELECT 'src' || CAST(item_id % 20 AS VARCHAR) AS repo, 'src' || CAST(item_id % 20 AS VARCHAR) || '-semgrep' AS scan_id,
         'bench/item_' || CAST(item_id AS VARCHAR) || '.py' AS path, text AS code
  FROM benchmark)
"""

PARSED_SOME = PARSED.replace("  FROM d),\nbench AS", "  FROM d WHERE doc_id % 3 <> 2),\nbench AS")  # some parsed code is absent

MARKS = r"""
mk AS (
  SELECT s.repo, s.scan_id, s.path, s.ordinal, s.start_line AS s, s.end_line AS e, len(d.lines) AS n
  FROM src s JOIN d ON s.repo = d.repo AND s.path = d.path),
mk2 AS (
  SELECT *, CASE WHEN e >= 1 AND e <= n THEN e ELSE s END AS ee FROM mk WHERE s >= 1 AND s <= n),
mrows AS (
  SELECT repo, scan_id, path, s AS line, ordinal, 0 AS k, '  # @BUG_HERE' AS m FROM mk2 WHERE s = ee
  UNION ALL SELECT repo, scan_id, path, s, ordinal, 0, '  # @BUG_HERE_START' FROM mk2 WHERE s <> ee
  UNION ALL SELECT repo, scan_id, path, ee, ordinal, 1, '  # @BUG_HERE_END' FROM mk2 WHERE s <> ee),
suf AS (SELECT repo, scan_id, path, line, string_agg(m, '' ORDER BY ordinal, k) AS suffix FROM mrows GROUP BY ALL),
fl AS (SELECT DISTINCT repo, scan_id, path FROM mrows),
ul AS (SELECT fl.repo, fl.scan_id, fl.path, unnest(d.lines) AS l, generate_subscripts(d.lines, 1) AS i
       FROM fl JOIN d ON fl.repo = d.repo AND fl.path = d.path)
"""
ANNOTATE_SELECT = """
SELECT ul.repo, ul.scan_id, ul.path,
       string_agg(ul.l || coalesce(suf.suffix, ''), chr(10) ORDER BY ul.i) || chr(10) AS annotated
FROM ul LEFT JOIN suf ON ul.repo = suf.repo AND ul.scan_id = suf.scan_id AND ul.path = suf.path AND ul.i = suf.line
GROUP BY ul.repo, ul.scan_id, ul.path
"""
T5 = with_(BASE, merge_sql("f"), "src AS (SELECT repo, scan_id, path, first_ordinal AS ordinal, start_line, end_line FROM merged)",
           MARKS) + ANNOTATE_SELECT
T5F = with_(BASE, "src AS (SELECT repo, scan_id, path, ordinal, start_line, end_line FROM f)", MARKS) + ANNOTATE_SELECT

J4 = with_(BASE, PARSED) + """
SELECT b.repo, b.scan_id, b.path, 'ORIGINAL_FILE_NOT_FOUND' AS code FROM bench b
WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.repo = b.repo AND d.path = b.path)
"""

T6 = with_(BASE, PARSED) + r"""
, hk AS (SELECT *, 1 + doc_id % len(lines) AS t, len(lines) AS n,
               greatest(1, 1 + doc_id % len(lines) - 3) AS a, least(len(lines), 1 + doc_id % len(lines) + 3) AS b
        FROM pc WHERE doc_id % 3 = 0),
body AS (SELECT repo, scan_id, path, any_value(a) AS a, any_value(b) AS b,
                string_agg(CASE WHEN i = t THEN '-' || l || chr(10) || '+fixed_' || CAST(doc_id AS VARCHAR) || chr(10)
                                ELSE ' ' || l || chr(10) END, '' ORDER BY i) AS body
         FROM (SELECT hk.*, unnest(lines) AS l, generate_subscripts(lines, 1) AS i FROM hk)
         WHERE i BETWEEN a AND b GROUP BY repo, scan_id, path)
SELECT repo, scan_id, path,
       '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -' || rng || ' +' || rng || ' @@' || chr(10) || body AS diff,
       'diff' AS status
FROM (SELECT *, CASE WHEN b - a + 1 = 1 THEN CAST(a AS VARCHAR) ELSE CAST(a AS VARCHAR) || ',' || CAST(b - a + 1 AS VARCHAR) END AS rng FROM body)
UNION ALL
SELECT repo, scan_id, path, '' AS diff, 'no_changes' AS status FROM pc WHERE doc_id % 3 <> 0
""".replace("\n, hk AS", ",\nhk AS", 1)

T6B = with_(BASE, PARSED) + r"""
, sides AS (
  SELECT repo, scan_id, path, unnest(lines) AS line, -1 AS sign FROM pc
  UNION ALL
  SELECT repo, scan_id, path, unnest(string_split(code, chr(10))) AS line, 1 AS sign FROM pc),
per_line AS (SELECT repo, scan_id, path, line, sum(sign) AS dd FROM sides GROUP BY ALL)
SELECT repo, scan_id, path, CAST(sum(greatest(dd, 0)) AS BIGINT) AS n_added, CAST(sum(greatest(-dd, 0)) AS BIGINT) AS n_removed
FROM per_line GROUP BY repo, scan_id, path
""".replace("\n, sides AS", ",\nsides AS", 1)

T7 = with_(BASE, PARSED_SOME) + """
SELECT d.repo, d.path, pc.scan_id,
       CASE WHEN d.doc_id % 3 = 0 THEN pc.code ELSE d.content END AS content,
       CASE WHEN d.doc_id % 3 = 0 THEN 'patched' ELSE 'unchanged' END AS status
FROM d LEFT JOIN pc ON d.repo = pc.repo AND d.path = pc.path
UNION ALL
SELECT repo, path, scan_id, NULL AS content, 'no_original' AS status FROM bench
"""

F3 = with_(BASE) + """
SELECT repo, path FROM d WHERE doc_id % 3 = 0
UNION ALL
SELECT 'src' || CAST(item_id % 20 AS VARCHAR), 'docs/.snyk_notes_' || CAST(item_id AS VARCHAR) || '.md' FROM benchmark
"""

ORACLES.update({
    "t5_annotate_source": T5,
    "t5_annotate_findings": T5F,
    "j4_unpaired": J4,
    "t6_unified_diff": T6,
    "t6b_diff_stats": T6B,
    "t7_apply_patches": T7,
    "f3_exclude_paths": F3,
})


# --------------------------------------------------------------------------- M6
PY = r"""
ok AS (SELECT repo, path, doc_id, CAST(len(lines) AS INTEGER) AS n FROM d WHERE doc_id % 97 <> 0),
ix AS (SELECT repo, path, n, CAST(unnest(range(1, n + 1)) AS INTEGER) AS i FROM ok),
ix2 AS (SELECT *, CAST(length(CAST(i AS VARCHAR)) AS INTEGER) AS dg FROM ix),
nodes AS (
  SELECT repo, path, 0 AS bfs_id, CAST(NULL AS INTEGER) AS parent_id, 'Module' AS node_type,
         CAST(NULL AS INTEGER) AS line, CAST(NULL AS INTEGER) AS col, CAST(NULL AS INTEGER) AS end_line,
         CAST(NULL AS INTEGER) AS end_col FROM ok
  UNION ALL SELECT repo, path, i, 0, 'FunctionDef', 2 * i - 1, 0, 2 * i, 18 + dg FROM ix2
  UNION ALL SELECT repo, path, n + 2 * i - 1, i, 'arguments', NULL, NULL, NULL, NULL FROM ix2
  UNION ALL SELECT repo, path, n + 2 * i, i, 'Return', 2 * i, 4, 2 * i, 18 + dg FROM ix2
  UNION ALL SELECT repo, path, 3 * n + 2 * i - 1, n + 2 * i - 1, 'arg', 2 * i - 1, 6 + dg, 2 * i - 1, 7 + dg FROM ix2
  UNION ALL SELECT repo, path, 3 * n + 2 * i, n + 2 * i, 'Call', 2 * i, 11, 2 * i, 18 + dg FROM ix2
  UNION ALL SELECT repo, path, 5 * n + 2 * i - 1, 3 * n + 2 * i, 'Name', 2 * i, 11, 2 * i, 14 FROM ix2
  UNION ALL SELECT repo, path, 5 * n + 2 * i, 3 * n + 2 * i, 'Constant', 2 * i, 15, 2 * i, 17 + dg FROM ix2
  UNION ALL SELECT repo, path, 7 * n + i, 5 * n + 2 * i - 1, 'Load', NULL, NULL, NULL, NULL FROM ix2)
"""
N1 = with_(BASE, PY) + "SELECT * FROM nodes"
N1_STATUS = with_(BASE) + """
SELECT repo, path, doc_id % 97 <> 0 AS success,
       CASE WHEN doc_id % 97 = 0 THEN 'invalid syntax (<unknown>, line ' || CAST(2 * len(lines) + 1 AS VARCHAR) || ')' END AS error_message
FROM d
"""
N2 = with_(BASE, PY) + "SELECT repo, node_type, count(*) AS n_nodes FROM nodes GROUP BY repo, node_type"
N3 = with_(BASE) + """
SELECT f.repo, f.scan_id, f.ordinal, f.path, f.start_line AS line,
       CASE WHEN hit THEN CAST((f.start_line + 1) // 2 AS INTEGER) END AS bfs_id,
       CASE WHEN hit THEN 'FunctionDef' END AS node_type
FROM (SELECT f.*, d.doc_id % 97 <> 0 AND f.ordinal % 40 <= 18 + length(CAST((f.start_line + 1) // 2 AS VARCHAR)) AS hit
      FROM f JOIN d ON f.repo = d.repo AND f.path = d.path) f
"""
J6 = with_(BASE) + """
SELECT repo, scan_id, ordinal, path, start_line,
       CASE WHEN ok THEN CASE WHEN end_line <= 2 * kk THEN 1 ELSE 2 END END AS tier,
       CASE WHEN ok THEN kk END AS bfs_id, CASE WHEN ok THEN 'FunctionDef' END AS node_type,
       CASE WHEN ok THEN 2 * kk - 1 END AS node_line, CASE WHEN ok THEN 0 END AS node_col,
       CASE WHEN ok THEN 2 * kk END AS node_end_line,
       CASE WHEN ok THEN CAST(18 + length(CAST(kk AS VARCHAR)) AS INTEGER) END AS node_end_col
FROM (SELECT f.*, d.doc_id % 97 <> 0 AS ok, CAST((f.start_line + 1) // 2 AS INTEGER) AS kk
      FROM f JOIN d ON f.repo = d.repo AND f.path = d.path)
"""
# every pair of a finding and a node of its file, tested by the rule itself
NESTED = """
nn AS (
  SELECT repo, path, CAST(i AS INTEGER) AS bfs_id, 'FunctionDef' AS node_type, i AS line, (i - 1) * 4 AS col, 10040 - i AS end_line, i * 4 + 10 AS end_col
  FROM d, range(1, 21) t(i)
  UNION ALL
  SELECT repo, path, CAST(21 + i AS INTEGER), 'If', 21 + (i % 200) * 50, 80, 60 + (i % 200) * 50, 90
  FROM (SELECT repo, path, unnest(range(0, len(lines))) AS i FROM d)),
nf AS (
  SELECT repo, scan_id, ordinal, path, CAST(1 + (ordinal * 131 + start_line) % 10039 AS INTEGER) AS s,
         CAST(1 + (ordinal * 131 + start_line) % 10039 + ordinal % 60 AS INTEGER) AS e
  FROM f)
"""
J6_NESTED = with_(BASE, NESTED) + """
SELECT * FROM (
  SELECT nf.repo, scan_id, ordinal, nf.path, s AS start_line,
         CASE WHEN (line, col) <= (s, 0) AND (e, 0) <= (end_line, end_col) THEN 1
              WHEN (line, col) <= (s, 0) AND (s, 0) <= (end_line, end_col) THEN 2
              WHEN line <= s AND s <= end_line AND col <= 0 AND 0 <= end_col THEN 3 END AS tier,
         CASE WHEN tier IS NOT NULL THEN bfs_id END AS bfs_id, CASE WHEN tier IS NOT NULL THEN node_type END AS node_type,
         CAST(CASE WHEN tier IS NOT NULL THEN line END AS INTEGER) AS node_line, CAST(CASE WHEN tier IS NOT NULL THEN col END AS INTEGER) AS node_col,
         CAST(CASE WHEN tier IS NOT NULL THEN end_line END AS INTEGER) AS node_end_line,
         CAST(CASE WHEN tier IS NOT NULL THEN end_col END AS INTEGER) AS node_end_col
  FROM nf JOIN nn ON nf.repo = nn.repo AND nf.path = nn.path)
QUALIFY row_number() OVER (PARTITION BY repo, scan_id, ordinal, path ORDER BY tier NULLS LAST,
                           CASE WHEN tier < 3 THEN node_end_line - node_line ELSE 0 END,
                           CASE WHEN tier < 3 THEN node_end_col - node_col ELSE 0 END, bfs_id) = 1
"""
N3_NESTED = with_(BASE, NESTED) + """
SELECT nf.repo, scan_id, ordinal, nf.path, s AS line, min(CASE WHEN hit THEN bfs_id END) AS bfs_id,
       min_by(node_type, CASE WHEN hit THEN bfs_id END) AS node_type
FROM nf JOIN (SELECT * FROM nn) nn ON nf.repo = nn.repo AND nf.path = nn.path,
     LATERAL (SELECT line <= s AND s <= end_line AND col <= ordinal % 96 AND ordinal % 96 <= end_col AS hit)
GROUP BY ALL
"""
ORACLES.update({
    "j6_nested_nodes": J6_NESTED,
    "n3_nested_nodes": N3_NESTED,
    "n1_ast_nodes": N1,
    "n1_parse_status": N1_STATUS,
    "n2_node_type_counts": N2,
    "n3_find_node_at": N3,
    "j6_findings_to_nodes": J6,
})


# --------------------------------------------------------------------------- M7
PUB = r"""
prl AS (
  SELECT strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS date, 'o' || CAST(user_id % 5 AS VARCHAR) AS owner,
         'r' || CAST(user_id % 20 AS VARCHAR) AS repo, 'u' || CAST(user_id % 7 AS VARCHAR) AS user_name,
         'https://github.com/o' || CAST(user_id % 5 AS VARCHAR) || '/r' || CAST(user_id % 20 AS VARCHAR) AS repo_url,
         sha256('https://github.com/o' || CAST(user_id % 5 AS VARCHAR) || '/r' || CAST(user_id % 20 AS VARCHAR)) AS repo_hash,
         CAST(user_id AS INTEGER) AS pr_number
  FROM events GROUP BY user_id),
upd AS (
  SELECT CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(user_id AS INTEGER) END AS pr_number,
         'https://github.com/o' || CAST(user_id % 5 AS VARCHAR) || '/r' || CAST(user_id % 20 AS VARCHAR)
           || CASE WHEN event_id % 50 = 0 THEN '-gone' ELSE '' END AS repo_url,
         event_type = 'purchase' AS approved, event_type IN ('signup', 'view') AS opened, ts, event_id AS seq
  FROM events),
w6 AS (
  SELECT pr_number, repo_url, approved, opened FROM upd WHERE pr_number IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY pr_number, repo_url ORDER BY ts DESC, seq DESC) = 1)
"""
L1 = with_(PUB) + "SELECT date, owner, repo, user_name, repo_url, repo_hash, pr_number, true AS opened, false AS approved FROM prl"
W6 = with_(PUB) + "SELECT * FROM w6"
J9 = with_(PUB) + """
SELECT p.date, p.owner, p.repo, p.user_name, p.repo_url, p.repo_hash, p.pr_number,
       CASE WHEN w.pr_number IS NOT NULL THEN w.approved ELSE false END AS approved,
       CASE WHEN w.pr_number IS NOT NULL THEN w.opened ELSE true END AS opened
FROM prl p LEFT JOIN w6 w ON p.pr_number = w.pr_number AND p.repo_url = w.repo_url
"""
J9_ERR = with_(PUB) + """
SELECT u.pr_number, u.repo_url, 404 AS status_code, 'PR not found' AS error FROM upd u
WHERE u.pr_number IS NOT NULL AND NOT EXISTS (SELECT 1 FROM prl p WHERE p.pr_number = u.pr_number AND p.repo_url = u.repo_url)
UNION ALL
SELECT pr_number, repo_url, 400, 'pr_number is required' FROM upd WHERE pr_number IS NULL
"""
RLOG = r"""
rl AS (
  SELECT 'p' || CAST(l_partkey AS VARCHAR) AS name, l_returnflag AS owner,
         CASE WHEN l_linestatus = 'F' THEN NULL ELSE 'https://github.com/' || l_linestatus END AS repo_url,
         CAST(l_linenumber AS BIGINT) AS vulnerabilities,
         [{'type': l_returnflag, 'count': CAST(l_linenumber AS BIGINT)}] AS byClass,
         'semgrep' AS sastTool, l_linenumber % 2 = 0 AS rerun, '' AS analysis,
         l_orderkey * 10 + l_linenumber AS seq, l_orderkey % 2 = 0 AS is_existing
  FROM lineitem)
"""
_K8 = ["name", "owner", "repo_url", "vulnerabilities", "byClass", "sastTool", "rerun", "analysis"]
J8 = with_(RLOG) + f"""
, nw AS (SELECT {', '.join(_K8)}, max(seq) AS seq FROM rl WHERE NOT is_existing GROUP BY ALL)
SELECT {', '.join(_K8[:4])}, sastTool, rerun, analysis, seq, CAST(to_json(byClass) AS VARCHAR) AS byClass FROM (
  SELECT {', '.join(_K8)}, seq FROM rl e WHERE is_existing AND NOT EXISTS (
    SELECT 1 FROM nw n WHERE {' AND '.join(f'e.{k} IS NOT DISTINCT FROM n.{k}' for k in _K8)})
  UNION ALL SELECT {', '.join(_K8)}, seq FROM nw)
""".replace("\n, nw AS", ",\nnw AS", 1)
P17 = with_(RLOG) + """
SELECT seq, sha256(to_json({'analysis': analysis, 'byClass': byClass, 'repo_url': repo_url, 'rerun': rerun,
                            'sastTool': sastTool, 'vulnerabilities': vulnerabilities})) AS repo_hash
FROM rl
"""
FORK = r"""
fp AS (
  SELECT 'r' || CAST(o_custkey % 20 AS VARCHAR) AS repo, o_custkey AS number,
         CASE WHEN o_custkey % 4 = 0 THEN 'closed' ELSE 'open' END AS state,
         'fix-' || CAST(o_custkey AS VARCHAR) AS head_ref, min(o_orderdate) AS created_at
  FROM orders GROUP BY o_custkey),
runs AS (
  SELECT 'r' || CAST(o_custkey % 20 AS VARCHAR) AS repo, unnest([o_custkey, o_custkey + 20]) AS number,
         o_orderkey AS id,
         CASE WHEN o_orderstatus IN ('F', 'P') THEN 'completed' ELSE 'in_progress' END AS status,
         CASE WHEN o_orderstatus = 'F' THEN 'success' WHEN o_orderstatus = 'P' THEN 'failure' END AS conclusion
  FROM orders),
fr AS (SELECT repo, number, id AS run_id, status AS run_status, conclusion AS run_conclusion FROM runs
       QUALIFY row_number() OVER (PARTITION BY repo, number ORDER BY id DESC) = 1),
w5 AS (SELECT repo, number, head_ref, created_at FROM fp WHERE state = 'open'
       QUALIFY row_number() OVER (PARTITION BY repo ORDER BY created_at DESC, number DESC) = 1)
"""
W5 = with_(FORK) + "SELECT * FROM w5"
J7 = with_(FORK) + "SELECT fp.*, fr.run_id, fr.run_status, fr.run_conclusion FROM fp LEFT JOIN fr USING (repo, number)"
L5 = with_(FORK) + """
SELECT repo, number, head_ref, run_id, reason = 'ok' AS publishable, reason FROM (
  SELECT w5.repo, w5.number, w5.head_ref, fr.run_id,
         CASE WHEN fr.run_id IS NULL THEN 'no_run' WHEN fr.run_status <> 'completed' THEN 'running'
              WHEN fr.run_conclusion <> 'success' THEN 'failed' ELSE 'ok' END AS reason
  FROM w5 LEFT JOIN fr USING (repo, number))
"""
F6 = with_(BASE, merge_sql("f")) + """
SELECT u.repo, u.repo IN (SELECT repo FROM merged) AS has_findings
FROM (SELECT DISTINCT 'src' || CAST(c_custkey % 25 AS VARCHAR) AS repo FROM customer) u
"""
_PATH = "regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g')"
P16 = f"""
WITH u AS (
  SELECT page_id, 'raw' AS variant, url FROM pages
  UNION ALL SELECT page_id, 'git', regexp_replace(url, '[?#].*$', '') || '.git' FROM pages),
s AS (SELECT *, string_split({_PATH}, '/') AS segs FROM u)
SELECT page_id, variant, url,
       CASE WHEN len(segs) >= 2 THEN segs[1] END AS owner,
       CASE WHEN len(segs) >= 2 THEN regexp_replace(segs[2], '\\.git$', '') END AS name,
       CASE WHEN len(segs) < 2 THEN 'invalid repository URL' END AS error,
       segs[len(segs)] AS last_segment
FROM s
"""
P18 = """
SELECT page_id, contains(html, '<!DOCTYPE html>') AND contains(html, '<title>') AND contains(html, '</html>') AS has_all
FROM pages
"""
ORACLES.update({
    "l1_pr_log_rows": L1, "w6_latest_status": W6, "j9_update_pr_status": J9, "j9_status_errors": J9_ERR,
    "j8_replace_equal_rows": J8, "p17_repo_hash": P17, "w5_latest_open_pr": W5, "j7_prs_to_runs": J7,
    "l5_publishable_prs": L5, "f6_has_findings": F6, "p16_repo_from_url": P16, "p18_contains_all": P18,
})


# --------------------------------------------------------------------------- M8 reports
from findrift.operators import report_text as _RT  # noqa: E402


def emo(x: str) -> str:
    return (f"CASE upper({x}) WHEN 'ERROR' THEN {lit(_RT.SEVERITY_LABELS['ERROR'])} "
            f"WHEN 'WARNING' THEN {lit(_RT.SEVERITY_LABELS['WARNING'])} "
            f"WHEN 'NOTE' THEN {lit(_RT.SEVERITY_LABELS['NOTE'])} ELSE upper({x}) END")


def md(x: str, n: int = 120) -> str:
    t = STRIP.format(x=f"replace(replace(coalesce({x}, ''), '|', '\\|'), chr(10), ' ')")
    return f"(CASE WHEN length({t}) > {n} THEN left({t}, {n}) || '…' ELSE {t} END)"


def cut(x: str, n: int = 180) -> str:
    return f"(CASE WHEN length({x}) > {n} THEN left({x}, {n}) || '…' ELSE {x} END)"


def values(rows: list[tuple[int, str]]) -> str:
    return "(VALUES " + ", ".join(f"({s}, {lit(t)})" for s, t in rows) + ") v(seq, text)"


def line(block, file_no, part, seq, text, src, where="true") -> str:
    return (f"SELECT repo, scan_id, {block} AS block, CAST({file_no} AS BIGINT) AS file_no, {part} AS part, "
            f"CAST({seq} AS BIGINT) AS seq, {text} AS text FROM {src} WHERE {where}")


_STEP_M = ("CASE WHEN start_line = end_line THEN 'Review line ' || CAST(start_line AS VARCHAR) || ' in ' || path "
           "ELSE 'Review lines ' || CAST(start_line AS VARCHAR) || '-' || CAST(end_line AS VARCHAR) || ' in ' || path END")
_T = "coalesce(xml_trigger, '')"
_FIRST = f"list_filter(list_transform(string_split({_T}, '|'), lambda x: {STRIP.format(x='x')}), lambda x: x <> '')[1]"
_TRIG = f"CASE WHEN {_T} <> '' THEN coalesce({_FIRST}, {STRIP.format(x=_T)}) ELSE '' END"
_MSG = STRIP.format(x="coalesce(message, '')")
_CUT = STRIP.format(x=f"regexp_extract({_MSG}, '^([^|\\n]*?)(?:\\||\\n|\\. |$)', 1)")
_TRIG_ALL = f"CASE WHEN ({_TRIG}) = '' AND {_MSG} <> '' THEN {_CUT} ELSE {_TRIG} END"
_TF = f"CASE WHEN contains({_T}, '|') THEN coalesce({_FIRST}, {STRIP.format(x=_T)}) ELSE {STRIP.format(x=_T)} END"
_REPRO = "'Inspect the indicated code region and verify unsafe data flow or pattern.'"

T9B_CTE = f"""
fno AS (SELECT repo, scan_id, path, row_number() OVER (PARTITION BY repo, scan_id ORDER BY min(ordinal)) AS file_no
        FROM f GROUP BY repo, scan_id, path),
flg AS (SELECT repo, scan_id, bool_or(len(cwe) > 0 OR len(coalesce(xc, [])) > 0) AS has_cwe,
               bool_or(len(refs) > 0) AS has_ref, bool_or(coalesce(xml_bit_severity, '') <> '') AS has_bit
        FROM att GROUP BY repo, scan_id),
items AS (SELECT c.*, fno.file_no, flg.has_cwe, flg.has_ref, flg.has_bit,
                 CASE WHEN c.matched THEN {_TF} END AS tf
          FROM ch2 c JOIN fno USING (repo, scan_id, path) JOIN flg USING (repo, scan_id)),
files AS (SELECT DISTINCT repo, scan_id, path, file_no, has_cwe, has_ref, has_bit FROM items),
scans AS (SELECT DISTINCT repo, scan_id, tool FROM f),
roll AS (
  SELECT p.repo, p.scan_id, p.path, n_issues,
         coalesce(nullif(concat_ws(', ', CASE WHEN n_error > 0 THEN 'E:' || CAST(n_error AS VARCHAR) END,
                                          CASE WHEN n_warning > 0 THEN 'W:' || CAST(n_warning AS VARCHAR) END,
                                          CASE WHEN n_note > 0 THEN 'N:' || CAST(n_note AS VARCHAR) END), ''), '-') AS levels,
         coalesce(nullif(t.top_cwes, ''), '-') AS top_cwes
  FROM (SELECT repo, scan_id, path, count(*) AS n_issues,
               count(*) FILTER (WHERE upper(severity) = 'ERROR') AS n_error,
               count(*) FILTER (WHERE upper(severity) = 'WARNING') AS n_warning,
               count(*) FILTER (WHERE upper(severity) = 'NOTE') AS n_note
        FROM f GROUP BY repo, scan_id, path) p
  LEFT JOIN (SELECT repo, scan_id, path, string_agg(cwe, ', ' ORDER BY rank) AS top_cwes FROM w3 GROUP BY ALL) t
    USING (repo, scan_id, path)),
sec AS (SELECT fl.repo, fl.scan_id, fl.path, fl.file_no, s.vulnerability, s.recommended_fix, s."references",
               (s.vulnerability <> '' OR s.risks <> '' OR s.recommended_fix <> '' OR s."references" <> '') AS any_sec
        FROM files fl JOIN ({relaxed_sql('fresp')}) s USING (repo, scan_id, path)),
fctx AS (SELECT i.repo, i.scan_id, i.path, i.file_no,
                list_sort(list_distinct(flatten(list(i.xrefs) FILTER (WHERE i.matched)))) AS rr,
                bool_or(i.matched) AS has_pre
         FROM items i GROUP BY i.repo, i.scan_id, i.path, i.file_no)
"""
_HL = (f"'- Line ' || CAST(start_line AS VARCHAR) || ': ' || concat_ws('; ', "
       f"CASE WHEN tf <> '' THEN 'Trigger: ' || {cut('tf')} END, "
       f"CASE WHEN coalesce(xml_steps, {_STEP_M}) <> '' THEN 'Steps: ' || {cut(f'coalesce(xml_steps, {_STEP_M})')} END, "
       f"'Repro: ' || {cut(_REPRO)})")
_SAST_HDR = ("'| Line | Type | Level' || CASE WHEN has_bit THEN ' | BIT Level' ELSE '' END || "
             "CASE WHEN has_cwe THEN ' | CWE(s)' ELSE '' END || CASE WHEN has_ref THEN ' | Ref' ELSE '' END || ' |'")
_SAST_SEP = ("'|----|----|-----' || CASE WHEN has_bit THEN '|---------' ELSE '' END || "
             "CASE WHEN has_cwe THEN '|------' ELSE '' END || CASE WHEN has_ref THEN '|---' ELSE '' END || '|'")
_BIT_LEVEL = (f"CASE WHEN coalesce(xml_bit_severity, '') <> '' THEN {emo('xml_bit_severity')} "
              f"WHEN coalesce(severity, '') <> '' THEN {emo('severity')} ELSE '' END")
_SAST_ROW = ("'| ' || concat_ws(' | ', CASE WHEN start_line = end_line THEN CAST(start_line AS VARCHAR) "
             "ELSE CAST(start_line AS VARCHAR) || '~' || CAST(end_line AS VARCHAR) END, "
             "coalesce(vulnerability_class[1], 'N/A'), " + emo("coalesce(nullif(upper(severity), ''), 'N/A')") + ", "
             f"CASE WHEN has_bit THEN CASE WHEN coalesce(xml_bit_severity, '') <> '' THEN {emo('xml_bit_severity')} ELSE '' END END, "
             "CASE WHEN has_cwe THEN coalesce(nullif(array_to_string(chosen, ', '), ''), 'N/A') END, "
             f"CASE WHEN has_ref THEN CASE WHEN coalesce(refs[1], '') <> '' THEN {lit(_RT.REF_LINK)} || '(' || refs[1] || ')' ELSE '' END END"
             ") || ' |'")
_LLM_LINES = " UNION ALL ".join(
    [line(2, "file_no", 6, 0, lit(_RT.LLM_ANALYSIS), "sec", "any_sec")]
    + [line(2, "file_no", 6, 2 * k + 1, lit(title), "sec", f"any_sec AND coalesce({q2}, '') <> ''")
       + " UNION ALL " + line(2, "file_no", 6, 2 * k + 2, f"{STRIP.format(x=q2)} || chr(10)", "sec", f"any_sec AND coalesce({q2}, '') <> ''")
       for k, (n, title) in enumerate(_RT.LLM_PARTS) for q2 in [f'"{n}"']])

T9B_BODY = " UNION ALL ".join([
    f"SELECT repo, scan_id, 0 AS block, CAST(0 AS BIGINT) AS file_no, 0 AS part, CAST(seq AS BIGINT) AS seq, text FROM scans, {values(list(enumerate(_RT.PR_HEADER)))}",
    f"SELECT repo, scan_id, 1, CAST(0 AS BIGINT), 0, CAST(seq AS BIGINT), CASE WHEN seq = 1 THEN '> Detected by: **' || upper(tool) || '**' || chr(10) ELSE text END FROM scans, "
    + values([(0, "### Overview\n"), (1, ""), (2, "| File | Total Issues | Levels | Top CWE(s) |"), (3, "|------|---------------|--------|-------------|")]),
    f"SELECT repo, scan_id, 3, CAST(0 AS BIGINT), 0, CAST(seq AS BIGINT), text FROM scans, {values(list(enumerate(_RT.PR_FOOTER)))}",
    line(1, 0, 1, "fno.file_no", "'| `' || roll.path || '` | **' || CAST(n_issues AS VARCHAR) || '** | ' || levels || ' | ' || top_cwes || ' |'",
         "roll JOIN fno USING (repo, scan_id, path)"),
    line(2, "file_no", 0, 0, "'### ' || CAST(file_no AS VARCHAR) || '. `' || path || '`'", "files"),
    f"SELECT repo, scan_id, 2, CAST(file_no AS BIGINT), 0, CAST(seq + 1 AS BIGINT), text FROM files, {values(list(enumerate(_RT.BIT_SUMMARY)))}",
    line(2, "file_no", 1, "ordinal", f"'| ' || CAST(start_line AS VARCHAR) || ' | ' || ({_BIT_LEVEL}) || ' | ' || {md(_TRIG_ALL)} || ' | ' || {md(f'coalesce(xml_steps, {_STEP_M})')} || ' |'", "items"),
    line(2, "file_no", 2, 0, lit(_RT.SAST_SUMMARY), "files"),
    line(2, "file_no", 2, 1, _SAST_HDR, "files"),
    line(2, "file_no", 2, 2, _SAST_SEP, "files"),
    line(2, "file_no", 3, "ordinal", _SAST_ROW, "items"),
    line(2, "file_no", 4, 0, lit(_RT.HIGHLIGHTS), "(SELECT DISTINCT repo, scan_id, file_no FROM items WHERE matched)"),
    line(2, "file_no", 5, "ordinal", _HL, "items", "matched"),
    _LLM_LINES,
    line(2, "file_no", 7, 0, lit(_RT.FURTHER), "fctx", "len(rr) > 0 OR has_pre"),
    line(2, "file_no", 8, 0, "'- References:'", "fctx", "len(rr) > 0"),
    "SELECT repo, scan_id, 2, CAST(file_no AS BIGINT), 8, CAST(generate_subscripts(rr, 1) AS BIGINT), '  - [link](' || unnest(rr) || ')' FROM fctx",
    line(2, "file_no", 9, 0, "'- Preconditions:'", "fctx", "has_pre"),
    line(2, "file_no", 9, 1, "'  - Authenticated user may be required depending on route.'", "fctx", "has_pre"),
])
T9B = with_(BASE, merge_sql("f"), ATTACH, FILE_RESP, T9B_CTE) + T9B_BODY
ORACLES["t9b_pr_body_lines"] = T9B
ORACLES["t9b_stored_report"] = f"""
SELECT repo, scan_id, CAST(i AS BIGINT) AS line_no, lines[i] AS text
FROM (SELECT repo, scan_id, string_split(string_agg(text, chr(10) ORDER BY block, file_no, part, seq), chr(10)) AS lines
      FROM ({T9B}) GROUP BY repo, scan_id), LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)
"""


_LVL = "coalesce(nullif(upper(severity), ''), 'N/A')"
T9A_CTE = f"""
fno AS (SELECT repo, scan_id, path, row_number() OVER (PARTITION BY repo, scan_id ORDER BY min(ordinal)) AS file_no
        FROM f GROUP BY repo, scan_id, path),
cc AS (SELECT repo, scan_id, vulnerability_class[1] AS type, count(*) AS cnt,
              row_number() OVER (PARTITION BY repo, scan_id ORDER BY min(ordinal)) AS class_pos
       FROM f WHERE len(vulnerability_class) > 0 GROUP BY repo, scan_id, vulnerability_class[1]),
sr AS (SELECT s.repo, s.scan_id, s.tool, coalesce(t.vulns, 0) AS vulns
       FROM (SELECT DISTINCT repo, scan_id, tool FROM f) s
       LEFT JOIN (SELECT repo, scan_id, sum(cnt) AS vulns FROM cc GROUP BY ALL) t USING (repo, scan_id)),
ff AS (SELECT fno.*, bool_or(len(f.cwe) > 0) AS f_cwe, bool_or(len(f.refs) > 0) AS f_ref
       FROM fno JOIN f USING (repo, scan_id, path) GROUP BY ALL),
it AS (SELECT f.*, ff.file_no, ff.f_cwe, ff.f_ref FROM f JOIN ff USING (repo, scan_id, path)),
ssec AS (SELECT ff.repo, ff.scan_id, ff.path, ff.file_no, s.vulnerability, s.recommended_fix, s."references"
         FROM ff JOIN ({sections_sql('fresp')}) s USING (repo, scan_id, path))
"""
T9A_BODY = " UNION ALL ".join([
    "SELECT repo, scan_id, 0 AS block, CAST(0 AS BIGINT) AS file_no, 0 AS part, CAST(0 AS BIGINT) AS seq, "
    + lit(_RT.LOG_HEADER) + " AS text FROM sr",
    line(0, 0, 0, 1, "'- SAST Tool: ' || upper(left(tool, 1)) || lower(substr(tool, 2))", "sr"),
    line(0, 0, 0, 2, "'- Total vulnerabilities Detected: ' || CAST(vulns AS VARCHAR) || chr(10)", "sr"),
    line(0, 0, 1, 0, "'| Type | Count |'", "sr", "vulns > 0"),
    line(0, 0, 1, 1, "'|------|-------|'", "sr", "vulns > 0"),
    line(0, 0, 2, "class_pos", "'| ' || type || ' | ' || CAST(cnt AS VARCHAR) || ' |'", "cc"),
    line(0, 0, 3, 0, lit(_RT.LOG_FILES), "sr"),
    line(1, "file_no", 0, 0, "chr(10) || '### ' || CAST(file_no AS VARCHAR) || '. `' || path || '`'", "ff"),
    line(1, "file_no", 0, 1, lit(_RT.LOG_SAST), "ff"),
    line(1, "file_no", 0, 2, "'| Line | Type | Level' || CASE WHEN f_cwe THEN ' | CWE' ELSE '' END || CASE WHEN f_ref THEN ' | Ref' ELSE '' END || ' |'", "ff"),
    line(1, "file_no", 0, 3, "'|----|----|-----' || CASE WHEN f_cwe THEN '|---' ELSE '' END || CASE WHEN f_ref THEN '|---' ELSE '' END || '|'", "ff"),
    line(1, "file_no", 1, "ordinal",
         "'| ' || concat_ws(' | ', CASE WHEN start_line = end_line THEN CAST(start_line AS VARCHAR) "
         "ELSE CAST(start_line AS VARCHAR) || '~' || CAST(end_line AS VARCHAR) END, coalesce(vulnerability_class[1], 'N/A'), "
         + emo(_LVL) + ", CASE WHEN f_cwe THEN coalesce(split_part(cwe[1], ':', 1), 'N/A') END, "
         f"CASE WHEN f_ref THEN CASE WHEN coalesce(refs[1], '') <> '' THEN {lit(_RT.REF_LINK)} || '(' || refs[1] || ')' ELSE '' END END) || ' |'",
         "it"),
    line(1, "file_no", 2, 0, lit(_RT.LOG_LLM), "ff"),
    line(1, "file_no", 3, 0, f"chr(10) || {lit(chr(0x23) * 3 + ' ' + chr(0x1f4c4) + ' `')} || path || '`'", "ssec"),
] + [line(1, "file_no", 3, 2 * k + 1, lit(title), "ssec", f"coalesce(\"{n}\", '') <> ''") + " UNION ALL "
     + line(1, "file_no", 3, 2 * k + 2, f'"{n}"', "ssec", f"coalesce(\"{n}\", '') <> ''")
     for k, (n, title) in enumerate(_RT.LOG_LLM_PARTS)])
T9A = with_(BASE, merge_sql("f"), FILE_RESP, T9A_CTE) + T9A_BODY

A10 = with_(BASE, merge_sql("f"), FILE_RESP) + """
SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.n, 0) AS files_with_findings, coalesce(b.n, 0) AS n_responses
FROM (SELECT repo, count(*) AS n FROM merged GROUP BY repo) a
FULL OUTER JOIN (SELECT repo, count(*) AS n FROM fresp GROUP BY repo) b ON a.repo = b.repo
"""

L2 = with_(BASE, merge_sql("f"), FILE_RESP, T9A_CTE, f"t9a AS ({T9A_BODY})") + """
, body AS (SELECT repo, scan_id, string_agg(text, chr(10) ORDER BY block, file_no, part, seq) AS analysis FROM t9a GROUP BY ALL),
bc AS (SELECT repo, scan_id, list({'type': type, 'count': cnt} ORDER BY class_pos) AS byClass, sum(cnt) AS vulns
       FROM cc GROUP BY ALL),
el AS (SELECT sr.repo, sr.scan_id, lower(sr.tool) AS sastTool, 'https://github.com/upstream/' || sr.repo AS repo_url,
              CAST(bc.vulns AS BIGINT) AS vulnerabilities, bc.byClass, body.analysis
       FROM sr JOIN bc USING (repo, scan_id) JOIN body USING (repo, scan_id)
       WHERE sr.repo <> 'src3' AND sr.tool <> 'codeql')
SELECT repo, scan_id, repo AS name, 'upstream' AS owner, repo_url, vulnerabilities, CAST(to_json(byClass) AS VARCHAR) AS byClass,
       sha256(analysis) AS analysis_sha, CAST(length(analysis) AS INTEGER) AS analysis_chars, sastTool, false AS rerun,
       sha256(CAST(to_json({'analysis': analysis, 'byClass': byClass, 'repo_url': repo_url, 'rerun': false,
                            'sastTool': sastTool, 'vulnerabilities': vulnerabilities}) AS VARCHAR)) AS repo_hash
FROM el
""".replace("\n, body AS", ",\nbody AS", 1)

L6 = with_(BASE, merge_sql("f"), ATTACH, FILE_RESP, T9B_CTE, f"t9b AS ({T9B_BODY})", FORK) + f"""
, body AS (SELECT regexp_replace(repo, '^src', 'r') AS repo,
                  string_agg(text, chr(10) ORDER BY block, file_no, part, seq) AS body
           FROM t9b WHERE scan_id LIKE '%-semgrep' GROUP BY repo, scan_id),
pub AS (SELECT w5.repo, w5.number, w5.head_ref FROM w5 JOIN fr USING (repo, number)
        WHERE fr.run_status = 'completed' AND fr.run_conclusion = 'success')
SELECT pub.repo, pub.number, '{_PB.PR_TITLE_PREFIX}2026-01-01' AS title, 'forker:' || pub.head_ref AS head,
       'main' AS base, sha256(body.body) AS body_sha
FROM pub LEFT JOIN body USING (repo)
""".replace("\n, body AS", ",\nbody AS", 1)

ORACLES.update({"t9a_report_lines": T9A, "a10_run_summary": A10, "l2_repo_log_rows": L2, "l6_pr_requests": L6})

SG_LIST = """
sgl AS (
  SELECT repo, scan_id, tool, (part << 40) + file_pos AS ordinal, raw_path AS path, raw_start AS start_line, end_line,
         CASE WHEN raw_start > 0 AND raw_start <= end_line AND end_line <= n_lines
              THEN array_to_string(list_slice(lines, raw_start, end_line), chr(10)) ELSE '' END AS snippet,
         message, [event_type] AS vulnerability_class,
         CASE WHEN k % 11 = 0 THEN []::VARCHAR[] ELSE ['CWE-' || CAST(k % 7 AS VARCHAR)] END AS cwe, severity,
         ['https://refs.example.org/' || CAST(k % 5 AS VARCHAR)] AS refs
  FROM sv WHERE tool = 'semgrep' AND event_id % 50 <> 0)
"""
R1 = with_(BASE, SCAN, SG_LIST, merge_sql("sgl")) + f"""
SELECT repo, scan_id, path, tool, first_ordinal, n_findings, start_line, end_line, snippet, message,
       {arr('vulnerability_class')} AS vulnerability_class, {arr('cwe')} AS cwe, severity, {arr('refs')} AS "references"
FROM merged
"""
R2_LATE = with_(PUB) + """
SELECT pr_number, repo_url, approved, opened, ts, seq
FROM (SELECT *, ts < m OR coalesce(pr_number, 0) % 4 = 0 AS later FROM upd, (
        SELECT make_timestamp(CAST((floor(epoch(min(ts))) + floor(epoch(max(ts)))) / 2 * 1000000 AS BIGINT)) AS m FROM upd))
QUALIFY later AND ts <= max(CASE WHEN NOT later THEN ts END) OVER () - INTERVAL 1 DAY
"""
R2_STORED = with_(PUB) + "SELECT count(*) AS n_rows FROM (SELECT DISTINCT pr_number, repo_url, ts, seq FROM upd)"
ORACLES.update({"r1_stream_findings": R1, "r2_stream_pr_status": W6, "r2_late_updates": R2_LATE, "r2_stored_updates": R2_STORED})

S1 = with_(BASE) + """
SELECT repo, path, CAST(len(lines) AS INTEGER) AS n_lines, sha256(array_to_string(lines, chr(10))) AS lines_sha FROM d
"""
S4 = with_(BASE) + f"""
SELECT repo, path, start_line, end_line, snippet, message, {arr('vulnerability_class')} AS vulnerability_class,
       {arr('cwe')} AS cwe, severity, {arr('refs')} AS "references" FROM f
"""
A5 = with_(BASE) + "SELECT DISTINCT repo, scan_id, path FROM f"
S2_FILES = with_(BASE, SCAN) + f"SELECT * EXCLUDE (ordinal, idx) FROM ({SEMGREP_ROWS})"
S7_REPOS = """
SELECT 'p' || CAST(l_partkey AS VARCHAR) AS name, l_returnflag AS owner,
       CASE WHEN l_linestatus <> 'F' THEN 'https://github.com/' || l_linestatus END AS repo_url,
       CAST(l_linenumber AS BIGINT) AS vulnerabilities,
       '[{"type":"' || l_returnflag || '","count":' || CAST(l_linenumber AS VARCHAR) || '}]' AS "byClass",
       '' AS analysis, 'semgrep' AS "sastTool", l_linenumber % 2 = 0 AS rerun
FROM lineitem
"""
L4_PULLS = """
SELECT CAST(o_orderkey AS INTEGER) AS pr_number, 'https://github.com/o/r' || CAST(o_custkey % 20 AS VARCHAR) AS repo_url,
       o_orderstatus = 'F' AS approved, o_orderstatus = 'O' AS opened, CAST(0 AS BIGINT) AS seq
FROM orders
"""
P16_UPSTREAM = r"""
SELECT page_id, CASE WHEN ok THEN seg[1] END AS owner, CASE WHEN ok THEN seg[2] END AS name,
       CASE WHEN page_id % 3 = 0 THEN 'not a repository host URL' WHEN NOT ok THEN 'invalid repository URL' END AS error
FROM (SELECT page_id, seg, page_id % 3 <> 0 AND len(seg) >= 2 AS ok
      FROM (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS seg FROM pages))
"""
ORACLES.update({"s2_read_scan_files": S2_FILES, "s2_read_scan_chunks": S2_FILES, "s7_read_repo_logs": S7_REPOS, "l4_updates_from_pulls": L4_PULLS,
                "p16_upstream_from_url": P16_UPSTREAM})
K3 = f"""
SELECT repo, scan_id, path, 'parsed' AS kind, sha256(code) AS text_sha FROM ({T1})
UNION ALL
SELECT repo, scan_id, path, 'diff', sha256(diff) FROM ({T6}) WHERE status = 'diff'
"""
S1_DEFAULT = with_(BASE) + """
SELECT 'source=' || source AS repo, 'lang=' || lang || '/doc=' || CAST(doc_id AS VARCHAR) AS folder,
       CAST(len(lines) AS INTEGER) AS n_lines
FROM documents JOIN d USING (doc_id)
"""
ORACLES.update({"s1_read_source_files": S1, "s1_default_layout": S1_DEFAULT, "s4_findings_roundtrip": S4, "s7_read_logs": L1, "k4_append_log": L1,
                "a5_distinct_paths": A5, "k3_text_per_file": K3})


BASE_HOT = BASE.replace("ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)",
                        "ON d.doc_id = CASE WHEN e.event_id % 3 = 0 THEN 0 ELSE e.event_id % (SELECT count(*) FROM documents) END")
assert BASE_HOT != BASE
ORACLES["a1_hot_file_merge"] = A1.replace(BASE.strip().rstrip(","), BASE_HOT.strip().rstrip(","))
assert ORACLES["a1_hot_file_merge"] != A1
