"""The detection queries as DuckDB SQL, from the same detector data.

DuckDB's regex engine has ASCII word boundaries and neither lookaround nor backreferences;
``DIALECT`` and the conditions below say the same without them.
"""

from __future__ import annotations

from collections.abc import Iterable

from umbra.operators.specs import KEYWORD_LABELS, MIN_ENTROPY, MIN_ENTROPY_LENGTH, DetectorSpec


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_PHONE_TAIL = r"[\s.-]?\d{3,4}[\s.-]?\d{3,4}"
_KEY = r"[A-Za-z0-9_.\-]*(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential)[A-Za-z0-9_.\-]*"
DIALECT = {
    "openai_api_key": r"\bsk-[A-Za-z0-9_-]{20,}\b",
    "cookie_header": r"(?im)(^(?:set-)?cookie:\s*)(.+)$",
    "phone_number": rf"(?:\+\d{{1,3}}[\s.-]?\(?\d{{1,4}}\)?{_PHONE_TAIL}|\(\d{{2,4}}\){_PHONE_TAIL})",
    "assignment_secret": rf"""(?i)({_KEY}\s*[:=]\s*)(?:"[^\s"'#]{{6,}}"|'[^\s"'#]{{6,}}'|[^\s"'#]{{6,}})""",
}
PLACEHOLDERS = r"(?is)(true|false|null|none|nil|yes|no|on|off|enabled|disabled|changeme|example|placeholder|redacted|todo|xxx+|\*+|\[.*\]|<.*>|\$\{.*\}|\$\(.*\))"


def _entropy(value: str) -> str:
    return f"(SELECT -sum(n / length({value}) * log2(n / length({value}))) FROM (SELECT count(*)::DOUBLE AS n FROM (SELECT unnest(string_split({value}, '')) AS c) GROUP BY c))"


def _luhn(value: str) -> str:
    digits = f"regexp_replace({value}, '[ -]', '', 'g')"
    d = f"CAST(substr({digits}, length({digits}) - i, 1) AS INTEGER)"
    return f"(length({digits}) BETWEEN 13 AND 19 AND list_sum([CASE WHEN i % 2 = 0 THEN {d} WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END FOR i IN range(length({digits}))]) % 10 = 0)"


def spans(source: str, key: str, text: str, pattern: str) -> str:
    """Rows (k, t, s, e, v): all matches of a pattern."""
    return f"""SELECT k, t, s, s + length(v) AS e, v FROM (
        SELECT k, t, f[i] AS v, (list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN f[1:i-1]]), 0))::BIGINT AS s FROM (
            SELECT k, t, f, g, unnest(range(1, len(f) + 1)) AS i FROM (
                SELECT {key} AS k, {text} AS t, regexp_extract_all({text}, {quote(pattern)}) AS f, string_split_regex({text}, {quote(pattern)}) AS g FROM {source})))"""


def hits(source: str, key: str, text: str, spec: DetectorSpec, order: int) -> str:
    """Rows (k, t, s, e, v, ord, kind, label, confidence) of one detector."""
    pattern, name = DIALECT.get(spec.name, spec.pattern), spec.name
    found, label, where = spans(source, key, text, pattern), quote(spec.label), "true"
    if name == "assignment_secret":
        quoted = f"regexp_extract(v, {quote(pattern)}, 1)"
        body = f"substr(v, length({quoted}) + 1)"
        found = f"""SELECT k, t, s + length({quoted}) + q AS s, s + length(v) - q AS e, substr({body}, 1 + q, length({body}) - 2 * q) AS v, lower({quoted}) AS key
            FROM (SELECT *, CASE WHEN substr({body}, 1, 1) IN ('"', '''') THEN 1 ELSE 0 END AS q FROM ({found}))"""
        label = "CASE " + " ".join(f"WHEN contains(key, {quote(w)}) THEN {quote(x)}" for w, x in KEYWORD_LABELS) + " ELSE 'Secret' END"
        where = f"NOT regexp_full_match(v, {quote(PLACEHOLDERS)})"
    elif spec.secret:
        rx = quote(pattern)
        found = f"SELECT k, t, s + length(regexp_extract(v, {rx}, 1)) AS s, s + length(regexp_extract(v, {rx}, 1)) + length(regexp_extract(v, {rx}, 2)) AS e, regexp_extract(v, {rx}, 2) AS v FROM ({found})"
    elif name == "openai_api_key":
        where = "NOT starts_with(v, 'sk-ant-')"
    elif name == "phone_number":
        where = r"NOT regexp_matches(CASE WHEN s > 0 THEN substr(t, s, 1) ELSE '' END, '[\p{L}\p{N}_]') AND NOT regexp_matches(substr(t, e + 1, 1), '[\p{L}\p{N}_]')"
    elif name == "credit_card":  # a separator before a letter belongs to the match
        found = rf"SELECT k, t, s, e + m AS e, substr(t, s + 1, e - s + m) AS v FROM (SELECT *, CASE WHEN regexp_matches(substr(t, e + 1, 2), '^[ -][\p{{L}}\p{{N}}_]') AND regexp_matches(v, '\d$') THEN 1 ELSE 0 END AS m FROM ({found}))"
        where = _luhn("v")
    elif name == "high_entropy_string":
        where = f"length(v) >= {MIN_ENTROPY_LENGTH} AND {_entropy('v')} >= {MIN_ENTROPY} - 1e-12"
    return f"SELECT k, t, s, e, v, {order} AS ord, {quote(name)} AS kind, {label} AS label, {spec.confidence}::DOUBLE AS confidence FROM ({found}) AS x WHERE {where}"


def all_hits(source: str, key: str, text: str, specs: Iterable[DetectorSpec]) -> str:
    return "\nUNION ALL\n".join(hits(source, key, text, s, i) for i, s in enumerate(specs))


def islands(found: str) -> str:
    """Rows (k, t, s, e, v, kind, label, confidence) after overlap resolution."""
    order = "(PARTITION BY k ORDER BY s, e, ord, v ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f"""SELECT k, t, min(s) OVER w AS s, max(e) OVER w AS e, v, kind, label, confidence FROM (
        SELECT *, sum(CASE WHEN p IS NULL OR s >= p THEN 1 ELSE 0 END) OVER {order} CURRENT ROW) AS island FROM (
            SELECT *, max(e) OVER {order} 1 PRECEDING) AS p FROM ({found})))
        WINDOW w AS (PARTITION BY k, island)
        QUALIFY row_number() OVER (PARTITION BY k, island ORDER BY confidence DESC, e - s DESC, s, e, ord) = 1"""


def redacted(source: str, key: str, text: str, resolved: str, numbering: bool = True, before: str = "[REDACTED: ", after: str = "]") -> str:
    """Rows (k, sanitized, n)."""
    suffix = "CASE WHEN max(i) OVER (PARTITION BY k, label) > 1 THEN ' #' || i ELSE '' END" if numbering else "''"
    return f"""SELECT x.k, coalesce(y.head || substr(x.t, y.last + 1), x.t) AS sanitized, coalesce(y.n, 0)::BIGINT AS n FROM (SELECT {key} AS k, {text} AS t FROM {source}) AS x LEFT JOIN (
        SELECT k, string_agg(substr(t, p + 1, s - p) || {quote(before)} || label || suffix || {quote(after)}, '' ORDER BY s) AS head, max(e) AS last, count(*) AS n FROM (
            SELECT *, coalesce(lag(e) OVER (PARTITION BY k ORDER BY s), 0) AS p, {suffix} AS suffix FROM (
                SELECT *, dense_rank() OVER (PARTITION BY k, label ORDER BY first) AS i FROM (
                    SELECT *, min(s) OVER (PARTITION BY k, label, v) AS first FROM ({resolved}))))
        GROUP BY k) AS y USING (k)"""


def preview(resolved: str, width: int, most: int) -> str:
    """Rows (k, position, line, label, shown)."""
    return f"""SELECT k, position, line, label, '  Ln ' || CASE WHEN length(line::VARCHAR) >= 4 THEN line::VARCHAR ELSE rpad(line::VARCHAR, 4, ' ') END || ' ' || CASE WHEN length(label) >= w THEN label ELSE rpad(label, w, ' ') END || '  '
          || CASE WHEN length(masked) <= {width} THEN masked ELSE CASE WHEN a > 0 THEN '…' ELSE '' END || substr(masked, a + 1, z - a) || CASE WHEN z < length(masked) THEN '…' ELSE '' END END AS shown FROM (
        SELECT *, greatest(0, z - {width}) AS a FROM (
            SELECT *, least(length(masked), greatest(0, s - start - {width // 2}) + {width}) AS z FROM (
                SELECT *, substr(t, start + 1, s - start) || '[' || label || ']' || substr(t, e + 1, stop - e) AS masked FROM (
                    SELECT *, row_number() OVER (PARTITION BY k ORDER BY s) - 1 AS position, least(max(length(label)) OVER (PARTITION BY k), {most})::INTEGER AS w,
                           length(b) - length(replace(b, chr(10), '')) + 1 AS line, length(b) - length(string_split(b, chr(10))[-1]) AS start,
                           CASE WHEN strpos(substr(t, e + 1), chr(10)) > 0 THEN e + strpos(substr(t, e + 1), chr(10)) - 1 ELSE length(t) END AS stop
                    FROM (SELECT *, substr(t, 1, s) AS b FROM ({resolved}))))))"""



def audit(source: str, key: str, resolved: str, salt: str) -> str:
    """Rows (k, audit): the pretty-printed JSON document of each row of ``source``."""
    fields = [("kind", "kind", True), ("label", "label", True), ("detector", "kind", True), ("start", "s", False), ("end", "e", False), ("length", "e - s", False), ("fingerprint", f"substr(sha256({quote(salt)} || v), 1, 12)", True)]
    quoted = ["'    \"" + name + "\" : " + ("\"' || " + value + " || '\"'" if text else "' || (" + value + ")") for name, value, text in fields]
    record = "'{' || chr(10) || " + " || ',' || chr(10) || ".join(quoted) + " || chr(10) || '  }'"
    return f"""SELECT x.k, '{{' || chr(10) || '  "version" : 1,' || chr(10) || '  "salt" : "{salt}",' || chr(10) || '  "redaction_count" : ' || coalesce(y.n, 0) || ',' || chr(10)
          || '  "records" : [ ' || coalesce(y.body || ' ', '') || ']' || chr(10) || '}}' AS audit
        FROM (SELECT {key} AS k FROM {source}) AS x LEFT JOIN (SELECT k, count(*) AS n, string_agg({record}, ', ' ORDER BY s) AS body FROM ({resolved}) GROUP BY k) AS y USING (k)"""
