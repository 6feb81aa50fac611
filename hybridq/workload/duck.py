"""Building blocks of the DuckDB twins: expressions and common table expressions.

Written against the rules, not against the Spark code, so that a twin is a second
opinion.  DuckDB's regular expressions have no look-around; boundaries are either
`\\b` or consumed characters.
"""

from __future__ import annotations

from hybridq import vocab
from hybridq.workload.tables import VIEWS, duck_sql

CTES: dict[str, tuple[list[str], str]] = {name: (needs, duck_sql(text)) for name, (needs, text) in VIEWS.items()}


def cte(name: str, needs: list[str], sql: str) -> None:
    CTES[name] = (needs, sql)


def with_ctes(final: str, *names: str) -> str:
    """SQL text with every needed CTE in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order or name not in CTES:
            return
        for need in CTES[name][0]:
            visit(need)
        order.append(name)

    for name in names:
        visit(name)
    body = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    return f"WITH RECURSIVE {body}\n{final}" if order else final


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case_of(expr: str, mapping: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {q(str(k))} THEN {v if isinstance(v, int) else q(v)}" for k, v in mapping.items())
    return f"CASE {expr} {arms} ELSE {default} END"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


def half_up(expr: str, digits: int) -> str:
    n = 10**digits
    return f"(floor(({expr}) * {n}.0 + 0.5) / {n}.0)"


def joined(expr: str, sep: str = "|") -> str:
    return f"coalesce(array_to_string({expr}, {q(sep)}), '')"


# --- tokens -----------------------------------------------------------------
def phrases(expr: str) -> str:
    out = f"lower(coalesce({expr}, ''))"
    for phrase in sorted(vocab.PHRASES, key=len, reverse=True):
        out = f"replace({out}, {q(phrase)}, {q(' ' + vocab.PHRASES[phrase] + ' ')})"
    return out


def tokens(expr: str) -> str:
    words = (
        f"list_filter(string_split_regex({phrases(expr)}, '[^a-z0-9+#]+'), "
        f"lambda w: w <> '' AND w NOT IN {in_list(vocab.STOPWORDS)})"
    )
    mapped = f"list_transform({words}, lambda w: {case_of('w', vocab.SYNONYMS, 'w')})"
    return (
        f"list_transform({mapped}, lambda w: CASE WHEN length(w) > 4 AND w LIKE '%s' AND w NOT LIKE '%ss' "
        "THEN left(w, length(w) - 1) ELSE w END)"
    )


def concepts_of(expr: str) -> str:
    arms = " ".join(
        f"WHEN {q(k)} THEN [{', '.join(q(x) for x in v)}]" for k, v in vocab.CONCEPTS.items()
    )
    return f"(CASE {expr} {arms} ELSE []::VARCHAR[] END)"


def ordered_distinct(expr: str) -> str:
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


HASH32 = "('0x' || substr(md5(feature), 1, 8))::BIGINT"


# --- formats ----------------------------------------------------------------
def lakhs(expr: str) -> str:
    t = f"((({expr}) + 5000) // 10000)"
    return f"(CAST({t} // 10 AS VARCHAR) || CASE WHEN {t} % 10 > 0 THEN '.' || CAST({t} % 10 AS VARCHAR) ELSE '' END)"


def salary(p: str = "") -> str:
    lo, hi = lakhs(f"{p}salary_min"), lakhs(f"{p}salary_max")
    return (
        f"(CASE WHEN {p}currency IS NULL OR upper({p}currency) = 'INR' THEN '₹' || CASE WHEN {lo} = {hi} THEN {lo} "
        f"ELSE {lo} || '-' || {hi} END || ' LPA' ELSE {p}currency || ' ' || format('{{:,}}', {p}salary_min) || '-' || "
        f"format('{{:,}}', {p}salary_max) END)"
    )


def years(p: str = "") -> str:
    return (
        f"(CASE WHEN {p}experience_min = {p}experience_max THEN {p}experience_min || "
        f"CASE WHEN {p}experience_min = 1 THEN ' year' ELSE ' years' END "
        f"ELSE {p}experience_min || '-' || {p}experience_max || ' years' END)"
    )


def label(expr: str) -> str:
    return f"coalesce({case_of(f'upper({expr})', vocab.EMPLOYMENT_LABELS)}, {expr}, 'Not specified')"


def bullets(expr: str, empty: str = "- Not specified") -> str:
    body = strip(f"array_to_string(list_transform({expr}, lambda x: '- ' || x), chr(10))")
    return f"(CASE WHEN coalesce(len({expr}), 0) = 0 THEN {q(empty)} ELSE {body} END)"


# --- chunking ---------------------------------------------------------------
def chunk_ctes(name: str, needs: list[str], source: str) -> None:
    """Defines <name>(k, chunk_index, part) from `source` yielding (k, body, lim)."""
    cte(f"{name}_src", needs, f"SELECT k, {strip('body')} AS body, lim FROM ({source}) WHERE {strip('body')} <> ''")
    pieces = (
        "string_split(regexp_replace(regexp_replace(body, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), "
        "'\\n+', chr(1), 'g'), chr(1))"
    )
    cte(
        f"{name}_sent",
        [f"{name}_src"],
        f"""SELECT k, lim, unnest(list_filter(list_transform({pieces}, lambda s: {strip('s')}), lambda s: s <> '')) AS s,
         generate_subscripts(list_filter(list_transform({pieces}, lambda s: {strip('s')}), lambda s: s <> ''), 1) AS i
         FROM {name}_src WHERE length(body) > lim""",
    )
    cte(
        f"{name}_wrap",
        [f"{name}_sent"],
        f"""SELECT k, i, lim, string_split_regex(s, '[ \\t\\n\\x0B\\f\\r]+') AS w, 1::BIGINT AS j, '' AS line, []::VARCHAR[] AS lines
         FROM {name}_sent WHERE length(s) > lim
         UNION ALL
         SELECT k, i, lim, w, j + 1,
          CASE WHEN j > len(w) THEN '' WHEN length(line) + length(w[j]) + 1 > lim AND line <> '' THEN w[j] || ' ' ELSE line || w[j] || ' ' END,
          CASE WHEN (j > len(w) AND line <> '') OR (j <= len(w) AND length(line) + length(w[j]) + 1 > lim AND line <> '')
           THEN list_append(lines, left(line, length(line) - 1)) ELSE lines END
         FROM {name}_wrap WHERE j <= len(w) + 1""",
    )
    cte(
        f"{name}_in",
        [f"{name}_sent", f"{name}_wrap"],
        f"""SELECT t.k, any_value(t.lim) AS lim, list(t.s ORDER BY t.i) AS ss, list(coalesce(x.lines, []::VARCHAR[]) ORDER BY t.i) AS hard
         FROM {name}_sent t LEFT JOIN (SELECT k, i, lines FROM {name}_wrap WHERE j = len(w) + 2) x ON x.k = t.k AND x.i = t.i GROUP BY t.k""",
    )
    cte(
        f"{name}_fold",
        [f"{name}_in"],
        f"""SELECT k, lim, ss, hard, 1::BIGINT AS i, '' AS cur, NULL::VARCHAR AS prev, []::VARCHAR[] AS chunks FROM {name}_in
         UNION ALL
         SELECT k, lim, ss, hard, i + 1,
          CASE WHEN i > len(ss) OR length(ss[i]) > lim THEN ''
               WHEN cur <> '' AND length(cur) + length(ss[i]) + 1 > lim THEN
                 CASE WHEN prev IS NOT NULL AND length(prev) + length(ss[i]) + 1 <= lim THEN prev || ' ' || ss[i] || ' ' ELSE ss[i] || ' ' END
               ELSE cur || ss[i] || ' ' END,
          CASE WHEN i <= len(ss) AND length(ss[i]) <= lim THEN ss[i] END,
          list_concat(list_concat(chunks,
            CASE WHEN cur <> '' AND (i > len(ss) OR length(ss[i]) > lim OR length(cur) + length(ss[i]) + 1 > lim)
                 THEN [left(cur, length(cur) - 1)] ELSE []::VARCHAR[] END),
            CASE WHEN i <= len(ss) AND length(ss[i]) > lim THEN hard[i] ELSE []::VARCHAR[] END)
         FROM {name}_fold WHERE i <= len(ss) + 1""",
    )
    cte(
        name,
        [f"{name}_src", f"{name}_fold"],
        f"""SELECT k, unnest(chunks) AS part, CAST(generate_subscripts(chunks, 1) - 1 AS INTEGER) AS chunk_index
         FROM {name}_fold WHERE i = len(ss) + 2
         UNION ALL SELECT k, body, 0 FROM {name}_src WHERE length(body) <= lim""",
    )


# --- embeddings -------------------------------------------------------------
def embed_ctes(name: str, needs: list[str], source: str) -> None:
    """<name>_w(k, feature, weight), <name>_b(k, idx, w) and <name>(k, idx, val) from `source` (k, txt)."""
    cte(f"{name}_t", needs, f"SELECT k, {tokens('txt')} AS t FROM ({source})")
    cte(
        f"{name}_w",
        [f"{name}_t"],
        f"""SELECT k, feature, CASE WHEN tf < 1 THEN tf ELSE 1 + ln(tf) END AS weight FROM (
          SELECT k, feature, sum(v) AS tf FROM (
           SELECT k, unnest(t) AS feature, 1.0::DOUBLE AS v FROM {name}_t
           UNION ALL SELECT k, unnest(flatten(list_transform(t, lambda x: {concepts_of('x')}))), 0.35::DOUBLE FROM {name}_t
           UNION ALL SELECT k, unnest(list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1])), 0.5::DOUBLE FROM {name}_t
          ) GROUP BY k, feature)""",
    )
    cte(
        f"{name}_b",
        [f"{name}_w"],
        f"""SELECT k, CAST({HASH32} % 1024 AS INTEGER) AS idx,
          sum(CASE WHEN {HASH32} >= 2147483648 THEN -weight ELSE weight END) AS w FROM {name}_w GROUP BY k, {HASH32} % 1024""",
    )
    cte(
        name,
        [f"{name}_b"],
        f"SELECT k, idx, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS val FROM {name}_b WHERE w <> 0",
    )
