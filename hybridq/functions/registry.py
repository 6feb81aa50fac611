"""SQL-callable functions."""

from pyspark.sql import SparkSession

from hybridq.functions.chunking import SENTENCE_BREAK

# name -> (parameters, return type, body).  Bodies are plain SQL, so Catalyst inlines them.
SQL_FUNCTIONS = {
    "format_lakhs": (
        "amount BIGINT",
        "STRING",
        "regexp_replace(format_string('%s', cast(round(cast(amount AS DECIMAL(20,0)) / 100000, 1) AS DECIMAL(20,1))), '[.]0$', '')",
    ),
    "format_experience": (
        "low INT, high INT",
        "STRING",
        "CASE WHEN low = high THEN concat(low, CASE WHEN low = 1 THEN ' year' ELSE ' years' END) "
        "ELSE concat(low, '-', high, ' years') END",
    ),
    "dot_product": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
        "DOUBLE",
        "aggregate(zip_with(slice(a, 1, least(size(a), size(b))), slice(b, 1, least(size(a), size(b))), (x, y) -> x * y), "
        "cast(0 AS DOUBLE), (acc, x) -> acc + x)",
    ),
    "round_half_up": ("v DOUBLE, digits INT", "DOUBLE", "floor(v * power(10, digits) + 0.5) / power(10, digits)"),
    "match_percent": ("score DOUBLE", "INT", "cast(floor(score * 100 + 0.5) AS INT)"),
}


_STRIP = "regexp_replace({0}, r'^[\\x00-\\x20]+|[\\x00-\\x20]+$', '')"
_NONE = "cast(array() AS ARRAY<STRING>)"
_NORM = "sqrt(aggregate({0}, cast(0 AS DOUBLE), (acc, x) -> acc + x * x))"


def _once(value: str, name: str, body: str) -> str:
    """`body` with `name` standing for `value`, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _done(line: str) -> str:
    return f"array(substr({line}, 1, length({line}) - 1))"


def _wrapped(sentence: str, limit: str) -> str:
    """SQL of chunking.hard_wrap."""
    full = f"length(a.line) + length(w) + 1 > {limit} AND a.line <> ''"
    return (
        f"aggregate(split({sentence}, r'\\s+'), named_struct('lines', {_NONE}, 'line', ''), "
        f"(a, w) -> named_struct('lines', CASE WHEN {full} THEN concat(a.lines, {_done('a.line')}) ELSE a.lines END, "
        f"'line', concat(CASE WHEN {full} THEN '' ELSE a.line END, w, ' ')), "
        f"a -> CASE WHEN a.line = '' THEN a.lines ELSE concat(a.lines, {_done('a.line')}) END)"
    )


def _packed(text: str, limit: str) -> str:
    """SQL of chunking.split_text, for a text that is stripped."""
    sentences = f"filter(transform(split({text}, r'{SENTENCE_BREAK}'), s -> {_STRIP.format('s')}), s -> s <> '')"
    long, open_ = f"length(s) > {limit}", "p.current <> ''"
    over = f"{open_} AND length(p.current) + length(s) + 1 > {limit}"
    overlap = f"p.previous IS NOT NULL AND length(p.previous) + length(s) + 1 <= {limit}"
    chunks = (
        f"CASE WHEN {long} AND {open_} THEN concat(p.chunks, {_done('p.current')}, {_wrapped('s', limit)}) "
        f"WHEN {long} THEN concat(p.chunks, {_wrapped('s', limit)}) "
        f"WHEN {over} THEN concat(p.chunks, {_done('p.current')}) ELSE p.chunks END"
    )
    current = (
        f"CASE WHEN {long} THEN '' WHEN {over} AND {overlap} THEN concat(p.previous, ' ', s, ' ') "
        f"WHEN {over} THEN concat(s, ' ') ELSE concat(p.current, s, ' ') END"
    )
    fold = (
        f"aggregate({sentences}, named_struct('chunks', {_NONE}, 'current', '', 'previous', cast(NULL AS STRING)), "
        f"(p, s) -> named_struct('chunks', {chunks}, 'current', {current}, 'previous', CASE WHEN {long} THEN NULL ELSE s END), "
        f"p -> CASE WHEN p.current = '' THEN p.chunks ELSE concat(p.chunks, {_done('p.current')}) END)"
    )
    return f"CASE WHEN {text} = '' THEN {_NONE} WHEN length({text}) <= {limit} THEN array({text}) ELSE {fold} END"


SQL_FUNCTIONS["cosine_similarity"] = (
    "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
    "DOUBLE",
    _once(
        f"{_NORM.format('cosine_similarity.a')} * {_NORM.format('cosine_similarity.b')}", "size_ab",
        f"CASE WHEN size_ab = 0 THEN cast(0 AS DOUBLE) ELSE {SQL_FUNCTIONS['dot_product'][2]} / size_ab END",
    ),
)
SQL_FUNCTIONS["text_chunks"] = (
    "body STRING, most INT",
    "ARRAY<STRING>",
    _once(_STRIP.format("coalesce(text_chunks.body, '')"), "t", _packed("t", "text_chunks.most")),
)

# name -> (parameters, columns, query).  Called in FROM, with LATERAL for the columns of another table; Catalyst
# makes a generator of such a call as long as the query is nothing but a generator; with a filter it joins on the text.
TABLE_FUNCTIONS = {
    "split_text": (
        "body STRING, most INT",
        "chunk_index INT, chunk STRING",
        "SELECT pos, col FROM posexplode("
        + _once(_STRIP.format("coalesce(split_text.body, '')"), "t", _packed("t", "split_text.most"))
        + ")",
    ),
    "text_sentences": (
        "body STRING",
        "sentence_index INT, sentence STRING",
        "SELECT pos, col FROM posexplode("
        f"filter(transform(split({_STRIP.format('text_sentences.body')}, r'{SENTENCE_BREAK}'), s -> {_STRIP.format('s')}), s -> s <> '')"
        ")",
    ),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create the temporary functions and table functions; returns their names."""
    for name, (params, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
    for name, (params, columns, body) in TABLE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS TABLE ({columns}) RETURN {body}")
    return [*SQL_FUNCTIONS, *TABLE_FUNCTIONS]
