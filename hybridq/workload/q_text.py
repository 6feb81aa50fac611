"""Queries of the document, chunking, token, embedding and vector operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F


from hybridq.functions import formats, vectors
from hybridq.functions.registry import register_functions
from hybridq.functions.chunking import hard_wrap
from hybridq.functions.text import expand_concepts, normalise_phrases, token_bigrams, tokenize
from hybridq.operators import documents as D
from hybridq.operators import embedding as E
from hybridq.workload import duck
from hybridq.workload.duck import chunk_ctes, cte, embed_ctes, half_up, joined, tokens, with_ctes
from hybridq.workload.registry import query
from hybridq.workload.tables import listings, view

c = F.col


def six(col, name):
    return (F.floor(col * 1e6 + F.lit(0.5)) / F.lit(1e6)).alias(name)


# ---------------------------------------------------------------------------
# Formats
# ---------------------------------------------------------------------------
@query(
    "format_lakhs",
    f"SELECT o_orderkey, {duck.lakhs('CAST(floor(o_totalprice * 37) AS BIGINT)')} AS lakhs FROM orders",
)
def format_lakhs(spark, sf):
    return view(spark, sf, "orders").select(
        "o_orderkey", formats.format_lakhs(F.floor(c("o_totalprice") * 37).cast("bigint")).alias("lakhs")
    )


@query("format_salary", with_ctes(f"SELECT id, {duck.salary()} AS salary FROM listings", "listings"))
def format_salary(spark, sf):
    return listings(spark, sf).select(
        "id", formats.format_salary(c("salary_min"), c("salary_max"), c("currency")).alias("salary")
    )


@query("format_experience", with_ctes(f"SELECT id, {duck.years()} AS experience FROM listings", "listings"))
def format_experience(spark, sf):
    return listings(spark, sf).select(
        "id", formats.format_experience(c("experience_min"), c("experience_max")).alias("experience")
    )


@query(
    "employment_label",
    with_ctes(f"SELECT id, {duck.label('employment_type')} AS label, {duck.label('nullif(company, chr(0))')} AS other FROM listings", "listings"),
)
def employment_label(spark, sf):
    return listings(spark, sf).select(
        "id", formats.employment_label(c("employment_type")).alias("label"), formats.employment_label(c("company")).alias("other")
    )


@query("bullet_list", f"SELECT doc_id, {duck.bullets('string_split(text, chr(10))')} AS bullets FROM documents")
def bullet_list(spark, sf):
    return view(spark, sf, "documents").select("doc_id", formats.bullet_list(F.split("text", "\n")).alias("bullets"))


# ---------------------------------------------------------------------------
# Documents and chunks
# ---------------------------------------------------------------------------
def _head(sep):
    yes = "CASE WHEN remote THEN 'Yes' ELSE 'No' END"
    return (
        f"'Job Title: ' || title || {sep} || 'Company: ' || company || {sep} || 'Location: ' || location || {sep} || 'Remote: ' || {yes} || {sep}"
        f" || 'Employment Type: ' || {duck.label('employment_type')} || {sep} || 'Experience: ' || {duck.years()} || {sep} || 'Salary: ' || {duck.salary()}"
    )


_gap = "chr(10) || chr(10)"
DOCUMENT = (
    f"{_head(_gap)} || {_gap} || 'Skills:' || chr(10) || array_to_string(skills, ', ') || {_gap} || 'Description:' || chr(10) || coalesce(description, 'null')"
    f" || {_gap} || 'Requirements:' || chr(10) || {duck.bullets('requirements')} || {_gap} || 'Responsibilities:' || chr(10) || {duck.bullets('responsibilities')}"
    f" || {_gap} || 'Benefits:' || chr(10) || {duck.bullets('benefits')}"
)


@query("build_document", with_ctes(f"SELECT id, {duck.strip(DOCUMENT)} AS document FROM listings", "listings"))
def build_document(spark, sf):
    return D.build_document(listings(spark, sf))


_header = "'Job: ' || title || ' at ' || company || ' (' || location || CASE WHEN remote THEN ', remote' ELSE '' END || ')'"
cte(
    "listing_sections",
    ["listings"],
    f"""SELECT id, unnest(['OVERVIEW', 'SKILLS', 'REQUIREMENTS', 'RESPONSIBILITIES', 'BENEFITS']) AS section, unnest([0, 1, 2, 3, 4]) AS sno,
    unnest([NULL, {_header}, {_header}, {_header}, {_header}]) AS header,
    unnest([{_head('chr(10)')} || chr(10) || 'Description: ' || coalesce(description, 'null'), 'Skills: ' || array_to_string(skills, ', '),
      'Requirements:' || chr(10) || {duck.bullets('requirements')}, 'Responsibilities:' || chr(10) || {duck.bullets('responsibilities')},
      'Benefits:' || chr(10) || {duck.bullets('benefits')}]) AS body FROM listings""",
)
chunk_ctes(
    "lc",
    ["listing_sections"],
    "SELECT id * 5 + sno AS k, body, CASE WHEN header IS NULL THEN 900 ELSE greatest(200, 900 - length(header) - 1) END AS lim FROM listing_sections",
)
cte(
    "listing_chunks",
    ["lc", "listing_sections"],
    """SELECT s.id, s.section, l.chunk_index, concat_ws(chr(10), s.header, l.part) AS part_text,
    'job-' || s.id || '-' || lower(s.section) || '-' || l.chunk_index AS document_id
    FROM lc l JOIN listing_sections s ON s.id * 5 + s.sno = l.k""",
)


@query("section_documents", with_ctes("SELECT id, section, header, body FROM listing_sections", "listing_sections"))
def section_documents(spark, sf):
    return D.section_documents(listings(spark, sf))


@query(
    "chunk_listings",
    with_ctes(
        """SELECT document_id, c.id AS job_id, section, chunk_index, part_text AS text, concat_ws('|', c.id, title, company, location,
        array_to_string(skills, ', '), CASE WHEN remote THEN 'true' ELSE 'false' END, section) AS metadata
        FROM listing_chunks c JOIN listings l ON l.id = c.id""",
        "listing_chunks",
    ),
)
def chunk_listings(spark, sf):
    keys = ["jobId", "title", "company", "location", "skills", "remote", "section"]
    return D.chunk_listings(listings(spark, sf)).withColumn(
        "metadata", F.concat_ws("|", *[c("metadata")[k] for k in keys])
    )


chunk_ctes("dc", ["documents"], "SELECT doc_id AS k, text AS body, 900 AS lim FROM documents")
cte("document_chunks", ["dc"], "SELECT 'doc-' || k || '-' || chunk_index AS document_id, k AS doc_id, chunk_index, part AS text FROM dc")
chunk_ctes("sc", ["documents"], "SELECT doc_id AS k, text AS body, 120 AS lim FROM documents")


@query("chunk_documents", with_ctes("SELECT * FROM document_chunks", "document_chunks"))
def chunk_documents(spark, sf):
    return D.chunk_documents(view(spark, sf, "documents"))


@query("split_text", with_ctes("SELECT k AS doc_id, chunk_index, part AS text FROM sc", "sc"))
def split_text(spark, sf):
    """A narrow limit, so that most sentences are hard-wrapped."""
    return D.chunk_documents(view(spark, sf, "documents"), max_chars=120).select("doc_id", "chunk_index", "text")


@query("split_text_sql", with_ctes("SELECT k AS doc_id, chunk_index, part AS text FROM sc", "sc"))
def split_text_sql(spark, sf):
    """The same from SQL, by a table function beside the table."""
    register_functions(spark)
    docs = view(spark, sf, "documents")
    return spark.sql("SELECT d.doc_id, c.chunk_index, c.chunk AS text FROM {d} d, LATERAL split_text(d.text, 120) c", d=docs)


# words go to the last line while it stays under the limit with the blank behind each word
_last = "regexp_extract(acc, '[^\\n]*$')"
_wrapped = f"list_reduce(w, lambda acc, x: CASE WHEN length({_last}) + 1 + length(x) + 1 > 200 THEN acc || chr(10) || x ELSE acc || ' ' || x END)"
cte(
    "hw",
    ["documents"],
    f"""SELECT doc_id, string_split({_wrapped}, chr(10)) AS lines
    FROM (SELECT doc_id, string_split_regex({duck.strip('text')}, '[ \\t\\n\\x0B\\f\\r]+') AS w FROM documents)""",
)


@query(
    "hard_wrap",
    with_ctes("SELECT doc_id, CAST(unnest(range(len(lines))) AS INTEGER) AS line_no, unnest(lines) AS line FROM hw", "hw"),
)
def hard_wrap_query(spark, sf):
    """Whole documents wrapped at 200 characters."""
    from hybridq.functions.strings import strip

    return view(spark, sf, "documents").select(
        "doc_id", F.posexplode(hard_wrap(strip(c("text")), F.lit(200))).alias("line_no", "line")
    )


_body = "CASE WHEN part_text LIKE 'Job: %' AND contains(part_text, chr(10)) THEN substr(part_text, instr(part_text, chr(10)) + 1) ELSE part_text END"


def _cut(expr, n):
    return f"CASE WHEN length({expr}) > {n} THEN left({expr}, {n}) || '...' ELSE {expr} END"


@query(
    "excerpts",
    with_ctes(
        f"""SELECT document_id, body AS stripped, {_cut("replace(body, chr(10), ' ')", 400)} AS excerpt, {_cut("replace(part_text, chr(10), ' ')", 220)} AS preview
        FROM (SELECT document_id, part_text, {_body} AS body FROM listing_chunks)""",
        "listing_chunks",
    ),
)
def excerpts(spark, sf):
    chunks = D.chunk_listings(listings(spark, sf))
    return chunks.select(
        "document_id", D.strip_header(c("text")).alias("stripped"), D.excerpt(c("text")).alias("excerpt"),
        D.preview(c("text")).alias("preview"),
    )


@query(
    "chunks_of_document",
    with_ctes("SELECT document_id, id AS job_id, part_text AS text FROM listing_chunks WHERE id IN (SELECT s_suppkey FROM supplier)", "listing_chunks"),
)
def chunks_of_document(spark, sf):
    ids = view(spark, sf, "supplier").select(c("s_suppkey").alias("job_id"))
    return D.chunks_of_document(D.chunk_listings(listings(spark, sf)), ids).select("document_id", "job_id", "text")


# ---------------------------------------------------------------------------
# Tokens and features
# ---------------------------------------------------------------------------
@query("normalise_phrases", with_ctes(f"SELECT query_id, {duck.phrases('text')} AS text FROM requests", "requests"))
def phrases(spark, sf):
    return view(spark, sf, "requests").select("query_id", normalise_phrases(c("text")).alias("text"))


@query(
    "tokenize",
    with_ctes(
        f"SELECT 'd' AS source, doc_id AS id, {joined(tokens('text'))} AS tokens FROM documents UNION ALL SELECT 'q', query_id, {joined(tokens('text'))} FROM requests",
        "requests",
    ),
)
def tokenize_query(spark, sf):
    row = lambda df, tag, key: df.select(
        F.lit(tag).alias("source"), c(key).alias("id"), F.array_join(tokenize(c("text")), "|").alias("tokens")
    )
    return row(view(spark, sf, "documents"), "d", "doc_id").unionByName(row(view(spark, sf, "requests"), "q", "query_id"))


@query(
    "expand_concepts",
    with_ctes(
        f"""SELECT query_id, {joined("flatten(list_transform(t, lambda x: list_concat([x], " + duck.concepts_of('x') + ")))")} AS terms
        FROM (SELECT query_id, {tokens('text')} AS t FROM requests)""",
        "requests",
    ),
)
def expand(spark, sf):
    return view(spark, sf, "requests").select(
        "query_id", F.array_join(expand_concepts(tokenize(c("text"))), "|").alias("terms")
    )


@query(
    "token_bigrams",
    f"""SELECT doc_id, {joined("list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1])")} AS bigrams
    FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)""",
)
def bigrams(spark, sf):
    return view(spark, sf, "documents").select(
        "doc_id", F.array_join(token_bigrams(tokenize(c("text"))), "|").alias("bigrams")
    )


embed_ctes("de", ["documents"], "SELECT doc_id AS k, text AS txt FROM documents")
embed_ctes("le", ["listing_chunks"], "SELECT document_id AS k, part_text AS txt FROM listing_chunks")


@query(
    "feature_weights", with_ctes(f"SELECT k AS doc_id, feature, {half_up('weight', 6)} AS weight FROM de_w", "de_w")
)
def weights(spark, sf):
    w = E.feature_weights(view(spark, sf, "documents"), ["doc_id"]).where(c("feature").isNotNull())
    return w.select("doc_id", "feature", six(c("weight"), "weight"))


@query("hash_features", with_ctes(f"SELECT k AS doc_id, idx, {half_up('w', 6)} AS w FROM de_b", "de_b"))
def hashed(spark, sf):
    b = E.hash_features(E.feature_weights(view(spark, sf, "documents"), ["doc_id"]), ["doc_id"])
    return b.where(c("idx").isNotNull()).select("doc_id", "idx", six(c("w"), "w"))


@query("embed_hashing", with_ctes(f"SELECT k AS doc_id, idx, {half_up('val', 6)} AS val FROM de", "de"))
def embed(spark, sf):
    e = E.embed_hashing(view(spark, sf, "documents"), ["doc_id"])
    return e.select("doc_id", F.inline(F.arrays_zip("idx", "val"))).select("doc_id", "idx", six(c("val"), "val"))


def letter_counts(texts):
    """A stand-in for an external model: frequencies of the 26 letters."""
    out = []
    for t in texts:
        raw = np.frombuffer(t.lower().encode("utf-8"), dtype=np.uint8).astype(int) - 97
        out.append(np.bincount(raw[(raw >= 0) & (raw < 26)], minlength=26))
    return out


@query(
    "embed_with",
    """SELECT doc_id, CAST(i AS INTEGER) AS position, length(t) - length(replace(t, chr(CAST(97 + i AS INTEGER)), '')) AS value
    FROM (SELECT doc_id, lower(text) AS t FROM documents), range(0, 26) r(i)""",
)
def embed_with(spark, sf):
    out = E.embed_with(view(spark, sf, "documents").select("doc_id", "text"), letter_counts)
    return out.select("doc_id", F.posexplode("embedding").alias("position", "value")).select(
        "doc_id", "position", c("value").cast("bigint").alias("value")
    )


@query(
    "choose_embedder",
    f"""SELECT 'full' AS mode, vec_id AS document_id, 'remote' AS provider, array_to_string(list_transform(embedding, lambda x: {half_up('x::DOUBLE', 6)}::DECIMAL(18, 6)), '|') AS x FROM embeddings
    UNION ALL SELECT 'gaps', vec_id, 'local', array_to_string(list_transform(embedding, lambda x: {half_up('-x::DOUBLE', 6)}::DECIMAL(18, 6)), '|') FROM embeddings""",
)
def choose(spark, sf):
    e = view(spark, sf, "embeddings").select(c("vec_id").alias("document_id"), "embedding", "label")
    local = e.withColumn("embedding", F.transform("embedding", lambda x: -x))
    gaps = e.withColumn("embedding", F.when(c("label") != 3, c("embedding")))
    out = None
    for mode, remote in (("full", e), ("gaps", gaps)):
        part = E.choose_embedder(remote, local, e).select(
            F.lit(mode).alias("mode"), "document_id", "provider", F.array_join(F.transform("embedding", lambda x: (F.floor(x.cast("double") * 1e6 + F.lit(0.5)) / F.lit(1e6)).cast("decimal(18,6)").cast("string")), "|").alias("x")
        )
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------------------
# Vectors
# ---------------------------------------------------------------------------
@query(
    "l2_normalise",
    f"""SELECT vec_id, array_to_string(list_transform(e, lambda x: CAST(CAST(floor(x / n * 1e6 + 0.5) AS BIGINT) AS VARCHAR)), '|') AS unit
    FROM (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM
      (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id)) AS e FROM embeddings))""",
)
def l2_normalise(spark, sf):
    e = view(spark, sf, "embeddings").withColumn("e", F.transform("embedding", lambda x: x.cast("double") * (1 + c("vec_id"))))
    unit = F.transform(vectors.l2_normalise(c("e")), lambda x: F.floor(x * 1e6 + F.lit(0.5)).cast("bigint").cast("string"))
    return e.select("vec_id", F.array_join(unit, "|").alias("unit"))


_pairs = """(SELECT a.vec_id, a.embedding::DOUBLE[] AS u, b.embedding::DOUBLE[] AS w
 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def neighbours(spark, sf):
    e = view(spark, sf, "embeddings")
    after = e.select((c("vec_id") - 1).alias("vec_id"), c("embedding").alias("w"))
    return e.select("vec_id", c("embedding").alias("u")).join(after, "vec_id")


@query("dot_product", f"SELECT vec_id, {half_up('list_dot_product(u, w)', 6)} AS dot FROM {_pairs}")
def dot(spark, sf):
    return neighbours(spark, sf).select("vec_id", six(vectors.dot_product(c("u"), c("w")), "dot"))


@query("cosine_similarity", f"SELECT vec_id, {half_up('list_cosine_similarity(u, w)', 6)} AS cosine FROM {_pairs}")
def cosine(spark, sf):
    return neighbours(spark, sf).select("vec_id", six(vectors.cosine_similarity(c("u"), c("w")), "cosine"))


@query("cosine_similarity_sql", f"SELECT vec_id, {half_up('list_cosine_similarity(u, w)', 6)} AS cosine FROM {_pairs}")
def cosine_sql(spark, sf):
    register_functions(spark)
    return spark.sql("SELECT vec_id, round_half_up(cosine_similarity(u, w), 6) AS cosine FROM {p}", p=neighbours(spark, sf))


@query(
    "register_functions",
    with_ctes(
        f"""SELECT id, {duck.lakhs('salary_min')} AS pay, {duck.years()} AS experience, {half_up('salary_min / 7.0', 3)} AS rounded,
        CAST(floor(experience_min / 13.0 * 100 + 0.5) AS INTEGER) AS percent FROM listings""",
        "listings",
    ),
)
def registered(spark, sf):
    register_functions(spark)
    return spark.sql(
        """SELECT id, format_lakhs(salary_min) AS pay, format_experience(experience_min, experience_max) AS experience,
        round_half_up(CAST(salary_min AS DOUBLE) / 7.0D, 3) AS rounded,
        match_percent(CAST(experience_min AS DOUBLE) / 13.0D) AS percent FROM {l}""",
        l=listings(spark, sf),
    )


def document_chunks(spark, sf):
    return D.chunk_documents(view(spark, sf, "documents"))


