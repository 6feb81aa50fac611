"""Queries of filters, gates, retrieval, scoring, ranking and the whole search."""

from __future__ import annotations

from pyspark.sql import functions as F

from hybridq import vocab
from hybridq.operators import filters as X
from hybridq.operators import keywords as K
from hybridq.operators import retrieval as R
from hybridq.operators import scoring as S
from hybridq.operators.documents import chunk_documents
from hybridq.operators.embedding import document_index, embed_hashing
from hybridq.plans import search as P
from hybridq.plans.stages import materialise
from hybridq.workload import duck
from hybridq.workload.duck import cte, embed_ctes, half_up, in_list, joined, ordered_distinct, tokens, with_ctes
from hybridq.workload.q_text import document_chunks
from hybridq.workload.registry import query
from hybridq.workload.tables import listing_facts, listing_index, listings, query_log, staged, view, words

c = F.col
KEY = "floor(({}) * 1e9 + 0.5)"

cte(
    "ql",
    ["query_log"],
    """SELECT *, coalesce(string_split(skill_words, ' '), []::VARCHAR[]) AS skills, coalesce(string_split(keyword_words, ' '), []::VARCHAR[]) AS keywords FROM query_log""",
)


def flat(name):
    return F.array_join(c(name).cast("array<string>"), "|").alias(name)


# ---------------------------------------------------------------------------
# Filters
# ---------------------------------------------------------------------------
P_REMOTE = "(q.remote IS NULL OR l.remote = q.remote)"
P_PLACE = "(q.location IS NULL OR coalesce(q.remote, false) OR contains(lower(l.location), lower(q.location)))"
P_PAY = "(q.salary_min IS NULL OR l.salary_max >= q.salary_min) AND (q.salary_max IS NULL OR l.salary_min <= q.salary_max)"
P_EXP = "(q.experience_max IS NULL OR l.experience_min <= q.experience_max) AND (q.experience_min IS NULL OR l.experience_max >= q.experience_min)"
P_TYPE = "(q.employment_type IS NULL OR l.employment_type = q.employment_type)"
P_ALL = f"{P_REMOTE} AND {P_PLACE} AND {P_PAY} AND {P_EXP} AND {P_TYPE}"


@query(
    "filter_candidates",
    with_ctes(f"SELECT q.query_id, l.id FROM ql q JOIN listings l ON {P_ALL}", "ql", "listings"),
)
def filter_candidates(spark, sf):
    return X.filter_candidates(query_log(spark, sf), listing_facts(spark, sf))


cte("delivered", ["lineitem"], "SELECT DISTINCT l_suppkey AS query_id, l_partkey AS id FROM lineitem")


def pairs(spark, sf, *more):
    """A given table of pairs, what each supplier delivered, with the criteria of one side and the facts of the other."""
    given = view(spark, sf, "lineitem").select(c("l_suppkey").alias("query_id"), c("l_partkey").alias("id")).distinct()
    facts = listings(spark, sf).select(*X.FACTS, *more)
    return given.join(query_log(spark, sf).select("query_id", "criteria"), "query_id").join(facts, "id")


def only(spark, sf, **keep):
    """The query log with every filter but the named ones removed."""
    from hybridq.operators.understanding import criteria_struct

    k = c("criteria")
    fields = {n: k[n] for n in keep}
    return query_log(spark, sf).select("query_id", criteria_struct(**fields).alias("criteria"))


@query("pred_remote", with_ctes(f"SELECT q.query_id, l.id FROM ql q JOIN listings l ON {P_REMOTE}", "ql", "listings"))
def pred_remote(spark, sf):
    return X.filter_candidates(only(spark, sf, remote=1), listing_facts(spark, sf))


@query("pred_location", with_ctes(f"SELECT q.query_id, l.id FROM ql q JOIN listings l ON {P_REMOTE} AND {P_PLACE}", "ql", "listings"))
def pred_location(spark, sf):
    return X.filter_candidates(only(spark, sf, remote=1, location=1), listing_facts(spark, sf))


@query("pred_salary_overlap", with_ctes(f"SELECT q.query_id, l.id FROM ql q JOIN listings l ON {P_PAY}", "ql", "listings"))
def pred_salary(spark, sf):
    return X.filter_candidates(only(spark, sf, salary_min=1, salary_max=1), listing_facts(spark, sf))


@query("pred_experience_overlap", with_ctes(f"SELECT q.query_id, l.id FROM ql q JOIN listings l ON {P_EXP}", "ql", "listings"))
def pred_experience(spark, sf):
    return X.filter_candidates(only(spark, sf, experience_min=1, experience_max=1), listing_facts(spark, sf))


@query("pred_employment_type", with_ctes(f"SELECT q.query_id, l.id FROM ql q JOIN listings l ON {P_TYPE}", "ql", "listings"))
def pred_type(spark, sf):
    return X.filter_candidates(only(spark, sf, employment_type=1), listing_facts(spark, sf))


# earlier result lists: the parts each supplier delivered; some suppliers carry an empty list
RESTRICT = """SELECT s_suppkey AS query_id, CASE WHEN s_suppkey % 6 = 0 THEN 'none' WHEN s_suppkey % 5 = 2 THEN 'free' ELSE 'list' END AS kind FROM supplier"""
cte("limits", ["supplier"], RESTRICT)
_LIMITED = """JOIN limits k ON k.query_id = q.query_id WHERE k.kind = 'free' OR (k.kind = 'list' AND EXISTS
 (SELECT 1 FROM lineitem i WHERE i.l_suppkey = q.query_id AND i.l_partkey = l.id))"""


def restrictions(spark, sf):
    kinds = spark.sql(RESTRICT.replace("FROM supplier", "FROM {s}"), s=view(spark, sf, "supplier"))
    delivered = (
        view(spark, sf, "lineitem").groupBy(c("l_suppkey").alias("query_id")).agg(F.collect_set("l_partkey").alias("ids"))
    )
    none = F.array().cast("array<bigint>")
    return kinds.join(delivered, "query_id", "left").select(
        "query_id",
        F.when(c("kind") == "none", none).when(c("kind") == "list", F.coalesce("ids", none)).alias("restrict_ids"),
    )


@query(
    "pred_restrict_ids",
    with_ctes(f"SELECT q.query_id, l.id FROM ql q JOIN listings l ON {P_ALL} {_LIMITED}", "ql", "listings", "limits"),
)
def pred_restrict(spark, sf):
    return X.filter_candidates(query_log(spark, sf).join(restrictions(spark, sf), "query_id"), listing_facts(spark, sf))


GATE_SKILL = "len(list_intersect(list_transform(q.skills, lambda s: lower(s)), list_transform(l.skills, lambda s: lower(s)))) > 0"
cte(
    "listing_terms",
    ["listings"],
    f"""SELECT DISTINCT id, unnest({tokens("concat_ws(' ', title, array_to_string(skills, ' '), description, array_to_string(requirements, ' '), array_to_string(responsibilities, ' '))")}) AS term FROM listings""",
)
cte(
    "query_terms",
    ["ql"],
    f"""SELECT DISTINCT query_id, unnest(list_concat([t], {duck.concepts_of('t')})) AS term FROM (
      SELECT query_id, unnest({tokens("array_to_string(keywords, ' ')")}) AS t FROM ql WHERE len(skills) = 0)""",
)
cte(
    "gated",
    ["ql", "listings", "listing_terms", "query_terms"],
    f"""SELECT q.query_id, l.id FROM ql q JOIN listings l ON len(q.skills) > 0 AND {GATE_SKILL}
    UNION SELECT t.query_id, x.id FROM query_terms t JOIN listing_terms x USING (term)
    UNION SELECT q.query_id, l.id FROM ql q CROSS JOIN listings l WHERE len(q.skills) = 0 AND len(q.keywords) = 0""",
)


@query(
    "topic_gate_skills",
    with_ctes(f"SELECT q.query_id, l.id FROM ql q JOIN listings l ON {GATE_SKILL}", "ql", "listings"),
)
def gate_skills(spark, sf):
    return X.topic_gate_skills(query_log(spark, sf), listing_facts(spark, sf)).select("query_id", "id")


@query(
    "topic_gate_keywords",
    with_ctes("SELECT DISTINCT t.query_id, x.id FROM query_terms t JOIN listing_terms x USING (term)", "query_terms", "listing_terms"),
)
def gate_keywords(spark, sf):
    return X.topic_gate_keywords(query_log(spark, sf), listings(spark, sf)).select("query_id", "id").distinct()


# which listings pass which topic gate, as the joins that find them
@query("topic_pairs", with_ctes("SELECT g.query_id, g.id FROM gated g JOIN ql q ON q.query_id = g.query_id WHERE len(q.skills) > 0 OR len(q.keywords) > 0", "gated", "ql"))
def topic_pairs(spark, sf):
    q, rows = query_log(spark, sf), listings(spark, sf)
    by_skill = X.topic_gate_skills(q.where(F.size("criteria.skills") > 0), rows)
    return by_skill.unionByName(X.topic_gate_keywords(q, rows)).select("query_id", "id")


# ---------------------------------------------------------------------------
# Retrieval
# ---------------------------------------------------------------------------
def vector_sql(where: str) -> str:
    return f"""SELECT query_id, vec_id, {half_up('score', 6)} AS score, rank FROM (
     SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY {KEY.format('score')} DESC, vec_id) AS rank FROM (
      SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
      FROM embeddings a JOIN embeddings b ON {where})) WHERE rank <= 20"""


def rounded(hits, item):
    return hits.select("query_id", item, (F.floor(c("score") * 1e6 + F.lit(0.5)) / F.lit(1e6)).alias("score"), "rank")


def vectors_of(spark, sf):
    e = view(spark, sf, "embeddings")
    return e.select(c("vec_id").alias("query_id"), "embedding", "label"), e.select("vec_id", "embedding", "label")


@query("vector_topk", vector_sql("true"))
def vector_topk(spark, sf):
    q, x = vectors_of(spark, sf)
    return rounded(R.vector_topk(q, x, 20, 64, item_key="vec_id"), "vec_id")


@query("vector_topk_filtered", vector_sql("a.label = b.label"))
def vector_topk_filtered(spark, sf):
    q, x = vectors_of(spark, sf)
    return rounded(R.vector_topk(q, x, 20, 64, match_on="label", item_key="vec_id"), "vec_id")


# candidate pairs given as a table: the vectors a user touched, per user
@query(
    "vector_topk_pairs",
    f"""SELECT query_id, vec_id, {half_up('score', 6)} AS score, rank FROM (
     SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY {KEY.format('score')} DESC, vec_id) AS rank FROM (
      SELECT p.query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
      FROM (SELECT DISTINCT user_id AS query_id, event_id % (SELECT count(*) FROM embeddings) AS vec_id FROM events) p
      JOIN embeddings a ON a.vec_id = p.query_id JOIN embeddings b ON b.vec_id = p.vec_id)) WHERE rank <= 5""",
)
def vector_pairs(spark, sf):
    q, x = vectors_of(spark, sf)
    n = x.count()
    allowed = view(spark, sf, "events").select(c("user_id").alias("query_id"), (c("event_id") % n).alias("vec_id")).distinct()
    hits = R.vector_topk_pairs(q, x.withColumn("item", c("vec_id")), allowed, 5, on="vec_id", item_key="item")
    return rounded(hits.withColumnRenamed("item", "vec_id"), "vec_id")


def keyword_sql(queries: str, chunks: str, k: int, rounded: bool = True) -> str:
    """`queries` yields (query_id, text), `chunks` (document_id, text)."""
    return f"""SELECT query_id, document_id, {half_up('score', 6) if rounded else 'score'} AS score, rank FROM (
     SELECT query_id, document_id, score, row_number() OVER (PARTITION BY query_id ORDER BY {KEY.format('score')} DESC, document_id) AS rank FROM (
      SELECT a.query_id, b.document_id, count(*) / any_value(a.n)::DOUBLE / (1 + ln(1 + any_value(b.len) / 50.0)) AS score FROM
       (SELECT query_id, n, unnest(t) AS term FROM (SELECT query_id, t, len(t) AS n FROM (SELECT query_id, list_distinct({tokens('text')}) AS t FROM ({queries})))) a
       JOIN (SELECT document_id, len, unnest(t) AS term FROM (SELECT document_id, len(t0) AS len, list_distinct(t0) AS t FROM (SELECT document_id, {tokens('text')} AS t0 FROM ({chunks})))) b
       USING (term) GROUP BY a.query_id, b.document_id)) WHERE rank <= {k}"""


@query(
    "keyword_topk",
    with_ctes(keyword_sql("SELECT item_id AS query_id, text FROM benchmark", "SELECT document_id, text FROM document_chunks", 20), "document_chunks"),
)
def keyword_topk(spark, sf):
    q = view(spark, sf, "benchmark").select(c("item_id").alias("query_id"), "text")
    return rounded(R.keyword_topk(q, document_keywords(spark, sf), 20), "document_id")


# how often a term stands in how many chunks, and how long its shortest chunk is
@query(
    "keyword_index",
    with_ctes(
        f"""SELECT term, count(*) AS df, min(len) AS shortest, CAST(sum(len) AS BIGINT) AS tokens FROM (
          SELECT document_id, len(t) AS len, unnest(list_distinct(t)) AS term FROM (SELECT document_id, {tokens('text')} AS t FROM document_chunks)) GROUP BY term""",
        "document_chunks",
    ),
)
def keyword_index(spark, sf):
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    blocks = document_keywords(spark, sf).postings.select("term", F.size("items").alias("n"), F.element_at("lengths", 1).alias("low"), total.alias("t"))
    return blocks.groupBy("term").agg(F.sum("n").alias("df"), F.min("low").alias("shortest"), F.sum("t").alias("tokens"))


def document_keywords(spark, sf):
    """The keyword index of all document chunks; it asks for no vectors."""
    chunks = lambda: chunk_documents(view(spark, sf, "documents").repartition("doc_id"))
    return kept_keywords(spark, sf, "documents", lambda: K.keyword_index(chunks().select("document_id", c("doc_id").alias("job_id"), "text"), carry=("job_id",)))


def listing_keywords(spark, sf):
    """The keyword index of all listing chunks."""
    return kept_keywords(spark, sf, "listings", lambda: K.keyword_index(listing_index(spark, sf), carry=("job_id",)))


_KEYWORDS = {}


def kept_keywords(spark, sf, name, build):
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _KEYWORDS:
        _KEYWORDS[key] = build()
    return _KEYWORDS[key]


embed_ctes("qe", ["query_log"], "SELECT query_id AS k, text AS txt FROM query_log")
embed_ctes("be", ["benchmark"], "SELECT item_id AS k, text AS txt FROM benchmark")
embed_ctes("ce", ["document_chunks"], "SELECT document_id AS k, text AS txt FROM document_chunks")


def sparse_sql(q: str, x: str) -> str:
    return f"SELECT a.k AS query_id, b.k AS document_id, sum(a.val * b.val) AS score FROM {q} a JOIN {x} b USING (idx) GROUP BY 1, 2"


def hashed_index(spark, sf):
    """Document chunks with their vectors."""
    return staged(spark, sf, "document_index", lambda: document_index(view(spark, sf, "documents")))


# benchmark passages: every third is blank, every fifth has no embedding
_RQ = "SELECT item_id AS query_id, CASE WHEN item_id % 3 = 1 THEN '  ' ELSE text END AS text FROM benchmark"


@query(
    "retrieve",
    with_ctes(
        f"""SELECT m.query_id, m.mode, m.note, h.document_id, h.score, h.rank FROM
        (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 1 THEN 'none' WHEN item_id % 5 = 2 THEN 'keyword' ELSE 'vector' END AS mode,
          CASE WHEN item_id % 3 = 1 THEN 'Empty query' WHEN item_id % 5 = 2 THEN 'Embedding provider ''local'' unavailable; used keyword retrieval' END AS note FROM benchmark) m
        LEFT JOIN (SELECT query_id, document_id, {half_up('score', 6)} AS score, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {KEY.format('score')} DESC, document_id) AS rank FROM ({sparse_sql('be', 'ce')}) WHERE query_id % 3 <> 1 AND query_id % 5 <> 2) WHERE rank <= 20
          UNION ALL ({keyword_sql("SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 3 <> 1 AND item_id % 5 = 2", "SELECT document_id, text FROM document_chunks", 20)})) h USING (query_id)""",
        "be",
        "ce",
    ),
)
def retrieve(spark, sf):
    b = view(spark, sf, "benchmark")
    q = b.select(c("item_id").alias("query_id"), F.when(c("item_id") % 3 == 1, "  ").otherwise(c("text")).alias("text"))
    index = hashed_index(spark, sf)
    vecs = embed_hashing(q.where(c("query_id") % 5 != 2), ["query_id"])
    manifest = spark.range(1).select(F.lit("local").alias("provider"))
    modes, hits = R.retrieve(q, index, manifest, vecs, keywords=document_keywords(spark, sf))
    return modes.join(rounded(hits, "document_id"), "query_id", "left")


# each passage may only see documents of its own residue; passages of some residues may see none
_MAY = "SELECT b.item_id AS query_id, d.doc_id AS job_id FROM benchmark b JOIN documents d ON d.doc_id % 10 = b.item_id % 11"
_MAY_CHUNK = f"JOIN ({_MAY}) may ON may.query_id = {{}}.query_id AND may.job_id = dc.doc_id"


@query(
    "retrieve_allowed",
    with_ctes(
        f"""SELECT m.query_id, m.mode, m.note, h.document_id, h.score, h.rank FROM
        (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 1 OR item_id % 11 = 10 THEN 'none' WHEN item_id % 5 = 2 THEN 'keyword' ELSE 'vector' END AS mode,
          CASE WHEN item_id % 3 = 1 THEN 'Empty query' WHEN item_id % 11 = 10 THEN 'No candidate jobs to search' WHEN item_id % 5 = 2 THEN 'Embedding provider ''local'' unavailable; used keyword retrieval' END AS note FROM benchmark) m
        LEFT JOIN (SELECT query_id, document_id, {half_up('score', 6)} AS score, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {KEY.format('score')} DESC, document_id) AS rank FROM (
            SELECT p.query_id, dc.document_id, coalesce(s.score, 0.0) AS score FROM (SELECT item_id AS query_id FROM benchmark WHERE item_id % 3 <> 1 AND item_id % 5 <> 2) p
            JOIN document_chunks dc ON true {_MAY_CHUNK.format('p')} LEFT JOIN ({sparse_sql('be', 'ce')}) s ON s.query_id = p.query_id AND s.document_id = dc.document_id)) WHERE rank <= 20
          UNION ALL (SELECT query_id, document_id, {half_up('score', 6)} AS score, rank FROM (
            SELECT s.query_id, s.document_id, s.score, row_number() OVER (PARTITION BY s.query_id ORDER BY {KEY.format('score')} DESC, s.document_id) AS rank FROM (
              {keyword_sql("SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 3 <> 1 AND item_id % 5 = 2", "SELECT document_id, text FROM document_chunks", 1 << 30, False)}) s
            JOIN document_chunks dc ON dc.document_id = s.document_id {_MAY_CHUNK.format('s')}) WHERE rank <= 20)) h USING (query_id)""",
        "be", "ce", "document_chunks",
    ),
)
def retrieve_allowed(spark, sf):
    b, d = view(spark, sf, "benchmark"), view(spark, sf, "documents")
    q = b.select(c("item_id").alias("query_id"), F.when(c("item_id") % 3 == 1, "  ").otherwise(c("text")).alias("text"))
    may = b.select(c("item_id").alias("query_id"), (c("item_id") % 11).alias("r")).join(d.select(c("doc_id").alias("job_id"), (c("doc_id") % 10).alias("r")), "r")
    vecs = embed_hashing(q.where(c("query_id") % 5 != 2), ["query_id"])
    index = hashed_index(spark, sf).withColumn("job_id", c("doc_id"))
    manifest = spark.range(1).select(F.lit("local").alias("provider"))
    modes, hits = R.retrieve(q, index, manifest, vecs, allowed=may, keywords=document_keywords(spark, sf))
    return modes.join(rounded(hits, "document_id"), "query_id", "left")


@query(
    "raw_retrieve",
    with_ctes(
        f"""SELECT query_id, rank, document_id, {half_up('score', 4)} AS similarity, text FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {KEY.format('score')} DESC, document_id) AS rank FROM ({sparse_sql('be', 'ce')})) JOIN document_chunks USING (document_id) WHERE rank <= 80""",
        "be",
        "ce",
    ),
)
def raw_retrieve(spark, sf):
    q = view(spark, sf, "benchmark").select(c("item_id").alias("query_id"), "text")
    index = hashed_index(spark, sf).withColumns(
        {"job_id": c("doc_id"), "section": F.lit("TEXT"), "metadata": F.lit("")}
    )
    out = R.raw_retrieve(embed_hashing(q, ["query_id"]), index, 80)
    return out.select("query_id", "rank", "document_id", "similarity", "text")


cte("le_ids", ["le", "listing_chunks"], "SELECT e.k, e.idx, e.val, l.id, l.section FROM le e JOIN listing_chunks l ON l.document_id = e.k")


# every listing is asked the search of the supplier with its number, and all of its chunks are ranked
@query(
    "retrieve_within",
    with_ctes(
        f"""SELECT query_id, document_id, {half_up('score', 6)} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {KEY.format('score')} DESC, document_id) AS rank
         FROM (SELECT c.id AS query_id, c.document_id, coalesce(sum(a.val * b.val), 0) AS score FROM listing_chunks c JOIN query_log q ON q.query_id = c.id % (SELECT count(*) FROM supplier)
           LEFT JOIN le b ON b.k = c.document_id LEFT JOIN qe a ON a.k = q.query_id AND a.idx = b.idx GROUP BY 1, 2))""",
        "qe",
        "le",
    ),
)
def retrieve_within(spark, sf):
    q = view(spark, sf, "query_log").select(c("query_id").alias("asker"), "text")
    suppliers = view(spark, sf, "supplier").count()
    own = listing_facts(spark, sf).select(c("id").alias("query_id"), c("id").alias("job_id"), (c("id") % suppliers).alias("asker")).distinct()
    asked = own.join(embed_hashing(q, ["asker"]), "asker").drop("asker")
    return rounded(R.retrieve_within(asked, listing_index(spark, sf), None), "document_id")


# ---------------------------------------------------------------------------
# Scoring of topic pairs (no retrieval needed)
# ---------------------------------------------------------------------------
def offered_skills():
    return c("_low_skills")


def gated(spark, sf, offered=(), asked=()):
    """Every pair of a query with a topic and a listing on it, with criteria and facts.

    What a listing or a query says alone is made before they meet: its skills in lower case, and the named texts."""
    low = F.transform("skills", lambda x: F.lower(x)).alias("_low_skills")
    rows = listings(spark, sf).select("*", low, *[S.offered_texts()[n].alias(f"_{n}") for n in offered])
    k = c("criteria")
    queries = query_log(spark, sf)
    for n in asked:
        queries = queries.withColumn("criteria", k.withField(f"_{n}", S.asked_texts(k)[n]))
    return P.topic_pairs(queries, rows, [*X.FACTS, "_low_skills", *[f"_{n}" for n in offered]])


PAIRS = "gated g JOIN ql q ON q.query_id = g.query_id JOIN listings l ON l.id = g.id WHERE (len(q.skills) > 0 OR len(q.keywords) > 0)"
_lower_l = "list_transform(l.skills, lambda s: lower(s))"
MATCHED = f"list_filter(q.skills, lambda s: list_contains({_lower_l}, lower(s)))"
MISSING = f"list_filter(q.skills, lambda s: NOT list_contains({_lower_l}, lower(s)))"
C_SKILL = f"CASE WHEN len(q.skills) > 0 THEN len({MATCHED})::DOUBLE / len(q.skills) END"


def exp_fit(p="q."):
    return f"""CASE WHEN {p}experience_min IS NOT NULL OR {p}experience_max IS NOT NULL THEN
     CASE WHEN l.experience_min <= coalesce({p}experience_max, 60) AND l.experience_max >= coalesce({p}experience_min, 0) THEN 1.0::DOUBLE
     ELSE greatest(0.0, 1.0 - 0.25::DOUBLE * CASE WHEN l.experience_min > coalesce({p}experience_max, 60) THEN l.experience_min - coalesce({p}experience_max, 60)
       ELSE coalesce({p}experience_min, 0) - l.experience_max END) END END"""


def place_fit(p="q."):
    return f"""CASE WHEN {p}location IS NOT NULL THEN CASE WHEN contains(lower(l.location), lower({p}location)) THEN 1.0::DOUBLE
     WHEN l.remote AND coalesce({p}remote, false) THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END END"""


def remote_sql(p="q."):
    return f"CASE WHEN {p}remote IS NOT NULL THEN CASE WHEN l.remote = {p}remote THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END"


def pay_fit(p="q."):
    return f"""CASE WHEN {p}salary_min IS NOT NULL OR {p}salary_max IS NOT NULL THEN CASE WHEN l.salary_min > {p}salary_max THEN 0.0::DOUBLE
     WHEN {p}salary_min IS NULL OR l.salary_min >= {p}salary_min THEN 1.0::DOUBLE WHEN l.salary_max >= {p}salary_min THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END END"""


def score_sql(sem, skill, exp, place, rem, pay):
    parts = [(sem, 0.35), (skill, 0.25), (exp, 0.15), (place, 0.10), (rem, 0.05), (pay, 0.10)]
    value = " + ".join(f"coalesce({p} * {w}::DOUBLE, 0)" for p, w in parts)
    weight = " + ".join(f"CASE WHEN {p} IS NULL THEN 0 ELSE {w}::DOUBLE END" for p, w in parts)
    return f"(CASE WHEN ({weight}) = 0 THEN 0.0 ELSE ({value}) / ({weight}) END)"


def component_query(name, sql, fn):
    @query(name, with_ctes(f"SELECT g.query_id, g.id, {half_up(sql, 6)} AS value FROM {PAIRS}", "gated", "ql", "listings"))
    def run(spark, sf):
        value = F.floor(fn(c("criteria")) * 1e6 + F.lit(0.5)) / F.lit(1e6)
        return gated(spark, sf).select("query_id", "id", value.alias("value"))

    return run


component_query("skill_score", C_SKILL, lambda k: S.skill_score(k, offered_skills()))
component_query("experience_fit", exp_fit(), S.experience_fit)
component_query("location_fit", place_fit(), S.location_fit)
component_query("remote_fit", remote_sql(), S.remote_fit)
component_query("salary_fit", pay_fit(), S.salary_fit)
component_query(
    "weighted_score",
    score_sql("NULL::DOUBLE", C_SKILL, exp_fit(), place_fit(), remote_sql(), pay_fit()),
    lambda k: S.weighted_score(S.components(k, F.lit(None).cast("double"), offered_skills())),
)

PLAIN_SCORE = score_sql("NULL::DOUBLE", C_SKILL, exp_fit(), place_fit(), remote_sql(), pay_fit())


@query(
    "match_label",
    with_ctes(
        f"""SELECT query_id, id, CAST(floor(s * 100 + 0.5) AS INTEGER) AS percent, CASE WHEN s >= 0.75 THEN 'Strong match' WHEN s >= 0.5 THEN 'Good match' ELSE 'Partial match' END AS label,
        {half_up('s', 3)} AS rounded FROM (SELECT g.query_id, g.id, {half_up(PLAIN_SCORE, 9)} AS s FROM {PAIRS})""",
        "gated", "ql", "listings",
    ),
)
def match_label(spark, sf):
    from hybridq.functions.strings import round_half_up

    s = round_half_up(S.weighted_score(S.components(c("criteria"), F.lit(None).cast("double"), offered_skills())), 9)
    rows = gated(spark, sf).select("query_id", "id", s.alias("s"))
    return rows.select(
        "query_id", "id", S.match_percent(c("s")).alias("percent"), S.match_label(c("s")).alias("label"),
        round_half_up(c("s"), 3).alias("rounded"),
    )


@query(
    "round_half_up",
    f"SELECT o_orderkey, {half_up('o_totalprice / 7.0', 2)} AS two, {half_up('o_totalprice / 7.0', 0)} AS whole FROM orders",
)
def round_half_up_query(spark, sf):
    from hybridq.functions.strings import round_half_up

    v = c("o_totalprice") / F.lit(7.0)
    return view(spark, sf, "orders").select("o_orderkey", round_half_up(v, 2).alias("two"), round_half_up(v, 0).alias("whole"))


def human(expr):
    return f"(CASE WHEN len({expr}) = 1 THEN {expr}[1] ELSE array_to_string(list_slice({expr}, 1, len({expr}) - 1), ', ') || ' and ' || {expr}[len({expr})] END)"


def asked_years(p="q."):
    lo, hi = f"{p}experience_min", f"{p}experience_max"
    return f"(CASE WHEN {lo} = {hi} THEN {lo} || ' years of experience' WHEN {lo} IS NOT NULL AND {hi} IS NOT NULL THEN {lo} || '-' || {hi} || ' years' WHEN {hi} IS NOT NULL THEN 'up to ' || {hi} || ' years' ELSE {lo} || '+ years' END)"


def explain_sql(sem="NULL::DOUBLE", sections="[]::VARCHAR[]"):
    """(reasons, gaps) list expressions over q (criteria) and l (listing)."""
    need, band = duck.years("l."), duck.salary("l.")
    wanted, cap = f"'₹' || {duck.lakhs('q.salary_min')} || ' LPA'", f"'₹' || {duck.lakhs('q.salary_max')} || ' LPA'"
    low_sections = f"list_transform({sections}, lambda s: lower(s))"
    reasons = [
        f"CASE WHEN {sem} >= 0.8 AND len({sections}) > 0 THEN 'Job content closely matches your request (' || array_to_string({ordered_distinct(low_sections)}, ', ') || ')' END",
        f"CASE WHEN len({MATCHED}) > 0 THEN {human(MATCHED)} || CASE WHEN len({MATCHED}) = 1 THEN ' matches' ELSE ' match' END END",
        f"CASE WHEN {exp_fit()} >= 1 THEN 'Requires ' || {need} || ' - within your range (' || {asked_years()} || ')' END",
        f"CASE {place_fit()} WHEN 1.0 THEN 'Located in ' || l.location WHEN 0.8 THEN 'Remote role (listed location: ' || l.location || ')' END",
        f"CASE WHEN {remote_sql()} = 1 THEN CASE WHEN q.remote THEN 'Remote preference matches' ELSE 'On-site role as requested' END END",
        f"CASE WHEN l.salary_min >= q.salary_min THEN 'Salary ' || {band} || ' meets your ' || {wanted} || ' minimum' WHEN l.salary_max >= q.salary_min THEN 'Upper end of ' || {band} || ' reaches your ' || {wanted} || ' minimum' END",
        f"CASE WHEN q.salary_min IS NULL AND l.salary_min <= q.salary_max THEN 'Salary ' || {band} || ' is within ' || {cap} END",
        f"CASE WHEN q.employment_type = l.employment_type THEN {duck.label('l.employment_type')} || ' as requested' END",
    ]
    gaps = [
        f"CASE WHEN len({MISSING}) > 0 THEN {human(MISSING)} || ' not listed in the job''s skills' END",
        f"CASE WHEN {exp_fit()} < 1 THEN 'Requires ' || {need} || ' (you asked for ' || {asked_years()} || ')' END",
        f"CASE WHEN {place_fit()} = 0 THEN 'Located in ' || l.location || ', not ' || q.location END",
        f"CASE WHEN {remote_sql()} = 0 THEN CASE WHEN l.remote THEN 'Role is remote, you asked for on-site' ELSE 'Role is not remote' END END",
        f"CASE WHEN l.salary_max < q.salary_min THEN 'Salary ' || {band} || ' is below your ' || {wanted} || ' minimum' END",
        f"CASE WHEN l.salary_min > q.salary_max THEN 'Salary ' || {band} || ' starts above ' || {cap} END",
    ]
    pack = lambda parts: f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"
    return pack(reasons), pack(gaps)


_reasons, _gaps = explain_sql()


@query(
    "match_explanations",
    with_ctes(f"SELECT g.query_id, g.id, {joined(_reasons)} AS reasons, {joined(_gaps)} AS gaps FROM {PAIRS}", "gated", "ql", "listings"),
)
def match_explanations(spark, sf):
    none, k = F.lit(None), c("criteria")
    offered, asked = ["need", "band", "type"], ["wanted", "cap", "years"]
    own = lambda n, make: make(k, offered_skills()) if n in ("matched", "missing") else make(k)
    rows = gated(spark, sf, offered, asked).withColumns({f"_{n}": own(n, make) for n, make in S.PAIR_FACTS.items()})
    texts = {n: c(f"_{n}") for n in (*offered, *S.PAIR_FACTS)} | {n: k[f"_{n}"] for n in asked}
    reasons, gaps = S.match_explanations(k, none.cast("double"), none.cast("array<string>"), texts=texts)
    return rows.select(
        "query_id", "id", F.array_join(reasons, "|").alias("reasons"), F.array_join(gaps, "|").alias("gaps")
    )


ORDER = f"{KEY.format('score')} DESC, {KEY.format('similarity')} DESC, salary_max DESC, posted_date DESC NULLS LAST, id"


@query(
    "rank_results",
    with_ctes(
        f"""SELECT query_id, id, rank, total_matches, {half_up('score', 6)} AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {ORDER}) AS rank,
         count(*) OVER (PARTITION BY query_id) AS total_matches FROM (SELECT g.query_id, g.id, {PLAIN_SCORE} AS score, 0.0 AS similarity, l.salary_max, l.posted_date FROM {PAIRS})) WHERE rank <= 50""",
        "gated", "ql", "listings",
    ),
)
def rank_results(spark, sf):
    scored = gated(spark, sf).withColumn("similarity", F.lit(0.0)).withColumn(
        "score", S.weighted_score(S.components(c("criteria"), F.lit(None).cast("double"), offered_skills()))
    )
    out = S.rank_results(scored)
    return out.select("query_id", "id", "rank", "total_matches", (F.floor(c("score") * 1e6 + F.lit(0.5)) / F.lit(1e6)).alias("score"))


# ---------------------------------------------------------------------------
# Relaxation and the whole search
# ---------------------------------------------------------------------------
LEVEL = f"""greatest(0, CASE WHEN NOT ({P_PAY}) THEN 1 ELSE 0 END, CASE WHEN NOT ({P_EXP}) THEN 2 ELSE 0 END, CASE WHEN NOT {P_PLACE} THEN 3 ELSE 0 END,
 CASE WHEN NOT {P_TYPE} THEN 4 ELSE 0 END, CASE WHEN NOT {P_REMOTE} THEN 5 ELSE 0 END)"""


def relax_ctes(name, q="ql", gate="gated"):
    """<name>_l(query_id, id, lv, ok) over all pairs, <name>(query_id, level, dropped)."""
    cte(
        f"{name}_l", [q, gate, "listings"],
        f"""SELECT q.query_id, l.id, {LEVEL} AS lv, g.id IS NOT NULL AS ok FROM {q} q CROSS JOIN listings l LEFT JOIN {gate} g ON g.query_id = q.query_id AND g.id = l.id""",
    )
    cte(
        name, [f"{name}_l", q],
        f"""SELECT q.query_id, m.level, list_filter([CASE WHEN m.level >= 1 AND (q.salary_min IS NOT NULL OR q.salary_max IS NOT NULL) THEN 'salary' END,
         CASE WHEN m.level >= 2 AND (q.experience_min IS NOT NULL OR q.experience_max IS NOT NULL) THEN 'experience' END, CASE WHEN m.level >= 3 AND q.location IS NOT NULL THEN 'location' END,
         CASE WHEN m.level >= 4 AND q.employment_type IS NOT NULL THEN 'employment type' END, CASE WHEN m.level >= 5 AND q.remote IS NOT NULL THEN 'remote' END], lambda x: x IS NOT NULL) AS dropped
        FROM {q} q LEFT JOIN (SELECT query_id, min(lv) AS level FROM {name}_l WHERE ok GROUP BY query_id) m USING (query_id)""",
    )


def search_ctes(name, q="ql", qe="qe", gate="gated", pool=50, restrict=None, keyword=False):
    """<name>(query_id, id, rank, score, ...): the whole search over criteria table `q`."""
    relax_ctes(f"{name}_r", q, gate)
    scored = f"""SELECT a.k AS query_id, b.k AS document_id, any_value(b.id) AS id, any_value(b.section) AS section, sum(a.val * b.val) AS score
          FROM {qe} a JOIN le_ids b USING (idx) JOIN {q} q ON q.query_id = a.k AND (len(q.skills) > 0 OR len(q.keywords) > 0) GROUP BY 1, 2"""
    if keyword:
        asked = f"SELECT query_id, list_distinct({tokens('text')}) AS t FROM {q} WHERE len(skills) > 0 OR len(keywords) > 0"
        said = f"SELECT document_id, id, section, {tokens('part_text')} AS t0 FROM listing_chunks"
        scored = f"""SELECT a.query_id, b.document_id, any_value(b.id) AS id, any_value(b.section) AS section,
           count(*) / any_value(a.n)::DOUBLE / (1 + ln(1 + any_value(b.len) / 50.0)) AS score
          FROM (SELECT query_id, len(t) AS n, unnest(t) AS term FROM ({asked})) a
          JOIN (SELECT document_id, id, section, len(t0) AS len, unnest(list_distinct(t0)) AS term FROM ({said})) b USING (term) GROUP BY 1, 2"""
    cte(
        f"{name}_h", [f"{name}_r", q, *(["listing_chunks"] if keyword else [qe, "le_ids"])],
        f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {KEY.format('score')} DESC, document_id) AS hrank FROM (
          {scored})
         JOIN {name}_r_l x USING (query_id, id) JOIN {name}_r r USING (query_id) WHERE x.lv <= r.level QUALIFY hrank <= 20""",
    )
    cte(
        f"{name}_s", [f"{name}_h"],
        f"""SELECT query_id, id, max(score) AS sim, list(section ORDER BY hrank) AS sections, list(document_id ORDER BY hrank) AS docs FROM {name}_h GROUP BY 1, 2""",
    )
    def relaxed(n, f):
        return f"CASE WHEN r.level < {n} THEN q.{f} END AS {f}"

    cte(
        f"{name}_p", [f"{name}_s", f"{name}_r"],
        f"""SELECT r.query_id, x.id, r.level, r.dropped, q.skills, coalesce(s.sim, 0.0) AS similarity, s.sections, s.docs,
          CASE WHEN b.best > 0 THEN greatest(0.0, coalesce(s.sim, 0.0)) / b.best END AS norm, {relaxed(1, 'salary_min')}, {relaxed(1, 'salary_max')},
          {relaxed(2, 'experience_min')}, {relaxed(2, 'experience_max')}, {relaxed(3, 'location')}, {relaxed(4, 'employment_type')}, {relaxed(5, 'remote')}
         FROM {name}_r r JOIN {q} q USING (query_id) JOIN {name}_r_l x ON x.query_id = r.query_id AND x.ok AND x.lv <= r.level
         LEFT JOIN {name}_s s ON s.query_id = r.query_id AND s.id = x.id LEFT JOIN (SELECT query_id, max(sim) AS best FROM {name}_s GROUP BY 1) b ON b.query_id = r.query_id""",
    )
    sc = score_sql("q.norm", C_SKILL, exp_fit(), place_fit(), remote_sql(), pay_fit())
    parts = "q.norm AS semantic_norm, {} AS f_skills, {} AS f_exp, {} AS f_place, {} AS f_remote, {} AS f_pay"
    cte(
        f"{name}_1", [f"{name}_p", "listings"],
        f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {ORDER}) AS rank, count(*) OVER (PARTITION BY query_id) AS total_matches FROM (
          SELECT q.query_id, q.id, q.level, q.dropped, q.similarity, q.sections, q.docs, {sc} AS score, {parts.format(C_SKILL, exp_fit(), place_fit(), remote_sql(), pay_fit())},
           l.salary_max, l.posted_date FROM {name}_p q JOIN listings l USING (id)) QUALIFY rank <= {pool}""",
    )
    # relaxed pools once more, against the original criteria
    cte(
        f"{name}_2", [f"{name}_1", q],
        f"""SELECT o.*, CASE WHEN max(o.semantic_norm IS NOT NULL) OVER w AND max(o.similarity) OVER w > 0 THEN greatest(0.0, o.similarity) / max(o.similarity) OVER w END AS norm
         FROM {name}_1 o WHERE o.level > 0 WINDOW w AS (PARTITION BY o.query_id)""",
    )
    sc2 = score_sql("n.norm", C_SKILL, exp_fit(), place_fit(), remote_sql(), pay_fit())
    cols = "query_id, id, level, dropped, similarity, sections, docs, total_matches, score, rank, semantic_norm, f_skills, f_exp, f_place, f_remote, f_pay"
    cte(
        name, [f"{name}_1", f"{name}_2"],
        f"""SELECT {cols} FROM {name}_1 WHERE level = 0 UNION ALL
         SELECT query_id, id, level, dropped, similarity, sections, docs, total_matches, score, row_number() OVER (PARTITION BY query_id ORDER BY {KEY.format('score')} DESC, oldrank) AS rank,
          norm, f_skills, f_exp, f_place, f_remote, f_pay FROM (
          SELECT n.query_id, n.id, n.level, n.dropped, n.similarity, n.sections, n.docs, n.total_matches, {sc2} AS score, n.rank AS oldrank, n.norm,
           {C_SKILL} AS f_skills, {exp_fit()} AS f_exp, {place_fit()} AS f_place, {remote_sql()} AS f_remote, {pay_fit()} AS f_pay
          FROM {name}_2 n JOIN {q} q ON q.query_id = n.query_id JOIN listings l ON l.id = n.id)""",
    )


search_ctes("hs")
search_ctes("hk", keyword=True)


@query(
    "relax_filters",
    with_ctes(
        f"""SELECT r.query_id, r.level, {joined('r.dropped')} AS dropped, coalesce(n.matches, 0) AS matches, coalesce(n.candidates, 0) AS candidates FROM hs_r r LEFT JOIN (
          SELECT x.query_id, count(*) FILTER (x.ok AND x.lv <= r.level) AS matches, count(*) FILTER (x.lv <= coalesce(r.level, 0)) AS candidates
          FROM hs_r_l x JOIN hs_r r USING (query_id) GROUP BY 1) n USING (query_id)""",
        "hs_r",
    ),
)
def relax_filters(spark, sf):
    found = P.relax_filters(query_log(spark, sf), listings(spark, sf))
    return found.select("query_id", "level", flat("dropped"), F.coalesce("matches", F.lit(0)).alias("matches"), "candidates")


_hr, _hg = explain_sql("h.semantic_norm", "coalesce(h.sections, []::VARCHAR[])")
HYBRID = f"""SELECT h.query_id, h.rank, h.id, {half_up('h.score', 6)} AS score, {half_up('h.similarity', 6)} AS similarity, h.total_matches, n.candidate_count, h.level, {joined('h.dropped')} AS dropped,
 {half_up('h.semantic_norm', 3)} AS semantic, {half_up('h.f_skills', 3)} AS skills, {half_up('h.f_exp', 3)} AS experience, {half_up('h.f_place', 3)} AS location, {half_up('h.f_remote', 3)} AS remote,
 {half_up('h.f_pay', 3)} AS salary, {joined(_hr)} AS reasons, {joined(_hg)} AS gaps, {joined('h.docs')} AS chunks,
 CASE WHEN a.asked IS NULL THEN 'none' ELSE 'vector' END AS mode
 FROM @found h JOIN @queries q ON q.query_id = h.query_id JOIN listings l ON l.id = h.id
 LEFT JOIN (SELECT DISTINCT query_id AS asked FROM @found_s) a ON a.asked = h.query_id
 JOIN (SELECT x.query_id, count(*) AS candidate_count FROM @found_r_l x JOIN @found_r r USING (query_id) WHERE x.lv <= r.level GROUP BY 1) n ON n.query_id = h.query_id WHERE h.rank <= @n"""


def hybrid_sql(name, q, n, *deps):
    return with_ctes(HYBRID.replace("@found", name).replace("@queries", q).replace("@n", str(n)), name, f"{name}_s", *deps)


def flat_search(df):
    num = lambda col, name: (F.floor(col * 1e6 + F.lit(0.5)) / F.lit(1e6)).alias(name)
    return df.select(
        "query_id", "rank", "id", num(c("score"), "score"), num(c("similarity"), "similarity"), "total_matches", "candidate_count", "level", "mode",
        flat("dropped"), *[c(f"breakdown.{n}").alias(n) for n in S.COMPONENTS], flat("reasons"), flat("gaps"),
        F.coalesce(F.array_join(F.transform("chunks", lambda x: x.document_id), "|"), F.lit("")).alias("chunks"),
    )


@query("hybrid_search", hybrid_sql("hs", "ql", 5))
def hybrid_search(spark, sf):
    return flat_search(P.hybrid_search(query_log(spark, sf), listings(spark, sf), listing_index(spark, sf), words=words(spark, sf)))


@query("hybrid_search_keyword", hybrid_sql("hk", "ql", 5).replace("THEN 'none' ELSE 'vector' END", "THEN 'none' ELSE 'keyword' END"))
def hybrid_search_keyword(spark, sf):
    found = P.hybrid_search(query_log(spark, sf), listings(spark, sf), listing_index(spark, sf), retrieval="keyword", keywords=listing_keywords(spark, sf))
    return flat_search(found)


@query(
    "semantic_norm",
    with_ctes(
        f"""SELECT query_id, id, {half_up('similarity', 6)} AS similarity, {half_up('CASE WHEN best > 0 THEN greatest(0.0, similarity) / best END', 6)} AS norm FROM (
          SELECT g.query_id, g.id, coalesce(s.sim, 0.0) AS similarity, b.best FROM delivered g JOIN ql q ON q.query_id = g.query_id JOIN listings l ON l.id = g.id
          LEFT JOIN hs_s s ON s.query_id = g.query_id AND s.id = g.id LEFT JOIN (SELECT query_id, max(sim) AS best FROM hs_s GROUP BY 1) b ON b.query_id = g.query_id)""",
        "hs_s", "delivered", "ql", "listings",
    ),
)
def semantic_norm(spark, sf):
    rows = listings(spark, sf)
    relaxed = materialise(P.relax_filters(query_log(spark, sf), rows), "relaxed")
    hits = materialise(P.search_hits(relaxed, rows, listing_index(spark, sf)), "hits")
    out = P.with_similarity(pairs(spark, sf).join(P.best_similarity(hits), "query_id", "left"), hits)
    num = lambda n: F.floor(c(n) * 1e6 + F.lit(0.5)) / F.lit(1e6)
    return out.select("query_id", "id", num("similarity").alias("similarity"), num("semantic_norm").alias("norm"))


@query(
    "best_chunk_per_listing",
    with_ctes(f"SELECT query_id, id, {half_up('sim', 6)} AS best_score, array_to_string(docs, '|') AS chunks FROM hs_s", "hs_s"),
)
def best_chunks(spark, sf):
    rows = listings(spark, sf)
    relaxed = materialise(P.relax_filters(query_log(spark, sf), rows), "relaxed")
    hits = P.search_hits(relaxed, rows, listing_index(spark, sf))
    return R.best_chunk_per_listing(hits).select(
        "query_id", c("job_id").alias("id"), (F.floor(c("best_score") * 1e6 + F.lit(0.5)) / F.lit(1e6)).alias("best_score"),
        F.array_join(F.transform("chunks", lambda x: x.document_id), "|").alias("chunks"),
    )


@query(
    "source_refs",
    with_ctes(
        f"""SELECT h.query_id, h.id, l.title, l.company, CASE WHEN h.sections IS NULL THEN 'STRUCTURED DATA' ELSE array_to_string({ordered_distinct('h.sections')}, '|') END AS sections,
        CASE WHEN h.sections IS NOT NULL THEN {half_up('h.similarity', 3)} END AS similarity FROM hs h JOIN listings l USING (id) WHERE h.rank <= 5""",
        "hs",
    ),
)
def source_refs(spark, sf):
    rows = listings(spark, sf)
    found = P.hybrid_search(query_log(spark, sf), rows, listing_index(spark, sf)).select("query_id", "id", "chunks")
    out = R.source_refs(found, rows)
    return out.select("query_id", "id", "title", "company", flat("sections"), "similarity")


@query(
    "rescore_relaxed",
    with_ctes(f"SELECT query_id, id, rank, {half_up('score', 6)} AS score, {half_up('semantic_norm', 6)} AS norm FROM hs WHERE level > 0", "hs"),
)
def rescore_relaxed(spark, sf):
    out = P.hybrid_search(query_log(spark, sf), listings(spark, sf), listing_index(spark, sf), n=None).where(c("level") > 0)
    num = lambda col, name: (F.floor(col * 1e6 + F.lit(0.5)) / F.lit(1e6)).alias(name)
    return out.select("query_id", "id", "rank", num(c("score"), "score"), num(c("semantic_norm"), "norm"))
