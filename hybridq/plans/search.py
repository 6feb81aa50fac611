"""The whole search, for a table of queries: filter, gate, retrieve, score, rank, relax.

The relaxation loop of a one-query engine becomes one pass: every listing has a level for a query
(its last failing filter), the lowest level with a listing on topic decides how far the
query is relaxed, and the listings on topic at or below it are its matches.

Queries meet listings twice, both times in a block scan that keeps a bounded answer a query: first to count
listings by level, then, with the retrieved chunks at hand, to score the matches and keep a pool.  Only
the pool is ever a table of pairs; reasons and gaps are written for it in the JVM.  Queries
restricted to a list of ids start from that list and don't scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hybridq import vocab
from hybridq.operators import scoring
from hybridq.operators.embedding import embed_hashing
from hybridq.operators.filters import FACTS, asked_words, match_places, on_topic, required_level, said_words, topic_gate_keywords, topic_gate_skills
from hybridq.operators.keywords import KeywordIndex, exact_scores, keyword_index, keyword_terms
from hybridq.operators.retrieval import best_chunk_per_listing, keep_top, keyword_topk, order_key, topk_among, vector_topk
from hybridq.operators.understanding import criteria_struct, has_topic, merge_criteria, parse_queries
from hybridq.functions.strings import blank_to_null
from hybridq.plans.blockscan import LEVELS, block_scan
from hybridq.plans.matching import ITEM, NUMBERS, BestMatches, Filters, KeywordTopK, LevelCounts
from hybridq.plans.stages import drop_stage, materialise

CHUNK_LIST = "array<struct<rank:int,document_id:string,section:string,score:double>>"
LEVEL_OF = {
    "salary_min": 1, "salary_max": 1, "experience_min": 2, "experience_max": 2, "location": 3,
    "employment_type": 4, "remote": 5,
}


def relaxed_criteria(c: Column, level: Column) -> Column:
    """Criteria with every filter up to `level` dropped; topics are never dropped."""
    fields = {"keywords": c["keywords"], "skills": c["skills"]}
    for name, position in LEVEL_OF.items():
        fields[name] = F.when(level < position, c[name])
    return criteria_struct(**fields)


def dropped_filters(c: Column, level: Column) -> Column:
    """Names of the filters that were set and are dropped at `level`."""
    isset = {
        "salary": c["salary_min"].isNotNull() | c["salary_max"].isNotNull(),
        "experience": c["experience_min"].isNotNull() | c["experience_max"].isNotNull(),
        "location": c["location"].isNotNull(),
        "employment type": c["employment_type"].isNotNull(),
        "remote": c["remote"].isNotNull(),
    }
    names = [
        F.when(isset[name] & (level >= position), F.lit(name))
        for position, name in enumerate(vocab.RELAXATION_ORDER, start=1)
    ]
    return F.array_compact(F.array(*names))


# ---------------------------------------------------------------------------
# Both sides of the scan
# ---------------------------------------------------------------------------
def _lowered(names: Column) -> Column:
    return F.transform(names, lambda x: F.lower(x))


def query_side(criteria: Column) -> list[Column]:
    """Criteria as the columns a scan compares; see plans/matching.py."""
    c = criteria
    return [
        *[c[n].cast("double").alias(n) for n in NUMBERS if n != "remote"],
        c["remote"].cast("int").cast("double").alias("remote"),
        c["employment_type"].alias("employment_type"),
        F.lower(c["location"]).alias("place"),
        _lowered(c["skills"]).alias("skills"),
        asked_words(c).alias("words"),
        has_topic(c).alias("topical"),
    ]


def match_items(queries: DataFrame, listings: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """One row per listing with what a scan compares, staged.

    Of its place a listing carries the asked texts it contains, of its words the asked ones."""
    c = F.col("criteria")
    asked = queries.select(c["location"].alias("asked"))
    places = match_places(asked, listings.select(F.col("location").alias("place")))
    places = places.groupBy("place").agg(F.collect_set(F.lower("asked")).alias("asked"))
    words = said_words(queries, listings, words).groupBy("id").agg(F.collect_set("word").alias("words"))
    col = F.col
    numbers = [col(n).cast("double").alias(n) for n in NUMBERS if n != "remote"]
    own = listings.select(
        "id", *numbers, col("remote").cast("int").cast("double").alias("remote"), "employment_type",
        F.array_distinct(_lowered(col("skills"))).alias("skills"), F.unix_date("posted_date").cast("double").alias("posted"),
        col("location").alias("place"),
    )
    joined = own.join(places, "place", "left").join(words, "id", "left")
    return materialise(joined.select("id", *ITEM, "posted", F.monotonically_increasing_id().alias("item_no")), "items")


def _limited(queries: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(queries without, queries with a list of ids)."""
    if "restrict_ids" not in queries.columns:
        return queries, None
    listed = F.col("restrict_ids").isNotNull()
    return queries.where(~listed), queries.where(listed)


def listed_ids(limited: DataFrame, kept: list[str]) -> DataFrame:
    """(<kept>, id): a row for each different id of a list.

    Spark takes what an explode makes to be as small as its input, so it would send these rows to every
    executor, through the driver; they are joined by sorting instead."""
    return limited.select(*kept, F.explode(F.array_distinct("restrict_ids")).alias("id")).hint("merge")


def listed_pairs(limited: DataFrame, listings: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, criteria, ..., <facts>): the listings on topic among the ids each query is restricted to."""
    kept = [n for n in limited.columns if n != "restrict_ids"]
    facts = listings.select(*FACTS).join(items.select("id", F.col("words").alias("_said")), "id")
    pairs = listed_ids(limited, kept).join(facts, "id")
    return pairs.where(on_topic(F.col("criteria"), F.col("skills"), F.col("_said"))).select(*kept, *FACTS)


# ---------------------------------------------------------------------------
# Relaxation levels
# ---------------------------------------------------------------------------
COUNTS = [f"{kind}{i}" for kind in ("at", "all") for i in range(LEVELS)]


def relaxation_levels(queries: DataFrame, listings: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, level, matches, candidates) of every query.

    Twelve counts a query: listings on topic, and listings at all, by the level where they pass first.  The lowest
    level with a listing on topic is the level, `matches` the number there; `candidates` counts the
    listings that pass the filters left at that level (no filter dropped where nothing matches)."""
    c = F.col("criteria")
    free, limited = _limited(queries)
    kind = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, {', '.join(f'{n} long' for n in COUNTS)}"
    sides = free.select("query_id", *query_side(c)), items.select("id", *ITEM)
    counts = block_scan(*sides, LevelCounts(), schema, item_key="id")
    if limited is not None:
        facts = listings.select(*FACTS).join(items.select("id", F.col("words").alias("_said")), "id")
        seen = listed_ids(limited, ["query_id", "criteria"]).join(facts, "id").select(
            "query_id", required_level(c).alias("_lv"), on_topic(c, F.col("skills"), F.col("_said")).alias("_on")
        )
        at = lambda i, also: F.count(F.when((F.col("_lv") == i) & also, 1))
        listed = seen.groupBy("query_id").agg(
            *[at(i, F.col("_on")).alias(f"at{i}") for i in range(LEVELS)], *[at(i, F.lit(True)).alias(f"all{i}") for i in range(LEVELS)]
        )
        counts = counts.unionByName(listed)
    counts = counts.groupBy("query_id").agg(*[F.sum(n).alias(n) for n in COUNTS])
    found = F.coalesce(*[F.when(F.col(f"at{i}") > 0, F.struct(F.lit(i).alias("level"), F.col(f"at{i}").alias("n"))) for i in range(LEVELS)])
    level = F.coalesce(F.col("f.level"), F.lit(0))
    passing = sum((F.when(level >= i, F.col(f"all{i}")).otherwise(F.lit(0)) for i in range(LEVELS)), F.lit(0))
    return counts.withColumn("f", found).select(
        "query_id", "f.level", F.col("f.n").alias("matches"), passing.cast("long").alias("candidates")
    )


def relax_filters(queries: DataFrame, listings: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(query_id, level, matches, candidates, dropped, criteria, applied): how far each query is relaxed.

    A query that matches at no level keeps level NULL, nothing dropped."""
    items = match_items(queries, listings) if items is None else items
    levels = relaxation_levels(queries, listings, items)
    c, level = F.col("criteria"), F.coalesce("level", F.lit(0))
    return queries.join(levels, "query_id", "left").select(
        *queries.columns,
        "level",
        "matches",
        F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"),
        dropped_filters(c, level).alias("dropped"),
        relaxed_criteria(c, level).alias("applied"),
    )


def topic_pairs(queries: DataFrame, listings: DataFrame, facts: list[str]) -> DataFrame:
    """(query_id, criteria, <facts>) of every listing passing the query's topic gate."""
    topical = queries.where(has_topic(F.col("criteria")))
    by_skill = topic_gate_skills(topical.where(F.size("criteria.skills") > 0), listings, facts)
    return by_skill.unionByName(topic_gate_keywords(topical, listings, facts))


def best_similarity(hits: DataFrame) -> DataFrame:
    """(query_id, best): the highest similarity a query retrieved."""
    return hits.groupBy("query_id").agg(F.max("score").alias("best"))


def best_matches(
    relaxed: DataFrame, listings: DataFrame, items: DataFrame, hits: DataFrame, pool: int | None, weights: dict = vocab.WEIGHTS
) -> DataFrame:
    """(query_id, id): the `pool` best matches of every query (all of them where it is None).

    Restricted queries keep all matches of their list, which is no longer than the list."""
    alive = relaxed.where(F.col("level").isNotNull())
    free, limited = _limited(alive)
    # at most k hits a query
    retrieved = best_chunk_per_listing(hits).groupBy("query_id").agg(
        F.collect_list(F.struct("job_id", "best_score")).alias("h"), F.max("best_score").alias("best")
    )
    sides = free.join(retrieved, "query_id", "left").select(
        "query_id", *query_side(F.col("applied")), "best", F.col("h.job_id").alias("hit_ids"), F.col("h.best_score").alias("hit_scores")
    ), items.select("id", *ITEM, "posted")
    kind = relaxed.schema["query_id"].dataType.simpleString()
    found = block_scan(*sides, BestMatches(pool, weights), f"query_id {kind}, {BestMatches.SCHEMA}", item_key="id")
    if pool is not None:
        order = [F.desc("score_key"), F.desc("similarity_key"), F.desc("salary_max"), F.desc("posted"), F.asc("id")]
        found = found.withColumn("_place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("_place") <= pool)
    found = found.select("query_id", "id")
    if limited is not None:
        pairs = listed_pairs(limited.select("query_id", "criteria", "level", "restrict_ids"), listings, items)
        found = found.unionByName(pairs.where(required_level(F.col("criteria")) <= F.col("level")).select("query_id", "id"))
    return found


# ---------------------------------------------------------------------------
# Search
# ---------------------------------------------------------------------------
def _repeats(df: DataFrame, key: str) -> bool:
    return not df.groupBy(key).count().where("count > 1").isEmpty()


def keyword_hits(asking: DataFrame, listings: DataFrame, items: DataFrame, index: DataFrame, k: int, keywords: KeywordIndex | None) -> DataFrame:
    """search_hits by keywords, for an index whose embedder can't be asked.

    Filters leave few listings, so the k-th score is no floor for whole posting lists; the words are counted
    inside the scan that compares the filters, and candidate pairs never become rows.  Where ids repeat, every
    copy counts, as the posting lists have it."""
    keywords = keywords or keyword_index(index, carry=("job_id",))
    if _repeats(asking, "query_id") or _repeats(listings, "id") or _repeats(keywords.lists, "document_id"):
        return posted_hits(asking, listings, k, keywords)
    c = F.col("criteria")
    asked = keyword_terms(asking).where(F.size("terms") > 0)
    free, limited = _limited(asked)
    q = free.select("query_id", "terms", *query_side(c), F.col("level").cast("double").alias("level"))
    q = q.select("query_id", "terms", *Filters.QUERY, "level")
    x = keywords.lists.select("document_id", "job_id", "n_tokens", "terms").join(
        items.select(F.col("id").alias("job_id"), *Filters.ITEM, "item_no"), "job_id"
    ).drop("job_id")
    kinds = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for df, n in ((asking, "query_id"), (keywords.lists, "document_id")))
    task = KeywordTopK(max(k, 1), Filters())
    found = block_scan(q, x if k > 0 else x.limit(0), task, f"{kinds}, score double", together="item_no")
    if limited is not None:
        # an id restriction is an equality filter: those queries only meet their own listings
        own = listed_ids(limited, ["query_id", "criteria", "level"])
        allowed = own.join(listings.select(*FACTS), "id").where(required_level(c) <= F.col("level"))
        pairs = allowed.select("query_id", F.col("id").alias("job_id")).join(keywords.lists.select("job_id", "document_id"), "job_id")
        exact = exact_scores(pairs, limited.select("query_id", "terms"), keywords).where(F.col("score") > 0)
        found = found.unionByName(exact)
    return keep_top(found, k)


def posted_hits(asking: DataFrame, listings: DataFrame, k: int, keywords: KeywordIndex) -> DataFrame:
    """keyword_hits through the posting lists."""
    chunks = keywords.lists.select("document_id", F.col("job_id").alias("id"))
    facts = listings.select(*FACTS)
    limits = ["restrict_ids"] if "restrict_ids" in asking.columns else []
    wanted = asking.select("query_id", "criteria", "level", *limits)

    def keep(pairs: DataFrame) -> DataFrame:
        seen = pairs.join(chunks, "document_id").join(facts, "id").join(wanted, "query_id")
        passing = required_level(F.col("criteria")) <= F.col("level")
        if limits:
            passing &= F.col("restrict_ids").isNull() | F.array_contains("restrict_ids", F.col("id"))
        return seen.where(passing).select(*pairs.columns)

    return keyword_topk(asking.select("query_id", "text"), keywords, k, keep)


def search_hits(
    relaxed: DataFrame,
    listings: DataFrame,
    index: DataFrame,
    k: int = vocab.RETRIEVAL_TOP_K,
    dims: int = vocab.DIMENSIONS,
    retrieval: str = "vector",
    items: DataFrame | None = None,
    keywords: KeywordIndex | None = None,
) -> DataFrame:
    """Top-k chunks per query among the listings passing its (relaxed) filters.

    Only queries with a topic and a text retrieve; the filter is evaluated inside
    the scan, so candidate pairs never become rows.  `retrieval` is vector or keyword."""
    c = F.col("criteria")
    asking = relaxed.where(
        F.col("level").isNotNull() & has_topic(c) & blank_to_null(F.col("text")).isNotNull()
    )
    if retrieval == "keyword":
        items = match_items(relaxed, listings) if items is None else items
        hits = keyword_hits(asking, listings, items, index, k, keywords)
        return hits.join(index.select("document_id", "job_id", "section"), "document_id")
    items = match_items(relaxed, listings) if items is None else items
    vectors = embed_hashing(asking, ["query_id"], "text", dims)
    free, limited = _limited(asking)
    q = free.select("query_id", *query_side(c), F.col("level").cast("double").alias("level")).join(vectors, "query_id")
    x = index.select("document_id", "job_id", "idx", "val").join(
        items.select(F.col("id").alias("job_id"), *Filters.ITEM, "item_no"), "job_id"
    )
    gate_columns = [*Filters.QUERY, "level"], [*Filters.ITEM, "item_no"]
    hits = vector_topk(q, x, k, dims, gate=Filters(), gate_columns=gate_columns, together="item_no")
    if limited is not None:
        # an id restriction is an equality filter: those queries only meet their own listings
        own = listed_ids(limited, ["query_id", "criteria", "level"])
        allowed = own.join(listings.select(*FACTS), "id").where(required_level(c) <= F.col("level"))
        allowed = allowed.select("query_id", F.col("id").alias("job_id"))
        hits = hits.unionByName(topk_among(vectors, index, allowed, k))
    return hits.join(index.select("document_id", "job_id", "section"), "document_id")


def with_similarity(pairs: DataFrame, hits: DataFrame) -> DataFrame:
    """Adds similarity, semantic_norm and the retrieved chunks to pairs (query_id, id, best, ...)."""
    per_listing = best_chunk_per_listing(hits).withColumnRenamed("job_id", "id")
    return (
        pairs.join(per_listing, ["query_id", "id"], "left")
        .withColumn("similarity", F.coalesce("best_score", F.lit(0.0)))
        .withColumn(
            "semantic_norm",
            F.when(F.col("best") > 0, F.greatest(F.lit(0.0), F.col("similarity")) / F.col("best")),
        )
        .drop("best_score", "best")
    )


def rescore_relaxed(pool: DataFrame, weights: dict = vocab.WEIGHTS) -> DataFrame:
    """Score a relaxed pool against the original criteria.

    The best similarity is taken inside the pool (at most `pool` rows per query);
    only the score orders the result, the previous rank breaks ties."""
    w = Window.partitionBy("query_id")
    best = F.max("similarity").over(w)
    applies = F.max(F.col("semantic_norm").isNotNull()).over(w)
    norm = F.when(applies & (best > 0), F.greatest(F.lit(0.0), F.col("similarity")) / best)
    again = pool.withColumn("semantic_norm", norm)
    parts = scoring.components(F.col("criteria"), F.col("semantic_norm"))
    again = again.withColumn("parts", parts).withColumn("score", scoring.weighted_score(F.col("parts"), weights))
    order = Window.partitionBy("query_id").orderBy(order_key(F.col("score")).desc(), "rank")
    return again.withColumn("rank", F.row_number().over(order))


def hybrid_search(
    queries: DataFrame,
    listings: DataFrame,
    index: DataFrame,
    weights: dict = vocab.WEIGHTS,
    k: int = vocab.RETRIEVAL_TOP_K,
    pool: int | None = vocab.POOL_SIZE,
    n: int | None = vocab.MAX_RETURNED,
    dims: int = vocab.DIMENSIONS,
    retrieval: str = "vector",
    words: DataFrame | None = None,
    keywords: KeywordIndex | None = None,
) -> DataFrame:
    """queries (query_id, criteria, text, restrict_ids?) -> ranked listings per query.

    `words` is the catalogue's listing_words and `keywords` the keyword index of the chunks (with their job_id), where
    they are kept; else listings are read for their words, and chunks for theirs.

    `retrieval` is vector, or keyword where the index holds vectors of an embedder that can't be asked.

    Columns: query_id, rank, the listing facts, score, similarity, breakdown, reasons, gaps, total_matches,
    candidate_count (listings that pass the filters, on topic or not), level, dropped, mode, chunks.
    `n=None` returns the pool, `pool=None` keeps every match."""
    # staged are one row a listing, one a query, at most k a query, and at most `pool` a query
    queries = materialise(queries, "queries")
    items = match_items(queries, listings, words)
    relaxed = materialise(relax_filters(queries, listings, items), "relaxed")
    hits = materialise(search_hits(relaxed, listings, index, k, dims, retrieval, items, keywords), "hits")
    matches = materialise(best_matches(relaxed, listings, items, hits, pool, weights), "matches")
    drop_stage(items)
    asked = relaxed.select("query_id", "criteria", "applied", "level", "matches", "candidates")
    pairs = matches.join(asked.join(best_similarity(hits), "query_id", "left"), "query_id").join(listings.select(*FACTS), "id")
    found = with_similarity(pairs, hits)
    found = found.withColumn("parts", scoring.components(F.col("applied"), F.col("semantic_norm")))
    found = found.withColumn("score", scoring.weighted_score(F.col("parts"), weights))
    totals = relaxed.where(F.col("matches").isNotNull()).select("query_id", F.col("matches").alias("total_matches"))
    ranked = materialise(scoring.rank_results(found.drop("matches", "applied"), pool, totals=totals), "ranked")
    drop_stage(matches)
    again = rescore_relaxed(ranked.where(F.col("level") > 0), weights)
    final = ranked.where(F.col("level") == 0).unionByName(again)
    if n is not None:
        final = final.where(F.col("rank") <= n)
    sections = F.transform(F.coalesce("chunks", F.array().cast(CHUNK_LIST)), lambda x: x.section)
    reasons, gaps = scoring.match_explanations(F.col("criteria"), F.col("semantic_norm"), sections)
    dropped = dropped_filters(F.col("criteria"), F.col("level"))
    # a query that retrieved nothing (no topic, no text, no chunk left) says so
    final = final.join(hits.select("query_id").distinct().withColumn("_hit", F.lit(True)), "query_id", "left")
    mode = F.when(F.col("_hit"), retrieval).otherwise("none")
    return final.select(
        "query_id", "rank", *FACTS, "score", "similarity",
        scoring.rounded_breakdown(F.col("parts")).alias("breakdown"),
        reasons.alias("reasons"), gaps.alias("gaps"),
        "total_matches", F.col("candidates").alias("candidate_count"), "level", dropped.alias("dropped"), mode.alias("mode"),
        "chunks", "criteria", "semantic_norm",
    )


def search_request(
    requests: DataFrame, listings: DataFrame, index: DataFrame, limit: int = 10, **options
) -> DataFrame:
    """Free text plus explicit criteria: requests (query_id, text, explicit struct).

    The text is parsed, the explicit fields win, and the text (else the skills) is embedded."""
    ready = requests.withColumn("_previous", F.lit(False))
    parsed = parse_queries(ready, "text", "_previous")
    criteria = merge_criteria(F.col("criteria"), F.col("explicit"))
    queries = parsed.select("query_id", criteria.alias("criteria"), F.col("text").alias("_text")).select(
        "query_id",
        "criteria",
        F.coalesce(blank_to_null(F.col("_text")), F.array_join("criteria.skills", " ")).alias("text"),
    )
    return hybrid_search(queries, listings, index, n=limit, **options)


def refine_search(
    turns: DataFrame, previous: DataFrame, listings: DataFrame, index: DataFrame, **options
) -> DataFrame:
    """Follow-up turns (query_id, criteria, text) over previous (query_id, criteria, text, candidate_ids)."""
    before = previous.select(
        "query_id", F.col("criteria").alias("_criteria"), F.col("text").alias("_text"),
        F.coalesce("candidate_ids", F.array().cast("array<bigint>")).alias("restrict_ids"),
    )
    joined = turns.join(before, "query_id")
    said = F.when(
        blank_to_null(F.col("_text")).isNull(), F.col("text")
    ).otherwise(F.concat(F.col("_text"), F.lit(". "), F.col("text")))
    queries = joined.select(
        "query_id", merge_criteria(F.col("_criteria"), F.col("criteria")).alias("criteria"), said.alias("text"), "restrict_ids"
    )
    return hybrid_search(queries, listings, index, **options)


