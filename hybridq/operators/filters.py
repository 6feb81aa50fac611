"""Structured filters and topic gates between a query table and a listing table.

Nothing here is a nested loop: places meet through the rarest piece of the asked text, everything
else through the cells of a grid (place, remote, pay band, band of years), and the
exact predicates are verified inside the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hybridq.functions.strings import strings
from hybridq.functions.text import Tokenizer, expand_concepts, tokenize
from hybridq.plans.joins import TARGET_ROWS, all_tasks, spread_join
from hybridq.plans.stages import materialise

#: Tokens that a task remembers, and listings whose words are made at once.
KNOWN = 1 << 18
PART_ROWS = 1000

FACTS = [
    "id", "skills", "location", "remote", "employment_type", "experience_min", "experience_max",
    "salary_min", "salary_max", "currency", "posted_date",
]


# ---------------------------------------------------------------------------
# Predicates (criteria struct column x listing columns)
# ---------------------------------------------------------------------------
def _asked(wanted: Column, holds: Column) -> Column:
    """True unless asked; a listing without the fact (NULL) fails what is asked."""
    return wanted.isNull() | F.coalesce(holds, F.lit(False))


def pred_remote(c: Column) -> Column:
    return _asked(c["remote"], F.col("remote") == c["remote"])


def pred_location(c: Column) -> Column:
    """Case-insensitive substring; a remote search does not filter by place."""
    holds = F.contains(F.lower("location"), F.lower(c["location"]))
    return F.coalesce(c["remote"], F.lit(False)) | _asked(c["location"], holds)


def pred_salary_overlap(c: Column) -> Column:
    return _asked(c["salary_min"], F.col("salary_max") >= c["salary_min"]) & _asked(
        c["salary_max"], F.col("salary_min") <= c["salary_max"]
    )


def pred_experience_overlap(c: Column) -> Column:
    return _asked(c["experience_max"], F.col("experience_min") <= c["experience_max"]) & _asked(
        c["experience_min"], F.col("experience_max") >= c["experience_min"]
    )


def pred_employment_type(c: Column) -> Column:
    return _asked(c["employment_type"], F.col("employment_type") == c["employment_type"])


def passes_all(c: Column) -> Column:
    return (
        pred_remote(c) & pred_location(c) & pred_salary_overlap(c) & pred_experience_overlap(c)
        & pred_employment_type(c)
    )


def filter_listings(listings: DataFrame, criteria: dict) -> DataFrame:
    """One literal search: only the requested conjuncts, so they reach the scan."""
    c, col = criteria, F.col
    if c.get("remote") is not None:
        listings = listings.where(col("remote") == c["remote"])
    if c.get("location") is not None and c.get("remote") is not True:
        listings = listings.where(F.contains(F.lower("location"), F.lit(c["location"].lower())))
    if c.get("salary_min") is not None:
        listings = listings.where(col("salary_max") >= c["salary_min"])
    if c.get("salary_max") is not None:
        listings = listings.where(col("salary_min") <= c["salary_max"])
    if c.get("experience_max") is not None:
        listings = listings.where(col("experience_min") <= c["experience_max"])
    if c.get("experience_min") is not None:
        listings = listings.where(col("experience_max") >= c["experience_min"])
    if c.get("employment_type") is not None:
        listings = listings.where(col("employment_type") == c["employment_type"])
    return listings


def required_level(c: Column) -> Column:
    """Position of the last filter the listing fails: 0 when it passes them all."""
    checks = [
        pred_salary_overlap(c), pred_experience_overlap(c), pred_location(c), pred_employment_type(c), pred_remote(c),
    ]
    return F.greatest(
        F.lit(0), *[F.when(~check, F.lit(i)).otherwise(F.lit(0)) for i, check in enumerate(checks, start=1)]
    )


# ---------------------------------------------------------------------------
# Places
# ---------------------------------------------------------------------------
def _pieces(text: Column, size: int) -> Column:
    """All different pieces of `size` characters, none of a shorter text."""
    n = F.length(text)
    starts = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(size))))


def match_places(asked: DataFrame, places: DataFrame) -> DataFrame:
    """(asked, place) for every asked text contained in a place name.

    Works on the distinct names only.  An asked text looks under the one of its pieces of three characters that the
    fewest names hold (a text of one or two characters under itself, an empty one under every name), so
    a beginning that most names share brings nothing together."""
    wanted = asked.select("asked").where(F.col("asked").isNotNull()).distinct().withColumn("_want", F.lower("asked"))
    own = F.when(F.length("_want") < 3, F.array("_want")).otherwise(_pieces(F.col("_want"), 3))
    wanted = wanted.withColumn("_gram", F.explode(own))
    names = places.select("place").where(F.col("place").isNotNull()).distinct().withColumn("_low", F.lower("place"))
    held = F.concat(F.array(F.lit("")), *[_pieces(F.col("_low"), size) for size in (1, 2, 3)])
    names = names.withColumn("_gram", F.explode(held)).join(wanted.select("_gram").distinct(), "_gram", "left_semi")
    often = names.groupBy("_gram").agg(F.count(F.lit(1)).alias("_names"))
    # a piece that no name holds leaves its text without any name
    ranked = wanted.join(often, "_gram", "left").groupBy("asked", "_want").agg(
        F.min(F.struct(F.coalesce("_names", F.lit(0)).alias("names"), "_gram")).alias("_rarest")
    )
    chosen = ranked.where("_rarest.names > 0").select("asked", "_want", F.col("_rarest._gram").alias("_gram"))
    return names.join(chosen, "_gram").where(F.contains("_low", F.col("_want"))).select("asked", "place")


# ---------------------------------------------------------------------------
# Candidate pairs
# ---------------------------------------------------------------------------
#: Years of experience in one band; pay bands are quarters of a doubling.
YEARS = 4
TOP_YEARS = 60
GRID = ["_place", "_remote", "_pay", "_years"]
UNKNOWN, ANY = -1, -2
#: Pairs of one key that are tested in one task: a test takes a fraction of a microsecond, a copy of a row costs disk.
PAIRS = 4 * TARGET_ROWS
ANYWHERE = ""


def place_key(place: Column) -> Column:
    """The key of one place, which no name makes equal to ANYWHERE."""
    return F.concat(F.lit("="), place)


def pay_band(amount: Column) -> Column:
    """Bands of pay, four for each doubling; monotone."""
    return F.floor(F.log2(F.greatest(amount.cast("double"), F.lit(1.0))) * 4).cast("int")


def year_band(years: Column) -> Column:
    return F.floor(F.least(F.greatest(years, F.lit(0)), F.lit(TOP_YEARS)) / YEARS).cast("int")


def _bands(low: Column, high: Column) -> Column:
    """All bands from low to high; none where they are turned round."""
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def _listing_cells(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """A listing once in each band of years that its range touches, and once for queries that don't ask for years;
    so for its place and for remote.  Its pay is the band of its upper end, which is what a lower bound asks for.

    `asked` is one row: the kinds of cells that any query looks into.  The others are not made."""
    low, high = F.col("experience_min"), F.col("experience_max")
    known = low.isNotNull() & high.isNotNull() & (low <= high)
    years = F.when(known, _bands(year_band(low), year_band(high))).otherwise(F.array(F.lit(UNKNOWN)))
    remote = F.array(F.lit(ANY), F.coalesce(F.col("remote").cast("int"), F.lit(UNKNOWN)))
    cells = F.flatten(F.transform(F.concat(F.array(F.lit(ANY)), years), lambda y: F.flatten(F.transform(
        remote, lambda r: F.transform(F.array(F.lit(True), F.lit(False)), lambda p: F.struct(p.alias("here"), r.alias("_remote"), y.alias("_years")))))))
    own = rows.columns
    placed = rows.join(F.broadcast(asked)).select(  # one row
        *own, F.coalesce(pay_band(F.col("salary_max")), F.lit(UNKNOWN)).alias("_pay"), F.array_min(years).alias("_first_years"),
        F.explode(F.array_intersect(cells, "_asked_cells")).alias("_cell"),
    )
    place = F.when(F.col("_cell.here"), place_key(F.col("location"))).otherwise(F.lit(ANYWHERE))
    return placed.select(*own, "_pay", "_first_years", place.alias("_place"), "_cell._remote", "_cell._years").where(F.col("_place").isNotNull())


#: The criteria that filter, as plain columns: Spark prunes structs, but not below a generator.
ASKED = ["location", "remote", "experience_min", "experience_max", "salary_min", "salary_max", "employment_type"]
ASKED_COLUMNS = {name: f"_asked_{name}" for name in ASKED}


def _asked_fields() -> dict[str, Column]:
    return {name: F.col(own) for name, own in ASKED_COLUMNS.items()}


def _query_cells(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """A query once in each cell that can hold a match; `edges` is one row: the bands of pay that occur."""
    c, col = _asked_fields(), F.col
    remote = F.coalesce(c["remote"].cast("int"), F.lit(ANY))
    least = F.when(c["salary_min"].isNotNull(), F.greatest(pay_band(c["salary_min"]), col("_first")))
    pay = F.when(c["salary_min"].isNull(), F.concat(F.array(F.lit(UNKNOWN)), _bands(col("_first"), col("_last")))).otherwise(
        _bands(least, col("_last"))
    )
    low, high = F.coalesce(c["experience_min"], F.lit(0)), F.coalesce(c["experience_max"], F.lit(TOP_YEARS))
    asked = c["experience_min"].isNotNull() | c["experience_max"].isNotNull()
    # a listing with one end of its range unknown, or both turned round, may still pass what is asked of the other end
    years = F.when(asked, F.concat(F.array(F.lit(UNKNOWN)), _bands(year_band(low), year_band(high)))).otherwise(F.array(F.lit(ANY)))
    years = F.when(asked & (low > high), F.array_union(years, _bands(year_band(high), year_band(low)))).otherwise(years)
    each = lambda values, inner: F.flatten(F.transform(values, inner))
    cells = each(pay, lambda p: F.transform(years, lambda y: F.struct(p.alias("_pay"), y.alias("_years"))))
    one = queries.join(F.broadcast(edges))  # one row
    spread = one.select(
        *queries.columns, F.least(year_band(low), year_band(high)).alias("_low_years"), remote.alias("_remote"), F.explode(cells).alias("_cell")
    )
    return spread.select(*queries.columns, "_low_years", "_remote", "_cell._pay", "_cell._years")


def grid_pairs(queries: DataFrame, listings: DataFrame, out: list[str], target_rows: int = PAIRS, verify: bool = True) -> DataFrame:
    """Pairs that pass all filters, met in a grid of place, remote, pay band and band of years.

    `queries` have one row for each place they accept, as its key in `_place` (ANYWHERE where they ask for none).  A pair
    whose ranges of years share several bands meets in each, and counts in the first one only.
    `verify=False` gives every pair that is tested, as often as it is."""
    pay = pay_band(F.col("salary_max"))
    edges = listings.agg(F.coalesce(F.min(pay), F.lit(0)).alias("_first"), F.coalesce(F.max(pay), F.lit(0)).alias("_last"))
    shared = F.greatest("_first_years", "_low_years")
    first = (F.col("_years") < 0) | (F.col("_years") == shared)
    extra = first & passes_all(_asked_fields()) if verify else None
    wanted = _query_cells(queries, edges)
    kinds = F.collect_set(F.struct((F.col("_place") != ANYWHERE).alias("here"), F.col("_remote"), F.col("_years")))
    cells = _listing_cells(listings, wanted.agg(kinds.alias("_asked_cells")))
    return spread_join(cells, wanted, GRID, ["id"], target_rows=target_rows, extra=extra, tasks=all_tasks(queries)).select(*out)


def filter_candidates(
    queries: DataFrame,
    listings: DataFrame,
    facts: list[str] = ("id",),
    target_rows: int = PAIRS,
    verify: bool = True,
) -> DataFrame:
    """(query_id, <facts>) for every listing that passes every requested filter.

    queries: query_id, criteria and optionally restrict_ids array<bigint> (NULL = no
    restriction, empty = no rows).  `verify=False` shows the pairs that are tested."""
    if "restrict_ids" not in queries.columns:
        queries = queries.withColumn("restrict_ids", F.lit(None).cast("array<bigint>"))
    c = _asked_fields()
    q = queries.select("query_id", "restrict_ids", *[F.col("criteria")[name].alias(own) for name, own in ASKED_COLUMNS.items()])
    needed = list(dict.fromkeys([*facts, *[f for f in FACTS if f not in ("skills", "posted_date", "currency")]]))
    rows = listings.select(*needed)
    by_place = c["location"].isNotNull() & ~F.coalesce(c["remote"], F.lit(False))
    free = q.where(F.col("restrict_ids").isNull()).drop("restrict_ids")
    own = ["query_id", *ASKED_COLUMNS.values()]
    out = ["query_id", *facts]

    # 1. a place is asked: all place names that contain it, else anywhere
    places = match_places(
        free.where(by_place).select(c["location"].alias("asked")), rows.select(F.col("location").alias("place"))
    )
    placed = free.where(by_place).join(places, c["location"] == F.col("asked")).select(*own, place_key(F.col("place")).alias("_place"))
    anywhere = free.where(~by_place).select(*own, F.lit(ANYWHERE).alias("_place"))
    first = grid_pairs(placed.unionByName(anywhere), rows, out, target_rows, verify)

    # 2. restricted to earlier results: start from the ids
    listed = q.where(F.col("restrict_ids").isNotNull()).select(*own, F.explode(F.array_distinct("restrict_ids")).alias("id"))
    second = listed.join(rows, "id")
    second = (second.where(passes_all(c)) if verify else second).select(*out)
    return first.unionByName(second)


def pred_restrict_ids(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Keep the pairs whose id is in the query's list (NULL list keeps all, empty keeps none)."""
    limited = queries.where(F.col("restrict_ids").isNotNull())
    allowed = limited.select("query_id", F.explode("restrict_ids").alias("id")).distinct()
    free = pairs.join(limited.select("query_id"), "query_id", "left_anti")
    return free.unionByName(pairs.join(allowed, ["query_id", "id"], "left_semi"))


# ---------------------------------------------------------------------------
# Topic gates
# ---------------------------------------------------------------------------
def _lowered(arr: Column) -> Column:
    return F.array_distinct(F.transform(arr, lambda s: F.lower(s)))


def topic_gate_skills(
    queries: DataFrame, listings: DataFrame, facts: list[str] = ("id",), target_rows: int = PAIRS
) -> DataFrame:
    """(query_id, criteria, <facts>): listings with at least one requested skill.

    A pair that shares several skills is emitted at the first one only, which makes
    a distinct (and its shuffle) unnecessary."""
    wanted = queries.select("query_id", "criteria", _lowered(F.col("criteria.skills")).alias("_wanted")).select(
        "query_id", "criteria", "_wanted", F.posexplode("_wanted").alias("_nth", "_skill")
    )
    wanted = wanted.select("query_id", "criteria", "_skill", F.when(F.col("_nth") > 0, F.slice("_wanted", F.lit(1), F.col("_nth"))).alias("_before"))
    offered = listings.select(*facts, _lowered(F.col("skills")).alias("_offered")).withColumn(
        "_skill", F.explode("_offered")
    )
    met = spread_join(offered, wanted, ["_skill"], ["id"], target_rows=target_rows, tasks=all_tasks(queries))
    return met.where(_none_of("_before", "_offered")).select("query_id", "criteria", *facts)


def _none_of(before: str, held: str) -> Column:
    """Nothing that was asked before the word of a pair is held (NULL: it is the first)."""
    return F.col(before).isNull() | ~F.coalesce(F.arrays_overlap(before, held), F.lit(False))


def asked_words(c: Column) -> Column:
    """What a query without skills asks by its keywords: their words and the concrete terms of their concepts."""
    terms = F.array_distinct(F.flatten(F.transform(c["keywords"], lambda k: expand_concepts(tokenize(k)))))
    return F.when(F.size(c["skills"]) == 0, terms).otherwise(strings([]))


def said_words(queries: DataFrame, listings: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(id, word): of the words that any query asks, those that stand in each listing.

    `words` is the catalogue's listing_words, where it is kept."""
    wanted = queries.select(F.explode(asked_words(F.col("criteria"))).alias("word")).distinct()
    return (listing_words(listings) if words is None else words).join(wanted, "word", "left_semi")


def listing_words(listings: DataFrame) -> DataFrame:
    """(id, word): all words of each listing, for a catalogue that is searched more than once."""
    body = F.concat_ws(
        " ", "title", F.array_join("skills", " "), "description", F.array_join("requirements", " "),
        F.array_join("responsibilities", " "),
    )
    kind = listings.schema["id"].dataType.simpleString()
    return listings.select("id", body.alias("_body")).mapInArrow(_different_words, f"id {kind}, word string")


def _different_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different word of each text; a text without words has a row with NULL."""
    tokenizer = Tokenizer(KNOWN)
    for batch in batches:
        for low in range(0, batch.num_rows, PART_ROWS):
            part = batch.slice(low, PART_ROWS)
            row, code = tokenizer.coded(part.column("_body"))
            size = len(tokenizer.names)
            row, code = np.divmod(np.unique(row * size + code), max(size, 1))
            used, at = np.unique(code, return_inverse=True)
            word = pa.array([tokenizer.names[c] for c in used.tolist()], pa.string()).take(pa.array(at))
            bare = np.setdiff1d(np.arange(part.num_rows), row)
            ids = part.column("id").take(pa.array(np.concatenate([row, bare])))
            yield pa.RecordBatch.from_arrays([ids, pa.concat_arrays([word, pa.nulls(len(bare), pa.string())])], ["id", "word"])


def on_topic(c: Column, skills: Column, said: Column) -> Column:
    """The topic gate of one pair: any asked skill is offered, else any asked word is among those `said`."""
    asked, offered = _lowered(c["skills"]), _lowered(skills)
    words = F.coalesce(F.arrays_overlap(asked_words(c), said), F.lit(False))
    return (
        F.when(F.size(c["skills"]) > 0, F.coalesce(F.arrays_overlap(asked, offered), F.lit(False)))
        .when(F.size(c["keywords"]) > 0, words)
        .otherwise(F.lit(True))
    )


def keyword_pairs(queries: DataFrame, listings: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """(query_id, id) for queries without skills: any keyword, or a concrete term of its
    concept, occurs in the listing."""
    wanted = queries.select("query_id", F.explode(asked_words(F.col("criteria"))).alias("word"))
    # read twice below (hot keys, join): keep the few matching words instead of tokenizing again
    spoken = materialise(said_words(queries, listings), "spoken")
    return spread_join(spoken, wanted, ["word"], ["id"], target_rows=target_rows).select("query_id", "id").distinct()


def topic_gate_keywords(
    queries: DataFrame,
    listings: DataFrame,
    facts: list[str] = ("id",),
    target_rows: int = PAIRS,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """(query_id, criteria, <facts>) of the keyword gate; `pairs` reuses an earlier keyword_pairs."""
    if pairs is not None:
        found = pairs.join(listings.select(*facts), "id")
        return spread_join(found, queries.select("query_id", "criteria"), ["query_id"], ["id"], target_rows=target_rows).select(
            "query_id", "criteria", *facts
        )
    # as with skills: a pair is made at the first shared word, with both sides' columns, and never shuffled
    terms = queries.select("query_id", F.explode(asked_words(F.col("criteria"))).alias("_word"))
    terms = terms.groupBy("query_id").agg(F.sort_array(F.collect_set("_word")).alias("_asked"))
    wanted = queries.select("query_id", "criteria").join(terms, "query_id").select(
        "query_id", "criteria", "_asked", F.posexplode("_asked").alias("_nth", "_word")
    )
    wanted = wanted.select("query_id", "criteria", "_word", F.when(F.col("_nth") > 0, F.slice("_asked", F.lit(1), F.col("_nth"))).alias("_before"))
    # read twice below (hot keys, join): keep the few matching words instead of tokenizing again
    spoken = said_words(queries, listings).groupBy("id").agg(F.sort_array(F.collect_set("word")).alias("_said"))
    spoken = materialise(spoken, "spoken")
    offered = listings.select(*facts).join(spoken, "id").withColumn("_word", F.explode("_said"))
    met = spread_join(offered, wanted, ["_word"], ["id"], target_rows=target_rows, tasks=all_tasks(queries))
    return met.where(_none_of("_before", "_said")).select("query_id", "criteria", *facts)
