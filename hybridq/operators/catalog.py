"""Lookups, pages, cards, saved items and side-by-side comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hybridq.functions.strings import first_n
from hybridq.functions.formats import date_text, employment_label, format_experience, format_salary, yes_no
from hybridq.operators.scoring import match_label, match_percent
from hybridq.plans.joins import TARGET_ROWS, spread_join


def _page_size(size: int, most: int | None) -> int:
    return max(size, 1) if most is None else min(max(size, 1), most)


def page_listings(listings: DataFrame, page: int, size: int, most: int | None = None) -> DataFrame:
    """One page, newest first, with the total number of rows and pages; `most` bounds the page size, if given.

    Skipped rows pass through one task, so deep pages are for `page_after`.
    """
    size, page = _page_size(size, most), max(page, 0)
    rows = (
        listings.orderBy(F.col("posted_date").desc_nulls_last(), "id").offset(page * size).limit(size)
        .withColumn("_one", F.lit(1))
    )
    total = listings.agg(F.count("*").alias("total_rows")).select(
        F.lit(1).alias("_one"), "total_rows", F.ceil(F.col("total_rows") / size).cast("bigint").alias("total_pages")
    )
    return rows.join(F.broadcast(total), "_one").drop("_one")


def page_after(listings: DataFrame, posted_date, last_id: int, size: int, most: int | None = None) -> DataFrame:
    """Keyset page: rows after (posted_date, id), without reading the skipped ones."""
    size = _page_size(size, most)
    day = F.lit(posted_date).cast("date")
    if posted_date is None:
        after = F.col("posted_date").isNull() & (F.col("id") > last_id)
    else:
        after = (
            F.col("posted_date").isNull() | (F.col("posted_date") < day)
            | ((F.col("posted_date") == day) & (F.col("id") > last_id))
        )
    return listings.where(after).orderBy(F.col("posted_date").desc_nulls_last(), "id").limit(size)


def _first_positions(requests: DataFrame) -> DataFrame:
    """(request_id, id, pos) with the first position of each id; lists are bounded requests."""
    distinct = F.array_distinct("ids")
    return requests.select("request_id", F.posexplode(distinct).alias("pos", "id"))


def lookup_strict(requests: DataFrame, listings: DataFrame) -> DataFrame:
    """Ids in request order; an unknown id yields a row with `error`."""
    found = _first_positions(requests).join(listings.withColumn("_hit", F.lit(True)), "id", "left")
    error = F.when(F.col("_hit").isNull(), F.concat(F.lit("unknown id "), F.col("id").cast("string")))
    return found.withColumn("error", error).drop("_hit")


def lookup_ordered(requests: DataFrame, listings: DataFrame) -> DataFrame:
    """Ids in request order, unknown ones skipped."""
    return _first_positions(requests).join(listings, "id")


def _card_columns() -> list[Column]:
    c = F.col
    return [
        c("id"), c("title"), c("company"), c("location"), c("remote"), c("employment_type"),
        employment_label(c("employment_type")).alias("employment_label"),
        format_experience(c("experience_min"), c("experience_max")).alias("experience"),
        c("experience_min"), c("experience_max"),
        format_salary(c("salary_min"), c("salary_max"), c("currency")).alias("salary"),
        c("salary_min"), c("salary_max"), c("currency"), c("skills"),
        F.date_format("posted_date", "yyyy-MM-dd").alias("posted_date"),
    ]


def listing_card(listings: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """Display projection; with `ranked` (query_id, rank, id, score, reasons, gaps) one card per match."""
    cards = listings.select(*_card_columns())
    if ranked is None:
        return cards
    match = ranked.select(
        "query_id", "rank", "id", match_percent(F.col("score")).alias("match_percent"),
        match_label(F.col("score")).alias("match_label"), "reasons", "gaps",
    )
    return match.join(cards, "id")


def listing_detail(listings: DataFrame) -> DataFrame:
    return listings.select(
        *_card_columns(), "description", "requirements", "responsibilities", "benefits", "application_url"
    )


def saved_items(events: DataFrame, listings: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """(id, saved_at): items whose last action is save; the first save since the last unsave counts.

    events: id, action, ts, event_id.  Unknown items are left out; a hot item's events
    are cut into pieces before they meet its last unsave."""
    at = F.struct("ts", "event_id")
    gone = events.where(F.col("action") == "unsave").groupBy("id").agg(F.max(at).alias("_gone"))
    saves = events.where(F.col("action") == "save").select("id", at.alias("_at"))
    live = spread_join(saves.withColumn("_n", F.col("_at.event_id")), gone, ["id"], ["_n"], "left", target_rows)
    first = live.where(F.col("_gone").isNull() | (F.col("_at") > F.col("_gone"))).groupBy("id").agg(
        F.min("_at").alias("_at")
    )
    known = first.join(listings.select("id"), "id", "left_semi")
    return known.select("id", F.col("_at.ts").alias("saved_at")).orderBy(F.col("saved_at").desc(), "id")


# ---------------------------------------------------------------------------
# Comparison
# ---------------------------------------------------------------------------
def _members(sets: DataFrame, listings: DataFrame) -> DataFrame:
    """Distinct members of each set with their listing; sets of fewer than 2, more than 4
    or with unknown members are left out (see compare_errors)."""
    ids = F.array_distinct("ids")
    asked = sets.select("set_id", ids.alias("ids")).where(F.size("ids").between(2, 4))
    rows = asked.select("set_id", F.size("ids").alias("_n"), F.posexplode("ids").alias("pos", "id")).join(listings, "id")
    complete = rows.groupBy("set_id").agg(F.count("*").alias("_c"), F.max("_n").alias("_n")).where(
        F.col("_c") == F.col("_n")
    )
    return rows.join(complete.select("set_id"), "set_id", "left_semi").drop("_n")


def compare_errors(sets: DataFrame, listings: DataFrame) -> DataFrame:
    """(set_id, error) for sets that cannot be compared."""
    ids = F.array_distinct("ids")
    small = sets.where(~F.size(ids).between(2, 4)).select(
        "set_id", F.lit("provide 2 to 4 different job ids").alias("error")
    )
    unknown = (
        sets.where(F.size(ids).between(2, 4))
        .select("set_id", F.posexplode(ids).alias("pos", "id"))
        .join(listings.select("id"), "id", "left_anti")
        .groupBy("set_id").agg(F.min_by("id", "pos").alias("id"))
        .select("set_id", F.concat(F.lit("unknown id "), F.col("id").cast("string")).alias("error"))
    )
    return small.unionByName(unknown)


def _matrix_rows() -> list[tuple[str, Column]]:
    c = F.col
    return [
        ("Title", c("title")),
        ("Company", c("company")),
        ("Location", c("location")),
        ("Remote", yes_no(c("remote"))),
        ("Experience", format_experience(c("experience_min"), c("experience_max"))),
        ("Salary", format_salary(c("salary_min"), c("salary_max"), c("currency"))),
        ("Skills", F.array_join("skills", ", ")),
        ("Employment", employment_label(c("employment_type"))),
        ("Posted", date_text(c("posted_date"))),
        ("Benefits", F.array_join("benefits", ", ")),
    ]


def compare_matrix(sets: DataFrame, listings: DataFrame) -> DataFrame:
    """(set_id, line, label, values): ten labelled rows, one value per compared listing."""
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("line"), F.lit(label).alias("label"), value.alias("value"))
            for i, (label, value) in enumerate(_matrix_rows())
        ]
    )
    rows = _members(sets, listings).select("set_id", "pos", F.inline(cells))
    ordered = F.sort_array(F.collect_list(F.struct("pos", F.col("value").alias("v"))))
    return rows.groupBy("set_id", "line", "label").agg(F.transform(ordered, lambda x: x.v).alias("values"))


def compare_facts(sets: DataFrame, listings: DataFrame) -> DataFrame:
    """One row per set: top salary, lowest experience, remote ids, common and unique skills, summary."""
    c = F.col
    item = F.struct(
        "pos", "id", "title", "salary_max", "experience_min", "remote", "skills",
        format_salary(c("salary_min"), c("salary_max"), c("currency")).alias("salary"),
        format_experience(c("experience_min"), c("experience_max")).alias("experience"),
    )
    # at most four items per set
    sets4 = _members(sets, listings).groupBy("set_id").agg(
        F.sort_array(F.collect_list(item)).alias("items"),
        F.max_by(item, F.struct("salary_max", -c("pos"))).alias("top"),
        F.min_by(item, F.struct("experience_min", "pos")).alias("entry"),
    )
    items = c("items")
    ref = lambda x: F.concat(F.lit("Job #"), x.id.cast("string"))
    remote = F.filter(items, lambda x: x.remote)
    common = F.aggregate(
        items, F.get(items, F.lit(0)).skills, lambda acc, x: F.array_intersect(acc, x.skills)
    )
    unique = F.transform(
        items,
        lambda x: F.struct(
            x.id.alias("id"),
            F.filter(
                x.skills,
                lambda s: ~F.exists(items, lambda y: (y.pos != x.pos) & F.array_contains(y.skills, s)),
            ).alias("skills"),
        ),
    )
    unique = F.filter(unique, lambda u: F.size(u.skills) > 0)
    facts = sets4.withColumns({"remote_items": remote, "common_skills": common, "unique_skills": unique})
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    listed = lambda arr: F.when(F.size(arr) == 0, "none").otherwise(F.array_join(arr, ", "))
    remote_refs = F.transform(c("remote_items"), ref)
    lines = F.concat(
        F.array(
            say("- Highest salary ceiling: Job #", c("top.id").cast("string"), " (", c("top.title"), ", ",
                c("top.salary"), ")."),
            say("- Lowest experience requirement: Job #", c("entry.id").cast("string"), " (", c("entry.experience"), ")."),
            say("- Remote: ", F.when(F.size(remote_refs) == 0, "none of these roles").otherwise(
                F.array_join(remote_refs, ", ")), "."),
            say("- Skills in common: ", listed(c("common_skills")), "."),
        ),
        F.transform(
            c("unique_skills"),
            lambda u: say("- Only Job #", u.id.cast("string"), " lists: ", F.array_join(u.skills, ", "), "."),
        ),
    )
    return facts.select(
        "set_id",
        c("top.id").alias("top_salary_id"),
        c("entry.id").alias("lowest_experience_id"),
        F.transform("remote_items", lambda x: x.id).alias("remote_ids"),
        "common_skills",
        "unique_skills",
        F.array_join(lines, "\n").alias("summary"),
    )


# ---------------------------------------------------------------------------
# References to shown items
# ---------------------------------------------------------------------------
def map_ordinals(ordinals: Column, shown: Column) -> Column:
    """Ids at 1-based positions (-1 = last), out-of-range ones dropped, deduplicated."""
    at = lambda o: F.when(o == -1, F.size(shown) - 1).otherwise(o - 1)
    ids = F.transform(ordinals, lambda o: F.when(at(o) >= 0, F.get(shown, at(o))))
    return F.array_distinct(F.filter(ids, lambda x: x.isNotNull()))


def existing_ids(queries: DataFrame, name: str, listings: DataFrame) -> DataFrame:
    """(query_id, ids): the distinct ids of a list column that exist, in order."""
    rows = queries.select("query_id", F.posexplode(F.array_distinct(name)).alias("pos", "id"))
    known = rows.join(listings.select("id"), "id", "left_semi")
    ordered = F.sort_array(F.collect_list(F.struct("pos", "id")))
    return known.groupBy("query_id").agg(F.transform(ordered, lambda x: x.id).alias("ids"))


def resolve_compare_ids(
    turns: DataFrame, listings: DataFrame, most: int | None = None, most_shown: int | None = None
) -> DataFrame:
    """(query_id, ids): explicit ids, else ordinals, else the selection, else what was shown.

    `most` and `most_shown` keep the first ids only, if given.
    turns: query_id, job_ids, ordinals, selected_ids, shown_ids."""
    none = F.array().cast("array<bigint>")
    explicit = existing_ids(turns, "job_ids", listings).withColumnRenamed("ids", "_explicit")
    chosen = existing_ids(turns, "selected_ids", listings).withColumnRenamed("ids", "_chosen")
    both = turns.join(explicit, "query_id", "left").join(chosen, "query_id", "left")
    shown = F.coalesce("shown_ids", none)
    enough = lambda arr: F.when(F.size(arr) >= 2, first_n(arr, most))
    return both.select(
        "query_id",
        F.coalesce(
            enough(F.col("_explicit")), enough(map_ordinals(F.col("ordinals"), shown)), enough(F.col("_chosen")),
            first_n(shown, most_shown),
        ).alias("ids"),
    )


def resolve_target(turns: DataFrame, listings: DataFrame) -> DataFrame:
    """(query_id, id): explicit existing id, ordinal, focus of the request, stored focus, first shown."""
    none = F.array().cast("array<bigint>")
    explicit = existing_ids(turns, "job_ids", listings).withColumnRenamed("ids", "_explicit")
    shown = F.coalesce("shown_ids", none)
    first = lambda arr: F.get(arr, F.lit(0))
    return turns.join(explicit, "query_id", "left").select(
        "query_id",
        F.coalesce(
            first(F.col("_explicit")), first(map_ordinals(F.col("ordinals"), shown)), "focus_id", "stored_focus_id",
            first(shown),
        ).alias("id"),
    )


