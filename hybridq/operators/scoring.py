"""Explainable relevance: components, weighted score, reasons, gaps and labels.

Functions take the criteria struct as a Column and read listing columns by name.
A component nobody asked for is NULL and does not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hybridq import vocab
from hybridq.functions.formats import employment_label, format_experience, format_lakhs, format_salary
from hybridq.functions.strings import first_n, join_human, let, round_half_up
from hybridq.operators.retrieval import order_key

COMPONENTS = list(vocab.WEIGHTS)


def _lower_all(arr: Column) -> Column:
    return F.transform(arr, lambda s: F.lower(s))


def _offered(offered: Column | None) -> Column:
    return _lower_all(F.col("skills")) if offered is None else offered


def matched_skills(c: Column, offered: Column | None = None) -> Column:
    """Asked skills that the listing offers.  `offered` are its skills in lower case, where they are kept."""
    return let(
        _offered(offered),
        lambda offered: F.filter(c["skills"], lambda s: F.array_contains(offered, F.lower(s))),
    )


def missing_skills(c: Column, offered: Column | None = None) -> Column:
    return let(
        _offered(offered),
        lambda offered: F.filter(c["skills"], lambda s: ~F.array_contains(offered, F.lower(s))),
    )


def skill_score(c: Column, offered: Column | None = None) -> Column:
    n = F.size(c["skills"])
    return F.when(n > 0, F.size(matched_skills(c, offered)).cast("double") / n)


def experience_fit(c: Column) -> Column:
    asked = c["experience_min"].isNotNull() | c["experience_max"].isNotNull()
    low = F.coalesce(c["experience_min"], F.lit(0))
    high = F.coalesce(c["experience_max"], F.lit(60))
    need_low, need_high = F.col("experience_min"), F.col("experience_max")
    distance = F.when(need_low > high, need_low - high).otherwise(low - need_high)
    partial = F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(0.25) * distance)
    return F.when(asked, F.when((need_low <= high) & (need_high >= low), F.lit(1.0)).otherwise(partial))


def _in_place(c: Column) -> Column:
    return F.coalesce(F.contains(F.lower("location"), F.lower(c["location"])), F.lit(False))


def location_fit(c: Column) -> Column:
    away = F.col("remote") & F.coalesce(c["remote"], F.lit(False))
    return F.when(
        c["location"].isNotNull(), F.when(_in_place(c), F.lit(1.0)).when(away, F.lit(0.8)).otherwise(F.lit(0.0))
    )


def remote_fit(c: Column) -> Column:
    return F.when(c["remote"].isNotNull(), F.when(F.col("remote") == c["remote"], F.lit(1.0)).otherwise(F.lit(0.0)))


def salary_fit(c: Column) -> Column:
    low, high = c["salary_min"], c["salary_max"]
    reach = (
        F.when(low.isNull() | (F.col("salary_min") >= low), F.lit(1.0))
        .when(F.col("salary_max") >= low, F.lit(0.5))
        .otherwise(F.lit(0.0))
    )
    return F.when(
        low.isNotNull() | high.isNotNull(), F.when(F.col("salary_min") > high, F.lit(0.0)).otherwise(reach)
    )


def components(c: Column, semantic: Column, offered: Column | None = None) -> Column:
    """Six nullable doubles, in the fixed order of the weights."""
    return F.struct(
        semantic.alias("semantic"),
        skill_score(c, offered).alias("skills"),
        experience_fit(c).alias("experience"),
        location_fit(c).alias("location"),
        remote_fit(c).alias("remote"),
        salary_fit(c).alias("salary"),
    )


def weighted_score(parts: Column, weights: dict = vocab.WEIGHTS) -> Column:
    """Sum of weight x component over sum of weights, applicable components only."""
    value = weight = F.lit(0.0)
    for name in COMPONENTS:
        w = F.lit(float(weights[name]))
        value = value + F.coalesce(parts[name] * w, F.lit(0.0))
        weight = weight + F.when(parts[name].isNotNull(), w).otherwise(F.lit(0.0))
    return F.when(weight == 0, F.lit(0.0)).otherwise(value / weight)


def rounded_breakdown(parts: Column) -> Column:
    return F.struct(*[round_half_up(parts[name], 3).alias(name) for name in COMPONENTS])


def match_percent(score: Column) -> Column:
    return F.floor(score * 100 + F.lit(0.5)).cast("int")


def match_label(score: Column) -> Column:
    return F.when(score >= 0.75, "Strong match").when(score >= 0.5, "Good match").otherwise("Partial match")


# ---------------------------------------------------------------------------
# Explanations
# ---------------------------------------------------------------------------
def describe_experience(c: Column) -> Column:
    low, high = c["experience_min"].cast("string"), c["experience_max"].cast("string")
    return (
        F.when(low == high, F.concat(low, F.lit(" years of experience")))
        .when(low.isNotNull() & high.isNotNull(), F.concat(low, F.lit("-"), high, F.lit(" years")))
        .when(high.isNotNull(), F.concat(F.lit("up to "), high, F.lit(" years")))
        .otherwise(F.concat(low, F.lit("+ years")))
    )


def offered_texts() -> dict[str, Column]:
    """What explanations say of a listing alone."""
    col = F.col
    return {
        "need": format_experience(col("experience_min"), col("experience_max")),
        "band": format_salary(col("salary_min"), col("salary_max"), col("currency")),
        "type": employment_label(col("employment_type")),
    }


def asked_texts(c: Column) -> dict[str, Column]:
    """What explanations say of the criteria alone."""
    lakhs = lambda amount: F.concat(F.lit("₹"), format_lakhs(amount), F.lit(" LPA"))
    return {"wanted": lakhs(c["salary_min"]), "cap": lakhs(c["salary_max"]), "years": describe_experience(c)}


#: What several sentences of an explanation ask of a pair.
PAIR_FACTS = {
    "matched": matched_skills, "missing": missing_skills, "experience": experience_fit, "location": location_fit, "remote": remote_fit,
}


def match_explanations(
    c: Column, semantic: Column, sections: Column, most_sections: int | None = None, texts: dict[str, Column] | None = None
) -> tuple[Column, Column]:
    """(reasons, gaps) as string arrays.  `sections` lists the sections of the listing's hits;
    `most_sections` names the first ones only, if given.

    `texts` are columns that hold what offered_texts, asked_texts and PAIR_FACTS make: for many pairs they are made once
    a listing, a query and a pair."""
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    col = F.col
    kept = texts or {}
    texts = offered_texts() | asked_texts(c) | kept
    matched, missing, exp, place, rem = (kept[n] if n in kept else make(c) for n, make in PAIR_FACTS.items())
    need, band, wanted, cap = texts["need"], texts["band"], texts["wanted"], texts["cap"]
    has_min, has_max = c["salary_min"].isNotNull(), c["salary_max"].isNotNull()
    above, reaches = col("salary_min") >= c["salary_min"], col("salary_max") >= c["salary_min"]
    hit_sections = F.array_join(first_n(F.array_distinct(_lower_all(sections)), most_sections), ", ")
    reasons = [
        F.when(
            (semantic >= 0.8) & (F.coalesce(F.size(sections), F.lit(0)) > 0),
            say("Job content closely matches your request (", hit_sections, ")"),
        ),
        F.when(
            F.size(matched) > 0,
            say(join_human(matched), F.when(F.size(matched) == 1, " matches").otherwise(" match")),
        ),
        F.when(exp >= 1.0, say("Requires ", need, " - within your range (", texts["years"], ")")),
        F.when(place == 1.0, say("Located in ", col("location"))).when(
            place == 0.8, say("Remote role (listed location: ", col("location"), ")")
        ),
        F.when(rem == 1.0, F.when(c["remote"], "Remote preference matches").otherwise("On-site role as requested")),
        F.when(has_min & above, say("Salary ", band, " meets your ", wanted, " minimum")).when(
            has_min & reaches, say("Upper end of ", band, " reaches your ", wanted, " minimum")
        ),
        F.when(has_max & ~has_min & (col("salary_min") <= c["salary_max"]), say("Salary ", band, " is within ", cap)),
        F.when(
            F.upper(c["employment_type"]) == F.upper("employment_type"),
            say(texts["type"], " as requested"),
        ),
    ]
    gaps = [
        F.when(F.size(missing) > 0, say(join_human(missing), " not listed in the job's skills")),
        F.when(exp < 1.0, say("Requires ", need, " (you asked for ", texts["years"], ")")),
        F.when(place == 0.0, say("Located in ", col("location"), ", not ", c["location"])),
        F.when(
            rem == 0.0,
            F.when(col("remote"), "Role is remote, you asked for on-site").otherwise("Role is not remote"),
        ),
        F.when(has_min & ~above & ~reaches, say("Salary ", band, " is below your ", wanted, " minimum")),
        F.when(has_max & (col("salary_min") > c["salary_max"]), say("Salary ", band, " starts above ", cap)),
    ]
    return F.array_compact(F.array(*reasons)), F.array_compact(F.array(*gaps))


# ---------------------------------------------------------------------------
# Ranking
# ---------------------------------------------------------------------------
def ranking_window():
    col = F.col
    return Window.partitionBy("query_id").orderBy(
        order_key(col("score")).desc(),
        order_key(col("similarity")).desc(),
        col("salary_max").desc(),
        col("posted_date").desc_nulls_last(),
        col("id"),
    )


def rank_results(
    scored: DataFrame, pool: int | None = vocab.POOL_SIZE, n: int | None = None, totals: DataFrame | None = None
) -> DataFrame:
    """Ranked pool with `rank` and `total_matches` (counted before the pool cut).

    The rank window is pruned to `pool` rows per query before its shuffle (None keeps all).  `totals`
    (query_id, total_matches) are known counts; without them a partial aggregate counts."""
    kept = [x for x in (pool, n) if x is not None]
    if totals is None:
        totals = scored.groupBy("query_id").agg(F.count("*").alias("total_matches"))
    top = scored.withColumn("rank", F.row_number().over(ranking_window()))
    if kept:
        top = top.where(F.col("rank") <= min(kept))
    return top.join(totals, "query_id")


