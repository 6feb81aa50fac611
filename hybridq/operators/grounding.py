"""Grounded context, answer audit and deterministic answers, per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hybridq.functions.formats import (
    bullet_list, date_text, employment_label, format_experience, format_salary, yes_no,
)
from hybridq.functions.strings import cut, first_n, strings
from hybridq.operators.documents import strip_header
from hybridq.operators.scoring import match_label, match_percent
from hybridq.operators.understanding import describe_criteria
from hybridq.vocab import B_OPEN


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def referenced_ids(text: Column, min_digits: int = 2) -> Column:
    """Distinct ids written as #n, job n, job id n or job #n, in order."""
    pattern = rf"(?i)(?:#|{B_OPEN}job\s+(?:id\s*)?#?)\s*(\d{{{min_digits},}})"
    return F.array_distinct(
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.try_cast("bigint"))
    )


def grounding_audit(answers: DataFrame, allowed: DataFrame, min_digits: int = 2) -> DataFrame:
    """(query_id, accepted, unknown_ids, note) for answers (query_id, answer) and pairs (query_id, id)."""
    refs = answers.select("query_id", F.posexplode(referenced_ids(F.col("answer"), min_digits)).alias("pos", "id"))
    stray = refs.join(allowed.select("query_id", "id"), ["query_id", "id"], "left_anti")
    ordered = F.sort_array(F.collect_list(F.struct("pos", "id")))
    unknown = stray.groupBy("query_id").agg(F.transform(ordered, lambda x: x.id).alias("unknown_ids"))
    bad = F.col("unknown_ids").isNotNull()
    return answers.join(unknown, "query_id", "left").select(
        "query_id",
        (~bad).alias("accepted"),
        F.coalesce("unknown_ids", F.array().cast("array<bigint>")).alias("unknown_ids"),
        F.when(
            bad,
            _say(
                "Grounding guard: LLM referenced job(s) [", F.array_join(F.col("unknown_ids").cast("array<string>"), ", "),
                "] that are not in the retrieved context; answer discarded",
            ),
        ).alias("note"),
    )


def item_facts() -> Column:
    """The fact sheet of a listing, one line per field."""
    c = F.col
    return F.concat_ws(
        "\n",
        _say("[JOB #", c("id").cast("string"), "]"),
        _say("Title: ", c("title")),
        _say("Company: ", c("company")),
        _say("Location: ", c("location")),
        _say("Remote: ", yes_no(c("remote"))),
        _say("Employment type: ", employment_label(c("employment_type"))),
        _say("Experience required: ", format_experience(c("experience_min"), c("experience_max"))),
        _say("Salary: ", format_salary(c("salary_min"), c("salary_max"), c("currency"))),
        _say("Skills: ", F.array_join("skills", ", ")),
        _say("Posted: ", date_text(c("posted_date"))),
        F.lit(""),
    )


def _excerpts(chunks: Column, most: int | None) -> Column:
    """Excerpts from chunk structs (section, score, text), or an empty text."""
    line = lambda x: _say(
        "  (", x.section, ", similarity ", F.format_string("%.2f", x.score), ") ",
        F.replace(strip_header(x.text), F.lit("\n"), F.lit("\n    ")), "\n",
    )
    some = F.coalesce(F.size(chunks), F.lit(0)) > 0
    return F.when(
        some, _say("Retrieved excerpts:\n", F.array_join(F.transform(first_n(chunks, most), line), ""))
    ).otherwise("")


def _ordered(order: str, text: Column) -> Column:
    return F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct(order, text.alias("t")))), lambda x: x.t), ""
    )


def build_context(ranked: DataFrame, applied_col: str = "criteria", most_excerpts: int | None = None) -> DataFrame:
    """(query_id, context) from ranked rows with facts, reasons, gaps, chunks (with text),
    total_matches, dropped and criteria.  Rows per query are the shown ones, a handful.
    `most_excerpts` keeps the first excerpts of a listing only, if given."""
    c = F.col
    reasons = F.when(F.size("reasons") > 0, _say("Why it matches: ", F.array_join("reasons", "; "), "\n")).otherwise("")
    gaps = F.when(F.size("gaps") > 0, _say("Gaps: ", F.array_join("gaps", "; "), "\n")).otherwise("")
    block = _say(
        item_facts(), "Match assessment (computed by the search engine, relative): ",
        match_percent(c("score")).cast("string"), "% - ", match_label(c("score")), "\n",
        reasons, gaps, _excerpts(c("chunks"), most_excerpts), "\n",
    )
    rows = ranked.withColumns({"_block": block, "_summary": describe_criteria(c(applied_col))})
    per_query = rows.groupBy("query_id").agg(
        _ordered("rank", c("_block")).alias("_blocks"),
        F.first("_summary").alias("_summary"),
        F.first("total_matches").alias("_total"),
        F.count("*").alias("_shown"),
        F.first("dropped").alias("_dropped"),
    )
    summary = F.when(c("_summary") == "", "none").otherwise(c("_summary"))
    relaxed = F.when(
        F.size("_dropped") > 0,
        _say(" No job matched every filter, so these filters were relaxed: ", F.array_join("_dropped", ", "), "."),
    ).otherwise("")
    return per_query.select(
        "query_id",
        _say(
            "JOB CONTEXT (ranked by relevance, best first):\n\n", c("_blocks"),
            "SEARCH SUMMARY: criteria applied by the search engine: ", summary, ". ", c("_total").cast("string"),
            " job(s) matched in total; ", c("_shown").cast("string"), " shown above.", relaxed,
        ).alias("context"),
    )


def build_item_context(items: DataFrame, most_excerpts: int | None = None) -> DataFrame:
    """(query_id, id, context) for rows of listing fields plus chunk structs with text.
    `most_excerpts` keeps the first excerpts of a listing only, if given."""
    excerpts = _excerpts(F.col("chunks"), most_excerpts)
    return items.select(
        "query_id",
        "id",
        _say("JOB CONTEXT:\n\n", item_facts(), "Description: ", F.col("description"), "\n", excerpts).alias("context"),
    )


def build_comparison_context(members: DataFrame) -> DataFrame:
    """(set_id, context) from the members of each set (set_id, pos and listing fields, at most 4)."""
    block = _say(item_facts(), "Benefits: ", F.array_join("benefits", "; "), "\n\n")
    return members.withColumn("_block", block).groupBy("set_id").agg(
        _say("JOB CONTEXT:\n\n", _ordered("pos", F.col("_block"))).alias("context")
    )


def shown_line() -> Column:
    c = F.col
    return _say(
        "Job #", c("id").cast("string"), " ", c("title"), " - ", c("company"), " (", c("location"),
        F.when(c("remote"), ", remote").otherwise(""), ", ",
        format_salary(c("salary_min"), c("salary_max"), c("currency")), ")",
    )


def _shown(states: DataFrame, listings: DataFrame) -> DataFrame:
    """(query_id, _lines): existing shown listings in order, as text (a handful per query)."""
    rows = states.select("query_id", F.posexplode("shown_ids").alias("pos", "id")).join(listings, "id")
    ordered = F.sort_array(F.collect_list(F.struct("pos", shown_line().alias("t"))))
    return rows.groupBy("query_id").agg(F.transform(ordered, lambda x: x.t).alias("_lines"))


def state_block(states: DataFrame, listings: DataFrame) -> DataFrame:
    """(query_id, block) from states (query_id, criteria, shown_ids, focus_id, filters)."""
    c = F.col
    rows = states.join(_shown(states, listings), "query_id", "left")
    lines = F.coalesce("_lines", strings([]))
    numbered = F.array_join(
        F.transform(lines, lambda t, i: _say("  ", (i + 1).cast("string"), ". ", t, "\n")), ""
    )
    nothing = F.coalesce(F.size("shown_ids"), F.lit(0)) <= 0
    filters = F.coalesce(describe_criteria(c("filters")), F.lit(""))
    return rows.select(
        "query_id",
        _say(
            "CONVERSATION STATE:\n",
            F.when(nothing, "- No jobs have been shown yet.\n").otherwise(
                _say("- Last search: ", F.coalesce(describe_criteria(c("criteria")), F.lit("")), "\n",
                     "- Jobs shown to the user (in order):\n", numbered)
            ),
            F.when(
                c("focus_id").isNotNull(),
                _say("- The user is currently asking about Job #", c("focus_id").cast("string"),
                     " (\"this job\" refers to it).\n"),
            ).otherwise(""),
            F.when(
                filters != "",
                _say("- Filters selected in the UI (applied automatically to searches): ", filters, "\n"),
            ).otherwise(""),
        ).alias("block"),
    )


def extraction_prompt(turns: DataFrame, listings: DataFrame, message_chars: int | None = None) -> DataFrame:
    """(query_id, prompt) from turns (query_id, text, criteria, shown_ids, history).

    `message_chars` cuts the messages of the history, if given."""
    c = F.col
    rows = turns.join(_shown(turns, listings), "query_id", "left")
    numbered = F.array_join(
        F.transform("_lines", lambda t, i: _say((i + 1).cast("string"), ". ", t, "\n")), ""
    )
    spoken = F.array_join(
        F.transform(
            "history",
            lambda m: _say(m.role, ": ", F.replace(m.content if message_chars is None else cut(m.content, message_chars), F.lit("\n"), F.lit(" ")), "\n"),
        ),
        "",
    )
    none = lambda arr, text: F.when(F.coalesce(F.size(arr), F.lit(0)) <= 0, "none\n").otherwise(text)
    return rows.select(
        "query_id",
        _say(
            "PREVIOUS SEARCH CRITERIA: ", F.coalesce(F.to_json("criteria"), F.lit("none")), "\n\n",
            "PREVIOUSLY SHOWN JOBS:\n", none("_lines", numbered),
            "\nRECENT CONVERSATION:\n", none("history", spoken),
            "\nCURRENT MESSAGE: ", c("text"),
        ).alias("prompt"),
    )


def answer_search(ranked: DataFrame, queries: DataFrame | None = None, most_reasons: int | None = None) -> DataFrame:
    """(query_id, answer): deterministic result text from the shown rows of each query.

    With `queries` (query_id, criteria), those without a row in `ranked` are answered too.
    `most_reasons` keeps the first reasons of a listing only, if given."""
    c = F.col
    why = F.when(
        F.size("reasons") > 0, _say("   Why: ", F.array_join(first_n(c("reasons"), most_reasons), "; "), "\n")
    ).otherwise("")
    item = _say(
        c("rank").cast("string"), ". **", c("title"), "** - ", c("company"), " (Job #", c("id").cast("string"), ")\n   ",
        c("location"), F.when(c("remote"), " · Remote").otherwise(""), " · ",
        format_salary(c("salary_min"), c("salary_max"), c("currency")), " · ",
        format_experience(c("experience_min"), c("experience_max")), "\n", why,
    )
    rows = ranked.withColumns({"_item": item, "_filters": describe_criteria(c("criteria"))})
    per_query = rows.groupBy("query_id").agg(
        _ordered("rank", c("_item")).alias("_items"),
        F.first("_filters").alias("_filters"),
        F.first("total_matches").alias("_total"),
        F.count("*").alias("_shown"),
        F.first("dropped").alias("_dropped"),
    )
    opening = F.when(
        F.size("_dropped") > 0,
        _say("No job matched all of your filters, so I relaxed: ", F.array_join("_dropped", ", "),
             ". Here are the closest matches"),
    ).otherwise(
        _say("I found ", c("_total").cast("string"), F.when(c("_total") == 1, " job").otherwise(" jobs"),
             " matching your request")
    )
    filters = F.when(c("_filters") != "", _say(" (", c("_filters"), ")")).otherwise("")
    top = F.when(c("_total") > c("_shown"), _say(". Top ", c("_shown").cast("string"), ":")).otherwise(":")
    text = _say(opening, filters, top, "\n\n", c("_items"))
    found = per_query.select("query_id", F.regexp_replace(text, r"[\x00-\x20]+$", "").alias("answer"))
    if queries is None:
        return found
    none = answer_no_results(c("criteria"))
    return queries.select("query_id", "criteria").join(found, "query_id", "left").select(
        "query_id", F.coalesce("answer", none).alias("answer")
    )


def answer_no_results(criteria: Column) -> Column:
    filters = describe_criteria(criteria)
    return _say(
        "I couldn't find any jobs in the knowledge base matching your request",
        F.when(filters == "", "").otherwise(_say(" (", filters, ")")),
        ". Try removing a filter, widening the salary or experience range, or searching for a related skill.",
    )


def answer_item(items: DataFrame, question_col: str = "question") -> DataFrame:
    """(query_id, answer) about one listing: the sections its question asks for."""
    c = F.col
    q = F.lower(question_col)
    ref = _say("Job #", c("id").cast("string"), " (", c("title"), " at ", c("company"), ")")
    bullets = lambda n: bullet_list(c(n), "- Not specified in the listing")
    band = format_salary(c("salary_min"), c("salary_max"), c("currency"))
    years = format_experience(c("experience_min"), c("experience_max"))
    # fixed values: question words of each section, and the section text
    sections = [
        (["skill", "tech", "stack"], _say(ref, " lists these skills: ", F.array_join("skills", ", "), ".")),
        (["require", "qualif", "eligib"], _say("Requirements:\n", bullets("requirements"))),
        (["responsib", "duties", "day to day", "role involve"], _say("Responsibilities:\n", bullets("responsibilities"))),
        (["benefit", "perk", "insurance"], _say("Benefits:\n", bullets("benefits"))),
        (["salary", "pay", "ctc", "compensation"], _say("Salary: ", band, ".")),
        (["experience", "years"], _say("Experience required: ", years, ".")),
        (
            ["remote", "location", "where", "office"],
            _say("Location: ", c("location"), F.when(c("remote"), " (remote-friendly).").otherwise(" (not remote).")),
        ),
        (["apply", "link", "url"], _say("Application link: ", c("application_url"))),
    ]
    asked = lambda words: F.greatest(*[F.contains(q, F.lit(w)) for w in words])
    parts = F.array_compact(F.array(*[F.when(asked(words), text) for words, text in sections]))
    default = F.array(
        _say(ref, ": ", c("description")),
        _say(
            "Key facts: ", c("location"), F.when(c("remote"), " (remote)").otherwise(""), ", ", band, ", ", years,
            ", skills: ", F.array_join("skills", ", "), ".",
        ),
    )
    opening = F.array(_say("Here is what the listing for ", ref, " says:"))
    rows = items.withColumn("_parts", parts)
    full = (
        F.when(F.size("_parts") == 0, default)
        .when(asked(sections[0][0]), c("_parts"))
        .otherwise(F.concat(opening, c("_parts")))
    )
    return rows.select("query_id", F.array_join(full, "\n\n").alias("answer"))
