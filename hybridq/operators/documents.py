"""Listings -> documents -> sections -> chunks.

The splitter is exploded with the outer form: the inner form makes the optimizer
add a size filter that evaluates the whole splitter a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hybridq.functions.chunking import split_text
from hybridq.functions.formats import bullet_list, employment_label, format_experience, format_salary, yes_no
from hybridq.functions.strings import cut, strings, strip
from hybridq.vocab import CHUNK_MAX_CHARS


def _text(c) -> Column:
    """A missing value prints as the word null, as in the display documents."""
    return F.coalesce(c.cast("string"), F.lit("null"))


def _headline(sep: str) -> list[Column]:
    c = F.col
    fields = [
        ("Job Title", _text(c("title"))),
        ("Company", _text(c("company"))),
        ("Location", _text(c("location"))),
        ("Remote", yes_no(c("remote"))),
        ("Employment Type", employment_label(c("employment_type"))),
        ("Experience", format_experience(c("experience_min"), c("experience_max"))),
        ("Salary", format_salary(c("salary_min"), c("salary_max"), c("currency"))),
    ]
    return [F.concat(F.lit(f"{name}:{sep}"), value) for name, value in fields]


def build_document(listings: DataFrame) -> DataFrame:
    """(id, document): one readable document per listing."""
    c = F.col
    blocks = [
        *_headline(" "),
        F.concat(F.lit("Skills:\n"), F.array_join("skills", ", ")),
        F.concat(F.lit("Description:\n"), _text(c("description"))),
        F.concat(F.lit("Requirements:\n"), bullet_list(c("requirements"))),
        F.concat(F.lit("Responsibilities:\n"), bullet_list(c("responsibilities"))),
        F.concat(F.lit("Benefits:\n"), bullet_list(c("benefits"))),
    ]
    return listings.select("id", strip(F.concat_ws("\n\n", *blocks)).alias("document"))


def _sections() -> Column:
    c = F.col
    header = F.concat(
        F.lit("Job: "), c("title"), F.lit(" at "), c("company"), F.lit(" ("), c("location"),
        F.when(c("remote"), ", remote").otherwise(""), F.lit(")"),
    )
    overview = F.concat_ws("\n", *_headline(" "), F.concat(F.lit("Description: "), _text(c("description"))))

    def section(name, head, body):
        return F.struct(F.lit(name).alias("section"), head.alias("header"), body.alias("body"))

    return F.array(
        section("OVERVIEW", F.lit(None).cast("string"), overview),
        section("SKILLS", header, F.concat(F.lit("Skills: "), F.array_join("skills", ", "))),
        section("REQUIREMENTS", header, F.concat(F.lit("Requirements:\n"), bullet_list(c("requirements")))),
        section("RESPONSIBILITIES", header, F.concat(F.lit("Responsibilities:\n"), bullet_list(c("responsibilities")))),
        section("BENEFITS", header, F.concat(F.lit("Benefits:\n"), bullet_list(c("benefits")))),
    )


def section_documents(listings: DataFrame) -> DataFrame:
    """(id, section, header, body), blank bodies left out."""
    return (
        listings.select("id", F.inline(_sections()))
        .where(strip(F.col("body")) != "")
        .select("id", "section", "header", "body")
    )


def chunk_listings(listings: DataFrame, max_chars: int = CHUNK_MAX_CHARS) -> DataFrame:
    """(document_id, job_id, section, chunk_index, text, metadata)."""
    c = F.col
    metadata = F.map_from_arrays(
        strings(["jobId", "title", "company", "location", "skills", "remote"]),
        F.array(
            c("id").cast("string"), _text(c("title")), _text(c("company")), _text(c("location")),
            F.array_join("skills", ", "), c("remote").cast("string"),
        ),
    )
    sections = listings.select("id", metadata.alias("facts"), F.inline(_sections()))
    budget = F.when(c("header").isNull(), F.lit(max_chars)).otherwise(
        F.greatest(F.lit(200), F.lit(max_chars) - F.length("header") - 1)
    )
    parts = sections.select(
        "id", "section", "header", "facts", F.posexplode_outer(split_text(c("body"), budget)).alias("chunk_index", "part")
    ).where(c("part").isNotNull())
    return parts.select(
        F.concat(
            F.lit("job-"), c("id").cast("string"), F.lit("-"), F.lower("section"), F.lit("-"),
            c("chunk_index").cast("string"),
        ).alias("document_id"),
        c("id").alias("job_id"),
        "section",
        "chunk_index",
        F.concat_ws("\n", "header", "part").alias("text"),
        F.map_concat("facts", F.create_map(F.lit("section"), c("section"))).alias("metadata"),
    )


def chunk_documents(documents: DataFrame, max_chars: int = CHUNK_MAX_CHARS, id_col: str = "doc_id") -> DataFrame:
    """Free prose: (document_id, <id_col>, chunk_index, text)."""
    parts = documents.select(
        id_col, F.posexplode_outer(split_text(F.col("text"), max_chars)).alias("chunk_index", "text")
    ).where(F.col("text").isNotNull())
    return parts.select(
        F.concat_ws("-", F.lit("doc"), F.col(id_col).cast("string"), F.col("chunk_index").cast("string")).alias(
            "document_id"
        ),
        id_col,
        "chunk_index",
        "text",
    )


def strip_header(text: Column) -> Column:
    """Drop the first line when it is a chunk header."""
    headed = text.startswith("Job: ") & F.contains(text, F.lit("\n"))
    return F.when(headed, text.substr(F.instr(text, "\n") + 1, F.length(text))).otherwise(text)


def _flat(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def excerpt(text: Column, limit: int = 400) -> Column:
    return cut(_flat(strip_header(text)), limit)


def preview(text: Column, limit: int = 220) -> Column:
    return cut(_flat(text), limit)


def chunks_of_document(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """All chunks of the listings in `ids` (column job_id)."""
    return chunks.join(ids.select("job_id").distinct(), "job_id", "left_semi")
