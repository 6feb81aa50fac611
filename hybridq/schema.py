"""Explicit schemas of the catalogue input and the listing table."""

from __future__ import annotations

from pyspark.sql import types as T

LISTING = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("remote", T.BooleanType()),
        T.StructField("employment_type", T.StringType()),
        T.StructField("experience_min", T.IntegerType()),
        T.StructField("experience_max", T.IntegerType()),
        T.StructField("salary_min", T.LongType()),
        T.StructField("salary_max", T.LongType()),
        T.StructField("currency", T.StringType()),
        T.StructField("skills", T.ArrayType(T.StringType())),
        T.StructField("description", T.StringType()),
        T.StructField("requirements", T.ArrayType(T.StringType())),
        T.StructField("responsibilities", T.ArrayType(T.StringType())),
        T.StructField("benefits", T.ArrayType(T.StringType())),
        T.StructField("posted_date", T.DateType()),
        T.StructField("application_url", T.StringType()),
    ]
)

# fixed value: property names of the catalogue file
JSON_NAMES = {
    "id": "id", "title": "title", "company": "company", "location": "location", "remote": "remote",
    "employment_type": "employmentType", "experience_min": "experienceMin", "experience_max": "experienceMax",
    "salary_min": "salaryMin", "salary_max": "salaryMax", "currency": "currency", "skills": "skills",
    "description": "description", "requirements": "requirements", "responsibilities": "responsibilities",
    "benefits": "benefits", "posted_date": "postedDate", "application_url": "applicationUrl",
}

JSON_JOB = T.StructType(
    [
        T.StructField(JSON_NAMES[f.name], T.StringType() if f.name == "posted_date" else f.dataType)
        for f in LISTING.fields
    ]
)
ENVELOPE = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("disclaimer", T.StringType()),
        T.StructField("jobs", T.ArrayType(JSON_JOB)),
    ]
)
