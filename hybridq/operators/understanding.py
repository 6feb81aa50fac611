"""Messages -> structured search criteria, for a whole table of messages at once."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from hybridq import vocab
from hybridq.functions.formats import employment_label, format_lakhs
from hybridq.functions.strings import blank_to_null, first_n, look_up, string_map, strings, strip
from hybridq.functions.text import tokenize

CRITERIA = [
    "keywords", "skills", "location", "remote", "experience_min", "experience_max",
    "salary_min", "salary_max", "employment_type",
]
CRITERIA_TYPES = {
    "keywords": "array<string>", "skills": "array<string>", "location": "string", "remote": "boolean",
    "experience_min": "int", "experience_max": "int", "salary_min": "bigint", "salary_max": "bigint",
    "employment_type": "string",
}
O, S = vocab.B_OPEN, vocab.B_SHUT
# a word boundary in either direction, ASCII only
EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
LINE_END = r"[\n\r\u0085\u2028\u2029]"


def _lower(text: Column) -> Column:
    return F.lower(strip(F.coalesce(text, F.lit(""))))


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _says(text: Column, words: str) -> Column:
    """A whole-message match: the words occur and the message has a single line."""
    return text.rlike(f"{O}(?:{words}){S}") & ~text.rlike(LINE_END)


# ---------------------------------------------------------------------------
# Skills and places
# ---------------------------------------------------------------------------
def _surface_forms() -> list[tuple[str, str]]:
    forms = []
    for skill in vocab.SKILLS:
        forms.append((skill, skill))
        forms.extend((skill, alias) for alias in vocab.SKILL_ALIASES.get(skill, []))
    return sorted(forms, key=lambda f: len(f[1]), reverse=True)


def _skill_pattern() -> str:
    """Longest form first.  A form that starts with a sign may also follow a longer match directly.

    What stands before a place is looked at once, not for each form, and a place that starts no form is left at once."""
    parts, signs, starts = [], [], set()
    for skill, form in _surface_forms():
        exact = form == skill and skill in vocab.EXACT_CASE_SKILLS
        body = re.escape(form).replace("/", r"\/")
        body = f"(?-i:{body})" if exact else body
        parts.append(body)
        starts |= {form[0].lower(), form[0].upper()}
        if not form[0].isalnum():
            signs.append(body)
    start = "".join(re.escape(s) for s in sorted(starts))
    alone = f"(?<![A-Za-z0-9])(?=[{start}])(?:{'|'.join(parts)})"
    after = rf"|\G(?<=[A-Za-z0-9+#.]{{4}})(?:{'|'.join(signs)})" if signs else ""
    return f"(?i)(?:{alone}{after})(?![A-Za-z0-9#])"


SKILL_PATTERN = _skill_pattern()


def _skill_lookup() -> Column:
    table = {}
    for skill in vocab.SKILLS:
        for form in [skill, *vocab.SKILL_ALIASES.get(skill, [])]:
            table[form.lower()] = skill
    return string_map(table)


def detect_skills(text: Column) -> Column:
    """Canonical skills in order of first appearance."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SKILL_PATTERN), F.lit(0))
    table = _skill_lookup()
    return F.array_distinct(F.transform(found, lambda s: look_up(table, F.lower(s))))


def canonicalise_skill(skill: Column) -> Column:
    """Canonical name of a skill or alias, NULL when unknown."""
    return look_up(_skill_lookup(), F.lower(strip(skill)))


def detect_location(text: Column) -> Column:
    """First dictionary entry mentioned anywhere in the text."""
    lower = F.lower(text)
    cases = [
        F.when(lower.rlike(f"{O}(?:{'|'.join(aliases)}){S}"), F.lit(place))
        for place, aliases in vocab.LOCATIONS.items()
    ]
    return F.coalesce(*cases)


def canonicalise_location(place: Column) -> Column:
    known = blank_to_null(place)
    return F.when(F.lower(known).isin(vocab.PLACELESS), F.lit(None)).otherwise(F.coalesce(detect_location(known), known))


# ---------------------------------------------------------------------------
# Single requirements
# ---------------------------------------------------------------------------
def extract_remote(lower: Column) -> Column:
    return F.when(lower.rlike(f"{O}(?:{vocab.ONSITE_WORDS}){S}"), F.lit(False)).when(
        lower.rlike(f"{O}(?:{vocab.REMOTE_WORDS}){S}"), F.lit(True)
    )


def _rupees(number: Column) -> Column:
    return F.floor(number.cast("double") * F.lit(float(vocab.LAKH)) + F.lit(0.5)).cast("bigint")


def extract_salary(lower: Column) -> Column:
    """struct(salary_min, salary_max)"""
    low, high = _group(lower, vocab.SALARY_SPAN, 1), _group(lower, vocab.SALARY_SPAN, 2)
    least, most = _group(lower, vocab.SALARY_LEAST, 1), _group(lower, vocab.SALARY_MOST, 1)
    bare = F.when(least.isNull() & most.isNull(), _group(lower, vocab.SALARY_AMOUNT, 1))
    ranged = low.isNotNull()
    return F.struct(
        _rupees(F.when(ranged, low).otherwise(F.coalesce(least, bare))).alias("salary_min"),
        _rupees(F.when(ranged, high).otherwise(most)).alias("salary_max"),
    )


def extract_experience(lower: Column) -> Column:
    """struct(experience_min, experience_max); the first rule that matches decides."""
    get = lambda pattern, g=1: _group(lower, pattern, g).cast("int")
    span = vocab.YEARS_SPAN
    less, most, more = get(vocab.YEARS_LESS), get(vocab.YEARS_MOST), get(vocab.YEARS_MORE)
    plus, exact = get(vocab.YEARS_PLUS), get(vocab.YEARS_EXACT)
    fresher = _says(lower, vocab.FRESHER_WORDS)

    def pair(lo, hi):
        return F.struct(lo.cast("int").alias("experience_min"), hi.cast("int").alias("experience_max"))

    nothing = F.lit(None)
    return (
        F.when(get(span).isNotNull(), pair(get(span), get(span, 2)))
        .when(less.isNotNull(), pair(nothing, F.greatest(F.lit(0), less - 1)))
        .when(most.isNotNull(), pair(nothing, most))
        .when(more.isNotNull(), pair(more, nothing))
        .when(plus.isNotNull(), pair(plus, nothing))
        .when(exact.isNotNull(), pair(exact, exact))
        .when(fresher, pair(F.lit(0), F.lit(1)))
        .otherwise(pair(nothing, nothing))
    )


def extract_employment_type(lower: Column) -> Column:
    return F.coalesce(
        *[F.when(_says(lower, words), F.lit(code)) for code, words in vocab.EMPLOYMENT_WORDS.items()]
    )


def extract_keywords(text: Column, skills: Column, location: Column, limit: int | None = None) -> Column:
    """Topic words that are not filters, skills or places; the first `limit`, if given."""
    spoken = F.flatten(F.transform(skills, lambda s: tokenize(s)))
    place = F.when(location.isNull(), strings([])).otherwise(tokenize(location))
    aliases = "|".join(a for names in vocab.LOCATIONS.values() for a in names)
    topic = F.filter(
        tokenize(text),
        lambda t: (F.length(t) >= 2)
        & ~t.rlike("^[0-9]+$")
        & ~t.isin(vocab.NON_TOPIC)
        & ~t.rlike(f"{O}(?:{aliases}){S}"),
    )
    return first_n(F.array_except(F.array_distinct(topic), F.concat(spoken, place)), limit)


def extract_ordinals(lower: Column) -> Column:
    """array<int> of 1-based positions; -1 is the last one."""
    count = _group(lower, vocab.FIRST_COUNT, 1)
    numbers = F.create_map(*[F.lit(x) for kv in vocab.NUMBER_WORDS.items() for x in kv])
    ordinals = F.create_map(*[F.lit(x) for kv in vocab.ORDINALS.items() for x in kv])
    words = F.regexp_extract_all(lower, F.lit(rf"{O}({'|'.join(vocab.ORDINALS)}){S}"), F.lit(1))
    last = lower.rlike(vocab.LAST_ITEM) & ~lower.rlike(LINE_END)
    named = F.concat(
        F.transform(words, lambda w: look_up(ordinals, w)),
        F.when(last, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")),
    )
    return F.when(count.isNotNull(), F.sequence(F.lit(1), look_up(numbers, count))).otherwise(F.array_distinct(named))


def extract_item_ids(lower: Column) -> Column:
    found = F.regexp_extract_all(lower, F.lit(vocab.ITEM_IDS), F.lit(1))
    return F.transform(found, lambda x: x.cast("bigint"))


def small_numbers(lower: Column) -> Column:
    """Numbers 1..5 that are not amounts, when at least two distinct ones are named."""
    pattern = rf"{EDGE}{vocab.NUMBER_NOUNS}\s*([1-5]){S}(?!{vocab.NUMBER_UNITS})"
    found = F.array_distinct(
        F.transform(F.regexp_extract_all(lower, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))
    )
    return F.when(F.size(found) >= 2, found).otherwise(F.array().cast("array<int>"))


# ---------------------------------------------------------------------------
# Criteria
# ---------------------------------------------------------------------------
def criteria_struct(**fields: Column) -> Column:
    """Typed criteria struct; NULL means not asked, missing lists become empty."""
    out = []
    for name in CRITERIA:
        value = fields.get(name, F.lit(None)).cast(CRITERIA_TYPES[name])
        if name in ("keywords", "skills"):
            value = F.coalesce(value, strings([]))
        elif name in ("location", "employment_type"):
            value = blank_to_null(value)
        out.append(value.alias(name))
    return F.struct(*out)


def has_structured_filters(c: Column) -> Column:
    return F.coalesce(
        *[F.when(c[name].isNotNull(), F.lit(True)) for name in CRITERIA[2:]], F.lit(False)
    )


def has_topic(c: Column) -> Column:
    return (F.size(c["skills"]) > 0) | (F.size(c["keywords"]) > 0)


def criteria_flags(c: Column) -> Column:
    return F.struct(
        (~has_topic(c) & ~has_structured_filters(c)).alias("is_empty"),
        has_structured_filters(c).alias("has_structured_filters"),
        has_topic(c).alias("has_topic"),
    )


def merge_criteria(base: Column, override: Column) -> Column:
    """Follow-up merge: given scalars win, experience moves as a pair, lists are unioned."""
    experience = override["experience_min"].isNotNull() | override["experience_max"].isNotNull()
    pick = lambda name: F.coalesce(override[name], base[name])
    merged = criteria_struct(
        keywords=F.array_union(base["keywords"], override["keywords"]),
        skills=F.array_union(base["skills"], override["skills"]),
        location=pick("location"),
        remote=pick("remote"),
        experience_min=F.when(experience, override["experience_min"]).otherwise(base["experience_min"]),
        experience_max=F.when(experience, override["experience_max"]).otherwise(base["experience_max"]),
        salary_min=pick("salary_min"),
        salary_max=pick("salary_max"),
        employment_type=pick("employment_type"),
    )
    return F.when(override.isNull(), base).when(base.isNull(), override).otherwise(merged)


def validate_criteria(c: Column, most_items: int | None = 20) -> Column:
    """array<string> of violated limits; `most_items` bounds the two lists, None leaves them free."""
    n = lambda name: F.coalesce(F.size(c[name]), F.lit(0))
    outside = lambda name, top: (c[name] < 0) | (c[name] > top)
    rules = [
        *[(n(x) > most_items, f"{x}: more than {most_items}") for x in ("keywords", "skills") if most_items is not None],
        (F.length(c["location"]) > 100, "location: longer than 100"),
        (outside("experience_min", 50), "experience_min: outside 0..50"),
        (outside("experience_max", 50), "experience_max: outside 0..50"),
        (outside("salary_min", 1_000_000_000), "salary_min: outside 0..1000000000"),
        (outside("salary_max", 1_000_000_000), "salary_max: outside 0..1000000000"),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in rules]))


def criteria_from_filters(f: Column) -> Column:
    """Explicit filters as criteria: remote only counts when true, zero or blank values are unset."""
    return criteria_struct(
        location=f["location"],
        remote=F.when(f["remote"], F.lit(True)),
        experience_min=f["experience_min"],
        experience_max=f["experience_max"],
        salary_min=F.nullif(f["salary_min"].cast("bigint"), F.lit(0).cast("bigint")),
        employment_type=f["employment_type"],
    )


def describe_criteria(c: Column) -> Column:
    dot = lambda arr: F.when(F.size(arr) > 0, F.array_join(arr, ", "))
    low, high = c["experience_min"], c["experience_max"]
    txt = lambda x: x.cast("string")
    experience = (
        F.when(low.isNotNull() & (low == high), F.concat(txt(low), F.lit(" yrs experience")))
        .when(
            low.isNotNull() & high.isNotNull(),
            F.concat(txt(low), F.lit("-"), txt(high), F.lit(" yrs experience")),
        )
        .when(high.isNotNull(), F.concat(F.lit("≤ "), txt(high), F.lit(" yrs experience")))
        .when(low.isNotNull(), F.concat(txt(low), F.lit("+ yrs experience")))
    )
    money = lambda sign, v: F.concat(F.lit(f"{sign} ₹"), format_lakhs(v), F.lit(" LPA"))
    return F.concat_ws(
        " · ",
        F.coalesce(dot(c["skills"]), dot(c["keywords"])),
        F.when(c["remote"], "remote").when(~c["remote"], "on-site"),
        c["location"],
        F.when(c["salary_min"].isNotNull(), money("≥", c["salary_min"])),
        F.when(c["salary_max"].isNotNull(), money("≤", c["salary_max"])),
        experience,
        F.when(c["employment_type"].isNotNull(), employment_label(c["employment_type"])),
    )


def semantic_query(text: Column, skills: Column, refine: Column, previous: Column) -> Column:
    """Text to embed: the message, else the skills; a refinement continues the previous text."""
    own = F.coalesce(blank_to_null(text), F.array_join(skills, " "))
    return F.when(refine & blank_to_null(previous).isNotNull(), F.concat(previous, F.lit(". "), text)).otherwise(own)


# ---------------------------------------------------------------------------
# Intent and the whole analysis
# ---------------------------------------------------------------------------
def classify_intent(lower: Column, criteria: Column, ordinals: Column, ids: Column, has_previous: Column) -> Column:
    filters = has_structured_filters(criteria)
    no_skill = F.size(criteria["skills"]) == 0
    pointed = lower.rlike(vocab.ITEM_POINTED)
    about_item = pointed | (F.size(ids) > 0) | ((F.size(ordinals) > 0) & (lower.rlike(vocab.ITEM_NAMED) & ~lower.rlike(LINE_END)))
    asks = lower.rlike(rf"\?|{O}(?:{vocab.QUESTION_WORDS})")
    narrows = lower.rlike(rf"^(?:{vocab.REFINE_START}){S}|{O}(?:{vocab.REFINE_ANYWHERE}){S}")
    greets = (
        lower.rlike(rf"^(?:{vocab.GREETING_WORDS}){S}")
        & ~lower.rlike(LINE_END)
        & (F.size(F.split(lower, r"\s+")) <= 4)
    )
    return (
        F.when(lower.rlike(vocab.COMPARE), "COMPARE")
        .when(about_item & asks & ~filters, "JOB_QUESTION")
        .when(has_previous & narrows, "REFINE")
        .when(greets & no_skill & ~filters, "GENERAL")
        .when(no_skill & ~filters & ~lower.rlike(f"{O}(?:{vocab.SEARCH_WORDS})"), "GENERAL")
        .otherwise("NEW_SEARCH")
    )


def parse_queries(queries: DataFrame, text_col: str = "text", previous_col: str = "has_previous") -> DataFrame:
    """Adds `criteria`, `intent`, `standalone_query`, `ordinals`, `job_ids`, `source`."""
    text = strip(F.coalesce(F.col(text_col), F.lit("")))
    found = queries.withColumn("_lower", _lower(F.col(text_col))).withColumns(
        {"_skills": detect_skills(text), "_location": detect_location(text)}
    )
    low = F.col("_lower")
    found = found.withColumns({"_pay": extract_salary(low), "_exp": extract_experience(low)})
    found = found.withColumns(
        {
            "criteria": criteria_struct(
                keywords=extract_keywords(text, F.col("_skills"), F.col("_location")),
                skills=F.col("_skills"),
                location=F.col("_location"),
                remote=extract_remote(low),
                experience_min=F.col("_exp.experience_min"),
                experience_max=F.col("_exp.experience_max"),
                salary_min=F.col("_pay.salary_min"),
                salary_max=F.col("_pay.salary_max"),
                employment_type=extract_employment_type(low),
            ),
            "ordinals": extract_ordinals(low),
            "job_ids": extract_item_ids(low),
        }
    )
    c = F.col
    intent = classify_intent(low, c("criteria"), c("ordinals"), c("job_ids"), c(previous_col))
    found = found.withColumn("intent", intent)
    by_number = (c("intent") == "COMPARE") & (F.size("ordinals") == 0) & (F.size("job_ids") == 0)
    return found.withColumns(
        {
            "ordinals": F.when(by_number, small_numbers(low)).otherwise(c("ordinals")),
            "standalone_query": text,
            "source": F.lit("rules"),
        }
    ).drop("_lower", "_skills", "_location", "_pay", "_exp")


# ---------------------------------------------------------------------------
# Model outputs and logged tool arguments
# ---------------------------------------------------------------------------
def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_text(v: Column) -> Column:
    return _kind(v) == "STRING"


def _is_number(v: Column) -> Column:
    return F.coalesce(_kind(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))


def _scalar(v: Column, path: str) -> Column:
    """Trimmed text of a JSON scalar; blank, the word null, lists and objects count as missing."""
    field = F.try_variant_get(v, path, "variant")
    single = _is_text(field) | _is_number(field) | (_kind(field) == "BOOLEAN")
    text = blank_to_null(F.when(single, F.try_variant_get(v, path, "string")))
    return F.when(F.lower(text) == "null", F.lit(None)).otherwise(text)


def _elements(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _texts(v: Column, path: str, limit: int | None) -> Column:
    """Non-blank texts of a JSON list; the first `limit`, if given."""
    texts = F.transform(
        F.filter(_elements(v, path), _is_text), lambda x: strip(F.try_variant_get(x, "$", "string"))
    )
    return first_n(F.filter(texts, lambda s: s != ""), limit)


def _number(v: Column, path: str) -> Column:
    field = F.try_variant_get(v, path, "variant")
    return F.when(_is_number(field), F.try_variant_get(field, "$", "double"))


def _whole(v: Column, path: str, digits: str = r"^\d+$") -> Column:
    """Integer part of a number, or of a text made of digits only."""
    field = F.try_variant_get(v, path, "variant")
    text = F.when(_is_text(field), F.try_variant_get(field, "$", "string"))
    return F.coalesce(
        _number(v, path).cast("bigint"),
        F.when(text.rlike(digits), strip(text).try_cast("bigint")),
    )


def _known_and_unknown(texts: Column) -> tuple[Column, Column]:
    pairs = F.transform(texts, lambda s: F.struct(s.alias("raw"), canonicalise_skill(s).alias("known")))
    return (
        F.transform(F.filter(pairs, lambda p: p.known.isNotNull()), lambda p: p.known),
        F.transform(F.filter(pairs, lambda p: p.known.isNull()), lambda p: p.raw),
    )


def _employment_code(text: Column) -> Column:
    code = F.regexp_replace(F.upper(text), "[- ]", "_")
    return F.when(code.isin(list(vocab.EMPLOYMENT_LABELS)), code)


def parse_model_json(
    outputs: DataFrame, raw_col: str = "raw", message_col: str = "text", list_limit: int | None = None
) -> DataFrame:
    """Adds the analysis read from model output, plus `error` (NULL when usable).

    Lists and objects where one value is expected count as missing.  `list_limit` bounds JSON lists.
    """
    body = F.regexp_extract(F.col(raw_col), r"(?s)\{.*\}", 0)
    df = outputs.withColumn("_body", body).withColumn("_v", F.try_parse_json("_body"))
    v = F.col("_v")
    remote = F.try_variant_get(v, "$.remote", "variant")
    integers = lambda path: F.filter(
        F.transform(_elements(v, path), lambda x: F.when(_is_number(x), F.try_variant_get(x, "$", "bigint"))),
        lambda x: x.isNotNull(),
    )
    # fields first, so that the rules below read columns instead of repeating the JSON access
    df = df.withColumns(
        {
            "_skills": _texts(v, "$.skills", list_limit),
            "_words": _texts(v, "$.keywords", list_limit),
            "_place": _scalar(v, "$.location"),
            "_remote": F.when(_kind(remote) == "BOOLEAN", F.try_variant_get(remote, "$", "boolean")),
            "_low": _whole(v, "$.experienceMin"),
            "_high": _whole(v, "$.experienceMax"),
            "_pay_low": _number(v, "$.salaryMin"),
            "_pay_high": _number(v, "$.salaryMax"),
            "_type": _scalar(v, "$.employmentType"),
            "_intent": F.upper(F.coalesce(_scalar(v, "$.intent"), F.lit("NEW_SEARCH"))),
            "standalone_query": F.coalesce(_scalar(v, "$.standaloneQuery"), F.col(message_col)),
            "ordinals": F.filter(integers("$.ordinals"), lambda x: x.between(1, 20)).cast("array<int>"),
            "job_ids": F.filter(integers("$.jobIds"), lambda x: x > 0),
        }
    )
    known, unknown = _known_and_unknown(F.col("_skills"))
    clamp = lambda name: F.when(F.col(name).between(0, 50), F.col(name)).cast("int")
    df = df.withColumns({"_low": clamp("_low"), "_high": clamp("_high")})
    low, high = F.col("_low"), F.col("_high")
    swap = low.isNotNull() & high.isNotNull() & (low > high)

    def salary(name):
        n = F.col(name)
        rupees = F.floor(F.when(n < 1000, n * vocab.LAKH).otherwise(n) + F.lit(0.5)).cast("bigint")
        return F.when((n > 0) & (rupees <= 1_000_000_000), rupees)

    df = df.withColumns(
        {
            "criteria": criteria_struct(
                keywords=F.concat(unknown, F.col("_words")),
                skills=known,
                location=canonicalise_location(F.col("_place")),
                remote=F.col("_remote"),
                experience_min=F.when(swap, high).otherwise(low),
                experience_max=F.when(swap, low).otherwise(high),
                salary_min=salary("_pay_low"),
                salary_max=salary("_pay_high"),
                employment_type=_employment_code(F.col("_type")),
            ),
            "intent": F.when(F.col("_intent").isin(vocab.INTENTS), F.col("_intent")).otherwise("NEW_SEARCH"),
        }
    )
    violations = validate_criteria(F.col("criteria"), list_limit)
    error = (
        F.when(F.col("_body") == "", "no JSON object in LLM output")
        .when(v.isNull(), "unparseable JSON from LLM")
        .when(F.size(violations) > 0, F.concat(F.lit("criteria failed validation: "), F.get(violations, F.lit(0))))
    )
    df = df.withColumn("error", error)
    usable = F.col("error").isNull()
    for name in ["criteria", "intent", "standalone_query", "ordinals", "job_ids"]:
        df = df.withColumn(name, F.when(usable, F.col(name)))
    scratch = ["_body", "_v", "_skills", "_words", "_place", "_remote", "_low", "_high", "_pay_low", "_pay_high", "_type", "_intent"]
    return df.withColumn("source", F.when(usable, "llm")).drop(*scratch)


def clean_keywords(keywords: Column, skills: Column, location: Column) -> Column:
    """Proposed keywords, filtered like extracted ones."""
    return extract_keywords(F.array_join(keywords, " "), skills, location)


def merge_model_and_rules(model: DataFrame, rules: DataFrame, key: str = "query_id") -> DataFrame:
    """Join both analyses on `key`: model values win, rules fill the gaps.

    A model row with an error leaves the rule analysis untouched; `note` says why, also where there is no model row."""
    fields = ["criteria", "intent", "standalone_query", "ordinals", "job_ids"]
    m = model.select(key, "error", *[F.col(f).alias(f"m_{f}") for f in fields])
    r = rules.select(key, "has_previous", *[F.col(f).alias(f"r_{f}") for f in fields])
    both = r.join(m, key, "left").withColumn(
        "usable", F.col("error").isNull() & F.col("m_criteria").isNotNull()
    )
    l, u = F.col("m_criteria"), F.col("r_criteria")
    both = both.withColumns(
        {
            "_skills": F.array_union(l["skills"], u["skills"]),
            "_location": F.coalesce(l["location"], u["location"]),
            "_words": F.when(F.size(l["keywords"]) > 0, l["keywords"]).otherwise(u["keywords"]),
        }
    )
    experience = l["experience_min"].isNotNull() | l["experience_max"].isNotNull()
    pick = lambda name: F.coalesce(l[name], u[name])
    merged = criteria_struct(
        keywords=clean_keywords(F.col("_words"), F.col("_skills"), F.col("_location")),
        skills=F.col("_skills"),
        location=F.col("_location"),
        remote=pick("remote"),
        experience_min=F.when(experience, l["experience_min"]).otherwise(u["experience_min"]),
        experience_max=F.when(experience, l["experience_max"]).otherwise(u["experience_max"]),
        salary_min=pick("salary_min"),
        salary_max=pick("salary_max"),
        employment_type=pick("employment_type"),
    )
    usable = F.col("usable")
    both = both.withColumn("criteria", F.when(usable, merged).otherwise(u))
    first = F.when(F.col("r_intent") == "COMPARE", F.lit("COMPARE")).otherwise(F.col("m_intent"))
    second = F.when((first == "REFINE") & ~F.col("has_previous"), F.lit("NEW_SEARCH")).otherwise(first)
    third = F.when(
        (second == "GENERAL") & has_topic(F.col("criteria")) & (F.col("r_intent") != "GENERAL"), F.lit("NEW_SEARCH")
    ).otherwise(second)
    either = lambda name: F.when(usable & (F.size(f"m_{name}") > 0), F.col(f"m_{name}")).otherwise(
        F.col(f"r_{name}")
    )
    before, after = vocab.BAD_MODEL_OUTPUT
    return both.select(
        key,
        "criteria",
        F.when(usable, third).otherwise(F.col("r_intent")).alias("intent"),
        F.when(usable, F.col("m_standalone_query")).otherwise(F.col("r_standalone_query")).alias("standalone_query"),
        either("ordinals").alias("ordinals"),
        either("job_ids").alias("job_ids"),
        F.when(usable, "llm+rules").otherwise("rules").alias("source"),
        F.when(F.col("error").isNotNull(), F.concat(F.lit(before), F.col("error"), F.lit(after)))
        .when(~usable, vocab.NO_MODEL).alias("note"),
    )


def criteria_from_tool_args(calls: DataFrame, args_col: str = "arguments") -> DataFrame:
    """Adds `query` and `criteria` read from logged search arguments (JSON)."""
    df = calls.withColumn(
        "_v", F.try_parse_json(F.coalesce(blank_to_null(F.col(args_col)), F.lit("{}")))
    )
    v = F.col("_v")
    texts = F.transform(F.filter(_elements(v, "$.skills"), _is_text), lambda x: F.try_variant_get(x, "$", "string"))
    known, unknown = _known_and_unknown(F.filter(texts, lambda s: strip(s) != ""))
    digits = r"^[\x00-\x20]*\d+[\x00-\x20]*$"
    years = _whole(v, "$.experience_years", digits)
    lpa_field = F.try_variant_get(v, "$.min_salary_lpa", "variant")
    lpa_text = F.when(_is_text(lpa_field), strip(F.try_variant_get(lpa_field, "$", "string")))
    lpa = F.coalesce(
        _number(v, "$.min_salary_lpa"), F.when(lpa_text.rlike(r"^\d+(\.\d+)?$"), lpa_text.try_cast("double"))
    )
    remote = F.try_variant_get(v, "$.remote", "string")
    df = df.withColumns(
        {
            "query": _scalar(v, "$.query"),
            "_explicit": criteria_struct(
                keywords=unknown,
                skills=known,
                location=canonicalise_location(_scalar(v, "$.location")),
                remote=F.when(F.lower(remote) == "true", F.lit(True)),
                experience_min=years,
                experience_max=F.coalesce(years, F.when(years.isNull(), _whole(v, "$.max_required_experience", digits))),
                salary_min=F.when(lpa > 0, F.floor(lpa * vocab.LAKH + F.lit(0.5))),
                employment_type=_employment_code(_scalar(v, "$.employment_type")),
            ),
        }
    )
    parsed = parse_queries(df.withColumn("_previous", F.lit(False)), "query", "_previous")
    merged = F.when(F.col("query").isNull(), F.col("_explicit")).otherwise(
        merge_criteria(F.col("criteria"), F.col("_explicit"))
    )
    return parsed.select(*[c for c in calls.columns], "query", merged.alias("criteria"))
