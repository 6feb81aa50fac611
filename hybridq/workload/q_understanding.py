"""Queries of message understanding."""

from __future__ import annotations

from pyspark.sql import functions as F

from hybridq import vocab
from hybridq.operators import understanding as U
from hybridq.workload import duck
from hybridq.workload.duck import cte, in_list, joined, ordered_distinct, q, strip, tokens, with_ctes
from hybridq.workload.registry import query
from hybridq.workload.tables import query_log, run_sql, view

c = F.col
LOW = f"lower({strip('text')})"

# every text the parser sees: requests, logged queries, and real messages
cte(
    "texts",
    ["requests", "query_log", "messages"],
    """SELECT query_id * 10 AS query_id, has_previous, text FROM requests UNION ALL SELECT query_id * 10 + 1, true, text FROM query_log
    UNION ALL SELECT message_id * 10 + 2, turn > 0, text FROM messages""",
)


def texts(spark, sf):
    part = lambda df, tag, prev: df.select(
        (c("query_id") * 10 + tag).alias("query_id"), prev.alias("has_previous"), "text"
    )
    messages = view(spark, sf, "messages").withColumnRenamed("message_id", "query_id")
    return (
        part(view(spark, sf, "requests"), 0, c("has_previous"))
        .unionByName(part(view(spark, sf, "query_log"), 1, F.lit(True)))
        .unionByName(part(messages, 2, c("turn") > 0))
    )


def lowered(spark, sf):
    return texts(spark, sf).withColumn("low", U._lower(c("text")))


# --- skills: longest form first, each match replaced by one private-use character ---------
def _skill_marks() -> str:
    """Tokens get \\x01..\\x02 marks, so that boundaries can be consumed."""
    out = "regexp_replace(coalesce(text, ''), '([A-Za-z0-9]+)', chr(1) || '\\1' || chr(2), 'g')"
    forms = []
    for number, skill in enumerate(vocab.SKILLS):
        for form in [skill, *vocab.SKILL_ALIASES.get(skill, [])]:
            forms.append((number, form, form == skill and skill in vocab.EXACT_CASE_SKILLS))
    forms.sort(key=lambda f: len(f[1]), reverse=True)
    for number, form, exact in forms:
        pattern, previous = "", False
        for ch in form:
            word = ch.isalnum()
            if word and not previous:
                pattern += "\\x01"
            if previous and not word:
                pattern += "\\x02"
            pattern += ch if word or ch in " -/#" else "\\" + ch
            previous = word
        lead = "(^|[^A-Za-z0-9\\x02])" if not form[0].isalnum() else "()"
        if form[-1].isalnum():
            pattern, tail = pattern + "\\x02", "([^#]|$)"
        else:
            tail = "([^A-Za-z0-9#\\x01]|$)"
        flags = "g" if exact else "gi"
        for _ in range(2):
            out = f"regexp_replace({out}, '{lead}{pattern}{tail}', '\\1' || chr({57344 + number}) || '\\2', '{flags}')"
    return out


MARK_NAMES = "[" + ", ".join(q(s) for s in vocab.SKILLS) + "]"
cte("skill_marks", ["texts"], f"SELECT query_id, {_skill_marks()} AS marked FROM texts")
cte(
    "skill_hits",
    ["skill_marks"],
    """SELECT query_id, list_transform(regexp_extract_all(marked, '[\\x{E000}-\\x{E0FF}]'), lambda x: unicode(x) - 57343) AS hits FROM skill_marks""",
)
cte(
    "skill_lists",
    ["skill_hits"],
    f"SELECT query_id, list_transform({ordered_distinct('hits')}, lambda x: {MARK_NAMES}[x]) AS skills FROM skill_hits",
)


@query("detect_skills", with_ctes(f"SELECT query_id, {joined('skills')} AS skills FROM skill_lists", "skill_lists"))
def detect_skills(spark, sf):
    return texts(spark, sf).select("query_id", F.array_join(U.detect_skills(c("text")), "|").alias("skills"))


SKILL_TABLE = {f.lower(): s for s in vocab.SKILLS for f in [s, *vocab.SKILL_ALIASES.get(s, [])]}


@query(
    "canonicalise_skill",
    with_ctes(
        f"SELECT DISTINCT w AS word, {duck.case_of('lower(w)', SKILL_TABLE)} AS skill FROM (SELECT unnest(string_split(text, ' ')) AS w FROM texts) WHERE w <> ''",
        "texts",
    ),
)
def canonicalise_skill(spark, sf):
    words = texts(spark, sf).select(F.explode(F.split("text", " ")).alias("word")).where(c("word") != "").distinct()
    return words.select("word", U.canonicalise_skill(c("word")).alias("skill"))


def _place(expr: str) -> str:
    arms = " ".join(
        f"WHEN regexp_matches({expr}, '\\b({'|'.join(a)})\\b') THEN {q(p)}" for p, a in vocab.LOCATIONS.items()
    )
    return f"CASE {arms} END"


@query("detect_location", with_ctes(f"SELECT query_id, {_place('lower(text)')} AS location FROM texts", "texts"))
def detect_location(spark, sf):
    return texts(spark, sf).select("query_id", U.detect_location(c("text")).alias("location"))


@query(
    "canonicalise_location",
    with_ctes(
        f"""SELECT id, part, CASE WHEN lower(p) IN ('remote', 'anywhere') THEN NULL ELSE coalesce({_place('lower(p)')}, p) END AS place
        FROM (SELECT id, part, nullif({strip('p')}, '') AS p FROM (
          SELECT id, unnest([1, 2, 3, 4]) AS part, unnest([location, ' ' || split_part(location, ',', 2) || ' ', CASE WHEN remote THEN 'Remote' ELSE ' ' END, lower(title)]) AS p FROM listings))""",
        "listings",
    ),
)
def canonicalise_location(spark, sf):
    from hybridq.workload.tables import listing_facts

    part = lambda n, text: F.struct(F.lit(n).alias("part"), text.alias("p"))
    rows = listing_facts(spark, sf).select(
        "id",
        F.inline(
            F.array(
                part(1, c("location")),
                part(2, F.concat(F.lit(" "), F.split_part(c("location"), F.lit(","), F.lit(2)), F.lit(" "))),
                part(3, F.when(c("remote"), "Remote").otherwise(" ")),
                part(4, F.lower("title")),
            )
        ),
    )
    return rows.select("id", "part", U.canonicalise_location(c("p")).alias("place"))


def _words(expr, words, single=False):
    test = f"regexp_matches({expr}, '\\b({words})\\b')"
    return f"({test} AND NOT contains({expr}, chr(10)))" if single else test


REMOTE = f"CASE WHEN {_words(LOW, vocab.ONSITE_WORDS)} THEN false WHEN {_words(LOW, vocab.REMOTE_WORDS)} THEN true END"


@query("extract_remote", with_ctes(f"SELECT query_id, {REMOTE} AS remote FROM texts", "texts"))
def extract_remote(spark, sf):
    return lowered(spark, sf).select("query_id", U.extract_remote(c("low")).alias("remote"))


def re2(pattern: str) -> str:
    """A pattern of the vocabulary in RE2, which has no look-around: boundaries become `\\b` or a letter that isn't there."""
    return pattern.replace("(?![a-z])", "(?:[^a-z]|$)").replace(vocab.B_OPEN, r"\b").replace(vocab.B_SHUT, r"\b")


def _get(pattern, g=1):
    return f"nullif(regexp_extract({LOW}, {q(re2(pattern))}, {g}), '')"


cte(
    "pay",
    ["texts"],
    f"""SELECT query_id, CAST(floor(CAST(CASE WHEN s1 IS NOT NULL THEN s1 ELSE coalesce(lo, CASE WHEN hi IS NULL THEN bare END) END AS DOUBLE) * 100000 + 0.5) AS BIGINT) AS salary_min,
    CAST(floor(CAST(CASE WHEN s1 IS NOT NULL THEN s2 ELSE hi END AS DOUBLE) * 100000 + 0.5) AS BIGINT) AS salary_max
    FROM (SELECT query_id, {_get(vocab.SALARY_SPAN)} AS s1, {_get(vocab.SALARY_SPAN, 2)} AS s2, {_get(vocab.SALARY_LEAST)} AS lo, {_get(vocab.SALARY_MOST)} AS hi, {_get(vocab.SALARY_AMOUNT)} AS bare FROM texts)""",
)


@query("extract_salary", with_ctes("SELECT * FROM pay", "pay"))
def extract_salary(spark, sf):
    return lowered(spark, sf).select("query_id", U.extract_salary(c("low")).alias("s")).select("query_id", "s.*")


_exp = {
    "less": vocab.YEARS_LESS, "most": vocab.YEARS_MOST, "more": vocab.YEARS_MORE, "plus": vocab.YEARS_PLUS,
    "exact": vocab.YEARS_EXACT,
}
cte(
    "exp",
    ["texts"],
    f"""SELECT query_id, CASE WHEN a IS NOT NULL THEN a WHEN less IS NOT NULL OR most IS NOT NULL THEN NULL WHEN more IS NOT NULL THEN more
      WHEN plus IS NOT NULL THEN plus WHEN exact IS NOT NULL THEN exact WHEN fresh THEN 0 END AS experience_min,
    CASE WHEN a IS NOT NULL THEN b WHEN less IS NOT NULL THEN greatest(0, less - 1) WHEN most IS NOT NULL THEN most
      WHEN more IS NOT NULL OR plus IS NOT NULL THEN NULL WHEN exact IS NOT NULL THEN exact WHEN fresh THEN 1 END AS experience_max
    FROM (SELECT query_id, CAST({_get(vocab.YEARS_SPAN)} AS INTEGER) AS a, CAST({_get(vocab.YEARS_SPAN, 2)} AS INTEGER) AS b,
      {', '.join(f"CAST({_get(_exp[k])} AS INTEGER) AS {k}" for k in ('less', 'most', 'more', 'plus', 'exact'))},
      {_words(LOW, vocab.FRESHER_WORDS, True)} AS fresh FROM texts)""",
)


@query("extract_experience", with_ctes("SELECT * FROM exp", "exp"))
def extract_experience(spark, sf):
    return lowered(spark, sf).select("query_id", U.extract_experience(c("low")).alias("e")).select("query_id", "e.*")


EMPLOYMENT = "CASE " + " ".join(
    f"WHEN {_words(LOW, w, True)} THEN {q(k)}" for k, w in vocab.EMPLOYMENT_WORDS.items()
) + " END"


@query("extract_employment_type", with_ctes(f"SELECT query_id, {EMPLOYMENT} AS employment_type FROM texts", "texts"))
def extract_employment_type(spark, sf):
    return lowered(spark, sf).select("query_id", U.extract_employment_type(c("low")).alias("employment_type"))


_aliases = "|".join(a for v in vocab.LOCATIONS.values() for a in v)


def keywords_sql(text: str, skills: str, location: str) -> str:
    """Expression over columns; duplicates removed by first position."""
    topic = (
        f"list_filter({tokens(text)}, lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '[0-9]+') AND t NOT IN {in_list(vocab.NON_TOPIC)} "
        f"AND NOT regexp_matches(t, '\\b({_aliases})\\b') AND NOT list_contains(list_concat(flatten(list_transform({skills}, lambda s: {tokens('s')})), "
        f"CASE WHEN {location} IS NULL THEN []::VARCHAR[] ELSE {tokens(location)} END), t))"
    )
    return topic


cte(
    "keyword_lists",
    ["texts", "skill_lists"],
    f"""SELECT query_id, {ordered_distinct('k')} AS keywords FROM (
      SELECT query_id, {keywords_sql('text', 'skills', 'location')} AS k FROM
       (SELECT t.query_id, {strip('t.text')} AS text, s.skills, {_place('lower(t.text)')} AS location FROM texts t JOIN skill_lists s USING (query_id)))""",
)


@query("extract_keywords", with_ctes(f"SELECT query_id, {joined('keywords')} AS keywords FROM keyword_lists", "keyword_lists"))
def extract_keywords(spark, sf):
    t = texts(spark, sf)
    words = U.extract_keywords(c("text"), U.detect_skills(c("text")), U.detect_location(c("text")))
    return t.select("query_id", F.array_join(words, "|").alias("keywords"))


_ordinals = "|".join(vocab.ORDINALS)
_num_words = {k: v for k, v in vocab.NUMBER_WORDS.items()}
cte(
    "ordinal_lists",
    ["texts"],
    f"""SELECT query_id, CASE WHEN n IS NOT NULL THEN range(1, {duck.case_of('n', _num_words)} + 1) ELSE {ordered_distinct('o')} END AS ordinals FROM (
     SELECT query_id, {_get(vocab.FIRST_COUNT)} AS n,
      list_concat(list_transform(regexp_extract_all({LOW}, '\\b({_ordinals})\\b', 1), lambda w: CAST({duck.case_of('w', vocab.ORDINALS)} AS BIGINT)),
       CASE WHEN regexp_matches({LOW}, {q(re2(vocab.LAST_ITEM))}) AND NOT contains({LOW}, chr(10)) THEN [-1::BIGINT] ELSE []::BIGINT[] END) AS o FROM texts)""",
)


@query("extract_ordinals", with_ctes(f"SELECT query_id, {joined('ordinals')} AS ordinals FROM ordinal_lists", "ordinal_lists"))
def extract_ordinals(spark, sf):
    found = U.extract_ordinals(c("low")).cast("array<string>")
    return lowered(spark, sf).select("query_id", F.array_join(found, "|").alias("ordinals"))


IDS = f"list_transform(regexp_extract_all({LOW}, {q(re2(vocab.ITEM_IDS))}, 1), lambda x: CAST(x AS BIGINT))"


@query("extract_item_ids", with_ctes(f"SELECT query_id, {joined(IDS)} AS ids FROM texts", "texts"))
def extract_item_ids(spark, sf):
    found = U.extract_item_ids(c("low")).cast("array<string>")
    return lowered(spark, sf).select("query_id", F.array_join(found, "|").alias("ids"))


_b = r"\b"
_small = (
    f"list_transform(regexp_extract_all(regexp_replace(low, '\\b([1-5])({vocab.NUMBER_UNITS})', 'x\\2', 'g'), "
    f"'\\b{vocab.NUMBER_NOUNS}\\s*([1-5])\\b', 1), lambda x: CAST(x AS BIGINT))"
)
cte(
    "analysis",
    ["texts", "skill_lists", "keyword_lists", "pay", "exp", "ordinal_lists"],
    f"""SELECT *, CASE WHEN intent = 'COMPARE' AND len(ords) = 0 AND len(ids) = 0 THEN
       CASE WHEN len(list_distinct(small)) >= 2 THEN {ordered_distinct('small')} ELSE []::BIGINT[] END ELSE ords END AS ordinals FROM (
     SELECT *, {_small} AS small,
      CASE WHEN regexp_matches(low, {q(re2(vocab.COMPARE))}) THEN 'COMPARE'
       WHEN about AND asks AND NOT filters THEN 'JOB_QUESTION'
       WHEN has_previous AND narrows THEN 'REFINE'
       WHEN greets AND len(skills) = 0 AND NOT filters THEN 'GENERAL'
       WHEN len(skills) = 0 AND NOT filters AND NOT regexp_matches(low, '\\b({vocab.SEARCH_WORDS})') THEN 'GENERAL'
       ELSE 'NEW_SEARCH' END AS intent FROM (
      SELECT *, (location IS NOT NULL OR remote IS NOT NULL OR experience_min IS NOT NULL OR experience_max IS NOT NULL OR salary_min IS NOT NULL
         OR salary_max IS NOT NULL OR employment_type IS NOT NULL) AS filters,
       regexp_matches(low, {q(re2(vocab.ITEM_POINTED))})
         OR len(ids) > 0 OR (len(ords) > 0 AND regexp_matches(low, {q(re2(vocab.ITEM_NAMED))}) AND NOT contains(low, chr(10))) AS about,
       regexp_matches(low, '\\?|\\b({vocab.QUESTION_WORDS})') AS asks,
       regexp_matches(low, '^({vocab.REFINE_START})\\b|\\b({vocab.REFINE_ANYWHERE})\\b') AS narrows,
       regexp_matches(low, '^({vocab.GREETING_WORDS})\\b') AND NOT contains(low, chr(10)) AND len(string_split_regex(low, '\\s+')) <= 4 AS greets
      FROM (SELECT t.query_id, t.has_previous, {strip('t.text')} AS text, {LOW.replace('text', 't.text')} AS low, s.skills, k.keywords, {_place('lower(t.text)')} AS location,
        {REMOTE.replace('(text', '(t.text')} AS remote, e.experience_min, e.experience_max, p.salary_min, p.salary_max, {EMPLOYMENT.replace('(text', '(t.text')} AS employment_type,
        o.ordinals AS ords, {IDS.replace('(text', '(t.text')} AS ids
       FROM texts t JOIN skill_lists s USING (query_id) JOIN keyword_lists k USING (query_id) JOIN pay p USING (query_id)
        JOIN exp e USING (query_id) JOIN ordinal_lists o USING (query_id))))""",
)
ANALYSIS_COLS = (
    f"query_id, {joined('skills')} AS skills, {joined('keywords')} AS keywords, location, remote, experience_min, experience_max, salary_min, salary_max, "
    f"employment_type, intent, {joined('ordinals')} AS ordinals, {joined('ids')} AS job_ids"
)


def flat_criteria(prefix="criteria"):
    return [
        F.array_join(f"{prefix}.skills", "|").alias("skills"),
        F.array_join(f"{prefix}.keywords", "|").alias("keywords"),
        *[c(f"{prefix}.{n}").alias(n) for n in U.CRITERIA[2:]],
    ]


def flat_ints(name):
    return F.array_join(c(name).cast("array<string>"), "|").alias(name)


@query("classify_intent", with_ctes("SELECT query_id, intent FROM analysis", "analysis"))
def classify_intent(spark, sf):
    return U.parse_queries(texts(spark, sf)).select("query_id", "intent")


@query("parse_queries", with_ctes(f"SELECT {ANALYSIS_COLS}, text AS standalone_query, 'rules' AS source FROM analysis", "analysis"))
def parse_queries(spark, sf):
    p = U.parse_queries(texts(spark, sf))
    return p.select(
        "query_id", *flat_criteria(), "intent", flat_ints("ordinals"), flat_ints("job_ids"), "standalone_query", "source"
    )


# ---------------------------------------------------------------------------
# Model outputs: a JSON object in prose; some truncated, some odd
# ---------------------------------------------------------------------------
MODEL = """
SELECT query_id, text, has_previous, CASE WHEN k % 23 = 7 THEN 'I could not find criteria.'
 WHEN k % 19 = 6 THEN concat('Sure: {"intent":"NEW_SEARCH","skills":["Jav', text)
 ELSE concat('Here you go: ', '{"intent":"', split_part('new_search|REFINE|compare|GENERAL|job_question|UNSURE', '|', CAST(k % 6 AS INT) + 1),
 '","skills":[', split_part('"java","Cobol"|"k8s"||"React","js","FORTRAN ",5|null', '|', CAST(k % 5 AS INT) + 1),
 '],"keywords":[', split_part('"payments"||"cloud","logistics"|" ","ledger"', '|', CAST(k % 4 AS INT) + 1),
 '],"location":', split_part('"Bengaluru"|null|"remote"|"NATION_3"|" "|"null"|["Lyon"]|{"a":"Lyon"}', '|', CAST(k % 8 AS INT) + 1),
 ',"remote":', split_part('true|false|null|"yes"', '|', CAST(k % 4 AS INT) + 1),
 ',"experienceMin":', split_part('3|7|null|"4"|99|2.7', '|', CAST(k % 6 AS INT) + 1),
 ',"experienceMax":', split_part('5|null|2|"x"', '|', CAST(k % 4 AS INT) + 1),
 ',"salaryMin":', split_part('12|1200000|null|12.5|-3|"9"', '|', CAST(k % 6 AS INT) + 1),
 ',"salaryMax":', split_part('null|30|99999999999|2500000', '|', CAST(k % 4 AS INT) + 1),
 ',"employmentType":', split_part('"full-time"|"Contract"|null|"gig"|"part time"', '|', CAST(k % 5 AS INT) + 1),
 ',"ordinals":[', split_part('1,2||0,3,21|"4",5', '|', CAST(k % 4 AS INT) + 1),
 '],"jobIds":[', split_part('|101|-5,205,7', '|', CAST(k % 3 AS INT) + 1),
 '],"standaloneQuery":', split_part('null|"clean query"|"  "|["q"]|{"q":1}', '|', CAST(k % 5 AS INT) + 1),
 '}', ' Hope this helps') END AS raw
FROM (SELECT query_id, text, has_previous, query_id + 3 * (query_id % 11) AS k FROM requests) r
"""
cte("model_out", ["requests"], MODEL.replace("AS STRING", "AS VARCHAR"))


def model_out(spark, sf):
    return run_sql(spark, MODEL, requests=view(spark, sf, "requests"))


def _js(path):
    return f"json_extract(j, '$.{path}')"


def _jtext(path):
    return f"(CASE WHEN json_type(j, '$.{path}') IS NULL OR json_type(j, '$.{path}') IN ('NULL', 'ARRAY', 'OBJECT') OR lower({strip(_jstr(path))}) IN ('', 'null') THEN NULL ELSE {strip(_jstr(path))} END)"


def _jstr(path):
    return f"json_extract_string(j, '$.{path}')"


_isnum = "IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT')"


def _jint(path):
    v = (
        f"(CASE WHEN json_type(j, '$.{path}') {_isnum} THEN CAST(trunc(CAST({_jstr(path)} AS DOUBLE)) AS BIGINT) "
        f"WHEN json_type(j, '$.{path}') = 'VARCHAR' AND regexp_full_match({_jstr(path)}, '[0-9]+') THEN TRY_CAST({_jstr(path)} AS BIGINT) END)"
    )
    return f"(CASE WHEN {v} BETWEEN 0 AND 50 THEN CAST({v} AS INTEGER) END)"


def _jpay(path):
    v = f"TRY_CAST({_jstr(path)} AS DOUBLE)"
    r = f"CAST(floor(CASE WHEN {v} < 1000 THEN {v} * 100000 ELSE {v} END + 0.5) AS BIGINT)"
    return f"(CASE WHEN json_type(j, '$.{path}') {_isnum} AND {v} > 0 AND {r} <= 1000000000 THEN {r} END)"


def _jlist(path):
    elems = f"coalesce(CAST(json_extract(j, '$.{path}') AS JSON[]), []::JSON[])"
    texts_ = f"list_transform(list_filter({elems}, lambda x: json_type(x) = 'VARCHAR'), lambda x: {strip(chr(40) + 'x->>' + q('$') + chr(41))})"
    return f"list_filter({texts_}, lambda s: s <> '')"


def _jnums(path, test):
    elems = f"coalesce(CAST(json_extract(j, '$.{path}') AS JSON[]), []::JSON[])"
    nums = f"list_transform(list_filter({elems}, lambda x: json_type(x) {_isnum}), lambda x: CAST(x AS BIGINT))"
    return f"list_filter({nums}, lambda x: {test})"


_known = f"list_filter(list_transform(sk, lambda s: {duck.case_of('lower(s)', SKILL_TABLE)}), lambda s: s IS NOT NULL)"
_unknown = f"list_filter(sk, lambda s: {duck.case_of('lower(s)', SKILL_TABLE)} IS NULL)"
_code = f"replace(replace(upper({_jtext('employmentType')}), '-', '_'), ' ', '_')"
cte(
    "model_parsed",
    ["model_out"],
    f"""SELECT query_id, text, has_previous, error, CASE WHEN error IS NULL THEN {_known} END AS skills, CASE WHEN error IS NULL THEN list_concat({_unknown}, kw) END AS keywords,
     CASE WHEN error IS NULL AND lower(loc) NOT IN ('remote', 'anywhere') THEN coalesce({_place('lower(loc)')}, loc) END AS location,
     CASE WHEN error IS NULL THEN remote END AS remote, CASE WHEN lo > hi THEN hi ELSE lo END AS experience_min, CASE WHEN lo > hi THEN lo ELSE hi END AS experience_max,
     salary_min, salary_max, employment_type,
     CASE WHEN error IS NULL THEN CASE WHEN intent IN {in_list(vocab.INTENTS)} THEN intent ELSE 'NEW_SEARCH' END END AS intent,
     CASE WHEN error IS NULL THEN coalesce(standalone, text) END AS standalone_query, ordinals, job_ids FROM (
    SELECT query_id, text, has_previous, error, {_jlist('skills')} AS sk, {_jlist('keywords')} AS kw, {_jtext('location')} AS loc,
     CASE WHEN json_type(j, '$.remote') = 'BOOLEAN' THEN CAST(json_extract(j, '$.remote') AS BOOLEAN) END AS remote, {_jint('experienceMin')} AS lo, {_jint('experienceMax')} AS hi,
     {_jpay('salaryMin')} AS salary_min, {_jpay('salaryMax')} AS salary_max, CASE WHEN {_code} IN {in_list(vocab.EMPLOYMENT_LABELS)} THEN {_code} END AS employment_type,
     upper({strip(_jstr('intent'))}) AS intent, {_jtext('standaloneQuery')} AS standalone, {_jnums('ordinals', 'x BETWEEN 1 AND 20')} AS ordinals, {_jnums('jobIds', 'x > 0')} AS job_ids
    FROM (SELECT *, CASE WHEN json_valid(b) THEN CAST(b AS JSON) END AS j,
      CASE WHEN b = '' THEN 'no JSON object in LLM output' WHEN NOT json_valid(b) THEN 'unparseable JSON from LLM' END AS error
     FROM (SELECT *, regexp_extract(raw, '(?s)\\{{.*\\}}', 0) AS b FROM model_out)))""",
)


@query(
    "parse_model_json",
    with_ctes(
        f"""SELECT query_id, error, {joined('skills')} AS skills, {joined('keywords')} AS keywords, location, remote, experience_min, experience_max, salary_min, salary_max,
        employment_type, intent, standalone_query, {joined('ordinals')} AS ordinals, {joined('job_ids')} AS job_ids FROM model_parsed""",
        "model_parsed",
    ),
)
def parse_model_json(spark, sf):
    p = U.parse_model_json(model_out(spark, sf))
    return p.select(
        "query_id", "error",
        F.coalesce(F.array_join("criteria.skills", "|"), F.lit("")).alias("skills"),
        F.coalesce(F.array_join("criteria.keywords", "|"), F.lit("")).alias("keywords"),
        *[c(f"criteria.{n}").alias(n) for n in U.CRITERIA[2:]],
        "intent", "standalone_query",
        F.coalesce(flat_ints("ordinals"), F.lit("")).alias("ordinals"),
        F.coalesce(flat_ints("job_ids"), F.lit("")).alias("job_ids"),
    )


cte(
    "model_merge",
    ["model_parsed", "analysis"],
    f"""SELECT m.query_id, m.has_previous, m.error, m.intent AS mi, r.intent AS ri, m.standalone_query AS ms, r.text AS rs,
     CASE WHEN len(m.ordinals) > 0 AND m.error IS NULL THEN m.ordinals ELSE r.ordinals END AS ordinals,
     CASE WHEN len(m.job_ids) > 0 AND m.error IS NULL THEN m.job_ids ELSE r.ids END AS job_ids,
     CASE WHEN m.error IS NULL THEN list_concat(m.skills, list_filter(r.skills, lambda s: NOT list_contains(m.skills, s))) ELSE r.skills END AS sk0,
     CASE WHEN m.error IS NULL THEN array_to_string(CASE WHEN len(m.keywords) > 0 THEN m.keywords ELSE r.keywords END, ' ') END AS kw0, r.keywords AS rk,
     coalesce(m.location, r.location) AS location, coalesce(m.remote, r.remote) AS remote,
     CASE WHEN m.experience_min IS NOT NULL OR m.experience_max IS NOT NULL THEN m.experience_min ELSE r.experience_min END AS experience_min,
     CASE WHEN m.experience_min IS NOT NULL OR m.experience_max IS NOT NULL THEN m.experience_max ELSE r.experience_max END AS experience_max,
     coalesce(m.salary_min, r.salary_min) AS salary_min, coalesce(m.salary_max, r.salary_max) AS salary_max, coalesce(m.employment_type, r.employment_type) AS employment_type
    FROM model_parsed m JOIN analysis r ON r.query_id = m.query_id * 10""",
)
cte(
    "model_merged",
    ["model_merge"],
    f"""SELECT *, {ordered_distinct('sk0')} AS skills, CASE WHEN error IS NULL THEN {ordered_distinct('kc')} ELSE rk END AS keywords
     FROM (SELECT *, {keywords_sql('kw0', 'sk0', 'location')} AS kc FROM model_merge)""",
)


@query(
    "merge_model_and_rules",
    with_ctes(
        f"""SELECT query_id, {joined('skills')} AS skills, {joined('keywords')} AS keywords, location, remote, experience_min, experience_max, salary_min, salary_max, employment_type,
        CASE WHEN error IS NOT NULL THEN ri WHEN ri = 'COMPARE' THEN 'COMPARE' WHEN mi = 'REFINE' AND NOT has_previous THEN 'NEW_SEARCH'
          WHEN mi = 'GENERAL' AND (len(skills) > 0 OR len(keywords) > 0) AND ri <> 'GENERAL' THEN 'NEW_SEARCH' ELSE mi END AS intent,
        CASE WHEN error IS NULL THEN ms ELSE rs END AS standalone_query, {joined('ordinals')} AS ordinals, {joined('job_ids')} AS job_ids,
        CASE WHEN error IS NULL THEN 'llm+rules' ELSE 'rules' END AS source,
        CASE WHEN error IS NOT NULL THEN 'LLM extraction output invalid (' || error || '): used rule-based extraction' END AS note FROM model_merged""",
        "model_merged",
    ),
)
def merge_model_and_rules(spark, sf):
    model = U.parse_model_json(model_out(spark, sf))
    rules = U.parse_queries(view(spark, sf, "requests"))
    m = U.merge_model_and_rules(model, rules)
    return m.select(
        "query_id", *flat_criteria(), "intent", "standalone_query", flat_ints("ordinals"), flat_ints("job_ids"), "source", "note"
    )


# ---------------------------------------------------------------------------
# Criteria operators
# ---------------------------------------------------------------------------
@query(
    "validate_criteria",
    with_ctes(
        """SELECT query_id, concat_ws('|', CASE WHEN length(repeat(location, 12)) > 100 THEN 'location: longer than 100' END,
        CASE WHEN experience_min * 7 > 50 THEN 'experience_min: outside 0..50' END, CASE WHEN experience_max - 3 < 0 THEN 'experience_max: outside 0..50' END,
        CASE WHEN salary_min * 500 > 1000000000 THEN 'salary_min: outside 0..1000000000' END) AS violations FROM query_log""",
        "query_log",
    ),
)
def validate_criteria(spark, sf):
    k = c("criteria")
    stretched = U.criteria_struct(
        skills=k["skills"], keywords=k["keywords"], location=F.repeat(k["location"], F.lit(12)), remote=k["remote"],
        experience_min=k["experience_min"] * 7, experience_max=k["experience_max"] - 3, salary_min=k["salary_min"] * 500,
    )
    rows = query_log(spark, sf).select("query_id", stretched.alias("s"))
    return rows.select("query_id", F.array_join(U.validate_criteria(c("s")), "|").alias("violations"))


@query(
    "merge_criteria",
    with_ctes(
        f"""SELECT a.query_id, {joined(ordered_distinct('list_concat(a.skills, b.skills)'))} AS skills, {joined(ordered_distinct('list_concat(a.keywords, b.keywords)'))} AS keywords,
        coalesce(b.location, a.location) AS location, coalesce(b.remote, a.remote) AS remote,
        CASE WHEN b.experience_min IS NOT NULL OR b.experience_max IS NOT NULL THEN b.experience_min ELSE a.experience_min END AS experience_min,
        CASE WHEN b.experience_min IS NOT NULL OR b.experience_max IS NOT NULL THEN b.experience_max ELSE a.experience_max END AS experience_max,
        coalesce(b.salary_min, a.salary_min) AS salary_min, coalesce(b.salary_max, a.salary_max) AS salary_max, coalesce(b.employment_type, a.employment_type) AS employment_type
        FROM analysis a JOIN analysis b ON b.query_id = a.query_id + 10""",
        "analysis",
    ),
)
def merge_criteria(spark, sf):
    p = U.parse_queries(texts(spark, sf)).select("query_id", "criteria")
    nxt = p.select((c("query_id") - 10).alias("query_id"), c("criteria").alias("override"))
    both = p.join(nxt, "query_id")
    return both.select("query_id", U.merge_criteria(c("criteria"), c("override")).alias("criteria")).select(
        "query_id", *flat_criteria()
    )


@query(
    "criteria_flags",
    with_ctes(
        "SELECT query_id, len(skills) = 0 AND len(keywords) = 0 AND NOT filters AS is_empty, filters AS has_structured_filters, len(skills) > 0 OR len(keywords) > 0 AS has_topic FROM analysis",
        "analysis",
    ),
)
def criteria_flags(spark, sf):
    p = U.parse_queries(texts(spark, sf))
    return p.select("query_id", U.criteria_flags(c("criteria")).alias("f")).select("query_id", "f.*")


CALLS = """
SELECT query_id, CASE WHEN k % 13 = 4 THEN ' ' ELSE concat('{"query":', CASE WHEN k % 5 = 0 THEN 'null' ELSE concat('"', text, '"') END,
 ',"skills":[', split_part('"golang","Perl"||"react"', '|', CAST(k % 3 AS INT) + 1),
 '],"experience_years":', split_part('null|3|"4"|"many"', '|', CAST(k % 4 AS INT) + 1),
 ',"max_required_experience":', split_part('6|null|" 8 "', '|', CAST(k % 3 AS INT) + 1),
 ',"min_salary_lpa":', split_part('null|12.5|"7"|0', '|', CAST(k % 4 AS INT) + 1),
 ',"remote":', split_part('true|false|null', '|', CAST(k % 3 AS INT) + 1),
 ',"location":', split_part('"Gurugram"|"anywhere"|null|"NATION_4"', '|', CAST(k % 4 AS INT) + 1),
 ',"employment_type":', split_part('"part-time"|null|"temp"', '|', CAST(k % 3 AS INT) + 1), '}') END AS arguments
FROM (SELECT query_id, text, query_id + query_id % 7 * 5 AS k FROM requests) r
"""
cte("calls", ["requests"], CALLS)


def calls(spark, sf):
    return run_sql(spark, CALLS, requests=view(spark, sf, "requests"))


def _cint(path):
    return (
        f"(CASE WHEN json_type(j, '$.{path}') {_isnum} THEN CAST(trunc(CAST({_jstr(path)} AS DOUBLE)) AS INTEGER) "
        f"WHEN json_type(j, '$.{path}') = 'VARCHAR' AND regexp_full_match(trim({_jstr(path)}), '[0-9]+') THEN CAST(trim({_jstr(path)}) AS INTEGER) END)"
    )


_ccode = f"replace(replace(upper({_jtext('employment_type')}), '-', '_'), ' ', '_')"
cte(
    "call_args",
    ["calls"],
    f"""SELECT query_id, query, {_known} AS skills, {_unknown} AS keywords, CASE WHEN lower(loc) NOT IN ('remote', 'anywhere') THEN coalesce({_place('lower(loc)')}, loc) END AS location,
     remote, yrs AS experience_min, coalesce(yrs, mx) AS experience_max, CASE WHEN lpa > 0 THEN CAST(floor(lpa * 100000 + 0.5) AS BIGINT) END AS salary_min, employment_type FROM (
     SELECT query_id, {_jtext('query')} AS query, {_jlist('skills')} AS sk, {_jtext('location')} AS loc,
      CASE WHEN {_jstr('remote')} = 'true' THEN true END AS remote, {_cint('experience_years')} AS yrs, {_cint('max_required_experience')} AS mx,
      CASE WHEN json_type(j, '$.min_salary_lpa') <> 'NULL' THEN TRY_CAST({_jstr('min_salary_lpa')} AS DOUBLE) END AS lpa,
      CASE WHEN {_ccode} IN {in_list(vocab.EMPLOYMENT_LABELS)} THEN {_ccode} END AS employment_type
     FROM (SELECT query_id, CAST(CASE WHEN {strip('arguments')} = '' THEN '{{}}' ELSE arguments END AS JSON) AS j FROM calls))""",
)


@query(
    "criteria_from_tool_args",
    with_ctes(
        f"""SELECT a.query_id, a.query, {joined(ordered_distinct('CASE WHEN a.query IS NULL THEN a.skills ELSE list_concat(r.skills, a.skills) END'))} AS skills,
        {joined(ordered_distinct('CASE WHEN a.query IS NULL THEN a.keywords ELSE list_concat(r.keywords, a.keywords) END'))} AS keywords,
        coalesce(a.location, CASE WHEN a.query IS NOT NULL THEN r.location END) AS location, coalesce(a.remote, CASE WHEN a.query IS NOT NULL THEN r.remote END) AS remote,
        CASE WHEN a.query IS NULL OR a.experience_min IS NOT NULL OR a.experience_max IS NOT NULL THEN a.experience_min ELSE r.experience_min END AS experience_min,
        CASE WHEN a.query IS NULL OR a.experience_min IS NOT NULL OR a.experience_max IS NOT NULL THEN a.experience_max ELSE r.experience_max END AS experience_max,
        coalesce(a.salary_min, CASE WHEN a.query IS NOT NULL THEN r.salary_min END) AS salary_min, CASE WHEN a.query IS NOT NULL THEN r.salary_max END AS salary_max,
        coalesce(a.employment_type, CASE WHEN a.query IS NOT NULL THEN r.employment_type END) AS employment_type
        FROM call_args a JOIN analysis r ON r.query_id = a.query_id * 10""",
        "call_args",
        "analysis",
    ),
)
def criteria_from_tool_args(spark, sf):
    return U.criteria_from_tool_args(calls(spark, sf)).select("query_id", "query", *flat_criteria())


@query(
    "criteria_from_filters",
    with_ctes(
        """SELECT query_id, CASE WHEN remote THEN true END AS remote, location, experience_min, experience_max, nullif(salary_min - 500000, 0) AS salary_min, employment_type FROM query_log""",
        "query_log",
    ),
)
def criteria_from_filters(spark, sf):
    f = view(spark, sf, "query_log").withColumn("salary_min", c("salary_min") - 500_000).select(
        "query_id", F.struct("remote", "location", "salary_min", "experience_min", "experience_max", "employment_type").alias("f")
    )
    cr = f.select("query_id", U.criteria_from_filters(c("f")).alias("k"))
    return cr.select("query_id", *[c(f"k.{n}").alias(n) for n in ("remote", "location", "experience_min", "experience_max", "salary_min", "employment_type")])


def describe_sql(skills="skills", keywords="keywords", p="") -> str:
    lo, hi = f"{p}experience_min", f"{p}experience_max"
    return f"""concat_ws(' · ', CASE WHEN len({skills}) > 0 THEN array_to_string({skills}, ', ') WHEN len({keywords}) > 0 THEN array_to_string({keywords}, ', ') END,
    CASE WHEN {p}remote THEN 'remote' WHEN NOT {p}remote THEN 'on-site' END, {p}location, '≥ ₹' || {duck.lakhs(p + 'salary_min')} || ' LPA', '≤ ₹' || {duck.lakhs(p + 'salary_max')} || ' LPA',
    CASE WHEN {lo} = {hi} THEN {lo} || ' yrs experience' WHEN {lo} IS NOT NULL AND {hi} IS NOT NULL THEN {lo} || '-' || {hi} || ' yrs experience'
     WHEN {hi} IS NOT NULL THEN '≤ ' || {hi} || ' yrs experience' WHEN {lo} IS NOT NULL THEN {lo} || '+ yrs experience' END,
    CASE WHEN {p}employment_type IS NOT NULL THEN {duck.label(p + 'employment_type')} END)"""


@query("describe_criteria", with_ctes(f"SELECT query_id, {describe_sql()} AS description FROM analysis", "analysis"))
def describe(spark, sf):
    p = U.parse_queries(texts(spark, sf))
    return p.select("query_id", U.describe_criteria(c("criteria")).alias("description"))


@query(
    "semantic_query",
    with_ctes(
        f"""SELECT a.query_id, CASE WHEN a.intent = 'REFINE' AND nullif(b.text, '') IS NOT NULL THEN b.text || '. ' || a.text
        ELSE coalesce(nullif(CASE WHEN a.has_previous THEN a.text END, ''), {joined('a.skills', ' ')}) END AS semantic
        FROM analysis a LEFT JOIN analysis b ON b.query_id = a.query_id - 10""",
        "analysis",
    ),
)
def semantic_query(spark, sf):
    p = U.parse_queries(texts(spark, sf)).select("query_id", "criteria", "intent", "standalone_query", "has_previous")
    before = p.select((c("query_id") + 10).alias("query_id"), c("standalone_query").alias("previous"))
    both = p.join(before, "query_id", "left")
    refine = c("intent") == "REFINE"
    text = F.when(c("has_previous") | refine, c("standalone_query"))
    return both.select(
        "query_id", U.semantic_query(text, c("criteria.skills"), refine, c("previous")).alias("semantic")
    )
