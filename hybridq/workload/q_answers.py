"""Queries of grounding, answers and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from hybridq.operators import catalog as C
from hybridq.operators import grounding as G
from hybridq.operators import traces as T
from hybridq.plans import search as P
from hybridq.workload import duck
from hybridq.workload.duck import cte, half_up, joined, ordered_distinct, with_ctes
from hybridq.workload.q_catalog import sets
from hybridq.workload.q_conversations import attached
from hybridq.workload.q_search import explain_sql
from hybridq.workload.q_understanding import describe_sql
from hybridq.workload.registry import query
from hybridq.workload.tables import listing_index, listings, query_log, run_sql, staged, view

c = F.col

# answers: one per order, naming its parts and sometimes one that was never retrieved
ANSWERS = """
SELECT o_orderkey AS query_id, concat('Job #', CAST(o_orderkey % 900 AS STRING), ' and job id ', CAST(o_orderkey % 450 + 7 AS STRING), ' beat JOB  #',
 CAST(o_custkey AS STRING), '; also #', CAST(o_orderkey % 900 AS STRING), ' but not job 5', CASE WHEN o_orderkey % 4 = 3 THEN ' or #987654' ELSE '' END, '.') AS answer FROM orders
"""
cte("answers", ["orders"], ANSWERS.replace("AS STRING", "AS VARCHAR"))
cte(
    "allowed", ["orders"],
    "SELECT o_orderkey AS query_id, unnest([o_orderkey % 900, o_orderkey % 450 + 7, o_custkey]) AS id FROM orders",
)


def refs(n):
    return ordered_distinct(
        f"list_transform(regexp_extract_all(answer, '(?i)(?:#|\\bjob\\s+(?:id\\s*)?#?)\\s*(\\d{{{n},}})', 1), lambda x: CAST(x AS BIGINT))"
    )


def answers(spark, sf):
    return run_sql(spark, ANSWERS, orders=view(spark, sf, "orders"))


@query("referenced_ids", with_ctes(f"SELECT query_id, {joined(refs(2))} AS two, {joined(refs(3))} AS three FROM answers", "answers"))
def referenced(spark, sf):
    ids = lambda n: F.array_join(G.referenced_ids(c("answer"), n).cast("array<string>"), "|")
    return answers(spark, sf).select("query_id", ids(2).alias("two"), ids(3).alias("three"))


@query(
    "grounding_audit",
    with_ctes(
        f"""SELECT query_id, len(stray) = 0 AS accepted, {joined('stray')} AS unknown_ids,
        CASE WHEN len(stray) > 0 THEN 'Grounding guard: LLM referenced job(s) [' || array_to_string(stray, ', ') || '] that are not in the retrieved context; answer discarded' END AS note
        FROM (SELECT a.query_id, list_filter({refs(2)}, lambda x: NOT list_contains(coalesce(k.ids, []::BIGINT[]), x)) AS stray FROM answers a
          LEFT JOIN (SELECT query_id, list(id) AS ids FROM allowed GROUP BY query_id) k USING (query_id))""",
        "answers", "allowed",
    ),
)
def audit(spark, sf):
    o = view(spark, sf, "orders")
    k = c("o_orderkey")
    allowed = o.select(k.alias("query_id"), F.explode(F.array(k % 900, k % 450 + 7, c("o_custkey"))).alias("id"))
    out = G.grounding_audit(answers(spark, sf), allowed)
    return out.select("query_id", "accepted", F.array_join(c("unknown_ids").cast("array<string>"), "|").alias("unknown_ids"), "note")


FACTS = f"""'[JOB #' || l.id || ']' || chr(10) || 'Title: ' || l.title || chr(10) || 'Company: ' || l.company || chr(10) || 'Location: ' || l.location || chr(10) || 'Remote: ' ||
 CASE WHEN l.remote THEN 'Yes' ELSE 'No' END || chr(10) || 'Employment type: ' || {duck.label('l.employment_type')} || chr(10) || 'Experience required: ' || {duck.years('l.')} || chr(10) ||
 'Salary: ' || {duck.salary('l.')} || chr(10) || 'Skills: ' || array_to_string(l.skills, ', ') || chr(10) || 'Posted: ' || coalesce(CAST(l.posted_date AS VARCHAR), 'null') || chr(10)"""
_strip = "CASE WHEN part_text LIKE 'Job: %' AND contains(part_text, chr(10)) THEN substr(part_text, instr(part_text, chr(10)) + 1) ELSE part_text END"
cte(
    "hit_lines", ["hs_h", "listing_chunks"],
    f"""SELECT query_id, id, string_agg('  (' || section || ', similarity ' || printf('%.2f', score) || ') ' || replace(body, chr(10), chr(10) || '    ') || chr(10), '' ORDER BY hrank) AS lines FROM (
      SELECT h.query_id, h.id, h.section, h.score, h.hrank, {_strip} AS body, h.hrank AS n FROM hs_h h JOIN listing_chunks k ON k.document_id = h.document_id)
     GROUP BY 1, 2""",
)
_r, _g = explain_sql("h.semantic_norm", "coalesce(h.sections, []::VARCHAR[])")
_score = half_up("h.score", 9)
cte(
    "shown", ["hs", "ql", "listings"],
    f"""SELECT h.query_id, h.id, h.rank, h.total_matches, h.dropped, {_score} AS score, {_r} AS reasons, {_g} AS gaps, {describe_sql('q.skills', 'q.keywords', 'q.')} AS summary
     FROM hs h JOIN ql q ON q.query_id = h.query_id JOIN listings l ON l.id = h.id WHERE h.rank <= 5""",
)


def shown(spark, sf):
    """The five best listings of every logged query, with all listing fields."""

    def build():
        rows = listings(spark, sf)
        found = P.hybrid_search(query_log(spark, sf), rows, listing_index(spark, sf))
        own = [n for n in found.columns if n not in rows.columns or n == "id"]
        return found.select(*own).join(rows, "id")

    return staged(spark, sf, "shown", build)


def with_texts(df, index):
    """Chunk structs (document_id, section, score) completed with their text."""
    each = df.select("query_id", "id", F.posexplode("chunks").alias("at", "ch")).select(
        "query_id", "id", "at", "ch.section", "ch.score", c("ch.document_id").alias("document_id")
    )
    full = each.join(index.select("document_id", "text"), "document_id")
    packed = full.groupBy("query_id", "id").agg(
        F.sort_array(F.collect_list(F.struct("at", "section", "score", "text"))).alias("chunks")
    )
    return df.drop("chunks").join(packed, ["query_id", "id"], "left")


@query(
    "build_context",
    with_ctes(
        f"""SELECT query_id, 'JOB CONTEXT (ranked by relevance, best first):' || chr(10) || chr(10) || string_agg(block, '' ORDER BY rank) || 'SEARCH SUMMARY: criteria applied by the search engine: ' ||
          CASE WHEN any_value(summary) = '' THEN 'none' ELSE any_value(summary) END || '. ' || any_value(total_matches) || ' job(s) matched in total; ' || count(*) || ' shown above.' ||
          CASE WHEN len(any_value(dropped)) > 0 THEN ' No job matched every filter, so these filters were relaxed: ' || array_to_string(any_value(dropped), ', ') || '.' ELSE '' END AS context
        FROM (SELECT s.*, {FACTS} || 'Match assessment (computed by the search engine, relative): ' || CAST(floor(s.score * 100 + 0.5) AS INTEGER) || '% - ' ||
           CASE WHEN s.score >= 0.75 THEN 'Strong match' WHEN s.score >= 0.5 THEN 'Good match' ELSE 'Partial match' END || chr(10) ||
           CASE WHEN len(reasons) > 0 THEN 'Why it matches: ' || array_to_string(reasons, '; ') || chr(10) ELSE '' END || CASE WHEN len(gaps) > 0 THEN 'Gaps: ' || array_to_string(gaps, '; ') || chr(10) ELSE '' END ||
           coalesce('Retrieved excerpts:' || chr(10) || x.lines, '') || chr(10) AS block
          FROM shown s JOIN listings l ON l.id = s.id LEFT JOIN hit_lines x ON x.query_id = s.query_id AND x.id = s.id) GROUP BY query_id""",
        "shown", "hit_lines",
    ),
)
def build_context(spark, sf):
    rows = with_texts(shown(spark, sf), listing_index(spark, sf))
    rows = rows.withColumn("score", F.floor(c("score") * 1e9 + F.lit(0.5)) / F.lit(1e9))
    return G.build_context(rows)


_asked = describe_sql("q.skills", "q.keywords", "q.")


@query(
    "answer_search",
    with_ctes(
        f"""SELECT q.query_id, coalesce(a.answer, 'I couldn''t find any jobs in the knowledge base matching your request' ||
          CASE WHEN {_asked} <> '' THEN ' (' || {_asked} || ')' ELSE '' END || '. Try removing a filter, widening the salary or experience range, or searching for a related skill.') AS answer
        FROM ql q LEFT JOIN (SELECT query_id, regexp_replace(CASE WHEN len(any_value(dropped)) > 0 THEN 'No job matched all of your filters, so I relaxed: ' || array_to_string(any_value(dropped), ', ') || '. Here are the closest matches'
          ELSE 'I found ' || any_value(total_matches) || CASE WHEN any_value(total_matches) = 1 THEN ' job' ELSE ' jobs' END || ' matching your request' END ||
          CASE WHEN any_value(summary) <> '' THEN ' (' || any_value(summary) || ')' ELSE '' END || CASE WHEN any_value(total_matches) > count(*) THEN '. Top ' || count(*) || ':' ELSE ':' END || chr(10) || chr(10) ||
          string_agg(s.rank || '. **' || l.title || '** - ' || l.company || ' (Job #' || l.id || ')' || chr(10) || '   ' || l.location || CASE WHEN l.remote THEN ' · Remote' ELSE '' END || ' · ' || {duck.salary('l.')} || ' · ' ||
            {duck.years('l.')} || chr(10) || CASE WHEN len(reasons) > 0 THEN '   Why: ' || array_to_string(reasons, '; ') || chr(10) ELSE '' END, '' ORDER BY s.rank), '[\\x00-\\x20]+$', '') AS answer
        FROM shown s JOIN listings l USING (id) GROUP BY query_id) a ON a.query_id = q.query_id""",
        "shown", "ql", "listings",
    ),
)
def answer_search(spark, sf):
    return G.answer_search(shown(spark, sf), query_log(spark, sf))


# questions about single listings: the request texts, each about the listing with its number
QUESTIONS = """
SELECT query_id, query_id AS id, concat(text, ' ', split_part('which skills?|requirements please|duties|perks and pay|years needed|where is the office|apply link|hello', '|', CAST(query_id % 8 AS INT) + 1)) AS question FROM requests
"""
cte("questions", ["requests"], QUESTIONS)


def questions(spark, sf):
    return run_sql(spark, QUESTIONS, requests=view(spark, sf, "requests"))


def _asks(words):
    return "(" + " OR ".join(f"contains(lower(question), {duck.q(w)})" for w in words) + ")"


_ref = "'Job #' || l.id || ' (' || l.title || ' at ' || l.company || ')'"
_plain = lambda n: duck.bullets(f"l.{n}", "- Not specified in the listing")
_skills_asked = _asks(["skill", "tech", "stack"])
_parts = [
    (_skills_asked, f"{_ref} || ' lists these skills: ' || array_to_string(l.skills, ', ') || '.'"),
    (_asks(["require", "qualif", "eligib"]), f"'Requirements:' || chr(10) || {_plain('requirements')}"),
    (_asks(["responsib", "duties", "day to day", "role involve"]), f"'Responsibilities:' || chr(10) || {_plain('responsibilities')}"),
    (_asks(["benefit", "perk", "insurance"]), f"'Benefits:' || chr(10) || {_plain('benefits')}"),
    (_asks(["salary", "pay", "ctc", "compensation"]), f"'Salary: ' || {duck.salary('l.')} || '.'"),
    (_asks(["experience", "years"]), f"'Experience required: ' || {duck.years('l.')} || '.'"),
    (_asks(["remote", "location", "where", "office"]), "'Location: ' || l.location || CASE WHEN l.remote THEN ' (remote-friendly).' ELSE ' (not remote).' END"),
    (_asks(["apply", "link", "url"]), "'Application link: ' || l.application_url"),
]
_list = f"list_filter([{', '.join(f'CASE WHEN {t} THEN {e} END' for t, e in _parts)}], lambda x: x IS NOT NULL)"


@query(
    "answer_item",
    with_ctes(
        f"""SELECT q.query_id, array_to_string(CASE WHEN len({_list}) = 0 THEN [{_ref} || ': ' || l.description, 'Key facts: ' || l.location || CASE WHEN l.remote THEN ' (remote)' ELSE '' END || ', ' || {duck.salary('l.')} || ', ' ||
          {duck.years('l.')} || ', skills: ' || array_to_string(l.skills, ', ') || '.'] WHEN {_skills_asked} THEN {_list} ELSE list_concat(['Here is what the listing for ' || {_ref} || ' says:'], {_list}) END, chr(10) || chr(10)) AS answer
        FROM questions q JOIN listings l USING (id)""",
        "questions", "listings",
    ),
)
def answer_item(spark, sf):
    return G.answer_item(questions(spark, sf).join(listings(spark, sf), "id"))


@query(
    "build_item_context",
    with_ctes(
        f"""SELECT h.query_id, h.id, 'JOB CONTEXT:' || chr(10) || chr(10) || {FACTS} || 'Description: ' || l.description || chr(10) || coalesce('Retrieved excerpts:' || chr(10) || x.lines, '') AS context
        FROM shown h JOIN listings l USING (id) LEFT JOIN hit_lines x ON x.query_id = h.query_id AND x.id = h.id""",
        "shown", "hit_lines",
    ),
)
def item_context(spark, sf):
    return G.build_item_context(with_texts(shown(spark, sf), listing_index(spark, sf)))


@query(
    "build_comparison_context",
    with_ctes(
        f"SELECT l.set_id, 'JOB CONTEXT:' || chr(10) || chr(10) || string_agg({FACTS} || 'Benefits: ' || array_to_string(l.benefits, '; ') || chr(10) || chr(10), '' ORDER BY l.pos) AS context FROM members l GROUP BY l.set_id",
        "members",
    ),
)
def comparison_context(spark, sf):
    return G.build_comparison_context(C._members(sets(spark, sf), listings(spark, sf)))


cte(
    "shown_lines", ["attached", "listings"],
    f"""SELECT message_id, list('Job #' || l.id || ' ' || l.title || ' - ' || l.company || ' (' || l.location || CASE WHEN l.remote THEN ', remote' ELSE '' END || ', ' || {duck.salary('l.')} || ')' ORDER BY a.pos) AS lines
     FROM (SELECT message_id, unnest(job_ids) AS id, generate_subscripts(job_ids, 1) AS pos FROM attached) a JOIN listings l USING (id) GROUP BY message_id""",
)


@query(
    "state_block",
    with_ctes(
        f"""SELECT a.message_id AS query_id, 'CONVERSATION STATE:' || chr(10) || CASE WHEN len(a.job_ids) = 0 THEN '- No jobs have been shown yet.' || chr(10) ELSE '- Last search: ' || coalesce({describe_sql('q.skills', 'q.keywords', 'q.')}, '') || chr(10) ||
          '- Jobs shown to the user (in order):' || chr(10) || coalesce(array_to_string(list_transform(s.lines, lambda t, i: '  ' || i || '. ' || t || chr(10)), ''), '') END ||
          CASE WHEN a.turn = 3 THEN '- The user is currently asking about Job #' || a.conv_id || ' ("this job" refers to it).' || chr(10) ELSE '' END ||
          CASE WHEN q.location IS NOT NULL THEN '- Filters selected in the UI (applied automatically to searches): ' || q.location || chr(10) ELSE '' END AS block
        FROM attached a LEFT JOIN ql q ON q.query_id = a.conv_id LEFT JOIN shown_lines s USING (message_id)""",
        "shown_lines", "ql",
    ),
)
def state_block(spark, sf):
    from hybridq.operators.understanding import criteria_struct

    m = attached(spark, sf).select(
        c("message_id").alias("query_id"), "conv_id", c("job_ids").alias("shown_ids"),
        F.when(c("turn") == 3, c("conv_id")).alias("focus_id"),
    )
    k = query_log(spark, sf).select(c("query_id").alias("conv_id"), "criteria")
    s = m.join(k, "conv_id", "left").withColumn("filters", criteria_struct(location=c("criteria.location")))
    return G.state_block(s, listings(spark, sf))


@query("extraction_prompt")
def extraction_prompt(spark, sf):
    from hybridq.operators.conversations import recent_history

    m = attached(spark, sf)
    h = recent_history(m).select(c("message_id").alias("query_id"), "history", "text")
    states = m.select(c("message_id").alias("query_id"), c("conv_id"), c("job_ids").alias("shown_ids"))
    k = query_log(spark, sf).select(c("query_id").alias("conv_id"), "criteria")
    return G.extraction_prompt(h.join(states.join(k, "conv_id", "left"), "query_id"), listings(spark, sf))


# ---------------------------------------------------------------------------
# Traces
# ---------------------------------------------------------------------------
TRACES = "SELECT event_id AS trace_id, ts AS happened, event_type AS intent, value AS duration, event_type <> 'error' AS ok FROM events"


def traces(spark, sf):
    return run_sql(spark, TRACES + " ", events=view(spark, sf, "events")).withColumnRenamed("happened", "at")


@query("recent_traces", f"SELECT trace_id, intent FROM ({TRACES}) ORDER BY happened DESC, trace_id DESC LIMIT 80")
def recent_traces(spark, sf):
    return T.recent_traces(traces(spark, sf), 80).select("trace_id", "intent")


@query("find_trace", f"SELECT trace_id, intent, ok FROM ({TRACES}) WHERE trace_id = 77")
def find_trace(spark, sf):
    return T.find_trace(traces(spark, sf), 77).select("trace_id", "intent", "ok")


CALL_LOG = """
SELECT event_id, split_part('search_jobs|get_job_details|compare_jobs|other', '|', CAST(event_id % 4 AS INT) + 1) AS name,
 CASE event_type WHEN 'error' THEN concat('{"error":"', repeat(props, 12), '"}') ELSE '{"ok":1}' END AS result, CAST(value AS INT) AS total, user_id % 5 AS shown, user_id AS focus_id FROM events
"""
cte("call_log", ["events"], CALL_LOG)


@query(
    "tool_call_log",
    with_ctes(
        """SELECT event_id, name, NOT starts_with(result, '{"error"') AS ok, CASE WHEN starts_with(result, '{"error"') THEN 'error: ' || CASE WHEN length(result) > 120 THEN left(result, 120) || '...' ELSE result END
        WHEN name = 'search_jobs' THEN total || ' match(es), showing ' || shown WHEN name = 'get_job_details' THEN 'loaded Job #' || focus_id WHEN name = 'compare_jobs' THEN 'compared ' || shown || ' jobs' ELSE 'done' END AS summary
        FROM (SELECT * REPLACE (CAST(floor(total2) AS INTEGER) AS total) FROM (SELECT c.*, e.value AS total2 FROM call_log c JOIN events e USING (event_id)))""",
        "call_log",
    ),
)
def tool_calls(spark, sf):
    rows = run_sql(spark, CALL_LOG, events=view(spark, sf, "events"))
    return T.tool_call_log(rows).select("event_id", "name", "ok", "summary")


_metrics = f"""SELECT strftime(time_bucket(INTERVAL 5 MINUTE, happened), '%Y-%m-%d %H:%M:%S') AS window_start, intent, count(*) AS turns,
 {half_up('avg(CASE WHEN ok THEN 0.0 ELSE 1.0 END)', 6)} AS error_share, {half_up('avg(duration)', 6)} AS mean_duration FROM ({TRACES}) GROUP BY ALL"""


def flat_metrics(df):
    six = lambda n: (F.floor(c(n) * 1e6 + F.lit(0.5)) / F.lit(1e6)).alias(n)
    return df.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "intent", "turns", six("error_share"), six("mean_duration")
    )


@query("trace_metrics", _metrics)
def trace_metrics(spark, sf):
    return flat_metrics(T.trace_metrics(traces(spark, sf)))


@query(
    "trace_rows",
    with_ctes(
        f"""SELECT q.query_id, CASE WHEN len(q.skills) > 0 OR len(q.keywords) > 0 THEN 'vector' ELSE 'none' END AS mode, coalesce(n.n, 0) AS candidate_count, coalesce(h.r, '') AS retrieved, coalesce(s.s, '') AS selected
        FROM ql q LEFT JOIN (SELECT x.query_id, count(*) AS n FROM hs_r_l x JOIN hs_r r USING (query_id) WHERE x.lv <= r.level GROUP BY 1) n USING (query_id)
        LEFT JOIN (SELECT query_id, string_agg(document_id, '|' ORDER BY hrank) AS r FROM hs_h GROUP BY 1) h USING (query_id)
        LEFT JOIN (SELECT query_id, string_agg(id, '|' ORDER BY rank) AS s FROM hs WHERE rank <= 5 GROUP BY 1) s USING (query_id)""",
        "hs", "ql",
    ),
)
def trace_rows(spark, sf):
    from hybridq.operators.understanding import has_topic
    from hybridq.plans.stages import materialise

    rows, index = listings(spark, sf), listing_index(spark, sf)
    relaxed = materialise(P.relax_filters(query_log(spark, sf), rows), "relaxed")
    hits = P.search_hits(relaxed, rows, index).join(index.select("document_id", "text"), "document_id")
    counted = relaxed.select("query_id", F.when(c("level").isNotNull(), c("candidates")).otherwise(0).alias("candidate_count"))
    q = relaxed.select(
        "query_id", "text", "criteria", F.when(has_topic(c("criteria")), "vector").otherwise("none").alias("mode"),
        F.lit(None).cast("string").alias("note"),
    )
    t = T.trace_rows(q, hits, shown(spark, sf), counted)
    ids = lambda name, field: F.coalesce(
        F.array_join(F.transform(name, lambda x: x[field].cast("string")), "|"), F.lit("")
    ).alias(name)
    return t.select("query_id", "mode", "candidate_count", ids("retrieved", "document_id"), ids("selected", "job_id"))


