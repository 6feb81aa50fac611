"""Queries of lookups, cards, saved items and comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from hybridq.operators import catalog as C
from hybridq.plans.stages import stage_path
from hybridq.sources.page_store import page_read, pages_write
from hybridq.workload import duck
from hybridq.workload.duck import cte, joined, ordered_distinct, with_ctes
from hybridq.workload.registry import query
from hybridq.workload.tables import listing_facts, listings, run_sql, view

c = F.col


def flat(name):
    return F.coalesce(F.array_join(c(name).cast("array<string>"), "|"), F.lit("")).alias(name)


@query(
    "page_listings",
    with_ctes(
        """SELECT id, title, total_rows, CAST(ceil(total_rows / 400.0) AS BIGINT) AS total_pages FROM (SELECT id, title, posted_date, count(*) OVER () AS total_rows FROM listings)
        ORDER BY posted_date DESC NULLS LAST, id LIMIT 400 OFFSET 1200""",
        "listings",
    ),
)
def page_listings(spark, sf):
    return C.page_listings(listings(spark, sf), 3, 400).select("id", "title", "total_rows", "total_pages")


@query(
    "page_directory",
    with_ctes(
        """SELECT id, title, total_rows, CAST(ceil(total_rows / 75.0) AS BIGINT) AS total_pages, page FROM (
          SELECT *, (row_number() OVER (ORDER BY posted_date DESC NULLS LAST, id) - 1) // 75 AS page, count(*) OVER () AS total_rows FROM listings)
        WHERE page IN (0, 2, 7, 20)""",
        "listings",
    ),
)
def page_directory(spark, sf):
    """Pages from the start, the middle and behind the last one, through a directory of small ranges."""
    path = stage_path(spark, "pages")
    pages_write(listings(spark, sf), path, range_rows=100)
    cols = ["id", "title", "total_rows", "total_pages"]
    found = [page_read(spark, path, n, 75).select(*cols, F.lit(n).cast("bigint").alias("page")) for n in (0, 2, 7, 20)]
    return reduce(DataFrame.unionByName, found)


@query(
    "page_after",
    with_ctes(
        """SELECT id, title FROM listings WHERE posted_date IS NULL OR posted_date < DATE '2024-02-10' OR (posted_date = DATE '2024-02-10' AND id > 900)
        ORDER BY posted_date DESC NULLS LAST, id LIMIT 25""",
        "listings",
    ),
)
def page_after(spark, sf):
    return C.page_after(listings(spark, sf), "2024-02-10", 900, 25).select("id", "title")


# ids asked for per order: its parts, one repeated, plus an id past the end of the catalogue
IDS = """
SELECT l_orderkey AS request_id, CAST(l_partkey AS BIGINT) AS id, l_linenumber * 10 + l_suppkey % 10 AS pos FROM lineitem
UNION ALL SELECT o_orderkey, 1000000000 + o_orderkey, 25 FROM orders
"""
cte(
    "asked_ids", ["lineitem", "orders"],
    f"""SELECT request_id, {ordered_distinct('ids')} AS ids FROM (SELECT request_id, list(id ORDER BY pos, id) AS ids FROM ({IDS}) GROUP BY request_id)""",
)
cte("asked_pos", ["asked_ids"], "SELECT request_id, unnest(ids) AS id, CAST(generate_subscripts(ids, 1) - 1 AS INTEGER) AS pos FROM asked_ids")


def requests(spark, sf):
    rows = run_sql(spark, IDS, lineitem=view(spark, sf, "lineitem"), orders=view(spark, sf, "orders"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "id")))
    return rows.groupBy("request_id").agg(F.transform(ordered, lambda x: x.id).alias("ids"))


@query(
    "lookup_strict",
    with_ctes(
        "SELECT a.request_id, a.pos, a.id, l.title, CASE WHEN l.id IS NULL THEN 'unknown id ' || a.id END AS error FROM asked_pos a LEFT JOIN listings l USING (id)",
        "asked_pos", "listings",
    ),
)
def lookup_strict(spark, sf):
    return C.lookup_strict(requests(spark, sf), listing_facts(spark, sf)).select("request_id", "pos", "id", "title", "error")


@query("lookup_ordered", with_ctes("SELECT a.request_id, a.pos, a.id, l.title FROM asked_pos a JOIN listings l USING (id)", "asked_pos", "listings"))
def lookup_ordered(spark, sf):
    return C.lookup_ordered(requests(spark, sf), listing_facts(spark, sf)).select("request_id", "pos", "id", "title")


_card = f"""id, title, company, location, remote, employment_type, {duck.label('employment_type')} AS employment_label, {duck.years()} AS experience, {duck.salary()} AS salary,
 array_to_string(skills, '|') AS skills, CAST(posted_date AS VARCHAR) AS posted_date"""
CARD = ["id", "title", "company", "location", "remote", "employment_type", "employment_label", "experience", "salary"]


@query("listing_card", with_ctes(f"SELECT {_card} FROM listings", "listings"))
def listing_card(spark, sf):
    return C.listing_card(listing_facts(spark, sf)).select(*CARD, flat("skills"), "posted_date")


@query(
    "listing_detail",
    with_ctes(
        f"SELECT {_card}, description, array_to_string(requirements, '|') AS requirements, array_to_string(responsibilities, '|') AS responsibilities, array_to_string(benefits, '|') AS benefits, application_url FROM listings",
        "listings",
    ),
)
def listing_detail(spark, sf):
    return C.listing_detail(listings(spark, sf)).select(
        *CARD, flat("skills"), "posted_date", "description", flat("requirements"), flat("responsibilities"), flat("benefits"), "application_url"
    )


@query(
    "saved_items",
    with_ctes(
        """SELECT s.id, min(s.ts) AS saved_at FROM save_events s LEFT JOIN (SELECT id, max((ts, event_id)) AS gone FROM save_events WHERE action = 'unsave' GROUP BY id) u USING (id)
        WHERE s.action = 'save' AND (u.gone IS NULL OR (s.ts, s.event_id) > u.gone) AND s.id IN (SELECT p_partkey FROM part) GROUP BY s.id""",
        "save_events",
    ),
)
def saved_items(spark, sf):
    return C.saved_items(view(spark, sf, "save_events"), listings(spark, sf))


# sets to compare: three neighbours per customer; some too small, some with an unknown member
SETS = """
SELECT c_custkey AS set_id, c_custkey AS a, CASE WHEN c_custkey % 11 = 4 THEN c_custkey ELSE c_custkey + 1 END AS b,
 CASE WHEN c_custkey % 11 = 4 THEN c_custkey WHEN c_custkey % 13 = 6 THEN c_custkey + 1000000000 ELSE c_custkey + 7 END AS d FROM customer
"""
cte("sets", ["customer"], f"SELECT set_id, {ordered_distinct('raw')} AS ids FROM (SELECT set_id, [a, b, d] AS raw FROM ({SETS}))")
cte(
    "members", ["sets", "listings"],
    """SELECT s.set_id, m.pos, l.* FROM (SELECT set_id, len(ids) AS n, unnest(ids) AS id, CAST(generate_subscripts(ids, 1) - 1 AS INTEGER) AS pos FROM sets WHERE len(ids) BETWEEN 2 AND 4) m
    JOIN sets s USING (set_id) JOIN listings l ON l.id = m.id QUALIFY count(*) OVER (PARTITION BY s.set_id) = m.n""",
)


def sets(spark, sf):
    return run_sql(spark, SETS, customer=view(spark, sf, "customer")).select("set_id", F.array("a", "b", "d").alias("ids"))


_values = [
    ("Title", "title"), ("Company", "company"), ("Location", "location"), ("Remote", "CASE WHEN remote THEN 'Yes' ELSE 'No' END"),
    ("Experience", duck.years()), ("Salary", duck.salary()), ("Skills", "array_to_string(skills, ', ')"),
    ("Employment", duck.label("employment_type")), ("Posted", "coalesce(CAST(posted_date AS VARCHAR), 'null')"), ("Benefits", "array_to_string(benefits, ', ')"),
]


@query(
    "compare_matrix",
    with_ctes(
        f"""SELECT set_id, line, label, array_to_string(list(v ORDER BY pos), '|') AS values FROM (
        SELECT set_id, pos, unnest([{', '.join(str(i) for i in range(10))}]) AS line, unnest([{', '.join(duck.q(n) for n, _ in _values)}]) AS label, unnest([{', '.join(e for _, e in _values)}]) AS v FROM members)
        GROUP BY set_id, line, label""",
        "members",
    ),
)
def compare_matrix(spark, sf):
    return C.compare_matrix(sets(spark, sf), listings(spark, sf)).select("set_id", "line", "label", flat("values"))


@query(
    "compare_errors",
    with_ctes(
        """SELECT set_id, CASE WHEN len(ids) NOT BETWEEN 2 AND 4 THEN 'provide 2 to 4 different job ids' ELSE 'unknown id ' || list_filter(ids, lambda x: x >= n)[1] END AS error
        FROM sets, (SELECT count(*) AS n FROM part) WHERE len(ids) NOT BETWEEN 2 AND 4 OR len(list_filter(ids, lambda x: x >= n)) > 0""",
        "sets",
    ),
)
def compare_errors(spark, sf):
    return C.compare_errors(sets(spark, sf), listings(spark, sf))


cte(
    "facts", ["members"],
    f"""SELECT set_id, arg_max(id, salary_max * 10 - pos) AS top_salary_id, arg_min(id, experience_min * 10 + pos) AS lowest_experience_id, list(id ORDER BY pos) FILTER (remote) AS remote_ids,
      arg_max(title || ', ' || {duck.salary()}, salary_max * 10 - pos) AS top_text, arg_min({duck.years()}, experience_min * 10 + pos) AS entry_text, list(skills ORDER BY pos) AS sk, list(id ORDER BY pos) AS ids
    FROM members GROUP BY set_id""",
)
_common = "list_filter(sk[1], lambda s: len(list_filter(sk, lambda o: list_contains(o, s))) = len(sk))"
_unique = "list_filter(list_transform(ids, lambda i, n: struct_pack(id := i, own := list_filter(sk[n], lambda s: len(list_filter(sk, lambda o: list_contains(o, s))) = 1))), lambda u: len(u.own) > 0)"


@query(
    "compare_facts",
    with_ctes(
        f"""SELECT set_id, top_salary_id, lowest_experience_id, {joined('remote_ids')} AS remote_ids, {joined(ordered_distinct(_common))} AS common_skills,
        {joined(f"list_transform({_unique}, lambda u: u.id || ':' || array_to_string(u.own, ','))")} AS unique_skills,
        array_to_string(list_concat(['- Highest salary ceiling: Job #' || top_salary_id || ' (' || top_text || ').', '- Lowest experience requirement: Job #' || lowest_experience_id || ' (' || entry_text || ').',
         '- Remote: ' || coalesce(array_to_string(list_transform(remote_ids, lambda i: 'Job #' || i), ', '), 'none of these roles') || '.',
         '- Skills in common: ' || CASE WHEN len({_common}) = 0 THEN 'none' ELSE array_to_string({ordered_distinct(_common)}, ', ') END || '.'],
         list_transform({_unique}, lambda u: '- Only Job #' || u.id || ' lists: ' || array_to_string(u.own, ', ') || '.')), chr(10)) AS summary FROM facts""",
        "facts",
    ),
)
def compare_facts(spark, sf):
    out = C.compare_facts(sets(spark, sf), listings(spark, sf))
    unique = F.transform("unique_skills", lambda u: F.concat(u.id.cast("string"), F.lit(":"), F.array_join(u.skills, ",")))
    return out.select(
        "set_id", "top_salary_id", "lowest_experience_id", flat("remote_ids"), flat("common_skills"),
        F.array_join(unique, "|").alias("unique_skills"), "summary",
    )


# what a turn may refer to: ids and ordinals parsed from requests, the order's parts as shown list
TURNS = """
SELECT query_id, CASE WHEN query_id % 3 = 0 THEN 1 WHEN query_id % 7 = 2 THEN 2 ELSE 0 END AS explicit, query_id % 5 AS o,
 query_id % 4 = 1 AS chosen, CASE WHEN query_id % 6 = 1 THEN query_id + 3 END AS focus_id, CASE WHEN query_id % 4 = 2 THEN query_id + 4 END AS stored_focus_id,
 query_id % 9 <> 0 AS seen FROM requests
"""
cte(
    "turn_refs", ["requests", "lineitem"],
    f"""SELECT t.query_id, CASE explicit WHEN 1 THEN [t.query_id + 1000000000, t.query_id, t.query_id + 2] WHEN 2 THEN [t.query_id + 5] ELSE []::BIGINT[] END AS job_ids,
     CASE o WHEN 0 THEN []::INTEGER[] WHEN 1 THEN [1, 2] WHEN 2 THEN [-1] WHEN 3 THEN [2, 2, 9] ELSE [3, 1, -1] END AS ordinals,
     CASE WHEN chosen THEN [t.query_id + 6, t.query_id + 7] END AS selected_ids, focus_id, stored_focus_id, CASE WHEN seen THEN coalesce(s.ids, []::BIGINT[]) ELSE []::BIGINT[] END AS shown_ids
    FROM ({TURNS}) t LEFT JOIN (SELECT l_orderkey, list(DISTINCT l_partkey ORDER BY l_partkey) AS ids FROM lineitem GROUP BY 1) s ON s.l_orderkey = t.query_id""",
)


def turns(spark, sf):
    t = run_sql(spark, TURNS, requests=view(spark, sf, "requests"))
    shown = view(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("query_id")).agg(
        F.array_sort(F.collect_set(c("l_partkey").cast("bigint"))).alias("ids")
    )
    none = F.array().cast("array<bigint>")
    k = c("query_id")
    ints = lambda *v: F.array(*[F.lit(x) for x in v])
    return t.join(shown, "query_id", "left").select(
        "query_id",
        F.when(c("explicit") == 1, F.array(k + 1_000_000_000, k, k + 2)).when(c("explicit") == 2, F.array(k + 5)).otherwise(none).alias("job_ids"),
        F.when(c("o") == 0, F.array().cast("array<int>")).when(c("o") == 1, ints(1, 2)).when(c("o") == 2, ints(-1))
        .when(c("o") == 3, ints(2, 2, 9)).otherwise(ints(3, 1, -1)).alias("ordinals"),
        F.when(c("chosen"), F.array(k + 6, k + 7)).alias("selected_ids"),
        "focus_id", "stored_focus_id",
        F.when(c("seen"), F.coalesce("ids", none)).otherwise(none).alias("shown_ids"),
    )


_mapped = "list_filter(list_transform(ordinals, lambda o: CASE WHEN o = -1 THEN shown_ids[len(shown_ids)] WHEN o >= 1 THEN shown_ids[o] END), lambda x: x IS NOT NULL)"
cte(
    "resolved", ["turn_refs", "part"],
    f"""SELECT *, {ordered_distinct(_mapped)} AS mapped, list_filter(job_ids, lambda x: x < n) AS known, list_filter(coalesce(selected_ids, []::BIGINT[]), lambda x: x < n) AS picked
    FROM turn_refs, (SELECT count(*) AS n FROM part)""",
)


@query("map_ordinals", with_ctes(f"SELECT query_id, {joined('mapped')} AS ids FROM resolved", "resolved"))
def map_ordinals(spark, sf):
    ids = C.map_ordinals(c("ordinals"), c("shown_ids")).cast("array<string>")
    return turns(spark, sf).select("query_id", F.array_join(ids, "|").alias("ids"))


@query(
    "resolve_compare_ids",
    with_ctes(
        f"""SELECT query_id, {joined("CASE WHEN len(known) >= 2 THEN known WHEN len(mapped) >= 2 THEN mapped WHEN len(picked) >= 2 THEN picked ELSE shown_ids END")} AS ids FROM resolved""",
        "resolved",
    ),
)
def resolve_compare(spark, sf):
    return C.resolve_compare_ids(turns(spark, sf), listings(spark, sf)).select("query_id", flat("ids"))


@query(
    "resolve_target",
    with_ctes("SELECT query_id, coalesce(known[1], mapped[1], focus_id, stored_focus_id, shown_ids[1]) AS id FROM resolved", "resolved"),
)
def resolve_target(spark, sf):
    return C.resolve_target(turns(spark, sf), listings(spark, sf))
