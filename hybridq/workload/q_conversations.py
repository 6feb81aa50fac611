"""Queries of the conversation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hybridq.operators import conversations as V
from hybridq.workload import duck
from hybridq.workload.duck import cte, joined, ordered_distinct, with_ctes
from hybridq.workload.registry import query
from hybridq.workload.tables import listings, run_sql, view

c = F.col


def messages(spark, sf):
    return view(spark, sf, "messages")


def at(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


cte("placed", ["messages"], "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY message_id) AS position FROM messages")


@query("conversation_history", with_ctes("SELECT conv_id, position, message_id, role, text FROM placed", "placed"))
def history(spark, sf):
    return V.conversation_history(messages(spark, sf)).select("conv_id", "position", "message_id", "role", "text")


cte(
    "windows", ["placed"],
    """SELECT message_id, conv_id, list(lower(role)) OVER w AS roles, list(text) OVER w AS said FROM placed
    WINDOW w AS (PARTITION BY conv_id ORDER BY position ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)""",
)


@query(
    "recent_history",
    with_ctes(
        f"""SELECT message_id, {joined("list_transform(roles, lambda r, i: r || ': ' || said[i])")} AS history FROM windows""",
        "windows",
    ),
)
def recent(spark, sf):
    lines = F.transform("history", lambda e: F.concat(e.role, F.lit(": "), e.content))
    return V.recent_history(messages(spark, sf)).select("message_id", F.array_join(lines, "|").alias("history"))


_users = "list_filter(said, lambda t, i: roles[i] = 'user')"


@query(
    "recent_user_turns",
    with_ctes(f"SELECT message_id, conv_id, {joined(f'list_slice({_users}, greatest(1, len({_users}) - 3), len({_users}))')} AS turns FROM windows", "windows"),
)
def user_turns(spark, sf):
    """The last two, because conversations here are short."""
    out = V.recent_user_turns(messages(spark, sf), 8)
    return out.select("message_id", "conv_id", F.array_join("turns", "|").alias("turns"))


@query("message_counts", with_ctes("SELECT conv_id, count(*) AS messages FROM messages GROUP BY conv_id", "messages"))
def counts(spark, sf):
    return V.message_counts(messages(spark, sf))


def title(expr: str) -> str:
    line = f"regexp_replace(regexp_replace(coalesce({expr}, ''), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')"
    return f"CASE WHEN {line} = '' THEN 'New chat' WHEN length({line}) > 60 THEN regexp_replace(left({line}, 57), '^\\s+|\\s+$', '', 'g') || '...' ELSE {line} END"


@query("title_from_text", with_ctes(f"SELECT message_id, {title('text')} AS title FROM messages", "messages"))
def titles(spark, sf):
    return messages(spark, sf).select("message_id", V.title_from_text(c("text")).alias("title"))


# renames typed by users: the event's property text, blank for clicks
RENAMES = """
SELECT event_id % ((SELECT max(conv_id) FROM conversations) + 3) AS conv_id, event_id AS happened,
 CASE event_type WHEN 'click' THEN '  ' ELSE concat('Renamed  by ', event_type, ' ', props) END AS title FROM events
"""
cte("renames", ["events", "conversations"], RENAMES)
cte(
    "summaries", ["messages"],
    f"""SELECT conv_id, CASE WHEN bool_or(role = 'USER') THEN {title("arg_min(text, message_id) FILTER (role = 'USER')")} ELSE 'New chat' END AS title,
      min(ts) AS created_at, max(ts) AS updated_at, count(*) AS messages FROM messages GROUP BY conv_id""",
)
cte(
    "named", ["summaries", "renames"],
    f"""SELECT s.* REPLACE (CASE WHEN r.title IS NULL THEN s.title ELSE {title('r.title')} END AS title) FROM summaries s
      LEFT JOIN (SELECT conv_id, arg_max(title, happened) AS title FROM renames WHERE trim(title) <> '' GROUP BY conv_id) r USING (conv_id)""",
)
_times = "strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at"


@query("conversation_summary", with_ctes(f"SELECT conv_id, title, {_times}, messages FROM summaries", "summaries"))
def summary(spark, sf):
    return V.conversation_summary(messages(spark, sf)).select("conv_id", "title", at("created_at"), at("updated_at"), "messages")


def renames(spark, sf):
    rows = run_sql(spark, RENAMES, events=view(spark, sf, "events"), conversations=view(spark, sf, "conversations"))
    return rows.withColumnRenamed("happened", "at")


@query("rename_conversations", with_ctes("SELECT conv_id, title FROM named", "named"))
def renamed(spark, sf):
    return V.conversation_summary(messages(spark, sf), renames(spark, sf)).select("conv_id", "title")


# conversations to delete: numbered like a supplier
@query(
    "delete_conversations",
    with_ctes("SELECT message_id, conv_id FROM messages WHERE conv_id NOT IN (SELECT n_nationkey FROM nation)", "messages"),
)
def deleted(spark, sf):
    ids = view(spark, sf, "nation").select(c("n_nationkey").cast("bigint").alias("conv_id"))
    return V.delete_conversations(messages(spark, sf), ids).select("message_id", "conv_id")


# cuts: from the downward ratings; the conversation they name is sometimes the wrong one
CUTS = "SELECT message_id, CASE WHEN event_id % 5 = 1 THEN 0 ELSE (message_id - message_id % 1000) // 1000 END AS conv_id FROM ratings WHERE rating = 'down'"
cte("cuts", ["ratings"], CUTS)


@query(
    "truncate_from",
    with_ctes(
        """SELECT m.message_id, m.conv_id FROM messages m LEFT JOIN (SELECT c.conv_id, min(c.message_id) AS cut FROM cuts c JOIN messages x ON x.message_id = c.message_id AND x.conv_id = c.conv_id GROUP BY 1) k USING (conv_id)
        WHERE k.cut IS NULL OR m.message_id < k.cut""",
        "cuts", "messages",
    ),
)
def truncated(spark, sf):
    cuts = run_sql(spark, CUTS.replace("//", "DIV"), ratings=view(spark, sf, "ratings"))
    return V.truncate_from(messages(spark, sf), cuts).select("message_id", "conv_id")


@query(
    "pop_last_user_turn",
    with_ctes(
        """WITH_LAST SELECT 'popped' AS part, conv_id, max(message_id) AS message_id, arg_max(text, message_id) AS text FROM messages WHERE role = 'USER' GROUP BY conv_id
        UNION ALL SELECT 'kept', m.conv_id, m.message_id, m.text FROM messages m LEFT JOIN (SELECT conv_id, max(message_id) AS cut FROM messages WHERE role = 'USER' GROUP BY 1) k USING (conv_id)
        WHERE k.cut IS NULL OR m.message_id < k.cut""".replace("WITH_LAST ", ""),
        "messages",
    ),
)
def popped(spark, sf):
    kept, gone = V.pop_last_user_turn(messages(spark, sf))
    row = lambda df, tag: df.select(F.lit(tag).alias("part"), "conv_id", "message_id", "text")
    return row(gone, "popped").unionByName(row(kept, "kept"))


@query(
    "apply_feedback",
    with_ctes(
        """SELECT m.message_id, r.feedback FROM messages m LEFT JOIN (SELECT message_id, rating AS feedback FROM ratings WHERE rating IS NULL OR rating IN ('up', 'down')
          QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY ts DESC, event_id DESC) = 1) r USING (message_id)""",
        "ratings", "messages",
    ),
)
def feedback(spark, sf):
    return V.apply_feedback(messages(spark, sf), view(spark, sf, "ratings")).select("message_id", "feedback")


@query(
    "rejected_feedback",
    with_ctes(
        """SELECT event_id, 'rating must be "up", "down" or null' AS error FROM ratings WHERE rating = 'sideways' UNION ALL
        SELECT event_id, 'unknown message' FROM ratings WHERE (rating IS NULL OR rating <> 'sideways') AND message_id NOT IN (SELECT message_id FROM messages)""",
        "ratings", "messages",
    ),
)
def rejected(spark, sf):
    return V.rejected_feedback(messages(spark, sf), view(spark, sf, "ratings"))


# search events: each user message searches, refines (sometimes finding nothing) or asks about one item
STATE = """
SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 1 THEN 'focus' WHEN 4 THEN 'refine' WHEN 3 THEN 'refine' ELSE 'search' END AS kind,
 concat('{"t":', CAST(turn AS STRING), '}') AS criteria, text AS query, conv_id * 3 + turn AS base, (conv_id + turn) % 6 = 3 AS nothing
FROM messages
"""
cte("state_events", ["messages"], STATE.replace("AS STRING", "AS VARCHAR"))
cte(
    "states", ["state_events"],
    """SELECT e.conv_id, s.criteria, s.query, CASE WHEN s.base IS NOT NULL THEN [s.base, s.base + 1, s.base + 2] END AS candidate_ids,
      CASE WHEN s.base IS NOT NULL THEN [s.base, s.base + 1] END AS shown_ids, CASE WHEN f.turn > coalesce(s.turn, -1) THEN f.base END AS focus_id
    FROM (SELECT DISTINCT conv_id FROM state_events) e
    LEFT JOIN (SELECT * FROM state_events WHERE kind = 'search' OR (kind = 'refine' AND NOT nothing) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1) s USING (conv_id)
    LEFT JOIN (SELECT * FROM state_events WHERE kind = 'focus' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1) f USING (conv_id)""",
)


def state_events(spark, sf):
    e = run_sql(spark, STATE, messages=messages(spark, sf))
    b, none = c("base"), F.array().cast("array<bigint>")
    return e.select(
        "conv_id", "turn", "kind", "criteria", "query",
        F.when(c("nothing"), none).otherwise(F.array(b, b + 1, b + 2)).alias("candidate_ids"),
        F.when(c("nothing"), none).otherwise(F.array(b, b + 1)).alias("shown_ids"),
        b.alias("focus_id"),
    )


def flat(name):
    return F.coalesce(F.array_join(c(name).cast("array<string>"), "|"), F.lit("")).alias(name)


_state_cols = f"conv_id, criteria, query, {joined('candidate_ids')} AS candidate_ids, {joined('shown_ids')} AS shown_ids, focus_id"


@query("fold_search_state", with_ctes(f"SELECT {_state_cols} FROM states", "states"))
def fold(spark, sf):
    return V.fold_search_state(state_events(spark, sf)).select(
        "conv_id", "criteria", "query", flat("candidate_ids"), flat("shown_ids"), "focus_id"
    )


@query(
    "known_ids",
    with_ctes(
        f"""SELECT conv_id, {joined(ordered_distinct('every'))} AS ids FROM (SELECT s.conv_id, list_concat(coalesce(candidate_ids, []::BIGINT[]), coalesce(shown_ids, []::BIGINT[]),
          CASE WHEN focus_id IS NULL THEN []::BIGINT[] ELSE [focus_id] END, coalesce(r.ids, []::BIGINT[])) AS every
        FROM states s LEFT JOIN (SELECT n_nationkey AS conv_id, [n_nationkey + 2, 900] AS ids FROM nation) r ON r.conv_id = s.conv_id)""",
        "states",
    ),
)
def known(spark, sf):
    returned = view(spark, sf, "nation").select(
        c("n_nationkey").cast("bigint").alias("conv_id"),
        F.array((c("n_nationkey") + 2).cast("bigint"), F.lit(900).cast("bigint")).alias("ids"),
    )
    return V.known_ids(V.fold_search_state(state_events(spark, sf)), returned).select("conv_id", flat("ids"))


_now = "TIMESTAMP '2024-01-30 12:00:00'"


def bucket(expr):
    day = "TIMESTAMP '2024-01-30 00:00:00'"
    return f"""CASE WHEN {expr} >= {day} THEN 'Today' WHEN {expr} >= {day} - INTERVAL 1 DAY THEN 'Yesterday' WHEN {expr} >= {day} - INTERVAL 7 DAY THEN 'Previous 7 days'
     WHEN {expr} >= {day} - INTERVAL 30 DAY THEN 'Previous 30 days' ELSE 'Older' END"""


@query(
    "recency_bucket",
    f"""SELECT user_id, 'last' AS which, {bucket('max(ts)')} AS bucket FROM events GROUP BY user_id UNION ALL SELECT user_id, 'first', {bucket('min(ts)')} FROM events GROUP BY user_id
    UNION ALL SELECT event_id, 'event', {bucket('ts')} FROM events""",
)
def recency(spark, sf):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    e = view(spark, sf, "events")
    u = e.groupBy("user_id").agg(F.max("ts").alias("last"), F.min("ts").alias("first"))
    row = lambda df, key, tag, t: df.select(
        c(key).alias("user_id"), F.lit(tag).alias("which"), V.recency_bucket(c(t), now).alias("bucket")
    )
    return row(u, "user_id", "last", "last").unionByName(row(u, "user_id", "first", "first")).unionByName(
        row(e, "event_id", "event", "ts")
    )


@query(
    "search_titles",
    with_ctes(
        f"""SELECT conv_id, title, bucket, CAST(CASE bucket WHEN 'Today' THEN 1 WHEN 'Yesterday' THEN 2 WHEN 'Previous 7 days' THEN 3 WHEN 'Previous 30 days' THEN 4 ELSE 5 END AS INTEGER) AS bucket_rank
        FROM (SELECT conv_id, title, {bucket("updated_at + INTERVAL 20 DAY")} AS bucket FROM summaries WHERE contains(lower(title), 'der'))""",
        "summaries",
    ),
)
def search_titles(spark, sf):
    s = V.conversation_summary(messages(spark, sf))
    s = s.withColumn("updated_at", c("updated_at") + F.expr("INTERVAL 20 DAYS"))
    out = V.search_titles(s, " DER ", F.lit("2024-01-30 12:00:00").cast("timestamp"))
    return out.select("conv_id", "title", "bucket", "bucket_rank")


# listings attached to assistant messages; some do not exist
cte(
    "attached", ["messages", "part"],
    "SELECT *, CASE WHEN role = 'ASSISTANT' THEN [message_id % 1000, conv_id, conv_id + 1000000000, conv_id] ELSE []::BIGINT[] END AS job_ids FROM messages",
)


def attached(spark, sf):
    ids = F.array(c("message_id") % 1000, c("conv_id"), c("conv_id") + 1_000_000_000, c("conv_id"))
    return messages(spark, sf).withColumn(
        "job_ids", F.when(c("role") == "ASSISTANT", ids).otherwise(F.array().cast("array<bigint>"))
    )


cte(
    "attached_cards", ["attached", "listings"],
    f"""SELECT a.message_id, a.pos, l.*, {duck.salary('l.')} AS pay, {duck.years('l.')} AS yrs FROM (SELECT message_id, unnest(job_ids) AS id, CAST(generate_subscripts(job_ids, 1) - 1 AS INTEGER) AS pos FROM attached) a JOIN listings l USING (id)""",
)


@query("restore_cards", with_ctes("SELECT message_id, pos, id, title, pay AS salary FROM attached_cards", "attached_cards"))
def restore(spark, sf):
    return V.restore_cards(attached(spark, sf), listings(spark, sf)).select("message_id", "pos", "id", "title", "salary")


_line = "'- **' || title || '** at ' || company || ' (Job #' || id || ') · ' || location || CASE WHEN remote THEN ' · Remote' ELSE '' END || ' · ' || pay || ' · ' || yrs"


@query(
    "export_transcript",
    with_ctes(
        f"""SELECT conv_id, 0 AS position, '# Conversation' || chr(10) || chr(10) || '_Exported 30 Jan 2024 · started ' || strftime(min(ts), '%-d %b %Y') || '_' || chr(10) AS block FROM messages GROUP BY conv_id
        UNION ALL SELECT conv_id, count(*) + 1, '---' || chr(10) || '_All job listings are fictional demo data._' FROM messages GROUP BY conv_id
        UNION ALL SELECT p.conv_id, p.position, CASE role WHEN 'USER' THEN '### 🧑 You · ' ELSE '### 🤖 Assistant · ' END || strftime(ts, '%H:%M') || chr(10) || chr(10) || text || chr(10) || coalesce(chr(10) || k.lines || chr(10), '')
        FROM placed p LEFT JOIN (SELECT message_id, string_agg({_line}, chr(10) ORDER BY pos) AS lines FROM attached_cards GROUP BY message_id) k USING (message_id)""",
        "placed", "attached_cards",
    ),
)
def export(spark, sf):
    return V.export_transcript(attached(spark, sf), listings(spark, sf), "30 Jan 2024")
