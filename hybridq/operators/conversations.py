"""Conversation tables: history, summaries, edits, feedback and search state.

Messages have message_id (monotonic), conv_id, role, text and ts.  One conversation
may hold a large share of all messages, so nothing orders a whole conversation in
one task: positions come from bucket counts, states from max_by aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hybridq import vocab
from hybridq.functions.formats import format_experience, format_salary
from hybridq.functions.strings import blank_to_null
from hybridq.operators.catalog import listing_card

BUCKET = 1024


def positions(messages: DataFrame, key: str = "conv_id", order: str = "message_id", bucket: int = BUCKET) -> DataFrame:
    """Adds `position` (1-based within `key`, by `order`).

    Ids are cut into buckets of a fixed width and those into regions of `bucket` buckets.  A bucket numbers
    its own rows, a region sums the counts of its buckets, and only the regions' totals
    are summed along a whole conversation, also where ids grow over all conversations and
    a bucket holds one or two rows of each."""
    part = messages.withColumn("_bucket", F.floor(F.col(order) / bucket))
    counts = part.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_region", F.floor(F.col("_bucket") / bucket))
    so_far = lambda by, along: Window.partitionBy(*by).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    regions = counts.groupBy(key, "_region").agg(F.sum("_n").alias("_total"))
    regions = regions.select(key, "_region", F.coalesce(F.sum("_total").over(so_far([key], "_region")), F.lit(0)).alias("_base"))
    inner = F.coalesce(F.sum("_n").over(so_far([key, "_region"], "_bucket")), F.lit(0))
    offsets = counts.withColumn("_inner", inner).join(regions, [key, "_region"]).select(
        key, "_bucket", (F.col("_base") + F.col("_inner")).alias("_offset")
    )
    inside = Window.partitionBy(key, "_bucket").orderBy(order)
    numbered = part.withColumn("_row", F.row_number().over(inside))
    return numbered.join(offsets, [key, "_bucket"]).withColumn(
        "position", (F.col("_offset") + F.col("_row")).cast("bigint")
    ).drop("_bucket", "_row", "_offset")


def conversation_history(messages: DataFrame) -> DataFrame:
    """All messages with their position, oldest first."""
    return positions(messages).sort("conv_id", "position")


def recent_history(messages: DataFrame, n: int = vocab.HISTORY_WINDOW, bucket: int = BUCKET) -> DataFrame:
    """(message_id, conv_id, history): the n messages before each one, oldest first.

    Positions are cut into blocks; a block is one window partition and only gets copies of
    the last n rows of the block before it."""
    placed = positions(messages, bucket=bucket)
    keep = ["message_id", "conv_id", "position", "role", "text"]
    if n <= 0:
        return placed.select(*keep, F.array().cast("array<struct<role:string,content:string>>").alias("history"))
    size = max(bucket, n)
    blocks = placed.select(*keep, F.floor((F.col("position") - 1) / size).alias("_block"), F.lit(True).alias("_own"))
    tails = blocks.where((F.col("position") - 1) % size >= size - n)
    both = blocks.unionByName(tails.withColumns({"_block": F.col("_block") + 1, "_own": F.lit(False)}))
    before = Window.partitionBy("conv_id", "_block").orderBy("position").rowsBetween(-n, -1)
    said = F.struct(F.lower("role").alias("role"), F.col("text").alias("content"))
    return both.withColumn("history", F.collect_list(said).over(before)).where("_own").select(*keep, "history")


def recent_user_turns(messages: DataFrame, n: int = vocab.HISTORY_WINDOW, last: int = 4) -> DataFrame:
    """(message_id, conv_id, turns): the last user messages inside the history window."""
    users = F.transform(F.filter("history", lambda e: e.role == "user"), lambda e: e.content)
    kept = F.when(F.size(users) > last, F.slice(users, -last, last)).otherwise(users)
    return recent_history(messages, n).select("message_id", "conv_id", kept.alias("turns"))


def message_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.count("*").alias("messages"))


def title_from_text(text: Column) -> Column:
    """One line of at most 60 characters."""
    edge = r"^\s+|\s+$"
    line = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), edge, ""), r"\s+", " ")
    short = F.concat(F.regexp_replace(F.substring(line, 1, 57), edge, ""), F.lit("..."))
    return F.when(line == "", "New chat").when(F.length(line) > 60, short).otherwise(line)


def conversation_summary(messages: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """(conv_id, title, created_at, updated_at, messages), most recently active first.

    renames: conv_id, title, at."""
    user = F.col("role") == "USER"
    summary = messages.groupBy("conv_id").agg(
        F.min_by(F.when(user, F.col("text")), F.when(user, F.col("message_id"))).alias("_first"),
        F.max(user).alias("_spoke"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
        F.count("*").alias("messages"),
    )
    title = F.when(F.col("_spoke"), title_from_text(F.col("_first"))).otherwise("New chat")
    summary = summary.select("conv_id", title.alias("title"), "created_at", "updated_at", "messages")
    if renames is not None:
        summary = rename_conversations(summary, renames)
    return summary.orderBy(F.col("updated_at").desc(), "conv_id")


def rename_conversations(summary: DataFrame, renames: DataFrame) -> DataFrame:
    """The last non-blank rename of a conversation replaces its title."""
    last = (
        renames.where(blank_to_null(F.col("title")).isNotNull())
        .groupBy("conv_id").agg(F.max_by("title", F.struct("at", "title")).alias("_title"))
    )
    return summary.join(last, "conv_id", "left").withColumn(
        "title", F.when(F.col("_title").isNotNull(), title_from_text(F.col("_title"))).otherwise(F.col("title"))
    ).drop("_title")


def delete_conversations(messages: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Messages that remain after removing the conversations in `ids` (None removes all)."""
    if ids is None:
        return messages.where(F.lit(False))
    return messages.join(ids.select("conv_id").distinct(), "conv_id", "left_anti")


def truncate_from(messages: DataFrame, cuts: DataFrame) -> DataFrame:
    """Drop each cut message and all later ones of its conversation.

    cuts: conv_id, message_id; a message of another conversation cuts nothing."""
    valid = cuts.join(messages.select("conv_id", "message_id"), ["conv_id", "message_id"], "left_semi")
    first = valid.groupBy("conv_id").agg(F.min("message_id").alias("_cut"))
    return messages.join(first, "conv_id", "left").where(
        F.col("_cut").isNull() | (F.col("message_id") < F.col("_cut"))
    ).drop("_cut")


def pop_last_user_turn(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining messages, (conv_id, message_id, text) of each popped user message)."""
    popped = messages.where(F.col("role") == "USER").groupBy("conv_id").agg(
        F.max("message_id").alias("message_id"), F.max_by("text", "message_id").alias("text")
    )
    return truncate_from(messages, popped.select("conv_id", "message_id")), popped


def apply_feedback(messages: DataFrame, ratings: DataFrame) -> DataFrame:
    """Adds `feedback`: the last valid rating (up, down, or NULL which clears) of each message.

    ratings: message_id, rating, ts, event_id."""
    valid = ratings.where(F.col("rating").isNull() | F.col("rating").isin("up", "down"))
    last = valid.groupBy("message_id").agg(
        F.max_by(F.struct("rating"), F.struct("ts", "event_id")).alias("_last")
    )
    return messages.join(last, "message_id", "left").withColumn("feedback", F.col("_last.rating")).drop("_last")


def rejected_feedback(messages: DataFrame, ratings: DataFrame) -> DataFrame:
    """(event_id, error) for unknown ratings and unknown messages."""
    wrong = F.col("rating").isNotNull() & ~F.col("rating").isin("up", "down")
    unknown = ratings.where(~wrong).join(messages.select("message_id"), "message_id", "left_anti")
    return ratings.where(wrong).select("event_id", F.lit('rating must be "up", "down" or null').alias("error")).unionByName(
        unknown.select("event_id", F.lit("unknown message").alias("error"))
    )


def fold_search_state(events: DataFrame, query_chars: int | None = None) -> DataFrame:
    """Latest search state per conversation.

    events: conv_id, turn, kind (search, refine or focus), criteria, query,
    candidate_ids, shown_ids, focus_id.  A search replaces the state and clears the
    focus, a focus sets it, a refinement that showed nothing leaves everything.
    `query_chars` cuts the stored search text, if given.  The fold is one partial aggregate and
    serves streams (update mode) as well."""
    c = F.col
    counts = (c("kind") == "search") | ((c("kind") == "refine") & (F.coalesce(F.size("shown_ids"), F.lit(0)) > 0))
    searched = F.struct("criteria", (F.col("query") if query_chars is None else F.substring("query", 1, query_chars)).alias("query"), "candidate_ids", "shown_ids")
    state = events.groupBy("conv_id").agg(
        F.max_by(F.when(counts, searched), F.when(counts, c("turn"))).alias("s"),
        F.max(F.when(counts, c("turn"))).alias("_searched"),
        F.max(F.when(c("kind") == "focus", c("turn"))).alias("_focused"),
        F.max_by(F.when(c("kind") == "focus", c("focus_id")), F.when(c("kind") == "focus", c("turn"))).alias("_focus"),
    )
    live = c("_focused").isNotNull() & (c("_searched").isNull() | (c("_focused") > c("_searched")))
    return state.select(
        "conv_id", "s.criteria", "s.query", "s.candidate_ids", "s.shown_ids", F.when(live, c("_focus")).alias("focus_id")
    )


def known_ids(states: DataFrame, returned: DataFrame) -> DataFrame:
    """(conv_id, ids): everything an answer may mention.

    returned: conv_id, ids of this turn (bounded by the pool)."""
    none = F.array().cast("array<bigint>")
    focus = F.when(F.col("focus_id").isNotNull(), F.array("focus_id")).otherwise(none)
    merged = F.flatten(
        F.array(*[F.coalesce(n, none) for n in ("candidate_ids", "shown_ids")], focus, F.coalesce("_ids", none))
    )
    now = returned.select("conv_id", F.col("ids").alias("_ids"))
    return states.join(now, "conv_id", "left").select("conv_id", F.array_distinct(merged).alias("ids"))


def recency_bucket(at: Column, now: Column) -> Column:
    today = F.date_trunc("day", now)
    back = lambda days: today - F.make_interval(days=F.lit(days))
    names = vocab.RECENCY_GROUPS
    return (
        F.when(at >= today, names[0]).when(at >= back(1), names[1]).when(at >= back(7), names[2])
        .when(at >= back(30), names[3]).otherwise(names[4])
    )


def search_titles(summary: DataFrame, text: str, now: Column) -> DataFrame:
    """Conversations whose title contains `text`, with their recency group and its order."""
    wanted = text.strip().lower()
    rows = summary.where(F.contains(F.lower("title"), F.lit(wanted))) if wanted else summary
    group = recency_bucket(F.col("updated_at"), now)
    return rows.withColumn("bucket", group).withColumn(
        "bucket_rank", F.array_position(F.lit(vocab.RECENCY_GROUPS), F.col("bucket")).cast("int")
    )


def restore_cards(messages: DataFrame, listings: DataFrame) -> DataFrame:
    """(message_id, pos, card fields): the cards an assistant message showed, in order."""
    shown = messages.where(F.col("role") == "ASSISTANT").select(
        "message_id", F.posexplode("job_ids").alias("pos", "id")
    )
    return shown.join(listing_card(listings), "id")


def _card_line() -> Column:
    c = F.col
    return F.concat(
        F.lit("- **"), c("title"), F.lit("** at "), c("company"), F.lit(" (Job #"), c("id").cast("string"), F.lit(") · "),
        c("location"), F.when(c("remote"), " · Remote").otherwise(""), F.lit(" · "),
        format_salary(c("salary_min"), c("salary_max"), c("currency")), F.lit(" · "),
        format_experience(c("experience_min"), c("experience_max")),
    )


def export_transcript(
    messages: DataFrame,
    listings: DataFrame,
    exported: str,
    heading: str = "Conversation",
    notice: str = "All job listings are fictional demo data.",
) -> DataFrame:
    """(conv_id, position, block): the blocks of one Markdown document per conversation.

    Blocks in order, joined by line ends, are the document; keeping them as rows
    means a long conversation is never gathered in one task.  messages may carry
    job_ids; `exported` is the export date text."""
    day, clock = "d MMM yyyy", "HH:mm"
    cards = (
        messages.where(F.col("role") == "ASSISTANT").select("message_id", F.posexplode("job_ids").alias("pos", "id"))
        .join(listings, "id")
        .select("message_id", F.struct("pos", _card_line().alias("line")).alias("_c"))
        .groupBy("message_id").agg(F.sort_array(F.collect_list("_c")).alias("_cards"))
    )
    body = positions(messages).join(cards, "message_id", "left")
    who = F.when(F.col("role") == "USER", "### 🧑 You · ").otherwise("### 🤖 Assistant · ")
    lines = F.concat_ws(
        "\n", F.concat(who, F.date_format("ts", clock)), F.lit(""), "text", F.lit(""),
        F.when(
            F.size("_cards") > 0,
            F.concat(F.array_join(F.transform("_cards", lambda x: x.line), "\n"), F.lit("\n")),
        ),
    )
    blocks = body.select("conv_id", "position", lines.alias("block"))
    ends = messages.groupBy("conv_id").agg(F.min("ts").alias("_start"), F.count("*").alias("_n"))
    head = F.concat(
        F.lit(f"# {heading}\n\n"),
        F.lit(f"_Exported {exported} · started "), F.date_format("_start", day), F.lit("_\n"),
    )
    heads = ends.select("conv_id", F.lit(0).cast("bigint").alias("position"), head.alias("block"))
    tails = ends.select(
        "conv_id", (F.col("_n") + 1).alias("position"),
        F.lit(f"---\n_{notice}_").alias("block"),
    )
    return heads.unionByName(blocks).unionByName(tails)
