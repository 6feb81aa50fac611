"""Sentence packing with one sentence of overlap, as one native fold per text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hybridq.functions.strings import strings, strip

# fixed value: a break follows closing punctuation, or is a run of line ends
SENTENCE_BREAK = r"(?<=[.!?])\s+|\n+"


def _drop_last_blank(c: Column) -> Column:
    return c.substr(F.lit(1), F.length(c) - 1)


def hard_wrap(sentence: Column, max_chars: Column) -> Column:
    """Greedy word wrap; a word longer than the limit stays whole."""
    start = F.struct(strings([]).alias("lines"), F.lit("").alias("line"))

    def add(acc, word):
        full = (F.length(acc.line) + F.length(word) + 1 > max_chars) & (acc.line != "")
        return F.struct(
            F.when(full, F.concat(acc.lines, F.array(_drop_last_blank(acc.line)))).otherwise(acc.lines).alias("lines"),
            F.concat(F.when(full, F.lit("")).otherwise(acc.line), word, F.lit(" ")).alias("line"),
        )

    return F.aggregate(
        F.split(sentence, r"\s+"),
        start,
        add,
        lambda acc: F.when(acc.line == "", acc.lines).otherwise(
            F.concat(acc.lines, F.array(_drop_last_blank(acc.line)))
        ),
    )


def split_text(text: Column, max_chars: Column | int) -> Column:
    """array<string> of chunks; see the module docstring for the rules."""
    limit = F.lit(max_chars) if isinstance(max_chars, int) else max_chars
    trimmed = strip(F.coalesce(text, F.lit("")))
    sentences = F.filter(F.transform(F.split(trimmed, SENTENCE_BREAK), strip), lambda s: s != "")
    start = F.struct(
        strings([]).alias("chunks"), F.lit("").alias("current"), F.lit(None).cast("string").alias("previous")
    )

    def add(acc, s):
        n = F.length(s)
        too_long = n > limit
        started = acc.current != ""
        overflow = started & (F.length(acc.current) + n + 1 > limit)
        overlap = acc.previous.isNotNull() & (F.length(acc.previous) + n + 1 <= limit)
        done = F.array(_drop_last_blank(acc.current))
        chunks = (
            F.when(too_long & started, F.concat(acc.chunks, done, hard_wrap(s, limit)))
            .when(too_long, F.concat(acc.chunks, hard_wrap(s, limit)))
            .when(overflow, F.concat(acc.chunks, done))
            .otherwise(acc.chunks)
        )
        current = (
            F.when(too_long, F.lit(""))
            .when(overflow & overlap, F.concat(acc.previous, F.lit(" "), s, F.lit(" ")))
            .when(overflow, F.concat(s, F.lit(" ")))
            .otherwise(F.concat(acc.current, s, F.lit(" ")))
        )
        previous = F.when(too_long, F.lit(None).cast("string")).otherwise(s)
        return F.struct(chunks.alias("chunks"), current.alias("current"), previous.alias("previous"))

    packed = F.aggregate(
        sentences,
        start,
        add,
        lambda acc: F.when(acc.current == "", acc.chunks).otherwise(
            F.concat(acc.chunks, F.array(_drop_last_blank(acc.current)))
        ),
    )
    return (
        F.when(trimmed == "", strings([])).when(F.length(trimmed) <= limit, F.array(trimmed)).otherwise(packed)
    )
