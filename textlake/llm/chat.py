"""Chat formatting: messages are rebuilt from an event log and rendered with turn marks and a loss mask.

Events of a conversation are ordered by ``seq``. ``message`` and ``edit`` set a message's text (and role), ``delta``
appends to it, ``regenerate`` empties it so that later deltas fill it anew. A regeneration, and an edit of a message
that others followed, also takes away the messages after it that had no event since. Folding is an aggregation per
message (its last setting event, and the deltas after that), so a conversation is never gathered to be folded.

Rendering is an expression per message: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts every ``<``
followed by backslashes and ``|`` gets one more backslash, so no control string can stand there, and the reader takes
one away. The loss mask covers the text of assistant messages.

Defined results: a NULL text or role is empty; messages of one place in the order come by role and text; an event
for a message that has no setting event builds on an empty text; conversations may be NULL, and are one
conversation then; repeated message rows with message ids of their own are turns of their own; other columns play no
part; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from textlake.llm.common import written

START, END = "<|im_start|>", "<|im_end|>\n"
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"<\\(\\*)\|")
_ROLE = re.compile(r"\\([\\n])")


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def escaped_role(role: Column) -> Column:
    """A role is one line: backslashes are doubled and line ends written as ``\\n`` first."""
    plain = F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escaped(plain)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def unescaped_role(role: str) -> str:
    return _ROLE.sub(lambda m: "\n" if m[1] == "n" else "\\", unescaped(role))


def fold(events: DataFrame) -> DataFrame:
    """``events`` (conv_id, message, seq, event, role, text) to final messages: conv_id, place, role, text.

    ``message`` names a message within its conversation; ``place`` is the ``seq`` of its first event.
    """
    sets = F.col("event").isin("message", "edit", "regenerate")
    text = F.coalesce("text", F.lit(""))
    setting = F.struct("seq", F.when(F.col("event") == "regenerate", F.lit("")).otherwise(text).alias("text"))
    final = events.groupBy("conv_id", "message").agg(
        F.min("seq").alias("place"),
        F.max("seq").alias("latest"),
        F.max(F.when(sets, setting)).alias("base"),
        F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("role"),
        F.collect_list(F.when(F.col("event") == "delta", F.struct("seq", text.alias("text")))).alias("deltas"),
        F.max(F.when(F.col("event").isin("edit", "regenerate"), F.col("seq"))).alias("reset"),
    )
    after = F.filter("deltas", lambda d: F.col("base").isNull() | (d["seq"] > F.col("base.seq")))
    joined = F.concat(F.coalesce("base.text", F.lit("")), F.array_join(F.transform(F.array_sort(after), lambda d: d["text"]), ""))
    final = written(final.withColumn("text", joined).withColumn("role", F.col("role.role")).drop("base", "deltas"), "messages")
    # messages without an event since an earlier one was set again go; only conversations with such events are ordered
    resets = final.where("reset IS NOT NULL").select(F.col("conv_id").alias("again")).distinct()
    known = final.join(resets, final["conv_id"].eqNullSafe(F.col("again")), "left_semi")
    other = final.join(resets, final["conv_id"].eqNullSafe(F.col("again")), "left_anti")
    before = Window.partitionBy("conv_id").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    known = known.withColumn("cut", F.max("reset").over(before)).where("cut IS NULL OR latest > cut").drop("cut")
    return known.unionByName(other).select("conv_id", "place", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """One segment per message: conv_id, place, role, text, segment, mask_start, mask_length (in code points of it).

    The formatted conversation is its segments in the order of place, role and text.
    """
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    body = escaped(F.col("text"))
    learn = F.coalesce(F.col("role") == "assistant", F.lit(False))
    return messages.select(
        "conv_id",
        "place",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.concat(head, body, F.lit(END)).alias("segment"),
        F.char_length(head).alias("mask_start"),
        F.when(learn, F.char_length(body)).otherwise(0).alias("mask_length"),
    )


def formatted(segments: DataFrame) -> DataFrame:
    """Whole conversations: conv_id, formatted (text), mask (array of start and length in it). One row each, so for
    conversations that fit in one row; ``digests`` reads segments one at a time."""
    rows = F.array_sort(F.collect_list(F.struct("place", "role", "text", "segment", "mask_start", "mask_length")))
    all_ = segments.groupBy("conv_id").agg(rows.alias("rows"))
    pieces = F.transform("rows", lambda r: r["segment"])
    step = F.aggregate(
        "rows",
        F.struct(F.lit(0).alias("at"), F.expr("array(struct(0 AS start, 0 AS length))").alias("mask")),
        lambda acc, r: F.struct(
            (acc["at"] + F.char_length(r["segment"])).alias("at"),
            F.when(r["mask_length"] > 0, F.concat(acc["mask"], F.array(F.struct((acc["at"] + r["mask_start"]).alias("start"), r["mask_length"].alias("length")))))
            .otherwise(acc["mask"])
            .alias("mask"),
        ),
    )
    return all_.select("conv_id", F.array_join(pieces, "").alias("formatted"), F.slice(step["mask"], 2, F.lit(2147483647)).alias("mask"))


def read_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts read back from formatted text."""
    return [(unescaped_role(role), unescaped(body)) for role, body in _TURN.findall(text)]


def digests(segments: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted segments: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest is a function of the whole conversation in order, so its segments pass through one task; they are sorted
    on disk and read one by one, and only digests are kept.
    """
    key = segments.schema["conv_id"].dataType.simpleString()
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "place", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            for conv, segment, start, length in zip(*(batch.column(c) for c in ("conv_id", "segment", "mask_start", "mask_length"))):
                conv, segment, start, length = conv.as_py(), segment.as_py(), start.as_py(), length.as_py()
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(now)
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(segment):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                learned = unescaped(segment[start : start + length])
                now[3] += len(learned)
                now[4].update(learned.encode())
                now[5] += len(segment)
            yield rows_of(done)
        if now is not None:
            yield rows_of([now])

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [kinds[key], pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def rows_of(done: list) -> pa.RecordBatch:
        rows = [(c, n, t.hexdigest(), k, m.hexdigest(), f) for c, n, t, k, m, f in done]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], names)

    return ordered.select("conv_id", "segment", "mask_start", "mask_length").mapInArrow(
        run, f"conv_id {key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
