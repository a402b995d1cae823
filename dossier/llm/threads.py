"""Conversations rebuilt from quotations.

A message's lines are parsed by quote level.  Its quoted passages, and their lines, are
normalised and hashed, and joined to the messages in which the same words stand unquoted.
The message that explains most of the outermost quotation is the one replied to.
Replies form trees; a tree is a conversation, in which every reply follows its original
and nothing is quoted any more.

The join is an as-of join: every quoted passage looks for its last original before
the message, by a running maximum over the passage's places, so a phrase that everybody uses
pairs nothing.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier.llm.common import written

_QUOTE = re.compile(r"(?:[ \t]*>)+[ \t]?")
_ESCAPED = re.compile(r"^([ \t]*)\\(\\*>)")
_BLANK = re.compile(r"\s+")
PLACES = 1024


def quoted_lines(text: str) -> list[tuple[int, str]]:
    """(quote level, content) of every line; a content that begins with ``>`` itself is
    written with a backslash before it."""
    out = []
    for line in text.split("\n"):
        mark = _QUOTE.match(line)
        level, content = (mark[0].count(">"), line[mark.end():]) if mark else (0, line)
        out.append((level, _ESCAPED.sub(r"\1\2", content) if "\\" in content else content))
    return out


def _hash(words: str) -> int:
    return int.from_bytes(hashlib.blake2b(words.encode(), digest_size=8).digest(), "little",
                          signed=True)


def units(lines: list[tuple[int, str]]) -> list[dict]:
    """Passages (runs of one level) and their lines as (level, hash, weight).

    White space is made single and case is ignored; blank lines end nothing and count
    for nothing.  The weight is the number of characters, and one more for a passage.
    """
    passages: list[tuple[int, list[str]]] = []
    for level, line in lines:
        words = _BLANK.sub(" ", line).strip().lower()
        if words:
            if not passages or passages[-1][0] != level:
                passages.append((level, []))
            passages[-1][1].append(words)
    found = {}
    for level, held in passages:
        for k, words in enumerate([" ".join(held), *held]):
            key = level, _hash(words)
            found[key] = max(found.get(key, 0), len(words) + (k == 0))
    return [{"level": lev, "hash": h, "weight": w} for (lev, h), w in found.items()]


def _parsed(messages: DataFrame, thread: str, order: str, role: str, text: str) -> DataFrame:
    """Written (uid, thread, place, role, body, units): one row per different message."""
    rows = messages.select(
        F.col(thread).alias("own_thread"), F.col(order).cast("long").alias("own_order"),
        F.col(role).cast("string").alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    named = rows.select(
        F.md5(F.to_json(F.struct("own_thread", "own_order", "role", "body"))).alias("uid"),
        F.to_json(F.struct("own_thread")).alias("thread"),
        F.coalesce("own_order", F.lit(-1)).alias("place"), "own_thread", "own_order", "role",
        "body").dropDuplicates(["uid"])
    kind = "array<struct<level:int,hash:bigint,weight:int>>"

    def run(batches):
        for batch in batches:
            lines = [quoted_lines(t) for t in batch.column("body").to_pylist()]
            body = ["\n".join(x for level, x in found if not level).strip() for found in lines]
            at = batch.schema.get_field_index("body")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array(body, pa.string()),
                 pa.array([units(found) for found in lines], pa.list_(pa.struct(
                     [("level", pa.int32()), ("hash", pa.int64()), ("weight", pa.int32())])))],
                [*batch.schema.names[:at], "body", "units"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema)
    return written(named.mapInArrow(run, f"{fields}, units {kind}"))


def _originals(parsed: DataFrame) -> DataFrame:
    """(uid, parent): the message that each quoting message replies to.

    Places are cut into blocks of PLACES, so a passage that occurs in very many messages of a
    thread is worked on block by block; a block begins with what the blocks before it end with.
    """
    seen = parsed.select("uid", "thread", "place", F.explode("units").alias("u")).select(
        "uid", "thread", "place", "u.*", F.floor(F.col("place") / PLACES).alias("block"))
    original = F.when(F.col("level") == 0, F.struct("place", "uid"))
    key = ["thread", "hash"]
    blocks = seen.groupBy(*key, "block").agg(F.max(original).alias("best"))
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("carried", F.max("best").over(before)).drop("best")
    # strictly earlier places, so neither the message nor one of the same place hides an original
    running = (Window.partitionBy(*key, "block").orderBy("place")
               .rangeBetween(Window.unboundedPreceding, -1))
    found = (seen.withColumn("here", F.max(original).over(running))
             .filter(F.col("level") > 0).join(blocks, [*key, "block"])
             .withColumn("to", F.coalesce("here", "carried"))
             .filter(F.col("to").isNotNull()))
    return (found.groupBy("uid", "level", "to").agg(F.sum("weight").alias("weight"))
            .groupBy("uid").agg(F.max(F.struct((-F.col("level")).alias("near"), "weight", "to"))
                                .alias("best")).select("uid", F.col("best.to.uid").alias("parent")))


def conversations(messages: DataFrame, thread: str = "conv_id", order: str = "turn",
                  role: str = "role", text: str = "text") -> DataFrame:
    """One row per different message: thread, order, role, parent, root, depth, body, formatted.

    ``parent`` and ``root`` are the orders of the message replied to and of the first
    message of the conversation; ordering by (thread, root, order) puts every reply behind its
    original.  ``formatted`` is the message in chat form, without its quotations.  A
    message that quotes no earlier message of its thread starts a conversation.  A quotation is
    explained by its outermost level that has an original, there by the message that
    holds most of it, and of equals by the latest.  Null threads are one thread; a null order
    comes first; a null text counts as empty; rows equal in all four columns count once.
    """
    parsed = _parsed(messages, thread, order, role, text)
    linked = parsed.select("uid").join(_originals(parsed), "uid", "left")
    start = written(linked.select(
        "uid", "parent", F.coalesce("parent", "uid").alias("top"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"),
        F.col("parent").isNull().alias("done")))
    settled, open_ = start.filter("done"), start.filter("not done")
    while not open_.isEmpty():  # each round doubles the reach of what has not met its root
        higher = settled.unionByName(open_).select(
            F.col("uid").alias("top"), F.col("top").alias("top2"),
            F.col("depth").alias("depth2"), F.col("done").alias("done2"))
        now = written(open_.join(higher, "top").select(
            "uid", "parent", F.col("top2").alias("top"),
            (F.col("depth") + F.col("depth2")).alias("depth"), F.col("done2").alias("done")))
        settled, open_ = settled.unionByName(now.filter("done")), now.filter("not done")
    up = settled.drop("done")
    names = parsed.select("uid", "own_order")
    rows = (parsed.drop("units").join(up, "uid")
            .join(names.toDF("parent", "parent_order"), "parent", "left")
            .join(names.toDF("top", "root_order"), "top", "left"))
    return rows.select(
        F.col("own_thread").alias(thread), F.col("own_order").alias(order), "role",
        F.col("parent_order").alias("parent"), F.col("root_order").alias("root"), "depth", "body",
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), "body",
                 F.lit("\n<|end|>\n")).alias("formatted"))


def as_mail(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) written as mail: every turn but the first quotes the
    turn before it, or every third time the one before that, with what that one quotes."""
    rows = messages.select("conv_id", "turn", "role",
                           F.regexp_replace(F.coalesce("text", F.lit("")),
                                            r"(^|\n)([ \t]*)(\\*>)", r"$1$2\\$3").alias("text"))
    back = F.when(((F.col("conv_id") + F.col("turn")) % 3 == 0) & (F.col("turn") > 1), 2).otherwise(1)
    turns = rows.withColumn("to", F.col("turn") - back)
    earlier = turns.select("conv_id", F.col("turn").alias("to"), F.col("text").alias("one"),
                           F.col("to").alias("to2"))
    oldest = rows.select("conv_id", F.col("turn").alias("to2"), F.col("text").alias("two"))

    def quoted(text: str, mark: str):
        # lines end where the parser lets them end: at a line feed only
        return F.concat(F.lit(mark), F.replace(F.col(text), F.lit("\n"), F.lit(f"\n{mark}")))

    return (turns.join(earlier, ["conv_id", "to"], "left").join(oldest, ["conv_id", "to2"], "left")
            .select("conv_id", "turn", "role", F.concat_ws(
                "\n", quoted("two", "> > "), quoted("one", "> "), "text").alias("text")))
