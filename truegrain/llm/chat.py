"""Chat formatting by quotation linking.

Quoted lines begin with one ``>`` (or ``&gt;``) per level.  A passage is a run of
lines of one level; its normalised text (marks off, lower case, single spaces) is
hashed, and so are its lines.  The hashes are joined to those of the messages'
own words (the whole message, its paragraphs and its lines): the first message
of the conversation to have said it, if it came before, is the original.  A
message answers the original that its first-level quotes share most text with.

Replies stand under what they answer, in the order of their turns, each followed
by its own replies; messages that quote nothing are ordered likewise.  A position
is counted from sums, one number a row: the thread sizes of earlier siblings,
added up along what the message answers.  Quotes, and the lines that announce
them, are cut out.

Everything is DataFrame operations.  Originals are found by a partially
aggregated minimum and an equality join, so a line that everybody says makes as
many rows as it has occurrences; siblings are ordered by a range sort and threads
added up by pointer doubling, so a conversation may span any number of tasks and
a thread may be of any depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import ranked, running_sum
from .common import saved

MARKS = r"^[ \t]*(?:(?:>|&gt;)[ \t]?)+"
#: A line that announces a quote, if one follows.
ANNOUNCES = r"(?i)^\s*(?:on|le|am|el)\s.*(?:wrote|writes|a écrit|schrieb|escribió)\s*:\s*$|^\s*-+\s*original message\s*-+\s*$"


def _normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " ")))


def parse(messages: DataFrame) -> DataFrame:
    """One row per distinct message: ``row``, ``conv_id``, ``turn``, ``role``,
    ``own`` (its text without quotes), ``units`` (hashes of what it says itself)
    and ``quotes`` (level, hash and length of quoted passages and lines)."""
    m = messages.select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))]).distinct()
    m = m.withColumn("line", F.split(F.coalesce("text", F.lit("")), r"\r\n|\n|\r"))
    level = lambda x: F.length(F.regexp_replace(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "&gt;", ">"), "[^>]", ""))
    m = m.withColumn("line", F.transform("line", lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("text"))))
    ahead = F.concat(F.slice(F.col("line"), 2, F.greatest(F.size("line") - 1, F.lit(0))), F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("text"))))
    m = m.withColumn(
        "line",
        F.zip_with("line", ahead, lambda x, y: F.struct(F.when((x["level"] == 0) & (y["level"] > 0) & x["text"].rlike(ANNOUNCES), -1).otherwise(x["level"]).alias("level"), x["text"].alias("text"))),
    )
    # a passage's lines joined: text of equal level, cut where the level changes or a line is blank
    cut = F.transform(
        "line", lambda x, i: F.struct(x["level"].alias("level"), _normal(x["text"]).alias("text"), F.when(i == 0, True).otherwise(F.element_at("line", i)["level"] != x["level"]).alias("fresh"))
    )
    m = m.withColumn("cut", F.when(F.exists("line", lambda x: x["level"] > 0), cut))
    marked = F.array_join(F.transform("cut", lambda x: F.concat(F.when(x["fresh"], F.concat(F.lit("\u0002"), x["level"].cast("string"), F.lit("\u0001"))).otherwise(F.lit(" ")), x["text"])), "")
    passages = F.transform(F.filter(F.split(marked, "\u0002"), lambda x: x.rlike("^[1-9][0-9]*\u0001")), lambda x: F.struct(F.substring_index(x, "\u0001", 1).cast("int").alias("level"), _normal(F.substring_index(x, "\u0001", -1)).alias("text")))
    quoted_lines = F.transform(F.filter("cut", lambda x: x["level"] > 0), lambda x: F.struct(x["level"].alias("level"), x["text"].alias("text")))
    quotes = F.transform(F.filter(F.array_distinct(F.concat(passages, quoted_lines)), lambda x: x["text"] != ""), lambda x: F.struct(x["level"].alias("level"), F.xxhash64(x["text"]).alias("hash"), F.length(x["text"]).alias("chars")))
    own_lines = F.transform(F.filter("line", lambda x: x["level"] == 0), lambda x: x["text"])
    own = F.regexp_replace(F.regexp_replace(F.array_join(own_lines, "\n"), r"^\s+|\s+$", ""), r"\n{3,}", "\n\n")
    m = m.withColumn("quotes", F.coalesce(quotes, F.filter(F.array(F.struct(F.lit(0).alias("level"), F.lit(0).cast("long").alias("hash"), F.lit(0).alias("chars"))), lambda x: F.lit(False)))).withColumn("own", own)
    parts = F.concat(F.array("own"), F.split("own", "\n"), F.split("own", r"\n\s*\n"))
    units = F.array_distinct(F.transform(F.filter(F.transform(parts, _normal), lambda x: x != ""), lambda x: F.xxhash64(x)))
    return m.select(F.monotonically_increasing_id().alias("row"), "conv_id", "turn", "role", "own", units.alias("units"), "quotes")


def link(parsed: DataFrame) -> DataFrame:
    """``row`` of a message that answers another, its ``turn``, and ``parent``
    and ``parent_turn`` of the message that its first-level quotes share most
    text with (ties: the later turn)."""
    quotes = parsed.where(F.size("quotes") > 0).select("row", "conv_id", "turn", F.explode("quotes").alias("q")).select("row", "conv_id", "turn", "q.level", "q.hash", "q.chars").where("level = 1")
    origin = parsed.where("turn is not null").select("conv_id", F.explode("units").alias("hash"), F.struct("turn", "row").alias("at")).groupBy("conv_id", "hash").agg(F.min("at").alias("at"))
    found = quotes.join(origin, ["conv_id", "hash"]).where(F.col("at.turn") < F.col("turn"))
    shared = found.groupBy("row", "turn", "at").agg(F.sum("chars").alias("chars"))
    best = shared.groupBy("row", "turn").agg(F.max(F.struct("chars", "at.turn", F.col("at.row").alias("parent"))).alias("best"))
    return best.select("row", "turn", F.col("best.parent").alias("parent"), F.col("best.turn").alias("parent_turn"))


def _threads(links: DataFrame) -> DataFrame:
    """``row``, ``depth`` (1 for what answers nothing) and ``size`` (messages of
    its thread from it down, itself included) of messages that answer or are
    answered, by pointer doubling: after k rounds a row knows its 2^k-th
    ancestor and counts the descendants nearer than that."""
    ends = links.select("row", F.col("parent").alias("up")).union(links.select("parent", F.lit(None).cast("long")))
    p = saved(ends.groupBy("row").agg(F.max("up").alias("up")).select("row", "up", F.lit(1).alias("depth"), F.lit(1).cast("long").alias("size")), "threads")
    while not p.where("up is not null").isEmpty():
        far = p.where("up is not null")
        below = far.groupBy("up").agg(F.sum("size").alias("below")).withColumnRenamed("up", "row")
        over = p.select(F.col("row").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("over"))
        step = far.join(over, "up").select("row", F.col("up2").alias("up"), (F.col("depth") + F.col("over")).alias("depth"), "size").union(p.where("up is null"))
        p = saved(step.join(below, "row", "left").select("row", "up", "depth", (F.col("size") + F.coalesce("below", F.lit(0))).alias("size")), "threads")
    return p.select("row", "depth", "size")


def _places(steps: DataFrame) -> DataFrame:
    """``row`` and ``position``: the sum of ``step`` over a row and all that it
    answers (``up``, and so on), by pointer doubling."""
    p = saved(steps.select("row", "up", F.col("step").alias("position")), "places")
    while not p.where("up is not null").isEmpty():
        over = p.select(F.col("row").alias("up"), F.col("up").alias("up2"), F.col("position").alias("over"))
        step = p.where("up is not null").join(over, "up").select("row", F.col("up2").alias("up"), (F.col("position") + F.col("over")).alias("position"))
        p = saved(step.union(p.where("up is null")), "places")
    return p.select("row", "position")


def conversations(messages: DataFrame) -> DataFrame:
    """The messages without quotes, in reply order.

    One row per distinct message: ``conv_id``, ``position`` from 1, ``turn``,
    ``role``, ``text``, ``parent_turn`` (null if it quotes nothing said before)
    and ``depth`` (1, or one more than what it answers).  Reads ``conv_id``, ``turn``, ``role``,
    ``text``; other columns are ignored.  Repeated rows are one message; a null
    text is an empty message; messages without conv_id form one conversation, in
    which nothing is linked; a null turn comes first and answers and originates
    nothing; several messages of one turn that answer the same are ordered by role
    and text, each followed by its replies; an empty table gives no rows.
    """
    parsed = saved(parse(messages), "messages")
    links = saved(link(parsed), "links")
    rows = parsed.select("row", "conv_id", "turn", "role", "own").join(links.select("row", "parent", "parent_turn"), "row", "left").join(_threads(links), "row", "left")
    rows = rows.withColumn("depth", F.coalesce("depth", F.lit(1))).withColumn("size", F.coalesce("size", F.lit(1).cast("long")))
    # a row stands behind what it answers and the threads of its earlier siblings
    lined = running_sum(ranked(rows.drop("depth", "parent_turn"), "conv_id", "parent", "turn", "role", "own", "row", name="at"), "size", "at", "through")
    lined = saved(lined.select("row", "conv_id", "parent", (F.col("through").cast("long") - F.col("size")).alias("before")), "siblings")
    first = lined.groupBy(F.col("conv_id").alias("c"), F.col("parent").alias("up")).agg(F.min("before").alias("first"))
    steps = lined.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("parent").eqNullSafe(F.col("up"))).select("row", "up", (F.col("before") - F.col("first") + 1).alias("step"))
    out = rows.join(_places(steps), "row")
    return out.select("conv_id", "position", "turn", "role", F.col("own").alias("text"), "parent_turn", "depth")


def transcripts(messages: DataFrame, piece: int = 256) -> DataFrame:
    """Conversations as arrays of (position, role, text), ``piece`` messages to
    a row so that no row grows with the conversation."""
    rows = conversations(messages).withColumn("part", ((F.col("position") - 1) / piece).cast("long"))
    lists = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("position", "role", "text"))).alias("messages"))
    return lists.select("conv_id", "part", F.size("messages").alias("n_messages"), "messages")
