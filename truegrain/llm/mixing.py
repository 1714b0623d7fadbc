"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken target / source size times on
average, at most twice.  The whole part is certain; the fractional parts are
rounded together: of two documents, probability mass counted in words moves
from one to the other, in a random direction that keeps both expectations, until
one of them is certain.  The other one goes on to meet the next.  The words a
source takes in all thus never change, up to the rounding of the very last
document, which is to the nearest.

Documents meet in groups of about ``GROUP`` (hashed within their source), the
largest first and each with all smaller ones as one, so that a small one is left
over; the documents left over by ``GROUP`` neighbouring groups meet in the next
level of a tree, until each source has one.  No task sees more than a group,
however large a source is.  Directions are drawn alike in groups and sources of
every size.  Random numbers are hashes of ids, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, unused

GROUP = 256
SHARE = 1.5
LIMIT = 2.0
WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame) -> DataFrame:
    """``source``, ``source_size`` with a ``target``: ``SHARE`` of all sizes by
    weight, no more than ``LIMIT`` times the source's size, the excess shared
    again by weight among the rest.

    That is target = min(limit, level * weight) for one common level, found by
    filling up the sources in the order in which they reach their limit.
    Windows run over one row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((rank - 1) % len(WEIGHTS) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("most", F.lit(LIMIT) * F.col("source_size"))
    s = s.withColumn("full", F.col("most") / F.col("weight"))
    every, order = Window.partitionBy(), Window.orderBy("full", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(SHARE) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level)
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("full"), F.struct(F.col("full").alias("f"), "level"))).over(every)["level"])
    target = F.when(F.col("level").isNull() | (F.col("full") <= F.col("level")), F.col("most")).otherwise(F.col("level") * F.col("weight"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _meet(state: Column, x: Column, level: int) -> Column:
    """Let the document left over so far (``state.left``) meet ``x``."""
    c = state["left"]
    gain = F.least(c["size"] * (1 - c["p"]), x["size"] * x["p"])
    loss = F.least(x["size"] * (1 - x["p"]), c["size"] * c["p"])
    gains = F.coalesce(_uniform(c["doc_id"], c["seq"], x["doc_id"], x["seq"], x["size"], F.lit(level)) < F.try_divide(loss, gain + loss), F.lit(False))

    def at(d: Column, p: Column) -> Column:
        return F.struct(d["size"].alias("size"), d["doc_id"].alias("doc_id"), d["seq"].alias("seq"), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p"))

    one, none = F.lit(1.0), F.lit(0.0)
    c_full = gains & (c["size"] * (1 - c["p"]) <= x["size"] * x["p"])
    c_empty = ~gains & (c["size"] * c["p"] <= x["size"] * (1 - x["p"]))
    left = (
        F.when(c_full, at(x, x["p"] - gain / x["size"])).when(c_empty, at(x, x["p"] + loss / x["size"]))
        .when(gains, at(c, c["p"] + gain / c["size"])).otherwise(at(c, c["p"] - loss / c["size"]))
    )
    sure = F.when(c_full, at(c, one)).when(c_empty, at(c, none)).when(gains, at(x, none)).otherwise(at(x, one))
    return F.struct(left.alias("left"), F.concat(state["sure"], F.array(sure)).alias("sure"))


def _against_rest(state: Column, x: Column) -> Column:
    """Let ``x`` meet all smaller documents of its group as if they were one,
    of ``state.rest`` words and probability ``state.p``.  Either ``x`` becomes
    certain, or the rest does and ``x`` is left over."""
    p, size = state["p"], x["size"]
    rest = state["rest"] - size
    gain, loss = F.least(size * (1 - p), rest * p), F.least(size * p, rest * (1 - p))
    gains = F.coalesce(_uniform(x["doc_id"], x["seq"], size, state["rest"]) < F.try_divide(loss, gain + loss), F.lit(False))

    def at(q: Column) -> Column:
        return F.struct(size.alias("size"), x["doc_id"].alias("doc_id"), x["seq"].alias("seq"), F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0)).alias("p"))

    can_fill, can_empty = size * (1 - p) <= rest * p, size * p <= rest * (1 - p)
    settled, alone = state["left"].isNotNull(), rest <= 0
    full, empty = gains & can_fill, ~gains & can_empty
    kept = F.when(settled | full | empty, state["left"]).when(alone, at(p)).when(gains, at(p + gain / size)).otherwise(at(p - loss / size))
    kept = F.when(alone & ~settled, at(p)).otherwise(kept)
    sure = F.when(settled, F.array(at(p))).when(alone, F.slice(state["sure"], 1, 0)).when(full, F.array(at(F.lit(1.0)))).when(empty, F.array(at(F.lit(0.0)))).otherwise(F.slice(state["sure"], 1, 0))
    new = F.when(settled | alone, p).when(full, p - gain / rest).when(empty, p + loss / rest).when(gains, F.lit(0.0)).otherwise(F.lit(1.0))
    return F.struct(
        F.least(F.greatest(new, F.lit(0.0)), F.lit(1.0)).alias("p"), rest.alias("rest"), kept.alias("left"), F.concat(state["sure"], sure).alias("sure")
    )


def _round(members: Column, level: int) -> Column:
    """Fold a group, largest first; a struct with ``left`` and ``sure``."""
    members = F.sort_array(members, asc=False)
    if level == 0:  # all documents of a source begin with one probability
        total = F.aggregate(members, F.lit(0.0), lambda n, x: n + x["size"])
        start = F.struct(F.element_at(members, 1)["p"].alias("p"), total.alias("rest"), F.try_element_at(F.slice(members, 1, 0), F.lit(1)).alias("left"), F.slice(members, 1, 0).alias("sure"))
        return F.aggregate(members, start, lambda state, x: _against_rest(state, x))
    start = F.struct(F.element_at(members, 1).alias("left"), F.slice(members, 1, 0).alias("sure"))
    return F.aggregate(F.slice(members, 2, F.greatest(F.size(members) - 1, F.lit(0))), start, lambda state, x: _meet(state, x, level))


def mix(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` = copies * size,
    ``copies`` (0, 1 or 2), ``source`` and ``seq`` for every row of ``docs``;
    ``seq`` numbers rows of equal doc_id, source and size.

    Reads ``doc_id``, ``text``, ``source``; other columns are ignored.  A null
    text has size 0; null sources are one source, the last; null doc_ids take
    part like any id; repeated rows are rounded each on its own; if all sizes
    are 0 so are all targets; an empty table gives no rows.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    kinds = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    kinds = saved(kinds.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "sizes")
    sources = kinds.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("source_rows"))
    goals = saved(targets(sources.select("source", "source_size")).withColumnRenamed("source", "s").join(sources.drop("source_size"), F.col("s").eqNullSafe(F.col("source"))).drop("s"), "targets")

    rate = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    g = goals.select(F.col("source").alias("s"), "source_size", "target", "source_rows", rate.alias("rate"))
    rows = kinds.join(F.broadcast(g) if _few(goals) else g, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("seq", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).withColumn("whole", F.floor("rate")).withColumn("p", F.col("rate") - F.col("whole"))
    groups = F.ceil(F.col("source_rows") / GROUP)
    rows = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "seq", "size"), groups))

    level, sure = 0, None
    left = rows.where("p > 0 and size > 0").select("source", "group", F.struct("size", "doc_id", "seq", "p").alias("d"))
    while True:
        met = left.groupBy("source", "group").agg(F.collect_list("d").alias("members")).select("source", "group", _round(F.col("members"), level).alias("r"))
        met = saved(met, f"level{level}")
        done = met.select("source", F.explode("r.sure").alias("d"))
        sure = done if sure is None else sure.union(done)
        left = met.select("source", (F.col("group") / GROUP).cast("long").alias("group"), F.col("r.left").alias("d"))
        if not (met.agg(F.max("group")).first()[0] or 0):
            break
        level += 1
    last = F.round("d.p")
    sure = sure.select("source", "d.doc_id", "d.seq", "d.size", "d.p").union(left.select("source", "d.doc_id", "d.seq", "d.size", last))
    sure = sure.toDF("s", "i", "q", "z", "more")
    same = F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("seq") == F.col("q")) & (F.col("size") == F.col("z"))
    copies = (F.col("whole") + F.coalesce("more", F.lit(0.0))).cast("int")
    out = rows.join(sure, same, "left").withColumn("copies", copies)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", "seq")


def _few(table: DataFrame, most: int = 100_000) -> bool:
    """Whether a table of one row per source is small enough to broadcast."""
    return table.count() <= most


def take(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: a row per copy, with ``copy`` from 1 (with
    underscores before it if ``docs`` has such a column)."""
    i, src, z, q, times, size, seq = (unused(docs, n) for n in ("i", "s", "z", "q", "times", "size", "seq"))
    name = "copy" if "copy" not in {c.lower() for c in docs.columns} else unused(docs, "copy")
    chosen = mix(docs).where("copies > 0").select(F.col("doc_id").alias(i), F.col("source").alias(src), F.col("size").alias(z), F.col("seq").alias(q), F.col("copies").alias(times))
    chosen = saved(chosen, "chosen")
    keyed = docs.withColumn(size, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    again = chosen.agg(F.max(q)).first()[0]
    if again and again > 1:
        keyed = keyed.withColumn(seq, F.row_number().over(Window.partitionBy("doc_id", "source", size).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))))
    else:
        keyed = keyed.withColumn(seq, F.lit(1))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & F.col("source").cast("string").eqNullSafe(F.col(src)) & (F.col(size) == F.col(z)) & (F.col(seq) == F.col(q))
    return keyed.join(chosen, same).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), times)).alias(name))
