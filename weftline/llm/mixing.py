"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. Within a source each document is to be
taken ``e`` times on average, in proportion to a weight of the document; its
whole copies, ``floor(e)``, are certain, and the fraction is its inclusion
probability ``p`` in an unequal-probability sample of fixed size (in words).
The sample ranks the documents by random odds over inclusion odds,
``(u / (1 - u)) / (p / (1 - p))``, and takes the lowest until the words are
used up. ``u`` is a hash of the id, so reruns agree on any partitioning.

No document group is ever ordered as a whole: a histogram of the ranks gives
each source's cut, refined twice, and only the rows of the last bucket, about a
millionth of a source, are ordered. Texts are never shuffled: they are read
once for their sizes and once for the result, which looks its decision up in a
table with one row per source and weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ordering import number_rows
from weftline.session import durable

WORDS = r"[^\x20\x09-\x0D]+"
#: Buckets of a histogram level; two levels are used.
BUCKETS = 1024
#: The decision table is broadcast up to this many counted rows, else joined.
BROADCAST_ROWS = 50_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("bigint")


def size_weight(size: Column) -> Column:
    """Binary digits of the size: longer documents are a little likelier to be repeated."""
    return F.length(F.bin(size)).cast("double")


def targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(name, source_size, target) per source from (name, source, source_size).

    Sources in code-point order, null last, weigh ``weights`` in turn. A target
    stops at ``cap`` times the source's size; what is cut off is shared again by
    weight until no target is above.
    """
    placed = number_rows(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "name"], name="_place")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    placed = placed.withColumn("_w", F.get(turn, ((F.col("_place") - 1) % len(weights)).cast("int"))).withColumn("_most", F.lit(float(cap)) * F.col("source_size"))
    level, full = 0.0, -1
    while True:  # one short row per round comes to the driver; each round fills at least one more source
        over = F.col("_most") <= F.lit(level) * F.col("_w")
        row = placed.agg(
            F.sum("source_size"), F.sum(F.when(over, F.col("_most"))), F.sum(F.when(~over, F.col("_w"))), F.sum(over.cast("int")),
        ).first()
        total, used, left, now_full = row[0] or 0, row[1] or 0.0, row[2], row[3] or 0
        if left is None or now_full == full:
            break
        full, level = now_full, (total - used) / left
    return placed.select("name", "source_size", F.least(F.col("_most"), F.lit(level) * F.col("_w")).alias("target"))


def decisions(narrow: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Per (name, weight): source_size, target, whole copies, inclusion share, and where the source's sample is cut."""
    classes = narrow.groupBy("name", "source", "weight").agg(F.sum("size").alias("mass"))
    classes = durable(classes)
    goal = targets(classes.groupBy("name", "source").agg(F.sum("mass").alias("source_size")), weights, cap)
    heavier = Window.partitionBy("name").orderBy(F.desc("weight"))  # a few weights per source
    scaled = classes.join(goal, "name").withColumns({
        "_above": F.coalesce(F.sum("mass").over(heavier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_below": F.sum(F.col("weight") * F.col("mass")).over(heavier.rowsBetween(0, Window.unboundedFollowing)),
    })
    # copies = factor * weight, where the heaviest documents stop at the cap and the others share what is left
    factor = F.when(F.col("_below") > 0, (F.col("target") - F.lit(float(cap)) * F.col("_above")) / F.col("_below")).otherwise(0.0)
    scaled = scaled.withColumn("_factor", factor)
    fits = F.when(F.col("_factor") * F.col("weight") <= F.lit(float(cap)), F.struct("weight", "_factor"))
    scaled = scaled.withColumn("_factor", F.max(fits).over(Window.partitionBy("name")).getField("_factor"))
    copies = F.greatest(F.lit(0.0), F.coalesce(F.least(F.lit(float(cap)), F.col("_factor") * F.col("weight")), F.lit(float(cap))))
    plan = scaled.withColumn("_copies", copies).select(
        "name", "weight", "mass", "source_size", "target", F.floor("_copies").cast("bigint").alias("whole"), (F.col("_copies") - F.floor("_copies")).alias("share"),
    )
    plan = durable(plan)
    rest = plan.groupBy("name").agg((F.max("target") - F.sum(F.col("whole") * F.col("mass"))).alias("_rest"))
    drawn = ranks(small_join(narrow, plan.select("name", "weight", "share"), ["name", "weight"]).filter(F.col("share") > 0))
    drawn = durable(drawn.select("name", "_id", "size", "_rank", "_bucket"))
    coarse = boundary(drawn, F.floor(F.col("_bucket") / BUCKETS), rest)
    inside = small_join(drawn, coarse, ["name"]).filter(F.floor(F.col("_bucket") / BUCKETS) == F.col("_cut")).drop("_cut", "_rest")
    fine = boundary(inside, F.col("_bucket"), coarse.select("name", "_rest"))
    last = small_join(inside, fine, ["name"]).filter(F.col("_bucket") == F.col("_cut"))
    before = F.sum("size").over(Window.partitionBy("name").orderBy("_rank", "_id").rowsBetween(Window.unboundedPreceding, -1))
    taken = last.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") + F.col("size") / 2 <= F.col("_rest"))
    edge = taken.groupBy("name").agg(F.max(F.struct("_rank", "_id")).alias("_edge"))
    cut = fine.select("name", F.col("_cut").alias("cut_bucket")).join(edge, "name", "left")
    return plan.drop("mass").join(cut, "name", "left").select(
        "name", "weight", "source_size", "target", "whole", "share", "cut_bucket", F.col("_edge._rank").alias("cut_rank"), F.col("_edge._id").alias("cut_id"),
    )


def boundary(rows: DataFrame, bucket: Column, rest: DataFrame) -> DataFrame:
    """(name, _cut, _rest): the bucket in which a source's words run out, and the words left for it; no row if they suffice for all."""
    sums = rows.groupBy("name", bucket.cast("bigint").alias("_cut")).agg(F.sum("size").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("name").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("_before", F.coalesce(before, F.lit(0))).join(rest, "name")
    crossing = sums.filter((F.col("_before") <= F.col("_rest")) & (F.col("_before") + F.col("_sum") > F.col("_rest")))
    return durable(crossing.select("name", "_cut", (F.col("_rest") - F.col("_before")).alias("_rest")))


def ranks(df: DataFrame) -> DataFrame:
    """Random odds over inclusion odds, and the rank's place among all buckets of both levels."""
    rank = (F.col("_u") / (1 - F.col("_u"))) / (F.col("share") / (1 - F.col("share")))
    placed = df.withColumn("_rank", F.when(F.col("share") > 0, rank))
    return placed.withColumn("_bucket", F.floor(F.col("_rank") / (1 + F.col("_rank")) * BUCKETS * BUCKETS).cast("bigint"))


def small_join(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Join with a table that is broadcast only if its counted rows are few."""
    return rows.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on)


def mix(docs: DataFrame, key: str, text: str, source: str, *, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """All columns of ``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (``copies * size``).

    ``size`` is the number of words of the whole text, 0 for a null one. A null
    source is a source of its own, other than the empty name. Rows draw by id and
    text, so different texts under one id, or without an id, are drawn apart;
    rows that repeat both are taken alike. Columns of these names are
    replaced. An empty table stays empty; if no text has a word, every target is 0.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in docs.columns if c not in made]
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("binary")), 1, 13)
    facts = {
        "name": F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")),
        "_id": F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63))),
        "_u": (F.conv(digits, 16, 10).cast("bigint") + 0.5) / float(1 << 52),
    }
    sized = docs.select(F.struct(*[docs[c] for c in kept]).alias("_row"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *[c.alias(n) for n, c in facts.items()])
    sized = sized.withColumn("weight", size_weight(F.col("size")))
    plan = durable(decisions(durable(sized.drop("_row")), weights, cap))
    found = ranks(small_join(sized, plan, ["name", "weight"]))
    past = F.coalesce(F.col("cut_bucket"), F.lit(BUCKETS * BUCKETS + 1))
    within = (F.col("_rank") < F.col("cut_rank")) | ((F.col("_rank") == F.col("cut_rank")) & (F.col("_id") <= F.col("cut_id")))
    drawn = (F.col("share") > 0) & ((F.col("_bucket") < past) | ((F.col("_bucket") == past) & within))
    copies = F.col("whole") + F.coalesce(drawn, F.lit(False)).cast("bigint")
    return found.select("_row.*", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
