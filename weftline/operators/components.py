"""Connected components of an edge table, and groups of similar sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftline.session import Rounds


def components(edges: DataFrame, rounds: Rounds | None = None) -> DataFrame:
    """(node, component) for the nodes of the edges (a, b): the smallest node id reachable.

    Alternating star contraction: every node hands its larger neighbours to its
    smallest one, then its smaller ones, until only stars are left. The number
    of rounds grows with the logarithm of the longest path, and a hub's edges
    are aggregated before they are shuffled. A round is a written table, so a
    lost executor costs one round, and the round before is deleted. ``rounds``
    lets a caller delete the last one too.
    """
    rounds = rounds or Rounds(edges.sparkSession)

    def kept(table: DataFrame) -> tuple[DataFrame, tuple]:
        """The written links with their number and the sum of their hashes, both taken while they are written: one job a round."""
        seen = Observation()
        links = rounds.keep("links", table.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("sum")))
        return links, (seen.get["n"], seen.get["sum"])

    links, before = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    while before[0]:
        # large star: every larger neighbour of a node goes to the smallest node around it
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("_low")).select("a", F.least("a", "_low").alias("_low"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_low").alias("b")).distinct()
        # small star: smaller neighbours, and the node itself, go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("_low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "_low"), F.struct(F.col("a").alias("b"), "_low"))).alias("_e"))
        links, now = kept(small.select(F.col("_e.b").alias("a"), F.col("_e._low").alias("b")).filter("a != b").distinct())
        if now == before:
            break
        before = now
    star = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return star.unionByName(star.select(F.col("component").alias("node"), "component").distinct())


def similar_groups(sets: DataFrame, key: str, tokens: str, threshold: float) -> DataFrame:
    """(key, group): rows whose token sets are linked, directly or over others, by a Jaccard similarity of ``threshold`` or more.

    ``group`` is the smallest key of the rows linked. Rows without tokens, and
    rows like no other, are groups of their own. A key is one row; equal sets
    under several keys are one from the start, so copies make no pairs. Sets meet
    under the rare tokens of their prefix: two sets that are similar enough
    share one of their first ``n - ceil(t n) + 1`` in any common order. A list
    of sets under one token is not expanded into pairs: in each round some of
    its members are hubs, which meet all members not yet in their group and
    then leave; there are sixteen times as many hubs in the next round.
    """
    rounds = Rounds(sets.sparkSession)
    given = sets.select(F.col(key).alias("id"), F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t.isNotNull()))).alias("set"))
    given = given.withColumn("_set", F.sha2(F.to_json("set"), 256))
    full = given.filter(F.size("set") > 0)
    reps = rounds.keep("reps", full.groupBy("_set").agg(F.min("id").alias("rep"), F.any_value("set").alias("set")).withColumn("n", F.size("set")))
    rows = reps.select("rep", "n", F.explode("set").alias("token"))
    often = rows.groupBy("token").agg(F.count(F.lit(1)).alias("_n"))
    ordered = rows.join(often, "token").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("_n", "token"))).alias("_all"))
    prefix = F.slice("_all", F.lit(1), F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1)
    posted = ordered.select("rep", "n", F.explode(prefix).alias("_t")).filter("_t._n > 1").select(F.col("_t.token").alias("token"), "rep", "n")
    state = rounds.keep("state", posted.withColumn("group", F.col("rep")))
    stars = sets.sparkSession.createDataFrame([], reps.select(F.col("rep").alias("a"), F.col("rep").alias("b")).schema)
    hubs = 1
    while True:
        lists = state.groupBy("token").agg(F.min("group").alias("_low"), F.max("group").alias("_high"), F.count(F.lit(1)).alias("_m"), F.min("rep").alias("_first"))
        # a list within one group has nothing left to find
        state = rounds.keep("state", state.join(lists.filter("_low != _high"), "token"))
        if state.isEmpty():
            break
        is_hub = (F.col("rep") == F.col("_first")) | (F.pmod(F.xxhash64("rep", F.lit(hubs)), F.col("_m")) < hubs - 1)
        side = lambda df, name: df.select("token", F.col("rep").alias(name), F.col("group").alias(f"_g{name}"), F.col("n").alias(f"_n{name}"))
        fits = F.least("_na", "_nb") >= F.greatest("_na", "_nb") * threshold - 1e-9
        pairs = side(state.filter(is_hub), "a").join(side(state, "b"), "token").filter((F.col("_ga") != F.col("_gb")) & fits)
        pairs = pairs.select("a", "b").distinct()
        left, right = (reps.select(F.col("rep").alias(c), F.col("set").alias(f"_s{c}")) for c in ("a", "b"))
        common = F.size(F.array_intersect("_sa", "_sb"))
        near = pairs.join(left, "a").join(right, "b").filter(common >= (F.size("_sa") + F.size("_sb") - common) * threshold - 1e-9).select("a", "b")
        # a member goes to the smallest of its hubs, and so do its other hubs
        to_hubs = near.groupBy("b").agg(F.min("a").alias("_low"), F.collect_set("a").alias("_hubs"))
        between = to_hubs.select(F.explode("_hubs").alias("a"), F.col("_low").alias("b"))
        near = rounds.keep("near", to_hubs.select(F.col("b").alias("a"), F.col("_low").alias("b")).unionByName(between).filter("a != b").distinct())
        rest = state.filter(~is_hub).select("token", "rep", "n", "group")
        hubs *= 16
        if not near.isEmpty():
            stars = rounds.keep("stars", components(stars.unionByName(near), rounds).select(F.col("node").alias("a"), F.col("component").alias("b")))
            joined = rest.join(stars.select(F.col("a").alias("rep"), F.col("b").alias("_group")), "rep", "left")
            rest = joined.select("token", "rep", "n", F.coalesce("_group", "group").alias("group"))
        state = rounds.keep("state", rest)
    named = reps.join(stars.select(F.col("a").alias("rep"), "b"), "rep", "left").select("_set", F.coalesce("b", "rep").alias("group"))
    return given.join(named, "_set", "left").select(F.col("id").alias(key), F.coalesce("group", "id").alias("group"))
