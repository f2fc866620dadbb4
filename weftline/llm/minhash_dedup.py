"""Near-duplicate documents by a join on the coordinates of MinHash signatures.

A document is the set of its word shingles; its signature has ``COORDINATES``
minima, and each (coordinate, value) pair is a token. Documents of similarity
0.8 or more agree in most coordinates; pairs that agree in at least ``MATCHES``
are candidates, and a candidate is a link once the full sets confirm it.

Documents are posted under their tokens, but not under all of them:

* Prefix: two signatures that agree in ``MATCHES`` of ``COORDINATES`` tokens
  share one of their first ``COORDINATES - MATCHES + 1``, whatever the common
  order of tokens. Tokens are ordered by frequency, rare first, so documents
  are never posted under passages that many share, except the documents that
  consist of such passages.
* Skip: a token of one document posts nothing but takes a place in the prefix,
  so a document without near copies is not posted at all.

Documents with equal sets are one class from the start. The posting lists of a
large group of near copies are merged in rounds rather than as pairs: in each
round some members of a list are its hubs and meet all other members that are
not yet in their component; hubs then leave the list, as all their pairs in it
are decided, and lists that lie within one component leave as well. Rounds go
on, with sixteen times as many hubs each, until no list is left. No pair between
different components goes untested, so the components are those of all links.
Members of long lists are posted anew under their full sets, where the same
prefix needs a fifth of the shingles instead of half the coordinates, and pairs
whose counts of shared shingles rule a link out are left aside.

A large group keeps members outside its component, each of which would meet all
others to show that it has no link. So long lists are posted once more, under
what their members have and the list's first member, the centre, has not, and
the reverse. All members meet the centre. Two members in different components
are not both linked to it, and then a link between them needs more than four
ninths of the smaller difference in common (``centred_lists``). Differences are
mostly edits of one member, so few meet.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.components import components
from weftline.session import Rounds

SHINGLE = 5
THRESHOLD = 80  # percent
COORDINATES, MATCHES = 64, 34  # a pair of similarity 0.8 agrees in fewer with a chance of about 2e-7
PREFIX = COORDINATES - MATCHES + 1
SEED = 2024
WORDS = 400_000  # word hashes remembered per Python worker
CHUNK = 1 << 10  # shingles hashed at a time
LONG_LIST = 16  # members of longer lists are posted under their full sets, which spares pairs and changes no link

_A = np.random.default_rng(SEED).integers(1, 2**63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_B = np.random.default_rng(SEED + 1).integers(0, 2**63, COORDINATES, dtype=np.uint64)


class _Words(dict):
    """64-bit hash of each word seen; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        value = self[word] = struct.unpack("<Q", blake2b(word, digest_size=8).digest())[0]
        return value


def shingles(text: str | None, width: int, words: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words.

    A to Z are lower-cased; words are runs of anything but ASCII white space.
    A text of fewer words is one shingle; one without words has none.
    """
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    size = min(width, len(h))
    mixed = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed += h[k : k + len(mixed)]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed)


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """Minima of ``COORDINATES`` hash functions, 32 bits each."""
    low = np.full(COORDINATES, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(shingle_set), CHUNK):
        part = shingle_set[at : at + CHUNK]
        low = np.minimum(low, ((part * _A[:, None] + _B[:, None]).min(axis=1) >> np.uint64(32)).astype(np.uint32))
    return low.view(np.int32)


def signatures(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, n, class, sig): set size, 16-byte digest of the set, and signature (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            sizes, names, sigs = [], [], []
            for value in batch["text"]:
                s = shingles(value.as_py(), width, words)
                sizes.append(len(s))
                names.append(blake2b(s.tobytes(), digest_size=16).digest())
                sigs.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))], names=["id", "n", "class", "sig"])

    given = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    return given.mapInArrow(run, "id bigint, n bigint, class binary, sig array<int>")


def full_sets(docs: DataFrame, key: str, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """(rep, set): the shingle sets of the wanted documents, one row per id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            sets = [shingles(value.as_py(), width, words).view(np.int64) for value in batch["text"]]
            names = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([batch["rep"], pa.array(names, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "class", "set"])

    given = docs.select(F.col(key).cast("bigint").alias("rep"), F.col(text).alias("text")).join(wanted.select("rep"), "rep", "left_semi")
    made = given.mapInArrow(run, "rep bigint, class binary, set array<bigint>")
    return made.join(wanted.select("rep", "class"), ["rep", "class"], "left_semi").select("rep", "set").dropDuplicates(["rep"])


def postings(reps: DataFrame) -> DataFrame:
    """(token, rep): each class under the tokens of its prefix that others have too."""
    tokens = reps.select("rep", F.posexplode("sig").alias("_c", "_v")).select("rep", (F.col("_c").cast("bigint") * (1 << 32) + (F.col("_v").cast("bigint") + (1 << 31))).alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    shared = tokens.join(often, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("_n", "token"))).alias("_all"))
    # tokens of one document come first in the order and use up the prefix
    room = F.lit(PREFIX - COORDINATES) + F.size("_all")
    return shared.filter(room > 0).select("rep", F.explode(F.slice("_all", F.lit(1), room)).alias("_t")).select("rep", F.col("_t.token").alias("token"))


def shingle_lists(facts: DataFrame, wanted: DataFrame, threshold: int) -> DataFrame:
    """(rep, n, s, tokens): set size, how many shingles other wanted classes have too, and the prefix of those on the full set.

    ``wanted`` has ``rep`` and ``m``, the size of its smallest candidate. Sets
    with a link have at least ``T = t / (1 + t) * (n + m)`` shingles in common,
    so they share one of their first ``n - T + 1`` in order of frequency; those
    of one class come first.
    """
    rows = facts.join(wanted, "rep").select("rep", "m", F.size("set").alias("n"), F.explode("set").alias("_h"))
    often = rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    shared = rows.join(often, "_h").groupBy("rep", "n", "m").agg(F.sort_array(F.collect_list(F.struct("_n", "_h"))).alias("_all"))
    least = F.ceil((F.col("n") + F.col("m")) * threshold / (100 + threshold) - 1e-9).cast("int")
    room = F.size("_all") - least + 1
    return shared.filter(room > 0).select(
        "rep", "n", F.size("_all").alias("s"), F.transform(F.slice("_all", F.lit(1), room), lambda t: t["_h"]).alias("tokens"))


def centred_lists(facts: DataFrame, members: DataFrame, threshold: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Members (centre, rep) compared with their centres, and a function that makes their new postings (token, rep) of the compared, written rows.

    The compared rows are (centre, rep, near, slack, diff): ``diff`` is the
    symmetric difference of both sets. Sets x and y are linked if theirs has at
    most ``r (n_x + n_y)`` elements, where ``r = (1 - t) / (1 + t)``; it has
    ``|D_x| + |D_y| - 2 |D_x & D_y|``. With ``slack = |D| - r n`` a link so takes
    ``(slack_x + slack_y) / 2`` common differences at least. That is more than none
    unless both are near the centre, as ``slack > r n_c`` for one that is not near
    and ``slack >= (1 - r) |D| - r n_c`` for any; those near are linked over it.
    Slacks are multiplied by ``100 + threshold`` to stay whole numbers.
    """
    mine, theirs = facts.select("rep", "set"), facts.select(F.col("rep").alias("centre"), F.col("set").alias("_centre"))
    diff = F.concat(F.array_except("set", "_centre"), F.array_except("_centre", "set"))
    met = members.join(theirs, "centre").join(mine, "rep").select("centre", "rep", F.size("set").alias("_n"), F.size("_centre").alias("_c"), diff.alias("diff"))
    slack = F.size("diff") * (100 + threshold) - F.col("_n") * (100 - threshold)
    compared = met.select("centre", "rep", (slack <= F.col("_c") * (100 - threshold)).alias("near"), slack.alias("slack"), "diff")

    def posted(compared: DataFrame) -> DataFrame:
        # only pairs with a member that is not near are left to decide
        least = compared.groupBy("centre").agg(F.min("slack").alias("_any"), F.min(F.when(~F.col("near"), F.col("slack"))).alias("_far")).filter("_far is not null")
        rows = compared.join(least, "centre").select(
            "centre", "rep", "near", F.ceil((F.col("slack") + F.when(F.col("near"), F.col("_far")).otherwise(F.col("_any"))) / (2 * (100 + threshold))).cast("int").alias("_least"),
            F.explode("diff").alias("_h"))
        often = rows.groupBy("centre", "_h").agg(F.count(F.lit(1)).alias("_n"), F.bool_and("near").alias("_near")).filter("_n > 1 and not _near").select("centre", "_h", "_n")
        shared = rows.join(often, ["centre", "_h"]).groupBy("centre", "rep", "_least").agg(F.sort_array(F.collect_list(F.struct("_n", "_h"))).alias("_all"))
        room = F.size("_all") - F.col("_least") + 1
        return shared.filter(room > 0).select("centre", "rep", F.explode(F.slice("_all", F.lit(1), room)).alias("_t")).select(
            F.xxhash64("centre", "_t._h").alias("token"), "rep")

    return compared, posted


def links(docs: DataFrame, key: str, text: str, width: int, threshold: int, reps: DataFrame, rounds: Rounds) -> DataFrame:
    """(a, b): each linked class with the smallest of its component."""
    spark = docs.sparkSession
    posted = rounds.keep("posted", postings(reps))
    several = posted.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    lists = rounds.keep("lists", posted.join(several, "token"))
    # sets and signatures of posted documents only; the others have no candidate
    wanted = reps.join(lists.select("rep").distinct(), "rep", "left_semi")
    facts = rounds.keep("facts", full_sets(docs, key, text, width, wanted).join(reps.select("rep", "sig"), "rep"))
    # members of long lists are posted anew under their full sets, whose prefix is far shorter; n shingles,
    # of which s are shared at all: a pair has at most min(s) in common, which bounds its similarity
    short = lists.filter(F.col("_n") <= LONG_LIST).select("token", "rep").join(facts.select("rep", F.size("set").alias("n")), "rep")
    in_long = lists.filter(F.col("_n") > LONG_LIST).select("token", "rep").join(facts.select("rep", F.size("set").alias("n")), "rep")
    smallest = in_long.groupBy("token").agg(F.min("n").alias("m"))
    smallest = in_long.select("token", "rep").join(smallest, "token").groupBy("rep").agg(F.min("m").alias("m"))
    longer = rounds.keep("longer", shingle_lists(facts, smallest, threshold))
    anew = longer.select(F.explode("tokens").alias("token"), "rep", "n", "s")
    state = short.select("token", "rep", "n", F.col("n").alias("s")).unionByName(anew).withColumn("comp", F.col("rep"))
    sigs = facts.select("rep", "sig")
    left, right = (facts.select(F.col("rep").alias(c), F.col("set").alias(f"_x{c}")) for c in ("a", "b"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The links among pairs: collisions are counted on the signatures; only pairs above the threshold meet their full sets."""
        counted = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("_sa")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("_sb")), "b")
        collisions = F.size(F.filter(F.zip_with("_sa", "_sb", lambda x, y: x == y), lambda same: same))
        likely = counted.filter(collisions >= MATCHES).select("a", "b")
        common = F.size(F.array_intersect("_xa", "_xb"))
        return likely.join(left, "a").join(right, "b").filter(common * 100 >= (F.size("_xa") + F.size("_xb") - common) * threshold).select("a", "b")

    def merged(stars: DataFrame, near: DataFrame) -> DataFrame:
        return rounds.keep("stars", components(stars.unionByName(near), rounds).select(F.col("node").alias("a"), F.col("component").alias("b")))

    def regrouped(state: DataFrame, stars: DataFrame) -> DataFrame:
        return state.drop("comp").join(stars.select(F.col("a").alias("rep"), F.col("b").alias("_comp")), "rep", "left").select(
            "token", "rep", "n", "s", F.coalesce("_comp", "rep").alias("comp"))

    # the largest partner a member can have: (100 + t) s >= t (n + m)
    reach = F.col("s") * (100 + threshold) - F.col("n") * threshold
    # the member with the fewest shingles of its own comes first: copies are nearest to their original
    score = F.struct(reach - F.col("n") * threshold, -F.col("rep"))
    stars = spark.createDataFrame([], "a bigint, b bigint")
    # before the rounds every member meets the best of its lists' first members, one pair each; large groups are mostly one component after that
    state = rounds.keep("state", state)
    firsts = state.groupBy("token").agg(F.max_by("rep", score).alias("_first"), F.max(score).alias("_score"))
    best = state.join(firsts, "token").groupBy("rep").agg(F.max_by("_first", "_score").alias("a")).select("a", F.col("rep").alias("b")).filter("a != b")
    near = rounds.keep("near", confirmed(best))
    if not near.isEmpty():
        stars = merged(stars, near)
        state = regrouped(state, stars)
    hubs = 1
    while True:
        spread = state.groupBy("token").agg(
            F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.count(F.lit(1)).alias("_m"), F.min("n").alias("_least"), F.max(reach).alias("_reach"),
            F.max_by("rep", score).alias("_first"))
        # out go lists within one component, and members too far from all others of their list
        near_some = (reach >= F.col("_least") * threshold) & (F.col("n") * threshold <= F.col("_reach"))
        state = rounds.keep("state", state.join(spread.filter("_low != _high"), "token").filter(near_some))
        if state.isEmpty():
            return stars
        near, anew = spark.createDataFrame([], "a bigint, b bigint"), None
        if hubs == 1:
            # long lists meet their centre alone, and go on under what their members differ in from it
            in_long = state.filter(F.col("_m") > LONG_LIST)
            compared, posted_anew = centred_lists(facts, in_long.filter("rep != _first").select(F.col("_first").alias("centre"), "rep").distinct(), threshold)
            compared = rounds.keep("compared", compared)
            near = compared.filter("near").select(F.col("centre").alias("a"), F.col("rep").alias("b"))
            anew = posted_anew(compared).join(in_long.select("rep", "n", "s", "comp").distinct(), "rep").select("token", "rep", "n", "s", "comp")
            state = state.filter(F.col("_m") <= LONG_LIST)
        # the member with the fewest shingles of its own is always a hub: copies are nearest to their original
        chance = F.pmod(F.xxhash64("rep", F.lit(hubs)), F.col("_m")) < hubs - 1
        is_hub = (F.col("rep") == F.col("_first")) | chance
        given = state.withColumn("hub", is_hub)
        side = lambda df, name: df.select("token", F.col("rep").alias(name), *[F.col(c).alias(f"_{c}{name}") for c in ("comp", "n", "s", "hub")])
        possible = F.least("_sa", "_sb") * (100 + threshold) >= (F.col("_na") + F.col("_nb")) * threshold
        pairs = side(given.filter("hub"), "a").join(side(given, "b"), "token").filter((F.col("_compa") != F.col("_compb")) & possible)
        # two hubs meet once
        pairs = pairs.filter("not _hubb or a < b").select("a", "b").distinct()
        near = near.unionByName(confirmed(pairs))
        # a member goes to the smallest of its hubs, and so do its other hubs: as many edges as members, and few between hubs
        to_hubs = near.groupBy("b").agg(F.min("a").alias("_low"), F.collect_set("a").alias("_hubs"))
        between = to_hubs.select(F.explode("_hubs").alias("a"), F.col("_low").alias("b"))
        near = rounds.keep("near", to_hubs.select(F.col("b").alias("a"), F.col("_low").alias("b")).unionByName(between).filter("a != b").distinct())
        rest = state.filter(~is_hub).select("token", "rep", "n", "s", "comp")
        if anew is not None:
            rest = rounds.keep("rest", rest.unionByName(anew))
            rounds.drop("compared")
        hubs *= 16
        if near.isEmpty():
            state = rest
            continue
        stars = merged(stars, near)
        state = regrouped(rest, stars)


def near_duplicates(docs: DataFrame, key: str, text: str, *, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(id, n_shingles, class_id, component_id), one row per row of ``docs``.

    ``class_id`` is the smallest id with the same shingle set, ``component_id``
    the smallest id reachable over links; both are the row's own id if its set
    is empty. Rows with a null id are linked with nothing and get nulls. Rows
    that repeat an id are one document: of its texts without a copy under a
    smaller id the one with the smallest digest makes the links. Other columns are ignored. An empty table gives no row.
    """
    rounds = Rounds(docs.sparkSession)
    signed = rounds.keep("signed", signatures(docs, key, text, shingle))
    real = signed.filter(F.col("id").isNotNull() & (F.col("n") > 0))
    # copies meet in a partial aggregate, so a large class sends one row per task
    firsts = rounds.keep("firsts", real.groupBy("class").agg(F.min(F.struct("id", "sig")).alias("_f")).select("class", F.col("_f.id").alias("rep"), F.col("_f.sig").alias("sig")))
    reps = rounds.keep("reps", firsts.groupBy("rep").agg(F.min(F.struct("class", "sig")).alias("_r")).select("rep", "_r.class", "_r.sig"))
    stars = links(docs, key, text, shingle, threshold, reps, rounds).select(F.col("a").alias("rep"), F.col("b").alias("component"))
    rounds.drop("reps", "posted", "lists", "facts", "longer", "state", "rest", "near", "links")
    named = firsts.join(stars, "rep", "left").select("class", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))
    found = signed.join(named, "class", "left")
    own = F.col("id").isNull() | (F.col("n") == 0)
    return found.select("id", F.col("n").alias("n_shingles"), *[F.when(own, F.col("id")).otherwise(F.col(c)).alias(c) for c in ("class_id", "component_id")])
