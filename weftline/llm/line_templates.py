"""Line dedup with a log-template tree.

A line is parsed through a tree of fixed depth: its number of tokens, then its
leading tokens; tokens that hold a digit are variable fields, ``<*>``. Lines
that agree in all tokens are one template. A line of which too few tokens are
constant, a row of numbers or a sentence without spaces, has no fields: it is
the same only as its exact text. A leaf whose lines do not recur by themselves
is generalised: the lines with the same frequent tokens at the same positions
are a group, its other positions are fields, each group that recurs is a
template, and the lines that have all its tokens fit it. So a leaf may hold
several templates and foreign lines besides. Templates that recur across
documents are boilerplate; their lines are dropped everywhere. The longer a
line, the fewer documents it takes.

Copies of a document repeat all their lines without any being boilerplate. So
recurrence is counted in families: the connected components of near copies.
Each document has a sketch, the smallest hashes of its units of a few words; documents
that post two neighbouring hashes in common are compared with two of those that do, and are
linked if the sketches say that enough of both texts is the same. Versions
that drift apart are linked through those between them; a passage in otherwise
different texts links nothing.

Lines are counted as hashes. Only templates and leaves in enough documents
meet the families, tokens are made once for each distinct line of a leaf to be
generalised, and the texts are cut in place after one join with the positions
each document loses.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.arrays import let
from weftline.operators.components import components
from weftline.session import Rounds

FIELD = "<*>"
SPACE = r"[\x20\x09\x0B-\x0D]+"
MASKED = r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*"  # a token with a digit, looked for at the beginnings of tokens only
DEPTH = 3  # leading tokens in a path of the tree
LEAST_CONSTANT = 0.5  # share of tokens without a digit that lets a line have fields
LEAST_FAMILIES = 10  # families that make a template of up to SHORT tokens recur
LONG_FAMILIES, SHORT = 3, 10  # a longer line takes proportionally fewer families, but so many at least
CONSTANT = 0.6  # share of positions a general template must keep
UNITS = r"[bdfhjlnprtvxz.,;:!?] "  # ends of units: a few words each, cut by what they end with, so that an edit changes only its own
ALIKE = 0.5  # least share of units that near copies have in common
SKETCH, POSTED = 32, 16  # hashes of a sketch, and the smallest of them, under which copies are looked for
BROADCAST_ROWS = 50_000  # hashes broadcast at most, by count; more are joined


def has_any(text: Column, characters: str) -> Column:
    """True if the text holds one of the characters: plain scans, which cost less than a pattern where most texts have none."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in characters])


def squeezed(text: Column) -> Column:
    """The text with one space for every run of blanks inside a line."""
    return F.when(F.contains(text, F.lit("  ")) | has_any(text, "\t\r\x0b\x0c"), F.regexp_replace(text, SPACE, " ")).otherwise(text)


def templates_of(text: Column, least_constant: float) -> Column:
    """Per line of a squeezed text its template: the tokens with fields, one space between; empty for a line without a token."""
    count = lambda x, token: F.length(x) - F.length(F.replace(x, F.lit(token), F.lit("")))
    plain = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    masked = F.transform(F.split(F.regexp_replace(text, MASKED, "\x00"), "\n"), lambda x: F.trim(x))

    def fields(line: Column, mask: Column) -> Column:
        enough = count(mask, "\x00") <= (count(line, " ") + 1) * (1 - least_constant)
        return F.when(F.contains(mask, F.lit("\x00")) & enough, F.replace(mask, F.lit("\x00"), F.lit(FIELD))).otherwise(line)

    return F.when(F.rlike(text, F.lit("[0-9]")), F.zip_with(plain, masked, fields)).otherwise(plain)


def hashed_lines(text: Column, depth: int, least_constant: float) -> Column:
    """Per line with a token: ``pos``, the hash of its ``template``, its ``size`` in tokens, and ``leaf``, the hash of its path in the tree."""
    def line(x: Column, i: Column) -> Column:
        return let(F.size(F.split(x, " ")), lambda size: F.struct(
            i.alias("pos"), F.xxhash64(x).alias("template"), size.alias("size"), F.when(size > depth + 1, path(x, size, depth)).alias("leaf")))

    return F.filter(F.transform(templates_of(text, least_constant), line), lambda x: x["template"] != F.xxhash64(F.lit("")))


def path(template: Column, size: Column, depth: int) -> Column:
    """Hash of the path of a line in the tree."""
    return F.xxhash64(size, F.substring_index(template, " ", depth))


def sketch_of(text: Column, size: int) -> Column:
    """The ``size`` smallest hashes of the units of a squeezed text; of a long text only hashes small enough to be among them are sorted."""
    # a line ends a unit too; one pattern without alternatives costs a fraction
    ended = F.replace(text, F.lit("\n"), F.lit("x "))
    hashes = F.transform(F.split(ended, UNITS), lambda x: F.xxhash64(x))
    # hashes are uniform: about twice as many as needed lie below the bound
    bound = lambda h: (F.lit(-(2.0**63)) + F.lit(2.0**64 * 2 * size) / F.size(h)).cast("bigint")
    small = lambda h: F.when(F.size(h) <= 2 * size, h).otherwise(let(bound(h), lambda b: F.filter(h, lambda x: x <= b)))
    return F.slice(F.sort_array(F.array_distinct(let(hashes, small))), 1, size)


def parsed_texts(docs: DataFrame, doc: Column, text: str, depth: int, least_constant: float, sketch: int) -> DataFrame:
    """(_doc, sketch, lines) of the documents with a token."""
    made = let(squeezed(F.col(text)), lambda t: F.struct(sketch_of(t, sketch).alias("sketch"), hashed_lines(t, depth, least_constant).alias("lines")))
    # generated, not projected: the filter on lines would go below a projection and parse every text a second time
    rows = docs.filter(F.col(text).isNotNull()).select(doc.alias("_doc"), F.explode(F.array(made)).alias("_l"))
    return rows.select("_doc", "_l.*").filter(F.size("lines") > 0)


def few(df: DataFrame) -> DataFrame:
    """``df``, broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def families(kept: Rounds, sketches: DataFrame, alike: float, size: int, posted: int) -> DataFrame:
    """(_doc, family) of the near copies in ``sketches`` (_doc, sketch); a document like no other has no row.

    Documents with equal sketches are one at once. A list of documents that
    post the same pair of hashes is compared with two of its members, not among
    itself.
    """
    named = sketches.withColumn("_class", F.xxhash64("sketch"))
    classes = kept.keep("classes", named.groupBy("_class").agg(F.min("_doc").alias("_rep"), F.first("sketch").alias("sketch")))
    # each hash with its follower: a single one may be of a few common words, which most texts have
    pairs = F.transform(F.slice("sketch", 1, posted), lambda x, i: F.xxhash64(x, F.get("sketch", i + 1)))
    posts = classes.select("_rep", F.explode(pairs).alias("_hash"))
    lists = posts.groupBy("_hash").agg(F.min("_rep").alias("_low"), F.max("_rep").alias("_high")).filter("_low != _high")
    hubs = posts.join(lists, "_hash").select("_rep", F.explode(F.array("_low", "_high")).alias("_hub")).filter("_hub != _rep").distinct()
    theirs = classes.select(F.col("_rep").alias("_hub"), F.col("sketch").alias("_theirs"))
    low = F.slice(F.sort_array(F.array_union("sketch", "_theirs")), 1, size)
    # most pairs have too little in common at all, which one pass over both tells
    enough = lambda both: F.size(both) >= F.least(F.lit(size), F.size("sketch") + F.size("_theirs") - F.size(both)) * alike
    same = let(F.array_intersect("sketch", "_theirs"), lambda both: F.when(
        enough(both), let(low, lambda all_: F.size(F.array_intersect(all_, both)) >= F.size(all_) * alike)).otherwise(False))
    links = hubs.join(classes, "_rep").join(theirs, "_hub").filter(same).select(F.col("_rep").alias("a"), F.col("_hub").alias("b"))
    found = components(links, kept).select(F.col("node").alias("_rep"), F.col("component").alias("family"))
    families_of = classes.join(found, "_rep", "left").select("_class", F.coalesce("family", "_rep").alias("family"))
    return kept.keep("families", named.select("_doc", "_class").join(families_of, "_class").filter("family != _doc").select("_doc", "family"))


def general_templates(kept: Rounds, rest: DataFrame, docs: DataFrame, depth: int, least_families: int, constant: float, least_constant: float) -> DataFrame:
    """(template): hashes of the lines that fit a recurring general template; ``rest`` (_doc, leaf, template, family) are lines not dropped yet, ``docs`` (_doc, _body) the texts."""
    leaves = rest.groupBy("leaf").agg(F.count_distinct("family").alias("_n")).filter(F.col("_n") >= least_families).select("leaf")
    leaves = kept.keep("leaves", leaves)
    opened = rest.join(few(leaves), "leaf", "left_semi").groupBy("leaf", "template", "family").agg(F.min("_doc").alias("_doc"))
    kinds = kept.keep("kinds", opened)
    if kinds.isEmpty():
        return kinds.select("template")
    # the words of the distinct lines, each from one document that has it
    shown = kept.keep("shown", kinds.groupBy("leaf", "template").agg(F.min("_doc").alias("_doc")))
    wanted = docs.join(few(shown.select("_doc").distinct()), "_doc", "left_semi")
    words = wanted.select("_doc", F.explode(templates_of(squeezed(F.col("_body")), least_constant)).alias("_words")).filter("_words != ''")
    sized = words.withColumn("size", F.size(F.split("_words", " ")))
    lines = sized.select("_doc", path(F.col("_words"), F.col("size"), depth).alias("leaf"), F.xxhash64("_words").alias("template"), "size", "_words")
    lines = lines.join(few(shown), ["_doc", "leaf", "template"], "left_semi").groupBy("leaf", "template").agg(F.first("size").alias("size"), F.first("_words").alias("_words"))
    in_families = kinds.groupBy("leaf", "template").agg(F.count_distinct("family").alias("_in"))
    lines = kept.keep("lines", lines.join(in_families, ["leaf", "template"]))
    # a token at its place goes on as a hash, and a row per token holds no list: a line may have thousands of them. The joins below are merged,
    # as the size of a written table says nothing of the rows made from its lists
    placed = lines.select("leaf", "template", "size", "_in", F.posexplode(F.split("_words", " ")).alias("_place", "_token")).filter(F.col("_token") != FIELD)
    tokens = placed.select("leaf", "template", "size", "_in", "_place", F.xxhash64("_place", "_token").alias("_token"))
    frequent = tokens.groupBy("leaf", "_token").agg(F.sum("_in").alias("_n")).filter(F.col("_n") >= least_families)
    ordered = tokens.join(frequent.hint("merge"), ["leaf", "_token"]).groupBy("leaf", "template", "size").agg(
        F.sort_array(F.collect_list(F.struct("_n", "_place", "_token"))).alias("_ordered"))
    behind = F.filter("_ordered", lambda x: x["_place"] >= depth)  # after the path, the rarest first
    ordered = ordered.filter((F.size("_ordered") >= F.col("size") * constant) & (F.size(behind) >= (F.col("size") - depth) / 2))
    named = lambda x: F.transform(x, lambda y: y["_token"])
    held = kept.keep("held", ordered.select("leaf", "template", named("_ordered").alias("_held"), named(behind).alias("_behind")).withColumn("_set", F.xxhash64("_held")))
    groups = kinds.join(held.select("leaf", "template", "_set").hint("merge"), ["leaf", "template"]).groupBy("leaf", "_set").agg(F.count_distinct("family").alias("_n"))
    groups = kept.keep("groups", groups.filter(F.col("_n") >= least_families).select("leaf", "_set"))
    # equal lists are compared once
    sets = kept.keep("sets", held.groupBy("leaf", "_set").agg(F.first("_held").alias("_held"), F.first("_behind").alias("_behind")))
    sought = sets.join(groups.hint("merge"), ["leaf", "_set"]).select(
        "leaf", F.col("_set").alias("_group"), F.get("_behind", F.lit(0)).alias("_rarest"), F.col("_held").alias("_needed"))
    # a line that fits has the group's rarest token too, so only such lines are compared
    asked = sets.select("leaf", "_set", F.size("_held").alias("_size"), F.explode("_behind").alias("_rarest"))
    met = asked.join(sought.select("leaf", "_rarest", "_group", F.size("_needed").alias("_least")).hint("merge"), ["leaf", "_rarest"])
    met = met.filter((F.col("_set") != F.col("_group")) & (F.col("_size") > F.col("_least"))).select("leaf", "_set", "_group")
    compared = met.join(sought.select("leaf", "_group", "_needed").hint("merge"), ["leaf", "_group"]).join(sets.select("leaf", "_set", "_held").hint("merge"), ["leaf", "_set"])
    more = compared.filter(F.size(F.array_except("_needed", "_held")) == 0).select("leaf", "_set")
    fit = groups.unionByName(more).distinct()
    return held.select("leaf", "template", "_set").join(fit.hint("merge"), ["leaf", "_set"]).select("template").distinct()


def drop_recurring_lines(
    docs: DataFrame, key: str, text: str, *, depth: int = DEPTH, least_families: int = LEAST_FAMILIES, long_families: int = LONG_FAMILIES, short: int = SHORT,
    constant: float = CONSTANT, least_constant: float = LEAST_CONSTANT, alike: float = ALIKE, sketch: int = SKETCH, posted: int = POSTED,
) -> DataFrame:
    """All columns of ``docs`` with recurring lines cut from the text, and ``n_dropped`` (bigint).

    A line of up to ``short`` tokens recurs in ``least_families`` families of
    near copies, a longer one in proportionally fewer, ``long_families`` at
    least; general templates take ``least_families``. ``sketch`` and ``posted``
    say how closely copies are looked for: with the defaults a copy with 90 %
    of its units is linked with a chance above 0.999.

    Lines without a token are kept and never counted. A null text stays null,
    an empty one empty; a text all of whose lines recur becomes empty. Rows
    with the same id (null ids included) and text count once and are cut
    alike. A column called ``n_dropped`` is replaced. An empty table stays empty.
    """
    rounds = Rounds(docs.sparkSession)
    columns = [c for c in docs.columns if c != "n_dropped"]
    doc = F.xxhash64(F.col(key), F.col(text))
    parsed = rounds.keep("parsed", parsed_texts(docs, doc, text, depth, least_constant, sketch))
    # rows that repeat a document count once: counts are of distinct documents wherever a document could repeat
    family_of = families(rounds, parsed.select("_doc", "sketch"), alike, sketch, posted)
    once = F.array_distinct(F.transform("lines", lambda x: F.struct(x["template"], x["leaf"], x["size"])))
    seen = parsed.select("_doc", F.explode(once).alias("_x")).select("_doc", "_x.*")
    needed = F.greatest(F.lit(long_families), F.least(F.lit(least_families), F.ceil(F.lit(least_families * short) / F.col("size")))).cast("int")
    often = seen.groupBy("template", "size").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= needed).select("template")
    full = seen.filter("leaf is not null").groupBy("leaf").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least_families).select("leaf")
    often, full = rounds.keep("often", often), rounds.keep("full", full)
    with_family = lambda rows: rows.join(family_of, "_doc", "left").withColumn("family", F.coalesce("family", "_doc"))
    direct = with_family(seen.join(few(often), "template", "left_semi").select("_doc", "template", "size"))
    direct = direct.groupBy("template", "size").agg(F.count_distinct("family").alias("_n")).filter(F.col("_n") >= needed).select("template")
    direct = rounds.keep("direct", direct)
    rest = with_family(seen.join(few(full), "leaf", "left_semi").join(few(direct), "template", "left_anti").select("_doc", "leaf", "template"))
    bodies = docs.filter(F.col(text).isNotNull()).select(doc.alias("_doc"), F.col(text).alias("_body"))
    general = general_templates(rounds, rest, bodies, depth, least_families, constant, least_constant)
    gone = rounds.keep("gone", direct.unionByName(general))
    places = parsed.select("_doc", F.explode("lines").alias("_x")).select("_doc", "_x.template", "_x.pos").join(few(gone), "template", "left_semi")
    lost = rounds.keep("lost", places.groupBy("_doc").agg(F.collect_set("pos").alias("_lost")))
    rounds.drop("parsed", "classes", "links", "families", "often", "full", "direct", "leaves", "kinds", "shown", "lines", "held", "groups", "sets", "gone")
    whole = docs.select(F.struct(*[docs[c] for c in columns]).alias("_row"), doc.alias("_doc"))
    # texts meet their positions by document at every size; a broadcast of the positions would be bounded by nothing
    found = whole.join(lost.hint("merge"), "_doc", "left")
    body = F.col("_row").getField(text)
    # array_except keeps the order and looks positions up by hash
    left = let(F.split(body, "\n"), lambda parts: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "_lost"), lambda i: F.get(parts, i)))
    cut = F.when(F.col("_lost").isNull() | body.isNull(), body).otherwise(F.array_join(left, "\n"))
    shown = [cut.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in columns]
    return found.select(*shown, F.when(body.isNull() | F.col("_lost").isNull(), F.lit(0)).otherwise(F.size("_lost")).cast("bigint").alias("n_dropped"))
