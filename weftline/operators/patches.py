"""Structural patches: intake, field changes, reordering, review routing."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.coerce import strip
from weftline.functions.elements import FENCE
from weftline.operators.ordering import segmented_last
from weftline.operators.rows import unpack

# Patch operations and the element column each one sets.
FIELD_OPS = {"set_text": "text", "set_label": "label", "set_level": "level"}
UNIT_CHARS = 500
_PATCH = "struct<op:string,ref:string,text:string,label:string,level:int,refs:array<string>,reason:string,confidence:double>"


def page_units(elements: DataFrame) -> DataFrame:
    """Text elements with the review unit of their first page, in unit order.

    One row per element: a unit is the rows that share ``unit_id``.
    """
    texts = elements.filter(F.col("grp") == "texts")
    page = F.coalesce(F.get("pages", F.lit(0)), F.lit(0))
    return texts.select(
        "doc_id", page.alias("page_no"), F.format_string("page-%04d", page).alias("unit_id"), "idx", "ref", "label", "text"
    )


def structure_units(elements: DataFrame, unit_chars: int = UNIT_CHARS) -> DataFrame:
    """Text elements as short one-line units for structure review, cut at ``unit_chars``."""
    line = F.replace(F.col("raw_text"), F.lit("\n"), F.lit(" "))
    return elements.filter(F.col("grp") == "texts").select(
        "doc_id", "idx", "ref", F.col("pages").alias("page"), "label", "level", F.substring(line, 1, unit_chars).alias("text")
    )


@F.pandas_udf(T.StringType())
def _embedded_object(raw: pd.Series, key: pd.Series) -> pd.Series:
    """First JSON object inside a text; with a key, the first one that has it."""
    decoder = json.JSONDecoder()

    def find(text: str, wanted: str) -> str | None:
        at = text.find("{")
        while at >= 0:
            try:
                value, _ = decoder.raw_decode(text, at)
            except ValueError:
                value = None
            if isinstance(value, dict) and (not wanted or wanted in value):
                return json.dumps(value, ensure_ascii=False)
            at = text.find("{", at + 1)
        return None

    return pd.Series([find(t, k) if t else None for t, k in zip(raw, key)], dtype="object")


def _payload(raw: Column, key: str) -> Column:
    """JSON text of a response that parses whole or inside a fence, else NULL: the rest is searched in Python.

    With a ``key`` a whole text counts whatever it is, and a fenced one only as
    an object with that key; without one, both count as objects only.
    """
    whole = strip(raw)
    unfenced = strip(F.regexp_extract(whole, "(?s)^" + FENCE + r"\w*\n(.*)\n" + FENCE + r"$", 1))

    def parsed(text: Column, test: Callable[[Column], Column]) -> Column:
        return F.when(F.coalesce(test(F.try_parse_json(text)), F.lit(False)), text)

    def is_object(value: Column) -> Column:
        return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))

    def has_key(value: Column) -> Column:
        return is_object(value) & F.try_variant_get(value, f"$.{key}", "variant").isNotNull()

    tests = (lambda v: v.isNotNull(), has_key) if key else (is_object, is_object)
    return F.coalesce(parsed(whole, tests[0]), parsed(F.nullif(unfenced, F.lit("")), tests[1]))


def read_responses(responses: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Patch rows and rejected responses.

    ``strict``: only the three field operations, each with a ref, and one bad
    patch rejects its whole response. Otherwise every patch object passes.
    """
    key = "patches" if strict else ""
    base = responses.select("unit_id", strip(F.col("raw")).alias("raw"))
    base = base.withColumn("_native", _payload(F.col("raw"), key))
    easy = base.filter(F.col("_native").isNotNull()).withColumn("_json", F.col("_native"))
    rest = base.filter(F.col("_native").isNull()).withColumn("_json", _embedded_object(F.col("raw"), F.lit(key)))
    found = easy.unionByName(rest).drop("_native")
    listed = F.from_json(F.get_json_object("_json", "$.patches"), f"array<{_PATCH}>")
    is_list = F.coalesce(
        F.startswith(F.schema_of_variant(F.try_variant_get(F.try_parse_json("_json"), "$.patches", "variant")), F.lit("ARRAY")),
        F.lit(False),
    )
    typed = found.withColumn("_patches", F.when(is_list, listed))
    valid_op = lambda p: p["op"].isin(*FIELD_OPS) & (F.coalesce(p["ref"], F.lit("")) != "")
    sound = F.forall("_patches", lambda p: F.coalesce(valid_op(p), F.lit(False))) if strict else F.lit(True)
    reason = (
        F.when(F.col("raw") == "", "response was empty")
        .when(F.col("_json").isNull(), F.concat(F.lit("no patches object in response: "), F.substring(F.replace(F.col("raw"), F.lit("\n"), F.lit("\\n")), 1, 120)))
        .when(F.col("_patches").isNull(), "response must be an object with a patches array")
        .when(~sound, "invalid patch object")
    )
    judged = typed.withColumn("reason", reason)
    good = unpack(judged.filter(F.col("reason").isNull()), ["unit_id"], F.col("_patches"), "seq", "p")
    patches = good.filter(F.col("p").isNotNull()).select("unit_id", "seq", "p.*")
    return patches, judged.filter(F.col("reason").isNotNull()).select("unit_id", "reason")


def _target(df: DataFrame) -> DataFrame:
    """Split a positional ref into group and index; anything else is no target."""
    shape = r"^#/(texts|tables|pictures)/(\d+)$"
    plain = F.replace(F.replace(F.col("ref"), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    return df.withColumn("_grp", F.nullif(F.regexp_extract(plain, shape, 1), F.lit(""))).withColumn(
        "_idx", F.nullif(F.regexp_extract(plain, shape, 2), F.lit("")).try_cast("int")
    )


def _new_value() -> Column:
    by_op = F.when(F.col("op") == "set_text", F.col("text")).when(F.col("op") == "set_label", F.col("label"))
    return by_op.when(F.col("op") == "set_level", F.col("level").cast("string"))


def patch_audit(elements: DataFrame, patches: DataFrame) -> DataFrame:
    """Outcome of each field patch with the value before and after it.

    The value before is the one set by the previous patch on the same field,
    else the element's own.
    """
    aimed = _target(patches).withColumn("after", _new_value())
    own = elements.select(
        "doc_id", F.col("grp").alias("_grp"), F.col("idx").alias("_idx"), F.lit(True).alias("_known"),
        F.col("text").alias("_text"), F.col("label").alias("_label"), F.col("level").cast("string").alias("_level"),
    )
    # only elements that a patch addresses come along with their texts
    own = own.join(aimed.select("doc_id", "_grp", "_idx").distinct(), ["doc_id", "_grp", "_idx"], "left_semi")
    joined = aimed.join(own, ["doc_id", "_grp", "_idx"], "left")
    original = (
        F.when(F.col("op") == "set_text", F.col("_text")).when(F.col("op") == "set_label", F.col("_label"))
        .when(F.col("op") == "set_level", F.col("_level"))
    )
    error = (
        F.when(~F.col("op").isin(*FIELD_OPS), F.concat(F.lit("unsupported patch op: "), F.coalesce("op", F.lit("null"))))
        .when(F.col("_known").isNull(), F.concat(F.lit("unknown ref: "), F.coalesce("ref", F.lit("null"))))
        .when(F.col("after").isNull(), "patch has no value")
    )
    judged = joined.withColumn("_own", original).withColumn("error", error)
    effective = F.when(F.col("error").isNull(), F.struct(F.col("after").alias("v")))
    seen = segmented_last(judged, ["doc_id", "ref", "op"], "seq", {"_before": effective}, include_current=False)
    ok = F.col("error").isNull()
    return seen.select(
        "doc_id", "seq", "ref", "op", F.when(ok, "success").otherwise("failed").alias("status"),
        F.when(ok, F.coalesce(F.col("_before.v"), F.col("_own"))).alias("before"),
        F.when(ok, F.col("after")).alias("after"), "error",
    )


def apply_field_patches(elements: DataFrame, patches: DataFrame) -> DataFrame:
    """Elements with the last patch of each field applied; one join in all."""
    aimed = _target(patches).filter(F.col("op").isin(*FIELD_OPS) & F.col("_grp").isNotNull())
    aimed = aimed.withColumn("after", _new_value()).filter(F.col("after").isNotNull())
    last = aimed.groupBy("doc_id", F.col("_grp").alias("grp"), F.col("_idx").alias("idx")).agg(
        *[
            F.max_by("after", F.when(F.col("op") == op, F.col("seq"))).alias(f"_new_{field}")
            for op, field in FIELD_OPS.items()
        ]
    )
    merged = elements.join(last, ["doc_id", "grp", "idx"], "left")
    fields = {
        field: F.coalesce(F.col(f"_new_{field}").cast(dict(elements.dtypes)[field]), F.col(field))
        for field in FIELD_OPS.values()
    }
    return merged.withColumns(fields).select(*elements.columns)


def order_problems(elements: DataFrame, orders: DataFrame, complete: bool = False) -> DataFrame:
    """Documents whose requested order is unusable, with the reason.

    Unknown and duplicate refs always count, missing ones only where the
    order must be ``complete``.
    """
    known = elements.filter(F.col("grp") == "texts").select("doc_id", "ref", F.lit(1).alias("k"), F.lit(0).alias("w"))
    wanted = orders.select("doc_id", F.explode("refs").alias("ref"), F.lit(0).alias("k"), F.lit(1).alias("w"))
    concerned = orders.select("doc_id").distinct()
    tally = (
        known.join(concerned, "doc_id", "left_semi").unionByName(wanted)
        .groupBy("doc_id", "ref").agg(F.sum("k").alias("k"), F.sum("w").alias("w"))
    )
    counts = tally.groupBy("doc_id").agg(
        F.count_if((F.col("k") == 0) & (F.col("w") > 0)).alias("unknown_refs"),
        F.count_if(F.col("w") > 1).alias("duplicate_refs"),
        F.count_if((F.col("k") > 0) & (F.col("w") == 0)).alias("missing_refs"),
    )
    bad = (F.col("unknown_refs") > 0) | (F.col("duplicate_refs") > 0)
    if complete:
        bad = bad | (F.col("missing_refs") > 0)
    return counts.filter(bad)


def reorder_texts(elements: DataFrame, orders: DataFrame) -> DataFrame:
    """Listed texts first in the given order, the rest after them as before.

    All or nothing per document. ``order_major``/``order_minor`` hold the new
    order; :func:`apply_patches` also rewrites ``idx`` so that positional refs follow.
    """
    sound = orders.join(order_problems(elements, orders), "doc_id", "left_anti")
    places = sound.select("doc_id", F.posexplode("refs").alias("_place", "ref"))
    texts = elements.filter(F.col("grp") == "texts")
    return texts.join(places, ["doc_id", "ref"], "left").select(
        *elements.columns,
        F.when(F.col("_place").isNull(), 1).otherwise(0).alias("order_major"),
        F.coalesce("_place", "idx").alias("order_minor"),
    )


def text_orders(elements: DataFrame, patches: DataFrame) -> DataFrame:
    """(doc_id, seqs, orders): the reorders of each document and the order of its texts after each of them.

    ``orders`` has one entry more than ``seqs``: the original positions, in the
    order before the first reorder, after the first, and so on. A reorder that
    names a ref twice or an unknown one changes nothing. One row per document
    that has a reorder; an order is an array of one index per text.
    """
    asked = patches.filter(F.col("op") == "reorder_texts").select("doc_id", "seq", "refs")
    texts = elements.filter(F.col("grp") == "texts").join(asked.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "idx", "ref")
    sizes = texts.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    named = asked.select("doc_id", "seq", F.posexplode("refs").alias("_place", "ref"))
    known = texts.groupBy("doc_id", "ref").agg(F.min("idx").alias("idx"))
    moves = named.join(known, ["doc_id", "ref"], "left").groupBy("doc_id", "seq").agg(
        F.array_sort(F.collect_list(F.struct("_place", "idx"))).alias("_moves"), F.count_if(F.col("idx").isNull()).alias("_unknown"))
    front = F.transform("_moves", lambda m: m["idx"])
    sound = moves.filter((F.col("_unknown") == 0) & (F.size(F.array_distinct(front)) == F.size("_moves")))
    listed = sound.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", front.alias("front")))).alias("_all"))
    whole = listed.join(sizes, "doc_id")
    start = F.array(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: (i - 1).cast("int")))
    turned = lambda all_, m: F.concat(all_, F.array(F.concat(m["front"], F.array_except(F.element_at(all_, -1), m["front"]))))
    return whole.select("doc_id", F.transform("_all", lambda m: m["seq"]).alias("seqs"), F.aggregate("_all", start, turned).alias("orders"))


def apply_patches(elements: DataFrame, patches: DataFrame) -> DataFrame:
    """Field patches and reorders in sequence.

    A positional ref means the element at that place at that moment. The
    reorders of a document are composed inside its row; each field patch on a
    text is led back to the text's original position through the order in
    force at its place in the sequence. Then all field patches are applied at
    once and the last order numbers the texts: one pass, no job while planning.
    """
    orders = text_orders(elements, patches)
    aimed = _target(patches.filter(F.col("op").isin(*FIELD_OPS)))
    on_texts = aimed.filter("_grp = 'texts'").select("doc_id", F.struct(*[c for c in aimed.columns if c != "doc_id"]).alias("_patch"))
    moved = on_texts.join(orders.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list("_patch").alias("_patches")).join(orders, "doc_id")
    at = lambda p: F.get(F.get("orders", F.size(F.filter("seqs", lambda s: s < p["seq"]))), p["_idx"])
    led = F.transform("_patches", lambda p: F.struct(p.alias("p"), at(p).alias("original")))
    back = unpack(moved, ["doc_id"], led).select("doc_id", "p.*", "original").filter(F.col("original").isNotNull())
    back = back.withColumn("ref", F.concat(F.lit("#/texts/"), F.col("original").cast("string"))).select(*patches.columns)
    still = aimed.filter("_grp <> 'texts'").unionByName(aimed.filter("_grp = 'texts'").join(orders.select("doc_id"), "doc_id", "left_anti")).select(*patches.columns)
    done = apply_field_patches(elements, still.unionByName(back))
    last = unpack(orders, ["doc_id"], F.element_at("orders", -1), "_new", "_old").select("doc_id", F.lit("texts").alias("grp"), F.col("_old").alias("idx"), "_new")
    return done.join(last, ["doc_id", "grp", "idx"], "left").withColumn("idx", F.coalesce("_new", "idx")).select(*elements.columns)


def route_patches(patches: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Confident patches to apply, the rest for review."""
    sure = F.coalesce(F.col("confidence") >= threshold, F.lit(False))
    return patches.filter(sure), patches.filter(~sure)


def merge_elements(elements: DataFrame, merges: DataFrame) -> DataFrame:
    """Merge operations: texts of the listed refs move to the first one.

    ``merges``: doc_id, refs, kind (``merge`` or ``group_as_code``). The size of
    a merged group is the length of its ref list.
    """
    parts = merges.select(
        "doc_id", F.get("refs", F.lit(0)).alias("_head"), "kind", F.posexplode("refs").alias("_place", "ref")
    )
    hit = elements.join(parts, ["doc_id", "ref"])
    grouped = hit.groupBy("doc_id", "_head", "kind").agg(
        F.array_sort(F.collect_list(F.struct("_place", "text"))).alias("_parts")
    )
    texts = F.transform("_parts", lambda p: p["text"])
    joined = F.when(F.col("kind") == "group_as_code", F.array_join(texts, "\n")).otherwise(F.array_join(texts, " "))
    heads = grouped.select("doc_id", F.col("_head").alias("ref"), joined.alias("_text"), F.col("kind").alias("_kind"))
    swallowed = parts.filter(F.col("_place") > 0).select("doc_id", "ref")
    left = elements.join(swallowed, ["doc_id", "ref"], "left_anti").join(heads, ["doc_id", "ref"], "left")
    label = F.when(F.col("_kind") == "group_as_code", F.lit("code")).otherwise(F.col("label"))
    return left.withColumn("text", F.coalesce("_text", "text")).withColumn("label", label).select(*elements.columns)
