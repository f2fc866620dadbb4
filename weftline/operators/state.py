"""Run state: hashes, manifests, resume decisions, events and metrics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.patches import FIELD_OPS, apply_field_patches

# Stages of a document run, in order, and the finished states.
STAGES = ("parse", "normalize", "structure", "translate", "render")
DONE = ("success", "skipped", "fallback_source")


def text_hash(col: Column) -> Column:
    return F.sha2(col, 256)


def file_hashes(files: DataFrame) -> DataFrame:
    """Hash per file of a ``binaryFile`` listing (``path``, ``content``)."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def directory_hash(hashes: DataFrame, root: str) -> DataFrame:
    """One hash per directory tree: relative paths and file hashes, sorted.

    Works on the short hash rows, never on file contents.
    """
    # scheme and host go, then the root as plain text
    path = F.regexp_replace(F.col("path"), "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    path, top = F.ltrim(path, F.lit("/")), re.sub("^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).strip("/") + "/"
    relative = F.when(F.startswith(path, F.lit(top)), F.substring(path, len(top) + 1, 1 << 30)).otherwise(path)
    lines = hashes.select(relative.alias("p"), "sha256")
    ordered = F.array_sort(F.collect_list(F.struct("p", "sha256")))
    nul = F.lit("\0")
    return lines.agg(
        F.sha2(F.array_join(F.transform(ordered, lambda x: F.concat(x["p"], nul, x["sha256"], nul)), ""), 256).alias("sha256")
    )


def manifest_skeleton(units: DataFrame, run_id: str, now: str, input_sha256: Column) -> DataFrame:
    """One pending row per work item."""
    return units.select(
        F.lit(run_id).alias("run_id"), "unit_id", F.lit("pending").alias("status"), F.lit(0).alias("attempts"),
        F.lit(now).cast("timestamp").alias("updated_at"), input_sha256.alias("input_sha256"),
        F.lit(None).cast("string").alias("output_ref"),
    )


def input_mismatches(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """Units whose recorded input hash differs from the present one."""
    now = current.select("unit_id", F.col("input_sha256").alias("current_sha256"))
    return manifest.join(now, "unit_id").filter(
        ~F.col("input_sha256").eqNullSafe(F.col("current_sha256"))
    ).select("unit_id", "input_sha256", "current_sha256")


def guarded(manifest: DataFrame, current: DataFrame, force: bool = False) -> DataFrame:
    """The manifest, failing at run time on a changed input unless forced."""
    if force:
        return manifest
    now = current.select("unit_id", F.col("input_sha256").alias("_now"))
    same = F.col("_now").isNull() | F.col("input_sha256").eqNullSafe(F.col("_now"))
    message = F.lit("recorded input hash does not match; rerun with force")
    checked = manifest.join(now, "unit_id", "left").withColumn(
        "status", F.when(same, F.col("status")).otherwise(F.raise_error(message))
    )
    return checked.select(*manifest.columns)


def replay_patches(elements: DataFrame, manifest: DataFrame) -> DataFrame:
    """Apply the patches stored with successful units (``patches`` array)."""
    stored = manifest.filter(F.col("status") == "success").select(
        "doc_id", "unit_id", F.posexplode("patches").alias("_k", "p")
    )
    # units of one document are replayed in unit order
    rows = stored.select("doc_id", F.struct("unit_id", "_k").alias("seq"), "p.*").filter(F.col("op").isin(*FIELD_OPS))
    return apply_field_patches(elements, rows)


def merge_states(manifest: DataFrame, updates: DataFrame) -> DataFrame:
    """New manifest snapshot: the latest row of each unit.

    A union and one aggregation; updates win ties.
    """
    rest = [c for c in manifest.columns if c not in ("run_id", "unit_id")]
    pooled = manifest.withColumn("_rank", F.lit(0)).unionByName(updates.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    newest = F.max_by(F.struct(*rest), F.struct("updated_at", "_rank")).alias("s")
    return pooled.groupBy("run_id", "unit_id").agg(newest).select("run_id", "unit_id", *[F.col(f"s.{c}").alias(c) for c in rest])


def stage_event(events: DataFrame, now: Column | None = None) -> DataFrame:
    """Events ready to append: second resolution, UTC, kept where given."""
    stamp = F.date_trunc("second", now if now is not None else F.current_timestamp())
    given = F.col("timestamp") if "timestamp" in events.columns else F.lit(None).cast("timestamp")
    return events.withColumn("timestamp", F.coalesce(given, stamp))


def pending_outputs(expected: DataFrame, existing: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Work whose output does not exist yet."""
    return expected if force else expected.join(existing.select(*keys).distinct(), keys, "left_anti")


def resume_plan(states: DataFrame, artifacts: DataFrame, config: DataFrame) -> DataFrame:
    """Every (stage, unit) with what to do and why.

    Reuse needs a completed state, the artifact with the recorded hash, and
    unchanged config and input. A run that died leaves ``running``: pending.
    ``config``: stage, config_hash, input_hash (one row per stage).
    """
    found = artifacts.select("stage", "unit_id", F.col("sha256").alias("artifact_sha256"))
    current = config.select("stage", F.col("config_hash").alias("now_config"), F.col("input_hash").alias("now_input"))
    joined = states.join(found, ["stage", "unit_id"], "left").join(current, "stage", "left")
    reason = (
        F.when(F.col("status") == "running", "stale running")
        .when(F.col("status") != "completed", "not completed")
        .when(F.col("artifact_sha256").isNull(), "artifact missing")
        .when(F.col("artifact_sha256") != F.col("sha256"), "artifact changed")
        .when(~F.col("config_hash").eqNullSafe(F.col("now_config")), "config changed")
        .when(~F.col("input_hash").eqNullSafe(F.col("now_input")), "input changed")
    )
    status = F.when(F.col("status") == "running", "pending").otherwise(F.col("status"))
    return joined.select(
        "stage", "unit_id", status.alias("status"), reason.isNull().alias("reuse"), F.coalesce(reason, F.lit("valid")).alias("reason")
    )


def config_hash(settings: DataFrame, key: str = "stage") -> DataFrame:
    """Hash of the settings of each stage in canonical (sorted) JSON.

    ``settings``: stage, name, value; a stage has a handful of names.
    """
    pairs = F.array_sort(F.collect_list(F.struct("name", "value")))
    text = F.to_json(F.map_from_entries(pairs))
    return settings.groupBy(key).agg(F.sha2(text, 256).alias("config_hash"))


def invalidated_stages(old: DataFrame, new: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """Reuse or invalidate per stage: a change spoils every later stage.

    ``old``/``new``: stage, config_hash. The stage list is fixed and short.
    """
    spark = old.sparkSession
    order = spark.createDataFrame([(i, s) for i, s in enumerate(stages)], "stage_no int, stage string")
    was = old.select("stage", F.col("config_hash").alias("was"))
    now = new.select("stage", F.col("config_hash").alias("now"))
    joined = order.join(was, "stage", "left").join(now, "stage", "left")
    changed = (~F.col("was").eqNullSafe(F.col("now"))).cast("int")
    so_far = F.max(changed).over(Window.orderBy("stage_no").rowsBetween(Window.unboundedPreceding, 0))
    return joined.select("stage_no", "stage", F.when(so_far == 1, "invalidate").otherwise("reuse").alias("action"))


def only_pages(elements: DataFrame, pages: list[int]) -> DataFrame:
    """Elements that touch one of the pages to be reprocessed."""
    return elements.filter(F.arrays_overlap("pages", F.array(*[F.lit(p) for p in pages])))


#: Size of a quantile sketch, and the error of a rank it leaves.
SKETCH_PRECISION, RANK_ERROR = 200, 0.0165


def stage_metrics(events: DataFrame) -> DataFrame:
    """Volume, failures and duration per stage."""
    return events.groupBy("stage").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("error_type").isNotNull()).alias("errors"),
        F.avg("duration_ms").alias("avg_ms"), F.max("duration_ms").alias("max_ms"),
        F.percentile_approx("duration_ms", 0.95).alias("p95_ms"),
    )


def duration_sketches(events: DataFrame, keys: tuple[str, ...] = ("run_id", "stage"), precision: int = SKETCH_PRECISION) -> DataFrame:
    """(keys, events, errors, durations): per run and stage, a quantile sketch of the durations that later runs are merged with.

    ``durations`` is a KLL sketch of a size that does not grow with the events;
    with the default ``precision`` the rank of a quantile is off by at most
    ``RANK_ERROR``, with 99 % confidence. Null durations are not counted in it.
    """
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("error_type").isNotNull()).alias("errors"),
        F.kll_sketch_agg_bigint(F.col("duration_ms").cast("bigint"), precision).alias("durations"))


def merged_durations(sketches: DataFrame, keys: tuple[str, ...] = ("stage",), quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(keys, events, errors, p50_ms, p95_ms, ...): the sketches of several runs as one; no event is read again."""
    merged = sketches.groupBy(*keys).agg(
        F.sum("events").alias("events"), F.sum("errors").alias("errors"), F.kll_merge_agg_bigint("durations").alias("_d"))
    some = F.kll_sketch_get_n_bigint("_d") > 0
    named = {f"p{round(q * 100)}_ms": F.when(some, F.kll_sketch_get_quantile_bigint("_d", F.lit(q))) for q in quantiles}
    return merged.select(*keys, "events", "errors", *[c.alias(n) for n, c in named.items()])


def settled_states(events: DataFrame, now: Column, patience: str) -> DataFrame:
    """(stage, unit_id, status, ts, ...): the last state of each unit; ``running`` without a sign of life for ``patience`` is ``pending``.

    ``events``: stage, unit_id, ts, status and further fields of the state; of
    events at the same time the one with the greatest status counts.
    """
    rest = [c for c in events.columns if c not in ("stage", "unit_id")]
    last = events.groupBy("stage", "unit_id").agg(F.max_by(F.struct(*rest), F.struct("ts", "status")).alias("s")).select("stage", "unit_id", "s.*")
    stale = (F.col("status") == "running") & (F.col("ts") + F.expr(f"interval {patience}") <= now)
    return last.withColumn("status", F.when(stale, "pending").otherwise(F.col("status"))).select(*events.columns)


def errors_by_type(events: DataFrame) -> DataFrame:
    return events.filter(F.col("error_type").isNotNull()).groupBy("stage", "error_type").agg(F.count(F.lit(1)).alias("errors"))


def usage_totals(attempts: DataFrame) -> DataFrame:
    """Tokens and cost per run and model."""
    return attempts.groupBy("run_id", "model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"),
    )
