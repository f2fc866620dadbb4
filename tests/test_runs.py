"""Requests, sketches, live states, Markdown files and secret tables against plain Python."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from test_documents import arrays
from weftline.functions.cleaning import clean_text
from weftline.functions.coerce import lines_of
from weftline.functions.redact import redact_table
from weftline.operators import chunking, elements, glossary, matching, rendering, state, translation
from weftline.plans import registry, render_queries
from weftline.sources import sinks
from weftline.streaming import stage_states

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("segment_rows", [1, 3, 7, 4096])
def test_requests_do_not_depend_on_segments(spark, segment_rows):
    rng = random.Random(1)
    docs, expected = [], {}
    for doc in range(4):
        texts = [{"label": "title", "text": f"Book {doc}"}]
        section, open_, filled, number = 0, None, 0, -1
        for i in range(1, 90):
            if rng.random() < 0.05:
                texts.append({"label": "section_header", "text": f"S{i}"})
                section, open_ = i, None
                continue
            text = "x" * rng.choice([1, 5, 9, 20, 30, 55])
            texts.append({"label": "text", "text": text})
            if open_ is None:
                open_, number, filled = [], 0, 0
            if filled and filled + len(text) > 40:
                number, filled = number + 1, 0
            filled += len(text)
            expected.setdefault((doc, section, number), []).append((f"#/texts/{i}", text))
            open_.append(i)
        docs.append({"texts": texts})
    flat = elements.element_table(arrays(spark, *docs))
    made = chunking.translation_requests(flat, limit=40, segment_rows=segment_rows).collect()
    assert {(r.doc_id, r.section_pos, r.request_no): [(i.id, i.text) for i in r["items"]] for r in made} == expected
    assert all(r.document_title == f"Book {r.doc_id}" and r.chars == sum(len(i.text) for i in r["items"]) for r in made)
    assert chunking.translation_requests(flat.limit(0), segment_rows=segment_rows).count() == 0


def test_merged_sketches_are_within_their_error(spark):
    rng = random.Random(4)
    rows = [(run, "render", rng.randrange(10**6), None if rng.random() < 0.9 else "E") for run in range(7) for _ in range(3000)] + [(0, "none", None, None)]
    log = spark.createDataFrame(rows, "run_id int, stage string, duration_ms long, error_type string")
    merged = {r.stage: r for r in state.merged_durations(state.duration_sketches(log)).collect()}
    times = sorted(r[2] for r in rows if r[2] is not None)
    for q, value in ((0.5, merged["render"].p50_ms), (0.95, merged["render"].p95_ms), (0.99, merged["render"].p99_ms)):
        assert abs(sum(t <= value for t in times) / len(times) - q) < 2 * state.RANK_ERROR
    assert merged["render"].events == len(times) and merged["render"].errors == sum(r[3] is not None for r in rows)
    assert merged["none"].p95_ms is None and merged["none"].events == 1


def test_live_states_equal_the_batch(spark, tmp_path):
    rng = random.Random(6)
    base = 1_767_225_600
    log = [("render", f"u{rng.randrange(8)}", rng.choice(["running", "running", "completed", "failed"]), base + 60 * i) for i in range(80)]
    log += [("render", "dead", "running", base + 30), ("render", "late", "completed", base + 60 * 70)]
    log.sort(key=lambda r: r[3])
    end = base + 60 * 200
    (tmp_path / "in").mkdir()
    for k in range(5):
        part = [log[i] for i in range(len(log)) if i * 5 // len(log) == k]
        if k == 4:
            part.append(("clock", "tick", "completed", end))
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("stage", "unit_id", "status", "ts"), r, strict=True))) for r in part))
        os.utime(tmp_path / "in" / f"{k}.json", (time.time() - 100 + k, time.time() - 100 + k))
    raw = spark.readStream.schema("stage string, unit_id string, status string, ts long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    live = stage_states.live_states(raw.withColumn("ts", F.timestamp_seconds("ts")), 600)
    query = live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append")
    query.trigger(availableNow=True).start().awaitTermination(120)
    seen = spark.read.parquet(str(tmp_path / "out"))
    # a state made pending has the time of its last event, so it comes after the running state of that time
    last = seen.groupBy("stage", "unit_id").agg(F.max_by("status", F.struct("ts", (F.col("status") == "pending").alias("p"))).alias("status"))
    events = spark.createDataFrame(log, "stage string, unit_id string, status string, ts long").withColumn("ts", F.timestamp_seconds("ts"))
    batch = state.settled_states(events, F.timestamp_seconds(F.lit(end)), "600 seconds")
    expected = {(r.stage, r.unit_id): r.status for r in batch.collect()}
    assert expected["render", "dead"] == "pending" and "completed" in expected.values()
    assert {(r.stage, r.unit_id): r.status for r in last.filter("stage = 'render'").collect()} == expected


def test_markdown_files(spark, tmp_path):
    docs = spark.createDataFrame([(f"a/b {i}", f"# {i}\n\nä") for i in range(25)] + [("empty", None)], "doc_id string, markdown string").repartition(4)
    for fanout, pattern in ((0, "*.md"), (3, "*/*.md")):
        path = tmp_path / f"out{fanout}"
        sinks.write_markdown_files(docs, str(path), fanout=fanout)
        files = {p.name: p.read_text() for p in path.glob(pattern)}
        assert files == {f"a%2Fb%20{i}.md": f"# {i}\n\nä" for i in range(25)} | {"empty.md": ""}
        assert (path / "_SUCCESS").exists() and not list(path.glob("_temporary*"))
    sinks.write_markdown_files(docs.limit(1), str(tmp_path / "out0"))  # overwrites
    assert len(list((tmp_path / "out0").glob("*.md"))) == 1


def test_a_killed_task_leaves_no_half_file(spark, tmp_path):
    def broken(batches):
        for batch in batches:
            yield batch
        raise ValueError("lost")

    docs = spark.createDataFrame([(str(i), "text " * 1000) for i in range(20)], "doc_id string, markdown string").repartition(2)
    with pytest.raises(Exception, match="lost"):
        sinks.write_markdown_files(docs.mapInArrow(broken, docs.schema), str(tmp_path / "out"))
    files = list((tmp_path / "out").rglob("*.md"))
    assert all(p.read_text() == "text " * 1000 for p in files)
    assert not (tmp_path / "out" / "_SUCCESS").exists() and not list((tmp_path / "out").glob("_temporary*"))


def test_ten_thousand_secrets(spark):
    rng = random.Random(9)
    letters = "abcdefgh"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    secrets = [word(rng.randrange(4, 12)) for _ in range(10_000)] + ["ab", "z", "", None]
    texts = [" ".join(word(rng.randrange(2, 14)) for _ in range(60)) + rng.choice(["", rng.choice(secrets[:100])]) for _ in range(40)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, body string")
    table = spark.createDataFrame([(s,) for s in secrets], "s string")
    expected = {}
    ordered = sorted({s for s in secrets if s}, key=lambda s: (-len(s), s))
    for i, text in enumerate(texts):
        for s in ordered:
            text = text.replace(s, "\0") if text else text
        expected[i] = text.replace("\0", "[REDACTED]") if text else text
    assert {r.k: r.body for r in redact_table(df, "body", table, "s", ("k",)).collect()} == expected
    assert redact_table(df, "body", table.limit(0), "s", ("k",)).count() == len(texts)


def test_terms_in_blocks(spark):
    texts = spark.createDataFrame([(1, "the cathedral of the cat"), (2, "dog"), (3, None)], "k int, t string")
    terms = spark.createDataFrame([(w,) for w in ("cat", "cathedral", "dog", "the", "x", "", "of the cat")], "w string")
    whole = set(map(tuple, matching.term_hits(texts, terms, "t", "w", ("k",)).collect()))
    assert whole == {(1, "cat"), (1, "cathedral"), (1, "the"), (1, "of the cat"), (2, "dog")}
    assert set(map(tuple, matching.term_hits(texts, terms, "t", "w", ("k",), block_chars=12).collect())) == whole
    entries = spark.createDataFrame([("Cat", "a", "", ""), ("CAT", "b", "", ""), ("Dog", "c", "", "")], "english string, japanese string, genre string, description string")
    assert sorted((r.k, r.english) for r in glossary.matches(texts, entries, "t", ("k",)).collect()) == [(1, "CAT"), (1, "Cat"), (2, "Dog")]


def test_captions_and_edited_cells_reach_the_translated_markdown(spark):
    doc = {
        "texts": [{"label": "section_header", "text": "Results"}, {"label": "text", "text": "Body text."}, {"label": "code", "text": "x = 1"}, {"label": "text", "text": "Not in memory."}],
        "tables": [{"caption": "Table 1", "data": {"grid": [["Two words", "A-1"], ["Other words", ""]], "table_cells": [{"row": 1, "col": 0, "text": "Edited words"}]}}],
    }
    flat = elements.element_table(arrays(spark, doc))
    known = ["Results", "Body text.", "Table 1", "Two words", "Edited words", "A-1"]
    memory = spark.createDataFrame([(t, f"ja {t}", 1) for t in known], "s string, translated_text string, updated_at int").select(F.sha2("s", 256).alias("source_sha256"), "translated_text", "updated_at")
    made = rendering.render_translated(flat, memory, elements.cell_table(flat)).first().markdown
    assert made == (
        "## Results / ja Results\n\nja Body text.\n\n```\nx = 1\n```\n\nNot in memory.\n\n**Table 1 / ja Table 1**\n\n"
        "| ja Two words | A-1 |\n| --- | --- |\n| ja Edited words |  |\n")


def physical_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_and_secrets_are_found_inside_the_row(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abc \t🦖") for _ in range(rng.randrange(1, 24))) for _ in range(400)]
    texts = ["".join(rng.choice("abc \n\t🦖") for _ in range(rng.randrange(120))) for _ in range(40)] + ["", None]
    index = matching.TermIndex(sorted({w for w in words if w}))
    for text in texts[:-1]:
        assert index.hits(text) == {w for w in words if w in text}
    df = spark.createDataFrame(list(enumerate(texts)), "k int, body string")
    secrets = spark.createDataFrame([(w,) for w in words], "s string")
    expected = {}
    for k, text in enumerate(texts):
        for w in sorted(set(words), key=lambda w: (-len(w), w)) if text else ():
            text = text.replace(w, "\x00")
        expected[k] = text and text.replace("\x00", "[REDACTED]")
    done = redact_table(df, "body", secrets, "s", ("k",))
    assert {r.k: r.body for r in done.collect()} == expected
    assert "Exchange" not in physical_plan(done) and "Join" not in physical_plan(done)
    several = matching.term_arrays(df, secrets, "body", "s", ("k",), "found", block_chars=900).collect()
    assert {r.k: r.found for r in several} == {k: sorted({w for w in words if t and w in t}) for k, t in enumerate(texts)}


def test_glossary_entries_are_selected_inside_the_row(spark):
    rng = random.Random(6)
    entries = spark.createDataFrame(
        [(w, f"ja {w}", "g" if len(w) % 2 else "", "") for w in sorted({"".join(rng.choice("abAB") for _ in range(rng.randrange(1, 4))) for _ in range(60)})],
        "english string, japanese string, genre string, description string")
    docs = spark.createDataFrame([(i, "".join(rng.choice("abAB ") for _ in range(12))) for i in range(30)] + [(30, None)], "doc_id int, source_text string")
    whole = glossary.with_prompt_terms(docs, entries, limit=9, keys=("doc_id",))
    assert "Exchange" not in physical_plan(whole)
    rows = glossary.select_entries(docs, entries, limit=9, keys=("doc_id",), block_chars=80)
    assert {(r.doc_id, r.glossary_text) for r in whole.collect()} == {(r.doc_id, r.glossary_text) for r in glossary.prompt_terms(rows, ("doc_id",)).collect()}
    names = sorted(r.english for r in entries.collect())
    for doc, text in ((r.doc_id, r.source_text or "") for r in docs.collect()):
        hits = [n for n in names if n.lower() in text.lower()]
        ranked = sorted((r.rank, r.english, r.matched) for r in rows.filter(F.col("doc_id") == doc).collect()) if doc in (0, 30) else None
        if ranked is not None:
            picked = (hits + [n for n in names if n not in hits])[:9]
            assert ranked == [(i + 1, n, n in hits) for i, n in enumerate(picked)]


@pytest.mark.parametrize("fanout", [0, 3])
def test_markdown_files_are_read_by_their_tasks(spark, tmp_path, fanout):
    rows = {("a/b c", "x\n"), ("2", ""), ("ü", "y" * 50), ("3.md", "# 🦖\r\n")}
    path = str(tmp_path / "out")
    sinks.write_markdown_files(spark.createDataFrame(sorted(rows), "doc_id string, markdown string"), path, fanout=fanout)
    back = sinks.read_markdown_files(spark, path, fanout=fanout)
    assert {tuple(r) for r in back.collect()} == rows
    assert "FileScan" not in physical_plan(back)  # no list of all files in the plan


def test_translated_batches_are_bounded_by_their_text(spark):
    texts = [f"{i} " + "x" * 300_000 for i in range(40)] + ["", "a", None]

    def translate(batch):
        if batch.str.len().sum() > 2 * translation.BATCH_BYTES:
            raise ValueError("too much at once")
        return "ja " + batch

    docs = spark.createDataFrame(list(enumerate(texts)), "k int, source_text string").coalesce(1)
    done = translation.plug_translate(docs, translate)
    assert {r.k: r.translated_text for r in done.collect()} == {k: None if t is None else f"ja {t}" for k, t in enumerate(texts)}


def test_missing_parts_of_an_entry_stay_missing(spark):
    entries = spark.createDataFrame([("cat", "a", None, ""), ("dog", "b", "g", None)], "english string, japanese string, genre string, description string")
    docs = spark.createDataFrame([(1, "a cat")], "k int, source_text string")
    rows = glossary.select_entries(docs, entries, keys=("k",)).orderBy("rank").select("english", "genre", "description", "matched").collect()
    assert [tuple(r) for r in rows] == [("cat", None, "", True), ("dog", "g", None, False)]


@pytest.mark.parametrize("name", ["document_translated", "document_render_tables"])
def test_documents_are_parsed_once_for_all_their_parts(spark, name):
    plan = physical_plan(render_queries.Q[name](spark, SF))
    assert "from_json" not in plan and "documents.parquet" not in plan


def test_lines_end_with_any_break_and_a_last_break_adds_none(spark):
    texts = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\r\n", "a b\x0b", None]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(lines_of(F.col("t")).alias("l")).collect()
    assert [r.l for r in found] == [[], ["a"], ["a"], ["a", ""], [""], ["a", "b"], ["a", "b"], None]


@pytest.mark.parametrize("name", ["translation_requests", "fragment_merge_columns", "translated_elements", "patch_sequence"])
def test_lines_are_made_once_for_all_their_readers(spark, name):
    plan = physical_plan(registry.queries()[name](spark, SF))
    assert "split(text" not in plan and "from_json" not in plan


def test_texts_are_normalized_once_per_row(spark):
    plan = physical_plan(registry.queries()["normalize_patches"](spark, SF))
    assert not [line for line in plan.splitlines() if "Filter" in line and "regexp_replace" in line]


def test_single_blanks_stay_and_runs_shrink(spark):
    texts = ["a b", "a  b", "a\tb", "a \t b", "\x0b", "a\f\fb", " x  ", "https://e.x/a  b\t\tc"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(clean_text(F.col("t")).alias("c")).collect()
    assert [r.c for r in found] == ["a b", "a b", "a b", "a b", " ", "a b", " x ", "https://e.x/a b c"]


def test_secrets_in_blocks_shuffle_no_text(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abc \n🦖") for _ in range(rng.randrange(2, 20))) for _ in range(300)]
    texts = ["".join(rng.choice("abc \n🦖") for _ in range(rng.randrange(150))) for _ in range(30)] + ["", None, "c" * 40]
    df = spark.createDataFrame([(k, k % 2, t) for k, t in enumerate(texts)], "k int, other int, body string").unionAll(spark.createDataFrame([(0, 0, texts[0])], "k int, other int, body string"))
    secrets = spark.createDataFrame([(w,) for w in [*words, "", None, words[0]]], "s string")
    expected = []
    for k, other, text in map(tuple, df.collect()):
        parts = None if text is None else [text]
        for w in sorted(set(words), key=lambda w: (-len(w), w)) if text else ():
            parts = [x for part in parts for x in part.split(w)]
        expected.append((k, other, None if text is None else "[REDACTED]".join(parts)))
    for chars in (200, 1500, 1_000_000):
        done = matching.replace_terms(df, secrets, "body", "s", "[REDACTED]", chars)
        assert sorted(map(tuple, done.collect()), key=str) == sorted(expected, key=str)
        assert "Exchange" not in physical_plan(done) and "Join" not in physical_plan(done)


def test_only_secrets_are_redacted(spark):
    """What stands in for a mark meanwhile is in no text, whatever the text holds."""
    df = spark.createDataFrame([(1, "a\0b secret\x01"), (2, "\0"), (3, "sec\0ret \0")], "k int, body string")
    found = redact_table(df, "body", spark.createDataFrame([("secret",), ("\0r",)], "s string"), "s", ("k",))
    assert {r.k: r.body for r in found.collect()} == {1: "a\0b [REDACTED]\x01", 2: "\0", 3: "sec[REDACTED]et \0"}
