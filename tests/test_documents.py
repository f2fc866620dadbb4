import json
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.functions.cleaning import blank_symbol_cell, clean_text, normalize_text
from weftline.functions.elements import page_ranges
from weftline.functions.redact import mask_secrets, redact_known
from weftline.operators import blocks, chunking, elements, glossary, ordering, patches, rendering, translation


def value(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t"))).first()[0]


def arrays(spark, *docs):
    rows = [(i, json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)]
    return elements.element_arrays(spark.createDataFrame(rows, "doc_id long, payload string"))


def test_cleaning(spark):
    noisy = "Wait......  see https://example.com/a...b and ・・・・・・・・ now ----"
    assert value(spark, noisy, clean_text) == "Wait... see https://example.com/a...b and ・・・ now ---"
    assert value(spark, "See   https://example.com/a---b .... ----", normalize_text) == "See https://example.com/a---b ... ---"
    assert value(spark, "a______https://x.y/____b ======\n\n\n\nc", clean_text) == "a___https://x.y/____b ===\n\nc"
    once = value(spark, noisy, clean_text)
    assert value(spark, once, clean_text) == once


@pytest.mark.parametrize("cell, kept", [("......", ""), ("------", ""), ("……", ""), ("Version...", "Version..."), ("A-1", "A-1"), ("1.2.3", "1.2.3")])
def test_symbol_cells(spark, cell, kept):
    assert value(spark, cell, blank_symbol_cell) == kept


def test_masking(spark):
    assert value(spark, "sk-abcdefgh1234", mask_secrets) == "***"
    assert value(spark, "Authorization: Bearer abc", mask_secrets) == "Authorization: Bearer ***"
    assert value(spark, "X-Api-Key: k1", mask_secrets) == "X-Api-Key: ***"
    assert value(spark, "key secret-api-key", lambda c: redact_known(c, "secret-api-key")) == "key [REDACTED]"


def test_page_ranges(spark):
    df = spark.createDataFrame([([1, 2, 3, 5],), ([],), ([9, 7, 8, 7],)], "p array<int>")
    assert [r[0] for r in df.select(page_ranges(F.col("p"))).collect()] == ["1-3,5", "unknown", "7-9"]


def test_code_is_left_alone(spark):
    doc = {"texts": [{"label": "code", "text": "x    =    '......'"}, {"label": "text", "text": "a....."}]}
    changes = elements.change_log(elements.clean_elements(elements.element_table(arrays(spark, doc)))).collect()
    assert [(c.node_ref, c.before_chars, c.after_chars) for c in changes] == [("#/texts/1", 6, 4)]


def test_normalising(spark):
    doc = {
        "texts": [{"label": "text", "text": "print('x')\nimport os"}, {"text": "A   B"}],
        "tables": [{"data": {"table_cells": [{"text": "A   B", "row": 0, "col": 0}, {"text": "C....", "row": 0, "col": 1}]}}],
    }
    flat = elements.element_table(arrays(spark, doc))
    rows = elements.normalization_patches(flat, elements.cell_table(flat)).orderBy("ref").collect()
    assert [(r.ref, r.after) for r in rows] == [
        ("#/tables/0/data/table_cells/0", "A B"), ("#/tables/0/data/table_cells/1", "C..."), ("#/texts/1", "A B"),
    ]


def test_grid_cells_and_strings(spark):
    doc = {"tables": [{"data": {"grid": [["a", {"text": "b"}], [{"content": "c"}]]}}]}
    flat = elements.element_table(arrays(spark, doc))
    assert rendering.tables_markdown(elements.rendered_cells(flat)).first().markdown == "| a | b |\n| --- | --- |\n| c |  |"


def test_heading_and_body_stay_together(spark):
    page = [{"page_no": 1}]
    doc = {"texts": [{"label": "section_header", "level": 2, "text": "Strategy", "prov": page}, {"text": "The department will act.", "prov": page}]}
    rows = chunking.build_chunks(arrays(spark, doc), 10, 30).collect()
    assert [(r.header_path, r.page_numbers) for r in rows] == [(["## Strategy"], [1])]


def test_table_is_one_chunk(spark):
    cells = [{"row": r, "col": c, "text": t} for r, line in enumerate((("Term", "Meaning"), ("DoD", "Department of Defense " * 20))) for c, t in enumerate(line)]
    rows = chunking.build_chunks(arrays(spark, {"tables": [{"data": {"table_cells": cells}}]}), 10, 20).collect()
    assert len(rows) == 1 and rows[0].kind == "table" and rows[0].source_text.startswith("| Term | Meaning |")


def test_header_path_by_length(spark):
    doc = {"texts": [x for n, (level, name) in enumerate(((1, "A"), (3, "B"), (3, "C"), (2, "D"))) for x in ({"label": "heading", "level": level, "text": name}, {"label": "code", "text": f"x{n}"})]}
    paths = [r.header_path for r in chunking.build_chunks(arrays(spark, doc)).orderBy("chunk_no").collect() if r.kind == "code"]
    assert [[p.lstrip("# ") for p in path] for path in paths] == [["A"], ["A", "B"], ["A", "B", "C"], ["A", "D"]]


def packed_by_hand(blocks, low, high):
    """The packing rules, step by step, for one document."""
    chunks, path, pending = [], [], []

    def flush():
        if pending:
            chunks.append(("text", list(path), [b["ref"] for b in pending]))
            pending.clear()

    for b in blocks:
        if b["kind"] == "code":
            flush()
            chunks.append(("code", list(path), [b["ref"]]))
            continue
        if b["kind"] == "heading":
            path[b["level"] - 1:] = [b["md"]]
            if pending and sum(len(x["md"]) for x in pending) >= low:
                flush()
        pending.append(b)
        if b["kind"] == "text" and not re.match(r"#{1,6}\s", b["md"]) and sum(len(x["md"]) for x in pending) >= high:
            flush()
    flush()
    return chunks


@pytest.mark.parametrize("segment_rows", [None, 1, 3, 8, 5000])
def test_packing_in_segments_equals_packing_by_hand(spark, segment_rows):
    rng = random.Random(7)
    docs, expected = [], {}
    for d in range(12):
        texts, blocks = [], []
        for i in range(rng.randrange(1, 60)):
            kind = rng.choice(["text", "text", "text", "heading", "code"])
            level, text = rng.randrange(1, 8), rng.choice(["", "", "", "# "]) * (kind == "text") + "x" * rng.randrange(1, 90)
            texts.append({"label": {"text": "text", "heading": "heading", "code": "code"}[kind], "level": level, "text": text})
            level = min(level, 6)
            blocks.append({"kind": kind, "level": level, "md": "#" * level + " " + text if kind == "heading" else text, "ref": f"#/texts/{i}"})
        docs.append({"texts": texts})
        expected[d] = packed_by_hand(blocks, 60, 150)
    got = {}
    for r in chunking.build_chunks(arrays(spark, *docs), 60, 150, segment_rows).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.header_path, r.source_node_refs))
    assert got == expected


def test_patches(spark):
    flat = elements.element_table(arrays(spark, {"texts": [{"label": "paragraph", "text": "Title"}]}))
    todo = spark.createDataFrame(
        [(0, 1, "set_label", "#/texts/0", None, "section_header", None), (0, 2, "set_level", "#/texts/0", None, None, 2), (0, 3, "set_text", "#/texts/0", "Strategy", None, None)],
        "doc_id long, seq int, op string, ref string, text string, label string, level int",
    )
    assert {r.status for r in patches.patch_audit(flat, todo).collect()} == {"success"}
    row = patches.apply_field_patches(flat, todo).first()
    assert (row.text, row.label, row.level) == ("Strategy", "section_header", 2)


def test_responses(spark):
    body = '{"patches":[{"op":"set_text","ref":"#/texts/0","text":"a"}]}'
    df = spark.createDataFrame([("f", f"```json\n{body}\n```"), ("p", f"Here {{you}} go: {body}"), ("e", " ")], "unit_id string, raw string")
    good, bad = patches.read_responses(df)
    assert {r.unit_id for r in good.collect()} == {"f", "p"}
    assert [(r.unit_id, "empty" in r.reason) for r in bad.collect()] == [("e", True)]


def test_glossary(spark):
    raw = spark.createDataFrame(
        [(0, "DoD ", "国防総省", "", ""), (1, "DoD", "米国国防総省", "軍事", "省"), (2, " ", "", "", ""), (3, "Air", "空", "", "")],
        "seq long, english string, japanese string, genre string, description string",
    )
    assert tuple(glossary.entry_counts(raw).first()) == (3, 2)
    entries = glossary.effective_entries(raw)
    chunks = spark.createDataFrame([(0, 1, "The dod will publish guidance.")], "doc_id long, chunk_no long, source_text string")
    chosen = glossary.select_entries(chunks, entries)
    assert glossary.prompt_terms(chosen).first().glossary_text == "- DoD => 米国国防総省 / 軍事 / 省\n- Air => 空"
    half = spark.createDataFrame([(0, "", "空", "", ""), (1, "Sea", " ", "", "")], raw.schema)
    assert glossary.effective_entries(half).count() == 0 and glossary.entry_problems(half).count() == 2
    none = glossary.translation_messages(chunks, glossary.prompt_terms(glossary.select_entries(chunks, entries.limit(0)))).first()
    assert "用語辞書:\nなし\n" in none.messages[1].content


@pytest.mark.parametrize("count", [1, 60, 3000])
def test_glossary_of_any_size(spark, count):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abAB🦖") for _ in range(rng.randrange(1, 9))) for _ in range(count)})
    texts = ["".join(rng.choice("abAB \n🦖") for _ in range(60)) for _ in range(20)] + ["", "ab"]
    terms = spark.createDataFrame([(w,) for w in words], "english string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {tuple(r) for r in glossary.matches(docs, terms, "text", ("doc_id",)).collect()}
    assert found == {(i, w) for i, t in enumerate(texts) for w in words if w.lower() in t.lower()}


def test_attempts(spark):
    chunks = spark.createDataFrame([(0, "c1", "text", True, "a"), (0, "c2", "text", True, "b"), (0, "c3", "code", True, "c")], "doc_id long, chunk_id string, kind string, translatable boolean, source_text string")
    tried = spark.createDataFrame([(0, "c1", 1, "```", None), (0, "c1", 2, "A", None), (0, "c2", 11, "late", None)], "doc_id long, chunk_id string, attempt int, text string, error string")
    rows = {r.chunk_id: (r.status, r.translated_text, r.attempts) for r in translation.settle_attempts(chunks, tried).collect()}
    assert rows == {"c1": ("success", "A", 2), "c2": ("fallback_source", "b", 0), "c3": ("skipped", "c", 0)}


def test_rendering(spark):
    rows = spark.createDataFrame([(0, 2, "本文", None), (0, 1, "# Chunks(JS)", None), (0, 3, "", " "), (0, 4, "本文", "本文")], "doc_id long, chunk_no long, source_text string, translated_text string")
    assert rendering.concat_chunks(rows).first().markdown == "# Chunks(JA)\n\n本文\n"
    open_fence = spark.createDataFrame([(0, "```\nx")], "doc_id long, markdown string")
    assert [tuple(r) for r in rendering.lint_markdown(open_fence, ["doc_id"]).collect()] == [(0, 0, "fenced code block is not closed")]
    blank = spark.createDataFrame([(0, "\n \n")], "doc_id long, markdown string")
    assert [tuple(r) for r in rendering.paragraphs(blank, ["doc_id"]).collect()] == [(0, 0, None, "")]


@pytest.mark.parametrize("volume_parts", [1, 2, 8, None])
def test_volumes_are_pieces_of_one_text(spark, volume_parts):
    cells = spark.range(10_000).selectExpr("0L as doc_id", "'#/tables/0' as table_ref", "cast(id as int) as row", "0 as col", "0 as seq", "cast(id as string) as text")
    lines = rendering.table_lines(rendering.table_grid(cells))
    whole = "| 0 |\n| --- |\n" + "\n".join(f"| {i} |" for i in range(1, 10_000))
    cut = rendering.volumes(lines, ["doc_id", "table_ref"], "part_no", "line", "\n", volume_parts=volume_parts)
    assert "".join(r.markdown for r in sorted(cut.collect(), key=lambda r: r.volume)) == whole
    flat = elements.element_table(arrays(spark, {"tables": [{"caption": "T", "data": {"grid": [["a"]]}}], "texts": [{"text": "end"}, {"text": "x"}]}))
    tables = spark.createDataFrame([(0, "#/tables/0", whole)], "doc_id long, table_ref string, markdown string")
    pieces = rendering.render_documents(flat, tables, volume_parts).collect()
    assert "".join(r.markdown for r in sorted(pieces, key=lambda r: r.volume)) == f"end\n\nx\n\n**T**\n\n{whole}\n"


def test_raw_texts_and_cells(spark):
    doc = {
        "texts": [{"label": "text", "text": "  a....  "}, {"label": "text", "orig": "b......"}],
        "tables": [{"data": {"table_cells": [{"text": " A ", "row": 0, "col": 0}, "bare", {"text": "B......", "row": 0, "col": 1}]}}],
        "pictures": [{"title": "T", "image": {"uri": "u"}}],
    }
    flat = elements.element_table(arrays(spark, doc))
    assert [(c.node_ref, c.before_chars, c.after_chars) for c in elements.change_log(elements.clean_elements(flat)).collect()] == [("#/texts/0", 9, 6)]
    cells = elements.cell_table(flat)
    assert sorted((c.node_ref, c.before_chars, c.after_chars) for c in elements.cell_change_log(cells).collect()) == [("#/tables/0/data/table_cells/2", 7, 4)]
    patched = {r.ref: (r.before, r.after) for r in elements.normalization_patches(flat, cells).collect()}
    assert patched["#/tables/0/data/table_cells/0"] == (" A ", "A") and "#/tables/0/data/table_cells/1" not in patched
    parts = [r.part for r in rendering.document_parts(flat).filter("part like '!%'").collect()]
    assert parts == ["![image](u)"]


def test_grid_wins_over_the_cell_list(spark):
    doc = {"tables": [{"data": {"grid": [["G", "G"], ["x", "y"]], "table_cells": [{"text": "G", "row": 0, "col": 0}]}}]}
    flat = elements.element_table(arrays(spark, doc))
    assert rendering.tables_markdown(elements.rendered_cells(flat)).first().markdown == "| G | G |\n| --- | --- |\n| x | y |"
    assert chunking.build_chunks(arrays(spark, doc)).first().source_text == "| G | G |\n| --- | --- |\n| x | y |"
    assert [r.cell_ref for r in elements.cell_table(flat).collect()] == ["#/tables/0/data/table_cells/0"]


def test_fragments(spark):
    texts = [{"label": "text", "text": t, "prov": [{"page_no": 1}]} for t in ("This goes", "on and", "on.", "New start", *["and on"] * 9)]
    rows = blocks.merge_fragments(elements.element_table(arrays(spark, {"texts": texts}))).orderBy("pos").collect()
    assert [r.text for r in rows] == ["This goes on and on.", "New start" + " and on" * 9]


def test_numbering_one_hot_group(spark):
    df = spark.range(5000).selectExpr("id", "case when id % 3 > 0 then 'hot' else cast(id as string) end as g", "-id as o")
    rows = ordering.number_rows(df, ["o"], ["g"], "n").collect()
    hot = sorted((r.o, r.n) for r in rows if r.g == "hot")
    assert [n for _, n in hot] == list(range(1, len(hot) + 1)) and len(rows) == 5000
    assert all(r.n == 1 for r in rows if r.g != "hot")


@pytest.mark.parametrize("segment_rows", [1, 4, 100])
def test_segmented_last_equals_a_window(spark, segment_rows):
    rng = random.Random(5)
    data = [(k, p, rng.choice([None, None, rng.randrange(9)])) for k in range(4) for p in range(rng.randrange(30))]
    df = spark.createDataFrame(data, "k int, p int, v int")
    for current in (True, False):
        got = {(r.k, r.p): r.x for r in ordering.segmented_last(df, ["k"], "p", {"x": F.col("v")}, include_current=current, segment_rows=segment_rows).collect()}
        for k, p, _ in data:
            before = [v for kk, pp, v in data if kk == k and (pp <= p if current else pp < p) and v is not None]
            assert got[(k, p)] == (before[-1] if before else None)
