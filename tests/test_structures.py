"""Columns of a page, chat trees, similar titles, composed reorders, line numbers and token bags against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from test_documents import arrays
from weftline.operators import blocks, components, elements, messages, news, patches, translation
from weftline.sources import dumps


def placed(text, left, top, right, bottom, page=1, label="text", **more):
    box = {"l": left, "t": -top, "r": right, "b": -bottom, "coord_origin": "BOTTOMLEFT"}
    return {"label": label, "text": text, "prov": [{"page_no": page, "bbox": box}], **more}


def merged(spark, texts, **options):
    rows = blocks.merge_fragments(elements.element_table(arrays(spark, {"texts": texts})), **options)
    return [r.text for r in rows.orderBy("pos").collect()]


def test_fragments_merge_inside_a_column_only(spark):
    page = [
        placed("A title over both columns", 50, 20, 560, 40, label="title"),
        placed("left one goes", 50, 60, 290, 70), placed("on here", 51, 75, 200, 85), placed("far below", 50, 120, 280, 130),
        placed("right one goes", 310, 60, 560, 70), placed("on there", 312, 78, 500, 88),
        placed("too wide for a column", 50, 90, 560, 98),
    ]
    assert merged(spark, page) == ["A title over both columns", "left one goes on here", "far below", "right one goes on there", "too wide for a column"]
    assert merged(spark, page, max_gap=40) == ["A title over both columns", "left one goes on here far below", "right one goes on there", "too wide for a column"]


def test_fragments_with_tolerance_styles_and_two_places(spark):
    # columns may overlap by the tolerance, a style tells fragments apart, and a text that ends in the next column is continued there
    left, right = placed("left", 50, 60, 300, 70), placed("goes on", 294, 75, 540, 85)
    assert merged(spark, [left, right], spanning=1.0) == ["left", "goes on"]
    assert merged(spark, [left, right], spanning=1.0, tolerance=0) == ["left goes on"]
    assert merged(spark, [placed("bold", 50, 60, 200, 70, formatting={"bold": True}), placed("not", 50, 75, 200, 85, formatting={"bold": False})]) == ["bold", "not"]
    both = placed("from left", 50, 700, 290, 710)
    both["prov"].append(placed("", 310, 20, 560, 30)["prov"][0])
    assert merged(spark, [placed("x.", 50, 650, 290, 660), both, placed("to right", 310, 40, 560, 50)]) == ["x.", "from left to right"]
    over = placed("page one", 50, 700, 290, 710)
    over["prov"].append(placed("", 50, 20, 290, 30, page=2)["prov"][0])
    third = placed("and two", 50, 35, 290, 45, page=2)
    third["prov"].append(placed("", 50, 20, 290, 30, page=3)["prov"][0])
    assert merged(spark, [over, third, placed("and three", 50, 38, 290, 48, page=3), {"label": "text", "text": "no page"}, {"label": "text", "text": "at all"}]) == [
        "page one and two and three", "no page", "at all"]


def random_tree(rng, chat, size):
    parents = {i: (rng.randrange(max(0, i - 2), i) if rng.random() < 0.9 else rng.randrange(i)) if i else None for i in range(size)}
    children = {i: [k for k, p in parents.items() if p == i and rng.random() < 0.93] for i in range(size)}
    gone = {i for i in range(size) if rng.random() < 0.03}
    return [(chat, f"m{i}", None if p is None else f"m{p}", [f"m{k}" for k in children[i]], "user", "x") for i, p in parents.items() if i not in gone]


TREE = "chat_id long, id string, parent_id string, children_ids array<string>, role string, content string"


def test_chat_trees_equal_a_walk(spark):
    rng = random.Random(3)
    rows = list(itertools.chain(*(random_tree(rng, c, 70) for c in range(12))))
    loop = [(99, "a", "b", ["b"], "user", "x"), (99, "b", "a", ["a"], "user", "x"), (99, "c", "b", [], "user", "x"), (98, "only", None, None, "user", "x"), (97, "e", "", [], "user", "x")]
    rows += [(99, "d", "a", [], "user", "x"), *loop]
    by_id = {(r[0], r[1]): r for r in rows}

    def up(chat, name):
        parent = by_id[chat, name][2] or None
        if parent is None:
            return None, None
        if (chat, parent) not in by_id:
            return None, "unknown parent"
        return (parent, None) if name in (by_id[chat, parent][3] or []) else (None, "not listed by parent")

    def walk(chat, name):
        path = [name]
        while (above := up(chat, path[-1])[0]) is not None and above not in path:
            path.append(above)
        return path, above is not None

    hidden, visible = set(), set()
    heads = {chat: rng.choice([r[1] for r in rows if r[0] == chat]) for chat in {r[0] for r in rows}} | {99: "a", 55: "nowhere", 98: "only"}
    for chat, name in by_id:
        path, looped = walk(chat, name)
        reason = up(chat, path[-1])[1]
        if looped or reason:
            inherited = "parents form a loop" if looped else "under a broken link"
            hidden.add((chat, name, by_id[chat, name][2] or None, up(chat, name)[1] or inherited, None if looped else path[-1]))
    for chat, name in heads.items():
        path, looped = walk(chat, name) if (chat, name) in by_id else ([], False)
        visible |= {(chat, m, -i if looped else len(path) - 1 - i) for i, m in enumerate(path)}
    assert max(v[2] for v in visible) > 10 and {h[3] for h in hidden} >= {"under a broken link", "unknown parent", "not listed by parent", "parents form a loop"}
    trees = messages.ChatTrees(spark.createDataFrame(rows, TREE))
    assert set(map(tuple, trees.hidden().collect())) == hidden
    assert set(map(tuple, trees.visible(spark.createDataFrame(list(heads.items()), "chat_id long, current_id string")).collect())) == visible
    trees.close()


def test_a_deep_chat_and_no_chat(spark):
    deep = [(1, f"m{i}", f"m{i - 1}" if i else None, [f"m{i + 1}"], "user", "x") for i in range(40)]
    trees = messages.ChatTrees(spark.createDataFrame(deep, TREE))
    heads = spark.createDataFrame([(1, "m39")], "chat_id long, current_id string")
    assert sorted((r.place, r.id) for r in trees.visible(heads).collect()) == [(i, f"m{i}") for i in range(40)]
    assert messages.broken_links(spark.createDataFrame([], TREE)).count() == 0


def test_an_appended_chat_carries_its_new_head(spark):
    tree = spark.createDataFrame([(1, "m0", None, None, "user", "x"), (2, "n0", None, [], "user", "x")], TREE)
    heads = spark.createDataFrame([(1, "m0"), (2, "n0"), (3, "")], "chat_id long, current_id string")
    turns = spark.createDataFrame([(1, "u", "a", "hi"), (2, "u", "a", "  "), (3, "u", "a", "new")], "chat_id long, user_id string, assistant_id string, content string")
    grown, after = messages.append_turn(tree, heads, turns)
    assert {r.chat_id: r.current_id for r in after.collect()} == {1: "a", 2: "n0", 3: "a"}
    rows = {(r.chat_id, r.id): (r.parent_id, r.children_ids) for r in grown.collect()}
    assert rows == {(1, "m0"): (None, ["u"]), (2, "n0"): (None, []), (1, "u"): ("m0", ["a"]), (1, "a"): ("u", []), (3, "u"): (None, ["a"]), (3, "a"): ("u", [])}
    trees = messages.ChatTrees(grown)
    assert [r.id for r in trees.visible(after).filter("chat_id = 1").orderBy("place").collect()] == ["m0", "u", "a"]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_similar_groups_equal_brute_force(spark, threshold):
    rng = random.Random(11)
    names = [f"w{i}" for i in range(12)]
    rows = [(i, rng.sample(names, rng.randrange(6))) for i in range(120)]
    rows += [(200 + i, [f"s{k}" for k in range(8)] + [f"t{i}"]) for i in range(60)]  # all alike: one list holds them all
    rows += [(300 + i, [f"c{k}" for k in range(i, i + 9)]) for i in range(40)]  # a chain
    sets = {i: set(t) for i, t in rows}
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
            group[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame(rows, "id long, words array<string>")
    assert {r.id: r.group for r in components.similar_groups(df, "id", "words", threshold).collect()} == {i: root(i) for i in sets}
    assert components.similar_groups(df.limit(0), "id", "words", threshold).count() == 0


def test_primary_source_wins_its_topic(spark):
    items = spark.createDataFrame(
        [(1, "Our view: new chip announced by Foo", 1, "2026-01-01"), (2, "New chip announced by Foo", 0, "2026-01-02"), (3, "NEW CHIP, announced by Foo!", 0, None),
         (4, "Something else", 1, "2026-01-01"), (5, "", 1, None), (6, None, 1, None)], "seq long, title string, source_priority int, published_at string")
    rows = {r.seq: (r.topic_seq, r.copies) for r in news.one_per_similar_topic(items).collect()}
    assert rows == {2: (1, 3), 4: (4, 1), 5: (5, 1), 6: (6, 1)}


def test_composed_reorders_equal_a_replay(spark):
    rng = random.Random(8)
    docs, steps, expected = [], [], {}
    for doc in range(6):
        n = rng.randrange(3, 9)
        docs.append({"texts": [{"label": "text", "text": f"t{i}"} for i in range(n)], "tables": [{"label": "table"}]})
        state = [[f"#/texts/{i}", f"t{i}", "text"] for i in range(n)]
        for seq in range(40):
            kind = rng.randrange(4) if doc else 3
            if kind == 0:  # ten of them a document or so, some with unknown or repeated refs
                refs = rng.sample([s[0] for s in state], rng.randrange(n)) + rng.choice([[], [], [], ["#/texts/99"], [state[0][0]]])
                steps.append((doc, seq, "reorder_texts", None, None, None, None, refs))
                if len(set(refs)) == len(refs) and "#/texts/99" not in refs:
                    state = [next(s for s in state if s[0] == r) for r in refs] + [s for s in state if s[0] not in refs]
            else:
                at, field = rng.randrange(n + 1), rng.choice(["text", "label"])
                steps.append((doc, seq, f"set_{field}", f"#/texts/{at}", f"x{seq}" if field == "text" else None, f"l{seq}" if field == "label" else None, None, None))
                if at < n:
                    state[at][1 if field == "text" else 2] = ("x" if field == "text" else "l") + str(seq)
        expected |= {(doc, s[0]): (i, s[1], s[2]) for i, s in enumerate(state)}
        steps.append((doc, 99, "set_label", "#/tables/0", None, "grid", None, None))
    flat = elements.element_table(arrays(spark, *docs))
    given = spark.createDataFrame(steps, "doc_id long, seq int, op string, ref string, text string, label string, level int, refs array<string>")
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    done = patches.apply_patches(flat, given)
    assert len(tracker.getJobIdsForGroup(None)) == before
    rows = done.collect()
    assert {(r.doc_id, r.ref): (r.idx, r.text, r.label) for r in rows if r.grp == "texts"} == expected
    assert {r.label for r in rows if r.grp == "tables"} == {"grid"}


def test_line_numbers_of_a_file_in_many_blocks(spark, tmp_path):
    lines = [("" if i % 5 == 0 else "bad" if i % 7 == 0 else '{"a": %d}' % i) for i in range(400)]
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "y.jsonl").write_text("\n\nbad\n", encoding="utf-8")
    wanted = sorted([("x", i + 1) for i, s in enumerate(lines) if s == "bad"] + [("y", 3)])
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("128m", "300", "1000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            good, bad = dumps.read_jsonl(spark, str(tmp_path), "a int")
            assert sorted((r.path[-7], r.line_no) for r in bad.collect()) == wanted
            assert good.count() == sum(s.startswith("{") for s in lines)
            assert size == "128m" or dumps.text_lines(spark, str(tmp_path))[1].count() >= 5
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_tokens_are_lost_one_by_one(spark):
    pairs = spark.createDataFrame(
        [(1, "a", "5 apples, 5 pears, see `f(x)` {name}", "5 Äpfel"), (2, "b", "10 GB of 10", None), (3, "c", "1 and 2", "2 und 1"), (4, "d", None, "7")],
        "doc_id long, chunk_id string, source_text string, translated_text string")
    lost = {(r.doc_id, r.token_kind, r.token): r.missing for r in translation.lost_tokens(pairs).collect()}
    assert lost == {
        (1, "number", "5"): 1, (1, "code", "`f(x)`"): 1, (1, "placeholder", "{name}"): 1, (2, "number", "10"): 2, (2, "unit", "10 GB"): 1}


def test_attempts_beyond_the_limit_are_counted(spark):
    attempts = spark.createDataFrame([(1, "a", n) for n in range(1, 14)], "doc_id long, chunk_id string, attempt int")
    assert [tuple(r) for r in translation.late_attempts(attempts).collect()] == [(1, "a", 3)]
    assert translation.late_attempts(attempts.filter(F.col("attempt") < 11)).count() == 0
