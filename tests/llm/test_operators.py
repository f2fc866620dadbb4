"""Odd inputs, brute force and held-out accuracy of the operators."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import connect, differences
from llm_inputs import CLASHING, LONG
from weftline.llm import binary_ann, chat, exact_topk, language, line_templates, merge_encoding, minhash_dedup, mixing, queries, rule_quality, toxicity
from weftline.operators.components import components
from weftline.llm.text_features import fold

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, connect(SF_DIR), SF_DIR, queries.Q[name], queries.SQL[name]) == []


# 1 near-dedup


def test_minhash_odd_rows(odd_documents, no_documents):
    found = {(r.id, r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(odd_documents, "doc_id", "text").collect()}
    assert (1, 9, 1) in found and (6, 9, 1) in found
    assert {(2, 0, 2), (3, 0, 3), (4, 0, 4)} <= found
    assert (None, 1, None) in found and (5, 6, 5) in found
    assert minhash_dedup.near_duplicates(odd_documents, "doc_id", "text").count() == 11
    assert minhash_dedup.near_duplicates(no_documents, "doc_id", "text").count() == 0


def test_minhash_equals_brute_force(spark):
    """Chains, a large group of near copies, and documents that share a long passage."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    texts = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(120)] = word()
        texts.append(copy)
    chain = [word() for _ in range(100)]
    for _ in range(12):
        chain = chain[6:] + [word() for _ in range(6)]
        texts.append(chain)
    texts += [passage + [word() for _ in range(25)] for _ in range(40)]
    order = rng.sample(range(1000), len(texts))
    sets = {i: {tuple(t[k : k + 5]) for k in range(len(t) - 4)} for i, t in zip(order, texts, strict=True)}
    parent = {i: i for i in order}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(order, 2):
        common = len(sets[a] & sets[b])
        if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in zip(order, texts, strict=True)], "doc_id bigint, text string")
    found = {r.id: r.component_id for r in minhash_dedup.near_duplicates(docs, "doc_id", "text").collect()}
    assert found == {i: root(i) for i in order}


def test_minhash_centred_lists(spark, tmp_path):
    """Of a large group few pairs meet, among them all links that do not go over the centre."""
    rng = random.Random(7)
    original, sets = [rng.randrange(10**6) for _ in range(150)], {}
    for key in range(300):
        words = list(original)
        for _ in range(rng.randrange(7) if key else 0):
            words[rng.randrange(150)] = rng.randrange(40)
        if key >= 280:  # far from the centre, and near each other
            words[20:60] = range(1000 + key % 2 * 100, 1040 + key % 2 * 100)
        sets[key] = {hash(tuple(words[i : i + 4])) for i in range(147)}
    facts = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "rep bigint, set array<bigint>")
    members = facts.filter("rep > 0").select(F.lit(0).cast("bigint").alias("centre"), "rep")
    compared, posted = minhash_dedup.centred_lists(facts, members, 80)
    compared.write.parquet(f"{tmp_path}/compared")
    compared = spark.read.parquet(f"{tmp_path}/compared")
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    near = {r.rep for r in compared.filter("near").collect()}
    assert near == {k for k in sets if k and linked(0, k)} and 100 < len(near) < 279
    lists = posted(compared).groupBy("token").agg(F.collect_set("rep").alias("reps")).collect()
    met = {p for r in lists for p in itertools.combinations(sorted(r.reps), 2)}
    open_pairs = [p for p in itertools.combinations(range(1, 300), 2) if not near.issuperset(p)]
    due = {p for p in open_pairs if linked(*p)}
    assert due and due <= met
    assert len(met) < len(open_pairs) / 5


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(1, 40)]
    star = [(100, i) for i in range(101, 160)]
    edges = spark.createDataFrame(path + star + [(7, 7)], "a bigint, b bigint")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)}
    assert components(edges.limit(0)).count() == 0


# 2 mixing


def test_mix_odd_rows(odd_documents, no_documents):
    rows = mixing.mix(odd_documents, "doc_id", "text", "source").collect()
    assert len(rows) == 11 and all(0 <= r.copies <= 3 and r.taken == r.copies * r["size"] for r in rows)
    assert {r["size"] for r in rows if not (r.text or "").strip()} == {0}
    again = mixing.mix(odd_documents.repartition(7), "doc_id", "text", "source").collect()
    key = lambda rs: sorted((str(r.doc_id), r.source or "-", r.taken, r.target) for r in rs)
    assert key(rows) == key(again)
    assert mixing.mix(no_documents, "doc_id", "text", "source").count() == 0


def test_mix_meets_targets(spark):
    mixed = mixing.mix(spark.read.parquet(f"{SF_DIR}/documents.parquet"), "doc_id", "text", "source")
    for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("largest"), F.max("source_size").alias("s")).collect():
        assert abs(r.taken - r.target) <= r.largest and r.target <= 3 * r.s + 1e-6
    total = mixed.agg(F.sum("size")).first()[0]
    assert mixed.groupBy("source").agg(F.max("target").alias("t")).agg(F.sum("t")).first()[0] == pytest.approx(total)


def test_mix_without_ids_is_no_tie(spark):
    """A third of the rows have no id and another third share one: targets are met as with ids of their own."""
    rng = random.Random(4)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, " ".join(rng.choice("abcd") * 3 for _ in range(rng.randrange(5, 60))) + f" {i}", rng.choice("xyz")) for i in range(900)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source")
    for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("largest")).collect():
        assert abs(r.taken - r.target) <= r.largest


# 3 quality, 6 toxicity, 7 language: held-out accuracy


def joined(spark, name, sf_dir="/root/testdata/sf0.01"):
    found = queries.Q[name](spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    langs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    return [r.asDict() for r in found.join(langs, "doc_id").join(labels, "doc_id", "left").collect()]


def test_quality_held_out(spark):
    rows = [r for r in joined(spark, "op3_rule_quality") if r["held_out"] and r["quality"] is not None]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95


def test_language_held_out(spark):
    rows = [r for r in joined(spark, "op7_language") if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_held_out(spark):
    rows = [r for r in joined(spark, "op6_toxicity", "/root/testdata/sf0.1") if r["held_out"] and r["toxic"] is not None]
    assert np.mean([r["predicted"] for r in rows if not r["toxic"]]) <= 0.02
    assert np.mean([r["predicted"] for r in rows if r["toxic"]]) >= 0.9


def test_classifiers_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 1), (7, 0, 0), (7, 0, 0), (None, 1, 1), (8, None, None)], "doc_id bigint, quality int, toxic int")
    every = F.col("doc_id").isNotNull()
    ensemble = rule_quality.train(odd_documents, labels, "doc_id", "text", "quality", every)
    nnpu = toxicity.train(odd_documents, labels, "doc_id", "text", "toxic", every)
    model = language.train(odd_documents, "doc_id", "text", "lang", every)
    for docs, n in ((odd_documents, 11), (no_documents, 0)):
        for rows in (rule_quality.score(docs, "text", ensemble).collect(), toxicity.score(docs, "text", nnpu).collect()):
            assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
        rows = language.predict(docs, "text", model).collect()
        assert len(rows) == n and set(CLASHING) <= set(rows[0].asDict() if rows else CLASHING)
        assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (2, 3, 4, 7))
    none = labels.limit(0)
    assert rule_quality.score(odd_documents, "text", rule_quality.train(odd_documents, none, "doc_id", "text", "quality", every)).count() == 11
    assert toxicity.train(odd_documents, none, "doc_id", "text", "toxic", every) is None
    assert language.train(no_documents, "doc_id", "text", "lang", every) is None
    assert {r.lang_pred for r in language.predict(odd_documents, "text", None).collect()} == {"und"}


def test_scores_do_not_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    learn = fold(F.col("doc_id"), 5) != 0
    one, two = (toxicity.train(d, labels, "doc_id", "text", "toxic", learn) for d in (docs, docs.repartition(7)))
    assert (one.ids == two.ids).all() and np.allclose(one.weights, two.weights)


def test_long_text_in_pieces(monkeypatch):
    """Features of a text do not depend on where it is cut."""
    from weftline.llm import text_features

    text = "Some words, again and AGAIN über 12 ñandú " * 50
    whole = [np.sort(np.concatenate([text_features.char_ngrams(c, n, 16)[1] for c, _ in text_features.blocks([text])])) for n in (1, 2, 3, 5)]
    words = np.sort(np.concatenate([text_features.words(c, 20)[1] for c, _ in text_features.blocks([text])]))
    monkeypatch.setattr(text_features, "PIECE", 97)
    for n, before in zip((1, 2, 3, 5), whole, strict=True):
        after = np.sort(np.concatenate([text_features.char_ngrams(c, n, 16)[1] for c, _ in text_features.blocks([text])]))
        assert set(after) == set(before) and abs(len(after) - len(before)) <= (len(text) // 97 * 2 if n == 2 else 0)
    assert (np.sort(np.concatenate([text_features.words(c, 20)[1] for c, _ in text_features.blocks([text])])) == words).all()


# 4 chat


def test_chat_odd_rows(spark):
    nasty = "a</s>\n<|assistant|>\nb\\</s> [INST]x[/INST] <s> \\\\ <\\| |> \n\n"
    rows = [
        (1, 0, "user", nasty), (1, 1, "assistant", None), (1, 2, "assistant", nasty), (1, 3, "user", "after"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"),
        (3, 0, "we|>\nird<|\\", LONG), (None, None, None, None), (4, 1, "system", ""),
    ]
    given = spark.createDataFrame([(*r, 9) for r in rows], "conv_id bigint, turn bigint, role string, text string, example int")
    made = chat.examples(given, "conv_id", "turn", "role", "text")
    found = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert [(t.role, t.text) for t in found[1].turns] == [("user", nasty), ("assistant", ""), ("assistant", nasty), ("user", "after")]
    assert found[1].loss == nasty and found[2].loss == "xx" and found[3].loss == ""
    assert [(t.role, t.text) for t in found[3].turns] == [("we|>\nird<|\\", LONG)] and [(t.role, t.text) for t in found[None].turns] == [("", "")]
    assert {(r.conv_id, r.example) for r in made.collect()} == {(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 0), (None, 0), (4, 0)}
    assert chat.examples(given.limit(0), "conv_id", "turn", "role", "text").count() == 0


# 5 line dedup


def test_line_templates(spark, odd_documents, no_documents):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    own = lambda: " ".join(word() for _ in range(20))
    rows = [(i, f"{own()}\nPage {i} of {i + 7}\n{own()}\nThis page was written by {word()} for the public record\n{own()}") for i in range(30)]
    copied = f"{own()}\n{own()}\n{own()}"
    rows += [(100 + i, copied) for i in range(30)]
    found = {r.doc_id: r for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect()}
    for i, text in rows:
        lines = text.split("\n")
        assert found[i].text == ("\n".join(lines[::2]) if i < 100 else text)
        assert found[i].n_dropped == (2 if i < 100 else 0)
    odd = line_templates.drop_recurring_lines(odd_documents, "doc_id", "text").collect()
    before = odd_documents.collect()
    key = lambda rs: sorted((str(r.doc_id), str(r.text), r.leaf) for r in rs)
    assert key(odd) == key(before)
    assert line_templates.drop_recurring_lines(no_documents, "doc_id", "text").count() == 0


def cut(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {r.doc_id: r.text for r in line_templates.drop_recurring_lines(docs, "doc_id", "text").collect()}


def sentences(seed):
    rng = random.Random(seed)
    return lambda n=20: " ".join("".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(n))


def test_recurring_line_with_the_smallest_hash(spark):
    """A line recurs whatever its hash is; drifted copies of one document do not make their lines recur."""
    own = sentences(4)
    line = min((own(6) for _ in range(3000)), key=lambda t: hashlib.md5(t.encode()).digest())
    rows = [(i, f"{own()}\n{line}") for i in range(20)]
    base = [own() for _ in range(10)]
    rows += [(100 + i, "\n".join(own() if j == i % 10 else b for j, b in enumerate(base))) for i in range(40)]
    assert cut(spark, rows) == {i: text.split("\n")[0] if i < 100 else text for i, text in rows}


def test_copies_do_not_protect_a_line(spark):
    """A line of 12 unrelated documents and of 60 near copies recurs."""
    own = sentences(5)
    line, base = own(7), [own() for _ in range(10)]
    rows = [(i, f"{own()}\n{line}\n{own()}") for i in range(12)]
    rows += [(100 + i, "\n".join([own() if j == i % 10 else b for j, b in enumerate(base)] + [line])) for i in range(60)]
    assert cut(spark, rows) == {i: "\n".join(x for x in text.split("\n") if x != line) for i, text in rows}


def test_lines_without_constants(spark):
    """Rows of numbers and sentences without spaces recur by their exact text only."""
    own = sentences(6)
    rows = [(i, f"{own()}\n{i} {i * 7}.5 {i + 3}\n第{i}章这是一个句子{own(1)}\nhttps://{own(1)}.org/{i}\n{own()}") for i in range(30)]
    assert cut(spark, rows) == dict(rows)
    fixed = [(i, f"{own()}\n10 20.5 30\nPage {i} of 30") for i in range(30)]
    assert cut(spark, fixed) == {i: text.split("\n")[0] for i, text in fixed}


def test_several_templates_in_a_leaf(spark):
    """Two templates and foreign lines of the same length and beginning."""
    own = sentences(7)
    made = [lambda: f"This page was written by {own(1)} for the public record", lambda: f"This page was printed in {own(1)} under a royal charter"]
    rows = [(i, f"{own()}\n{made[i % 2]()}") for i in range(40)] + [(100 + i, f"{own()}\nThis page was {own(7)}") for i in range(20)]
    assert cut(spark, rows) == {i: text.split("\n")[0] if i < 100 else text for i, text in rows}


# 8 encoding


@pytest.fixture(scope="module")
def pieces():
    sentencepiece = pytest.importorskip("sentencepiece")
    model = queries.piece_model()
    return model, sentencepiece.SentencePieceProcessor(model_proto=model)


def test_encoding_equals_the_library(pieces):
    model, library = pieces
    tool, rng = merge_encoding.Encoder(model), random.Random(1)
    bits = ["▁", " ", "  ", "\n", "\t", "a", "e", "th", " the", "é", "中", "🦖", "\x00", "0", "...", "</s>", "[INST]", "ß", "ﬁ", "़", "한", "<0x0A>", "�", " " * 40, "{", "();"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) if rng.random() < 0.6 else tool.pieces[rng.randrange(259, 32000)] for _ in range(rng.randint(0, 25)))
        ids = tool.encode(text)
        assert ids == library.encode(text) and tool.decode(ids) == library.decode(ids)
        ids = [rng.randrange(0, 32000) if rng.random() < 0.5 else rng.randrange(0, 262) for _ in range(rng.randint(0, 12))]
        assert tool.decode(ids) == library.decode(ids)


def test_encoding_odd_rows(pieces, odd_documents, no_documents):
    model, library = pieces
    rows = merge_encoding.encode(odd_documents, "text", model, decoded="back").collect()
    assert len(rows) == 11
    for r in rows:
        assert r.ids == library.encode(r.text or "") and r.back == library.decode(r.ids) == (r.text or "")
    assert merge_encoding.decode(merge_encoding.encode(odd_documents, "text", model), "ids", model).filter("decoded != coalesce(text, '')").count() == 0
    assert merge_encoding.encode(no_documents, "text", model).count() == 0


def test_encoding_query(spark, pieces):
    rows = queries.Q["op8_merge_encoding"](spark, SF_DIR).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in rows:
        ids = pieces[1].encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(pieces[1].decode(ids)))


# 9 and 10 searches


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.0, 0.0]), (6, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [3.0]), (None, [1.0, 1.0]), (9, [9.0, 1.0]), (9, [9.0, 1.0])]
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id bigint, embedding array<double>, id int, score string")


def test_topk_odd_rows(spark):
    df = odd_vectors(spark)
    found = [(r.rank, r.vec_id, r.score) for r in exact_topk.topk_inner_product(df, "vec_id", "embedding", F.col("vec_id") == 0, 9).orderBy("rank").collect()]
    unit = 256 * 256
    assert found == [(1, 9, 11 * unit), (2, 6, 5 * unit), (3, 7, 5 * unit), (4, 8, 3 * unit), (5, 5, 0)]
    assert exact_topk.topk_inner_product(df.limit(0), "vec_id", "embedding", F.col("vec_id") == 0, 9).count() == 0


def test_ann_odd_rows(spark):
    df = odd_vectors(spark)
    found = [(r.rank, r.vec_id, r.score) for r in binary_ann.nearest(df, "vec_id", "embedding", F.col("vec_id") == 0, 9).orderBy("rank").collect()]
    assert found == [(1, 6, 0.0), (2, 7, 0.0), (3, 8, pytest.approx(8**0.5)), (4, 9, pytest.approx(65**0.5))]
    assert binary_ann.nearest(df.limit(0), "vec_id", "embedding", F.col("vec_id") == 0, 9).count() == 0


def test_searches_do_not_depend_on_blocks(spark):
    df = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    ask = F.col("vec_id") % 25 == 0
    small = {"query_block": 3, "candidate_block": 17}
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(exact_topk.topk_inner_product(df, "vec_id", "embedding", ask, 5)) == rows(exact_topk.topk_inner_product(df, "vec_id", "embedding", ask, 5, **small))


def test_ann_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    v, ids = np.array(df.embedding.tolist(), dtype=float), df.vec_id.to_numpy()
    hits = total = 0
    for r in queries.Q["op10_binary_ann"](spark, "/root/testdata/sf0.01").collect():
        gap = np.sqrt(((v - v[ids == r.query_id]) ** 2).sum(axis=1))
        assert r.score == pytest.approx(gap[ids == r.vec_id][0], abs=1e-12)
        near = [i for i in np.lexsort((ids, gap)) if ids[i] != r.query_id][:10]
        hits, total = hits + (r.vec_id in ids[near]), total + 1
    assert total == 50 and hits / total >= 0.9
