"""The stages against plain versions of their rules."""

import hashlib

import corpus_pipeline
from weftline.llm import mixing


def columns(rows):
    return [tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in rows]


def test_stages_on_odd_rows(spark, odd_documents, no_documents, tmp_path):
    for name, given, expected in (("odd", odd_documents, {1, 5, 8, 9, None}), ("none", no_documents, set())):
        docs = given
        seen = {}
        for stage, fn in corpus_pipeline.STAGES:
            fn(spark, docs, "").write.parquet(str(tmp_path / name / stage))
            docs = spark.read.parquet(str(tmp_path / name / stage))
            seen[stage] = docs.collect()
            if stage != "encode":
                assert docs.columns == list(corpus_pipeline.COLUMNS)
        assert {r.doc_id for r in seen["near_dedup"]} <= expected | {6}
        assert [r.doc_id for r in seen["near_dedup"] if r.doc_id in (6, 9)].count(9) <= 1
        assert len(seen["encode"]) == len(seen["mix"]) and all(r.n_tokens == len(r.ids) for r in seen["encode"])


def test_pipeline_keeps_its_promises(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = corpus_pipeline.keep_known_language(spark, docs, sf_dir)
    assert known.count() == docs.count()  # all of them are prose in a known language
    one = corpus_pipeline.keep_one_of_each_group(spark, docs, sf_dir).collect()
    sets = {}
    for r in docs.collect():
        words = r.text.encode().lower().split()
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    kept = {r.doc_id for r in one}
    alike = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ids = sorted(sets)
    group = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if j < i and alike(i, j):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert kept == {i for i in ids if group[i] == i}
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    plan = {r.doc_id: r.copies for r in mixing.mix(docs, "doc_id", "text", "source").collect()}
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in plan.items() if n}
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_encoded_ids_read_back(spark, odd_documents):
    texts = sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in odd_documents.collect())
    assert sorted(r.decoded_sha256 for r in corpus_pipeline.encode_tokens(spark, odd_documents, "").collect()) == texts


def test_different_texts_under_one_id_stay(spark):
    rows = [(1, "one text about something that is long enough", "en", "a", 44), (1, "another text altogether with other words in it", "en", "b", 46),
            (1, "another text altogether with other words in it", "en", "b", 46), (2, "a third text that stands under its own number", "en", "a", 45)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(columns(corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()))
    assert kept == sorted(set(rows))
