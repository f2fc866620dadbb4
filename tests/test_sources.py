import json

import pytest

from weftline.operators import news, state
from weftline.sources import dumps, feeds, glossaries, sinks
from weftline.streaming import activity_stream


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":1}\n\n  \n[1]\n{"a":2}\nnot json\n', encoding="utf-8")
    good, bad = dumps.read_jsonl(spark, str(tmp_path), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2]
    assert sorted(r.line for r in bad.collect()) == ["[1]", "not json"]
    assert sorted(r.line_no for r in bad.collect()) == [4, 6]
    with pytest.raises(Exception, match="must contain objects"):
        dumps.read_jsonl_strict(spark, str(tmp_path), "a int").collect()


def test_json_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    out = str(tmp_path / "out")
    sinks.write_jsonl(df, out)
    sinks.write_jsonl(df, out, append=True)
    assert dumps.read_jsonl(spark, out, "a int, b string")[0].count() == 4


def test_documents_and_lines(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.json").write_text('{"texts":\n [{"text":"a"}]}', encoding="utf-8")
    assert json.loads(dumps.read_json_documents(spark, str(tmp_path / "d")).first().payload)["texts"][0]["text"] == "a"
    lines = spark.createDataFrame([(1, "b"), (0, "a")], "pos int, line string")
    sinks.write_lines(lines, str(tmp_path / "md"), ["pos"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "md").glob("part-*")))
    assert text == "a\nb\n"


def test_glossary_csv(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text('﻿english , "japanese", genre, description\nDoD, 国防総省, 軍, "a, b"\n , , ,\n DoD ,米国国防総省,,\n', encoding="utf-8")
    rows = glossaries.read_glossary(spark, str(path)).orderBy("seq").collect()
    assert [(r.english, r.japanese, r.description) for r in rows if r.english] == [("DoD", "国防総省", "a, b"), ("DoD", "米国国防総省", "")]
    path.write_text("english,japanese\na,b\n", encoding="utf-8")
    with pytest.raises(ValueError, match="missing columns"):
        glossaries.read_glossary(spark, str(path))


def test_pages_stop_after_a_short_one(spark):
    pages = spark.createDataFrame([(0, ["m1", "m2"]), (1, ["m3"]), (2, ["m4", "m5"])], "page int, items array<string>")
    assert [r.item for r in dumps.stitch_pages(pages, 2).orderBy("page", "pos").collect()] == ["m1", "m2", "m3"]
    assert dumps.stitch_pages(pages, 2, max_pages=1).count() == 2


def test_channel_resolution(spark):
    names = spark.createDataFrame([(0, "c1", "report"), (1, "c2", "report")], "seq int, id string, name string")
    asked = spark.createDataFrame([("#report",), ("2b63b27b-fc60-4b84-bb04-e51d2fced360",), ("nope",), ("",)], "channel string")
    got = {r.channel: (r.channel_id, r.error) for r in dumps.resolve_channels(asked, names).collect()}
    assert got["#report"] == ("c1", None) and got["nope"][1] == "channel not found: nope" and got[""][1] == "channel is required"


def test_items_inline_and_file(spark, tmp_path):
    (tmp_path / "i.json").write_text('[{"title":"a"},{"headline":"b"}]', encoding="utf-8")
    schema = "struct<title:string,headline:string,url:string>"
    for rows in (dumps.read_items(spark, str(tmp_path / "i.json"), schema=schema), dumps.read_items(spark, inline='[{"title":"a"},{"headline":"b"}]', schema=schema)):
        out = news.normalize_news(rows).orderBy("seq").collect()
        assert [(r.title, r.category, r.url) for r in out] == [("a", "トピック", ""), ("b", "トピック", "")]


def test_news_hints(spark):
    n = spark.createDataFrame([(0, "Cloud cost tool update", "Vendor blog", "Review cost dashboards.")], "seq int, title string, source string, impact string")
    a = spark.createDataFrame([(0, "t", "Improve internal developer experience.")], "seq int, title string, takeaways string")
    p = spark.createDataFrame([(0, "e", "Episode 42", "Model serving and GPU operations.")], "seq int, title string, episode string, highlights string")
    news_rows, articles, podcasts = news.normalize_news(n), news.normalize_articles(a), news.normalize_podcasts(p)
    assert news_rows.first().impact_hint == "Review cost dashboards."
    assert articles.first().learning_hint == "Improve internal developer experience."
    assert (podcasts.first().episode, podcasts.first().highlight_hint) == ("Episode 42", "Model serving and GPU operations.")
    items = news.all_sections(news_rows, articles, podcasts)
    assert {(r.section, r["items"]) for r in news.section_counts(items).collect()} == {("news", 1), ("articles", 1), ("podcasts", 1)}
    lines = [r.line for r in news.inventory(items).collect()]
    assert "- 1. トピック: Cloud cost tool update - Vendor blog (N/A)" in lines


def test_feed_files(spark, tmp_path):
    (tmp_path / "r.xml").write_text("<rss><channel><item><title>T1</title><link>http://a/1</link><description>d</description><pubDate>x</pubDate></item></channel></rss>")
    row = feeds.read_feed_items(spark, str(tmp_path / "r.xml")).first()
    assert (row.title, row.url, row.published_at) == ("T1", "http://a/1", "x")
    (tmp_path / "a.xml").write_text('<feed><entry><title>T2</title><link href="http://a/2"/><link rel="self" href="http://s"/><updated>u</updated><summary>s</summary></entry></feed>')
    row = feeds.read_feed_items(spark, str(tmp_path / "a.xml"), "atom").first()
    assert (row.title, row.url, row.published_at, row.summary) == ("T2", "http://a/2", "u", "s")


def test_directory_hash(spark, tmp_path):
    import hashlib

    (tmp_path / "s").mkdir()
    parts = {"b.txt": b"2", "a.txt": b"1", "s/c.txt": b"3"}
    for name, content in parts.items():
        (tmp_path / name).write_bytes(content)
    digest = hashlib.sha256()
    for name in sorted(parts):
        digest.update(name.encode() + b"\0" + hashlib.sha256(parts[name]).hexdigest().encode() + b"\0")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    assert state.directory_hash(state.file_hashes(files), str(tmp_path)).first()[0] == digest.hexdigest()


def test_guard_fails_on_changed_input(spark):
    old = spark.createDataFrame([("u", "pending", "h1")], "unit_id string, status string, input_sha256 string")
    new = spark.createDataFrame([("u", "h2")], "unit_id string, input_sha256 string")
    with pytest.raises(Exception, match="does not match"):
        state.guarded(old, new).collect()
    assert state.guarded(old, new, force=True).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(300).selectExpr(
        "cast(id % 250 as string) as id", "timestamp '2024-01-01' + make_dt_interval(0, id % 250) as ts", "concat('u', id % 7) as user_label",
        "'channel' as kind", "case when id % 5 = 0 then 'an Error' else 'fine' end as content",
    )
    src = str(tmp_path / "src")
    rows.repartition(1).write.parquet(src)
    late = spark.createDataFrame([("end", "2024-03-01 00:00:00")], "id string, t string").selectExpr("id", "cast(t as timestamp) ts", "'z' user_label", "'channel' kind", "'x' content")
    schema = rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    expected_base = rows.dropDuplicates(["id"])
    for name, count in (("users", activity_stream.daily_users), ("totals", activity_stream.daily_totals), ("words", activity_stream.daily_keywords)):
        out, state_dir, inbox = (str(tmp_path / f"{name}-{x}") for x in ("out", "state", "in"))
        rows.repartition(1).write.parquet(inbox)
        for _ in range(2):
            stream = activity_stream.distinct_messages(activity_stream.read_messages(spark, inbox, schema))
            activity_stream.start(count(stream), out, state_dir, once=True).awaitTermination()
            late.write.mode("append").parquet(inbox)
        got = sorted(map(tuple, spark.read.parquet(out).collect()))
        assert got == sorted(map(tuple, count(expected_base).collect())) and got
