from __future__ import annotations

import json

import pytest

from quillon.functions import text as T
from quillon.plans import pipeline
from quillon.sources import feeds, sinks

FEED = """<feed><entry><id>u1</id><name>n1</name><title>One</title><language>eng,fra</language><articleCount>7</articleCount><issued>2024-05</issued>
<link rel="http://opds-spec.org/acquisition/open-access" type="application/x-zim" href="/one.zim" length="123"/><link rel="alternate" type="text/html" href="http://x/one"/></entry>
<entry><id>u2</id><name></name><link rel="a" type="b" href="http://x/two" length="9"/></entry><entry><id>u3</id><name>n3</name><link rel="a" type="application/x-zim" href="http://x/three"/></entry><entry><id>u4</id><name>n4</name><link rel="a" type="b" href="http://x/four"/></entry></feed>"""
METALINK = """<metalink><file name="one.zim"><size>123</size><hash type="md5">m</hash><hash type="sha-256">s</hash>
<url priority="20">http://b</url><url>http://c</url><url priority="3">http://a</url></file></metalink>"""


def test_atom_feed(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(FEED)
    rows = {r.id: r for r in feeds.atom_feed(spark, str(tmp_path / "feed.xml"), "http://base/").collect()}
    assert set(rows) == {"u1", "u3"} and rows["u1"].url == "http://base/one.zim" and rows["u1"]["size"] == 123 and rows["u1"].article_count == 7
    assert rows["u3"].url == "http://x/three" and rows["u3"]["size"] == 0 and rows["u3"].title == "n3"


def test_metalink(spark, tmp_path):
    (tmp_path / "m.xml").write_text(METALINK)
    row = feeds.metalink(spark, str(tmp_path / "m.xml")).first()
    assert (row["name"], row["size"], row.sha256, list(row.mirrors)) == ("one.zim", 123, "s", ["http://a", "http://b", "http://c"])


ENTRIES = "zim_id int, path string, mimetype string, content string, is_redirect boolean, redirect_target string"


def test_entries(spark):
    rows = [
        (1, "A/x", "text/html; charset=utf-8", "", False, None), (1, "img", "image/png", "", False, None), (1, "main", "text/html", "", True, "A/x"),
        (1, "index/v1", "text/html", "", False, None), (1, "v/v1.json", "application/json", '{"videoPath": "v.webm", "duration": "PT1M"}', False, None),
        (1, "v/v2.json", "application/json", '{"videoPath": "w.webm"}', False, None), (1, "files/d.pdf", "application/pdf", "", False, None),
        (1, "db.js", "application/javascript", "var DATABASE = [{'_id': 1, 'ti': 'Doc', \"aut\": \"Me\", 'fp': ['d.pdf', 'e.pdf']}, {'ti': 'Gone', 'fp': ['no.pdf']}]", False, None),
    ]
    entries = spark.createDataFrame(rows, ENTRIES)
    assert {r.path for r in feeds.text_entries(entries).collect()} == {"A/x", "index/v1"}
    assert feeds.main_entry(entries, "main").first().path == "A/x"
    from pyspark.sql import functions as F

    assert feeds.read_entry(entries, F.lit("A/x#part")).count() == 1
    assert [(r.path, r.video) for r in feeds.media_sidecars(entries).collect()] == [("index/v1", "v.webm")]
    found = feeds.document_manifest(entries.where("path = 'db.js'"), entries).collect()
    assert [(r.doc_path, r.title, r.author) for r in found] == [("files/d.pdf", "Doc", "Me")]


def test_bench_questions(spark, tmp_path):
    good = '{"questions": [{"id": "a", "question": "q?", "expected_behavior": "answer", "sources": [{"article_path": "p", "required": true}]}, {"id": "b", "question": "r", "expected_behavior": "abstain", "level": 1}]}'
    (tmp_path / "q.json").write_text(good)
    assert {r.id: r.level for r in feeds.bench_questions(spark, str(tmp_path / "q.json")).collect()} == {"a": 3, "b": 1}
    (tmp_path / "bad.json").write_text(good.replace('"b"', '"a"'))
    with pytest.raises(Exception, match="twice"):
        feeds.bench_questions(spark, str(tmp_path / "bad.json")).collect()


def test_golden_and_ranges(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("name: base\nentries:\n- {id: a, query: q, expected_paths: [A/x]}\n- {id: b, query: r, slice: own, provenance: made}\n")
    rows = {r.id: r for r in feeds.golden_slices(spark, str(tmp_path)).collect()}
    assert rows["a"].slice == "base" and rows["a"].provenance == "hand-written" and rows["b"].slice == "own" and rows["b"].expected_paths == []
    assert feeds.byte_range("bytes=0-9", 100) == (0, 9) and feeds.byte_range("bytes=-5", 100) == (95, 99) and feeds.byte_range("bytes=90-", 100) == (90, 99)
    assert feeds.byte_range("bytes=100-", 100) is None and feeds.byte_range("lines=1-2", 100) is None


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").write.parquet(path)
    sinks.upsert_table(spark, path, spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string"), ["id"])
    sinks.upsert_table(spark, path, spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string"), ["id"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "B"), (3, "C")]
    parts = str(tmp_path / "p")
    spark.createDataFrame([(1, "a"), (2, "b")], "z int, v string").write.partitionBy("z").parquet(parts)
    sinks.reload_partitions(spark.createDataFrame([(2, "x"), (2, "y")], "z int, v string"), parts, "z")
    assert sorted((r.z, r.v) for r in spark.read.parquet(parts).collect()) == [(1, "a"), (2, "x"), (2, "y")]


def test_profiles():
    with pytest.raises(ValueError, match="no parameter"):
        pipeline.profile("x", ("fuser", "rrf", {"kk": 1}))
    with pytest.raises(ValueError, match="no fuser"):
        pipeline.profile("x", ("fuser", "nope", {}))
    with pytest.raises(ValueError, match="order"):
        pipeline.profile("x", ("fuser", "rrf", {}), ("query_preparer", "normalize", {}))
    a, b = pipeline.sweep(pipeline.PROFILES["lexical"], "rrf.k=10,20.5")
    assert a.hash() != b.hash() and dict(b.parts[2][2])["k"] == 20.5
    with pytest.raises(ValueError):
        pipeline.sweep(pipeline.PROFILES["lexical"], "nothing.k=1")


def test_text_functions(spark):
    from pyspark.sql import functions as F

    def one(column):
        return spark.range(1).select(column.alias("x")).first().x

    shell = """<meta http-equiv="refresh" content="0;URL='../../A/Target'">"""
    assert one(T.soft_redirect_target(F.lit(shell))) == "A/Target" and one(T.soft_redirect_target(F.lit(shell + " " * 600))) is None
    assert one(T.entry_flags(F.lit("Mercury (disambiguation)"), F.lit(shell), F.lit(True), F.lit(10))) == 1 + 2 + 4 + 16
    assert one(T.entry_flags(F.lit("List of things"), F.lit(None).cast("string"), F.lit(False), F.lit(0))) == 8
    assert one(T.query_terms(F.lit("How do I mount a USB 'drive'?"))) == ["mount", "usb", "drive"] and one(T.query_terms(F.lit("the the"))) == ["the", "the"]
    assert one(T.vtt_text(F.lit("WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\nHello\n00:01:39\nNOTE x\nthere"))) == "1\nHello\nthere"
    assert one(T.markdown_text(F.lit("# Head\n\n\n\n**b** [t](u) `c`"))) == "Head\n\nb t c"
    assert one(T.looks_abstained(F.lit("I could not find it"))) and one(T.looks_abstained(F.lit(" "))) and not one(T.looks_abstained(F.lit("Paris")))
    assert one(T.title_key(F.lit("./A/Some_Title"))) == "some title"
    long = "start " * 60 + "needle " + "end " * 60
    shown = one(T.snippet(F.lit(long), F.array(F.lit("needle"))))
    assert "needle" in shown and shown.startswith("…") and shown.endswith("…") and len(shown) <= 222


def test_profiles_of_a_file_are_the_built_in_ones():
    text = json.dumps({name: [[stage, own, dict(params)] for stage, own, params in p.parts] for name, p in pipeline.PROFILES.items()})
    assert pipeline.load_profiles(text) == pipeline.PROFILES
    with pytest.raises(ValueError, match="no parameter"):
        pipeline.load_profiles('{"x": [["fuser", "rrf", {"kk": 1}]]}')
