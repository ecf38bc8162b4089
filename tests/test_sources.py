"""Sources and streams on small files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from meetlake.sources import readers as S
from meetlake.streaming import live as V


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return f"file://{path}"


def test_library(spark, tmp_path):
    meeting = {"id": "m1", "title": "T", "lines": [{"speaker": 0, "start": 0, "end": 1.5, "text": "hi"}], "notes": [{"id": 1, "window": 0, "ts": "0:01", "tag": None, "text": "n"}], "speakerNames": {"0": "Ann", "x": "?"}, "speakerPeople": {"0": "p1"}}
    write(tmp_path / "lib/a.json", json.dumps(meeting))
    write(tmp_path / "lib/b.json", "{broken")
    rows = S.library(spark, f"file://{tmp_path}/lib")
    assert [r.id for r in rows.collect()] == ["m1"]
    assert [(r.utt_idx, r.text, r.end_s) for r in S.utterances(rows).collect()] == [(0, "hi", 1.5)]
    assert [(r.ts_s, r.text) for r in S.notes(rows).collect()] == [(1, "n")]
    assert [(r.speaker, r.name, r.person_id) for r in S.speaker_links(rows).collect()] == [(0, "Ann", "p1")]


def test_segment_records(spark, tmp_path):
    path = write(tmp_path / "seg/a.txt", "0\x1f0.5\x1f1.5\x1fhello\nworld\x1f10,20\x1e1\x1fx\x1f2\x1fbad\x1e1\x1f2\x1f3\x1e1\x1f2\x1f3\x1fok\x1e")
    assert sorted((r.speaker, r.text, r.char_ms) for r in S.segment_records(spark, path).collect()) == [(0, "hello\nworld", [10, 20]), (1, "ok", None)]


def test_texts(spark):
    rows = spark.createDataFrame([("m", "#1 [0:12] (ACTION) do it\nnoise\n#2 [1:00] plain")], "meeting_id string, journal string")
    assert [(r.note_idx, r.note_id, r.tag, r.text) for r in S.note_journal(rows).orderBy("note_idx").collect()] == [(0, 1, "ACTION", "do it"), (1, 2, None, "plain")]
    rows = spark.createDataFrame([("m", "TITLE: Budget\nDECISIONS:\n- keep [c1]\n- None\nfoo [0:01-0:05]\n")], "meeting_id string, notes string")
    assert [(r.section, r.item) for r in S.sectioned_notes(rows).orderBy("pos").collect()] == [("TITLE", "Budget"), ("DECISIONS", "keep"), ("DECISIONS", "foo")]
    rows = spark.createDataFrame([("m", "【Decisions】\n- go [1:05]\n- None\n【Other】\n- 無")], "meeting_id string, minutes string")
    found = S.minutes(rows, spark.createDataFrame([("Decisions", "DECISION")], "heading string, tag string")).collect()
    assert [(r.tag, r.text, r.ts) for r in found] == [("DECISION", "go", "1:05")]
    rows = spark.createDataFrame([("m", 0, "[0:05] S1: hi"), ("m", 1, "[0:06] a very long remark without any name: yes"), ("m", 2, "no")], "meeting_id string, pos int, line string")
    assert [(r.start, r.speaker, r.text) for r in S.transcript_lines(rows).orderBy("pos").collect()] == [(5, "S1", "hi"), (6, None, "a very long remark without any name: yes")]


def test_people_and_feeds(spark, tmp_path):
    more = {"id": "3", "name": " Bo ", "note": 5, "aliases": ["B", "", 7], "emails": "none", "contact": {"key": "k", "org": " O ", "their": [1]}, "created": "x", "voiceEnabled": False, "my": {"a": 1}}
    doc = {"people": [{"id": "1", "name": "Ann", "emails": [{"address": " a@X.co ", "from": "contact"}, "a@x.co", "bad", 5, {"address": " "}]}, {"id": "1", "name": "Later"}, {"id": "", "name": "No"}, {"id": "2", "name": " "}, {"id": 4, "name": "No"}, "text", None, more, {"id": "5", "name": "C", "contact": "call"}]}
    found = S.people(spark, write(tmp_path / "people.json", json.dumps(doc))).collect()
    ann, bo, c = sorted(found, key=lambda r: r.person_id)
    assert (ann.person_id, ann.name, [tuple(e) for e in ann.emails], ann.contact, ann.extra) == ("1", "Ann", [("a@X.co", "contact"), ("bad", "user")], None, None)
    assert (bo.name, bo.note, bo.aliases, bo.emails, bo.created, bo.voice_enabled, json.loads(bo.extra)) == ("Bo", None, ["B"], [], 0, False, {"my": {"a": 1}})
    assert (bo.contact.platform, bo.contact.key, bo.contact.org, bo.contact.missing, json.loads(bo.contact.raw)) == ("android", "k", "O", False, {"their": [1]})
    assert c.contact is None and json.loads(c.extra) == {"contact": "call"}
    again = json.loads(S.directory_documents(S.people(spark, f"{tmp_path}/people.json")).where("person_id = '3'").first().document)
    assert again["my"] == {"a": 1} and again["name"] == "Bo"
    feed = """<rss><channel><item><title>One</title><enclosure type="image/png" url="p.png"/><enclosure type="audio/mpeg" url="http://x/a.mp3?y"/></item>
    <item><title>None</title></item><item><title> </title><enclosure type="audio/mp4" url="http://x/b.m4a"/></item></channel></rss>"""
    found = S.podcast_feed(spark, write(tmp_path / "feed.xml", feed)).orderBy("pos").collect()
    assert [(r.title, r.extension) for r in found] == [("One", "mp3"), ("Episode", "m4a")]
    series = S.podcast_series(spark, write(tmp_path / "s.json", json.dumps({"results": [{"collectionName": "A", "feedUrl": "f"}, {"collectionName": "B"}]})))
    assert [(r.name, r.feed) for r in series.collect()] == [("A", "f")]


def test_script_dictionary(spark, tmp_path):
    path = write(tmp_path / "d.txt", "# c\n后\t後 后\n干\t幹 乾\n一\t一\n")
    assert {r.key: r.to for r in S.script_dictionary(spark, path).collect()} == {"后": "後", "干": "幹"}
    assert {r.key: r.to for r in S.script_dictionary(spark, path, True).collect()} == {"後": "后", "幹": "干", "乾": "干"}


@pytest.mark.parametrize("files", [1, 3])
def test_frozen_lines_equal_their_batch_twin(spark, tmp_path, files):
    rows = [("m", i, (i // 3) % 2, float(i), i + 1.0, f"{i} ", i + 1.0, i + 0.5) for i in range(60)]
    frame = spark.createDataFrame(rows, "meeting_id string, seq long, speaker int, start_s double, end_s double, text string, fed_s double, committed_s double")
    for k in range(files):
        part = frame.where((F.col("seq") >= 60 * k // files) & (F.col("seq") < 60 * (k + 1) // files))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")
    found = V.replayed(spark, V.frozen_lines(stream), f"file://{tmp_path}/out")
    key = lambda df: sorted((r.segment, r.speaker, r.start_s, r.end_s, r.text) for r in df.collect())
    assert key(found) == key(V.settled_lines(frame)) != []
