"""Hand cases of the rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from meetlake.functions import text as X
from meetlake.operators import directory
from meetlake.operators import library as L
from meetlake.operators import notes as N
from meetlake.operators import passages as P
from meetlake.operators import people as O
from meetlake.operators import render as D
from meetlake.operators import retrieval as R
from meetlake.operators import segments as S
from meetlake.operators import timeline as T


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], names).select(column(*map(F.col, names)).alias("x")).first().x


def test_terms(spark):
    assert one(spark, X.terms, t="頭獎是 iphone 16") == ["頭獎", "獎是", "iphone", "16"]
    assert one(spark, X.terms, t="車") == ["車"]
    assert one(spark, X.terms, t="") == []


def test_token_estimates(spark):
    for text, n in (("搬遷預算", 4), ("the movers budget", 4), ("預算 80k 上限是多少", 9)):
        assert one(spark, X.token_estimate, t=text) == n


def test_clocks(spark):
    assert [one(spark, X.clock, s=s) for s in (0.0, 61.9, 3600.0, 7325.0)] == ["0:00", "1:01", "1:00:00", "2:02:05"]
    assert one(spark, X.long_clock, s=61.0) == "01:01"
    assert [one(spark, X.seconds_of, t=t) for t in ("1:05", "2:02:05", "1:60", "x", "1:5")] == [65, 7325, None, None, None]
    assert one(spark, lambda s: X.subtitle_clock(s, ","), s=3661.2345) == "01:01:01,235"
    assert one(spark, X.lyric_clock, s=61.239) == "01:01.23"
    assert one(spark, X.duration_text, s="3080") == "51:20"


def test_clean_text(spark):
    assert one(spark, X.clean, t=" [Noise] 嗯，好的。 呃 對 ") == "好的。 對"
    assert one(spark, X.similar, a="abcd", b="bcde") == pytest.approx(0.5)
    assert one(spark, X.edit_tokens, t="Well, 頭獎 is 5!") == ["Well, ", "頭", "獎 ", "is ", "5!"]
    assert one(spark, X.width, t="ab頭獎") == 6
    assert one(spark, X.anchors, t="x [1:05, 2:00] y [3:00]") == ["1:05", "2:00", "3:00"]


def test_addresses_and_names(spark):
    for address, fine in (("a@b.co", True), ("a@b", False), ("a b@c.de", False), (".a@b.co", False), ("a..b@c.de", False), ("a@-b.co", False)):
        assert one(spark, X.is_email, a=address) is fine
    assert one(spark, X.email_key, a="Ann@Mail.ORG") == "Ann@mail.org"
    assert [one(spark, X.is_person_name, n=n) for n in ("Ann", "Speaker 2", "語者 3", "  ")] == [True, False, False, False]
    assert one(spark, X.name_key, n="ＡＮＮ　 Lee ") == "ann lee"


def test_bm25_scores_only_shared_terms(spark):
    docs = spark.createDataFrame([(1, "停車費要繳"), (2, "禮券多少錢"), (3, "今天天氣")], "doc_id long, text string")
    hits = R.bm25(docs, spark.createDataFrame([(1, "禮券多少")], "query_id long, query string")).collect()
    assert [h.doc_id for h in hits] == [2]


def test_line_at_a_time(spark):
    lines = spark.createDataFrame([("m", i, s) for i, s in enumerate((196.2, 202.4, 210.3, 210.8))], "meeting_id string, utt_idx int, start_s double")
    asked = spark.createDataFrame([("m", 0, 202.0), ("m", 1, 201.0), ("m", 2, 3.0), ("none", 3, 1.0)], "meeting_id string, q_id int, t double")
    assert {r.q_id: r.utt_idx for r in T.line_at(asked, lines).collect()} == {0: 1, 1: 0, 2: 0, 3: -1}
    exact = spark.createDataFrame([("m", 0, 210.3), ("m", 1, 205.5)], "meeting_id string, q_id int, t double")
    assert {r.q_id: r.utt_idx for r in T.line_at(exact, lines, False).collect()} == {0: 2, 1: 1}


def test_overlap_join_by_buckets_finds_the_same(spark):
    a = spark.createDataFrame([(1, i, i * 7.0, i * 7.0 + 25) for i in range(40)], "m int, x int, a double, b double")
    b = spark.createDataFrame([(1, i, i * 11.0, i * 11.0 + 30) for i in range(30)], "m int, y int, c double, d double")
    plain = {(r.x, r.y, r.overlap) for r in T.overlap_join(a, b, ["m"], ("a", "b"), ("c", "d")).collect()}
    dealt = [(r.x, r.y, r.overlap) for r in T.overlap_join(a, b, ["m"], ("a", "b"), ("c", "d"), 20.0).collect()]
    assert plain and len(dealt) == len(plain) and set(dealt) == plain


def test_carry_over_is_one_to_one(spark):
    cols = "meeting_id string, speaker int, start_s double, end_s double"
    old = spark.createDataFrame([("m", 0, 0.0, 10.0), ("m", 1, 10.0, 20.0)], cols)
    new = spark.createDataFrame([("m", 1, 0.0, 9.0), ("m", 0, 10.0, 20.0), ("m", 2, 20.0, 30.0)], cols)
    assert {(r.old_speaker, r.new_speaker) for r in T.carry_over(old, new).collect()} == {(0, 1), (1, 0)}


def test_stitching_keeps_what_is_after_the_seam(spark):
    cols = "meeting_id string, utt_idx long, speaker int, start_s double, end_s double"
    prior = spark.createDataFrame([("m", 0, 0, 0.0, 10.0), ("m", 1, 1, 10.0, 20.0)], cols)
    fresh = spark.createDataFrame([("m", 0, 5, 12.0, 20.0), ("m", 1, 5, 21.0, 30.0), ("m", 2, 7, 30.0, 40.0)], cols)
    found = T.stitch(prior, fresh, spark.createDataFrame([("m", 20.0)], "meeting_id string, seam_s double")).where("resumed").collect()
    assert {(r.start_s, r.speaker) for r in found} == {(21.0, 1), (30.0, 2)}


def test_attribution(spark):
    turns = spark.createDataFrame([("m", 1, 0, 0.0, 10.0), ("m", 2, 1, 8.0, 20.0), ("m", 3, 2, 40.0, 50.0)], "meeting_id string, turn_id int, speaker int, t_start double, t_end double")
    spans = spark.createDataFrame([("m", 1, 7.0, 11.0), ("m", 2, 24.0, 25.0), ("m", 3, 34.0, 36.0), ("m", 4, 8.0, 10.0)], "meeting_id string, span_id int, start_s double, end_s double")
    found = {r.span_id: (r.speaker, r.snapped) for r in T.attribute(spans, turns).collect()}
    assert found == {1: (0, False), 2: (1, True), 3: (2, True), 4: (0, False)}
    assert 3 not in {r.span_id for r in T.attribute(spans, turns, 3.5).collect()}
    early = spans.unionByName(spark.createDataFrame([("m", 5, -3.0, -1.0)], spans.schema))
    found = {r.span_id: (r.speaker, r.snapped) for r in T.attribute(early, turns, previous=True).collect()}
    assert found == {1: (0, False), 2: (1, True), 3: (1, True), 4: (0, False), 5: (0, True)}


def test_chunks_share_a_line(spark):
    rows = lambda tokens: spark.createDataFrame([("m", i, i * 5.0, i * 5.0 + 5, n) for i, n in enumerate(tokens)], "meeting_id string, utt_idx long, start_s double, end_s double, tokens int")
    spans = lambda tokens: [(r.a, r.b) for r in P.chunks(rows(tokens)).orderBy("chunk").collect()]
    assert spans([90, 90, 90]) == [(0, 1), (1, 2), (2, 2)]
    assert spans([300]) == [(0, 0)]
    assert spans([90, 90, 190]) == [(0, 1), (1, 1), (2, 2)]
    assert spans([10] * 10) == [(0, 7), (7, 9), (9, 9)]


def test_parts_close_before_the_budget(spark):
    rows = spark.createDataFrame([("m", i, n) for i, n in enumerate((60, 50, 20, 500, 10))], "meeting_id string, utt_idx long, tokens int")
    assert [r.part for r in P.parts(rows, 100).orderBy("utt_idx").collect()] == [0, 1, 1, 2, 3]


def test_guard_counts(spark):
    reply = ["NOTE [0:12] (DECISION) keep it", "NOTE [0:15] (WISH) more", "NOTE no time", "Some prose", "and more", "NEXT", ""]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(reply)], "meeting_id long, utt_idx int, text string")
    r = N.guard_counts(lines).first()
    assert (r.lines, r.notes, r.other, r.unknown, r.malformed) == (5, 2, 2, 1, 1)
    assert not r.exceeds


def test_proposals(spark):
    rows = spark.createDataFrame([(1, "DECISION", "maybe we go"), (2, "ACTION", "we agreed, perhaps"), (3, "NUMBER", "maybe 5"), (4, "DECISION", "we go")], "pos int, tag string, text string")
    assert [r.tag for r in N.reclassified(rows).orderBy("pos").collect()] == ["PROPOSAL", "ACTION", "NUMBER", "DECISION"]
    rows = spark.createDataFrame([(1, "DECISION", "建議改期"), (2, "DECISION", "建議通過")], "pos int, tag string, text string")
    assert [r.tag for r in N.reclassified(rows, "zh").orderBy("pos").collect()] == ["PROPOSAL", "DECISION"]


def test_languages(spark):
    texts = {1: "the quick brown fox " * 8, 2: "我們今天討論預算的問題以及下一步的安排好嗎", 3: "我們今天 review 一下 budget 跟 timeline 然後決定下一步的安排", 4: "ok"}
    lines = spark.createDataFrame(list(texts.items()), "meeting_id long, text string")
    assert {r.meeting_id: r.language for r in N.language(lines).collect()} == {1: "en", 2: "zh", 3: "zh", 4: None}


def test_snapped_times(spark):
    known = spark.createDataFrame([(1, 100), (1, 130), (1, 500)], "meeting_id long, k long")
    cites = spark.createDataFrame([(1, i, t) for i, t in enumerate((100, 115, 116, 531, 530, 60))], "meeting_id long, cite_id int, t long")
    assert [r.snapped for r in N.snapped(cites, known).orderBy("cite_id").collect()] == [100, 100, 130, None, 500, None]


def test_clean_speech_sampling(spark):
    rows = [(0, 0, 0.0, 25.0), (1, 0, 40.0, 70.0), (2, 0, 70.0, 95.0), (3, 1, 30.0, 35.0), (4, 0, 5.0, 6.0)]
    lines = spark.createDataFrame([("m", *r) for r in rows], "meeting_id string, utt_idx int, speaker int, start_s double, end_s double")
    found = T.sampled_speech(T.clean_speech(lines)).orderBy("turn", "third").collect()
    assert sum(r.end_s - r.start_s for r in found) == pytest.approx(60.0)
    assert {r.speaker for r in found} == {0}


def test_segments_and_votes(spark):
    rows = [(0, 3, "a "), (1, 3, "b "), (2, None, "c "), (3, 1, "d "), (4, 3, "e")]
    pieces = spark.createDataFrame([("m", p, s, float(p), p + 1.0, t) for p, s, t in rows], "meeting_id string, pos int, speaker int, start_s double, end_s double, text string")
    found = S.speaker_segments(pieces).orderBy("segment").collect()
    assert [(r.speaker, r.text, r.untagged) for r in found] == [(0, "a b c ", 1), (1, "d ", 0), (0, "e", 0)]
    chars = spark.createDataFrame([("m", i, c, s, False, 0.5) for i, (c, s) in enumerate(zip("it's on", "AABBBBA", strict=True))], "meeting_id string, pos int, ch string, label string, snapped boolean, confidence double")
    assert [(r.text, r.label) for r in S.word_vote(chars).orderBy("word").collect()] == [("it's", "A"), (" ", "B"), ("on", "A")]


def test_people(spark):
    rows = [("m1", "2024-01-01", 0, "Ann"), ("m2", "2024-02-01", 1, "ANN "), ("m2", "2024-02-01", 0, "Bo"), ("m1", "2024-01-01", 1, "Speaker 2")]
    names = spark.createDataFrame(rows, "meeting_id string, date string, speaker int, name string").withColumn("date", F.to_date("date"))
    none = spark.createDataFrame([], "person_id string, name string, last_used date")
    first = O.bootstrap(names, none)
    assert {(r.name, r.created) for r in first.collect()} == {("ANN", True), ("Bo", True)}
    again = O.bootstrap(names, first.select("person_id", "name", "last_used"))
    assert {(r.name, r.created) for r in again.collect()} == {("ANN", False), ("Bo", False)}
    asked = spark.createDataFrame([(1, "What did Mark say?"), (2, "the market fell"), (3, "問王小明的事"), (4, "王先生")], "query_id int, query string")
    people = spark.createDataFrame([("p1", "Mark"), ("p2", "王小明"), ("p3", "王")], "person_id string, name string")
    assert {(r.query_id, r.person_id) for r in O.mentioned(asked, people).collect()} == {(1, "p1"), (3, "p2")}


def test_voices_and_suggestions(spark):
    e = spark.createDataFrame([("a", 10.0, [2.0, 0.0]), ("a", 30.0, [0.0, 5.0]), ("b", 5.0, [1.0, 0.0]), ("c", 1.0, [0.0, 0.0])], "person string, seconds double, vector array<double>")
    found = {r.person: r.vector for r in O.voices(e, ["person"], 2).collect()}
    assert set(found) == {"a", "b"} and found["a"] == pytest.approx([1 / 10**0.5, 3 / 10**0.5])
    people = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.8, 0.6])], "person string, vector array<double>")
    speakers = spark.createDataFrame([("m", 0, [1.0, 0.0]), ("m", 1, [0.8, 0.6]), ("m", 2, [0.0, 1.0])], "meeting_id string, speaker int, vector array<double>")
    assert {(r.speaker, r.person, r.level) for r in O.suggested(speakers, people, 2).collect()} == {(0, "a", "likely"), (1, "b", "likely")}


def test_cues_are_cut_and_timed(spark):
    kinds = "meeting_id string, utt_idx int, start_s double, end_s double, name string, text string"
    cut = lambda text, end=10.0: [(r.text, r.start_s, r.end_s) for r in D.cues(spark.createDataFrame([("m", 0, 0.0, end, "A", text)], kinds)).orderBy("cue").collect()]
    assert cut("Yes. I agree.") == [("Yes. I agree.", 0.0, 10.0)]  # fits as it is
    assert cut("\n \n one\n \n two \n") == [("one\n two", 0.0, 10.0)]
    assert cut(" \n ") == [] and cut("x", 0.0) == [("x", 0.0, 1.0)]
    assert cut("Short one. " + "w" * 60 + ".", 71.0) == [("Short one.", 0.0, 10.0), ("w" * 60 + ".", 10.0, 71.0)]  # trimmed before time is shared
    spoken = "the whole board objected to postponing the remaining decisions until the spring of the year after"
    assert [x for x, _, _ in cut(spoken)] == ["the whole board objected to postponing the remaining decisions", "until the spring of the year after"]
    assert [x for x, _, _ in cut("字" * 40)] == ["字" * 32, "字" * 8]
    assert [x for x, _, _ in cut("字" * 15 + "，" + "字" * 20)] == ["字" * 15 + "，", "字" * 20]
    assert [x for x, _, _ in cut("字" * 14 + "，" + "字" * 20)] == ["字" * 14 + "，" + "字" * 17, "字" * 3]
    lines = spark.createDataFrame([("m", 0, 0.0, 10.0, "A", "One. two")], kinds)
    assert D.subtitles(D.cues(lines)).first().subtitles == "1\n00:00:00,000 --> 00:00:10,000\nA: One. two\n"


def test_library_edits(spark):
    people = spark.createDataFrame([(k, k.upper(), None, ["Y"], 1, 1, True, False, [], None) for k in "abc"], directory.PEOPLE)
    rows = [("a", 1, "rename", "X"), ("a", 2, "rename", " Y "), ("b", 3, "voice_off", None), ("c", 4, "delete", None), ("c", 5, "create", "again"), ("d", 6, "rename", "too early"), ("d", 7, "create", "D"), ("d", 8, "me", None), ("b", 9, "email_add", " b@X.org "), ("b", 10, "email_add", "b@x.ORG"), ("b", 11, "email_add", "nobody")]
    edits = spark.createDataFrame([(p, n, n, k, v, False, None) for p, n, k, v in rows], directory.EDITS)
    found = {r.person_id: r for r in directory.directory_after(people, edits).collect()}
    assert {(r.person_id, r.name, r.voice_enabled, r.me, tuple(r.aliases)) for r in found.values()} == {("a", "Y", True, False, ()), ("b", "B", False, False, ("Y",)), ("d", "D", True, True, ())}
    assert [(e.address, e["from"]) for e in found["b"].emails] == [("b@X.org", "user")] and found["d"].created == 7
    assert {r.name for r in directory.directory_after(people, edits.where("false")).collect()} == set("ABC") and directory.directory_after(people.where("false"), edits).count() == 2  # "c" is new here
    gone = spark.createDataFrame([(1,)], "meeting_id int")
    audio = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y")], "meeting_id int, audio string")
    assert [r.audio for r in L.kept_audio(gone, audio).collect()] == ["x"]


def test_merging_people(spark):
    people = spark.createDataFrame([(1, "A", ["a"], 5, 9), (2, "B", ["a", "b"], 3, 7), (3, "C", ["c"], 1, 1)], "person_id int, name string, aliases array<string>, created int, last_used int")
    found = {r.person_id: r for r in O.merged(people, spark.createDataFrame([(2, 1)], "from_id int, into_id int")).collect()}
    assert set(found) == {1, 3}
    assert (found[1].name, found[1].aliases, found[1].created, found[1].last_used) == ("A", ["a", "B", "b"], 3, 9)
