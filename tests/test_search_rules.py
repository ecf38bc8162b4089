"""Folding in stages, routing by people, reading windows of two levels, imports, links: hand cases of the rules."""

from __future__ import annotations

import json
import random


from pyspark.sql import functions as F

from meetlake.functions import text as X
from meetlake.operators import mail as M
from meetlake.operators import passages as P
from meetlake.operators import people as O
from meetlake.operators import retrieval as R
from meetlake.operators.script import converted, folded, staged


def plain_fold(text: str, entries: dict[str, str]) -> str:
    """At every place the longest entry."""
    out, at = "", 0
    while at < len(text):
        key = next((text[at : at + n] for n in range(max(map(len, entries)), 0, -1) if text[at : at + n] in entries), None)
        out, at = out + (entries[key] if key else text[at]), at + len(key or "x")
    return out


def test_stages_take_the_longest_entry_from_the_left(spark):
    first = {"後天": "后天", "後": "后", "皇后": "皇后", "乾隆": "乾隆", "乾": "干", "a" * 40: "long", "aab": "B", "ab": "C"}
    second = {"后": "H", "干": "G", "天": "T", "B": "後"}
    rows = [(1, "皇后後天乾隆乾杯"), (2, "a" * 40 + "aabab"), (3, "後です"), (4, ""), (5, None), (6, "aaab" * 30 + "x")]
    chance = random.Random(2)
    rows += [(10 + i, "".join(chance.choice("後天皇乾隆杯ab x") for _ in range(30))) for i in range(60)]
    texts = spark.createDataFrame(rows, "id int, text string")
    frames = [spark.createDataFrame(list(d.items()), "key string, to string") for d in (first, second)]
    want = {i: t if not t or "で" in t else plain_fold(plain_fold(t, first), second) for i, t in rows}
    assert {r.id: r.text for r in staged(texts, frames).collect()} == want
    assert {r.id: r.one for r in folded(texts, "text", frames, "one").collect()} == want
    assert converted(texts, frames[0].where("false")).count() == len(rows)


def test_search_and_names_in_one_script(spark):
    phrases = spark.createDataFrame([("計程車", "出租车"), ("車", "车"), ("張", "张")], "key string, to string")
    texts = spark.createDataFrame([("m", "note", 0, "搭計程車"), ("m", "note", 1, "出租车很慢"), ("m", "line", 2, "計程車"), ("n", "title", 0, "車")], "meeting_id string, kind string, pos int, text string")
    asked = spark.createDataFrame([(1, "出租车", "m"), (2, " 車 ", "x"), (3, "  ", "m")], "query_id int, query string, open_meeting string")
    found = R.lexical(texts, asked, dictionaries=[phrases]).collect()
    assert {(r.query_id, r.meeting_id, r.kind, r.pos) for r in found} == {(1, "m", "note", 0), (1, "m", "note", 1), (1, "m", "line", 2), (2, "m", "note", 0), (2, "m", "note", 1), (2, "n", "title", 0)}
    names = spark.createDataFrame([("p", "張三")], "person_id string, name string")
    assert [r.person_id for r in O.mentioned(spark.createDataFrame([(1, "张三說了什麼")], "query_id int, query string"), names, [phrases]).collect()] == ["p"]
    assert O.mentioned(spark.createDataFrame([(1, "张三說了什麼")], "query_id int, query string"), names).count() == 0


def test_words_meet_texts_by_their_rarest_pair(spark):
    texts = spark.createDataFrame([(k, "common words " + ("rare zq" if k == 3 else "here")) for k in range(50)] + [(60, None), (61, "z")], "id int, t string")
    words = spark.createDataFrame([("rare zq",), ("common",), ("none",), ("z",)], "w string")
    found = R.containing(texts, words, "t", "w").collect()
    assert sorted((r.id, r.w) for r in found) == sorted([(3, "rare zq"), *((k, "common") for k in range(50))])


def test_routing_restricted_to_named_people(spark):
    kinds = "query_id int, meeting_id string, score double"
    dense = spark.createDataFrame([(q, m, s) for q in (1, 2, 3) for m, s in (("a", 0.9), ("a", 0.9), ("b", 0.8), ("c", 0.5))], kinds)
    words = spark.createDataFrame([(q, "d", 3.0) for q in (1, 2, 3)], kinds)
    named = spark.createDataFrame([(1, "c"), (1, "c"), (1, "d"), (2, "nowhere")], "query_id int, meeting_id string")
    found = R.routed(dense, words, 2, named).collect()
    assert {(r.query_id, r.rank, r.meeting_id) for r in found} == {(1, 1, "c"), (1, 2, "d"), (2, 1, "a"), (2, 2, "d"), (3, 1, "a"), (3, 2, "d")}
    assert {(r.query_id, r.meeting_id) for r in R.routed(dense, words, 0, named).collect()} == {(1, "c")}


def plain_segments(lines, budget: int, seconds: int):
    """A line after the other, as they are read."""
    window, used, segment, end, closed, out = -1, 0, 0, 0, False, []
    for idx, start, label, text in lines:
        clock = f"{start // 60}:{start % 60:02d}"
        header = f"[{clock}] {label}: "
        own = [text] if X.estimated(header + text) <= budget else P.cut_long(text, header, budget, X.estimated)
        for piece, part in enumerate(own):
            n = X.estimated(header + part)
            if window < 0 or used + n > budget:
                window, used, segment, end = window + 1, 0, 0, start + seconds
            elif closed:
                segment += 1
            used += n
            out.append((idx, piece, window, segment, part, n))
            closed = start >= end
            end = start + seconds if closed else end
    return out


def test_reading_windows_and_segments(spark):
    assert X.estimated("two words 字字") == 2 + 3
    cut = P.cut_long("one, two three four. five six", "[0:01] S1: ", 8, X.estimated)
    assert "".join(cut) == "one, two three four. five six" and all(X.estimated("[0:01] S1: " + x) <= 8 for x in cut)
    chance, lines = random.Random(1), []
    for idx in range(60):
        lines.append((idx, (lines[-1][1] if lines else 0) + chance.choice([0, 3, 9, 25]), "S1", " ".join(chance.choice(["word", "word,", "字", "end."]) for _ in range(chance.choice([1, 5, 12, 60])))))
    frame = spark.createDataFrame([("m", *x) for x in lines], "meeting_id string, utt_idx int, start int, label string, text string")
    found = P.reading_segments(frame, 40).orderBy("utt_idx", "piece").collect()
    assert [(r.utt_idx, r.piece, r.window, r.segment, r.text, r.tokens) for r in found] == plain_segments(lines, 40, 20)
    assert any(r.piece for r in found) and any(r.segment for r in found)


def test_imports_keep_what_differs_from_what_is_derived(spark):
    def derive(notes):
        return notes.where("tag = 'ACTION'").selectExpr("meeting_id", "concat('- ', text, ' [', ts, ']') AS actions")

    journal = "#1 [0:05] (ACTION) Go\nprose"
    cases = [{"notes": journal, "action_items": " - Go [0:05] "}, {"notes": journal, "action_items": "- Stay [0:05]"}, {"notes": journal, "action_items": "-"}, {"notes": "TOPIC: x\n- y"}, {"notes": "prose"}, {"title": "T", "utterances": [{"start": 1, "end": 2.5, "text": "hi"}], "speaker_names": {"0": {"name": "", "person": "p"}, "1": {"name": "A", "person": ""}, "x": {"name": "B"}}}]
    rows = spark.createDataFrame([*((k, json.dumps(c)) for k, c in enumerate(cases)), (90, "{broken"), (91, None), (92, "{}")], "meeting_id int, manifest string")
    meetings, lines, links, notes = M.imported(rows, derive)
    found = {r.meeting_id: r for r in meetings.collect()}
    assert set(found) == set(range(6))
    assert [found[k].actions_edited for k in range(6)] == [None, "- Stay [0:05]", None, None, None, None]
    assert [found[k].legacy_notes for k in range(6)] == [None, None, None, "TOPIC: x\n- y", None, None]
    assert (found[5].title, found[5].seconds, found[0].title) == ("T", 2.5, "") and notes.count() == 3
    assert [(r.utt_idx, r.speaker, r.text) for r in lines.collect()] == [(0, 0, "hi")] and [(r.speaker, r.name, r.person_id) for r in links.collect()] == [(1, "A", None)]


def test_links_are_added_once(spark):
    people = spark.createDataFrame([("p1", "Ann", 1, 5), ("p2", "ann", 1, 50)], "person_id string, name string, created long, last_used long")
    names = spark.createDataFrame([("m", 10, 0, "ANN ", None), ("m", 10, 1, "Speaker 2", None), ("m", 10, 2, "Bo", "p2"), ("n", 20, 0, "bo  b", None), ("n", 20, 1, "Bo B", "gone"), ("o", 5, 0, "BO B", None)], "meeting_id string, date long, speaker int, name string, person_id string")
    after, links = O.linked_up(names, people)
    got = {(r.meeting_id, r.speaker): (r.name, r.person_id, r.added) for r in links.collect()}
    new = next(r.person_id for r in after.collect() if r.person_id not in ("p1", "p2"))
    assert got == {("m", 0): ("ANN", "p1", True), ("m", 2): ("Bo", "p2", False), ("n", 0): ("bo  b", new, True), ("n", 1): ("Bo B", new, True), ("o", 0): ("BO B", new, True)}
    assert {(r.person_id, r.name, r.created, r.last_used) for r in after.collect()} == {("p1", "Ann", 1, 10), ("p2", "ann", 1, 50), (new, "bo  b", 20, 20)}
    dates = {"m": 10, "n": 20, "o": 5}
    again = spark.createDataFrame([(m, dates[m], s, n, p) for (m, s), (n, p, _) in got.items()], names.schema)
    after2, links2 = O.linked_up(again, after)
    assert {(r.meeting_id, r.speaker): (r.name, r.person_id) for r in links2.collect()} == {k: v[:2] for k, v in got.items()} and not any(r.added for r in links2.collect())
    assert sorted(map(str, after2.collect())) == sorted(map(str, after.collect()))


def test_terms_of_texts_of_all_kinds(spark):
    texts = ["plain words 12 a_b", "Füße été №5", "禮券多少 mixed 字 x", "𝒳𝒴 astral a", "", "a\x00b", "ｗｉｄｅ ひら"]
    found = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", X.terms(F.col("text")).alias("t")).orderBy("i").collect()]
    assert found == [["plain", "words", "12", "a", "b"], ["Füße", "été", "5"], ["禮券", "券多", "多少", "mixed", "字", "x"], ["astral", "a"], [], ["a", "b"], ["ｗｉｄｅ", "ひら"]]
