"""Hand cases of edits, answers, mails, voices and scripts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from meetlake.functions import text as X
from meetlake.functions.amounts import amount, amounts_in_digits, in_digits
from meetlake.operators import ask as K
from meetlake.operators import edits as E
from meetlake.operators import mail as M
from meetlake.operators import notes as N
from meetlake.operators import render as D
from meetlake.operators import snap as Z
from meetlake.operators import voice as V
from meetlake.operators.script import converted


def test_amounts(spark):
    cases = {"八萬二": 82_000, "四千五": 4500, "一萬零五": 10_005, "二十五": 25, "一億二千萬": 120_000_000, "3.5萬": 35_000, "一千": 1000, "三百五": 350, "十二": 12}
    assert {k: amount(k) for k in cases} == cases
    assert amount("二三") is None
    assert in_digits("預算八萬二，人數三百五") == "預算82,000，人數三百五"
    rows = spark.createDataFrame([("花了四千五",), (None,)], "t string")
    assert [r.x for r in rows.select(amounts_in_digits("t").alias("x")).collect()] == ["花了4,500", None]


def test_titles_and_prose(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t")).alias("x")).first().x
    assert one(X.title_cut, "x" * 50) == "x" * 40
    assert one(X.title_cut, "word " * 11) == "word " * 11
    assert one(X.title_cut, "word, " * 20) == "word, " * 9 + "word"
    prose = lambda t: X.clean_prose(t, "<end>")
    assert one(prose, "# Head line here\n- bullet\nThe plan  is fine .\nMore text follows here<end>junk") == "Head line here\n\nThe plan is fine.\n\nMore text follows here"
    assert one(prose, "The budget was kept as it is. And then we") == "The budget was kept as it is."
    assert one(prose, "short<end>") is None


def test_script_conversion(spark):
    words = spark.createDataFrame([("后", "後"), ("皇后", "皇后"), ("干", "幹"), ("干杯", "乾杯")], "key string, to string")
    texts = spark.createDataFrame([(1, "皇后干杯后干"), (2, "無"), (3, "后です"), (4, "")], "id int, text string")
    assert {r.id: r.text for r in converted(texts, words).collect()} == {1: "皇后乾杯後幹", 2: "無", 3: "后です", 4: ""}


def test_changes_move_to_turn_starts(spark):
    chars = [("m", i, c, 10 + i * 0.1, 10.1 + i * 0.1, "A" if i < 6 else "B") for i, c in enumerate("我覺得好對嗎是的沒錯")]
    frame = spark.createDataFrame(chars, "meeting_id string, pos int, ch string, start_s double, end_s double, label string")
    turns = spark.createDataFrame([("m", "A", 0.0, 10.5), ("m", "B", 10.1, 20.0)], "meeting_id string, label string, start_s double, end_s double")
    assert "".join(r.label for r in Z.snapped_changes(frame, turns).orderBy("pos").collect()) == "AAAABBBBBB"
    busy = turns.unionByName(spark.createDataFrame([("m", "C", 9.0, 12.0)], turns.schema))
    assert "".join(r.label for r in Z.snapped_changes(frame, busy).orderBy("pos").collect()) == "AAAAAABBBB"


def test_token_times(spark):
    rows = spark.createDataFrame([(["Hi ", "there"], "hithere", [0.0] * 7), (["hi ", "you"], "hi you", [0.0, 0.1, 0.2, 0.3, 0.4, 0.5]), (["x"], "abc", [0.0, 1.0, 2.0])], "tokens array<string>, raw string, starts array<double>")
    assert [r.token_starts for r in Z.aligned_times(rows).collect()] == [[0.0, 0.0], [0.0, 0.3], None]


def test_boundaries_and_splits(spark):
    lines = spark.createDataFrame([("m", 0, 0, 0.0, 4.0, "one two "), ("m", 1, 1, 4.0, 8.0, "six ten")], "meeting_id string, utt_idx int, speaker int, start_s double, end_s double, text string")
    moves = lambda k: spark.createDataFrame([("m", 0, k)], "meeting_id string, seam int, k int")
    assert [r.text for r in E.moved_boundaries(lines, moves(3)).orderBy("utt_idx").collect()] == ["one two six ", "ten"]
    assert [r.text for r in E.moved_boundaries(lines, moves(9)).orderBy("utt_idx").collect()] == ["one two six ", "ten"]
    assert [r.text for r in E.moved_boundaries(lines, moves(0)).orderBy("utt_idx").collect()] == ["one ", "two six ten"]
    split = E.split_lines(lines, spark.createDataFrame([("m", 0, 1, 7), ("m", 1, 5, 7)], "meeting_id string, utt_idx int, k int, new_speaker int")).orderBy("utt_idx").collect()
    assert [(r.utt_idx, r.speaker, r.text) for r in split] == [(0, 0, "one "), (1, 7, "two "), (2, 1, "six ten")]


def test_edit_log(spark):
    log = spark.createDataFrame([("m", i, a) for i, a in enumerate(["edit", "edit", "undo", "redo", "undo", "undo", "undo", "edit", "redo"])], "meeting_id string, seq long, action string")
    r = E.edit_state(log).first()
    assert (r.done, r.undone) == ([7], [])


def test_long_lines(spark):
    text = "A sentence of words that goes on for long enough to be cut here after ninety characters at last 3.14. " + "Then a second sentence that also has some words in it."
    lines = spark.createDataFrame([("m", 0, 0, 0.0, 30.0, text), ("m", 1, 0, 30.0, 31.0, text)], "meeting_id string, utt_idx int, speaker int, start_s double, end_s double, text string")
    found = E.long_lines(lines).orderBy("utt_idx", "piece").collect()
    assert [r.utt_idx for r in found] == [0, 0, 1]
    assert found[0].end_s == pytest.approx(found[1].start_s) and found[1].end_s == pytest.approx(30.0)
    assert found[0].text.endswith("3.14.")


def test_sentence_tails_chain(spark):
    rows = spark.createDataFrame([("m", 0, "A", "想法？我"), ("m", 1, "B", "得！是"), ("m", 2, "A", "的"), ("m", 3, "A", "好。 x")], "meeting_id string, pos int, speaker string, text string")
    assert [r.text for r in E.sentence_snapped(rows).orderBy("pos").collect()] == ["想法？", "我得！", "是的", "好。 x"]


def test_enrolment(spark):
    lines = spark.createDataFrame([("m", 0, 3, 0.0, 4.0), ("m", 1, 3, 10.0, 15.0), ("m", 2, 1, 20.0, 20.5), ("m", 3, 1, 30.0, 32.0), ("m", 4, 1, 90.0, 99.0)], "meeting_id string, utt_idx int, speaker int, start_s double, end_s double")
    until = spark.createDataFrame([("m", 50.0)], "meeting_id string, offset_s double")
    clips = E.enrolment(lines, until)
    assert [(r.speaker, r.start_s, r.end_s) for r in clips.orderBy("clip").collect()] == [(3, 10.0, 15.0), (3, 0.0, 1.0), (1, 30.0, 32.0)]
    times = spark.createDataFrame([("m", i, t) for i, t in enumerate((0.0, 4.0, 5.5, 6.5, 8.0, 20.0))], "meeting_id string, q_id int, t double")
    assert [r.original for r in E.from_enrolment(times, clips, until).orderBy("q_id").collect()] == [10.0, 14.0, 15.0, 0.5, 30.0, 59.0]


def test_excerpts_merge(spark):
    lines = spark.createDataFrame([(1, i, f"l{i}", 10) for i in range(20)], "meeting_id long, utt_idx int, text string, tokens int")
    spans = [(6, 8), (0, 1), (9, 10), (7, 8)]
    rows = [(7, r, 1, a, b, " ".join(f"l{i}" for i in range(a, b + 1)), 10 * (b - a + 1), 1.0 / r) for r, (a, b) in enumerate(spans, 1)]
    ranked = spark.createDataFrame(rows, "query_id long, rank int, meeting_id long, a int, b int, text string, tokens int, score double")
    assert [(r.k, r.a, r.b) for r in K.selected(ranked, lines).orderBy("k").collect()] == [(1, 6, 10), (2, 0, 1)]


def test_citations_collapse(spark):
    one = lambda t: spark.createDataFrame([(t,)], "t string").select(K.collapsed(F.col("t")).alias("x")).first().x
    assert one("a [[m@1]], [[m@1]] b") == "a [[m@1]] b"
    assert one("[[m@1]] [[m@2]] [[m@1]]") == "[[m@1]] [[m@2]]"
    assert one("[[m@1]],[[m@2]] no") == "[[m@1]],[[m@2]] no"


def test_names_in_texts(spark):
    names = F.create_map(F.lit("0"), F.lit("王小明"), F.lit("1"), F.lit("Ann"))
    one = lambda t: spark.createDataFrame([(t,)], "t string").select(M.with_names(F.col("t"), names).alias("x")).first().x
    assert one("而 S1 則") == "而王小明 則"
    assert one("S2將 and S9, xS1") == "Ann 將 and S9, xS1"


def test_mail_fits_its_budget(spark):
    meetings = spark.createDataFrame([(1, "T", "facts", "first paragraph\n\nsecond paragraph")], "meeting_id long, title string, facts string, summary string")
    items = spark.createDataFrame([(1, i, "PROPOSAL", f"proposal {i}", "0:01") for i in range(9)] + [(1, 100, "DECISION", "go", "0:02")], "meeting_id long, pos int, tag string, text string, ts string")
    sections = spark.createDataFrame([(0, "Decisions", "DECISION"), (1, "Proposals", "PROPOSAL")], "ord int, heading string, tag string")
    texts = {b: M.mails(meetings, items, sections, b).first() for b in (10_000, 200, 40, 5)}
    assert texts[10_000].variant == 0 and "proposal 8" in texts[10_000].text and "more" not in texts[10_000].text
    assert texts[200].variant == 1 and "… 4 more" in texts[200].text
    assert texts[40].text == "facts\n\nDecisions\n- go [0:02]"
    assert texts[5].variant == 7
    assert M.mails(meetings, items, sections, 10_000, summary=False, only=("DECISION",)).first().text == "facts\n\nDecisions\n- go [0:02]"


def test_recipients_and_scrubbing(spark):
    links = spark.createDataFrame([("m", 2, "a"), ("m", 0, "b"), ("m", 1, "a"), ("m", 3, None)], "meeting_id string, speaker int, person_id string")
    people = spark.createDataFrame([("a", False, ["a@x.co", "z@x.co"]), ("b", True, ["b@x.co"])], "person_id string, me boolean, emails array<string>")
    found = M.recipients(links, people).orderBy("ord").collect()
    assert [(r.person_id, r.speakers, r.address, r.checked) for r in found] == [("b", [0], "b@x.co", False), ("a", [1, 2], "a@x.co", True)]
    last = spark.createDataFrame([("m", "q", "b@X.co")], "meeting_id string, person_id string, address string")
    assert [r.checked for r in M.recipients(links, people, last).orderBy("ord").collect()] == [True, False]


def test_sparse_lines_belong_to_nobody(spark):
    lines = spark.createDataFrame([("m", 0, 0, 0.0, 10.0, "x" * 50), ("m", 1, 1, 10.0, 20.0, "y" * 60), ("m", 2, 1, 20.0, 60.0, "hm")], "meeting_id string, utt_idx int, speaker int, start_s double, end_s double, text string")
    assert [r.speaker for r in V.voice_lines(lines).orderBy("utt_idx").collect()] == [0, 1, V.NOBODY]


def plain_fates(rows, keep, back, above):
    """The fate of each note (meeting, window, pos, tag, text), meeting by meeting, with all kept notes at hand."""
    rank = {"DECISION": 0, "ACTION": 0, "NUMBER": 1, "OPEN-ISSUE": 2}
    found, kept = {}, {}
    for meeting, window in sorted({r[:2] for r in rows}):
        mine = []
        for _, _, pos, tag, text in sorted((r for r in rows if r[:2] == (meeting, window)), key=lambda r: r[2]):
            pairs = {text[i : i + 2] for i in range(len(text or "") - 1)}
            seen = (kept.get(meeting, [])[-back:] + [p for *_, p in mine])[-back:]
            if any(len(pairs & s) / max(1, len(pairs | s)) > above for s in seen):
                found[meeting, pos] = "duplicate"
            else:
                mine.append((rank.get(tag, 3), pos, pairs))
        best = sorted(mine, key=lambda n: (n[0], n[1] if n[0] else -n[1]))[:keep]
        found |= {(meeting, n[1]): "kept" if n in best else "cap" for n in mine}
        kept.setdefault(meeting, []).extend(n[2] for n in mine if n in best)
    return found


def test_journal_of_notes(spark):
    """Copies of copies, of capped notes and of notes long past; null, empty and long texts; a table without rows."""
    words = ["budget", "agreed", "release", "moved", "hiring", "friday"]
    rows = []
    for meeting in (1, 2):
        for pos in range(90):
            text = " ".join(words[(pos * k * meeting + pos // 7) % 6] for k in (1, 2, 3)) + str(pos // 4)
            rows.append((meeting, pos // 9, pos, [None, "ACTION", "NUMBER", "decision", "DECISION"][pos % 5], None if pos == 11 else "" if pos == 12 else text * (400 if pos == 40 else 1)))
    schema = "meeting_id long, window long, pos long, tag string, text string"
    found = {(r.meeting_id, r.pos): r.fate for r in N.journal(spark.createDataFrame(rows, schema), 3, 10).collect()}
    want = plain_fates([(*r[:3], (r[3] or "").upper(), r[4]) for r in rows], 3, 10, 0.6)
    assert found == want
    assert set(found.values()) == {"kept", "cap", "duplicate"}
    assert N.journal(spark.createDataFrame([], schema)).collect() == []


def test_whole_exports(spark):
    lines = spark.createDataFrame([("m", 0, 1.0, "Ann", " hi "), ("m", 1, 3725.0, "Bo", " "), ("n", 0, 2.0, "Bo", "ho")], "meeting_id string, utt_idx int, start_s double, name string, text string")
    notes = D.rendered_notes(spark.createDataFrame([("m", 2, "0:09", None, "later"), ("m", 1, "0:01", "ACTION", "do it")], "meeting_id string, note_id int, ts string, tag string, text string"))
    heads = spark.createDataFrame([("m", "T", "S", "- do it [0:01]"), ("o", None, "", None)], "meeting_id string, title string, summary string, actions string").join(notes, "meeting_id", "left")
    plain = {r.meeting_id: r.export for r in D.exported(lines, heads).collect()}
    marked = {r.meeting_id: r.export for r in D.exported(lines, heads, markdown=True).collect()}
    assert plain == {"m": "T\n\nS\n\nAction items\n- do it [0:01]\n\n#1 [0:01] (ACTION) do it\n#2 [0:09] later\n\n[00:01] Ann: hi", "n": "\n\n[00:02] Bo: ho", "o": "\n\n"}
    assert marked["m"] == "# T\n\n## Summary\n\nS\n\n## Action items\n\n- do it [0:01]\n\n## Agent\n\n- #1 [0:01] (ACTION) do it\n- #2 [0:09] later\n\n## Transcript\n\n- `00:01` **Ann** hi\n"
    assert marked["o"] == "# Transcript\n\n## Transcript\n\n\n"
    assert {r.meeting_id: r.lyrics for r in D.lyrics(lines, heads).collect()} == {"m": "[ti:T]\n[00:01.00]Ann: hi\n", "n": "[00:02.00]Bo: ho\n"}


def test_near_copies(spark):
    """Against all pairs within reach; null, empty and one-letter texts; a table without rows."""
    texts = [None, "", "a", "the budget moved", "the budget moves", "release on friday", "the budget moved", "hiring " * 2000, "release on fridays", "", "the budget moved"]
    rows = [(m, p, texts[(p * m) % len(texts)]) for m in (1, 3) for p in range(25)]
    schema = "meeting_id long, pos long, text string"
    pairs = {r[:2]: {r[2][i : i + 2] for i in range(len(r[2] or "") - 1)} for r in rows}
    like = {(m, p): [q for q in range(max(0, p - 6), p) if len(pairs[m, p] & pairs[m, q]) / max(1, len(pairs[m, p] | pairs[m, q])) > 0.6] for m, p in pairs}
    found = {(r.meeting_id, r.pos): (r.first_like, r.n_like) for r in N.near_copies(spark.createDataFrame(rows, schema), 6).collect()}
    assert found == {k: (v[0], len(v)) for k, v in like.items() if v}
    assert N.near_copies(spark.createDataFrame([], schema)).collect() == []
