"""Whole results of queries without SQL, against plain versions over the same tables."""

from __future__ import annotations

import datetime
import os
import random
import re

import pytest

from meetlake.operators import letters as L
from meetlake.operators import people
from meetlake.plans import letters, passages, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


def width(text: str) -> int:
    return sum(2 if 0x2E80 <= ord(c) <= 0x9FFF or 0xAC00 <= ord(c) <= 0xD7A3 or 0xF900 <= ord(c) <= 0xFAFF or 0xFF00 <= ord(c) <= 0xFF60 else 1 for c in text)


def plain_cues(text: str, start: float, end: float) -> list[tuple[str, float, float]]:
    """One character after the other."""
    text, end = re.sub(r"\n\s*\n+", "\n", text).strip(), end if end > start else start + 1
    if not text:
        return []
    if width(text) <= 64:
        return [(text, start, end)]
    cut, now = [], ""
    for c in text:
        now += c
        if c in "。？！?!." or c in "，、,；;：:" and width(now) >= 32:
            cut, now = [*cut, now], ""
        elif width(now) >= 64:
            head, space, tail = now.rpartition(" ")
            cut, now = ([*cut, head], tail) if space and head else ([*cut, now], "")
    cut = [x.strip(" \t") for x in [*cut, now] if x.strip(" \t")]
    ends = [sum(map(len, cut[: k + 1])) / sum(map(len, cut)) for k in range(len(cut))]
    return [(x, start + (end - start) * a, start + (end - start) * b) for x, a, b in zip(cut, [0.0, *ends], ends, strict=False)]


def clock(seconds: float, sign: str) -> str:
    ms = int(seconds * 1000 + 0.5)
    return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}{sign}{ms % 1000:03d}"


@pytest.mark.parametrize("vtt", [False, True])
def test_subtitles(spark, vtt):
    found = {r.meeting_id: r.subtitles for r in registry.QUERIES["vtt_export" if vtt else "srt_export"](spark, SF).collect()}
    want: dict = {}
    for r in sorted(passages.named(spark, SF).collect(), key=lambda r: (r.meeting_id, r.utt_idx)):
        want.setdefault(r.meeting_id, []).extend((r.name, *c) for c in plain_cues(r.text or "", r.start_s, r.end_s))
    assert len(found) == len([x for x in want.values() if x]) > 5

    def close(a: str, b: str) -> bool:  # a thousandth where a half is rounded
        at = re.compile(r"(\d\d):(\d\d):(\d\d)[,.](\d{3})")
        times = [[sum(int(x) * y for x, y in zip(m, (3_600_000, 60_000, 1000, 1), strict=True)) for m in at.findall(t)] for t in (a, b)]
        return at.sub("", a) == at.sub("", b) and all(abs(x - y) <= 1 for x, y in zip(*times, strict=True))

    marked = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") if vtt else x
    for m, own in want.items():
        parts = [("" if vtt else f"{k}\n") + f"{clock(a, '.' if vtt else ',')} --> {clock(b, '.' if vtt else ',')}\n{marked(name)}: {marked(text)}\n" for k, (name, text, a, b) in enumerate(own, 1)]
        assert close(found[m], ("WEBVTT\n\n" if vtt else "") + "\n".join(parts))


STEPS = [("PROPOSAL", 5), ("summary", 1), ("NUMBER", 5), ("PROPOSAL", 0), ("summary", 0), ("NUMBER", 0), ("OPEN-ISSUE", 3)]


def plain_letter(m, items: list, names: dict, budget: int | None, chat: bool) -> tuple[str, int]:
    """A letter as it is written by hand, and how many steps it took."""
    say = letters._EN | (letters._DE if m.lang == "de" else {})
    heads = dict(zip(letters.TAGS, letters.HEADINGS.get(m.lang, letters.HEADINGS["en"]), strict=True))
    named = lambda t: re.sub(r"(?<![A-Za-z0-9_])S(\d{1,2})(?![A-Za-z0-9_])", lambda x: names.get(int(x[1]) - 1, x[0]), t)
    fill = lambda t, **kv: [t := t.replace("{" + k + "}", str(v)) for k, v in kv.items()][-1]
    heading = lambda h: fill(say["plain_heading"], h=h, H=h.upper())
    at = m.started
    dates = {"y": at.year, "mo": at.month, "d": at.day, "wd": say["weekdays"].split("|")[at.weekday()], "mon": say["months"].split("|")[at.month - 1]}
    about = {"title": m.title, "date_long": fill(say["date_long"], **dates), "date_short": fill(say["date_short"], **dates)}
    minutes = round(m.seconds / 60)
    end = at + datetime.timedelta(seconds=m.seconds)
    long = fill(say["duration_hm"], h=minutes // 60, m=minutes % 60) if minutes >= 60 else fill(say["duration_m"], m=minutes)
    people = say["list_sep"].join([*m.participants, *([fill(say["unnamed"], n=m.unnamed)] if m.unnamed else [])])
    limits = {}
    for step in range(len(STEPS) + 1):
        if step:
            limits[STEPS[step - 1][0]] = STEPS[step - 1][1]
        out = ""
        for tag in letters.TAGS:
            every = [i for i in items if i.tag == tag]
            kept = every[: limits.get(tag, len(every))]
            if not kept:
                continue
            out += f"\n{heading(heads[tag])}\n"
            owner = {i.pos: names.get(int(x[1]) - 1) for i in kept if tag == "ACTION" and (x := re.match(r"S(\d{1,2})(?![A-Za-z0-9_])", i.text))}
            line = lambda i, text: f"{say['bullet']}{text}" + (f" [{i.ts}]" if i.ts else "") + "\n"
            if any(owner.values()):
                order = list(dict.fromkeys(x for i in kept if (x := owner.get(i.pos))))
                for who in [*order, None]:
                    own = [i for i in kept if owner.get(i.pos) == who]
                    out += f"{who or say['owner_none']}\n" * bool(own) + "".join(line(i, named(i.text)[len(who) :].lstrip(" ") if who and named(i.text).startswith(who) else named(i.text)) for i in own)
            else:
                out += "".join(line(i, named(i.text)) for i in kept)
            out += fill(say["more"], n=len(every) - len(kept)) + "\n" if len(every) > len(kept) else ""
        if chat:
            text = fill(say["chat_intro"], **about) + "\n" + out
        else:
            told = [p.strip() for p in named(m.summary or "").split("\n\n") if p.strip()]
            told = told[: limits.get("summary", len(told))]
            lead = f"\n{heading(say['summary_heading'])}\n" + "".join(p + "\n\n" for p in told) if told else ""
            facts = "".join(f"{say[k]}{say['colon']}{v}\n" for k, v in (("label_date", about["date_long"]), ("label_time", f"{at:%H:%M}–{end:%H:%M}"), ("label_duration", long), ("label_participants", people)))
            files = fill(say["attachments"], files=say["list_sep"].join(["minutes.pdf", "talk.srt"]))
            text = f"{say['greeting']}\n\n{fill(say['intro'], **about)}\n\n{heading(say['facts_heading'])}\n{facts}{lead}{out}\n{files}\n\n--\n{say['disclaimer']}\n{say['footer']}\n"
        if budget is None or len(text) <= budget:
            break
    return re.sub("\n{3,}", "\n\n", text).strip() + "\n", step


def test_letters(spark):
    meetings, items, names = letters.inputs(spark, SF)
    found = {r.meeting_id: r for r in letters.meeting_letters(spark, SF).collect()}
    own, called = {}, {}
    for r in sorted(items.collect(), key=lambda r: r.pos):
        own.setdefault(r.meeting_id, []).append(r)
    for r in names.collect():
        called.setdefault(r.meeting_id, {})[r.speaker] = r.name
    rows = meetings.collect()
    assert len(found) == len(rows) and any(r.truncated for r in found.values()) and any("Nobody yet" in r.plain for r in found.values())
    for m in rows:
        plain, cut = plain_letter(m, own[m.meeting_id], called.get(m.meeting_id, {}), 2500, False)
        assert (found[m.meeting_id].plain, found[m.meeting_id].truncated) == (plain, cut > 0)
        assert found[m.meeting_id].chat == plain_letter(m, own[m.meeting_id], called.get(m.meeting_id, {}), 2000, True)[0]
    few = L.letters(meetings, items, names, *letters.tables(spark), summary=False, only=("DECISION",)).collect()
    assert all("SUMMARY" not in r.plain and "ACTIONS" not in r.plain and not r.truncated for r in few)
    assert all("DECISIONS" not in r.plain for r in L.letters(meetings, items, names, *letters.tables(spark), minutes=False).collect())


def test_voices_are_suggested_as_by_a_plain_list(spark):
    """Every speaker against everybody, with some pairs excluded."""
    chance = random.Random(5)

    def unit():
        v = [chance.gauss(0, 1) + (2.5 if k == 0 else 0) for k in range(4)]
        return [x / sum(y * y for y in v) ** 0.5 for x in v]

    voices = {f"p{k}": unit() for k in range(30)}
    speakers = {(m, s): unit() for m in range(12) for s in range(4)}
    banned = {(m, s, f"p{chance.randrange(30)}") for m, s in speakers for _ in range(3)}
    frames = [spark.createDataFrame(rows, kinds) for rows, kinds in (
        ([(*k, v) for k, v in speakers.items()], "meeting_id int, speaker int, vector array<double>"), (list(voices.items()), "person string, vector array<double>"), (sorted(banned), "meeting_id int, speaker int, person string"))]
    found = {(r.meeting_id, r.speaker, r["rank"]): (r.person, r.score, r.level) for r in people.suggested(frames[0], frames[1], 4, frames[2]).collect()}
    want = {}
    for m in range(12):
        lists = {s: sorted(((-round(sum(a * b for a, b in zip(speakers[m, s], v, strict=True)), 9), p) for p, v in voices.items() if (m, s, p) not in banned)) for s in range(4)}
        owner, taken = {}, set()
        for score, s, p in sorted((score, s, p) for s, own in lists.items() for score, p in own if -score >= 0.5):
            if s not in taken and p not in owner:
                owner[p] = s
                taken.add(s)
        for s, own in lists.items():
            shown = [(k, p, -score) for k, (score, p) in enumerate(own) if -score >= 0.5 and owner.get(p, s) == s][:3]
            for rank, (k, p, score) in enumerate(shown, 1):
                next_ = -own[k + 1][0] if k + 1 < len(own) else -1.0
                want[m, s, rank] = (p, score, "likely" if rank == 1 and score >= 0.7 and score - next_ >= 0.05 else "possible")
    assert {k: (p, round(x, 6), y) for k, (p, x, y) in found.items()} == {k: (p, round(x, 6), y) for k, (p, x, y) in want.items()} and len(want) > 60
