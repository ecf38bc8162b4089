"""What a step costs when its input grows, and that its results stay those of a plain version."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meetlake.operators import ask as K
from meetlake.operators import mail as M
from meetlake.operators import notes as N
from meetlake.operators import retrieval as R
from meetlake.operators import script
from meetlake.operators import timeline
from meetlake.operators import voice as V


def scored(passages: int, terms: int, queries: int, share: float, best: int | None):
    """One batch of passages that have all terms; each question asks for a share of them. The batch, the scores found and the peak of memory."""
    rng = np.random.default_rng(5)
    asks = rng.random((queries, terms)) < share
    q, t = np.nonzero(asks)
    asked = SimpleNamespace(value=pa.table({"query_id": pa.array(q * 3), "term": pa.array([f"t{x}" for x in t])}))
    weights = rng.random((passages, terms))
    used = sorted(set(t))
    lists = pa.array([[f"t{x}" for x in used]] * passages)
    batch = pa.RecordBatch.from_arrays([pa.array(range(passages)), pa.array([k % 2 for k in range(passages)]), lists, pa.array(list(weights[:, used]))], names=["key", "per", "terms", "weights"])
    tracemalloc.start()
    found = list(R.added(asked, best)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return weights @ asks.T, found, peak


@pytest.mark.parametrize("share", [0.05, 0.5])
def test_scores_in_slices(share, monkeypatch):
    monkeypatch.setattr(R, "CELLS", 500, raising=False)
    want, found, _ = scored(70, 40, 30, share, None)
    rows = {(q // 3, k): s for b in found for q, k, s in zip(*(b.column(c).to_pylist() for c in ("query_id", "key", "score")), strict=True)}
    assert set(rows) == set(zip(*(x.tolist() for x in np.nonzero(want.T)), strict=True))
    assert all(s == pytest.approx(want[k, q]) for (q, k), s in rows.items())


def test_scores_hold_a_bounded_part(spark):
    """3,000 passages with 300 terms each, asked for by half of 200 questions: 90 million pairs."""
    want, found, peak = scored(3_000, 300, 200, 0.5, 5)
    assert peak < 400_000_000
    best = {}
    for b in found:
        for q, k, s in zip(*(b.column(c).to_pylist() for c in ("query_id", "key", "score")), strict=True):
            best.setdefault(q // 3, []).append((-s, k))
    for q in range(200):
        assert [k for _, k in sorted(best[q])[:5]] == np.argsort(-want[:, q], kind="stable")[:5].tolist()


@pytest.mark.parametrize("share", [0.01, 0.5])
def test_scores_leave_a_slice_in_blocks(spark, share):
    """A task holds a few times the cells of a slice (8 MB), not a dozen times."""
    want, found, peak = scored(6_000, 100, 200, share, 3)
    assert peak < 65_000_000
    rows = {}
    for b in found:
        for q, k, p, s in zip(*(b.column(c).to_pylist() for c in ("query_id", "key", "per", "score")), strict=True):
            rows.setdefault((q // 3, p), []).append((-s, k))
    for q in range(200):
        for p in range(2):
            own = np.arange(p, 6_000, 2)
            best = own[np.argsort(-want[own, q], kind="stable")[:3]]
            assert [k for _, k in sorted(rows.get((q, p), []))[:3]] == best[want[best, q] > 0].tolist()


def plan_of(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def test_repaired_texts_pass_no_driver(spark, tmp_path):
    """What is made of the items of texts isn't broadcast, however small the planner takes it for, and equal items meet the times once."""
    texts = spark.createDataFrame([(1, k, "at [0:05] [[0:05]] and [0:5, 9:00] x") for k in range(3)] + [(2, 9, "[1:00]")], "meeting_id long, text_id long, text string")
    known = spark.createDataFrame([(1, "0:07", 1), (1, "0:52", 2)], "meeting_id long, ts string, pos long")
    for rows, name in ((texts, "texts"), (known, "known")):
        rows.write.parquet(f"{tmp_path}/{name}")
    found = N.repaired(*(spark.read.parquet(f"{tmp_path}/{name}") for name in ("texts", "known")))
    assert plan_of(found).count("BroadcastHashJoin") <= 1
    assert {(r.text_id, r.repaired) for r in found.collect()} == {(k, "at [0:07] [[0:05]] and [0:52] x") for k in range(3)} | {(9, "")}


def test_citations_make_no_pairs(spark):
    """2,000 citations and 2,000 excerpts of one meeting, a few seconds each: no join has more rows than both."""
    cites = spark.range(2000).selectExpr("1L as conversation", "id as cite_id", "1L as meeting_id", "if(id = 7, null, id % 300) as sec")
    excerpts = spark.range(2000).selectExpr("1L as conversation", "1999 - id as k", "1L as meeting_id", "if(id % 5 = 0, 0L, (id * 7) % 211) as sec").where("sec % 9 <> 4")
    found = K.checked(cites, excerpts)
    rows = {r.cite_id: r.sec for r in found.collect()}
    places = [(r.k, r.sec) for r in excerpts.collect()]
    for r in cites.collect():
        assert rows[r.cite_id] == (min(places)[1] if r.sec is None else min((abs(s - r.sec), k, s) for k, s in places)[2])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        run = K.checked(cites, excerpts)._jdf.queryExecution()
        run.executedPlan().executeCollect()
        plan, most = [run.executedPlan()], 0
        while plan:
            node = plan.pop()
            if "Join" in node.nodeName():
                most = max(most, node.metrics().apply("numOutputRows").value())
            plan += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert most <= 4000


@pytest.mark.parametrize("few", [300, 0])
def test_conversion_moves_no_text(spark, few, monkeypatch):
    """Texts stay in their task, and both ways of looking entries up agree."""
    monkeypatch.setattr(script, "FEW", few, raising=False)
    words = spark.createDataFrame([("a.b", "1"), ("a", "2"), ("a", "3"), ("]", "^"), ("ba", "x"), ("-", ""), ("", "no")], "key string, to string")
    texts = spark.createDataFrame([(1, "a.ba]b-a"), (2, None), (3, ""), (4, "zz"), (5, "a\u3042")], "id long, text string")
    found = script.staged(texts, [words, words])
    assert "Exchange" not in plan_of(found)
    assert {r.id: r.text for r in found.collect()} == {1: "12^b2", 2: None, 3: "", 4: "zz", 5: "a\u3042"}


def test_words_met_without_stored_pairs(spark, tmp_path, monkeypatch):
    """What is written on the way to the hits follows the questions, not the texts' pairs."""
    written = []
    monkeypatch.setattr(R, "settle", lambda df, name: (written.append((name, df.count())), df)[1])
    texts = spark.createDataFrame([(k, "title", 0, f"the report {k} on movers") for k in range(500)] + [(k, "line", 1, "the movers") for k in range(500)], "meeting_id long, kind string, pos int, text string")
    asked = spark.createDataFrame([(1, "The movers", 7), (2, "report 33", 8), (3, "7", 9)], "query_id long, query string, open_meeting long")
    hits = {(r.query_id, r.meeting_id, r.kind) for r in R.lexical(texts, asked).collect()}
    assert hits == {(1, k, "title") for k in range(500)} | {(1, 7, "line")} | {(2, k, "title") for k in range(500) if "33" in str(k)} | {(3, k, "title") for k in range(500) if "7" in str(k)}
    assert max(n for _, n in written) < 100


def test_crossed_lines_make_no_pairs(spark):
    rng = np.random.default_rng(3)
    starts, lengths, who = rng.integers(0, 400, 150), rng.integers(0, 6, 150), rng.integers(0, 3, 150)
    rows = [(k % 2, k, int(w), float(a), float(a + n)) for k, (a, n, w) in enumerate(zip(starts, lengths, who, strict=True)) if n]
    lines = spark.createDataFrame(rows, "meeting_id long, utt_idx long, speaker int, start_s double, end_s double")
    found = timeline.clean_speech(lines, 0.0, 0.5)
    crossed = {x[1] for x in rows for y in rows if x[0] == y[0] and x[2] != y[2] and x[3] < y[4] and y[3] < x[4]}
    assert {r.utt_idx for r in found.collect()} == {r[1] for r in rows} - crossed and crossed
    assert "_bucket" not in found._jdf.queryExecution().optimizedPlan().toString()




@pytest.mark.parametrize("seed", [1, 2])
def test_attribution_makes_no_pairs(spark, seed, monkeypatch):
    """Spans and turns of all kinds, touching ones, empty ones and equal ones among them, against all pairs."""
    rng = np.random.default_rng(seed)
    spans = [(k % 2, k, float(a), float(a + n)) for k, (a, n) in enumerate(zip(rng.integers(0, 60, 60), rng.integers(0, 25, 60), strict=True))]
    turns = [(k % 2, k, k % 5, float(a), float(a + n)) for k, (a, n) in enumerate(zip(rng.integers(0, 60, 90), rng.integers(0, 9, 90), strict=True))]
    want = {}
    for m, k, a, b in spans:
        met = [(-(min(b, d) - max(a, c)), c, i, s) for o, i, s, c, d in turns if o == m and min(b, d) - max(a, c) > 0]
        if met:
            want[k] = min(met)[3]
    monkeypatch.setattr(timeline, "overlap_join", None)
    found = timeline.attribute(spark.createDataFrame(spans, "meeting_id long, span_id long, start_s double, end_s double"), spark.createDataFrame(turns, "meeting_id long, turn_id long, speaker int, t_start double, t_end double"))
    assert {r.span_id: r.speaker for r in found.collect() if not r.snapped} == want and len(want) > 40


def test_common_seconds_make_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    sides = [[(k % 2, int(w), float(a) / 8, float(a + n) / 8) for k, (a, n, w) in enumerate(zip(rng.integers(0, 900, 80), rng.integers(-1, 90, 80), rng.integers(0, 4, 80), strict=True))] for _ in range(2)]
    want = {}
    for m, s, a, b in sides[0]:
        for o, t, c, d in sides[1]:
            if m == o and a < b and c < d and min(b, d) > max(a, c):
                want[m, s, t] = want.get((m, s, t), 0.0) + min(b, d) - max(a, c)
    monkeypatch.setattr(timeline, "overlap_join", None)
    old, new = (spark.createDataFrame(rows, "meeting_id long, speaker int, start_s double, end_s double") for rows in sides)
    assert {(r.meeting_id, r.old_speaker, r.new_speaker): r.seconds for r in timeline.overlap_matrix(old, new, 16.0).collect()} == want


def test_moves_follow_pairs_not_exemplars(spark, monkeypatch):
    """Exemplars of one person and meeting move as one; a plain version of the log."""
    rng = np.random.default_rng(6)
    rows = [(k, None if k % 41 == 0 else int(k % 4), int(k % 3), 1.0) for k in range(300)]
    edits = [(n, "remove" if n % 9 == 0 else "move", None if n % 7 == 0 else int(rng.integers(0, 5)), int(rng.integers(0, 3)) if n % 7 == 0 or n % 2 else None, int(rng.integers(0, 5))) for n in range(0, 40)]
    want = {}
    for k, p, m, _ in rows:
        for _, kind, of, at, to in edits:
            if p == "gone" or of is not None and of != p or at is not None and at != m:
                continue
            p = to if kind == "move" else "gone"
        if p != "gone":
            want[k] = p
    sizes = []
    monkeypatch.setattr(V, "settle", lambda df, name: (sizes.append(df.count()) if name != "edits" else None, df.localCheckpoint())[1])
    found = V.followed(spark.createDataFrame(rows, "speaker long, person long, meeting_id long, seconds double"), spark.createDataFrame(edits, "seq long, kind string, person long, meeting_id long, to long"))
    assert {r.speaker: r.person for r in found.collect()} == want and want
    assert max(sizes) <= 15


def test_mails_repeat_no_item(spark):
    """Items stand once, not once for each variant."""
    items = spark.createDataFrame([(1, k, t, f"item {k} " * 9, None) for k, t in enumerate(["PROPOSAL", "NUMBER", "OPEN-ISSUE", "DECISION"] * 8)], "meeting_id long, pos long, tag string, text string, ts string")
    meetings = spark.createDataFrame([(1, "t", "facts", "one\n\ntwo")], "meeting_id long, title string, facts string, summary string")
    sections = spark.createDataFrame([(0, "D", "DECISION"), (1, "O", "OPEN-ISSUE"), (2, "P", "PROPOSAL"), (3, "N", "NUMBER")], "ord int, heading string, tag string")
    texts = {b: M.mails(meetings, items, sections, b) for b in (10_000, 2_000, 1_500, 900, 10)}
    seen = {b: f.first() for b, f in texts.items()}
    assert [seen[b].variant for b in seen] == [0, 3, 6, 7, 7] and all(len(r.text) <= b for b, r in seen.items() if b >= 1_500)
    assert "Generate" not in plan_of(texts[10])


def test_names_cut_a_text_once(spark):
    text = "S1 and S2, " * 400
    names = F.create_map(F.lit("0"), F.lit("Ann"))
    frame = spark.createDataFrame([(text,), ("no short form",), (None,)], "t string")
    found = frame.select(M.with_names(F.col("t"), names).alias("x"))
    assert [r.x for r in found.collect()] == ["Ann and S2, " * 400, "no short form", None]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 1


def test_library_of_lines(spark, tmp_path):
    """Documents one a line of few files; a broken one costs no other."""
    from meetlake.sources import readers

    spark.createDataFrame([('{"id":"a","lines":[{"speaker":1,"start":0.0,"end":1.0,"text":"x\\ny"}]}',), ('{"id":"b","li',), ('{"id":"c","lines":[]}',)], "value string").coalesce(1).write.text(f"{tmp_path}/lib")
    assert [(r.id, len(r.lines)) for r in readers.library(spark, f"{tmp_path}/lib", lines=True).collect()] == [("a", 1), ("c", 0)]


def test_changes_in_pieces(spark, tmp_path):
    """Pieces give what characters give, short and empty lines and signs beyond 16 bits among them, and no character has a row before the fold."""
    from pyspark.sql import Window

    from meetlake.operators.snap import snapped_changes
    from meetlake.plans import adapters as A
    from meetlake.plans import edits

    rng = np.random.default_rng(8)
    texts = ["I", "ok", "", "yes!", None, "it's on \U0001f600 now, really", "我覺得好，對嗎", "... well ... so we go there", " - ", "The plan is fine. And then?"]
    rows = [(m, t, ["system", "user", "assistant"][int(rng.integers(0, 3))], texts[int(rng.integers(0, len(texts)))]) for m in range(60) for t in range(int(rng.integers(1, 12)))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = edits.speaker_snap(spark, str(tmp_path))
    assert "split(" not in plan_of(found).split("FlatMapCoGroupsInArrow")[1]
    lines = A.utterances(spark, str(tmp_path)).withColumn("label", F.col("speaker").cast("string"))
    order = Window.partitionBy("meeting_id").orderBy("utt_idx", "i")
    step = (F.col("end_s") - F.col("start_s")) / F.greatest(F.lit(1), F.char_length("text"))
    each = lines.withColumn("_s", step).select("*", F.posexplode(F.split("text", "")).alias("i", "ch")).where("ch <> ''").withColumn("pos", F.row_number().over(order))
    late = each.select("meeting_id", "pos", "ch", (F.col("start_s") + F.col("i") * F.col("_s")).alias("start_s"), (F.col("start_s") + (F.col("i") + 1) * F.col("_s")).alias("end_s"), F.coalesce(F.lag("label", 3).over(order), "label").alias("label"))
    turns = lines.select("meeting_id", "label", F.greatest(F.lit(0.0), F.col("start_s") - 0.3).alias("start_s"), "end_s")
    moved = snapped_changes(late, turns)
    want = moved.groupBy("meeting_id", "label").agg(F.count("*").alias("characters"), F.sum(F.crc32("ch")).alias("digest"))
    assert set(map(tuple, found.collect())) == set(map(tuple, want.collect()))
    assert moved.join(late.select("meeting_id", "pos", F.col("label").alias("was")), ["meeting_id", "pos"]).where("was <> label").count() > 20


def test_long_lines_cut_a_text_once(spark):
    """Against a plain fold over sentences; the text is taken apart at one place of the plan."""
    import re

    from meetlake.operators import edits as E

    rng = np.random.default_rng(9)
    bits = ["word ", "a longer stretch of words without an end ", "x.y", ". ", ".", "? ", "!", "。", ";", "…", "  ", "3.14 ", "\n", "And so on. ", "想法", "一。"]
    texts = ["".join(bits[int(k)] for k in rng.integers(0, len(bits), int(rng.integers(5, 60)))) + end for end in ("", ".\n", ".\n\n", "!\r", "x" * 40, "   ") for _ in range(25)]
    texts += [" " * 120, "x" * 130, "a.b" * 60, "short. ", "", None, "y" * 95 + ".\n", "y" * 95 + ".\n\n", "y" * 95 + ". " + "z" * 29, "y" * 95 + ". " + "z" * 28, "y" * 95 + ".z" * 3]
    rows = [(1, k, 0, 10.0, 10.0 + (30.0 if k % 7 else 5.0), t) for k, t in enumerate(texts)]

    def pieces(text: str) -> list[str]:
        parts, cur, out = [x for x in re.findall(r"[^。？！?!.；;]*[。？！?!；;.]|[^。？！?!.；;]+\Z", text)], "", []
        for i, x in enumerate(parts):
            cur += x
            stops = not x.endswith(".") or i + 1 == len(parts) or parts[i + 1].startswith(" ")
            if stops and len(cur) >= 90 and re.search("[。？！?!.；;](\r\n|[\n\r\x85\u2028\u2029])?\\Z", cur):
                out, cur = [*out, cur], ""
        if not cur.strip(" "):
            return out
        return [*out[:-1], out[-1] + cur] if out and len(cur) < 30 else [*out, cur]

    want = {}
    for _, k, _, a, b, t in rows:
        cut = pieces(t) if t and b - a > 20 and len(t) > 100 else [t]
        whole, before = max(1, sum(len(x or "") for x in cut)), 0
        for n, x in enumerate(cut):
            want[k, n] = (a + (b - a) * before / whole, None if x is None else a + (b - a) * (before + len(x)) / whole, None if x is None else x.strip(" "))
            before += len(x or "")
    found = E.long_lines(spark.createDataFrame(rows, "meeting_id long, utt_idx int, speaker int, start_s double, end_s double, text string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert {(r.utt_idx, r.piece): (r.start_s, r.end_s, r.text) for r in found.collect()} == want and len(want) > len(rows) + 60


def test_grams_in_blocks():
    """Numbers of four bytes and fewer, whatever the blocks; no gram reaches from a text into the next one."""
    texts = ["the movers", None, "", "abc", "d", "出租车很慢 now", "aaaaaaaa", "\U0001f600" * 3, "rs ab"]
    cut = lambda t, n: {t.encode()[k : k + n] for k in range(len(t.encode()) - n + 1)}
    for n in (1, 2, 3, 4):
        asked = sorted(set().union(*(cut(t, n) for t in texts if t)) | {b"zq"[:n], b"rsab"[:n]})
        number = {g: int(R.coded(np.frombuffer(g, np.uint8), n)[0]) for g in asked if len(g) == n}
        wanted = np.array(sorted(number.values()), np.int32)
        for step in (1, 3, 1000):
            for rows in (pa.array(texts), pa.array(["pad", *texts])[1:], pa.array(texts, pa.large_string())):
                assert [set(x) for x in R.grams(rows, wanted, step).to_pylist()] == [{number[g] for g in cut(t or "", n)} for t in texts]
    assert R.grams(pa.array([], pa.string()), wanted).to_pylist() == [] and R.grams(pa.array(texts), wanted[:0]).to_pylist() == [[]] * len(texts)


def test_words_in_texts_without_walking_to_each_character(spark):
    """Against a plain search; the cost of a text follows its length, also where it is one line of 300,000 characters."""
    rng = np.random.default_rng(11)
    bits = ["th", "e", "ä", "ß", "出", "租车", "\U0001f600", " ", ".", "\n", "rare", "zq"]
    texts = [(k, "".join(bits[int(x)] for x in rng.integers(0, len(bits), int(rng.integers(0, 40))))) for k in range(200)] + [(900, None), (901, ""), (902, "the ä" * 60_000 + "zqzq")]
    words = sorted({"".join(bits[int(x)] for x in rng.integers(0, len(bits), int(rng.integers(1, 4)))) for _ in range(60)} | {"zqzq", "不在", "ab"})
    found = R.containing(spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame([(w,) for w in words], "w string"), "t", "w")
    assert {(r.id, r.w) for r in found.collect()} == {(k, w) for k, t in texts for w in words if len(w) > 1 and t and w in t}
    assert "substring(" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("seed", [1, 2])
def test_found_lines_and_spans_make_no_pairs(spark, seed):
    """Against a plain version, with repeated rows, spans that end ahead of their start, and nulls."""
    rng = np.random.default_rng(seed)
    notes = [(int(q), k, int(t), f"vec {t}") for k, (q, t) in enumerate(zip(rng.integers(0, 6, 60), rng.integers(0, 40, 60), strict=True))]
    lines = [(int(q), int(i)) for q, i in zip(rng.integers(0, 6, 50), rng.integers(0, 300, 50), strict=True)] + [(0, None), (7, 5)]
    near = [(int(q), bool(k % 2), int(t), int(a), int(a + n), f"vec {t}") for k, (q, t, a, n) in enumerate(zip(rng.integers(0, 8, 120), rng.integers(0, 40, 120), rng.integers(0, 300, 120), rng.integers(-5, 20, 120), strict=True))]
    near += [near[0], near[1], (1, False, 3, None, 250, "x"), (1, False, 3, 9, None, "x"), (1, False, 3, None, None, "x"), (2, True, 4, 1, 2, None), (None, False, 1, 1, 400, "x"), (9, None, 1, 1, 4, "x")]
    rows = [(q, 0, t, k, x) for q, k, t, x in notes] + [(q, 1, i, 0, None) for q, i in lines]
    rows += [(q, 0, t, 2**40, x) for q, note, t, _, _, x in near if note and not any(q == n[0] and x == n[3] for n in notes)]
    inside = lambda q, a, b: a is not None and any(q == p and i is not None and a <= i <= max(a, a if b is None else b) for p, i in lines)
    rows += [(q, 1, a, 0, None) for q, note, _, a, b, _ in near if note is False and not inside(q, a, b)]
    nulls_first = lambda r: tuple((x is not None, x) if x is not None else (False,) for x in r)
    want = {q: sorted((r[1:] for r in rows if r[0] == q), key=nulls_first)[:30] for q in {r[0] for r in rows}}
    found = K.in_meeting(spark.createDataFrame(notes, "query_id long, pos long, t long, text string"), spark.createDataFrame(lines, "query_id long, utt_idx long"), spark.createDataFrame(near, "query_id long, is_note boolean, t long, a long, b long, text string"), 30)
    got = {(r.query_id, r["rank"]): (r.kind, r["at"], r.text) for r in found.collect()}
    assert got == {(q, k + 1): (kind, at, x) for q, own in want.items() for k, (kind, at, _, x) in enumerate(own)} and len(got) > 100
    assert not [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "LeftAnti" in x and ">=" in x]


def test_results_in_a_meeting_search_once(spark):
    """What the words are found in isn't read again for each use of the hits."""
    from meetlake.plans import edits

    found = edits.in_meeting_results(spark, "/root/testdata/sf0.001")
    assert not [x for x in found.inputFiles() if "documents" in x] and found.count() > 100
