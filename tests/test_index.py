"""The index: refreshes that repeat, come late or change the model; turns as a stream; time stamps; exemplars."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from meetlake.operators import index_store as I
from meetlake.operators import notes as N
from meetlake.operators import voice as V
from meetlake.plans.index import embedded
from meetlake.streaming import refresh as S


def document(meeting: int, version: int, words: str = "some words", title: str | None = "T", notes: list | None = None):
    lines = [(k, k % 2, 10.0 * k, 10.0 * k + 9, f"{words} {k}") for k in range(4)]
    return (meeting, version, title, None, notes or [], lines, {"0": "Ann", "1": ""})


@pytest.fixture
def store(spark, tmp_path):
    return I.Store(spark, f"file://{tmp_path}/index", "m1", buckets=3)


def shown(store):
    return sorted((r.meeting_id, r.kind, r.a, r.b, r.made, tuple(r.codes)) for r in store.vectors().collect())


def test_refresh_reuses_repeats_and_ignores_what_is_old(spark, store):
    calls = []

    def embed(rows):
        calls.append(rows.count())
        return embedded(rows)

    make = lambda *docs: spark.createDataFrame(list(docs), I.DOCUMENT)
    first = make(document(1, 1), document(2, 1), document(3, 1, notes=[(0, 1, "0:01", None, "short"), (1, 2, "0:02", "ACTION", "long enough")]))
    I.refresh(store, first, embed)
    before = shown(store)
    assert {(m, k) for m, k, *_ in before} == {(1, "meeting"), (2, "meeting"), (3, "meeting"), (3, "note"), (1, "chunk"), (2, "chunk"), (3, "chunk")}
    assert calls == [4]  # equal texts of three meetings are embedded once
    I.refresh(store, first, embed)  # a repeated micro-batch
    assert shown(store) == before and calls == [4]
    I.refresh(store, make(document(2, 2, title="New"), document(2, 1, "x"), document(1, 0, "older")), embed)
    after = shown(store)
    assert calls == [4, 1] and [r for r in after if r[0] != 2] == [r for r in before if r[0] != 2]
    assert {(k, made) for m, k, _, _, made, _ in after if m == 2} == {("meeting", 2), ("chunk", 1)}
    other = I.Store(spark, store.path, "m2", buckets=3)
    assert I.stale(I.latest(first), other).count() == 2  # of the second a newer version is there
    I.refresh(other, first, embed)
    assert {r.meeting_id for r in other.heads().where("model_id = 'm2'").collect()} == {1, 3}


def test_a_broken_write_is_not_seen_and_mended(spark, store, monkeypatch):
    docs = spark.createDataFrame([document(1, 1), document(2, 1)], I.DOCUMENT)
    I.refresh(store, docs, embedded)
    want = shown(store)
    changed = spark.createDataFrame([document(1, 2, "new")], I.DOCUMENT)
    whole = I.Store._put

    def broken(self, name, *rest):
        if name == "heads":
            raise RuntimeError("lost")
        whole(self, name, *rest)

    monkeypatch.setattr(I.Store, "_put", broken)
    with pytest.raises(RuntimeError):
        I.refresh(store, changed, embedded)
    assert shown(store) == [r for r in want if r[0] == 2]  # vectors have arrived, their head hasn't
    monkeypatch.setattr(I.Store, "_put", whole)
    I.refresh(store, changed, embedded)
    assert [r for r in shown(store) if r[0] == 2] == [r for r in want if r[0] == 2] and {(k, made) for m, k, _, _, made, _ in shown(store) if m == 1 and k == "chunk"} == {("chunk", 2)}


def test_edits_in_batches_equal_a_rebuild(spark, store, tmp_path):
    path = f"file://{tmp_path}/docs"
    for n in (1, 2, 3):
        spark.createDataFrame([document(m, n, f"words {m if n == 1 else m * n}") for m in range(n, 9, n)], I.DOCUMENT).write.parquet(f"{path}/v={n}")
        S.follow(spark.readStream.schema(I.DOCUMENT).option("maxFilesPerTrigger", 1).parquet(f"{path}/*"), store, embedded, f"file://{tmp_path}/checkpoint")
    rebuilt = I.Store(spark, f"file://{tmp_path}/rebuilt", "m1")
    I.refresh(rebuilt, spark.read.schema(I.DOCUMENT).parquet(f"{path}/*"), embedded)
    strip = lambda rows: [(m, k, a, b, c) for m, k, a, b, _, c in rows]
    assert strip(shown(store)) == strip(shown(rebuilt)) and len(shown(store)) > 8


def plain_turns(rows, within=0.01, settle=15.0):
    """Each statement against all turns so far."""
    turns, fed = [], -1e300
    for start, end, label, confidence, at in rows:
        fed = max(fed, at)
        near = [t for t in turns if abs(t[0] - start) <= within + 1e-9 and t[5] is None and not t[1] <= fed - settle]
        for t in turns:
            if t[5] is None and t[1] <= fed - settle:
                t[5] = fed
        if near:
            t = min(near)
            t[1], t[2], t[3], t[4] = max(t[1], end), label or t[2], confidence, t[4] + 1
        elif start > fed - settle:
            turns.append([start, end, label, confidence, 1, None])
    return sorted(tuple(t[:5]) for t in turns if t[5] is not None or t[1] <= fed - settle)


def test_turns_in_several_micro_batches(spark, tmp_path):
    chance, rows, at = random.Random(3), [], 0.0
    for n in range(400):
        at += chance.choice([0.5, 2.0, 6.0])
        start = round(max(0.0, at - chance.choice([0, 0, 1, 3, 30])) // 4 * 4 + chance.choice([0, 0.004, 0.008]), 3)
        rows.append((n % 2, n, start, round(start + chance.choice([1.0, 4.0, 9.0]), 3), chance.choice(["a", "b", ""]), n / 400, at))
    kinds = "meeting_id long, arrival long, start_s double, end_s double, label string, confidence double, fed_s double"
    frame = spark.createDataFrame(rows, kinds)
    batch = sorted(tuple(r) for r in S.settled_turns(frame).collect())
    assert batch == sorted((m, *t) for m in (0, 1) for t in plain_turns([r[2:] for r in rows if r[0] == m])) and len(batch) > 40
    found = []
    for k, cut in enumerate((70, 200, 210, 400)):
        before = (0, 70, 200, 210)[k]
        frame.where(F.col("arrival").between(before, cut - 1)).coalesce(1).write.parquet(f"{tmp_path}/turns/p={k}")
        stream = S.closed_turns(spark.readStream.schema(kinds).parquet(f"{tmp_path}/turns/*"))
        stream.writeStream.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).foreachBatch(lambda df, _: found.extend(tuple(r) for r in df.collect())).start().awaitTermination()
    assert sorted(found) == batch


def test_time_stamps_are_mended(spark):
    known = spark.createDataFrame([("m", "0:05", 0), ("m", "1:00", 1), ("m", "01:00", 2), ("m", "1:30", 3), ("m", "1:02:03", 4), ("m", "bad", 5), ("n", "9:09", 6)], "meeting_id string, ts string, pos int")
    cases = {
        "as [1:00] and [0:07].": "as [1:00] and [0:05].", "[1:15]": "[1:00]", "[5:00] gone": " gone", "[1:02, 1:29; 0:01～59:59]": "[1:00] [1:30] [0:05]", "[1:00-1:01]": "[1:00]", "[21] [x 1:00] [[1:00]] [1:00]]": " [x 1:00] [[1:00]] [1:00]]",
        "[1:3]": "[1:30]", "[1:9]": "[1:00]", "[1:02:03][1:62][1:1:1]": "[1:02:03]", "[1：00]": "[1:00]", "none": "none", "": "", "[1:00] [1:00]": "[1:00] [1:00]", "[0:45]": "[1:00]",
    }
    rows = [("m", k, x, 7) for k, x in enumerate(cases)] + [("q", 99, "[1:00]", 7), ("m", 100, None, 7)]
    found = {r.text_id: r for r in N.repaired(spark.createDataFrame(rows, "meeting_id string, text_id int, text string, tag int"), known).collect()}
    assert [found[k].repaired for k in range(len(cases))] == list(cases.values()) and found[99].repaired == "" and found[100].repaired is None and found[0].tag == 7


def test_exemplars_follow_links_in_order(spark):
    kinds = "person string, meeting_id int, speaker int, seconds double, confirmed boolean, vector array<double>"
    old = spark.createDataFrame([("a", 1, 0, 20.0, True, [1.0, 0.0]), ("a", 2, 0, 20.0, False, [0.0, 1.0]), ("b", 1, 1, 20.0, True, [0.0, 1.0]), ("c", 9, 0, 20.0, True, [1.0, 0.0])], kinds)
    links = spark.createDataFrame([(1, 0, "a"), (2, 0, "a"), (3, 0, "a"), (3, 2, "a"), (3, 1, "b"), (3, 3, "d"), (3, 4, "e"), (1, 1, "e")], "meeting_id int, speaker int, person string")
    people = spark.createDataFrame([(p, p != "e") for p in "abcde"], "person string, voice_enabled boolean")
    vectors = spark.createDataFrame([(1, 0, 20.0, [1.0, 0.0]), (2, 0, 20.0, [0.0, 1.0]), (3, 0, 20.0, [0.0, 1.0]), (3, 2, 30.0, [1.0, 0.0]), (3, 1, 5.0, [0.0, 1.0]), (3, 3, 20.0, [0.0, 1.0])], "meeting_id int, speaker int, seconds double, vector array<double>")
    found = {(r.person, r.meeting_id): (r.speaker, r.seconds, r.confirmed, r.vector) for r in V.synced(links, people, vectors, old).collect()}
    assert found == {
        ("a", 1): (0, 20.0, True, [1.0, 0.0]),  # confirmed before
        ("a", 2): (0, 20.0, False, [0.0, 1.0]),  # refused before
        ("a", 3): (2, 30.0, False, [1.0, 0.0]),  # the later speaker's vector, the earlier one's verdict
        ("d", 3): (3, 20.0, True, [0.0, 1.0]),  # nobody to compare with
        ("c", 9): (0, 20.0, True, [1.0, 0.0]),  # its meeting isn't synced
    }
    capped = V.synced(links, people, vectors, old, dates=spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "meeting_id int, date int"), cap=2).collect()
    assert {(r.person, r.meeting_id) for r in capped} == {("a", 2), ("a", 3), ("d", 3), ("c", 9)}
    edits = [(1, "move", "a", None, "x"), (2, "move", "x", 1, "y"), (3, "remove", None, 9, None), (4, "move", "y", None, "a"), (5, "remove", "b", 1, None), (0, "remove", "x", None, None)]
    moved = V.followed(old, spark.createDataFrame(edits, "seq int, kind string, person string, meeting_id int, to string")).collect()
    assert sorted((r.person, r.meeting_id, r.confirmed) for r in moved) == [("a", 1, True), ("x", 2, False)]
