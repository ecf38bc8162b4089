"""Speaker changes moved to where the incoming speaker's turn starts, and token times from code points."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds: how far a turn may be, what a turn is padded by, how long after its start a change stands, a pause that holds, and the longest move.
NEAR, PAD, LEAD, PAUSE, FAR = 3.0, 0.45, 0.30, 0.5, 0.4
#: Turns are looked up by so many seconds.
HELD = 60.0
SPOKEN = re.compile(r"[^\W_]", re.ASCII)
SILENT = re.compile("[ -⁯　-〿＀-／：-＠［-｀｛-･]")
WORD = re.compile(r"[A-Za-z0-9']")


def spoken(ch: str) -> bool:
    return bool(SPOKEN.match(ch)) if ch.isascii() else not SILENT.match(ch)


def aimed(changes: DataFrame, turns: DataFrame) -> DataFrame:
    """meeting_id, pos and target (seconds) of each change (meeting_id, pos, label, t) that has a turn of its speaker near, at whose start nobody else speaks.
    Changes meet starts in buckets of NEAR seconds, and starts what others say in buckets of HELD, so a meeting's turns aren't all compared with each other."""
    own = turns.select("meeting_id", F.col("label"), F.col("start_s").alias("_start")).withColumn("_k", F.floor((F.col("_start") + LEAD) / NEAR))
    off = F.abs(F.col("_start") + LEAD - F.col("t"))
    here = F.floor(F.col("t") / NEAR)
    best = changes.withColumn("_k", F.explode(F.array(here - 1, here, here + 1))).join(own, ["meeting_id", "label", "_k"]).where(off <= NEAR).groupBy("meeting_id", "pos", "label").agg(F.min_by("_start", F.struct(off, "_start")).alias("_start"))
    unpadded = lambda c: F.when(c == 0, 0.0).otherwise(c + PAD)
    core = best.withColumn("_core", unpadded(F.col("_start"))).withColumn("_k", F.floor(F.col("_core") / HELD))
    others = turns.select(F.col("meeting_id").alias("_m"), F.col("label").alias("_l"), unpadded(F.col("start_s")).alias("_a"), (F.col("end_s") - PAD).alias("_e")).where("_e > _a")
    others = others.withColumn("_h", F.explode(F.sequence(F.floor(F.col("_a") / HELD), F.floor(F.col("_e") / HELD))))
    crossed = (F.col("meeting_id") == F.col("_m")) & (F.col("_k") == F.col("_h")) & (F.col("_l") != F.col("label")) & (F.col("_a") < F.col("_core")) & (F.col("_e") > F.col("_core"))
    return core.join(others, crossed, "left_anti").select("meeting_id", "pos", (F.col("_start") + LEAD).alias("target"))


def targets(chars: DataFrame, turns: DataFrame) -> DataFrame:
    """aimed() of the changes between characters."""
    before = F.lag("label").over(Window.partitionBy("meeting_id").orderBy("pos"))
    return aimed(chars.withColumn("_b", before).where("_b <> label").select("meeting_id", "pos", "label", F.col("start_s").alias("t")), turns)


def kinds(text: str) -> tuple[list[bool], list[bool]]:
    """Of each character whether it is spoken, and whether it is part of a word; each distinct one is looked at once."""
    known, which = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    return tuple(np.array([bool(rule(chr(c))) for c in known], bool)[which].tolist() for rule in (spoken, WORD.match))


def moved(marks: list, at: list[float], until: list[float], said: list[bool], words: list[bool], wanted: dict[int, float]) -> list:
    """The labels of one meeting's characters after its changes have moved; ``wanted``: targets by the places of changes."""
    edges = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]

    def pause(i: int) -> float:
        left = next((j for j in range(i - 1, -1, -1) if said[j]), None)
        right = next((j for j in range(i, len(said)) if said[j]), None)
        return 0.0 if left is None or right is None else at[right] - until[left]

    new, floor = list(marks), 0
    for begin, here, end in zip(edges, edges[1:], edges[2:], strict=False):
        if here not in wanted:
            continue
        span = range(max(begin, floor) + 1, end)
        to = next((j for j in span if at[j] >= wanted[here]), None)
        if to is None:
            continue
        while to > span[0] and words[to - 1] and words[to]:
            to -= 1
        inside = words[to - 1] and words[to]
        both = any(said[max(begin, floor) : to]) and any(said[to:end])
        if to == here or inside or not both or not any(said[min(to, here) : max(to, here)]) or abs(at[to] - at[here]) > FAR or pause(here) >= PAUSE and pause(to) < pause(here):
            continue
        new[min(to, here) : max(to, here)] = [marks[here] if to < here else marks[here - 1]] * abs(to - here)
        floor = to
    return new


def snapped_changes(chars: DataFrame, turns: DataFrame) -> DataFrame:
    """Characters (meeting_id, pos, ch, start_s, end_s, label) with labels after the changes have moved.

    A change goes to the first character at or after its target, or to the start of the word that this one is in. It stays where it is if a side
    would be left without anything spoken, nothing spoken would move, the move is long, or it stands at a longer pause; it never passes the
    change before it. What depends on earlier changes runs over one meeting's characters.
    """

    def move(key: tuple, text: pd.DataFrame, aims: pd.DataFrame) -> pd.DataFrame:
        text = text.sort_values("pos").reset_index(drop=True)
        where = {p: i for i, p in enumerate(text.pos)}
        wanted = {where[p]: t for p, t in zip(aims["at"], aims.target, strict=True) if p in where}
        new = moved(list(text.label), list(text.start_s), list(text.end_s), [spoken(c) for c in text.ch], [bool(WORD.match(c)) for c in text.ch], wanted)
        return pd.DataFrame({"meeting_id": text.meeting_id, "pos": text.pos, "ch": text.ch, "label": new})

    aims = targets(chars, turns).select(F.col("meeting_id").alias("of"), F.col("pos").alias("at"), "target")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chars.select("meeting_id", "pos", "ch", "label").schema)
    return chars.groupBy("meeting_id").cogroup(aims.groupBy("of")).applyInPandas(move, kept)


def snapped_pieces(pieces: DataFrame, turns: DataFrame) -> DataFrame:
    """snapped_changes() of characters that stand in pieces, of which none has a row of its own: meeting_id, pos, text and label, cut where labels change.

    pieces: meeting_id, pos (a long, of its first character), text, label, start_s, step_s, first: its character k, from 0, has the number pos + k and
    lasts from start_s + (first + k) * step_s for step_s seconds. The label is no null.
    """

    def move(text: pa.Table, aims: pa.Table) -> pa.Table:
        text = text.sort_by("pos")
        parts, labels = text.column("text").to_pylist(), text.column("label").to_pylist()
        sizes = np.array([len(x) for x in parts], np.int64)
        ends = np.cumsum(sizes)
        pos, start, step, first = (np.repeat(text.column(c).to_numpy(), sizes) for c in ("pos", "start_s", "step_s", "first"))
        k = np.arange(len(pos)) - np.repeat(ends - sizes, sizes)
        places, at, until = pos + k, start + (first + k) * step, start + (first + k + 1) * step
        asked = aims.column("at").to_numpy()
        held = np.minimum(np.searchsorted(places, asked), max(0, len(places) - 1))
        wanted = {int(i): t for i, p, t in zip(held, asked, aims.column("target").to_pylist(), strict=True) if places[i] == p} if len(places) else {}
        marks = [x for x, n in zip(labels, sizes.tolist(), strict=True) for _ in range(n)]
        new = moved(marks, at.tolist(), until.tolist(), *kinds("".join(parts)), wanted)
        cut = [(row, a, b) for row, (b_, n) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)) for a, b in runs(new, b_ - n, b_)]
        rows = text.take(pa.array([x[0] for x in cut], pa.int64()))
        base = ends - sizes
        whole = [parts[row][a - base[row] : b - base[row]] for row, a, b in cut]
        fields = {"meeting_id": rows.column("meeting_id"), "pos": pa.array([int(places[a]) for _, a, _ in cut], pa.int64()), "text": pa.array(whole, pa.string()), "label": pa.array([new[a] for _, a, _ in cut], text.schema.field("label").type)}
        return pa.table(fields)

    order = Window.partitionBy("meeting_id").orderBy("pos")
    filled = pieces.where(F.char_length("text") > 0)
    changes = filled.withColumn("_b", F.lag("label").over(order)).where("_b <> label")
    aims = aimed(changes.select("meeting_id", "pos", "label", (F.col("start_s") + F.col("first") * F.col("step_s")).alias("t")), turns)
    types = dict(filled.dtypes)
    kept = f"meeting_id {types['meeting_id']}, pos long, text string, label {types['label']}"
    rows = filled.select("meeting_id", "pos", "text", "label", "start_s", "step_s", "first").groupBy("meeting_id")
    return rows.cogroup(aims.select(F.col("meeting_id").alias("of"), F.col("pos").alias("at"), "target").groupBy("of")).applyInArrow(move, kept)


def runs(marks: list, begin: int, end: int) -> list[tuple[int, int]]:
    """Stretches of equal labels between two places."""
    edges = [begin, *(i for i in range(begin + 1, end) if marks[i] != marks[i - 1]), end]
    return list(zip(edges, edges[1:], strict=False))


def aligned_times(lines: DataFrame, ahead: int = 12) -> DataFrame:
    """Token starts of lines from the recogniser's raw characters: each character of a token takes the next equal raw one, at most ``ahead``
    further on; null where fewer than half find one. lines: meeting_id, utt_idx, tokens (array of text), raw, starts (one for each raw character)."""

    def align(tokens: list[str], raw: str, starts: list[float]) -> list[float] | None:
        if raw is None or starts is None or len(raw) != len(starts) or not len(tokens):
            return None
        kept = [(c, s) for c, s in zip(raw, starts, strict=True) if not c.isspace()]
        at, hits, whole, firsts = 0, 0, 0, []
        for token in tokens:
            first = None
            for c in token:
                if c.isspace():
                    continue
                whole += 1
                k = next((k for k in range(at, min(at + ahead, len(kept))) if kept[k][0] == c), None)
                if k is not None:
                    first = kept[k][1] if first is None else first
                    at, hits = k + 1, hits + 1
            firsts.append(first)
        known = [x for x in firsts if x is not None]
        if not known or 2 * hits < whole:
            return None
        out = [known[0]]
        for x in firsts:
            out.append(max(out[-1], x) if x is not None else out[-1])
        return out[1:]

    @F.pandas_udf("array<double>")
    def run(tokens: pd.Series, raw: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([align(*row) for row in zip(tokens, raw, starts, strict=True)])

    return lines.withColumn("token_starts", run("tokens", "raw", "starts"))
