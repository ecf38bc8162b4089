"""Answering questions: excerpts, their citations, and conversations about them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meetlake.operators.retrieval import RANK, top
from meetlake.operators.timeline import asof_join
from meetlake.sources.settled import settle

BUDGET, HEADER, MOST = 800, 24, 8


def candidates(dense: DataFrame, words: DataFrame, routed: DataFrame, inside: int = 16, outside: int = 4, bonus: float = 0.05) -> DataFrame:
    """Passages of both lists fused: those of routed meetings first, of these more. dense: query_id, meeting_id, passage, cosine, is_note,
    named; words: query_id, meeting_id, passage, score; routed: query_id, meeting_id."""
    marked = lambda df: df.join(routed.withColumn("_in", F.lit(True)), ["query_id", "meeting_id"], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    lead = F.col("cosine") + F.when(F.col("is_note") | F.col("named"), bonus).otherwise(0.0)

    def ranked(df: DataFrame, by) -> DataFrame:
        best = top(marked(df).withColumn("_by", F.round(by, 9)), ["query_id", "meeting_id"], [F.desc("_by"), "passage"], max(inside, outside))
        trimmed = best.where(F.col("rank") <= F.when(F.col("_in"), inside).otherwise(outside))
        return trimmed.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_by"), "passage")))

    both = ranked(dense, lead).select("query_id", "meeting_id", "passage", "_in", "rank", F.lit(0).alias("_list")).unionByName(ranked(words, F.col("score")).select("query_id", "meeting_id", "passage", "_in", "rank", F.lit(1).alias("_list")))
    fused = both.groupBy("query_id", "meeting_id", "passage", "_in").agg(F.sum(1.0 / (RANK + F.col("rank"))).alias("score"), F.min(F.struct("_list", "rank")).alias("_seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc("_in"), F.desc(F.round("score", 12)), "_seen", "passage")
    return fused.select("query_id", "meeting_id", "passage", F.col("_in").alias("routed"), "score", F.row_number().over(order).alias("rank"))


SELECTED = "query_id long, k int, meeting_id long, a int, b int, text string, score double"


def selected(ranked: DataFrame, lines: DataFrame) -> DataFrame:
    """Excerpts of each question, best first, within the budget: a text once; a span that touches chosen ones of its meeting is merged with
    them, in their place, if the wider one fits; one inside a chosen one is passed over.

    ranked: query_id, rank, meeting_id, a, b (-1: a note), text, tokens, score; lines: meeting_id, utt_idx, text, tokens. A question has a few
    hundred candidates at most (they are cut before), so they and their meetings' lines fit one group.
    """
    wanted = ranked.select(F.col("query_id").alias("asked"), F.col("meeting_id").alias("of")).distinct()
    said_lines = lines.select(F.col("meeting_id").alias("of"), "utt_idx", F.col("text").alias("line"), F.col("tokens").alias("line_tokens"))
    spoken = wanted.join(said_lines, "of").select("asked", "of", "utt_idx", "line", "line_tokens")

    def choose(key: tuple, found: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        texts = {(r.of, r.utt_idx): (r.line, r.line_tokens) for r in said.itertuples()}
        taken: list[dict] = []
        for c in found.sort_values("rank").itertuples():
            if len(taken) >= MOST:
                break
            if c.text in [x["text"] for x in taken]:
                continue
            new = {"meeting_id": c.meeting_id, "a": c.a, "b": c.b, "text": c.text, "score": c.score, "cost": c.tokens + HEADER}
            beside = [x for x in taken if c.a >= 0 and x["a"] >= 0 and x["meeting_id"] == c.meeting_id and x["a"] <= c.b + 1 and c.a <= x["b"] + 1]
            if len(beside) == 1 and beside[0]["a"] <= c.a and c.b <= beside[0]["b"]:
                continue
            if beside:
                a, b = min([c.a, *(x["a"] for x in beside)]), max([c.b, *(x["b"] for x in beside)])
                parts = [texts[c.meeting_id, i] for i in range(a, b + 1) if (c.meeting_id, i) in texts]
                new |= {"a": a, "b": b, "text": " ".join(t for t, _ in parts), "score": max(x["score"] for x in beside), "cost": sum(n for _, n in parts) + HEADER}
            left = [x for x in taken if x not in beside]
            if sum(x["cost"] for x in left) + new["cost"] <= BUDGET:
                place = taken.index(beside[0]) if beside else len(left)
                left.insert(min(place, len(left)), new)
                taken = left
        rows = [(key[0], k + 1, x["meeting_id"], x["a"], x["b"], x["text"], x["score"]) for k, x in enumerate(taken)]
        return pd.DataFrame(rows, columns=["query_id", "k", "meeting_id", "a", "b", "text", "score"])

    return ranked.groupBy("query_id").cogroup(spoken.groupBy("asked")).applyInPandas(choose, SELECTED)


TAG = r"\[{1,2}(\d{1,3})\]{1,2}"


def expanded(answers: DataFrame, pool: DataFrame) -> DataFrame:
    """Answers (conversation, answer) with ``[[k]]`` as ``[[meeting@second]]`` by the conversation's excerpts (conversation, k, meeting_id, sec); a
    number without an excerpt stays."""
    named = pool.groupBy("conversation").agg(F.map_from_entries(F.collect_list(F.struct(F.col("k").cast("string").alias("k"), F.concat(F.lit("[["), F.col("meeting_id").cast("string"), F.lit("@"), F.col("sec").cast("string"), F.lit("]]")).alias("to")))).alias("_map"))
    tags, numbers = F.regexp_extract_all("answer", F.lit(TAG), F.lit(0)), F.regexp_extract_all("answer", F.lit(TAG), F.lit(1))
    between = F.split("answer", TAG, -1)
    rows = answers.join(named, "conversation", "left").withColumn("_b", between).withColumn("_t", tags).withColumn("_n", numbers)
    put = F.transform("_b", lambda b, i: F.concat(b, F.coalesce(F.try_element_at("_map", F.get("_n", i)), F.get("_t", i), F.lit(""))))
    return rows.select(*answers.columns, F.array_join(put, "").alias("expanded"))


CITE = r"\[\[[^\[\]@]+@\d+\]\]"


def collapsed(text: str):
    """Runs of citations that name a place twice keep it once, joined by the run's first separator; others stay as they are."""
    run = rf"{CITE}(?:[ \t]*[,，、;；]?[ \t]*{CITE})+"
    runs, between = F.regexp_extract_all(text, F.lit(run), F.lit(0)), F.split(text, run, -1)
    tags = lambda r: F.regexp_extract_all(r, F.lit(CITE), F.lit(0))
    sign = lambda r: F.regexp_extract(r, rf"^{CITE}([ \t]*[,，、;；]?[ \t]*)", 1)
    fixed = lambda r: F.when(F.size(F.array_distinct(tags(r))) == F.size(tags(r)), r).otherwise(F.array_join(F.transform(F.array_distinct(tags(r)), lambda t, i: F.when(i > 0, F.concat(sign(r), t)).otherwise(t)), ""))
    return F.array_join(F.transform(between, lambda b, i: F.concat(b, F.coalesce(fixed(F.get(runs, i)), F.lit("")))), "")


def checked(cites: DataFrame, excerpts: DataFrame) -> DataFrame:
    """Citations (conversation, cite_id, meeting_id, sec) moved to the nearest excerpt of their meeting in the conversation (of equally near ones the
    smallest k; a citation without a second goes to the smallest k of all); without one they are dropped. excerpts: conversation, k, meeting_id, sec.

    Equal places count once on either side; the nearest is the last at or before a place or the first from it on: two sorted passes, no pairs.
    """
    keys = ["conversation", "meeting_id"]
    known = excerpts.where("sec is not null")
    places = known.groupBy(*keys, F.col("sec").alias("_sec")).agg(F.min("k").alias("_k"))
    asked = cites.where("sec is not null").select(*keys, "sec").distinct()
    past = asof_join(asked, places.select(*keys, F.col("_sec").alias("p_sec"), F.col("_k").alias("p_k")), keys, "sec", "p_sec", ["p_sec", "p_k"], ["sec"])
    late = places.select(*keys, (-F.col("_sec")).alias("_at"), F.col("_sec").alias("n_sec"), F.col("_k").alias("n_k"))
    both = asof_join(past.withColumn("_e", -F.col("sec")), late, keys, "_e", "_at", ["n_sec", "n_k"], ["sec"])
    side = lambda s, k: F.when(F.col(s).isNotNull(), F.struct(F.abs(F.col(s) - F.col("sec")).alias("far"), F.col(k).alias("k"), F.col(s).alias("to")))
    best = both.select(*keys, "sec", F.least(side("p_sec", "p_k"), side("n_sec", "n_k")).alias("_best")).where("_best is not null")
    first = known.groupBy(*keys).agg(F.min(F.struct(F.lit(0).cast("long").alias("far"), "k", F.col("sec").alias("to"))).alias("_best"))
    found = cites.join(best, [*keys, "sec"]).select(*keys, "cite_id", "_best.far", "_best.k", "_best.to")
    bare = cites.where("sec is null").join(first, keys).select(*keys, "cite_id", "_best.far", "_best.k", "_best.to")
    return found.unionByName(bare).groupBy("conversation", "cite_id", "meeting_id").agg(F.min_by("to", F.struct("far", "k")).alias("sec"))


def pooled(excerpts: DataFrame) -> DataFrame:
    """Excerpts of all turns of a conversation, numbered through. excerpts: conversation, turn, pos."""
    return excerpts.withColumn("k", F.row_number().over(Window.partitionBy("conversation").orderBy("turn", "pos")))


def in_meeting(query_notes: DataFrame, query_lines: DataFrame, near: DataFrame, most: int = 50) -> DataFrame:
    """Results in one meeting: notes by time, then lines by place; what was found by meaning is added where no found note has its text and
    no found line lies in its span. query_notes: query_id, pos, t, text; query_lines: query_id, utt_idx; near: query_id, is_note, t, a, b, text.

    Spans and lines make no pairs: a span has a line in it if the last line by its end isn't ahead of its start. Of the notes and lines found only those move
    that may stand beside something found by meaning. Both are read twice, so they should be cheap to read.
    """
    notes = query_notes.select("query_id", F.lit(0).alias("kind"), F.col("t").cast("double").alias("at"), F.col("pos").cast("long").alias("pos"), "text", F.lit(False).alias("by_meaning"))
    lines = query_lines.select("query_id", F.lit(1).alias("kind"), F.col("utt_idx").cast("double").alias("at"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("by_meaning"))
    meant, spans = near.where("is_note"), near.where("not is_note").select("query_id", "a", F.greatest("a", "b").alias("_end"))
    asked = settle(meant.select("query_id", "text").distinct(), "asked")
    same = query_notes.select("query_id", "text").join(asked, ["query_id", "text"], "left_semi").distinct()
    more_notes = meant.join(same, ["query_id", "text"], "left_anti").select("query_id", F.lit(0).alias("kind"), F.col("t").cast("double").alias("at"), F.lit(2**40).cast("long").alias("pos"), "text", F.lit(True).alias("by_meaning"))
    around = settle(spans.groupBy("query_id").agg(F.min("a").alias("_first"), F.max("_end").alias("_last")), "around")
    told = query_lines.join(around, "query_id").where("utt_idx between _first and _last").select("query_id", "utt_idx").distinct()
    bare = asof_join(spans, told, ["query_id"], "_end", "utt_idx", ["utt_idx"], ["a", "_end"]).where("not coalesce(utt_idx >= a, false)")
    more_lines = bare.select("query_id", F.lit(1).alias("kind"), F.col("a").cast("double").alias("at"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("by_meaning"))
    every = notes.unionByName(lines).unionByName(more_notes).unionByName(more_lines)
    return top(every, ["query_id"], ["kind", "at", "pos", F.col("text")], most)
