"""Edits of transcripts in bulk: labels, boundaries, splits, undo, and the times that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetlake.functions import text as X


def relabelled(lines: DataFrame, edits: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with the last edit's speaker, and links without speakers that have no line left. edits: meeting_id, utt_idx, seq, new_speaker."""
    last = edits.groupBy("meeting_id", "utt_idx").agg(F.max_by("new_speaker", "seq").alias("_new"))
    found = lines.join(last, ["meeting_id", "utt_idx"], "left").withColumn("speaker", F.coalesce("_new", "speaker")).drop("_new")
    return found, links.join(found.select("meeting_id", "speaker").distinct(), ["meeting_id", "speaker"], "left_semi")


def other_speakers(lines: DataFrame) -> DataFrame:
    """Each line with the meeting's other speakers in order."""
    everyone = lines.groupBy("meeting_id").agg(F.array_sort(F.collect_set("speaker")).alias("_all"))
    return lines.join(everyone, "meeting_id").select("meeting_id", "utt_idx", F.array_remove("_all", F.col("speaker")).alias("others"))


def token_starts(lines: DataFrame) -> DataFrame:
    """Tokens of lines with their starts: the recogniser's offsets where there are as many, else by the share of visible characters before."""
    tokens = lines.withColumn("_t", X.edit_tokens(F.col("text")))
    each = tokens.select("meeting_id", "utt_idx", "start_s", "end_s", "token_times", F.size("_t").alias("_n"), F.posexplode("_t").alias("k", "token"))
    w = Window.partitionBy("meeting_id", "utt_idx")
    visible = F.greatest(F.lit(1), F.char_length(F.regexp_replace("token", r"\s", "")))
    before, whole = F.coalesce(F.sum(visible).over(w.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.sum(visible).over(w)
    spread = F.col("start_s") + (F.col("end_s") - F.col("start_s")) * before / whole
    at = F.when(F.size("token_times") == F.col("_n"), F.col("start_s") + F.get("token_times", F.col("k"))).otherwise(spread)
    return each.withColumn("at", at).select("meeting_id", "utt_idx", "k", "token", "at")


def moved_boundaries(lines: DataFrame, moves: DataFrame) -> DataFrame:
    """Line pairs whose boundary is moved to a token: the first ``k`` tokens of both together stay with the first (one at least on either
    side), and both times follow. One move for each pair. moves: meeting_id, seam (the first line), k."""
    w = Window.partitionBy("meeting_id").orderBy("utt_idx")
    paired = lines.withColumn("_next", F.lead(F.struct("utt_idx", "text", "end_s", "start_s")).over(w)).join(moves, (lines.meeting_id == moves.meeting_id) & (lines.utt_idx == moves.seam)).drop(moves.meeting_id)
    joined = paired.where("_next is not null").withColumn("_t", F.concat(X.edit_tokens(F.col("text")), X.edit_tokens(F.col("_next.text"))))
    k = F.greatest(F.lit(1), F.least(F.col("k"), F.size("_t") - 1)).cast("int")
    head, tail = F.array_join(F.slice("_t", F.lit(1), k), ""), F.array_join(F.slice("_t", k + 1, F.size("_t")), "")
    at = F.col("start_s") + (F.col("_next.end_s") - F.col("start_s")) * F.char_length(head) / F.greatest(F.lit(1), F.char_length(head) + F.char_length(tail))
    new = joined.where(F.size("_t") > 1).select("meeting_id", F.array(F.struct(F.col("utt_idx"), head.alias("t"), F.col("start_s").alias("a"), at.alias("b")), F.struct(F.col("_next.utt_idx").alias("utt_idx"), tail.alias("t"), at.alias("a"), F.col("_next.end_s").alias("b"))).alias("_n"))
    new = new.select("meeting_id", F.explode("_n").alias("n")).select("meeting_id", "n.*")
    found = lines.join(new, ["meeting_id", "utt_idx"], "left")
    return found.select("meeting_id", "utt_idx", "speaker", F.coalesce("a", "start_s").alias("start_s"), F.coalesce("b", "end_s").alias("end_s"), F.coalesce("t", "text").alias("text"))


def split_lines(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """Lines split before a token, the rest going to a speaker; lines are numbered anew. splits: meeting_id, utt_idx, k, new_speaker."""
    tokens = lines.join(splits, ["meeting_id", "utt_idx"], "left").withColumn("_t", F.when(F.col("k").isNotNull(), X.edit_tokens(F.col("text"))))
    fits = F.coalesce((F.col("k") >= 1) & (F.col("k") < F.size("_t")), F.lit(False))
    head, tail = F.array_join(F.slice("_t", F.lit(1), F.col("k")), ""), F.array_join(F.slice("_t", F.col("k") + 1, F.greatest(F.lit(0), F.size("_t"))), "")
    at = F.col("start_s") + (F.col("end_s") - F.col("start_s")) * F.char_length(head) / F.greatest(F.lit(1), F.char_length("text"))
    part = lambda p, speaker, a, b, text: F.struct(F.lit(p).alias("p"), speaker.alias("speaker"), a.alias("start_s"), b.alias("end_s"), text.alias("text"))
    c = F.col
    both = F.array(part(0, c("speaker"), c("start_s"), at, head), part(1, c("new_speaker"), at, c("end_s"), tail))
    parts = tokens.select("meeting_id", "utt_idx", F.explode(F.when(fits, both).otherwise(F.array(part(0, c("speaker"), c("start_s"), c("end_s"), c("text"))))).alias("x")).select("meeting_id", "utt_idx", "x.*")
    n = F.row_number().over(Window.partitionBy("meeting_id").orderBy("utt_idx", "p")) - 1
    return parts.select("meeting_id", n.alias("utt_idx"), "speaker", "start_s", "end_s", "text")


def edit_state(log: DataFrame, keep: int = 50) -> DataFrame:
    """Edits that hold after undo and redo, the last ``keep``: undo takes the last edit back, redo the last undone one, a new edit forgets the
    undone. log: meeting_id, seq, action (edit, undo, redo). A fold over a meeting's log."""
    rows = log.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("seq", "action"))).alias("log"))
    none = F.expr("cast(array() as array<bigint>)")
    last = lambda a: F.element_at(a, -1)
    rest = lambda a: F.slice(a, F.lit(1), F.size(a) - 1)
    state = lambda done, undone: F.struct(done.alias("done"), undone.alias("undone"))
    step = lambda s, x: (
        F.when(x["action"] == "edit", state(F.slice(F.concat(s["done"], F.array(x["seq"].cast("long"))), -F.least(F.lit(keep), F.size(s["done"]) + 1), F.lit(keep)), none))
        .when((x["action"] == "undo") & (F.size(s["done"]) > 0), state(rest(s["done"]), F.concat(s["undone"], F.array(last(s["done"])))))
        .when((x["action"] == "redo") & (F.size(s["undone"]) > 0), state(F.concat(s["done"], F.array(last(s["undone"]))), rest(s["undone"])))
        .otherwise(s)
    )
    return rows.select("meeting_id", F.aggregate("log", state(none, none), step).alias("s")).select("meeting_id", "s.done", "s.undone")


def long_lines(lines: DataFrame, seconds: float = 20.0, characters: int = 100, close: int = 90, tail: int = 30) -> DataFrame:
    """Long lines in pieces that end with sentences: from ``close`` characters on a sentence's end closes a piece, and a short rest joins the
    last one; times by share of characters. Other lines stay. A fold over a long line's sentences, of lengths alone; the sentences are cut once."""
    long = (F.col("end_s") - F.col("start_s") > seconds) & (F.char_length("text") > characters)
    sentences = F.regexp_extract_all("text", F.lit(r"[^。？！?!.；;]*(?:[。？！?!；;]|\.(?= |$)|\.|$)"), F.lit(0))
    none = F.expr("cast(array() as array<string>)")
    cut = lines.withColumn("_t", F.when(long, F.filter(sentences, lambda x: x != "")).otherwise(none))
    after = F.concat(F.slice("_t", F.lit(2), F.size("_t")), F.array(F.lit(None).cast("string")))
    # A full stop ends a sentence before a space or at the end alone: what follows another one starts without a space.
    marks = F.transform(F.arrays_zip(F.col("_t").alias("t"), after.alias("next")), lambda x: F.struct(F.char_length(x["t"]).alias("n"), x["t"].rlike(r"[。？！?!.；;]$").alias("ends"), (~x["t"].endswith(".") | F.coalesce(x["next"].startswith(" "), F.lit(True))).alias("stops"), (F.trim(x["t"]) == "").alias("blank"), x["t"].rlike(r"^(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])\z").alias("turn")))
    marked = cut.withColumn("_m", marks)
    # The piece that is open (its sentences, characters, whether it is blank) and those that are closed.
    state = lambda k, n, blank, out: F.struct(k.alias("k"), n.alias("n"), blank.alias("blank"), out.alias("out"))
    piece = lambda k, n: F.struct(k.alias("k"), n.alias("n"))

    def step(s: Column, x: Column) -> Column:
        k, n = s["k"] + 1, s["n"] + x["n"]
        # A line's end after a sentence's, as the last one, leaves that the end.
        closes = (x["ends"] | x["turn"] & (s["k"] > 0)) & (n >= close) & x["stops"]
        return F.when(closes, state(F.lit(0), F.lit(0), F.lit(True), F.concat(s["out"], F.array(piece(k, n))))).otherwise(state(k, n, s["blank"] & x["blank"], s["out"]))

    folded = marked.withColumn("_s", F.aggregate("_m", state(F.lit(0), F.lit(0), F.lit(True), F.expr("cast(array() as array<struct<k:int,n:int>>)")), step)).drop("_m")
    out, rest = F.col("_s.out"), piece(F.col("_s.k"), F.col("_s.n"))
    last = F.element_at(out, -1)
    joins = (F.size(out) > 0) & (F.col("_s.n") < tail)
    whole = F.when(F.col("_s.blank"), out).when(joins, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(piece(last["k"] + F.col("_s.k"), last["n"] + F.col("_s.n"))))).otherwise(F.concat(out, F.array(rest)))
    # Pieces with the sentences and characters before them.
    placed = F.aggregate("_p", F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), F.expr("cast(array() as array<struct<k0:int,n0:int,k:int,n:int>>)").alias("out")), lambda s, x: F.struct((s["k"] + x["k"]).alias("k"), (s["n"] + x["n"]).alias("n"), F.concat(s["out"], F.array(F.struct(s["k"].alias("k0"), s["n"].alias("n0"), x["k"].alias("k"), x["n"].alias("n")))).alias("out")))
    one = F.array(piece(F.lit(0), F.char_length("text")))
    each = folded.withColumn("_long", long).withColumn("_p", F.when(F.col("_long"), whole).otherwise(one)).withColumn("_q", placed)
    # Outer: what Spark infers from a plain explode, that the array isn't empty, it works out below, by folding each line over and over.
    each = each.select(*lines.columns, "_t", "_long", F.col("_q.n").alias("_all"), F.posexplode_outer("_q.out").alias("piece", "_x")).where("piece is not null")
    text = F.when(F.col("_long"), F.array_join(F.slice("_t", F.col("_x.k0") + 1, F.col("_x.k")), "")).otherwise(F.col("text"))
    n, before, all_ = F.col("_x.n"), F.col("_x.n0"), F.greatest(F.lit(1), F.col("_all"))
    span = F.col("end_s") - F.col("start_s")
    return each.select("meeting_id", "utt_idx", "piece", "speaker", (F.col("start_s") + span * before / all_).alias("start_s"), (F.col("start_s") + span * (before + n) / all_).alias("end_s"), F.trim(text).alias("text"))


def sentence_snapped(pieces: DataFrame) -> DataFrame:
    """Pieces in which up to three characters after a sentence's end go to the next speaker's piece; what a piece was given counts for
    its own end too. pieces: meeting_id, pos, speaker (null: untagged), text. A fold over a meeting's pieces."""
    form = r"(?s)^(.*[。？！?!])(.{1,3})$"
    rows = pieces.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "speaker", "text"))).alias("rows"))
    following = F.transform("rows", lambda r, i: F.struct(r.alias("r"), F.get("rows", i + 1).alias("next")))

    def step(s: Column, x: Column) -> Column:
        text = F.concat(s["carry"], x["r"]["text"])
        turns = F.coalesce((x["r"]["speaker"] != x["next"]["speaker"]) & text.rlike(form), F.lit(False))
        kept, carry = F.when(turns, F.regexp_extract(text, form, 1)).otherwise(text), F.when(turns, F.regexp_extract(text, form, 2)).otherwise("")
        return F.struct(carry.alias("carry"), F.concat(s["out"], F.array(F.struct(x["r"]["pos"].alias("pos"), kept.alias("text")))).alias("out"))

    start = F.struct(F.lit("").alias("carry"), F.expr("cast(array() as array<struct<pos:bigint,text:string>>)").alias("out"))
    return rows.select("meeting_id", F.explode(F.aggregate(following, start, step)["out"]).alias("o")).select("meeting_id", "o.pos", "o.text")


def enrolment(lines: DataFrame, until: DataFrame, each: float = 6.0, total: float = 60.0, least: float = 1.0) -> DataFrame:
    """Clips of a meeting's earlier speech: speakers as they appear, their longest lines first, up to ``each`` seconds a speaker and
    ``total`` in all. lines: meeting_id, utt_idx, speaker, start_s, end_s; until: meeting_id, offset_s. A fold in speaker order."""
    firsts = lines.groupBy("meeting_id", "speaker").agg(F.min("utt_idx").alias("_first"))
    usable = lines.join(until, "meeting_id").where((F.col("end_s") <= F.col("offset_s")) & (F.col("end_s") - F.col("start_s") >= least)).join(firsts, ["meeting_id", "speaker"])
    row = F.struct(F.col("_first").alias("o"), (F.col("start_s") - F.col("end_s")).alias("l"), F.col("utt_idx").alias("i"), "speaker", "start_s", "end_s")
    ordered = usable.groupBy("meeting_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    none = F.expr("cast(array() as array<struct<speaker:int,start_s:double,end_s:double>>)")

    def step(s: Column, x: Column) -> Column:
        got = F.when(s["speaker"] == x["speaker"], s["got"]).otherwise(0.0)
        shut = F.coalesce((s["speaker"] == x["speaker"]) & s["shut"], F.lit(False))
        n = F.least(-x["l"], each - got, total - s["all"])
        takes = ~shut & (n >= least)
        clip = F.struct(x["speaker"].cast("int").alias("speaker"), x["start_s"].alias("start_s"), (x["start_s"] + n).alias("end_s"))
        return F.struct(x["speaker"].cast("int").alias("speaker"), F.when(takes, got + n).otherwise(got).alias("got"), (~takes).alias("shut"), F.when(takes, s["all"] + n).otherwise(s["all"]).alias("all"), F.when(takes, F.concat(s["out"], F.array(clip))).otherwise(s["out"]).alias("out"))

    start = F.struct(F.lit(-1).alias("speaker"), F.lit(0.0).alias("got"), F.lit(False).alias("shut"), F.lit(0.0).alias("all"), none.alias("out"))
    return ordered.select("meeting_id", F.posexplode(F.aggregate("rows", start, step)["out"]).alias("clip", "c")).select("meeting_id", "clip", "c.*")


def laid_out(clips: DataFrame, gap: float) -> DataFrame:
    """Clips with where they begin in the stream (``_at``) and where the gap after them ends (``_to``)."""
    before = Window.partitionBy("meeting_id").orderBy("clip").rowsBetween(Window.unboundedPreceding, -1)
    long = F.col("end_s") - F.col("start_s") + gap
    return clips.withColumn("_at", F.coalesce(F.sum(long).over(before), F.lit(0.0))).withColumn("_to", F.col("_at") + long)


def from_enrolment(times: DataFrame, clips: DataFrame, until: DataFrame, gap: float = 1.0) -> DataFrame:
    """Times of a stream that plays clips with gaps before the audio goes on, as times of the original: within a clip its own, in a gap the
    clip's end. times: meeting_id, q_id, t."""
    laid = laid_out(clips, gap)
    whole = laid.groupBy("meeting_id").agg(F.max("_to").alias("_length"))
    asked = times.join(until, "meeting_id").join(whole, "meeting_id", "left").join(laid.select("meeting_id", "start_s", "end_s", "_at", "_to").withColumnRenamed("meeting_id", "_m"), (F.col("_m") == F.col("meeting_id")) & (F.col("t") >= F.col("_at")) & (F.col("t") < F.col("_to")), "left")
    inside = F.least(F.col("start_s") + F.col("t") - F.col("_at"), F.col("end_s"))
    return asked.select("meeting_id", "q_id", "t", F.coalesce(inside, F.col("t") - F.coalesce("_length", F.lit(0.0)) + F.col("offset_s")).alias("original"))


def lines_from_enrolment(lines: DataFrame, clips: DataFrame, until: DataFrame, gap: float = 1.0) -> DataFrame:
    """Lines of such a stream with original_start and original_end. A line that starts in a clip is cut at the clip's end. One that starts in a gap belongs to
    what follows it: the clip in which it ends, or the audio after the clips; one that doesn't leave the gap is silence at the clip's end.
    lines: meeting_id, utt_idx, start_s, end_s; a meeting has some sixty seconds of clips."""
    laid = laid_out(clips, gap)
    whole = laid.groupBy("meeting_id").agg(F.max("_to").alias("_length"))
    first, last = (laid.select(F.col("meeting_id").alias(f"_m{k}"), *(F.col(c).alias(f"{n}{k}") for c, n in (("start_s", "_s"), ("end_s", "_e"), ("_at", "_a"), ("_to", "_t")))) for k in "12")
    held = lambda k, t: (F.col(f"_m{k}") == F.col("meeting_id")) & (F.col(t) >= F.col(f"_a{k}")) & (F.col(t) < F.col(f"_t{k}"))
    found = lines.join(until, "meeting_id").join(whole, "meeting_id", "left").join(first, held("1", "start_s"), "left").join(last, held("2", "end_s"), "left")
    beyond = lambda t: F.col(t) - F.coalesce("_length", F.lit(0.0)) + F.col("offset_s")
    inside = F.col("start_s") - F.col("_a1") < F.col("_e1") - F.col("_s1")
    own = F.col("_s1") + (F.col("start_s") - F.col("_a1"))
    start = F.when(F.col("_m1").isNull(), beyond("start_s")).when(inside, own).when(F.col("_m2").isNull(), F.col("offset_s")).when(F.col("_a2") == F.col("_a1"), F.col("_e1")).otherwise(F.col("_s2"))
    to = F.when(F.col("_m2").isNull(), beyond("end_s")).otherwise(F.least(F.col("_s2") + F.col("end_s") - F.col("_a2"), F.col("_e2")))
    end = (
        F.when(F.col("_m1").isNull(), to).when(inside, F.greatest(own, F.least(F.col("_e1"), F.col("_s1") + (F.col("end_s") - F.col("_a1")))))
        .when(F.col("_m2").isNull(), F.greatest("offset_s", beyond("end_s"))).when(F.col("_a2") == F.col("_a1"), F.col("_e1")).otherwise(F.least(F.col("_e2"), F.col("_s2") + (F.col("end_s") - F.col("_a2"))))
    )
    return found.select("meeting_id", "utt_idx", "start_s", "end_s", start.alias("original_start"), end.alias("original_end"))
