"""SentencePiece encoding and decoding for models of the merge (BPE) type, by backtracking.

Merging repeatedly joins the adjacent pair whose union has the best score, leftmost first. Its result is the only way to cut a
text into pieces such that every two neighbours are compatible: merging their union alone gives the two again. The encoder
searches for that cut directly. Aho-Corasick lists the pieces that start at each position; the search takes the longest, checks
that it is compatible with its left neighbour, turns to shorter ones where it isn't, and steps back where none is left. A bitfield
marks positions from which the rest has failed, so none is tried twice and the time is linear in the text.

Where the vocabulary shows that no piece holds a space mark after another character, a line feed, or a Latin letter next to
another sign, a text falls into words, runs of other signs and line feeds, which are encoded independently: each distinct one of
a batch once, its ids then gathered for all places. Texts of a model without these properties are encoded whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.llm.common import slices, table, texts_of

SPACE = "▁"
NEVER = float("-inf")
#: Latin letters, the contents of a character class.
LETTERS = "A-Za-z\u00c0-\u024f"
#: Segments that a Python worker remembers from one batch for the next, at most.
REMEMBERED = 300_000
#: Characters of a long text that are cut into segments at once.
STRIDE = 1 << 20
#: What a model's normalising must leave as it is: case, compatibility forms, accents apart, runs of spaces and other white space.
PROBE = "  Aﬁ Ａ e\u0301  \t\n\u3000x  "


class Segments(dict):
    """Numbers of segments, given as they are first asked for; by number, a segment's ids (in ``flat``, up to ``ends``), and, where it isn't
    the segment itself with spaces, what they decode to."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.flat, self.ends, self.odd = encoder, array("i"), array("q", [0]), {}

    def __missing__(self, text: str) -> int:
        coder, number = self.encoder, len(self.ends) - 1
        pieces = coder.cut_pieces(text)
        try:
            self.flat.extend([coder.ids[x] for x in pieces])
        except KeyError:  # a character that is in no piece
            ids = [i for x in pieces for i in ([coder.ids[x]] if x in coder.ids else [coder.byte_ids[b] for b in x.encode("utf-8", "replace")])]
            self.flat.extend(ids)
            if (spelled := coder.spell(ids)) != text.replace(SPACE, " "):
                self.odd[number] = spelled
        self.ends.append(len(self.flat))
        self[text] = number
        return number


class Encoder:
    """Encodes and decodes as the model's library does, without begin or end ids.

    For models of the merge type with byte pieces, whose normalising puts a space mark first and for each space and changes nothing else;
    any other model is refused.
    """

    def __init__(self, model: bytes):
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [lib.id_to_piece(i) for i in range(lib.vocab_size())]
        special = [lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) for i in range(len(self.pieces))]
        self.score = {p: lib.get_score(i) for i, p in enumerate(self.pieces) if not special[i]}
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte pieces to fall back on")
        if lib.normalize(PROBE) != (SPACE + PROBE).replace(" ", SPACE):
            raise ValueError("the model normalises texts in a way that isn't supported")
        self.automaton = ahocorasick.Automaton()
        for piece in self.score:
            if len(piece) == 1 or self.merge(piece) == [piece]:  # a piece that merging never makes is no candidate
                self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.shorter = {x: next((x[:n] for n in range(len(x) - 1, 0, -1) if x[:n] in self.automaton), "") for x in self.automaton}
        self.cut = self.boundaries()
        self.compatible = lru_cache(1 << 20)(self._compatible)
        self.known = Segments(self)

    def boundaries(self) -> re.Pattern:
        """Matches the parts of a text that no piece reaches beyond, as the vocabulary shows."""
        letter, pairs = re.compile(f"[{LETTERS}]"), set()
        for piece in self.score:
            kinds = ["space" if c == SPACE else "line" if c == "\n" else "letter" if letter.match(c) else "other" for c in piece]
            pairs.update(zip(kinds, kinds[1:], strict=False))
            if kinds == ["line"]:
                pairs.add(("line", "line"))
        if any(b == "space" and a != b or "line" in (a, b) for a, b in pairs):
            return re.compile("(?s).+")
        if pairs & {("letter", "other"), ("other", "letter")}:
            return re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        return re.compile(f"{SPACE}*[{LETTERS}]+|{SPACE}*[^{SPACE}\n{LETTERS}]+|{SPACE}+|\n")

    def merge(self, text: str) -> list[str]:
        """The merging itself, for the short texts of the compatibility check."""
        parts, get = list(text), self.score.get
        scores = [get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) != NEVER:
            i = scores.index(best)  # the leftmost
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], NEVER)
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], NEVER)
        return parts

    def _compatible(self, left: str, right: str) -> bool:
        return left not in self.score or right not in self.score or self.merge(left + right) == [left, right]

    def look_ahead(self, text: str, pos: int, ends: dict[int, int]) -> None:
        """Add to ``ends`` where the longest piece from ``pos`` on ends, where the longest one from there on does, and so on, until they
        meet one that is known."""
        for end, n in self.automaton.iter_long(text, pos):
            start = end + 1 - n
            while pos < start:  # characters that are in no piece
                ends[pos] = pos = pos + 1
            if start in ends:
                return
            ends[start] = pos = end + 1
        while pos < len(text) and pos not in ends:
            ends[pos] = pos = pos + 1

    def cut_pieces(self, text: str) -> list[str]:
        """Pieces of a text; a character that is in no piece stands alone."""
        length, compatible, shorter = len(text), self.compatible, self.shorter
        failed = bytearray(length // 8 + 1)  # a bit for each position: the rest from here has failed
        ends: dict[int, int] = {}
        taken: list[str] = []
        pos, last, piece = 0, "", None  # piece: what is tried next; None: the longest
        while pos < length:
            if piece is None:
                if pos not in ends:
                    self.look_ahead(text, pos, ends)
                piece = text[pos : ends[pos]]
            while piece:
                stop = pos + len(piece)
                if not failed[stop >> 3] >> (stop & 7) & 1 and (not last or compatible(last, piece)):
                    break
                piece = shorter.get(piece)
            if piece:
                taken.append(piece)
                pos, last, piece = stop, piece, None
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                piece = taken.pop()
                pos -= len(piece)
                last, piece = taken[-1] if taken else "", shorter.get(piece, "")
        return taken

    def segments(self, text: str) -> Iterator[list[str]]:
        """The segments of a text, in lists of bounded length: a long text is cut a stride at a time."""
        text, at = SPACE + text.replace(" ", SPACE), 0
        while len(text) - at > STRIDE:
            part = self.cut.findall(text, at, at + STRIDE)
            if len(part) > 1:
                part.pop()  # it may go on
            else:
                part = [self.cut.match(text, at)[0]]
            at += sum(map(len, part))
            yield part
        yield self.cut.findall(text, at)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The ids of all texts in a row, where each text's end (0 first), and what they decode to."""
        known, parts, counts = self.known, [], [0]
        for text in texts:
            found = [np.fromiter(map(known.__getitem__, x), np.int64, len(x)) for x in self.segments(text)] if text else []
            parts.extend(found)
            counts.append(counts[-1] + sum(map(len, found)))
        codes = np.concatenate(parts) if parts else np.empty(0, np.int64)
        ends, flat = np.array(known.ends), np.array(known.flat, np.int32)
        sizes = ends[codes + 1] - ends[codes]
        after = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(ends[codes] - after[:-1], sizes) + np.arange(after[-1])]
        decoded = [x.replace(SPACE, " ") for x in texts]
        if known.odd:
            odd = np.isin(codes, np.fromiter(known.odd, np.int64, len(known.odd)))
            for k in np.unique(np.searchsorted(counts, np.flatnonzero(odd), "right") - 1).tolist():
                own = (x for part in self.segments(texts[k]) for x in part)
                decoded[k] = "".join([known.odd.get(known[x], x.replace(SPACE, " ")) for x in own])[1:]
        if len(known) > REMEMBERED:  # keep what this batch had more than once
            often = np.bincount(codes, minlength=len(known)) > 1
            self.known = Segments(self)
            for text, code in known.items():
                if often[code]:
                    self.known[text]
        return ids, after[counts], decoded

    def encode(self, text: str) -> tuple[list[int], str]:
        """The ids of a text, and what they decode to."""
        ids, _, decoded = self.encode_all([text])
        return ids.tolist(), decoded[0]

    def spell(self, ids: list[int]) -> str:
        """Pieces put together; runs of byte pieces become UTF-8, what isn't valid in them U+FFFD."""
        out, run = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.pieces[i].replace(SPACE, " "))
        return "".join(out) + run.decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        text = self.spell(ids)
        return text[1:] if text.startswith(" ") else text


@lru_cache(2)
def encoder(model: bytes) -> Encoder:
    return Encoder(model)


def encode_texts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (string), one row per document.

    Ids are those of the library's encode() without begin or end ids; decoded is what its decode() makes of them. Null texts
    count as empty: no ids, an empty string. Repeated rows are each returned; a null doc_id stays null; other columns are not
    read; an empty table gives no rows. Very long texts are cut a stride at a time. The model file is read on the driver and broadcast (its size is a tokenizer's, not the data's).
    """
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model.value)
        for batch in slices(batches, "text", 4 << 20):
            place: dict[str, int] = {}  # of each distinct text of the batch
            rows = pa.array([place.setdefault(x, len(place)) for x in texts_of(batch.column("text"))], pa.int32())
            ids, ends, decoded = coder.encode_all(list(place))
            own = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), own.take(rows), pa.array(decoded, pa.string()).take(rows)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return digests(encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model")))
