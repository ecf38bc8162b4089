r"""Personal data by a semi-Markov conditional random field.

Four patterns find plain e-mail addresses, IP addresses, card and phone numbers. The field finds more: obfuscated addresses, numbers
with other separators, phones without a plus. It scores candidate segments as wholes (digits, groups, separators, checksum, octets,
what stands around them) and each type after the one before it, and a dynamic programme over segments of at most LONGEST tokens and
WIDEST characters chooses boundaries and types of a stretch of text jointly. What it returns is the best cut of the stretch, where each
segment has to outweigh ADDED. Pattern spans are fixed: they part the segments, and their types count as what stood before.

The field is trained where it runs: on stretches around digits and at-signs of a bounded sample of documents, labelled by the
patterns, and on rewritten copies of these in which the spans are obfuscated or, with spoilt digits, no personal data any more.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.llm.common import settle, slices, table, texts_of

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
#: Tokens and characters of a segment at most; characters that a stretch has before and after what makes it one.
LONGEST, WIDEST, AROUND = 24, 320, 24
#: Documents sampled and stretches trained on, at most, and their length; passes over these; the log odds that a span has to outweigh.
SAMPLE, STRETCHES, TRAINED, PASSES, ADDED = 4_000, 400, 400, 6, 2.0

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_SIGNS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from their at-signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_SIGNS:
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """What the patterns find, by kind."""
    found: list[list[tuple[int, int]]] = [list(emails(text)) if "@" in text else [], [], [], []]
    found[1] = [m.span() for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split("."))]
    found[2] = [m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found[3] = [m.span() for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return found


TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\S")
#: What a stretch lies around: at-signs, written-out ones, or runs of signs with digits.
SPARK = re.compile(r"@|[\[({<] ?at ?[\])}>]| at [A-Za-z0-9-]++ dot |[0-9][0-9 ().\[\]/-]{6,}+")


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Parts of a text that may hold personal data; they don't overlap."""
    start = end = -1
    for m in SPARK.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if a <= end:
            end = max(end, b)
            continue
        if end >= 0:
            yield start, end
        start, end = a, b
    if end >= 0:
        yield start, end


#: The widest forms of addresses: at-signs and dots may be in brackets, written out or set apart; octets have one separator.
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+(?: ?[\[({<] ?(?:@|at) ?[\])}>] ?| ?@ ?| at )[A-Za-z0-9-]+(?:(?: ?[\[({<] ?(?:\.|dot) ?[\])}>] ?| ?\. ?| dot )[A-Za-z0-9-]+)+")
OCTETS = re.compile(r"[0-9]{1,4}( ?[\[({<]?(?:[.,]|dot)[\])}>]? ?)[0-9]{1,4}\1[0-9]{1,4}\1[0-9]{1,4}")


def bucket(n: int) -> str:
    return str(n) if n < 20 else "20"


def kinds_of(span: str, digits: int, letters: int, ats: int) -> list[int]:
    """Types that a segment can have at all, with the numbers of digits, letters, and at-signs or words "at" in it."""
    found = []
    if ats and ADDRESS.fullmatch(span):
        found.append(0)
    if "0" <= span[-1] <= "9":
        if 4 <= digits <= 16 and "0" <= span[0] <= "9" and OCTETS.fullmatch(span):
            found.append(1)
        if not letters:
            if "0" <= span[0] <= "9" and 13 <= digits <= 19:
                found.append(2)
            if 7 <= digits <= 15 and span[0] in "+(0123456789":
                found.append(3)
    return found


def span_features(text: str, start: int, end: int) -> list[str]:
    """Features of a whole segment in its place."""
    span = text[start:end]
    digits, groups = digits_of(span), re.findall("[0-9]+", span)
    between = sorted(set(re.sub(r"[A-Za-z0-9]+", " ", span.replace(" ", "_")).split()))
    around = lambda c: "none" if not c else "letter" if c.isalpha() else "digit" if c.isdigit() else "space" if c.isspace() else c
    ats = len(re.findall(r"@|\bat\b", span))
    return [
        "bias", f"digits={bucket(len(digits))}", f"groups={bucket(len(groups))}", f"sizes={'-'.join(str(len(g)) for g in groups[:6])}", *(f"between={x}" for x in between[:6]),
        f"kinds of separators={len(between)}", f"luhn={len(digits) >= 13 and luhn(digits)}", f"octets={len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups)}",
        f"first={around(span[0])}", f"before={around(text[start - 1 : start])}", f"after={around(text[end : end + 1])}", f"ats={min(ats, 3)}",
        f"domain={bool(re.search(r'(?:[.]|dot)[ )}>]*[A-Za-z]{2,6}$', span))}", f"plain local={bool(re.match(r'[A-Za-z0-9._%+-]+ ?(?:@|[(<{]? ?at )', span))}", f"words={bucket(len(re.findall('[A-Za-z]+', span)))}",
    ]


def candidates(text: str, start: int, end: int, fixed: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, list[str]]], dict[int, int]]:
    """Tokens of a stretch outside the fixed spans (start, end, type; sorted, apart from each other), segments of them (first token, one past the
    last, type, features), and by the token that follows it the type of a fixed span."""
    tokens, segments, forced, at = [], [], {}, 0
    for m in TOKEN.finditer(text, start, end):
        while at < len(fixed) and fixed[at][1] <= m.start():
            forced[len(tokens)] = fixed[at][2]
            at += 1
        if at == len(fixed) or m.end() <= fixed[at][0]:
            tokens.append(m.span())
    for _, _, kind in fixed[at:]:
        forced[len(tokens)] = kind
    shown = [text[a:b] for a, b in tokens]
    digits = list(accumulate((len(x) if "0" <= x[0] <= "9" else 0 for x in shown), initial=0))
    letters = list(accumulate((len(x) if x[0].isascii() and x[0].isalpha() else 0 for x in shown), initial=0))
    ats = list(accumulate((x in ("@", "at") for x in shown), initial=0))
    joined = [k > 0 and k not in forced and a - tokens[k - 1][1] <= 2 and "\n" not in text[tokens[k - 1][1] : a] for k, (a, _) in enumerate(tokens)]
    for i, (a, _) in enumerate(tokens):
        if not (shown[i][0].isalnum() or shown[i] in "+(") or a and text[a - 1].isalnum() and shown[i][0].isalnum():
            continue
        for j in range(i, min(i + LONGEST, len(tokens))):
            b = tokens[j][1]
            if j > i and not joined[j] or b - a > WIDEST or digits[j + 1] - digits[i] > 19 and ats[j + 1] == ats[i] and not letters[j + 1] - letters[i]:
                break
            if b - a >= 7 and shown[j][-1].isalnum() and not text[b : b + 1].isalnum():
                kinds = kinds_of(text[a:b], digits[j + 1] - digits[i], letters[j + 1] - letters[i], ats[j + 1] - ats[i])
                if kinds:
                    seen = span_features(text, a, b)
                    segments.extend((i, j + 1, k, seen) for k in kinds)
    return tokens, segments, forced


class Field:
    """Weights by type and feature, and of one type (column) after another (row; OUTSIDE: none before). Tokens outside weigh nothing."""

    def __init__(self, weights: dict[tuple[int, str], float] | None = None, after: np.ndarray | None = None):
        self.weights = weights if weights is not None else {}
        self.after = after if after is not None else np.zeros((OUTSIDE + 1, OUTSIDE + 1))

    def score(self, kind: int, seen: list[str]) -> float:
        return sum([self.weights.get((kind, x), 0.0) for x in seen])

    def ahead(self, n: int, segments: list, scores: list[float]) -> np.ndarray:
        """By position and type of the last segment before it: the log of the sum over all cuts up to there."""
        table = np.full((n + 1, OUTSIDE + 1), -np.inf)
        table[0, OUTSIDE] = 0.0
        ending = by_place(segments, 1)
        for j in range(1, n + 1):
            table[j] = table[j - 1]
            for s in ending.get(j, ()):
                i, _, kind, _ = segments[s]
                table[j, kind] = np.logaddexp(table[j, kind], np.logaddexp.reduce(table[i] + self.after[:, kind]) + scores[s])
        return table

    def behind(self, n: int, segments: list, scores: list[float]) -> np.ndarray:
        """The same over all cuts from a position on, after a type."""
        table = np.zeros((n + 1, OUTSIDE + 1))
        starting = by_place(segments, 0)
        for i in range(n - 1, -1, -1):
            table[i] = table[i + 1]
            for s in starting.get(i, ()):
                _, j, kind, _ = segments[s]
                table[i] = np.logaddexp(table[i], self.after[:, kind] + scores[s] + table[j, kind])
        return table

    def decode(self, n: int, segments: list, forced: dict[int, int] | None = None) -> list[int]:
        """The segments of the best cut, each of which counts ADDED less than it scores."""
        forced = forced or {}
        scores = [self.score(x[2], x[3]) - ADDED for x in segments]
        if not segments or max(scores) + 2 * np.ptp(self.after) <= 0:
            return []
        table, after = [[-np.inf] * OUTSIDE + [0.0]], self.after.tolist()
        back: dict[tuple[int, int], tuple[int, int, int]] = {}  # by position and type: the position and type before, and the segment
        ending = by_place(segments, 1)
        for j in range(n + 1):
            row = list(table[-1]) if j else table.pop()
            for s in ending.get(j, ()):
                i, _, kind, _ = segments[s]
                value, before = max((table[i][p] + after[p][kind], p) for p in range(OUTSIDE + 1))
                if value + scores[s] > row[kind]:
                    row[kind] = value + scores[s]
                    back[j, kind] = i, before, s
            if j in forced:
                kind = forced[j]
                value, before = max((row[p] + after[p][kind], p) for p in range(OUTSIDE + 1))
                row = [-np.inf] * (OUTSIDE + 1)
                row[kind] = value
                back[j, -1] = j, before, -1
            table.append(row)
        at, kind, found = n, max(range(OUTSIDE + 1), key=lambda p: table[n][p]), []
        while at >= 0:
            if (step := back.pop((at, -1), None)) is not None:
                kind = step[1]
            if (step := back.get((at, kind))) is not None:
                at, kind = step[0], step[1]
                found.append(step[2])
            else:
                at -= 1
        return found[::-1]

    def learn(self, examples: list[tuple[int, list, set[int]]], passes: int = PASSES, rate: float = 0.3) -> None:
        """Gradient steps on the conditional likelihood of the true segments (given by index) of each example."""
        order = random.Random(3)
        for k in range(passes):
            order.shuffle(examples)
            for n, segments, true in examples:
                scores = [self.score(x[2], x[3]) for x in segments]
                ahead, behind = self.ahead(n, segments, scores), self.behind(n, segments, scores)
                total, last, step = np.logaddexp.reduce(ahead[n]), OUTSIDE, rate / (1 + k)
                moves = np.zeros_like(self.after)
                for s in sorted(true, key=lambda s: segments[s][0]):
                    moves[last, segments[s][2]] += 1
                    last = segments[s][2]
                for s, (i, j, kind, seen) in enumerate(segments):
                    chance = np.exp(np.minimum(0.0, ahead[i] + self.after[:, kind] + scores[s] + behind[j, kind] - total))
                    moves[:, kind] -= chance
                    move = step * ((s in true) - float(chance.sum()))
                    if abs(move) > 1e-4:
                        for x in seen:
                            self.weights[kind, x] = self.weights.get((kind, x), 0.0) * (1 - 1e-4) + move
                self.after = self.after * (1 - 1e-4) + step * moves


def by_place(segments: list, end: int) -> dict[int, list[int]]:
    """Numbers of segments by where they start (0) or end (1)."""
    found: dict[int, list[int]] = {}
    for s, x in enumerate(segments):
        found.setdefault(x[end], []).append(s)
    return found


def rewritten(text: str, kind: int, chance: random.Random) -> tuple[str, bool]:
    """A span in another form, and whether that is still personal data."""
    if kind == 0:
        at, dot = chance.choice([(" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", " . "), ("(at)", "."), ("@", "[.]")])
        local, _, domain = text.partition("@")
        return local + at + domain.replace(".", dot), True
    if kind == 1:
        if chance.random() < 0.3:
            return ".".join(str(int(x) % 256 + 256) for x in text.split(".")), False
        return text.replace(".", chance.choice(["[.]", " . ", " dot ", "(.)"])), True
    digits = digits_of(text)
    if kind == 2:
        sign = chance.choice([".", "  ", "/", " - "])
        if chance.random() < 0.4:
            digits = digits[:-1] + str((int(digits[-1]) + chance.randint(1, 9)) % 10)
        return sign.join(digits[i : i + 4] for i in range(0, len(digits), 4)), luhn(digits)
    if chance.random() < 0.3:
        return digits, False  # a number among others
    return text[1:].strip() if chance.random() < 0.7 else text.replace(" ", "/").replace("-", "/"), True


def examples_of(text: str, chance: random.Random) -> Iterator[tuple[int, list, set[int]]]:
    """Training examples of a stretch: as it stands, and rewritten."""
    spans = [(a, b, k) for k, found in enumerate(base_spans(text)) for a, b in found]
    for turn in range(3):
        shown, gold, end = "", [], 0
        for a, b, k in sorted(spans):
            if a < end:
                continue
            shown += text[end:a]
            new, still = (text[a:b], True) if turn == 0 else rewritten(text[a:b], k, chance)
            if still:
                gold.append((len(shown), len(shown) + len(new), k))
            shown, end = shown + new, b
        shown += text[end:]
        tokens, segments, _ = candidates(shown, 0, len(shown), [])
        place = {(tokens[i][0], tokens[j - 1][1], k): s for s, (i, j, k, _) in enumerate(segments)}
        if segments:
            yield len(tokens), segments, {place[g] for g in gold if g in place}
        if not spans:
            return


def train(docs: DataFrame, sample: int = SAMPLE, stretches_: int = STRETCHES) -> Field:
    """A field from the stretches (``stretches_`` at most, by hash, of up to TRAINED characters) of ``sample`` documents at most, by the hash of
    doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = sorted({text[a:b] for text in texts_of(batch.column("text")) for a, b in stretches(text) if b - a <= TRAINED})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["stretch"])

    chosen = settle(docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "sample")
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("text").mapInArrow(run, "stretch string").distinct()
    field, chance = Field(), random.Random(5)
    field.learn([e for r in rows.orderBy(F.xxhash64("stretch"), "stretch").limit(stretches_).collect() for e in examples_of(r.stretch, chance)])
    return field


def found_spans(text: str, field: Field) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int, int]]]:
    """The patterns' spans by kind, and those that the field adds (kind, start, end)."""
    base, fixed, added = base_spans(text), [], []
    for a, b, k in sorted((a, b, k) for k, spans in enumerate(base) for a, b in spans):
        if fixed and a < fixed[-1][1]:  # patterns of two kinds may cross
            fixed[-1] = (fixed[-1][0], max(b, fixed[-1][1]), k)
        else:
            fixed.append((a, b, k))
    starts, ends = [x[0] for x in fixed], [x[1] for x in fixed]
    for start, end in stretches(text):
        own = fixed[bisect_right(ends, start) : bisect_left(starts, end)]
        tokens, segments, forced = candidates(text, start, end, own)
        added.extend((segments[s][2], tokens[segments[s][0]][0], tokens[segments[s][1] - 1][1]) for s in field.decode(len(tokens), segments, forced))
    return base, added


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id and spans (array of kind, start, end, base), by kind and start, one row per document.

    Places are code points, ends exclusive. Null and empty texts have no spans. Repeated rows are each searched; a null doc_id stays
    null; other columns are not read. An empty table trains an empty field, which adds nothing, and gives no rows. The work grows in
    proportion to a text, so very long ones are searched whole.
    """
    field = train(docs) if field is None else field
    weights = docs.sparkSession.sparkContext.broadcast((field.weights, field.after))  # bounded by the training sample
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*weights.value)
        for batch in slices(batches, "text"):
            rows = []
            for text in texts_of(batch.column("text")):
                base, added = found_spans(text, own)
                spans = [(k, a, b, True) for k, found in enumerate(base) for a, b in found] + [(*x, False) for x in added]
                rows.append([dict(zip(("kind", "start", "end", "base"), x, strict=True)) for x in sorted(spans)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(rows, pa.list_(span))], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:int,start:int,end:int,base:boolean>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, KINDS))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    number = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
