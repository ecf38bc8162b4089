"""The training-data operators against brute force, round trips and held-out labels, and on nulls, empties, ties and repeats."""

from __future__ import annotations

import collections
import hashlib
import importlib.util
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meetlake.llm import chat_format, common, exact_dedup, mixing, near_dedup, pii, sentencepiece_bpe, sharding, telephony, token_counts, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Nulls, empties, ties, repeats, white space alone, long texts, clashing column names.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "b"), (2, "THE quick brown fox jumps over the lazy dog again and again", "en", "a"), (3, None, None, None), (4, "", "en", "a"),
    (5, " \t\n ", "de", None), (6, "short", "en", "b"), (7, "Short", "en", "b"), (7, "Short", "en", "b"), (8, "word " * 20_000, "en", "c"), (9, "x" * 50_000, "en", "c"), (None, "no id at all", None, "a"),
    (10, "漢字🙂 mail a@b.co and +1 (487) 555-7209", "zh", "d"), (11, "Straße ÄÖÜ", "de", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, 1, 2, 3, 4, 5, 6) for r in ROWS]
    names = "size long, n long, owner long, target long, spans long, component long"
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {names}").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def generated(seed: int, n: int) -> list[tuple[int, str]]:
    """Texts with exact copies, near copies at all distances and shared passages."""
    chance = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    shared = [chance.choice(words) for _ in range(60)]
    bases = [[chance.choice(words) for _ in range(chance.randint(1, 150))] for _ in range(n // 6)]
    rows = []
    for i in range(n):
        text = list(chance.choice(bases))
        for _ in range(chance.choice([0, 0, 1, 2, 3, 6])):
            text[chance.randrange(len(text))] = chance.choice(words)
        if chance.random() < 0.2:
            text = shared + text[: chance.randint(0, 30)]
        rows.append((i, " ".join(text)))
    return rows


def sets_of(text: str | None, words: int) -> frozenset:
    own = (text or "").translate({c: c + 32 for c in range(65, 91)})
    own = re.findall(r"[^\x20\x09-\x0D]+", own)
    return frozenset(tuple(own[k : k + words]) for k in range(max(1, len(own) - words + 1))) if own else frozenset()


def components_of(rows, words: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {i: sets_of(t, words) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


# 1: personal data


def test_pii_patterns_against_plain_regular_expressions():
    plain = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def fine(kind, text):
        digits = re.sub("[^0-9]", "", text)
        return kind == 0 or kind == 1 and all(int(x) <= 255 for x in text.split(".")) or kind == 2 and 16 <= len(digits) <= 19 and pii.luhn(digits) or kind == 3 and 8 <= len(digits) <= 15

    chance = random.Random(2)
    for _ in range(5000):
        text = "".join(chance.choice("ab1234567890.@+-() x%_") for _ in range(chance.randint(0, 40)))
        assert pii.base_spans(text) == [[m.span() for m in re.finditer(p, text) if fine(k, m[0])] for k, p in enumerate(plain)]


@pytest.mark.parametrize("seed", range(4))
def test_pii_field_decodes_like_brute_force(seed):
    text = "ann at mail dot org, 10.1.2.3 or 4111.1111.1111.1111 and 555 123 4567 x"
    fixed = [(text.index("10."), text.index(" or 4"), 1)] if seed % 2 else []
    tokens, segments, forced = pii.candidates(text, 0, len(text), fixed)
    assert list(forced.values()) == [1] * len(fixed)
    chance = random.Random(seed)
    field = pii.Field({(k, x): chance.uniform(-0.5, 1) for _, _, k, seen in segments for x in seen}, np.random.default_rng(seed).normal(0, 1.5, (5, 5)))
    scores, best = [field.score(k, seen) - pii.ADDED for _, _, k, seen in segments], (-1e9, [])

    def walk(at, last, total, taken):
        nonlocal best
        if at in forced:
            total, last = total + field.after[last, forced[at]], forced[at]
        if at == len(tokens):
            best = max(best, (total, taken))
            return
        walk(at + 1, last, total, taken)
        for s, (i, j, k, _) in enumerate(segments):
            if i == at:
                walk(j, k, total + field.after[last, k] + scores[s], [*taken, s])

    walk(0, pii.OUTSIDE, 0.0, [])
    assert segments and best[1]
    assert field.decode(len(tokens), segments, forced) == best[1]
    total = np.logaddexp.reduce(field.ahead(len(tokens), segments, scores)[-1])
    assert total == pytest.approx(field.behind(len(tokens), segments, scores)[0, pii.OUTSIDE])


def test_pii_learns_from_the_type_before():
    """The same number is a card after an address and nothing after a card; only what stands before it tells."""
    one, two = (0, 2, 0, ["address"]), (0, 2, 2, ["first"])
    number = (3, 6, 2, ["number"])
    field = pii.Field()
    field.learn([(6, [one, number], {0, 1}), (6, [two, number], {0})] * 40)
    assert field.after[0, 2] > 1 > field.after[2, 2]
    assert 1 in field.decode(6, [one, number]) and 1 not in field.decode(6, [two, number])
    assert 0 in field.decode(4, [(0, 3, 2, ["number"])], {0: 0}) and not field.decode(4, [(0, 3, 2, ["number"])], {0: 2})


def test_pii_in_a_very_long_text():
    field = pii.Field({(3, "bias"): 3.0})
    texts = [" ".join(f"user{i}@mail{i}.org" for i in range(50_000)), "12 345 " * 20_000, "7" * 1_000_000, "a@" * 300_000, " at x" * 200_000]
    start = time.monotonic()
    base = [pii.found_spans(x, field)[0] for x in texts]
    assert [len(x[0]) for x in base] == [50_000, 0, 0, 0, 0]
    assert time.monotonic() - start < 240


def test_pii_finds_more_than_patterns_and_keeps_theirs(spark, docs, empty):
    rows = [(i, f"reach user{i}.x@mail{i}.example.org or +1 487 555 7{i:03d} or 10.0.{i % 200}.7 ok") for i in range(60)]
    field = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    base, added = pii.found_spans("now bob at mail dot example dot org, and 10[.]1[.]2[.]3 too", field)
    assert not any(base)
    assert {k for k, _, _ in added} == {0, 1}
    found = {r.doc_id: r.spans for r in pii.personal_data(docs, field).collect()}
    assert len(found) == len(ROWS) - 1
    assert not found[3] and not found[4]
    assert [(s.kind, s.base) for s in found[10]] == [(0, True), (3, True)]
    assert pii.personal_data(empty).count() == 0


# 2: mixing


def test_mixing_meets_targets_and_limits(spark, docs, empty):
    sizes = [(1, "a", 1000), (2, "b", 9000), (3, None, 500), (4, "c", 0), (5, "a", 4000), (6, "b", 7000)]
    rows = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, s, n in sizes], "doc_id long, text string, source string")
    found = mixing.taken(rows).collect()
    assert {r.source for r in found} == {"a", "b", "c", None}
    by = collections.defaultdict(list)
    for r in found:
        assert r.size == dict((i, n) for i, _, n in sizes)[r.doc_id]
        assert 0 <= r.taken <= 2 * r.size
        by[r.source].append(r)
    for own in by.values():
        assert sum(r.taken for r in own) == round(own[0].target)
        assert own[0].target <= 2 * own[0].source_size
    assert sum(own[0].target for own in by.values()) == pytest.approx(1.5 * 21_500)
    # by hand: weights a 3, b 1, c 2, null 3; a and null stop at twice their size, c has nothing, b takes the rest
    assert {s: own[0].target for s, own in by.items()} == {"a": 10_000, "b": 21_250, "c": 0, None: 1000}
    assert mixing.taken(docs).count() == len(ROWS)
    assert mixing.taken(empty).count() == 0
    left = mixing.mixed(docs)
    assert left.columns == docs.columns
    assert {3, 4, 5} <= {r.doc_id for r in left.collect()}
    twice = [(1, "a b c d " * 50, "s"), (1, "x", "s"), (1, "x", "s"), *((k, "w " * 40, "t") for k in range(2, 9))]
    again = collections.Counter((r.doc_id, r.text) for r in mixing.mixed(spark.createDataFrame(twice, "doc_id long, text string, source string")).collect())
    assert again[1, "x"] in (0, 2, 4) and again[1, "a b c d " * 50] <= 2


def test_taken_words_against_a_plain_walk(spark):
    """Each source's words stand in a hashed order and are walked until its target is met."""
    chance = random.Random(4)
    rows = [(i, " ".join(["w"] * chance.choice([0, 1, 7, 300, 3000])), chance.choice(["a", "b", "b", "b", None])) for i in range(200)]
    found = mixing.taken(spark.createDataFrame(rows, "doc_id long, text string, source string")).withColumn("at", F.xxhash64("doc_id", F.lit("mix"), "print")).collect()
    for source in ("a", "b", None):
        own = sorted((r for r in found if r.source == source), key=lambda r: r.at)
        left, want = round(own[0].target), dict.fromkeys((r.doc_id for r in own), 0)
        while left:
            for r in own:
                want[r.doc_id] += min(left, r.size)
                left -= min(left, r.size)
        assert {r.doc_id: r.taken for r in own} == want


def test_schedule_is_even_in_every_stretch(spark):
    sources = common.settle(spark.createDataFrame([(0, 30 * 1024), (1, 10 * 1024), (2, 60 * 1024)], "s int, want long"), "sources")
    slots = sorted((r.slot, r.s, r.k) for r in mixing.schedule(sources).collect())
    assert len({x for x, _, _ in slots}) == 100 and max(x for x, _, _ in slots) < 103
    for s, share in ((0, 0.3), (1, 0.1), (2, 0.6)):
        own = [(slot, k) for slot, t, k in slots if t == s]
        assert [k for _, k in own] == list(range(len(own)))
        for stop in range(1, 101):
            assert abs(sum(slot < stop for slot, _ in own) - share * stop) < 3


def walked(found, block: int, golden: float) -> dict:
    """What the slots take of each document: words, first, last and summed slots, one slot after the other; found: rows of taken()."""
    sources = sorted({(r.s, r.want) for r in found})
    blocks = {s: -(-want // block) for s, want in sources}
    own = {s: [r for r in sorted(found, key=lambda r: r.at) if r.s == s] for s, _ in sources}
    total, out = sum(blocks.values()), collections.defaultdict(lambda: [0, None, None, 0])
    endless = lambda rows: ((r.doc_id, r.print) for _ in range(3) for r in rows for _ in range(r.size))
    words, left = {s: endless(rows) for s, rows in own.items()}, dict(sources)

    def take(s: int, slot: int) -> None:
        for _ in range(min(block, left[s])):
            w = out[next(words[s])]
            w[:] = [w[0] + 1, slot if w[1] is None else w[1], slot, w[3] + slot]
        left[s] -= min(block, left[s])

    for slot in range(total):
        x, low = (slot + 1) * golden % 1.0, 0
        for s, _ in sources:
            if low / total <= x < (low + blocks[s]) / total:
                take(s, slot)
            low += blocks[s]
    slot = total
    for s, _ in sources:
        while left[s]:
            take(s, slot)
            slot += 1
    return out


@pytest.mark.parametrize("golden", [mixing.GOLDEN, 2**0.5 - 1])
def test_slots_against_a_plain_walk(spark, golden, monkeypatch):
    """The schedule decides the rows: another sequence of points gives others, and each agrees with its walk."""
    monkeypatch.setattr(mixing, "GOLDEN", golden)
    chance = random.Random(4)
    rows = [(i, " ".join(["w"] * chance.choice([0, 1, 7, 300, 3000])), chance.choice(["a", "b", "b", "b", None])) for i in range(100)]
    found = mixing.taken(spark.createDataFrame(rows, "doc_id long, text string, source string")).withColumn("at", F.xxhash64("doc_id", F.lit("mix"), "print")).collect()
    want = walked(found, mixing.BLOCK, golden)
    for r in found:
        assert [r.taken, r.first_slot, r.last_slot, r.slot_sum] == (want[r.doc_id, r.print] if r.taken else [0, None, None, None])


def test_mix_stands_in_the_order_of_its_slots(spark):
    rows = spark.createDataFrame([(i, "w " * (i * 37 % 900), "abc"[i % 3]) for i in range(200)], "doc_id long, text string, source string")
    slots = {r.doc_id: [x.slot for x in r.passes or []] for r in mixing.taken(rows).collect()}
    seen, last = collections.Counter(), -1
    for r in mixing.mixed(rows).collect():
        at = slots[r.doc_id][seen[r.doc_id]] if slots[r.doc_id] else 10**9
        seen[r.doc_id] += 1
        assert at >= last
        last = at


# 3: telephony


def test_laws_and_adpcm():
    tables = telephony.tables()
    assert tables["mulaw"][[0x00, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert tables["alaw"][[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    rng = np.random.default_rng(4)
    blocks = rng.integers(0, 256, (7, telephony.UNIT + telephony.HEAD), dtype=np.uint8)
    blocks[:, 2] %= 89
    got = telephony.decode_adpcm(blocks)
    for row, out in zip(blocks.tolist(), got.tolist(), strict=True):
        value = int.from_bytes(bytes(row[:2]), "little", signed=True)
        index, want = row[2], [value]
        for byte in row[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(telephony.STEPS[index])
                move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - move if code & 8 else value + move))
                index = max(0, min(88, index + int(telephony.INDEX_MOVES[code])))
                want.append(value)
        assert out == want


def test_telephony_round_trip(docs, empty):
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    seen = {}
    for r in telephony.telephony(docs).collect():
        payload = texts[r.doc_id] + b"\0" * (-len(texts[r.doc_id]) % 64 if texts[r.doc_id] else 64)
        assert bytes(r.payload) == payload
        assert r.n_bytes == len(texts[r.doc_id])
        assert len(r.pcm) == 4 * int(re.search(r"n=(\d+)", r.feature)[1])
        assert seen.setdefault(payload, (bytes(r.media), r.feature)) == (bytes(r.media), r.feature)
    assert telephony.telephony(empty).count() == 0
    tone = np.rint(8000 * np.sin(np.arange(800) / 9)).astype(np.int16)
    twice = telephony.doubled(tone)
    assert (twice[::2] == tone).all()
    assert np.abs(twice[1::2][5:-5] - 8000 * np.sin((np.arange(800) + 0.5) / 9)[5:-5]).max() < 80


# 4: exact dedup


@pytest.mark.parametrize(("budget", "fan"), [(exact_dedup.TRIE_BYTES, exact_dedup.FAN), (2000, 2)])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup_against_brute_force(spark, docs, empty, budget, fan, keep, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FAN", fan)
    lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    for rows in (docs, spark.createDataFrame(generated(3, 300), "doc_id long, text string").repartition(5)):
        groups = collections.defaultdict(list)
        table = rows.select("doc_id", "text").collect()
        for r in table:
            groups[lower(r.text)].append(r.doc_id)
        found = exact_dedup.exact_duplicates(rows, keep, budget).collect()
        want = collections.Counter()
        for r in table:
            own = groups[lower(r.text)]
            ids = [i for i in own if i is not None]
            best = (max if keep == "largest" else min)(ids) if ids else None
            want[r.doc_id, best, len(own), r.doc_id == best, hashlib.sha256(lower(r.text).encode()).hexdigest()] += 1
        assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found) == want
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_trie_splits_edges_and_spills():
    trie, chance = exact_dedup.Trie(), random.Random(1)
    texts = [bytes(chance.choice(b"ab") for _ in range(chance.randint(0, 12))) for _ in range(2000)]
    for k, t in enumerate(texts):
        node = trie.end(t)
        node.owners, node.best, node.n = node.owners or [k], exact_dedup.better(node.best, k, False), node.n + 1
    held = trie.bytes
    some = [(t, x.best, x.n) for t, x in trie.spill(held * 2 // 3)]
    assert some and trie.bytes <= held * 2 // 3 and len({t[:1] for t, _, _ in some}) == 1
    rest = [(t, x.best, x.n) for t, x in trie.spill(0)]
    assert trie.bytes == 0
    assert sorted(some + rest) == sorted((t, texts.index(t), n) for t, n in collections.Counter(texts).items())


def test_exact_clean_keeps_one_row_of_each_text(docs):
    left = exact_dedup.clean(docs)
    assert left.columns == docs.columns
    texts = [(r.text or "").lower() for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").lower() for _, t, _, _ in ROWS})


# 5: toxicity


def test_folding():
    assert toxicity.fold("Yоu are an 1d10t, a M0R0N and $tup!d! Ünïté ＩＤＩＯＴ mo​ron") .split()[3:] == ["idiot", "ldlot", "a", "moron", "and", "stupid", "stupld", "unite", "ünïté", "idiot", "moron"]
    assert toxicity.fold("455 in 1999") == " 455 in 1999 "
    matcher = toxicity.Matcher({" trash": 2.0, " trash ": 5.0, " idiot ": 3.0})
    assert [w for _, _, w in matcher.find(toxicity.fold("a trash can, trash, trashy idiot"))] == [5.0, 2.0, 3.0]


def test_toxicity_scores_against_a_plain_matcher():
    """Every term at every place, the heaviest at a place counts, none inside an exception."""
    chance, weights = random.Random(3), {" ab": 1.0, " ab ": 5.0, " abc": 6.0, " b": 0.5, " trash ": 4.0, " can ": 2.0}
    matcher, curve = toxicity.Matcher(weights), [-3.0, 1.0, 0.5, 0.25]
    texts = ["", "   ", "trash can trash"] + [" ".join(chance.choice(["ab", "abc", "b", "x", "ba", "trash", "can", "Éb"]) for _ in range(chance.randint(1, 30))) for _ in range(300)]
    words, found = toxicity.weighed(matcher, texts)
    scores, _, _ = toxicity.curved(words, found, curve)
    for text, n, score in zip(texts, words, scores, strict=True):
        own = toxicity.fold(text).split()
        shown, total, strong = f" {' '.join(own)} ", 0.0, 0.0
        shut = {i for phrase in toxicity.EXCEPTIONS for i in range(len(shown)) if shown.startswith(f" {phrase} ", i)}
        shut = {k for i in shut for phrase in toxicity.EXCEPTIONS if shown.startswith(f" {phrase} ", i) for k in range(i, i + len(phrase) + 1)}
        for i in range(len(shown)):
            fit = [w for t, w in weights.items() if shown.startswith(t, i)]
            if fit and i not in shut:
                total, strong = total + max(fit), strong + max(fit) * (max(fit) >= toxicity.STRONG)
        assert n == len(own)
        x = curve[0] + math.log1p(strong) * curve[1] + math.log1p(total) * curve[2] + math.log1p(1000 * total / (len(own) + 10)) * curve[3]
        assert score == pytest.approx(1 / (1 + math.exp(-x)))


def test_toxicity_on_held_out_labels(spark, docs, empty):
    chance = random.Random(7)
    bad = ["grumbolt", "zorkish", "fleemed"]
    rows, marks = [], []
    for i in range(900):
        words = [f"w{chance.randrange(300)}" for _ in range(chance.randint(5, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(1 + len(words) // 40):
                words[chance.randrange(len(words))] = chance.choice(bad) + chance.choice(["", "s", "en"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    texts, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity(texts, labels, ~toxicity.held_out()).collect()}
    held = [i for i, _ in marks if zlib.crc32(str(i).encode()) % 3 == 1]
    hits = sum(found[i].predicted == t for i, t in marks if i in set(held))
    assert hits >= 0.95 * len(held)
    odd = toxicity.toxicity(docs, labels.where("false"))
    assert odd.count() == len(ROWS)
    assert all(0 <= r.score <= 1 and not r.predicted for r in odd.collect())
    assert toxicity.toxicity(empty, labels.where("false")).count() == 0
    left = toxicity.kept(docs.unionByName(docs.where("doc_id is null").withColumn("text", F.lit("you IDIOT, ｍｏｒｏｎ and sсum"))), {" idiot ": 4.0, " moron ": 4.0, " scum ": 4.0}, [-3.0, 1.0, 0.5, 0.5])
    assert left.columns == docs.columns and left.count() == len(ROWS)


# 6: SentencePiece


def test_encoding_equals_the_library(docs, empty, monkeypatch):
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentencepiece_bpe.Encoder(open(MODEL, "rb").read())
    chance = random.Random(5)
    texts = ["", " ", "   ", "a" * 3000, "=" * 70 + " " * 33 + "the", "<s> </s> <0x0A>", "é▁x", "\x00a"]
    texts += ["".join(chance.choice("ab eéß▁\n\t  漢字🙂12,-=_#*/\x00ﬁ") for _ in range(chance.randint(1, 120))) for _ in range(500)]
    texts += ["".join(chance.choice("etaoinshr dlu") for _ in range(chance.randint(1, 200))) for _ in range(500)]
    monkeypatch.setattr(sentencepiece_bpe, "REMEMBERED", 500)
    for stride in (sentencepiece_bpe.STRIDE, 40):
        monkeypatch.setattr(sentencepiece_bpe, "STRIDE", stride)
        for text in texts:
            ids, decoded = own.encode(text)
            assert ids == library.encode(text)
            assert decoded == library.decode(ids) == own.decode(ids)
        ids, ends, decoded = own.encode_all(texts)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == library.encode(texts) and decoded == library.decode(library.encode(texts))
    for r in sentencepiece_bpe.encode_texts(docs, MODEL).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert list(r.ids) == library.encode(r.text or "") and r.decoded == library.decode(list(r.ids))
    assert sentencepiece_bpe.encode_texts(empty, MODEL).count() == 0


# 7: sharding


def test_sharding_law_and_slots(docs, empty, spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    for rows, n in ((docs, len(ROWS)), (many, 3000)):
        found = sharding.sharded(rows, sharding.default_tree(24), sharding.grown(sharding.default_tree(24), 24)).collect()
        assert len(found) == n
        slots = collections.defaultdict(list)
        for r in found:
            slots[r.shard].append(r.slot)
            assert r.grown_shard in (r.shard, 24)
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = [len(slots[k]) for k in range(24)]
    assert min(sizes) > 80 and max(sizes) < 175
    assert 60 < sum(r.grown_shard == 24 for r in found) < 190
    for n in (1, 7, 24, 25, 30):
        tree = sharding.default_tree(n)
        moved = sharding.sharded(many, tree, sharding.grown(tree, n)).collect()
        assert all(r.grown_shard in (r.shard, n) for r in moved) and 0.6 < sum(r.grown_shard == n for r in moved) * (n + 1) / 3000 < 1.4
        twice = sharding.sharded(many, sharding.grown(tree, n), sharding.grown(sharding.grown(tree, n), n + 1)).collect()
        assert all(r.grown_shard in (r.shard, n + 1) for r in twice)
    # the tree decides: the same shards under other nodes
    flat = {0: {0: {s: 1.0 for s in range(24)}}}
    assert sum(x.shard != y.shard for x, y in zip(*(sorted(sharding.sharded(many, t).collect(), key=lambda r: r.doc_id) for t in (flat, sharding.default_tree(24))), strict=True)) > 2000
    tree = {0: {0: {0: 1.0, 1: 0.5}, 1: {2: 2.0}}, 1: {2: {3: 1.0, 4: 0.0}}, 2: {3: {5: 0.0}}, "+7": 0.5}
    names = [x["name"] for x in sharding.nodes_of(tree)]
    for r in sharding.sharded(many, tree).select("*", *(F.xxhash64("doc_id", F.lit("shard"), F.lit(x)).alias(f"h{x}") for x in names)).collect():
        name, node, way = "", tree, []
        while isinstance(node, dict):  # draws among the children of the node that is reached
            weights = {k: sharding.weight_of(x) for k, x in node.items()}
            way.append(min((k for k in node if weights[k]), key=lambda k: -math.log((r[f"h{name}/{k}"] + 2.0**63 + 1) / (2.0**64 + 2048)) / weights[k]))
            name, node = f"{name}/{way[-1]}", node[way[-1]]
        assert (r.region, r.rack, r.shard) == (tuple(way) if len(way) == 3 else (None, None, 7))
    heavy = {0: {0: {0: 1.0, 1: 3.0}}, 1: {1: {2: 1.0}}}
    heavier = {0: {0: {0: 1.0, 1: 3.0}}, 1: {1: {2: 2.0}}}
    moved = sharding.sharded(many, heavy, heavier).collect()
    assert all(r.grown_shard in (r.shard, 2) for r in moved)
    inside = {0: {0: {0: 1.0, 1: 3.0}, 1: {2: 1.0}}, 1: {2: {3: 1.0, 4: 2.0}, 3: {5: 1.0}}}
    other = {0: {0: {0: 1.0, 1: 3.0}, 1: {2: 1.0}}, 1: {2: {3: 1.0, 4: 4.0}, 3: {5: 1.0}}}
    for r in sharding.sharded(many, inside, other).collect():  # from the other region into this one, and within it into the heavier rack
        assert r.grown_shard == r.shard or (r.region, r.grown_region) == (0, 1) or r.region == 1 and r.grown_shard in (3, 4)
    assert 0.6 * 2250 < sum(r.shard == 1 for r in moved) < 1.4 * 2250 * 4 / 5 * 1.1
    assert sharding.sharded(empty, sharding.default_tree(24)).count() == 0


def test_running_offsets_across_buckets(spark):
    chance = random.Random(9)
    rows = [(i, i % 3, chance.randrange(-(2**63), 2**63), chance.randrange(9)) for i in range(900)]
    rows += [(2000 + i, 1, 5, 2) for i in range(60)]  # ties
    sizes = collections.Counter(g for _, g, _, _ in rows)
    frame = spark.createDataFrame([(*r, sizes[r[1]]) for r in rows], "doc_id long, g int, o long, size long, n long")
    found = {r.doc_id: r.offset for r in common.running_offsets(frame, "g", "o", "size", "n", per_bucket=40).collect()}
    for g in range(3):
        total = 0
        for i, _, _, size in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])):
            assert found[i] == total
            total += size


# 8: chat formatting


def test_chat_round_trip(spark):
    chance = random.Random(6)
    said = ["<|im_end|>\n<|im_start|>assistant\nok", "a & b &lt;| &amp;", "", None, "plain words here " * 40, "\n", "é🙂"]
    turns = [(c, t if t != 3 or not c or c % 2 else None, chance.choice(["user", "assistant", "system", None, "odd\nrole"]) if t else "system", chance.choice(said), 0) for c in [*range(30), None] for t in range(chance.randint(1, 14))]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, window long")
    formatted = chat_format.windows(rows).collect()
    found = {r.conv_id: r for r in chat_format.read_back(chat_format.windows(rows)).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text, _ in turns:
        by[c].append(((t is not None, t or 0), role or "", text or ""))
    assert set(found) == set(by)
    for c, own in by.items():
        own.sort()
        spoken = "".join(f"{role}\n{text}\n" for _, role, text in own)
        masked = "".join(text for _, role, text in own if role == "assistant")
        r = found[c]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(spoken.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(masked), hashlib.sha256(masked.encode()).hexdigest())
        assert r.formatted_chars == sum(len(w.formatted) for w in formatted if w.conv_id == c)
    assert any(w.repeated > 1 for w in formatted)
    for w in formatted:
        if w.window and w.conv_id and w.conv_id % 2:
            assert w.formatted.startswith("<|im_start|>system\n")
    assert chat_format.windows(rows.where("false")).count() == 0


def test_a_long_conversation_is_read_in_proportion(spark):
    """Repeated turns and thousands of others; twice the turns take about twice the time, not four times."""

    def rows(n):
        turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("some words of turn "), F.col("id")).alias("text"))
        return turns.union(turns.where("turn < 2"))

    took = []
    for n in (10_000, 10_000, 40_000):
        start = time.perf_counter()
        found = chat_format.read_back(chat_format.windows(rows(n))).collect()
        took.append(time.perf_counter() - start)
        masked = "".join(f"some words of turn {t}" for t in sorted([*range(n), 0, 1]) if t % 2)
        assert [(r.n_turns, r.loss_chars, r.loss_sha256) for r in found] == [(n + 2, len(masked), hashlib.sha256(masked.encode()).hexdigest())]
    assert took[2] < 8 * took[1] + 5


# 9: near dedup


@pytest.mark.parametrize(("block", "size"), [(near_dedup.BLOCK, near_dedup.ROWS), (3000, 400), (near_dedup.BLOCK, 7)])
def test_near_dedup_against_brute_force(spark, docs, empty, block, size, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "ROWS", size)
    rows = generated(11, 400)
    for words, percent in ((4, 80), (5, 80)):
        want = components_of(rows, words, percent)
        found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words, percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    odd = {r.doc_id: r for r in near_dedup.near_duplicates(docs, 4).collect()}
    assert odd[2].component_id == 1 and not odd[2].kept
    assert [odd[k].n_shingles for k in (3, 4, 5, 6, 8, 9)] == [0, 0, 0, 1, 1, 1]
    assert [odd[k].component_id for k in (3, 4, 5, 6, 7)] == [3, 4, 5, 6, 6]
    assert odd[None].component_id is None and not odd[None].kept
    assert near_dedup.near_duplicates(docs, 4).count() == len(ROWS)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_ties_in_a_crowded_bucket():
    """Two rows among 3,000 of a bucket agree on 45 minima, but not on those that the order sorts by first."""
    draw, order = np.random.default_rng(3), near_dedup.constants()["orders"][0]
    lower = draw.integers(0, 256, (3000, near_dedup.MINIMA), np.uint8)
    lower[:, order[:8]] = 7
    lower[2999, order[8:45]] = lower[0, order[8:45]]
    lower[[0, 2999], order[8]] = 0, 255
    lower[2999, order[45]] = lower[0, order[45]]
    fields = {"tree": np.zeros(3000, np.int16), "bucket": [b"same"] * 3000, "key": [b"\7" * 16] * 3000, "pair": ["0"] * 3000, "doc_id": np.arange(3000), "n": np.full(3000, 100), "lower": [x.tobytes() for x in lower]}
    batch = pa.RecordBatch.from_pydict(fields)
    found = near_dedup.tied(80)(iter([batch.slice(0, 1700), batch.slice(1700)]))
    assert [x for part in found for x in part.to_pylist()] in ([{"a": 0, "b": 2999}], [{"a": 2999, "b": 0}])


def test_near_dedup_finds_a_pair_in_blocks_of_a_crowd(spark, monkeypatch):
    """Half of every document is one passage, and two documents at either end of the ids are little more than that passage."""
    monkeypatch.setattr(near_dedup, "CROWD", 500)
    passage, n = " ".join(f"p{w}" for w in range(100)), 8000
    rows = [(k, f"{passage} " + " ".join(f"{k}w{w}" for w in range(5 if k in (0, n) else 100))) for k in range(n + 1)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 1, 90).where("not kept").collect()
    assert [(r.doc_id, r.component_id) for r in found] == [(n, 0)]


@pytest.mark.parametrize("tasks", [1, 200])
def test_near_dedup_with_any_number_of_partitions(spark, tasks):
    rows = [(k, " ".join(f"{k // 2}w{w}" for w in range(60)) + (" end" if k % 2 else "")) for k in range(12)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.doc_id: r.component_id for r in found} == {k: k // 2 * 2 for k in range(12)}


def linked_groups(sets: list[set], percent: int = 80) -> tuple[list[int], list[int]]:
    """The smallest member of each set's group, as linked_sets has it and by comparing all pairs."""
    found, plain = near_dedup.Forest(), near_dedup.Forest()
    for a, b in near_dedup.linked_sets(np.arange(len(sets)), [np.array(sorted(x), np.uint64) for x in sets], percent, near_dedup.Forest()):
        found.join(a, b)
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                plain.join(a, b)
    return [found.root(x) for x in range(len(sets))], [plain.root(x) for x in range(len(sets))]


def test_links_that_bridge_two_groups():
    swap = lambda x, *spans: {v + 1000 if any(v in s for s in spans) else v for v in x}
    own = lambda x, at, n: {v + 10_000 * (n + 1) if v in at else v for v in x}
    d1, d2, d3 = range(6), range(6, 12), range(12, 18)
    c1 = set(range(100))
    c2 = swap(c1, d1, d2, d3)
    j, k = own(swap(c1, d1), (20, 21), 0), own(swap(c1, d1, d2), (22, 23), 1)
    sets = [c1, c2, j, k, *(own(c, (30 + n,), n) for n, c in enumerate([c1, c1, c1, c2, c2, c2], 2))]
    found, plain = linked_groups(sets)
    assert found == plain == [0] * 10


@pytest.mark.parametrize("seed", range(6))
def test_links_of_revision_chains(seed):
    draw, fresh = random.Random(seed), iter(range(1000, 10**9))
    sets = []
    for _ in range(4):  # chains, whose revisions differ by some shingles each and have copies
        now = set(range(100))
        for _ in range(40):
            for v in draw.sample(sorted(now), draw.randint(2, 11)):
                now = (now - {v}) | {next(fresh)}
            for _ in range(draw.choice([1, 1, 1, 4])):
                sets.append((now - {draw.choice(sorted(now))}) | {next(fresh)})
    draw.shuffle(sets)
    found, plain = linked_groups(sets)
    assert found == plain


def test_recall_of_pairs_at_the_threshold(spark):
    """20,000 documents, 300 pairs of which are just similar enough; a third of the documents begins with one passage."""
    chance, fresh, rows = random.Random(8), iter(range(10**9)), []
    passage = [f"p{k}" for k in range(40)]
    for i in range(19_700):
        rows.append((i, (passage if i % 3 == 0 else []) + [f"w{next(fresh)}" for _ in range(54)]))
    for i in range(300):  # a changed word costs five of each one's shingles: 90 - 10 of 90 + 10
        other = list(rows[i][1]) if len(rows[i][1]) == 94 else list(rows[i][1]) + [f"w{next(fresh)}" for _ in range(40)]
        rows[i] = (i, list(other))
        for place in (45, 60):
            other[place] = f"w{next(fresh)}"
        rows.append((19_700 + i, other))
    chance.shuffle(rows)
    found = near_dedup.near_duplicates(spark.createDataFrame([(i, " ".join(x)) for i, x in rows], "doc_id long, text string")).where("not kept").collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(19_700 + i, i) for i in range(300)}


def test_components_of_long_chains(spark):
    ids = list(range(300))
    random.Random(2).shuffle(ids)
    chain = list(zip(ids[:200], ids[1:200], strict=False)) + list(zip(ids[200:], ids[201:], strict=False))
    found = {r.id: r.component for r in near_dedup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: min(ids[:200]) for i in ids[:200]} | {i: min(ids[200:]) for i in ids[200:]}


# 10: token counts


def test_token_counts_and_their_cache(docs, empty, spark, tmp_path):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        found = token_counts.token_counts(docs, MODEL, cache).collect()
        assert len(found) == len(ROWS)
        assert all((r.n_tokens, r.n_bytes) == (len(library.encode(texts[r.doc_id])), len(texts[r.doc_id].encode())) for r in found)
    stored = spark.read.parquet(cache)
    assert stored.count() == len(set(texts.values()))
    spark.createDataFrame([(hashlib.sha256(b"short").digest(), "another version", 99)], token_counts.CACHE).write.mode("append").partitionBy("version").parquet(cache)
    marked = spark.createDataFrame([(1, "short \u2581x"), (1, "short  x"), (2, "short")], "doc_id long, text string")
    assert [r.n_tokens for r in token_counts.token_counts(marked, MODEL, cache).orderBy("doc_id").collect()] == [len(library.encode(x)) for x in ("short \u2581x", "short  x", "short")]
    stored = spark.read.parquet(cache)
    assert stored.count() == len(set(texts.values())) + 2  # the other version's row, and one for both spellings
    more = docs.select("doc_id", F.concat("text", F.lit(" more")).alias("text")).where("doc_id = 1")
    token_counts.token_counts(more, MODEL, cache)
    assert spark.read.parquet(cache).count() == stored.count() + 1
    path = public_tokenizers.path("byte_bpe_50k.json")
    import tokenizers

    lib = tokenizers.Tokenizer.from_file(path)
    assert all(r.n_tokens == len(lib.encode(texts[r.doc_id], add_special_tokens=False).ids) for r in token_counts.token_counts(docs, path, cache).collect())
    assert token_counts.token_counts(empty, MODEL, cache).count() == 0


# the pipeline


def plain_targets(sizes: dict) -> dict:
    """By source: the share by weight of one and a half times all sizes, what exceeds twice a size being shared out again."""
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [3, 1, 2] * len(sizes), strict=False))
    left, found = 1.5 * sum(sizes.values()), {}
    while len(found) < len(sizes):
        level = left / sum(w for s, w in weights.items() if s not in found)
        full = [s for s in sizes if s not in found and level * weights[s] > 2 * sizes[s]]
        found |= {s: 2 * sizes[s] for s in full} if full else {s: level * weights[s] for s in sizes if s not in found}
        left = 1.5 * sum(sizes.values()) - sum(found.values())
    return found


def plain_mix(spark, rows: list[tuple]) -> collections.Counter:
    """How often each (doc_id, text) of rows (doc_id, text, source) is in the mix of whole documents."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    at = {r.i: r.h for r in spark.createDataFrame([(i,) for i, *_ in rows], "i long").select("i", F.xxhash64("i", F.lit("mix")).alias("h")).distinct().collect()}
    sizes, found = collections.Counter(), collections.Counter()
    for _, t, source in rows:
        sizes[source] += size(t)
    for source, target in plain_targets(sizes).items():
        own = sorted(((at[i], size(t), i, t) for i, t, s in rows if s == source), key=lambda x: x[:2])
        left, taken = int(target + 0.5), [0] * len(own)
        while left and any(x[1] for x in own):
            for k, x in enumerate(own):
                taken[k] += min(left, x[1])
                left -= min(left, x[1])
        for k, (_, n, i, t) in enumerate(own):
            found[i, t] += 1 if not n else int(taken[k] / n + 0.5)
    return +found


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline_against_brute_force(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline

    rows = [(i, f"{t} only {i % 5}", "en", f"s{i % 3}", len(t)) for i, t in generated(21, 160)]
    rows += [(1000 + k, f"you stupid idiot moron number {k} " + " ".join(f"z{k}x{j}" for j in range(12)), "en", "s0", 0) for k in range(8)]
    rows += [(500 + (r[0] or 200), *r[1:], 0) for r in ROWS] + [(None, "no id, another text", None, None, 0)]
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size long, owner long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 1000)) for i, *_ in rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert all(stage(spark, docs.where("false"), folder).columns == docs.columns for _, stage in corpus_pipeline.STAGES[:-1])
    clean = sorted({(i if i is not None else 10**9, t) for i, t, *_ in rows if i is None or i < 1000}, key=lambda x: (x[0], x[1] or ""))
    source, first = {(i if i is not None else 10**9, t): s for i, t, _, s, _ in rows}, {}
    for i, t in clean:
        first.setdefault((t or "").lower(), (i, t))
    near = components_of(list(first.values()), 5, 80)
    kept = [(None if i == 10**9 else i, t, source[i, t]) for i, t in first.values() if near[i][1] == i]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = collections.Counter()
    for (i, t), n in plain_mix(spark, kept).items():
        ids = library.encode(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += n
    assert collections.Counter(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "encoding"]


def test_queries_on_odd_rows(spark, docs, tmp_path):
    """Each query over tables with nulls, empties, long texts, repeats and clashing columns, against plain versions."""
    import sentencepiece

    from meetlake.llm import queries

    folder, sha = f"file://{tmp_path}", lambda x: hashlib.sha256(x).hexdigest()
    more = docs.unionByName(docs.where("doc_id = 6").withColumn("text", F.lit("another text under a repeated id")))
    more.write.parquet(f"{folder}/documents.parquet")
    more.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{folder}/labels.parquet")
    more.limit(2).selectExpr("doc_id AS item_id", "text").write.parquet(f"{folder}/benchmark.parquet")
    more.selectExpr("doc_id AS vec_id", "CASE WHEN text <> '' THEN transform(array(1, 2, 3), x -> cast(length(text) % (x + 5) as float)) END AS embedding").write.parquet(f"{folder}/embeddings.parquet")
    turns = [(1, 0, "user", "x " * 9000, 1), (1, 1, "assistant", None, 1), (1, 1, "assistant", None, 1), (None, None, None, "<|im_end|>", 1)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, pos long").write.parquet(f"{folder}/conversations.parquet")
    found = {name: query(spark, folder).collect() for name, query in queries.QUERIES.items()}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(r.doc_id, r.text or "") for r in more.select("doc_id", "text").collect()]
    plain = collections.defaultdict(collections.Counter)
    for i, t in rows:
        data, ids = t.encode(), library.encode(t)
        spans = [f"{k}:{a}:{b}" for k, own in zip(pii.KINDS, pii.base_spans(t), strict=True) for a, b in own]
        plain["op1_pii"][i, sha(",".join(spans).encode())] += 1
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        plain["op3_telephony"][i, len(data), len(payload), sha(payload), zlib.crc32(payload[-64:])] += 1
        plain["op4_exact_dedup"][i, sha(data.lower())] += 1
        plain["op6_sentencepiece"][i, len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids).encode())] += 1
        plain["op7_sharding"][i, len(data) + 8, zlib.crc32(data), "key"] += 1
        plain["op9_near_dedup"][i, len(sets_of(t, 4))] += 1
        plain["op10_token_counts"][i, len(data), len(ids), len(ids) > 4096] += 1
        plain["op2_mixing"][i, len(re.findall(r"[^\x20\x09-\x0D]+", t))] += 1
        plain["op5_toxicity"][i, None if i is None else zlib.crc32(str(i).encode()) % 3 == 1, 0] += 1
        plain["op11_quality"][i, None if i is None else zlib.crc32(str(i).encode()) % 3 == 1, 1] += 1
        plain["op13_importance"][i, len(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.translate({c: c + 32 for c in range(65, 91)})))] += 1
        if t:
            for k in range(1, 1 + len({r.component for r in found["op12_whitening"]})):
                plain["op12_whitening"][i, k] += 1
    names = {
        "op11_quality": ["doc_id", "held_out", "predicted"], "op12_whitening": ["vec_id", "component"], "op13_importance": ["doc_id", "n_features"],
        "op1_pii": ["doc_id", "base_sha256"], "op2_mixing": ["doc_id", "size"], "op3_telephony": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"], "op4_exact_dedup": ["doc_id", "text_sha256"],
        "op5_toxicity": ["doc_id", "held_out", "predicted"], "op6_sentencepiece": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op7_sharding": ["doc_id", "size", "text_crc32", "law"],
        "op9_near_dedup": ["doc_id", "n_shingles"], "op10_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    }
    for name, columns in names.items():
        assert collections.Counter(tuple(r[c] for c in columns) for r in found[name]) == plain[name], name
    assert {r.spans for r in found["op1_pii"] if r.doc_id == 10} == {"email:9:15,phone:20:37"}
    assert {(r.conv_id, r.n_turns, r.loss_chars) for r in found["op8_chat_format"]} == {(1, 3, 0), (None, 1, 0), (-1, 2, 34)}
    masked = chat_format.windows(spark.read.parquet(f"{folder}/conversations.parquet")).where("conv_id = 1")
    assert sum(len(r.formatted) for r in masked.collect()) == next(r.formatted_chars for r in found["op8_chat_format"] if r.conv_id == 1)
