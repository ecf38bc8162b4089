"""Media columns of telephony audio: mu-law, A-law and ADPCM in WAV files, decoded to PCM and resampled.

The law codes expand by lookup tables. ADPCM is a recurrence over the codes of a block, but blocks are independent: all blocks of an
Arrow batch, whatever files they belong to, advance together, one numpy step for each code position.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.llm.common import slices, table, texts_of

#: WAV format tags by codec.
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 17}
CODECS = tuple(TAGS)
RATE, RESAMPLED = 8_000, 16_000
#: Payloads are padded to a multiple of this; an ADPCM block has as many bytes of codes.
UNIT = 64
#: An ADPCM block's header: the first sample and the index of its step.
HEAD = 4
# How a code's magnitude moves the step index.
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
# The steps.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
    1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
LAST_STEP = len(STEPS) - 1


@lru_cache(1)
def tables() -> dict[str, np.ndarray]:
    """PCM by code, for both laws."""
    code = ~np.arange(256) & 255
    mulaw = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    mulaw = np.where(code & 128, -mulaw, mulaw)
    code = np.arange(256) ^ 0x55
    segment, low = (code >> 4) & 7, ((code & 15) << 4) + 8
    alaw = np.where(segment == 0, low, (low + 256) << np.maximum(segment - 1, 0))
    alaw = np.where(code & 128, alaw, -alaw)
    return {"mulaw": mulaw.astype(np.int16), "alaw": alaw.astype(np.int16)}


def wav(codec: str, payload: bytes) -> bytes:
    """A WAV file with the payload as its codes, unchanged. ADPCM blocks start from silence."""
    block, bits, extra = 1, 8, b""
    data = payload
    if codec == "adpcm":
        block, bits, extra = UNIT + HEAD, 4, struct.pack("<H", 1 + 2 * UNIT)
        codes = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        data = np.hstack([np.zeros((len(codes), HEAD), np.uint8), codes]).tobytes()
    per_second = RATE if codec != "adpcm" else RATE * block // (1 + 2 * UNIT)
    form = struct.pack("<HHIIHHH", TAGS[codec], 1, RATE, per_second, block, bits, len(extra)) + extra
    pad = b"\0" * (len(data) % 2)
    chunks = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data + pad
    return b"RIFF" + struct.pack("<I", len(chunks)) + chunks


def read_wav(media: bytes) -> tuple[str, bytes]:
    """Codec and codes (for ADPCM: blocks with their headers) of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, data = 12, None, None
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
        elif name == b"data":
            data = media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    if data is None or tag not in TAGS.values():
        raise ValueError("no telephony audio")
    return next(k for k, v in TAGS.items() if v == tag), data


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (a row each) of ADPCM blocks (a row of header and codes each)."""
    value = blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int32) << 8)
    value = np.where(value > 32_767, value - 65_536, value)
    index = np.minimum(blocks[:, 2].astype(np.int32), LAST_STEP)
    codes = blocks[:, HEAD:]
    out = np.empty((len(blocks), 1 + 2 * codes.shape[1]), np.int16)
    out[:, 0] = value
    for k in range(2 * codes.shape[1]):
        code = ((codes[:, k // 2] >> (4 * (k % 2))) & 15).astype(np.int32)
        step = STEPS[index]
        move = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - move, value + move), -32_768, 32_767)
        index = np.clip(index + INDEX_MOVES[code], 0, LAST_STEP)
        out[:, k + 1] = value
    return out


@lru_cache(1)
def between() -> np.ndarray:
    """A windowed sinc for the samples half way between two."""
    x = np.arange(-4, 4) + 0.5
    taps = np.sinc(x) * np.cos(np.pi * x / 9) ** 2
    return taps / taps.sum()


def doubled(pcm: np.ndarray) -> np.ndarray:
    """PCM at twice the rate: the samples, and those half way between each two."""
    x = np.concatenate([np.repeat(pcm[:1], 3), pcm, np.repeat(pcm[-1:], 4)]).astype(np.float64)
    half = np.convolve(x, between(), "valid")[: len(pcm)]
    out = np.empty(2 * len(pcm), "<i2")
    out[0::2], out[1::2] = pcm, np.clip(np.rint(half), -32_768, 32_767)
    return out


def describe(codec: str, pcm: np.ndarray) -> str:
    """Codec, samples, level, peak, crossings of zero, and share of silence, in that order."""
    x = pcm.astype(np.int64)
    level = (int((x * x).sum()) / len(x)) ** 0.5
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"{codec} n={len(x)} rms={level:.3f} peak={int(np.abs(x).max())} zc={crossings} quiet={int(np.count_nonzero(np.abs(x) < 64))}"


def telephony(docs: DataFrame, resampled: bool = True) -> DataFrame:
    """doc_id, n_bytes, codec, media (the WAV file), payload (its codes, read back), pcm (16-bit, at twice the rate; null unless
    ``resampled``) and feature, one row per document.

    The payload is the text in UTF-8, with bytes 0 up to a positive multiple of 64; null counts as empty, so both give one unit of
    silence. The payload's checksum chooses the codec, so equal texts give equal files. Repeated rows are each converted; a null
    doc_id stays null; other columns are not read; very long texts are converted whole; an empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("codec", pa.string()), ("media", pa.binary()), ("payload", pa.binary()), ("pcm", pa.binary()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            sizes, media = [], []
            for text in texts_of(batch.column("text")):
                data = text.encode("utf-8", "replace")
                sizes.append(len(data))
                payload = data + b"\0" * (-len(data) % UNIT if data else UNIT)
                media.append(wav(CODECS[zlib.crc32(payload) % len(CODECS)], payload))
            read = [read_wav(x) for x in media]
            packed = [np.frombuffer(data, np.uint8).reshape(-1, UNIT + HEAD) for codec, data in read if codec == "adpcm"]
            decoded = decode_adpcm(np.concatenate(packed)) if packed else np.empty((0, 1), np.int16)
            ends = iter(np.cumsum([0, *map(len, packed)]))
            start = next(ends)
            codecs, payloads, pcms, features = [], [], [], []
            for codec, data in read:
                if codec == "adpcm":
                    stop = next(ends)
                    pcm = decoded[start:stop].ravel()
                    data, start = np.frombuffer(data, np.uint8).reshape(-1, UNIT + HEAD)[:, HEAD:].tobytes(), stop
                else:
                    pcm = tables()[codec][np.frombuffer(data, np.uint8)]
                codecs.append(codec)
                payloads.append(data)
                pcms.append(doubled(pcm).tobytes() if resampled else None)
                features.append(describe(codec, pcm))
            columns = [pa.array(x, t) for x, t in zip((sizes, codecs, media, payloads, pcms, features), schema.types[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, codec string, media binary, payload binary, pcm binary, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -UNIT, UNIT)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        "feature", "codec", F.sha2("pcm", 256).alias("pcm_sha256"),
    )
