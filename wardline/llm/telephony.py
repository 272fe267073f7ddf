"""Telephony audio as columns: mu-law, A-law and ADPCM to 16-bit PCM, resampled, in WAV containers.

Codes of one byte per sample are expanded by tables of 256 entries. ADPCM blocks are decoded step by step, each step over all
blocks of a batch at once. All arithmetic is on integers, so equal bytes give equal samples everywhere.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, shared_dir, texts

RATE_IN, RATE_OUT = 8000, 16000
PAD, UNIT = 0xFF, 576
ADPCM_BLOCK = 576
#: Bytes of media that are described at a time.
READ_BYTES = 4 << 20
PCM, ADPCM, ALAW, MULAW = 1, 0x11, 6, 7
#: Fixed values of IMA ADPCM: index steps of the magnitude bits, then the 89 quantiser steps.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int64)
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494,
        544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
        12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int64,
)


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: complemented code = sign, 3-bit exponent, 4-bit mantissa; bias 132."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: even bits inverted; a set sign bit is positive; exponent 0 is linear."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = code >> 4 & 7, code & 15
    size = np.where(exponent == 0, (mantissa << 4) + 8, (mantissa << 4) + 264 << np.maximum(exponent, 1) - 1)
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW_TO_PCM, ALAW_TO_PCM = mulaw_table(), alaw_table()


def decode_adpcm(blocks: np.ndarray, steps: np.ndarray = STEPS) -> np.ndarray:
    """IMA ADPCM, mono: uint8[n, size] -> int16[n, 1 + 2 * (size - 4)].

    A block starts with a 16-bit sample, the step index (over 88: 88) and a byte that isn't used; then two codes a byte, low first.
    """
    n, size = blocks.shape
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int64)
    index = np.minimum(blocks[:, 2].astype(np.int64), 88)
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    out[0] = value
    codes = blocks[:, 4:].T
    for k in range(size - 4):
        for place, code in ((1, codes[k] & 15), (2, codes[k] >> 4)):
            step, low = steps[index], code & 7
            move = (step >> 3) + np.where(low & 4, step, 0) + np.where(low & 2, step >> 1, 0) + np.where(low & 1, step >> 2, 0)
            value = np.clip(np.where(code & 8, value - move, value + move), -32768, 32767)
            index = np.clip(index + INDEX_STEP[low], 0, 88)
            out[2 * k + place] = value
    return np.ascontiguousarray(out.T)


def resample_double(pcm: np.ndarray) -> np.ndarray:
    """int16 at a rate -> int16 at twice the rate: each sample, then the mean (rounded down) of it and the next; the last is held."""
    if not len(pcm):
        return pcm.astype(np.int16)
    wide = pcm.astype(np.int32)
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
    out[-1] = pcm[-1]
    return out


def wav(samples: bytes, tag: int, rate: int, bits: int) -> bytes:
    """A mono WAV file. Chunks have even lengths."""
    fmt = struct.pack("<HHIIHH", tag, 1, rate, rate * bits // 8, bits // 8, bits)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, bytes] | None:
    """tag, rate and the data chunk of a mono WAV file; None if it isn't one."""
    if media is None or media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt ":
        return None
    at, tag, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            tag, rate = struct.unpack_from("<HxxI", media, at + 8)
        elif name == b"data":
            return tag, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return None


def to_pcm(tag: int, data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if tag == MULAW:
        return MULAW_TO_PCM[raw]
    if tag == ALAW:
        return ALAW_TO_PCM[raw]
    if tag == ADPCM:
        whole = len(raw) // ADPCM_BLOCK * ADPCM_BLOCK
        return decode_adpcm(raw[:whole].reshape(-1, ADPCM_BLOCK)).ravel()
    return np.frombuffer(data[: len(data) // 2 * 2], "<i2")


def decode_audio(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Add pcm: the WAV column decoded (mu-law, A-law, IMA ADPCM in blocks of 576 or 16-bit PCM), at twice its rate, as a PCM WAV.

    Null, empty and foreign media give a null. All other columns stay.
    """

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in (part for frame in frames for part in _by_bytes(frame, media_col)):
            found = [read_wav(x) for x in f[media_col]]
            yield f.assign(pcm=[None if x is None else wav(resample_double(to_pcm(x[0], x[2])).astype("<i2").tobytes(), PCM, 2 * x[1], 16) for x in found])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name != "pcm")
    return media.drop("pcm").mapInPandas(decode, f"{schema}, pcm binary")


def _mulaw_wav(text: str, unit: int) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), wav(raw + bytes([PAD]) * ((-len(raw)) % unit if raw else unit), MULAW, RATE_IN, 8)


def store_mulaw(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """doc_id, n_bytes, media: every text's UTF-8 bytes, padded with 255 to a positive multiple of `unit`, as the codes of a mu-law WAV.

    A null text is empty; an empty one is one unit of padding. Null and repeated ids stay. The codes are the payload: storing them loses nothing.
    """

    def store(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [_mulaw_wav(t, unit) for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "n_bytes": [n for n, _ in made], "media": [m for _, m in made]})

    return texts(docs).mapInPandas(store, "doc_id long, n_bytes long, media binary")


def stored_audio(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """doc_id, n_bytes, media (as store_mulaw) and pcm (the resampled PCM WAV, as decode_audio), written and read back.

    Every 16-bit sample is stored, and compressed as bytes: twice the samples of twice the size make the PCM the larger part.
    """
    spark = docs.sparkSession

    def store(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for f in _by_bytes(frame, "text", 1 << 20):
                made = [_mulaw_wav(t, unit) for t in f["text"]]
                pcm = [wav(resample_double(to_pcm(tag, data)).astype("<i2").tobytes(), PCM, 2 * rate, 16) for tag, rate, data in (read_wav(m) for _, m in made)]
                yield pd.DataFrame({"doc_id": f["doc_id"], "n_bytes": [n for n, _ in made], "media": [m for _, m in made], "pcm": pcm})

    path = f"{shared_dir(spark)}/telephony-{uuid.uuid4().hex}"
    schema = "doc_id long, n_bytes long, media binary, pcm binary"
    # long values: small row groups keep the writer's memory low; texts in order, so that copies in a task share pages
    (
        texts(docs)
        .sortWithinPartitions("text")
        .mapInPandas(store, schema)
        .write.option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", "11")
        .option("parquet.block.size", str(32 << 20))
        .option("parquet.page.size", str(4 << 20))
        .option("parquet.enable.dictionary", "false")
        .parquet(path)
    )
    return spark.read.schema(schema).parquet(path)


def audio_features(stored: DataFrame) -> DataFrame:
    """Read each stored mu-law WAV and its stored PCM (column pcm, of stored_audio) back, decode the samples as all three codes, and describe the result.

    feature: peak, sum of magnitudes and sign changes of the mu-law PCM and of the A-law PCM, then the sum of magnitudes and CRC of
    the ADPCM decoding of the payload's blocks of 576 bytes, then the CRC of the stored 16 kHz PCM WAV.
    """

    def describe(pcm: np.ndarray) -> str:
        wide = pcm.astype(np.int32)
        return f"{int(np.abs(wide).max())}:{int(np.abs(wide).sum(dtype=np.int64))}:{int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))}"

    def features(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            # values stay in the batch's own buffers, and few are expanded at once
            part = np.cumsum([x.as_buffer().size for x in b.column("media")]) // READ_BYTES
            for first, last in zip(starts := np.flatnonzero(np.diff(part, prepend=-1)), [*starts[1:], b.num_rows], strict=True):
                own_rows = b.slice(int(first), int(last - first))
                files, pcms = ([x.as_buffer() for x in own_rows.column(c)] for c in ("media", "pcm"))
                data = [read_wav(x.to_pybytes())[2] for x in files]
                blocks = np.frombuffer(b"".join(data), np.uint8).reshape(-1, ADPCM_BLOCK)
                adpcm, rows, at = decode_adpcm(blocks), [], 0
                for x, media, pcm in zip(data, files, pcms, strict=True):
                    codes, own = np.frombuffer(x, np.uint8), adpcm[at : at + len(x) // ADPCM_BLOCK]
                    at += len(own)
                    mu = MULAW_TO_PCM[codes]
                    block_sum = int(np.abs(own.astype(np.int32)).sum(dtype=np.int64))
                    feature = f"mulaw={describe(mu)};alaw={describe(ALAW_TO_PCM[codes])};adpcm={block_sum}:{zlib.crc32(own.astype('<i2').tobytes()):08x};pcm={zlib.crc32(pcm):08x}"
                    rows.append((len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-32:]), media.size, hashlib.sha256(media).hexdigest(), feature, pcm.size))
                columns = [own_rows.column("doc_id"), own_rows.column("n_bytes"), *[pa.array(c) for c in zip(*rows, strict=True)]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes"])

    return stored.select("doc_id", "n_bytes", "media", "pcm").mapInArrow(features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long")


def _by_bytes(frame: pd.DataFrame, column: str, most: int = 4 << 20) -> Iterator[pd.DataFrame]:
    """Consecutive rows of about `most` bytes in all, so that a batch of long media doesn't expand at once."""
    part = np.cumsum(frame[column].str.len().fillna(0).to_numpy(np.int64)) // most
    for _, f in frame.groupby(part, sort=False):
        yield f


def op2_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_features(stored_audio(documents(spark, sf_dir)))
