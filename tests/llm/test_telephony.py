import hashlib
import wave
import zlib
from io import BytesIO

import numpy as np

from pyspark.sql import functions as F

from wardline.llm import telephony as t

from .conftest import HARD


def slow_adpcm(block):
    """One block, one code at a time, straight from the definition."""
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(t.STEPS[index])
            move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - move if code & 8 else value + move))
            index = max(0, min(88, index + int(t.INDEX_STEP[code & 7])))
            out.append(value)
    return out


def test_tables_are_known_values():
    assert t.MULAW_TO_PCM[[0x00, 0x80, 0x7F, 0xFF, 0x0F]].tolist() == [-32124, 32124, 0, 0, -16764]
    assert t.ALAW_TO_PCM[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    assert sorted(t.MULAW_TO_PCM[:128]) == list(t.MULAW_TO_PCM[:128])


def test_adpcm_blocks_equal_one_by_one():
    blocks = np.random.default_rng(7).integers(0, 256, (40, 36), dtype=np.uint8)
    assert t.decode_adpcm(blocks).tolist() == [slow_adpcm(b.tobytes()) for b in blocks]


def test_resample():
    assert t.resample_double(np.array([0, 10, -4], np.int16)).tolist() == [0, 5, 10, 3, -4, -4]
    assert len(t.resample_double(np.zeros(0, np.int16))) == 0


def test_wav_round_trip():
    assert t.read_wav(t.wav(b"abc", t.MULAW, 8000, 8)) == (t.MULAW, 8000, b"abc")
    assert t.read_wav(b"nothing") is None and t.read_wav(None) is None
    with wave.open(BytesIO(t.wav(b"\1\0\2\0", t.PCM, 16000, 16))) as w:
        assert (w.getframerate(), w.getnframes(), w.readframes(2)) == (16000, 2, b"\1\0\2\0")


def test_decode_audio(spark):
    rows = [(1, t.wav(bytes([0xFF, 0]), t.MULAW, 8000, 8)), (2, None), (3, b"junk"), (4, t.wav(bytes([0x55]), t.ALAW, 8000, 8)), (5, t.wav(bytes(576), t.ADPCM, 8000, 4)), (6, t.wav(b"", t.MULAW, 8000, 8))]
    got = {r["id"]: r["pcm"] for r in t.decode_audio(spark.createDataFrame(rows, "id int, media binary")).collect()}
    assert got[2] is None and got[3] is None
    assert t.read_wav(bytes(got[1])) == (t.PCM, 16000, np.array([0, -16062, -32124, -32124], "<i2").tobytes())
    assert len(t.read_wav(bytes(got[5]))[2]) == 4 * 1145 and t.read_wav(bytes(got[6]))[2] == b""


def check(rows, texts):
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(payload), zlib.crc32(payload[-32:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["media_sha256"] == hashlib.sha256(t.wav(payload, t.MULAW, 8000, 8)).hexdigest()


def test_op2(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = t.op2_telephony_audio(spark, sf_dir).collect()
    check(rows, docs)
    assert len(rows) == len(docs)


def feature(payload):
    """As the definition has it, sample by sample."""
    def describe(pcm):
        return f"{max(map(abs, pcm))}:{sum(map(abs, pcm))}:{sum((a < 0) != (b < 0) for a, b in zip(pcm[:-1], pcm[1:], strict=True))}"

    mu, a_law = ([int(table[c]) for c in payload] for table in (t.MULAW_TO_PCM, t.ALAW_TO_PCM))
    adpcm = [x for k in range(0, len(payload), 576) for x in slow_adpcm(payload[k : k + 576])]
    twice = [x for k, m in enumerate(mu) for x in (m, (m + mu[k + 1]) // 2 if k + 1 < len(mu) else m)]
    file = BytesIO()
    with wave.open(file, "wb") as w:
        w.setparams((1, 2, 16000, 0, "NONE", ""))
        w.writeframes(np.array(twice, "<i2").tobytes())
    code = zlib.crc32(np.array(adpcm, "<i2").tobytes())
    return f"mulaw={describe(mu)};alaw={describe(a_law)};adpcm={sum(map(abs, adpcm))}:{code:08x};pcm={zlib.crc32(file.getvalue()):08x}"


def test_features_equal_brute_force(spark):
    rows = [(1, "Ein kürzerer Text."), (2, None), (3, "long text, " * 200), (4, "\x7f\x00é" * 300), (5, "日本語")]
    got = {r["doc_id"]: r["feature"] for r in t.audio_features(t.stored_audio(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, text in rows:
        raw = (text or "").encode()
        assert got[i] == feature(raw + b"\xff" * (-len(raw) % 576 if raw else 576))


def test_hard_rows(spark, hard):
    rows = t.audio_features(t.stored_audio(hard)).collect()
    check(rows, dict(HARD))
    assert len(rows) == len(HARD)
    same = [r["feature"] for r in rows if r["doc_id"] in (1, 2)]
    assert len(set(same)) == 1
    assert t.audio_features(t.stored_audio(hard.limit(0))).count() == 0


def test_pcm_is_stored_and_described_as_stored(spark):
    docs = spark.createDataFrame([(1, "a short text"), (2, None)], "doc_id long, text string")
    decoded = {r["doc_id"]: r["pcm"] for r in t.decode_audio(t.store_mulaw(docs)).collect()}
    stored = t.stored_audio(docs)
    for r in stored.collect():
        with wave.open(BytesIO(r["pcm"])) as w:
            assert (w.getframerate(), w.getsampwidth(), w.getnframes()) == (16000, 2, 2 * t.UNIT)
        assert r["pcm"] == decoded[r["doc_id"]]
    noise = np.random.default_rng(3).integers(-32768, 32768, 2 * t.UNIT).astype("<i2").tobytes()
    other = stored.withColumn("pcm", F.lit(t.wav(noise, t.PCM, 16000, 16)))  # any other samples are read as they are stored
    assert {r["feature"].split(";")[-1] for r in t.audio_features(other).collect()} == {f"pcm={zlib.crc32(t.wav(noise, t.PCM, 16000, 16)):08x}"}


def test_op2_writes_pcm(spark, sf_dir):
    files = t.op2_telephony_audio(spark, sf_dir).inputFiles()
    assert {"media", "pcm"} <= set(spark.read.parquet(*files).columns)
