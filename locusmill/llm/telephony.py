"""Telephony audio: mu-law and A-law by table, IMA ADPCM decoded across blocks, stored and resampled PCM."""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extend, slices, stage, unstage

RATE = 8000
MULAW, ALAW, PCM, IMA = 7, 6, 1, 0x11
#: Bytes a block of ADPCM has: 4 of header, then two samples a byte.
BLOCK = 64


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    x = ((((u & 0x0F) << 3) + 0x84) << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -x, x).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.int32) ^ 0x55
    e, m = (a >> 4) & 7, (a & 0x0F) << 4
    x = np.where(e == 0, m + 8, (m + 0x108) << np.maximum(e - 1, 0))
    return np.where(a & 0x80, x, -x).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = _mulaw_table(), _alaw_table()
# Fixed values of the IMA ADPCM format.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371,
    408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Blocks (rows of bytes: int16 start, index, 0, then nibbles, low first) to int16 samples, all blocks at once."""
    n = len(blocks)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(body), n), np.int16)
    out[0] = value
    for k in range(2 * len(body)):
        code = (body[k // 2] >> (4 * (k % 2))) & 0x0F
        step = STEPS[index]
        diff = ((2 * (code & 7).astype(np.int32) + 1) * step) >> 3
        value = np.clip(np.where(code & 8, value - diff, value + diff), -32768, 32767)
        index = np.clip(index + INDEX_STEP[code], 0, 88)
        out[k + 1] = value
    return out.T


def encode_ima(samples: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """int16 samples to blocks; the last is padded by its last sample. Encoded across blocks, step by step."""
    per = 2 * (block - 4) + 1
    n = max(1, -(-len(samples) // per))
    x = np.pad(samples.astype(np.int32), (0, n * per - len(samples)), "edge" if len(samples) else "constant").reshape(n, per)
    out = np.zeros((n, block), np.uint8)
    value, index = x[:, 0].copy(), np.zeros(n, np.int32)
    out[:, :2] = value.astype("<i2").view(np.uint8).reshape(n, 2)
    for k in range(1, per):
        diff = x[:, k] - value
        step = STEPS[index]
        mag = np.clip((np.abs(diff) * 4) // step, 0, 7)
        code = np.where(diff < 0, 8, 0) + mag
        d = ((2 * mag + 1) * step) >> 3
        value = np.clip(np.where(diff < 0, value - d, value + d), -32768, 32767)
        index = np.clip(index + INDEX_STEP[code], 0, 88)
        out[:, 4 + (k - 1) // 2] |= (code << (4 * ((k - 1) % 2))).astype(np.uint8)
    return out


def resample(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """int16 samples at another rate, by linear interpolation."""
    if source == target or not len(x):
        return x.astype(np.int16)
    n = len(x) * target // source
    return np.rint(np.interp(np.arange(n) * (source / target), np.arange(len(x)), x)).astype(np.int16)


def to_wav(payload: bytes, code: int, rate: int = RATE, align: int = 1, bits: int = 8) -> bytes:
    """A RIFF/WAVE file of one channel around payload (even length)."""
    extra = struct.pack("<HH", 2, 2 * (align - 4) + 1) if code == IMA else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", code, 1, rate, rate * align if code != IMA else rate * align // (2 * (align - 4) + 1), align, bits) + extra
    n = len(payload) // align * (2 * (align - 4) + 1) if code == IMA else len(payload) // align
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, n) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def from_wav(data: bytes) -> tuple[int, int, int, bytes]:
    """(format code, rate, align, payload) of a RIFF/WAVE file; ValueError for anything else."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, code, rate, align, payload = 12, 0, 0, 0, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            code, _, rate, _, align = struct.unpack_from("<HHIIH", data, at + 8)
        elif name == b"data":
            payload = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if payload is None:
        raise ValueError("no data chunk")
    return code, rate, align, payload


def decode(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, int16 samples) of a mu-law, A-law, IMA ADPCM or PCM file."""
    code, rate, align, payload = from_wav(data)
    raw = np.frombuffer(payload, np.uint8)
    if code == MULAW:
        return rate, MULAW_TABLE[raw]
    if code == ALAW:
        return rate, ALAW_TABLE[raw]
    if code == IMA:
        return rate, decode_ima(raw[: len(raw) // align * align].reshape(-1, align)).ravel()
    return rate, np.frombuffer(payload[: len(payload) // 2 * 2], "<i2")


def store_text_audio(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes (null: none), zero bytes up to a positive multiple of 64, as a mu-law file."""

    def encode(batches):
        for batch in slices(batches):
            raw = [b"" if t is None else t.encode() for t in batch.column("text").to_pylist()]
            media = [to_wav(b + bytes(max(64, -(-len(b) // 64) * 64) - len(b)), MULAW) for b in raw]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(encode, extend(docs.select("doc_id").schema, "n_bytes long, media binary"))


def to_pcm(media: DataFrame, rate: int = 16000, column: str = "media") -> DataFrame:
    """media with a column pcm: the decoded audio at rate as a 16-bit PCM file, null where media is null."""

    def convert(batches):
        for batch in slices(batches):
            out = []
            for m in batch.column(column).to_pylist():
                if m is None:
                    out.append(None)
                    continue
                have, x = decode(m)
                out.append(to_wav(resample(x, have, rate).astype("<i2").tobytes(), PCM, rate, 2, 16))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "pcm"])

    return media.mapInArrow(convert, extend(media.schema, "pcm binary"))


def level(x: np.ndarray) -> int:
    """Root mean square of samples, rounded down."""
    y = x.astype(np.int64)
    return int(np.sqrt((y * y).sum() / max(len(y), 1)))


def levels(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """level() of each stretch of x that begins at one of at and ends at the next."""
    y = x.astype(np.int64)
    return np.sqrt(np.add.reduceat(y * y, at[:-1]) / np.diff(at)).astype(np.int64)


def crossings(x: np.ndarray) -> int:
    """How often the sign changes."""
    return int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))


def store_pcm(media: DataFrame, rate: int = 16000) -> DataFrame:
    """From the files of store_text_audio() (doc_id, n_bytes, media): pcm, their sound at rate as a 16-bit file, and what is known of them.

    That is payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, and the levels
    of the payload read as A-law (alaw) and as ADPCM blocks (ima). Files are parsed as stored.
    """

    def convert(batches):
        for batch in batches:
            files = batch.column("media").to_pylist()
            found = [from_wav(m) for m in files]
            payloads = [x[3] for x in found]
            data = np.frombuffer(b"".join(payloads), np.uint8)
            at = np.concatenate([[0], np.cumsum([len(p) for p in payloads])])
            # ADPCM is decoded across the blocks of all files of the run
            alaw, ima = levels(ALAW_TABLE[data], at), levels(decode_ima(data.reshape(-1, BLOCK)).ravel(), at // BLOCK * (2 * (BLOCK - 4) + 1))
            sound = MULAW_TABLE[data]
            pcm = [to_wav(resample(sound[a:b], f[1], rate).astype("<i2").tobytes(), PCM, rate, 2, 16) for a, b, f in zip(at[:-1], at[1:], found)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"),
                "payload_bytes": pa.array(np.diff(at), pa.int64()), "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
                "tail_crc32": pa.array([zlib.crc32(p[-64:]) for p in payloads], pa.int64()), "media_bytes": pa.array([len(m) for m in files], pa.int64()),
                "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in files], pa.string()), "alaw": pa.array(alaw, pa.int64()), "ima": pa.array(ima, pa.int64()), "pcm": pa.array(pcm, pa.binary()),
            })

    schema = extend(media.select("doc_id", "n_bytes").schema, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, alaw long, ima long, pcm binary")
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_in_runs(convert, "media"), schema)


def _in_runs(convert, column: str, budget: int = 2 << 20):
    """convert() for runs of rows with about budget bytes in column; a longer value is a run by itself."""

    def run(batches):
        def cut():
            for batch in slices(batches):
                size = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
                start = total = 0
                for i, n in enumerate(size):
                    if i > start and total + n > budget:
                        yield batch.slice(start, i - start)
                        start, total = i, 0
                    total += int(n)
                if start < batch.num_rows:
                    yield batch.slice(start)

        yield from convert(cut())

    return run


def describe(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, from what store_pcm() stored.

    feature: level and sign changes of the PCM as stored, the levels as A-law and ADPCM, and a
    check sum of the PCM's samples.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]

    def read(batches):
        for batch in batches:
            out = []
            for m, a, i in zip(*(batch.column(c).to_pylist() for c in ("pcm", "alaw", "ima"))):
                rate, x = decode(m)
                out.append(f"pcm{rate}:{level(x)}:{crossings(x)}:{zlib.crc32(x.tobytes()):08x};alaw:{a};ima:{i}")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.string())], [*names, "feature"])

    return stored.mapInArrow(_in_runs(read, "pcm"), extend(stored.select(*names).schema, "feature string"))


def media_report(docs: DataFrame, rate: int = 16000, slices: int = 3) -> DataFrame:
    """describe() of the audio of docs' texts: mu-law files and resampled PCM, written to the shared folder and read back.

    Texts go through in slices by their hash; what is stored of a slice is deleted once it has
    been described, so that the folder never holds more than a slice. Null and empty texts give
    64 zero bytes; equal texts give equal values; very long texts are one file; ids may be null
    or repeated; other columns, whatever their names, aren't read; an empty table gives no rows.
    """
    done = []
    for k in range(slices):
        media = stage(store_text_audio(docs.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == k)), "media")
        pcm = stage(store_pcm(media, rate), "pcm")
        done.append(stage(describe(pcm), "described"))
        unstage(media)
        unstage(pcm)
    return functools.reduce(DataFrame.union, done)
