"""Media columns: telephony audio.

A text's bytes are kept as 8-bit samples in a WAV file, in one of three telephony codings: mu-law, A-law or
IMA ADPCM. Mu-law and A-law are expanded by tables of 256 entries, made from their rules. An ADPCM block
depends on its own bytes only, so numpy decodes the same sample of all blocks of a batch in one step. The
decoded samples are resampled, from any rate to any other, by a polyphase filter and stored as PCM. The filter works
on whole numbers, so the same samples come out everywhere.
"""

from __future__ import annotations

import hashlib
import math
import struct
from functools import lru_cache
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, plainly_named, slices

UNIT = 576
PAD = 255
RATE = 8_000
PCM_RATE = 16_000
#: Zero crossings of the resampling filter on each side, and what its taps add up to.
CROSSINGS = 8
UNITY = 1 << 14
#: Bytes of an ADPCM block: 4 of header, which give one sample, then two samples a byte.
BLOCK = 36
BLOCK_SAMPLES = 2 * (BLOCK - 4) + 1
MU_LAW, A_LAW, ADPCM, PCM = 7, 6, 17, 1
CODINGS = {MU_LAW: "mulaw", A_LAW: "alaw", ADPCM: "adpcm", PCM: "pcm"}
#: Bytes of payload that a task decodes at a time; one file is never cut.
AT_ONCE = 2_000_000


def _mu_law() -> np.ndarray:
    x = ~np.arange(256) & 0xFF
    size = ((((x & 15) << 3) + 132) << (x >> 4 & 7)) - 132
    return np.where(x & 128, -size, size).astype(np.int16)


def _a_law() -> np.ndarray:
    x = np.arange(256) ^ 0x55
    part, low = x >> 4 & 7, (x & 15) << 4
    size = np.where(part == 0, low + 8, (low + 264) << np.maximum(part - 1, 0))
    return np.where(x & 128, size, -size).astype(np.int16)


TABLES = {MU_LAW: _mu_law(), A_LAW: _a_law()}
# The step sizes and index changes of IMA ADPCM.
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
        7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def payload(text: str | bytes | None) -> bytes:
    """UTF-8 bytes and as many bytes 255 as make a positive multiple of UNIT."""
    data = text.encode() if isinstance(text, str) else text or b""
    return data + bytes([PAD]) * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def wav(data: bytes, coding: int, rate: int = RATE) -> bytes:
    """A mono WAV file of samples that are coded already."""
    samples = len(data) // 2 if coding == PCM else len(data) // BLOCK * BLOCK_SAMPLES if coding == ADPCM else len(data)
    align = {PCM: 2, ADPCM: BLOCK}.get(coding, 1)
    speed = rate * BLOCK // BLOCK_SAMPLES if coding == ADPCM else rate * align
    head = struct.pack("<HHIIHH", coding, 1, rate, speed, align, {PCM: 16, ADPCM: 4}.get(coding, 8))
    head += struct.pack("<HH", 2, BLOCK_SAMPLES) if coding == ADPCM else b"" if coding == PCM else struct.pack("<H", 0)
    fact = b"" if coding == PCM else struct.pack("<4sII", b"fact", 4, samples)
    chunks = struct.pack("<4sI", b"fmt ", len(head)) + head + fact + struct.pack("<4sI", b"data", len(data)) + data + b"\0" * (len(data) % 2)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(chunks), b"WAVE") + chunks


def read_wav(media: bytes) -> tuple[int, int, bytes]:
    """(coding, rate, coded samples) of a mono file. Raises ValueError for anything else."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, coding, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            if at + 8 + max(size, 16) > len(media):
                raise ValueError("a WAV file that is cut short")
            coding, channels, rate = struct.unpack_from("<HHI", media, at + 8)
            if channels != 1 or coding not in CODINGS or coding == ADPCM and struct.unpack_from("<H", media, at + 20)[0] != BLOCK:
                raise ValueError(f"a WAV file of {channels} channels in coding {coding}")
        elif name == b"data" and coding:
            return coding, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without data")


def decode_adpcm(data: np.ndarray) -> np.ndarray:
    """Blocks (one a row) to their samples, all blocks at once. A step index over 88 counts as 88."""
    data = data.astype(np.int32)
    now = (data[:, 0] | data[:, 1] << 8).astype(np.int16).astype(np.int32)
    step = np.minimum(data[:, 2], 88)
    out = np.empty((len(data), BLOCK_SAMPLES), np.int16)
    out[:, 0] = now
    codes = np.stack([data[:, 4:] & 15, data[:, 4:] >> 4], axis=2).reshape(len(data), -1).T
    for i, code in enumerate(np.ascontiguousarray(codes), 1):
        size = STEPS[step]
        change = (size >> 3) + (size >> 2) * (code & 1) + (size >> 1) * (code >> 1 & 1) + size * (code >> 2 & 1)
        now = np.clip(np.where(code & 8, now - change, now + change), -32768, 32767)
        out[:, i] = now
        step = np.clip(step + CHANGES[code & 7], 0, 88)
    return out


def decode(coded: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """Samples of 16 bits for each (coding, data); the ADPCM blocks of all are decoded together."""
    blocks = [np.frombuffer(d, np.uint8)[: len(d) // BLOCK * BLOCK].reshape(-1, BLOCK) for c, d in coded if c == ADPCM]
    whole = decode_adpcm(np.concatenate(blocks)) if blocks else None
    out, at = [], 0
    for coding, data in coded:
        if coding == ADPCM:
            n = len(data) // BLOCK
            out.append(whole[at : at + n].ravel())
            at += n
        elif coding == PCM:
            out.append(np.frombuffer(data, "<i2"))
        else:
            out.append(TABLES[coding][np.frombuffer(data, np.uint8)])
    return out


@lru_cache(maxsize=64)
def filter_taps(up: int, down: int) -> np.ndarray:
    """Taps of a low-pass filter, a row for each of `up` places between two samples: row f, column j is the weight of the
    sample j - half + 1 places on. A sinc under a Hann window that passes what both rates can hold; rows add up to UNITY."""
    cut = min(1.0, up / down)
    half = math.ceil(CROSSINGS / cut)
    away = np.arange(up)[:, None] / up - np.arange(1 - half, half + 1)
    weight = cut * np.sinc(cut * away) * np.cos(np.pi * np.clip(away / half, -1, 1) / 2) ** 2
    taps = np.rint(weight / weight.sum(axis=1, keepdims=True) * UNITY).astype(np.int32)
    taps[np.arange(up), np.abs(taps).argmax(axis=1)] += UNITY - taps.sum(axis=1)
    return taps


def resampled(samples: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Samples of 16 bits at another rate, target / rate times as many, rounded up. Beyond both ends there is silence."""
    if rate == target or not len(samples):
        return samples
    common = math.gcd(rate, target)
    up, down = target // common, rate // common
    taps = filter_taps(up, down)
    half = taps.shape[1] // 2
    count = -(-len(samples) * up // down)
    last = (count - 1) * down // up
    x = np.concatenate([np.zeros(half - 1, np.int32), samples.astype(np.int32), np.zeros(half + 1 + max(0, last - len(samples)), np.int32)])
    out = np.empty(count, np.int32)
    for f in range(up):
        n = f * pow(down, -1, up) % up if up > 1 else 0  # the first output sample at this place between two
        places = len(range(n, count, up))
        begin, total = n * down // up, np.full(places, UNITY // 2, np.int32)
        for j in np.flatnonzero(taps[f]).tolist() if places else ():
            total += x[begin + j : begin + j + (places - 1) * down + 1 : down] * taps[f, j]
        out[n::up] = total // UNITY
    return np.clip(out, -32768, 32767).astype(np.int16)


def _stored(batches: Iterator[pa.RecordBatch], text: str, coding: str, media: str) -> Iterator[pa.RecordBatch]:
    names = {v: k for k, v in CODINGS.items()}
    for whole in batches:
        for begin, end in slices(whole, text, AT_ONCE):
            batch = whole.slice(begin, end - begin)
            files = []
            for t in batch.column(text).cast(pa.binary()).to_pylist():
                data = payload(t)
                which = names[coding] if coding else (MU_LAW, A_LAW, ADPCM)[zlib.crc32(data) % 3]
                files.append(wav(data, which))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(files, pa.binary())], [*batch.schema.names, media])


def with_audio(docs: DataFrame, text_col: str = "text", out: str = "media", coding: str = "") -> DataFrame:
    """docs and a binary column with the text's payload as a WAV file. Null text counts as empty.

    coding is mulaw, alaw or adpcm; without one the payload's CRC-32 chooses, so equal texts have equal files.
    The payload is the file's data as it is, which loses nothing.
    """
    if coding not in ("", "mulaw", "alaw", "adpcm"):
        raise ValueError(f"no such coding: {coding}")
    name = fresh(docs.columns, out)
    plain, names = plainly_named(docs)
    text = names[text_col]
    schema = T.StructType([*plain.schema.fields, T.StructField("media", T.BinaryType())])
    return plain.mapInArrow(lambda b: _stored(b, text, coding, "media"), schema).toDF(*docs.columns, name)


FEATURES = (
    "n_samples long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, pcm binary"
)


def _features(media: list[bytes | None], pcm: bool, target: int) -> Iterator[dict | None]:
    read = [read_wav(m) if m is not None else None for m in media]
    samples = iter(decode([(r[0], r[2]) for r in read if r]))
    for m, r in zip(media, read, strict=True):
        if not r:
            yield None
            continue
        coding, rate, data = r
        x = next(samples)
        wide = x.astype(np.float64)
        root = float(np.sqrt(np.mean(wide * wide))) if len(x) else 0.0
        peak = int(np.abs(x.astype(np.int32)).max(initial=0))
        crossings = int(np.count_nonzero(np.diff(x < 0)))
        stored = resampled(x, rate, target).astype("<i2").tobytes()
        yield {
            "n_samples": len(x),
            "payload_bytes": len(data),
            "payload_sha256": hashlib.sha256(data).hexdigest(),
            "tail_crc32": zlib.crc32(data[-32:]),
            "media_bytes": len(m),
            "media_sha256": hashlib.sha256(m).hexdigest(),
            "feature": f"{CODINGS[coding]} ms={1000 * len(x) // rate} rms={root:.2f} peak={peak} crossings={crossings} pcm{target}={zlib.crc32(stored):08x}",
            "pcm": wav(stored, PCM, target) if pcm else None,
        }


_ARROW = pa.struct(
    [
        ("n_samples", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()),
        ("media_sha256", pa.string()),
        ("feature", pa.string()),
        ("pcm", pa.binary()),
    ]
)


def _read(batches: Iterator[pa.RecordBatch], media: str, out: str, pcm: bool, rate: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for begin, end in slices(whole, media, AT_ONCE):
            batch = whole.slice(begin, end - begin)
            made = list(_features(batch.column(media).to_pylist(), pcm, rate))
            columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != media]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(made, _ARROW)], [*(n for n in batch.schema.names if n != media), out]
            )


def decoded(docs: DataFrame, media_col: str = "media", out: str = "audio", pcm: bool = True, rate: int = PCM_RATE) -> DataFrame:
    """docs with the WAV column replaced by a struct of FEATURES, read from the stored bytes; null stays null.

    feature has the coding, duration, loudness, peak, sign changes, and the checksum of the samples at the given
    rate, which pcm holds as a WAV file (unless pcm is False). A file that can't be read raises ValueError. Rows are
    read one by one, repeated ones too; an empty table stays empty.
    """
    kept = [c for c in docs.columns if c != media_col]
    plain, names = plainly_named(docs)
    media = names[media_col]
    schema = T.StructType([*(plain.schema[names[c]] for c in kept), T.StructField("audio", T.StructType.fromDDL(FEATURES))])
    return plain.mapInArrow(lambda b: _read(b, media, "audio", pcm, rate), schema).toDF(*kept, fresh(kept, out))


def audio_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = PCM_RATE) -> DataFrame:
    """(id, n_bytes, payload and media sizes and digests, feature, pcm_bytes, pcm_sha256) for each row of docs.

    The resampled PCM is stored in a column as a file, and the last two are the size and digest of that column. Null
    text counts as empty.
    """
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("t"))
    stored = with_audio(slim, "t", "media").drop("t")
    read = decoded(stored, "media", "audio", True, rate)
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    pcm = F.octet_length("audio.pcm").cast("long").alias("pcm_bytes"), F.sha2("audio.pcm", 256).alias("pcm_sha256")
    return read.select(F.col("id").alias(id_col), "n_bytes", *(F.col(f"audio.{n}").alias(n) for n in names), *pcm)
