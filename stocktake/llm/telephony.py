"""Telephony audio columns: G.711 mu-law and A-law, IMA ADPCM, PCM.

Mu-law and A-law samples expand by lookup tables of 256 entries, built from the
companding rule.  ADPCM blocks are decoded side by side: one numpy step decodes
the same sample of every block of all clips at hand.  A clip is stored as a WAVE
file; what it decodes to is resampled and stored as 16-bit PCM.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_CHARS, batch_of, over_batches, text_slices

# fixed values: format tags of WAVE files
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17
RATE, RESAMPLED = 8_000, 16_000
UNIT = 64  # payloads are padded to a multiple of this

# fixed values: index changes of the IMA ADPCM standard
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
# fixed values: step sizes of the IMA ADPCM standard
IMA_STEP = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)


@lru_cache(1)
def mulaw_table() -> np.ndarray:
    """Linear value of each mu-law byte (14-bit scale times four)."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


@lru_cache(1)
def alaw_table() -> np.ndarray:
    """Linear value of each A-law byte (13-bit scale times eight)."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(exponent == 0, low + 8, low + 264 << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def decode_adpcm(data: bytes, block: int) -> np.ndarray:
    """Mono IMA ADPCM: blocks of a 4-byte head (first sample, step index) and
    two samples a byte, low half first.  A last, shorter block is decoded as
    far as it goes; one without a whole head is ignored."""
    count = len(data) // block
    parts = []
    for body, rows in ((data[: count * block], count), (data[count * block :], 1)):
        width = len(body) // rows if rows else 0
        if width < 4:
            continue
        grid = np.frombuffer(body, np.uint8).reshape(rows, width)
        value = np.ascontiguousarray(grid[:, :2]).view("<i2").ravel().astype(np.int32)
        index = np.minimum(grid[:, 2], 88).astype(np.int32)
        nibbles = np.empty((rows, 2 * (width - 4)), np.int32)
        nibbles[:, 0::2], nibbles[:, 1::2] = grid[:, 4:] & 15, grid[:, 4:] >> 4
        out = np.empty((rows, nibbles.shape[1] + 1), np.int16)
        out[:, 0] = value
        for t in range(nibbles.shape[1]):
            code, step = nibbles[:, t], IMA_STEP[index]
            change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
            value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
            index = np.clip(index + IMA_INDEX[code], 0, 88)
            out[:, t + 1] = value
        parts.append(out.ravel())
    return np.concatenate(parts) if parts else np.zeros(0, np.int16)


#: samples that one numpy step handles; bounds the memory of long clips
STEP = 1 << 18


def resample(samples: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation between sample times, a stretch at a time."""
    if source == target or not len(samples):
        return samples
    n = len(samples) * target // source
    out = np.empty(n, np.int16)
    for lo in range(0, n, STEP):
        at = np.arange(lo, min(n, lo + STEP)) * (source / target)
        first, last = int(at[0]), min(len(samples), int(at[-1]) + 2)
        out[lo : lo + len(at)] = np.rint(np.interp(at - first, np.arange(last - first), samples[first:last]))
    return out


def wave(data: bytes, tag: int, rate: int, bits: int, block: int) -> bytes:
    """A mono WAVE file around ``data``."""
    per_block = (block - 4) * 2 + 1 if tag == IMA_ADPCM else 1
    extra = b"" if tag == PCM else struct.pack("<HH", 2, per_block) if tag == IMA_ADPCM else struct.pack("<H", 0)
    head = struct.pack("<HHIIHH", tag, 1, rate, rate * block // per_block, block, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wave(media: bytes) -> tuple[int, int, int, bytes]:
    """(format tag, rate, block size, samples' bytes) of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, found = 12, {}
    while at + 8 <= len(media):
        (size,) = struct.unpack_from("<I", media, at + 4)
        found[media[at : at + 4]] = (at + 8, size)
        at += 8 + size + size % 2
    start, size = found[b"data"]
    tag, _, rate, _, block = struct.unpack_from("<HHIIH", media, found[b"fmt "][0])
    return tag, rate, block, media[start : start + size]


def decode(media: bytes) -> tuple[np.ndarray, int]:
    """16-bit samples and rate of a stored clip."""
    return decode_all([media])[0]


def decode_all(clips: list[bytes]) -> list[tuple[np.ndarray, int]]:
    """The same of many clips; ADPCM clips of whole blocks of one size are
    decoded together."""
    out: list[tuple[np.ndarray, int]] = []
    together: dict[int, list[tuple[int, bytes]]] = {}
    for i, media in enumerate(clips):
        tag, rate, block, data = parse_wave(media)
        if tag == MULAW:
            samples = mulaw_table()[np.frombuffer(data, np.uint8)]
        elif tag == ALAW:
            samples = alaw_table()[np.frombuffer(data, np.uint8)]
        elif tag == PCM:
            samples = np.frombuffer(data, "<i2")
        elif tag == IMA_ADPCM:
            samples = np.zeros(0, np.int16)
            if len(data) % block:
                samples = decode_adpcm(data, block)
            else:
                together.setdefault(block, []).append((i, data))
        else:
            raise ValueError(f"unknown format tag {tag}")
        out.append((samples, rate))
    for block, own in together.items():
        every, at = decode_adpcm(b"".join(d for _, d in own), block), 0
        for i, data in own:
            n = len(data) // block * ((block - 4) * 2 + 1)
            out[i] = (every[at : at + n], out[i][1])
            at += n
    return out


def features(samples: np.ndarray, rate: int) -> str:
    """Duration in milliseconds, root mean square, peak, zero crossings, and the
    share of energy in eight bands of the mean spectrum of frames of 256
    samples, the last one filled up with zeros."""
    n = len(samples)
    if not n:
        return "ms=0"
    squares, peak, power = 0.0, 0, np.zeros(128)
    crossings = 0
    for at in range(0, n, STEP):  # a multiple of 256
        part = samples[at : at + STEP]
        x = part.astype(np.float32)
        squares += float(np.square(x, dtype=np.float64).sum())
        peak = max(peak, int(np.abs(x).max()))
        sign = samples[max(0, at - 1) : at + STEP] < 0
        crossings += int(np.count_nonzero(sign[1:] != sign[:-1]))
        frames = np.pad(x, (0, -len(x) % 256)).reshape(-1, 256)
        power += np.square(np.abs(np.fft.rfft(frames, axis=1)[:, 1:])).sum(axis=0)
    bands = power.reshape(8, 16).sum(axis=1)
    share = bands / bands.sum() if bands.sum() else bands
    return f"ms={n * 1000 // rate};rms={np.sqrt(squares / n):.1f};peak={peak};zc={crossings};bands=" + ",".join(f"{v:.3f}" for v in share)


#: block size of a format's WAVE file
_BLOCK = {MULAW: 1, ALAW: 1, IMA_ADPCM: UNIT}


def store_clips(docs: DataFrame, formats: tuple[int, ...] = (MULAW, ALAW, IMA_ADPCM)) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``media`` of each row (doc_id, text, any other
    columns): the text's UTF-8 bytes, padded with 0 to a positive multiple of
    64, as the coded samples of a WAVE file.

    A checksum of the bytes picks one of ``formats`` (mu-law, A-law, ADPCM in
    blocks of 64 bytes), so equal texts give equal files.  Null texts are empty;
    lone surrogates keep their bytes; null ids stay null and repeated rows give
    repeated clips; an empty table gives none.  Nothing is shuffled."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column(1)):
                media, sizes = [], []
                for text in texts:
                    raw = text.encode("utf-8", "surrogatepass")
                    payload = raw + b"\0" * (-len(raw) % UNIT if raw else UNIT)
                    tag = formats[zlib.crc32(payload) % len(formats)]
                    media.append(wave(payload, tag, RATE, 4 if tag == IMA_ADPCM else 8, _BLOCK[tag]))
                    sizes.append(len(raw))
                yield batch_of(schema, batch.column(0).slice(lo, hi - lo), sizes, media)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return over_batches(rows, run, "doc_id long, n_bytes long, media binary")


def resampled_pcm(clips: DataFrame, rate: int = RESAMPLED) -> DataFrame:
    """``clips`` (doc_id, media, any other columns) decoded, resampled and stored
    as 16-bit PCM: ``doc_id``, ``media``.  Null media stay null, null ids and
    repeated rows are kept, an empty table gives no row."""
    schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, media in _media(batch.column(1)):
                found = iter(decode_all([m for m in media if m is not None]))
                out = [None if m is None else _pcm(*next(found), rate) for m in media]
                yield batch_of(schema, batch.column(0).slice(lo, hi - lo), out)

    return over_batches(clips.select("doc_id", "media"), run, "doc_id long, media binary")


def _pcm(samples: np.ndarray, own: int, rate: int) -> bytes:
    return wave(resample(samples, own, rate).astype("<i2", copy=False).tobytes(), PCM, rate, 16, 2)


def _media(column: pa.Array) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """Ranges of clips with about ``SLICE_CHARS`` bytes each, and their bytes."""
    size = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    lo = total = 0
    for i, n in enumerate(size):
        total += n
        if total >= SLICE_CHARS or i + 1 == len(size):
            yield lo, i + 1, column.slice(lo, i + 1 - lo).to_pylist()
            lo, total = i + 1, 0


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, format int, pcm binary"


def describe(clips: DataFrame) -> DataFrame:
    """Digests, features and the resampled PCM of stored clips (doc_id, n_bytes,
    media, any other columns), all taken from the stored bytes.

    The payload is what the file's data chunk holds; ``pcm`` is a WAVE file of
    the decoded samples at ``RESAMPLED``, and the features are those of its
    samples; ``format`` is the clip's format tag.  Null ids stay null, repeated
    rows give repeated results, an empty table none; media is never null in what
    ``store_clips`` wrote."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("format", pa.int32()), ("pcm", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, clip in _media(batch.column(2)):
                out: list[list] = [[] for _ in range(8)]
                for media, (samples, rate) in zip(clip, decode_all(clip), strict=True):
                    tag, _, _, payload = parse_wave(media)
                    pcm = _pcm(samples, rate, RESAMPLED)
                    row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), features(np.frombuffer(parse_wave(pcm)[3], "<i2"), RESAMPLED), tag, pcm)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                yield batch_of(schema, batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *out)

    return over_batches(clips.select("doc_id", "n_bytes", "media"), run, DIGEST)
