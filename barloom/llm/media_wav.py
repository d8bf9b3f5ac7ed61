"""Operator 8, media columns: WAV samples and spectral-peak fingerprints.

A text's UTF-8 bytes, filled up with zero bytes to a positive multiple of 64,
are stored as 8-bit mono samples of a WAV file in a binary column of a table on
shared storage.  What follows reads that table: the wave module gives the
samples back.  A short-time Fourier transform (Hann window),
with half a frame of silence at both ends so that every sample counts and the
shortest payload has five frames, gives in each frame the strongest bin of some frequency bands; those that top
the same band in both neighbouring frames are peaks.  Each peak is paired with
the peaks of the following frames, and the pairs are kept with their time as
an array of (time, hash), where the hash holds both bins and the time between.

Defined results: a null text is empty and is stored as 64 zero bytes.  Silence
(a spectrum of zeros) has no peaks.  Equal texts give equal values.  Long texts
are transformed in blocks of frames, so memory follows the samples, not the
spectrum.  Repeated rows each get a row.  Other columns are not read, whatever
their names.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, materialise, slices, text_or_empty

UNIT = 64
RATE = 8000
FRAME = 48
HOP = 16
#: Bins are those of frames filled up with zeros to this size.
BINS = 256
BANDS = ((2, 12), (12, 32), (32, 64), (64, 129))
AHEAD = 3
BLOCK_FRAMES = 4096
#: Values of about so many bytes are worked on at once.
SLICE_BYTES = 2 << 20
MEDIA = "doc_id long, n_bytes long, media binary"


def padded(raw: bytes, unit: int = UNIT) -> bytes:
    return raw.ljust(max(1, -(-len(raw) // unit)) * unit, b"\0")


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


_TURN = np.exp(-2j * np.pi * np.outer(np.arange(FRAME), np.arange(BANDS[-1][1])) / BINS) * np.hanning(FRAME)[:, None]
_REAL, _IMAG = _TURN.real.astype(np.float32), _TURN.imag.astype(np.float32)


def band_peaks(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each frame and band the strongest bin and its power."""
    samples = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    samples = np.pad(samples, (FRAME // 2, FRAME // 2 + -len(samples) % HOP))
    n = 1 + (len(samples) - FRAME) // HOP
    frames = np.lib.stride_tricks.as_strided(samples, (n, FRAME), (HOP * samples.itemsize, samples.itemsize))
    bins, power = np.empty((n, len(BANDS)), np.int64), np.empty((n, len(BANDS)), np.float32)
    for at in range(0, n, BLOCK_FRAMES):
        some = np.ascontiguousarray(frames[at : at + BLOCK_FRAMES])
        strength = (some @ _REAL) ** 2 + (some @ _IMAG) ** 2
        for b, (low, high) in enumerate(BANDS):
            best = strength[:, low:high].argmax(axis=1) + low
            bins[at : at + BLOCK_FRAMES, b] = best
            power[at : at + BLOCK_FRAMES, b] = strength[np.arange(len(best)), best]
    return bins, power


def peak_pairs(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times and hashes of the pairs, in order of time, first bin, second bin and distance."""
    bins, power = band_peaks(payload)
    edge = np.full((1, power.shape[1]), -1, np.float32)
    peak = (power > 1e-3) & (power > np.concatenate([edge, power[:-1]])) & (power >= np.concatenate([power[1:], edge]))
    times, hashes = [], []
    for step in range(1, AHEAD + 1):
        if step >= len(bins):
            break
        for one in range(len(BANDS)):
            for two in range(len(BANDS)):
                t = np.flatnonzero(peak[:-step, one] & peak[step:, two])
                times.append(t)
                hashes.append(bins[t, one] << 16 | bins[t + step, two] << 8 | step)
    if not times:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    t, h = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((h, t))
    return t[order].astype(np.int32), h[order].astype(np.int32)


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): whole texts as WAV files in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", SLICE_BYTES):
                raw = some.column("text").cast(pa.large_binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array([to_wav(padded(r)) for r in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, MEDIA)


def fingerprint_media(media: DataFrame) -> DataFrame:
    """Read the stored files: the media columns, the payload's digests, and the pairs as arrays time and hash."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, time array<int>, hash array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "media", SLICE_BYTES):
                files = some.column("media").to_pylist()
                payloads = [from_wav(f) for f in files]
                pairs = [peak_pairs(p) for p in payloads]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(t) for t, _ in pairs])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc_id"), some.column("n_bytes"), pa.array([len(p) for p in payloads], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                        pa.array([zlib.crc32(p[-UNIT:]) for p in payloads], pa.int64()), pa.array([len(f) for f in files], pa.int64()), pa.array([hashlib.sha256(f).hexdigest() for f in files]),
                        *[pa.ListArray.from_arrays(ends, pa.array(np.concatenate([p[i] for p in pairs]))) for i in (0, 1)],
                    ],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "time", "hash"],
                )

    return media.mapInArrow(run, schema)


def store_media(docs: DataFrame) -> DataFrame:
    """The table of ``to_media`` on shared storage, read back from it."""
    return materialise(to_media(docs), "media")
