"""Media columns: a payload stored as a WAV file of 8-bit samples, read back and fingerprinted.

Storing: UTF-8 bytes, filled with spaces to a positive multiple of BLOCK, become the samples of a mono file that
the wave module writes. Reading: the same module gives the samples; short-time Fourier transforms of frames of
two blocks, one block apart, give a magnitude spectrum; the largest bin of each of three bands is a peak if it
exceeds the frame's mean; peaks of the same band one and two frames apart form pairs (first bin, second bin,
distance), stored as two arrays: the frame of the first peak and the pair's code.

Defined results: null or empty text gives one block of spaces; very long texts are transformed in chunks of
frames, so memory follows the text's own size; equal texts give equal values; an empty table gives no rows;
repeated rows and null ids are carried through. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices, table, texts_of

BLOCK = 192
RATE = 8000
BANDS = 3
CHUNK = 4096


def to_wav(payload: bytes) -> bytes:
    """8-bit samples as a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def padded(data: bytes) -> bytes:
    return data + b" " * (max(1, -(-len(data) // BLOCK)) * BLOCK - len(data))


_WINDOW = np.hanning(2 * BLOCK).astype(np.float32)


def spectral_peaks(samples: np.ndarray) -> np.ndarray:
    """Per frame and band the bin of the peak, or -1. The signal is followed by one silent block."""
    blocks = np.concatenate([(samples.astype(np.float32) - 128) / 128, np.zeros(BLOCK, np.float32)]).reshape(-1, BLOCK)
    out = []
    for a in range(0, len(blocks) - 1, CHUNK):
        part = blocks[a : min(a + CHUNK, len(blocks) - 1) + 1]
        spectrum = np.abs(np.fft.rfft(np.concatenate([part[:-1], part[1:]], axis=1) * _WINDOW, axis=1))[:, 1 : BLOCK + 1]
        banded = spectrum.reshape(len(spectrum), BANDS, BLOCK // BANDS)
        bins = banded.argmax(axis=2)
        height = np.take_along_axis(banded, bins[:, :, None], axis=2)[:, :, 0]
        out.append(np.where(height > spectrum.mean(axis=1, keepdims=True), bins, -1))
    return np.concatenate(out)


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and codes of the peak pairs, in order of frame, band and distance."""
    peaks = spectral_peaks(samples).astype(np.int32)
    width = BLOCK // BANDS
    times, codes, order = [], [], []
    for distance in (1, 2):
        if len(peaks) <= distance:
            continue
        first, second = peaks[:-distance], peaks[distance:]
        frame, band = np.nonzero((first >= 0) & (second >= 0))
        times.append(frame)
        codes.append(((band * width + first[frame, band]) * width + second[frame, band]) * 4 + distance)
        order.append((frame * BANDS + band) * 4 + distance)
    if not times:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    at = np.argsort(np.concatenate(order), kind="stable")
    return np.concatenate(times)[at].astype(np.int32), np.concatenate(codes)[at].astype(np.int32)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def task(batches):
        for batch in slices(batches):
            data = [t.encode() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(b) for b in data], pa.int64()), pa.array([to_wav(padded(b)) for b in data], pa.binary())], schema=schema)

    return bounded(docs).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(task, "doc_id long, n_bytes long, media binary")


_READ_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fp_time array<int>, fp_code array<int>, media binary"
_READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("fp_time", pa.list_(pa.int32())), ("fp_code", pa.list_(pa.int32())), ("media", pa.binary())])


def read_back(stored: DataFrame) -> DataFrame:
    """What the stored media bytes hold: payload figures and time-coded fingerprint arrays, beside the media column itself."""

    def task(batches):
        for batch in slices(batches, column="media"):
            rows = []
            for media in batch.column("media").to_pylist():
                payload = from_wav(media)
                times, codes = fingerprint(np.frombuffer(payload, np.uint8))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), times, codes))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, f.type) for c, f in zip(columns, list(_READ)[2:-1], strict=True)), batch.column("media")], schema=_READ)

    return bounded(stored).select("doc_id", "n_bytes", "media").mapInArrow(task, _READ_DDL)


def query(spark, sf_dir):
    read = read_back(store(table(spark, sf_dir, "documents")))
    feature = F.concat_ws(":", F.size("fp_time").cast("string"), F.lower(F.hex(F.xxhash64("fp_time", "fp_code"))))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "fp_time", "fp_code", "media")
