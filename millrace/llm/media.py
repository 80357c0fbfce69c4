"""Media columns: bytes kept as 8-bit WAV, read by the wave module, short-time Fourier transform, spectral-peak pairs.

Stored form: one channel, 8-bit unsigned samples, 8000 a second; the payload's bytes are the samples, so nothing is lost.
Fingerprint: the spectrogram (256-sample Hann frames, hop 128; silence fills the last hop) is divided into bands; a band's loudest bin is a
peak if it is a maximum over the frames around it and above the file's mean. Peaks of one band are paired with
their next `fan` peaks within 63 frames; each pair becomes the long  frame << 32 | band << 28 | f1 << 20 | f2 << 8 | dt.

Defined cases: a null is the empty text, and its payload is 64 zero bytes; equal bytes give equal rows; media
without peaks (silence) have an empty array; columns besides the id and the content are not read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME, HOP, RATE, BLOCK = 256, 128, 8000, 64
#: First bins of the bands, and the end of the last.
BANDS = (1, 8, 20, 48, 129)
REACH = 3
_HANN = np.hanning(FRAME).astype(np.float32)


def payload_of(content: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of 64."""
    return content + b"\0" * ((-len(content)) % BLOCK or (0 if content else BLOCK))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def spectrum_peaks(samples: bytes, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Of each frame and band the loudest bin and its magnitude; `chunk` frames are transformed at a time."""
    x = np.frombuffer(samples, np.uint8)
    short = max(FRAME - len(x), -len(x) % HOP)
    if short:
        x = np.concatenate([x, np.full(short, 128, np.uint8)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    bins = np.empty((len(frames), len(BANDS) - 1), np.int64)
    loud = np.empty(bins.shape, np.float32)
    for at in range(0, len(frames), chunk):
        part = (frames[at : at + chunk].astype(np.float32) - 128) * _HANN
        power = np.abs(np.fft.rfft(part, axis=1))
        for b, (lo, hi) in enumerate(zip(BANDS, BANDS[1:], strict=False)):
            band = power[:, lo:hi]
            best = band.argmax(1)
            bins[at : at + chunk, b] = best + lo
            loud[at : at + chunk, b] = band[np.arange(len(band)), best]
    return bins, loud


def fingerprint(samples: bytes, fan: int = 2) -> np.ndarray:
    """Time-coded peak pairs, sorted, as longs."""
    bins, loud = spectrum_peaks(samples)
    n = len(loud)
    padded = np.pad(loud, ((REACH, REACH), (0, 0)), constant_values=-1)
    around = np.max([padded[d : d + n] for d in range(2 * REACH + 1)], axis=0)
    peak = (loud >= around) & (loud > loud.mean(0)) & (loud > 0)
    found = []
    for b in range(loud.shape[1]):
        t = np.flatnonzero(peak[:, b])
        f = bins[t, b]
        for k in range(1, fan + 1):
            dt = t[k:] - t[:-k]
            ok = dt < 64
            found.append((t[:-k][ok] << 32) | (b << 28) | (f[:-k][ok] << 20) | (f[k:][ok] << 8) | dt[ok])
    return np.sort(np.concatenate(found)).astype(np.int64)


SCHEMA = "id long, wav binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, fingerprint array<bigint>"


def fingerprints(df: DataFrame, id_col: str = "doc_id", content_col: str = "text") -> DataFrame:
    """One row per row: the stored WAV, digests of what is read back from it, and its fingerprint. No shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):  # bounds what one output batch holds
                rows = []
                for i, content in zip(batch["id"].iloc[at : at + 256], batch["content"].iloc[at : at + 256], strict=True):
                    content = bytes(content)
                    stored = to_wav(payload_of(content))
                    back = from_wav(stored)
                    rows.append((i, stored, len(content), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), fingerprint(back)))
                yield pd.DataFrame(rows, columns=["id", "wav", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "fingerprint"])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(content_col).cast("binary"), F.lit(b"")).alias("content"))
    return src.mapInPandas(run, SCHEMA).withColumnRenamed("id", id_col)


def media_digest(documents: DataFrame) -> DataFrame:
    """The rows that op4 returns: digests of the stored form and of the fingerprint."""
    got = fingerprints(documents)
    coded = F.array_join(F.transform("fingerprint", lambda x: F.hex(x)), ",")
    return got.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.length("wav").cast("long").alias("media_bytes"), F.sha2("wav", 256).alias("media_sha256"),
        F.concat(F.size("fingerprint").cast("string"), F.lit(":"), F.sha2(coded, 256)).alias("feature"),
        F.size("fingerprint").cast("long").alias("n_pairs"),
    )
