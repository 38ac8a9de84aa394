"""Media columns: WAV samples, short-time Fourier transform, spectral-peak pair fingerprints (operator 2).

A payload (the UTF-8 bytes of a text, filled up with bytes 255 to a positive multiple of `unit`) is stored as unsigned
8-bit mono samples of a WAV file by the wave module and read back from it. Frames of `frame` samples, `hop` apart, are windowed and
transformed; in each frame the `peaks` strongest local maxima over the mean magnitude of the frame are kept. A peak is
paired with the peaks of the next `ahead` frames; a pair is the number (f1 << 20 | f2 << 8 | frames between) and stands
with the time code of its first peak. The transform goes over a payload in runs of frames, so a long text needs no more
memory than its samples and pairs.

Defined cases: a null text is empty, its payload is `unit` bytes of 255. Equal texts give equal values.
Rows with the same doc_id, and equal rows, each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparloom.llm.common import free_name, per_text

UNIT = 576
RATE = 8000
FRAME, HOP, PEAKS, AHEAD = 512, 256, 3, 3
RUN = 2048  # frames that are transformed at once
_WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def payload_of(text: bytes, unit: int = UNIT) -> bytes:
    return text + b"\xff" * (-len(text) % unit if text else unit)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        return w.readframes(w.getnframes())


def peak_table(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, frequency bin) of the peaks, in the order of frames and bins."""
    times, bins = [], []
    n = 1 + max(0, -(-(len(samples) - FRAME) // HOP))
    padded = np.full((n - 1) * HOP + FRAME, 127.5, np.float32)
    padded[: len(samples)] = samples
    for i in range(0, n, RUN):
        m = min(RUN, n - i)
        part = padded[i * HOP : (i + m - 1) * HOP + FRAME]
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        power = np.abs(np.fft.rfft((frames - 127.5) * _WINDOW, axis=1)).astype(np.float32)
        power[:, :2] = 0  # the level of the samples
        inner = power[:, 1:-1]
        top = (inner > power[:, :-2]) & (inner >= power[:, 2:]) & (inner > power.mean(axis=1, keepdims=True))
        score = np.where(top, inner, 0)
        best = np.argpartition(score, -PEAKS, axis=1)[:, -PEAKS:]
        best.sort(axis=1)
        row, col = np.nonzero(np.take_along_axis(score, best, axis=1) > 0)
        times.append(row + i)
        bins.append(best[row, col] + 1)
    return np.concatenate(times).astype(np.int64), np.concatenate(bins).astype(np.int64)


def pair_prints(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(time codes int32, hashes int32) of the peak pairs, ordered by time and hash."""
    t, f = peak_table(np.frombuffer(payload, np.uint8))
    codes, hashes = [], []
    for step in range(1, PEAKS * (AHEAD + 1)):  # the step-th peak after each
        if step >= len(t):
            break
        gap = t[step:] - t[:-step]
        use = (gap > 0) & (gap <= AHEAD)
        codes.append(t[:-step][use])
        hashes.append(f[:-step][use] << 20 | f[step:][use] << 8 | gap[use])
    if not codes:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    code, value = np.concatenate(codes), np.concatenate(hashes)
    order = np.lexsort((value, code))
    return code[order].astype(np.int32), value[order].astype(np.int32)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT, rate: int = RATE) -> DataFrame:
    """Per row of docs: doc_id, n_bytes long, media binary (the WAV file), payload binary (read back from it), times and prints array<int>."""
    ident = free_name(docs, "_doc")
    ints = pa.list_(pa.int32())

    def make():
        def work(texts):
            media = [to_wav(payload_of(t, unit), rate) for t in texts]
            back = [from_wav(m) for m in media]
            pairs = [pair_prints(p) for p in back]
            return {"n_bytes": [len(t) for t in texts], "media": pa.array(media, pa.binary()), "payload": pa.array(back, pa.binary()), "times": pa.array([x[0] for x in pairs], ints), "prints": pa.array([x[1] for x in pairs], ints)}

        return work

    out = per_text(docs.withColumn(ident, docs[id_col]), text_col, [ident], "n_bytes long, media binary, payload binary, times array<int>, prints array<int>", make)
    return out.withColumnRenamed(ident, "doc_id")
