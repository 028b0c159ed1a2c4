"""Media columns: texts as 8-bit WAV files, read by the wave module, with spectral-peak pair fingerprints.

Each file is read back, cut into frames, transformed (short-time Fourier transform with a Hann window), and the
strongest bins that are local maxima in frequency become peaks. Each peak is paired with the peaks of the next
frames; a pair is stored as one integer time code: frame << 24 | first bin << 16 | second bin << 8 | gap.

Defined cases: a null text is empty and gives one block of spaces; equal texts give equal values; long texts
are processed whole; rows that repeat are processed alike; an empty table gives an empty result; columns other
than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import map_batches, with_names

BLOCK = 192
FRAME, HOP, PEAKS, FAN = 192, 96, 3, 2
RATE = 8000
#: Frames transformed at once; bounds a task's memory on long files.
FRAMES_AT_ONCE = 4096


def to_wav(payload: bytes) -> bytes:
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


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw)), len(raw)


WINDOW = np.hanning(FRAME).astype(np.float32)


def peaks_of(samples: np.ndarray) -> np.ndarray:
    """The ``PEAKS`` strongest local maxima of each frame's spectrum, by bin; 0 where a frame has fewer."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.zeros((len(frames), PEAKS), np.int64)
    for at in range(0, len(frames), FRAMES_AT_ONCE):
        part = frames[at : at + FRAMES_AT_ONCE].astype(np.float32)
        spectrum = np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * WINDOW, axis=1))
        middle = spectrum[:, 1:-1]
        # rounded, so that the choice does not hang on the last bits of a machine's arithmetic
        height = np.where((middle > spectrum[:, :-2]) & (middle >= spectrum[:, 2:]), np.round(middle, 2), 0.0)
        best = np.argsort(-height, axis=1, kind="stable")[:, :PEAKS]
        out[at : at + len(part)] = np.where(np.take_along_axis(height, best, axis=1) > 0, best + 1, 0)
    return out


def fingerprint(payload: bytes) -> np.ndarray:
    """Time-coded peak pairs, ascending."""
    peaks = peaks_of(np.frombuffer(payload, np.uint8).astype(np.float32) - 128)
    codes = []
    for gap in range(1, FAN + 1):
        first, second = peaks[:-gap], peaks[gap:]
        if not len(first):
            continue
        frame = np.arange(len(first), dtype=np.int64)[:, None, None] << 24
        pair = frame | first[:, :, None] << 16 | second[:, None, :] << 8 | gap
        codes.append(pair[(first[:, :, None] > 0) & (second[:, None, :] > 0)])
    return np.sort(np.concatenate(codes)) if codes else np.zeros(0, np.int64)


def _convert(batch: pa.RecordBatch, keep: bool) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in range(9)]
    for text in batch.column("text").to_pylist():
        payload, size = padded(text)
        media = to_wav(payload)
        back = from_wav(media)
        marks = fingerprint(back)
        row = (size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(marks)}:{hashlib.md5(marks.astype('<i8').tobytes()).hexdigest()}", marks if keep else None, media if keep else None)
        for c, v in zip(cols, row, strict=True):
            c.append(v)
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.binary()]
    arrays = [batch.column("id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))]
    return pa.RecordBatch.from_arrays(arrays, names=["id", *"n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature fingerprint media".split()])


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Per row: the payload's digests as read back, ``feature`` (number and digest of the peak pairs) and, unless
    ``keep`` is off, the stored WAV file (``media``) and ``fingerprint`` (array of time-coded peak pairs)."""
    docs = with_names(docs, id=id_col, text=text_col)
    schema = f"id {docs.schema['id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fingerprint array<long>, media binary"
    return map_batches(docs, lambda batch: _convert(batch, keep), schema, rows=500)
