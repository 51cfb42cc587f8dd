"""Audio columns: bytes held as 8-bit samples in WAV form, and features of the stored sound.

Features: 2:1 polyphase resampling, overlapped log-mel filterbanks, and segments of sound found by an energy
threshold with hysteresis. They are kept as an Arrow stream of fixed-shape tensors (clips of `CLIP` frames by
`MELS` bands of half-precision logarithms, the last clip filled up with the floor value) with each clip's time span.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkveil.llm.common import bytes_array, map_slices, text_rows

RATE, UNIT, FILLER = 16_000, 576, b"\xff"
FRAME, HOP, FFT, MELS, CLIP = 200, 80, 256, 24, 64  # at half the rate
TAPS, FLOOR, FRAMES_AT_ONCE = 32, 1e-6, 8192
#: Segments begin at HIGH and end below LOW decibels under the loudest frame.
HIGH, LOW = -6.0, -12.0
_WAV = struct.Struct("<4sI4s4sIHHIIHH4sI")


def to_wav(samples: bytes) -> bytes:
    return _WAV.pack(b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples


def from_wav(wav: bytes) -> bytes:
    head = _WAV.unpack_from(wav)
    if head[0] != b"RIFF" or head[2] != b"WAVE" or head[10] != 8:
        raise ValueError("not 8-bit WAV")
    return wav[_WAV.size : _WAV.size + head[12]]


@lru_cache(maxsize=1)
def _filters() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The low-pass filter's even and odd taps, the frame window, and the mel bands."""
    t = np.arange(TAPS) - (TAPS - 1) / 2
    low = np.sinc(t / 2) / 2 * np.hamming(TAPS)
    low /= low.sum()
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(RATE / 4), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FFT, 2 / RATE)[:, None]
    bands = np.clip(np.minimum((f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])), 0, None)
    return low[0::2], low[1::2], np.hanning(FRAME), bands


def resample(x: np.ndarray) -> np.ndarray:
    """Half the rate: each phase of the samples meets its own half of the taps, so no dropped sample is computed."""
    even, odd, _, _ = _filters()
    x = x if len(x) % 2 == 0 else np.append(x, 0)
    late = np.concatenate([[0.0], x[1:-1:2]])  # the odd taps meet the samples before the even ones
    return np.convolve(x[0::2], even)[: len(x) // 2] + np.convolve(late, odd)[: len(x) // 2]


def log_mel(x: np.ndarray) -> np.ndarray:
    _, _, window, bands = _filters()
    if len(x) < FRAME:
        x = np.pad(x, (0, FRAME - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.empty((len(frames), MELS))
    for i in range(0, len(frames), FRAMES_AT_ONCE):
        spectrum = np.fft.rfft(frames[i : i + FRAMES_AT_ONCE] * window, FFT)
        out[i : i + FRAMES_AT_ONCE] = np.log((spectrum.real**2 + spectrum.imag**2) @ bands + FLOOR)
    return out


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """[begin, end) frames of sound: from a frame of at least HIGH on, and back, to where it falls below LOW."""
    energy = 10 / np.log(10) * np.log(np.exp(mel).sum(1))
    energy -= energy.max()
    above = np.concatenate([[False], energy >= LOW, [False]])
    edges = np.flatnonzero(above[1:] != above[:-1])
    return [(int(a), int(b)) for a, b in zip(edges[0::2], edges[1::2], strict=True) if (energy[a:b] >= HIGH).any()]


def tensors(mel: np.ndarray) -> bytes:
    """Clips as an Arrow stream: mel (fixed-shape tensor, float16), begin_ms, end_ms."""
    n = -(-len(mel) // CLIP)
    clips = np.full((n * CLIP, MELS), np.log(FLOOR), np.float16)
    clips[: len(mel)] = mel
    begin = np.arange(n) * CLIP
    ms = lambda frame: pa.array(frame * HOP * 2000 // RATE, pa.int64())
    table = pa.table({"mel": pa.FixedShapeTensorArray.from_numpy_ndarray(clips.reshape(n, CLIP, MELS)), "begin_ms": ms(begin), "end_ms": ms(np.minimum(begin + CLIP, len(mel)))})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary WAV): each text's UTF-8 bytes, filled with byte 255 up to a positive multiple of 576.

    Null and empty texts: 576 filler samples. Repeated rows and null ids stay; extra columns are ignored. Narrow.
    """

    def write(rows: pa.RecordBatch) -> pa.RecordBatch:
        raw = [t.encode() for t in rows.column("text").to_pylist()]
        wavs = [to_wav(r.ljust(max(1, -(-len(r) // UNIT)) * UNIT, FILLER)) for r in raw]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), bytes_array(wavs)], ["doc_id", "n_bytes", "media"])

    return map_slices(text_rows(docs), write, "doc_id long, n_bytes long, media binary")


def mel_frames(stream: bytes) -> np.ndarray:
    """The frames of a stored tensor stream, without those that fill up the last clip."""
    table = pa.ipc.open_stream(stream).read_all()
    clips = table["mel"].combine_chunks().to_numpy_ndarray()
    return clips.reshape(-1, MELS)[: round(table["end_ms"][-1].as_py() * RATE / (2000 * HOP))]


def features(stored: DataFrame) -> DataFrame:
    """Per stored sound: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, spans of sound (ms) and tensors.
    Each sound is worked on alone, so equal sounds have equal values.
    """

    def read(rows: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(7)]
        for wav in rows.column("media").to_pylist():
            payload = from_wav(wav)
            mel = log_mel(resample((np.frombuffer(payload, np.uint8) - 128.0) / 128))
            spans = [{"begin_ms": a * HOP * 2000 // RATE, "end_ms": b * HOP * 2000 // RATE} for a, b in segments(mel)]
            values = [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(wav), hashlib.sha256(wav).hexdigest(), spans, tensors(mel)]
            for column, value in zip(out, values, strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin_ms", pa.int64()), ("end_ms", pa.int64())])), pa.binary()]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "spans", "tensors"]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("n_bytes"), *[pa.array(v, k) for v, k in zip(out, kinds, strict=True)]], ["doc_id", "n_bytes", *names])

    return map_slices(stored, read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, spans array<struct<begin_ms:long,end_ms:long>>, tensors binary", column="media")


def digests(stored: DataFrame) -> DataFrame:
    """The columns of stored features, with a short text form (feature) of their spans and tensors in place of these."""
    kept = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]

    def read(rows: pa.RecordBatch) -> pa.RecordBatch:
        n_spans = [len(s) for s in rows.column("spans").to_pylist()]
        mels = [mel_frames(t) for t in rows.column("tensors").to_pylist()]
        text = [f"frames={len(m)} segments={n} mel=" + ",".join(f"{v:.2f}" for v in m.mean(0, dtype=np.float64)) for m, n in zip(mels, n_spans, strict=True)]
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array(text, pa.string())], [*kept, "feature"])

    kinds = dict(stored.dtypes)
    return map_slices(stored.select(*kept, "spans", "tensors"), read, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", feature string", column="tensors")
