"""Media columns: audio features of raw samples.

Each payload is 8-bit mono PCM in a WAV file. Features are computed from the samples read back
from the stored bytes: a polyphase resampler (rational factor, windowed-sinc taps), overlapped
log-mel filterbanks, and segments of sound from frame energies with hysteresis. The log-mel frames
are cut into windows of a fixed shape and stored as an Arrow fixed-shape tensor column with the time
span of each window, in an IPC stream.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import arrow_map, text_of


@dataclass(frozen=True)
class Settings:
    """Sample rates in Hz; lengths in resampled samples, frames or dB."""

    rate: int = 16_000
    up: int = 3
    down: int = 8
    taps: int = 24
    frame: int = 256
    hop: int = 128
    mels: int = 32
    window: int = 16
    on_db: float = -14.5
    off_db: float = -15.0
    block: int = 1 << 17

    @property
    def resampled(self) -> float:
        return self.rate * self.up / self.down


def write_wav(payload: bytes, rate: int) -> bytes:
    """A RIFF file of 8-bit unsigned mono samples; an odd length gets the pad byte RIFF asks for."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(payload) % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * (len(payload) % 2)


def read_wav(stored: bytes) -> tuple[int, bytes]:
    """Sample rate and sample bytes of an 8-bit mono PCM file."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(stored):
        kind, n = struct.unpack_from("<4sI", stored, at)
        if kind == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", stored, at + 8)
            if (coding, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif kind == b"data":
            return rate, stored[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no samples")


@lru_cache(maxsize=8)
def _polyphase(up: int, down: int, taps: int) -> tuple[np.ndarray, int]:
    """Matrix that takes a stretch of input to `up` outputs, and the stretch's length: one column per phase."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = up * cut * np.sinc(cut * t) * np.kaiser(n, 6.0)
    stretch = taps + (up - 1) * down // up
    m = np.zeros((stretch, up), np.float32)
    for p in range(up):
        phase, first = p * down % up, p * down // up
        own = h[phase::up][::-1]
        m[first : first + taps, p] = own
    return m, stretch


def resample(x: np.ndarray, s: Settings) -> np.ndarray:
    """Polyphase resampling by up/down; as many outputs as ceil(n * up / down)."""
    if s.up == s.down:
        return x
    m, stretch = _polyphase(s.up, s.down, s.taps)
    wanted = -(-len(x) * s.up // s.down)
    steps = -(-wanted // s.up)
    padded = np.zeros(s.taps - 1 + max(len(x), (steps - 1) * s.down + stretch), np.float32)
    padded[s.taps // 2 : s.taps // 2 + len(x)] = x
    rows = np.lib.stride_tricks.as_strided(padded, (steps, stretch), (4 * s.down, 4))
    return np.concatenate([(np.ascontiguousarray(rows[i : i + s.block // 8]) @ m).ravel() for i in range(0, steps, s.block // 8)])[:wanted]


@lru_cache(maxsize=8)
def _filterbank(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Window and triangular mel filters (frequency bins x mels)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(s.resampled / 2), s.mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(s.frame, 1 / s.resampled)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    bank = np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid)))
    return np.hanning(s.frame + 1)[:-1].astype(np.float32), bank.astype(np.float32)


def log_mel(y: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows and energies in dB of overlapped frames; the last is filled up with zeros."""
    window, bank = _filterbank(s)
    n = 1 + max(0, -(-(len(y) - s.frame) // s.hop))
    padded = np.zeros((n - 1) * s.hop + s.frame, np.float32)
    padded[: len(y)] = y
    frames = np.lib.stride_tricks.as_strided(padded, (n, s.frame), (4 * s.hop, 4))
    mels, energy = np.empty((n, s.mels), np.float32), np.empty(n, np.float32)
    step = max(1, s.block // s.frame)
    for i in range(0, n, step):
        own = frames[i : i + step] * window
        spectrum = np.fft.rfft(own, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        mels[i : i + step] = np.log(power.astype(np.float32) @ bank + np.float32(1e-6))
        energy[i : i + step] = 10 * np.log10((own * own).mean(axis=1) + np.float32(1e-10))
    return mels, energy


def segments(energy: np.ndarray, on_db: float, off_db: float) -> list[tuple[int, int]]:
    """[first, last) frames of sound: from the first above on_db until one below off_db."""
    state = np.where(energy >= on_db, 1, np.where(energy < off_db, -1, 0))
    marks = np.flatnonzero(state)
    if not len(marks):
        return []
    held = np.zeros(len(energy), np.int8)
    at = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    held[at >= 0] = state[at[at >= 0]] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], held, [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


@lru_cache(maxsize=8)
def _tensor_kind(window: int, mels: int) -> tuple[pa.DataType, int]:
    return pa.fixed_shape_tensor(pa.float32(), [window, mels]), window * mels


def tensors(mels: np.ndarray, s: Settings) -> pa.RecordBatch:
    """Windows of `window` frames as fixed-shape tensors with their spans in seconds; the last is filled up with zeros."""
    n = -(-len(mels) // s.window)
    full = np.zeros((n, s.window, s.mels), np.float32)
    full.reshape(n * s.window, s.mels)[: len(mels)] = mels
    first = np.arange(n) * s.window
    last = np.minimum(first + s.window, len(mels)) - 1
    spans = [pa.array(first * s.hop / s.resampled), pa.array((last * s.hop + s.frame) / s.resampled)]
    kind, size = _tensor_kind(s.window, s.mels)
    rows = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), size))
    return pa.RecordBatch.from_arrays([rows, *spans], names=["log_mel", "start_s", "end_s"])


def to_ipc(batch: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue()


def from_ipc(stored: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(stored).read_all().combine_chunks().to_batches()[0]


def features(stored: bytes, s: Settings) -> tuple[bytes, pa.RecordBatch, list[tuple[float, float]]]:
    """Payload, tensors and segments (seconds) of a stored WAV file."""
    _, payload = read_wav(stored)
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mels, energy = log_mel(resample(x, s), s)
    spans = [(a * s.hop / s.resampled, ((b - 1) * s.hop + s.frame) / s.resampled) for a, b in segments(energy, s.on_db, s.off_db)]
    return payload, tensors(mels, s), spans


def payload_of(data: bytes) -> bytes:
    """Zeros appended up to a positive multiple of 64."""
    return data + b"\0" * (64 if not data else -len(data) % 64)


COLUMNS = "doc_id long, n_bytes long, media binary, tensor_ipc binary, segments array<struct<start_s: double, end_s: double>>"
DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def audio(docs: DataFrame, settings: Settings = Settings(), digests: bool = False) -> DataFrame:  # noqa: B008
    """Store every whole text as audio and compute its features from what was stored.

    One row for each row of ``docs``: doc_id, n_bytes (of the text in UTF-8), media (the WAV file),
    tensor_ipc (an Arrow IPC stream of log_mel, a fixed-shape tensor of window x mels, with start_s
    and end_s), segments of sound. Null counts as empty, whose payload is 64 zeros. Null doc_ids and
    repeated rows stay as they are; other columns aren't read; an empty table gives an empty table.
    Work per text is in blocks, so memory is a small multiple of the longest text. With ``digests``
    the rows hold lengths and digests of those values instead of the values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # media and tensors are as large as the texts
                part, rows = batch.slice(at, 64), []
                for text in part.column(1):
                    data = text.as_buffer().to_pybytes() if text.is_valid and len(text.as_buffer() or b"") else b""
                    media = write_wav(payload_of(data), settings.rate)
                    payload, batch_of, spans = features(media, settings)
                    ipc = to_ipc(batch_of)
                    if digests:
                        sound = sum(b - a for a, b in spans)
                        feature = f"windows={batch_of.num_rows};segments={len(spans)};sound_s={sound:.6f};tensor={hashlib.sha256(ipc).hexdigest()[:32]}"
                        rows.append((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
                    else:
                        rows.append((len(data), media, ipc, [{"start_s": a, "end_s": b} for a, b in spans]))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] if digests else [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))]
                names = [c.strip().split(" ")[0] for c in (DIGESTS if digests else COLUMNS.split(", segments")[0] + ", segments x").split(",")]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).transform(arrow_map, run, DIGESTS if digests else COLUMNS)
