"""Audio columns: lossless 8-bit wave storage, polyphase resampling, overlapped log-mel filterbanks and
hysteresis energy segmentation, kept as fixed-shape Arrow tensors with time spans.

Defined results: null media gives no frames; media shorter than a frame give one zero-padded frame;
silence has no segment; every value depends on the row's own bytes only, so equal media agree.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_rows

#: Rate of stored texts: two thirds of it is what features are computed at, so resampling has two phases.
RATE = 12_000


@dataclass(frozen=True)
class AudioConfig:
    """Lengths in samples at ``rate``, which the media are resampled to."""

    rate: int = 8_000
    frame: int = 200
    hop: int = 80
    fft: int = 256
    mels: int = 32
    taps: int = 16
    block: int = 16
    high: float = 0.25
    low: float = -0.25


def write_wave(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM in a RIFF container."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(payload) % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * (len(payload) % 2)


def read_wave(media: bytes) -> tuple[int, bytes]:
    """(rate, sample bytes), found by walking the container's chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a wave file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is stored")
        elif kind == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(32)
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """Windowed-sinc low pass split into ``up`` phases of ``2 * taps`` coefficients."""
    cutoff = min(1.0, up / down)
    n = 2 * taps * up
    t = (np.arange(n) - (n - 1) / 2) / up
    h = cutoff * np.sinc(cutoff * t) * np.hanning(n + 2)[1:-1]
    phases = h.reshape(2 * taps, up).T[:, ::-1]
    return (phases / phases.sum(1, keepdims=True)).astype(np.float32)


@lru_cache(32)
def _period(up: int, down: int, taps: int) -> np.ndarray:
    """The phases as one matrix: a period of ``down`` inputs and its surroundings to ``up`` outputs."""
    out = np.zeros((down + 2 * taps, up), np.float32)
    for r, h in enumerate(_phases(up, down, taps)[(np.arange(up) * down) % up]):
        first = (r * down) // up + 1
        out[first : first + 2 * taps, r] = h
    return out


def resample(x: np.ndarray, source: int, target: int, taps: int = 16) -> np.ndarray:
    """Polyphase resampling: output p*up + r is phase (r*down mod up) times the inputs around its time; all
    outputs of a period are one row of a matrix product."""
    g = int(np.gcd(source, target))
    up, down = target // g, source // g
    if up == down or not len(x):
        return x.astype(np.float32)
    n_out = -(-len(x) * up // down)
    periods = -(-n_out // up)
    padded = np.zeros(periods * down + 2 * taps, np.float32)
    padded[taps : taps + len(x)] = x
    rows = np.lib.stride_tricks.sliding_window_view(padded, down + 2 * taps)[::down]
    return (rows[:periods] @ _period(up, down, taps)).ravel()[:n_out]


@lru_cache(8)
def _filters(cfg: AudioConfig) -> tuple[np.ndarray, np.ndarray]:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(cfg.rate / 2), cfg.mels + 2) / 2595) - 1)
    freq = np.fft.rfftfreq(cfg.fft, 1 / cfg.rate)
    rise = (freq - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - freq) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)).T.astype(np.float32), np.hanning(cfg.frame).astype(np.float32)


def log_mel(x: np.ndarray, cfg: AudioConfig) -> tuple[np.ndarray, np.ndarray]:
    """(frames x mels, frame energies in dB) of overlapped frames; the tail is zero-padded."""
    bank, window = _filters(cfg)
    n = max(1, -(-(len(x) - cfg.frame) // cfg.hop) + 1)
    x = np.pad(x, (0, max(0, (n - 1) * cfg.hop + cfg.frame - len(x))))
    frames = np.lib.stride_tricks.sliding_window_view(x, cfg.frame)[:: cfg.hop][:n]
    out = np.empty((n, cfg.mels), np.float32)
    energy = np.empty(n, np.float32)
    for lo in range(0, n, 4096):
        f = frames[lo : lo + 4096] * window
        energy[lo : lo + 4096] = 10 * np.log10(np.einsum("ij,ij->i", f, f) / cfg.frame + 1e-9)
        spectrum = np.fft.rfft(f, cfg.fft)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out[lo : lo + 4096] = np.log(power @ bank + 1e-6)
    return out, energy


def segments(energy: np.ndarray, cfg: AudioConfig) -> list[tuple[int, int]]:
    """[first, end) frames of active spans: one starts at mean + high * deviation and lasts until the
    energy falls under mean + low * deviation."""
    mean, dev = float(energy.mean()), float(energy.std())
    if dev < 1e-6:
        return []
    mark = np.where(energy >= mean + cfg.high * dev, 1, np.where(energy < mean + cfg.low * dev, 0, -1))
    at = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(at >= 0, mark[np.maximum(at, 0)], 0)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], on, [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def tensor_table(media: list[tuple[np.ndarray, list[tuple[int, int]]]], cfg: AudioConfig) -> pa.Table:
    """Blocks of all (log-mel, spans): number of the medium, start_us, end_us, segment and a fixed-shape
    [block, mels] tensor; a segment's last block is filled up with silence."""
    owner, segment, first, last, rows = [], [], [], [], []
    silence = np.full((cfg.block, cfg.mels), np.log(1e-6), np.float32)
    for m, (mel, spans) in enumerate(media):
        for k, (a, b) in enumerate(spans):
            lo = np.arange(a, b, cfg.block)
            owner += [m] * len(lo)
            segment += [k] * len(lo)
            first.append(lo)
            last.append(np.minimum(lo + cfg.block, b) - 1)
            rows += [mel[a:b], silence[: len(lo) * cfg.block - (b - a)]]
    first, last = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (first, last))
    flat = np.concatenate(rows or [silence[:0]]).astype(np.float32, copy=False).ravel()
    storage = pa.FixedSizeListArray.from_arrays(pa.array(flat), cfg.block * cfg.mels)
    kind = pa.fixed_shape_tensor(pa.float32(), [cfg.block, cfg.mels])
    us = lambda samples: pa.array((samples * 1_000_000 // cfg.rate).astype(np.int64))
    return pa.table(
        {
            "medium": pa.array(owner, pa.int32()),
            "start_us": us(first * cfg.hop),
            "end_us": us(last * cfg.hop + cfg.frame),
            "segment": pa.array(segment, pa.int32()),
            "logmel": pa.ExtensionArray.from_storage(kind, storage),
        }
    )


def to_stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def tensors(mel: np.ndarray, spans: list[tuple[int, int]], cfg: AudioConfig) -> bytes:
    """Arrow stream of one medium's blocks."""
    return to_stream(tensor_table([(mel, spans)], cfg).drop_columns("medium"))


def features(stream: bytes, n_media: int, cfg: AudioConfig) -> list[str]:
    """Of each medium, from its stored tensors and time spans: segments, active frames, and means of four mel
    bands over them."""
    table = pa.ipc.open_stream(stream).read_all().combine_chunks()
    medium, start, end = (np.asarray(table[c]).astype(np.int64) for c in ("medium", "start_us", "end_us"))
    frames = ((end - start) * cfg.rate // 1_000_000 - cfg.frame + cfg.hop // 2) // cfg.hop + 1
    column = table["logmel"].combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    tensor = column.to_numpy_ndarray() if len(table) else np.zeros((0, cfg.block, cfg.mels), np.float32)
    live = np.arange(cfg.block) < frames[:, None]
    sums = np.einsum("bfkm,bf->bk", tensor.reshape(len(tensor), cfg.block, 4, cfg.mels // 4), live.astype(np.float32), dtype=np.float64)
    total = np.zeros((n_media, 4))
    np.add.at(total, medium, sums)
    active = np.bincount(medium, frames, n_media).astype(np.int64)
    fresh = (np.diff(medium, prepend=-1) != 0) | (np.diff(np.asarray(table["segment"]), prepend=-1) != 0)
    count = np.bincount(medium, fresh, n_media).astype(np.int64)
    mean = total / np.maximum(active * (cfg.mels // 4), 1)[:, None]
    return [f"segments={n};active={a};bands=" + ",".join(f"{b:.2f}" for b in m) for n, a, m in zip(count.tolist(), active.tolist(), mean)]


def analyse(media: bytes, cfg: AudioConfig) -> tuple[np.ndarray, list[tuple[int, int]]]:
    rate, samples = read_wave(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel, energy = log_mel(resample(x, rate, cfg.rate, cfg.taps), cfg)
    return mel, segments(energy, cfg)


def audio_features(df: DataFrame, media_col: str = "media", id_col: str = "doc_id", cfg: AudioConfig = AudioConfig()) -> DataFrame:
    """doc_id, n_frames, spans (start and end in microseconds), tensors (Arrow stream) for every row."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("text"))

    def make():
        def work(ids, media):
            out = {"doc_id": ids, "n_frames": [], "spans": [], "tensors": []}
            us = 1_000_000 / cfg.rate
            for m in media:
                mel, spans = analyse(m, cfg) if m else (np.empty((0, cfg.mels), np.float32), [])
                out["n_frames"].append(len(mel))
                out["spans"].append([{"start_us": int(a * cfg.hop * us), "end_us": int(((b - 1) * cfg.hop + cfg.frame) * us)} for a, b in spans])
                out["tensors"].append(tensors(mel, spans, cfg))
            return out

        return work

    return map_rows(rows, make, "doc_id long, n_frames long, spans array<struct<start_us:long,end_us:long>>, tensors binary")


def payload_of(text: str | None, multiple: int) -> tuple[int, bytes]:
    raw = (text or "").encode()
    size = max(multiple, -(-len(raw) // multiple) * multiple)
    return len(raw), raw.ljust(size, b" ")


def store_texts(df: DataFrame, multiple: int = 192, rate: int = RATE) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, blank-padded, as the samples of a wave file."""

    def make():
        def work(ids, texts):
            made = [payload_of(t, multiple) for t in texts]
            return {"doc_id": ids, "n_bytes": [n for n, _ in made], "media": [write_wave(p, rate) for _, p in made]}

        return work

    return map_rows(documents(df), make, "doc_id long, n_bytes long, media binary")


def media_digest(stored: DataFrame, cfg: AudioConfig = AudioConfig()) -> DataFrame:
    """Read the stored media back, compute their features and digest both."""
    rows = stored.select("doc_id", F.struct("n_bytes", "media").alias("text"))

    def make():
        def work(ids, stored_rows):
            media = [row["media"] for row in stored_rows]
            samples = [read_wave(m)[1] for m in media]
            analysed = [analyse(m, cfg) for m in media]
            stored_tensors = to_stream(tensor_table(analysed, cfg))
            return {
                "doc_id": ids,
                "n_bytes": [row["n_bytes"] for row in stored_rows],
                "payload_bytes": list(map(len, samples)),
                "payload_sha256": [hashlib.sha256(x).hexdigest() for x in samples],
                "tail_crc32": [zlib.crc32(x[-16:]) for x in samples],
                "media_bytes": list(map(len, media)),
                "media_sha256": [hashlib.sha256(m).hexdigest() for m in media],
                "feature": [f"frames={len(mel)};{f}" for (mel, _), f in zip(analysed, features(stored_tensors, len(media), cfg))],
            }

        return work

    return map_rows(rows, make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
