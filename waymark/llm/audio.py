"""Media columns: 8-bit audio and its features.

A payload is stored as the samples of a WAV file (unsigned 8-bit PCM, mono). Features of what is read back: polyphase
resampling, log-mel filterbanks over overlapping frames, and segments by energy with hysteresis. They are stored as an Arrow
stream for each medium: a row for each clip, with its time span, the active spans that begin in it, and its log-mel frames as a
tensor of the fixed shape CLIP_FRAMES x N_MELS. The features' digest is made of what is read back from that stream.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import column_bytes, document_batches, slices

SAMPLE_RATE, TARGET_RATE = 16_000, 8_000
TAPS = 24
FRAME, HOP, N_MELS = 256, 128, 24
CLIP_FRAMES = 64
#: Frames worked on at a time, whatever the length of the medium.
BLOCK_FRAMES = 2048
UNIT, PAD = 192, b"\x20"
#: Over the median energy of the medium, in dB.
ON_DB, OFF_DB = 1.5, 0.5


def padded(text: bytes | None) -> bytes:
    """The text followed by spaces up to a positive multiple of UNIT bytes."""
    text = text or b""
    size = max(UNIT, -(-len(text) // UNIT) * UNIT)
    return text + PAD * (size - len(text))


def write_wav(payload: bytes, rate: int = SAMPLE_RATE) -> bytes:
    """A WAV file with the payload's bytes as unsigned 8-bit samples, mono."""
    odd = len(payload) % 2
    header = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return header + payload + b"\0" * odd


def read_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of an unsigned 8-bit mono WAV file; chunks other than fmt and data are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate, kind = 12, 0, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind = struct.unpack_from("<HHIIHH", media, at + 8)
            rate = kind[2]
        if name == b"data":
            if kind is None or (kind[0], kind[1], kind[5]) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


@cache
def low_pass(up: int, down: int) -> np.ndarray:
    """A Hamming-windowed sinc of odd length for resampling by up / down, with gain `up`."""
    half = TAPS * max(up, down) // 2
    n = np.arange(-half, half + 1)
    h = np.sinc(n / max(up, down)) * np.hamming(2 * half + 1)
    return (h / h.sum() * up).astype(np.float64)


def resample(x: np.ndarray, up: int, down: int, first: int, count: int) -> np.ndarray:
    """Outputs first .. first + count - 1 of the signal at up / down times its rate; zero outside the signal.

    Polyphase: output n uses only the taps of phase n * down mod up, and each phase is a sum of short convolutions of the
    signal's residues modulo `down`.
    """
    h = low_pass(up, down)
    half = len(h) // 2
    out = np.zeros(count)
    for r in range(min(up, count)):
        n0, total = first + r, (count - r + up - 1) // up
        centre = n0 * down + half  # in the upsampled signal, for tap 0
        taps = h[centre % up :: up]
        base = centre // up  # the sample under tap 0 of this phase, for m = 0
        low = base - len(taps) + 1
        high = base + (total - 1) * down + 1
        window = np.zeros(high - low)
        a, b = max(0, low), min(len(x), high)
        if a < b:
            window[a - low : b - low] = x[a:b]
        acc = np.zeros(total)
        for s in range(min(down, len(taps))):
            part = taps[s::down]
            start = len(taps) - 1 - s - (len(part) - 1) * down
            stream = window[start : start + (total + len(part) - 2) * down + 1 : down]
            acc += np.convolve(stream, part, "valid")
        out[r::up] = acc
    return out


@cache
def mel_bank(rate: int) -> np.ndarray:
    """Triangular filters (FRAME // 2 + 1, N_MELS), evenly spaced in mel from 0 to rate / 2."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), N_MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def n_frames(samples: int, up: int, down: int) -> int:
    length = -(-samples * up // down)
    return max(1, 1 + -(-max(0, length - FRAME) // HOP))


def blocks(payload: bytes, rate: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first frame, log-mel frames as float32 rounded to 1/64 dB, energy in dB) in blocks of BLOCK_FRAMES; the values do not depend on what else is in a batch."""
    g = gcd(TARGET_RATE, rate)
    up, down = TARGET_RATE // g, rate // g
    x = np.frombuffer(payload, np.uint8)
    total = n_frames(len(x), up, down)
    window, bank = np.hanning(FRAME).astype(np.float32), mel_bank(TARGET_RATE)
    margin = TAPS * max(up, down) + down
    for f0 in range(0, total, BLOCK_FRAMES):
        f1 = min(total, f0 + BLOCK_FRAMES)
        first, count = f0 * HOP, (f1 - f0 - 1) * HOP + FRAME
        a = max(0, (first * down // up - margin) // down * down)
        b = min(len(x), (first + count) * down // up + margin)
        part = (x[a:b].astype(np.float64) - 128) / 128
        y = resample(part, up, down, first - a * up // down, count).astype(np.float32)
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        spectrum = np.fft.rfft(frames * window, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        mel = 10 * np.log10(power @ bank + 1e-6)
        around = frames - frames.mean(axis=1, keepdims=True)
        energy = 10 * np.log10(np.einsum("ij,ij->i", around, around) / FRAME + 1e-9)
        yield f0, np.round(mel * 64) / 64, energy


def segments(energy: np.ndarray, on: float = ON_DB, off: float = OFF_DB) -> list[tuple[int, int]]:
    """Half-open frame spans that begin where energy reaches `on` over its median and last until it falls under `off`."""
    level = energy - np.median(energy)
    mark = np.where(level >= on, 1, np.where(level < off, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    active = np.where(last >= 0, mark[last], 0) == 1
    change = np.flatnonzero(np.diff(np.r_[0, active.astype(np.int8), 0]))
    return list(zip(change[::2].tolist(), change[1::2].tolist()))


def analyse(media: bytes) -> tuple[bytes, int, np.ndarray, list[tuple[int, int]]]:
    """Payload, rate, log-mel frames and active spans of a stored medium."""
    payload, rate = read_wav(media)
    found = list(blocks(payload, rate))
    energy = np.concatenate([e for _, _, e in found])
    return payload, rate, np.concatenate([m for _, m, _ in found]), segments(energy)


def clips(mel: np.ndarray) -> np.ndarray:
    """Log-mel frames as clips of one shape (CLIP_FRAMES, N_MELS); the last is filled with the floor of -60 dB."""
    n = -(-len(mel) // CLIP_FRAMES)
    out = np.full((n * CLIP_FRAMES, N_MELS), -60.0, np.float32)
    out[: len(mel)] = mel
    return out.reshape(n, CLIP_FRAMES, N_MELS)


def tensor_array(values: np.ndarray) -> pa.FixedShapeTensorArray:
    return pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(values))


def pack(mel: np.ndarray, active: list[tuple[int, int]]) -> bytes:
    """An Arrow stream of one batch, a row for each clip: clip, start_s, end_s, frames, active (spans in seconds that begin in the clip), logmel (fixed-shape tensor)."""
    cut, step = clips(mel), HOP / TARGET_RATE
    first = np.arange(len(cut)) * CLIP_FRAMES
    frames = np.minimum(CLIP_FRAMES, len(mel) - first)
    spans = np.array(active, np.int64).reshape(-1, 2)
    bounds = np.r_[np.searchsorted(spans[:, 0], first), len(spans)].astype(np.int32)
    seconds = pa.StructArray.from_arrays([pa.array(spans[:, 0] * step), pa.array(spans[:, 1] * step)], ["start_s", "end_s"])
    batch = pa.record_batch({
        "clip": pa.array(np.arange(len(cut))),
        "start_s": pa.array(first * step),
        "end_s": pa.array(((first + frames - 1) * HOP + FRAME) / TARGET_RATE),
        "frames": pa.array(frames),
        "active": pa.ListArray.from_arrays(pa.array(bounds), seconds),
        "logmel": tensor_array(cut),
    })
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.RecordBatch:
    """The batch of a stream by `pack`."""
    with pa.ipc.open_stream(data) as reader:
        return reader.read_next_batch()


def spell(clip_rows: pa.RecordBatch) -> str:
    """The features as a short text: frames, clips, active segments and frames, and a digest of all tensors and time spans."""
    active = clip_rows.column("active").flatten()
    begin, end = (active.field(k).to_numpy() for k in (0, 1))
    digest = hashlib.sha256()
    for values in (clip_rows.column("logmel").to_numpy_ndarray().astype("<f4"), *(clip_rows.column(c).to_numpy().astype("<f8") for c in ("start_s", "end_s")), begin.astype("<f8"), end.astype("<f8")):
        digest.update(np.ascontiguousarray(values).tobytes())
    frames = int(np.round((end - begin).sum() * TARGET_RATE / HOP))
    return f"frames={sum(clip_rows.column('frames').to_pylist())};clips={clip_rows.num_rows};segments={len(begin)};active={frames};features={digest.hexdigest()}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): each whole text as a WAV file. Null texts are empty ones; the shortest payload is UNIT spaces."""
    document_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            texts = column_bytes(batch.column("t"))
            yield pa.record_batch([batch.column("i"), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([write_wav(padded(t)) for t in texts], pa.binary())], names=["i", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, f"i {id_type}, n_bytes long, media binary").withColumnRenamed("i", id_col)


def describe(media: DataFrame, media_col: str = "media") -> DataFrame:
    """All columns but the medium, with what its stored bytes hold: payload_bytes, payload_sha256, tail_crc32 (last 16 bytes), media_bytes, media_sha256, tensors (the stream of `pack`), feature (spelt from the stream). Null media give nulls."""
    kept = [c for c in media.columns if c != media_col]
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name != media_col)
    made = pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("tensors", pa.binary()), ("feature", pa.string())])

    def one(data: bytes | None) -> dict:
        if data is None:
            return {}
        payload, _, mel, active = analyse(data)
        packed = pack(mel, active)
        return {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "tensors": packed, "feature": spell(unpack(packed))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, media_col):
            rows = pa.RecordBatch.from_pylist([one(m) for m in batch.column(media_col).to_pylist()], schema=made)
            yield pa.record_batch([batch.column(c) for c in kept] + rows.columns, names=[*kept, *made.names])

    return media.mapInArrow(run, f"{typed}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tensors binary, feature string".removeprefix(", "))


def tensors(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each clip: (id_col, clip, start_s, end_s, active_s, logmel) with logmel as CLIP_FRAMES * N_MELS floats.

    Time spans are those of the clip's frames in the medium; active_s is the time that energy segments cover in it.
    `to_tensor_table` turns collected batches into Arrow's fixed-shape tensors. Null media have no clips.
    """
    id_type = media.schema[id_col].dataType.simpleString()
    step = HOP / TARGET_RATE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "m"):
            for k, data in enumerate(batch.column("m").to_pylist()):
                if data is None:
                    continue
                _, _, mel, active = analyse(data)
                covered = np.zeros(len(mel))
                for a, b in active:
                    covered[a:b] = step
                cut = clips(mel)
                starts = np.arange(len(cut)) * CLIP_FRAMES
                ends = np.minimum(starts + CLIP_FRAMES, len(mel))
                yield pa.record_batch([
                    pa.array([batch.column("i")[k].as_py()] * len(cut), batch.schema.field("i").type),
                    pa.array(np.arange(len(cut))),
                    pa.array(starts * step),
                    pa.array(((ends - 1) * HOP + FRAME) / TARGET_RATE),
                    pa.array(np.add.reduceat(covered, starts)),
                    pa.array(list(cut.reshape(len(cut), -1)), pa.list_(pa.float32())),
                ], names=["i", "clip", "start_s", "end_s", "active_s", "logmel"])

    rows = media.select(F.col(id_col).alias("i"), F.col(media_col).alias("m"))
    return rows.mapInArrow(run, f"i {id_type}, clip long, start_s double, end_s double, active_s double, logmel array<float>").withColumnRenamed("i", id_col)


def to_tensor_table(table: pa.Table, column: str = "logmel") -> pa.Table:
    """The table with `column` as Arrow fixed-shape tensors of (CLIP_FRAMES, N_MELS), as files and other readers keep them."""
    flat = table[column].combine_chunks().flatten() if table.num_rows else pa.array([], pa.float32())
    shaped = tensor_array(flat.to_numpy(zero_copy_only=False).reshape(-1, CLIP_FRAMES, N_MELS)) if table.num_rows else pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), (CLIP_FRAMES, N_MELS)), pa.array([], pa.list_(pa.float32(), CLIP_FRAMES * N_MELS)))
    return table.set_column(table.schema.get_field_index(column), column, shaped)
