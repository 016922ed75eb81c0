"""Audio columns: lossless 8-bit storage, polyphase resampling, log-mel tiles, energy segments.

``store`` wraps bytes as 8-bit PCM samples in a RIFF/WAVE file and ``load`` reads them back.
``features`` resamples with a polyphase FIR filter, takes overlapped windowed spectra to log-mel
bands, stores them as an Arrow column of fixed-shape tensors (``TILE`` frames x ``MELS`` bands, the
last one padded with its floor) with the time span of each, reads that column back, describes it,
and finds active segments by hysteresis on the frame energy.

``media_columns`` gives for each row the stored file, the stored tensor column (an Arrow IPC stream),
the spans and the description; ``media_digest`` the same without the two stored forms, of which it
has sizes and hashes; ``media_tiles`` one row for each tile.

Signals are worked through, and tensors stored, in blocks of a fixed number of frames, so memory is
bounded for any length (but for the stored forms where they are asked for) and equal signals give
equal bits wherever they stand in a batch.

Definitions.  A null value is an empty one.  Payloads are padded with 255 to a positive multiple
of ``PAD`` bytes.  Ids may be null or repeat; each row stands for itself.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilark.functions.cluster import ship
from profilark.llm import textscan as ts
from profilark.llm.columns import named, typed

PAD = 576
MELS, TILE = 40, 64
BLOCK_FRAMES = 2048


def pad(data: bytes, unit: int = PAD) -> bytes:
    return data + b"\xff" * (-len(data) % unit or (unit if not data else 0))


def store(payload: bytes, rate: int) -> bytes:
    """A mono 8-bit PCM WAVE file of the payload."""
    odd = b"\0" * (len(payload) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(odd), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return b"".join((head, payload, odd))


def load(media: bytes) -> tuple[memoryview, int]:
    """The samples and the rate of a mono 8-bit PCM WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate, view = 12, 0, memoryview(media)
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif kind == b"data":
            return view[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@dataclass(frozen=True)
class Bank:
    """Filters for one pair of rates; times in samples of the target rate."""

    rate: int = 8000
    target: int = 12000
    window: int = 300  # 25 ms
    hop: int = 120  # 10 ms
    fft: int = 512
    taps: int = 8  # input samples on each side of a resampled one
    up: int = field(init=False)
    down: int = field(init=False)
    phases: np.ndarray = field(init=False, repr=False)
    taper: np.ndarray = field(init=False, repr=False)
    mel: np.ndarray = field(init=False, repr=False)
    bins: np.ndarray = field(init=False, repr=False)  # spectrum bins of the filters' weights, band after band
    weights: np.ndarray = field(init=False, repr=False)
    bands: np.ndarray = field(init=False, repr=False)  # where each band's weights begin

    def __post_init__(self):
        g = gcd(self.rate, self.target)
        up, down = self.target // g, self.rate // g
        cut = min(1.0, self.target / self.rate)
        # row p: weights of input samples -taps+1 .. taps around phase p / up
        t = np.arange(-self.taps + 1, self.taps + 1)[None, :] - np.arange(up)[:, None] / up
        h = cut * np.sinc(cut * t) * np.i0(8.0 * np.sqrt(np.clip(1 - (t / self.taps) ** 2, 0, 1))) / np.i0(8.0)
        h /= h.sum(1, keepdims=True)
        to_mel = lambda f: 2595 * np.log10(1 + f / 700)
        edge = 700 * (10 ** (np.linspace(to_mel(20.0), to_mel(min(self.rate, self.target) / 2), MELS + 2) / 2595) - 1)
        f = np.fft.rfftfreq(self.fft, 1 / self.target)[:, None]
        bank = np.maximum(0, np.minimum((f - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - f) / (edge[2:] - edge[1:-1])))
        for k, v in {"up": up, "down": down, "phases": h.astype(np.float32), "taper": np.hanning(self.window + 1)[:-1].astype(np.float32), "mel": bank.astype(np.float32)}.items():
            object.__setattr__(self, k, v)
        used = self.mel > 0
        used[0] |= ~used.any(0)  # a band narrower than a bin has one weight of 0
        band, bins = np.nonzero(used.T)
        for k, v in {"bins": bins, "weights": self.mel[bins, band], "bands": np.searchsorted(band, np.arange(MELS))}.items():
            object.__setattr__(self, k, v)

    def frames(self, samples: int) -> int:
        """Frames of a signal; one at least, the last padded with silence."""
        return max(1, -(-max(0, -(-samples * self.up // self.down) - self.window) // self.hop) + 1)

    def resample(self, x: np.ndarray, first: int, count: int) -> np.ndarray:
        """Resampled values ``first`` .. of the signal (silence beyond its ends)."""
        cycles0, cycles1 = first // self.up, -(-(first + count) // self.up)
        lo = cycles0 * self.down - self.taps + 1
        hi = cycles1 * self.down + self.taps + 1
        part = np.zeros(hi - lo, np.float32)
        a, b = max(lo, 0), min(hi, len(x))
        if b > a:
            part[a - lo : b - lo] = x[a:b]
            part[a - lo : b - lo] -= 127.5
            part[a - lo : b - lo] /= 127.5
        out = np.empty((cycles1 - cycles0, self.up), np.float32)
        for j in range(self.up):
            shift, phase = divmod(j * self.down, self.up)
            row = np.correlate(part[shift:], self.phases[phase], "valid")
            out[:, j] = row[:: self.down][: len(out)]
        return out.ravel()[first - cycles0 * self.up :][:count]

    def to_bands(self, power: np.ndarray) -> np.ndarray:
        """The bands' energies of every frame, each summed in one fixed order: the bits of a matrix product
        depend on the library's threads, on the processor and on how many frames stand in the block."""
        return np.add.reduceat(power.take(self.bins, axis=1) * self.weights, self.bands, axis=1)

    def log_mel(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (frames x MELS log energies, frame energies in dB)."""
        total = self.frames(len(x))
        for first in range(0, total, BLOCK_FRAMES):
            n = min(BLOCK_FRAMES, total - first)
            y = self.resample(x, first * self.hop, (n - 1) * self.hop + self.window)
            view = np.lib.stride_tricks.sliding_window_view(y, self.window)[:: self.hop]
            spectrum = np.fft.rfft(view * self.taper, self.fft, axis=1)
            power = spectrum.real**2 + spectrum.imag**2
            yield np.log(self.to_bands(power) + np.float32(1e-6)), 10 * np.log10(power.sum(1) + np.float32(1e-6))


DEFAULT = Bank()


def segments(energy: np.ndarray, rise: float = 1.0, fall: float = -1.0, least: int = 3) -> np.ndarray:
    """(first, last) frames of active runs: entered above mean + rise dB, left below mean + fall dB, ``least`` frames long or more."""
    mean = float(np.mean(energy, dtype=np.float64))
    mark = np.where(energy > mean + rise, 1, np.where(energy < mean + fall, -1, 0))
    at = np.where(mark != 0, np.arange(len(mark)), -1)
    np.maximum.accumulate(at, out=at)
    on = (at >= 0) & (mark[at] == 1)
    edge = np.diff(np.concatenate([[0], on, [0]]).astype(np.int8))
    runs = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], axis=1)
    return runs[runs[:, 1] - runs[:, 0] + 1 >= least]


TENSOR = pa.fixed_shape_tensor(pa.float32(), (TILE, MELS))
TILES = pa.schema([("tensor", TENSOR), ("from_ms", pa.int64()), ("to_ms", pa.int64())])
FLOOR = np.log(np.float32(1e-6))


def store_tiles(mel: np.ndarray, first: int, ms: int) -> pa.Buffer:
    """Frames (from frame ``first`` on) as an Arrow stream of tensors with their time spans."""
    n = -(-len(mel) // TILE)
    values = np.full((n * TILE, MELS), FLOOR, np.float32)
    values[: len(mel)] = mel
    start = first + np.arange(n, dtype=np.int64) * TILE
    end = np.minimum(start + TILE, first + len(mel))
    batch = pa.RecordBatch.from_arrays([pa.FixedShapeTensorArray.from_numpy_ndarray(values.reshape(n, TILE, MELS)), pa.array(start * ms), pa.array(end * ms)], schema=TILES)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, TILES) as out:
        out.write_batch(batch)
    return sink.getvalue()


def load_tiles(stored: pa.Buffer | bytes) -> pa.RecordBatch:
    """The tensors and spans of such a stream."""
    with pa.ipc.open_stream(stored) as stream:
        return stream.read_next_batch()


def features(samples: np.ndarray, bank: Bank = DEFAULT) -> tuple[Iterator, dict]:
    """Stored blocks of tiles, one after another, and a summary that is complete when they have been taken."""
    ms = 1000 * bank.hop // bank.target
    summary: dict = {}

    def run() -> Iterator[pa.Buffer]:
        energies, total, squares, n = [], np.zeros(MELS), 0.0, 0
        sha, stored_sha, size, spans = hashlib.sha256(), hashlib.sha256(), 0, []
        for mel, energy in bank.log_mel(samples):
            energies.append(energy)
            stored = store_tiles(mel, n, ms)
            back = load_tiles(stored)
            mel = back.column(0).to_numpy_ndarray().reshape(-1, MELS)[: len(mel)]
            spans.append(np.stack([back.column(1).to_numpy(), back.column(2).to_numpy()], axis=1))
            total += mel.sum(0, dtype=np.float64)
            squares += float((mel.astype(np.float64) ** 2).sum())
            n += len(mel)
            sha.update(np.round(mel * 16).astype("<i2").tobytes())
            stored_sha.update(stored)
            size += stored.size
            yield stored
        found = segments(np.concatenate(energies))
        on = np.zeros(n + 1, np.int64)
        for a, b in found:
            on[a + 1 : b + 2] = 1
        np.cumsum(on, out=on)
        spans = np.concatenate(spans)
        active = (on[spans[:, 1] // ms] - on[spans[:, 0] // ms]) * ms
        mean = total / n
        deviation = float(np.sqrt(max(0.0, squares / (n * MELS) - float((total.sum() / (n * MELS)) ** 2))))
        summary.update(frames=n, mean=mean, deviation=deviation, sha=sha.hexdigest(), found=found, spans=np.column_stack([spans, active]), tensor_bytes=size, tensor_sha=stored_sha.hexdigest())

    return run(), summary


def describe(found: np.ndarray, summary: dict, bank: Bank = DEFAULT) -> str:
    """The features of a signal in one line."""
    ms = 1000 * bank.hop // bank.target
    active = int((found[:, 1] - found[:, 0] + 1).sum()) if len(found) else 0
    first = f"{found[0, 0] * ms}-{(found[0, 1] + 1) * ms}" if len(found) else "-"
    mel = ",".join(f"{v:.2f}" for v in summary["mean"].reshape(8, -1).mean(1))
    return f"frames={summary['frames']};hop_ms={ms};mel={mel};sd={summary['deviation']:.2f};segments={len(found)};active_ms={active * ms};first_ms={first};logmel_sha256={summary['sha']}"


_SPANS = "array<struct<from_ms: long, to_ms: long, active_ms: long>>"
_DIGEST = f"n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_segments long, duration_ms long, n_tiles long, tensor_bytes long, tensor_sha256 string, spans {_SPANS}"
_TABLE = "media binary, tile int, from_ms long, to_ms long, active_ms long, tensor array<float>"
_SPAN = pa.list_(pa.struct([("from_ms", pa.int64()), ("to_ms", pa.int64()), ("active_ms", pa.int64())]))


def _digest(bank: Bank, keep: bool):
    names = ["id", *(c.split()[0] for c in _DIGEST.split("<")[0].split(", "))] + ["media", "tensors"] * keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in ts.slices(whole, "data"):
                rows, spans, held = [], [], []
                for value in part.column(1):
                    data = value.as_py() or b""
                    media = store(pad(data), bank.rate)
                    payload, rate = load(media)
                    blocks, x = features(np.frombuffer(payload, np.uint8), bank)
                    kept = [b for b in blocks if keep]
                    rows.append((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), describe(x["found"], x, bank), len(x["found"]), 1000 * len(payload) // rate, len(x["spans"]), x["tensor_bytes"], x["tensor_sha"]))
                    spans.append(x["spans"])
                    if keep:
                        held.append((media, [b.to_pybytes() for b in kept]))
                ptr = np.append(0, np.cumsum([len(x) for x in spans])).astype(np.int32)
                flat = np.concatenate(spans)
                span = pa.ListArray.from_arrays(pa.array(ptr), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], fields=list(_SPAN.value_type)))
                out = [part.column(0), *(pa.array(list(x)) for x in zip(*rows)), span]
                if keep:
                    out += [pa.array([m for m, _ in held], pa.binary()), pa.array([b for _, b in held], pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def _tiles(bank: Bank):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(len(whole)):
                media = store(pad(whole.column(1)[i].as_py() or b""), bank.rate)
                samples = np.frombuffer(load(media)[0], np.uint8)
                blocks, x = features(samples, bank)
                for _ in blocks:  # spans are known when all has been seen
                    pass
                first, (again, _) = 0, features(samples, bank)
                for stored in again:
                    flat = load_tiles(stored).column(0).storage.flatten()
                    k = np.arange(first, first + len(flat) // (TILE * MELS))
                    first += len(k)
                    yield pa.RecordBatch.from_arrays(
                        [
                            whole.column(0).take(pa.array([i] * len(k), pa.int64())),
                            pa.array([media if j == 0 else None for j in k.tolist()], pa.binary()),
                            pa.array(k.astype(np.int32)),
                            *(pa.array(np.ascontiguousarray(x["spans"][k, c])) for c in range(3)),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * TILE * MELS), flat),
                        ],
                        names=["id", "media", "tile", "from_ms", "to_ms", "active_ms", "tensor"],
                    )

    return run


def _input(docs: DataFrame, id_col: str, data_col: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(named(id_col).alias("id"), named(data_col).cast("binary").alias("data"))


def media_digest(docs: DataFrame, id_col: str = "doc_id", data_col: str = "text", bank: Bank = DEFAULT) -> DataFrame:
    """One row per input row: checksums of payload and stored forms, the features in one line, the tiles' spans."""
    rows = _input(docs, id_col, data_col)
    return rows.mapInArrow(_digest(bank, False), typed(rows, "id", _DIGEST)).withColumnRenamed("id", id_col)


def media_columns(docs: DataFrame, id_col: str = "doc_id", data_col: str = "text", bank: Bank = DEFAULT) -> DataFrame:
    """As ``media_digest``, with the stored file (``media``) and the stored blocks of tensors (``tensors``, for ``load_tiles``)."""
    rows = _input(docs, id_col, data_col)
    return rows.mapInArrow(_digest(bank, True), typed(rows, "id", _DIGEST + ", media binary, tensors array<binary>")).withColumnRenamed("id", id_col)


def media_tiles(docs: DataFrame, id_col: str = "doc_id", data_col: str = "text", bank: Bank = DEFAULT) -> DataFrame:
    """One row per tile: its time span, active time and values; the stored file stands with tile 0."""
    rows = _input(docs, id_col, data_col)
    return rows.mapInArrow(_tiles(bank), typed(rows, "id", _TABLE)).withColumnRenamed("id", id_col)


def tensor_table(tiles: pa.Table) -> pa.Table:
    """Arrow table of ``media_tiles`` rows with ``tensor`` as a fixed-shape tensor column (TILE x MELS)."""
    kind = TENSOR
    flat = tiles.column("tensor").combine_chunks()
    values = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    storage = pa.FixedSizeListArray.from_arrays(values.cast(pa.float32()), TILE * MELS)
    at = tiles.schema.get_field_index("tensor")
    return tiles.set_column(at, pa.field("tensor", kind), pa.ExtensionArray.from_storage(kind, storage))
