"""Audio features of media columns: polyphase resampling, overlapped log-mel filterbanks and hysteresis segmentation.

A media value is a payload of bytes stored losslessly as a WAV file of one channel of 8-bit samples.
Features come from the samples read back: they are resampled by ``UP / DOWN`` with a windowed-sinc
polyphase filter, cut into overlapping Hann windows, and each frame's power goes through a mel
filterbank to decibels. Segments are runs of frames over ``LOW_DB`` (relative to the mean level) that
reach ``HIGH_DB`` somewhere. Log-mel frames are stored as tensors of the fixed shape (``BLOCK`` frames,
``MELS`` bands), the last one padded with the floor, each with its span of time. Long payloads go through
in pieces of ``PIECE`` frames; what is held at once is a small multiple of the one payload.

Cases: a null or empty text is a payload of padding only; equal texts give equal values; rows are
independent, so repeated rows and ties need no rule; an empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from waymark.llm.common import documents, map_texts, python_batches, record, schemas

RATE, UP, DOWN, TAPS = 16_000, 2, 3, 12
WINDOW, HOP, MELS, BLOCK = 256, 128, 24, 32
HIGH_DB, LOW_DB, FLOOR = 3.0, 1.0, 1e-6
PIECE = 4096
UNIT = 192


def payload(text: str | None) -> bytes:
    """UTF-8 bytes of the text with spaces up to a positive multiple of ``UNIT``."""
    raw = (text or "").encode()
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A WAV file of one channel of unsigned 8-bit samples."""
    body = samples + b"\0" * (len(samples) & 1)
    head = b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples))
    return b"RIFF" + struct.pack("<I", len(head) + len(body)) + head + body


def from_wav(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of a WAV file of one channel of 8-bit samples; other files raise ValueError."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("not one channel of 8-bit samples")
        elif kind == b"data":
            if rate is None or at + 8 + size > len(media):
                break
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("broken WAV file")


@lru_cache
def _filters():
    """(polyphase matrix, Hann window, mel matrix)."""
    n = 2 * TAPS * UP + 1
    t = (np.arange(n) - n // 2) / UP
    cut = min(1, UP / DOWN)
    low = np.sinc(t * cut) * cut * np.hamming(n)
    # Output UP * q + p sits at input DOWN * q + p * DOWN / UP; a row of inputs around DOWN * q makes UP outputs.
    width = 2 * TAPS + DOWN + 1
    bank = np.zeros((width, UP), np.float32)
    for p in range(UP):
        for i in range(width):
            k = round((p * DOWN / UP - (i - TAPS)) * UP) + n // 2
            if 0 <= k < n:
                bank[i, p] = low[k]
    hann = np.hanning(WINDOW + 1)[:-1].astype(np.float32)
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(50), mel(rate / 2), MELS + 2) / 2595) - 1) * WINDOW / rate
    bins = np.arange(WINDOW // 2 + 1)[:, None]
    rise, fall = (bins - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - bins) / np.diff(edges)[1:]
    return bank, hann, np.clip(np.minimum(rise, fall), 0, None).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """``x`` at ``UP / DOWN`` times its rate; samples outside count as 0."""
    bank = _filters()[0]
    rows = -(-len(x) // DOWN)
    padded = np.zeros(rows * DOWN + len(bank), np.float32)
    padded[TAPS : TAPS + len(x)] = x
    out = np.empty((rows, UP), np.float32)
    for a in range(0, rows, 1 << 14):
        b = min(rows, a + (1 << 14))
        part = padded[a * DOWN : (b - 1) * DOWN + len(bank)]
        out[a:b] = np.lib.stride_tricks.as_strided(part, (b - a, len(bank)), (4 * DOWN, 4)) @ bank
    return out.reshape(-1)[: -(-len(x) * UP // DOWN)]


def log_mel(y: np.ndarray) -> np.ndarray:
    """(frames, MELS) of decibels of overlapping windows; the last one is padded with zeros."""
    _, hann, mel = _filters()
    frames = max(1, -(-(len(y) - WINDOW) // HOP) + 1)
    padded = np.zeros((frames - 1) * HOP + WINDOW, np.float32)
    padded[: len(y)] = y
    out = np.empty((frames, MELS), np.float32)
    for a in range(0, frames, PIECE):
        b = min(frames, a + PIECE)
        part = padded[a * HOP : (b - 1) * HOP + WINDOW]
        cut = np.lib.stride_tricks.as_strided(part, (b - a, WINDOW), (4 * HOP, 4)) * hann
        spectrum = np.fft.rfft(cut, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        out[a:b] = 10 * np.log10(power.astype(np.float32) @ mel + FLOOR)
    return out


def segments(level: np.ndarray, high: float, low: float) -> list[tuple[int, int]]:
    """[begin, end) of the runs of frames at ``low`` or more that reach ``high`` somewhere."""
    over = np.zeros(len(level) + 2, bool)
    over[1:-1] = level >= low
    edge = np.flatnonzero(over[1:] != over[:-1])
    hits = np.r_[0, np.cumsum(level >= high)]
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2]) if hits[b] > hits[a]]


class Features:
    """Features of a media file of 8-bit samples: ``mel`` (frames, MELS), ``spans`` of active seconds, ``blocks()``."""

    def __init__(self, media: bytes):
        self.samples, self.rate = from_wav(media)
        x = np.frombuffer(self.samples, np.uint8).astype(np.float32)
        x -= 128
        x /= 128
        if len(x):
            x -= x.mean(dtype=np.float64).astype(np.float32)
        self.mel = log_mel(resample(x))
        self.step = HOP * DOWN / UP / self.rate
        level = self.mel.mean(axis=1)
        mean = float(level.mean(dtype=np.float64))
        self.level = mean
        self.frames_active = segments(level, mean + HIGH_DB, mean + LOW_DB)
        self.spans = [(a * self.step, b * self.step) for a, b in self.frames_active]

    def blocks(self):
        """(begin, end, tensor): seconds, and BLOCK * MELS values in row-major order."""
        for a in range(0, len(self.mel), BLOCK):
            part = self.mel[a : a + BLOCK]
            full = np.full((BLOCK, MELS), 10 * np.log10(FLOOR), np.float32)
            full[: len(part)] = part
            yield a * self.step, (a + len(part)) * self.step, full.reshape(-1)

    def summary(self) -> str:
        """One line of rounded figures."""
        bands = self.mel.reshape(len(self.mel), 4, -1).mean(axis=(0, 2), dtype=np.float64)
        active = sum(b - a for a, b in self.frames_active)
        return f"frames={len(self.mel)};level={self.level:.2f};bands={','.join(f'{v:.2f}' for v in bands)};segments={len(self.spans)};active={active}"


@lru_cache
def tensor_type() -> pa.DataType:
    """The Arrow type of a block of log-mel frames."""
    return pa.fixed_shape_tensor(pa.float32(), (BLOCK, MELS), dim_names=("frame", "mel"))


@lru_cache
def _file_schema() -> pa.Schema:
    return pa.schema([("begin_s", pa.float64()), ("end_s", pa.float64()), ("log_mel", tensor_type())])


def to_tensors(f: Features) -> bytes:
    """An Arrow stream of a media file's blocks: begin_s, end_s and a fixed-shape tensor of log-mel frames."""
    begin, end, blocks = zip(*f.blocks())
    flat = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(blocks)), BLOCK * MELS)
    schema, sink = _file_schema(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_batch(pa.record_batch([pa.array(begin), pa.array(end), pa.ExtensionArray.from_storage(tensor_type(), flat)], schema=schema))
    return sink.getvalue().to_pybytes()


def from_tensors(stored: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(spans, tensors) of :func:`to_tensors`: an array of begin and end, and one of (blocks, BLOCK, MELS)."""
    table = pa.ipc.open_stream(stored).read_all()
    if table.schema != _file_schema():
        raise ValueError("not log-mel blocks")
    spans = np.stack([table["begin_s"].to_numpy(), table["end_s"].to_numpy()], axis=1)
    return spans, table["log_mel"].combine_chunks().to_numpy_ndarray()


def to_media(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and media binary: each text's payload as a WAV file."""
    return map_texts(df, id_col, text, "media binary", _to_media)


def _to_media():
    return lambda t: (to_wav(payload(t)),)


def map_media(df: DataFrame, media: str, id_col: str, fields: str, make) -> DataFrame:
    """``id_col`` and ``fields`` for each row with media; ``make()`` gives a function from a media file to rows (tuples)."""
    python_batches(df.sparkSession)
    kind, arrow = schemas(f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {fields}")

    def run(batches):
        f = make()
        for batch in batches:
            for key, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if m is not None and (rows := list(f(m))):
                    yield record(arrow, [[key] * len(rows), *zip(*rows)])

    return df.select(id_col, media).mapInArrow(run, kind)


def feature_files(df: DataFrame, media: str = "media", id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and tensors, the Arrow stream of :func:`to_tensors`, of each row with media."""
    return map_media(df, media, id_col, "tensors binary", _files)


def _files():
    return lambda m: [(to_tensors(Features(m)),)]


def feature_blocks(df: DataFrame, media: str = "media", id_col: str = "doc_id") -> DataFrame:
    """``id_col``, begin_s, end_s and log_mel (``BLOCK * MELS`` values) of each block, for queries; rows without media give none."""
    return map_media(df, media, id_col, "begin_s double, end_s double, log_mel array<float>", _blocks)


def _blocks():
    return lambda m: Features(m).blocks()


def active_spans(df: DataFrame, media: str = "media", id_col: str = "doc_id") -> DataFrame:
    """``id_col``, begin_s and end_s of each active segment."""
    return map_media(df, media, id_col, "begin_s double, end_s double", _spans)


def _spans():
    return lambda m: Features(m).spans


DIGESTS = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_blocks bigint, tensor_sha256 string, active_s double"


def digests(text: str) -> tuple:
    """Stores a text's payload and its features, reads both back, and sums up what came back."""
    media = to_wav(payload(text))
    f = Features(media)
    back = f.samples
    spans, tensors = from_tensors(to_tensors(f))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    stored = np.round(spans, 6).tobytes() + (np.round(tensors, 1) + np.float32(0)).tobytes()
    active = round(sum(end - begin for begin, end in f.spans), 6)
    return len(text.encode()), len(back), sha(back), zlib.crc32(back[-16:]), len(media), sha(media), f.summary(), len(spans), sha(stored), active


def _digests():
    return digests


def op1_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_texts(documents(spark, sf_dir), "doc_id", "text", DIGESTS, _digests)


QUERIES = {"op1_audio": op1_audio}
