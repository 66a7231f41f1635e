"""Recordings and frame-wise recogniser output: decoding, loudness, CTC decoding and alignment, locating and cutting names.

Waveforms are arrays of floats at RATE; log-probabilities are frames x symbols. The kernels are NumPy functions of one
recording; the Arrow functions below apply them to columns, a recording a row. Models are not part of this: what they gave
is the input.
"""

from __future__ import annotations

import io
import wave
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE, FRAME = 16_000, 320
_WIDTHS = {1: ("u1", 128.0, 128.0), 2: ("<i2", 0.0, 32768.0), 4: ("<i4", 0.0, 2147483648.0)}


def decode(data: bytes, rate: int = RATE) -> np.ndarray:
    """Mono samples of a PCM WAV file, linearly interpolated to the rate. 24-bit files are widened."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, own, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    if width == 3:
        padded = np.zeros((len(raw) // 3, 4), dtype=np.uint8)
        padded[:, 1:] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3)
        raw, width = padded.tobytes(), 4
    kind, zero, full = _WIDTHS[width]
    y = ((np.frombuffer(raw, dtype=kind).astype(np.float64) - zero) / full).reshape(-1, channels).mean(axis=1)
    if own != rate and len(y):
        n = round(len(y) * rate / own)
        y = np.interp(np.arange(n) * own / rate, np.arange(len(y)), y)
    return y.astype(np.float32)


def encode(y: np.ndarray, rate: int = RATE) -> bytes:
    """A 16-bit mono WAV file; samples beyond full scale are clipped."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.rint(np.asarray(y, dtype=np.float64) * 32768), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def loudness_range(y: np.ndarray, frame: int = 400, hop: int = 160) -> float:
    """Decibels between the loud (90th percentile) and the quiet (10th) frames; 0 if there is no frame."""
    starts = np.arange(0, len(y) - frame, hop)
    if not len(starts):
        return 0.0
    sums = np.append(0.0, np.cumsum(np.square(y, dtype=np.float64)))
    energy = np.maximum((sums[starts + frame] - sums[starts]) / frame, 0.0) + 1e-10
    low, high = np.percentile(energy, [10, 90])
    return float(10 * np.log10(high / low))


def peaks(y: Column, width: int) -> Column:
    """Largest absolute value in each of `width` equal stretches, for drawing; empty stretches give 0."""
    n = F.size(y)
    bound = lambda i: F.floor(i * n / width).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.array_max(F.transform(F.slice(y, bound(i) + 1, bound(i + 1) - bound(i)), lambda v: F.abs(v))), F.lit(0.0)))


@dataclass(frozen=True)
class Symbols:
    """Names of a recogniser's outputs; those in angle brackets are no text, `delimiter` is a space."""

    names: list[str]
    blank: int
    delimiter: str = "|"

    def text(self, i: int) -> str:
        name = self.names[i] if i < len(self.names) else ""
        return " " if name == self.delimiter else "" if name.startswith("<") else name

    def ids(self, text: str) -> tuple[list[int], list[int]]:
        """Outputs that spell a text and their places in it; a run of spaces counts once, unknown characters are skipped."""
        number = {name: i for i, name in enumerate(self.names) if not name.startswith("<")}
        out: list[tuple[int, int]] = []
        space = number.get(self.delimiter)
        for at, c in enumerate(text):
            i = space if c.isspace() else number.get(c)
            if i is not None and not (i == space and (not out or out[-1][0] == space)):
                out.append((i, at))
        return [i for i, _ in out], [at for _, at in out]


def emitted(logp: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """(frames, outputs): frames whose likeliest output differs from the one before and is not blank."""
    best = np.asarray(logp).argmax(axis=1) if len(logp) else np.zeros(0, dtype=np.int64)
    new = np.append(True, best[1:] != best[:-1])[: len(best)] & (best != blank)
    return np.flatnonzero(new), best[new]


def transcript(logp: np.ndarray, symbols: Symbols, joined_by: str = "") -> tuple[str, float]:
    """Text and mean probability of what was emitted; joined_by=" " lists phones, without brackets and delimiters."""
    at, out = emitted(logp, symbols.blank)
    texts = [symbols.text(i) for i in out]
    if joined_by:
        kept = [k for k, t in enumerate(texts) if t.strip()]
        at, out, texts = at[kept], out[kept], [texts[k] for k in kept]
    return joined_by.join(texts).strip(), float(np.exp(np.asarray(logp)[at, out]).mean()) if len(at) else 0.0


def align(logp: np.ndarray, ids: list[int], blank: int) -> tuple[list[tuple[int, int]], float]:
    """First and last frame of each output on the best path through them, and the path's mean log-probability.

    Ties prefer to stay, then the step, then the leap over a blank. Outputs that the path can't reach take the last frame
    of the one before.
    """
    if not ids or not len(logp):
        return [], 0.0
    logp = np.asarray(logp, dtype=np.float64)
    label = np.full(2 * len(ids) + 1, blank)
    label[1::2] = ids
    leap = np.zeros(len(label), dtype=bool)
    leap[3::2] = label[3::2] != label[1:-2:2]
    score = np.full(len(label), -np.inf)
    score[:2] = logp[0, label[:2]]
    steps = np.zeros((len(logp), len(label)), dtype=np.int8)
    for t in range(1, len(logp)):
        ways = np.full((3, len(label)), -np.inf)
        ways[0], ways[1, 1:] = score, score[:-1]
        ways[2, 2:] = np.where(leap[2:], score[:-2], -np.inf)
        steps[t] = ways.argmax(axis=0)
        score = ways.max(axis=0) + logp[t, label]
    at = len(label) - 1 if score[-1] >= score[-2] else len(label) - 2
    total = float(score[at])
    path = np.zeros(len(logp), dtype=np.int64)
    for t in range(len(logp) - 1, -1, -1):
        path[t] = at
        at -= int(steps[t, at])
    spans: list[tuple[int, int]] = []
    for k in range(len(ids)):
        mine = np.flatnonzero(path == 2 * k + 1)
        last = spans[-1][1] if spans else 0
        spans.append((int(mine[0]), int(mine[-1])) if len(mine) else (last, last))
    return spans, total / len(logp)


def locate(heard: str, name: str) -> tuple[int, int, float] | None:
    """(start, end exclusive, distance by length) of the part of heard nearest to a name without spaces; None if there is none.

    Spaces heard cost nothing. Ties go to the first end; each cell carries the start of its way, so nothing is traced back.
    """
    target = name.replace(" ", "")
    cells = [(0, j) for j in range(len(heard) + 1)]
    for i, c in enumerate(target, 1):
        row = [(i, 0)]
        for j, h in enumerate(heard, 1):
            ways = (cells[j - 1][0] + (c != h), cells[j - 1][1]), (row[j - 1][0] + (h != " "), row[j - 1][1]), (cells[j][0] + 1, cells[j][1])
            row.append(min(ways, key=lambda w: w[0]))
        cells = row
    end = min(range(len(cells)), key=lambda j: cells[j][0])
    if not end:
        return None
    cost, start = cells[end]
    part = heard[start:end]
    start, end = start + len(part) - len(part.lstrip(" ")), start + len(part.rstrip(" "))
    return (start, end, cost / max(1, len(target))) if start < end else None


def quietest(y: np.ndarray, first: int, last: int) -> int:
    """The frame of least energy from first to last, the first of equals; first if the range is empty."""
    first = max(0, first)
    frames = range(first, max(first, last) + 1)
    part = lambda f: y[max(0, f * FRAME - FRAME // 2) :][:FRAME]
    return min(frames, key=lambda f: float(np.mean(np.square(part(f), dtype=np.float64))) if len(part(f)) else 0.0)


def cut(y: np.ndarray, logp: np.ndarray, symbols: Symbols, name: str, before_s: float = 0.05, after_s: float = 0.03) -> dict | None:
    """Where a name is in a recording: start and end sample, what was heard, its distance. None if it is not heard.

    The ends go to the quietest frame between the name's outer outputs and their neighbours, then out by a little.
    """
    at, out = emitted(logp, symbols.blank)
    texts = [symbols.text(i) for i in out]
    at = [int(a) for a, t in zip(at, texts, strict=True) if t]
    texts = [t for t in texts if t]
    owner = [k for k, t in enumerate(texts) for _ in t]
    found = locate("".join(texts), name)
    if found is None:
        return None
    i, j = owner[found[0]], owner[found[1] - 1]
    left = at[i - 1] if i else max(0, at[i] - 12)
    right = at[j + 1] if j + 1 < len(at) else min(len(logp) - 1, at[j] + 12)
    a = quietest(y, max(left, at[i] - 14), max(left, at[i] - 2))
    b = quietest(y, at[j] + 1, max(at[j] + 1, min(right, at[j] + 12)))
    return {"start": max(0, int(a * FRAME - before_s * RATE)), "end": min(len(y), int(b * FRAME + after_s * RATE)), "heard": "".join(texts[i : j + 1]), "distance": found[2]}


def cut_aligned(y: np.ndarray, logp: np.ndarray, symbols: Symbols, text: str, start: int, end: int, margin_s: float = 0.04) -> dict | None:
    """Where text[start:end] is in a recording of the text, by alignment. None if none of it can be aligned."""
    ids, places = symbols.ids(text)
    spans, score = align(logp, ids, symbols.blank)
    mine = [s for s, i, p in zip(spans, ids, places, strict=False) if start <= p < end and symbols.text(i) != " "]
    if not mine:
        return None
    return {"start": max(0, int(mine[0][0] * FRAME - margin_s * RATE)), "end": min(len(y), int((mine[-1][1] + 1) * FRAME + margin_s * RATE)), "score": score}


def with_noise(y: np.ndarray, snr_db: float, seed: int = 1) -> np.ndarray:
    """y with white noise at a signal-to-noise ratio."""
    noise = np.random.Generator(np.random.PCG64(seed)).standard_normal(len(y))
    power = lambda x: float(np.mean(np.square(x, dtype=np.float64))) + 1e-9 if len(x) else 1e-9
    return (y + noise * np.sqrt(power(y) / 10 ** (snr_db / 10) / power(noise))).astype(np.float32)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def samples(data: pa.Array) -> pa.Array:
    """Mono samples of WAV files; null stays null."""
    return pa.array([None if x is None else decode(x) for x in data.to_pylist()], pa.list_(pa.float32()))


@F.arrow_udf(T.BinaryType())
def wav(y: pa.Array) -> pa.Array:
    return pa.array([None if x is None else encode(np.asarray(x, dtype=np.float32)) for x in y.to_pylist()], pa.binary())


@F.arrow_udf(T.DoubleType())
def snr_db(y: pa.Array) -> pa.Array:
    """Loudness range of each array of samples; null stays null."""
    return pa.array([None if x is None else loudness_range(np.asarray(x, dtype=np.float32)) for x in y.to_pylist()], pa.float64())


@F.arrow_udf(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("distance", T.DoubleType())]))
def located(heard: pa.Array, name: pa.Array) -> pa.Array:
    found = [None if h is None or n is None else locate(h, n) for h, n in zip(heard.to_pylist(), name.to_pylist(), strict=True)]
    return pa.array([f and dict(zip(("start", "end", "distance"), f, strict=True)) for f in found], pa.struct([("start", pa.int32()), ("end", pa.int32()), ("distance", pa.float64())]))


LOGP = "array<array<float>>"


def _frames(x: list | None) -> np.ndarray:
    return np.asarray(x, dtype=np.float64) if x else np.zeros((0, 0))


def transcribed(symbols: Symbols, joined_by: str = ""):
    """A column function: struct(text, conf) of log-probabilities (frames x outputs); null stays null."""
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("conf", T.DoubleType())])

    @F.arrow_udf(kind)
    def run(logp: pa.Array) -> pa.Array:
        found = [None if x is None else transcript(_frames(x), symbols, joined_by) for x in logp.to_pylist()]
        return pa.array([f and {"text": f[0], "conf": f[1]} for f in found], pa.struct([("text", pa.string()), ("conf", pa.float64())]))

    return run


def aligned(symbols: Symbols):
    """A column function of (log-probabilities, text): struct(spans of first and last frame, score); null stays null."""
    span = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])

    @F.arrow_udf(T.StructType([T.StructField("spans", T.ArrayType(span)), T.StructField("score", T.DoubleType())]))
    def run(logp: pa.Array, text: pa.Array) -> pa.Array:
        out = []
        for x, t in zip(logp.to_pylist(), text.to_pylist(), strict=True):
            spans, score = ([], 0.0) if x is None or t is None else align(_frames(x), symbols.ids(t)[0], symbols.blank)
            out.append(None if x is None or t is None else {"spans": [{"first": a, "last": b} for a, b in spans], "score": score})
        return pa.array(out, pa.struct([("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("score", pa.float64())]))

    return run


def name_cut(symbols: Symbols):
    """A column function of (samples, log-probabilities, name): struct(start, end, heard, distance, clip); null where the name isn't heard."""
    kind = T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("start", "end")), T.StructField("heard", T.StringType()), T.StructField("distance", T.DoubleType()), T.StructField("clip", T.ArrayType(T.FloatType()))])

    @F.arrow_udf(kind)
    def run(y: pa.Array, logp: pa.Array, name: pa.Array) -> pa.Array:
        out = []
        for a, x, t in zip(y.to_pylist(), logp.to_pylist(), name.to_pylist(), strict=True):
            wave = np.asarray(a or [], dtype=np.float32)
            found = None if a is None or x is None or t is None else cut(wave, _frames(x), symbols, t)
            out.append(found and {**found, "clip": wave[found["start"] : found["end"]].tolist()})
        return pa.array(out, pa.struct([("start", pa.int32()), ("end", pa.int32()), ("heard", pa.string()), ("distance", pa.float64()), ("clip", pa.list_(pa.float32()))]))

    return run


def span_label(prefix: Column, start: Column, end: Column) -> Column:
    """A clip's label: what it is from and its place in samples, like `a#100-900`."""
    return F.format_string("%s#%d-%d", prefix, start, end)
