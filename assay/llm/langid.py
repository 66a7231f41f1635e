"""Language identification with spans: script ranges, per-word scores, Viterbi with a switching penalty.

The model counts character trigrams (words padded by a space, lower case, hashed into `BUCKETS` cells) of a bounded sample
of labelled rows. A word's script, from fixed code-point ranges, leaves only the languages that were seen in that script;
its score for each of them is the sum of the trigrams' log probabilities. Viterbi over all the words of a text, where each
change of language costs `SWITCH`, labels spans. The text's language is the one with most letters, and its score is that
language's share of the letters; marks such as vowel signs belong to the letters they follow and count with them.

Cases: a null text or one without a letter gets `und`, score 0 and no spans; a word in a script no learned language has
favours none; ties go to the language first in the alphabet; with nothing to learn from, every text is `und`; repeated
rows get the same answer; columns named like the results are replaced by identify() and keep their own values in
keep_identified(); texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm import kit

BUCKETS = 1 << 15
#: Nats that a change of language costs.
SWITCH = 10.0
#: The classifier is fitted on about so many labelled rows, by a hash of the id; the rest of its input is not read as text.
SAMPLE_ROWS = 12_000
#: A learned language must hold this share of a script's letters, within its own letters, to be a candidate there.
SCRIPT_SHARE = 0.01
MAX_LANGUAGES = 256
UND = "und"


@dataclass
class Model:
    languages: list[str]
    trigrams: np.ndarray  # BUCKETS x languages, log probabilities
    allowed: np.ndarray  # scripts x languages


def _words(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Folded code points, starts of texts, starts and ends of words, script of each word, hashed trigram at each code point."""
    raw, starts = kit.code_points(texts)
    letter, mark = kit.letters()[raw], kit.marks()[raw]
    low = np.where(letter, kit.folded()[raw], np.where(mark, raw, np.uint32(32)))
    change = np.diff((letter | mark).astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    so_far = np.append(0, np.cumsum(letter))
    some = so_far[end] > so_far[begin]  # marks alone are no word
    begin, end = begin[some], end[some]
    script = np.where(raw[begin] < 0x10000, kit.scripts()[np.minimum(raw[begin], 0xFFFF)], 0)  # a word begins in its script
    padded = np.concatenate([[np.uint32(32)], low, [np.uint32(32)]]).astype(np.uint32)
    h = padded[:-2] * np.uint32(0x9E3779B1) ^ padded[1:-1] * np.uint32(0x85EBCA77) ^ padded[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x27D4EB2F)
    return starts, begin, end, script, (h >> np.uint32(17)).astype(np.int32)


def fit(df: DataFrame, use: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the rows where use holds and text and lang are not null, or from about sample_rows of them."""
    rows = df.where(use & F.col(text).isNotNull() & F.col(lang).isNotNull())
    n = rows.count()
    share = min(1.0, sample_rows / max(n, 1))
    picked = rows.where(F.pmod(F.xxhash64(F.lit("langid"), F.col(key)), F.lit(1 << 20)) < int(share * (1 << 20) + 1)).select(F.col(lang).alias("l"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part in kit.slices(batch, "t"):
                langs = part.column("l").to_pylist()
                for name in dict.fromkeys(langs):
                    _, begin, end, script, h = _words([t for t, x in zip(kit.texts_of(part, "t"), langs, strict=True) if x == name])
                    grams, by_script = sums.setdefault(name, (np.zeros(BUCKETS, dtype=np.int64), np.zeros(len(kit.SCRIPTS) + 1, dtype=np.int64)))
                    inside = np.repeat(begin - np.cumsum(end - begin) + (end - begin), end - begin) + np.arange((end - begin).sum())
                    grams += np.bincount(h[inside], minlength=BUCKETS)
                    by_script += np.bincount(script, weights=end - begin, minlength=len(by_script)).astype(np.int64)
            batch = part = None
        kit.release()
        for name, (grams, by_script) in sums.items():
            all_ = np.concatenate([grams, by_script])
            at = np.flatnonzero(all_)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(all_[at])], names=["l", "cell", "n"])

    # At most MAX_LANGUAGES x (BUCKETS + scripts) rows, whatever the corpus.
    counted = kit.cut(picked.mapInArrow(run, "l string, cell int, n long").groupBy("l", "cell").agg(F.sum("n").alias("n")))
    names = sorted(r[0] for r in counted.select("l").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros((BUCKETS + len(kit.SCRIPTS) + 1, len(names)))
    got = counted.toArrow()
    counts[np.asarray(got["cell"]), np.searchsorted(np.array(names, dtype=object), np.array(got["l"].to_pylist(), dtype=object)) if names else []] = np.asarray(got["n"])
    grams, by_script = counts[:BUCKETS], counts[BUCKETS:]
    allowed = by_script >= SCRIPT_SHARE * np.maximum(by_script.sum(axis=0), 1)
    return Model(names, np.log((grams + 0.1) / (grams.sum(axis=0) + 0.1 * BUCKETS)).astype(np.float32), allowed & (by_script > 0))


def _path(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word. Texts are stepped through side by side, the longest first."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    active = np.searchsorted(-sizes[order], -np.arange(1, sizes.max(initial=0) + 1), side="right")
    heads = first[:-1][order]
    came = np.zeros(scores.shape, dtype=np.uint8 if scores.shape[1] <= 256 else np.uint16)
    ones, best = np.arange(scores.shape[1])[None, :], np.zeros((0, scores.shape[1]))
    for t, n in enumerate(active):
        at = heads[:n] + t
        if t:
            best = best[:n]
            top = best.argmax(axis=1)
            jump = best[np.arange(n), top] - switch
            stays = best >= jump[:, None]
            came[at] = np.where(stays, ones, top[:, None])
            best = np.where(stays, best, jump[:, None]) + scores[at]
        else:
            best = scores[at].astype(np.float64)
        ended = slice(active[t + 1] if t + 1 < len(active) else 0, n)
        if ended.start < n:
            came_last = best[ended].argmax(axis=1)
            scores[at[ended], 0] = came_last  # the last word's own scores are no longer needed
    out = np.zeros(len(scores), dtype=np.int64)
    now = np.zeros(len(order), dtype=np.int64)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at, ended = heads[:n] + t, active[t + 1] if t + 1 < len(active) else 0
        now[ended:n] = scores[at[ended:], 0].astype(np.int64)
        out[at] = now[:n]
        now[:n] = came[at, now[:n]]
    return out


def label(texts: list[str], model: Model, switch: float = SWITCH) -> tuple[list[str], list[float], list[str]]:
    """Language, score and spans (lang:start:end, code points, end exclusive, comma-joined) of each text."""
    starts, begin, end, script, h = _words(texts)
    k, n = len(model.languages), len(texts)
    if not k or not len(begin):
        return [UND] * n, [0.0] * n, [""] * n
    per_char = model.trigrams[np.append(h, 0)]  # a row more, as the last word may end the texts
    per_char[-1] = 0
    flat = np.empty(2 * len(begin), dtype=np.int64)
    flat[0::2], flat[1::2] = begin, end
    scores = np.add.reduceat(per_char, flat, axis=0)[0::2]
    del per_char
    allowed = model.allowed[script]
    allowed |= ~allowed.any(axis=1)[:, None]
    neutral = ~model.allowed[script].any(axis=1)
    scores = np.where(allowed, scores, np.float32(-1e6))
    scores[neutral] = 0
    first = np.searchsorted(begin, starts)
    path = _path(scores, first, switch)
    text_of = np.repeat(np.arange(n), np.diff(first))
    size = end - begin
    mass = np.bincount(text_of * k + path, weights=size, minlength=n * k).reshape(n, k)
    top, total = mass.argmax(axis=1), mass.sum(axis=1)
    new = np.flatnonzero((np.diff(path, prepend=-1) != 0) | (np.diff(text_of, prepend=-1) != 0))
    last = np.append(new[1:], len(path)) - 1
    spans: list[list[str]] = [[] for _ in texts]
    for d, l, a, b in zip(text_of[new].tolist(), path[new].tolist(), (begin[new] - starts[text_of[new]]).tolist(), (end[last] - starts[text_of[new]]).tolist(), strict=True):
        spans[d].append(f"{model.languages[l]}:{a}:{b}")
    share = mass[np.arange(n), top] / np.maximum(total, 1)
    return [model.languages[i] if m else UND for i, m in zip(top, total, strict=True)], share.tolist(), [",".join(x) for x in spans]


def identify(df: DataFrame, model: Model, text: str = "text", switch: float = SWITCH) -> DataFrame:
    """df with lang_pred, score and lang_spans. The model is shipped once to each executor; its size has a fixed bound."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        langs, scores, spans = label(kit.texts_of(batch, text), shared.value, switch)
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, pa.string())]

    return kit.append(df, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_spans", T.StringType())], text, work)


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is never learned from: crc32 of the id as text leaves no remainder by 5. False without an id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def keep_identified(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose languages are known, however many they are, as they are: those that are `und` go."""
    return kit.keep(df, lambda x: identify(x, model, text), ("lang_pred", "score", "lang_spans"), F.col("lang_pred") != UND)
