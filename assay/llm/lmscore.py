"""Cross-entropy difference of two n-gram models over one vocabulary.

The vocabulary is the lower-case words of the whole corpus, and every bigram is counted for itself: keys are hashes of 63
bits (two of a hundred million keys are one with a chance of 1 in 2,000). The target model counts the chosen rows, the
background model all rows, with the same orders, keys and smoothing: a bigram's relative frequency and a word's add-one
frequency are mixed by the Witten-Bell-like weight n(v) / (n(v) + `PRIOR`). A document's score is the mean over its tokens of
the loss under the target less the loss under the background: low is like the target. No document is scored by its own counts:
they are taken out of both models for it (out of the target model if it is chosen), so chosen rows are held out as all others
are, and a text that occurs twice is known from its other copy.

Counts grow with the corpus and are never gathered. Rows are dealt into parts by a hash of themselves. A part sends its
distinct keys with its counts, sorted, to the buckets of the keys; a bucket adds up what all parts have sent and answers each
part in the order it asked, so the answers hold counts alone; the part then finds its keys again in its own texts. Parts and
buckets are `SPLIT` to a shuffle partition, which bounds both; rows that are alike in all columns share a part.

Which rows are chosen is told by their keys: a narrow join finds the parts that chosen keys are in, and each part gets its own.
So texts are shuffled once, to their parts, and nothing is shipped to all tasks, however many keys there are.

Cases: a null or wordless text has 0 tokens and null losses; texts of any length are read whole, in slices; rows whose label is
missing or whose key is null are background alone; a label that is repeated counts if any of its rows is chosen; repeated rows
are counted each; without target rows the target model is uniform; empty tables work; columns named like the results are
replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm import kit

PRIOR = 5.0
#: Parts, and buckets of keys, for each shuffle partition.
SPLIT = 2
#: Texts of a part are read in slices of so many code units; a part rarely has more.
PART_BYTES = 16_000_000
#: What stands before the first word of a text. Keys of words are odd, those of bigrams and this one are even.
START = np.uint64(0)

ASKED = "_bucket int, _part int, keys binary, target binary, background binary"
ANSWERED = "_part int, _bucket int, n int, target binary, background binary, words long, target_tokens long, background_tokens long"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word keys of all texts one after another, and how many each has."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat = split.flatten()
    full = np.asarray(pc.not_equal(flat, "")) if len(flat) else np.zeros(0, dtype=bool)
    n = np.asarray(pc.list_value_length(split)).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), n)[full]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    keys = np.array([word_key(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    return keys[np.asarray(coded.indices)] if len(keys) else keys, np.bincount(of, minlength=len(texts))


def word_key(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, 1) | 1


def bigrams(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of each word with the word before it, and that word's key; START at the start of a text."""
    first = (np.cumsum(n) - n)[n > 0]
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[first] = START
    return kit.mixed(kit.mixed(before) ^ words) & ~np.uint64(1), before


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, the place of each key among them, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return keys[at], place, *(np.add.reduceat(c[order], at) if len(at) else c for c in counts)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[at], np.diff(np.append(at, len(keys)))


def read(rows: pa.Table | pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a table with the keys of their words and how many words each text has."""
    for batch in rows.to_batches() if isinstance(rows, pa.Table) else [rows]:
        for part in kit.slices(batch, text, PART_BYTES):
            yield part, *tokens(part[text])


def keys_of(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.concatenate([words, bigrams(words, n)[0], np.full(int((n > 0).sum()), START)])


def gathered(rows: pa.Table | pa.RecordBatch, text: str, chosen: Callable[[pa.RecordBatch], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a table's texts in order, and their counts in chosen texts and in all."""
    found = []
    for part, words, n in read(rows, text):
        keys, every = distinct(keys_of(words, n))
        counts = np.zeros(len(keys), dtype=np.int64)
        on = chosen(part)
        own, times = distinct(keys_of(words[np.repeat(on, n)], n[on]))
        counts[np.searchsorted(keys, own)] = times
        found.append((keys, counts, every))
    if len(found) == 1:
        return found[0]
    none = np.zeros(0, dtype=np.int64)
    keys, _, *sums = summed(*(np.concatenate(x) for x in zip((none.view(np.uint64), none, none), *found, strict=True)))
    return keys, *sums


def packed(x: np.ndarray) -> bytes:
    """Numbers of 64 bits, byte by byte of all, compressed: high bytes are mostly zero."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(x: bytes) -> np.ndarray:
    n = int.from_bytes(x[:8], "little")
    planes = np.frombuffer(pa.decompress(x[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel()


def bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the keys of each bucket begin (one entry more than buckets): each has an equal range of keys."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def asked(part: int | None, keys: np.ndarray, target: np.ndarray, background: np.ndarray, buckets: int) -> pa.Table:
    """A row for each bucket, also if it has no key of this part. Without a part the counts are given and nothing is asked."""
    at = bounds(keys, buckets)
    cut = lambda x, how: pa.array([packed(how(x[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
    as_is = lambda x: x
    values = [pa.array(np.arange(buckets, dtype=np.int32)), pa.array([part] * buckets, pa.int32()), cut(keys, lambda x: np.diff(x, prepend=np.uint64(0))), cut(target, as_is), cut(background, as_is)]
    return pa.Table.from_arrays(values, names=["_bucket", "_part", "keys", "target", "background"])


def answer(rows: pa.Table) -> pa.Table:
    """What a bucket says to each part that asked."""
    keys = [np.cumsum(unpacked(x), dtype=np.uint64) for x in rows["keys"].to_pylist()]
    given = [np.concatenate([unpacked(x) for x in rows[name].to_pylist()]).view(np.int64) for name in ("target", "background")]
    every, place, target, background = summed(np.concatenate(keys), *given)
    word = (every & np.uint64(1)).astype(bool)
    totals = [int((background[word] > 0).sum()), int(target[word].sum()), int(background[word].sum())]
    ends = np.cumsum([len(k) for k in keys])
    out = []
    for bucket, part, end, own in zip(rows["_bucket"].to_pylist(), rows["_part"].to_pylist(), ends, keys, strict=True):
        if part is not None:
            at = place[end - len(own) : end]
            out.append((part, bucket, len(own), packed(target[at]), packed(background[at]), *totals))
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in ANSWERED.split(", ")]
    return pa.Table.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)


class Model:
    """Both models as far as a part has keys."""

    def __init__(self, keys: np.ndarray, answers: pa.Table, buckets: int) -> None:
        told, at = sorted(answers.to_pylist(), key=lambda r: r["_bucket"]), bounds(keys, buckets)
        if [r["n"] for r in told] != np.diff(at).tolist():
            raise ValueError("the answers of the buckets don't fit the part's keys")
        self.keys, self.word = keys, np.flatnonzero(keys & np.uint64(1))
        self.counts = [np.concatenate([unpacked(r[name]) for r in told]).view(np.int64).astype(np.float64) for name in ("target", "background")]
        self.used = max(sum(r["words"] for r in told), 1)
        self.total = [sum(r[name] for r in told) for name in ("target_tokens", "background_tokens")]

    def scores(self, words: np.ndarray, n: np.ndarray, own: tuple[np.ndarray, np.ndarray]) -> list[pa.Array]:
        """Results of texts. own: of each text, whether the target and the background model hold its counts, to be taken out."""
        of = np.repeat(np.arange(len(n)), n)
        first = (np.cumsum(n) - n)[n > 0]
        pair = np.searchsorted(self.keys, bigrams(words, n)[0])
        word = self.word[np.searchsorted(self.keys[self.word], words)] if len(words) else np.zeros(0, dtype=np.int64)

        def shifted(x: np.ndarray, start: int) -> np.ndarray:
            out = np.empty_like(x)
            out[1:] = x[:-1]
            out[first] = start
            return out

        before = shifted(word, 0)  # START is the smallest key
        own_pair, own_word = (times_in_text(of, x, len(self.keys)) for x in (pair, word))
        own_before = shifted(own_word, 1)
        mean = []
        for k in (0, 1):
            out = own[k][of].astype(np.float64)
            low = (self.counts[k][word] - out * own_word + 1.0) / (self.total[k] - out * n[of] + self.used + 1.0)
            seen = self.counts[k][before] - out * own_before
            high = np.minimum((self.counts[k][pair] - out * own_pair) / np.maximum(seen, 1.0), 1.0)
            weight = seen / (seen + PRIOR)
            mean.append(np.bincount(of, weights=-np.log(weight * high + (1 - weight) * low), minlength=len(n)) / np.maximum(n, 1))
        return [pa.array(n.astype(np.int64)), *(pa.array(x, pa.float64(), mask=n == 0) for x in (mean[0], mean[1], mean[0] - mean[1]))]


def times_in_text(of: np.ndarray, keys: np.ndarray, n_keys: int) -> np.ndarray:
    """Of each token, how often its key occurs in its text."""
    both = of * n_keys + keys
    order = np.argsort(both, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], both[order][1:] != both[order][:-1]])[: len(both)])
    out = np.empty(len(both), dtype=np.int64)
    times = np.diff(np.append(at, len(both)))
    out[order] = np.repeat(times, times)
    return out


def chosen_keys(labels: DataFrame, key: str = "doc_id", where: str = "quality = 1") -> DataFrame:
    """(key) of the rows that labels choose, each once."""
    return labels.where(F.expr(where) & F.col(key).isNotNull()).select(key).distinct()


def count(df: DataFrame, chosen: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, target, background) of all words, bigrams and starts of texts that occur, with their counts. A model for other texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, on, every = gathered(batch, "_text", lambda part: np.asarray(part["_target"]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(on), pa.array(every)], names=["key", "target", "background"])

    told = chosen.select(F.col(key).alias("_chosen")).distinct()
    rows = df.select(F.col(text).alias("_text"), F.col(key).alias("_key")).join(told, F.col("_key") == F.col("_chosen"), "left").select("_text", F.col("_chosen").isNotNull().alias("_target"))
    return rows.mapInArrow(run, "key long, target long, background long").groupBy("key").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def score(df: DataFrame, chosen: DataFrame | None = None, model: DataFrame | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """df with n_tokens, ce_target, ce_background and ce_difference, by the counts of df itself and of its chosen rows, or by a model of count()."""
    pieces = SPLIT * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    alone = model is None
    fields = [T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("ce_target", "ce_background", "ce_difference"))]
    base = df.drop(*[f.name for f in fields if f.name in df.columns])
    plain = [F.col(f"`{f.name}`") for f in base.schema.fields if f.name == text or isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)]
    placed = base.withColumn("_part", F.pmod(F.xxhash64(*plain), F.lit(pieces)).cast("int")).withColumn("_key", F.col(key).cast("string"))
    kept = T.StructType([*base.schema.fields, *fields])
    names = base.columns
    told = chosen.select(F.col(key).cast("string").alias("_key")).where("_key IS NOT NULL").distinct() if alone and chosen is not None else df.sparkSession.createDataFrame([], "_key string")
    places = kit.cut(placed.select("_part", "_key").join(told, "_key").select("_part", "_key").distinct())
    places = places.select(*(F.col(c).alias(c) for c in places.columns))  # columns of their own beside those of placed

    def among(keys: pa.Table) -> Callable[[pa.RecordBatch], np.ndarray]:
        known = keys["_key"].combine_chunks().drop_null()
        return lambda part: np.asarray(pc.is_in(part["_key"], value_set=known))

    def ask(rows: pa.Table, keys: pa.Table) -> pa.Table:
        found, on, every = gathered(rows, text, among(keys))
        return asked(rows["_part"][0].as_py(), found, on, every if alone else np.zeros_like(every), pieces)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, _, target, every = summed(np.asarray(batch["key"]).view(np.uint64), np.asarray(batch["target"]), np.asarray(batch["background"]))
            yield from asked(None, keys, target, every, pieces).to_batches()

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        on = among(answers)
        parts = list(read(rows, text))
        keys = distinct(np.concatenate([distinct(keys_of(words, n))[0] for _, words, n in parts]))[0]
        told = Model(keys, answers.filter(pc.is_null(answers["_key"])), pieces)
        out = []
        for part, words, n in parts:
            own = (on(part), np.full(len(n), alone))
            out.append(pa.RecordBatch.from_arrays([*(part[c] for c in names), *told.scores(words, n, own)], names=[*names, *(f.name for f in fields)]))
        return pa.Table.from_batches(out)

    sent = placed.groupBy("_part").cogroup(places.groupBy("_part")).applyInArrow(ask, ASKED)
    if not alone:
        sent = sent.union(model.select("key", "target", "background").mapInArrow(give, ASKED))
    answers = sent.groupBy("_bucket").applyInArrow(answer, ANSWERED).withColumn("_key", F.lit(None).cast("string"))
    answers = answers.unionByName(places, allowMissingColumns=True)
    return placed.groupBy("_part").cogroup(answers.groupBy("_part")).applyInArrow(finish, kept)
