"""Token counts without tokens: Viterbi that carries the best score and its number of pieces.

Aho-Corasick lists the vocabulary's matches by their ends, the longest first. At each end the best score so far is kept
with its piece count; a later candidate must be strictly better, which is the tokenizer's rule for ties (the longer last
piece wins). A character that is no piece itself may be passed as unknown, last of the candidates at its end, and counts
as its UTF-8 bytes. A space mark in a text is read as a space, as the tokenizer does.

Cases: a null text has null tokens, an empty one none; texts and words of any length are counted whole; equal words are
counted once per worker (`CACHED` words are remembered, then the memory is cleared); repeated rows get the same answer;
columns named like the result are replaced; an empty table works.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from assay.llm import kit, pieces

CACHED = 400_000


class Counter(dict):
    """Pieces of each word asked for."""

    def __init__(self, vocabulary: pieces.Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        n = count_word(word, self.vocabulary)
        if len(word) <= 64:
            self[word] = n
        return n

    def count(self, text: str) -> int:
        if len(self) > CACHED:
            self.clear()
        return sum(map(self.__getitem__, pieces.words(text.replace(pieces.MARK, " "))))


def count_word(word: str, v: pieces.Vocabulary) -> int:
    best, counts = [0.0], [0]
    lost = float("-inf")
    single, unknown = v.single, v.unknown
    at, top, n = 0, lost, 0
    for last, (size, score, _) in v.automaton.iter(word):
        while at <= last - 1:  # ends without further matches are closed
            if word[at] not in single:
                if best[at] + unknown > top:
                    top, n = best[at] + unknown, counts[at] + len(word[at].encode("utf-8", "surrogatepass"))
            best.append(top)
            counts.append(n)
            at, top, n = at + 1, lost, 0
        start = last + 1 - size
        if best[start] + score > top:
            top, n = best[start] + score, counts[start] + 1
    while at < len(word):
        if word[at] not in single and best[at] + unknown > top:
            top, n = best[at] + unknown, counts[at] + len(word[at].encode("utf-8", "surrogatepass"))
        best.append(top)
        counts.append(n)
        at, top, n = at + 1, lost, 0
    return counts[-1]


def count_tokens(df: DataFrame, text: str = "text", model: str = pieces.DEFAULT, to: str = "n_tokens") -> DataFrame:
    """df with the number of pieces of each text, no marks of begin or end counted."""
    counters: dict[str, Counter] = {}

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        if model not in counters:
            counters[model] = Counter(pieces.vocabulary(model))
        return [pa.array([None if t is None else counters[model].count(t) if t else 0 for t in batch.column(text).to_pylist()], pa.int64())]

    return kit.append(df, [T.StructField(to, T.LongType())], text, work)
