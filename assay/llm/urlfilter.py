"""URL filters over a sorted digest array.

The block list is a table of entries. Spark hashes its strings, sorts them by their keys as unsigned numbers and packs them, and
the driver writes them, a chunk at a time, to three files in the shared folder: sorted 64-bit xxhash keys, offsets, and the full
strings in the keys' order. Spark ships those to every executor, which maps them into memory; a slice of URLs is probed by one
vectorised binary search, and a key that is found counts only if the stored string is the same. Entries are a host, which
stands for its subdomains too, or host/path. Rules (host, path) come first: a rule fits its host and subdomains if the URL's
path starts with the rule's path; the longest wins (host, then path), and block wins a tie. A URL that no rule fits is blocked
if the list holds its host, a parent domain or its host and path, else allowed.

A list over `MAX_LIST_BYTES` isn't shipped; its entries are joined by Spark on digest and string, with the same answers.

Cases: a null URL or one without `://` has an empty host and path, no rule, and is allowed; URLs of any length are read whole;
an empty list blocks nothing; null, empty and repeated entries change nothing; repeated URLs get the same answer; empty tables
work; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm import kit

MAX_LIST_BYTES = 2_000_000_000
#: Parts of the digest array; each is a file.
PARTS = ("keys", "at", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first `://`."""
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.when(F.instr(url, "://") > 0, F.translate(host, UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The rule that wins and its verdict; null where none fits. rules: (verdict, host, path)."""
    order = sorted(rules, key=lambda r: (-len(r[1]), -len(r[2]), r[0] != "block"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in reversed(order):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def distinct_entries(block: DataFrame, entry: str = "entry") -> DataFrame:
    return block.select(F.col(entry).alias("entry")).where("entry <> ''").distinct()


def packed(entries: DataFrame) -> DataFrame:
    """(keys, sizes, text) of entries in the order of their keys, as bytes of some thousand entries a row."""
    keyed = entries.select(F.xxhash64("entry").alias("key"), F.encode("entry", "utf-8").alias("text"))
    ordered = keyed.orderBy(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), "text")  # as unsigned numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            row = [np.asarray(batch["key"]).tobytes(), sizes.tobytes(), b"".join(texts)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=["keys", "sizes", "text"])

    return ordered.mapInArrow(run, "keys binary, sizes binary, text binary")


def write_list(entries: DataFrame, name: str) -> None:
    """Three files of the sorted digest array beside each other, by Hadoop's file system; the driver holds one chunk."""
    context = entries.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path
    system = path(name).getFileSystem(context._jsc.hadoopConfiguration())
    files = {x: system.create(path(f"{name}.{x}"), False) for x in PARTS}
    try:
        files["at"].write(bytearray(np.zeros(1, dtype=np.int64).tobytes()))
        end = 0
        for r in packed(entries).toLocalIterator():
            ends = end + np.cumsum(np.frombuffer(r.sizes, dtype=np.int64))
            end = int(ends[-1])
            for x, data in (("keys", r["keys"]), ("at", ends.tobytes()), ("text", r.text)):
                files[x].write(bytearray(data))
    finally:
        for f in files.values():
            f.close()


def hashed(text: bytes) -> int:
    """The key of an entry: Spark's xxhash64 of a string."""
    return xxhash.xxh64_intdigest(text, 42)


class DigestArray:
    """The block list, mapped into memory."""

    def __init__(self, name: str, hasher=hashed) -> None:
        mapped = lambda x, kind: np.memmap(f"{name}.{x}", dtype=kind, mode="r") if os.path.getsize(f"{name}.{x}") else np.zeros(0, dtype=kind)
        self.keys, self.at, self.text = mapped("keys", np.uint64), mapped("at", np.int64), mapped("text", np.uint8)
        self.hasher = hasher

    def has(self, strings: list[str]) -> np.ndarray:
        encoded = [s.encode("utf-8", "surrogatepass") for s in strings]
        want = np.array([self.hasher(b) for b in encoded], dtype=np.uint64)
        lo = np.searchsorted(self.keys, want, side="left")
        hi = np.searchsorted(self.keys, want, side="right")
        out = np.zeros(len(strings), dtype=bool)
        for i in np.flatnonzero(hi > lo):  # few: what is on the list
            out[i] = any(self.text[self.at[k] : self.at[k + 1]].tobytes() == encoded[i] for k in range(lo[i], hi[i]))
        return out


@cache
def _opened(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def names_of(host: str, path: str) -> list[str]:
    """What the list may hold for a URL: the host, its parent domains, and the host with the path."""
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))] + [host + path] if host else []


def _listed(hosts: list[str], paths: list[str], of: DigestArray) -> np.ndarray:
    names = [names_of(h, p) for h, p in zip(hosts, paths, strict=True)]
    sizes = np.array([len(x) for x in names], dtype=np.int64)
    flat = [x for n in names for x in n]
    distinct = list(dict.fromkeys(flat))
    known = dict(zip(distinct, of.has(distinct).tolist(), strict=True))
    hit = np.fromiter((known[x] for x in flat), dtype=np.int64, count=len(flat))
    return np.bincount(np.repeat(np.arange(len(names)), sizes), weights=hit, minlength=len(names)) > 0


def judge(df: DataFrame, rules: list[tuple[str, str, str]], block: DataFrame, key: str = "page_id", url: str = "url", most: int = MAX_LIST_BYTES) -> DataFrame:
    """(key, host, path, rule, verdict, listed) of every row. block: entry."""
    rows = df.select(F.col(key).alias("_key"), F.col(url).alias("_url"))
    rows = rows.select("_key", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path"))
    entries = kit.cut(distinct_entries(block))
    size = entries.agg(F.sum(F.octet_length("entry") + 16)).first()[0] or 0
    rows = _probe(rows, entries) if size <= most else _joined(rows, entries)
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    by_list = F.when(F.col("_listed"), "block").otherwise("allow")
    return rows.select(F.col("_key").alias(key), F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"), F.col("_listed").alias("listed"))


def _probe(rows: DataFrame, entries: DataFrame) -> DataFrame:
    context = rows.sparkSession.sparkContext
    name = kit.new_folder(rows.sparkSession, "urls")
    write_list(entries, name)
    for x in PARTS:
        context.addFile(f"{name}.{x}")
    own = name.rsplit("/", 1)[-1]

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(_listed(batch.column("_host").to_pylist(), batch.column("_path").to_pylist(), _opened(own)))]

    return kit.append(rows, [T.StructField("_listed", T.BooleanType())], "_path", work)


def _joined(rows: DataFrame, entries: DataFrame) -> DataFrame:
    entries = entries.select("entry", F.xxhash64("entry").alias("digest"))
    labels = F.split("_host", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    wanted = rows.where("_host <> ''").select("_host", "_path").distinct()
    asked = wanted.select("_host", "_path", F.explode(F.array_append(names, F.concat("_host", "_path"))).alias("entry")).withColumn("digest", F.xxhash64("entry"))
    hit = asked.join(entries, ["digest", "entry"], "left_semi").select("_host", "_path").distinct().withColumn("_hit", F.lit(True))
    return rows.join(hit, ["_host", "_path"], "left").select("_key", "_host", "_path", F.coalesce("_hit", F.lit(False)).alias("_listed"))
