"""Exact removal of repeated passages by relative Lempel-Ziv parsing.

The reference of a document is every document with a smaller doc_id.  It is indexed in blocks: documents are cut at
places that their own words choose (the smallest hash of ``ANCHOR_WORDS`` words in every window of ``window`` words), so
equal passages are cut alike wherever they stand.  A block holds the windows that share such an anchor; the index has the
earliest place of each block, and of each window of those blocks that occur with different surroundings.

A document's blocks are joined to the index.  A block that is there matches as a whole; where the match ends inside a
block, which is where a factor begins or ends, the block's windows are looked up one by one.  The document is then parsed
greedily: from its first match on, a factor grows over block after block and window after window as long as the same
place of the reference goes on, and the next factor begins where it does not.  Every factor has at least ``window`` words
and is a duplicate span; since every window that occurs in the reference is in a match, the union of the spans is exactly
the words under repeated windows.

Shuffles move one row of hashes per block (about a twentieth of the words) and the texts once.  Anchors and blocks that
very many documents share are counted before they move and joined back by plain joins, which Spark splits where skewed;
nothing pairs the members of a group.  Only window hashes within one anchor need be distinct (64 bits each).

Edge cases: null text has no words; documents shorter than the window lose nothing; rows repeating a doc_id are not in
each other's reference; rows with a null doc_id are kept whole and are nobody's reference; very long texts are worked on
one at a time, each in memory; an empty table gives an empty result; only doc_id and text are read, so other columns
cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, holds, using, written

WINDOW = 50
ANCHOR_WORDS = 15
CHUNK_WORDS = 200_000
CACHED_WORDS = 300_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Hashes(dict):
    """Numbers of words as they come, and a 64-bit hash for each number."""

    def __init__(self) -> None:
        self.values64, self.new = np.zeros(0, np.uint64), []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        if len(self) > CACHED_WORDS:
            self.clear()
            self.values64 = np.zeros(0, np.uint64)
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            fresh = np.fromiter(map(xxh3_64_intdigest, self.new), np.uint64, len(self.new))
            self.values64, self.new = np.concatenate([self.values64, fresh]), []
        return self.values64[numbers]


_hashes = Hashes()
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _drop() -> None:
    _hashes.clear()
    _hashes.values64 = np.zeros(0, np.uint64)
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


holds("hashes", _drop)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((_BASE, _INVERSE)):
            with np.errstate(over="ignore"):
                _powers[k] = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size - 1, base, np.uint64))])
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


class Stretch:
    """Hashes of any run of words of a sequence."""

    def __init__(self, words: np.ndarray) -> None:
        up, self.down = powers(len(words) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:-1], dtype=np.uint64)])

    def runs(self, begin: np.ndarray, length) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[begin + length] - self.sums[begin]) * self.down[begin] + np.uint64(1) * np.asarray(length).astype(np.uint64))


def blocks(words: np.ndarray, document: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """anchor hash, block hash, first window and number of windows of each block.

    document: the number of the document of each word; blocks never cross documents.
    """
    k = min(ANCHOR_WORDS, window)
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(words) < window:
        return none
    s = Stretch(words)
    grams = s.runs(np.arange(len(words) - k + 1), k)
    starts = np.flatnonzero(document[: len(words) - window + 1] == document[window - 1 :])
    if not len(starts):
        return none
    views = sliding_window_view(grams, window - k + 1)
    anchor = starts + (views.argmin(axis=1)[starts] if len(starts) * 2 > len(views) else views[starts].argmin(axis=1))
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    count = np.diff(np.append(first, len(starts)))
    return grams[anchor[first]], s.runs(starts[first], count + window - 1), starts[first], count


def _chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[list[bytes]]]]:
    texts, at = batch.column(batch.schema.get_field_index(column)), 0
    while at < len(texts):
        begin, lists, n = at, [], 0
        while at < len(texts) and (not lists or n < CHUNK_WORDS):
            lists.append((texts[at].as_py() or "").encode().split())  # on ASCII white space
            n += len(lists[-1])
            at += 1
        yield begin, lists


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def find_blocks(docs: DataFrame, window: int) -> DataFrame:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("hashes")
        for batch in batches:
            ids, versions = (np.asarray(batch.column(i)) for i in (0, 1))
            for begin, lists in _chunks(batch, "text"):
                sizes = np.array([len(x) for x in lists])
                document, offset = np.repeat(np.arange(len(lists)), sizes), np.cumsum(sizes) - sizes
                anchor, block, first, count = blocks(_hashes.of([w for x in lists for w in x]), document, window)
                which = document[first] if len(first) else first
                columns = [pa.array(ids[begin + which]), pa.array(versions[begin + which]), _signed(anchor), _signed(block), pa.array((first - offset[which]).astype(np.int32)), pa.array(count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "anchor", "block", "first", "n"])

    return docs.select("doc_id", "version", "text").mapInArrow(found, "doc_id long, version long, anchor long, block long, first int, n int")


def find_windows(docs: DataFrame, window: int) -> DataFrame:
    """A row per window of the blocks listed in the column ``parts``."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("hashes")
        for batch in batches:
            ids, versions, parts = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(3)
            for begin, lists in _chunks(batch, "text"):
                for i, words in enumerate(lists, begin):
                    part = parts[i].values
                    anchor, first, n = (np.asarray(part.field(x)) for x in range(3))
                    start = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                    hashes = Stretch(_hashes.of(words)).runs(start, window)
                    columns = [np.full(len(start), ids[i]), np.full(len(start), versions[i]), np.repeat(anchor, n), hashes.view(np.int64), start.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "version", "anchor", "hash", "first"])

    return docs.select("doc_id", "version", "text", "parts").mapInArrow(found, "doc_id long, version long, anchor long, hash long, first int")


def factors(first: np.ndarray, n: np.ndarray, ref: np.ndarray, ref_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greedy parse of one document: first window and number of windows of each factor, from left to right.

    Matches are runs of n windows that stand in the reference ``ref`` from window ref_first on; none overlap, but rows may
    be repeated.
    """
    _, once = np.unique(first, return_index=True)  # in order
    first, n, ref, ref_first = (np.asarray(x)[once].astype(np.int64) for x in (first, n, ref, ref_first))
    goes_on = (first[1:] == first[:-1] + n[:-1]) & (ref[1:] == ref[:-1]) & (ref_first[1:] == ref_first[:-1] + n[:-1])
    begin = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    return first[begin], np.add.reduceat(n, begin)


def strip(docs: DataFrame, window: int, joined: bool) -> DataFrame:
    """Parses each document by its ``matches`` and takes the factors out; kept words are joined by spaces."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("hashes")
        for batch in batches:
            matches = batch.column(2)
            for begin, lists in _chunks(batch, "text"):
                removed, texts, found = [], [], []
                for i, words in enumerate(lists, begin):
                    part = matches[i].values if matches[i].is_valid else None
                    if part is None or not len(part):
                        removed.append(0)
                        found.append(0)
                        texts.append(b" ".join(words))
                        continue
                    first, n = factors(*(np.asarray(part.field(x)) for x in range(4)))
                    found.append(len(first))
                    edges = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edges, first, 1)
                    np.add.at(edges, first + n + window - 1, -1)
                    stays = np.cumsum(edges[:-1]) == 0
                    removed.append(len(words) - int(stays.sum()))
                    texts.append(b" ".join([words[j] for j in np.flatnonzero(stays).tolist()]))
                sizes = pa.array([len(x) for x in lists], pa.int64())
                out = pa.array(texts, pa.binary()).cast(pa.string()) if joined else pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(lists)), sizes, pa.array(removed, pa.int64()), out, pa.array(found, pa.int64())], ["doc_id", "n_words", "n_removed", "kept", "n_factors"])

    return docs.select("doc_id", "text", "matches").mapInArrow(kept, "doc_id long, n_words long, n_removed long, kept string, n_factors long")


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the text that is left, or its SHA-256) and n_factors of each document."""
    every = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    whole = every.where("doc_id is not null").withColumn("version", F.xxhash64("text"))
    found = written(find_blocks(whole, window), "blocks")

    kinds = found.groupBy("anchor", "block").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    anchors = kinds.groupBy("anchor").agg(F.min("least").alias("a"), F.max("most").alias("z"), F.count("*").alias("kinds")).where("a < z")
    shared = kinds.join(anchors.select("anchor", (F.col("kinds") > 1).alias("varied")), "anchor").where("varied or least < most")
    marked = written(found.join(shared.select("anchor", "block", "least", "varied", (F.col("least") < F.col("most")).alias("shared")), ["anchor", "block"]), "marked")
    discard(found)
    # written, so that the join with what very many documents share is one that Spark can split
    index = written(marked.where("shared and doc_id = least").groupBy("anchor", "block").agg(F.min("first").alias("ref_first")), "index")
    matched = marked.where("doc_id > least").join(index, ["anchor", "block"]).select("doc_id", "version", "first", "n", F.col("least").alias("ref"), "ref_first")

    # where matches end within blocks: the first document of each kind of block stands for all that have it
    parts = marked.where("varied and doc_id = least").groupBy("doc_id", "version").agg(F.collect_set(F.struct("anchor", "first", "n")).alias("parts"))
    windows = written(find_windows(whole.join(parts, ["doc_id", "version"]), window), "windows")
    earliest = windows.groupBy("anchor", "hash").agg(F.min(F.struct("doc_id", "first")).alias("ref"), F.max("doc_id").alias("most")).where("ref.doc_id < most")
    earliest = written(earliest.drop("most"), "earliest")
    looked_up = windows.join(earliest, ["anchor", "hash"]).where(F.col("doc_id") > F.col("ref.doc_id")).select("doc_id", "version", "first", F.lit(1).alias("n"), F.col("ref.doc_id").alias("ref"), F.col("ref.first").alias("ref_first"))

    matches = matched.union(looked_up).groupBy("doc_id", "version").agg(F.collect_list(F.struct("first", "n", "ref", "ref_first")).alias("matches"))
    out = strip(whole.join(matches, ["doc_id", "version"], "left"), window, not digest)
    no_matches = F.lit(None).cast("array<struct<first:int,n:int,ref:long,ref_first:int>>").alias("matches")
    return out.union(strip(every.where("doc_id is null").select("doc_id", "text", no_matches), window, not digest))


SQL = r"""
with split as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), placed as (
  select doc_id, words, unnest(range(1, len(words) - 48)) as place from split where len(words) >= 50
), windows as (
  select doc_id, place, md5_number(array_to_string(words[place:place + 49], ' ')) as h from placed
), firsts as (
  select h, min(doc_id) as least from windows group by h having count(*) > 1
), marked as (
  select doc_id, place from windows join firsts using (h) where doc_id > least
), gone as (
  select distinct doc_id, unnest(range(place, place + 50)) as place from marked
), lists as (
  select doc_id, list(place) as places, count(*) as n_removed from gone group by doc_id
)
select s.doc_id, len(words)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
       sha256(array_to_string(case when n_removed is null then words else list_select(words, list_sort(list_where(range(1, len(words) + 1), list_transform(range(1, len(words) + 1), lambda i: not list_contains(places, i))))) end, ' ')) as kept_sha256
from split s left join lists using (doc_id)
"""
