"""Near-duplicate classes of documents with DartMinHash signatures.

A document is a weighted set: its runs of ``SHINGLE`` words, weighing as often as they occur; two documents are near
where the sum of the lesser weights is at least ``SIMILARITY`` of the sum of the greater.  Signatures: every element throws darts, a Poisson process over
its weight and a rank axis whose points are hashes of (element, number of the throw), so documents sharing an element
share its darts.  A dart lands on one of k coordinates; each coordinate keeps its earliest dart.  Only ranks below
phi = (k ln k + 2k) / total weight are thrown, which fills all coordinates of most documents with k ln k + 2k darts,
however many elements there are; documents with gaps throw again up to twice phi.

Signatures are joined by bands.  Equal texts count once.  A bucket is not paired out: its members are compared with the
member that is in the most crowded buckets overall, which in a group of edited copies is the text they were made from.
Pairs whose signatures promise enough are verified exactly on their shingle sets and become links.  What is then left
unlinked in a bucket is compared with the other members in blocks, signatures and then least hashes, so a link that the
chosen member does not show is found too.  Components of the links are the classes.

Edge cases: texts with fewer words than a shingle are one element; null texts and texts without words, and rows
without a doc_id, form no class (class_id is their doc_id); rows repeating a doc_id and text are copies; an empty table
gives an empty result.  Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, discard, text_or_empty, using, written
from .components import components
from .substring import Stretch, _hashes, mixed

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 5
#: Signatures this far below the similarity (four standard errors) are not verified.
SLACK = 0.13
#: Nothing looks again at pairs that no chosen member links, so these may miss the similarity by so many standard errors.
LATE_ERRORS = 5
BLOCK, ASKING = 256, 1024
#: Least hashes kept of a text's shingles.
LOW = 512
CHUNK_WORDS = 100_000
#: At most 2**DOC_BITS documents are worked on at once; the rest of 64 bits are a shingle's hash.
DOC_BITS = 10
#: Texts of candidate pairs up to this many are found by sending their 16-byte keys to all tasks.
BROADCAST_TEXTS = 1_000_000


def shingles(lists: list[list[bytes]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document number, hash and count of each distinct shingle, sorted."""
    sizes = np.array([len(x) for x in lists], np.int64)
    words = _hashes.of([w for x in lists for w in x])
    begins = np.cumsum(sizes) - sizes
    n = np.where(sizes == 0, 0, np.maximum(sizes - size + 1, 1))
    document = np.repeat(np.arange(len(lists)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins, n)
    hashes = Stretch(words).runs(start, np.repeat(np.minimum(sizes, size), n))
    keys = np.sort((document.astype(np.uint64) << np.uint64(64 - DOC_BITS)) | (hashes >> np.uint64(DOC_BITS)))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    found = keys[first]
    return (found >> np.uint64(64 - DOC_BITS)).astype(np.int64), found & np.uint64((1 << (64 - DOC_BITS)) - 1), np.diff(np.append(first, len(keys)))


def copies(element: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set as weighted: the n-th occurrence of an element is an element of its own.  Also how many each element has."""
    if not len(count) or count.max() == 1:
        return element, count
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    each = np.repeat(element, count)
    return np.where(nth == 0, each, mixed(each + np.uint64(0x9FB21C651E98DF25) * nth.astype(np.uint64)) >> np.uint64(DOC_BITS)), count


def weighted_sets(lists: list[list[bytes]], size: int) -> list[np.ndarray]:
    """Of each document the sorted hashes of its shingles, repeated ones told apart by number."""
    document, element, count = shingles(lists, size)
    each, _ = copies(element, count)
    sizes = np.bincount(document, count, minlength=len(lists)).astype(np.int64)
    return [np.sort(x) for x in np.split(each, np.cumsum(sizes)[:-1])]


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_minhash(document: np.ndarray, element: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """documents x k identities of the earliest darts; rows of documents without elements are 0.

    Weights are split into cells [0, 1), [1, 2), [2, 4), ...; a cell's darts come at a rate of its width, each with a
    place in the cell, and count where the place is below the element's weight.
    """
    many = int(document.max()) + 1 if len(document) else 0
    out, total = np.zeros((many, k), np.uint64), np.bincount(document, weight, minlength=many)
    phi = np.where(total > 0, (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    cells = np.where(weight <= 1, 1, 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)).astype(np.int64)
    of = np.repeat(np.arange(len(element)), cells)
    cell = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
    low, width = np.where(cell == 0, 0.0, 2.0 ** (cell - 1)), np.where(cell == 0, 1.0, 2.0 ** (cell - 1))
    seed = mixed(element[of] + np.uint64(0x632BE59BD9B4E019) * (cell.astype(np.uint64) + np.uint64(1)))
    open_ = total > 0
    while open_.any():
        alive = np.flatnonzero(open_[document[of]])
        rank, throw, found = np.zeros(len(alive)), 0, []
        while len(alive):
            h = mixed(seed[alive] ^ mixed(np.full(1, 2 * throw + 1, np.uint64)))
            rank = rank - np.log(_uniform(h)) / width[alive]
            near = rank < phi[document[of[alive]]]
            alive, rank, h = alive[near], rank[near], h[near]
            dart = mixed(h ^ np.uint64(0xD6E8FEB86659FD93))
            lies = low[alive] + width[alive] * _uniform(mixed(dart ^ np.uint64(0xA0761D6478BD642F))) < weight[of[alive]]
            found.append((document[of[alive[lies]]], dart[lies], rank[lies]))
            throw += 1
        d, dart, rank = (np.concatenate(x) for x in zip(*found, strict=True))
        slot = d * k + (dart % np.uint64(k)).astype(np.int64)
        # slot above, the rank's share of phi below: one sort puts the earliest dart of each slot first
        packed = (slot.astype(np.uint64) << np.uint64(40)) | (rank / phi[d] * 2.0**40).astype(np.uint64)
        order = np.argsort(packed)
        first = order[np.flatnonzero(np.concatenate([[True], np.diff(packed[order] >> np.uint64(40)) != 0]))] if len(order) else order
        full = np.bincount(d[first], minlength=many) == k
        take = first[full[d[first]]]
        out.reshape(-1)[slot[take]] = mixed(dart[take])
        open_ &= ~full
        phi = phi * 2
    return out


def signatures(texts: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """c, bands (a key for each) and sketch (16 bits of each coordinate); rows without words are left out."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("hashes")
        for batch in batches:
            keys, at = batch.column(1), 0
            while at < batch.num_rows:
                begin, lists, n = at, [], 0
                while at < batch.num_rows and (not lists or n < CHUNK_WORDS) and len(lists) < 1 << DOC_BITS:
                    lists.append((batch.column(2)[at].as_py() or "").encode().split())
                    n += len(lists[-1])
                    at += 1
                document, element, count = shingles(lists, shingle)
                sig = dart_minhash(document, element, count.astype(np.float64), bands * rows)
                full = np.flatnonzero(np.bincount(document, minlength=len(sig)) if len(document) else np.zeros(0))
                sig = sig[full]
                parts = sig.reshape(len(sig), bands, rows)
                band = mixed(np.full((len(sig), bands), np.arange(1, bands + 1), np.uint64))
                for r in range(rows):
                    band = mixed(band + parts[:, :, r])
                lists_ = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * bands), pa.array(band.reshape(-1).view(np.int64)))
                sketch = pa.array([x.tobytes() for x in (sig & np.uint64(0xFFFF)).astype("<u2")], pa.binary())
                where = pa.array(begin + full)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(where), keys.take(where), lists_, sketch], ["doc_id", "c", "bands", "sketch"])

    return texts.select("doc_id", "c", "text").mapInArrow(found, "doc_id long, c binary, bands array<long>, sketch binary")


def promising(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b), those whose sketches agree on a share of at least ``least``."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(batch.num_rows, -1) for i in (2, 3))
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= least))

    both = pairs.join(sketches.select(F.col("c").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("c").alias("b"), F.col("sketch").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(near, "a binary, b binary")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Of pairs (a, b), those whose weighted shingles have a Jaccard similarity of at least ``similarity``."""

    def true(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("hashes")
        for batch in batches:
            for begin in range(0, batch.num_rows, 50):
                part = batch.slice(begin, 50)
                n = part.num_rows
                lists = [x.split() for i in (2, 3) for x in part.column(i).cast(pa.binary()).to_pylist()]
                own, good = weighted_sets(lists, shingle), []
                for i in range(n):
                    common = len(np.intersect1d(own[i], own[n + i], assume_unique=True))
                    good.append(common >= similarity * (len(own[i]) + len(own[n + i]) - common) - 1e-9)
                yield pa.RecordBatch.from_arrays(part.columns[:2], ["a", "b"]).filter(pa.array(good))

    whole = texts.select("c", "text")
    both = pairs.join(whole.select(F.col("c").alias("a"), F.col("text").alias("x")), "a").join(whole.select(F.col("c").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(true, "a binary, b binary").distinct()


def least_agreeing(coordinates: int, similarity: float) -> int:
    """Coordinates that sketches of a pair must agree on where no later step finds it."""
    return math.floor(coordinates * similarity - LATE_ERRORS * math.sqrt(coordinates * similarity * (1 - similarity)))


def low_hashes(texts: DataFrame, shingle: int) -> DataFrame:
    """c, n (shingles) and low: the ``LOW`` least hashes of a text's weighted shingles (32 bits each), all if fewer."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("hashes")
        for batch in batches:
            for begin in range(0, batch.num_rows, 100):
                part = batch.slice(begin, 100)
                own = weighted_sets([x.split() for x in part.column(1).cast(pa.binary()).to_pylist()], shingle)
                lows = [np.unique((mixed(x) >> np.uint64(32)).astype("<u4"))[:LOW].tobytes() for x in own]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array(lows, pa.binary())], ["c", "n", "low"])

    return texts.select("c", "text").mapInArrow(least, "c binary, n long, low binary")


def alike(own: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the others may be as similar as asked, by their least hashes: exact but for equal hashes where all are there."""
    out = np.zeros(len(others), bool)
    for i, other in enumerate(others):
        common = np.intersect1d(own, other, assume_unique=True)
        if len(own) < LOW and len(other) < LOW:
            out[i] = len(common) >= (similarity - 0.005) * (len(own) + len(other) - len(common))
        else:
            union = np.union1d(own, other)[:LOW]
            out[i] = np.searchsorted(common, union[-1], "right") >= (similarity - LATE_ERRORS * math.sqrt(similarity * (1 - similarity) / LOW)) * len(union)
    return out


def unlinked(members: DataFrame, centres: DataFrame, classes: DataFrame, sketches: DataFrame, whole: DataFrame, bands: int, shingle: int, similarity: float) -> DataFrame:
    """Promising pairs (a, b) of different classes within a bucket, where a is not in the class of the bucket's centre.

    Members are dealt into blocks of about ``BLOCK`` and those that ask into blocks of about ``ASKING``; each block of the
    one meets each of the other, first by sketches, then by least hashes, so a pair that leaves here is nearly sure.
    """

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), "<u2").reshape(group.num_rows, -1)
        low = [np.frombuffer(x, "<u4") for x in group.column("low").to_pylist()]
        asks, loose, c = np.asarray(group.column("asks")), np.asarray(group.column("loose")), np.array(group.column("c").to_pylist(), "S16")
        of, band = np.asarray(group.column("of").combine_chunks().dictionary_encode().indices), group.column("band")[0].as_py()
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        enough = least_agreeing(sketch.shape[1], similarity)
        a, b = [], []
        for i in left:
            once = right[(of[right] != of[i]) & (~loose[right] | (c[right] > c[i]))]  # of two that ask, one
            equal = sketch[once] == sketch[i]
            near = equal.sum(axis=1) >= enough
            # only in the first two buckets that both are in by their sketches: the first may be one by chance
            shared = equal[near].reshape(int(near.sum()), bands, sketch.shape[1] // bands).all(axis=2)
            found = once[near][shared[:, band] & (shared[:, : band + 1].sum(axis=1) <= 2)]
            found = found[alike(low[i], [low[j] for j in found], similarity)]
            a += [int(i)] * len(found)
            b += found.tolist()
        keys = group.column("c")
        return pa.table({"a": keys.take(pa.array(a, pa.int64())), "b": keys.take(pa.array(b, pa.int64()))})

    placed = members.join(classes.withColumnsRenamed({"node": "c"}), "c", "left").withColumn("of", F.coalesce("component", "c"))
    middle = centres.join(classes.select(F.col("node").alias("centre"), F.col("component").alias("centre_of")), "centre", "left")
    placed = placed.join(middle.select("key", "size", F.coalesce("centre_of", "centre").alias("centre_of")), "key").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    placed = placed.withColumn("loose", F.col("of") != F.col("centre_of"))
    open_ = placed.where("loose").groupBy("key").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("ask_blocks"))
    placed = written(placed.join(open_, "key").select("key", "band", "c", "of", "loose", "blocks", "ask_blocks"), "placed")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("c"), F.col(n)).cast("int")
    asks = placed.where("loose").select("key", "band", "c", "of", every("blocks").alias("block"), mine("ask_blocks").alias("ask_block"), F.lit(True).alias("asks"), "loose")
    rest = placed.select("key", "band", "c", "of", mine("blocks").alias("block"), every("ask_blocks").alias("ask_block"), F.lit(False).alias("asks"), "loose")
    texts = _one_each(placed.select("c"), whole)
    held = written(low_hashes(texts, shingle).join(sketches.select("c", "sketch"), "c"), "low_hashes")
    discard(texts)
    pairs = asks.union(rest).join(held, "c").groupBy("key", "block", "ask_block").applyInArrow(compare, "a binary, b binary")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_md5, class_id (the least doc_id of the class) and kept (whether the row stands for its class).

    Of rows repeating a doc_id and text, all are marked alike.
    """
    every = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).withColumn("c", F.unhex(F.md5("text")))
    whole = every.where("doc_id is not null")
    signed = written(signatures(whole, shingle, bands, rows), "signatures")
    distinct = written(signed.groupBy("c").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "sketches")
    sketches = distinct.select("c", "sketch")

    banded = distinct.select(F.posexplode("bands").alias("band", "key"), "c")
    crowded = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = written(banded.join(crowded, "key"), "members")
    crowd = members.groupBy("c").agg(F.sum("size").alias("crowd"))
    centres = members.join(crowd, "c").groupBy("key").agg(F.max(F.struct("crowd", "c")).alias("top"), F.first("size").alias("size")).select("key", "size", F.col("top.c").alias("centre"))
    centres = written(centres, "centres")
    stars = members.join(centres.select("key", "centre"), "key").where("c <> centre").select(F.least("c", "centre").alias("a"), F.greatest("c", "centre").alias("b")).distinct()
    likely = written(promising(stars, sketches, similarity - SLACK), "likely")
    # one text of each kind: equal texts share c
    firsts = whole.groupBy("c").agg(F.min("doc_id").alias("doc_id"))
    links = _linked(likely, whole, shingle, similarity)

    classes = components(links)
    more, late = counted(unlinked(members.select("key", "band", "c"), centres, classes, sketches, whole, bands, shingle, similarity), "unlinked")
    if late:
        classes = components(links.union(_linked(more, whole, shingle, similarity)))
    for done in (distinct, members, centres, likely, more):
        discard(done)

    named = whole.select("doc_id", "c").join(signed.select("c").distinct().withColumn("has_words", F.lit(True)), "c", "left").join(classes.select(F.col("node").alias("c"), "component"), "c", "left")
    named = named.withColumn("of", F.coalesce("component", "c"))
    least = firsts.join(classes.select(F.col("node").alias("c"), "component"), "c", "left").groupBy(F.coalesce("component", "c").alias("of")).agg(F.min(F.struct("doc_id", "c")).alias("first"))
    out = named.join(least, "of").select(
        "doc_id", F.lower(F.hex("c")).alias("text_md5"), F.when(F.col("has_words"), F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("has_words"), (F.col("doc_id") == F.col("first.doc_id")) & (F.col("c") == F.col("first.c"))).otherwise(F.lit(True)).alias("kept"),
    )
    none = every.where("doc_id is null").select("doc_id", F.lower(F.hex("c")).alias("text_md5"), F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return out.union(none)


def _linked(pairs: DataFrame, whole: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs that are near indeed, stored."""
    texts = _one_each(pairs.select(F.explode(F.array("a", "b")).alias("c")), whole)
    links = written(verified(pairs, texts, shingle, similarity), "verified")
    discard(texts)
    return links


def _one_each(keys: DataFrame, whole: DataFrame) -> DataFrame:
    """The texts of the keys c, each once."""
    needed, n = counted(keys.distinct(), "needed")
    few = F.broadcast(needed) if n <= BROADCAST_TEXTS else needed
    texts = written(whole.join(few, "c", "left_semi").dropDuplicates(["c"]).select("c", "text"), "texts")
    discard(needed)
    return texts


SQL = r"""
with recursive texts as (
  select coalesce(text, '') as text, min(doc_id) as doc_id from documents where doc_id is not null group by 1
), split as (
  select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from texts
), known as (
  select doc_id, words, greatest(len(words) - 4, 1) as n from split where len(words) > 0
), shingles as (
  select doc_id, md5_number(array_to_string(words[place:place + 4], ' ')) as h, count(*) as n from (select doc_id, words, unnest(range(1, n + 1)) as place from known) group by 1, 2
), sizes as (
  select doc_id, sum(n) as n from shingles group by doc_id
), common as (
  select a.doc_id as a, b.doc_id as b, sum(least(a.n, b.n)) as n from shingles a join shingles b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2
), links as (
  select a, b from common c join sizes x on x.doc_id = a join sizes y on y.doc_id = b where c.n >= 0.8 * (x.n + y.n - c.n) - 1e-9
), ends as (select a, b from links union all select b, a from links),
closure as (select a as node, a as other from ends union select c.node, e.b from closure c join ends e on e.a = c.other),
classes as (select node, min(other) as class_id from closure group by node)
select d.doc_id, case when k.doc_id is null then d.doc_id else coalesce(c.class_id, t.doc_id) end as class_id,
       case when k.doc_id is null then true else d.doc_id = coalesce(c.class_id, t.doc_id) end as kept
from documents d join texts t on t.text = coalesce(d.text, '') left join known k on k.doc_id = t.doc_id left join classes c on c.node = t.doc_id
where d.doc_id is not null
union all select doc_id, doc_id, true from documents where doc_id is null
"""
