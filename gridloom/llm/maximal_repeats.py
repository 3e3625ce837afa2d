r"""Repeated byte strings by an enhanced suffix array and its common-prefix interval tree.

A repeat is a string of at least ``least`` bytes that starts at two or more places, of one text or of several.  Suffixes
are sorted from anchors only: of every ``least`` consecutive bytes the anchor is the ANCHOR_BYTES-gram with the smallest
hash, so equal strings have their anchors at the same place and every repeat runs through an anchor that its copies share.
The consecutive windows with one anchor make a block: the bytes before the anchor (its left side) and from it on (its
right side).

Blocks move as hashes.  Anchors that occur once drop out; an anchor whose blocks are all equal is one repeat as it stands.
Of the others the different blocks are cut out of the texts, sorted by their right sides (a suffix array of the anchors),
and lengths of common prefixes of neighbours are added.  A stack scan over these lengths visits the common-prefix
intervals, the inner nodes of the suffix tree; in each, the members are sorted by their reversed left sides and scanned
the same way, so that every way in which they go on to the left is a group of its own.  A group that stands in more than
one child of its interval (else it goes on to the right) with left and right parts of ``least`` bytes together is a
maximal repeat within its block, and all its members are given, not only neighbours.  A repeat longer than a block is
found once for each of its anchors; together they cover exactly the bytes under repeated windows.

A task holds the different blocks of an anchor, MOST_KINDS at most.  Anchors with more are worked on window by window:
hashes of all windows of their blocks are counted, which is exact as well, in rows that Spark deals by window.  What very
many texts share is counted before it moves, and joins with such rows are plain joins, which Spark splits.

Edge cases: null text is empty; texts shorter than ``least`` hold no repeats; repeated rows are copies of each other, with
or without an id, and lose all they have; long texts are read CHUNK_BYTES at a time, and windows at the joins are in both
pieces; runs of one window are one row; an empty table gives an empty result; only doc_id and text are read, so other
columns cannot clash.  Hashes of blocks and windows have 128 bits (with their anchor's), texts as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, text_or_empty, trimmed, using, written
from .substring import Stretch, mixed

LEAST = 400
ANCHOR_BYTES = 200
#: Bytes that are hashed at once; each takes about 80 bytes of memory meanwhile.
CHUNK_BYTES = 1 << 17
#: Different blocks of an anchor that one task sorts.
MOST_KINDS = 1000
#: Bytes of blocks that are sorted at once.
SORT_BYTES = 4 << 20
_BYTE_HASHES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of every ``width`` consecutive values, the first of equal ones: minima from both ends of strips."""
    n = len(x) - width + 1
    bits = np.uint64(max(1, int(len(x)).bit_length()))
    placed = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    placed[: len(x)] = (x >> bits << bits) | np.arange(len(x), dtype=np.uint64)
    strips = placed.reshape(-1, width)
    ahead = np.minimum.accumulate(strips, axis=1).reshape(-1)
    behind = np.minimum.accumulate(strips[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def blocks(data: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """anchor hash, block hash, first window, windows, repetitions and bytes before the anchor of each block.

    text: the number of the text of each byte.  Windows that follow each other and are equal make one block with that many
    repetitions.
    """
    k = min(ANCHOR_BYTES, least)
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4))
    if len(data) < least:
        return none
    starts = np.flatnonzero(text[: len(data) - least + 1] == text[least - 1 :])
    if not len(starts):
        return none
    s = Stretch(_BYTE_HASHES[data])
    grams = s.runs(np.arange(len(data) - k + 1), k)
    anchor = sliding_argmin(grams, least - k + 1)[starts]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    n = np.diff(np.append(first, len(starts)))
    begin, at = starts[first], anchor[first]
    anchors, hashes = grams[at], s.runs(begin, n + least - 1)
    again = (anchors[1:] == anchors[:-1]) & (hashes[1:] == hashes[:-1]) & (n[1:] == 1) & (n[:-1] == 1) & (begin[1:] == begin[:-1] + 1)
    heads = np.flatnonzero(np.concatenate([[True], ~again]))
    times = np.diff(np.append(heads, len(begin)))
    return anchors[heads], hashes[heads], begin[heads], n[heads], times, (at - begin)[heads]


def _texts(column: pa.Array, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of some texts or of a piece of one, the row of each byte, and the place of each byte in its text."""
    column = column.cast(pa.large_binary())
    places = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(places, places[row] + CHUNK_BYTES, "right")) - 1)
        for begin in range(places[row], max(places[to], places[row] + 1), CHUNK_BYTES if to == row + 1 else max(1, places[to] - places[row])):
            end = min(places[to], begin + CHUNK_BYTES + least - 1) if to == row + 1 else places[to]
            rows = np.repeat(np.arange(row, to), np.diff(np.clip(places[row : to + 1], begin, end)))
            yield data[begin:end], rows, np.arange(begin, end) - places[rows]
        row = to


BLOCKS = "k1 long, k2 long, anchor long, block long, first int, n int, times int, before int"


def find_blocks(texts: DataFrame, least: int) -> DataFrame:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("hashes")
        for batch in batches:
            k1, k2 = (np.asarray(batch.column(i)) for i in (0, 1))
            for data, rows, places in _texts(batch.column(2), least):
                anchor, block, first, n, times, before = blocks(data, rows, least)
                if len(first):
                    of = rows[first]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[of], k2[of], anchor.view(np.int64), block.view(np.int64), *(y.astype(np.int32) for y in (places[first], n, times, before)))], [f.split()[0] for f in BLOCKS.split(", ")])

    return texts.select("k1", "k2", "text").mapInArrow(trimmed(found), BLOCKS)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, pa.Array, list[bytes]]]:
    """anchor, block, before and bytes of the blocks that the column ``parts`` lists, text by text."""
    for batch in batches:
        parts = batch.column(1)
        for i, text in enumerate(batch.column(0)):
            data, part = text.as_buffer().to_pybytes(), parts[i].values
            first, length = np.asarray(part.field(2)).tolist(), np.asarray(part.field(3)).tolist()
            yield part.field(0), part.field(1), part.field(4), [data[a : a + n] for a, n in zip(first, length, strict=True)]


def cut_out(texts: DataFrame) -> DataFrame:
    """anchor, block, before and bytes of each block that the column ``parts`` lists."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("hashes")
        for anchor, block, before, pieces in _pieces(batches):
            yield pa.RecordBatch.from_arrays([anchor, block, before, pa.array(pieces, pa.binary())], ["anchor", "block", "before", "bytes"])

    return texts.select("text", "parts").mapInArrow(trimmed(cut), "anchor long, block long, before int, bytes binary")


def windows(texts: DataFrame, least: int) -> DataFrame:
    """A row per window of each block that ``parts`` lists: anchor, block, hash and place within the block.

    Blocks are cut out in the same task: a task after another would have a second worker for each core.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("hashes")
        for anchor, block, _, pieces in _pieces(batches):
            for i, data in enumerate(pieces):
                data = np.frombuffer(data, np.uint8)
                hashes = Stretch(_BYTE_HASHES[data]).runs(np.arange(len(data) - least + 1), least)
                n = len(hashes)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, x[i].as_py())) for x in (anchor, block)] + [pa.array(hashes.view(np.int64)), pa.array(np.arange(n, dtype=np.int32))], ["anchor", "block", "hash", "place"])

    return texts.select("text", "parts").mapInArrow(trimmed(found), "anchor long, block long, hash long, place int")


def common_prefixes(strings: list[bytes]) -> np.ndarray:
    """Length of the common prefix of each string and the one before it (0 for the first)."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    width = max(1, int(sizes.max(initial=1)))
    matrix = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width)
    differs = matrix[1:] != matrix[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    return np.concatenate([[0], np.minimum(common, np.minimum(sizes[1:], sizes[:-1]))])


def intervals(common: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals (length, first, last) of at least that length, inner ones first, by a scan with a stack."""
    stack: list[tuple[int, int]] = []  # length, first
    for i, length in enumerate([*common[1:], 0], 1):
        begin = i - 1
        while stack and stack[-1][0] > length:
            longer, begin = stack.pop()
            yield longer, begin, i - 1
        if length >= least and (not stack or stack[-1][0] < length):
            stack.append((length, begin))


def repeat_groups(left: list[bytes], right: list[bytes], shortest: int, least: int) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats through the anchors: bytes before and after the anchor, and all members.

    left: the bytes before each anchor, reversed; right: the bytes from it on, all different together.  Anchors have the
    first ``shortest`` bytes of their right sides in common with those that they can share a repeat with.
    """
    order = sorted(range(len(right)), key=right.__getitem__)
    common = common_prefixes([right[i] for i in order]).tolist()
    left_rank = np.empty(len(left), np.int64)
    by_left = sorted(range(len(left)), key=left.__getitem__)
    left_rank[by_left] = np.arange(len(left))
    for after, begin, end in intervals(common, shortest):
        members = order[begin : end + 1]
        longest = max(len(left[i]) for i in members)
        if longest + after < least:
            continue
        # members by reversed left side; the child of the interval that each is in
        child = dict(zip(members, np.cumsum([c == after for c in [after, *common[begin + 1 : end + 1]]]).tolist(), strict=True))
        members = [by_left[r] for r in np.sort(left_rank[members]).tolist()]
        left_common = common_prefixes([left[i] for i in members]).tolist()
        for before, a, b in intervals(left_common, max(0, least - after)) if least > after else _with_root(left_common):
            inside = members[a : b + 1]
            if any(child[i] != child[inside[0]] for i in inside):
                yield before, after, inside


def _with_root(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """All intervals, and the one of length 0 where the members have no byte in common."""
    found = list(intervals(common, 1))
    yield from found
    if (0, len(common) - 1) not in {f[1:] for f in found}:
        yield 0, 0, len(common) - 1


GROUPS = "anchor long, block long, member long, begin int, end int"


def sorted_groups(kinds: DataFrame, least: int, merged: bool) -> DataFrame:
    """Repeats among the different blocks of each anchor: anchor, block, member (of which group), begin and end in the block.

    merged: stretches of a block that overlap or touch are one, and which group they are of is not told.
    """
    shortest = min(ANCHOR_BYTES, least)

    def scanned(anchor: int, names: list[int], befores: list[int], data: list[bytes], out: list[tuple]) -> None:
        left, right = [d[:b][::-1] for d, b in zip(data, befores, strict=True)], [d[b:] for d, b in zip(data, befores, strict=True)]
        found: list[list[tuple[int, int]]] = [[] for _ in data]
        for k, (before, after, members) in enumerate(repeat_groups(left, right, shortest, least)):
            for i in members:
                if merged:
                    found[i].append((befores[i] - before, befores[i] + after))
                else:
                    out.append((anchor, names[i], k, befores[i] - before, befores[i] + after))
        for i, spans in enumerate(found):
            spans.sort()
            while spans:
                begin, end = spans[0]
                k = 1
                while k < len(spans) and spans[k][0] <= end:
                    end = max(end, spans[k][1])
                    k += 1
                out.append((anchor, names[i], 0, begin, end))
                del spans[:k]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("hashes")
        now, names, befores, data, out = None, [], [], [], []
        for batch in batches:
            for anchor, block, before, text in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if anchor != now:
                    if len(names) > 1:
                        scanned(now, names, befores, data, out)
                    now, names, befores, data = anchor, [], [], []
                names.append(block)
                befores.append(before)
                data.append(text)
            yield made(out)
            out = []
        if len(names) > 1:
            scanned(now, names, befores, data, out)
        yield made(out)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.int32()] * 2, strict=True)], [f.split()[0] for f in GROUPS.split(", ")])

    return kinds.select("anchor", "block", "before", "bytes").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(trimmed(scan), GROUPS)


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text and the key of a row: its id and 64 bits of its text, or 128 bits of its text."""
    text = text_or_empty(text)
    doc_id = F.col(doc_id).cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64(F.lit(2), text)).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))


def _with_parts(texts: DataFrame, kinds: DataFrame, least: int) -> DataFrame:
    """The texts that blocks are cut out of, each block out of one text, and in ``parts`` where."""
    part = F.struct("anchor", "block", "first", (F.col("n") + least - 1).alias("length"), "before")
    parts = kinds.groupBy("k1", "k2").agg(F.collect_list(part).alias("parts"))  # of one text
    return texts.join(parts, ["k1", "k2"]).dropDuplicates(["k1", "k2"])


def occurrences(texts: DataFrame, least: int = LEAST, merged: bool = False) -> DataFrame:
    """Repeats of the texts as ``keyed`` gives them: ``repeat`` says which; k1, k2, begin and end (bytes) say where.

    merged: rows say only which bytes are in repeats.
    """
    found = written(find_blocks(texts, least), "blocks")
    anchors = found.groupBy("anchor").agg(F.sum("times").alias("places"), F.min("block").alias("a"), F.max("block").alias("z")).where("places > 1")
    anchors = written(anchors.select("anchor", (F.col("a") < F.col("z")).alias("varied")), "anchors")  # so that the join is one that Spark can split
    marked = written(found.join(anchors, "anchor"), "marked")
    discard(found)
    kinds = marked.where("varied").groupBy("anchor", "block").agg(F.sum("times").alias("places"), F.min(F.struct("k1", "k2", "first", "n", "before")).alias("one"))
    kinds = written(kinds.select("anchor", "block", "places", "one.*"), "kinds")
    many = written(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > MOST_KINDS), "many")
    groups = sorted_groups(cut_out(_with_parts(texts, kinds.join(many, "anchor", "left_anti"), least)), least, merged)
    if not many.isEmpty():
        hot = written(windows(_with_parts(texts, kinds.join(many, "anchor"), least), least), "windows")
        again = written(hot.groupBy("anchor", "hash").agg(F.count("*").alias("places")).where("places > 1").select("anchor", "hash"), "again")
        hot = hot.join(again, ["anchor", "hash"]).select("anchor", "block", F.col("hash").alias("member"), F.col("place").alias("begin"), (F.col("place") + least).alias("end"))
        groups = groups.union(hot)
    groups = written(groups, "groups")

    at = lambda begin, end: ("k1", "k2", (F.col("first") + begin).alias("begin"), (F.col("first") + end).alias("end"))
    everywhere = kinds.where("places > 1").select("anchor", "block", "n")
    if merged:  # a block in several places is a repeat as it stands; one in a single place stands where its kind does
        inner = kinds.where("places = 1").join(groups, ["anchor", "block"])
    else:
        inner = marked.where("varied").join(groups, ["anchor", "block"])
        whole = (groups["begin"] == 0) & (groups["end"] == everywhere["n"] + least - 1)
        everywhere = everywhere.join(groups, (everywhere["anchor"] == groups["anchor"]) & (everywhere["block"] == groups["block"]) & whole, "left_anti")
    inner = inner.select(F.concat_ws(":", "anchor", "member").alias("repeat"), *at(F.col("begin"), F.col("end")))
    whole = marked.where("not varied").select("anchor", "block", "k1", "k2", "first", "n", "times")
    whole = whole.union(marked.where("varied").join(everywhere.select("anchor", "block"), ["anchor", "block"]).select(*whole.columns))
    return inner.union(whole.select(F.concat_ws(":", "anchor", "block", F.lit("all")).alias("repeat"), *at(F.lit(0), F.col("n") + F.col("times") - 1 + least - 1)))


def repeats(docs: DataFrame, least: int = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """repeat, doc_id, begin and end: every place of every maximal repeat within a block."""
    texts = keyed(docs, doc_id, text)
    places = occurrences(texts, least)
    return texts.select("doc_id", "k1", "k2").join(places, ["k1", "k2"]).select("repeat", "doc_id", "begin", "end")


def merged_spans(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches that overlap or touch made one, in order."""
    order = np.argsort(begins, kind="stable")
    begins, reached = begins[order], np.maximum.accumulate(ends[order])
    opens = np.flatnonzero(np.concatenate([[True], begins[1:] > reached[:-1]]))
    return begins[opens], reached[np.append(opens[1:], len(begins)) - 1]


def remove_repeats(docs: DataFrame, least: int = LEAST, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that are left, or their SHA-256) of each row."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("hashes")
        for batch in batches:
            spans, n, removed, runs, kept = batch.column(2), [], [], [], []
            for i, value in enumerate(batch.column(1)):
                data = value.as_buffer()
                n.append(len(data))
                if spans[i].is_valid and len(spans[i].values):
                    begins, ends = merged_spans(*(np.asarray(spans[i].values.field(c)) for c in (0, 1)))
                    removed.append(int((ends - begins).sum()))
                    runs.append(len(begins))
                    data = b"".join(data[a:b] for a, b in zip([0, *ends.tolist()], [*begins.tolist(), len(data)], strict=True))
                else:
                    removed.append(0)
                    runs.append(0)
                kept.append(hashlib.sha256(data).hexdigest() if digest else bytes(data))
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, runs)), pa.array(kept, pa.string() if digest else pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    texts = keyed(docs, doc_id, text)
    spans = occurrences(texts, least, merged=True).groupBy("k1", "k2").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))  # of one text
    rows = texts.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(trimmed(strip), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}")


SQL = r"""
with docs as (
  select row_number() over () as id, doc_id, encode(coalesce(text, '')) as b from documents
), windows as (
  select id, place, md5_number(b[place:place + 399]) as h from (select id, b, unnest(range(1, octet_length(b) - 398)) as place from docs where octet_length(b) >= 400)
), again as (
  select h from windows group by h having count(*) > 1
), marked as (
  select id, place, lag(place) over (partition by id order by place) as before from windows semi join again using (h)
), runs as (
  select id, place, sum(case when before is null or place > before + 400 then 1 else 0 end) over (partition by id order by place) as run from marked
), spans as (
  select id, run, min(place) as a, max(place) + 400 as z from runs group by all
), kept as (
  select id, doc_id, b, coalesce(list_sort(list({'a': a, 'z': z}) filter (a is not null)), []) as spans from docs left join spans using (id) group by all
)
select doc_id, octet_length(b)::bigint as n_bytes, coalesce(list_sum(list_transform(spans, lambda s: s.z - s.a)), 0)::bigint as n_removed, len(spans)::bigint as n_spans,
       sha256(list_reduce(list_prepend(''::blob, list_transform(range(1, len(spans) + 2), lambda i: b[case when i = 1 then 1 else spans[i - 1].z end : case when i > len(spans) then octet_length(b) else spans[i].a - 1 end])), lambda x, y: x || y)) as kept_sha256
from kept
"""
