"""Removal of repeated and nearly repeated lines by a deletion-neighbourhood join.

A line is compared without the ASCII white space around it.  Of equal lines the earliest stays (by doc_id, then place).
Lines of at least ``MIN_CHARS`` characters that one insertion, deletion or substitution turns into each other are near:
a line goes if an earlier line is near.  Such lines share a variant, the line without one of its characters: two
lines of equal length that differ at place i share the one without place i, and of two lines of lengths n and n + 1 the
shorter is a variant of the longer.  All variants are emitted as hashed keys, with length and place as part of the key;
equal keys are joined to the earliest line that has them, and the edit distance of such pairs is verified on the texts.

Emitting every variant of every line would write a row per character.  A line can only share a variant if it also
shares one half with a line of the same length or one more or less, so halves are counted first, then sixteenths among
the lines that remain, and only places inside shared sixteenths are emitted.  Both filters lose no pair.

Edge cases: null text stays null and has no lines; blank lines stay and never count; rows repeating a doc_id do not
remove each other's lines but for near ones, and rows with a null doc_id are kept whole; an empty table gives an empty
result; a line or text of any length is compared whole, within the memory of its task; other columns pass through, and
input columns named like the outputs n_lines and n_removed are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import counted, using, written

MIN_CHARS = 20
#: Columns of this module beside those of the input.
VERSION, GONE = "_line_version", "_line_gone"
ROWS_AT_ONCE = 500
#: A line is common if it makes up this share of all lines or more, so there are at most 10,000 common lines.
COMMON_SHARE = 1e-4
PARTS, FINE_PARTS = 2, 16
SPACE = b" \t\n\r\x0b\x0c"
#: Candidate lines up to this many are sent to all tasks (under 100 bytes each); more are joined by a shuffle.
BROADCAST_LINES = 500_000


def part_keys(line: str, parts: int) -> list[int]:
    """Hashes of the line without one part, as the longer or equally long and as the shorter of a pair."""
    from xxhash import xxh3_64_intdigest

    n, keys = len(line), []
    for m in (n, n + 1):
        for p in range(parts):
            a, z = m * p // parts, m * (p + 1) // parts
            keys.append(xxh3_64_intdigest(f"{m} {p} {line[:a]}\0{line[n - (m - z) :] if m > z else ''}".encode()) - (1 << 63))
    return keys


def _first_lines(text: bytes | None) -> dict[bytes, int]:
    """Place of the first of equal lines in a text."""
    found: dict[bytes, int] = {}
    for no, line in enumerate((text or b"").split(b"\n")):
        line = line.strip(SPACE)
        if line:
            found.setdefault(line, no)
    return found


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.int64))


def find_lines(docs: DataFrame) -> DataFrame:
    """doc_id, version, no, h1, h2 and keys (of lines long enough) of the distinct lines of each document."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("lines")
        from xxhash import xxh3_128_intdigest

        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(begin, ROWS_AT_ONCE)
                where, no, h1, h2, keys = [], [], [], [], []
                for i, text in enumerate(rows.column(2).cast(pa.binary()).to_pylist()):
                    for line, place in _first_lines(text).items():
                        h = xxh3_128_intdigest(line)
                        where.append(i)
                        no.append(place)
                        h1.append((h >> 64) - (1 << 63))
                        h2.append((h & ((1 << 64) - 1)) - (1 << 63))
                        decoded = line.decode()
                        keys.append(part_keys(decoded, PARTS) if len(decoded) >= MIN_CHARS else None)
                taken = pa.array(where, pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column(0).take(taken), rows.column(1).take(taken), pa.array(no, pa.int32()), _longs(h1), _longs(h2), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", VERSION, "no", "h1", "h2", "keys"])

    return docs.select("doc_id", VERSION, "text").mapInArrow(found, f"doc_id long, {VERSION} long, no int, h1 long, h2 long, keys array<long>")


def read_lines(docs: DataFrame) -> DataFrame:
    """The text of the lines at the places in the column ``wanted``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("lines")
        for batch in batches:
            for i in range(batch.num_rows):
                lines, wanted = batch.column(2)[i].as_py().split("\n"), batch.column(3)[i].as_py()
                n = len(wanted)
                texts = pa.array([lines[w["no"]].encode().strip(SPACE).decode() for w in wanted], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * n)), pa.array([w["no"] for w in wanted], pa.int32()), _longs([w["h1"] for w in wanted]), _longs([w["h2"] for w in wanted]), texts], ["doc_id", "no", "h1", "h2", "line"])

    return docs.select("doc_id", VERSION, "text", "wanted").drop(VERSION).select("doc_id", F.lit(0).alias("_"), "text", "wanted").mapInArrow(read, "doc_id long, no int, h1 long, h2 long, line string")


def find_parts(lines: DataFrame) -> DataFrame:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("lines")
        for batch in batches:
            texts = batch.column(2).to_pylist()
            where = pa.array(np.repeat(np.arange(len(texts)), 2 * FINE_PARTS))
            keys = [k for x in texts for k in part_keys(x, FINE_PARTS)]
            part = np.tile(np.arange(2 * FINE_PARTS, dtype=np.int32), len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), _longs(keys), pa.array(part)], ["h1", "h2", "key", "part"])

    return lines.select("h1", "h2", "line").mapInArrow(found, "h1 long, h2 long, key long, part int")


def find_variants(lines: DataFrame) -> DataFrame:
    """Keys (v1, v2) of a line's variants inside its ``parts``, by length and place, and of the line itself.

    whole: the row is the line itself, a variant of lines one longer.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("lines")
        from xxhash import xxh3_128_intdigest

        for batch in batches:
            for begin in range(0, batch.num_rows, 100):
                rows = batch.slice(begin, 100)
                where, v1, v2, whole, place = [], [], [], [], []

                def emit(i: int, variant: str, n: int, at: int, is_whole: bool) -> None:
                    h = xxh3_128_intdigest(f"{n} {at} {variant}".encode())
                    where.append(i)
                    v1.append((h >> 64) - (1 << 63))
                    v2.append((h & ((1 << 64) - 1)) - (1 << 63))
                    whole.append(is_whole)
                    place.append(at)

                for i, (line, parts) in enumerate(zip(rows.column(4).to_pylist(), rows.column(5).to_pylist(), strict=True)):
                    n, shorter = len(line), set()
                    places = sorted({a for p in parts if p < FINE_PARTS for a in range(n * p // FINE_PARTS, n * (p + 1) // FINE_PARTS)})
                    for a in places:
                        variant = line[:a] + line[a + 1 :]
                        emit(i, variant, n, a, False)
                        if variant not in shorter:
                            shorter.add(variant)
                            emit(i, variant, n, -1, False)
                    emit(i, line, n + 1, -1, True)
                taken = pa.array(where, pa.int64())
                columns = [rows.column(c).take(taken) for c in range(4)]
                yield pa.RecordBatch.from_arrays([*columns, _longs(v1), _longs(v2), pa.array(place, pa.int32()), pa.array(whole, pa.bool_())], ["h1", "h2", "doc_id", "no", "v1", "v2", "place", "whole"])

    return lines.select("h1", "h2", "doc_id", "no", "line", "parts").mapInArrow(found, "h1 long, h2 long, doc_id long, no int, v1 long, v2 long, place int, whole boolean")


def near_lines(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """h1, h2 of lines that an earlier line is near to, by verified edit distance."""
    keyed = lines.where("keys is not null")
    halves = keyed.select(F.explode("keys").alias("key"), "h1")
    live = halves.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("z")).where("a <> z").select("key")
    held = halves.join(live, "key", "left_semi").select("h1").distinct()
    # what remains is a small share of the lines: the first of each kind, with its text
    first, n = counted(keyed.join(held, "h1", "left_semi").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "no", VERSION)).alias("at")), "candidates")
    wanted = first.groupBy("at.doc_id", f"at.{VERSION}").agg(F.collect_list(F.struct("at.no", "h1", "h2")).alias("wanted"))
    if n <= BROADCAST_LINES:
        wanted = F.broadcast(wanted)
    texts = written(read_lines(docs.select("doc_id", VERSION, "text").join(wanted, ["doc_id", VERSION])).dropDuplicates(["h1", "h2"]), "candidate_lines")

    fine = find_parts(texts)
    shared = fine.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("z")).where("a <> z").select("key")
    parts = fine.join(shared, "key", "left_semi").groupBy("h1", "h2").agg(F.collect_set("part").alias("parts"))
    # lines sharing a key with place are at most as many as there are characters, since they differ in one
    variants = written(find_variants(texts.join(parts, ["h1", "h2"])), "variants")
    at = F.struct("doc_id", "no", "h1", "h2")
    earliest = variants.groupBy("v1", "v2").agg(F.min(at).alias("least"), F.min(F.when(F.col("whole"), at)).alias("least_whole"), F.min(F.when(~F.col("whole"), at)).alias("least_longer"), F.count("*").alias("n")).where("n > 1")
    earlier = F.when(F.col("place") >= 0, F.col("least")).when(F.col("whole"), F.col("least_longer")).otherwise(F.col("least_whole"))
    pairs = variants.join(earliest, ["v1", "v2"]).withColumn("earlier", earlier).where(F.col("earlier") < at)
    pairs = pairs.select("h1", "h2", F.col("earlier.h1").alias("e1"), F.col("earlier.h2").alias("e2")).distinct()
    both = pairs.join(texts.select("h1", "h2", "line"), ["h1", "h2"]).join(texts.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("line").alias("earlier")), ["e1", "e2"])
    return verified(both).distinct()


def one_edit(a: str, b: str) -> bool:
    """Whether at most one insertion, deletion or substitution turns one line into the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def verified(pairs: DataFrame) -> DataFrame:
    """h1, h2 of the lines that are one edit away from the one in the column ``earlier``."""

    def true(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [one_edit(a.as_py(), b.as_py()) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    return pairs.select("h1", "h2", "line", "earlier").mapInArrow(true, "h1 long, h2 long")


def strip_lines(docs: DataFrame) -> DataFrame:
    """Takes out the lines at the places in ``gone`` and their equals in the same text, and repeated lines."""
    out = T.StructType([*(f for f in docs.schema if f.name not in (GONE, VERSION)), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("lines")
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            names = batch.schema.names
            texts, gone = (batch.column(names.index(c)).to_pylist() for c in ("text", GONE))
            new, sizes, removed = [], [], []
            for text, places in zip(texts, gone, strict=True):
                lines = text.split("\n") if text is not None else []
                seen, out_places, stays = {}, set(places or ()), []
                for no, line in enumerate(lines):
                    bare = line.encode().strip(SPACE)
                    if not bare or (seen.setdefault(bare, no) == no and no not in out_places):
                        stays.append(line)
                new.append(None if text is None else "\n".join(stays))
                sizes.append(len(lines))
                removed.append(len(lines) - len(stays))
            columns = {n: c for n, c in zip(names, batch.columns, strict=True) if n not in (GONE, VERSION)}
            columns |= {"text": pa.array(new, batch.schema.field("text").type), "n_lines": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in out], [f.name for f in out])

    return docs.mapInArrow(kept, out)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with ``text`` cut down to the lines that stay, and n_lines and n_removed."""
    every = docs.drop(*({"n_lines", "n_removed"} - {doc_id, text})).withColumnsRenamed({doc_id: "doc_id", text: "text"})
    whole = every.where("doc_id is not null").withColumn(VERSION, F.xxhash64("text"))
    lines, n = counted(find_lines(whole), "lines")
    firsts = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    near = near_lines(lines, whole).withColumn("near", F.lit(True))
    judged = written(firsts.join(near, ["h1", "h2"], "left").where("least < most or near"), "judged")
    # rows of common lines stay where they are: there are few such lines, so these go to all tasks
    is_common = F.col("n") >= max(2.0, COMMON_SHARE * n)
    common = F.broadcast(judged.where(is_common))
    places = lines.select("doc_id", VERSION, "no", "h1", "h2")
    rest = places.join(common.select("h1", "h2"), ["h1", "h2"], "left_anti").join(judged.where(~is_common), ["h1", "h2"])
    gone = places.join(common, ["h1", "h2"]).union(rest).where("near or doc_id > least")
    marks = gone.groupBy("doc_id", VERSION).agg(F.collect_set("no").alias(GONE))
    out = strip_lines(whole.join(marks, ["doc_id", VERSION], "left"))
    untouched = every.where("doc_id is null").withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")).withColumn("n_removed", F.lit(0).cast("long"))
    return out.unionByName(untouched).withColumnsRenamed({"doc_id": doc_id, "text": text})


SQL = """
with split as (
  select doc_id, string_split(text, chr(10)) as lines from documents where text is not null
), placed as (
  select doc_id, unnest(lines) as raw, unnest(range(len(lines))) as no from split
), named as (
  select doc_id, no, raw, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as line from placed
), once as (
  select line, min({'doc_id': doc_id, 'no': no}) as spot, min(doc_id) as least from named where line <> '' group by line
), long as (
  select line, spot, length(line) as n from once where length(line) >= 20
), cut as (
  select line, spot, n, i, substr(line, 1, i) || substr(line, i + 2) as variant from (select *, unnest(range(n)) as i from long)
), same_length as (
  select n, i, variant, min(spot) as first from cut group by 1, 2, 3 having count(*) > 1
), near as (
  select c.line from cut c join same_length s using (n, i, variant) where s.first < c.spot
  union select c.line from cut c join long l on l.line = c.variant where l.spot < c.spot
  union select l.line from cut c join long l on l.line = c.variant where c.spot < l.spot
), judged as (
  select m.*, line <> '' and (row_number() over (partition by doc_id, line order by no) > 1 or m.doc_id > o.least or e.line is not null) as gone
  from named m left join once o using (line) left join near e using (line)
), kept as (
  select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed, coalesce(string_agg(case when not gone then raw end, chr(10) order by no), '') as text from judged group by doc_id
)
select doc_id, n_lines, n_removed, sha256(text) as text_sha256 from kept
union all select doc_id, 0, 0, null from documents where text is null
"""
