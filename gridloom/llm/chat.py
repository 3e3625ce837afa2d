r"""Chat formatting by columnar byte assembly.

A turn becomes ``### role: text </turn>\n``.  Inside roles and texts a backslash, ``#`` and the slash of ``</turn>`` get
a backslash before them (in roles also ``:``), so the output holds control strings only where the template put them,
and dropping the backslash of every pair gives the text back.

Turns arrive sorted by conversation.  For a run of whole conversations the lengths of all segments give, by cumulative
sums, the place of every byte; headers, roles and texts are scattered into one preallocated buffer, which becomes the
output column as it is.  Spans of assistant texts, in bytes of the output, are the loss mask.

Edge cases: null text and null role are empty; a null conv_id is a conversation of its own; turns with equal numbers
are ordered by role, then text, and repeated rows are repeated turns; an empty table gives an empty result.  A
conversation is one output row and so must fit in memory; other columns are not read, so they cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

HEAD, MIDDLE, TAIL = b"### ", b": ", b" </turn>\n"
LEARNT_ROLE = "assistant"
#: Bytes of formatted conversations that are assembled at once.
BUFFER_BYTES = 16 << 20
#: Texts longer than this are copied as slices, since scatter indices take 16 bytes a byte.
SLICED_BYTES = 1 << 16


def escaped(text: Column) -> Column:
    for plain, marked in (("\\", "\\\\"), ("#", "\\#"), ("</turn>", "<\\/turn>")):
        text = F.replace(text, F.lit(plain), F.lit(marked))
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data, begins and lengths of a string column without nulls."""
    column = column.cast(pa.large_binary())
    places = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), places[:-1], np.diff(places)


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> None:
    for i in np.flatnonzero(lengths > SLICED_BYTES).tolist():
        out[to[i] : to[i] + lengths[i]] = data[begins[i] : begins[i] + lengths[i]]
    short = lengths <= SLICED_BYTES
    to, begins, lengths = to[short], begins[short], lengths[short]
    steps = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(to, lengths) + steps] = data[np.repeat(begins, lengths) + steps]


def _stamp(out: np.ndarray, to: np.ndarray, mark: bytes) -> None:
    out[to[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)


def assemble(conv: pa.Array, first: np.ndarray, role: pa.Array, text: pa.Array, learnt: np.ndarray) -> pa.RecordBatch:
    """A row per conversation from the turns of whole conversations; first: where each conversation begins."""
    (roles, role_at, role_n), (texts, text_at, text_n) = _bytes(role), _bytes(text)
    n = len(HEAD) + role_n + len(MIDDLE) + text_n + len(TAIL)
    ends = np.cumsum(n)
    begins = ends - n
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    text_to = begins + len(HEAD) + role_n + len(MIDDLE)
    _stamp(out, begins, HEAD)
    _scatter(out, begins + len(HEAD), roles, role_at, role_n)
    _stamp(out, begins + len(HEAD) + role_n, MIDDLE)
    _scatter(out, text_to, texts, text_at, text_n)
    _stamp(out, text_to + text_n, TAIL)
    bounds = np.append(begins[first], ends[-1])
    turns = np.diff(np.append(first, len(n)))
    formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out))
    of = np.repeat(np.arange(len(first)), turns)[learnt]
    spans = pa.StructArray.from_arrays([pa.array((text_to - bounds[:-1].repeat(turns))[learnt]), pa.array((text_to + text_n - bounds[:-1].repeat(turns))[learnt])], ["begin", "end"])
    loss = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(first)))]).astype(np.int32)), spans)
    return pa.RecordBatch.from_arrays([conv.take(pa.array(first)), pa.array(turns), formatted, loss], ["conv_id", "n_turns", "formatted", "loss"])


FORMATTED = "conv_id long, n_turns long, formatted string, loss array<struct<begin: long, end: long>>"


def format_chat(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learnt_role: str = LEARNT_ROLE) -> DataFrame:
    """conv_id, n_turns, formatted and loss (spans of bytes of the texts to learn) of each conversation."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finished(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = rows.combine_chunks()
            conv, roles, texts = (rows.column(c).combine_chunks() if rows.num_rows else pa.array([], rows.schema.field(c).type) for c in ("conv_id", "role", "text"))
            learnt = np.asarray(rows.column("learnt"))
            first = np.flatnonzero(_changes(rows.column("conv_id")))
            sizes = np.add.reduceat(_bytes(texts)[2] + _bytes(roles)[2] + 15, first)
            stops = np.append(first[1:], rows.num_rows)
            at = 0
            while at < len(first):
                to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), BUFFER_BYTES, "right")))
                a, n = int(first[at]), int(stops[to - 1] - first[at])
                yield assemble(conv.slice(a, n), first[at:to] - a, roles.slice(a, n), texts.slice(a, n), learnt[a : a + n])
                at = to

        for batch in batches:
            if not batch.num_rows:
                continue
            joined = pa.chunked_array([held[-1].column(0).slice(held[-1].num_rows - 1), batch.column(0)]) if held else batch.column(0)
            begins = np.flatnonzero(_changes(joined)[1:]) if held else np.flatnonzero(_changes(joined))
            if not len(begins) or begins[-1] == 0 and not held:
                held.append(batch)
                continue
            last = int(begins[-1])
            yield from finished(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = [batch.slice(last)]
        if held:
            yield from finished(pa.Table.from_batches(held))

    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), text_or_empty(role).alias("role"), text_or_empty(text).alias("text"))
    rows = rows.select("conv_id", "turn", F.replace(escaped(F.col("role")), F.lit(":"), F.lit("\\:")).alias("role"), escaped(F.col("text")).alias("text"), (F.col("role") == learnt_role).alias("learnt"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(whole, FORMATTED)


def _changes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values, known = column.fill_null(0).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.fill_null(0).to_numpy(), np.asarray(column.is_valid())
    return np.concatenate([[True], (values[1:] != values[:-1]) | (known[1:] != known[:-1])]) if len(values) else np.zeros(0, bool)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns = []
    for part in formatted.split(TAIL.decode())[:-1]:
        head = re.match(r"### ((?:[^\\:]|\\.)*): ", part, re.DOTALL)
        turns.append((unescape(head[1]), unescape(part[head.end() :])))
    return turns


def read_chat(chats: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text) and learnt (texts under the loss mask), all read from ``formatted``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = pa.struct([("role", pa.string()), ("text", pa.string())])
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                rows = batch.slice(begin, 500)
                turns, learnt = [], []
                for text, spans in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                    data = text.encode()
                    turns.append([{"role": r, "text": t} for r, t in parse(text)])
                    learnt.append([unescape(data[s["begin"] : s["end"]].decode()) for s in spans])
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(turns, pa.list_(turn)), pa.array(learnt, pa.list_(pa.string()))], ["conv_id", "formatted", "turns", "learnt"])

    return chats.select("conv_id", "formatted", "loss").mapInArrow(read, "conv_id long, formatted string, turns array<struct<role: string, text: string>>, learnt array<string>")


SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, * from (values (0, 'user', '\### Assistant: </turn> ok'), (1, 'assistant', '\### Assistant: </turn> ok')) t(turn, role, text)
), marked as (
  select *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>') as e,
         replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), ':', '\:') as r from turns
), told as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, r, e) as said,
         coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, r, e), '') as learnt, sum(4 + length(r) + 2 + length(e) + 9)::bigint as formatted_chars
  from marked group by conv_id
)
select conv_id, n_turns, sha256(said) as turns_sha256, length(learnt) as loss_chars, sha256(learnt) as loss_sha256, formatted_chars from told
"""
