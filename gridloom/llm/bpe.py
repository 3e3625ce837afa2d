"""BPE encoding and decoding with a public tokenizer file.

Method: tree concatenation.  A text of more than ``LEAF_CHARS`` is cut without looking at what stands there, both halves
are encoded on their own, and around the join a growing window is encoded until a token of the window is found, with the
same place and id, in the left and in the right encoding.  Two tokens that BPE leaves side by side in one text stay side
by side in any other, so left head + window + right tail is then exactly the encoding of the whole.  ``bpe_encode``
spreads the pieces of rows over ``split_chars`` over all tasks; the halves of other rows are encoded in their task.
Inside a half, words between ASCII white space are independent: each task keeps the ids of words it has met, and looks
for the places of tokens only near the ends of the half, unless a window grows beyond.

Rows over ``split_chars`` are looked for in a scan of their own, which costs less than writing all texts once.

Edge cases: null text is encoded as the empty text (no ids); null or empty ids decode to ''; repeated rows stay; a very
long text, with or without white space, is encoded in pieces; an empty table gives an empty table.  Output columns
replace input columns of the same name; other columns pass through.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import holds, using

#: Longest stretch of text that is encoded at once.
LEAF_CHARS = 8192
#: Rows longer than this are cut into pieces that separate tasks encode.
SPLIT_CHARS = 1 << 15
#: Columns of this module beside those of the input.
ROW, FROM, PIECE, IDS, PLACES, INNER = "_bpe_row", "_bpe_from", "_bpe_piece", "_bpe_ids", "_bpe_places", "_bpe_inner"
#: First reach of the window on each side of a join.
WINDOW_CHARS = 64
#: Words whose ids a Python worker remembers at most.
CACHED_WORDS = 300_000
#: Rows of an Arrow batch that are worked on at a time.
ROWS_AT_ONCE = 500
#: Characters of text that are turned into words at a time.
CHUNK_CHARS = 1_000_000


#: The one kind of tokenizer whose normalising and splitting are known well enough to do them on bytes.
KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
KNOWN_NORMALIZERS = ["NFC", "Replace", "Lowercase"]

_SPACE, _UPPER, _LOWER = b" \t\n\r\x0b\x0c", bytes(range(65, 91)), bytes(range(97, 123))
_LATIN = bytes(range(0x80, 0xC0)) + b"\xc3"  # bytes of Latin-1 letters
#: Each byte's kind: letter or digit a, space, stop or comma ".", other punctuation !, anything else X.
KINDS = bytes(
    ord("a") if bytes([b]).isalnum() or b in _LATIN else ord(" ") if b in _SPACE else ord(".") if b in b".," else ord("!") if 33 <= b <= 126 else ord("X") for b in range(256)
)
#: Bytes of lower-case letters up to U+00FF.
LOWER = _LOWER + b"\xc3\x9f" + bytes(b for b in range(0xA0, 0xC0) if b != 0xB7)


PIECES = re.compile(rb"[a-z\x80-\xbf\xc3]+|[0-9]|[!-/:-@\[-`{-~]+")


def simple_split(text: bytes) -> list[bytes] | None:
    """The lower-case words, digits and runs of punctuation of a text that is Latin-1 letters and ASCII.

    None where splitting takes more: other characters, added tokens, apostrophes beside other punctuation.
    """
    kinds = text.translate(KINDS)
    if b"X" in kinds or b"<|" in text or b"\xc3\x97" in text or b"\xc3\xb7" in text:
        return None
    if not (b".." in kinds or b".!" in kinds or b"!." in kinds):  # stops and commas stand alone
        return text.lower().replace(b".", b" . ").replace(b",", b" , ").split()
    return PIECES.findall(text.lower()) if b"'" not in text else None


FIRST_SPACE, LAST_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]"), re.compile(r"[ \t\n\r\x0b\x0c](?=[^ \t\n\r\x0b\x0c]*\Z)")


class Words(dict):
    """Numbers for words as they come; ``new`` holds those without ids yet."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def safe_cut(text: str, at: int, added: list[str]) -> int:
    """The first place from ``at`` on where normalisation cannot reach across and no added token is cut."""
    while at < len(text):
        c = text[at]
        if unicodedata.category(c)[0] == "M" or "ᅠ" <= c <= "ᇿ":
            at += 1
            continue
        for token in added:
            found = text.find(token, max(0, at - len(token) + 1), at + len(token) - 1)
            if 0 <= found < at:
                at = found + len(token)
                break
        else:
            return at
    return len(text)


class Piece:
    """Ids of a stretch of a text and the places in the text where their characters begin.

    inner: the part of the text whose tokens' places are not known (they are given as its begin), if any.
    """

    def __init__(self, ids: np.ndarray, places: np.ndarray, inner: tuple[int, int] | None = None) -> None:
        self.ids, self.places, self.inner = ids, places, inner

    def keys(self) -> list[tuple[int, int]]:
        return list(zip(self.places.tolist(), self.ids.tolist(), strict=True))


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Encoder:
    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS, cached_words: int = CACHED_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = load(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.leaf_chars, self.cached_words = leaf_chars, cached_words
        made = json.loads(self.tokenizer.to_str())
        normal, split, suffix = made["normalizer"] or {}, (made["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0], made["model"].get("end_of_word_suffix")
        self.simple = bool(suffix) and [x["type"] for x in normal.get("normalizers", [])] == KNOWN_NORMALIZERS and split.get("pattern") == {"Regex": KNOWN_SPLIT}
        if self.simple:
            made["normalizer"] = None
            self.lower = Tokenizer.from_str(json.dumps(made))
            self.last = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
            for token, i in self.tokenizer.get_vocab().items():
                self.last[i] = token.endswith(suffix)
        self.forget()

    def forget(self) -> None:
        self.words = Words()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def piece(self, text: str, begin: int, end: int) -> Piece:
        e = self.tokenizer.encode(text[begin:end], add_special_tokens=False)
        return Piece(np.asarray(e.ids, np.uint32), np.fromiter((x[0] for x in e.offsets), np.int64, len(e.ids)) + begin)

    def half(self, text: str, begin: int, end: int) -> Piece:
        """As ``piece``, but words well inside take their ids from what is known."""
        near = 2 * WINDOW_CHARS
        inner = text[begin + near : end - near]
        cuts = [m.start() for m in (FIRST_SPACE.search(inner), LAST_SPACE.search(inner)) if m]
        if len(cuts) < 2 or cuts[0] >= cuts[1]:
            return self.piece(text, begin, end)
        h, t = (begin + near + x for x in cuts)
        head, tail = self.piece(text, begin, h), self.piece(text, t, end)
        ids = self.encode_all([text[h:t].encode()])[0]
        return Piece(np.concatenate([head.ids, ids, tail.ids]), np.concatenate([head.places, np.full(len(ids), h), tail.places]), (h, t))

    def join(self, text: str, left: Piece, right: Piece, begin: int, at: int, end: int, reach: int = WINDOW_CHARS) -> Piece:
        """The encoding of text[begin:end] from those of text[begin:at] and text[at:end]."""
        while True:
            a = begin if at - reach <= begin else min(safe_cut(text, at - reach, self.added), at)
            b = end if at + reach >= end else min(safe_cut(text, at + reach, self.added), end)
            if a > begin and left.inner and a < left.inner[1]:
                left = self.piece(text, begin, at)
            if b < end and right.inner and b > right.inner[0]:
                right = self.piece(text, at, end)
            middle = self.piece(text, a, b)
            if a == begin and b == end:
                return middle
            keys = middle.keys()
            fresh = [i == 0 or keys[i][0] != keys[i - 1][0] for i in range(len(keys))]  # not within a character
            i0, j0, i1, j1 = 0, 0, len(right.ids), len(keys)
            if a > begin:
                lo = int(np.searchsorted(left.places, a))
                heads = {k: lo + i for i, k in enumerate(Piece(left.ids[lo:], left.places[lo:]).keys())}
                j0 = next((j for j, k in enumerate(keys) if fresh[j] and k in heads), -1)
                i0 = heads[keys[j0]] if j0 >= 0 else 0
            if b < end:
                hi = int(np.searchsorted(right.places, b))
                tails = {k: i for i, k in reversed([*enumerate(Piece(right.ids[:hi], right.places[:hi]).keys())])}
                j1 = next((j for j in reversed(range(len(keys))) if fresh[j] and keys[j] in tails), -1)
                i1 = tails[keys[j1]] if j1 >= 0 else 0
            if j0 < 0 or j1 < 0 or j0 > j1:
                reach *= 2
                continue
            head = left.ids[:i0] if a > begin else left.ids[:0], left.places[:i0] if a > begin else left.places[:0]
            unknown = [x.inner for x in (left if a > begin else None, right if b < end else None) if x is not None and x.inner]
            inner = (unknown[0][0], unknown[-1][1]) if unknown else None
            return Piece(*(np.concatenate(x) for x in zip(head, (middle.ids[j0:j1], middle.places[j0:j1]), (right.ids[i1:], right.places[i1:]), strict=True)), inner)

    def tree(self, text: str, pieces: list[Piece], cuts: list[int]) -> Piece:
        """Joins neighbours, level by level; pieces[i] encodes text[cuts[i]:cuts[i + 1]]."""
        while len(pieces) > 1:
            odd = pieces[-1:] if len(pieces) % 2 else []
            pieces = [self.join(text, pieces[i], pieces[i + 1], cuts[i], cuts[i + 1], cuts[i + 2]) for i in range(0, len(pieces) - 1, 2)] + odd
            cuts = cuts[::2] if len(cuts) % 2 else [*cuts[::2], cuts[-1]]
        return pieces[0]

    def cuts(self, text: str, chars: int | None = None) -> list[int]:
        places = [0]
        while places[-1] < len(text):
            places.append(safe_cut(text, min(places[-1] + (chars or self.leaf_chars), len(text)), self.added))
        return places

    def long(self, text: str) -> Piece:
        """Halves, by the tree."""
        cuts = self.cuts(text)
        return self.tree(text, [self.half(text, a, b) for a, b in zip(cuts, cuts[1:], strict=False)], cuts)

    def unbroken(self, text: str) -> np.ndarray:
        return self.long(text).ids if len(text) > self.leaf_chars else self.encode(text)

    def encode_texts(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Ids of each text; long ones go by the tree, the words of others are looked up."""
        found = [x.decode() if x is not None and len(x) > self.leaf_chars else None for x in texts]
        out = self.encode_all([x if y is None or len(y) <= self.leaf_chars else b"" for x, y in zip(texts, found, strict=True)])
        return [self.long(y).ids if y is not None and len(y) > self.leaf_chars else x for x, y in zip(out, found, strict=True)]

    def learn(self) -> None:
        """Finds the ids of new words, short ones many at a time.

        Words of lower-case letters are told apart by the tokens that end words, others by their places.
        """
        new, self.words.new = self.words.new, []
        counts, order, parts = np.zeros(len(new), np.int64), [], []
        simple = [i for i, w in enumerate(new) if self.simple and len(w) <= 512 and not w.translate(None, LOWER)]
        other = np.ones(len(new), bool)
        other[simple] = False
        lots = [simple[at : at + 1000] for at in range(0, len(simple), 1000)]
        joined = [b" ".join([new[i] for i in lot]).decode() for lot in lots]
        for lot, e in zip(lots, self.lower.encode_batch_fast(joined, add_special_tokens=False), strict=True):  # without places
            parts.append(np.asarray(e.ids, np.uint32))
            counts[lot] = np.diff(np.flatnonzero(self.last[parts[-1]]), prepend=-1)
            order += lot
        rest = np.flatnonzero(other).tolist()
        texts = [new[i].decode() for i in rest]
        at = 0
        while at < len(texts):
            if len(texts[at]) > 512:
                parts.append(self.unbroken(texts[at]))
                counts[rest[at]] = len(parts[-1])
                at += 1
                continue
            to = at
            while to < len(texts) and to - at < 1000 and len(texts[to]) <= 512:
                to += 1
            e = self.tokenizer.encode("\n".join(texts[at:to]), add_special_tokens=False)
            begins = np.cumsum([0] + [len(x) + 1 for x in texts[at : to - 1]])
            places = np.fromiter((x[0] for x in e.offsets), np.int64, len(e.ids))
            counts[rest[at:to]] = np.bincount(np.searchsorted(begins, places, "right") - 1, minlength=to - at)
            parts.append(np.asarray(e.ids, np.uint32))
            at = to
        order += rest
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        start, n = np.empty(len(new), np.int64), counts[order]
        start[order] = self.used + np.cumsum(n) - n
        self.start, self.length = np.concatenate([self.start, start]), np.concatenate([self.length, counts])
        self.used += len(ids)

    def split(self, text: bytes) -> list[bytes]:
        """On ASCII white space, or finer where that is simple."""
        found = simple_split(text) if self.simple else None
        return text.split() if found is None else found

    def encode_all(self, texts: list[bytes | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            words: list[bytes] = []
            ends, size = [], 0
            while at < len(texts) and (size < CHUNK_CHARS or not ends):
                words += self.split(texts[at] or b"")
                ends.append(len(words))
                size += len(texts[at] or b"")
                at += 1
            if len(self.words) > self.cached_words:
                self.forget()
            numbers = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
            if self.words.new:
                self.learn()
            lengths = self.length[numbers]
            stops = np.cumsum(lengths)
            total = int(stops[-1]) if len(stops) else 0
            ids = self.flat[np.repeat(self.start[numbers] - (stops - lengths), lengths) + np.arange(total)]
            bounds = np.concatenate([[0], stops])[ends]
            out += np.split(ids, bounds[:-1])
        return out


_encoders: dict[tuple, Encoder] = {}
_decoders: dict[str, object] = {}


def _drop() -> None:
    _encoders.clear()
    _decoders.clear()


holds("bpe", _drop)


def encoder(path: str, leaf_chars: int = LEAF_CHARS) -> Encoder:
    """One for each Python worker, which lives through many tasks."""
    using("bpe")
    if (path, leaf_chars) not in _encoders:
        _encoders[path, leaf_chars] = Encoder(path, leaf_chars)
    return _encoders[path, leaf_chars]


def binary_array(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != name]
    return pa.RecordBatch.from_arrays([*columns, values], [*(n for n in batch.schema.names if n != name), name])


def _without(batch: pa.RecordBatch, name: str) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in kept], kept)


def _with(df: DataFrame | T.StructType, name: str, kind: T.DataType) -> T.StructType:
    fields = df if isinstance(df, T.StructType) else df.schema
    return T.StructType([*(f for f in fields if f.name != name), T.StructField(name, kind)])


def _decoded(tokenizer, ids: list[bytes | None]) -> pa.Array:
    return pa.array(tokenizer.decode_batch([np.frombuffer(x or b"", "<u4").tolist() for x in ids], skip_special_tokens=False), pa.string())


def bpe_encode(df: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids", split_chars: int | None = SPLIT_CHARS, leaf_chars: int = LEAF_CHARS, decoded: str | None = None) -> DataFrame:
    """Adds ``ids``: the token ids of ``text`` as little-endian unsigned 32-bit integers (binary).

    Without ``split_chars`` every row stays in its task, and partitions keep their order.  ``decoded`` names a column for
    what decoding makes of the ids, as ``bpe_decode`` adds it, but in the same worker and without the text: it takes its place.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer_path, leaf_chars)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                texts = part.column(part.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
                found = [x.astype("<u4").tobytes() for x in e.encode_texts(texts)]
                if decoded is not None:
                    part = _replaced(_without(part, text), decoded, _decoded(e.tokenizer, found))
                yield _replaced(part, ids, binary_array(found))

    out = _with(df if decoded is None else _with(df.drop(text), decoded, T.StringType()), ids, T.BinaryType())
    if split_chars is None:
        return df.mapInArrow(whole, out)
    long = F.length(text) > split_chars
    short = df.where(F.coalesce(~long, F.lit(True))).mapInArrow(whole, out)
    rest = _encode_long(df.where(long), tokenizer_path, text, ids, leaf_chars, split_chars, decoded, out)
    return short.unionByName(rest.select(short.columns))


def _encode_long(df: DataFrame, path: str, text: str, ids: str, leaf_chars: int, split_chars: int, decoded: str | None, out: T.StructType) -> DataFrame:
    """Rows of long text: pieces of ``split_chars`` are encoded by separate tasks and joined in a tree.

    The texts move once to be encoded and once, beside their ids, to be joined.  A document's pieces are one group.
    """
    wide = df.drop(ids).withColumn(ROW, F.monotonically_increasing_id())
    kept = T.StructType([T.StructField(f.name, f.dataType) for f in wide.schema if f.name != text])  # pieces after the first hold NULLs
    pieces = T.StructType([*kept, T.StructField(FROM, T.LongType()), T.StructField(PIECE, T.StringType())])
    coded = T.StructType([*pieces, *(T.StructField(n, T.BinaryType()) for n in (IDS, PLACES)), T.StructField(INNER, T.ArrayType(T.LongType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, leaf_chars)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                whole = row.column(row.schema.get_field_index(text))[0].as_py()
                cuts = e.cuts(whole, split_chars)
                n = len(cuts) - 1
                columns = []
                for f in kept:
                    c = row.column(row.schema.get_field_index(f.name))
                    columns.append(c.take(pa.array([0] * n)) if f.name == ROW else pa.concat_arrays([c, pa.nulls(n - 1, c.type)]))
                columns += [pa.array(cuts[:-1], pa.int64()), pa.array([whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), FROM, PIECE])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, leaf_chars)
        for batch in batches:
            found, inner = [], []
            for piece, begin in zip(batch.column(batch.schema.get_field_index(PIECE)).to_pylist(), batch.column(batch.schema.get_field_index(FROM)).to_pylist(), strict=True):
                p = e.long(piece)
                found.append((p.ids.astype("<u4").tobytes(), (p.places + begin).astype("<i8").tobytes()))
                inner.append(None if p.inner is None else [x + begin for x in p.inner])
            columns = [*batch.columns, binary_array([x[0] for x in found]), binary_array([x[1] for x in found]), pa.array(inner, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, IDS, PLACES, INNER])

    def concatenated(group: pa.Table) -> pa.Table:
        e = encoder(path, leaf_chars)
        group = group.sort_by(FROM)
        whole = "".join(group.column(PIECE).to_pylist())
        cuts = [*group.column(FROM).to_pylist(), len(whole)]
        parts = zip(*(group.column(c).to_pylist() for c in (IDS, PLACES, INNER)), strict=True)
        pieces = [Piece(np.frombuffer(a, "<u4"), np.frombuffer(b, "<i8"), None if c is None else tuple(c)) for a, b, c in parts]
        found = [e.tree(whole, pieces, cuts).ids.astype("<u4").tobytes()]
        columns = {f.name: group.column(f.name).slice(0, 1) for f in kept} | {text: pa.array([whole])}
        if decoded is not None:  # here: another function after this one would take another worker, with a tokenizer of its own
            columns[decoded] = _decoded(e.tokenizer, found)
        columns[ids] = binary_array(found)
        return pa.table({f.name: columns[f.name] for f in out})

    encoded = wide.mapInArrow(cut, pieces).hint("rebalance", ROW, FROM).mapInArrow(code, coded)  # as many tasks as the pieces' size asks for
    return encoded.groupBy(ROW).applyInArrow(concatenated, out)


def bpe_decode(df: DataFrame, tokenizer_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds ``text``: what the tokenizer's own decoding makes of ``ids``, special tokens included."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("bpe")
        t = _decoders[tokenizer_path] = _decoders.get(tokenizer_path) or load(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                yield _replaced(part, text, _decoded(t, part.column(part.schema.get_field_index(ids)).to_pylist()))

    return df.mapInArrow(decode, _with(df, text, T.StringType()))


def token_counts(ids: str = "ids"):
    return F.expr(f"octet_length({ids}) div 4")
