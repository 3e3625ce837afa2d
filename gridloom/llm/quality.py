"""A quality classifier: histogram gradient-boosted trees over statistics of a document's text.

Statistics are computed where the documents are and kept in a small table.  Training takes labelled documents whose
crc32(doc_id as text) mod 5 is not 0; of more than ``MAX_TRAINING_ROWS`` such labels, those whose hash of doc_id lies
below that share.  Only their statistics come to the driver.  Trees are complete and of one depth, flattened into arrays (feature, threshold,
leaf value), so scoring a batch is a few numpy gathers for each level of each tree.

Edge cases: null and empty texts have statistics of zero length and get a score; labels without a document or with a
null or contradictory quality teach nothing; without any usable label every score is 0.5; a null doc_id is never held
out; repeated rows are scored alike, whatever their number; a text of any length is one row of statistics, made in
memory; an empty table gives an empty result; input columns named like outputs are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import counted, using, written

MAX_TRAINING_ROWS = 100_000
ACCEPT = 0.3
ROWS_AT_ONCE = 500
FEATURES = (
    "log_bytes", "log_words", "bytes_per_word", "upper", "digits", "stops", "symbols", "other_bytes", "spaces", "words_per_line", "blank_lines",
    "repeated_lines", "distinct_words", "most_common_word", "repeated_neighbours", "distinct_pairs", "compressed", "words_ending_in_symbols", "capital_words", "long_words",
)

_SYMBOLS = np.array([33 <= b <= 126 and not bytes([b]).isalnum() and b not in b".,'" for b in range(256)])
_STOPS = np.isin(np.arange(256), [*b".,"])


def statistics(text: bytes) -> list[float]:
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), text.split(b"\n")
    m, full = max(1, len(words)), [x for x in lines if x.strip()]
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    same = sum(map(bytes.__eq__, words, words[1:]))
    distinct = tally.items()
    ends = sum(k for w, k in distinct if _SYMBOLS[w[-1]])
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), (n - len(words)) / m, counts[65:91].sum() / n, counts[48:58].sum() / n, counts[_STOPS].sum() / n,
        counts[_SYMBOLS].sum() / n, counts[128:].sum() / n, (counts[32] + counts[9:14].sum()) / n, len(words) / len(lines), 1 - len(full) / len(lines),
        1 - len(set(full)) / max(1, len(full)), len(tally) / m, max(tally.values(), default=0) / m, same / m, pairs / m, len(zlib.compress(text, 1)) / n,
        ends / m, sum(k for w, k in distinct if w[:1].isupper()) / m, sum(k for w, k in distinct if len(w) > 20) / m,
    ]


def document_statistics(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys and the array ``features`` of each document."""
    kept = docs.select(*keys).schema

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("quality")
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            flat = np.array([statistics(t or b"") for t in texts], np.float32).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(FEATURES)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*batch.schema.names[:-1], "features"])

    return docs.select(*keys, F.col(text).alias("_text")).mapInArrow(measure, T.StructType([*kept, T.StructField("features", T.ArrayType(T.FloatType()))]))


@dataclass
class Trees:
    """Complete trees of one depth: inner nodes by level, then leaves."""

    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2**depth
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 5, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least_weight: float = 2.0) -> Trees:
    n, f = x.shape
    inner = 2**depth - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1))
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    numbers = np.arange(n)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")).astype(np.float32) for j in range(f)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left").astype(np.int32) for j in range(f)])  # value > edges[b] if and only if bin > b
    raw = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            many = 2**level
            begin = ((node - (many - 1)) * bins).astype(np.int32)
            # a feature at a time: no array longer than the rows
            sums = [np.stack([np.bincount(begin + own, v, many * bins).reshape(many, bins) for own in binned], axis=1) for v in (g, h)]
            (gl, hl), (ga, ha) = (np.cumsum(s, axis=2) for s in sums), (s.sum(axis=2, keepdims=True) for s in sums)
            gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
            gain[(hl < least_weight) | (ha - hl < least_weight)] = 0
            for j in range(f):
                gain[:, j, len(edges[j]) :] = 0  # no such threshold
            best = gain.reshape(many, -1).argmax(axis=1)
            j, b = best // bins, best % bins
            good = gain.reshape(many, -1)[np.arange(many), best] > 1e-9
            ids = many - 1 + np.arange(many)
            feature[t, ids] = j
            threshold[t, ids] = [edges[a][c] if ok else np.inf for a, c, ok in zip(j, b, good, strict=True)]
            mine = node - (many - 1)
            node = 2 * node + 1 + (good[mine] & (binned[j[mine], numbers] > b[mine]))
        last = node - inner
        gs, hs = np.bincount(last, g, inner + 1), np.bincount(last, h, inner + 1)
        leaf[t] = -rate * gs / (hs + ridge)
        raw += leaf[t][last]
    return Trees(feature, threshold, leaf, base, depth)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(features: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> Trees | None:
    """Trees learnt from the labelled documents that are not held out: of about ``max_rows`` labels at most, one row each.

    Of rows repeating a labelled doc_id the one with the least features is learnt from, so however many there are, no
    more rows than labels come to the driver.
    """
    known = labels.where(F.col(quality).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(quality).alias("y"), F.max(quality).alias("z"))
    sure, n = counted(known.where("y = z").where(~held_out("doc_id")).select("doc_id", F.col("y").cast("int").alias("y")), "labels")
    if n > max_rows:
        sure = sure.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(max_rows / n * 2**40))
    few = features.join(F.broadcast(sure), "doc_id").groupBy("doc_id", "y").agg(F.min("features").alias("features")).select("doc_id", "features", "y").toArrow()
    if not few.num_rows:
        return None
    x = np.asarray(few.column("features").combine_chunks().flatten()).reshape(few.num_rows, -1)
    y, ids = np.asarray(few.column("y")).astype(np.float64), np.asarray(few.column("doc_id"))
    order = np.argsort(ids, kind="stable")  # the same trees on every run
    return train(x[order], y[order])


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", keys: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and ``keys``, held_out, score and predicted of each document."""
    named = docs.select(F.col(doc_id).alias("doc_id"), *keys, F.col(text).alias("_t"))
    features = written(document_statistics(named, "_t", ("doc_id", *keys)), "statistics")
    model = fit(features, labels)
    out = T.StructType([*features.drop("features").schema, T.StructField("score", T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("quality")
        for batch in batches:
            x = np.asarray(batch.column(batch.num_columns - 1).flatten()).reshape(batch.num_rows, -1)
            score = model.score(x) if model is not None else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], [*batch.schema.names[:-1], "score"])

    return features.mapInArrow(scored, out).select("doc_id", *keys, held_out("doc_id").alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose score is at least ``ACCEPT``, as they are.

    Statistics are computed twice, once to learn and once to decide, so texts neither move nor are written.
    """
    model = fit(document_statistics(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")), "_t"), labels)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("quality")
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                texts = rows.column(rows.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
                x = np.array([statistics(t or b"") for t in texts], np.float32)
                yield rows.filter(pa.array(model.score(x) >= ACCEPT if model is not None else np.ones(len(x), bool)))

    return docs.mapInArrow(good, docs.schema)
