r"""Divergence between sources of a language and the terms that mark each, by a heavy-light split.

Terms are runs of ASCII letters and non-ASCII characters, A to Z lower-cased; of each language the terms in at least
``least_docs`` documents are kept.  Every source of a language, and the language itself, gives each kept term the smoothed
share p = 1 + floor(10^9 (count + 2) / (N + 2V)); two of them differ in a term by f = floor((p - q)^2 / (p + q)).

The sum of f over all V terms is needed for every pair of sources, though a source lacks most terms.  A lacking source has
the same share z for each of them, so the sum is V times f(z, z') plus corrections for terms that either source has:

* heavy terms, in many sources: dense tiles of TILE_TERMS terms by blocks of TILE_SOURCES sources, summed with numpy;
* light terms, in at most ``light`` sources (MOST_LIGHT, and a quarter of the language's sources): what a source's term
  adds against sources without it depends on its count alone, so each source's light terms are counted by share and
  added in the tiles; what two sources that both have the term add beyond that comes from the posting pairs of the term,
  at most MOST_LIGHT * (MOST_LIGHT - 1) / 2 of them.

All parts are whole numbers and are added exactly: shares are divided as decimals, f fits 64 bits.

Counts are made in tasks before they move (a task flushes them at FLUSH_TERMS), so no language, source or term is one
task; terms are dealt into tiles by hash.  The result has a row for each ordered pair of sources, as the report asks, and
a tile reads each block of sources once for each other block.

Edge cases: null text, lang and source are empty; a source without terms has z everywhere; without kept terms every pair
has value 0; a repeated row is a document of its own; texts of any length are counted in pieces; an empty table gives an
empty result; other columns are not read, so they cannot clash.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, text_or_empty, using, written

SCALE = 1_000_000_000
LEAST_DOCS = 10
TOP_TERMS = 10
MOST_LIGHT = 16
TILE_TERMS, TILE_SOURCES = 512, 64
#: Different terms that a task holds before it gives their counts away.
FLUSH_TERMS = 200_000
#: Bytes of a text that are cut into terms at once.
PIECE_BYTES = 1 << 20

#: Bytes of terms as they count, all others a space: A to Z lower-cased, a to z and whatever is not ASCII as it is.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    data, begin = text.translate(_TERM_BYTES), 0
    while len(data) - begin > PIECE_BYTES:
        end = data.rfind(b" ", begin, begin + PIECE_BYTES)
        end = end if end >= 0 else data.find(b" ", begin + PIECE_BYTES)
        if end < 0:
            break
        yield data[begin:end].split()
        begin = end + 1
    yield (data[begin:] if begin else data).split()


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs, summed within tasks; and a row without a term for each source."""
    names = ["lang", "source", "term", "n", "docs"]

    def flushed(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            columns = [pa.array([*(t.decode() for t in terms), None], pa.string()), pa.array([*n.values(), 0], pa.int64()), pa.array([*map(docs.__getitem__, terms), 0], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([x] * (len(terms) + 1), pa.string()) for x in (lang, source)] + columns, names)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("terms")
        held: dict = defaultdict(lambda: (Counter(), Counter()))
        for batch in batches:
            for lang, source, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                n, docs = held[lang.as_py(), source.as_py()]
                parts = pieces(text.as_buffer().to_pybytes())
                words = next(parts)
                n.update(words)
                seen = set(words)
                for words in parts:
                    n.update(words)
                    seen.update(words)
                docs.update(seen)
                if sum(len(x[0]) for x in held.values()) > FLUSH_TERMS:
                    yield from flushed(held)
                    held.clear()
        yield from flushed(held)

    return docs.mapInArrow(counted, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + 2) / (total + 2 terms)), exactly."""
    wide = lambda x: x.cast("decimal(20,0)")
    top, bottom = wide(n + 2) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + 2 * terms)
    return F.call_function("div", top, bottom) + 1


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // np.maximum(p + q, 1)


def tile_sums(key: tuple, rows: pa.Table) -> pa.Table:
    """lang, a, b (a < b) and value: what one tile adds to the pairs of its blocks of sources.

    Rows: sources (share z of an absent term, number of kept terms), shares of heavy terms, and light shares with how many
    terms have them.
    """
    lang, tile, block_a, block_b = (k.as_py() for k in key)
    kind, p, m = (np.asarray(rows.column(c)) for c in ("kind", "p", "m"))
    coded = rows.column("source").combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)  # by code point, as UTF-8 sorts
    at = np.empty(len(names), np.int64)
    at[order] = np.arange(len(names))
    names, source = [names[i] for i in order], at[np.asarray(coded.indices)]
    z, block, v = (np.zeros(len(names), np.int64) for _ in range(3))
    is_source = kind == 0
    z[source[is_source]], v[source[is_source]] = p[is_source], m[is_source]
    block[source] = np.asarray(rows.column("block"))
    total = np.zeros((len(names), len(names)), np.int64)  # a pair's parts stand in either half

    heavy = np.flatnonzero(kind == 1)
    terms = rows.column("term").combine_chunks().take(pa.array(heavy)).dictionary_encode()
    n_terms = len(terms.dictionary)
    shares = np.repeat(z[:, None], n_terms, axis=1)
    shares[source[heavy], np.asarray(terms.indices)] = p[heavy]
    light = np.flatnonzero(kind == 2)
    light = light[np.argsort(source[light], kind="stable")]
    bounds = np.searchsorted(source[light], np.arange(len(names) + 1))
    for i in range(len(names)):
        base = _differences(z[i], z)
        total[i, i + 1 :] += (n_terms and _differences(shares[i], shares[i + 1 :]).sum(axis=1)) - (n_terms - (v[i] if tile == 0 else 0)) * base[i + 1 :]
        own = light[bounds[i] : bounds[i + 1]]
        if len(own):
            total[i] += (m[own, None] * (_differences(p[own, None], z) - base)).sum(axis=0)
    a, b = np.triu_indices(len(names), 1)
    if block_a != block_b:
        across = block[a] != block[b]
        a, b = a[across], b[across]
    value = total[a, b] + total[b, a]
    return pa.table([pa.array([lang] * len(a), pa.string()), pa.array([names[i] for i in a], pa.string()), pa.array([names[i] for i in b], pa.string()), pa.array(value)], ["lang", "a", "b", "value"])


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value and rank: each source's other sources and its top terms, most divergent first."""
    rows = docs.select(text_or_empty(lang).alias("lang"), text_or_empty(source).alias("source"), text_or_empty(text).alias("text"))
    counts = written(count_terms(rows).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    sources = counts.where("term is null").select("lang", "source")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n"), F.count("*").alias("in_sources")).where(F.col("docs") >= least_docs)
    light = F.least(F.lit(MOST_LIGHT), F.floor(F.col("n_sources") / 4))
    kept = kept.join(sources.groupBy("lang").agg(F.count("*").alias("n_sources")), "lang").select("lang", "term", "all_n", (F.col("in_sources") > light).alias("heavy"))
    kept = written(kept, "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_n"), F.count_if("heavy").alias("n_heavy"))
    langs = sources.groupBy("lang").agg(F.count("*").alias("n_sources")).join(langs, "lang", "left").fillna(0)
    tiles, blocks = (F.greatest(F.ceil(F.col(c) / size), F.lit(1)).cast("int") for c, size in (("n_heavy", TILE_TERMS), ("n_sources", TILE_SOURCES)))
    langs = langs.select("lang", "v", "lang_n", tiles.alias("tiles"), blocks.alias("blocks"))

    postings = written(counts.where("term is not null").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "postings")
    info = sources.join(langs, "lang").join(postings.groupBy("lang", "source").agg(F.sum("n").alias("source_n")), ["lang", "source"], "left").fillna(0, "source_n")
    z = F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("source_n"), F.col("v"))).otherwise(F.lit(0).cast("long"))
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    info = written(info.withColumn("z", z).withColumn("block", block), "sources")  # with a size known to Spark
    scored = postings.join(info, ["lang", "source"])
    scored = scored.withColumn("p", share(F.col("n"), F.col("source_n"), F.col("v"))).withColumn("q", share(F.col("all_n"), F.col("lang_n"), F.col("v")))
    scored = written(scored.select("lang", "source", "term", "heavy", "p", "q", "z", "block", "blocks", "tiles"), "shares")
    discard(postings)

    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = scored.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top_terms)

    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    none, one = F.lit(None).cast("string"), F.lit(1).cast("long")
    tile = lambda *of: F.pmod(F.xxhash64(*of), F.col("tiles")).cast("int").alias("tile")
    absent = info.select("lang", "source", "block", "blocks", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(0).alias("kind"), none.alias("term"), F.col("z").alias("p"), F.col("v").alias("m"))
    dense = scored.where("heavy").select("lang", "source", "block", "blocks", tile("term"), F.lit(1).alias("kind"), "term", "p", one.alias("m"))
    by_share = scored.where("not heavy").groupBy("lang", "source", "block", "blocks", "tiles", "p").agg(F.count("*").alias("m"))
    by_share = by_share.select("lang", "source", "block", "blocks", tile("source", "p"), F.lit(2).alias("kind"), none.alias("term"), "p", "m")
    tiled = absent.union(dense).union(by_share).withColumn("other", other)
    tiled = tiled.withColumn("block_a", F.least("block", "other")).withColumn("block_b", F.greatest("block", "other")).drop("blocks", "other")
    sums = tiled.groupBy("lang", "tile", "block_a", "block_b").applyInArrow(tile_sums, "lang string, a string, b string, value long")

    both = scored.where("not heavy").groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "z")).alias("with"))  # MOST_LIGHT at most
    both = both.where(F.size("with") > 1).select("lang", "with", F.explode("with").alias("x")).select("lang", "x", F.explode("with").alias("y")).where("x.source < y.source")
    x, y, xz, yz = (F.col(c) for c in ("x.p", "y.p", "x.z", "y.z"))
    beyond = difference(x, y) - difference(x, yz) - difference(xz, y) + difference(xz, yz)
    both = both.select("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), beyond.alias("value"))
    pairs = sums.union(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", "value", ways).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return pairs.withColumn("rank", F.row_number().over(by_value)).unionByName(terms)


SQL = r"""
with docs as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), words as (
  select id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs
), kept as (select lang, term, count(*) as all_n from words group by all having count(distinct id) >= 10),
langs as (select lang, count(*) as v, sum(all_n) as lang_n from kept group by all),
counts as (select lang, source, term, count(*) as n from words semi join kept using (lang, term) group by all),
sizes as (select lang, source, sum(n) as source_n from counts group by all),
sources as (select distinct lang, source from docs),
shares as (
  select s.lang, s.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (coalesce(z.source_n, 0) + 2 * l.v) as p, 1 + (1000000000::hugeint * (k.all_n + 2)) // (l.lang_n + 2 * l.v) as q
  from sources s join kept k using (lang) join langs l using (lang) left join counts c using (lang, source, term) left join sizes z using (lang, source)
), pairs as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), parts as (
  select x.lang, x.source, 'pair' as part, y.source as item, coalesce(value, 0)::bigint as value from sources x join sources y on x.lang = y.lang and x.source <> y.source left join pairs p on p.lang = x.lang and p.source = x.source and p.item = y.source
  union all select lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint from shares where n > 0 and p > q
), ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from parts
)
select * from ranked where part = 'pair' or rank <= 10
"""
