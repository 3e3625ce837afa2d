"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A document is a weighted set: its words, weighing as often as they occur.  For sample i, every term draws r and c from
Gamma(2, 1) and b from U(0, 1), all from hashes of (term, i); with t = floor(ln(weight) / r + b) the term offers
a = c * exp(-r * (t - b + 1)), and the sample is the (term, t) of the smallest offer.  Two documents agree on a sample
with probability sum(min weights) / sum(max weights), the generalised Jaccard similarity.

The offers of a document are reduced where its words are, so a shuffle moves one row of ``SAMPLES`` numbers per text.

Edge cases: a null text is the empty text; texts without words share one fingerprint that agrees with no other; equal
texts have equal fingerprints; rows repeating a doc_id stay separate, ordered by a hash of the text; a null doc_id sorts
first; the document after the last is the first, so a single document is its own next; a text of any length is split into
words and counted in the row that it is in; only doc_id and text are read, so other columns cannot clash; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_or_empty, written

SAMPLES = 32
#: Documents aimed at in a group of neighbours, and most groups that bounds are computed for at once.
GROUP_ROWS, BOUNDS = 256, 1000


def terms(words: str) -> Column:
    """array of (hash, count) of the distinct words of the sorted array column ``words``."""
    n = F.size(words)
    begins = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at(words, i) != F.element_at(words, F.greatest(i - 1, F.lit(1)))))
    return F.when(n > 0, begins)


def offers(term: Column, ln_weight: Column, sample: int) -> Column:
    """The offer of a term and what it stands for in one long: ln(a) in the upper 32 bits, a hash of (term, t) below."""
    first, second = F.xxhash64(term, F.lit(2 * sample)), F.xxhash64(term, F.lit(2 * sample + 1))
    uniform = lambda h, shift, bits: (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5) * 2.0**-bits
    r = -F.log(uniform(first, 0, 21) * uniform(first, 21, 21))
    ln_c = F.log(-F.log(uniform(second, 0, 32) * uniform(second, 32, 32)))
    b = uniform(first, 42, 22)
    t = F.floor(ln_weight / r + b)
    ln_a = ln_c - r * (t - b + 1.0)
    scaled = F.floor((F.least(F.greatest(ln_a, F.lit(-1000.0)), F.lit(1000.0)) + 1024.0) * 2.0**20)
    return F.shiftleft(scaled, 32).bitwiseOR(F.xxhash64(term, t, F.lit(sample)).bitwiseAND(F.lit(0xFFFFFFFF)))


def fingerprint(df: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """keys and ``samples``: array of 32-bit sample hashes as longs (-1 throughout for a text without words).

    Each row of ``df`` must have keys of its own.
    """
    blank = r"[\x20\x09-\x0D]+"
    words = df.select(*keys, F.sort_array(F.filter(F.split(text, blank), lambda w: w != "")).alias("words"))
    runs = words.withColumn("begins", terms("words"))
    counted = F.expr("zip_with(begins, concat(slice(begins, 2, greatest(size(begins) - 1, 0)), array(size(words) + 1)), (a, b) -> struct(xxhash64(element_at(words, a)) as term, ln(cast(b - a as double)) as ln_weight))")
    rows = runs.select(*keys, F.inline_outer(counted))
    lows = rows.groupBy(*keys).agg(*(F.min(offers(F.col("term"), F.col("ln_weight"), i)).alias(f"m{i}") for i in range(samples)))
    return lows.select(*keys, F.array(*(F.coalesce(F.col(f"m{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(-1)) for i in range(samples))).alias("samples"))


def as_text(samples: Column) -> Column:
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.when(x < 0, F.lit("-")).otherwise(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of samples that agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(samples))


def neighbours(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """g and place (of a row), doc_id, text, next_g, next_place, next_text: each document beside the next in ascending doc_id order.

    Documents are dealt into groups of neighbouring ids, so that no task orders more than a group.  Rows of an id that
    many rows have, or of none, are dealt by a hash of their text.  A row is known by its group and its place there, so
    whoever reads the documents anew, in whatever order, knows it by the same.
    """
    u = F.pmod(F.xxhash64(text_or_empty(text)), F.lit(1 << 32))
    base = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"), u.alias("u"))
    n, known, low = base.agg(F.count("*"), F.count("doc_id"), F.min("doc_id")).first()
    groups = max(1, math.ceil(n / GROUP_ROWS))
    shares = [i / min(groups, BOUNDS) for i in range(1, min(groups, BOUNDS))]
    found = (base.agg(F.percentile_approx("doc_id", shares, 100_000)).first()[0] if shares and low is not None else None) or []
    bounds, cells = sorted(set(found)), math.ceil(groups / BOUNDS)
    missing = max(1, math.ceil((n - known) / GROUP_ROWS)) if n > known else 0
    part, index = F.lit(0), F.lit(missing)  # of a group within its part
    if bounds:
        array = F.array(*(F.lit(b) for b in bounds))
        # the number of lesser bounds, without a lambda: plans that hold one are not seen to be equal and would not share an exchange
        part = F.coalesce(F.array_position(F.sort_array(F.array_append(array, F.col("doc_id"))), F.col("doc_id")) - 1, F.lit(0))
        if cells > 1:  # equal cells between the bounds
            before, after = F.get(array, part - 1), F.get(array, part)
            index = F.coalesce(F.least(F.floor((F.col("doc_id") - before) * cells / (after - before)), F.lit(cells)), F.lit(0)) + missing
        # an id that is several bounds is the last of its part; it has as many groups as bounds, times cells
        hot = {b: found.count(b) * cells for b in bounds if found.count(b) > 1}
        if hot:
            many = F.element_at(F.create_map(*(F.lit(x) for pair in hot.items() for x in pair)), F.col("doc_id"))
            index = F.coalesce(F.floor(F.col("u") * many / F.lit(float(1 << 32))) + (missing + cells + 1), index)
    if missing:  # before all others
        index = F.when(F.col("doc_id").isNull(), F.floor(F.col("u") * F.lit(missing) / F.lit(float(1 << 32)))).otherwise(index)
    base = base.withColumn("g", F.shiftleft(part.cast("long"), 40) + index.cast("long"))

    # a row per group: its first row, and the group before it, which gets a copy of that row
    groups = base.groupBy("g").agg(F.min(F.struct("doc_id", "u")).alias("first")).withColumn("part", F.shiftright("g", 40))
    parts = groups.groupBy("part").agg(F.max("g").alias("last"))
    end = parts.agg(F.max("last")).first()[0] or 0
    parts = parts.select("part", F.lag("last").over(Window.orderBy("part")).alias("last"))
    groups = groups.withColumn("before", F.lag("g").over(Window.partitionBy("part").orderBy("g"))).join(parts, "part")
    heads = groups.select(F.col("g").alias("own"), F.col("first.doc_id").alias("first_id"), F.col("first.u").alias("first_u"), F.coalesce("before", "last", F.lit(end)).alias("to"))
    heads = written(heads, "heads")  # of a size that Spark knows
    firsts = base.join(heads, (F.col("g") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("u") == F.col("first_u")))
    copies = firsts.select("doc_id", "text", "u", F.col("to").alias("g"), F.col("own").alias("copy"))
    own = Window.partitionBy("g").orderBy(F.col("copy").isNotNull(), "doc_id", "u", "text")
    laid = base.select("doc_id", "text", "u", "g", F.lit(None).cast("long").alias("copy")).union(copies)
    ahead = F.lead("copy").over(own)
    laid = laid.withColumns({"place": F.row_number().over(own), "next_text": F.lead("text").over(own), "next_g": F.coalesce(ahead, F.col("g")), "ahead": ahead})
    laid = laid.withColumn("next_place", F.when(F.col("ahead").isNotNull(), F.lit(1)).otherwise(F.col("place") + 1))
    return laid.where("copy is null").select("g", "place", "doc_id", "text", "next_g", "next_place", "next_text")


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text, and of the text whose last half is replaced by the head of the next document."""
    chars = F.char_length("text")
    laid = neighbours(docs, doc_id, text).withColumn("n_chars", chars.cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    laid = laid.withColumn("edited", edited).withColumn("edited_sha256", F.sha2("edited", 256))
    both = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body"))))
    about = ["g", "place", "doc_id", "next_g", "next_place", "n_chars", "edited_sha256"]
    texts = laid.select(*about, both.alias("it")).select(*about, "it.kind", "it.body")
    made = written(fingerprint(texts, [*about, "kind"], "body", samples), "fingerprints")
    plain, changed = made.where("kind = 0"), made.where("kind = 1").select("g", "place", F.col("samples").alias("edited_samples"))
    after = made.where("kind = 0").select(F.col("g").alias("next_g"), F.col("place").alias("next_place"), F.col("samples").alias("next_samples"))
    out = plain.join(changed, ["g", "place"]).join(after, ["next_g", "next_place"])
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("samples")).alias("fingerprint"), as_text(F.col("edited_samples")).alias("edited_fingerprint"),
        likeness(F.col("samples"), F.col("edited_samples"), samples).alias("near_edited"), likeness(F.col("samples"), F.col("next_samples"), samples).alias("near_next"),
    )
