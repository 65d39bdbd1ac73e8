"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

A source's target repetition rate is its target share of the mixture over its own share of the corpus.
Each document draws its number of copies from a Poisson distribution with that rate as mean, by
inverting the distribution at a uniform number hashed from the seed and the document.  Copies are
exploded and dealt over the whole output by another hash.  A draw depends on the document alone, so a
repeated task draws the same and no state is kept.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize

#: A rate is cut into equal parts of at most this mean, drawn one by one; so exp(-mean) cannot underflow.
PART = 8.0
#: Terms of each part's distribution.  The mass beyond 64 at a mean of 8 is under 1e-35, far below the step of the uniform numbers (2**-52).
TERMS = 64
#: A table of rates goes to every executor if it has at most this many sources (some 100 bytes each).
FEW_SOURCES = 100_000
#: Bytes of a partition of the output, about.
PARTITION_BYTES = 64 << 20


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from MD5 over the seed and the parts; a null part counts as the word null."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def distribution(rate: Column) -> Column:
    """The Poisson distribution with mean `rate` as struct(pieces, cdf): how many equal parts it is cut into, and each part's distribution function up to where no uniform number reaches."""
    pieces = F.greatest(F.lit(1), F.ceil(rate / PART)).cast("int")
    mean = rate / pieces
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * mean / i
        return F.struct(p.alias("p"), F.array_append(s["cdf"], F.element_at(s["cdf"], -1) + p).alias("cdf"))

    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step)["cdf"]
    return F.struct(pieces.alias("pieces"), F.filter(cdf, lambda c: c <= 1 - 2.0**-52).alias("cdf"))


def drawn_copies(of: Column, seed: int, *parts: Column) -> Column:
    """The count that a distribution(rate) has at the uniform numbers of `parts`."""
    numbers = F.transform(F.sequence(F.lit(1), of["pieces"]), lambda k: uniform(seed, *parts, k))
    return F.aggregate(numbers, F.lit(0), lambda n, u: n + F.size(F.filter(of["cdf"], lambda c: u >= c)))


def poisson_copies(rate: Column, seed: int, *parts: Column) -> Column:
    """The Poisson count with mean `rate` at the uniform numbers of `parts`; 0 where rate is null or not above 0."""
    return F.when(rate > 0, drawn_copies(distribution(rate), seed, *parts)).otherwise(F.lit(0))


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, flatten: float = 0.5, epochs: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, chars, weight, rate, counts) for each source, the null source included; counts is the rate's distribution.

    `weights` gives target shares, normalised over the sources present; sources it leaves out get none.
    Without it a source's share is its size to the power `flatten`, normalised.  Sizes are characters of
    whole texts over all documents.  `epochs` scales the mixture: 1 keeps the corpus's size on average.
    A source without any characters counts one character, so that its rate is defined.
    """
    source = F.col(source_col).cast("string")
    size = docs.groupBy(source.alias("source")).agg(F.sum(F.coalesce(F.length(text_col), F.lit(0)).cast("long")).alias("chars")).withColumn("chars", F.greatest(F.col("chars"), F.lit(1)))
    if weights is None:
        share = F.pow(F.col("chars").cast("double"), F.lit(flatten))
    else:
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(share)
    size = size.withColumn("share", share)
    total = size.agg(F.sum("chars").alias("all_chars"), F.sum("share").alias("all_shares"))
    # One row: the totals.  A join with it is no product of rows.
    joined = size.join(F.broadcast(total))
    weight = F.when(F.col("all_shares") > 0, F.col("share") / F.col("all_shares")).otherwise(F.lit(0.0))
    rated = joined.select("source", "chars", weight.alias("weight"), (weight * F.col("all_chars") * F.lit(float(epochs)) / F.col("chars")).alias("rate"))
    return rated.withColumn("counts", F.when(F.col("rate") > 0, distribution(F.col("rate"))))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, flatten: float = 0.5, epochs: float = 1.0, seed: int = 20, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", copy_col: str | None = None) -> DataFrame:
    """`docs` with each row repeated by its Poisson draw, in an order shuffled over the whole output.

    All columns are returned, and with `copy_col` the copy's number from 0.  Rows with a null source are
    a source of their own; null and empty texts are drawn like others; a null id draws as the id null.
    Rows that repeat an id draw alike.  An empty table gives an empty one.  Rates have no upper limit: a source of a few
    characters is repeated as its weight asks, one row a copy.
    """
    names = docs.columns
    src, rate, copy, order, one = free_name(docs, "source", "rate", "copy", "order", "one")
    held = materialize(rates(docs, weights, flatten, epochs, source_col, text_col), "rates")
    known = held.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("chars") * F.col("rate")).alias("chars")).first()
    table = held.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias(src), F.col("counts").alias(rate))
    keyed = docs.withColumn(src, F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")))
    # Rates are few as a rule and go to the documents; documents would otherwise meet at a source's task.
    joined = keyed.join(F.broadcast(table) if known["n"] <= FEW_SOURCES else table, src)
    # The draw stands in the generator alone, so that no filter repeats it.
    drawn = joined.select(*(docs[c] for c in names), F.posexplode_outer(F.array_repeat(F.lit(True), drawn_copies(F.col(rate), seed, docs[id_col]))).alias(copy, one))
    dealt = drawn.where(F.col(copy).isNotNull()).withColumn(order, F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(copy)))
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((known["chars"] or 0) / PARTITION_BYTES))
    out = dealt.repartition(n, order).sortWithinPartitions(order)
    return out.select(*names, *([F.col(copy).alias(copy_col)] if copy_col else []))


#: DuckDB SQL for `mix` at its defaults over the table or relation {docs}; {columns} are those to return.
MIX_SQL = """
WITH RECURSIVE sized AS (SELECT source, greatest(sum(coalesce(length(text), 0)), 1)::BIGINT AS chars FROM {docs} GROUP BY source),
shares AS (SELECT source, chars, pow(chars::DOUBLE, 0.5) AS share FROM sized),
totals AS (SELECT sum(chars)::DOUBLE AS all_chars, sum(share) AS all_shares FROM shares),
rated AS (SELECT source, share / all_shares * all_chars / chars AS rate FROM shares, totals),
cut AS (SELECT source, rate, greatest(1, ceil(rate / 8.0))::INT AS pieces, rate / greatest(1, ceil(rate / 8.0)) AS mean FROM rated),
terms(source, i, p, c) AS (
  SELECT source, 0, exp(-mean), exp(-mean) FROM cut
  UNION ALL SELECT t.source, t.i + 1, t.p * k.mean / (t.i + 1), t.c + t.p * k.mean / (t.i + 1)
  FROM terms t JOIN cut k ON t.source IS NOT DISTINCT FROM k.source WHERE t.i < 63),
steps AS (SELECT source, list(c) AS cdf FROM terms GROUP BY source),
rows_in AS (SELECT d.*, k.pieces, s.cdf FROM {docs} d JOIN cut k ON d.source IS NOT DISTINCT FROM k.source JOIN steps s ON d.source IS NOT DISTINCT FROM s.source),
drawn AS (SELECT *, list_sum([len(list_filter(cdf, lambda c: ('0x' || md5('20:' || coalesce(doc_id::VARCHAR, 'null') || ':' || k)[1:13])::BIGINT::DOUBLE / 4503599627370496.0 >= c))
  FOR k IN range(1, pieces + 1)])::INT AS copies FROM rows_in)
SELECT {columns} FROM (SELECT *, unnest(range(0, copies))::INT AS copy FROM drawn WHERE copies > 0)
"""
