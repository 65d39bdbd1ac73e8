"""SimHash near-dedup by pigeonhole blocks.

Fingerprints that differ in at most two of 64 bits, cut into four blocks, agree on at least two whole
blocks.  Each distinct fingerprint is therefore filed under its six pairs of blocks; those that meet in
a pair are candidates, and their Hamming distance decides.  Exact copies share a fingerprint and are
one candidate, however many there are.

Only connections are needed, so a bucket yields the edges of its own spanning forest and not all its
pairs.  A bucket of more than `bucket_rows` fingerprints is never gathered: its fingerprints are linked
through midpoints instead, which is exact as well.  Two fingerprints differ in at most two bits if
and only if some value is within one bit of both; each is filed under the 65 values within one bit of
it, at most 65 fingerprints can meet under a value, and each is linked with the least of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_texts, materialize, small_batches, text_column
from .components import components

BITS = 2
BLOCKS = ((0, 16), (16, 16), (32, 16), (48, 16))
SEED = 42
SHINGLE = 3


def fingerprint(text: str) -> int:
    """SimHash of a whole text over word shingles, repeats included; zero for a text without words."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths)
        starts = (ends - lengths)[: len(words) - SHINGLE + 1].tolist()
        of, seed = xxhash.xxh64_intdigest, SEED
        hashes = np.fromiter((of(joined[a:b], seed) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.unpackbits(hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # The sum of up to 255 bits fits in a byte, so most of the adding is done on bytes.
        full = len(part) // 255 * 255
        if full:
            ones += part[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += part[full:].sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _load():
    return lambda texts: pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64), pa.int64())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text as a signed long; null texts count as empty."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    kind = source.schema["doc_id"].dataType.simpleString()
    return map_texts(source, "text", lambda: lambda texts: [_load()(texts)], f"doc_id {kind}, fp bigint", ["doc_id"])


def _block(fp: Column, k: int) -> Column:
    at, width = BLOCKS[k]
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def _pair_keys(fp: Column) -> Column:
    """Six keys: which two blocks, and their bits."""
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    return F.array(*(F.shiftleft(F.lit(n).cast("long"), 32).bitwiseOR(F.shiftleft(_block(fp, i), 16)).bitwiseOR(_block(fp, j)) for n, (i, j) in enumerate(pairs)))


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a spanning forest of each bucket's fingerprints within BITS bits; buckets are small lists."""
    for batch in batches:
        a, b = [], []
        for bucket in batch.column(0):
            left = np.unique(np.array(bucket.as_py(), np.int64))
            while len(left) > 1:  # grow one tree after another, each fingerprint leaves when it is reached
                front, left = left[:1], left[1:]
                while len(front) and len(left):
                    near = np.bitwise_count(left.view(np.uint64) ^ front[:1].view(np.uint64)) <= BITS
                    a += [int(front[0])] * int(near.sum())
                    b += left[near].tolist()
                    front, left = np.concatenate([front[1:], left[near]]), left[~near]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(fps: DataFrame, bucket_rows: int = 256) -> DataFrame:
    """fps(fp): distinct fingerprints -> edges(a, b) that connect exactly what links of at most BITS bits connect."""
    filed = fps.select("fp", F.explode(_pair_keys(F.col("fp"))).alias("key"))
    # Counted with a combine before the shuffle; only keys that two fingerprints share go on.
    shared = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = filed.join(shared, "key")
    # The key is hashed anew so that the join may split a hot key's rows among tasks.
    small = met.where(F.col("n") <= bucket_rows).groupBy(F.xxhash64("key", F.lit(1)).alias("h"), "key").agg(F.collect_list("fp").alias("bucket")).select("bucket")
    near = small.mapInArrow(forest, "a bigint, b bigint")
    large = met.where(F.col("n") > bucket_rows).groupBy("fp").agg(F.lit(1).alias("hot")).select("fp")
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    around = large.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("mid"))
    least = around.groupBy("mid").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("mid", "b")
    return near.union(around.join(least, "mid").select(F.col("fp").alias("a"), "b").where("a <> b"))


def _rooted(made: DataFrame, bucket_rows: int) -> DataFrame:
    """made(doc_id, fp) -> (fp, least, root): each distinct fingerprint, its least doc_id, its component's least fingerprint."""
    held = made.groupBy("fp").agg(F.min("doc_id").alias("least"))
    part = components(links(held.select("fp"), bucket_rows)).withColumnsRenamed({"id": "fp"})
    return held.join(part, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))


def simhash_components(docs: DataFrame, bucket_rows: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id.

    Rows link when their fingerprints differ in two bits or fewer; component_id is the smallest doc_id
    reachable by links, the row's own included.  Empty and null texts have fingerprint zero and link
    like others.  Rows with a null doc_id take part and get their component's smallest id that is not
    null, or null.  Repeated rows are kept.  Other columns are not read.
    """
    made = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    rooted = _rooted(made, bucket_rows)
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    whole = rooted.select("fp", "root").join(roots, "root").select("fp", "component_id")
    return made.join(whole, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, bucket_rows: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that stay: one of each component, that with the smallest doc_id.

    A null id counts as larger than any other; among equal ids the least fingerprint decides, and rows
    that agree in both stay once.  Empty and null texts are one component like any other.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    no_id, key, fp = free_name(docs, "no_id", "key", "fp")
    made = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    rooted = _rooted(made, bucket_rows).select("fp", "root")
    first = (
        made.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("fp"))).alias("first")).join(rooted, "fp")
        .groupBy("root").agg(F.min("first").alias("first"))
        .select(F.col("first.no_id").alias(no_id), F.coalesce(F.col("first.doc_id").cast("string"), F.lit("")).alias(key), F.col("first.fp").alias(fp))
    )
    marked = docs.withColumns({no_id: F.col(id_col).isNull(), key: F.coalesce(F.col(id_col).cast("string"), F.lit("")), fp: text_column(_load, F.col(text_col), "bigint")})
    return marked.join(first, [no_id, key, fp], "left_semi").dropDuplicates([no_id, key, fp]).select(*names)
