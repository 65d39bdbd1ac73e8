"""Bounded samples of labelled documents, and the columns that classifier queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDS = 5
#: Characters of all texts of a sample together, at most.
ALL_CHARS = 48_000_000


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out and never learnt from."""
    return F.crc32(F.col(id_col).cast("string")) % FOLDS


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_chars: int, id_col: str = "doc_id", text_col: str = "text", all_chars: int = ALL_CHARS) -> tuple[list[str], list[int], float]:
    """Whole texts with their labels, at most `per_class` of each class, and the share of label 1 among all labelled rows.

    The rows are those with the least hashes of their ids outside fold 0; ids with no, null or
    contradicting labels are left out, and so are texts of more than `most_chars` characters and null
    texts.  An id gives one text, that with the least hash, however many rows have it; it is chosen before anything
    is collected.  Together the texts have at most `all_chars` characters, those of the least hashes first.  The bounds make the
    sample fit on the driver, whatever the corpus.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & (fold(id_col) != 0)).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z").select("doc_id", F.col("y").cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(per_class)
        picked = part if picked is None else picked.union(part)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull() & (F.length("text") <= most_chars))
    one = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))  # picked has at most 2 * per_class rows
    size = F.sum(F.length("text")).over(Window.orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = one.withColumn("h", F.xxhash64("doc_id", F.lit(17))).withColumn("size", size).where(F.col("size") <= all_chars).select("text", "y", "h").toArrow()
    order = sorted(zip(rows.column("h").to_pylist(), rows.column("text").to_pylist(), rows.column("y").to_pylist(), strict=True))
    del rows  # the texts are held once
    total = sum(counts.values())
    return [t for _, t, _ in order], [y for _, _, y in order], counts.get(1, 0) / total if total else 0.0
