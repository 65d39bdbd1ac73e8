"""Exact top-k inner-product search by pivot-table elimination.

Integer vectors are compared by squared distance: a score is (|q|^2 + |x|^2 - d^2) / 2.  A pivot table, made
once and written beside the vectors, holds each vector's distances to a set of pivots; by the triangle inequality the
largest difference between a query's and a candidate's distances to a pivot is a lower bound of theirs, and
so bounds the score from above.  Distances are doubles in the table, and each bound is widened by what rounding
them can be, the pivot's own distance included.  Within a block of candidates, each query evaluates them in the order of
their bounds and stops when the next bound is below its k-th best score.  Bounds only save work: scores are exact integers.

Queries and candidates are dealt into blocks by hash and every block of queries meets every block of
candidates, which is a stated set of queries against all rows.  A block pair holds a bounded number of
vectors and hands on k rows a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a candidate block and of a query block at most, about, and block pairs that are wanted at least, as long as blocks of candidates keep so many rows.
CANDIDATES = 8_192
QUERIES = 4_096
PAIRS, LEAST = 12, 2_048
#: Pivots, and about how many rows are looked at to choose them.
PIVOTS = 24
SAMPLE = 4_096
#: The sample's share, by distance from its mean, that pivots are chosen from: a pivot far from all others bounds nothing.
CENTRAL = 0.98


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to n rows of the sample's central part, each the farthest from those before it."""
    x = sample.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        out = ((x - np.median(x, axis=0)) ** 2).sum(axis=1)
        x = x[np.argsort(out, kind="stable")[: max(1, int(np.ceil(CENTRAL * len(x))))]]
        far = ((x - x[-1]) ** 2).sum(axis=1)
        chosen = [len(x) - 1]
        while len(chosen) < n and np.isfinite(far).all() and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of vectors to pivots, each to a few units in its last place; infinite where the squares overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.stack([np.sqrt(np.nan_to_num(((x - p) ** 2).sum(axis=1), nan=np.inf)) for p in pivots], axis=1) if len(pivots) else np.empty((len(x), 0))


def norms(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (x * x).sum(axis=1)


#: Bounds are taken in 32 bits, of distances up to FAR (beyond it none is told from another), for so many queries at once.
FAR = 1e18
TOGETHER = 16
#: What a distance may be off by as it is rounded in 64 bits and then to 32, and a square likewise, as shares of it.
ROUNDED, SQUARED = 2.0**-21, 2.0**-20


def _at_most(score: int) -> float:
    """A double not above a score; far enough below it that no bound of as much is cut off."""
    if abs(score) > 1 << 1000:
        return -np.inf
    return float(score) - abs(float(score)) * 2.0**-50


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of (ids, scores), ties to the smaller id."""
    if scores.dtype == object:
        top = np.array(sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:k], int)
    else:
        if len(scores) > 4 * k:
            near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            ids, scores = ids[near], scores[near]
        top = np.lexsort((ids, -scores))[:k]
    return ids[top], scores[top]


class Block:
    """Candidates of one length with what is known of them: sums of products are taken in the narrowest numbers that hold them exactly."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, table: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.table, self.k = ids[order], x[order], table[order], k
        near = np.minimum(self.table, FAR)
        self.near, self.off = np.ascontiguousarray(near.T.astype(np.float32)), (near.max(axis=1, initial=0) * ROUNDED).astype(np.float32)
        with np.errstate(over="ignore"):
            self.half = (norms(self.x) * (0.5 + SQUARED) + 1).astype(np.float32)
        size = np.abs(self.x).max(axis=1, initial=0)
        # Vectors far larger than most are kept apart, or they would make all others dear.
        self.usual = size <= max(2.0**20, 16 * float(np.median(size)) if len(size) else 0)
        self.limit = float(size[self.usual].max(initial=0))
        self.made: dict[str, np.ndarray] = {}
        self.evaluated = 0

    def _as(self, kind: str) -> np.ndarray:
        if kind not in self.made:
            x = np.where(self.usual[:, None], self.x, 0.0)
            self.made[kind] = x.astype(kind)
        return self.made[kind]

    def scores(self, at: np.ndarray, q: np.ndarray, largest: float) -> np.ndarray:
        """Exact scores of the candidates at some places, as 64-bit integers unless one needs more."""
        self.evaluated += len(at)
        most = self.limit * largest * self.x.shape[1]
        kind = "float32" if most < 2**24 else "float64" if most < 2**53 else "int64" if most < 2**62 else None
        plain = self.usual[at] if kind else np.zeros(len(at), bool)
        if plain.all() and len(at):
            return (self._as(kind).take(at, axis=0) @ q.astype(kind)).astype(np.int64)
        out = np.empty(len(at), object)
        if plain.any():
            out[plain] = (self._as(kind).take(at[plain], axis=0) @ q.astype(kind)).astype(np.int64).tolist()
        whole = [int(v) for v in q.tolist()]
        out[~plain] = [sum(int(a) * b for a, b in zip(x, whole, strict=True)) for x in self.x[at[~plain]].tolist()]
        return out.astype(np.int64) if all(-(1 << 62) < s < 1 << 62 for s in out) else out

    def bounds(self, squares: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Upper bounds of some queries' scores with all candidates, rounding allowed for."""
        far = np.minimum(table, FAR).astype(np.float32)
        gap, now = np.zeros((len(table), len(self.ids)), np.float32), np.empty((len(table), len(self.ids)), np.float32)
        for p in range(table.shape[1]):
            np.subtract(self.near[p][None], far[:, p][:, None], out=now)
            np.abs(now, out=now)
            np.maximum(gap, now, out=gap)
        off = (np.minimum(table, FAR).max(axis=1, initial=0) * ROUNDED).astype(np.float32)
        gap -= self.off[None]
        gap -= off[:, None]
        np.maximum(gap, 0, out=gap)
        np.multiply(gap, gap, out=gap)
        gap *= np.float32(-0.5 * (1 - SQUARED))
        gap += self.half[None]
        with np.errstate(over="ignore"):
            gap += (squares * (0.5 + SQUARED) + 1).astype(np.float32)[:, None]
        return gap

    def search(self, own: int, q: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best candidates for a query but those of its own id: ids and scores, best first.  `low`: their bounds."""
        largest = float(np.abs(q).max(initial=0))
        rest, size = np.flatnonzero(self.ids != own), 8 * self.k
        ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
        while len(rest):
            if size < len(rest):
                split = np.argpartition(-low[rest], size - 1)
                now, rest = rest[split[:size]], rest[split[size:]]
            else:
                now, rest = rest, rest[:0]
            scores = self.scores(now, q, largest)
            if scores.dtype != best.dtype:
                scores, best = scores.astype(object), best.astype(object)
            ids, best = _best(np.concatenate([ids, self.ids[now]]), np.concatenate([best, scores]), self.k)
            if len(best) >= self.k:
                rest = rest[low[rest] >= _at_most(int(best[-1]))]
            size *= 4
        return ids, best

    def search_all(self, owns: list[int], qs: np.ndarray, table: np.ndarray):
        """(id, its k best ids, scores) for each query."""
        squares = norms(qs)
        for at in range(0, len(owns), TOGETHER):
            part = slice(at, at + TOGETHER)
            for own, q, low in zip(owns[part], qs[part], self.bounds(squares[part], table[part]), strict=True):
                yield own, *self.search(own, q, low)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def _sound(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    x = F.col("x")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    return rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))


def _steps(vectors: pa.Array, scale: int) -> list[np.ndarray]:
    """floor(scale * x) of each vector's components, as whole doubles."""
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if not np.isfinite(flat).all():
        raise OverflowError("a vector's component times the scale is beyond what a double holds")
    return np.split(flat, np.cumsum(np.diff(vectors.offsets.to_numpy()))[:-1])


def exact_top_k(df: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", candidate_rows: int = CANDIDATES, query_rows: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k highest integer inner products.

    Queries are the rows whose id is divisible by `every`; candidates are all rows but those of the
    query's own id; ties go to the smaller id.  Vectors that are null, empty, or hold null or
    non-finite components take no part, nor do rows without an id; any finite vector does.  Scores are
    exact whatever their size; one among a query's k highest that does not fit in 64 bits raises an
    error, as does a component that leaves the range of doubles when scaled.  Vectors of different lengths
    are not compared.  Rows that repeat an id are candidates each; as queries they are one, the first by their bytes.
    """
    spark = df.sparkSession
    sound = _sound(df, id_col, vector_col)
    sizes = sound.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("m"))
    total, rows, asked = sizes.agg(F.sum("n"), F.max("n"), F.max("m")).first()
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    # One sample for all lengths; a length of which it has no vector goes without pivots and compares all.
    picked = sound.where(F.pmod(F.xxhash64("vec_id", "x", F.lit(5)), F.lit(max(1, total // SAMPLE))) == 0).select("vec_id", "x").limit(2 * SAMPLE).collect()
    by_length: dict[int, list[tuple]] = {}
    for p in sorted(picked):
        by_length.setdefault(len(p["x"]), []).append(p["x"])
    pivots = {n: choose_pivots(np.floor(np.array(x, np.float64) * scale)) for n, x in by_length.items()}
    shared = spark.sparkContext.broadcast(pivots)  # chosen from a sample of bounded size

    def measured(batches):
        """Vectors with their row of the pivot table."""
        for b in batches:
            vectors = _steps(b.column(1), scale)
            sizes = np.array([len(v) for v in vectors], np.int32)
            rows = np.empty(len(vectors), object)
            for n in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == n)
                for i, d in zip(at.tolist(), distances(np.stack([vectors[i] for i in at]), shared.value.get(n, np.empty((0, n)))), strict=True):
                    rows[i] = d
            columns = [b.column(0), pa.array(sizes), *(pa.array([v.astype("<f8").tobytes() for v in vs], pa.binary()) for vs in (vectors, rows))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "dim", "v", "d"])

    held = materialize(sound.select("vec_id", "x").mapInArrow(measured, "vec_id bigint, dim int, v binary, d binary"), "pivot_table")
    # Blocks are smaller where there would be too few pairs of them to keep machines busy.
    c_blocks, q_blocks = -(-rows // candidate_rows), -(-max(asked, 1) // query_rows)
    while c_blocks * q_blocks < PAIRS and rows > LEAST * c_blocks:
        c_blocks *= 2

    def block(salt: int, n: int):
        return F.pmod(F.xxhash64("vec_id", "v", F.lit(salt)), F.lit(n)).cast("int")

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), c_blocks * q_blocks // 4, 1)
    keys = ("dim", "qb", "cb")
    c = held.withColumn("cb", block(1, c_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    asked_rows = held.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "dim", "d")).alias("f")).select("vec_id", "f.dim", "f.v", "f.d")
    q = asked_rows.withColumn("qb", block(2, q_blocks)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        dim = left.column("dim")[0].as_py()
        width = len(shared.value.get(dim, ()))
        mine = Block(right.column("vec_id").to_numpy(), _matrix(right.column("v"), dim), _table(right.column("d"), width), k)
        out: tuple[list, list, list] = ([], [], [])
        for own, ids, scores in mine.search_all(left.column("vec_id").to_pylist(), _matrix(left.column("v"), dim), _table(left.column("d"), width)):
            out[0].extend([own] * len(ids))
            out[1].extend(ids.tolist())
            out[2].extend(map(int, scores))
        # A score beyond 64 bits may still be beaten in another block; it travels as the nearest that fits and is refused at the end.
        scores = [min(max(s, -FARTHEST), FARTHEST) for s in out[2]]
        return pa.table([pa.array(x, pa.int64()) for x in (out[0], out[1], scores)], schema=schema)

    # Both sides are dealt to as many tasks as the pairs of blocks ask for, not to as few as their bytes would.
    blocks = q.repartition(tasks, *keys).groupBy(*keys).cogroup(c.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(meet, "query_id bigint, vec_id bigint, score bigint")
    ranked = blocks.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))))
    refused = F.raise_error(F.format_string("the score of query %d and vector %d does not fit in 64 bits", F.col("query_id"), F.col("vec_id"))).cast("long")
    score = F.when(F.abs(F.col("score")) >= FARTHEST, refused).otherwise(F.col("score"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


#: Scores of this size or more do not travel as they are.
FARTHEST = (1 << 63) - 1


def _table(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, width) if width else np.empty((len(column), 0))
