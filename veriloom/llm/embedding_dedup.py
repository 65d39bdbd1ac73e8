"""Embedding near-dedup: a navigable small-world graph over centres, every vector in a centre's list, links verified by cosine.

Equal vectors are one class, with a number of its own, whatever ids its rows have.  The graph is fitted on a bounded sample of the
classes, the centres.  Every class searches it once: it joins the list of the nearest centre its beam finds, and asks the lists of the
nearest few.  How many are asked, and how wide the beam is, is settled by an audit: a bounded sample of classes, none of them a centre, is
compared with every class, and both are doubled until the lists asked hold the wanted share of the audit's links, of all together and
of a class; where no such number is left every list is asked, which compares all.  Lists that lie together are one shard, and a
class is sent once to each shard it asks, in blocks; a list of many is dealt over shards.  Every link is verified
in double precision, or follows from the triangle inequality with a margin.

A shard hands on a number of links for each class and the edges of a forest, not one for each pair.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, materialize
from .components import components
from .hnsw import TIGHT, Graph

#: At least this many shards, and about this many classes in each at most.
SHARDS = 8
SHARD_ROWS = 65_536
#: Classes of a block that asks a shard (its lists are sent once a block), and the bytes of their vectors, at most; those handled at once.
BLOCK = 262_144
BLOCK_BYTES = 64 << 20
AT_ONCE = 512
#: Centres at most; there are half as many as the root of the number of classes, so that a search and the lists it asks cost about alike.
CENTRES = 4096
#: Classes that are compared with all others, links of each that are looked up, and those classes that audit the graph's beams alone, the ones
#: with most centres near first.
COMPARED = 4096
LOOKED_UP = 4
AUDITED = 64
#: First beam, and the recall that its audit has to find; lists asked at first, and the recall that these have to hold of the links
#: together and of a class's.
BEAM = 32
RECALL = 0.995
ASKED = 4
HELD, HELD_EACH = 0.99, 0.985
#: Radians by which angles have to clear the limit where the triangle inequality stands in for a comparison.
MARGIN = 1e-6
#: Members within TIGHT of a list's centre that are counted together, at least.
TIGHT_ROWS = 16
#: Products in single precision that are settled at once; edges beyond so many are thinned to a forest.
PRODUCTS = 4_000_000
EDGES = 1_000_000


def grouped(key: np.ndarray, value: np.ndarray) -> dict[int, np.ndarray]:
    """The values of each key, in their order."""
    order = np.argsort(key, kind="stable")
    at, starts = np.unique(key[order], return_index=True)
    return dict(zip(at.tolist(), np.split(value[order], starts[1:]), strict=True)) if len(at) else {}


class Shard:
    """A graph with what verification needs: the members of each node, and the groups that their links form."""

    def __init__(self, graph: Graph, ids: np.ndarray, copies: np.ndarray, cosine: float):
        self.graph, self.ids, self.copies, self.cosine = graph, ids, copies, cosine
        self.members = grouped(graph.owner, np.arange(len(graph.owner)))
        radius = max((float(np.arccos(np.clip((graph.x[m] @ graph.x[o]).min(), -1, 1))) for o, m in self.members.items()), default=0.0)
        self.nodes = np.array(sorted(self.members), np.int64)
        # A link with a member may leave the node itself this far away.
        self.reach = float(np.cos(min(np.pi, float(np.arccos(cosine)) + radius + MARGIN)))
        self.beam = BEAM

    def widen(self, q: np.ndarray) -> None:
        """Double the beam until the sample's links, and its nearest nodes, are found."""
        sims = q.astype(np.float32) @ self.graph.fast[self.nodes].T
        # Of the sample those that link most, as far as there are such.
        most = np.argsort(-(sims >= self.reach).sum(axis=1), kind="stable")[:AUDITED]
        q, sims = q[most], sims[most]
        nearest = np.partition(sims, -min(2, sims.shape[1]), axis=1)[:, -min(2, sims.shape[1])] if sims.shape[1] else sims
        wanted = [set(self.nodes[(s >= self.reach) | (s >= max(n, 0.7))].tolist()) for s, n in zip(sims, nearest, strict=True)]
        total = sum(map(len, wanted))
        while self.beam < len(self.nodes):
            found = self.graph.search(q, self.beam)[0]
            if not total or sum(len(w & set(f.tolist())) for w, f in zip(wanted, found, strict=True)) >= RECALL * total:
                return
            self.beam *= 2

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` best nodes a beam finds for each query, best first, or all of them: ids (-1: none) and cosines."""
        if width < len(self.nodes):
            return self.graph.search(q, width)
        sims = q @ self.graph.x[self.nodes].T
        order = np.argsort(-sims, axis=1, kind="stable")
        return self.nodes[order], np.take_along_axis(sims, order, 1)

    def near(self, q: np.ndarray, most: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (row of q, node) within reach, and the `most` nearest nodes that the beam finds; and the nearest node of each row."""
        width = max(self.beam, 2 * most)
        ids, sims = self.search(q, width)
        home = (ids if width == self.beam else self.search(q, self.beam)[0])[:, 0].astype(np.int64)
        pick = lambda ids, sims: np.nonzero(((sims >= self.reach - 1e-5) | (np.arange(sims.shape[1]) < most)) & (ids >= 0))
        r, c = pick(ids, sims)
        node = ids[r, c].astype(np.int64)
        # Where a whole beam is within reach more may follow: such queries compare all nodes.
        full = np.flatnonzero((sims[:, -1] >= self.reach - 1e-5) & (ids[:, -1] >= 0)) if width < len(self.nodes) else r[:0]
        if len(full):
            rest = ~np.isin(r, full)
            ids, sims = self.search(q[full], len(self.nodes))
            fr, fc = pick(ids, sims)
            r, node = np.concatenate([r[rest], full[fr]]), np.concatenate([node[rest], ids[fr, fc]])
        return r, node, home

    def homes(self, q: np.ndarray) -> np.ndarray:
        """The node whose list each row joins: the nearest that the beam finds."""
        parts = [self.search(q[at : at + AT_ONCE], self.beam)[0][:, 0] for at in range(0, len(q), AT_ONCE)]
        return np.concatenate([np.empty(0, np.int64), *parts]).astype(np.int64)

    def asked(self, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (row of q, node) of the lists that each row asks: the `most` nearest that the beam finds and those within reach, or all; and the list that it joins."""
        if most >= len(self.nodes):
            return np.repeat(np.arange(len(q)), len(self.nodes)), np.tile(self.nodes, len(q)), self.homes(q)
        none = np.empty(0, np.int64)
        parts = [(at, self.near(q[at : at + AT_ONCE], most)) for at in range(0, len(q), AT_ONCE)]
        return np.concatenate([none, *(at + p[0] for at, p in parts)]), np.concatenate([none, *(p[1] for _, p in parts)]), np.concatenate([none, *(p[2] for _, p in parts)])

    def links(self, qid: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
        """For each query its number of links with vectors of this graph but its own class, and edges of ids that connect alike."""
        r, node, _ = self.asked(q, 0)
        lists = ((rows, self.members[o], self.graph.x[o]) for o, rows in grouped(node, r).items())
        n, a, b = compare(qid, q, self.ids, self.graph.x, self.copies, self.cosine, lists)
        return n, a.tolist(), b.tolist()


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the given ones connect, one for each id but the least of a component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right, label = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        # Labels meet at the roots, so that whole trees are joined.
        for side in (left, right):
            np.minimum.at(new, label[side], least)
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(ids))
    return ids[own], ids[label[own]]


def compare(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, copies: np.ndarray, cosine: float, lists: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its number of links with members of the lists it asks but its own class, and edges (a, b) of ids.

    `lists` gives the rows of q that ask a list, the rows of x that are in it, and its centre's vector; q and x hold unit vectors.
    """
    n, limit = np.zeros(len(q), np.int64), float(np.arccos(cosine))
    q32, x32 = q.astype(np.float32), x.astype(np.float32) if x is not q else None
    x32 = q32 if x32 is None else x32
    margin = max(1e-5, 2e-7 * x.shape[1]) if x.ndim == 2 else 0
    a: list[np.ndarray] = [np.empty(0, np.int64)]
    b: list[np.ndarray] = [np.empty(0, np.int64)]
    held = 0

    def edges(left: np.ndarray, right: np.ndarray) -> None:
        nonlocal held
        a.append(left)
        b.append(right)
        held += len(left)
        if held > EDGES:
            left, right = forest(np.concatenate(a), np.concatenate(b))
            a[:], b[:] = [left], [right]
            held = 0

    def pairs(rows: np.ndarray, members: np.ndarray) -> None:
        step = max(1, PRODUCTS // max(1, len(members)))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            sims = q32[some] @ x32[members].T
            r, c = np.nonzero(sims >= cosine - margin)
            if not len(r):
                continue
            close = np.flatnonzero(sims[r, c] < cosine + margin)
            good = qid[some[r]] != ids[members[c]]
            for part in np.array_split(close, len(close) * x.shape[1] // PRODUCTS + 1):
                good[part] &= np.einsum("ij,ij->i", q[some[r[part]]], x[members[c[part]]]) >= cosine
            r, c = some[r[good]], members[c[good]]
            np.add.at(n, r, copies[c])
            edges(qid[r], ids[c])

    for rows, members, centre in lists:
        if not len(rows) or not len(members):
            continue
        to_centre = x[members] @ centre
        tight = to_centre >= TIGHT
        if tight.sum() < TIGHT_ROWS:
            pairs(rows, members)
            continue
        # All that are tight are linked with one another, so one edge to one of them connects as each of theirs would.
        group, rest = members[tight], members[~tight]
        radius = float(np.arccos(np.clip(to_centre[tight].min(), -1, 1)))
        sure = np.arccos(np.clip(q[rows] @ centre, -1, 1)) + radius <= limit - MARGIN
        n[rows[sure]] += copies[group].sum()
        edges(qid[rows[sure]], np.full(int(sure.sum()), ids[group[0]]))
        order = np.argsort(ids[group])
        at = np.minimum(np.searchsorted(ids[group], qid[rows], sorter=order), len(group) - 1)
        mine = sure & (ids[group[order[at]]] == qid[rows])
        n[rows[mine]] -= copies[group[order[at[mine]]]]
        if not sure.all():
            pairs(rows[~sure], group)
        if len(rest):
            pairs(rows, rest)
    return n, *forest(np.concatenate(a), np.concatenate(b))


def split(x: np.ndarray, weight: np.ndarray, parts: int) -> list[np.ndarray]:
    """For each of the points the parts it is in: parts of about even weight that lie together; a heavy point is in several."""
    out: list[list[int]] = [[] for _ in x]

    def cut(rows: np.ndarray, share: np.ndarray, first: int, k: int) -> None:
        if k == 1 or len(rows) == 1:
            for i in rows:
                out[i] += range(first, first + k)
            return
        about = x[rows] - np.average(x[rows], axis=0, weights=share)
        direction = np.linalg.eigh((about * share[:, None]).T @ about)[1][:, -1] if len(rows) > 2 else about[-1]
        order = np.argsort(about @ direction, kind="stable")
        sums = np.cumsum(share[order])
        left = k // 2
        goal = sums[-1] * left / k
        at = int(np.searchsorted(sums, goal * (1 - 1e-9)))
        # The point on the cut goes to both sides with what it has on each.
        over, under = sums[at] - goal, goal - (sums[at - 1] if at else 0)
        slack = 0.1 * sums[-1] / k
        if over <= slack:
            low, high, ls, hs = order[: at + 1], order[at + 1 :], share[order[: at + 1]], share[order[at + 1 :]]
        elif under <= slack:
            low, high, ls, hs = order[:at], order[at:], share[order[:at]], share[order[at:]]
        else:
            low, high = order[: at + 1], order[at:]
            ls, hs = share[low].copy(), share[high].copy()
            ls[-1], hs[0] = under, over
        for side, w, f, n in ((low, ls, first, left), (high, hs, first + left, k - left)):
            if len(side):
                cut(rows[side], w, f, n)

    cut(np.arange(len(x)), weight.astype(float), 0, parts)
    return [np.array(p, np.int64) for p in out]


def classes(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(cid, h, x, vec_id, copies, dim): each distinct vector that can link, with a number of its own and its least id."""
    x = F.col("x")
    sound = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x")).where(
        F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))) & F.exists(x, lambda c: c != 0)
    )
    same = sound.groupBy("x").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    return same.select(F.monotonically_increasing_id().alias("cid"), F.xxhash64("x").alias("h"), "x", "vec_id", "copies", F.size("x").alias("dim"))


def _units(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors of one length as rows of length one, in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    u = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    u /= np.abs(u).max(axis=1, initial=0, keepdims=True)  # so that squares neither overflow nor vanish
    return u / np.sqrt((u * u).sum(axis=1, keepdims=True))


def embedding_components(df: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", shards: int = SHARDS, shard_rows: int = SHARD_ROWS, block: int = BLOCK) -> DataFrame:
    """One row per row of `df`: vec_id, n_links, component_id, kept.

    Rows link when their vectors have the same length and a cosine of at least `cosine`, in double
    precision.  n_links counts the other rows linked directly; component_id is the smallest id reachable, the own
    included; kept marks the rows whose id is their component's.  Vectors that are null, empty or zero or hold null or
    non-finite components link with nothing, nor do rows without an id (component and kept null).
    Rows that repeat an id are rows each, with their own vector's links and the links' component.  `cosine` must be at least 0.8: below it, members of a node
    need not be linked through it.
    """
    if cosine < 0.8 or cosine > TIGHT:
        raise ValueError(f"cosine must be from 0.8 to {TIGHT}")
    spark = df.sparkSession
    held = materialize(classes(df, id_col, vector_col), "classes")
    sizes = {r["dim"]: r["n"] for r in held.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a vector length
    kind = held.schema["x"].dataType.simpleString()
    vectors = held.select("cid", "copies", "dim", F.col("x") if kind in ("array<float>", "array<double>") else F.col("x").cast("array<double>").alias("x"))
    kind = vectors.schema["x"].dataType.simpleString()

    # The sample in the order of hashes: first the centres, then those that are compared with all.
    place = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("x", F.lit(11)), "cid"))
    sample = vectors.withColumn("place", place).where(F.col("place") <= CENTRES + COMPARED)

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        dim = t.column("dim")[0].as_py()
        centres = min(CENTRES, math.isqrt(sizes[dim] - 1) // 2 + 1)
        x = _units(t.column("x"), dim)
        audit = x[centres : centres + COMPARED] if len(x) > centres else x
        graph = Graph(x[:centres])
        shard = Shard(graph, np.arange(centres), np.ones(centres, np.int64), cosine)
        weight = np.array([len(shard.members[o]) for o in shard.nodes.tolist()])
        n_shards = max(shards, -(-sizes[dim] // shard_rows))
        parts = split(graph.x[shard.nodes], weight, n_shards)
        shard.widen(audit)
        return pa.table({"dim": [dim], "graph": [graph.dump()], "beam": [shard.beam], "audit": [audit.astype("<f8").tobytes()], "parts": pa.array([[p.tolist() for p in parts]], pa.list_(pa.list_(pa.int64())))}, schema=_GRAPHS)

    made = sample.groupBy("dim").applyInArrow(build, "dim int, graph binary, beam int, audit binary, parts array<array<bigint>>").collect()  # bounded: the sample and its links
    model = {r["dim"]: (bytes(r["graph"]), r["beam"], bytes(r["audit"]), r["parts"]) for r in made}
    shared = spark.sparkContext.broadcast(model)
    key = f"embeddings {uuid.uuid4().hex}"

    def load(graph: bytes, beam: int) -> Shard:
        g = Graph.load(graph)
        shard = Shard(g, np.arange(len(g.x)), np.ones(len(g.x), np.int64), cosine)
        shard.beam = beam
        return shard

    def by_dim(batches):
        """Rows of a batch by the length of their vectors, with what belongs to it."""
        loaded = keep(key, dict)
        for batch in batches:
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in loaded:
                    g, beam, audit, parts = shared.value[dim]
                    loaded[dim] = load(g, beam), np.frombuffer(audit, "<f8").reshape(-1, dim), parts
                part = batch.filter(pa.array(dims == dim))
                for at in range(0, part.num_rows, 8 * AT_ONCE):
                    some = part.slice(at, 8 * AT_ONCE)
                    yield dim, some, _units(some.column(some.schema.get_field_index("x")), dim), *loaded[dim]

    def audited(batches):
        """Links of the audit's classes: the vectors they link with, of each batch those of the least hashes, and how many there are."""
        for dim, some, x, _, audit, _ in by_dim(batches):
            sims = x.astype(np.float32) @ audit.astype(np.float32).T
            r, c = np.nonzero(sims >= cosine - 1e-5)
            good = (np.einsum("ij,ij->i", x[r], audit[c]) >= cosine) & (x[r] != audit[c]).any(axis=1)
            r, c = r[good], c[good]
            h = some.column(some.schema.get_field_index("h")).to_numpy()[r]
            order = np.lexsort((h, c))
            r, c, h = r[order], c[order], h[order]
            _, first, n = np.unique(c, return_index=True, return_counts=True)
            place = np.arange(len(c)) - np.repeat(first, n)
            few = place < LOOKED_UP
            links = np.where(place == 0, np.repeat(n, n), 0)[few]
            vectors = pa.array([v.tobytes() for v in x[r[few]]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(links), dim), pa.int32()), pa.array(c[few], pa.int64()), pa.array(h[few], pa.int64()), pa.array(links, pa.int64()), vectors], names=["dim", "q", "h", "n", "v"])

    by_class = Window.partitionBy("dim", "q")
    pairs = vectors.withColumn("h", F.xxhash64("cid", F.lit(13))).mapInArrow(audited, "dim int, q bigint, h bigint, n bigint, v binary")
    pairs = pairs.withColumn("place", F.row_number().over(by_class.orderBy("h"))).withColumn("n", F.sum("n").over(by_class)).where(F.col("place") <= LOOKED_UP)
    seen: dict[int, list] = {}
    for r in pairs.select("dim", "q", "n", "v").collect():  # bounded: LOOKED_UP rows for each of the audit's classes
        seen.setdefault(r["dim"], []).append((r["q"], r["n"], np.frombuffer(r["v"], "<f8")))
    settled, blocks = {}, {}
    for dim, (graph, beam, audit, parts) in model.items():
        shard, audit, most = load(graph, beam), np.frombuffer(audit, "<f8").reshape(-1, dim), ASKED
        if dim in seen:
            q, n, others = (np.array(c) for c in zip(*seen[dim], strict=True))
            rows, at = np.unique(q, return_inverse=True)
            share = n / np.bincount(at)[at]
            while most < len(shard.nodes):
                r, node, _ = shard.asked(audit[rows], most)
                held_there = np.isin(at * len(shard.graph.x) + shard.homes(others), r * len(shard.graph.x) + node)
                each = np.bincount(at, held_there) / np.bincount(at)
                if (share * held_there).sum() >= HELD * share.sum() and each.mean() >= HELD_EACH:
                    break
                most, shard.beam = 2 * most, 2 * shard.beam
        settled[dim] = most, shard.beam
        # Blocks by the number of shards that the audit's classes ask.
        where = dict(zip(shard.nodes.tolist(), parts, strict=True))
        r, node, _ = shard.asked(audit[:AT_ONCE], most)
        visits = len({(i, p) for i, o in zip(r.tolist(), node.tolist(), strict=True) for p in where[o]}) / len(audit[:AT_ONCE])
        n_shards = max(shards, -(-sizes[dim] // shard_rows))
        rows_at_once = max(1, min(block, BLOCK_BYTES // (4 * dim)))
        blocks[dim] = max(1, -(-int(sizes[dim] * visits / n_shards) // rows_at_once))

    def route(batches):
        """What each class asks, its own list, the shards that hold these, and the one that it is in."""
        for dim, some, x, shard, _, parts in by_dim(batches):
            where = dict(zip(shard.nodes.tolist(), parts, strict=True))
            cid = some.column(some.schema.get_field_index("cid")).to_numpy()
            most, shard.beam = settled[dim]
            all_asked = most >= len(shard.nodes)
            r, node, home = (np.empty(0, np.int64), np.empty(0, np.int64), shard.homes(x)) if all_asked else shard.asked(x, most)
            lists: list[set[int]] = [{h} for h in home.tolist()]
            for i, o in zip(r.tolist(), node.tolist(), strict=True):
                lists[i].add(o)
            own = [where[h][c % len(where[h])] for h, c in zip(home.tolist(), cid.tolist(), strict=True)]
            every = sorted({p for ps in parts for p in ps})
            visits = [every if all_asked else sorted({p for o in ls for p in where[o]}) for ls in lists]
            asks = [[]] * len(lists) if all_asked else [sorted(ls) for ls in lists]  # empty: all
            more = [pa.array(home, pa.int64()), pa.array(own, pa.int32()), pa.array(asks, pa.list_(pa.int32())), pa.array(visits, pa.list_(pa.int32())), pa.array(np.full(len(own), blocks[dim]), pa.int32())]
            yield pa.RecordBatch.from_arrays([*(some.column(some.schema.get_field_index(c)) for c in ("cid", "copies", "dim", "x")), *more], names=["cid", "copies", "dim", "x", "home", "own", "asks", "visits", "blocks"])

    routed = vectors.mapInArrow(route, f"cid bigint, copies bigint, dim int, x {kind}, home bigint, own int, asks array<int>, visits array<int>, blocks int")
    sent = routed.withColumn("turn", F.pmod(F.xxhash64("cid", F.lit(12)), "blocks").cast("int")).select("*", F.explode("visits").alias("shard")).withColumn("mine", F.col("shard") == F.col("own"))
    # A member is sent to every block of its shard, and asks in one.
    sent = sent.withColumn("blk", F.explode(F.when(F.col("mine"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("turn")))).select(
        "cid", "copies", "dim", "x", F.when(F.col("mine"), F.col("home")).alias("home"), F.when(F.col("blk") == F.col("turn"), F.col("asks")).alias("asks"), "shard", "blk"
    )

    def ask(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        t = t.sort_by("cid")
        graph = Graph.load(shared.value[dim][0])
        cid, copies, x = t.column("cid").to_numpy(), t.column("copies").to_numpy(), _units(t.column("x"), dim)
        home = t.column("home").fill_null(-1).to_numpy()
        rows = np.flatnonzero(home >= 0)
        members = grouped(home[rows], rows)
        asking = t.column("asks").combine_chunks()
        lengths = asking.value_lengths().fill_null(-1).to_numpy()
        r, node = np.repeat(np.arange(len(cid)), np.maximum(lengths, 0)), asking.flatten().to_numpy()
        by = grouped(node, r)
        everywhere = np.flatnonzero(lengths == 0)
        lists = ((np.concatenate([by.get(o, everywhere[:0]), everywhere]), m, graph.x[o]) for o, m in members.items())
        n, a, b = compare(cid, x, cid, x, copies, cosine, lists)
        some = np.flatnonzero(n)
        none = pa.nulls(len(a), pa.int64())
        return pa.table({"cid": pa.concat_arrays([pa.array(cid[some], pa.int64()), pa.array(a, pa.int64())]), "n": pa.concat_arrays([pa.array(n[some], pa.int64()), none]), "to": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(b, pa.int64())])}, schema=_FOUND)

    found = materialize(sent.groupBy("dim", "shard", "blk").applyInArrow(ask, "cid bigint, n bigint, to bigint"), "links")
    part = components(found.where("to is not null").select(F.col("cid").alias("a"), F.col("to").alias("b"))).withColumnsRenamed({"id": "cid", "component": "root"})
    linked = found.where("n is not null").groupBy("cid").agg(F.sum("n").alias("n"))
    rooted = held.select("cid", "vec_id", "copies").join(linked, "cid", "left").join(part, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = rooted.groupBy("root").agg(F.min("vec_id").alias("least"))
    counted = rooted.join(least, "root").select("cid", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), "least")
    known = held.select("cid", "h", "x").join(counted, "cid").select("h", F.col("x").alias("same"), "links", "least")
    # Each row finds its class by its vector's hash and then by the vector; of a vector that many rows share the join's partition is split.
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x")).withColumn("hash", F.xxhash64("x"))
    out = rows.join(known, (F.col("hash") == F.col("h")) & (F.col("x") == F.col("same")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


_GRAPHS = pa.schema([("dim", pa.int32()), ("graph", pa.binary()), ("beam", pa.int32()), ("audit", pa.binary()), ("parts", pa.list_(pa.list_(pa.int64())))])
_FOUND = pa.schema([("cid", pa.int64()), ("n", pa.int64()), ("to", pa.int64())])
