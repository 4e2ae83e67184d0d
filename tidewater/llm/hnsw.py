"""Near-duplicate vectors by sharded HNSW graphs (operator 1).

Vectors are scaled to length 1; equal ones are one class. Classes are dealt by
hash into shards, each shard builds one hierarchical navigable small-world
graph, and every class is searched in every shard. A search descends the layers,
then runs a beam on the bottom layer and finally spreads from all vectors within
the threshold through their neighbours, so that dense groups are found whole.
An audit compares the links of a hash-chosen set of queries with brute force; it
averages the recall of the queries that have a link, and more are drawn while few
have one. While it is under the target the beam doubles, up to ``max_beam``; where
that fails too, or too few of the queries drawn have a link to tell, every shard
is searched exactly, in blocks. Every link is verified by a cosine in double
precision. Components come from the links by union.

Null, zero and non-finite vectors link with nothing. Vectors of another
dimension than most are compared among their own kind only. Null ids are
returned with no component; rows that share an id count as one vector with the
links of all. Other columns are ignored.

Searches run in lockstep over blocks of queries, so the work is done in array
operations; memory is bounded by the block size and the shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import materialize, salted_left_join, table
from tidewater.llm.graph import components


@dataclass(frozen=True)
class Index:
    """degree: neighbours a node keeps; layers shrink by ``shrink``; shard_rows: most vectors a shard aims at."""

    degree: int = 16
    shrink: int = 16
    shard_rows: int = 65_536
    min_shards: int = 4
    block: int = 512


class Shard:
    """HNSW over unit vectors, built layer by layer from exact nearest neighbours within blocks."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, marks: np.ndarray, index: Index, graph: bool = True):
        order = np.argsort(marks, kind="stable")  # the hash decides how high a vector stands
        self.ids, self.v = ids[order], np.ascontiguousarray(vectors[order], np.float32)
        self.sizes, n = [], len(ids)
        while n > index.degree:  # layer 0 holds all, each layer above the first 1/shrink of it
            self.sizes.append(n)
            n //= index.shrink
        if not self.sizes:
            self.sizes.append(len(ids))
        self.links = [self._connect(size, index) for size in self.sizes] if graph else []

    def _connect(self, size: int, index: Index) -> np.ndarray:
        """Neighbour lists of a layer: near ones kept only if nearer to the node than to a kept one, then back links."""
        m = min(index.degree, size - 1)
        out = np.full((size, 2 * index.degree), -1, np.int32)
        if m <= 0:
            return out
        v, pool = self.v[:size], min(size - 1, 2 * m)
        for a in range(0, size, 1024):
            sims = v[a : a + 1024] @ v.T
            rows = np.arange(sims.shape[0])
            sims[rows, rows + a] = -2
            near = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
            own = np.take_along_axis(sims, near, 1)
            vectors = v[near]
            between = np.einsum("ipd,iqd->ipq", vectors, vectors)
            kept = np.zeros(near.shape, bool)
            count = np.zeros(len(near), np.int64)
            for p in range(pool):  # the heuristic of Malkov and Yashunin
                far = ~((between[:, p, :] > own[:, p, None]) & kept).any(1)
                take = far & (count < m)
                kept[:, p] = take
                count += take
            for p in range(pool):  # fill up with the nearest left
                take = ~kept[:, p] & (count < m)
                kept[:, p] |= take
                count += take
            chosen = np.where(kept, near, -1)
            chosen = np.take_along_axis(chosen, np.argsort(~kept, axis=1, kind="stable"), 1)[:, :m]
            out[a : a + len(chosen), :m] = chosen
        # back links, as many as there is room for, so that every node can be reached
        src, dst = np.repeat(np.arange(size), m), out[:, :m].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        new = ~(out[dst, :m] == src[:, None]).any(1)
        src, dst = src[new], dst[new]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        place = np.arange(len(dst)) - np.searchsorted(dst, dst)
        room = place < out.shape[1] - m
        out[dst[room], m + place[room]] = src[room]
        return out

    def exact(self, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """All (query row, node) pairs with similarity of ``least`` or more."""
        return np.nonzero(np.ascontiguousarray(queries, np.float32) @ self.v.T >= least)

    def search(self, queries: np.ndarray, beam: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query row, node) pairs with similarity of about ``least`` or more."""
        b = len(queries)
        q = np.ascontiguousarray(queries, np.float32)
        at = np.zeros(b, np.int64)
        best = q @ self.v[0]
        for links in self.links[:0:-1]:  # greedy descent
            moving = np.ones(b, bool)
            while moving.any():
                rows = np.flatnonzero(moving)
                near = links[at[rows]]
                sims = np.where(near >= 0, np.einsum("bd,bkd->bk", q[rows], self.v[near]), -2)
                top = sims.argmax(1)
                value = sims[np.arange(len(rows)), top]
                up = value > best[rows]
                best[rows[up]], at[rows[up]] = value[up], near[np.arange(len(rows)), top][up]
                moving[rows[~up]] = False
        links, n = self.links[0], len(self.v)
        seen = np.zeros((b, n), bool)
        seen[np.arange(b), at] = True
        nodes, sims = np.full((b, beam), -1, np.int64), np.full((b, beam), -2, np.float32)
        done = np.ones((b, beam), bool)
        nodes[:, 0], sims[:, 0], done[:, 0] = at, best, False
        hits: list[np.ndarray] = [np.stack([np.arange(b), at])[:, best >= least]]
        live = np.arange(b)
        while len(live):  # each query opens the best node of its beam that is not opened yet
            open_ = np.where(done[live], -3, sims[live])
            slot = open_.argmax(1)
            go = open_[np.arange(len(live)), slot] > -2
            live, slot = live[go], slot[go]
            if not len(live):
                break
            done[live, slot] = True
            near = links[nodes[live, slot]].astype(np.int64)
            fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
            rows, cols = np.nonzero(fresh)
            seen[live[rows], near[rows, cols]] = True
            value = np.full(near.shape, -2, np.float32)
            value[rows, cols] = np.einsum("nd,nd->n", q[live[rows]], self.v[near[rows, cols]])
            r, c = np.nonzero(value >= least)
            hits.append(np.stack([live[r], near[r, c]]))
            every = np.concatenate([sims[live], value], 1)
            pick = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
            sims[live] = np.take_along_axis(every, pick, 1)
            nodes[live] = np.take_along_axis(np.concatenate([nodes[live], near], 1), pick, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], 1), pick, 1)
        found = np.concatenate(hits, 1)
        front = found
        while front.shape[1]:  # spread through everything within the threshold
            step = []
            for a in range(0, front.shape[1], 65_536):
                row, node = front[0, a : a + 65_536], front[1, a : a + 65_536]
                near = links[node].astype(np.int64)
                r, c = np.nonzero(near >= 0)
                pair_row, pair_node = row[r], near[r, c]
                new = ~seen[pair_row, pair_node]
                keys = np.unique(pair_row[new] * n + pair_node[new])
                pair_row, pair_node = keys // n, keys % n
                seen[pair_row, pair_node] = True
                close = np.einsum("nd,nd->n", q[pair_row], self.v[pair_node]) >= least
                step.append(np.stack([pair_row[close], pair_node[close]]))
            front = np.concatenate(step, 1)
            found = np.concatenate([found, front], 1)
        keys = np.unique(found[0] * n + found[1])
        return keys // n, keys % n


def unit_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, dim, key, unit): doubles of length 1 as bytes; key tells equal ones; null where there is no direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, dims = [], []
            for value in batch.column("v"):
                v = np.array(value.as_py() if value.is_valid else [], dtype=object)
                if not len(v) or any(x is None for x in v.tolist()):
                    x = np.zeros(0)
                else:
                    x = v.astype(np.float64)
                ok = len(x) and np.isfinite(x).all() and np.abs(x).max() > 0
                if ok:
                    x = x / np.abs(x).max()
                    x = x / np.sqrt((x * x).sum())
                dims.append(len(x) if ok else 0)
                out.append(x.tobytes() if ok else None)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "dim": pa.array(dims, pa.int32()), "unit": pa.array(out, pa.binary())})

    made = rows.mapInArrow(run, "vec_id long, dim int, unit binary")
    return made.withColumn("key", F.when(F.col("unit").isNotNull(), F.unhex(F.sha1("unit"))))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(x.as_buffer(), np.float64) for x in column])


def _linked(q: np.ndarray, vectors: np.ndarray, r: np.ndarray, node: np.ndarray, least: float) -> np.ndarray:
    """Which pairs have a cosine of ``least`` or more in doubles, by parts of bounded memory."""
    parts = [np.einsum("nd,nd->n", q[r[a : a + 65_536]], vectors[node[a : a + 65_536]]) >= least for a in range(0, len(r), 65_536)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


class Forest:
    """Union of ids in one task: says which edges join two trees. Cleared when large, which only repeats edges."""

    def __init__(self, most: int = 1_000_000):
        self.parent: dict[int, int] = {}
        self.most = most

    def joins(self, a: int, b: int) -> bool:
        parent = self.parent
        if len(parent) > self.most:
            parent.clear()
        for x in (a, b):
            parent.setdefault(x, x)
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        parent[a] = b
        return a != b


def search_links(classes: DataFrame, queries: DataFrame, shards: int, beam: int | None, least: float, index: Index, forest: bool = False) -> DataFrame:
    """(a, b, n): query class and found class, every shard searched for every query, cosine >= least in doubles.

    Without a beam no graph is built and the shards are searched exactly.

    With ``forest`` a shard gives, instead of every link, one row (a, null, n)
    with the number of vectors that the query links with there, and of its links
    those that join two trees, so that dense groups give no more rows than members.

    A shard's rows come sorted with its vectors first, so one task builds the
    graph and then streams the queries through it.
    """
    base = classes.select("id", "dim", "unit", "copies", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), F.lit(0).alias("side"))
    asked = queries.select("id", "dim", "unit", F.lit(1).cast("long").alias("copies"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")).alias("shard"), F.lit(1).alias("side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, shard, vectors, copies, trees = None, None, None, None, Forest()

        def build():
            ids = np.concatenate([np.asarray(h.column("id")) for h in held])
            marks = np.concatenate([np.asarray(h.column("mark")) for h in held])
            v = np.concatenate([_matrix(h.column("unit")) for h in held])
            order = np.argsort(marks, kind="stable")
            return Shard(ids, v, marks, index, beam is not None), v[order], np.concatenate([np.asarray(h.column("copies")) for h in held])[order]

        for batch in batches:
            keys = list(zip(batch.column("shard").to_pylist(), batch.column("dim").to_pylist(), batch.column("side").to_pylist()))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                key, part = keys[a], batch.slice(a, z - a)
                if key[:2] != now:
                    now, held, shard = key[:2], [], None
                if key[2] == 0:
                    held.append(part)
                    continue
                if shard is None and held:
                    shard, vectors, copies = build()
                    held = []
                if shard is None:  # no vectors of this dimension in the shard
                    continue
                rows = max(1, min(index.block, (32 << 20 if beam else 8 << 20) // max(1, len(shard.v))))
                for at in range(0, part.num_rows, rows):
                    block = part.slice(at, rows)
                    q, ids = _matrix(block.column("unit")), np.asarray(block.column("id"))
                    r, node = shard.search(q, min(beam, len(shard.v)), least - 1e-4) if beam else shard.exact(q, least - 1e-4)
                    ok = (shard.ids[node] != ids[r]) & _linked(q, vectors, r, node, least)
                    a_, b_, w = ids[r][ok], shard.ids[node][ok], copies[node][ok]
                    if not forest:
                        yield pa.RecordBatch.from_pydict({"a": a_, "b": b_, "n": w})
                        continue
                    new = np.array([trees.joins(x, y) for x, y in zip(a_.tolist(), b_.tolist())], bool)
                    own = np.bincount(r[ok], weights=w, minlength=len(ids)).astype(np.int64)
                    some = own > 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([a_[new], ids[some]])), pa.array([*b_[new].tolist(), *[None] * int(some.sum())], pa.int64()), pa.array(np.concatenate([np.zeros(int(new.sum()), np.int64), own[some]]))],
                        names=["a", "b", "n"],
                    )

    both = base.unionByName(asked).withColumn("mark", F.xxhash64("id", F.lit(3)))
    dealt = both.repartition(shards, "shard").sortWithinPartitions("shard", "dim", "side", "id")
    return dealt.mapInArrow(run, "a long, b long, n long")


def true_links(classes: DataFrame, asked: DataFrame, least: float) -> DataFrame:
    """(a, b): the links of the asked classes by brute force in blocks over all classes."""
    rows = asked.collect()  # a bounded number of queries
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r["dim"] for r in rows}:
        mine = [r for r in rows if r["dim"] == dim]
        by_dim[dim] = np.array([r["id"] for r in mine]), np.array([np.frombuffer(r["unit"], np.float64) for r in mine])
    shared = classes.sparkSession.sparkContext.broadcast(by_dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                dims = np.asarray(batch.column("dim"))
                for dim, (ids, q) in shared.value.items():
                    part = batch.filter(pa.array(dims == dim))
                    if part.num_rows:
                        own = np.asarray(part.column("id"))
                        i, j = np.nonzero(_matrix(part.column("unit")) @ q.T >= least)
                        ok = own[i] != ids[j]
                        yield pa.RecordBatch.from_pydict({"a": ids[j][ok], "b": own[i][ok]})

    return materialize(classes.select("id", "dim", "unit").mapInArrow(run, "a long, b long"), "truth")


def audit_set(classes: DataFrame, n: int, queries: int, least: float) -> tuple[DataFrame, DataFrame, bool]:
    """Asked classes, their true links, and whether they can tell: an eighth of ``queries`` have a link, or all classes were asked.

    From about ``queries`` on, four times as many are drawn each round, 16 times at most.
    """
    for drawn in (queries, 4 * queries, 16 * queries):
        every = max(1, n // drawn)
        asked = materialize(classes.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(every)) == 0).select("id", "dim", "unit"), "asked")
        truth = true_links(classes, asked, least)
        tells = every == 1 or truth.agg(F.count_distinct("a")).first()[0] >= max(1, queries // 8)
        if tells:
            break
    return asked, truth, tells


def audit(truth: DataFrame, links: DataFrame) -> float:
    """Mean over the queries that have a true link of the share of them found."""
    hits = truth.join(links.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left")
    recall = hits.groupBy("a").agg((F.count("hit") / F.count(F.lit(1))).alias("recall")).agg(F.avg("recall")).first()[0]
    return 1.0 if recall is None else recall


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, target: float = 0.99, audit_queries: int = 256, beam: int = 32, max_beam: int = 1024, index: Index = Index(),
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    picked = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    units = materialize(unit_vectors(picked), "units")
    usable = units.where("unit is not null and vec_id is not null")
    classes = usable.groupBy("key").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim"), F.first("unit").alias("unit"))
    classes = materialize(classes, "classes")
    n = classes.count()
    shards = max(index.min_shards, -(-n // index.shard_rows))
    asked, truth, tells = audit_set(classes, n, audit_queries, least)
    beam = beam if tells else None
    while beam and audit(truth, search_links(classes, asked, shards, beam, least, index)) < target:
        beam = beam * 2 if beam * 2 <= max_beam else None  # beyond, search exactly
    found = materialize(search_links(classes, classes, shards, beam, least, index, forest=True), "links")
    other = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    comps = components(found.where("b is not null"))
    named = classes.join(other, "id", "left").join(comps, "id", "left").select(
        "key", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    out = salted_left_join(units.select("vec_id", F.coalesce("key", F.lit(b"")).alias("key")), named, "key", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"),
    )


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
