"""Exact n-gram Jaccard join in the metric space of shingle sets (operator 3).

A document's set holds its distinct shingles of five words as 64-bit digests.
Jaccard distance d = 1 - J is a metric, and documents link at d <= r = 0.2.
Equal sets are one class, so copies are never compared.

1. A globally fixed order of shingles (frequent ones last, by a frequency sketch
   of fixed size, then by digest) gives each class a prefix of
   n - ceil(0.8 n) + l(n) shingles, l(n) = 1 + n / 10. Two classes within r
   share as many of them as the lesser l says, so a class with fewer shared
   prefix shingles than l(0.8 n) links with nothing and leaves. Without this step
   Voronoi regions would say nothing: texts that share no shingle are at distance
   1 from each other and from every pivot.
2. Classes joined by shared prefix shingles form cells: the components over
   shingles with at most ``most`` holders. A component beyond ``most`` members is
   split into the regions of its shingles, each within ``most``. The holders of
   shingles with more form heavy cells. Linked classes share a cell.
3. A cell is joined recursively. Pivots are compared with all members; members go
   to the Voronoi region of their nearest pivot, or to the remainder when no pivot
   is nearer than 1 - r. Boundary members are replicated to each region that the
   triangle inequality allows to hold a partner: d(x, p) <= d(x, nearest) + 2 r
   and d(x, p) <= radius of the region + r. Regions with one component left are
   settled; regions that do not shrink are ended by pivots alone, one after the
   other, until all members outside the largest component have met all others.
4. Heavy cells take the same step as a job: members are dealt to parts of
   ``block`` rows, each with a copy of the pivots. A cell goes on as its regions
   where those hold fewer members than it, replicas counted; else it stays whole
   without its pivots, which have met all. After ``rounds`` steps there are only
   pivots, four times as many each step up to ``block``. Cells within ``most`` go
   to step 3; a block of few members outside the largest component meets all
   blocks of its cell. So no step holds more than a copy of a cell and its pivots.

So every pair within r that is not in one component already is compared: the
components are exact. No step lists the pairs of a cell; a cell whose members
neither link nor part costs the square of its size in comparisons, in blocks.

Null and word-free texts have an empty set and link with nothing; very long texts
are taken whole. Rows without id are returned with no component. Rows that share
an id count as one document with the links of all; repeated rows give their
result again. Equal distances to two pivots go to the first. An empty table gives
an empty table. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import SLICE_BYTES, drop_table, materialize, release, salted_left_join, slices, table, text_buffers
from tidewater.llm.graph import components
from tidewater.llm.words import POWERS, mix, word_codes

SKETCH_BITS = 20


@dataclass(frozen=True)
class Cells:
    """most: members of a cell that one task joins; block: rows of a part; pivots a step; rounds: steps of heavy cells that may part them; leaf: members that need no regions."""

    most: int = 2048
    block: int = 1024
    pivots: int = 16
    rounds: int = 3
    leaf: int = 48


def shingles(raw: np.ndarray, offs: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(digests, bounds): sorted distinct shingles of every row, row i in digests[bounds[i]:bounds[i + 1]]."""
    rows = len(offs) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    words, row = word_codes(raw, offs)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    count = np.bincount(row, minlength=rows)
    ends = np.cumsum(count)
    total = words.copy()
    for k in range(1, size):  # the sum of the next words, each times a power of its place
        total[: len(words) - k] += words[k:] * POWERS[k]
    left = ends[row] - np.arange(len(words))
    whole = mix(total[left >= size] ^ np.uint64(size))
    owner = row[left >= size]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        rest = np.array([int(mix(np.array([sum(int(w) * int(POWERS[k]) for k, w in enumerate(words[ends[i] - count[i] : ends[i]])) % 2**64 ^ int(count[i])], np.uint64))[0]) for i in short.tolist()], np.uint64)
        whole, owner = np.concatenate([whole, rest]), np.concatenate([owner, short])
    order = np.lexsort((whole, owner))
    whole, owner = whole[order], owner[order]
    new = np.ones(len(whole), bool)
    new[1:] = (whole[1:] != whole[:-1]) | (owner[1:] != owner[:-1])
    whole, owner = whole[new], owner[new]
    return whole, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])


def frequency_sketch(texts: DataFrame, size: int) -> np.ndarray:
    """log2 of how often the shingles of each of 2^SKETCH_BITS hash buckets occur: one byte a bucket, whatever the input."""
    segments, width = 64, (1 << SKETCH_BITS) // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                digests, _ = shingles(*text_buffers(batch.column("text")), size)
                total += np.bincount((digests >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
        parts = total.reshape(segments, width)
        yield pa.RecordBatch.from_pydict({"segment": pa.array(range(segments), pa.int32()), "counts": pa.array([p.tobytes() for p in parts], pa.binary())})

    def add(pdf):
        import pandas as pd

        total = np.zeros(width, np.int64)
        for part in pdf["counts"]:
            total += np.frombuffer(part, np.int64)
        return pd.DataFrame({"segment": [pdf["segment"].iloc[0]], "counts": [total.tobytes()]})

    made = texts.select("text").mapInArrow(count, "segment int, counts binary").withColumn("part", F.spark_partition_id() % 64)
    for keys in (("segment", "part"), ("segment",)):  # in two steps, so that no task holds a share of every partition
        made = made.groupBy(*keys).applyInPandas(add, "segment int, counts binary")
    parts = made.collect()
    out = np.zeros((segments, width), np.uint8)
    for row in parts:  # a fixed number of fixed-size parts
        out[row["segment"]] = np.ceil(np.log2(np.frombuffer(row["counts"], np.int64) + 1) * 8).astype(np.uint8)
    return out.ravel()


def lead(n):
    """Prefix shingles that a set of n shares with a linked set of its size or more, at least."""
    return 1 + n // 10


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + lead(n)


def least_shared(n, num: int, den: int):
    """Prefix shingles that a set of n shares with any linked set, at least: the lead of the smallest one."""
    return lead(-(-num * n // den))


def class_table(texts: DataFrame, sketch, size: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, digest, code, prefix): set size, digest of the set, 64 bits of it, prefix shingles in the order of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = sketch.value
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                digests, bounds = shingles(*text_buffers(batch.column("text")), size)
                weight = logs[(digests >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                sums, prefixes = [], []
                for i in range(batch.num_rows):
                    own = digests[bounds[i] : bounds[i + 1]]
                    if not len(own):
                        sums.append(None)
                        prefixes.append(None)
                        continue
                    sums.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    order = np.lexsort((own, weight[bounds[i] : bounds[i + 1]]))[: prefix_length(len(own), num, den)]
                    prefixes.append(own[order].view(np.int64).tolist())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id"), "n": np.diff(bounds), "digest": pa.array(sums, pa.binary()),
                    "code": pa.array([None if x is None else int.from_bytes(x[:8], "little", signed=True) for x in sums], pa.int64()), "prefix": pa.array(prefixes, pa.list_(pa.int64())),
                })

    return texts.mapInArrow(run, "doc_id long, n long, digest binary, code long, prefix array<long>")


def bloom(ids: DataFrame, bits: int) -> np.ndarray:
    """Bit table of a column of 64-bit digests, of fixed size, two places each; it only saves shuffling rows that nobody asks for."""
    t = F.col(ids.columns[0])
    places = ids.select(F.explode(F.array(*[F.shiftright(t, shift).bitwiseAND(F.lit((1 << bits) - 1)) for shift in (0, 29)])).alias("h"))
    words = places.groupBy((F.col("h") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("bits"))
    table_ = np.zeros((1 << bits) // 64, np.int64)
    found = words.toArrow()  # at most 2^BLOOM_BITS / 64 words of 16 bytes, whatever the input
    table_[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    return table_


BLOOM_BITS = 27  # 16 MB


def bloom_bits(count: int) -> int:
    """16 bits an id at least, between 2^16 and 2^BLOOM_BITS bits in all."""
    return min(BLOOM_BITS, max(16, (16 * count).bit_length()))


def in_bloom(table_: np.ndarray, ids: np.ndarray, bits: int) -> np.ndarray:
    """Whether both places of each id are set."""
    hit = np.ones(len(ids), bool)
    for shift in (0, 29):
        h = (ids >> shift) & ((1 << bits) - 1)
        hit &= ((table_[h >> 6] >> (h & 63)) & 1).astype(bool)
    return hit


def set_table(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, set): sets of the wanted ids as sorted uint64 bytes, and of a few that were not asked for."""
    bits = bloom_bits(wanted.count())  # past the bound it lets more through and saves less
    filter_ = texts.sparkSession.sparkContext.broadcast(bloom(wanted.select(F.xxhash64("id")), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = filter_.value
        for whole in batches:
            for part in slices(whole.filter(pa.array(in_bloom(held, np.asarray(whole.column("h")), bits))), "text", SLICE_BYTES):
                digests, bounds = shingles(*text_buffers(part.column("text")), size)
                yield pa.RecordBatch.from_pydict({"id": part.column("doc_id"), "set": pa.array([digests[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())})

    return texts.where("doc_id is not null").withColumn("h", F.xxhash64("doc_id")).mapInArrow(run, "id long, set binary")


def shared_by(postings: DataFrame) -> DataFrame:
    """(t, c, lo, hi) of the shingles t of two classes x or more; partially aggregated, so that a hot shingle is no hot task."""
    return postings.groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo != hi")


SLICE, MOST_SLICES = 1 << 23, 16


def shared_postings(full: DataFrame, num: int, den: int) -> DataFrame:
    """(t, x): prefix shingles t that several classes hold and their holders, without classes that hold too few.

    Shingles meet once, without their holders, a slice of them after the other, so
    that the disk holds one slice's shuffle. While a bit table of the shared ones
    is within its bound it keeps all other postings out of any further shuffle;
    beyond it they are joined, slice by slice too.
    """
    full = full.where("code is not null and doc_id is not null")
    spark = full.sparkSession
    slices_ = min(MOST_SLICES, 1 + (full.agg(F.sum(F.size("prefix"))).first()[0] or 0) // SLICE)
    post = [full.select(F.explode("prefix").alias("t"), F.col("code").alias("x"), "n").where(F.pmod("t", F.lit(slices_)) == i) for i in range(slices_)]
    shared = []
    for own in post:
        release(spark, 0.0)
        shared.append(materialize(own.groupBy("t").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo != hi").select("t"), "shared"))
    release(spark, 0.0)
    count = sum(s.count() for s in shared)
    if 4 * count > 1 << BLOOM_BITS:
        both = []
        for own, few in zip(post, shared):
            both.append(materialize(own.join(few, "t").distinct(), "shared-postings"))
            release(spark, 0.0)
        every = _union(both)
        enough = every.groupBy("x", "n").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= 1 + F.floor(F.ceil(num * F.col("n") / den) / 10)).select("x")
        out = materialize(every.join(enough, "x", "left_semi").select("t", "x"), "members")
        for used in (*both, *shared):
            drop_table(used)
        return out
    bits = bloom_bits(count)
    held = spark.sparkContext.broadcast(bloom(_union(shared), bits))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                prefix, n = batch.column("prefix"), np.asarray(batch.column("n"))
                values, ends = np.asarray(prefix.flatten()), np.cumsum(np.asarray(prefix.value_lengths()))
                hit = in_bloom(table_, values, bits)
                owner = np.repeat(np.arange(batch.num_rows), np.diff(ends, prepend=0))
                some = np.bincount(owner[hit], minlength=batch.num_rows) >= least_shared(n, num, den)
                keep = hit & some[owner]
                yield pa.RecordBatch.from_pydict({"t": values[keep], "x": np.asarray(batch.column("code"))[owner[keep]]})

    out = materialize(full.select("prefix", "n", "code").mapInArrow(named, "t long, x long").distinct(), "members")
    for used in shared:
        drop_table(used)
    return out


def cells_of(members: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """(cell, x): components over shingles of at most ``most`` holders, those beyond ``most`` members as the regions of their shingles; and whether no x is in two cells."""
    light = members.where(F.col("c") <= most)
    comps = materialize(components(light.select(F.col("x").alias("a"), F.col("lo").alias("b"))), "cells")
    wide = comps.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > most).select("component", F.lit(True).alias("wide"))
    named = materialize(salted_left_join(comps, wide, "component", "id"), "named-cells")
    drop_table(comps)
    small = named.where("wide is null").select(F.col("component").alias("cell"), F.col("id").alias("x"))
    split = not named.where("wide").isEmpty()
    if split:
        inner = light.join(named.where("wide").select(F.col("id").alias("x")), "x", "left_semi")
        regions = inner.select(F.xxhash64("c", "lo", "hi").alias("cell"), "x").distinct()  # shingles with the same holders are one region
        small = small.unionByName(regions)
    return small, not split


# inside one task


class Trees:
    """Union of members 0, 1, ..."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, a: int) -> int:
        parent = self.parent
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


class Holders:
    """Which sets hold a shingle: overlaps of any set with all of them in one count."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets], np.int64)
        self.tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), self.n)
        self.by = owner[np.argsort(at, kind="stable")]
        self.count = np.bincount(at, minlength=len(self.tokens))
        self.start = np.cumsum(self.count) - self.count

    def overlaps(self, own: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.tokens, own), len(self.tokens) - 1)
        place = place[self.tokens[place] == own]
        start, count = self.start[place], self.count[place]
        runs = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return np.bincount(self.by[runs], minlength=len(self.n))


def regions_of(d: np.ndarray, met: np.ndarray, r: float, whole: bool) -> list[np.ndarray]:
    """Member numbers of every Voronoi region and of the remainder, boundary members replicated.

    d[i, x] is the distance of x to pivot i, met[i, x] whether they share anything.
    Without ``whole`` the members are a part of the cell, so that radii are not known.
    """
    near = d.argmin(0)
    least = d[near, np.arange(d.shape[1])]
    inside = least < 1 - r - 1e-9
    out = []
    for i in range(len(d)):
        native = inside & (near == i)
        if whole:
            radius = d[i][native].max() if native.any() else -1.0
            reach = d[i] <= radius + r + 1e-9
        else:  # natives are nearer than 1 - r, so partners are nearer than 1
            reach = met[i]
        out.append(np.flatnonzero(native | (reach & (d[i] <= least + 2 * r + 1e-9))) if native.any() or not whole else np.zeros(0, np.int64))
    rest = ~inside | (least >= 1 - 2 * r - 1e-9)
    out.append(np.flatnonzero(rest) if (~inside).any() or not whole else np.zeros(0, np.int64))
    return out


def join_cell(sets: list[np.ndarray], num: int, den: int, cells: Cells = Cells()) -> np.ndarray:
    """For each member of a cell the first place of its component within the cell."""
    trees, links, r = Trees(len(sets)), [], 1 - num / den
    stack = [np.arange(len(sets))]
    while stack:
        members = stack.pop()
        holders, known = Holders([sets[i] for i in members.tolist()]), [-1, None]

        def meet(at: int) -> np.ndarray:
            """Compare one member with all; returns the overlaps."""
            inter = holders.overlaps(sets[members[at]])
            union = holders.n[at] + holders.n - inter
            for other in np.flatnonzero((inter * den >= union * num) & (inter > 0)).tolist():
                if trees.join(int(members[at]), int(members[other])):
                    links.append((int(members[at]), int(members[other])))
            return inter

        def roots() -> np.ndarray:
            if known[0] != len(links):
                known[:] = [len(links), np.array([trees.root(i) for i in members.tolist()])]
            return known[1]

        done = np.zeros(len(members), bool)
        if len(members) > cells.leaf:
            inters, pivots = [], []
            for _ in range(cells.pivots):
                comp = roots()
                values, counts = np.unique(comp, return_counts=True)
                open_ = np.flatnonzero(~done & ((comp != values[counts.argmax()]) | (len(values) == len(members))))
                if not len(open_):
                    break
                at = int(open_[len(open_) // 2])
                pivots.append(at)
                inters.append(meet(at))
                done[at] = True
            comp = roots()
            if len(set(comp.tolist())) == 1:
                continue
            if inters:
                inter = np.array(inters)
                d = 1 - inter / (holders.n[pivots][:, None] + holders.n[None, :] - inter)
                parts = [p[~done[p]] for p in regions_of(d, inter > 0, r, True)]
                parts = [p for p in parts if len(set(comp[p].tolist())) > 1]
                if sum(len(p) for p in parts) <= 0.9 * len(members):
                    stack.extend(members[p] for p in parts)
                    continue
        while True:  # pivots alone, until all outside the largest component have met all
            comp = roots()
            values, counts = np.unique(comp, return_counts=True)
            open_ = np.flatnonzero(~done & (comp != values[counts.argmax()]))
            if not len(open_):
                break
            meet(int(open_[0]))
            done[open_[0]] = True
    return np.array([trees.root(i) for i in range(len(sets))])


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], split: str | None = None) -> Iterator[pa.Table]:
    """Rows of equal keys, which stand together; with ``split`` also cut where that column changes."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys + ([split] if split else [])]
        new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if key != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def _sets(column) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), np.uint64) for v in column]


def cell_links(cells_: DataFrame, sets: DataFrame, num: int, den: int, cells: Cells) -> DataFrame:
    """(a, b) of all cells within ``most`` members: a linked member and the least one of its component in the cell, itself too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs(batches, ["cell"]):
            ids = np.asarray(cell.column("id"))  # in order, so that the first place has the least id
            root = join_cell(_sets(cell.column("set")), num, den, cells)
            linked = np.bincount(root, minlength=len(root))[root] > 1
            if linked.any():
                yield pa.RecordBatch.from_pydict({"a": ids[linked], "b": ids[root[linked]]})

    rows = cells_.join(sets, "id").select("cell", "id", "set")
    return rows.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(run, "a long, b long")


# heavy cells


def pivot_step(now: DataFrame, num: int, den: int, cells: Cells, round_: int) -> DataFrame:
    """(cell, id, key, region, q): links (id, q) that tie what the pivots link, and where q is null the members left: at region -1 all, besides in each of their regions.

    ``now`` has cell, id, key, set, comp, lead, size. No set leaves the step.
    """
    split = round_ < cells.rounds
    most = cells.pivots if split else min(cells.block, cells.pivots << 2 * (round_ - cells.rounds + 1))
    outside = now.where("comp != lead")
    pivots = outside.groupBy("cell", F.pmod(F.xxhash64("key", F.lit(round_)), F.lit(most)).alias("no")).agg(F.min_by(F.struct("id", "key", "set", "size"), F.struct(F.xxhash64("key"), "key")).alias("p"))
    parts = lambda size: F.ceil(F.col(size) / cells.block)
    copies = pivots.select("cell", F.explode(F.sequence(F.lit(0), (parts("p.size") - 1).cast("int"))).alias("part"), "p.id", "p.key", "p.set", F.lit(0).alias("side"))
    dealt = now.select("cell", F.pmod(F.xxhash64("key"), parts("size")).cast("int").alias("part"), "id", "key", "set", F.lit(1).alias("side"))
    both = copies.unionByName(dealt).repartition("cell", "part").sortWithinPartitions("cell", "part", "side", "key")
    r = 1 - num / den

    def rows(cell: int, ids: np.ndarray, keys: np.ndarray | None, region: int | None, q: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(ids), pa.int64())
        columns = [pa.array([cell] * len(ids), pa.int64()), pa.array(ids), none if keys is None else pa.array(keys), none if region is None else pa.array([region] * len(ids), pa.int64()), none if q is None else pa.array(q)]
        return pa.RecordBatch.from_arrays(columns, names=["cell", "id", "key", "region", "q"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot_ids = pivot_keys = holders = None
        for part in runs(batches, ["cell", "part"], "side"):
            ids, keys = np.asarray(part.column("id")), np.asarray(part.column("key"))
            if part.column("side")[0].as_py() == 0:
                pivot_ids, pivot_keys, holders = ids, keys, Holders(_sets(part.column("set")))
                continue
            sets, cell = _sets(part.column("set")), part.column("cell")[0].as_py()
            inter = np.array([holders.overlaps(s) for s in sets]).T
            union = holders.n[:, None] + np.array([len(s) for s in sets])[None, :] - inter
            linked = (inter * den >= union * num) & (inter > 0)
            some, first = np.flatnonzero(linked.any(0)), linked.argmax(0)
            yield rows(cell, ids[some], None, None, pivot_ids[first[some]])
            q, x = np.nonzero(linked)  # pivots with a member in common, once each
            ties = np.unique(first[x] * len(pivot_ids) + q)
            yield rows(cell, pivot_ids[ties % len(pivot_ids)], None, None, pivot_ids[ties // len(pivot_ids)])
            left = np.flatnonzero(~np.isin(keys, pivot_keys))  # pivots have met the whole cell
            if len(left):
                yield rows(cell, ids[left], keys[left], -1, None)
                for i, at in enumerate(regions_of((1 - inter / union)[:, left], inter[:, left] > 0, r, False) if split else []):
                    if len(at):
                        yield rows(cell, ids[left[at]], keys[left[at]], i, None)

    return both.mapInArrow(run, "cell long, id long, key long, region long, q long")


def next_cells(ready: DataFrame, step: DataFrame, comps: DataFrame, round_: int, split: bool) -> DataFrame:
    """(cell, id, key, set) after a pivot step: the regions with several components where they hold fewer members than the cell, else the cell without its pivots."""
    home = F.when(F.col("region") < 0, F.col("cell")).otherwise(F.xxhash64("cell", "region", F.lit(round_)))
    left = step.where("q is null").select("cell", "id", "key", (F.col("region") >= 0).alias("part"), home.alias("home"))
    named = left.join(comps.select("id", "component"), "id", "left").withColumn("comp", F.coalesce("component", "id"))
    groups = named.groupBy("cell", "home", "part").agg(F.count(F.lit(1)).alias("k"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi")
    groups = materialize(groups, "regions")  # at most pivots + 2 rows a cell
    total = lambda rows: F.sum(F.when(rows, F.col("k")).otherwise(0))
    choice = groups.groupBy("cell").agg((F.lit(split) & (total(F.col("part")) <= 0.9 * total(~F.col("part")))).alias("split"))
    kept = groups.join(choice, "cell").where("part = split").select("home", F.lit(True).alias("kept"))
    moved = salted_left_join(left, kept, "home", "key").where("kept").select("cell", "key", "home")
    out = materialize(ready.select("cell", "id", "key", "set").join(moved, ["cell", "key"]).select(F.col("home").alias("cell"), "id", "key", "set"), "heavy")
    drop_table(groups)
    return out


def block_links(now: DataFrame, num: int, den: int, cells: Cells) -> DataFrame:
    """(a, b): members outside the largest component, in blocks, against all blocks of their cell."""
    blocks = F.ceil(F.col("size") / cells.block).cast("int")
    most = F.ceil(F.col("outside") / cells.block).cast("int")
    few = now.where("comp != lead").select("cell", F.pmod(F.xxhash64("id", F.lit(11)), most).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"), "id", "set", "comp", F.lit(0).alias("side"))
    every = now.select("cell", F.explode(F.sequence(F.lit(0), most - 1)).alias("i"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("j"), "id", "set", "comp", F.lit(1).alias("side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = comp = holders = None
        key = None
        for part in runs(batches, ["cell", "i", "j"], "side"):
            here = tuple(part.column(c)[0].as_py() for c in ("cell", "i", "j"))
            if part.column("side")[0].as_py() == 0:
                key, ids, comp, holders = here, np.asarray(part.column("id")), np.asarray(part.column("comp")), Holders(_sets(part.column("set")))
                continue
            if key != here:
                continue
            trees: dict[int, int] = {}

            def root(c: int) -> int:
                while trees.get(c, c) != c:
                    c = trees[c]
                return c

            for own, x, c in zip(_sets(part.column("set")), part.column("id").to_pylist(), part.column("comp").to_pylist()):
                inter = holders.overlaps(own)
                near = np.flatnonzero((inter * den >= (holders.n + len(own) - inter) * num) & (inter > 0) & (comp != c)).tolist()
                for k in near:
                    a, b = root(int(c)), root(int(comp[k]))
                    if a != b:
                        trees[max(a, b)] = min(a, b)
                        yield pa.RecordBatch.from_pydict({"a": pa.array([x], pa.int64()), "b": pa.array([int(ids[k])], pa.int64())})

    both = few.unionByName(every).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "side", "id")
    return both.mapInArrow(run, "a long, b long")


def heavy_links(heavy: DataFrame, sets: DataFrame, num: int, den: int, cells: Cells) -> list[DataFrame]:
    """Tables (a, b) of the links of cells (cell, id) with more than ``most`` members."""
    now = materialize(heavy.join(sets, "id").select("cell", "id", F.xxhash64("id", "set").alias("key"), "set"), "heavy")
    found: list[DataFrame] = []
    comps, round_ = None, 0
    while True:
        named = now.withColumn("comp", F.col("id")) if comps is None else now.join(comps.select("id", F.col("component").alias("_c")), "id", "left").withColumn("comp", F.coalesce("_c", "id")).drop("_c")
        counts = named.groupBy("cell", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("cell").agg(F.sum("k").alias("size"), F.max(F.struct("k", "comp")).alias("top"))
        stats = counts.select("cell", "size", F.col("top.comp").alias("lead"), (F.col("size") - F.col("top.k")).alias("outside")).where("outside > 0")
        ready = materialize(salted_left_join(named, stats, "cell", "key").where("size is not null"), "heavy-cells")
        drop_table(now)
        small, thin = F.col("size") <= cells.most, F.col("outside") <= cells.block
        found.append(materialize(cell_links(ready.where(small).select("cell", "id"), ready.where(small).select("id", "set").dropDuplicates(["id", "set"]), num, den, cells), "small-links"))
        found.append(materialize(block_links(ready.where(~small & thin), num, den, cells), "block-links"))
        wide = ready.where(~small & ~thin)
        if wide.isEmpty():
            drop_table(ready)
            return found
        step = materialize(pivot_step(wide, num, den, cells, round_), "pivot-step")
        found.append(materialize(step.where("q is not null and id != q").select(F.col("id").alias("a"), F.col("q").alias("b")).distinct(), "pivot-links"))
        comps = materialize(components(_union(found)), "heavy-components")
        now = next_cells(wide, step, comps, round_, round_ < cells.rounds)
        drop_table(ready)
        drop_table(step)
        round_ += 1


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def join_components(full: DataFrame, classes: DataFrame, texts: DataFrame, size: int, num: int, den: int, cells: Cells, more: list[DataFrame]) -> DataFrame:
    """(id, component) of the documents that link with another class; ``more`` are tables of further links (a, b). Removes the files of ``full``."""
    found = shared_postings(full, num, den)
    drop_table(full)
    release(full.sparkSession, 0.0)
    marks = materialize(shared_by(found), "shared")  # once more: holders of too few have left
    members = materialize(found.join(marks, "t"), "postings")  # a mark a shingle: a hot one's holders stay as many
    drop_table(found)
    drop_table(marks)
    named = classes.select(F.col("code").alias("x"), "id")
    found, disjoint = cells_of(members, cells.most)
    small = materialize(found.join(named, "x").select("cell", "id"), "small-cells")
    wide = members.where(F.col("c") > cells.most)
    heavy = None
    if not wide.isEmpty():
        comps = components(wide.select(F.col("x").alias("a"), F.col("lo").alias("b"))).select(F.col("component").alias("cell"), F.col("id").alias("x"))
        heavy = materialize(comps.join(named, "x").select("cell", "id"), "heavy-cells")
    wanted = small.select("id") if heavy is None else small.select("id").unionByName(heavy.select("id"))
    wanted = materialize(wanted.distinct(), "wanted")
    sets = set_table(texts, wanted, size)
    if more:  # ids with several rows: each of their sets once
        sets = sets.distinct()
    if heavy is not None:
        sets = materialize(sets, "sets")
    links = [materialize(cell_links(small, sets, num, den, cells), "links"), *more]
    drop_table(members)
    if heavy is None and not more and disjoint:  # each class was in one cell: its component is known
        return links[0].select(F.col("a").alias("id"), F.col("b").alias("component"))
    if heavy is not None:
        links += heavy_links(heavy, sets, num, den, cells)
    return materialize(components(_union(links)), "components")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 4, den: int = 5, cells: Cells = Cells()) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id; documents link at J >= num / den."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketch = docs.sparkSession.sparkContext.broadcast(frequency_sketch(texts, size))  # fixed size
    full = materialize(class_table(texts, sketch, size, num, den), "sets-of-rows")
    rows = materialize(full.select("doc_id", "n", "digest", "code"), "rows")  # prefixes go once they have met
    usable = rows.where("digest is not null and doc_id is not null")
    classes = materialize(usable.groupBy("digest").agg(F.min("doc_id").alias("id"), F.min("code").alias("code"), F.count(F.lit(1)).alias("copies")), "classes")
    # ids with several rows tie the classes of their texts together
    several = usable.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"), F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("c > 1")
    several = materialize(several, "several")
    more = []
    if not several.isEmpty():
        tied = usable.join(several.where("lo != hi").select("doc_id"), "doc_id", "left_semi").select("doc_id", "digest").distinct()
        more = [materialize(tied.join(classes.select("digest", "id"), "digest").select(F.col("doc_id").alias("a"), F.col("id").alias("b")), "ties")]
    comps = join_components(full, classes, texts, size, num, den, cells, more)
    named = classes.join(comps, "id", "left").where("copies > 1 or component is not null").select("digest", F.coalesce("component", "id").alias("component_id"))
    out = salted_left_join(rows.select("doc_id", "n", F.coalesce("digest", F.lit(b"")).alias("digest")), named, "digest", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
