"""Embedding near-dedup (operator 7) by NN-descent.

Equal vectors are one node with a multiplicity. Neighbour lists of K begin in the leaves of random-hyperplane trees, more trees for more nodes, and are refined by
joins of neighbours of neighbours: the list of a node and the nodes that list it meet, and each learns of the others that are nearer than its
own last one; only entries that are new since the last round meet again, until fewer than SETTLED of the entries near the threshold change. Links are the list entries whose
cosine in double precision reaches the threshold.

A list that is full of links is saturated: there may be more. Saturated lists are enlarged together: saturated nodes that links connect are a group, and every
node that a list names beside one of them, either way, is a candidate of the group. So are the members of groups nearby, for lists that are full name nobody
outside their own crowd: one node of each group is its seed, seeds have neighbour lists among themselves, and by the triangle inequality of angles two groups can
only link if their seeds are no further apart than both groups' radii and the threshold's angle. Candidates meet the group's members in blocks of a grid, so a group with a
third of all vectors is many tasks; a block gives each member its number of links and each linked node the smallest of its class there,
never all pairs. Links found so may connect groups; these are then enlarged again as one, until none are connected any more.

An audit compares bounded samples of nodes with all nodes by brute force: as many of those with a link as of all, more of them until MIN_AUDITED nodes that truly
have links were asked. Each node counts alike, and nodes with fewer than K others count apart
from the rest, so that a crowd does not outweigh isolated pairs. Below MIN_RECALL the lists are made twice as long and refined again; if the
last attempt is below it too, an error is raised.

Cases: vectors that are null, empty, zero or hold null or non-finite numbers link with nothing; vectors of different lengths do not link; repeated rows
are linked copies; an empty table gives no rows; extra columns are dropped."""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import discard, quoted, smallest, stage
from inkspan.llm.components import components

K = 10
TREES = 6
#: One more tree for each doubling of the nodes beyond so many.
NODES_OF_TREES = 50_000
LEAF = 128
ROUNDS = 10
SETTLED = 0.005
#: Entries whose cosine falls short of the threshold by less name candidates of a group.
MARGIN = 0.1
GRID_ROWS = 2048
MIN_RECALL = 0.95
ATTEMPTS = 3
AUDIT_NODES = 1024
AUDIT_LIMIT = 8192
MIN_AUDITED = 100
_LISTS = "node long, other long, sim float, fresh boolean"
_log = logging.getLogger(__name__)


def _matrix(column: pa.Array | pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(v, kind) for v in column.to_pylist()]


def _stacked(column: pa.Array, rows: np.ndarray, kind: str) -> np.ndarray:
    """Rows of equal length as one matrix."""
    return np.frombuffer(b"".join(column.take(pa.array(rows)).to_pylist()), kind).reshape(len(rows), -1)


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("v")
        dims = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(dims)])
        whole, half = np.empty(len(dims), object), np.empty(len(dims), object)
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            x = flat[starts[rows][:, None] + np.arange(dim)]
            x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that no square overflows or vanishes
            x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            small = x.astype("<f2")
            for r, u, h in zip(rows, x, small, strict=True):
                whole[r], half[r] = u.tobytes(), h.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("rep"), batch.column("many"), pa.array(dims, pa.int32()), pa.array(whole, pa.binary()), pa.array(half, pa.binary())], names=["node", "rep", "many", "dim", "unit", "half"])


def _leaves(batches: Iterator[pa.RecordBatch], trees: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Each node's leaf in every tree: on which side of each of the tree's random hyperplanes it lies."""
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            x = _stacked(batch.column("half"), rows, "<f2").astype(np.float32)
            own = planes.setdefault(int(dim), np.random.default_rng([17, int(dim)]).standard_normal((trees * bits, dim)).astype(np.float32))
            sides = (x @ own.T > 0).reshape(len(rows), trees, bits)
            leaf = (sides * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2) * trees + np.arange(trees)
            key = (leaf * 100_003 + int(dim)).ravel()
            taken = batch.take(pa.array(np.repeat(rows, trees)))
            yield pa.RecordBatch.from_arrays([pa.array(key), taken.column("node"), taken.column("half")], names=["leaf", "node", "half"])


def _gather(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    kept = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(kept).combine_chunks() if kept else None


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    return order, np.concatenate([[0], np.flatnonzero(np.diff(keys[order])) + 1, [len(keys)]])


def _pairs(node: np.ndarray, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(s.astype(np.float32)), pa.array(np.ones(len(a), bool))], names=["node", "other", "sim", "fresh"])


def _in_leaf(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """All nodes of some leaves: each one's k nearest in its leaf."""
    if (table := _gather(batches)) is None:
        return
    node, vectors = table.column("node").to_numpy(), _matrix(table.column("half"), "<f2")
    order, edges = _groups(table.column("leaf").to_numpy())
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        rows = order[start:end]
        if len(rows) > 1:
            x = np.stack([vectors[r] for r in rows]).astype(np.float32)
            for at in range(0, len(rows), 2048):
                sims = x[at : at + 2048] @ x.T
                own = np.arange(len(sims))
                sims[own, at + own] = -2
                near = np.argpartition(-sims, min(k, len(rows) - 1) - 1, axis=1)[:, : min(k, len(rows) - 1)]
                yield _pairs(node[rows], np.repeat(at + own, near.shape[1]), near.ravel(), np.take_along_axis(sims, near, 1).ravel())


def _nearest(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """All entries of some nodes' lists: the k nearest different ones of each; fresh where none was there before."""
    if (table := _gather(batches)) is None:
        return
    node, other, sim = (table.column(c).to_numpy() for c in ("node", "other", "sim"))
    fresh = table.column("fresh").to_numpy(zero_copy_only=False).astype(bool)
    order = np.lexsort([fresh, other, node])
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(node[order]) != 0) | (np.diff(other[order]) != 0)
    order = order[new]
    order = order[np.lexsort([other[order], -sim[order], node[order]])]
    first = np.concatenate([[True], np.diff(node[order]) != 0])
    starts = np.flatnonzero(first)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    order = order[rank < k]
    yield pa.RecordBatch.from_arrays([pa.array(node[order]), pa.array(other[order]), pa.array(sim[order]), pa.array(fresh[order])], names=["node", "other", "sim", "fresh"])


def _meet(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """At each node, those in its list and (up to k of) those that list it; to each, the others that are nearer than its last one, where either of the
    two entries is fresh."""
    if (table := _gather(batches)) is None:
        return
    node, last = table.column("member").to_numpy(), table.column("last").to_numpy()
    back, fresh = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("back", "fresh"))
    vectors = _matrix(table.column("half"), "<f2")
    center = table.column("center").to_numpy()
    order = np.lexsort([node * np.int64(0x9E3779B97F4A7C15 - (1 << 64)), ~fresh, back, center])
    edges = np.concatenate([[0], np.flatnonzero(np.diff(center[order])) + 1, [len(center)]])
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        rows = order[start:end]
        rows = rows[: int((~back[rows]).sum()) + k]
        if len(rows) < 2 or not fresh[rows].any():
            continue
        x = np.stack([vectors[r] for r in rows]).astype(np.float32)
        sims = x @ x.T
        a, b = np.nonzero((sims > last[rows][:, None]) & (node[rows][:, None] != node[rows][None, :]) & (fresh[rows][:, None] | fresh[rows][None, :]))
        if len(a):
            yield _pairs(node[rows], a, b, sims[a, b])


def _exact(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims, others = (pc.binary_length(batch.column(c)).to_numpy() for c in ("ua", "ub"))
        close = np.zeros(batch.num_rows, bool)
        for dim in np.unique(dims):
            rows = np.flatnonzero((dims == dim) & (others == dim))
            for at in range(0, len(rows), 4096):
                some = rows[at : at + 4096]
                close[some] = np.einsum("ij,ij->i", _stacked(batch.column("ua"), some, "<f8"), _stacked(batch.column("ub"), some, "<f8")) >= threshold
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(close)), batch.column("b").filter(pa.array(close))], names=["a", "b"])


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = pc.binary_length(batch.column("ua")).to_numpy()
        angles = np.zeros(batch.num_rows)
        for dim in np.unique(dims):
            every = np.flatnonzero(dims == dim)
            for at in range(0, len(every), 4096):
                rows = every[at : at + 4096]
                angles[rows] = np.arccos(np.clip(np.einsum("ij,ij->i", _stacked(batch.column("ua"), rows, "<f8"), _stacked(batch.column("ub"), rows, "<f8")), -1, 1))
        yield pa.RecordBatch.from_arrays([batch.column("leader"), pa.array(angles)], names=["leader", "angle"])


def _grid(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Some cells of the grid. kind 0: a member and how many vectors it links with in the cell; 1: a linked node and the smallest of its
    class in the cell; 2: a link of a node whose own list was not saturated."""
    if (table := _gather(batches)) is None:
        return
    node, many = table.column("node").to_numpy(), table.column("many").to_numpy()
    side, own = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("side", "own"))
    vectors = table.column("unit").combine_chunks()
    order, edges = _groups(table.column("cell").to_numpy())
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        rows = order[start:end]
        a, c = rows[side[rows]], rows[~side[rows]]
        if not len(a) or not len(c):
            continue
        x, y = (_stacked(vectors, part, "<f8") for part in (a, c))
        close = (x @ y.T >= threshold) & (node[a][:, None] != node[c][None, :])
        links = close @ many[c]
        label_a, label_c = node[a].copy(), node[c].copy()
        big = np.iinfo(np.int64).max
        while True:
            next_a = np.minimum(label_a, np.where(close, label_c[None, :], big).min(axis=1))
            next_c = np.minimum(label_c, np.where(close, next_a[:, None], big).min(axis=0))
            if (next_a == label_a).all() and (next_c == label_c).all():
                break
            label_a, label_c = next_a, next_c
        i, j = np.nonzero(close & ~own[c][None, :])
        out = [(0, node[a], links), (1, np.concatenate([node[a], node[c]]), np.concatenate([label_a, label_c])), (2, node[c][j], node[a][i])]
        for kind, p, q in out:
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), kind, np.int32)), pa.array(p), pa.array(q.astype(np.int64))], names=["kind", "p", "q"])


def _tasks(n: int, each: int) -> int:
    return int(max(8, -(-n // each)))


def neighbour_lists(nodes: DataFrame, n: int, k: int, trees: int, rounds: int, close: float) -> DataFrame:
    """(node, other, sim, fresh): staged, up to k entries a node; refined until few of the entries of at least the similarity close change."""
    trees += max(0, math.ceil(math.log2(max(n, 1) / NODES_OF_TREES)))
    bits = max(0, math.ceil(math.log2(max(n, 1) / LEAF)))
    leaves = nodes.select("node", "dim", "half").mapInArrow(partial(_leaves, trees=trees, bits=bits), "leaf long, node long, half binary")
    crowded = stage(leaves.groupBy("leaf").count().where(F.col("count") > 2 * LEAF).select("leaf", F.ceil(F.col("count") / LEAF).alias("parts")))
    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))
    dealt = leaves.join(crowded, "leaf", "left").select(F.xxhash64("leaf", part).alias("leaf"), "node", "half")
    merge = lambda df: stage(df.repartition(_tasks(n, 20_000), "node").mapInArrow(partial(_nearest, k=k), _LISTS))
    lists = merge(dealt.repartition(_tasks(n * trees, 20_000), "leaf").mapInArrow(partial(_in_leaf, k=k), _LISTS))
    halves = nodes.select(F.col("node").alias("member"), "half")
    discard(crowded)
    for _ in range(rounds):
        last = lists.groupBy("node").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("last"))
        known = stage(halves.join(last.withColumnRenamed("node", "member"), "member"))
        forth = lists.select(F.col("node").alias("center"), F.col("other").alias("member"), F.lit(False).alias("back"), "fresh")
        back = lists.select(F.col("other").alias("center"), F.col("node").alias("member"), F.lit(True).alias("back"), "fresh")
        met = forth.unionByName(back).join(known, "member").repartition(_tasks(n, 10_000), "center").mapInArrow(partial(_meet, k=k), _LISTS)
        turned = lists.where("fresh").select(F.col("other").alias("node"), F.col("node").alias("other"), "sim", "fresh")
        before, lists = lists, merge(lists.withColumn("fresh", F.lit(False)).unionByName(turned).unionByName(met))
        discard(before, known)
        changed, every = lists.where(F.col("sim") >= close).agg(F.count_if("fresh"), F.count("*")).first()
        if changed <= SETTLED * every:
            break
    return lists


def _with_units(pairs: DataFrame, nodes: DataFrame, a: str, b: str) -> DataFrame:
    left, right = (nodes.select(F.col("node").alias(x), F.col("unit").alias(u)) for x, u in ((a, "ua"), (b, "ub")))
    return pairs.join(left, a).join(right, b)


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _near_groups(nodes: DataFrame, members: DataFrame, threshold: float, k: int, trees: int, rounds: int) -> DataFrame:
    """members(node, leader). (seed, node), staged: each group's leader, and the members of another group that may link with its own."""
    angles = _with_units(members, nodes, "node", "leader").select("leader", "ua", "ub").mapInArrow(_angles, "leader long, angle double")
    radii = stage(angles.groupBy("leader").agg(F.max("angle").alias("radius")))
    seeds = stage(nodes.join(radii.select(F.col("leader").alias("node")), "node", "left_semi"))
    lists = neighbour_lists(seeds, seeds.count(), 2 * k, trees, rounds, threshold - MARGIN)
    of = lambda x: radii.select(F.col("leader").alias(x), F.col("radius").alias(f"radius_{x}"))
    reach = F.cos(F.least(F.lit(math.pi), F.col("radius_a") + F.col("radius_b") + math.acos(threshold)))
    near = _both_ways(lists.select(F.col("node").alias("a"), F.col("other").alias("b"), "sim").join(of("a"), "a").join(of("b"), "b").where(F.col("sim") >= reach - 0.01))
    return stage(near.distinct().join(members.select(F.col("leader").alias("b"), "node"), "b").select(F.col("a").alias("seed"), "node"))


def _enlarged(nodes: DataFrame, n: int, members: DataFrame, beside: DataFrame, nearby: DataFrame, threshold: float) -> DataFrame:
    """members(node, leader): saturated nodes and their groups; beside(a, b): who stands beside whom, both ways; nearby(seed, node): who may link with the
    group that seed is in. The grid's findings (kind, p, q), staged."""
    of = members.select(F.col("node").alias("a"), "leader")
    named = beside.join(of, "a").select("leader", F.col("b").alias("node"))
    named = named.unionByName(nearby.join(of.withColumnRenamed("a", "seed"), "seed").select("leader", "node")).unionByName(members.select("leader", "node")).distinct()
    candidates = stage(named.join(members.select("node", F.col("leader").alias("of")), "node", "left"))
    sizes = candidates.groupBy("leader").agg(F.count("*").alias("size"))
    side = F.greatest(F.least(F.lit(8), F.ceil(F.col("size") / 128)), F.ceil(F.col("size") / GRID_ROWS)).cast("int").alias("parts")
    dealt = candidates.join(stage(sizes.select("leader", side)), "leader").withColumn("spot", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    as_member = dealt.where(F.col("of") == F.col("leader")).select("leader", F.col("spot").alias("i"), F.explode(every).alias("j"), "node", F.lit(True).alias("side"), F.lit(True).alias("own"))
    as_candidate = dealt.select("leader", F.explode(every).alias("i"), F.col("spot").alias("j"), "node", F.lit(False).alias("side"), F.col("of").isNotNull().alias("own"))
    cells = as_member.unionByName(as_candidate).select(F.xxhash64("leader", "i", "j").alias("cell"), "node", "side", "own").join(nodes.select("node", "many", "unit"), "node")
    return stage(cells.repartition(_tasks(n, 5_000), "cell").mapInArrow(partial(_grid, threshold=threshold), "kind int, p long, q long"))


def links_of(nodes: DataFrame, n: int, threshold: float, k: int, trees: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(node, links): how many vectors a node links with, beside its own copies; (a, b): links with the same components as all."""
    lists = neighbour_lists(nodes, n, k, trees, rounds, threshold - MARGIN)
    close = lists.where(F.col("sim") >= threshold - 0.01)
    saturated = stage(close.groupBy("node").agg(F.count("*").alias("full")).where(F.col("full") >= k).select("node"))
    ends = close.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    found = stage(_with_units(ends, nodes, "a", "b").select("a", "b", "ua", "ub").mapInArrow(partial(_exact, threshold=threshold), "a long, b long"))
    counts = nodes.select(F.col("node").alias("b"), "many")
    if saturated.isEmpty():
        return _both_ways(found).join(counts, "b").groupBy(F.col("a").alias("node")).agg(F.sum("many").alias("links")), found
    full = saturated.select(F.col("node").alias("a"))
    beside = _both_ways(lists.where(F.col("sim") >= threshold - MARGIN).select(F.col("node").alias("a"), F.col("other").alias("b")))
    links, met, n_groups = found, None, -1
    while True:
        inner = links.join(full, "a").join(full.withColumnRenamed("a", "b"), "b")
        members = stage(saturated.join(components(inner.select("a", "b")), "node", "left").select("node", F.coalesce("component", "node").alias("leader")))
        now = members.select("leader").distinct().count()
        if now == n_groups:
            break
        if n_groups < 0:
            nearby = _near_groups(nodes, members, threshold, k, trees, rounds)
        n_groups, before = now, met
        met = _enlarged(nodes, n, members, beside.unionByName(_both_ways(links)), nearby, threshold)
        links = found.unionByName(met.where("kind = 1 and p != q").select(F.col("p").alias("a"), F.col("q").alias("b")))
        discard(before, members)
    own = met.where("kind = 0").groupBy(F.col("p").alias("node")).agg(F.sum("q").alias("links"))
    rest = _both_ways(found).unionByName(met.where("kind = 2").select(F.col("p").alias("a"), F.col("q").alias("b"))).distinct().join(full, "a", "left_anti")
    other = rest.join(counts, "b").groupBy(F.col("a").alias("node")).agg(F.sum("many").alias("links"))
    return own.unionByName(other), links


def _brute(batches: Iterator[pa.RecordBatch], asked: list[tuple[int, bytes]], threshold: float) -> Iterator[pa.RecordBatch]:
    by_dim: dict[int, list[tuple[int, bytes]]] = {}
    for q, u in asked:
        by_dim.setdefault(len(u), []).append((q, u))
    packed = {dim: (np.array([q for q, _ in own]), np.frombuffer(b"".join(u for _, u in own), "<f8").reshape(len(own), -1)) for dim, own in by_dim.items()}
    for batch in batches:
        node, many = batch.column("node").to_numpy(), batch.column("many").to_numpy()
        dims = pc.binary_length(batch.column("unit")).to_numpy()
        for dim in np.unique(dims):
            if int(dim) not in packed:
                continue
            every = np.flatnonzero(dims == dim)
            names, own = packed[int(dim)]
            links, others = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
            for at in range(0, len(every), 2048):
                rows = every[at : at + 2048]
                close = own @ _stacked(batch.column("unit"), rows, "<f8").T >= threshold
                close &= names[:, None] != node[rows][None, :]
                links += close @ many[rows]
                others += close.sum(axis=1)
            some = np.flatnonzero(others)
            yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(links[some]), pa.array(others[some])], names=["node", "links", "others"])


def recall(nodes: DataFrame, n: int, links: DataFrame, threshold: float, sample: int = AUDIT_NODES, limit: int = AUDIT_LIMIT) -> tuple[float, int]:
    """The mean share of its links that links has for a node, and how many nodes with links were asked: sample nodes of all and as many of those in links, chosen by
    hash, against all nodes, by brute force; four times as many, up to limit, while fewer than MIN_AUDITED of them truly have links. The lower of
    two means counts: of nodes that link with fewer than K others, and of the rest. 1.0 if none has a link."""
    while True:
        linked = smallest(nodes.join(links.where("links > 0").select("node"), "node", "left_semi").select("node", "unit"), sample, "node")
        asked = smallest(nodes.select("node", "unit"), sample, "node").unionByName(linked).toArrow()
        pairs = list(dict(zip(asked.column(0).to_pylist(), asked.column(1).to_pylist(), strict=True)).items())
        true = nodes.select("node", "many", "unit").mapInArrow(partial(_brute, asked=pairs, threshold=threshold), "node long, links long, others long").groupBy("node").agg(F.sum("links").alias("real"), F.sum("others").alias("others"))
        share = F.least("real", F.coalesce("links", F.lit(0))) / F.col("real")
        means = true.join(links, "node", "left").groupBy(F.col("others") < K).agg(F.avg(share).alias("mean"), F.count("*").alias("n")).collect()
        audited = sum(r["n"] for r in means)
        if audited >= MIN_AUDITED or sample >= min(n, limit):
            return min((r["mean"] for r in means), default=1.0), audited
        sample = min(4 * sample, limit)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, k: int = K, trees: int = TREES, rounds: int = ROUNDS) -> DataFrame:
    """id_col, n_links (long), component_id (long: the smallest id reachable), kept (boolean)."""
    rows = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(vector)).cast("array<double>").alias("v"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = F.coalesce((F.size("v") > 0) & F.forall("v", number) & F.exists("v", lambda x: x != 0), F.lit(False))
    plain = rows.where(valid).groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("many")).withColumn("node", F.monotonically_increasing_id())
    keyed = stage(plain)
    nodes = stage(keyed.mapInArrow(_unit, "node long, rep long, many long, dim int, unit binary, half binary"))
    n = nodes.count()
    for attempt in range(ATTEMPTS):
        links, ends = links_of(nodes, n, threshold, k << attempt, trees, rounds)
        links, ends = stage(links), stage(ends)
        share, audited = recall(nodes, n, links, threshold)
        _log.info("neighbour lists of %d: recall %.4f of %d nodes with links", k << attempt, share, audited)
        if share >= MIN_RECALL:
            break
    else:
        raise RuntimeError(f"recall {share:.4f} after {ATTEMPTS} attempts, below {MIN_RECALL}")
    groups = components(ends)
    classed = nodes.select("node", "rep", "many").join(groups, "node", "left").join(links, "node", "left").select("node", "rep", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("class"))
    classed = stage(classed)
    least = stage(classed.groupBy("class").agg(F.min("rep").alias("component_id")))
    final = stage(classed.join(least, "class").select("node", "n_links", "component_id"))
    by_vector = stage(keyed.select("v", "node").join(final, "node").select("v", "n_links", "component_id"))
    judged = rows.where(valid).join(by_vector, "v").select("id", "n_links", "component_id")
    alone = rows.where(~valid).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"))
    out = judged.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
