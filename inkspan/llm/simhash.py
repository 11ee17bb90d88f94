"""SimHash near-dedup (operator 5) by anchor-point covering.

Fingerprints of 64 bits link at 3 or fewer differing bits. Of two such fingerprints, one half of 32 bits differs in at most one
bit. For a half the anchors are a covering code: the perfect Golay code on 23 bits (covering radius 3), the perfect Hamming code on
7 (radius 1) and the last 2 bits as they are (radius 0), 2**18 anchors in all, of covering radius 4. Each fingerprint is at home
at the one anchor within the radius part by part, and visits every anchor within radius plus threshold (1); so of each linked pair
one is at home where the other visits, and an anchor compares its homes with its visitors. That is some 9 replicas a half, for
buckets of one in 2**18 of the distinct fingerprints.

Copies are merged before: only distinct fingerprints are replicated. An anchor with more than HOT_ANCHOR rows is dealt again by
the four 16-bit quarters of the fingerprint, of which a linked pair shares at least one, so none is dropped and no task gets a crowded
anchor whole. A task links the fingerprints of an anchor to the smallest one of their class there: as many links as
fingerprints, not pairs. Connected components over these links give the groups.

Cases: a null text is as an empty one and has fingerprint zero, linked like any other; fewer than three words are one shingle;
repeated rows share a group; a null id is a document like any other, but names a group only if no other id is there (component_id is then null); an empty
table gives no rows; extra columns are dropped by ``fingerprints`` and kept by ``one_of_each``."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.llm.common import quoted, small_batches, stage, text_bytes, tidy
from inkspan.llm.components import components

SEED = 42
SHINGLE = 3
THRESHOLD = 3
HOT_ANCHOR = 2048
ROWS_A_TASK = 400_000
#: Generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, and of the Hamming code, x^3 + x + 1.
GOLAY, HAMMING = 0b110001110101, 0b1011


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each group of counts[i] > 0 hashes in turn: a bit is 1 if set in over half of them. Bits are counted in
    the eight byte lanes of a word, in blocks of at most 255."""
    blocks = (counts + 254) // 255
    first = np.cumsum(blocks) - blocks
    owner = np.repeat(np.arange(len(counts)), blocks)
    starts = (np.cumsum(counts) - counts)[owner] + 255 * (np.arange(len(owner)) - first[owner])
    lanes = np.empty((len(owner), 8, 8), np.uint8)
    for k in range(8):
        ones = (hashes >> np.uint64(k)) & np.uint64(0x0101010101010101)
        lanes[:, :, k] = np.add.reduceat(ones, starts).astype("<u8").view(np.uint8).reshape(-1, 8)
    sums = np.add.reduceat(lanes.reshape(-1, 64), first, axis=0, dtype=np.int64)
    return np.packbits(2 * sums > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


def text_fingerprints(texts: list[bytes | None]) -> np.ndarray:
    """Of each text, unsigned 64-bit."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    held: list[np.ndarray] = []
    counts: list[int] = []
    rows: list[int] = []
    size = 0

    def close() -> None:
        nonlocal held, counts, rows, size
        if rows:
            out[rows] = majority(np.concatenate(held), np.array(counts))
        held, counts, rows, size = [], [], [], 0

    for i, text in enumerate(texts):
        words = (text or b"").lower().split()
        if not words:
            continue
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))) or [b" ".join(words)]
        held.append(np.fromiter(map(digest, shingles, repeat(SEED)), np.uint64, len(shingles)))
        counts.append(len(shingles))
        rows.append(i)
        size += len(shingles)
        if size > 500_000:
            close()
    close()
    return out


@tidy
def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = text_fingerprints(text_bytes(batch.column(2)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(values.view(np.int64))], names=["id", "same", "fp"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id (as it is), same (long: equal for equal texts), fp (long: the 64 bits)."""
    small_batches(df.sparkSession)
    of = lambda c: F.col(quoted(c))
    source = df.select(of(id_col).alias("id"), F.xxhash64(of(text)).alias("same"), of(text).alias("text"))
    return source.mapInArrow(_fingerprint, T.StructType([*source.schema.fields[:-1], T.StructField("fp", T.LongType())]))


def _remainders(poly: int, bits: int) -> np.ndarray:
    """Of every word of so many bits, what division by the generator leaves."""
    degree = poly.bit_length() - 1
    table = np.zeros(1 << bits, np.uint32)
    for i in range(bits):
        x = 1 << i
        for j in range(bits - 1, degree - 1, -1):
            if x >> j & 1:
                x ^= poly << (j - degree)
        table[1 << i : 2 << i] = table[: 1 << i] ^ x
    return table


def _patterns(poly: int, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """By remainder: the one error pattern of weight radius or less, and the further ones of weight up to radius + 1, padded with it."""
    degree = poly.bit_length() - 1
    left = _remainders(poly, bits)
    home, more = np.zeros(1 << degree, np.uint32), [[] for _ in range(1 << degree)]
    for weight in range(radius + 2):
        for places in combinations(range(bits), weight):
            x = sum(1 << p for p in places)
            if weight <= radius:
                home[left[x]] = x
            else:
                more[left[x]].append(x)
    wide = max(map(len, more))
    return home, np.array([m + [h] * (wide - len(m)) for m, h in zip(more, home.tolist(), strict=True)], np.uint32)


@lru_cache(maxsize=1)
def _codes():
    return _remainders(GOLAY, 23), *_patterns(GOLAY, 23, 3), _remainders(HAMMING, 7), *_patterns(HAMMING, 7, 1)


def half_anchors(half: np.ndarray) -> np.ndarray:
    """Of 32-bit halves: column 0 the home anchor, then all others within radius plus threshold; a repeat of column 0 is padding."""
    left_g, home_g, more_g, left_h, home_h, more_h = _codes()
    g, h, rest = half & 0x7FFFFF, half >> 23 & 0x7F, half >> 30
    rg, rh = left_g[g], left_h[h]
    at = lambda a, b, c: a.astype(np.uint32) | b.astype(np.uint32) << np.uint32(23) | c.astype(np.uint32) << np.uint32(30)
    g0, h0 = g ^ home_g[rg], h ^ home_h[rh]
    columns = [at(g0, h0, rest)]
    columns += [at(g ^ more_g[rg, k], h0, rest) for k in range(more_g.shape[1])]
    columns += [at(g0, h ^ more_h[rh, k], rest) for k in range(more_h.shape[1])]
    columns += [at(g0, h0, rest ^ k) for k in (1, 2)]
    return np.stack(columns, axis=1)


@tidy
def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for half in (0, 1):
            anchors = half_anchors((fp >> np.uint64(32 * half)).astype(np.uint32))
            used = anchors != anchors[:, :1]
            used[:, 0] = True
            row, column = np.nonzero(used)
            key = anchors[row, column].astype(np.int64) << 1 | half
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row].view(np.int64)), pa.array(column == 0)], names=["anchor", "fp", "home"])


def _classes(fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different fingerprints of one anchor: those linked there, and the smallest of each one's class. All meet the homes, in
    blocks of some 4 million pairs; the smallest number spreads until nothing changes, and no pair is kept."""
    ranked = np.sort(fp)
    label = np.searchsorted(ranked, fp)
    own, changed = label.copy(), True
    homes = np.flatnonzero(home)
    step = max(1, 4_000_000 // len(homes))
    while changed:
        least = label.copy()
        for k in range(0, len(fp), step):
            near = np.bitwise_count(fp[k : k + step, None] ^ fp[homes][None, :]) <= THRESHOLD
            least[k : k + step] = np.minimum(least[k : k + step], np.where(near, label[homes][None, :], len(fp)).min(axis=1))
            least[homes] = np.minimum(least[homes], np.where(near, label[k : k + step, None], len(fp)).min(axis=0))
        changed = bool((least != label).any())
        label = least
    linked = label != own
    return fp[linked], ranked[label[linked]]


@tidy
def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of some anchors. Links each linked fingerprint to the smallest of its class at the anchor."""
    keys, fps, homes = [], [], []
    for batch in batches:
        keys.append(batch.column("key").to_numpy())
        fps.append(batch.column("fp").to_numpy().view(np.uint64))
        homes.append(batch.column("home").to_numpy(zero_copy_only=False).astype(bool))
    if not keys:
        return
    key, fp, home = np.concatenate(keys), np.concatenate(fps), np.concatenate(homes)
    order = np.argsort(key, kind="stable")
    key, fp, home = key[order], fp[order], home[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
    # pairs of small anchors at once: each visitor against the homes of its anchor
    n_home = np.add.reduceat(home.astype(np.int64), edges[:-1])
    total = np.diff(edges)
    out_a, out_b = [], []
    small = (n_home > 0) & (total > 1) & (n_home * total <= 4096)
    place = np.lexsort((~home, key))  # homes first within an anchor
    key, fp, home = key[place], fp[place], home[place]
    group = np.repeat(np.arange(len(total)), total)
    rows = np.flatnonzero(small[group])
    for k in range(0, len(rows), 200_000):
        own = rows[k : k + 200_000]
        g = group[own]
        c = n_home[g]
        left = np.repeat(own, c)
        right = np.arange(int(c.sum())) + np.repeat(edges[g] - (np.cumsum(c) - c), c)
        close = (np.bitwise_count(fp[left] ^ fp[right]) <= THRESHOLD) & (fp[left] != fp[right])
        out_a.append(fp[left[close]])
        out_b.append(fp[right[close]])
    for g in np.flatnonzero((n_home > 0) & (total > 1) & ~small):
        part, at_home = fp[edges[g] : edges[g + 1]], home[edges[g] : edges[g + 1]]
        a, b = _classes(part, at_home)
        out_a.append(a)
        out_b.append(b)
    if out_a:
        pairs = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]].view(np.int64)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def linked(distinct: DataFrame, hot: int = HOT_ANCHOR) -> DataFrame:
    """distinct(fp): different fingerprints, staged. Links (a, b) between them whose components are those of all pairs that
    differ in 3 bits or fewer."""
    replicas = distinct.mapInArrow(_replicate, "anchor long, fp long, home boolean")
    crowded = stage(replicas.groupBy("anchor").count().where(F.col("count") > hot).select("anchor", F.lit(True).alias("crowded")))
    quarters = F.array(*(F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF).alias("q")) for k in range(4)))
    whole = F.array(F.struct(F.lit(-1).alias("k"), F.lit(0).cast("long").alias("q")))
    parts = replicas.join(crowded, "anchor", "left").withColumn("part", F.explode(F.when(F.col("crowded"), quarters).otherwise(whole)))
    keyed = parts.select(F.xxhash64("anchor", "part.k", "part.q").alias("key"), "fp", "home")
    tasks = max(8, -(-distinct.count() * 22 // ROWS_A_TASK))
    return keyed.repartition(tasks, "key").mapInArrow(_compare, "a long, b long")


def _grouped(own: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """own(id, same, fp), staged. (fp, class) of each fingerprint; (class, rep) of each group, rep being the first of its rows: that with the smallest
    id, null ids last, then by text."""
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "same"))
    distinct = stage(own.groupBy("fp").agg(first.alias("rep")))
    groups = components(linked(distinct.select("fp"), hot))
    classed = stage(distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("class")))
    return classed.select("fp", "class"), stage(classed.groupBy("class").agg(F.min("rep").alias("rep")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", hot: int = HOT_ANCHOR) -> DataFrame:
    """id_col (long), fingerprint (16 hexadecimal digits), component_id (the smallest id reachable by links)."""
    own = stage(fingerprints(df, id_col, text))
    classed, first = _grouped(own, hot)
    final = stage(classed.join(first, "class").select("fp", F.col("rep.id").alias("component_id")))
    return own.join(final, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text: str = "text", hot: int = HOT_ANCHOR) -> DataFrame:
    """df's columns, whatever their names: of each group one row, that with the smallest id; ids that are null come last, and of rows with the same id and text
    the first by their other plain columns stays."""
    names = df.columns
    plain = [c.name for c in df.schema.fields if isinstance(c.dataType, T.AtomicType) and c.name != text]
    of = lambda c: F.col(quoted(c))
    _, first = _grouped(stage(fingerprints(df, id_col, text)), hot)
    kept = first.select(F.col("rep.id").alias("kept_id"), F.col("rep.same").alias("kept_same"))
    order = F.struct(*(of(c).alias(f"o{i}") for i, c in enumerate(plain))) if plain else F.lit(0)
    rows = df.select(of(id_col).alias("id"), F.xxhash64(of(text)).alias("same"), order.alias("order"), F.struct(*(of(c).alias(f"k{i}") for i, c in enumerate(names))).alias("row"))
    found = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("same") == F.col("kept_same")))
    return found.groupBy("id", "same").agg(F.min_by("row", "order").alias("row")).select(*(F.col(f"row.k{i}").alias(c) for i, c in enumerate(names)))
