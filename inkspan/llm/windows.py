"""Substring dedup (operator 8): Rabin-Karp hashes of every window of so many words, counted over the corpus.

Every word has two random numbers (XXH64 under two seeds). A window's hash is a pair: a polynomial over its words' first numbers modulo
the prime 2**61 - 1, and the upper half of one over their second numbers modulo 2**64. Hashes of windows of 2, 4, 8 ... words are made from those of half
the length, and joined to the length asked for. A task packs some 12 million characters of documents into a
chunk and sends the chunk's distinct window hashes, sorted, to buckets of the hash range. The task of a bucket counts in how
many chunks each hash stands and answers every chunk with those found elsewhere; repeats inside a chunk show in the chunk itself.
Back at the chunk, which never moved (it is staged in buckets and cogrouped in place), windows with a repeated hash are merged
into maximal runs of words, and these are removed. A hash that a third of all windows share costs one entry for each chunk,
so nothing is hot. Only hashes are shuffled: 12 bytes a window, less after packing.

Two different windows are taken for repeats if all 93 bits of their hashes agree: among n windows some n * n / 2**94 pairs, 0.005 on
10**13 windows (100 TB). No structure of a text helps that on: the prime modulus has no low bits of its own, unlike a power of two.

Cases: a null text has no words, and texts with fewer words than a window keep all; repeated rows repeat each other's windows,
so both lose them; an empty table gives no rows; columns named in ``keep`` pass through, others are dropped; a text of any length is
judged whole, in pieces that overlap by a window less one word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.llm.common import chunk_id, give_back, pack_sorted, pack_table, partitions_for, small_batches, stage_bucketed, text_bytes, tidy, unpack_sorted, unpack_table

CHUNK_BYTES = 12_000_000
BLOCK_WORDS = 200_000
PIECE_WORDS = 100_000
BUCKET_WINDOWS = 3_000_000
PRIME = (1 << 61) - 1
#: Bases of the two polynomials, drawn at random; the second is odd.
BASES = (0x11B6DC7F2E9A4C35, 0x9E3779B97F4A7C15)
SEEDS = (20240131, 20240607)
Pairs = tuple[np.ndarray, np.ndarray]


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


def times(x: np.ndarray, c: int) -> np.ndarray:
    """x * c modulo the prime, in parts of 31 bits: 2**61 counts as 1."""
    low, high = np.uint64(c & 0x7FFFFFFF), np.uint64(c >> 31)
    a, b = x & np.uint64(0x7FFFFFFF), x >> np.uint64(31)
    middle = b * low + a * high
    return _reduce((b * high << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64(0x3FFFFFFF)) << np.uint64(31)) + a * low)


def polynomials(first: np.ndarray, second: np.ndarray, size: int) -> Pairs:
    """Of every window of size numbers: the polynomial over first modulo the prime, and that over second modulo 2**64."""
    n = len(first) - size + 1
    done: Pairs | None = None
    length, made = 1, 0
    while True:
        if size & length:  # the window's next so many words
            if done is None:
                done = first[:n], second[:n]
            else:
                p, q = pow(BASES[0], length, PRIME), pow(BASES[1], length, 1 << 64)
                done = _reduce(times(done[0], p) + first[made : made + n]), done[1] * np.uint64(q) + second[made : made + n]
            made += length
        if 2 * length > size:
            return done
        p, q = pow(BASES[0], length, PRIME), pow(BASES[1], length, 1 << 64)
        first, second = _reduce(times(first[:-length], p) + first[length:]), second[:-length] * np.uint64(q) + second[length:]
        length *= 2


def numbers(words: list[bytes]) -> Pairs:
    """Each word's two random numbers; the first below the prime."""
    coded = pa.array(words, pa.large_binary()).dictionary_encode()
    own = coded.dictionary.to_pylist()
    at = coded.indices.to_numpy()
    first, second = (np.fromiter((xxhash.xxh64_intdigest(w, seed=s) for w in own), np.uint64, len(own)) for s in SEEDS)
    return _reduce(first)[at], second[at]


def text_hashes(texts: list[list[bytes]], size: int) -> Iterator[tuple[int, int, Pairs]]:
    """For texts given as words: (text's number, first word's number, hashes of the windows that begin there and at the next
    words), block by block."""
    block: list[tuple[int, int, int]] = []
    held: list[bytes] = []

    def run() -> Iterator[tuple[int, int, Pairs]]:
        prime, power = polynomials(*numbers(held), size)
        power = (power >> np.uint64(32)).astype(np.uint32)
        at = 0
        for text, word, n in block:
            windows = slice(at, at + n - size + 1)  # none across two texts
            yield text, word, (prime[windows], power[windows])
            at += n

    for t, words in enumerate(texts):
        for start in range(0, len(words) - size + 1, PIECE_WORDS):
            piece = words[start : start + PIECE_WORDS + size - 1]
            block.append((t, start, len(piece)))
            held += piece
            if len(held) >= BLOCK_WORDS:
                yield from run()
                block, held = [], []
    if block:
        yield from run()
        block, held = [], []


def distinct(pairs: Pairs) -> tuple[Pairs, np.ndarray]:
    """The different pairs, sorted, and how often each is there."""
    a, b = pairs
    order = np.argsort(a)
    a, b = a[order], b[order]
    if len(a) and ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():  # only then may equal pairs stand apart
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    starts = np.flatnonzero(new)
    return (a[starts], b[starts]), np.diff(np.append(starts, len(a)))


def among(pairs: Pairs, known: Pairs) -> np.ndarray:
    """Which pairs are among known, which is sorted and has each once."""
    (a, b), (x, y) = pairs, known
    if not len(x):
        return np.zeros(len(a), bool)
    at = np.minimum(np.searchsorted(x, a), len(x) - 1)
    found = (x[at] == a) & (y[at] == b)
    open_ = np.flatnonzero((x[at] == a) & ~found)
    while len(open_):  # first numbers that several pairs share
        at[open_] += 1
        open_ = open_[at[open_] < len(x)]
        open_ = open_[x[at[open_]] == a[open_]]
        found[open_] = y[at[open_]] == b[open_]
        open_ = open_[~found[open_]]
    return found


def joined(parts: list[Pairs]) -> Pairs:
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])


def _packed(pairs: Pairs) -> bytes:
    a = pack_sorted(pairs[0])
    return len(a).to_bytes(8, "little") + a + pairs[1].astype("<u4").tobytes()


def _unpacked(data: bytes) -> Pairs:
    end = 8 + int.from_bytes(data[:8], "little")
    return unpack_sorted(data[8:end]), np.frombuffer(data, "<u4", offset=end)


def _split(texts: pa.ChunkedArray | pa.Array) -> list[list[bytes]]:
    return [(t or b"").split() for t in text_bytes(texts)]


@tidy
def _chunks(batches: Iterator[pa.RecordBatch], size: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    kept: list[pa.RecordBatch] = []
    held = windows = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"chunk": [chunk_id()], "n_windows": [windows], "docs": pa.array([pack_table(pa.Table.from_batches(kept))], pa.binary())})

    for batch in batches:
        texts = text_bytes(batch.column(batch.num_columns - 1))
        start = 0
        for i, t in enumerate(texts):
            held += len(t or b"")
            windows += len(t or b"") // 6
            if held >= chunk_bytes:
                kept.append(batch.slice(start, i + 1 - start))
                start = i + 1
                yield flush()
                kept, held, windows = [], 0, 0
        if start < batch.num_rows:
            kept.append(batch.slice(start))
    if kept:
        yield flush()


@tidy
def _hashes(batches: Iterator[pa.RecordBatch], size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    edges = np.array([k * PRIME // buckets for k in range(1, buckets)], np.uint64)
    for batch in batches:
        for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            (a, b), _ = distinct(joined([h for _, _, h in text_hashes(_split(_texts(unpack_table(packed.as_py()))), size)]))
            cuts = [0, *np.searchsorted(a, edges), len(a)]
            for k in range(buckets):
                own = slice(cuts[k], cuts[k + 1])
                if cuts[k] < cuts[k + 1]:
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([k], pa.int32()), "chunk": [chunk], "hashes": pa.array([_packed((a[own], b[own]))], pa.binary())})


def _texts(table: pa.Table) -> pa.Array:
    return table.column(table.num_columns - 1).combine_chunks()


@tidy
def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task, one bucket: to each chunk, those of its hashes that stand in another chunk too."""
    chunks: list[int] = []
    packed: list[bytes] = []
    for batch in batches:
        chunks += batch.column("chunk").to_pylist()
        packed += batch.column("hashes").to_pylist()
    if not chunks:
        return
    (a, b), many = distinct(joined([_unpacked(p) for p in packed]))
    twice = a[many > 1], b[many > 1]
    del a, b, many
    for chunk, p in zip(chunks, packed, strict=True):
        own = _unpacked(p)
        hits = among(own, twice)
        if hits.any():
            yield pa.RecordBatch.from_pydict({"chunk": [chunk], "hashes": pa.array([_packed((own[0][hits], own[1][hits]))], pa.binary())})


def _remove(left: pa.Table, right: pa.Table, size: int, names: list[str]) -> pa.Table:
    docs = unpack_table(left.column("docs")[0].as_py())
    texts = _split(_texts(docs))
    found = list(text_hashes(texts, size))
    (a, b), many = distinct(joined([h for _, _, h in found]))
    repeated, _ = distinct(joined([(a[many > 1], b[many > 1]), *(_unpacked(x.as_py()) for x in right.column("hashes"))]))
    del a, b, many
    give_back()
    covered: dict[int, np.ndarray] = {}
    for text, word, h in found:
        hits = np.flatnonzero(among(h, repeated)) + word
        if len(hits):
            steps = covered.setdefault(text, np.zeros(len(texts[text]) + 1, np.int64))
            steps[hits] += 1
            steps[hits + size] -= 1
    kept, removed, spans = [], [], []
    n_words = [len(w) for w in texts]
    for t in range(len(texts)):
        words, texts[t] = texts[t], None  # each text's words go as soon as they are written
        if t in covered:
            out = np.cumsum(covered[t][:-1]) > 0
            turns = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
            spans.append([{"start": int(a), "end": int(b)} for a, b in turns.reshape(-1, 2)])
            removed.append(int(out.sum()))
            kept.append(b" ".join([w for w, x in zip(words, out.tolist(), strict=True) if not x]))
        else:
            spans.append([])
            removed.append(0)
            kept.append(b" ".join(words))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    columns = [docs.column(c) for c in range(docs.num_columns - 1)]
    del found, repeated, covered, docs
    give_back()
    return pa.table([*columns, pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()).cast(pa.string())], names=names)


def remove_repeats(df: DataFrame, size: int = 35, text: str = "text", keep: tuple[str, ...] = ("doc_id",), chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """keep..., n_words, n_removed (long), removed (array of word intervals, end exclusive), kept_text (the words left, joined by
    one space): every word is removed that a window of size words covers whose words also begin anywhere else."""
    small_batches(df.sparkSession)
    source = df.select(*(df[c].alias(f"k{i}") for i, c in enumerate(keep)), df[text].alias("text"))
    chunks = stage_bucketed(source.mapInArrow(partial(_chunks, size=size, chunk_bytes=chunk_bytes), "chunk long, n_windows long, docs binary"), "chunk", partitions_for(source, 4 << 20))
    buckets = max(1, -(-(chunks.agg(F.sum("n_windows")).first()[0] or 0) // BUCKET_WINDOWS))
    hashes = chunks.select("chunk", "docs").mapInArrow(partial(_hashes, size=size, buckets=buckets), "bucket int, chunk long, hashes binary")
    shared = hashes.repartitionById(buckets, F.col("bucket")).mapInArrow(_shared, "chunk long, hashes binary")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", span), T.StructField("kept_text", T.StringType())])
    out = chunks.select("chunk", "docs").groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(partial(_remove, size=size, names=schema.names), schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "n_words", "n_removed", "removed", "kept_text")
