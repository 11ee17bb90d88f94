"""Byte-level BPE encoding and decoding (operator 3): each distinct pre-token of the whole corpus is encoded once.

The plan is a global distinct-word shuffle, with its rows packed. A task turns its documents into chunks of some 12 million
characters: the pre-tokens by position as numbers into the chunk's list of distinct pre-tokens. The lists are exploded over
buckets of the pre-token's hash; the task of a bucket sees every chunk's mention of a pre-token, encodes it once, and sends the
ids back to the chunks; there the documents are put together again by position. The sequences by position never move: the
chunks are staged in buckets and cogrouped in place. Exploding one Spark row for each pre-token (some 170 million on 0.5 GB)
would shuffle several times the input; packed, all shuffles and the staged table come to about its size.

Decoding joins the token-byte table, which is bounded by the vocabulary, to the ids by position.

Cases: a null or empty text has no ids; repeated rows are encoded alike and all kept; an empty table gives no rows; columns named
in ``keep`` pass through whatever their names, others are dropped. A text of any length is encoded whole. Decoding an id that is
not in the vocabulary raises ValueError; null ids decode to empty bytes."""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.llm.common import chunk_id, copy_rows, expand, give_back, pack_table, partitions_for, small_batches, squeeze, stage_bucketed, tidy, unpack_table

CHUNK_CHARS = 12_000_000
BUCKET_WORDS = 250_000
#: Characters on which ``re`` and the tokenizer's own pattern language may differ in their classes; a text that has any is split by ``regex``.
_UNSURE = re.compile("[\x1c-\x1f²³¹¼-¾]|[^\x00-ɏ‐-‧‰-⁞]")


@lru_cache(maxsize=4)
def _splitters(pattern: str):
    import regex

    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:_|[^\s\w])").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    return (re.compile(plain).findall if r"\p" not in plain else None), regex.compile(pattern).findall


def pre_tokens(text: str, pattern: str) -> list[str]:
    """The matches of pattern, whole and in order."""
    fast, sure = _splitters(pattern)
    return fast(text) if fast and not _UNSURE.search(text) else sure(text)


@lru_cache(maxsize=4)
def parse_ranks(data: bytes) -> dict[bytes, int]:
    """The bytes of a rank file: on each line a token in base 64 and its id."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


@lru_cache(maxsize=4)
def _encoder(data: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=parse_ranks(data), special_tokens={})._core_bpe.encode_single_piece


@lru_cache(maxsize=4)
def _token_table(data: bytes) -> list[bytes | None]:
    ranks = parse_ranks(data)
    table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _planes(values: np.ndarray) -> bytes:
    return squeeze(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(expand(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


@tidy
def _chunks(batches: Iterator[pa.RecordBatch], pattern: str, chunk_chars: int) -> Iterator[pa.RecordBatch]:
    kept: list[pa.RecordBatch] = []
    lengths: list[int] = []
    numbers: list[np.ndarray] = []
    known: dict[str, int] = {}
    chars = 0

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(kept).append_column("\0n", pa.array(lengths, pa.int64()))
        words = pa.table({"w": pa.array([w.encode("utf-8", "surrogatepass") for w in known], pa.large_binary())})
        seq = np.concatenate(numbers) if numbers else np.empty(0, np.uint32)
        return pa.RecordBatch.from_pydict({"chunk": [chunk_id()], "n_words": [len(known)], "docs": pa.array([pack_table(table)], pa.binary()), "seq": pa.array([_planes(seq)], pa.binary()), "words": pa.array([pack_table(words)], pa.binary())})

    for batch in batches:
        texts, rest = batch.column(batch.num_columns - 1), batch.select(list(range(batch.num_columns - 1)))
        start = 0
        for i, text in enumerate(texts):
            words = pre_tokens(text.as_py() or "", pattern)
            number = known.setdefault
            numbers.append(np.fromiter([number(w, len(known)) for w in words], np.uint32, len(words)))
            lengths.append(len(words))
            chars += len(text.as_py() or "")
            if chars >= chunk_chars:
                kept.append(copy_rows(rest, start, i + 1))
                start = i + 1
                yield flush()
                kept, lengths, numbers, known, chars = [], [], [], {}, 0
        if start < batch.num_rows:
            kept.append(copy_rows(rest, start, batch.num_rows))
    if lengths:
        yield flush()


@tidy
def _mentions(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Of each chunk's list, the part of each bucket."""
    for batch in batches:
        for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = unpack_table(packed.as_py()).column("w").combine_chunks()
            where = np.fromiter((zlib.crc32(w) for w in words.to_pylist()), np.int64, len(words)) % buckets
            order = np.argsort(where, kind="stable")
            edges = np.searchsorted(where[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)):
                rows = order[edges[b] : edges[b + 1]]
                part = pack_table(pa.table({"i": pa.array(rows, pa.int32()), "w": words.take(pa.array(rows))}))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "chunk": [chunk], "part": pa.array([part], pa.binary())})


@tidy
def _encode_bucket(batches: Iterator[pa.RecordBatch], ranks: bytes, pattern: str) -> Iterator[pa.RecordBatch]:
    """One task, one bucket: all mentions of its words meet here, so each is encoded once."""
    encode, done = _encoder(ranks, pattern), {}
    for batch in batches:
        for chunk, part in zip(batch.column("chunk").to_pylist(), batch.column("part"), strict=True):
            table = unpack_table(part.as_py())
            ids = []
            for w in table.column("w").to_pylist():
                if w not in done:
                    own = encode(w)
                    done[w] = struct.pack(f"<{len(own)}I", *own)
                ids.append(done[w])
            lengths = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
            flat = np.frombuffer(b"".join(ids), "<u4")
            yield pa.RecordBatch.from_pydict({"chunk": [chunk], "i": pa.array([_planes(table.column("i").to_numpy())], pa.binary()), "n": pa.array([_planes(lengths)], pa.binary()), "ids": pa.array([_planes(flat)], pa.binary())})


def _reassemble(left: pa.Table, right: pa.Table, names: list[str]) -> pa.Table:
    docs = unpack_table(left.column("docs")[0].as_py())
    seq = _from_planes(left.column("seq")[0].as_py()).astype(np.int64)
    parts = [tuple(_from_planes(right.column(c)[r].as_py()) for c in ("i", "n", "ids")) for r in range(right.num_rows)]
    at, lengths, ids = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.uint32) for k in range(3))
    first, count = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    count[at] = lengths
    first[at] = np.cumsum(lengths, dtype=np.int64) - lengths
    n = docs.column("\0n").to_numpy()
    ends = np.cumsum(n)
    totals = np.add.reduceat(np.append(count[seq], 0), np.minimum(ends - n, len(seq))) * (n > 0) if len(n) else n
    offsets = np.concatenate([[0], np.cumsum(totals)])
    flat = np.empty(offsets[-1], "<u4")
    for k, end in enumerate(ends):
        own = seq[end - n[k] : end]
        c = count[own]
        flat[offsets[k] : offsets[k + 1]] = ids[np.arange(totals[k]) + np.repeat(first[own] - (np.cumsum(c) - c), c)]
    values = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((4 * offsets).astype("<i4")), pa.py_buffer(flat)])
    columns = [docs.column(x) for x in range(docs.num_columns - 1)]
    del seq, at, ids, first, count, parts
    give_back()
    return pa.table([*columns, pa.array(totals, pa.int64()), values], names=names)


def encode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """keep..., n_tokens (long), ids (binary: unsigned 32-bit integers, little-endian) of every row's whole text. ranks: the
    bytes of a rank file; pattern: what splits texts before the merges."""
    small_batches(df.sparkSession)
    source = df.select(*(df[c].alias(f"k{i}") for i, c in enumerate(keep)), df[text].alias("text"))
    kept = source.schema.fields[:-1]
    chunk_schema = "chunk long, n_words long, docs binary, seq binary, words binary"
    chunks = stage_bucketed(source.mapInArrow(partial(_chunks, pattern=pattern, chunk_chars=chunk_chars), chunk_schema), "chunk", partitions_for(source, 4 << 20))
    words = chunks.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(1, -(-words // BUCKET_WORDS))
    mentions = chunks.select("chunk", "words").mapInArrow(partial(_mentions, buckets=buckets), "bucket int, chunk long, part binary")
    encoded = mentions.repartitionById(buckets, F.col("bucket")).mapInArrow(partial(_encode_bucket, ranks=ranks, pattern=pattern), "chunk long, i binary, n binary, ids binary")
    schema = T.StructType([*kept, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    whole = chunks.select("chunk", "docs", "seq").groupBy("chunk").cogroup(encoded.groupBy("chunk")).applyInArrow(partial(_reassemble, names=schema.names), schema)
    return whole.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "n_tokens", "ids")


@tidy
def _decode(batches: Iterator[pa.RecordBatch], ranks: bytes) -> Iterator[pa.RecordBatch]:
    table = _token_table(ranks)
    for batch in batches:
        out = []
        for ids in batch.column(batch.num_columns - 1).to_pylist():
            try:
                out.append(b"".join([table[i] for i in np.frombuffer(ids or b"", "<u4").tolist()]))
            except (IndexError, TypeError) as e:
                raise ValueError("an id is not in the vocabulary") from e
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])


def decode(df: DataFrame, ranks: bytes, ids: str = "ids") -> DataFrame:
    """df's columns and decoded (binary): the bytes of each row's ids."""
    names = [c for c in df.columns if c != "decoded"]
    source = df.select(*(df[c].alias(f"k{i}") for i, c in enumerate(names)), df[ids].alias("\0ids"))
    schema = T.StructType([*source.schema.fields, T.StructField("decoded", T.BinaryType())])
    out = source.mapInArrow(partial(_decode, ranks=ranks), schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(names)), "decoded")
