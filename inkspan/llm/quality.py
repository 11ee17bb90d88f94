"""Quality rules (operator 2): counts of each document, and the cross-document line frequency of its host.

A document's lines are normalised (words of A-Z in lower case, runs of digits as 0, one space between) and hashed. For every host
and line the distinct documents are counted; a line is over the limit when they are more than MIN_DOCUMENTS and than MAX_SHARE of
the host's documents. Lines over the limit are removed, and a document left with under MIN_LEFT of its words is rejected as depleted.
The column ``source`` is the host. Copies of one document, whose distinct normalised lines are the same, count once: documents are told
apart by a fingerprint of all of them, so a clean text that stands there a thousand times is not taken for boilerplate, and a notice of
any number of lines that stands in many texts is. Near copies are different documents.

A hot host or line is only a group of partial counts; to find the lines to remove, the lines are joined over two exchanges, which
adaptive execution splits.

Cases: a null text has no words and fails the base rules; a null host is a host; repeated rows are judged alike and kept; an empty table
gives no rows; columns named in ``keep`` pass through whatever their names; a text of any length is read whole."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.llm.common import quoted, small_batches, stage, text_bytes, tidy

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCUMENTS = 10
MAX_SHARE_PERCENT = 1
MIN_LEFT_PERCENT = 30
SYMBOLS = tuple(bytes([c]) for c in b"#*$%&|<>")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_LINES = T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("n", T.LongType())]))


def line_hash(line: bytes) -> tuple[int, int]:
    """The first 60 bits of the normalised line's MD5, and its number of words."""
    words = line.lower().split()
    return int.from_bytes(hashlib.md5(re.sub(rb"[0-9]+", b"0", b" ".join(words))).digest()[:8], "big") >> 4, len(words)


def repeat_words(words: list[bytes]) -> int:
    """How many words stand in windows of three words that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    flags = bytearray(len(words))
    for i, w in enumerate(windows):
        if times[w] > 1:
            flags[i : i + 3] = b"\1\1\1"
    return sum(flags)


def measure(text: bytes) -> tuple[dict[str, int], list[dict[str, int]]]:
    """The counts of a whole text, and its distinct lines (hash and words over all their occurrences)."""
    words = text.split()
    raw = [x for x in text.split(b"\n") if x.strip()]
    lines: dict[int, int] = {}
    for line, times in Counter(raw).items():
        h, n = line_hash(line)
        lines[h] = lines.get(h, 0) + n * times
    in_words = b"".join(words)
    counts = {"n_words": len(words), "word_chars": len(in_words.decode("utf-8", "replace")), "n_symbols": sum(text.count(c) for c in SYMBOLS), "n_dup_lines": len(raw) - len(set(raw)), "n_repeat_words": repeat_words(words)}
    return counts, [{"h": h, "n": n} for h, n in lines.items()]


@tidy
def _measured(batches: Iterator[pa.RecordBatch], carry: bool) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())]))
    for batch in batches:
        found = [measure(t or b"") for t in text_bytes(batch.column(batch.num_columns - 1))]
        counts = [pa.array([c[name] for c, _ in found], pa.int64()) for name in COUNTS]
        end = batch.num_columns - (not carry)
        yield pa.RecordBatch.from_arrays([*batch.columns[:end], *counts, pa.array([x for _, x in found], kind)], names=[*batch.schema.names[:end], *COUNTS, "lines"])


def _assessed(df: DataFrame, text: str, host: str, keep: tuple[str, ...], carry: bool) -> DataFrame:
    """k0, k1, ... (keep), text if it is to be carried, the five counts, n_words_over, base_failed, kept, over."""
    small_batches(df.sparkSession)
    of = lambda c: F.col(quoted(c))
    source = df.select(*(of(c).alias(f"k{i}") for i, c in enumerate(keep)), of(host).cast("string").alias("host"), of(text).alias("text"))
    fields = source.schema.fields if carry else source.schema.fields[:-1]
    schema = T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("lines", _LINES)])
    base = stage(source.mapInArrow(partial(_measured, carry=carry), schema).withColumn("row", F.monotonically_increasing_id()))
    host_key = F.coalesce(F.concat(F.lit("h"), F.col("host")), F.lit("")).alias("host")
    rows = base.select("row", host_key, "lines", F.xxhash64(F.array_sort("lines.h")).alias("whole"))
    lines = rows.select("row", "host", "whole", F.explode("lines").alias("line")).select("row", "host", "whole", F.col("line.h").alias("h"), F.col("line.n").alias("n"))
    documents = rows.groupBy("host").agg(F.count("*").alias("documents"))
    distinct = lines.groupBy("host", "h", "whole").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count("*").alias("times")).where(F.col("times") > MIN_DOCUMENTS)
    over = stage(distinct.join(documents, "host").where(F.col("times") * 100 > F.col("documents") * MAX_SHARE_PERCENT).select("host", "h"))
    found = lines.select("row", "host", "h", "n").join(over, ["host", "h"]).groupBy("row").agg(F.sum("n").alias("n_over"), F.collect_set("h").alias("over"))
    joined = base.drop("lines", "host").join(found, "row", "left").withColumn("n_words_over", F.coalesce("n_over", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = (F.col("n_words") - F.col("n_words_over")) * 100 < F.col("n_words") * MIN_LEFT_PERCENT
    return joined.select(*(f"k{i}" for i in range(len(keep))), *(["text"] if carry else []), *COUNTS, "n_words_over", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "over")


def assess(df: DataFrame, text: str = "text", host: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep..., the five counts, n_words_over (long: words in lines over the limit), base_failed, kept (boolean) and over (the hashes
    of those lines; null if none)."""
    out = _assessed(df, text, host, keep, carry=False)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *COUNTS, "n_words_over", "base_failed", "kept", "over")


@tidy
def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, over in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            if over:
                gone = set(over)
                text = "\n".join(x for x in text.split("\n") if not x.strip(" \t\n\v\f\r") or line_hash(x.encode())[0] not in gone)
            out.append(text)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.string())], names=batch.schema.names[:-1])


def clean(df: DataFrame, text: str = "text", host: str = "source", n_chars: str = "n_chars") -> DataFrame:
    """df's columns, whatever their names: the documents kept, without their lines over the limit. n_chars, if there is such a column, is counted anew."""
    names = df.columns
    rest = tuple(c for c in names if c != text)
    judged = _assessed(df, text, host, rest, carry=True).where("kept")
    source = judged.select(*(f"k{i}" for i in range(len(rest))), "text", "over")
    cut = source.mapInArrow(_without, T.StructType([*source.schema.fields[:-1]]))
    own = {text: F.col("text")} | ({n_chars: F.length("text").cast("long")} if n_chars in rest else {})
    return cut.select(*((own[c] if c in own else F.col(f"k{rest.index(c)}")).alias(c) for c in names))
