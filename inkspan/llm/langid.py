"""Language ID (operator 4) by hierarchical discrimination: the language family first, then one-versus-one linear support vector
machines between the languages of that family.

A text's features are its hashed letter n-grams of one to three characters (lower case, everything else a blank), square roots of their
counts, of unit length. Families come from a fixed table; a language that is not in it is a family of its own. The family machines are one
against the rest. All machines are trained on the driver from a bounded sample: of each language the SAMPLE documents with the smallest hashes of
their id, as vectors of DIMENSIONS numbers; texts go in whole. The LANGUAGES labels with most documents are learned, so that dirty labels do not
grow the model. Prediction needs the text alone.

Cases: a null text, or one without a letter, is ``und`` with score 0; so is everything when nothing can be learned; documents without an id are learned from like
others; repeated rows are predicted alike and kept; an empty table gives no rows; columns named in ``keep`` pass through; a text of any length is read whole, in
pieces."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.llm.common import small_batches, tidy

DIMENSIONS = 4096
SAMPLE = 600
LANGUAGES = 200
PIECE = 1_000_000
UNKNOWN = "und"
#: Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
}


def family(language: str) -> str:
    return next((name for name, codes in FAMILIES.items() if language in codes.split()), language)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Of each code point: its lower-case letter, or a blank."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            table[c] = ord(x.lower()[0])
    return table


def features(text: str) -> np.ndarray | None:
    """Unit vector of a whole text; None if it has no letter."""
    total = np.zeros(DIMENSIONS, np.int64)
    some = False
    for at in range(0, len(text), PIECE):
        raw = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), "<u4")
        own = _letters()[raw]
        own = np.concatenate([np.array([32], np.uint32), own[(own != 32) | (np.roll(own, 1) != 32)], np.array([32], np.uint32)])
        some = some or bool((own != 32).any())
        pair = own[:-1] * np.uint32(0x9E3779B1) + own[1:]
        for k, h in enumerate((own, pair, pair[:-1] * np.uint32(0x85EBCA77) + own[2:])):
            mixed = (h ^ h >> np.uint32(15)) * np.uint32(0xC2B2AE3D) + np.uint32(k)
            total += np.bincount(mixed >> np.uint32(20), minlength=DIMENSIONS)
    if not some:
        return None
    root = np.sqrt(total, dtype=np.float32)
    return root / np.linalg.norm(root)


def svm(x: np.ndarray, y: np.ndarray, strength: float = 1e-4, steps: int = 300) -> np.ndarray:
    """A linear machine with squared hinge loss by accelerated gradient descent, classes weighed equally; y is 1 or -1. The last weight is
    the offset."""
    x = np.hstack([x, np.full((len(x), 1), 0.1, np.float32)])
    # all in single precision: one double among them has the whole matrix converted at every step
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    y = y.astype(np.float32)
    w = look = np.zeros(x.shape[1], np.float32)
    rate = float(1 / (2 * 1.01 + strength))
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ look))
        step = look - rate * (strength * look - 2 * (x.T @ (weight * y * slack)))
        look = step + k / (k + 3) * (step - w)
        w = step
    return w


def _apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + 0.1 * w[-1]


class Hierarchy:
    """The family machines and, by family, those between its languages."""

    def __init__(self, x: np.ndarray, languages: list[str]):
        lang = np.array(languages)
        self.families: dict[str, list[str]] = {}
        for name in sorted(set(languages)):
            self.families.setdefault(family(name), []).append(name)
        kin = np.array([family(name) for name in languages])
        names = sorted(self.families)
        self.first = [(names[0], names[1], svm(x, np.where(kin == names[0], 1, -1)))] if len(names) == 2 else [(n, None, svm(x, np.where(kin == n, 1, -1))) for n in names if len(names) > 1]
        self.pairs = {}
        for name, own in self.families.items():
            for a, b in combinations(own, 2):
                rows = (lang == a) | (lang == b)
                self.pairs[a, b] = svm(x[rows], np.where(lang[rows] == a, 1, -1))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        squash = lambda m: 1 / (1 + np.exp(-4 * m))
        names = sorted(self.families)
        if not self.first:
            best, sure = np.zeros(len(x), int), np.ones(len(x))
        elif len(self.first) == 1:
            m = _apply(self.first[0][2], x)
            best, sure = (m <= 0).astype(int), squash(np.abs(m))
        else:
            m = np.stack([_apply(w, x) for _, _, w in self.first])
            best, sure = m.argmax(axis=0), squash(m.max(axis=0))
        out = np.empty(len(x), object)
        for k, name in enumerate(names):
            rows, own = np.flatnonzero(best == k), self.families[name]
            if not len(rows):
                continue
            votes, margins, least = np.zeros((len(own), len(rows))), np.zeros((len(own), len(rows))), np.full((len(own), len(rows)), np.inf)
            for i, j in combinations(range(len(own)), 2):
                m = _apply(self.pairs[own[i], own[j]], x[rows])
                for at, sign in ((i, 1), (j, -1)):
                    votes[at] += sign * m > 0
                    margins[at] += sign * m
                    least[at] = np.minimum(least[at], sign * m)
            winner = (votes + 1e-3 * np.tanh(margins)).argmax(axis=0)
            out[rows] = np.array(own, object)[winner]
            if len(own) > 1:
                sure[rows] *= squash(least[winner, np.arange(len(rows))])
        return list(out), np.clip(sure, 0, 1)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [(lang, v.astype("<f2").tobytes()) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (v := features(text or "")) is not None]
        yield pa.RecordBatch.from_pydict({"lang": pa.array([x for x, _ in own], pa.string()), "v": pa.array([v for _, v in own], pa.binary())})


def chosen_rows(known: DataFrame, sample: int, languages: int) -> DataFrame:
    """known(id, text, lang): of each of the languages with most rows, the sample rows with the smallest hashes of their ids. The cut is found
    without the texts; ties at it, as of many rows without an id, are ranked too, in each task first."""
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    hashed = known.where(F.col("lang").isin(*counts)).withColumn("hash", F.xxhash64("id"))
    first = Window.partitionBy("lang").orderBy("hash")

    def cut(bounds: dict[str, int]) -> dict[str, tuple[int, int]]:
        """Of each language, among the hashes up to its bound: the last of the sample's, and how many the sample has."""
        low = hashed.select("lang", "hash").where(F.col("hash") <= F.coalesce(*(F.when(F.col("lang") == x, n) for x, n in bounds.items())))
        ranked = low.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample)
        return {r["lang"]: (r["cut"], r["n"]) for r in ranked.groupBy("lang").agg(F.max("hash").alias("cut"), F.count("*").alias("n")).collect()}

    # hashes are even, so twice the sample's share of them is enough to rank, and one task never ranks what every task has; where ids repeat it may not be
    whole = (1 << 63) - 1
    found = cut({x: min(whole, -(1 << 63) + (1 << 65) * sample // n) for x, n in counts.items()}) if counts else {}
    if short := {x: whole for x, n in counts.items() if found.get(x, (0, 0))[1] < min(sample, n)}:
        found |= cut(short)
    cuts = [{"lang": x, "cut": c} for x, (c, _) in found.items()]
    if not cuts:
        return known.limit(0)
    below = F.coalesce(*(F.when(F.col("lang") == r["lang"], r["cut"]) for r in cuts))
    tied = Window.partitionBy("lang").orderBy("hash", F.xxhash64("text"))
    return hashed.where(F.col("hash") <= below).withColumn("rank", F.row_number().over(tied)).where(F.col("rank") <= sample)


def train(df: DataFrame, fold: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, languages: int = LANGUAGES) -> Hierarchy | None:
    """Learns from the rows where fold is true and the language is known; None if there are none."""
    known = df.where(fold & F.col(lang).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    chosen = chosen_rows(known, sample, languages).select("lang", "text").mapInArrow(_vectors, "lang string, v binary").toArrow()
    if not chosen.num_rows:
        return None
    x = np.stack([np.frombuffer(v, "<f2") for v in chosen.column("v").to_pylist()]).astype(np.float32)
    languages = chosen.column("lang").to_pylist()
    order = np.lexsort([x[:, 0], x[:, 1], x[:, 2], np.array(languages)])
    return Hierarchy(x[order], [languages[i] for i in order])


@tidy
def _predict(batches: Iterator[pa.RecordBatch], model: Hierarchy | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
        column = batch.column(batch.num_columns - 1)
        for k in range(0, batch.num_rows, 512):
            own = [(k + i, v) for i, t in enumerate(column.slice(k, 512)) if model and (v := features(t.as_py() or "")) is not None]
            if own:
                found, sure = model.predict(np.stack([v for _, v in own]))
                for (i, _), name, s in zip(own, found, sure, strict=True):
                    langs[i], scores[i] = name, s
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores)], names=[*batch.schema.names[:-1], "lang_pred", "score"])


def predict(df: DataFrame, model: Hierarchy | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep..., lang_pred (string), score (double, 0 to 1)."""
    small_batches(df.sparkSession)
    source = df.select(*(df[c].alias(f"k{i}") for i, c in enumerate(keep)), df[text].alias("text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    out = source.mapInArrow(partial(_predict, model=model), schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score")
