"""Queries of the catalogue over whole texts, against plain versions."""

from __future__ import annotations

import hashlib

import pytest

from inkspan.operators import layout
from inkspan.plans import catalogue
from tests.test_functions import edits

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "all of the stones on the hill " * 40


def misread(text):
    return text.replace("the ", "teh ").replace("on", "0n").replace("ll", "l")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    rows = [(1, "x " * 100 + LONG, "en"), (2, "short on", "en"), (3, "", "en"), (4, "señor, all on the 漢字 😀 hill " * 30, "es"), (6, "lang is not known on the hill", None)]
    spark.createDataFrame([(*r, "a", 0) for r in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path, {i: t for i, t, _ in rows}


def rate(p, t):
    return edits(p, t) / len(t) if len(t) else float(len(p) > 0)


def test_error_rates_of_whole_texts(spark, docs):
    path, texts = docs
    assert {r.doc_id: r.cer for r in catalogue.cer(spark, path).collect()} == pytest.approx({i: rate(misread(t), t) for i, t in texts.items()}, abs=1e-8)
    assert {r.doc_id: r.wer for r in catalogue.wer(spark, path).collect()} == pytest.approx({i: rate(misread(t).split(), t.split()) for i, t in texts.items()}, abs=1e-8)


def test_layout_of_whole_texts(spark, tmp_path):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(103)]
    spark.createDataFrame([(1, " ".join(words), "en", "a", 0), (2, "one two", "en", "a", 0)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: (r.n_rows, r.sizes) for r in catalogue.row_cluster(spark, str(tmp_path)).collect()}
    assert rows == {1: (13, ",".join(["8"] * 12 + ["7"])), 2: (1, "2")}
    text = {r.doc_id: r.raw_text for r in layout.reconstruct(catalogue.pages(spark, str(tmp_path))).collect()}[1]
    assert {r.doc_id: (r.n_chars, r.digest) for r in catalogue.layout_text(spark, str(tmp_path)).collect()}[1] == (len(text), hashlib.md5(text.encode()).hexdigest())
    assert [w for w in text.split() if w.startswith("w")][8:] == words  # the first row stands as text before the table too
    flat = {r.doc_id: r.digest for r in catalogue.flat_text(spark, str(tmp_path)).collect()}
    assert flat[1] == hashlib.md5("\n".join(words).encode()).hexdigest()
