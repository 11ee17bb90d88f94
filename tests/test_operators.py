"""Evaluation, jobs, analytics, layout, pictures, engines, sources and the streaming service."""

from __future__ import annotations

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspan.functions import image_kernels as kernels
from inkspan.operators import analytics, benchmark, engines, evaluation, image_quality, images, jobs, layout
from inkspan.schemas import EXTRACTION, STATUSES, TEXT_BLOCK, TRANSITIONS
from inkspan.sources.files import Objects, dataset, pictures, truths, with_truths


def extraction(no="RE-5081", day="2031-04-09", net="73.50", items=()):
    return ((no, day, None, None, None, None, None), [("x", None, None, n, None, None) for n in items], (net, None, None))


def structured(no, day, net):
    return {"header": {"invoice_no": no, "invoice_date": day}, "summary": {"total_net_worth": net}}


CASES = [
    (extraction("re - 5081", "04/09/2031"), {"json": structured("RE-5081", "2031-04-09", "$ 73.5")}, (True, True, 1, 1, 1)),
    (extraction(), {"json": structured("RE-77", "2031-04-09", "73.50")}, (True, False, 0, 1, 1)),
    (extraction(), {"json": "invalid-json-string{"}, (True, False, 0, 0, 0)),
    (extraction(), {"json": json.dumps(structured("5081", "", None))}, (True, True, 1, 1, 1)),
    (extraction(), {"json": repr(structured("5081", None, 71.0))}, (True, False, 1, 1, 0)),
    (extraction(), None, (False, True, 1, 1, 1)),
    (extraction(), {}, (False, True, 1, 1, 1)),
    (extraction(), {"json": ""}, (True, True, 1, 1, 1)),
    (extraction(), {"json": {}}, (True, True, 1, 1, 1)),
    (extraction(), {"json": [1]}, (True, False, 0, 0, 0)),
    (extraction(), {"json": "{}"}, (True, False, 0, 0, 0)),
    (extraction(), {"json": "[1, 2]"}, "transient"),
    (extraction(), {"json": {"header": {"invoice_no": "9"}}}, (True, True, 1, 1, 1)),
    (extraction(), {"json": {"header": None, "summary": "x"}}, (True, True, 1, 1, 1)),
    (extraction(), structured("RE-9", "2031-04-09", "73.5"), (True, False, 0, 1, 1)),
]


def test_evaluate(spark):
    rows = [(i, e, None if t is None else json.dumps(t)) for i, (e, t, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, f"i int, extraction {EXTRACTION.simpleString()}, ground_truth string")
    for r in evaluation.evaluate(df).collect():
        want, e = CASES[r.i][2], r.evaluation
        if want == "transient":
            assert r.evaluation_error == "transient" and e.passed is None
        else:
            assert (e.evaluated, e.passed, *e.field_accuracies) == want, r.i


def test_validate_and_sum(spark):
    rows = [extraction(), extraction(no=" "), extraction(net=None), extraction(items=("40,00", "33.50")), extraction(items=("40", "x")), extraction(items=("x",))]
    df = spark.createDataFrame([(i, e) for i, e in enumerate(rows)], f"i int, e {EXTRACTION.simpleString()}")
    got = df.select("i", evaluation.is_valid(F.col("e")).alias("v"), evaluation.items_sum_differs(F.col("e")).alias("d")).orderBy("i").collect()
    assert [r.v for r in got] == [True, False, False, True, True, True] and [r.d for r in got] == [False, False, False, False, True, False]


def test_parse_extraction(spark):
    good = json.dumps({"header": {"invoice_no": "1", "invoice_date": "d"}, "items": [{"item_desc": "x"}], "summary": {"total_net_worth": "5"}})
    texts = [good, good.replace('"d"', "null"), good[:-3], "[]", None, good.replace('"x"', "null"), '"text"']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", evaluation.parse_extraction(F.col("t")).alias("r"))
    assert [r.r.valid for r in df.orderBy("i").collect()] == [True] + [False] * 6


def test_final_output(spark):
    df = spark.createDataFrame([(extraction(),)], f"extraction {EXTRACTION.simpleString()}").withColumn("ground_truth", F.lit(None).cast("string"))
    e = evaluation.evaluate(df)
    text = e.select(evaluation.final_output(F.lit("j"), F.lit(0.5), F.col("extraction"), F.col("evaluation")).alias("t")).first().t
    assert list(json.loads(text)) == ["job_id", "ocr_confidence", "extraction", "evaluation"] and json.loads(text)["extraction"]["header"]["seller"] is None


# jobs


def test_transitions(spark):
    pairs = [(a, b) for a in (None, *STATUSES) for b in STATUSES]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", jobs.is_allowed(F.col("a"), F.col("b")).alias("ok"))
    assert {(r.a, r.b): r.ok for r in df.collect()} == {(a, b): a is None or a == b or b in TRANSITIONS[a] for a, b in pairs}
    assert jobs.transitions(spark).count() == sum(map(len, TRANSITIONS.values()))


def test_violations_and_snapshot(spark):
    rows = [("j", 1, 1.0, "queued", "p"), ("j", 2, 2.0, "done", None), ("j", 3, 3.0, "ocr_processing", None), ("k", 1, 1.0, "ocr_done", "q")]
    df = spark.createDataFrame(rows, "job_id string, seq int, at double, status string, input_file_path string")
    assert [(r.job_id, r.seq, r.previous_status) for r in jobs.violations(df).orderBy("seq").collect()] == [("j", 2, "queued"), ("j", 3, "done")]
    assert sorted(map(tuple, jobs.snapshot(df).select("job_id", "status", "input_file_path", "created_at", "updated_at").collect())) == [("j", "ocr_processing", "p", 1.0, 3.0), ("k", "ocr_done", "q", 1.0, 1.0)]


RETRIES = [
    ("ocr_processing", 1, "transient", "queued", (True, "queued", 2, "Transient failure (Retry #2): e")),
    ("ocr_processing", 3, "transient", "queued", (False, "failed", 3, "Failed: e")),
    ("ocr_processing", 0, "persistent", "queued", (False, "failed", 0, "Failed: e")),
    ("extracted", 0, "transient", "extracted", (True, "extracted", 1, "Transient failure (Retry #1): e")),
    ("ocr_done", 0, "transient", "queued", (True, "ocr_done", 0, None)),
    ("done", 0, "value", "queued", (False, "done", 0, None)),
]


def test_retry(spark):
    df = spark.createDataFrame([(i, s, n, k, b, "e") for i, (s, n, k, b, _) in enumerate(RETRIES)], "i int, status string, retry_count int, error_kind string, transient_status string, error string")
    got = jobs.retry_decision(df).orderBy("i").collect()
    assert [(r.again, r.next_status, r.next_retry, r.error_message) for r in got] == [x[-1] for x in RETRIES]


def test_page(spark):
    df = spark.range(12)
    at = lambda n: [r.id for r in analytics.page(df, n, [F.col("id")]).collect()]
    assert at(1) == [0, 1, 2, 3, 4] and at(3) == at(9) == [10, 11] and at(-2) == at(1) and analytics.page(df.limit(0), 1, [F.col("id")]).collect() == []


def test_kpi_of_nothing(spark):
    e = "struct<evaluated:boolean,passed:boolean,field_accuracies:struct<invoice_no:double,invoice_date:double,total_net_worth:double>>"
    r = analytics.kpi(spark.createDataFrame([], f"status string, confidence_score double, evaluation_data {e}")).first()
    assert (r.total, r.passed_count, r.pass_rate, r.avg_overall, r.avg_confidence, r.rating) == (0, 0, 0, 0, 0, "rose")


def test_histogram(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 9.99, 10)], "v double")
    assert {r.bin: r.cnt for r in analytics.histogram(df, "v", 5).collect()} == {1: 2, 2: 1, 5: 2}
    assert [(r.bin, r.cnt) for r in analytics.histogram(spark.createDataFrame([(3.0,), (3.0,)], "v double"), "v", 4).collect()] == [(1, 2)]


# layout


def plain_rows(boxes, ratio=0.5):
    order = sorted(range(len(boxes)), key=lambda i: boxes[i][1])
    heights = [b[3] - b[1] for b in boxes if b[3] > b[1]]
    near = ratio * (sum(heights) / len(heights) if heights else 20)
    out, y = [], 0.0
    for i in order:
        mid = (boxes[i][1] + boxes[i][3]) / 2
        if out and abs(mid - y) <= near:
            out[-1].append(i)
            y = float(np.median([(boxes[k][1] + boxes[k][3]) / 2 for k in out[-1]]))
        else:
            out.append([i])
            y = mid
    # stable by x, in the order in which the blocks came to the row
    return [sorted(r, key=lambda i: boxes[i][0]) for r in out]


def page(spark, *blocks_of):
    return spark.createDataFrame([(i, [(t, 0.9, list(b) if b is not None else None) for t, b in bs]) for i, bs in enumerate(blocks_of)], f"i int, text_blocks array<{TEXT_BLOCK.simpleString()}>")


def test_rows_like_plain(spark):
    rng = random.Random(7)
    pages = [[(f"w{k}", (rng.randint(0, 300), y := rng.randint(0, 120), rng.randint(0, 400), y + rng.randint(0, 30))) for k in range(rng.randint(1, 25))] for _ in range(40)]
    got = {r.i: [[b.text for b in row] for row in r.rows] for r in layout.with_rows(page(spark, *pages), repair=False).collect()}
    for i, p in enumerate(pages):
        assert [sorted(r) for r in got[i]] == [sorted(p[k][0] for k in row) for row in plain_rows([b for _, b in p])]


def test_waving_row(spark):
    r = layout.with_rows(page(spark, [("a", (10, 10, 50, 30)), ("b", (100, 15, 140, 35)), ("c", (200, 20, 240, 40))])).first()
    assert [[b.text for b in row] for row in r.rows] == [["a", "b", "c"]]


def test_layout_text(spark):
    two = lambda y, a, b: [(a, (0, y, 40, y + 20)), (b, (350, y, 460, y + 20))]
    first = [("Seller", (0, 0, 90, 20)), *two(40, "name", "qty"), *two(80, "Oak table", "2"), ("items", (0, 120, 50, 140)), *two(160, "a", "b"), ("end", (0, 200, 30, 220))]
    # a marker between tabular rows does not break the turn: the table begins with the marker's row
    second = [*two(0, "a", "b"), ("TOTAL", (0, 40, 50, 60)), *two(80, "c", "d")]
    got = {r.i: r.raw_text for r in layout.reconstruct(page(spark, first, second, [], [("  ", (0, 0, 1, 1))], [("only", None)])).collect()}
    assert got[0].split("\n") == ["Seller", "name    qty", "| name      | qty |", "|-----------|-----|", "| Oak table | 2   |", "", "--- ITEMS ---", "a    b", "end"]
    assert got[1].split("\n") == ["a    b", "", "--- TOTAL ---", "| TOTAL |   |", "|-------|---|", "| c     | d |"]
    assert got[2] == got[3] == "" and got[4] == "only"


def test_table_region(spark):
    blocks = [("one", (10, 100, 50, 120)), ("two", (60, 100, 110, 120)), ("three", (10, 130, 50, 150)), ("four", (60, 130, 110, 150))]
    df = page(spark, blocks).withColumn("regions", F.array(F.struct(F.array(F.lit(5), F.lit(90), F.lit(210), F.lit(160)).alias("bbox"), F.lit("table").alias("label"))))
    assert "|" in layout.reconstruct(df, regions="regions").first().raw_text and "|" not in layout.reconstruct(df).first().raw_text


def test_boxes(spark):
    df = spark.createDataFrame([([[10.0, 10.0], [100.0, 10.0], [100.9, 30.0], [10.0, 30.9]], ["a", "b"], [0.98], [[1, 2, 3, 4], [5, 6, 7, 8]])], "q array<array<double>>, t array<string>, s array<double>, x array<array<int>>")
    r = df.select(layout.box_of(F.col("q")).alias("b"), layout.blocks_of_result(F.col("t"), F.col("s"), F.col("x")).alias("z")).first()
    assert r.b == [10, 10, 100, 30] and [(b.text, b.confidence, b.bbox) for b in r.z] == [("a", 0.98, [1, 2, 3, 4])]


# pictures


def drawn(lines=True):
    image = np.full((200, 200, 3), 255, np.uint8)
    for k in range(5):
        for x in range(20, 180, 6):
            image[30 + 30 * k : 40 + 30 * k, x : x + 3] = 0
    return image


def test_png_round_trip():
    rng = np.random.default_rng(1)
    for image in (rng.integers(0, 256, (7, 5, 3)).astype(np.uint8), rng.integers(0, 256, (4, 9)).astype(np.uint8)):
        back, texts = kernels.decode_png(kernels.encode_png(image, {"k": "v é"}))
        assert (back == (image if image.ndim == 3 else image[:, :, None])).all() and texts == {"k": "v é"}
    assert kernels.decode_png(b"no") is None and kernels.decode_png(kernels.encode_png(drawn())[:60]) is None


def test_assess(spark):
    noise = np.random.default_rng(3).integers(100, 150, (200, 200, 3)).astype(np.uint8)
    rows = [(1, bytearray(kernels.encode_png(drawn()))), (2, bytearray(kernels.encode_png(noise))), (3, bytearray(b"x"))]
    got = {r.i: r for r in images.assess(spark.createDataFrame(rows, "i int, content binary")).collect()}
    assert got[1].source == "software_pdf" and got[1].strategy in ("none", "minimal") and got[1].sharpness_score > 0.5 and got[1].bg_uniformity > 0.8
    assert got[2].source == "camera_degraded" and got[2].strategy == "aggressive" and got[3].source is None


def test_preprocess_sizes(spark):
    rows = [(1, bytearray(kernels.encode_png(drawn()[:100, :100]))), (2, bytearray(b"x"))]
    got = {r.i: bytes(r.processed) for r in images.preprocess(spark.createDataFrame(rows, "i int, content binary")).collect()}
    assert max(kernels.decode_png(got[1])[0].shape) == 2000 and got[2] == b"x"
    assert kernels.normalise_size(np.zeros((10, 5000), np.uint8)).shape == (8, 4000)


def test_perspective():
    image = np.zeros((600, 600), np.uint8)
    quad = np.array([[100, 150], [480, 100], [520, 500], [80, 450]])
    y, x = np.mgrid[:600, :600]
    inside = np.ones((600, 600), bool)
    for a, b in zip(quad, np.roll(quad, -1, axis=0)):
        inside &= (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0
    image[inside] = 255
    out = kernels.straighten(image)
    assert out.shape != image.shape and out[20, 20] > 200 and out[-20, -20] > 200
    blank = np.full((400, 400), 255, np.uint8)
    assert kernels.straighten(blank) is blank


def test_skew_and_rotate():
    image = np.full((400, 600), 255, np.uint8)
    image[100:104, 50:550] = image[200:204, 50:550] = 0
    assert abs(kernels.skew(image)) <= 0.5
    turned = kernels.rotate(image, 5)
    assert 4 <= abs(kernels.skew(turned)) <= 6 and abs(kernels.skew(kernels.rotate(turned, kernels.skew(turned)))) <= 1.5


def test_pixels_like_kernels(spark):
    rng = np.random.default_rng(8)
    g = rng.integers(0, 256, (60, 70)).astype(np.uint8)
    df = spark.createDataFrame([(1, int(y), int(x), int(g[y, x])) for y in range(60) for x in range(70)], "k int, y int, x int, v int")
    r = image_quality.from_pixels(df, "k").first()
    std, mean = kernels.background(g)
    assert (r.sharpness, r.contrast, r.brightness, r.bg_std, r.bg_mean) == pytest.approx((kernels.sharpness(g), kernels.contrast(g), g.mean(), std, mean))


def test_corners(spark):
    pts = [(520.0, 500.0), (100.0, 150.0), (80.0, 450.0), (480.0, 100.0)]
    df = spark.createDataFrame([([*pts],)], "p array<struct<x:double,y:double>>").select(image_quality.order_corners(F.col("p")).alias("c"))
    r = df.select("c", image_quality.output_size(F.col("c")).alias("s")).first()
    want = kernels.order_corners(np.array(pts))
    assert [tuple(r.c[n]) for n in ("tl", "tr", "br", "bl")] == [tuple(p) for p in want] and (r.s.width, r.s.height) == (442, 401)


# engines and benchmark


def test_engines(spark):
    with pytest.raises(ValueError):
        engines.ocr_engine("tesseract")
    with pytest.raises(ValueError):
        engines.extractor("other")
    with pytest.raises(ValueError):
        engines.extractor("gemini")
    assert engines.ocr_engine("PaddleOCR") and engines.extractor("gemini", key="k") and engines.extractor("ollama")
    blocks = [{"text": "Invoice no: 7", "confidence": 0.5, "bbox": [0, 0, 9, 9]}]
    png = bytearray(kernels.encode_png(drawn(), {"blocks": json.dumps(blocks)}))
    df = spark.createDataFrame([("a.png", bytearray(b"?"), png), ("b.png", None, bytearray(b"?"))], "file_name string, processed binary, content binary")
    got = {r.file_name: r.ocr_output for r in engines.ocr_output(engines.recognise(df, "embedded"), "embedded").collect()}
    assert got["a.png"].raw_text == "Invoice no: 7" and got["a.png"].average_confidence == 0.5 and got["b.png"].average_confidence == 0.0


def test_extract_repairs_once(spark, monkeypatch):
    good = json.dumps({"header": {"invoice_no": "1", "invoice_date": "d"}, "items": [], "summary": {"total_net_worth": "5"}})

    def scripted(**_):
        def ask(system, user):
            name = user.split("File: ")[1].split("\n")[0]
            if name == "down":
                raise OSError
            return good if name == "good" or name == "second" and "Your answer was" in user else "not json"

        return ask

    monkeypatch.setitem(engines.EXTRACTORS, "scripted", scripted)
    rows = [((n, "e", "t", 0.1, []),) for n in ("good", "second", "never", "down")]
    df = spark.createDataFrame(rows, f"ocr_output struct<file_name:string,ocr_engine:string,raw_text:string,average_confidence:double,text_blocks:array<{TEXT_BLOCK.simpleString()}>>")
    got = {r.ocr_output.file_name: (r.extraction is not None, r.extraction_error) for r in engines.extract(df, "scripted").collect()}
    assert got == {"good": (True, None), "second": (True, None), "never": (False, "persistent"), "down": (False, "transient")}


def test_benchmark(spark):
    """Engines run: preprocessing makes pictures larger and slower to read, layout sets blocks side by side, and a picture without blocks has none."""
    two = [{"text": "a1", "confidence": 0.5, "bbox": [0, 0, 20, 20]}, {"text": "b", "confidence": 0.7, "bbox": [300, 0, 320, 20]}]
    png = bytearray(kernels.encode_png(drawn(), {"blocks": json.dumps(two)}))
    df = spark.createDataFrame([("p.png", png, "a1    b"), ("q.png", png, "a1    c"), ("r.png", png, None), ("s.png", bytearray(b"?"), "z")], "file_name string, content binary, truth string")
    variants = (*benchmark.DEFAULT, ("flat", False, False, ""))
    rows = benchmark.run(spark, df, variants)
    assert {(r.config, r.file_name): (r.confidence, r.cer) for r in rows.collect() if r.config != "flat"} == {(c, n): v for c in ("baseline_with_preprocess", "raw_no_preprocess") for n, v in (("p.png", (0.6, 0)), ("q.png", (0.6, 1 / 7)), ("r.png", (0.6, -1)), ("s.png", (0, 1)))}
    got = {r.config: r for r in benchmark.summarise(rows).collect()}
    assert got["baseline_with_preprocess"].n == 4 and got["flat"].avg_cer == pytest.approx((4 / 7 + 5 / 7 + 1) / 3)
    assert got["baseline_with_preprocess"].avg_latency > got["raw_no_preprocess"].avg_latency > 0
    none = benchmark.summarise(benchmark.run(spark, df.where("truth is null"))).first()
    assert (none.avg_cer, none.avg_wer) == (-1, -1)


# sources and the service


def test_sources(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.png").write_bytes(kernels.encode_png(drawn()))
    (tmp_path / "p/b.jpeg").write_bytes(b"x")
    (tmp_path / "p/a.txt").write_text("line\nmore", encoding="utf-8")
    got = {r.file_name: r.truth for r in with_truths(pictures(spark, f"{tmp_path}/p"), truths(spark, f"{tmp_path}/p")).collect()}
    assert got == {"a.png": "line\nmore", "b.jpeg": ""}
    spark.createDataFrame([(b"i", "7", '{"a": 1}'), (b"j", None, "{bad"), (b"k", None, None)], "image binary, id string, parsed_data string").coalesce(1).write.parquet(f"{tmp_path}/d/test")
    rows = sorted(map(tuple, dataset(spark, f"{tmp_path}/d").select("id", "ground_truth").collect()))
    assert rows == [("7", '{"a": 1}'), ("hf_1", '{"raw":"{bad"}'), ("hf_2", "{}")] and dataset(spark, f"{tmp_path}/d", limit=2).count() == 2
    with pytest.raises(ValueError):
        dataset(spark, f"{tmp_path}/d", limit=0)
    spark.range(50, numPartitions=5).selectExpr("cast(cast(id as string) as binary) as image").write.parquet(f"{tmp_path}/m/test")  # files of several tasks
    many = dataset(spark, f"{tmp_path}/m").select("id", "image").collect()
    assert sorted(r.id for r in many) == sorted(f"hf_{k}" for k in range(50))
    store = Objects(spark, f"{tmp_path}/o")
    store.put("b", "t/j/x.json", b"{}")
    assert store.exists("b", "t/j/x.json") and store.get("b", "t/j/x.json") == b"{}" and store.listing("b").first().path == "b/t/j/x.json"
    for root, bucket in (("b/o/b", "b"), ("a.b+c", "x.y+z"), ("t$1", "(b"), ("w s", "o")):  # a root that holds the bucket's name, and names that mean something in patterns
        other = Objects(spark, f"{tmp_path}/{root}")
        other.put(bucket, "b/k.json", b"12")
        assert [(r.path, r.length, bytes(r.content)) for r in other.listing(bucket).collect()] == [(f"{bucket}/b/k.json", 2, b"12")]
    store.delete("b", "t/j/x.json")
    store.delete("b", "t/j/x.json")
    with pytest.raises(FileNotFoundError):
        store.get("b", "t/j/x.json")


def test_service(spark, tmp_path):
    from inkspan.streaming.workers import Service

    blocks = [{"text": t, "confidence": 0.8, "bbox": [10, 30 * k, 200, 30 * k + 20]} for k, t in enumerate(["Invoice no: RE-5081", "Date of issue: 2031-04-09", "Total net worth: 73,50"])]
    png = bytearray(kernels.encode_png(drawn(), {"blocks": json.dumps(blocks)}))
    truth = json.dumps({"json": structured("5081", "09/04/2031", "$ 73.5")})
    uploads = spark.createDataFrame([("a.png", png, truth), ("b.txt", bytearray(b"x"), None), ("c.png", bytearray(), None), ("d.png", bytearray(b"?"), None)], "filename string, content binary, ground_truth string")
    service = Service(spark, str(tmp_path))
    assert sorted(r.filename for r in service.submit(uploads, "t1", "1").collect()) == ["b.txt", "c.png"]
    assert service.requeue("1") == 2
    service.drain()
    got = {r.status: r for r in service.jobs().collect()}
    assert set(got) == {"done", "failed"} and got["done"].evaluation_data.passed and got["failed"].error_message.startswith("Failed:")
    assert service.outputs().select("job_id").distinct().count() == 1
    before = service.events().count()
    service.drain()  # nothing new: nothing happens
    assert service.events().count() == before
    job = got["done"].job_id
    own = {r.path.rpartition("/")[2] for r in service.objects.listing("invoices").collect() if f"/{job}/" in r.path}
    assert own == {"input.png", "final_output.json"}  # what was in between has gone with the job's end
    assert json.loads(service.outputs().first().final_output)["job_id"] == job and not list((tmp_path / "intermediate").iterdir())


def test_service_begins_again(spark, tmp_path, monkeypatch):
    """The running service: a worker that fails is started again, silent jobs are reaped, and stop ends all."""
    import threading

    from inkspan.streaming import workers

    blocks = [{"text": t, "confidence": 0.8, "bbox": [10, 30 * k, 200, 30 * k + 20]} for k, t in enumerate(["Invoice no: R7", "Date of issue: 2031-04-09", "Total net worth: 5,00"])]
    png = bytearray(kernels.encode_png(drawn(), {"blocks": json.dumps(blocks)}))
    service = workers.Service(spark, str(tmp_path), workers.Settings(preprocess=False))
    service.submit(spark.createDataFrame([("a.png", png, None)], "filename string, content binary, ground_truth string"), "t", "1")
    once, calls = service._process, []

    def fails_first(batch, number):
        calls.append(number)
        if len(calls) == 1:
            raise RuntimeError("lost")
        once(batch, number)

    monkeypatch.setattr(service, "_process", fails_first)
    stop = threading.Event()
    worker = threading.Thread(target=service.run, args=(stop, 1000))
    worker.start()
    until = time.time() + 60
    while time.time() < until and service.jobs().first().status != "done":
        time.sleep(0.5)
    stop.set()
    worker.join()
    assert service.jobs().first().status == "done" and len(calls) >= 2 and calls[0] == calls[1]


def test_reap(spark, tmp_path):
    from inkspan.schemas import JOB_EVENT
    from inkspan.streaming.workers import Service
    from inkspan.streaming.topics import INTAKE
    from inkspan.schemas import INGESTED

    service = Service(spark, str(tmp_path))
    old = F.current_timestamp() - F.expr("interval 10 minutes")
    rows = [("a", "ocr_processing", 0), ("b", "extracting", 3), ("c", "queued", 0), ("d", "done", 0)]
    made = spark.createDataFrame(rows, "job_id string, status string, retry_count int")
    given = {"job_id": F.col("job_id"), "seq": F.lit(1), "at": old, "status": F.col("status"), "retry_count": F.col("retry_count"), "tenant_id": F.lit("t"), "input_file_path": F.lit("b/k")}
    service._log(made.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in JOB_EVENT.fields)), "1")
    assert service.reap("1") == 2 and service.reap("2") == 0
    assert [(r.job_id, r.retry_count) for r in service.topics.read(INTAKE, INGESTED).collect()] == [("a", 1)]
    assert {r.job_id: (r.status, r.retry_count) for r in service.jobs().collect()} == {"a": ("ocr_processing", 1), "b": ("failed", 3), "c": ("queued", 0), "d": ("done", 0)}


def test_dataset_inline_or_behind(spark, tmp_path):
    from inkspan.streaming.workers import Service

    spark.range(8).selectExpr("cast(cast(id as string) as binary) as image", "concat('d', id) as id").coalesce(1).write.parquet(f"{tmp_path}/d/test")
    service = Service(spark, f"{tmp_path}/s")
    assert service.submit_dataset(f"{tmp_path}/d", "t", "few", limit=2) == 2 and service.jobs().count() == 2
    assert service.submit_dataset(f"{tmp_path}/d", "t", "many", limit=6) == 0
    service.wait()
    assert service.jobs().count() == 6


def test_tenants_and_status(spark):
    assert jobs.tenant_of(jobs.seed_tenants(spark)).endswith("1")
    with pytest.raises(LookupError):
        jobs.tenant_of(jobs.seed_tenants(spark), "nobody")
    row = spark.createDataFrame([("j", "done")], "job_id string, status string").withColumns({c: F.lit(None).cast("string") for c in jobs.STATUS if c not in ("job_id", "status")})
    assert list(jobs.status_of(row, "j")) == list(jobs.STATUS) and jobs.status_of(row, "k") is None


def test_regions_by_model(spark):
    with pytest.raises(ValueError):
        engines.layout_model("other")
    region = {"bbox": [0, 90, 300, 160], "label": "table", "confidence": 0.9}
    png = bytearray(kernels.encode_png(drawn(), {"regions": json.dumps([region])}))
    df = spark.createDataFrame([(1, png), (2, bytearray(b"?")), (3, None)], "i int, processed binary")
    got = {r.i: [x.asDict() for x in r.layout_regions] for r in engines.find_regions(df, "Embedded").collect()}
    assert got == {1: [region], 2: [], 3: []}


def test_older_results(spark):
    lines = '[[[[[10.9, 5], [90, 5], [90, 30], [10, 30]], ["Total 7", 0.98]], [[[0, 0], [1, 0], [1, 1], [0, 1]], ["x", 1]]], [[[[9, 9], [9, 9], [9, 9], [9, 9]], ["other page", 0.1]]]]'
    df = spark.createDataFrame([(lines,), ("[]",), ("[null]",), ("no",), (None,)], "raw string").select(layout.blocks_of_lines(F.col("raw")).alias("b"))
    got = [[tuple(x) for x in r.b] for r in df.collect()]
    assert got == [[("Total 7", 0.98, [10, 5, 90, 30]), ("x", 1.0, [0, 0, 1, 1])], [], [], [], []]


def test_transition_stream(spark, tmp_path):
    from inkspan.streaming.state import check_transitions

    rows = [("j", 1, "queued"), ("j", 2, "done"), ("j", 3, "ocr_processing"), ("k", 1, "failed"), ("k", 2, "queued")]
    spark.createDataFrame(rows, "job_id string, seq long, status string").write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("job_id string, seq long, status string").parquet(f"{tmp_path}/e")
    query = check_transitions(stream).writeStream.format("memory").queryName("checked").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.job_id, r.seq, r.previous_status, r.allowed) for r in spark.table("checked").collect())
    assert got == [("j", 1, None, True), ("j", 2, "queued", False), ("j", 3, "queued", True), ("k", 1, None, True), ("k", 2, "failed", False)]


def test_delivery_stream(spark, tmp_path):
    from inkspan.streaming.state import track_deliveries

    rows = [("a", "delivery"), ("a", "delivery"), ("b", "delivery"), ("c", "delivery"), ("c", "delivery"), ("c", "delivery"), ("c", "delivery")]
    spark.createDataFrame(rows, "message_id string, kind string").coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("message_id string, kind string").parquet(f"{tmp_path}/e")
    # a query with timers never runs out of batches
    query = track_deliveries(stream).writeStream.format("memory").queryName("delivered").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        until = time.time() + 40
        while spark.table("delivered").count() < 3 and time.time() < until:
            time.sleep(0.5)
        got = sorted(map(tuple, spark.table("delivered").collect()))
    finally:
        query.stop()
    assert got[:3] == [("a", 1, "delivered"), ("b", 0, "delivered"), ("c", 3, "failed")]


def test_entry_and_oracles():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
