"""Engines by name: OCR from bytes to blocks, extraction from text to JSON. The offline ones need no model; the others need their library or service."""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from inkspan.functions import image_kernels, prompts
from inkspan.operators.evaluation import parse_extraction
from inkspan.operators.layout import flat_text, mean_confidence, reconstruct
from inkspan.schemas import REGION, TEXT_BLOCK

Blocks = list[dict]


def embedded_blocks(data: bytes | None) -> Blocks:
    """Offline OCR: the blocks that a PNG carries as JSON in its text chunk named blocks."""
    found = image_kernels.decode_png(data or b"")
    return json.loads(found[1].get("blocks", "[]")) if found else []


def _paddle() -> Callable[[bytes | None], Blocks]:
    try:
        from paddleocr import PaddleOCR
    except ImportError as e:
        raise RuntimeError("paddleocr is not installed") from e
    engine = PaddleOCR()

    def run(data: bytes | None) -> Blocks:
        image = image_kernels.decode_png(data or b"")
        pages = engine.predict(image[0]) if image else []
        page = pages[0] if pages else {}
        return [{"text": t, "confidence": float(s), "bbox": [int(x) for x in b]} for t, s, b in zip(page.get("rec_texts", []), page.get("rec_scores", []), page.get("rec_boxes", []), strict=False)]

    return run


#: A name's value makes the engine, once in each Python worker that needs it.
OCR: dict[str, Callable[[], Callable[[bytes | None], Blocks]]] = {"embedded": lambda: embedded_blocks, "paddleocr": _paddle}


def ocr_engine(name: str) -> Callable[[], Callable[[bytes | None], Blocks]]:
    if name.lower() not in OCR:
        raise ValueError(f"unknown OCR engine: {name}")
    return OCR[name.lower()]


def embedded_regions(data: bytes | None) -> Blocks:
    """Offline layout model: the regions that a PNG carries as JSON in its text chunk named regions."""
    found = image_kernels.decode_png(data or b"")
    return json.loads(found[1].get("regions", "[]")) if found else []


def _doclayout() -> Callable[[bytes | None], Blocks]:
    try:
        from doclayout_yolo import YOLOv10
    except ImportError as e:
        raise RuntimeError("doclayout_yolo is not installed") from e
    model = YOLOv10("doclayout_yolo_docstructbench_imgsz1024.pt")

    def run(data: bytes | None) -> Blocks:
        image = image_kernels.decode_png(data or b"")
        found = model.predict(image[0], imgsz=1024)[0] if image else None
        return [{"bbox": [int(v) for v in b.xyxy[0]], "label": found.names[int(b.cls)], "confidence": float(b.conf)} for b in found.boxes] if found else []

    return run


#: As for OCR: models that find regions of a page.
LAYOUTS: dict[str, Callable[[], Callable[[bytes | None], Blocks]]] = {"embedded": lambda: embedded_regions, "doclayout": _doclayout}


def layout_model(name: str) -> Callable[[], Callable[[bytes | None], Blocks]]:
    if name.lower() not in LAYOUTS:
        raise ValueError(f"unknown layout model: {name}")
    return LAYOUTS[name.lower()]


def find_regions(df: DataFrame, name: str, content: str = "processed") -> DataFrame:
    """Adds layout_regions; none where the picture has none or cannot be read."""
    make = layout_model(name)

    @pandas_udf(T.ArrayType(REGION))
    def regions(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = make()
        for data in batches:
            yield pd.Series([[] if x is None else run(x) for x in data])

    return df.withColumn("layout_regions", F.coalesce(regions(F.col(content)), F.array().cast(T.ArrayType(REGION))))


def recognise(df: DataFrame, engine: str, content: str = "processed", fallback: str | None = "content") -> DataFrame:
    """Adds text_blocks. Pictures without any are read again as they came, from the fallback column, in a pass over those alone."""
    make = ocr_engine(engine)

    @pandas_udf(T.ArrayType(TEXT_BLOCK))
    def blocks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = make()
        for data in batches:
            yield pd.Series([None if x is None else run(x) for x in data])

    read = df.withColumn("text_blocks", F.coalesce(blocks(F.col(content)), F.array().cast(T.ArrayType(TEXT_BLOCK))))
    if fallback:
        again = blocks(F.when(F.size("text_blocks") == 0, F.col(fallback)))
        read = read.withColumn("_again", again).withColumn("text_blocks", F.when(F.size("text_blocks") == 0, F.coalesce("_again", "text_blocks")).otherwise(F.col("text_blocks"))).drop("_again")
    return read


def ocr_output(df: DataFrame, engine: str, layout: bool = True, regions: str | None = None) -> DataFrame:
    """Adds ocr_output (file_name, ocr_engine, raw_text, average_confidence, text_blocks) to rows with file_name and text_blocks."""
    text = reconstruct(df, regions=regions) if layout else df.withColumn("raw_text", flat_text(F.col("text_blocks")))
    record = F.struct("file_name", F.lit(engine).alias("ocr_engine"), "raw_text", mean_confidence(F.col("text_blocks")).alias("average_confidence"), "text_blocks")
    return text.withColumn("ocr_output", record).drop("raw_text")


#: Labels before a value in an invoice's text, tried by the offline extractor.
LABELS = {
    "invoice_no": r"invoice\s*(?:no|number|#)\.?\s*[:#]?\s*([A-Za-z0-9][A-Za-z0-9/-]*)",
    "invoice_date": r"(?:invoice\s+)?date(?:\s+of\s+issue)?\s*[:]?\s*([0-9A-Za-z][0-9A-Za-z ,./-]*[0-9])",
    "seller": r"seller\s*[:]\s*(\S[^\n|]*?)\s*(?:\||\n|$)",
    "client": r"client\s*[:]\s*(\S[^\n|]*?)\s*(?:\||\n|$)",
    "iban": r"iban\s*[:]?\s*([A-Z]{2}[0-9]{2}[A-Z0-9]{10,30})",
    "total_net_worth": r"total(?:\s+net(?:\s+worth)?)?\s*[:|]?[\s|]*((?:\$|€|each)?\s*[0-9][0-9 .,]*[0-9])",
}


def read_labels(text: str) -> str:
    """Offline extraction: values behind known labels, as JSON of the schema; a mandatory one that is missing is an empty text."""
    found = {k: (m[1].strip() if (m := re.search(p, text or "", re.I)) else None) for k, p in LABELS.items()}
    header = {k: found.get(k) for k in ("invoice_no", "invoice_date", "seller", "client", "iban")} | {"seller_tax_id": None, "client_tax_id": None}
    header = {k: "" if v is None and k in ("invoice_no", "invoice_date") else v for k, v in header.items()}
    return json.dumps({"header": header, "items": [], "summary": {"total_net_worth": found["total_net_worth"] or "", "total_vat": None, "total_gross_worth": None}})


def _post(url: str, body: dict, headers: dict[str, str]) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=300) as answer:
        return json.load(answer)


def _ollama(url: str = "http://localhost:11434", model: str = "qwen2.5:7b", **_) -> Callable[[str, str], str]:
    options = {"temperature": 0, "num_ctx": 4096, "num_predict": 2048}

    def ask(system: str, user: str) -> str:
        turns = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        return _post(f"{url}/api/chat", {"model": model, "messages": turns, "format": "json", "stream": False, "options": options}, {})["message"]["content"]

    return ask


def _gemini(key: str = "", model: str = "gemini-2.5-flash", url: str = "https://generativelanguage.googleapis.com", **_) -> Callable[[str, str], str]:
    if not key:
        raise ValueError("gemini needs a key")

    def ask(system: str, user: str) -> str:
        body = {"systemInstruction": {"parts": [{"text": system}]}, "contents": [{"parts": [{"text": user}]}], "generationConfig": {"temperature": 0, "responseMimeType": "application/json"}}
        return _post(f"{url}/v1beta/models/{model}:generateContent", body, {"x-goog-api-key": key})["candidates"][0]["content"]["parts"][0]["text"]

    return ask


def _offline(**_) -> Callable[[str, str], str]:
    return lambda system, user: read_labels(user.partition(prompts.TEXT_MARK)[2])


def _recorded(answers: dict[str, list[str | None]] | None = None, **_) -> Callable[[str, str], str]:
    """Answers kept from an earlier run, by file name: the first to the request, the second to its repair; None stands for a service that was not reached."""

    def ask(system: str, user: str) -> str:
        name = user.partition("File: ")[2].partition("\n")[0]
        said = (answers or {})[name][1 if AGAIN in user else 0]
        if said is None:
            raise OSError("not reached")
        return said

    return ask


EXTRACTORS: dict[str, Callable[..., Callable[[str, str], str]]] = {"labels": _offline, "recorded": _recorded, "ollama": _ollama, "gemini": _gemini}


def maker(name: str) -> Callable[..., Callable[[str, str], str]]:
    if name not in EXTRACTORS:
        raise ValueError(f"unknown extractor: {name}")
    return EXTRACTORS[name]


def extractor(name: str, **settings) -> Callable[[str, str], str]:
    return maker(name)(**settings)


#: What stands between a request and the answer that is to be repaired.
AGAIN = "\n\nYour answer was:"


def _answer(ask: Callable[[str, str], str], user: str, said: str | None = None, why: str | None = None) -> tuple[str | None, str | None]:
    """(answer, kind of error)."""
    request = user if said is None else f"{user}{AGAIN}\n{said}\n\nIt is not valid: {why}. Answer again with the corrected JSON only."
    try:
        return ask(prompts.SYSTEM, request), None
    except (OSError, TimeoutError):
        return None, "transient"
    except (KeyError, ValueError, TypeError, IndexError):
        return None, "persistent"


def extract(df: DataFrame, name: str = "labels", ocr: str = "ocr_output", **settings) -> DataFrame:
    """Adds extraction (null if none is valid) and extraction_error (transient: the service was not reached; persistent: no valid answer after one repair; else
    null). Only rows whose first answer is not valid are asked again."""
    make = maker(name)  # looked up here, so that one registered on the driver is known in the workers
    make(**settings)  # an unknown name or a missing key shows now
    pair = T.StructType([T.StructField("said", T.StringType()), T.StructField("error", T.StringType())])

    @pandas_udf(pair)
    def first(users: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ask = make(**settings)
        for batch in users:
            yield pd.DataFrame([_answer(ask, u) for u in batch], columns=["said", "error"])

    @pandas_udf(pair)
    def second(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        ask = make(**settings)
        for users, said in batches:
            rows = [(None, None) if u is None else _answer(ask, u, s, "it does not follow the schema") for u, s in zip(users, said, strict=True)]
            yield pd.DataFrame([(a, "persistent" if e else None) for a, e in rows], columns=["said", "error"])

    def judged(c: Column) -> Column:
        return parse_extraction(c)

    text = prompts.user_prompt(F.col(f"{ocr}.file_name"), F.col(f"{ocr}.ocr_engine"), F.col(f"{ocr}.raw_text"))
    one = df.withColumn("_user", text).withColumn("_one", first("_user")).withColumn("_read", judged(F.col("_one.said")))
    unclear = F.col("_one.error").isNull() & ~F.col("_read.valid")
    two = one.withColumn("_two", second(F.when(unclear, F.col("_user")), F.col("_one.said"))).withColumn("_again", judged(F.col("_two.said")))
    value = F.when(F.col("_read.valid"), F.col("_read.value")).when(unclear & F.col("_again.valid"), F.col("_again.value"))
    error = F.when(F.col("_read.valid"), None).when(F.col("_one.error").isNotNull(), F.col("_one.error")).when(F.col("_again.valid"), None).otherwise("persistent")
    return two.withColumn("extraction", value).withColumn("extraction_error", error).drop("_user", "_one", "_read", "_two", "_again")
