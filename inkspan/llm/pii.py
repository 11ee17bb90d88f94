"""PII (operator 10), in built-in column functions only: regular expressions propose spans, checksums confirm them, and words nearby
adjust the score.

Each kind has a pattern, a check that drops a proposal, a score, and context words that add to the score when they stand within
CONTEXT characters. The four base kinds (email, ip, card, phone) stay whenever their check holds; a span of the further kinds
stays from score KEEP on. A span's place comes from the pieces that the same pattern splits the text into: the lengths of pieces
and matches, added up in turn. Patterns are possessive, and a run is entered only at its first character or where the last match
ended, so long runs cost linear time; texts that lack a kind's telling character skip it. Long texts with many spans cost little more
than their length: stretches of text are read from its pieces of PIECE characters, a column of its own, since a substring of the whole
text walks there from its start; arrays grow within blocks of the square root of their length, since an appended element copies them.

Cases: a null or empty text has no spans; repeated rows are judged alike and kept; an empty table gives no rows; extra columns pass
through, whatever their names (but base and spans are replaced by ``find``); a text of any length is searched whole. Offsets are code points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import quoted

CONTEXT = 50
PIECE = 4000
KEEP = 0.5
SPAN = "struct<kind:string,start:bigint,end:bigint,score:double>"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A text without a match of this has none of the pattern.
    hint: str
    check: str
    score: float
    context: str = ""
    bonus: float = 0.4


def in_pieces(text: Column) -> Column:
    """The text in pieces of PIECE code points, the last one shorter."""
    several = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.length(text) > PIECE, several).otherwise(F.array(text))


def stretch(pieces: Column, start: Column, end: Column) -> Column:
    """The code points from start up to end (exclusive; may lie beyond the text's end) of a text in pieces."""
    first = F.floor(start / PIECE)
    some = F.slice(pieces, (first + 1).cast("int"), (F.floor(end / PIECE) - first + 1).cast("int"))
    return F.substring(F.array_join(some, ""), (start - first * PIECE + 1).cast("int"), (end - start).cast("int"))


def in_blocks(values: Column) -> Column:
    """The array cut into blocks of the square root of its size."""

    def cut(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda k: F.slice(v, k * width + 1, width))
        return F.when(F.size(v) > 0, blocks).otherwise(F.slice(F.array(v), 1, 0))

    return F.transform(F.array(values), cut)[0]  # bound once: written out, the search would run for every mention of it


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Of a string of digits, not empty."""
    n = F.length(digits)
    places = F.sequence(F.lit(1), n)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(places, F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def mod97(code: Column) -> Column:
    """ISO 7064: the first four characters to the end, letters as 10 to 35; the number leaves 1."""
    bare = F.regexp_replace(F.upper(code), "[^0-9A-Z]", "")
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))

    def step(a: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v >= 65, (a * 100 + v - 55) % 97).otherwise((a * 10 + v - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"
#: Each says of a proposal m whether it stays.
CHECKS = {
    "none": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda m: F.exists(F.array(_digits(m)), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)),
    "short_card": lambda m: F.exists(F.array(_digits(m)), lambda d: F.when(F.length(d).between(13, 15), luhn(d)).otherwise(False)),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
    "iban": lambda m: F.when(F.length(F.regexp_replace(m, " ", "")).between(15, 34), mod97(m)).otherwise(False),
}
_RUN = "[A-Za-z0-9._%+-]"
BASE = (
    Kind("email", rf"(?:\G|(?<!{_RUN})){_RUN}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "none", 0.9),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", "ip", 0.6, r"(?i)\b(?:ip|host|address|server)\b"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9][ 0-9-][0-9]", "card", 0.8, r"(?i)\b(?:card|visa|mastercard|credit|debit)\b"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", "phone", 0.7, r"(?i)\b(?:phone|tel|call|fax|mobile)\b"),
)
FURTHER = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{1,4}){3,8}+(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", "iban", 0.8, r"(?i)\b(?:iban|bank|account|konto)\b"),
    Kind("short_card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])", "[0-9][ 0-9-][0-9]", "short_card", 0.2, r"(?i)\b(?:card|amex|credit|debit)\b"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]", "none", 0.3, r"(?i)\b(?:ssn|social security)\b"),
    Kind("local_phone", r"(?<![0-9+(-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])", "[0-9][-. ][0-9]{4}", "none", 0.2, r"(?i)\b(?:phone|tel|call|fax|mobile)\b"),
    Kind("access_key", r"(?<![A-Z0-9])AKIA[0-9A-Z]{16}(?![A-Z0-9])", "AKIA", "none", 0.8),
)


def proposals(text: Column, kind: Kind) -> Column:
    """array<struct<start,end,value>> of the pattern's matches in turn; nothing where the hint is missing."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.split(text, kind.pattern, -1)
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.length(p).cast("long").alias("gap"), m.alias("value")))
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,value:string>>)")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("spans"))

    def block(state: Column, part: Column) -> Column:
        walked = F.aggregate(part, F.struct(state["at"].alias("at"), empty.alias("spans")), step)
        return F.transform(F.array(walked), lambda w: F.struct(w["at"].alias("at"), F.concat(state["blocks"], F.array(w["spans"])).alias("blocks")))[0]

    none = F.expr("cast(array() as array<array<struct<start:bigint,end:bigint,value:string>>>)")
    walked = F.aggregate(in_blocks(pairs), F.struct(F.lit(0).cast("long").alias("at"), none.alias("blocks")), block, lambda s: F.flatten(s["blocks"]))
    there = text.contains(kind.hint) if kind.hint in ("@", "AKIA") else text.rlike(kind.hint)
    return F.when(there, walked).otherwise(empty)


def spans_of(text: Column, pieces: Column, kind: Kind, base: bool) -> Column:
    """The kind's spans that stay, with their scores, in order of place. pieces: a column with the text's pieces."""

    def score(x: Column) -> Column:
        if not kind.context:
            return F.lit(kind.score)
        left = F.greatest(x["start"] - CONTEXT, F.lit(0))
        near = F.concat(stretch(pieces, left, x["start"]), F.lit(" "), stretch(pieces, x["end"], x["end"] + CONTEXT))
        return F.when(near.rlike(kind.context), F.least(F.lit(1.0), F.lit(kind.score + kind.bonus))).otherwise(F.lit(kind.score))

    valid = F.filter(proposals(text, kind), lambda x: CHECKS[kind.check](x["value"]))
    scored = F.transform(valid, lambda x: F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score(x).alias("score")))
    return scored if base else F.filter(scored, lambda s: s["score"] >= KEEP)


def _found(text: Column, further: tuple[Kind, ...]) -> tuple[Column, Column, Column]:
    """pieces, base and more, of a text that is not null: columns to be named _pieces, _base and _more in turn."""
    digit = text.rlike("[0-9]")
    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    join = lambda kinds, base: F.concat(*(spans_of(text, F.col("_pieces"), k, base) for k in kinds))
    numeric = F.when(digit, join(BASE[1:], True)).otherwise(empty)
    more = F.when(digit | text.contains("AKIA"), join(further, False)).otherwise(empty) if further else empty
    return in_pieces(text), F.concat(spans_of(text, F.col("_pieces"), BASE[0], True), numeric), more


def _with_spans(df: DataFrame, further: tuple[Kind, ...]) -> DataFrame:
    """df(..., _text) with _pieces, _base and _spans."""
    pieces, base, more = _found(F.coalesce("_text", F.lit("")), further)
    return df.withColumn("_pieces", pieces).withColumn("_base", base).withColumn("_more", more).withColumn("_spans", F.concat("_base", "_more"))


def _apart(df: DataFrame, names: list[str], text: str) -> DataFrame:
    """k0, k1, ... (names) and _text, so that no name of df meets ours."""
    return df.select(*(F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(names)), F.col(quoted(text)).alias("_text"))


def find(df: DataFrame, text: str = "text", further: tuple[Kind, ...] = FURTHER) -> DataFrame:
    """df's columns; base (array of kind, start, end, score: the base kinds' spans, by kind, then place) and spans (those and the
    further kinds')."""
    names = [c for c in df.columns if c not in ("base", "spans")]
    out = _with_spans(_apart(df, names, text), further)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(names)), F.col("_base").alias("base"), F.col("_spans").alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _masked() -> Column:
    """Of _text, _pieces and _spans: [KIND] over every span."""
    order = F.array_sort(F.col("_spans"), lambda a, b: F.when(a["start"] != b["start"], (a["start"] - b["start"]).cast("int")).otherwise((b["end"] - a["end"]).cast("int")))

    pieces = F.col("_pieces")
    none = F.expr("cast(array() as array<string>)")

    def step(state: Column, s: Column) -> Column:
        label = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        added = F.struct(s["end"].alias("at"), F.concat(state["out"], F.array(stretch(pieces, state["at"], s["start"]), label)).alias("out"))
        reached = F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out"))
        return F.when(s["start"] >= state["at"], added).otherwise(reached)

    def block(state: Column, part: Column) -> Column:
        written = F.aggregate(part, F.struct(state["at"].alias("at"), none.alias("out")), step)
        return F.transform(F.array(written), lambda w: F.struct(w["at"].alias("at"), F.concat(state["out"], F.array(F.array_join(w["out"], ""))).alias("out")))[0]

    tail = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col("_text"), (s["at"] + 1).cast("int"), F.length("_text")))
    masked = F.aggregate(in_blocks(order), F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), block, tail)
    return F.when(F.size("_spans") > 0, masked).otherwise(F.col("_text"))


def _with_text(out: DataFrame, names: list[str], text: str, n_chars: str) -> DataFrame:
    own = {text: F.col("_masked")} | ({n_chars: F.length("_masked").cast("long")} if n_chars in names else {})
    return out.select(*(own.get(c, F.col(f"k{i}")).alias(c) for i, c in enumerate(names)))


def mask(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """df's columns, with [KIND] written over every span of find(); of spans that overlap, the one that begins first (then the longest) names all."""
    names = df.columns
    cut = _apart(df, names, text).withColumn("_spans", F.col(f"k{names.index(spans)}")).withColumn("_pieces", in_pieces(F.coalesce("_text", F.lit(""))))
    return _with_text(cut.withColumn("_masked", _masked()), names, text, "")


def redact(df: DataFrame, text: str = "text", n_chars: str = "n_chars", further: tuple[Kind, ...] = FURTHER) -> DataFrame:
    """df's columns, whatever their names, with the personal data in its texts masked. n_chars, if there is such a column, is counted anew."""
    names = df.columns
    return _with_text(_with_spans(_apart(df, names, text), further).withColumn("_masked", _masked()), names, text, n_chars)
