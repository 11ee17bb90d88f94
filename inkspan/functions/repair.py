"""Repair of characters that OCR takes for others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkspan.functions.text import let

#: Words that OCR joins, and how they are written.
JOINED = {"Grossworth": "Gross worth", "grossworth": "gross worth", "Networth": "Net worth", "networth": "net worth", "Netprice": "Net price", "netprice": "net price"}
#: In a text with one of these, in any case, 0Z after any digits is a percent sign; elsewhere after one or two digits.
TAX_WORDS = ("VAT", "TAX", "IVA", "%")
LOST = "�"
#: What a text has that repair_text changes; some that have it stay the same. Each branch begins with plain characters, for speed.
_BROKEN = rf"(?U){LOST}|(?=[{''.join(sorted({w[0] for w in JOINED}))}])(?:{'|'.join(JOINED)})|\d(?:[Ool]\d|0Z|\s{{2,}}\d)|[Oo]\d+[,.]\d"


def repair_text(c: Column) -> Column:
    """In this order: lost characters go, joined words part, O and l between digits (O also at the head of a decimal) are 0 and 1, 0Z is a
    percent sign, and wide gaps between digits shrink to a blank."""
    swap = lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1]))
    parted = F.when(c.rlike("|".join([LOST, *JOINED])), reduce(swap, JOINED.items(), F.replace(c, F.lit(LOST), F.lit("")))).otherwise(c)

    def percent(x: Column) -> Column:
        upper = F.upper(x)
        taxed = reduce(lambda a, b: a | b, (F.contains(upper, F.lit(w)) for w in TAX_WORDS))
        return F.when(taxed, F.regexp_replace(x, r"(?U)\b(\d+)0Z\b", "$1%")).otherwise(F.regexp_replace(x, r"(?U)\b(\d{1,2})0Z\b", "$1%"))

    def digits(x: Column) -> Column:
        text = x
        for pattern, put in ((r"(?U)(?<=\d)[Oo](?=\d)", "0"), (r"(?U)\b[Oo](\d+[,.]\d+)\b", "0$1"), (r"(?U)(?<=\d)l(?=\d)", "1")):
            text = F.regexp_replace(text, pattern, put)
        return F.regexp_replace(let(text, percent), r"(?U)(\d)\s{2,}(\d)", "$1 $2")

    # all that is left to do stands beside a digit
    return let(parted, lambda x: F.when(x.rlike(r"(?U)\d"), digits(x)).otherwise(x))


def repair_texts(texts: Column) -> Column:
    """repair_text of each text of an array. One look at all of them, parted by a character that no pattern matches or counts as a word's, tells whether any can
    be broken; most pages have none."""
    broken = lambda t: F.array_join(t, "\0").rlike(_BROKEN)
    return let(texts, lambda t: F.when(broken(t), F.transform(t, repair_text)).otherwise(t))
