"""Small corpora with every odd case, and plain versions of what the operators compute."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, parts=("the", "ing", "er", "on", "th", "at", "ou", "ed")) -> list[str]:
    return ["".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n)]


def corpus(seed: int = 1, n: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lines = [" ".join(words(rng, rng.randint(5, 25))) for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(lines), rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), None))
    shared = " ".join(words(rng, 50))
    rows += [(100 + i, f"{' '.join(words(rng, 30))} {shared} {' '.join(words(rng, 20))}", "en", "a", 1) for i in range(3)]
    rows += [(200 + i, rows[0][1], "en", "b", 1) for i in range(3)]  # copies
    near = rows[1][1].split(" ")
    rows += [(210, " ".join([*near[:-1], "otherwise"]), "en", "b", 1)]
    rows += [(300, None, None, None, None), (301, "", "en", "a", 0), (302, " \t\n ", "en", "a", 0), (303, "one", "en", "a", 3), (304, "two words", "en", "a", 9)]
    rows += [(400, " ".join(words(rng, 6_000)), "en", "a", 0), (401, "x" * 4_000, "en", "a", 0), (402, "é ß ñ 漢字 😀 \u2028 a\u00a0b " * 40, "de", "c", 0)]
    rows += [rows[5], rows[5]]  # repeated rows
    return rows


def frame(spark, rows, extra: bool = False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:  # names that clash with those the operators use inside
        for name in ("size", "kept", "h", "key", "component_id", "n_words", "chunk", "hit", "k0", "id", "fp", "base", "spans", "row", "over", "host", "node"):
            df = df.withColumn(name, df.doc_id * 0 + 7)
    return df


def by_row(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
