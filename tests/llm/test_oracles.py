"""The DuckDB SQL of operators 2, 7, 8, 9 and 10 against the operators, over odd cases."""

from __future__ import annotations

import random

import pytest

from inkspan.llm.queries import oracle_sql, queries
from tests.llm.helpers import corpus, frame
from tests.llm.test_documents import PII_TEXTS, boilerplate


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, tmp_path, name):
    import duckdb

    rows = corpus() + boilerplate() + [(800 + i, t, None, None, None) for i, t in enumerate(PII_TEXTS)]
    frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    vectors = [*base, *([x + 0.05 * rng.gauss(0, 1) for x in v] for v in base[:15]), *([x + 0.1 * rng.gauss(0, 1) for x in base[0]] for _ in range(20)), base[3], [2 * x for x in base[3]], None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [1.0] * 8, [1.0] * 8]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(oracle_sql()[name])
    columns = sorted(got.columns)
    assert sorted(x[0] for x in want.description) == columns
    at = [[x[0] for x in want.description].index(c) for c in columns]
    plain = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted((plain(r[i] for i in at) for r in want.fetchall()), key=repr) == sorted((plain(r) for r in got.select(*columns).collect()), key=repr)
