"""Every registered query at the smallest size against its SQL."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from meetlake.plans import people, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return repr(round(float(value), 6) + 0.0)
    return str(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted(str([plain(v) for v in r]) for r in found.select(columns).collect())
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert rows == sorted(str([plain(r[i]) for i in order]) for r in want.fetchall())


def test_voice_suggest_asks_in_every_meeting(spark, tmp_path):
    """Forty vectors along eight axes: every meeting has speakers whose voice someone has."""
    rows = [(k, f"p{k % 8}", [float(d == k % 8) for d in range(64)]) for k in range(40)]
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = people.voice_suggest(spark, str(tmp_path)).where("rank = 1").collect()
    assert {(r.meeting_id, r.speaker, r.person) for r in found} == {(k % 20, k, f"p{k % 8}") for k in range(40)}
