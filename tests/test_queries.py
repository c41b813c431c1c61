"""Every query with an SQL twin against DuckDB; every other one for rows."""

import datetime
import decimal
import math
import os
import re

import duckdb
import pytest
import xxhash
from conftest import ROOT, SMALL

from sluicework import queries as engine
from sluicework.functions import text

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)) or isinstance(v, int) and not isinstance(v, bool):
        return f"{float(v):.6f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def table(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_matches_sql(spark, duck, name):
    df = engine.QUERIES[name](spark, SMALL)
    twin = duck.execute(engine.SQL[name])
    names = [c[0] for c in twin.description]
    assert sorted(df.columns) == sorted(names)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(names, twin.fetchall())


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.SQL)))
def test_runs(spark, name):
    assert engine.QUERIES[name](spark, SMALL).count() > 0


def brute_vectors(doc_id, said, size=512, step=448, width=32):
    """The vectors of a text's chunks, word by word."""
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", said or "") if w]
    out = {}
    for chunk, start in enumerate(range(0, len(words), step)):
        v = [0] * width
        for w in " ".join(words[start : start + size]).lower().split():
            h = xxhash.xxh64_intdigest(w)
            v[h % width] += 1 if h >= 2**63 else -1
        length = math.sqrt(sum(x * x for x in v)) or 1.0
        out[doc_id, chunk] = [x / length for x in v]
    return out


def same_vectors(found, said):
    want = {}
    for doc_id, words in said:
        want |= brute_vectors(doc_id, words)
    got = [((r["doc_id"], r["chunk_index"]), r["embedding"]) for r in found.collect()]
    assert len(got) == len(want) and dict(got).keys() == want.keys()
    assert all(v == pytest.approx(want[k], abs=1e-12) for k, v in got)


def test_chunk_vectors_of_the_whole_table(spark):
    said = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    same_vectors(engine.QUERIES["embed_chunks"](spark, SMALL), said)


def test_chunk_vectors_of_odd_texts(spark):
    """Nothing, white space, one word, the last word of a step and the first of the next, no id."""
    long = [f"W{i}" for i in range(1_400)]
    said = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, " ".join(long[:448])), (6, " ".join(long[:449])), (7, "\n".join(long)), (None, "no id")]
    df = spark.createDataFrame(said, "doc_id long, text string")
    same_vectors(text.embed(text.chunks(df, "doc_id", "text"), "text"), said)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 3
    assert os.path.dirname(e.__file__)


def test_filters_and_columns_reach_the_scan(spark):
    plan = engine.QUERIES["filter_predicate"](spark, SMALL).select("c_custkey")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThanOrEqual(c_acctbal,1800.0)]" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in plan


def test_as_of_is_one_shuffle(spark):
    plan = engine.QUERIES["asof_join_latest"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_embedded_database_keeps_every_value_and_mode(spark):
    """Rows go in through Derby's import, so what its text form could lose is tried; modes are Spark's."""
    from sluicework.sources import embedded, readers, writers

    rows = [(1, "a", 1.5), (2, "", None), (3, None, -2e-30), (4, 'say "x", twice ""', 0.1), (5, "two\nlines, \r\n three ", 1e300), (6, "  spaced ", 3.0), (7, "ß漢😀\\n'", 4.0), (None, None, None)]
    df = spark.createDataFrame(rows, "id long, name string, x double")
    cfg = {"url": embedded.new_database(), "table": "odd", "driver": embedded.DRIVER}
    size = {"options": {"createTableColumnTypes": "name varchar(100)"}}
    writers.write_jdbc(df, {**cfg, **size, "mode": "error"})
    writers.write_jdbc(df.limit(3), {**cfg, "mode": "ignore"})
    with pytest.raises(Exception, match="already exists"):
        writers.write_jdbc(df, {**cfg, "mode": "error"})
    writers.write_jdbc(df.filter("false"), cfg)
    writers.write_jdbc(df.select("x", "name", "id").filter("id = 1"), cfg)
    writers.write_jdbc(df, {**cfg, **size, "table": "again", "mode": "ignore"})
    writers.write_jdbc(df.filter("id < 3"), {**cfg, **size, "table": "again", "mode": "overwrite"})
    cfg = embedded.published(spark, cfg)
    order = lambda found: sorted(map(tuple, found), key=repr)
    assert order(readers.read_jdbc(spark, cfg).collect()) == order([*rows, rows[0]])
    assert order(readers.read_jdbc(spark, {**cfg, "table": "again"}).collect()) == order(rows[:2])


def test_jdbc_queries_on_executors_of_their_own():
    """An embedded database lives in one process; here driver and executors are three."""
    import subprocess
    import sys

    code = f"""
import sys, tempfile
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
shared = tempfile.mkdtemp()
spark = (SparkSession.builder.master("local-cluster[2,1,1000]").config("spark.executor.memory", "600m").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
    .config("spark.checkpoint.dir", f"file://{{shared}}/shared").config("spark.sql.warehouse.dir", f"{{shared}}/warehouse").getOrCreate())
from sluicework import queries as engine
for name in ("src_jdbc_table", "sink_jdbc_roundtrip", "src_jdbc_query", "src_jdbc_partitioned"):
    print("rows", name, engine.QUERIES[name](spark, {SMALL!r}).count())
spark.stop()
"""
    env = {**os.environ, "PYTHONPATH": ROOT}
    made = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env=env)
    found = dict(line.split()[1:] for line in made.stdout.splitlines() if line.startswith("rows "))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{SMALL}/customer.parquet'")
    assert found == {name: str(len(con.execute(engine.SQL[name]).fetchall())) for name in ("src_jdbc_table", "sink_jdbc_roundtrip", "src_jdbc_query", "src_jdbc_partitioned")}, made.stderr[-2000:]
