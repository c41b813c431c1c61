"""Every operator as a query over the standard tables, with its SQL twin."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import fingerprints, text
from .operators import cleaning, joins, models, statistics, transforms
from .plans import hooks, lineage, runner, spec
from .plans.spec import Step
from .session import shared_folder
from .sources import embedded, readers, rest, writers
from .sources.registry import default_registry
from .streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dec(c: str, scale: int = 2) -> F.Column:
    return F.col(c).cast(f"decimal(18,{scale})")


# --- aggregation -------------------------------------------------------------------------

@query("rate_by_class", """
    SELECT l_returnflag, count(l_orderkey) AS line_count, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS filled_count,
        round(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) / count(l_orderkey), 4) AS filled_rate
    FROM lineitem GROUP BY l_returnflag ORDER BY l_returnflag""")
def rate_by_class(spark, d):
    rows = t(spark, d, "lineitem")
    return statistics.rate(rows, ["l_returnflag"], "l_orderkey", F.col("l_linestatus") == "F", ("line_count", "filled_count", "filled_rate")).orderBy("l_returnflag")


@query("rate_by_class_group", """
    SELECT l_returnflag, CASE WHEN l_quantity < 18 THEN 'small' ELSE 'large' END AS size_group, count(*) AS line_count,
        CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS filled_count,
        round(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) / count(*), 4) AS filled_rate
    FROM lineitem GROUP BY ALL""")
def rate_by_class_group(spark, d):
    rows = t(spark, d, "lineitem").withColumn("size_group", cleaning.choose([("l_quantity < 18", "small")], "large"))
    return statistics.rate(rows, ["l_returnflag", "size_group"], "*", F.col("l_linestatus") == "F", ("line_count", "filled_count", "filled_rate"))


@query("global_count", "SELECT count(*) AS n FROM lineitem")
def global_count(spark, d):
    return t(spark, d, "lineitem").agg(F.count("*").alias("n"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("row_count_audit", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in TABLES))
def row_count_audit(spark, d):
    counts = [t(spark, d, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n in TABLES]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("quantile_breaks", "SELECT i / 10.0::DOUBLE AS q, round(quantile_cont(value, i / 10.0), 6) AS value FROM events, range(11) r(i) GROUP BY i".replace(
    "quantile_cont(value, i / 10.0)", "list_extract(list_value(" + ", ".join(f"quantile_cont(value, {i / 10})" for i in range(11)) + "), CAST(i AS INT) + 1)"))
def quantile_breaks(spark, d):
    return statistics.quantile_breaks(t(spark, d, "events"), "value").select("q", F.round("value", 6).alias("value"))


@query("quantile_breaks_approx", "SELECT i / 10.0::DOUBLE AS q, true AS close FROM range(11) r(i)")
def quantile_breaks_approx(spark, d):
    """Whether each approximate break lies within a hundredth of its rank."""
    e = t(spark, d, "events").select("value").filter("value is not null")
    breaks = statistics.quantile_breaks(e, "value", accuracy=1_000).withColumnRenamed("value", "b")
    at = F.transform("bs", lambda b: F.struct(b["q"].alias("q"), (F.col("value") < b["b"]).cast("long").alias("below"), (F.col("value") <= b["b"]).cast("long").alias("upto")))
    met = e.join(F.broadcast(breaks.agg(F.collect_list(F.struct("q", "b")).alias("bs")))).select(F.inline(at))  # one row of eleven breaks
    ranks = met.groupBy("q").agg(F.avg("below").alias("low"), F.avg("upto").alias("high"))
    return ranks.select("q", F.col("q").between(F.col("low") - 0.01, F.col("high") + 0.01).alias("close"))


_SPLIT_TS = "TIMESTAMP '2024-01-16 00:00:00'"
_DAY = "CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS DOUBLE)"


def _shares_sql(value: str = "value", width: bool = False) -> str:
    cuts = ", ".join(f"min(v) + (max(v) - min(v)) * CAST({i / 10} AS DOUBLE)" if width else f"quantile_cont(v, {i / 10})" for i in range(1, 10))
    return f"""
        WITH e AS (SELECT ts, {value} AS v FROM events), cut AS (SELECT list_value({cuts}) AS c FROM e WHERE ts < {_SPLIT_TS}),
        placed AS (SELECT len(list_filter(c, lambda x: x <= v)) AS bucket, ts < {_SPLIT_TS} AS is_ref FROM e, cut WHERE v IS NOT NULL),
        counts AS (SELECT b.bucket, count(p.bucket) FILTER (is_ref) AS r, count(p.bucket) FILTER (NOT is_ref) AS c FROM range(10) b(bucket) LEFT JOIN placed p ON p.bucket = b.bucket GROUP BY b.bucket),
        shares AS (SELECT CAST(bucket AS INTEGER) AS bucket, r / sum(r) OVER () AS ref, c / sum(c) OVER () AS cur FROM counts)"""


_SHARES = _shares_sql()


def _drift(spark, d, columns=("value",), **how):
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("double")
    e = t(spark, d, "events").select("ts", "value", day.alias("day"))
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return statistics.shares(e.filter(F.col("ts") < cut), e.filter(F.col("ts") >= cut), list(columns), **how)


@query("drift_histogram", _SHARES + " SELECT 'value' AS feature, bucket, round(ref, 6) AS ref, round(cur, 6) AS cur FROM shares")
def drift_histogram(spark, d):
    return _drift(spark, d).select("feature", "bucket", F.round("ref", 6).alias("ref"), F.round("cur", 6).alias("cur"))


_PSI = "round(sum((cur - ref) * ln((cur + 1e-8) / (ref + 1e-8))), 6)"


@query("drift_psi", _SHARES + f" SELECT 'value' AS feature, {_PSI} AS psi, CASE WHEN {_PSI} < 0.2 THEN 'PASS' ELSE 'FAIL' END AS status FROM shares")
def drift_psi(spark, d):
    return statistics.psi(_drift(spark, d))


@query("drift_kl", _shares_sql(width=True) + " SELECT 'value' AS feature, round(sum(ref * ln((ref + 1e-8) / (cur + 1e-8))), 6) AS kl FROM shares")
def drift_kl(spark, d):
    return statistics.kl(_drift(spark, d, width=True))


@query("route_fail_rows", "SELECT * FROM (" + " UNION ALL ".join(f"({_shares_sql(v)} SELECT '{n}' AS feature, {_PSI} AS psi, CASE WHEN {_PSI} < 0.2 THEN 'PASS' ELSE 'FAIL' END AS status FROM shares)" for n, v in (("value", "value"), ("day", _DAY))) + ") WHERE status = 'FAIL'")
def route_fail_rows(spark, d):
    """Of a feature that keeps its distribution and one that cannot, the day, the one that drifts."""
    return cleaning.route(statistics.psi(_drift(spark, d, ("value", "day"))), "status = 'FAIL'")[1]


def _scored(spark, d):
    return t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("predicted", (F.col("n_chars") > 1000).cast("int"))


@query("metric_accuracy_f1", """
    WITH s AS (SELECT quality = 1 AS y, n_chars > 1000 AS p FROM labels JOIN documents USING (doc_id))
    SELECT round(count(*) FILTER (y = p) / count(*), 6) AS accuracy,
        round(2 * count(*) FILTER (y AND p) / (2 * count(*) FILTER (y AND p) + count(*) FILTER (y <> p)), 6) AS f1 FROM s""")
def metric_accuracy_f1(spark, d):
    return statistics.accuracy_f1(_scored(spark, d), "quality", "predicted")


@query("metric_auc", """
    WITH s AS (SELECT quality AS y, n_chars AS x FROM labels JOIN documents USING (doc_id)),
    r AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk FROM s)
    SELECT round(CAST((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) AS DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r""")
def metric_auc(spark, d):
    return statistics.auc(_scored(spark, d), "quality", "n_chars")


_HOLED = "SELECT event_id, ts, user_id, nullif(event_type, 'error') AS event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events"


def _holed(spark, d):
    e = t(spark, d, "events")
    return e.select("event_id", "ts", "user_id", F.nullif("event_type", F.lit("error")).alias("event_type"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))


@query("null_counts", f"WITH h AS ({_HOLED}) " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null FROM h" for c in ("event_id", "ts", "user_id", "event_type", "value")))
def null_counts(spark, d):
    return cleaning.null_counts(_holed(spark, d))


# --- row operators -----------------------------------------------------------------------

@query("noop_passthrough", "SELECT * FROM region")
def noop_passthrough(spark, d):
    return transforms.noop({"r": t(spark, d, "region")}, {})["r"]


@query("transform_chain", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 2 AS DOUBLE) AS doubled FROM orders WHERE o_orderstatus = 'F'")
def transform_chain(spark, d):
    steps = [
        Step(type="filter", params={"where": {"orders": "o_orderstatus = 'F'"}}),
        Step(type="sql", params={"queries": {"orders": "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 2 AS DOUBLE) AS doubled FROM {orders}"}}),
        Step(),
    ]
    return transforms.chain({"orders": t(spark, d, "orders")}, steps, default_registry())["orders"]


@query("sql_transform", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def sql_transform(spark, d):
    frames = {"nation": t(spark, d, "nation"), "region": t(spark, d, "region")}
    return transforms.sql(frames, {"queries": {"out": "SELECT n_name, r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"}})["out"]


@query("filter_predicate", "SELECT * FROM customer WHERE c_acctbal >= 1800")
def filter_predicate(spark, d):
    return t(spark, d, "customer").filter("c_acctbal >= 1800")


class _RichCustomers(runner.Task):
    def setup(self):
        self.least = 1800

    def transform(self, sources):
        return {"rich": sources["customer"].filter(F.col("c_acctbal") >= self.least)}


def _run(spark, inputs: dict, outputs: dict, task: type[runner.Task] | None = None, record: lineage.RunRecord | None = None) -> None:
    """A task run by the engine, from named inputs to named outputs."""
    config = spec.parse({"VERSION": "1.0.0", "CONFIG": {"inputs": inputs, "outputs": outputs}}, {}, {})
    made = task(config.CONFIG.model_dump()) if task else None
    if made is not None:
        made.setup()
    runner.Engine(spark).run(config, hooks.Context("query", "queries/engine/task"), made, record)


@query("task_filter", "SELECT * FROM customer WHERE c_acctbal >= 1800")
def task_filter(spark, d):
    path = shared_folder(spark, "task")
    _run(spark, {"customer": {"format": "path", "path": f"{d}/customer.parquet"}}, {"rich": {"format": "path", "path": path}}, _RichCustomers)
    return spark.read.schema(CUSTOMER).parquet(path)


@query("filter_length", "SELECT doc_id, n_chars FROM documents WHERE length(text) > 200")
def filter_length(spark, d):
    return t(spark, d, "documents").filter("LENGTH(text) > 200").select("doc_id", "n_chars")


@query("filter_not_null", f"SELECT event_id, event_type, value FROM ({_HOLED}) WHERE event_type IS NOT NULL AND value IS NOT NULL")
def filter_not_null(spark, d):
    return cleaning.not_null(_holed(spark, d), "event_type", "value").select("event_id", "event_type", "value")


@query("dropna_any", f"SELECT event_id, user_id FROM ({_HOLED}) WHERE event_type IS NOT NULL AND value IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL AND event_id IS NOT NULL")
def dropna_any(spark, d):
    return _holed(spark, d).dropna().select("event_id", "user_id")


@query("dropna_subset", f"SELECT event_id, event_type, value FROM ({_HOLED}) WHERE event_type IS NOT NULL")
def dropna_subset(spark, d):
    return cleaning.not_null(_holed(spark, d), "event_type").select("event_id", "event_type", "value")


@query("derive_case", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'filled' ELSE 'open' END AS status_label,
        CASE WHEN nullif(o_totalprice, 0) < 100000 THEN 'small' ELSE 'large' END AS size_group FROM orders""")
def derive_case(spark, d):
    o = t(spark, d, "orders").withColumn("p", F.nullif("o_totalprice", F.lit(0.0)))
    return o.select("o_orderkey", cleaning.choose([("o_orderstatus = 'F'", "filled")], "open").alias("status_label"), cleaning.choose([("p < 100000", "small")], "large").alias("size_group"))


@query("encode_segment", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 2 WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS segment_code FROM customer")
def encode_segment(spark, d):
    return t(spark, d, "customer").select("c_custkey", cleaning.encode(F.col("c_mktsegment"), {"BUILDING": 2, "MACHINERY": 1}).alias("segment_code"))


@query("dedup_rows", "SELECT DISTINCT event_type, user_id FROM events")
def dedup_rows(spark, d):
    return t(spark, d, "events").select("event_type", "user_id").dropDuplicates()


@query("dedup_key", "SELECT min(doc_id) AS doc_id, count(*) AS n_copies, md5(text) AS text_md5 FROM documents GROUP BY text")
def dedup_key(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text")
    hashed = docs.select("doc_id", F.md5("text").alias("text_md5"))
    return cleaning.dedup_by_key(hashed, ["text_md5"], ["doc_id"], copies="n_copies").select("doc_id", "n_copies", "text_md5")


@query("cast_columns", "SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def cast_columns(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return cleaning.cast_columns(cleaning.cast_columns(o, {"o_orderkey": "int", "o_totalprice": "decimal(18,2)", "o_orderdate": "date"}), {"o_totalprice": "double"})


@query("normalise_names", "SELECT s_suppkey, s_name FROM supplier")
def normalise_names(spark, d):
    return cleaning.normalise_names(t(spark, d, "supplier").select(F.col("s_suppkey").alias(" S_SuppKey "), F.col("s_name").alias("S_NAME ")), lower=True)


@query("feature_arith", """
    SELECT l_orderkey, l_linenumber, l_linenumber + CAST(l_quantity AS INTEGER) + 1 AS bundle_size, CAST(l_linenumber = 1 AS INTEGER) AS is_first,
        CAST(l_returnflag = 'R' AS INTEGER) AS is_returned, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) / CAST(l_quantity AS DECIMAL(18,2)) AS DOUBLE) > 1000 AS dear FROM lineitem""")
def feature_arith(spark, d):
    li = t(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", (F.col("l_linenumber") + F.col("l_quantity").cast("int") + 1).alias("bundle_size"), (F.col("l_linenumber") == 1).cast("int").alias("is_first"),
        (F.col("l_returnflag") == "R").cast("int").alias("is_returned"), ((dec("l_extendedprice") / dec("l_quantity")).cast("double") > 1000).alias("dear"),
    )


@query("bin_ordinal", "SELECT p_partkey, CASE WHEN p_size <= 0 THEN NULL WHEN p_size <= 12 THEN 0 WHEN p_size <= 18 THEN 1 WHEN p_size <= 60 THEN 2 WHEN p_size <= 100 THEN 3 END AS size_bin FROM part")
def bin_ordinal(spark, d):
    return t(spark, d, "part").select("p_partkey", cleaning.bin_right_closed(F.col("p_size"), [0, 12, 18, 60, 100]).alias("size_bin"))


@query("impute_median", """
    WITH c AS (SELECT c_custkey, nullif(c_nationkey, 3) AS n FROM customer)
    SELECT c_custkey, CAST(coalesce(n, (SELECT quantile_cont(n, 0.5) FROM c)) AS DOUBLE) AS n FROM c""")
def impute_median(spark, d):
    return cleaning.impute_median(t(spark, d, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("n")), "n")


@query("tag_literals", "SELECT *, '1.0.0' AS model_version, 'production' AS model_stage FROM region")
def tag_literals(spark, d):
    return cleaning.tag(t(spark, d, "region"), model_version="1.0.0", model_stage="production")


@query("sample_hash", "SELECT event_id, user_id FROM events WHERE CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 10")
def sample_hash(spark, d):
    return cleaning.sample_by_hash(t(spark, d, "events").select("event_id", "user_id"), ["event_id"], 10)


@query("audit_row", """
    SELECT 'orders' AS output, 'path' AS format, count(*) AS row_count,
        CAST(sum(CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || chr(31) || CAST(o_custkey AS VARCHAR)), 1, 8) AS BIGINT)) AS BIGINT) > 0 AS hashed FROM orders""")
def audit_row(spark, d):
    """One row about a run: what the engine observed while it wrote."""
    record = lineage.RunRecord("query", "queries/engine/audit", "queries", "engine", "audit", None, "etl", "1.0.0", "")
    source = shared_folder(spark, "audit-in")
    t(spark, d, "orders").write.parquet(source)
    _run(spark, {"orders": {"format": "path", "path": source}}, {"orders": {"format": "path", "path": shared_folder(spark, "audit")}}, record=record)
    rows = [(s.name, s.format, s.row_count, bool(s.data_hash)) for s in record.outputs]
    return spark.createDataFrame(rows, "output string, format string, row_count long, hashed boolean")


@query("train_test_split", """
    WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels)
    SELECT doc_id, quality, CASE WHEN k <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM r""")
def train_test_split(spark, d):
    return cleaning.split_by_hash(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality")


# --- joins -------------------------------------------------------------------------------

@query("join_left_dim", "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join_left_dim(spark, d):
    dim = t(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return joins.dimension(t(spark, d, "orders").select("o_orderkey", "o_custkey"), dim, "o_custkey", ["c_mktsegment"])


def _as_of_sql(kind: str) -> str:
    return f"""
        WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
        SELECT p.event_id, p.user_id, v.ts AS matched_ts, v.value AS matched_value FROM p ASOF {kind} JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts"""


def _as_of(spark, d, how):
    e = t(spark, d, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'view'").select("user_id", "ts", "value")
    return joins.as_of(left, right, "user_id", "ts", "ts", ["value"], how).select("event_id", "user_id", "matched_ts", "matched_value")


@query("asof_join_latest", _as_of_sql("LEFT"))
def asof_join_latest(spark, d):
    return _as_of(spark, d, "left")


@query("asof_join_inner", _as_of_sql(""))
def asof_join_inner(spark, d):
    return _as_of(spark, d, "inner")


@query("latest_per_key", "SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_per_key(spark, d):
    return joins.latest_per_key(t(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value"), ["user_id"], ["ts", "event_id"])


@query("compare_versions", f"""
    WITH a AS (SELECT event_type, sum(CAST(value AS DECIMAL(18,4))) AS v FROM events WHERE ts < {_SPLIT_TS} GROUP BY 1), b AS (SELECT event_type, sum(CAST(value AS DECIMAL(18,4))) AS v FROM events WHERE ts >= {_SPLIT_TS} GROUP BY 1)
    SELECT event_type, CAST(a.v AS DOUBLE) AS value_a, CAST(b.v AS DOUBLE) AS value_b, round(CAST(b.v AS DOUBLE) - CAST(a.v AS DOUBLE), 6) AS delta FROM a FULL JOIN b USING (event_type)""")
def compare_versions(spark, d):
    e = t(spark, d, "events").withColumn("early", F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"))
    side = lambda early: e.filter(F.col("early") == early).groupBy("event_type").agg(F.sum(dec("value", 4)).cast("double").alias("v"))
    return joins.compare(side(True), side(False), "event_type", "v")


@query("sql_join_inner", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def sql_join_inner(spark, d):
    return t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("sql_join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region")
def sql_join_cross(spark, d):
    return t(spark, d, "nation").crossJoin(t(spark, d, "region")).select("n_name", "r_name")


@query("sql_join_full", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def sql_join_full(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "supplier"), F.col("c_custkey") == F.col("s_suppkey"), "full").select("c_custkey", "s_suppkey")


@query("sql_join_right", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
def sql_join_right(spark, d):
    return t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "right").select("o_orderkey", "c_custkey")


@query("sql_join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def sql_join_semi(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("sql_join_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def sql_join_anti(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("sql_join_theta", "SELECT n_name, r_name FROM nation JOIN region ON n_nationkey > 5 * r_regionkey")
def sql_join_theta(spark, d):
    return t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_nationkey") > 5 * F.col("r_regionkey")).select("n_name", "r_name")


# --- windows, sorting, sets --------------------------------------------------------------

_ROLLING = ", ".join(f"CAST(sum(CAST(value AS DECIMAL(18,4))) OVER w{n} AS DOUBLE) AS sum_{n}d, count(value) OVER w{n} AS count_{n}d, round(CAST(sum(CAST(value AS DECIMAL(18,4))) OVER w{n} AS DOUBLE) / count(value) OVER w{n}, 6) AS avg_{n}d" for n in (7, 30))
_FRAMES = ", ".join(f"w{n} AS (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts))::BIGINT RANGE BETWEEN {n * 86400} PRECEDING AND CURRENT ROW)" for n in (7, 30))


@query("rolling_range_agg", f"SELECT event_id, user_id, {_ROLLING} FROM events WINDOW {_FRAMES}")
def rolling_range_agg(spark, d):
    out = t(spark, d, "events")
    for days in (7, 30):
        out = statistics.rolling(out, "user_id", "ts", dec("value", 4), days)
    frames = [c for n in (7, 30) for c in (F.col(f"sum_{n}d").cast("double").alias(f"sum_{n}d"), F.col(f"count_{n}d"), F.round(f"avg_{n}d", 6).alias(f"avg_{n}d"))]
    return out.select("event_id", "user_id", *frames)


@query("latest_n_runs", "SELECT user_id, event_id, CAST(k AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 3")
def latest_n_runs(spark, d):
    return joins.newest(t(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 3).select("user_id", "event_id", "place")


class _Constant(models.Model):
    """A model that has nothing to learn."""

    def save(self, path):
        pass


def _registry(spark) -> models.ModelRegistry:
    """Three versions: the first two were promoted to production, one after the other."""
    store = models.ModelRegistry(shared_folder(spark, "registry"))
    for accuracy in (0.8, 0.9, 0.7):
        store.register("use", "model", _Constant(), {"accuracy": accuracy})
    for version in ("1.0.0", "1.0.1"):
        store.promote("use", "model", version, "production", {"min_accuracy": 0.75})
    return store


@query("active_version", "SELECT * FROM (VALUES ('1.0.0', 'archived', false), ('1.0.1', 'production', true), ('1.0.2', 'development', false)) v(version, stage, active)")
def active_version(spark, d):
    """The registry's versions and which one is current: the last promoted of those in production."""
    rows = _registry(spark).versions(spark, "use", "model")
    newest = F.max_by(F.when(F.col("stage") == "production", F.col("version")), F.when(F.col("stage") == "production", F.col("promoted_to_prod"))).over(Window.partitionBy())
    return rows.select("version", "stage", (F.col("version") == newest).alias("active"))


@query("topk_preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk_preview(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20)


@query("sql_rank", "SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS INTEGER) AS place, CAST(ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS quarter FROM customer")
def sql_rank(spark, d):
    return t(spark, d, "customer").selectExpr("c_custkey", "rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS place", "ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS quarter")


@query("sql_lag", "SELECT conv_id, turn, role, lag(role) OVER w AS previous_role, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def sql_lag(spark, d):
    return t(spark, d, "conversations").selectExpr("conv_id", "turn", "role", "lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_role", "lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role")


@query("sql_rows_frame", "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS last_three FROM orders")
def sql_rows_frame(spark, d):
    return t(spark, d, "orders").selectExpr("o_orderkey", "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS last_three")


@query("sql_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS all_flags FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def sql_rollup(spark, d):
    return t(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping("l_returnflag").cast("long").alias("all_flags"))


@query("sql_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def sql_cube(spark, d):
    return t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("sql_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))")
def sql_grouping_sets(spark, d):
    return spark.sql("SELECT l_returnflag, l_linestatus, count(*) AS n FROM {li} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))", li=t(spark, d, "lineitem"))


@query("sql_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def sql_count_distinct(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("sql_count_approx", "SELECT event_type, true AS close FROM events GROUP BY event_type")
def sql_count_approx(spark, d):
    """Whether the approximate number of users is within a tenth of the exact one, twice its deviation."""
    counts = t(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.05).alias("a"), F.count_distinct("user_id").alias("n"))
    return counts.select("event_type", (F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("close"))


@query("sql_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def sql_having(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 12")


@query("sql_union_all", "SELECT c_nationkey AS nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def sql_union_all(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")).unionByName(t(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey")))


_FEW = "SELECT s_nationkey FROM supplier WHERE s_nationkey % 3 = 0"


@query("sql_intersect", f"SELECT c_nationkey AS nationkey FROM customer INTERSECT {_FEW}")
def sql_intersect(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")).intersect(t(spark, d, "supplier").filter("s_nationkey % 3 = 0").select("s_nationkey"))


@query("sql_except", f"SELECT c_nationkey AS nationkey FROM customer EXCEPT {_FEW}")
def sql_except(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")).subtract(t(spark, d, "supplier").filter("s_nationkey % 3 = 0").select("s_nationkey"))


# --- functions ---------------------------------------------------------------------------

@query("vector_topk", """
    WITH q AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(raw, 6) AS similarity FROM (SELECT vec_id, list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), e) AS raw FROM embeddings, q ORDER BY raw DESC, vec_id LIMIT 10)""")
def vector_topk(spark, d):
    e = t(spark, d, "embeddings")
    return statistics.most_similar(e, "vec_id", "embedding", e.filter("vec_id = 0").first()["embedding"], 10)


@query("explode_arrays", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(CAST(embedding[i] AS DOUBLE), 6) AS x FROM embeddings, range(1, 65) r(i)")
def explode_arrays(spark, d):
    return t(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", "pos", F.round(F.col("x").cast("double"), 6).alias("x"))


@query("arrays_zip_explode", "SELECT vec_id, CAST(i AS INTEGER) AS k, round(CAST(embedding[i] AS DOUBLE), 6) AS x FROM embeddings, range(1, 65) r(i)")
def arrays_zip_explode(spark, d):
    z = F.arrays_zip(F.sequence(F.lit(1), F.size("embedding")).alias("k"), F.col("embedding").alias("x"))
    return t(spark, d, "embeddings").select("vec_id", F.inline(z).alias("k", "x")).select("vec_id", "k", F.round(F.col("x").cast("double"), 6).alias("x"))


@query("json_extract", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_extract(spark, d):
    return t(spark, d, "events").select(F.from_json("props", "k bigint").alias("p")).select("p.*").groupBy("k").agg(F.count("*").alias("n"))


@query("flatten_json", "SELECT c_custkey AS id, c_name AS person_name, c_nationkey AS person_home_nation, c_acctbal AS person_home_balance FROM customer")
def flatten_json(spark, d):
    """Nested records, as an API gives them, to flat columns."""
    home = F.struct(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    record = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("name"), home.alias("home")).alias("person")))
    kind = "id bigint, person struct<name: string, home: struct<nation: int, balance: double>>"
    return cleaning.flatten_structs(t(spark, d, "customer").select(F.from_json(record, kind).alias("r")).select("r.*"))


@query("rest_json_schema", "SELECT c_custkey AS id, c_name AS name, TIMESTAMP '2024-01-02 03:04:05' AS seen FROM customer")
def rest_json_schema(spark, d):
    record = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("2024-01-02 03:04:05").alias("seen")))
    ddl = rest.schema_ddl([{"name": "id", "type": "long"}, {"name": "name", "type": "str"}, {"name": "seen", "type": "timestamp_ntz"}])
    return t(spark, d, "customer").select(F.from_json(record, ddl).alias("r")).select("r.*")


@query("derive_date", "SELECT CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def derive_date(spark, d):
    return t(spark, d, "events").groupBy(F.to_date("ts").alias("day"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))


@query("html_to_text", r"""
    SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages""")
def html_to_text(spark, d):
    return t(spark, d, "pages").select("page_id", F.md5(text.html_to_text(F.col("html"))).alias("text_md5"))


@query("chunk_documents", r"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM documents)
    SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, md5(array_to_string(words[i * 448 + 1:i * 448 + 512], ' ')) AS text_md5 FROM w, unnest(range((len(words) - 1) // 448 + 1)) r(i) WHERE len(words) > 0""")
def chunk_documents(spark, d):
    return text.chunks(t(spark, d, "documents"), "doc_id", "text").select("doc_id", "chunk_index", F.md5("text").alias("text_md5"))


@query("embed_chunks")
def embed_chunks(spark, d):
    return text.embed(text.chunks(t(spark, d, "documents"), "doc_id", "text"), "text").drop("text")


@query("derive_round", "SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(18,4)), 1) AS DOUBLE) AS about, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.15 AS DECIMAL(4,2)) AS DOUBLE) AS tax FROM orders")
def derive_round(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.round(dec("o_totalprice", 4), 1).cast("double").alias("about"), (dec("o_totalprice") * F.lit("0.15").cast("decimal(4,2)")).cast("double").alias("tax"))


@query("map_of_columns", "SELECT c_custkey, c_mktsegment AS segment, 2 AS entries, NULL AS absent FROM customer")
def map_of_columns(spark, d):
    made = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"))
    return t(spark, d, "customer").select("c_custkey", made.alias("m")).select("c_custkey", F.try_element_at("m", F.lit("segment")).alias("segment"), F.size("m").alias("entries"), F.try_element_at("m", F.lit("none")).alias("absent"))


@query("recent_window", "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-24 00:00:00' AND ts <= TIMESTAMP '2024-01-31 00:00:00'")
def recent_window(spark, d):
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return t(spark, d, "events").filter((F.col("ts") > F.lit("2024-01-24 00:00:00").cast("timestamp_ntz")) & (F.col("ts") <= as_of)).select("event_id", "ts")


@query("to_json_payload", "SELECT c_custkey, CAST(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_mktsegment': c_mktsegment}) AS VARCHAR) AS record FROM customer")
def to_json_payload(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.to_json(F.struct("c_custkey", "c_name", "c_mktsegment")).alias("record"))


def _schema_sql(table: str) -> str:
    """The fingerprint of the schema that DuckDB itself reads; a column of a file is always nullable."""
    kind = "replace(replace(replace(replace(lower(column_type), 'varchar', 'string'), 'integer', 'int'), 'timestamp', 'timestamp_ntz'), 'float[]', 'array<float>')"
    each = f"""'["' || column_name || '", "' || {kind} || '", true]'"""
    return f"SELECT '{table}' AS table_name, sha256('[' || string_agg({each}, ', ' ORDER BY place) || ']') AS schema_hash FROM (SELECT *, row_number() OVER () AS place FROM (DESCRIBE {table}))"


@query("schema_fingerprint", " UNION ALL ".join(map(_schema_sql, TABLES)))
def schema_fingerprint(spark, d):
    return spark.createDataFrame([(n, fingerprints.schema_fingerprint(t(spark, d, n))) for n in TABLES], "table_name string, schema_hash string")


@query("data_fingerprint", "SELECT count(*) AS row_count, CAST(sum(CAST('0x' || substr(md5(CAST(n_nationkey AS VARCHAR) || chr(31) || n_name || chr(31) || CAST(n_regionkey AS VARCHAR)), 1, 8) AS BIGINT)) AS BIGINT) AS row_sum FROM nation")
def data_fingerprint(spark, d):
    n = t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return n.agg(*fingerprints.table_fingerprint_columns(n))


@query("row_sha256", "SELECT c_custkey, sha256(c_name) AS name_sha256 FROM customer")
def row_sha256(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.sha2("c_name", 256).alias("name_sha256"))


@query("gate_eval", "SELECT * FROM (VALUES ('min_accuracy', true, CAST(0.91 AS DOUBLE)), ('max_loss', false, 0.4), ('min_auc', false, NULL)) g(gate, passed, actual)")
def gate_eval(spark, d):
    rows = models.evaluate_gates({"min_accuracy": 0.9, "max_loss": 0.3, "min_auc": 0.5, "require_drift_check": False}, {"accuracy": 0.91, "loss": 0.4})
    return spark.createDataFrame([r[:3] for r in rows], "gate string, passed boolean, actual double")


# --- sources and sinks -------------------------------------------------------------------

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def _staged(kind: str, **read):
    def run(spark, d):
        path = shared_folder(spark, f"src-{kind}")
        options = {"header": "true"} if kind == "csv" else {}
        writers.write_path(t(spark, d, "customer"), {"path": path, "file_format": kind, "options": options})
        return readers.read_path(spark, {"path": path, "file_format": kind, "options": options | read.get("options", {}), "schema": read.get("schema")})

    return run


query("src_parquet", "SELECT * FROM customer")(lambda spark, d: readers.read_path(spark, {"path": f"{d}/customer.parquet"}))
query("src_csv_schema", "SELECT * FROM customer")(_staged("csv", schema=CUSTOMER, options={"mode": "FAILFAST"}))
query("src_csv_infer", "SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")(_staged("csv", options={"inferSchema": "true"}))
query("src_json", "SELECT * FROM customer")(_staged("json", schema=CUSTOMER))
query("src_orc", "SELECT * FROM customer")(_staged("orc"))
query("sink_parquet_roundtrip", "SELECT * FROM customer")(_staged("parquet"))
query("sink_csv_roundtrip", "SELECT * FROM customer")(_staged("csv", schema=CUSTOMER))


@query("sink_json_roundtrip", "SELECT * FROM customer WHERE c_acctbal > 0 UNION ALL SELECT * FROM customer WHERE c_acctbal <= 0")
def sink_json_roundtrip(spark, d):
    """Overwritten, then appended to."""
    path, c = shared_folder(spark, "sink-json"), t(spark, d, "customer")
    for rows, mode in ((c, "overwrite"), (c.filter("c_acctbal > 0"), "overwrite"), (c.filter("c_acctbal <= 0"), "append")):
        writers.write_path(rows, {"path": path, "file_format": "json", "mode": mode, "options": {"compression": "gzip"}})
    return readers.read_path(spark, {"path": path, "file_format": "json", "schema": CUSTOMER})


def _table(spark, df, **cfg) -> str:
    """A catalog table of its own, its files in the shared folder."""
    name = f"t_{os.urandom(6).hex()}"
    writers.write_table(df, {"table": name, "options": {"path": shared_folder(spark, name)}, **cfg})
    return name


@query("src_catalog_table", "SELECT * FROM nation")
def src_catalog_table(spark, d):
    return readers.read_table(spark, {"db_name": "default", "tbl_name": _table(spark, t(spark, d, "nation"))})


@query("src_catalog_3part", "SELECT * FROM nation")
def src_catalog_3part(spark, d):
    return readers.read_table(spark, {"catalog": "spark_catalog", "schema": "default", "tbl_name": _table(spark, t(spark, d, "nation"))})


@query("src_sql", "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey >= 3 GROUP BY n_regionkey")
def src_sql(spark, d):
    name = _table(spark, t(spark, d, "nation"))
    return readers.read_table(spark, {"sql": f"SELECT n_regionkey, count(*) AS n FROM {name} WHERE n_nationkey >= :least GROUP BY n_regionkey", "args": {"least": 3}})


def _derby(spark, d) -> dict:
    """Customers in an embedded database of the driver."""
    cfg = {"url": embedded.new_database(), "table": "customer", "driver": embedded.DRIVER}
    writers.write_jdbc(t(spark, d, "customer"), {**cfg, "mode": "overwrite", "options": {"createTableColumnTypes": "c_name varchar(100), c_mktsegment varchar(30)", "batchsize": "1000"}})
    return cfg


def _lower(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.lower() for c in df.columns))


@query("src_jdbc_table", "SELECT * FROM customer")
def src_jdbc_table(spark, d):
    return _lower(readers.read_jdbc(spark, embedded.published(spark, _derby(spark, d))))


@query("sink_jdbc_roundtrip", "SELECT * FROM customer UNION ALL SELECT -c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal < 0")
def sink_jdbc_roundtrip(spark, d):
    cfg = _derby(spark, d)
    writers.write_jdbc(t(spark, d, "customer").filter("c_acctbal < 0").withColumn("c_custkey", -F.col("c_custkey")), {**cfg, "mode": "append"})
    return _lower(readers.read_jdbc(spark, embedded.published(spark, cfg)))


@query("src_jdbc_query", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0")
def src_jdbc_query(spark, d):
    cfg = embedded.published(spark, _derby(spark, d))
    return _lower(readers.read_jdbc(spark, {**cfg, "table": None, "sql": 'SELECT "c_custkey", "c_name" FROM customer WHERE "c_acctbal" > 0'}))


@query("src_jdbc_partitioned", "SELECT * FROM customer")
def src_jdbc_partitioned(spark, d):
    return _lower(readers.read_jdbc(spark, {**embedded.published(spark, _derby(spark, d)), "partitionColumn": '"c_custkey"', "lowerBound": 1, "upperBound": 1000, "numPartitions": 4}))


def _files(spark, d) -> str:
    path = shared_folder(spark, "src-binary")
    t(spark, d, "nation").orderBy("n_nationkey").coalesce(1).write.option("header", True).csv(path)
    return path


_FILE = """
    WITH f AS (SELECT 'n_nationkey,n_name,n_regionkey' || chr(10) || string_agg(n_nationkey || ',' || n_name || ',' || n_regionkey || chr(10), '' ORDER BY n_nationkey) AS body FROM nation)
    SELECT CAST(octet_length(encode(body)) AS BIGINT) AS length, sha256(body) AS sha256 FROM f"""


@query("src_binary", _FILE)
def src_binary(spark, d):
    return readers.read_binary(spark, {"path": _files(spark, d), "options": {"pathGlobFilter": "*.csv"}}).select("length", F.sha2("content", 256).alias("sha256"))


@query("file_sha256", _FILE)
def file_sha256(spark, d):
    return fingerprints.file_fingerprints(spark, _files(spark, d)).filter("path like '%.csv'").select("length", "sha256")


@query("sink_table_overwrite", "SELECT * FROM nation WHERE n_regionkey = 1")
def sink_table_overwrite(spark, d):
    n = t(spark, d, "nation")
    name = _table(spark, n, comment="it's a test", properties={"steward": "o'neil"})
    writers.write_table(n.filter("n_regionkey = 1"), {"table": name, "mode": "overwrite"})
    return spark.table(name)


@query("sink_table_properties", "SELECT * FROM (VALUES ('comment', 'it''s a test'), ('steward', 'o''neil')) p(key, value)")
def sink_table_properties(spark, d):
    """A table's comment and properties, as read back from the catalog."""
    name = _table(spark, t(spark, d, "nation"), comment="it's a test", properties={"steward": "o'neil"})
    comment = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Comment'").select(F.lit("comment").alias("key"), F.col("data_type").alias("value"))
    return comment.unionByName(spark.sql(f"SHOW TBLPROPERTIES {name}").filter("key = 'steward'").select("key", "value"))


@query("sink_partitioned", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sink_partitioned(spark, d):
    return spark.table(_table(spark, t(spark, d, "nation"), partitionBy=["n_regionkey"])).select("n_nationkey", "n_name", "n_regionkey")


@query("sink_dynamic_overwrite", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS n_name, n_regionkey FROM nation")
def sink_dynamic_overwrite(spark, d):
    path, n = shared_folder(spark, "sink-dynamic"), t(spark, d, "nation")
    writers.write_path(n, {"path": path, "partitionBy": "n_regionkey"})
    changed = n.filter("n_regionkey = 1").withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!")))
    writers.write_path(changed, {"path": path, "partitionBy": "n_regionkey", "partition_overwrite": "dynamic"})
    return spark.read.schema("n_nationkey int, n_name string, n_regionkey int").parquet(path).select("n_nationkey", "n_name", "n_regionkey")


@query("sink_append", "SELECT * FROM region UNION ALL SELECT * FROM region")
def sink_append(spark, d):
    path, r = shared_folder(spark, "sink-append"), t(spark, d, "region")
    for _ in range(2):
        writers.write_path(r, {"path": path, "mode": "append"})
    return spark.read.parquet(path)


@query("sink_ignore", "SELECT * FROM region")
def sink_ignore(spark, d):
    path, r = shared_folder(spark, "sink-ignore"), t(spark, d, "region")
    writers.write_path(r, {"path": path, "mode": "error"})
    writers.write_path(r.limit(1), {"path": path, "mode": "ignore"})
    return spark.read.parquet(path)


@query("sink_compact", "SELECT * FROM customer")
def sink_compact(spark, d):
    path = shared_folder(spark, "sink-compact")
    writers.compact(t(spark, d, "customer"), path, ["c_nationkey"], 4)
    return spark.read.parquet(path)


@query("sink_merge_upsert", """
    SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 10 = 0 THEN -1.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer
    UNION ALL SELECT -c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey BETWEEN 1 AND 5""")
def sink_merge_upsert(spark, d):
    path, c = shared_folder(spark, "sink-merge"), t(spark, d, "customer")
    writers.write_path(c, {"path": path})
    changed = c.filter("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(-1.0))
    fresh = c.filter("c_custkey between 1 and 5").withColumn("c_custkey", -F.col("c_custkey"))
    writers.write_path(changed.unionByName(fresh), {"path": path, "mode": "merge", "merge_keys": ["c_custkey"]})
    return spark.read.schema(CUSTOMER).parquet(path)


@query("sink_delta_merge", """
    SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation
    UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 2""")
def sink_delta_merge(spark, d):
    cfg, n = {"path": shared_folder(spark, "sink-delta")}, t(spark, d, "nation")
    writers.write_delta(n, cfg)
    fresh = n.filter("n_regionkey = 2").withColumn("n_nationkey", (F.col("n_nationkey") + 100).cast(n.schema["n_nationkey"].dataType))
    writers.write_delta(n.filter("n_regionkey = 1").withColumn("n_name", F.upper("n_name")).unionByName(fresh), {**cfg, "mode": "merge", "merge_keys": ["n_nationkey"]})
    return readers.read_delta(spark, cfg)


# --- models and streams ------------------------------------------------------------------

def _examples(spark, d):
    return t(spark, d, "labels").select("doc_id", "quality").join(t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", F.length(F.regexp_replace("text", "[a-z ]", "")).alias("n_odd")), "doc_id")


_FOREST = {"numbers": ["n_chars", "n_odd"], "categories": ["lang"], "label": "quality", "trees": 10, "depth": 5, "key": "doc_id"}


@query("ml_train_metrics")
def ml_train_metrics(spark, d):
    params = {"action": "train", "model_params": _FOREST, "output_name": "metrics"}
    return transforms.model({"rows": _examples(spark, d)}, params)["metrics"]


@query("ml_predict")
def ml_predict(spark, d):
    path = shared_folder(spark, "model")
    rows = _examples(spark, d)
    transforms.model({"rows": rows}, {"action": "train", "model_params": _FOREST, "model_path": path})
    return transforms.model({"rows": rows}, {"action": "predict", "model_path": path})["model_output"].select("doc_id", "prediction", "proba", "model_version", "model_stage")


@query("ml_batch_score", "SELECT doc_id, n_chars, CAST(1 AS DOUBLE) / (1 + n_chars) AS score FROM documents")
def ml_batch_score(spark, d):
    return models.batch_score(t(spark, d, "documents").select("doc_id", "n_chars"), ["n_chars"], lambda p: 1.0 / (1.0 + p["n_chars"]))


@query("stream_tumbling_count", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_count(spark, d):
    src = shared_folder(spark, "stream-in")
    e = t(spark, d, "events").select("ts", "event_type")
    e.write.parquet(src)
    rows = windows.read_stream(spark, src, "ts timestamp_ntz, event_type string")
    out = windows.complete_result(windows.tumbling_count(rows, "ts", ["event_type"]), shared_folder(spark, "stream-out"), shared_folder(spark, "stream-state"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("stream_append_sink", "SELECT event_id, event_type FROM events")
def stream_append_sink(spark, d):
    """What has arrived is appended and the run ends; a second run finds nothing new."""
    src, out, state = (shared_folder(spark, f"stream-{x}") for x in ("src", "sink", "offsets"))
    t(spark, d, "events").select("event_id", "event_type").repartition(3).write.parquet(src)
    for _ in range(2):
        rows = windows.read_stream(spark, src, "event_id bigint, event_type string", files_per_trigger=1)
        windows.write_available(rows, out, state).awaitTermination()
    return spark.read.schema("event_id bigint, event_type string").parquet(out)


@query("session_windows", """
    WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    numbered AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM marked)
    SELECT min(ts) AS session_start, user_id, count(*) AS n FROM numbered GROUP BY user_id, k""")
def session_windows(spark, d):
    return windows.sessions(t(spark, d, "events"), "ts", ["user_id"], gap="6 hours").withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query("src_rest_offset", "SELECT * FROM nation")
def src_rest_offset(spark, d):
    """Nations through a local server, in pages; for local sessions."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlparse

    rows = [r.asDict() for r in t(spark, d, "nation").orderBy("n_nationkey").collect()]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            at = int(parse_qs(urlparse(self.path).query).get("offset", ["0"])[0])
            body = json.dumps({"data": rows[at : at + 10]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        paging = {"type": "offset", "page_size": 10, "max_pages": 5}
        df = readers.read_rest(spark, {"url": f"http://127.0.0.1:{server.server_port}/", "root_key": "data", "pagination": paging, "schema": "n_nationkey int, n_name string, n_regionkey int"})
        path = shared_folder(spark, "rest")
        df.write.parquet(path)
    finally:
        server.shutdown()
    return spark.read.schema(df.schema).parquet(path)
