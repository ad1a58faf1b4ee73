"""Queries over rows in an order: prefix scans, numbering, slices of equal cost, edit scripts, as-of and interval joins, order statistics."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import edits, loops, quantiles, scans, temporal
from ..operators.scans import Scan
from ..operators.vector import PositionalVector
from ..sources.frame import KEY, IndexedFrame
from .catalogue import T, _own, _query, _table
from .schedule import Weighted

SLICES = 16


@_query("SELECT event_id, round(sum(value) OVER w, 2) AS total, max(value) OVER w AS top, lag(ts) OVER w AS before, last_value(event_type) OVER w AS latest, count(*) OVER w AS n FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def scan_events(spark, sf_dir):
    made = scans.scan(_table(spark, sf_dir, "events"), ["ts", "event_id"], total=Scan("sum", "value"), top=Scan("max", "value"), before=Scan("lag", "ts"), latest=Scan("last", "event_type"), n=Scan("count"))
    return made.select("event_id", F.round("total", 2).alias("total"), "top", "before", "latest", "n")


@_query("SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS total, max(o_totalprice) OVER w AS top, lag(o_orderdate) OVER w AS before, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def scan_orders_by_customer(spark, sf_dir):
    made = scans.scan(_table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], ["o_custkey"], total=Scan("sum", "o_totalprice"), top=Scan("max", "o_totalprice"), before=Scan("lag", "o_orderdate"), n=Scan("count"))
    return made.select("o_orderkey", F.round("total", 2).alias("total"), "top", "before", "n")


@_query("SELECT event_id, round(sum(value) OVER w, 2) AS total, lag(user_id) OVER w AS before, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def scan_events_by_type(spark, sf_dir):
    """Very few groups, so each is cut into many ranges."""
    made = scans.scan(_table(spark, sf_dir, "events"), ["ts", "event_id"], ["event_type"], total=Scan("sum", "value"), before=Scan("lag", "user_id"), n=Scan("count"))
    return made.select("event_id", F.round("total", 2).alias("total"), "before", "n")


#: What leaks from the bucket of ``scan_bucket`` at each event.
LEAK = 10.0


def _bucket_step(state: list[float] | None, rows: pd.DataFrame) -> list[list[float]]:
    """An event maps a level x to max(0, x + value - LEAK); any number of them to max(a, x + b), so (a, b) is what the fold has."""
    total = np.cumsum(rows["value"].to_numpy() - LEAK)
    here = np.stack([total - np.minimum.accumulate(total), total], axis=1)
    if state is not None:
        here = np.stack([np.maximum(here[:, 0], state[0] + here[:, 1]), state[1] + here[:, 1]], axis=1)
    return here.tolist()


def _bucket_combine(a: list[float], b: list[float]) -> list[float]:
    return [max(b[0], a[0] + b[1]), a[1] + b[1]]


@_query(f"WITH s AS (SELECT event_id, sum(value - {LEAK}) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s, ts FROM events) SELECT event_id, round(s - least(0, min(s) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), 2) + 0 AS level FROM s")
def scan_bucket(spark, sf_dir):
    """The level of a leaking bucket after each event: an associative fold of Python's."""
    made = scans.scan_python(_table(spark, sf_dir, "events").select("event_id", "ts", "value"), ["ts", "event_id"], "fold", "array<double>", _bucket_step, _bucket_combine)
    return made.select("event_id", (F.round(F.greatest(F.col("fold")[0], F.col("fold")[1]), 2) + 0).alias("level"))


_LINE = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@_query(f"SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, {_LINE}) - 1 AS task_index, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem")
def numbered_lineitem(spark, sf_dir):
    made = scans.numbered(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
    return made.select(KEY, "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@_query(f"WITH t AS (SELECT row_number() OVER (ORDER BY conv_id, turn, role, text) - 1 AS i, strlen(text) AS size FROM conversations) SELECT {_own('i', 'n', T)} AS thread_index, min(i) AS first, count(*) AS count, CAST(sum(size) AS BIGINT) AS bytes FROM t, (SELECT count(*) n FROM t) GROUP BY 1")
def unkeyed_slices(spark, sf_dir):
    """Slices of a table without a dense key."""
    frame = IndexedFrame.from_ordered(_table(spark, sf_dir, "conversations"), ["conv_id", "turn"])
    return loops.for_slices(frame, F.sum(F.octet_length("text")).cast("long").alias("bytes"))


def _cost_sql(table: str, order: str, cost: str, first: str) -> str:
    return f"""
WITH t AS (SELECT {first} AS first, {cost} AS c, {order} FROM {table}), s AS (SELECT sum(c) AS total FROM t),
u AS (SELECT *, sum(c) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) - c AS begins FROM t),
v AS (SELECT *, least((CAST(begins AS HUGEINT) * {SLICES}) // CAST(total AS HUGEINT), {SLICES - 1}) * 2 + CAST(c * {SLICES} >= total AS INT) AS raw FROM u, s),
w AS (SELECT *, dense_rank() OVER (ORDER BY raw) - 1 AS slice_index FROM v)
SELECT slice_index, count(*) AS items, CAST(sum(c) AS BIGINT) AS cost, min(first) AS first, max(first) AS last FROM w GROUP BY 1
"""


def _by_slice(made: DataFrame, cost, first: str) -> DataFrame:
    return made.groupBy("slice_index").agg(F.count("*").alias("items"), F.sum(cost).cast("long").alias("cost"), F.min(first).alias("first"), F.max(first).alias("last"))


@_query(_cost_sql("documents", "doc_id", "coalesce(strlen(text), 0)", "doc_id"))
def cost_slices_documents(spark, sf_dir):
    """Contiguous slices of documents with equal numbers of bytes."""
    size = F.octet_length("text").cast("long")
    return _by_slice(scans.cost_slices(_table(spark, sf_dir, "documents"), ["doc_id"], size, SLICES), size, "doc_id")


@_query(_cost_sql("lineitem", f"l_orderkey, l_linenumber, {_LINE}", "CAST(l_quantity AS BIGINT)", "l_orderkey"))
def cost_slices_lineitem(spark, sf_dir):
    size = F.col("l_quantity").cast("long")
    order = ["l_orderkey", "l_linenumber", *_LINE.split(", ")]
    return _by_slice(scans.cost_slices(_table(spark, sf_dir, "lineitem"), order, size, SLICES), size, "l_orderkey")


@_query("SELECT row_number() OVER (ORDER BY doc_id, text) - 1 AS task_index, doc_id, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) AS BIGINT) AS value FROM documents")
def map_weighted(spark, sf_dir):
    """An opaque function over rows that are placed by what they cost."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    placed = IndexedFrame.from_ordered(docs, ["doc_id"]).with_schedule(Weighted(T, F.octet_length("text"))).place()
    return placed.map_python(lambda rows: pd.DataFrame({KEY: rows[KEY], "doc_id": rows["doc_id"], "value": rows["text"].str.count(" ").astype("int64")}), f"{KEY} long, doc_id long, value long").df


#: Edits of the script that ``edit_script`` plays.
EDITS = 10_000


def script(length: int, edits_: int = EDITS, seed: int = 7) -> list[edits.Edit]:
    """A fixed script of insertions, removals, moves and overwrites all over a vector of ``length``."""
    rng, out = random.Random(seed), []
    for k in range(edits_):
        kind = rng.choice(("insert", "remove", "move", "set")) if length > 1 else "insert"
        at = rng.randrange(length + (kind == "insert"))
        out.append(edits.Edit(kind, at, -k, rng.randrange(length) if kind == "move" else 0))
        length += {"insert": 1, "remove": -1}.get(kind, 0)
    return out


@_query()
def edit_script(spark, sf_dir):
    """All orders after ten thousand edits, in one pass. SQL has no such script; a test plays it on a list."""
    vector = PositionalVector.from_table(_table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey")
    return edits.edited(vector, script(len(vector))).df


@_query("SELECT e.event_id, p.event_id AS purchase, p.value AS paid FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts > p.ts")
def asof_purchase(spark, sf_dir):
    """Each event with its user's last purchase before it."""
    events = _table(spark, sf_dir, "events")
    bought = events.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"), F.col("event_id").alias("purchase"), F.col("value").alias("paid"))
    asked = events.select("event_id", "user_id", "ts")
    return temporal.asof_join(asked, bought, ("ts", "bought"), ["user_id"], ["purchase", "paid"], ties=["purchase"], strict=True).select("event_id", "purchase", "paid")


@_query("SELECT e.event_id, p.event_id AS error FROM events e ASOF JOIN (SELECT * FROM events WHERE event_type = 'error') p ON e.ts >= p.ts")
def asof_error(spark, sf_dir):
    """Each event with the last error of anyone, itself included: no key, so one order over all rows."""
    events = _table(spark, sf_dir, "events")
    errors = events.filter("event_type = 'error'").select(F.col("ts").alias("at"), F.col("event_id").alias("error"))
    return temporal.asof_join(events.select("event_id", "ts"), errors, ("ts", "at"), (), ["error"], ties=["error"], how="inner").select("event_id", "error")


def _orders_until(spark, sf_dir, days: int) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", "o_orderdate", (F.col("o_orderdate") + F.expr(f"INTERVAL {days} DAYS")).alias("until"))


@_query("SELECT o_orderkey, l_linenumber, l_partkey, l_shipdate FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 60 DAYS")
def interval_shipments(spark, sf_dir):
    """Orders with those of their lines that were shipped within sixty days."""
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_shipdate")
    return temporal.interval_join(_orders_until(spark, sf_dir, 60), lines, ("o_orderdate", "until"), "l_shipdate", ["o_orderkey"]).select("o_orderkey", "l_linenumber", "l_partkey", "l_shipdate")


@_query("SELECT a.event_id AS error, b.event_id FROM events a JOIN events b ON a.event_type = 'error' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR")
def interval_after_error(spark, sf_dir):
    """Everyone's events within an hour of each error."""
    events = _table(spark, sf_dir, "events")
    spans = events.filter("event_type = 'error'").select(F.col("event_id").alias("error"), F.col("ts").alias("since"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("until"))
    return temporal.interval_join(spans, events.select("event_id", "ts"), ("since", "until"), "ts").select("error", "event_id")


@_query("WITH d AS (SELECT l_shipdate, sum(count(*)) OVER (ORDER BY l_shipdate) AS upto FROM lineitem GROUP BY 1), a AS (SELECT o_orderkey, coalesce(upto, 0) AS n FROM orders ASOF LEFT JOIN d ON o_orderdate > l_shipdate), b AS (SELECT o_orderkey, coalesce(upto, 0) AS n FROM orders ASOF LEFT JOIN d ON o_orderdate + INTERVAL 30 DAYS >= l_shipdate) SELECT o_orderkey, CAST(b.n - a.n AS BIGINT) AS shipped FROM a JOIN b USING (o_orderkey)")
def interval_counts(spark, sf_dir):
    """How many lines of any order were shipped in the month after each order: pairs beyond number, counted and not made."""
    lines = _table(spark, sf_dir, "lineitem").select("l_shipdate")
    return temporal.interval_counts(_orders_until(spark, sf_dir, 30), lines, ("o_orderdate", "until"), "l_shipdate", name="shipped").select("o_orderkey", "shipped")


_AT = (0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0)


@_query("SELECT l_returnflag, CAST(q AS DOUBLE) AS quantile, round(v, 4) AS value FROM (SELECT l_returnflag, unnest([" + ", ".join(map(str, _AT)) + "]) AS q, unnest(quantile_cont(l_extendedprice, [" + ", ".join(map(str, _AT)) + "])) AS v FROM lineitem GROUP BY l_returnflag)")
def quantiles_by_flag(spark, sf_dir):
    made = quantiles.quantiles(_table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", _AT)
    return made.withColumn("value", F.round("value", 4))


@_query("SELECT CAST(q AS DOUBLE) AS quantile, v AS value FROM (SELECT unnest([0.1, 0.5, 0.75]) AS q, unnest(quantile_disc(value, [0.1, 0.5, 0.75])) AS v FROM events)")
def quantiles_of_events(spark, sf_dir):
    return quantiles.quantiles(_table(spark, sf_dir, "events"), [], "value", (0.1, 0.5, 0.75), interpolate=False)


@_query("SELECT DISTINCT o_totalprice AS value, below, upto FROM (SELECT *, rank() OVER (ORDER BY o_totalprice) - 1 AS below, CAST(count(*) OVER (ORDER BY o_totalprice) AS BIGINT) AS upto FROM orders) WHERE o_orderpriority = '1-URGENT'")
def ranks_of_urgent(spark, sf_dir):
    """Where the prices of urgent orders stand among those of all orders."""
    orders = _table(spark, sf_dir, "orders")
    return quantiles.ranks_of(orders, "o_totalprice", orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_totalprice").alias("value")))
