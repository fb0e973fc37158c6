"""Models over the test tables, queries that use every operator on them, and the same results in SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import date, datetime

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import SemanticsError
from .operators import cleaners
from .plans import audit, bind
from .plans.modelload import models_from
from .plans.scope import Scope, all_, context, last, not_
from .plans.slices import BoundModel
from .sources import csvfile
from .sources.config import TableSpec
from .sources.store import Store
from .streaming.land import spooled

MODELS = """
dimensions:
  supplier: {table: supplier, key_column: s_suppkey, attributes: {name: s_name, nation: s_nationkey}, hierarchy: [name, nation]}
  part: {table: part, key_column: p_partkey, attributes: {brand: p_brand, type: p_type, size: p_size}}
  customer: {table: customer, key_column: c_custkey, attributes: {segment: c_mktsegment, nation: c_nationkey}}
sales:
  fact: lineitem
  time: {column: l_shipdate}
  dimensions: {flag: l_returnflag, status: l_linestatus, supplier: {shared: l_suppkey}, part: {shared: l_partkey}}
  measures:
    lines: {expr: count(*), description: Lines shipped.}
    big_lines: {expr: count(*), where: l_quantity > 25, description: Lines of more than 25 pieces.}
    quantity: {expr: "cast(sum(cast(l_quantity as decimal(18,2))) as double)", description: Pieces shipped.}
    revenue: {expr: "cast(sum(cast(l_extendedprice as decimal(18,2))) as double)", description: Prices before discount.}
    orders: {expr: count(distinct l_orderkey), description: Orders shipped from.}
    big_share: {ratio: {num: count(*) FILTER (WHERE l_quantity > 25), den: count(*)}, description: Share of big lines.}
    returned: {expr: {sum: "case when l_returnflag = 'R' then cast(l_quantity as decimal(18,2)) end", nulls: propagate}, description: "Returned pieces, unknown if any line is not returned."}
ordering:
  fact: orders
  time: {column: o_orderdate}
  dimensions: {status: o_orderstatus, priority: o_orderpriority, customer: {shared: o_custkey}}
  measures:
    orders: {expr: count(*), description: Orders placed.}
    urgent: {expr: count(*), where: o_orderpriority = '1-URGENT', description: Urgent orders.}
    buyers: {expr: count(distinct o_custkey), description: Customers who ordered.}
    urgent_share: {ratio: {num: count(*) FILTER (WHERE o_orderpriority = '1-URGENT'), den: count(*)}, description: Share of urgent orders.}
    usual: {expr: mode(o_orderpriority), description: The most frequent priority.}
    least_price: {expr: min(o_totalprice), description: Least price.}
    greatest_price: {expr: max(o_totalprice), description: Greatest price.}
    middle: {expr: median(o_totalprice), description: Median price.}
census:
  fact: orders
  time: {column: o_orderdate, cadence: weekly}
  snapshot: true
  dimensions: {status: o_orderstatus, customer: {shared: o_custkey}}
  measures:
    waiting: {expr: count(*), description: Orders at the census.}
    buyers: {expr: count(distinct o_custkey), description: Customers at the census.}
    urgent_share: {ratio: {num: count(*) FILTER (WHERE o_orderpriority = '1-URGENT'), den: count(*)}, description: Share of urgent orders.}
    middle_price: {expr: median(o_totalprice), time_agg: none, description: Median price.}
activity:
  fact: events
  time: {column: ts}
  dimensions: {kind: event_type}
  measures:
    events: {expr: count(*), description: Events.}
    users: {expr: count(distinct user_id), description: Users seen.}
    value: {expr: "cast(sum(cast(value as decimal(18,4))) as double)", description: Sum of values.}
"""

MODEL = {start: models_from([("showcase", yaml.safe_load(MODELS))], start) for start in (1, 7)}


def bound(spark: SparkSession, sf_dir: str, name: str, fiscal_start: int = 7) -> BoundModel:
    """A model whose tables are the Parquet files of a folder."""
    return BoundModel(spark, MODEL[fiscal_start][name], lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"), check=False)


def plain(df: DataFrame) -> DataFrame:
    """Dots in column names become underscores."""
    return df.toDF(*[c.replace(".", "_") for c in df.columns])


def _slice(model: str, *measures: str, n: int | None = None, **request) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = bound(spark, sf_dir, model).slice(list(measures), **request)
        return plain((s.suppress(n) if n else s).df)

    return run


# ---- SQL pieces: written from the meaning of the operators, for DuckDB

GRAIN = {
    "day": "CAST({0} AS DATE)", "week": "CAST(date_trunc('week', {0}) AS DATE)", "month": "CAST(date_trunc('month', {0}) AS DATE)",
    "quarter": "CAST(date_trunc('quarter', {0}) AS DATE)", "year": "CAST(date_trunc('year', {0}) AS DATE)",
    "fy": "CAST(date_trunc('year', {0} - INTERVAL 6 MONTH) + INTERVAL 6 MONTH AS DATE)",
    "fy_quarter": "CAST(date_trunc('quarter', {0} - INTERVAL 6 MONTH) + INTERVAL 6 MONTH AS DATE)",
}
STEP = {"day": "1 DAY", "week": "7 DAY", "month": "1 MONTH", "quarter": "3 MONTH", "year": "12 MONTH", "fy": "12 MONTH", "fy_quarter": "3 MONTH"}
SHIP, ORDER = "l_shipdate", "o_orderdate"


def _g(grain: str, column: str) -> str:
    return GRAIN[grain].format(column)


def _lanes(select: str, table: str, column: str, grain: str, back: str, name: str, measure: str, where: str = "true", early: str = "true", key: str | None = None) -> str:
    k, on = (f", {key} AS k", " AND b.k IS NOT DISTINCT FROM c.k") if key else ("", "")
    lane = lambda cond: f"SELECT {_g(grain, column)} AS period{k}, {measure} AS v FROM {table} WHERE {cond} GROUP BY ALL"
    return f"WITH b AS ({lane(where)}), c AS ({lane(early)}) SELECT b.period{', b.k AS ' + key if key else ''}, b.v AS {select}, c.v AS {name} FROM b LEFT JOIN c ON c.period = CAST(b.period - INTERVAL {back} AS DATE){on}"


def _as_at(grain: str | None, body: str, filters: str = "true", key: str = "", window: str = "true") -> str:
    p = f"{_g(grain, ORDER)} AS period" if grain else "0 AS period"
    return f"WITH w AS (SELECT *, {p} FROM orders WHERE {window}), m AS (SELECT period, max(o_orderdate) AS at FROM w GROUP BY period) SELECT {'w.period, ' if grain else ''}{key}{body} FROM w JOIN m ON w.period = m.period AND w.o_orderdate = m.at WHERE {filters}" + (" GROUP BY ALL" if grain or key else "")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


REVENUE = "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)"
QUANTITY = "CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE)"
SHARE = "CAST(count(*) FILTER (WHERE l_quantity > 25) AS DOUBLE) / nullif(count(*), 0)"
URGENT = "CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS DOUBLE) / nullif(count(*), 0)"

_add(
    "flagship_sales_by_nation",
    _slice("sales", "revenue", "orders", "big_lines", "big_share", by="supplier.nation", grain="month"),
    f"SELECT {_g('month', SHIP)} AS period, s_nationkey AS supplier_nation, {REVENUE} AS revenue, count(DISTINCT l_orderkey) AS orders, count(*) FILTER (WHERE l_quantity > 25) AS big_lines, {SHARE} AS big_share FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL",
)
for _grain in GRAIN:
    _add(f"grain_{_grain}", _slice("sales", "lines", "quantity", by="flag", grain=_grain), f"SELECT {_g(_grain, SHIP)} AS period, l_returnflag AS flag, count(*) AS lines, {QUANTITY} AS quantity FROM lineitem GROUP BY ALL")
_add("measure_distinct_filtered_ratio", _slice("ordering", "orders", "urgent", "buyers", "urgent_share", by="status"), f"SELECT o_orderstatus AS status, count(*) AS orders, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(DISTINCT o_custkey) AS buyers, {URGENT} AS urgent_share FROM orders GROUP BY ALL")
_add("measure_sum_propagate", _slice("sales", "returned", by="flag"), "SELECT l_returnflag AS flag, CASE WHEN count(CASE WHEN l_returnflag = 'R' THEN l_quantity END) = count(*) THEN sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DECIMAL(18,2)) END) END AS returned FROM lineitem GROUP BY ALL")
_add("measure_global", _slice("sales", "lines", "revenue", "big_share"), f"SELECT count(*) AS lines, {REVENUE} AS revenue, {SHARE} AS big_share FROM lineitem")
_add("measure_global_empty", _slice("sales", "lines", "quantity", "big_share", context={"flag": "none such"}), f"SELECT count(*) AS lines, {QUANTITY} AS quantity, {SHARE} AS big_share FROM lineitem WHERE l_returnflag = 'none such'")
_CONTEXTS = {
    "eq": (Scope({"flag": "R"}), "l_returnflag = 'R'"),
    "in": (Scope({"supplier__nation": [1, 5, 9]}), "s_nationkey IN (1, 5, 9)"),
    "not": (Scope({"part__brand": not_("Brand#11")}), "p_brand IS DISTINCT FROM 'Brand#11'"),
    "between": (context({"part__size": {"between": [10, 20]}}), "p_size BETWEEN 10 AND 20"),
    "all": (Scope({"flag": all_(), "time": all_()}), "true"),
    "date_window": (Scope({"time": ("1996-02-10", "1997-03-05")}), "l_shipdate >= DATE '1996-02-10' AND l_shipdate < DATE '1997-03-06'"),
    "datetime_window": (Scope({"time": (datetime(1996, 2, 10, 6), datetime(1996, 8, 1, 0))}), "l_shipdate >= TIMESTAMP '1996-02-10 06:00:00' AND l_shipdate <= TIMESTAMP '1996-08-01 00:00:00'"),
    "last_months": (Scope({"time": last(3, "month")}), "l_shipdate >= (SELECT CAST(max(l_shipdate) AS DATE) - INTERVAL 3 MONTH + INTERVAL 1 DAY FROM lineitem)"),
    "miss_rule": (Scope({"customer__segment": "BUILDING", "status": "F"}), "l_linestatus = 'F'"),
}
for _name, (_scope, _where) in _CONTEXTS.items():
    _add(f"context_{_name}", _slice("sales", "lines", "revenue", by="status", context=_scope), f"SELECT l_linestatus AS status, count(*) AS lines, {REVENUE} AS revenue FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey WHERE {_where} GROUP BY ALL")
_add("dims_two_shared", _slice("sales", "lines", "orders", by=["supplier.nation", "part.brand"]), "SELECT s_nationkey AS supplier_nation, p_brand AS part_brand, count(*) AS lines, count(DISTINCT l_orderkey) AS orders FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL")
for _grain in GRAIN:
    _add(f"prior_{_grain}", _slice("sales", "lines", by="flag", grain=_grain, compare="prior"), _lanes("lines", "lineitem", SHIP, _grain, STEP[_grain], "lines_prior", "count(*)", key="flag").replace("flag AS k", "l_returnflag AS k"))
for _grain in ("day", "month", "quarter", "year", "fy", "fy_quarter"):
    _add(f"yoy_{_grain}", _slice("ordering", "orders", grain=_grain, compare="yoy"), _lanes("orders", "orders", ORDER, _grain, "12 MONTH", "orders_yoy", "count(*)"))
_add(
    "prior_windowed",
    _slice("sales", "orders", grain="month", compare="prior", context={"time": ("1996-03-01", "1996-06-15")}),
    _lanes("orders", "lineitem", SHIP, "month", "1 MONTH", "orders_prior", "count(DISTINCT l_orderkey)", "l_shipdate >= DATE '1996-03-01' AND l_shipdate < DATE '1996-06-16'", "l_shipdate >= DATE '1996-02-01' AND l_shipdate < DATE '1996-05-16'"),
)
for _grain in GRAIN:
    _add(
        f"fytd_{_grain}",
        _slice("ordering", "orders", "buyers", by="status", grain=_grain, compare="fytd"),
        f"WITH f AS (SELECT *, {_g(_grain, ORDER)} AS p, {_g('fy', ORDER)} AS fy FROM orders), b AS (SELECT p AS period, o_orderstatus AS status, count(*) AS orders, count(DISTINCT o_custkey) AS buyers FROM f GROUP BY ALL), y AS (SELECT b.period, b.status, count(*) AS orders_fytd, count(DISTINCT o_custkey) AS buyers_fytd FROM b JOIN f ON f.fy = {_g('fy', 'b.period')} AND f.p <= b.period AND f.o_orderstatus IS NOT DISTINCT FROM b.status GROUP BY ALL) SELECT b.period, b.status, orders, orders_fytd, buyers, buyers_fytd FROM b LEFT JOIN y ON b.period = y.period AND b.status IS NOT DISTINCT FROM y.status",
    )
_add(
    "fytd_windowed",
    _slice("ordering", "orders", grain="month", compare="fytd", context={"time": ("1997-09-10", "1997-11-05"), "customer__segment": "BUILDING"}),
    f"WITH f AS (SELECT *, {_g('month', ORDER)} AS p, {_g('fy', ORDER)} AS fy FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1997-11-06'), b AS (SELECT p AS period, count(*) AS orders FROM f WHERE o_orderdate >= DATE '1997-09-10' GROUP BY ALL) SELECT period, orders, (SELECT count(*) FROM f WHERE f.fy = {_g('fy', 'b.period')} AND f.p <= b.period) AS orders_fytd FROM b",
)
_add("as_at_month", _slice("census", "waiting", "buyers", "urgent_share", by="status", grain="month"), _as_at("month", f"count(*) AS waiting, count(DISTINCT o_custkey) AS buyers, {URGENT} AS urgent_share", key="o_orderstatus AS status, "))
_add("as_at_overall", _slice("census", "waiting", "buyers"), _as_at(None, "count(*) AS waiting, count(DISTINCT o_custkey) AS buyers"))
_add("as_at_filtered", _slice("census", "waiting", grain="month", context={"status": "F"}), _as_at("month", "count(*) AS waiting", "o_orderstatus = 'F'"))
_add("as_at_median", _slice("census", "middle_price", grain="quarter"), _as_at("quarter", "median(o_totalprice) AS middle_price"))
_add(
    "as_at_prior",
    _slice("census", "waiting", grain="month", compare="prior", context={"time": ("1996-01-01", "1997-12-31")}),
    "WITH b AS (" + _as_at("month", "count(*) AS v", window="o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01'") + "), c AS (" + _as_at("month", "count(*) AS v", window="o_orderdate >= DATE '1995-12-01' AND o_orderdate < DATE '1997-12-01'") + ") SELECT b.period, b.v AS waiting, c.v AS waiting_prior FROM b LEFT JOIN c ON c.period = CAST(b.period - INTERVAL 1 MONTH AS DATE)",
)
_add("complete_by_newest", _slice("sales", "lines", grain="month", complete_periods=True), f"SELECT * FROM (SELECT {_g('month', SHIP)} AS period, count(*) AS lines FROM lineitem GROUP BY ALL) WHERE period + INTERVAL 1 MONTH - INTERVAL 1 DAY <= (SELECT max(l_shipdate) FROM lineitem)")
_add("complete_by_cadence", _slice("census", "waiting", grain="month", complete_periods=True), "SELECT a.* FROM (" + _as_at("month", "count(*) AS waiting") + f") a JOIN (SELECT {_g('month', ORDER)} AS p, max(o_orderdate) AS at FROM orders GROUP BY ALL) n ON n.p = a.period WHERE n.at > a.period + INTERVAL 1 MONTH - INTERVAL 1 DAY - INTERVAL 7 DAY")
_add("complete_cut_window", _slice("sales", "lines", grain="quarter", complete_periods=True, context={"time": ("1996-02-10", "1997-03-05")}), f"SELECT * FROM (SELECT {_g('quarter', SHIP)} AS period, count(*) AS lines FROM lineitem WHERE l_shipdate >= DATE '1996-02-10' AND l_shipdate < DATE '1997-03-06' GROUP BY ALL) WHERE period + INTERVAL 3 MONTH - INTERVAL 1 DAY <= (SELECT max(l_shipdate) FROM lineitem) AND period + INTERVAL 3 MONTH - INTERVAL 1 DAY < DATE '1997-03-06'")
_add("suppress_cells", _slice("ordering", "orders", "urgent_share", by="priority", grain="day", n=3), f"SELECT {_g('day', ORDER)} AS period, o_orderpriority AS priority, CASE WHEN count(*) >= 3 THEN count(*) END AS orders, CASE WHEN count(*) >= 3 THEN {URGENT} END AS urgent_share FROM orders GROUP BY ALL")
_add(
    "suppress_comparison",
    _slice("ordering", "orders", by="priority", grain="day", compare="prior", n=2),
    "WITH b AS (SELECT CAST(o_orderdate AS DATE) AS period, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ALL) SELECT b.period, b.priority, CASE WHEN b.n >= 2 THEN b.n END AS orders, CASE WHEN c.n >= 2 THEN c.n END AS orders_prior FROM b LEFT JOIN b c ON c.period = b.period - 1 AND c.priority IS NOT DISTINCT FROM b.priority",
)
_add("values_of_dimension", lambda s, d: bound(s, d, "sales").values_frame("part.brand"), "SELECT DISTINCT p_brand AS value FROM part WHERE p_brand IS NOT NULL")
_add("values_in_scope", lambda s, d: bound(s, d, "sales").values_frame("supplier.nation", {"flag": "R", "time": ("1996-01-01", "1996-01-05")}), "SELECT DISTINCT s_nationkey AS value FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-01-06' AND s_nationkey IS NOT NULL")
_add("values_of_fact_column", lambda s, d: bound(s, d, "activity").values_frame("kind"), "SELECT DISTINCT event_type AS value FROM events WHERE event_type IS NOT NULL")
_add("activity_by_kind", _slice("activity", "events", "users", "value", by="kind", grain="week"), f"SELECT {_g('week', 'ts')} AS period, event_type AS kind, count(*) AS events, count(DISTINCT user_id) AS users, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value FROM events GROUP BY ALL")


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ratio with its components, as explain() gives them: one row a cell."""
    found = bound(spark, sf_dir, "sales").slice("big_share", by="flag", grain="year", compare="prior", context={"status": "F"}).explain()
    rows = [{**r, **{f"part_{k}_num": v for k, v in n.items()}, **{f"part_{k}_den": v for k, v in d.items()}} for r, n, d in zip(found.rows, found.numerators, found.denominators)]
    names = ["period", "flag", "big_share", "big_share_prior", *[f"part_{k}_{end}" for k in ("big_share", "big_share_prior") for end in ("num", "den")]]
    kinds = {"period": "date", "flag": "string"}
    schema = ", ".join(f"{n} {kinds.get(n, 'long' if n.startswith('part_') else 'double')}" for n in names)
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


_ratio_lane = f"SELECT {_g('year', SHIP)} AS period, l_returnflag AS flag, count(*) FILTER (WHERE l_quantity > 25) AS n, count(*) AS d FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL"
_add("explain_ratio", _explained, f"WITH b AS ({_ratio_lane}) SELECT b.period, b.flag, CAST(b.n AS DOUBLE) / b.d AS big_share, CAST(c.n AS DOUBLE) / c.d AS big_share_prior, b.n AS part_big_share_num, b.d AS part_big_share_den, c.n AS part_big_share_prior_num, c.d AS part_big_share_prior_den FROM b LEFT JOIN b c ON c.period = CAST(b.period - INTERVAL 12 MONTH AS DATE) AND c.flag = b.flag")
_add("date_range", lambda s, d: s.createDataFrame([bound(s, d, "ordering").date_range()], "first_day date, last_day date"), "SELECT CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders")

# ---- more of the request


def _with_cadence(cadence: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = bound(spark, sf_dir, "census")
        return BoundModel(spark, replace(m.model, cadence=cadence), m.read, check=False).slice("waiting", grain="month", complete_periods=True).df

    return run


for _cadence, _days in (("daily", 1), ("monthly", 31)):
    _add(f"complete_by_cadence_{_cadence}", _with_cadence(_cadence), "SELECT a.* FROM (" + _as_at("month", "count(*) AS waiting") + f") a JOIN (SELECT {_g('month', ORDER)} AS p, max(o_orderdate) AS at FROM orders GROUP BY ALL) n ON n.p = a.period WHERE n.at > a.period + INTERVAL 1 MONTH - INTERVAL 1 DAY - INTERVAL {_days} DAY")
for _n, _unit, _back in ((10, "day", "INTERVAL 10 DAY"), (4, "week", "INTERVAL 28 DAY"), (2, "year", "INTERVAL 24 MONTH")):
    _add(f"context_last_{_unit}s", _slice("sales", "lines", by="status", context=Scope({"time": last(_n, _unit)})), f"SELECT l_linestatus AS status, count(*) AS lines FROM lineitem WHERE CAST(l_shipdate AS DATE) >= (SELECT CAST(max(l_shipdate) AS DATE) - {_back} + INTERVAL 1 DAY FROM lineitem) GROUP BY ALL")
_add("context_nul", _slice("sales", "lines", context={"flag": "R\0' OR 'x"}), "SELECT count(*) AS lines FROM lineitem WHERE l_returnflag = 'R' || chr(0) || chr(39) || ' OR ' || chr(39) || 'x'")
_add("context_not_shared", _slice("sales", "lines", by="flag", context={"supplier__name": not_("Supplier#000000001")}), "SELECT l_returnflag AS flag, count(*) AS lines FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey WHERE s_name IS DISTINCT FROM 'Supplier#000000001' GROUP BY ALL")
_add("measure_mode", _slice("ordering", "usual", by="status", grain="month"), f"SELECT period, status, priority AS usual FROM (SELECT period, status, priority, row_number() OVER (PARTITION BY period, status ORDER BY n DESC, priority) AS k FROM (SELECT {_g('month', ORDER)} AS period, o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ALL)) WHERE k = 1")
_add("measure_extremes", _slice("ordering", "least_price", "greatest_price", by="priority", grain="quarter", compare="fytd"), f"WITH f AS (SELECT *, {_g('quarter', ORDER)} AS p, {_g('fy', ORDER)} AS fy FROM orders), b AS (SELECT p AS period, o_orderpriority AS priority, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM f GROUP BY ALL) SELECT period, priority, lo AS least_price, hi AS greatest_price, (SELECT min(o_totalprice) FROM f WHERE f.fy = {_g('fy', 'b.period')} AND f.p <= b.period AND f.o_orderpriority = b.priority) AS least_price_fytd, (SELECT max(o_totalprice) FROM f WHERE f.fy = {_g('fy', 'b.period')} AND f.p <= b.period AND f.o_orderpriority = b.priority) AS greatest_price_fytd FROM b")
_add(
    "fytd_ratio",
    _slice("ordering", "urgent_share", "urgent", grain="month", compare="fytd"),
    f"WITH f AS (SELECT *, {_g('month', ORDER)} AS p, {_g('fy', ORDER)} AS fy FROM orders), y AS (SELECT b.p AS period, {URGENT} AS share, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n FROM (SELECT DISTINCT p, {_g('fy', 'p')} AS fy FROM f) b JOIN f ON f.fy = b.fy AND f.p <= b.p GROUP BY ALL) SELECT period, urgent_share, share AS urgent_share_fytd, urgent, n AS urgent_fytd FROM (SELECT p AS period, {URGENT} AS urgent_share, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM f GROUP BY ALL) LEFT JOIN y USING (period)",
)
_add(
    "fytd_median",
    _slice("ordering", "middle", grain="fy_quarter", compare="fytd"),
    f"WITH f AS (SELECT *, {_g('fy_quarter', ORDER)} AS p, {_g('fy', ORDER)} AS fy FROM orders), b AS (SELECT p AS period, median(o_totalprice) AS middle FROM f GROUP BY p) SELECT period, middle, (SELECT median(o_totalprice) FROM f WHERE f.fy = {_g('fy', 'b.period')} AND f.p <= b.period) AS middle_fytd FROM b",
)


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periods and the places at which they stand in the result."""
    found = bound(spark, sf_dir, "sales").slice("lines", grain="month").df.collect()
    return spark.createDataFrame([(k, r["period"], r["lines"]) for k, r in enumerate(found, 1)], "place long, period date, lines long")


_add("ordered_by_period", _ordered, f"SELECT row_number() OVER (ORDER BY period) AS place, period, lines FROM (SELECT {_g('month', SHIP)} AS period, count(*) AS lines FROM lineitem GROUP BY ALL)")


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice as a view, asked in SQL."""
    bound(spark, sf_dir, "sales").slice(["lines", "quantity"], by="flag", grain="year").view("showcase_sales_by_year")
    return spark.sql("SELECT flag, sum(lines) AS lines, max(period) AS last_year FROM showcase_sales_by_year WHERE period >= DATE '1994-01-01' GROUP BY flag")


_add("view_of_slice", _view, f"SELECT l_returnflag AS flag, count(*) AS lines, max({_g('year', SHIP)}) AS last_year FROM lineitem WHERE l_shipdate >= DATE '1994-01-01' GROUP BY ALL")


def _widgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A choice among the values of an attribute and one among days, put into a context as they are."""
    m = bound(spark, sf_dir, "sales")
    flags, days = m.filter_dim("flag"), m.filter_date()
    flags.value, days.value = [flags.options["R"]], (date(1996, 1, 1), days.stop)
    return plain(m.slice("lines", by="supplier.nation", context=Scope({"flag": flags, "time": days, "status": m.filter_dim("status")})).df)


_add("filter_widgets", _widgets, "SELECT s_nationkey AS supplier_nation, count(*) AS lines FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' AND l_shipdate >= DATE '1996-01-01' GROUP BY ALL")


def _refused(spark: SparkSession, cases: dict[str, Callable], name: str) -> DataFrame:
    rows = []
    for case, attempt in cases.items():
        try:
            attempt()
            rows.append((case, False))
        except SemanticsError as e:
            rows.append((case, bool(str(e))))
    return spark.createDataFrame(rows, f"{name} string, refused boolean")


def _guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that must be refused, and what came of them."""
    m, census, month = bound(spark, sf_dir, "sales"), bound(spark, sf_dir, "census"), {"grain": "month"}
    cases = {
        "no measure": lambda: m.slice([]), "unknown measure": lambda: m.slice("nothing"), "unknown grain": lambda: m.slice("lines", grain="decade"), "complete without grain": lambda: m.slice("lines", complete_periods=True),
        "suppress zero": lambda: m.slice("lines").suppress(0), "suppress true": lambda: m.slice("lines").suppress(True), "compare without grain": lambda: m.slice("lines", compare="prior"), "unknown comparison": lambda: m.slice("lines", compare="next", **month),
        "comparison twice": lambda: m.slice("lines", compare=["prior", "prior"], **month), "yoy by week": lambda: m.slice("lines", compare="yoy", grain="week"), "fytd of a stock": lambda: census.slice("waiting", compare="fytd", **month),
        "comparison of none": lambda: census.slice("middle_price", compare="prior", **month), "time in by": lambda: m.slice("lines", by="time"), "unknown dimension": lambda: m.slice("lines", by="planet"), "shared without attribute": lambda: m.slice("lines", by="supplier"),
        "unknown attribute": lambda: m.slice("lines", by="supplier.planet"), "attribute of a column": lambda: m.slice("lines", by="flag.x"), "same column twice": lambda: m.slice("lines", by=["flag", "flag"]), "strict context": lambda: m.slice("lines", context={"customer__segment": "x"}, strict_context=True),
        "none in context": lambda: Scope({"flag": None}), "empty list in context": lambda: Scope({"flag": []}), "nan in context": lambda: Scope({"flag": float("nan")}), "range backwards": lambda: Scope({"time": ("1996-02-01", "1996-01-01")}), "last for a column": lambda: Scope({"flag": last(1, "day")}),
        "last zero": lambda: last(0, "day"), "last unknown": lambda: last(1, "decade"),
    }
    return _refused(spark, cases, "request")


_add("guards", _guards, "SELECT request, true AS refused FROM (VALUES " + ", ".join(f"('{x}')" for x in ("no measure", "unknown measure", "unknown grain", "complete without grain", "suppress zero", "suppress true", "compare without grain", "unknown comparison", "comparison twice", "yoy by week", "fytd of a stock", "comparison of none", "time in by", "unknown dimension", "shared without attribute", "unknown attribute", "attribute of a column", "same column twice", "strict context", "none in context", "empty list in context", "nan in context", "range backwards", "last for a column", "last zero", "last unknown")) + ") t(request)")


def _context_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a slice did with each entry of its context, and the entry in plain data."""
    base = context({"flag": {"in": ["A", "R"]}, "customer__segment": {"eq": "BUILDING"}, "part__size": {"between": [1, 5]}}, status=all_())
    s = bound(spark, sf_dir, "sales").slice("lines", context=(base | {"time": ("1996-01-01", "1996-12-31")}).with_(supplier__name=not_("x")).without("part__size"))
    record = s.provenance()
    rows = [(k, json.dumps(v), k in s.applied, k in s.ignored, k in record.unfiltered) for k, v in record.context.items()]
    return spark.createDataFrame(rows, "entry string, said string, applied boolean, ignored boolean, unfiltered boolean")


_add("context_record", _context_record, """SELECT * FROM (VALUES ('flag', '{"in": ["A", "R"]}', true, false, false), ('customer__segment', '{"eq": "BUILDING"}', false, true, false), ('status', '{"all": true}', true, false, true), ('supplier__name', '{"not": "x"}', true, false, false), ('time', '{"between": ["1996-01-01", "1996-12-31"]}', true, false, false)) t(entry, said, applied, ignored, unfiltered)""")

# ---- checks, provenance, mirror and readers

_add("bind_orphans", lambda s, d: bind.orphans(MODEL[7]["sales"], bound(s, d, "sales").read), "SELECT 'supplier' AS dimension, 'l_suppkey' AS key_column, (SELECT count(*) FROM lineitem WHERE l_suppkey IS NOT NULL AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier)) AS orphan_rows, (SELECT count(*) FROM lineitem) AS fact_rows UNION ALL SELECT 'part', 'l_partkey', (SELECT count(*) FROM lineitem WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part)), (SELECT count(*) FROM lineitem)")


def _bad_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that must not bind, and what came of them."""
    good, read = MODEL[7]["sales"], bound(spark, sf_dir, "sales").read
    one = lambda expr: replace(good, measures={"m": replace(good.measures["lines"], name="m", expr=expr)})
    shared = good.dims["supplier"].shared
    with_dim = lambda **change: replace(good, dims={"supplier": replace(good.dims["supplier"], shared=replace(shared, **change))})
    cases = {
        "fact unreadable": replace(good, fact="no_such_table"), "time column missing": replace(good, time_column="l_nothing"), "time column no date": replace(good, time_column="l_returnflag"), "no SQL": one("sum("), "no aggregate": one("l_quantity"),
        "unknown column": one("sum(l_nothing)"), "column of another table": one("sum(orders.o_totalprice)"), "another table in a subquery": one("count(*) FILTER (WHERE l_orderkey IN (SELECT o_orderkey FROM orders))"),
        "attribute missing": with_dim(attributes={"x": "s_nothing"}), "key not unique": with_dim(key="s_nationkey"), "good": good,
    }
    return _refused(spark, {k: lambda m=m: BoundModel(spark, m, read) for k, m in cases.items()}, "model")


_add("bind_refusals", _bad_models, "SELECT model, model <> 'good' AS refused FROM (VALUES ('fact unreadable'), ('time column missing'), ('time column no date'), ('no SQL'), ('no aggregate'), ('unknown column'), ('column of another table'), ('another table in a subquery'), ('attribute missing'), ('key not unique'), ('good')) t(model)")


def _captured(spark: SparkSession, sf_dir: str) -> dict:
    return bound(spark, sf_dir, "census").slice("waiting", grain="month", compare="prior", context={"time": ("1992-03-01", "1996-06-15")}).provenance().data


def _as_at_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(lane, date.fromisoformat(p), datetime.fromisoformat(at)) for lane, found in _captured(spark, sf_dir)["as_at"].items() for p, at in found]
    return spark.createDataFrame(rows, "lane string, period date, as_at timestamp_ntz")


_moments = lambda lane, lo, high: f"SELECT '{lane}' AS lane, {_g('month', ORDER)} AS period, max(o_orderdate) AS as_at FROM orders WHERE o_orderdate >= DATE '{lo}' AND o_orderdate < DATE '{high}' GROUP BY ALL"
_add("provenance_as_at", _as_at_moments, _moments("base", "1992-03-01", "1996-06-16") + " UNION ALL " + _moments("prior", "1992-02-01", "1996-05-16"))


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _captured(spark, sf_dir)
    rows = [(lane, s["state"], s["from"], s["before"], found["data_from"][:10], found["data_to"][:10], found["last_period_cut"]) for lane, s in found["scans"].items()]
    return spark.createDataFrame(rows, "lane string, state string, starts string, ends_before string, data_from string, data_to string, last_period_cut boolean")


_add("provenance_coverage", _coverage, "WITH e AS (SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS data_from, strftime(max(o_orderdate), '%Y-%m-%d') AS data_to FROM orders) SELECT lane, CASE WHEN starts < data_from THEN 'partly before the data begin' ELSE 'covered' END AS state, starts, ends_before, data_from, data_to, true AS last_period_cut FROM e, (VALUES ('base', '1992-03-01', '1996-06-16'), ('prior', '1992-02-01', '1996-05-16')) t(lane, starts, ends_before)")


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of measures, and whether their hashes tell them apart: spacing and descriptions do not count, meaning does."""
    model = MODEL[7]["sales"]
    first = replace(model.measures["big_lines"], expr="sum(l_quantity)", where="l_quantity > 25")
    others = {
        "spacing and case": replace(first, expr="SUM( L_QUANTITY )"), "description": replace(first, description="Another."), "literal": replace(first, where="l_quantity > 26"), "function": replace(first, expr="max(l_quantity)"),
        "predicate dropped": replace(first, where=None), "distinct": replace(first, expr="sum(distinct l_quantity)"), "time_agg": replace(first, time_agg="last"),
    }
    rows = [(k, audit.measure_hash(spark, model, first) != audit.measure_hash(spark, model, m)) for k, m in others.items()]
    rows += [("fiscal start", audit.model_hash(model) != audit.model_hash(MODEL[1]["sales"])), ("dimension dropped", audit.model_hash(model) != audit.model_hash(replace(model, dims={})))]
    return spark.createDataFrame(rows, "change string, another boolean")


_add("provenance_hashes", _hashes, "SELECT * FROM (VALUES ('spacing and case', false), ('description', false), ('literal', true), ('function', true), ('predicate dropped', true), ('distinct', true), ('time_agg', true), ('fiscal start', true), ('dimension dropped', true)) t(change, another)")


def _folder(spark: SparkSession) -> str:
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/_showcase/{uuid.uuid4().hex}"


def _mirrored(spark: SparkSession, sf_dir: str, then: Callable[[Store], DataFrame]) -> DataFrame:
    """What `then` finds in a mirror of two small tables, the second of which has been refreshed once; the mirror goes again."""
    store = Store(spark, _folder(spark))
    specs = [TableSpec("nation", "SELECT * FROM nation", "core", mode="parquet"), TableSpec("region", "SELECT * FROM region")]
    read = lambda spec: spark.read.parquet(f"{sf_dir}/{spec.name}.parquet")
    try:
        store.build(specs, lambda spec: read(spec).limit(0) if spec.name == "region" else read(spec))
        store.build(specs, read, only=["region"])
        out = then(store)
        return spark.createDataFrame(out.collect(), out.schema)  # a few rows of small tables
    finally:
        store.files.delete(store.root)


_add("mirror_freshness", lambda s, d: _mirrored(s, d, lambda store: store.freshness().select("schema_name", "table_name", "source_sql", "mode", "row_count")), "SELECT 'core' AS schema_name, 'nation' AS table_name, 'SELECT * FROM nation' AS source_sql, 'parquet' AS mode, (SELECT count(*) FROM nation) AS row_count UNION ALL SELECT 'main', 'region', 'SELECT * FROM region', 'native', (SELECT count(*) FROM region)")
_add("mirror_table", lambda s, d: _mirrored(s, d, lambda store: store.table("core.nation").join(store.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as text with semicolons, read back with delimiter, header and types guessed."""
    folder = _folder(spark)
    spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey", "c_acctbal").write.option("header", True).option("sep", ";").csv(folder)
    return csvfile.read_csv(spark, folder)


_add("read_csv_guessed", _csv, "SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey, c_acctbal FROM customer")


def _spooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of record batches as a table."""
    table = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").toArrow()
    return spooled(spark, table.to_reader(max_chunksize=7), rows_at_once=10)


_add("land_stream", _spooled, "SELECT n_nationkey, n_name FROM nation")


def _messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a careless export has them."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(
        F.col("o_orderkey").alias("Order Key"), F.concat(F.lit(" \t"), F.col("o_orderpriority"), F.lit("\n ")).alias("Priority!"),
        F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("Total ($)"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("Placed On"),
        F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30").cast("date")).cast("double").alias("serial"), F.lit(None).cast("string").alias("Nothing"), F.lit("  ").alias("Blank"),
    )


_add(
    "clean_all_steps",
    lambda s, d: cleaners.clean(_messy(s, d), cleaners.snake_names, cleaners.strip_strings, cleaners.drop_empty, cleaners.parse_dates("placed_on", format="%d/%m/%Y"), cleaners.parse_dates("serial"), cleaners.numeric("total")),
    "SELECT o_orderkey AS order_key, o_orderpriority AS priority, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS total, date_trunc('day', o_orderdate) AS placed_on, date_trunc('day', o_orderdate) AS serial FROM orders",
)
_add("clean_strip_documents", lambda s, d: cleaners.strip_strings(s.read.parquet(f"{d}/documents.parquet")), r"SELECT doc_id, n_chars, " + ", ".join(rf"nullif(regexp_replace({c}, '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g'), '') AS {c}" for c in ("text", "lang", "source")) + " FROM documents")
