"""The driver's queries over events and orders, and SQL for the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import engine
from .functions import hll
from .operators.accumulate import Result
from .sinks.histories import extract_histories
from .sinks.json_sink import json_rows
from .sources.events import EventSource, lexicon
from .sources.side import read_excludes, read_windows

_SECONDS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({} AS TIMESTAMP_NTZ)) div 1000000"
DAY = 86400
#: 2024-01-01, the first day of events.
T0 = 1704067200


def events(spark: SparkSession, sf_dir: str, distinct: bool = True, where: str | None = None) -> EventSource:
    """A user's events; fields type and k."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    if where:
        df = df.where(where)
    return EventSource(df, "user_id", F.expr(_SECONDS.format("ts")), {"type": "event_type", "k": F.get_json_object("props", "$.k")}, ("ts", "event_id"), distinct)


def orders(spark: SparkSession, sf_dir: str) -> EventSource:
    """A customer's orders; fields status and priority."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return EventSource(df, "o_custkey", F.expr(_SECONDS.format("o_orderdate")), {"status": "o_orderstatus", "priority": "o_orderpriority"}, ("o_orderdate", "o_orderkey"), True)


def counters(result: Result) -> DataFrame:
    """One row: each counter under its name."""
    names = [v for v, k in result.program.results.items() if k == "counter"]
    return result.wide().select(*[F.col(f"`{v}`").alias(v[1:]) for v in names])


def values(result: Result) -> DataFrame:
    """var, value (items joined by |) and n for each value of each result."""
    return result.long().select(F.col("var"), F.array_join("key", "|").alias("value"), F.col("n"))


def by_tuple(result: Result, variable: str) -> DataFrame:
    """Scalar foreach variables under their names, then value and n."""
    t = result.table(variable)
    scalars = [F.col(f"`{v}`").alias(v[1:]) for v in result.tuples.variables if v[0] == "%"]
    return t.select(*scalars, *([F.array_join("value", "|").alias("value")] if "value" in t.columns else []), "n")


_EV = """ev AS (
  SELECT CAST(user_id AS VARCHAR) AS id, epoch_us(ts) // 1000000 AS ts, event_type AS type, json_extract_string(props, '$.k') AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events
)"""


def _sql(body: str, *more: str) -> str:
    return "WITH " + ", ".join((_EV, *more)) + " " + body


def _machine_sql(step: str, columns: str, start: str, body: str, ev: str = _EV) -> str:
    """A recursive query: one row for each event of each history, carrying the machine's state."""
    return f"""WITH RECURSIVE {ev}, m AS (
  SELECT id, CAST(0 AS BIGINT) AS rn, {start} FROM (SELECT DISTINCT id FROM ev)
  UNION ALL
  SELECT e.id, e.rn, {step} FROM m JOIN ev e ON e.id = m.id AND e.rn = m.rn + 1
), last AS (SELECT m.* FROM m JOIN (SELECT id, max(rn) AS rn FROM ev GROUP BY id) USING (id, rn)) SELECT {columns} {body}"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _of(program: str, shape: Callable[[Result], DataFrame] = counters, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: shape(engine.run(program, events(spark, sf_dir), **options))


COUNT_CLICKS = """
start ->
    receive
        type = "click" -> yield $n
        * -> repeat
"""

FIRST_MATCH = """
start ->
    receive
        type = "click", k = "7" -> yield $both
        type = "click" -> yield $clicks
        k = "7" -> yield $sevens
        * -> repeat
"""

SEVERAL = """
start ->
    receive
        type = "click" -> yield $clicks, yield k to #ks, yield type,k to &pairs, repeat
        type = "view", k = "3" -> yield k to #ks
        * -> repeat
"""

FOREACH = """
foreach %t in @types
    start ->
        receive
            type = %t -> yield $n
            * -> repeat
"""

IMPLICIT = """
foreach %t
    start ->
        receive
            type = %t -> yield $n
            * -> repeat
"""

PAIRS = """
foreach %t,%k in @pairs
    start ->
        receive
            type = %t, k = %k -> yield $n
            * -> repeat
"""

SETS = """
foreach %t,#ks in @groups
    start ->
        receive
            type = %t, k in #ks -> yield $n, yield cookie to #users
            * -> repeat
"""

TWO_SETS = """
foreach %name,#a,#b in @groups
    start ->
        receive
            k in #a, k in #b -> yield $n
            * -> repeat
"""

MERGED = """
foreach %t,%k in @pairs merged results
    start ->
        receive
            type = %t, k = %k -> yield $n, yield k to #ks
            * -> repeat
"""

UNGUARDED = """
foreach %t in @types
    start ->
        receive
            type = %t -> yield $mine
            k = "5" -> yield $fives
            * -> repeat
"""

_GROUPS = [["click", ["1", "2", "3"]], ["view", ["2", "3", "4", ""]], ["nosuch", ["1"]]]
_PAIRS = [["click", "1"], ["click", "2"], ["view", "1"], ["nosuch", "1"]]
_TWO = [["x", ["1", "2", "3"], ["2", "3", "4"]], ["y", ["1"], ["2"]]]
_VALUES_PAIRS = "pairs(t, k) AS (VALUES ('click', '1'), ('click', '2'), ('view', '1'), ('nosuch', '1'))"

QUERIES |= {
    "q01_count": _of(COUNT_CLICKS),
    "q02_first_match": _of(FIRST_MATCH),
    "q03_several_yields": _of(SEVERAL, values),
    "q04_foreach": _of(FOREACH, lambda r: by_tuple(r, "$n"), params={"@types": [["click"], ["view"], ["nosuch"]]}),
    "q05_foreach_implicit": _of(IMPLICIT, lambda r: by_tuple(r, "$n")),
    "q06_foreach_pairs": _of(PAIRS, lambda r: by_tuple(r, "$n"), params={"@pairs": _PAIRS}),
    "q07_foreach_sets": _of(SETS, lambda r: by_tuple(r, "#users"), params={"@groups": _GROUPS}),
    "q08_two_sets": _of(TWO_SETS, lambda r: by_tuple(r, "$n"), params={"@groups": _TWO}),
    "q09_merged": _of(MERGED, values, params={"@pairs": _PAIRS}),
    "q09b_foreach_unguarded": _of(UNGUARDED, lambda r: by_tuple(r, "$mine").join(by_tuple(r, "$fives").withColumnRenamed("n", "fives"), "t"), params={"@types": [["click"], ["view"], ["nosuch"]]}),
}
ORACLE_SQL |= {
    "q01_count": _sql("SELECT count(*) AS n FROM ev WHERE type = 'click'"),
    "q02_first_match": _sql("SELECT count(*) FILTER (type = 'click' AND k = '7') AS both, count(*) FILTER (type = 'click' AND k <> '7') AS clicks, count(*) FILTER (type <> 'click' AND k = '7') AS sevens FROM ev"),
    "q03_several_yields": _sql(
        "SELECT '$clicks' AS var, '' AS value, count(*) AS n FROM ev WHERE type = 'click' UNION ALL "
        "SELECT DISTINCT '#ks', k, CAST(1 AS BIGINT) FROM ev WHERE type = 'click' OR type = 'view' AND k = '3' UNION ALL "
        "SELECT '&pairs', type || '|' || k, count(*) FROM ev WHERE type = 'click' GROUP BY type, k"
    ),
    "q04_foreach": _sql("SELECT t, count(ev.id) AS n FROM (VALUES ('click'), ('view'), ('nosuch')) v(t) LEFT JOIN ev ON type = t GROUP BY t"),
    "q05_foreach_implicit": _sql("SELECT t, count(ev.id) AS n FROM (SELECT DISTINCT type AS t FROM ev UNION SELECT '') LEFT JOIN ev ON type = t GROUP BY t"),
    "q06_foreach_pairs": _sql("SELECT p.t, p.k, count(ev.id) AS n FROM pairs p LEFT JOIN ev ON type = p.t AND ev.k = p.k GROUP BY p.t, p.k", _VALUES_PAIRS),
    "q07_foreach_sets": _sql("SELECT DISTINCT type AS t, id AS value, CAST(1 AS BIGINT) AS n FROM ev WHERE type = 'click' AND k IN ('1', '2', '3') OR type = 'view' AND k IN ('2', '3', '4')"),
    "q08_two_sets": _sql("SELECT 'x' AS name, count(*) AS n FROM ev WHERE k IN ('2', '3') UNION ALL SELECT 'y', 0"),
    "q09_merged": _sql("SELECT '$n' AS var, '' AS value, count(*) AS n FROM ev JOIN pairs p ON type = p.t AND ev.k = p.k UNION ALL SELECT DISTINCT '#ks', ev.k, CAST(1 AS BIGINT) FROM ev JOIN pairs p ON type = p.t AND ev.k = p.k", _VALUES_PAIRS),
    "q09b_foreach_unguarded": _sql("SELECT t, count(*) FILTER (type = t) AS n, count(*) FILTER (type <> t AND k = '5') AS fives FROM (VALUES ('click'), ('view'), ('nosuch')) v(t) CROSS JOIN ev GROUP BY t"),
}

FREE = """
start ->
    receive
        type = %t, k in #ks -> yield $n
        * -> repeat
"""

RANGE = """
start ->
    receive
        timestamp >= '2024-01-05', timestamp < %end, type = "click" -> yield $n
        timestamp < 1704326400 -> yield $early
        * -> repeat
"""

TUPLES = """
start ->
    receive
        type = "purchase" -> yield cookie,k to #bought
        type = "error" -> yield timestamp,type to &errors
        * -> repeat
"""

QUERIES |= {
    "q10_free_scalar": _of(FREE, params={"%t": "view", "#ks": ["1", "2", ""]}),
    "q11_free_set": _of(FREE, params={"%t": "click", "#ks": [str(i) for i in range(50)]}),
    "q12_time_range": _of(RANGE, params={"%end": str(T0 + 10 * DAY)}),
    "q13_q14_tuples": _of(TUPLES, values),
}
ORACLE_SQL |= {
    "q10_free_scalar": _sql("SELECT count(*) AS n FROM ev WHERE type = 'view' AND k IN ('1', '2')"),
    "q11_free_set": _sql("SELECT count(*) AS n FROM ev WHERE type = 'click' AND CAST(k AS INT) < 50"),
    "q12_time_range": _sql(f"SELECT count(*) FILTER (ts >= {T0 + 4 * DAY} AND ts < {T0 + 10 * DAY} AND type = 'click') AS n, count(*) FILTER (ts < {T0 + 3 * DAY}) AS early FROM ev"),
    "q13_q14_tuples": _sql(
        "SELECT DISTINCT '#bought' AS var, id || '|' || k AS value, CAST(1 AS BIGINT) AS n FROM ev WHERE type = 'purchase' UNION ALL SELECT '&errors', CAST(ts AS VARCHAR) || '|error', count(*) FROM ev WHERE type = 'error' GROUP BY ts"
    ),
}

SKIP = """
start ->
    receive
        type = "click" -> yield $n, skip
        * -> repeat
skip ->
    receive
        * -> repeat
    after 6h -> start
"""

BOUNCE = """
start ->
    receive
        type = "view" -> wait
        * -> repeat
wait ->
    receive
        type = "view" -> start
        * -> repeat
    after 1d -> yield $bounces, yield cookie to #users, start
"""

SESSIONS = """
start ->
    receive
        * -> yield $sessions, inside
inside ->
    receive
        * -> inside
    after 12h -> start
"""

FUNNEL = """
start ->
    receive
        type = "view" -> funnel
        * -> repeat
funnel ->
    window
        seen ->
            receive
                type = "click" -> clicked
                * -> repeat
        clicked ->
            receive
                type = "purchase" -> yield $bought, yield start_timestamp[funnel] to &started, start
                * -> repeat
    after 3d -> yield $lapsed, start
"""

BUYERS = """
start ->
    receive
        type = "purchase" -> yield $buyers, quit
        * -> repeat
"""

UNTIL_ERROR = """
start ->
    receive
        type = "error" -> quit
        type = "click" -> yield $n, repeat
        * -> repeat
"""

STARTED = """
start ->
    receive
        type = "view" -> seen
        * -> repeat
seen ->
    receive
        type = "click" -> yield start_timestamp,timestamp to &pairs, start
        * -> repeat
    after 2d -> start
"""

AT_END = """
start ->
    receive
        type = "purchase" -> bought
        * -> repeat
bought ->
    receive
        type = "error" -> start
        * -> repeat
    after -> yield $open, yield cookie to #users, start
"""

_SKIP_STEP = """
  CASE WHEN st = 0 OR ex <= e.ts THEN CASE WHEN type = 'click' THEN 1 ELSE 0 END ELSE 1 END,
  CASE WHEN (st = 0 OR ex <= e.ts) AND type = 'click' THEN e.ts + 21600 ELSE ex END,
  n + CASE WHEN (st = 0 OR ex <= e.ts) AND type = 'click' THEN 1 ELSE 0 END"""
_STATE = "CAST(0 AS BIGINT) AS st, CAST(0 AS BIGINT) AS ex, CAST(0 AS BIGINT) AS n"
_BOUNCE_STEP = """
  CASE WHEN st = 1 AND ex > e.ts THEN CASE WHEN type = 'view' THEN 0 ELSE 1 END ELSE CASE WHEN type = 'view' THEN 1 ELSE 0 END END,
  CASE WHEN (st = 0 OR ex <= e.ts) AND type = 'view' THEN e.ts + 86400 ELSE ex END,
  n + CASE WHEN st = 1 AND ex <= e.ts THEN 1 ELSE 0 END"""


def _funnel_step(live: str) -> str:
    """live: whether the machine is still in the funnel when the event comes."""
    return f"""
  CASE WHEN {live} THEN CASE WHEN st = 1 AND type = 'click' THEN 2 WHEN st = 2 AND type = 'purchase' THEN 0 ELSE st END ELSE CASE WHEN type = 'view' THEN 1 ELSE 0 END END,
  CASE WHEN NOT ({live}) AND type = 'view' THEN e.ts + 259200 ELSE ex END,
  n + CASE WHEN {live} AND st = 2 AND type = 'purchase' THEN 1 ELSE 0 END,
  lapsed + CASE WHEN st > 0 AND NOT ({live}) THEN 1 ELSE 0 END"""


_FUNNEL_STATE = _STATE + ", CAST(0 AS BIGINT) AS lapsed"
_FUNNEL_OUT = "CAST(sum(n) AS BIGINT) AS bought, CAST(sum(lapsed + CASE WHEN st > 0 THEN 1 ELSE 0 END) AS BIGINT) AS lapsed"

QUERIES |= {
    "q15_skip_repeats": _of(SKIP),
    "q16_bounces": _of(BOUNCE),
    "q17_sessions": _of(SESSIONS),
    "q18_funnel_eager": _of(FUNNEL, eager_outer_expiry=True),
    "q18b_funnel": _of(FUNNEL),
    "q19_quit": _of(BUYERS),
    "q20_until_error": _of(UNTIL_ERROR),
    "q21_start_timestamp": _of(STARTED, values),
    "q22_window_start": _of(FUNNEL, lambda r: values(r).where("var = '&started'"), eager_outer_expiry=True),
    "q23_at_end": _of(AT_END),
    "q24_pending_after": _of(BOUNCE, lambda r: values(r).where("var = '#users'")),
}
ORACLE_SQL |= {
    "q15_skip_repeats": _machine_sql(_SKIP_STEP, "CAST(sum(n) AS BIGINT) AS n", _STATE, "FROM last"),
    "q16_bounces": _machine_sql(_BOUNCE_STEP, "CAST(sum(n + st) AS BIGINT) AS bounces", _STATE, "FROM last"),
    "q17_sessions": _sql("SELECT count(*) AS sessions FROM (SELECT ts, lag(ts) OVER (PARTITION BY id ORDER BY rn) AS before FROM ev) WHERE before IS NULL OR ts - before >= 43200"),
    "q18_funnel_eager": _machine_sql(_funnel_step("st > 0 AND ex > e.ts"), _FUNNEL_OUT, _FUNNEL_STATE, "FROM last"),
    "q18b_funnel": _machine_sql(_funnel_step("st > 0"), _FUNNEL_OUT, _FUNNEL_STATE, "FROM last"),
    "q19_quit": _sql("SELECT count(DISTINCT id) AS buyers FROM ev WHERE type = 'purchase'"),
    "q20_until_error": _sql("SELECT count(*) AS n FROM ev LEFT JOIN (SELECT id, min(rn) AS stop FROM ev WHERE type = 'error' GROUP BY id) USING (id) WHERE type = 'click' AND (stop IS NULL OR rn < stop)"),
    "q21_start_timestamp": _machine_sql(
        """
  CASE WHEN st = 1 AND ex > e.ts THEN CASE WHEN type = 'click' THEN 0 ELSE 1 END ELSE CASE WHEN type = 'view' THEN 1 ELSE 0 END END,
  CASE WHEN NOT (st = 1 AND ex > e.ts) AND type = 'view' THEN e.ts + 172800 ELSE ex END,
  CASE WHEN st = 1 AND ex > e.ts AND type = 'click' THEN e.ts ELSE 0 END""",
        "'&pairs' AS var, CAST(ex - 172800 AS VARCHAR) || '|' || CAST(n AS VARCHAR) AS value, count(*) AS n",
        _STATE,
        "FROM m WHERE n > 0 GROUP BY value",
    ),
    "q22_window_start": _machine_sql(
        f"""
  CASE WHEN {"st > 0 AND ex > e.ts"} THEN CASE WHEN st = 1 AND type = 'click' THEN 2 WHEN st = 2 AND type = 'purchase' THEN 0 ELSE st END ELSE CASE WHEN type = 'view' THEN 1 ELSE 0 END END,
  CASE WHEN NOT ({"st > 0 AND ex > e.ts"}) AND type = 'view' THEN e.ts + 259200 ELSE ex END,
  CASE WHEN {"st > 0 AND ex > e.ts"} AND st = 2 AND type = 'purchase' THEN 1 ELSE 0 END""",
        "'&started' AS var, CAST(ex - 259200 AS VARCHAR) AS value, count(*) AS n",
        _STATE,
        "FROM m WHERE n > 0 GROUP BY value",
    ),
    "q23_at_end": _machine_sql("CASE WHEN st = 0 AND type = 'purchase' THEN 1 WHEN st = 1 AND type = 'error' THEN 0 ELSE st END, ex, n", "CAST(sum(st) AS BIGINT) AS open", _STATE, "FROM last"),
    "q24_pending_after": _machine_sql(_BOUNCE_STEP, "'#users' AS var, id AS value, CAST(1 AS BIGINT) AS n", _STATE, "FROM last WHERE n + st > 0"),
}

_CNF = {"clauses": [[{"field": "type", "value": "click"}, {"field": "type", "value": "view"}], [{"field": "k", "value": "7", "op": "notequal"}]]}
_CNF_MISSING = {"clauses": [[{"field": "nosuch", "value": ""}], [{"field": "nosuch", "value": "x", "op": "notequal"}], [{"field": "type", "value": "error", "op": "notequal"}]]}

BY_TYPE = """
start ->
    receive
        type = "click" -> yield $clicks, yield cookie,timestamp to #at
        * -> yield $others
"""

BOUNDS = """
start ->
    receive
        type = "click" -> yield cookie,cookie_timestamp_filter_start,cookie_timestamp_filter_end to &seen
        * -> repeat
"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's key as a user id, from one of ten days for a week."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").cast("string").alias("_id"), (F.lit(T0) + F.col("c_custkey") % 10 * DAY).alias("start"), (F.lit(T0) + (F.col("c_custkey") % 10 + 7) * DAY).alias("end"))


def _windows_with_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _windows(spark, sf_dir)
    early = w.withColumn("window_id", F.concat("_id", F.lit("-a")))
    late = w.select("_id", (F.col("start") + 5 * DAY).alias("start"), F.lit(0).cast("long").alias("end"), F.concat("_id", F.lit("-b")).alias("window_id"))
    return early.unionByName(late)


_WINDOWS_SQL = f"w AS (SELECT CAST(c_custkey AS VARCHAR) AS id, {T0} + c_custkey % 10 * {DAY} AS low, {T0} + (c_custkey % 10 + 7) * {DAY} AS high FROM customer)"


@_query("q27_windows", _sql("SELECT '&seen' AS var, id || '|' || low || '|' || high AS value, count(*) AS n FROM ev JOIN w USING (id) WHERE type = 'click' AND ts >= low AND ts < high GROUP BY id, low, high", _WINDOWS_SQL))
def q27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(engine.run(BOUNDS, events(spark, sf_dir), windows=_windows(spark, sf_dir)))


@_query(
    "q28_windows_with_ids",
    _sql(
        f"""SELECT '&seen' AS var, wid || '|' || low || '|' || high AS value, count(*) AS n FROM ev JOIN
        (SELECT id, id || '-a' AS wid, low, high FROM w UNION ALL SELECT id, id || '-b', low + {5 * DAY}, 0 FROM w) USING (id)
        WHERE type = 'click' AND ts >= low AND (high = 0 OR ts < high) GROUP BY wid, low, high""",
        _WINDOWS_SQL,
    ),
)
def q28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(engine.run(BOUNDS, events(spark, sf_dir), windows=_windows_with_id(spark, sf_dir)))


@_query("q29_excludes", _sql("SELECT count(*) FILTER (type = 'click') AS clicks, count(*) FILTER (type <> 'click') AS others FROM ev WHERE id NOT IN (SELECT id FROM ev WHERE type = 'error' AND k = '13')"))
def q29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the users who ever had an error 13."""
    out = _users(spark, sf_dir, "event_type = 'error' and get_json_object(props, '$.k') = '13'")
    return counters(engine.run(BY_TYPE, events(spark, sf_dir), excludes=out))


def _users(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").where(where).select(F.col("user_id").cast("string").alias("_id")).distinct()


def _slices(spark: SparkSession, sf_dir: str) -> list[EventSource]:
    """Three sources, ten days each."""
    return [events(spark, sf_dir, where=f"event_type is not null and ts >= TIMESTAMP_NTZ'2024-01-{a}' and ts < TIMESTAMP_NTZ'2024-{b}'") for a, b in (("01", "01-11"), ("11", "01-21"), ("21", "02-11"))]


@_query("q30_three_sources", ORACLE_SQL["q15_skip_repeats"])
def q30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters(engine.run(SKIP, _slices(spark, sf_dir)))


@_query("q30b_overlap", _sql("SELECT count(*) + (SELECT count(*) FROM ev WHERE type = 'click' AND ts >= (SELECT max(ts) FROM ev)) AS n FROM ev WHERE type = 'click'"))
def q30b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same source twice: the second adds only what is at the first's last time."""
    return counters(engine.run(COUNT_CLICKS, [events(spark, sf_dir)] * 2))


@_query(
    "q31_repeated_events",
    "WITH ev AS (SELECT user_id AS id, epoch_us(ts) // 86400000000 * 86400 AS ts, event_type AS type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), "
    "kept AS (SELECT *, lag(ts) OVER w AS t, lag(type) OVER w AS u FROM ev WINDOW w AS (PARTITION BY id ORDER BY rn)) "
    "SELECT count(*) FILTER (type = 'click') AS clicks, count(*) FILTER (type <> 'click') AS others FROM kept WHERE NOT coalesce(t = ts AND u = type, false)",
)
def q31(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times cut to days, so that neighbours can be alike."""
    e = events(spark, sf_dir, distinct=False)
    day = F.expr(_SECONDS.format("date_trunc('DAY', ts)"))
    return counters(engine.run(BY_TYPE, EventSource(e.df, e.id, day, {"type": "event_type"}, e.order)))


CALLS = """
foreach %t,%tag in @arr
    start ->
        receive
            type = %t -> yield glue(%tag, upper(type), "x", 7, k) to &made
            * -> repeat
"""


@_query("q32_functions", _sql("SELECT t, tag || '-' || upper(type) || '-x-7-' || k AS value, count(*) AS n, tag FROM ev JOIN (VALUES ('click', 'A'), ('view', 'B')) v(t, tag) ON type = t GROUP BY t, tag, type, k"))
def q32(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = {"glue": lambda *parts: "-".join(parts), "upper": lambda s: s.upper()}
    return by_tuple(engine.run(CALLS, events(spark, sf_dir), {"@arr": [["click", "A"], ["view", "B"]]}, functions=calls), "&made")


NO_FIELD = """
start ->
    receive
        nosuch = "", type = "click" -> yield type,nosuch to &seen
        * -> repeat
"""

#: A negated clause, an entry block that isn't the first, and a move to the next block exist in the JSON form only.
NEGATED = {
    "rules": [
        {"name": "second", "clauses": [{"attrs": {"type": ["click"]}, "op": "not", "action": "repeat", "yield": [{"dst": "$others"}]}, {"attrs": {}, "action": "repeat"}]},
        {"name": "first", "entrypoint": True, "clauses": [{"attrs": {"type": ["purchase"]}, "action": "break"}, {"attrs": {}, "action": "repeat"}]},
        {"name": "third", "clauses": [{"attrs": {"type": ["error"]}, "action": "restart-from-next(0)"}, {"attrs": {}, "action": "repeat", "yield": [{"dst": "$between"}]}]},
    ]
}

QUERIES |= {
    "q25_event_filter": _of(BY_TYPE, event_filter=_CNF),
    "q26_filter_missing_field": _of(BY_TYPE, event_filter=_CNF_MISSING),
    "q33_missing_field": _of(NO_FIELD, values),
    "q34_q35_json_program": lambda spark, sf_dir: counters(engine.run(NEGATED, events(spark, sf_dir))),
}
ORACLE_SQL |= {
    "q25_event_filter": _sql("SELECT count(*) FILTER (type = 'click') AS clicks, count(*) FILTER (type <> 'click') AS others FROM ev WHERE type IN ('click', 'view') AND k <> '7'"),
    "q26_filter_missing_field": _sql("SELECT count(*) FILTER (type = 'click') AS clicks, count(*) FILTER (type <> 'click') AS others FROM ev WHERE type <> 'error'"),
    "q33_missing_field": _sql("SELECT '&seen' AS var, 'click|' AS value, count(*) AS n FROM ev WHERE type = 'click'"),
    "q34_q35_json_program": _sql(
        """SELECT count(*) FILTER (rn > error AND type <> 'click') AS others, count(*) FILTER (rn > bought AND (error IS NULL OR rn < error)) AS between FROM ev LEFT JOIN
        (SELECT e.id, min(bought) AS bought, min(rn) FILTER (type = 'error' AND rn > bought) AS error FROM ev e JOIN (SELECT id, min(rn) AS bought FROM ev WHERE type = 'purchase' GROUP BY id) b ON e.id = b.id GROUP BY e.id) USING (id)"""
    ),
}

SKETCH = """
start ->
    receive
        type = "click" -> yield cookie to ^users, yield cookie,k to ^pairs, yield cookie,k to #pairs
        * -> repeat
"""


@_query("q36_sketch_error", "SELECT true AS users_close, true AS pairs_close")
def q36(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the estimates are within a twentieth of the exact numbers."""
    estimate = F.udf(hll.estimate, "double", useArrow=True)
    w = engine.run(SKETCH, events(spark, sf_dir)).wide().withColumnsRenamed({"^users": "u", "^pairs": "p", "#pairs": "s"})
    users = F.size(F.array_distinct(F.transform("s", lambda x: F.split_part(x, F.lit(","), F.lit(1)))))
    close = lambda e, n: F.abs(estimate(e) - n) <= 0.05 * n
    return w.select(close(F.col("u"), users).alias("users_close"), close(F.col("p"), F.size("s")).alias("pairs_close"))


@_query("q37_sketch_hex")
def q37(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = engine.run(SKETCH, events(spark, sf_dir)).wide()
    return w.select(F.col("`^users`").alias("users"), F.col("`^pairs`").alias("pairs"))


@_query("q38_extract", _sql("SELECT id, ts, type, k FROM ev WHERE id IN (SELECT id FROM ev WHERE type = 'signup' AND k = '5')"))
def q38(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_histories([events(spark, sf_dir)], _users(spark, sf_dir, "event_type = 'signup' and get_json_object(props, '$.k') = '5'")).select("id", "ts", "type", "k")


@_query(
    "q39_extract_union",
    _sql(
        "SELECT id, 0 AS source, ts, type, k, '' AS status FROM ev WHERE type <> 'error' UNION ALL "
        "SELECT CAST(o_custkey AS VARCHAR), 1, epoch_us(o_orderdate) // 1000000, '', '', o_orderstatus FROM orders"
    ),
)
def q39(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"clauses": [[{"field": "type", "value": "error", "op": "notequal"}]]}
    return extract_histories([events(spark, sf_dir), orders(spark, sf_dir)], None, spec).select("id", "source", "ts", "type", "k", "status")


@_query("q40_lexicon", _sql("SELECT DISTINCT type AS value FROM ev UNION SELECT ''"))
def q40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon([events(spark, sf_dir)], "type")


ORDERS = """
foreach %s in @status
    start ->
        receive
            status = %s -> yield $n, waiting
            * -> repeat
    waiting ->
        receive
            status = "P" -> yield $then_open, start
            * -> repeat
        after 90d -> yield $lapsed, start
"""

_OEV = """ev AS (SELECT CAST(o_custkey AS VARCHAR) || '/' || s AS id, s, epoch_us(o_orderdate) // 1000000 AS ts, o_orderstatus AS status,
  row_number() OVER (PARTITION BY o_custkey, s ORDER BY o_orderdate, o_orderkey) AS rn FROM orders CROSS JOIN (VALUES ('F'), ('O'), ('nosuch')) v(s))"""


@_query(
    "q41_orders",
    _machine_sql(
        """e.s,
  CASE WHEN st = 1 AND ex > e.ts THEN CASE WHEN status = 'P' THEN 0 ELSE 1 END ELSE CASE WHEN status = e.s THEN 1 ELSE 0 END END,
  CASE WHEN NOT (st = 1 AND ex > e.ts) AND status = e.s THEN e.ts + 7776000 ELSE ex END,
  n + CASE WHEN NOT (st = 1 AND ex > e.ts) AND status = e.s THEN 1 ELSE 0 END,
  p + CASE WHEN st = 1 AND ex > e.ts AND status = 'P' THEN 1 ELSE 0 END,
  l + CASE WHEN st = 1 AND ex <= e.ts THEN 1 ELSE 0 END""",
        "s, CAST(sum(n) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS then_open, CAST(sum(l + st) AS BIGINT) AS lapsed",
        "'' AS s, " + _STATE + ", CAST(0 AS BIGINT) AS p, CAST(0 AS BIGINT) AS l",
        "FROM last GROUP BY s",
        _OEV,
    ),
)
def q41(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = engine.run(ORDERS, orders(spark, sf_dir), {"@status": [["F"], ["O"], ["nosuch"]]})
    return r.wide().select(F.col("`%s`").alias("s"), F.col("`$n`").alias("n"), F.col("`$then_open`").alias("then_open"), F.col("`$lapsed`").alias("lapsed"))


@_query("q42_json", _sql("SELECT '{\"$n\":' || count(ev.id) || ',\"%t\":\"' || t || '\"}' AS json FROM (VALUES ('click'), ('view'), ('nosuch')) v(t) LEFT JOIN ev ON type = t GROUP BY t"))
def q42(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_rows(engine.run(FOREACH, events(spark, sf_dir), {"@types": [["click"], ["view"], ["nosuch"]]}))


AT = """
start ->
    receive
        timestamp = "{}" -> yield $at
        * -> yield $others
"""


@_query("q43_timestamp_equals", _sql("SELECT count(*) FILTER (ts = t) AS at, count(*) FILTER (ts <> t) AS others FROM ev, (SELECT max(ts) AS t FROM ev)"))
def q43(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at the last second of all."""
    source = events(spark, sf_dir)
    last = source.rows(0, []).agg(F.max("_ts")).first()[0]
    return counters(engine.run(AT.format(last), source))


#: A timeout with yields only goes to the first block, with the same event.
PLAIN_AFTER = """
start ->
    receive
        type = "view" -> wait
        * -> yield $others
wait ->
    receive
        * -> repeat
    after 6h -> yield $lapsed
"""

#: One late event can run through several timeouts; a block entered by one starts when it was due.
CASCADE = """
start ->
    receive
        type = "click" -> one
        * -> repeat
one ->
    receive
        type = "purchase" -> yield $soon, start
        * -> repeat
    after 2h -> yield $first, two
two ->
    receive
        type = "purchase" -> yield $late, start
        * -> repeat
    after 30h -> yield $second, start
"""

#: The first block's own timeout runs only once the block has been entered by a move.
IDLE = """
start ->
    receive
        type = "click" -> yield $n, start
        * -> repeat
    after 4h -> yield $idle, start
"""

FIRST_OF_EACH = """
foreach %t in @types
    start ->
        receive
            type = %t -> yield $users, yield cookie,timestamp to #first, quit
            * -> repeat
"""

_LIVE = "st = 1 AND ex > e.ts"
#: What timeouts have made of the state before the event is looked at.
_CASCADED = "CASE WHEN st = 1 AND ex <= e.ts AND ex + 108000 > e.ts THEN 2 WHEN st > 0 AND ex + CASE st WHEN 1 THEN 108000 ELSE 0 END <= e.ts THEN 0 ELSE st END"
_TIMES = "CASE WHEN st = 1 AND ex <= e.ts THEN (e.ts - ex) // 14400 + 1 ELSE 0 END"

QUERIES |= {
    "q44_plain_after": _of(PLAIN_AFTER),
    "q45_cascade": _of(CASCADE),
    "q46_entry_timeout": _of(IDLE),
    "q47_quit_of_one_tuple": _of(FIRST_OF_EACH, lambda r: by_tuple(r, "#first"), params={"@types": [["click"], ["view"], ["nosuch"]]}),
}
ORACLE_SQL |= {
    "q44_plain_after": _machine_sql(
        f"""
  CASE WHEN {_LIVE} THEN 1 WHEN type = 'view' THEN 1 ELSE 0 END,
  CASE WHEN {_LIVE} THEN ex WHEN type = 'view' THEN e.ts + 21600 ELSE 0 END,
  n + CASE WHEN st = 1 AND ex <= e.ts THEN 1 ELSE 0 END,
  o + CASE WHEN NOT ({_LIVE}) AND type <> 'view' THEN 1 ELSE 0 END""",
        "CAST(sum(n + st) AS BIGINT) AS lapsed, CAST(sum(o) AS BIGINT) AS others",
        _STATE + ", CAST(0 AS BIGINT) AS o",
        "FROM last",
    ),
    "q45_cascade": _machine_sql(
        f"""
  CASE {_CASCADED} WHEN 0 THEN CASE WHEN type = 'click' THEN 1 ELSE 0 END ELSE CASE WHEN type = 'purchase' THEN 0 ELSE {_CASCADED} END END,
  CASE WHEN {_CASCADED} = 0 THEN CASE WHEN type = 'click' THEN e.ts + 7200 ELSE 0 END WHEN st = 1 AND {_CASCADED} = 2 THEN ex + 108000 ELSE ex END,
  n + CASE WHEN {_CASCADED} = 1 AND type = 'purchase' THEN 1 ELSE 0 END,
  f + CASE WHEN st = 1 AND {_CASCADED} <> 1 THEN 1 ELSE 0 END,
  l + CASE WHEN {_CASCADED} = 2 AND type = 'purchase' THEN 1 ELSE 0 END,
  s + CASE WHEN st > 0 AND {_CASCADED} = 0 THEN 1 ELSE 0 END""",
        "CAST(sum(n) AS BIGINT) AS soon, CAST(sum(f + CASE st WHEN 1 THEN 1 ELSE 0 END) AS BIGINT) AS first, CAST(sum(l) AS BIGINT) AS late, CAST(sum(s + CASE st WHEN 2 THEN 1 ELSE 0 END) AS BIGINT) AS second",
        _STATE + ", CAST(0 AS BIGINT) AS f, CAST(0 AS BIGINT) AS l, CAST(0 AS BIGINT) AS s",
        "FROM last",
    ),
    "q46_entry_timeout": _machine_sql(
        f"""
  CASE WHEN type = 'click' THEN 1 ELSE st END,
  CASE WHEN type = 'click' THEN e.ts + 14400 ELSE ex + 14400 * {_TIMES} END,
  n + CASE WHEN type = 'click' THEN 1 ELSE 0 END,
  i + {_TIMES}""",
        "CAST(sum(n) AS BIGINT) AS n, CAST(sum(i + st) AS BIGINT) AS idle",
        _STATE + ", CAST(0 AS BIGINT) AS i",
        "FROM last",
    ),
    "q47_quit_of_one_tuple": _sql("SELECT type AS t, id || '|' || min(ts) AS value, CAST(1 AS BIGINT) AS n FROM ev WHERE type IN ('click', 'view') GROUP BY type, id"),
}

OBJECT = """
-- a comment, and a program with all kinds of results
start ->
    receive
        type = "click" -> \\
            yield $clicks, \\
            yield k to #ks, \\
            yield type,k to &pairs
        * -> repeat -- another
"""


@_query(
    "q48_json_object",
    _sql(
        """SELECT '{"$clicks":' || (SELECT count(*) FROM c) || ',"#ks":[' || (SELECT string_agg('"' || k || '"', ',' ORDER BY k) FROM (SELECT DISTINCT k FROM c)) || '],"&pairs":{' ||
        (SELECT string_agg('"click,' || k || '":' || n, ',' ORDER BY 'click,' || k) FROM (SELECT k, count(*) AS n FROM c GROUP BY k)) || '}}' AS json""",
        "c AS (SELECT k FROM ev WHERE type = 'click')",
    ),
)
def q48(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_rows(engine.run(OBJECT, events(spark, sf_dir)))


def _hex_events(spark: SparkSession, sf_dir: str) -> EventSource:
    """Users by the hex form of their ids, as in side files."""
    e = events(spark, sf_dir)
    return EventSource(e.df, F.rpad(F.lower(F.hex(F.col("user_id").cast("string"))), 32, "0"), e.ts, e.fields, e.order, True)


def _written(spark: SparkSession, df: DataFrame, name: str) -> str:
    """CSV lines without a head in the shared folder; a temporary one only where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='stepweave-')}"
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.csv(path)
    return path


_HEX = "rpad(lower(hex(CAST({} AS VARCHAR))), 32, '0')"


@_query("q49_window_file", _sql(f"SELECT '&seen' AS var, {_HEX.format('id')} || '|' || low || '|' || high AS value, count(*) AS n FROM ev JOIN w USING (id) WHERE type = 'click' AND ts >= low AND ts < high GROUP BY id, low, high", _WINDOWS_SQL))
def q49(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows read from a file."""
    w = _windows(spark, sf_dir)
    path = _written(spark, w.withColumn("_id", F.rpad(F.hex("_id"), 32, "0")), "windows")
    return values(engine.run(BOUNDS, _hex_events(spark, sf_dir), windows=read_windows(spark, path)))


@_query("q50_exclude_file", ORACLE_SQL["q29_excludes"])
def q50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excluded histories read from a file."""
    out = _users(spark, sf_dir, "event_type = 'error' and get_json_object(props, '$.k') = '13'")
    path = _written(spark, out.select(F.rpad(F.lower(F.hex("_id")), 32, "0").alias("_id")), "excludes")
    return counters(engine.run(BY_TYPE, _hex_events(spark, sf_dir), excludes=read_excludes(spark, path)))


@_query("q51_dump_and_load", ORACLE_SQL["q15_skip_repeats"])
def q51(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories written as a table of rows and read back as a source."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='stepweave-')}"
    path = f"{folder.rstrip('/')}/histories-{uuid.uuid4().hex}"
    source = events(spark, sf_dir)
    rows = source.rows(0, ["type", "k"])
    rows.select(F.col("_id").alias("id"), F.col("_ts").alias("ts"), F.to_json(F.struct(F.col("_seq.k0").cast("string").alias("at"), F.col("_seq.k1").alias("event"))).alias("seq"), "type", "k").write.json(path)
    back = spark.read.schema("id string, ts long, seq string, type string, k string").json(path)
    return counters(engine.run(SKIP, EventSource(back, "id", "ts", {"type": "type", "k": "k"}, (F.get_json_object("seq", "$.at").cast("timestamp_ntz"), F.get_json_object("seq", "$.event").cast("long")), True)))
