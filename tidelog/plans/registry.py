"""The registry of queries and of their SQL."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers ``f(spark, sf_dir)`` under its name; ``sql`` gives the same rows in DuckDB."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Common table expressions of the workloads.
EV = """ev AS (SELECT user_id AS key, event_id AS seq,
  CASE WHEN event_type = 'signup' THEN 'PUT' WHEN event_type = 'error' AND event_id % 10 = 0 THEN 'RANGE_DELETE' WHEN event_type = 'error' THEN 'DELETE' ELSE 'MERGE' END AS op,
  CAST(floor(value * 100 + 0.5) AS BIGINT) AS value, CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN user_id + 3 END AS end_key, epoch_us(ts) AS ts FROM events)"""
ORD = """o AS (SELECT o_custkey AS key, o_orderkey AS seq, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS value, epoch_us(o_orderdate) AS ts FROM orders)"""
LI = """li AS (SELECT l_partkey AS key, CAST(l_quantity AS BIGINT) AS value, l_returnflag, l_orderkey, l_linenumber FROM lineitem)"""
PROBE = """probe AS (SELECT CAST(n_nationkey * 7 AS BIGINT) AS key FROM nation)"""
DKV = """kv AS (SELECT source || ':' || CAST(doc_id AS VARCHAR) AS key, doc_id AS seq, text AS value, lang FROM documents)"""
TR = """tr AS (SELECT CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'SEEK' WHEN 'signup' THEN 'PUT' WHEN 'error' THEN 'DELETE' ELSE 'MERGE' END AS type,
  user_id AS key, event_id AS seq, epoch_us(ts) AS access_time, CAST(CASE WHEN value > 100 THEN length(props) ELSE 0 END AS BIGINT) AS value_size FROM events)"""


def resolved(source: str = "ev", where: str = "TRUE", ranges: bool = True, name: str = "res") -> str:
    """State of a mixed log with added merges, as expressions to put after the log's."""
    cover = f"AND NOT EXISTS (SELECT 1 FROM {source} t WHERE {where.replace('seq', 't.seq').replace('ts <', 't.ts <')} AND t.op = 'RANGE_DELETE' AND t.seq > p.seq AND p.key >= t.key AND p.key < t.end_key)" if ranges else ""
    return f"""{name}_pts AS (SELECT p.* FROM {source} p WHERE {where} AND p.op <> 'RANGE_DELETE' {cover}),
{name}_base AS (SELECT *, max(CASE WHEN op <> 'MERGE' THEN seq END) OVER (PARTITION BY key) AS base_seq FROM {name}_pts),
{name}_live AS (SELECT * FROM {name}_base WHERE seq >= coalesce(base_seq, -1)),
{name} AS (SELECT key, CAST(max(seq) AS BIGINT) AS seq, CAST(count(*) FILTER (op = 'MERGE') AS BIGINT) AS n_operands,
  CAST(CASE WHEN count(*) FILTER (op = 'MERGE') = 0 THEN max(value) FILTER (op = 'PUT') ELSE coalesce(max(value) FILTER (op = 'PUT'), 0) + sum(value) FILTER (op = 'MERGE') END AS BIGINT) AS value
  FROM {name}_live GROUP BY key HAVING bool_or(op <> 'DELETE'))"""
