"""Relations that the queries read, derived from the tables in SQL that Spark and other engines both run.

Text relations come from documents and benchmark; marks, units, logs and scores, which no table holds, are made of
the rows of lineitem, supplier, events and others, all rows of them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SQL = {
    "marks": """SELECT l_orderkey * 8 + l_linenumber AS mark_id, l_orderkey % 97 AS page, CAST(l_partkey % 90 + 10 AS STRING) AS numeral, l_tax * 10 AS confidence,
        CAST(l_quantity AS DOUBLE) / 64.0 AS x, CAST(l_extendedprice AS DOUBLE) / 131072.0 AS y, 0.015625 AS w, 0.015625 AS h, l_returnflag AS engine,
        CASE WHEN l_linestatus = 'F' THEN 180 WHEN l_linenumber = 3 THEN 90 ELSE 0 END AS angle FROM lineitem""",
    "text_labels": "SELECT DISTINCT CAST(p_size + 40 AS STRING) AS label FROM part",
    "mentions": "SELECT CAST(o_custkey AS STRING) AS doc_id, CAST(o_orderkey % 50 AS STRING) AS label, CAST(o_orderkey * 7 % 100000 AS BIGINT) AS pos FROM orders",
    "refs": "SELECT CAST(o_custkey AS STRING) AS doc_id, CAST(o_orderkey % 9 + 1 AS STRING) AS fig, CAST(o_orderkey * 13 % 100000 AS BIGINT) AS at_pos FROM orders",
    "units": """SELECT 'd' AS doc_id, 'claim ' || CAST(c_custkey AS STRING) AS name, CASE WHEN c_custkey >= 2 THEN 'claim ' || CAST(CAST(FLOOR(c_custkey / 2.0) AS BIGINT) AS STRING) END AS parent,
        c_custkey * 100 AS char_start, c_custkey * 100 + 100 AS char_end FROM customer""",
    "claims": "SELECT o_custkey AS doc_id, o_orderkey AS number, CASE WHEN o_orderstatus <> 'F' THEN o_orderkey - o_orderkey % 7 + 3 END AS depends_on FROM orders",
    "log": """SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'session_start' WHEN 'error' THEN 'check_claim' WHEN 'click' THEN 'check_support' ELSE 'verify' END AS kind,
        CASE WHEN event_type = 'signup' THEN 'u' || CAST(user_id AS STRING) END AS label, CASE WHEN event_type IN ('click', 'error') THEN props END AS query,
        CASE WHEN event_type IN ('click', 'error') THEN CASE WHEN value < 10 THEN 'insufficient' ELSE 'supported' END END AS status, CASE WHEN event_type IN ('view', 'purchase') THEN value < 15 END AS ok FROM events""",
    "items": """SELECT user_id AS item_id, min(event_id) % 3 <> 0 AS answerable, CASE min(event_id) % 4 WHEN 0 THEN 'reject-false-premise' WHEN 1 THEN 'partial-abstain' WHEN 2 THEN 'refuse-to-adjudicate' END AS behavior FROM events GROUP BY user_id""",
    "runs": "SELECT user_id AS item_id, value < 12 AS ok FROM events WHERE event_type = 'view'",
    "confidences": "SELECT round(CAST(l_discount * 10 AS DOUBLE), 4) AS confidence, l_linenumber % 2 = 0 AS ok FROM lineitem",
    "scores": "SELECT round(value, 2) AS score, user_id % 2 = 0 AS present FROM events",
    "adjudications": """SELECT event_id AS seq, 'a' || CAST(CASE WHEN event_id % 500 = 7 THEN event_id - 1 ELSE event_id END AS STRING) AS adj_id, CASE event_type WHEN 'view' THEN 'CONFIRM' WHEN 'click' THEN 'CORRECT' WHEN 'error' THEN 'REFUTE' WHEN 'signup' THEN 'NOTE' ELSE 'CONFIRM' END AS kind,
        'n' || CAST(user_id AS STRING) AS target, 'p' AS by_who, '2024-01-01' AS on_day, CASE WHEN value > 1 THEN CAST(value AS STRING) END AS value, CASE WHEN event_id % 5 = 0 AND event_id > 20 THEN 'a' || CAST(event_id - 20 AS STRING) WHEN event_id % 997 = 0 THEN 'zz' END AS supersedes, event_id % 10 = 0 AS machine FROM events""",
    "ranges": """SELECT CAST(o_custkey AS STRING) AS doc_id, o_orderkey % 400 AS char_start, o_orderkey % 400 + 5 + o_orderkey % 60 AS char_end, CASE o_orderkey % 3 WHEN 0 THEN 'figure' WHEN 1 THEN 'label' ELSE 'closest' END AS kind FROM orders""",
    "sheets": "SELECT CAST(l_suppkey AS STRING) AS doc_id, l_orderkey * 8 + l_linenumber AS sheet, CAST(l_quantity AS DOUBLE) AS w, CAST(l_linenumber AS DOUBLE) AS h FROM lineitem",
    "figures_of": "SELECT CAST(l_orderkey % 97 AS BIGINT) AS page, CAST(l_partkey % 30 AS STRING) AS fig, CAST(l_tax AS DOUBLE) AS confidence FROM lineitem WHERE l_linenumber = 1",
}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation over the tables of a directory."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in SQL[name].split()}
    for t in frames:
        frames[t].createOrReplaceTempView(f"veridoc_{t}")
    text = re.sub(r"\bFROM (\w+)", lambda m: f"FROM veridoc_{m[1]}" if m[1] in frames else m[0], SQL[name])
    return spark.sql(text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
