"""Domain relations as views over the analytic tables, for Spark and for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORD = "cast(l_linenumber as bigint) * 1000000000 + l_partkey * 10000 + l_suppkey"

#: One text for both engines, or a (Spark, DuckDB) pair.
VIEWS: dict[str, str | tuple[str, str]] = {
    "fx_strain": "SELECT s.s_suppkey AS strain_id, s.s_name AS name, r.r_name AS genus, n.n_name AS species, cast(1000000 + floor(abs(s.s_acctbal)) AS bigint) AS genome_len FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey",
    "fx_sample": "SELECT o_orderkey AS sample_id, cast(year(o_orderdate) * 12 + month(o_orderdate) AS int) AS t, cast(o_custkey % 50 AS int) AS sample_name, o_orderkey % 1000 + 1 AS depth, CASE WHEN o_orderkey % 3 = 0 THEN 'single' WHEN o_orderkey % 3 = 1 THEN 'paired_1' ELSE 'paired_2' END AS read_type FROM orders",
    "fx_hit": f"SELECT cast(year(l_shipdate) AS int) AS t, l_orderkey AS read_id, {ORD} AS ord, l_partkey AS frag_id, l_suppkey AS strain_id, -(l_quantity * 2 + l_discount * 10) AS ll FROM lineitem",
    "fx_interval": f"SELECT l_suppkey AS strain_id, l_returnflag AS gene, l_orderkey AS read_id, {ORD} AS ord, cast(l_partkey * 20 AS bigint) AS s, cast(l_partkey * 20 + l_quantity * 4 AS bigint) AS e, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand FROM lineitem",
    "fx_aln": f"SELECT l_orderkey AS read_id, {ORD} AS ord, l_partkey AS marker_id, cast(100 + l_orderkey % 51 AS int) AS read_len, cast(100 + l_orderkey % 51 - l_linenumber % 4 AS int) AS n_match, cast(100 + l_orderkey % 51 + l_linenumber % 3 AS int) AS aln_len, cast(l_discount * 40 AS double) AS exp_err, l_returnflag = 'R' AS is_edge FROM lineitem",
    "fx_seq": (
        "SELECT doc_id AS seq_id, regexp_replace(upper(text), '[^ACGT]', '') AS seq FROM documents",
        "SELECT doc_id AS seq_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents",
    ),
    "fx_mate": "SELECT conv_id, turn, conv_id * 1000 + turn - turn % 2 AS pair_id, turn % 2 = 0 AS is_forward, cast(length(text) % 5 AS bigint) AS strain_id, -cast(length(text) AS double) / 10 AS ll FROM conversations",
    "fx_series": "SELECT cast(day(ts) AS int) AS t, user_id AS strain_id, event_id AS sample_no, event_type AS kind, value FROM events",
    "fx_json": ("SELECT event_id, cast(get_json_object(props, '$.k') AS int) AS k FROM events", "SELECT event_id, cast(json_extract_string(props, '$.k') AS int) AS k FROM events"),
    "fx_vec": "SELECT vec_id, label, embedding FROM embeddings",
}


def _used(sql: str, names: list[str] | dict) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", sql)]


def _with(sql: str, side: int) -> str:
    ctes = [f"{n} AS ({v if isinstance(v := VIEWS[n], str) else v[side]})" for n in _used(sql, VIEWS)]
    if not ctes:
        return sql
    sql = sql.strip()
    head = ", ".join(ctes)
    return f"WITH {head}, {sql[5:]}" if sql[:5].upper() == "WITH " else f"WITH {head} {sql}"


def duck(sql: str) -> str:
    """The text with the views it names, for DuckDB."""
    return _with(sql, 1)


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a text over the tables of a folder, with the views it names; no view of the session is touched."""
    text = _with(sql, 0).replace("{", "{{").replace("}", "}}")
    tables = _used(text, TABLES)
    for table in tables:
        text = re.sub(rf"\b{table}\b", f"{{{table}}}", text)
    return spark.sql(text, **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in tables})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run(spark, sf_dir, f"SELECT * FROM {name}")
