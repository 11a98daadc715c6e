"""Compare registered queries with their SQL restatement in DuckDB."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(value):
    if value is None:
        return "null"
    if isinstance(value, float):
        if math.isnan(value) or math.isinf(value):
            return str(value)
        return f"{value + 0.0:.5f}"
    return str(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(row[i]) for i in order) for row in rows)


def difference(frame, con, sql: str) -> str | None:
    """None when both sides agree, else a short description."""
    left = table_of(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(sql)
    right = table_of([d[0] for d in result.description], result.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if left[1] != right[1]:
        only_left = sorted(set(left[1]) - set(right[1]))[:3]
        only_right = sorted(set(right[1]) - set(left[1]))[:3]
        return f"rows {len(left[1])} != {len(right[1])}: spark {only_left} sql {only_right}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from varicube.session import build_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    spark = build_session("oracle-check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracle = connect(sf_dir), entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            if name not in oracle:
                verdict = f"no sql, {queries[name](spark, sf_dir).count()} rows"
            else:
                verdict = difference(queries[name](spark, sf_dir), con, oracle[name]) or "ok"
        except Exception as error:  # noqa: BLE001
            verdict = f"ERROR {type(error).__name__} {str(error)[:600]}"
        print(f"{name:30s} {time.time() - start:6.1f}s {verdict}", flush=True)


if __name__ == "__main__":
    main()
