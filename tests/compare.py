"""Comparing a query's rows with those of its DuckDB SQL."""

import math
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def canonical(frame):
    names = sorted(frame.columns)
    rows = frame[names].astype(object).itertuples(index=False, name=None)
    return names, sorted((tuple(_plain(v) for v in r) for r in rows), key=repr)


def sql_rows(sf_dir, sql):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return canonical(connection.execute(sql).df())
