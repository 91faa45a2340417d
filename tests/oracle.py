"""Runs a query and its SQL over the same tables and compares rows, columns sorted by name."""

import math
from pathlib import Path

import duckdb


def rows(df_rows, names):
    order = sorted(names)
    at = [names.index(c) for c in order]

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return str(v) if type(v).__name__ == "Decimal" else v

    return order, sorted((tuple(plain(r[i]) for i in at) for r in df_rows), key=repr)


def compare(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = con.execute(sql)
    want = rows(cur.fetchall(), [d[0] for d in cur.description])
    df = query(spark, sf_dir)
    return rows([tuple(r) for r in df.collect()], df.columns), want
