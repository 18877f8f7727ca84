"""Runs a registered query and its SQL counterpart and compares the rows."""

import duckdb

TABLES = ("orders", "lineitem", "part", "customer", "events")


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    """Rows with columns in name order, sorted; floats as given."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def differences(spark, con, query, sql, folder):
    """Empty when both give the same columns, types of values and rows."""
    df = query(spark, folder)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(names, found.fetchall())
    if ours != theirs:
        odd = [r for r in ours if r not in set(theirs)][:3], [r for r in theirs if r not in set(ours)][:3]
        return f"{len(ours)} rows != {len(theirs)} rows, e.g. {odd}"
    return ""
