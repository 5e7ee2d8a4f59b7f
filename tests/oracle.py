"""Compare a query with its SQL the way the driver does: rows, columns and values, whatever their order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, float):
        return round(x, 6)
    return str(x) if x is not None and not isinstance(x, (int, str)) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(frame, con, sql):
    """None if equal, else what differs."""
    got_columns = frame.columns
    got = rows_of(got_columns, [tuple(r) for r in frame.collect()])
    table = con.sql(sql)
    want_columns = table.columns
    want = rows_of(want_columns, table.fetchall())
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {got_columns} and {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; only here {sorted(set(got) - set(want), key=repr)[:3]}, only there {sorted(set(want) - set(got), key=repr)[:3]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} rows, such as {bad[:2]}" if bad else None
