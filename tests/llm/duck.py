import os

import duckdb

TABLES = "documents pages benchmark labels conversations".split()


def run(sql, sf_dir, **frames):
    """Rows of a query over the tables of a folder, or over given Arrow tables."""
    con = duckdb.connect()
    for t in TABLES:
        if t in frames:
            con.register(t, frames[t])
        elif os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).to_arrow_table()


def same(df, sql, sf_dir, **frames):
    """True if the frame has the rows of the query, columns by name."""
    got, want = df.toArrow(), run(sql, sf_dir, **frames)
    names = sorted(want.column_names)
    assert sorted(got.column_names) == names
    rows = [sorted(map(repr, zip(*(t.column(c).to_pylist() for c in names)))) for t in (got, want)]
    return rows[0] == rows[1]
