"""Side-by-side comparison of a query with its SQL twin."""

from pathlib import Path

import duckdb


def _rows(frame, columns):
    def plain(v):
        v = v.item() if hasattr(v, "item") else v
        return None if v is None or v != v else v

    return sorted(repr(tuple(plain(v) for v in row)) for row in frame[columns].itertuples(index=False))


def same(spark, query, sql, folder):
    con = duckdb.connect()
    for f in Path(folder).iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    ours, theirs = query(spark, folder).toPandas(), con.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours, sorted(ours.columns)) == _rows(theirs, sorted(ours.columns))
    return ours
