"""Run a registered query and its SQL side by side."""

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def compare(spark, name, query, sql, sf_dir):
    """Fail with the first rows that differ between Spark and DuckDB."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got, want = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns), (name, sorted(got.columns), sorted(want.columns))
    names = sorted(got.columns)

    def rows(frame):
        return sorted(
            tuple("null" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r)
            for r in frame[names].itertuples(index=False, name=None)
        )

    a, b = rows(got), rows(want)
    assert len(a) == len(b), (name, len(a), len(b))
    for x, y in zip(a, b, strict=True):
        assert x == y, (name, names, x, y)
