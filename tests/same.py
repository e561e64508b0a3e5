"""Comparison of a Spark result with DuckDB's for the same tables."""
import math


def rows_of(frame, columns):
    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        return repr(round(float(x), 9)) if isinstance(x, float) else str(x)

    return sorted(repr(tuple(plain(x) for x in row)) for row in zip(*(frame[c] for c in columns)))


def assert_same(spark_df, con, sql):
    found = con.execute(sql)
    names, rows = [d[0] for d in found.description], found.fetchall()
    got, want = spark_df.toArrow().to_pydict(), {name: [row[i] for row in rows] for i, name in enumerate(names)}
    assert sorted(got) == sorted(want)
    assert rows_of(got, sorted(got)) == rows_of(want, sorted(got))
