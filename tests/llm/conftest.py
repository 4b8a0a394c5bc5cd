import duckdb
import pytest


@pytest.fixture()
def same_as_sql():
    """Compare a DataFrame with DuckDB SQL over the given tables (name -> rows and columns)."""

    def check(df, sql, **tables):
        con = duckdb.connect()
        for name, t in tables.items():
            arrow = t.toArrow()
            con.register(name, arrow)
        got = con.execute(sql)
        names = [c[0] for c in got.description]
        assert sorted(df.columns) == sorted(names)
        order = sorted(names)
        key = lambda rows: sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])
        want = key([tuple(r[names.index(c)] for c in order) for r in got.fetchall()])
        have = key([tuple(r[c] for c in order) for r in df.collect()])
        assert have == want
        return have

    return check
