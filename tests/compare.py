"""Spark and DuckDB results side by side: columns by name, rows in sorted order, floats with a tolerance."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str, sql: str, only=TABLES) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in only:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], _ordered([tuple(r[i] for i in order) for r in out.fetchall()])


def rows_of(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, _ordered([tuple(r) for r in df.select(*names).collect()])


def _ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, round(x, 3) if isinstance(x, float) else x) if not isinstance(x, (list, dict)) else (False, str(x)) for x in r))


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-5) or (math.isnan(a) and math.isnan(b))
    return a == b or str(a) == str(b)


def assert_same(got, wanted):
    assert got[0] == wanted[0]
    assert len(got[1]) == len(wanted[1])
    wrong = [(x, y) for x, y in zip(got[1], wanted[1]) if not all(same(a, b) for a, b in zip(x, y))]
    assert not wrong, f"{len(wrong)} of {len(got[1])} rows differ, first {wrong[0]}"
