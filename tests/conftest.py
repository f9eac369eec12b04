import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from millrace.session import build

    session = build("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return con


def canonical(rows, columns):
    """Rows as sorted text, floats to nine digits."""

    def text(v):
        if v is None or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v)

    return sorted(tuple(text(r[c]) for c in columns) for r in rows)


@pytest.fixture(scope="session")
def same(spark, duck, small):
    """Compares a registered query with its SQL at the smallest scale."""

    def check(query, sql):
        df = query(spark, small)
        other = duck.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(other.columns)
        ours = canonical([r.asDict() for r in df.collect()], columns)
        theirs = canonical([dict(zip(other.columns, r, strict=True)) for r in other.fetchall()], columns)
        assert ours == theirs

    return check
