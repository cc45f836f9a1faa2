import os
import tempfile

import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def plain(v):
    """A value in one form whatever engine it comes from."""
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def same_rows(df, relation):
    columns = sorted(df.columns)
    names = [d[0] for d in relation.description]
    assert columns == sorted(names)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    theirs = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in relation.fetchall())
    assert ours == theirs
