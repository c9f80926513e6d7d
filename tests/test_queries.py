"""Every registered query against its SQL on the smallest tables; those without SQL must have rows."""

import os

import duckdb
import pytest

from twinlens.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels pages".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    def plain(v):
        if v is None or v != v:
            return None
        return round(v, 9) + 0.0 if isinstance(v, float) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE:
        assert rows(got) == rows(db.execute(ORACLE[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pair_calls_scores_whole_windows(spark, monkeypatch):
    from twinlens import queries

    widths, feature_window = [], queries.SEQ.feature_window
    monkeypatch.setattr(queries.SEQ, "feature_window", lambda sites, vectors, width, flank: widths.append(2 * flank + 1) or feature_window(sites, vectors, width, flank))
    assert len(QUERIES["pair_calls"](spark, DATA).columns) and widths == [33, 33]


def test_of_equal_line_numbers_the_first_in_the_files_is_a_read(spark, db, tmp_path):
    li = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag"
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    # the second file is larger, so that Spark reads it first; each of its rows has an equal line number in the first
    db.execute(f"COPY (SELECT {li} FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey < 200) TO '{folder}/0.parquet'")
    db.execute(f"COPY (SELECT {li.replace('l_quantity', 'l_quantity % 50 + 1 AS l_quantity')} FROM lineitem WHERE l_returnflag = 'R') TO '{folder}/1.parquet'")
    con = duckdb.connect()
    con.execute(f"SET threads = 1; CREATE VIEW lineitem AS SELECT * FROM '{folder}/*.parquet'")
    want = rows(con.execute(ORACLE["read_matrices"]).df())
    assert rows(QUERIES["read_matrices"](spark, str(tmp_path)).toPandas()) == want and len(want[1]) > 50
