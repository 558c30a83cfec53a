import os
import sys
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import SparkSession

SMALL = Path("/root/testdata/sf0.001")
HERE = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])  # for the Python workers


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


#: Names that operators use inside, as columns of the input.
CLASHING = "key value chunk n part place rank offset total k g s d w a b m e v p i who copy served words area item size pos start body state base pivot cluster home parts range rounds supply near maybe spread whole by at grp".split()


def _hostile(table):
    """``table`` with rows of nulls, its first row once per column with that column null, all rows again, clashing columns."""
    nulls = pa.table([pa.nulls(2, f.type) for f in table.schema], names=table.column_names)
    first = table.slice(0, 1)
    single = [first.set_column(i, f.name, pa.nulls(1, f.type)) for i, f in enumerate(table.schema)]
    plain = [t.cast(pa.schema([pa.field(f.name, f.type) for f in table.schema])) for t in (table, table, nulls, *single)]
    out = pa.concat_tables(plain)
    for name in CLASHING:
        if name not in out.column_names:
            out = out.append_column(name, pa.array(["x"] * len(out)))
    return out


@pytest.fixture(scope="session", params=["empty", "hostile"])
def edge_folder(request, tmp_path_factory):
    """All tables without a row, or with nulls, repeated rows and clashing columns."""
    if not SMALL.exists():
        pytest.skip("no test tables here")
    folder = tmp_path_factory.mktemp(request.param)
    for path in SMALL.glob("*.parquet"):
        table = pq.read_table(path)
        pq.write_table(table.slice(0, 0) if request.param == "empty" else _hostile(table), folder / path.name)
    return str(folder)


def same_as_sql(spark, folder, query, sql):
    """The rows of ``query``, having checked that they are those of ``sql`` in DuckDB where there is one."""
    found = query(spark, folder)
    names = sorted(found.columns)
    rows = sorted((tuple(r[c] for c in names) for r in found.collect()), key=str)
    if sql:
        con = duckdb.connect()
        for path in Path(folder).glob("*.parquet"):
            con.execute(f"create view {path.stem} as select * from '{path}'")
        want = con.execute(f"select {', '.join(names)} from ({sql})").fetchall()
        assert str(rows) == str(sorted(want, key=str))
    return rows
