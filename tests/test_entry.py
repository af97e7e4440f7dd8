"""The driver's contract, with and without the subpackage for training data."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
import pytest

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "keep", "reasons"] and df.count() == 1000


def test_works_without_the_subpackage(tmp_path):
    for p in ("palimpsest", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, tmp_path / p)
    shutil.rmtree(tmp_path / "palimpsest/llm", ignore_errors=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert said.stdout.split()[1] == "False" and int(said.stdout.split()[0]) > 60, said.stderr


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "palimpsest").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "palimpsest").parts:
            assert "palimpsest.llm" not in p.read_text(), p


@pytest.mark.parametrize("name", ["forget_combined", "prune_decide", "tree_ls", "read_coalesce", "vfs_latest_and_identical", "repair_snapshots"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df, rel = __spark_entry__.queries()[name](spark, SF), db.sql(__spark_entry__.oracle_sql()[name])
    order = sorted(df.columns)
    assert sorted(rel.columns) == order
    mine = sorted((tuple(str(r[c]) for c in order) for r in df.collect()))
    at = [rel.columns.index(c) for c in order]
    assert mine == sorted(tuple(str(r[i]) for i in at) for r in rel.fetchall())


def test_streamed_snapshots_are_kept_once(spark, tmp_path):
    from palimpsest.streaming.ingest import into_table

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"id": "1", "time": "x"}\n{"id": "2", "time": "y"}\n{"id": "1", "time": "x"}\n')
    for more in (None, '{"id": "2", "time": "y"}\n{"id": "3", "time": "z"}\n'):
        if more:
            (source / "b.json").write_text(more)
        stream = spark.readStream.schema("id string, time string").json(str(source))
        into_table(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2", "3"]
