"""Every registered query runs, and returns what its SQL returns."""

import json
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from maskline.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.8g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.8g}")
    return v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    rows, names = df.collect(), df.columns
    if name not in catalog.ORACLES:
        return
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS FROM '{SF}/{f}'")
    cur = con.execute(catalog.ORACLES[name])
    theirs = [c[0] for c in cur.description]
    assert sorted(names) == sorted(theirs)
    order = sorted(names)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr)
    assert mine == sorted((tuple(plain(r[theirs.index(c)]) for c in order) for r in cur.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_serves_without_the_training_data_folders(tmp_path, pipeline_too):
    top = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    gone = shutil.ignore_patterns("llm", ".git", "__pycache__", *(["corpus_pipeline.py"] if pipeline_too else []))
    shutil.copytree(top, tmp_path / "copy", ignore=gone)
    told = "import __spark_entry__ as e, json; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    said = subprocess.run([sys.executable, "-B", "-c", told], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": str(tmp_path / "copy")}, capture_output=True, text=True, check=True)
    assert said.stdout.strip() == json.dumps([sorted(catalog.QUERIES), sorted(catalog.ORACLES)])
