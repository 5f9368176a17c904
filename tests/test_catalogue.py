import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from buildproof.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df):
    text = lambda v: "null" if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    df = df[sorted(df.columns)]
    return sorted(tuple(text(v) for v in row) for row in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, duck, name):
    found, want = QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    numbers = lambda df: df.astype({c: "float64" for c in df.columns if pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c])})
    assert canonical(numbers(found.toPandas())) == canonical(numbers(want))


def test_rest_works_without_the_llm_folders(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'd_grain_001' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql(); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
