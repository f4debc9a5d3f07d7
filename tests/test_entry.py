"""The driver's contract, and every query beside its SQL on the smallest tables."""

import math
import os
import sys

import pytest

import __spark_entry__ as entry
from docgraph import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    ours = sorted(([plain(r[c]) for c in sorted(df.columns)] for r in df.collect()), key=repr)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert ours == sorted(([plain(r[i]) for i in order] for r in result.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).columns == ["dst", "src", "place"]


def test_without_the_llm_parts():
    """Nothing else imports them."""
    import subprocess

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'backlinks_topk' in e.queries() and not any(k.startswith('op') and k[2:3].isdigit() for k in e.queries()); assert not any('llm' in m for m in sys.modules)"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_with_both_llm_folders_deleted(tmp_path):
    """A copy without them: the entry imports, queries equal their SQL, and the other tests are collected."""
    import shutil
    import subprocess

    root = os.path.dirname(os.path.abspath(entry.__file__))
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(q) == set(o) and len(q) > 150"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)
    ran = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests", "-k", "test_front or test_toml or test_leaves or (test_query_equals_its_sql and (backlinks_topk or search_basic))"], cwd=copy, capture_output=True, text=True)
    assert ran.returncode == 0, ran.stdout[-2000:]
