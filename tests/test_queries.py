"""Every registered query against its DuckDB equivalent, and the shape of those that SQL can't express."""

from __future__ import annotations

import os

import pytest
from pagewright import queries

from .conftest import normal


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf, duck, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) and normal(got) == normal(want)


def test_full_page_record(spark, sf):
    rows = queries.QUERIES["full_page_record"](spark, sf).collect()
    assert len(rows) == 50
    for r in rows:
        assert r.quarantine is None and r.lane == "own" and r.rung == "fetch" and r.content_kind == "html" and r.extractor_version == "1"
        assert len(r.body_sha256) == len(r.text_sha256) == len(r.content_region_sha256) == 64
        assert r.markdown.startswith("# ") and r.title and r.links and not r.outbound_hosts and r.same_content >= 1


def test_entry_without_the_other_subpackage(tmp_path):
    """The entry module still imports when the pipeline and its subpackage are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/pagewright", tmp_path / "pagewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    (tmp_path / "pagewright" / "llm" / "__pycache__").mkdir(parents=True)  # what deleting the sources may leave
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 40 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
