"""The stages one after another on the smallest tables, and the entry without the subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@needs_data
def test_stages(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(P.STAGES) - 1:
            assert docs.columns == names
            now = [r.doc_id for r in docs.select("doc_id").collect()]
            assert len(now) == len(set(now)) and set(now) <= kept
            kept = set(now)
        if name == "secret scans":
            assert docs.where("text rlike '[0-9a-f]{32}|AKIA[A-Z0-9]{12}'").count() == 0
    assert {r.doc_id for r in docs.select("doc_id").collect()} == kept and len(kept) > 50
    total = docs.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).where("`sum(length)` <> `max(doc_tokens)`").count()
    assert total == 0


@needs_data
def test_all_queries_run(spark):
    import __spark_entry__ as e

    found = e.queries()
    assert "pipeline" in found
    for n in range(1, 11):
        (name,) = [q for q in found if q.startswith(f"op{n}_")]
        if n in (1, 2, 6):
            assert found[name](spark, SF).count() > 0
    assert found["pipeline"](spark, SF).count() > 0


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "granary", tmp_path / "granary", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(x.startswith('op') and x[2].isdigit() for x in q) and 'pipeline' not in q; print(len(q), len(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
