"""The driver's entry lists the engine's queries whatever state the training-data operators are in."""

import os
import shutil
import subprocess
import sys

import pytest

from recallscope.plans import catalog

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("broken", ["nothing", "one module", "all"])
def test_entry_without_operators(tmp_path, broken):
    for name in ("recallscope", "__spark_entry__.py", "corpus_pipeline.py"):
        source = f"{REPO}/{name}"
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path / name)
    llm = tmp_path / "recallscope" / "llm"
    there = (llm / "queries.py").exists()
    if broken == "one module":
        for name in ("katz.py",):
            (llm / name).unlink(missing_ok=True)
    elif broken == "all":
        shutil.rmtree(llm, ignore_errors=True)
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), 'pipeline' in q, set(o) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120,
                         env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    queries, twins, pipeline, subset = out.stdout.split()[-4:]
    assert int(twins) >= len(catalog.queries()) and subset == "True"
    assert pipeline == str(there and broken == "nothing")
    if broken != "nothing":
        assert int(queries) == int(twins) == len(catalog.queries())
