import importlib.util
import os
import pathlib
import re
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def test_queries_and_their_sql_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and set(s) <= set(q); print(len(q))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout) > 70


CORE_ONLY = "import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and 'p5_found' not in q, sorted(q); assert set(e.oracle_sql()) <= set(q)"


def _run(cwd, code, **env):
    return subprocess.run([sys.executable, "-c", code], cwd=cwd, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(cwd), **env})


@pytest.mark.parametrize("left_over", ["nothing", "empty folder", "caches"])
def test_the_core_stands_without_the_optional_subpackage(tmp_path, left_over):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "alinea", tmp_path / "alinea", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if left_over != "nothing":
        (tmp_path / "alinea" / "llm" / ("__pycache__" if left_over == "caches" else "")).mkdir(parents=True)
    done = _run(tmp_path, CORE_ONLY)
    assert done.returncode == 0, done.stderr


def test_the_core_stands_if_a_library_of_the_optional_subpackage_is_missing():
    if importlib.util.find_spec("alinea.llm") is None:
        pytest.skip("no optional subpackage")
    done = _run(ROOT, "import sys; sys.modules['regex'] = None; " + CORE_ONLY)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_optional_subpackage():
    for path in ROOT.glob("alinea/**/*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"^\s*(from|import) alinea\.llm", path.read_text(), re.M), path


def test_no_unbounded_collect_and_no_local_checkpoint():
    for path in ROOT.glob("alinea/**/*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text and ".toPandas()" not in text, path
