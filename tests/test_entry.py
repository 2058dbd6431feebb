import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_optional_subpackage(tmp_path, pipeline):
    """The entry module works where the optional subpackage is deleted, with and without the pipeline's file."""
    optional = "".join(("l", "lm"))
    shutil.copytree(os.path.join(ROOT, "tessera"), tmp_path / "tessera", ignore=shutil.ignore_patterns(optional, "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    if pipeline:
        if not os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
            pytest.skip("no pipeline")
        shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 40 and set(s) <= set(q); assert not any(k.startswith('op') or k == 'pipeline' for k in q if k[2:3].isdigit() or k == 'pipeline'); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_optional_subpackage():
    optional = "tessera." + "".join(("l", "lm"))
    for folder, _, names in os.walk(os.path.join(ROOT, "tessera")):
        if os.path.basename(folder) == optional.split(".")[1]:
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert optional not in f.read(), name
