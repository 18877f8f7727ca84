"""The entry file with and without the operators for training data."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"


def names(folder):
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True).stdout
    return [set(line.split()) for line in out.splitlines()]


def copy_without(target, *left_out):
    shutil.copytree(ROOT / "orderloom", target / "orderloom", ignore=shutil.ignore_patterns("__pycache__", *left_out))
    for file in {"__spark_entry__.py", "corpus_pipeline.py"} - set(left_out):
        if (ROOT / file).exists():
            shutil.copy(ROOT / file, target / file)
    return target


def test_without_the_operators_for_training_data(tmp_path):
    """Whatever of them is missing, the other queries are all there, with their SQL."""
    from orderloom.plans.catalog import QUERIES
    from orderloom.plans.oracles import ORACLE_SQL

    for k, left_out in enumerate((("llm", "corpus_pipeline.py"), ("llm",), ("corpus_pipeline.py",))):
        folder = copy_without(tmp_path / str(k), *left_out)
        if k == 1:
            (folder / "orderloom" / "llm").mkdir()  # as a deletion may leave it
        found, sql = names(folder)
        assert found == set(QUERIES) and sql == set(ORACLE_SQL)


def test_other_missing_modules_are_faults(tmp_path):
    folder = copy_without(tmp_path / "broken")
    (folder / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    run = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True)
    assert run.returncode and "a_module_that_is_not_there" in run.stderr
