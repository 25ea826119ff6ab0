import os
import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_every_oracle_has_a_query():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 150


def test_the_rest_works_without_the_training_data_parts():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("tessera.llm", "corpus_pipeline"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "tpch_q1" in e.queries() and not any(q.startswith("op") and q[2].isdigit() or q == "pipeline" for q in e.queries())
assert "tpch_q1" in e.oracle_sql()
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_the_rest_works_where_the_parts_are_deleted(tmp_path):
    import shutil

    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tpch_q1' in q and 'pipeline' not in q and not any(x.startswith('op1_') for x in q) and e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env=env)


def test_what_the_parts_need_is_not_passed_over():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "ahocorasick":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
try:
    e.queries()
except ImportError as x:
    assert x.name == "ahocorasick"
else:
    raise AssertionError
"""
    if (ROOT / "tessera" / "llm").exists():
        subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_names_the_subpackage():
    for path in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path


def test_flagship(spark):
    import __spark_entry__ as entry

    if Path("/root/testdata/sf0.001").exists():
        assert entry.entry(spark).count() > 0
