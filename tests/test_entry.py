"""The entry points, with and without the optional subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_llm(tmp_path):
    to = tmp_path / "repo"
    shutil.copytree(HERE, to, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'r4_lexical_search' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=to, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_nothing_else_imports_llm():
    for d, _, names in os.walk(os.path.join(HERE, "quillspark")):
        if os.path.basename(d) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "quillspark.llm" not in open(os.path.join(d, n), encoding="utf-8").read(), n
