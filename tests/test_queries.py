"""Every registered domain query against its SQL."""

from __future__ import annotations

import pytest
from conftest import SF, compare

from matchframe.plans import core, exports, landed, more, replays  # noqa: F401


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_same_as_sql(spark, name):
    compare(spark, core.QUERIES, core.ORACLE_SQL, [name])


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert core.QUERIES[name](spark, SF).count() > 0


def test_entry_works_without_the_corpus_folders(tmp_path):
    """The registered domain queries stay when the corpus subpackage is taken away."""
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "matchframe", tmp_path / "matchframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'h2h_pairs' in e.queries() and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
