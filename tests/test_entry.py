import subprocess
import sys
from pathlib import Path

import __spark_entry__


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() == 2


def test_without_the_training_data_operators():
    code = "import sys; sys.modules['graphloom.llm'] = sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True)


def test_one_missing_package_leaves_the_rest():
    """Without a package that only those operators need, or without the pipeline, the other queries are there."""
    for missing, has_ops in (("xxhash", False), ("corpus_pipeline", True)):
        code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and 'pipeline' not in q and any(n.startswith('op1_') for n in q) == {has_ops}; assert set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True)
