import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["key", "count"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_text_operators(tmp_path):
    """The rest imports, and has its queries, when that subpackage and the pipeline are gone."""
    shutil.copytree(ROOT / "brookline", tmp_path / "brookline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in q), sorted(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
