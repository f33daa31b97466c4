import os
import subprocess
import sys

import __spark_entry__ as entry

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_query_with_sql_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 40


def test_import_without_the_corpus_operators(tmp_path):
    """The rest stands alone when the llm folders and the pipeline are gone."""
    import shutil

    shutil.copy(f"{HERE}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{HERE}/ledgerloom", tmp_path / "ledgerloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k[2:3].isdigit() for k in e.queries() if k.startswith('op')))"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0 and said.stdout.split()[1] == "False" and int(said.stdout.split()[0]) > 30
