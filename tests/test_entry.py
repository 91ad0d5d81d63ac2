"""The driver contract, with and without the optional subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["g", "src", "dst", "weight", "distance"] and df.count() > 0


def test_queries_stand_without_the_text_subpackage():
    code = "import sys; sys.modules['panelforge.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(k.startswith('op') and k[2].isdigit() for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, env={**os.environ, "PYTHONPATH": ROOT})


def test_nothing_else_imports_the_text_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "panelforge")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name), encoding="utf-8") as f:
                        assert "panelforge.llm" not in (text := f.read()) and "from .llm" not in text and "from ..llm" not in text
