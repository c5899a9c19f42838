import ast
import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_only_the_entry_knows_the_optional_subpackage():
    for path in [*(ROOT / "latticework").rglob("*.py"), ROOT / "bench.py"]:
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("latticework.llm") or n == "corpus_pipeline" for n in names), path


def test_entry_works_without_it():
    code = "import sys\nsys.modules['latticework.llm'] = None\nimport __spark_entry__ as e\nassert 'bfs_down' in e.queries() and not any(q.startswith('op1') or q == 'pipeline' for q in e.queries())\nassert e.oracle_sql().keys() <= e.queries().keys()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
