"""The library without its optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*sorted(q))"


def registered(at: Path) -> set[str]:
    done = subprocess.run([sys.executable, "-c", SAY], cwd=at, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(at)})
    assert done.returncode == 0, done.stderr
    return set(done.stdout.split())


@pytest.mark.parametrize("gone", [["fleetscope/llm", "tests/llm", "corpus_pipeline.py"], ["fleetscope/llm", "tests/llm"], ["corpus_pipeline.py"]])
def test_optional_parts_can_be_deleted(tmp_path, gone):
    if not (ROOT / "fleetscope/llm").exists():
        pytest.skip("deleted already")
    at = tmp_path / "copy"
    shutil.copytree(ROOT, at, ignore=lambda folder, names: {
        n for n in names if n in (".git", "__pycache__") or str((Path(folder) / n).relative_to(ROOT)) in gone})
    left = registered(at)
    optional = {k for k in left if k == "pipeline" or k[:2] == "op" and k[2].isdigit()}
    assert left - optional >= {"d2_differential", "s3_split_stream", "h9_run_pack"}
    assert bool(optional) == (gone == ["corpus_pipeline.py"]) and "pipeline" not in left


def test_nothing_else_imports_the_optional_package():
    for path in [*ROOT.glob("fleetscope/**/*.py"), *ROOT.glob("checks/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts and path.name != "test_entry.py":
            text = path.read_text()
            assert "fleetscope.llm" not in text and "from .llm" not in text and "corpus_pipeline" not in text, path
