import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    got = entry.entry(spark)
    pairs = {(x.u, x.v) for x in got.collect()}
    assert pairs and all((v, u) in pairs for u, v in pairs) and len({u for u, _ in pairs}) == len(pairs)


def test_without_the_second_part(tmp_path):
    """The rest of the library stands alone."""
    for name in ("pairwright", "__spark_entry__.py"):
        copy = shutil.copytree if (ROOT / name).is_dir() else shutil.copy
        copy(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "pairwright/llm", ignore_errors=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e, sys; print(len(e.queries()), any('llm' in m for m in sys.modules))"], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) > 50 and said[1] == "False"


def test_with_a_library_missing():
    """What the second part needs and does not find takes none of the graph queries along."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') and n[2].isdigit() for n in q), set(e.oracle_sql()) <= set(q))"
    ran = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    said = ran.stdout.split()
    assert int(said[0]) > 50 and said[1:] == ["False", "True"] and ("xxhash" in ran.stderr or not (ROOT / "pairwright/llm").is_dir())
