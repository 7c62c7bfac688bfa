"""The entry module loads with nothing but the Python sources of pyspark, and without the llm folders."""

import json
import os
import subprocess
import sys
import zipfile
from pathlib import Path

import pyspark
import pytest

from catalog.stop_words import ENGLISH

ROOT = Path(__file__).resolve().parent.parent


def names(cwd, path, prelude=""):
    code = prelude + "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    env = os.environ | {"PYTHONPATH": os.pathsep.join(map(str, path)), "PYTHONDONTWRITEBYTECODE": "1"}
    out = subprocess.run([sys.executable, "-c", code], cwd=cwd, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    return json.loads(out.stdout.splitlines()[-1])


def test_loads_from_the_zips_that_pyspark_ships():
    zips = sorted(Path(pyspark.__file__).parent.glob("python/lib/*.zip"))
    if not zips or not any("pyspark/__init__.py" in zipfile.ZipFile(z).namelist() for z in zips):
        pytest.skip("no zips beside pyspark")
    queries, sql = names(ROOT, [*zips, ROOT])
    assert len(queries) >= 158 and set(sql) <= set(queries)


def test_loads_without_the_llm_folders(tmp_path):
    for name in ("waxworks", "catalog"):
        for source in (ROOT / name).rglob("*.py"):
            if "llm" not in source.relative_to(ROOT).parts:
                target = tmp_path / source.relative_to(ROOT)
                target.parent.mkdir(parents=True, exist_ok=True)
                target.write_bytes(source.read_bytes())
    (tmp_path / "__spark_entry__.py").write_bytes((ROOT / "__spark_entry__.py").read_bytes())
    queries, _ = names(tmp_path, [tmp_path])
    assert len(queries) >= 158 and not any(n.startswith("op") or n == "pipeline" for n in queries)


def test_stop_words_are_those_of_spark(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert list(ENGLISH) == StopWordsRemover.loadDefaultStopWords("english")
