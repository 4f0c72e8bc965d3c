"""Every query with SQL gives DuckDB's rows on a small folder; the entry works without the training-data folder."""

import glob
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from inkstone.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(value):
    if value is None or value != value:
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) or type(value).__name__ == "Decimal" else value


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_like_sql(spark, tables, name):
    got = registry.queries()[name](spark, DATA)
    cursor = tables.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()), key=repr) == want


def test_odd_sources_like_sql(spark, tmp_path):
    """Texts that are null, blank or open oddly, and documents that are told twice, give the SQL's rows too."""
    blank = [" " * 25 + "late", "\u2003" * 30, "\xa0", "\x0b", "", " ", None]
    texts = [*blank, "plain text", "co\xad\noperate now", "A\xad\r\nB c", "\xad\nx", "\x85nel word", "\xa0 wide", "a\\Eb c", "-5% up", "x" * 30 + " y"]
    rows = [(5005 * k + r, t, "en") for k, t in enumerate(texts) for r in (0, 1, 7, 11, 13, 14, 26, 77, 91)]
    rows += [(7, "again", "en"), (7, "again", "en"), (7, "again", "de"), (-7, "below", "en"), (-121, "below", "en"), (None, "none", "en"), (14, "none", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["source_errors"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(registry.oracle_sql()["source_errors"]).fetchall()
    assert sorted((r["source_id"], r["errors"]) for r in got) == sorted(want) and len(want) > 100


def test_works_without_optional_folders(tmp_path):
    """The rest of the library imports, and its tests pass, where the training-data folders and the pipeline are gone."""
    root = Path(__file__).resolve().parents[1]
    for folder in ("inkstone", "tests"):
        (tmp_path / folder).mkdir()
        for p in (root / folder).iterdir():
            if p.name != "llm":
                (tmp_path / folder / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(root / "__spark_entry__.py")
    (tmp_path / "tests" / "conftest.py").unlink()
    (tmp_path / "tests" / "conftest.py").write_text((root / "tests" / "conftest.py").read_text())
    code = "import __spark_entry__ as e, inkstone; assert inkstone.__file__.startswith({!r}); assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']; assert e.oracle_sql()"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code.format(str(tmp_path))], cwd=tmp_path, check=True, env=env)
    if not os.environ.get("INKSTONE_STRIPPED"):
        subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests/test_documents.py", "tests/test_sources.py"], cwd=tmp_path, check=True, env=env | {"INKSTONE_STRIPPED": "1"})
