"""The driver's contract, the catalogue against DuckDB, and plans."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

from tidemark.plans import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
REPO = Path(__file__).resolve().parent.parent
needs_data = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


def _plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((repr(tuple(_plain(r[i]) for i in order)) for r in rows))


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_catalogue_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = QUERIES[name](spark, str(DATA))
    want = con.sql(ORACLE_SQL[name])
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(want.columns, want.fetchall())


def test_whole_document_queries(spark, tmp_path):
    """Documents with dates of their own and with no-break spaces are in the results, against values by hand and by brute force."""
    texts = {1: "It ran on May 1, 2019 and 2020/03/04", 2: " a\u00a0\u00a0b\u3000\n1234 😀 ", 3: "plain"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    day = lambda i: f"2023-01-0{i + 1}"
    appended = {i: f"{day(i)} 00 {day(i)} 00 {day(i)} 02 {day(i)} 00" for i in texts}
    got = dict(tuple(r) for r in QUERIES["find_dates"](spark, str(tmp_path)).collect())
    assert got == appended | {1: f"2019-05-01 00 2020-03-04 00 {appended[1]}"}
    lines = {r["doc_id"]: (r["line"], r["units"]) for r in QUERIES["space_and_units"](spark, str(tmp_path)).collect()}
    assert lines == {i: (" ".join(t.split()), len(t.encode("utf-16-le")) // 2) for i, t in texts.items()}


@needs_data
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and set(QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("left", [False, True])
def test_without_the_corpus_operators(tmp_path, left):
    """The rest imports and answers where the corpus folders and the pipeline are gone."""
    import shutil

    for name in ("tidemark", "__spark_entry__.py"):
        (shutil.copytree if (REPO / name).is_dir() else shutil.copy)(REPO / name, tmp_path / name)
    shutil.rmtree(tmp_path / "tidemark" / "llm", ignore_errors=True)
    if left:  # an empty folder, and the pipeline without what it imports
        (tmp_path / "tidemark" / "llm").mkdir()
        (tmp_path / "corpus_pipeline.py").write_text("from tidemark.llm import language\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'normalize_url' in q and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


@needs_data
def test_plans(spark):
    """Scans read the asked columns only, filters reach them, and small sides are broadcast."""
    plan = QUERIES["article_view"](spark, str(DATA))._jdf.queryExecution().toString()
    assert "o_totalprice" not in plan.rsplit("== Physical Plan ==", 1)[1] and "BroadcastHashJoin" in plan
    plan = QUERIES["topn_global"](spark, str(DATA))._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [IsNotNull(event_type)" in plan
    plan = QUERIES["cap_oldest_first"](spark, str(DATA))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    plan = QUERIES["html_to_text_pages"](spark, str(DATA))._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "url" not in plan.rsplit("ReadSchema", 1)[1]
