import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages conversations part"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_training_part(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("foliant.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "foliant.llm", None)
    names = entry.queries()
    assert "hybrid_search" in names and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names)


def test_flagship(spark):
    assert entry.entry(spark).columns == ["chunk_id", "book_title", "source", "rank", "score"]


@pytest.mark.parametrize("name", ["keyword_all_terms", "semantic_search", "section_counts", "outline_lines", "isbn_checks", "page_furniture", "intake_status"])
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES.split():
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    flat = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert flat(got.select(*names).collect()) == flat(want.fetchall())
