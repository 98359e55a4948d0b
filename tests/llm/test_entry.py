"""The text queries over the smallest data: each runs, gives each row once and the columns that are asked for."""

import pytest

from marginalia.llm import queries as Q

COLUMNS = {
    "p1_found": ["page_id", "field_name", "line_no", "kind"], "p4_found": ["note_id_a", "note_id_b"], "p5_found": ["tbl", "row_id", "kind"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "kind"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_single_rows(spark, data, name):
    df = Q.QUERIES[name](spark, data)
    assert df.columns == COLUMNS[name]
    assert all(t in ("bigint", "string", "array<bigint>") for _, t in df.dtypes)
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))


def test_p4_equals_sql(spark, data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW notes AS SELECT * FROM '{data}/notes.parquet'")
    assert {tuple(r) for r in Q.p4_found(spark, data).collect()} == set(con.sql(Q.P4_FOUND).fetchall())


def test_excluded_and_kept_make_up_all(spark, data):
    kept, found = Q.p9_kept(spark, data), Q.p9_found(spark, data)
    assert kept.count() + found.count() == spark.read.parquet(f"{data}/documents.parquet").count()
