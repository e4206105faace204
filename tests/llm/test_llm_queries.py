import pytest

import __spark_entry__ as entry
from quillmesh.llm import queries as Q

SF = "/root/testdata/sf0.001"
FOUND = {"p1_found": ["id_a", "id_b"], "p2_found": ["response_id", "defect"], "p3_found": ["source_table", "record_id", "kind"], "p4_found": ["response_id"], "p5_found": ["doc_a", "doc_b"], "p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "reading_level"]}


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    assert rows or name == "p4_limits"
    if name in FOUND:
        assert df.columns == FOUND[name] and len(set(rows)) == len(rows)


def test_p5_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW source_documents AS SELECT * FROM '{SF}/source_documents.parquet'")
    assert sorted(map(tuple, Q.p5_found(spark, SF).collect())) == sorted(con.execute(Q.SQL["p5_found"]).fetchall())
