from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillmesh.session import table

SF = "/root/testdata/sf0.001"


def test_whole_contents_of_all_documents_are_ingested(spark):
    given = table(spark, SF, "source_documents").where("doc_id is not null and content is not null").select("doc_id", "content").distinct()
    end = F.ceil((F.length("content") - 1000) / 900.0)
    last = given.where("length(content) > 0").select(F.concat("doc_id", F.lit("#"), F.greatest(end, F.lit(0)).cast("string")).alias("id"))
    got = entry.queries()["ingest_upsert"](spark, SF)
    assert last.count() > 0 and last.join(got, "id", "left_anti").count() == 0
    assert entry.queries()["orphan_delete"](spark, SF).count() > 0
