"""Which row stays when several share an id."""

import small
from pyspark.sql import functions as F

from relweave.llm import near_duplicates


def test_the_least_text_stays(spark):
    a, b = small.prose(1, 80), small.prose(2, 80)
    rows = [(a, 1, "s", {"k": 1}), (b, 1, "s", None), (None, 2, "t", None), ("x", 2, "u", None), ("x", 2, "t", None), (small.prose(3, 50), 3, "v", {}), ("", None, "w", None), ("", None, "w", None)]
    documents = spark.createDataFrame(rows, "text string, doc_id long, source string, tags map<string,int>")
    for parts in (1, 4):
        left = near_duplicates.deduplicate(documents.repartition(parts, F.rand(parts)))
        assert left.columns == documents.columns
        found = sorted((r.doc_id is None, r.doc_id, r.text, r.source) for r in left.collect())
        assert [f[1] for f in found] == [1, 2, 3, None, None]
        assert found[0][2] == min(a, b) and found[1][2] is None and found[2][3] == "v"
