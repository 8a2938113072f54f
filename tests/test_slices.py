"""A worker holds few rows as Python objects at once, whatever the batch."""

import pandas as pd
import pyarrow as pa

from litmine.operators import ner, slices


def test_slices_are_small_and_whole(monkeypatch):
    monkeypatch.setattr(slices, "SLICE_BYTES", 4096)
    batch = pa.RecordBatch.from_pandas(pd.DataFrame({"k": range(1000), "text": ["x" * 100] * 1000}))
    parts = list(slices.sliced(batch))
    assert max(p.num_rows for p in parts) <= 40 and pa.Table.from_batches(parts).to_pandas().equals(batch.to_pandas())
    assert [p.num_rows for p in slices.sliced(batch.slice(0, 0))] == []


def test_matchers_take_slices(spark):
    """No operator on texts hands whole batches to pandas; null texts and large numbers come through."""
    docs = spark.createDataFrame([(2**60 + 1, "the oil"), (2, None), (3, "oil")], "doc_id long, text string").coalesce(1)
    found = ner.match_trie(spark, docs, spark.createDataFrame([("X", "oil", "oil")], "label string, pattern string, canonical string"))
    assert "MapInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.doc_id, r.start) for r in found.collect()} == {(2**60 + 1, 4), (3, 0)}
