"""Streaming page ingest: files in a folder → flattened parquet, exactly once."""

import json
import os
import tempfile

from honorlens.streaming.ingest import start_ingest


def _page(i):
    return {"laureates": [{"id": str(i), "givenName": {"en": f"P{i}"}, "birth": {"date": "1900-01-01"},
                           "nobelPrizes": [{"awardYear": "1950", "category": {"en": "Peace"}},
                                           {"awardYear": "1961", "category": {"en": "Peace"}}]}]}


def test_stream_ingest_available_now(spark):
    root = tempfile.mkdtemp(prefix="honorlens-stream-")
    pages, out, ckpt = (os.path.join(root, d) for d in ("pages", "out", "ckpt"))
    os.makedirs(pages)
    for i in range(3):
        with open(os.path.join(pages, f"p{i}.json"), "w") as f:
            json.dump(_page(i), f)
    start_ingest(spark, pages, out, ckpt).awaitTermination()
    assert spark.read.parquet(out).count() == 6
    # a second run with no new files adds nothing (checkpointed progress)
    start_ingest(spark, pages, out, ckpt).awaitTermination()
    assert spark.read.parquet(out).count() == 6
    with open(os.path.join(pages, "p9.json"), "w") as f:
        json.dump(_page(9), f)
    start_ingest(spark, pages, out, ckpt).awaitTermination()
    assert spark.read.parquet(out).count() == 8
