import os
import tempfile

from tests.test_sources_models import _write_layout


def test_incremental_ingest(spark):
    from pvlake.streaming.ingest import start_ingest

    root = tempfile.mkdtemp(prefix="pvlake-stream-in-")
    out = tempfile.mkdtemp(prefix="pvlake-stream-out-") + "/table"
    ckpt = tempfile.mkdtemp(prefix="pvlake-stream-ckpt-")
    _write_layout(root)
    q = start_ingest(spark, root, out, ckpt)
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 4
    # a new file arrives: only it is ingested on the next run
    os.makedirs(f"{root}/test2/EP0000001C", exist_ok=True)
    with open(f"{root}/test2/EP0000001C/2024-01-05.csv", "w") as fh:
        fh.write("us_timestamp,pvGenTotal,latitude,longitude\n2024-01-05 12:00:00,0.3,10.0,10.0\n")
    q = start_ingest(spark, root, out, ckpt)
    q.awaitTermination(120)
    df = spark.read.parquet(out)
    assert df.count() == 5
    assert df.filter("split = 'test2'").select("deviceSn").first()[0] == "EP0000001C"
