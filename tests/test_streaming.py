from helpers import SF_SMALL
from epsgrid.operators.detect import detect
from epsgrid.plans import fixtures as fx
from epsgrid.session import scratch_path
from epsgrid.streaming import detect_stream


def test_stream_batches_match_batch_detection(spark):
    df, idc, feats = fx.events2d(spark, SF_SMALL)
    src = scratch_path(spark, "stream-src")
    df.write.parquet(src)
    out = scratch_path(spark, "stream-out")
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = detect_stream(stream, feats, 23.1, 8, idc, out)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    want = detect(df, feats, 23.1, 8, idc).outliers
    assert sorted(got.columns) == sorted([*want.columns, "batch_id"])
    assert sorted(r[0] for r in got.select(idc).collect()) == sorted(r[0] for r in want.select(idc).collect())
