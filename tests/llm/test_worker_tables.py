"""What a Python worker holds between the tasks of different operators."""
import gc

import public_tokenizers as P
import pyarrow as pa

from epsgrid.llm import bpe, common, queries


def test_codec_leaves_the_worker_with_its_operator(spark, make_docs):
    docs = make_docs([(i, f"some text {i}") for i in range(20)]).coalesce(1)

    def held(batches):
        gc.unfreeze()
        n = sum(type(o).__name__ == "Codec" for o in gc.get_objects())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    encoded = bpe.encode_documents(docs, P.path(queries.VOCABULARY), P.PATTERN)
    first = sorted(map(tuple, encoded.collect()))
    assert [r.n for r in common.map_arrow(docs.select("doc_id"), held, "n long").collect()] == [0]
    assert sorted(map(tuple, encoded.collect())) == first


def test_one_table_at_a_time():
    made = []
    make = lambda: made.append(1) or object()
    before = gc.get_threshold()
    a = common.keep_tables("a", make)
    assert common.keep_tables("a", make) is a and len(made) == 1
    common.keep_tables("b", make)
    assert list(common._TABLES) == ["b"]
    common.drop_tables()
    assert not common._TABLES and gc.get_threshold() == before and gc.get_freeze_count() == 0
