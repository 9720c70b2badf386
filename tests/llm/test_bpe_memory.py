"""What a task of byte-level BPE holds: parts of a block, one Python worker, small batches."""

import random

import pyarrow as pa
import public_tokenizers as public

from sparkgrid.llm import distinct_bpe
from sparkgrid.llm.common import ship
from tests.llm import data

RANKS = public.path("byte_bpe_50k.tiktoken")


def test_ids_are_decoded_where_they_are_put_together(spark):
    df = data.with_clashes(data.frame(spark, data.rows()))
    found = distinct_bpe.encode_and_decode(df, RANKS, public.PATTERN)
    expected = distinct_bpe.round_trip(distinct_bpe.encode_documents(df, RANKS, public.PATTERN), RANKS)
    assert found.dtypes == expected.dtypes

    def rows(table):
        return sorted(map(repr, table.collect()))
    assert rows(found) == rows(expected)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "decoded_sha256" in plan.split("Exchange")[0]
    assert distinct_bpe.encode_and_decode(data.frame(spark, []), RANKS, public.PATTERN).isEmpty()


def test_a_block_is_put_together_in_parts(monkeypatch):
    monkeypatch.setattr(distinct_bpe, "PART", 30)
    block = distinct_bpe.Block(distinct_bpe.regex.compile(public.PATTERN))
    texts = ["", *(data.sentence(random.Random(k), 12) for k in range(20)), "", data.sentence(random.Random(7), 90), ""]
    for k, text in enumerate(texts):
        block.add(k, text)
    fields = [("route", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()),
              ("ids", pa.list_(pa.int64())), ("pieces", pa.binary()), ("stream", pa.binary()), ("homes", pa.binary())]
    schema = pa.schema(fields)
    rows = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*block.rows(1, 4)), schema)],
                                      schema=schema)
    coded = distinct_bpe.encode_buckets([rows], RANKS, public.PATTERN, schema)
    out = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    parts = list(distinct_bpe._documents(*_head_and_parts(next(coded)), out))
    assert len(parts) > 5 and [i for p in parts for i in p.column("id").to_pylist()] == list(range(len(texts)))
    encode = distinct_bpe.encoder(RANKS, public.PATTERN).encode_ordinary
    assert [i for p in parts for i in p.column("ids").to_pylist()] == [encode(t) for t in texts]


def _head_and_parts(batch):
    rows = [{name: batch.column(name)[k] for name in batch.schema.names} for k in range(batch.num_rows)]
    head, *parts = sorted(rows, key=lambda r: r["bucket"].as_py())
    return head, {r["bucket"].as_py(): r["words"].as_py() for r in parts}


def test_batches_are_bounded_in_bytes(spark):
    ship(spark)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["bytes"])
    wide = spark.range(0, 1000, 1, 1).selectExpr("repeat(cast(id as string), 20000) as text")
    assert max(r.bytes for r in wide.mapInArrow(sizes, "bytes long").collect()) < 9 << 20
