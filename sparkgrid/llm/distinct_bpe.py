"""Byte-level BPE in which the cluster encodes each distinct pre-token once.

1. Blocks of documents are cut into pre-tokens. A block keeps its distinct
   pre-tokens once, and the positions as a stream of their numbers.
2. The distinct pre-tokens are dealt out by a hash of their bytes: all blocks'
   copies of one meet in a bucket, where it is encoded once. However frequent
   it is, it arrives once per block.
3. The ids go back to the blocks, where the stream of positions puts them in
   order, some documents at a time. Decoding looks the ids up in the table of
   token bytes; ``encode_and_decode`` does so in the task that has the ids, so
   that they need not pass through a second Python worker.

The pre-tokens of a block that fall into a bucket travel as one compressed
row, so the shuffle carries no more rows than it has segments anyway. The
streams pass through the same two shuffles unchanged: blocks are cut once, and
a lost executor costs only its own blocks. Blocks are bounded by
``BLOCK_CHARS`` (or hold one larger document); buckets by their number, which
follows ``spark.sql.shuffle.partitions``.

Defined cases: NULL text counts as empty and has no ids; special strings are
ordinary text; NULL and repeated ids are carried through row by row; a very long
text is a block of its own; only ids and texts are read, whatever other columns
are called; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkgrid.llm.common import lean, released, ship, text_or_empty
from sparkgrid.llm.pieces import Ragged, cut, gather, read_ranks, row_sums

BLOCK_CHARS = 10 << 20
PART = 1 << 19            # pre-tokens of a block whose ids are put together at a time
MIN_BUCKETS = 48
SEPARATOR = b"\xff"       # never part of UTF-8

# A block's stream (bucket -1), or the pre-tokens of a block that go to a bucket; in time, their ids.
BLOCK_SCHEMA = ("route int, block long, bucket int, words binary, ids array<{id}>, pieces binary, stream binary, "
                "homes binary")


def squeeze(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: the first bytes of all, then the second bytes, and so on."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def route(block: int, buckets: int) -> int:
    """Task of the stream of a block; block numbers of different tasks differ in their high bits only."""
    return zlib.crc32(block.to_bytes(8, "little")) % buckets


class Block:
    """Documents of one task whose pre-tokens are numbered together."""

    def __init__(self, pattern: regex.Pattern):
        self.pattern = pattern
        self.ids, self.counts, self.streams, self.chars = [], [], [], 0
        self.runs: dict[str, int] = {}      # runs of pre-tokens between single spaces, cut once
        self.cuts = Ragged()                # the pre-tokens of each run
        self.words: dict[str, int] = {}

    def add(self, doc_id, text: str) -> None:
        first, *rest = cut(text)
        rows = []
        for lead, runs in (("", [first] if first else []), (" ", rest)):
            for r in runs:
                at = self.runs.get(lead + r)
                if at is None:
                    at = self.runs[lead + r] = len(self.cuts)
                    words = self.words
                    self.cuts.append([words.setdefault(w, len(words)) for w in self.pattern.findall(lead + r)])
                rows.append(at)
        stream, _ = self.cuts.gather(np.array(rows, np.int64))
        self.streams.append(stream)
        self.ids.append(doc_id)
        self.counts.append(len(stream))
        self.chars += len(text)

    def rows(self, number: int, buckets: int) -> Iterator[tuple]:
        stream = np.concatenate(self.streams)
        # Frequent pre-tokens get small numbers, which compress best.
        order = np.argsort(-np.bincount(stream, minlength=len(self.words)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        every = list(self.words)
        words = [every[k].encode("utf-8") for k in order]
        homes = np.array([zlib.crc32(w) % buckets for w in words], np.uint32)
        by_home = np.argsort(homes, kind="stable")
        ends = np.searchsorted(homes[by_home], np.arange(1, buckets + 1))
        pack = zstandard.ZstdCompressor(level=3).compress
        yield (route(number, buckets), number, -1, None, self.ids, squeeze(np.array(self.counts)), squeeze(rank[stream]),
               squeeze(homes))
        for bucket, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends)):
            if b > a:
                held = pack(SEPARATOR.join([words[k] for k in by_home[a:b]]))
                yield bucket, number, bucket, held, None, None, None, None


@lean
def cut_blocks(batches: Iterable[pa.RecordBatch], pattern: str, buckets: int,
               schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    compiled = regex.compile(pattern)
    number = TaskContext.get().partitionId() << 24
    block = Block(compiled)

    def written() -> pa.RecordBatch:
        columns = zip(*block.rows(number, buckets))
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text")):
            block.add(doc_id, text.as_py())
            if block.chars >= BLOCK_CHARS:
                yield written()
                number, block = number + 1, Block(compiled)
    if block.ids:
        yield written()


def encoder(path: str, pattern: str):
    import tiktoken
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


@lean
def encode_buckets(batches: Iterable[pa.RecordBatch], path: str, pattern: str,
                   schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Puts ids in the place of pre-tokens; rows come sorted by bucket, and a bucket encodes a pre-token once."""
    encode = encoder(path, pattern).encode_ordinary
    bucket, known, ids = None, {}, Ragged()
    words_at = schema.get_field_index("words")
    for batch in batches:
        out = []
        for home, packed in zip(batch.column("bucket").to_pylist(), batch.column("words")):
            if home < 0:
                out.append(None)
                continue
            if home != bucket:
                bucket, known, ids = home, {}, Ragged()
            words = zstandard.ZstdDecompressor().decompress(packed.as_py()).split(SEPARATOR)
            for w in words:
                if w not in known:
                    known[w] = len(ids)
                    ids.append(encode(w.decode("utf-8")))
            values, lengths = ids.gather(np.array([known[w] for w in words]))
            out.append(squeeze(np.concatenate(([len(lengths)], lengths, values))))
        columns = batch.columns
        columns[words_at] = pa.array(out, schema.field("words").type)
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


@lean
def put_together(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(id, ids) of each document; the rows of a block follow each other, its stream first."""
    head, parts = None, {}
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k] for name in batch.schema.names}
            if row["bucket"].as_py() < 0:
                if head is not None:
                    yield from _documents(head, parts, schema)
                head, parts = row, {}
            else:
                parts[row["bucket"].as_py()] = row["words"].as_py()
    if head is not None:
        yield from _documents(head, parts, schema)


def _documents(head: dict, parts: dict[int, bytes], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    homes = unsqueeze(head["homes"].as_py())
    order = np.argsort(homes, kind="stable")
    coded = [unsqueeze(parts[b]) for b in sorted(parts)] or [np.zeros(1, np.uint32)]
    lengths = np.concatenate([c[1:1 + c[0]] for c in coded]).astype(np.int64)
    values = np.concatenate([c[1 + c[0]:] for c in coded])
    starts = np.cumsum(lengths) - lengths
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    stream = unsqueeze(head["stream"].as_py())
    doc_ids = head["ids"].values.cast(schema.field("id").type)
    pieces = unsqueeze(head["pieces"].as_py()).astype(np.int64)
    piece_ends = np.concatenate(([0], np.cumsum(pieces)))
    first = 0
    while first < len(pieces):
        last = max(first + 1, int(np.searchsorted(piece_ends, piece_ends[first] + PART, "right")) - 1)
        words = place[stream[piece_ends[first]:piece_ends[last]]]
        counts = lengths[words]
        ids = gather(values, starts[words], counts).view(np.int32)
        ends = np.concatenate(([0], np.cumsum(row_sums(counts, pieces[first:last])))).astype(np.int32)
        rows = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)).cast(schema.field("ids").type)
        yield pa.RecordBatch.from_arrays([doc_ids[first:last], rows], schema=schema)
        first = last


def _encoded_blocks(df: DataFrame, path: str, pattern: str, text: str, id_column: str) -> tuple[DataFrame, T.StructType]:
    """Blocks with their ids, each in one task for ``put_together``, and the schema of what that gives."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(f"`{id_column}`").alias("id"), text_or_empty(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    buckets = max(MIN_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))

    block_schema = T._parse_datatype_string(BLOCK_SCHEMA.format(id=kind))
    out_schema = T.StructType([T.StructField("id", rows.schema["id"].dataType),
                               T.StructField("ids", T.ArrayType(T.IntegerType()))])
    block_arrow = to_arrow_schema(block_schema)

    blocks = rows.mapInArrow(lambda b: cut_blocks(b, pattern, buckets, block_arrow), block_schema)
    dealt = blocks.repartition(buckets, "route").sortWithinPartitions("bucket", "block")
    coded = dealt.mapInArrow(lambda b: encode_buckets(b, path, pattern, block_arrow), block_schema)
    return coded.repartition(buckets, "block").sortWithinPartitions("block", "bucket"), out_schema


def encode_documents(df: DataFrame, path: str, pattern: str, text: str = "text",
                     id_column: str = "doc_id") -> DataFrame:
    """(id, ids): the token ids of each whole text, one row per row of ``df``."""
    blocks, schema = _encoded_blocks(df, path, pattern, text, id_column)
    arrow = to_arrow_schema(schema)
    return blocks.mapInArrow(lambda b: put_together(b, arrow), schema)


def encode_and_decode(df: DataFrame, path: str, pattern: str, text: str = "text",
                      id_column: str = "doc_id") -> DataFrame:
    """``round_trip`` of ``encode_documents``: each text's ids are decoded where they were put together."""
    blocks, ids_schema = _encoded_blocks(df, path, pattern, text, id_column)
    schema = T.StructType([ids_schema["id"], *T._parse_datatype_string(f"n_tokens long, {DIGESTS}")])
    ids_arrow, arrow = to_arrow_schema(ids_schema), to_arrow_schema(schema)
    return blocks.mapInArrow(lambda b: _decoded(put_together(b, ids_arrow), path, arrow), schema)


def token_table(path: str) -> list[bytes]:
    """Bytes of each token, by id."""
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


DIGESTS = "ids_sha256 string, decoded_sha256 string"


def digester(path: str) -> Callable[[np.ndarray], tuple[str, str]]:
    """Digests of the ids of one document, as written in decimal and as decoded."""
    table = token_table(path)
    numbers = [str(i) for i in range(len(table))]

    def row(ids: np.ndarray) -> tuple[str, str]:
        # One document at a time: as Python numbers the ids of a batch would take ten times their size.
        held = ids.tolist()
        written = " ".join([numbers[i] for i in held]).encode()
        return hashlib.sha256(written).hexdigest(), hashlib.sha256(b"".join([table[i] for i in held])).hexdigest()
    return row


@lean
def _decoded(batches: Iterable[pa.RecordBatch], path: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    digests = digester(path)
    for batch in batches:
        ids = batch.column("ids")
        ends, values = ids.offsets.to_numpy(), ids.values.to_numpy()
        made = zip(*[digests(values[a:b]) for a, b in zip(ends[:-1], ends[1:])])
        columns = [batch.column("id"), np.diff(ends), *map(list, made)]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type)
                                          for c, f in zip(columns, schema)], schema=schema)


def round_trip(encoded: DataFrame, path: str) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) from (id, ids)."""
    ship(encoded.sparkSession)

    @F.pandas_udf(DIGESTS)
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        row = digester(path)
        for batch in batches:
            yield pd.DataFrame([row(v) for v in batch], columns=["ids_sha256", "decoded_sha256"])
        released()

    return encoded.select("id", F.size("ids").cast("long").alias("n_tokens"), digests("ids").alias("d")).select(
        "id", "n_tokens", "d.*")


def decode_texts(encoded: DataFrame, path: str) -> DataFrame:
    """(id, text) from (id, ids)."""
    ship(encoded.sparkSession)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = token_table(path)
        for batch in batches:
            yield pd.Series([b"".join([table[i] for i in v.tolist()]).decode("utf-8", "replace") for v in batch],
                            dtype=object)

    return encoded.select("id", decode("ids").alias("text"))
