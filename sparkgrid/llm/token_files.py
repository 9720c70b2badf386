"""Token ids of all documents in id order, in files of Simple-8b words.

A cheap pass over the ids alone finds the bounds of as many shards as there
are shuffle partitions. Documents are encoded where they are read, and only
their ids move, to the shard whose range they fall into; there they are sorted
and packed into segments of about ``SEGMENT`` ids. A segment is a row of the
written table: document ids, lengths and token ids as Simple-8b words, and the
offset of each block of words. Reading all decodes segments one by one; reading
some documents (``read_documents``) decodes the blocks that they lie in. The
number of ids before a document comes from sums over segments and shards.

Defined cases: NULL text counts as empty and has the end id only; NULL ids come
first; rows with equal ids are ordered by the checksum of their texts, and a
hot id is split between shards; a very long text is encoded in chunks and is
one document of its segment; other columns are not read, whatever their names;
an empty table gives an empty file table.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkgrid.llm import simple8b
from sparkgrid.llm.common import lean, ship, text_or_empty
from sparkgrid.llm.pieces import added_tokens, load_tokenizer
from sparkgrid.llm.word_table import WordTable
from sparkgrid.session import join_small, staging_path

END = 2
SEGMENT = 1 << 18
HELD_BYTES = 24 << 20   # of known pieces that a worker keeps between groups of texts
GROUP_CHARS = 1 << 18
MAX_SIGNS = 10_000

WHITE = "\n\t\r\x0b\x0c"
# A word of letters that no normalization changes but for their case, and a run of ASCII signs: a pre-token each. An
# apostrophe may begin a pre-token of its own with the letters behind it.
PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")
# A full stop or comma at the end of a piece that may belong to a longer run of signs; after letters or digits it is one alone.
SIGNS = re.compile("[^A-Za-z0-9\xc0-\xd6\xd8-\xf6\xf8-\xff ][.,] ")
FILE_COLUMNS = "shard int, segment int, n_docs long, n_ids long, ids array<{id}>, lengths binary, words binary, offsets binary"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    out, spare = [], 256
    for b in range(256):
        printable = 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE
        out.append(chr(b if printable else spare))
        spare += not printable
    return out


class PieceIds:
    """Ids of pieces between ASCII white space, for a tokenizer that drops white space; lives in a worker."""

    def __init__(self, path: str, limit: int = HELD_BYTES):
        self.tokenizer, self.added = load_tokenizer(path), added_tokens(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.table, self.signs = WordTable(limit), {}

    def pieces(self, text: str) -> bytes:
        """The pieces of a text, each with a space behind it."""
        for c in WHITE:
            if c in text:
                text = text.replace(c, " ")
        text += " "
        if not SIGNS.search(text):
            text = text.replace(". ", " . ").replace(", ", " , ")
        # The tokenizer lowers case itself; for A-Z it can as well be done for all pieces at once.
        return text.encode("utf-8").lower()

    def learn(self, words: list[bytes]) -> list[list[int]]:
        out, others, tokenize, plain = [], [], self.model.tokenize, PLAIN.fullmatch
        for k, word in enumerate(b" ".join(words).decode("utf-8").split(" ") if words else ()):
            parts = plain(word)
            if parts is None:
                others.append((k, word))
                out.append(None)
                continue
            # Words and signs from their merges alone; this takes a quarter of a whole encoding.
            letters, signs = parts[1].lower(), parts[2]
            if not letters.isascii():
                letters = "".join([self.letters[b] for b in letters.encode("utf-8")])
            ids = [t.id for t in tokenize(letters)]
            if signs:
                if signs not in self.signs:
                    if len(self.signs) > MAX_SIGNS:
                        self.signs.clear()
                    self.signs[signs] = [t.id for t in tokenize(signs)]
                ids += self.signs[signs]
            out.append(ids)
        for start in range(0, len(others), 4096):
            part = others[start:start + 4096]
            for (k, _), e in zip(part, self.tokenizer.encode_batch_fast([w for _, w in part], add_special_tokens=False)):
                out[k] = e.ids
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each text has."""
        # A text with an added token goes through the tokenizer as a whole.
        whole = {k for k, t in enumerate(texts) if any(token in t for token in self.added)}
        bodies = [b"" if k in whole else self.pieces(t) for k, t in enumerate(texts)]
        starts, lengths, values = self.table.encode(b"".join(bodies), self.learn)
        ends = np.cumsum([len(b) for b in bodies])
        before = np.concatenate([[0], np.cumsum(lengths)])
        stops = before[np.searchsorted(starts, ends)]
        counts = np.diff(stops, prepend=0)
        if whole:
            parts = np.split(values, stops[:-1])
            for k, e in zip(sorted(whole), self.tokenizer.encode_batch_fast([texts[k] for k in sorted(whole)], add_special_tokens=False)):
                parts[k], counts[k] = np.array(e.ids, np.uint32), len(e.ids)
            values = np.concatenate(parts)
        return values, counts


_loaded: dict[str, PieceIds] = {}


def _key(doc_id, check: int, tie: int) -> tuple:
    return (doc_id is not None, 0 if doc_id is None else doc_id, check, tie)


def id_kind(path: str, end: int) -> str:
    """Bytes that an id takes between tasks: two, where the vocabulary allows it."""
    return "<u2" if max(load_tokenizer(path).get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 > end else "<u4"


@lean
def encode_batches(batches: Iterable[pa.RecordBatch], path: str, end: int, bounds: list[tuple],
                   schema: pa.Schema, kind: str = "<u4") -> Iterator[pa.RecordBatch]:
    """Adds the shard and the ids (little-endian, of one ``kind``) of each document."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = PieceIds(path)

    def coded(rows: list[tuple]) -> pa.RecordBatch:
        values, counts = _loaded[path].encode([r[3] for r in rows])
        stops = np.cumsum(counts)
        tail, values = np.array([end], kind).tobytes(), values.astype(kind)
        tokens = [values[b - n:b].tobytes() + tail for n, b in zip(counts, stops)]
        ids, checks, ties = ([r[k] for r in rows] for k in range(3))
        shards = [bisect_right(bounds, _key(*r[:3])) for r in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip((shards, ids, checks, ties, tokens), schema)], schema=schema)

    for batch in batches:
        rows, chars = [], 0
        for row in zip(*(batch.column(c).to_pylist() for c in ("id", "check", "tie")), batch.column("text")):
            text = row[3].as_py()
            rows.append((*row[:3], text))
            chars += len(text)
            if chars >= GROUP_CHARS:
                yield coded(rows)
                rows, chars = [], 0
        if rows:
            yield coded(rows)


@lean
def pack_segments(batches: Iterable[pa.RecordBatch], schema: pa.Schema, size: int,
                  kind: str = "<u4") -> Iterator[pa.RecordBatch]:
    """Sorted documents of one or more shards, as segments of ``size`` ids or a little more."""
    shard, segment, ids, tokens, held, width = None, 0, [], [], 0, np.dtype(kind).itemsize

    def segment_row() -> pa.RecordBatch:
        lengths = np.array([len(t) // width for t in tokens], np.uint64)
        words, offsets = simple8b.pack(np.frombuffer(b"".join(tokens), kind).astype(np.uint64))
        row = [shard, segment, len(ids), int(lengths.sum()), ids, simple8b.pack(lengths)[0].astype("<u8").tobytes(),
               words.astype("<u8").tobytes(), offsets.astype("<u4").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    for batch in batches:
        for to, doc_id, body in zip(batch.column("shard").to_pylist(), batch.column("id").to_pylist(),
                                    batch.column("tokens")):
            if ids and (to != shard or held >= size):
                yield segment_row()
                segment, ids, tokens, held = (segment + 1 if to == shard else 0), [], [], 0
            shard = to
            body = body.as_py()
            ids.append(doc_id)
            tokens.append(body)
            held += len(body) // width
    if ids:
        yield segment_row()


def write_tokens(df: DataFrame, vocabulary: str, path: str, end: int = END, text: str = "text",
                 id_column: str = "doc_id", segment: int = SEGMENT) -> None:
    """Write the token ids of ``df`` to ``path``, documents in id order."""
    spark = df.sparkSession
    ship(spark)
    body = text_or_empty(text)
    rows = df.select(F.col(f"`{id_column}`").alias("id"), F.crc32(F.encode(body, "UTF-8")).alias("check"),
                     F.monotonically_increasing_id().alias("tie"), body.alias("text"))
    order = ["id", "check", "tie"]
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # With a number given, adaptive execution leaves the ranges as they are.
    ranges = rows.select(*order).repartitionByRange(shards, *order).groupBy(F.spark_partition_id().alias("part")).agg(
        F.min(F.struct(*order)).alias("first"))
    # One row per shuffle partition.
    bounds = sorted(_key(*r["first"]) for r in ranges.collect())[1:]
    shared = spark.sparkContext.broadcast(bounds)

    id_type = rows.schema["id"].dataType
    coded_schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("id", id_type), T.StructField("check", T.LongType()),
        T.StructField("tie", T.LongType()), T.StructField("tokens", T.BinaryType())])
    file_schema = T._parse_datatype_string(FILE_COLUMNS.format(id=id_type.simpleString()))
    coded_arrow, file_arrow = to_arrow_schema(coded_schema), to_arrow_schema(file_schema)
    kind = id_kind(vocabulary, end)
    coded = rows.mapInArrow(lambda b: encode_batches(b, vocabulary, end, shared.value, coded_arrow, kind), coded_schema)
    dealt = coded.repartition(shards, "shard").sortWithinPartitions("shard", *order)
    dealt.mapInArrow(lambda b: pack_segments(b, file_arrow, segment, kind), file_schema).write.parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """(id, start, n_tokens, tokens) of each document; ``tokens`` are little-endian 32-bit ids."""
    ship(spark)
    files = spark.read.parquet(path)
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("total")).select(
        "shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("shard_start"))
    segments = files.select("shard", "segment", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("inside"))
    starts = join_small(segments, shards, ["shard"]).select(
        "shard", "segment", (F.col("shard_start") + F.col("inside")).alias("before"))

    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("segment", T.IntegerType()),
        T.StructField("id", files.schema["ids"].dataType.elementType), T.StructField("inside", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    @lean
    def unpack(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                n = row["n_docs"].as_py()
                lengths = simple8b.unpack(np.frombuffer(row["lengths"].as_py(), "<u8"))[:n].astype(np.int64)
                body = simple8b.unpack(np.frombuffer(row["words"].as_py(), "<u8")).astype("<u4")
                ends = np.cumsum(lengths)
                tokens = [body[b - m:b].tobytes() for m, b in zip(lengths, ends)]
                columns = [np.full(n, row["shard"].as_py()), np.full(n, row["segment"].as_py()), row["ids"].values,
                           ends - lengths, lengths, tokens]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type)
                                                  for c, f in zip(columns, arrow)], schema=arrow)

    documents = files.select("shard", "segment", "n_docs", "ids", "lengths", "words").mapInArrow(unpack, schema)
    return join_small(documents, starts, ["shard", "segment"]).select(
        "id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "tokens")


def read_documents(spark, path: str, wanted: DataFrame) -> DataFrame:
    """(id, n_tokens, tokens) of the documents whose ids are in ``wanted`` (id), one row for each that is there.

    The ids lead to the segments; of a segment only the blocks that a wanted
    document reaches into are decoded, from their offsets on.
    """
    ship(spark)
    files = spark.read.parquet(path)
    places = files.select("shard", "segment", F.posexplode("ids").alias("place", "id"))
    asked = wanted.select(wanted.columns[0]).distinct().toDF("id")
    found = join_small(places, asked, ["id"], "left_semi").groupBy("shard", "segment").agg(
        F.sort_array(F.collect_list("place")).alias("places"))  # at most a segment's documents
    rows = files.join(found, ["shard", "segment"]).select("ids", "lengths", "words", "offsets", "n_docs", "places")

    schema = T.StructType([T.StructField("id", files.schema["ids"].dataType.elementType),
                           T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def unpack(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                lengths = simple8b.unpack(np.frombuffer(row["lengths"].as_py(), "<u8"))[:row["n_docs"].as_py()].astype(np.int64)
                ends = np.cumsum(lengths)
                words, offsets = (np.frombuffer(row[c].as_py(), t) for c, t in (("words", "<u8"), ("offsets", "<u4")))
                chosen = row["places"].values.to_numpy()
                tokens = [simple8b.some(words, offsets, ends[p] - lengths[p], ends[p]).astype("<u4").tobytes() for p in chosen]
                yield pa.RecordBatch.from_arrays([row["ids"].values.take(pa.array(chosen)).cast(arrow.field("id").type),
                                                  pa.array(lengths[chosen]), pa.array(tokens, pa.binary())], schema=arrow)

    return rows.mapInArrow(unpack, schema)


def token_file_digests(df: DataFrame, vocabulary: str, end: int = END) -> DataFrame:
    """Write the ids of ``df`` to a new folder and return (id, start, n_tokens, ids_crc32) as read from there."""
    path = staging_path(df.sparkSession, "tokens")
    write_tokens(df, vocabulary, path, end)
    return read_tokens(df.sparkSession, path).select("id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))
