"""Near-duplicate groups by an inverted join over MinHash signature coordinates.

1. Every document gets the set of its five-word shingles and a signature of
   ``COORDINATES`` minima. Documents with the same words share one
   representative from here on.
2. Representatives are posted under each (coordinate, value). Two documents of
   similarity 0.75 agree in 24 of 32 coordinates on average; a pair is retained
   from ``MATCHES`` = 12 collisions on, which loses less than one pair in
   500,000 at exactly that similarity. A value that one document alone has
   cannot match, so a document with fewer than 12 shared values is done.
3. Prefix: pairs with 12 collisions must meet in a list that is among the
   rarest of both, so each document joins only through its m - 11 rarest shared
   values (m of them in all). The long lists are skipped; their collisions are
   counted by comparing signatures of the pairs found.
4. In each list the members are first paired with its hub, the document whose
   values are shared most. What the links (exact on full shingle sets) join
   into one component needs no further pairs. What is left open are members of
   different components in one list. A shingle that no other open document has
   cannot be common, so a document of which over a quarter is its own drops
   out (shingles of its own component count as its own), and pairs need enough
   shared shingles on both sides. Short lists are
   paired by a join; long ones are compared in blocks of ``BLOCK`` documents,
   from which only links come out, and blocks of one component meet only
   others. A group of thousands of copies thus costs one pair per member and
   list, besides its members that no hub can link.

Defined cases: NULL text counts as empty; a document without words has no
shingles, links with nothing and stays; fewer than five words are one shingle;
the member with the smallest id stays, of equal ids one; NULL ids rank last
and stay only where all ids of the component are NULL; empty tables give empty
results; added columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkgrid.llm.common import lean, packed, ship, text_or_empty
from sparkgrid.llm.components import connected_components
from sparkgrid.session import join_small, stage

WORDS = 5
SIMILAR = 75          # percent
COORDINATES = 32
MATCHES = 12
CHUNK = 4096
SHORT_LIST = 64       # members up to which the open pairs of a list are joined as rows
BLOCK = 1024          # documents on a side that are compared at a time,
BLOCK_SHINGLES = 1 << 20  # or so many shingles of them

_rng = np.random.default_rng(20_24)
SEEDS = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
FACTORS = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
PLACES = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, letters A-Z lowered."""
    return text.encode("utf-8").lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct 64-bit shingle hashes, sorted."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    total = np.zeros(n - WORDS + 1, np.uint64)
    for k in range(WORDS):
        total += h[k:n - WORDS + 1 + k] * PLACES[k]
    return np.unique(_mixed(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum over the set of each coordinate's permutation."""
    best = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), CHUNK):
        part = hashes[start:start + CHUNK, None]
        best = np.minimum(best, ((part ^ SEEDS) * FACTORS).min(axis=0))
    return best


@lean
def _sketches(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, signatures = [], [], []
        for text in batch.column("text"):
            words = words_of(text.as_py())
            found = shingles(words)
            sizes.append(len(found))
            digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
            signatures.append(signature(found).view(np.int64) if len(found) else [])
        columns = [batch.column("uid"), batch.column("id"), sizes, digests, signatures]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type)
                                          for c, f in zip(columns, schema)], schema=schema)


@lean
def _sets(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Shingle sets of the texts that have the wanted words."""
    for batch in batches:
        rows = []
        for uid, digest, text in zip(*(batch.column(c) for c in ("uid", "digest", "text"))):
            words = words_of(text.as_py())
            if xxhash.xxh3_128_digest(b" ".join(words)) == digest.as_py():
                rows.append((uid.as_py(), shingles(words).view(np.int64)))
        columns = zip(*rows) if rows else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def near_duplicates(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(uid, id, n_shingles, component_id, kept) for each row of ``df``; ``uid`` numbers the rows."""
    # Written with a number for each row, since ids may repeat or be NULL.
    return _grouped(stage(df.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_column}`").alias("id"),
                                    text_or_empty(text).alias("text")), "texts"))


def _grouped(docs: DataFrame) -> DataFrame:
    """The groups of a written table (uid, id, text)."""
    ship(docs.sparkSession)
    sketch_schema = T.StructType([
        T.StructField("uid", T.LongType()), T.StructField("id", docs.schema["id"].dataType), T.StructField("n", T.LongType()),
        T.StructField("digest", T.BinaryType()), T.StructField("signature", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(sketch_schema)
    sketches = stage(docs.mapInArrow(lambda b: _sketches(b, arrow), sketch_schema), "sketches")

    # One representative for all documents with the same words.
    classes = stage(sketches.where("n > 0").groupBy("digest").agg(
        F.min("uid").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"), "classes")
    members = join_small(sketches, classes, ["digest"], "left").withColumn(
        "rep", F.when(F.col("n") > 0, F.coalesce("first", "uid")).otherwise(F.col("uid"))).drop("first")
    reps = members.where("uid = rep and n > 0").select("uid", "id", "n", "digest", "signature")

    prefixes, wanted = _prefixes(reps)
    sets = _wanted_sets(docs, reps, wanted)
    narrow = stage(reps.join(wanted, "uid", "left_semi").select("uid", "n", "signature"), "signatures")
    tested = _hub_pairs(prefixes)
    links = _links(tested, narrow, sets)
    labels = connected_components(links)
    more = stage(_open_links(prefixes, labels, narrow, sets), "more")
    if not more.isEmpty():
        labels = connected_components(links.union(more))

    grouped = members.select("uid", "id", "n", "rep").join(
        labels.select(F.col("vertex").alias("rep"), "label"), "rep", "left").withColumn(
        "component", F.coalesce("label", "rep"))
    # The first of a component; only components of several rows need the shuffle of their members.
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "uid"))
    shared = stage(grouped.groupBy("component").agg(first.alias("head"), F.count("*").alias("c")).where(
        "c > 1").select("component", F.col("head.id").alias("component_id"), F.col("head.uid").alias("head")), "heads")
    whole = join_small(grouped, shared, ["component"], "left")
    return whole.select("uid", "id", F.col("n").alias("n_shingles"),
                        F.when(F.col("head").isNull(), F.col("id")).otherwise(F.col("component_id")).alias(
                            "component_id"),
                        F.coalesce(F.col("uid") == F.col("head"), F.lit(True)).alias("kept"))


def _prefixes(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(list, uid, weight): the lists through which a document joins; and the documents that have any."""
    postings = reps.select("uid", F.posexplode("signature")).select(
        "uid", F.xxhash64("pos", "col").alias("list"))
    lists = stage(postings.groupBy("list").agg(F.count("*").alias("length")).where("length > 1"), "lists")
    shared = postings.join(lists, "list").groupBy("uid").agg(
        F.array_sort(F.collect_list(F.struct("length", "list"))).alias("lists")).where(
        F.size("lists") >= MATCHES)
    rarest = F.slice("lists", F.lit(1), F.size("lists") - MATCHES + 1)
    weight = F.aggregate("lists", F.lit(0).cast("long"), lambda total, x: total + x["length"])
    prefixes = stage(shared.select("uid", weight.alias("weight"), F.explode(rarest).alias("x")).select(
        F.col("x.list").alias("list"), "uid", "weight"), "prefixes")
    return prefixes, prefixes.select("uid").distinct()


def _wanted_sets(docs: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField("set", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)
    keys = stage(reps.join(wanted, "uid", "left_semi").select("uid", "digest"), "wanted")
    texts = join_small(docs, keys, ["uid"]).select("uid", "digest", "text")
    return stage(texts.mapInArrow(lambda b: _sets(b, arrow), schema), "sets")


def _hub_pairs(prefixes: DataFrame) -> DataFrame:
    """(a, b) with b the hub of a list and a another member."""
    hubs = stage(prefixes.groupBy("list").agg(
        F.max(F.struct("weight", (-F.col("uid")).alias("minus"))).alias("hub"), F.count("*").alias("c")).where(
        "c > 1").select("list", (-F.col("hub.minus")).alias("b")), "hubs")
    pairs = prefixes.join(hubs, "list").where("uid <> b")
    return pairs.select(F.col("uid").alias("a"), "b").distinct()


def _open_links(prefixes: DataFrame, labels: DataFrame, narrow: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members of a list that lie in different components."""
    marked = stage(prefixes.select("list", "uid").join(
        labels.withColumnRenamed("vertex", "uid"), "uid", "left").select(
        "list", "uid", F.coalesce("label", "uid").alias("label")), "marked")
    # Of lists with the same members one is enough.
    lists = marked.groupBy("list").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("c"),
        F.sum(F.xxhash64("uid").cast("decimal(38,0)")).alias("members"))
    one = lists.where("low < high").groupBy("c", "members").agg(F.min("list").alias("list")).select("list")
    # A row per document with its lists, at most one for each coordinate, so that joins by document see it once.
    opened = stage(marked.join(one, "list", "left_semi").groupBy("uid").agg(
        F.first("label").alias("label"), F.collect_list("list").alias("lists")), "open")

    # Only shingles that open documents of two components have can be common to a pair.
    # A window finds them with one exchange of the entries and one of the sets.
    entries = sets.join(opened.select("uid", "label"), "uid").select(
        "uid", "label", F.explode("set").alias("shingle"))
    owners = Window.partitionBy("shingle")
    known = entries.select("uid", "shingle", F.min("label").over(owners).alias("low"),
                           F.max("label").over(owners).alias("high")).where("low < high")
    shared = known.groupBy("uid").agg(F.collect_list("shingle").alias("shared")).join(
        narrow.select("uid", "n"), "uid").withColumn("s", F.size("shared"))
    shared = stage(shared.where(100 * F.col("s") >= SIMILAR * F.col("n")), "shared")

    members = opened.join(shared.select("uid", "n", "s"), "uid").select(
        "uid", "label", "n", "s", F.explode("lists").alias("list"))
    sizes = members.groupBy("list").agg(F.count("*").alias("length"), F.min("label").alias("low"),
                                        F.max("label").alias("high")).where("low < high").select("list", "length")
    members = stage(members.join(sizes, "list"), "members")
    return _short_list_links(members.where(F.col("length") <= SHORT_LIST), shared).union(
        _long_list_links(members.where(F.col("length") > SHORT_LIST), shared))


def _short_list_links(members: DataFrame, shared: DataFrame) -> DataFrame:
    def side(name: str) -> DataFrame:
        return members.select("list", *[F.col(c).alias(x) for c, x in (
            ("uid", name), ("label", f"l{name}"), ("n", f"n{name}"), ("s", f"s{name}"))])

    both = F.col("na") + F.col("nb")
    possible = (F.col("la") < F.col("lb")) & (
        (100 + SIMILAR) * F.least("sa", "sb", "na", "nb") >= SIMILAR * both)
    pairs = stage(side("a").join(side("b"), "list").where(possible).select("a", "b").distinct(), "pairs")
    sets = shared.select("uid", "n", "shared")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return (pairs.join(sets.toDF("a", "n_a", "set_a"), "a").join(sets.toDF("b", "n_b", "set_b"), "b")
            .select("a", "b", (F.col("n_a") + F.col("n_b")).alias("both"), common.alias("common"))
            .where(100 * F.col("common") >= SIMILAR * (F.col("both") - F.col("common"))).select("a", "b"))


def _long_list_links(members: DataFrame, shared: DataFrame) -> DataFrame:
    """Compare the members of a list block by block; a large component has blocks of its own."""
    counts = members.groupBy("list", "label").agg(
        F.greatest(F.count("*") / BLOCK, F.sum("s") / BLOCK_SHINGLES).alias("c"))
    large = F.col("c") >= 1
    rest = counts.groupBy("list").agg(F.sum(F.when(large, 0.0).otherwise(F.col("c"))).alias("rest"))
    parts = F.ceil(F.when(large, F.col("c")).otherwise(F.col("rest")))
    dealt = F.when(large, F.xxhash64("uid")).otherwise(F.xxhash64("label"))
    homes = stage(members.join(counts, ["list", "label"]).join(rest, "list").select(
        "list", "uid", "label", F.when(large, F.col("label")).otherwise(-1).alias("home"),
        F.pmod(dealt, parts).alias("part")), "homes")
    blocks = stage(homes.select("list", "home", "part").distinct(), "blocks")
    left, right = blocks.toDF("list", "ha", "pa"), blocks.toDF("list", "hb", "pb")
    ordered = (F.struct("ha", "pa") <= F.struct("hb", "pb")) & ((F.col("ha") != F.col("hb")) | (F.col("ha") == -1))
    meetings = stage(left.join(right, "list").where(ordered), "meetings")
    key = ["list", "ha", "pa", "hb", "pb"]
    first = homes.join(meetings, (homes["list"] == meetings["list"]) & (F.col("home") == F.col("ha")) & (
        F.col("part") == F.col("pa"))).select(meetings["list"], *key[1:], "uid", "label", F.lit(0).alias("side"))
    second = homes.join(meetings, (homes["list"] == meetings["list"]) & (F.col("home") == F.col("hb")) & (
        F.col("part") == F.col("pb"))).where("ha <> hb or pa <> pb").select(
        meetings["list"], *key[1:], "uid", "label", F.lit(1).alias("side"))
    rows = first.union(second).join(shared.select("uid", "n", "shared"), "uid")
    return rows.groupBy(*key).applyInPandas(_compare, "a long, b long").distinct()


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """Links across two blocks, or within one, of different components."""
    rows = rows.reset_index(drop=True)
    sets = rows["shared"].to_numpy()
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in sets])
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    common = np.zeros((len(rows), len(rows)), np.float32)
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    for start in range(0, int(number[-1]) + 1, 4096):  # some thousand shingles at a time
        a, b = np.searchsorted(number, (start, start + 4096))
        held = np.zeros((len(rows), 4096), np.float32)
        held[owner[a:b], number[a:b] - start] = 1
        common += held @ held.T
    n, label, side = (rows[c].to_numpy() for c in ("n", "label", "side"))
    similar = 100 * common >= SIMILAR * (n[:, None] + n[None, :] - common)
    similar &= label[:, None] != label[None, :]
    if side.any():
        similar &= (side[:, None] == 0) & (side[None, :] == 1)
    a, b = np.nonzero(similar)
    uid = rows["uid"].to_numpy()
    return pd.DataFrame({"a": uid[a], "b": uid[b]})


def _links(pairs: DataFrame, narrow: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that collide in enough coordinates and are similar on their full sets."""
    def side(table: DataFrame, name: str) -> DataFrame:
        return table.select(*[F.col(c).alias(name if c == "uid" else f"{c}_{name}") for c in table.columns])

    collisions = F.size(F.filter(F.zip_with("signature_a", "signature_b", lambda x, y: x == y), lambda x: x))
    retained = stage(
        pairs.join(side(narrow, "a"), "a").join(side(narrow, "b"), "b")
        .where(100 * F.least("n_a", "n_b") >= SIMILAR * F.greatest("n_a", "n_b"))
        .where(collisions >= MATCHES).select("a", "b", "n_a", "n_b"), "retained")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return stage(
        retained.join(side(sets, "a"), "a").join(side(sets, "b"), "b")
        .select("a", "b", (F.col("n_a") + F.col("n_b")).alias("both"), common.alias("common"))
        .where(100 * F.col("common") >= SIMILAR * (F.col("both") - F.col("common"))).select("a", "b"), "links")


def kept_documents(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row of each group, with the columns of ``df`` only."""
    rows = stage(df.select(packed(df), F.monotonically_increasing_id().alias("uid")), "numbered")
    own_id = F.col(f"row.`{id_column}`")
    docs = rows.select("uid", F.struct(own_id.isNull().alias("last"), own_id.alias("id"), F.col("uid").alias("number")).alias(
        "id"), text_or_empty(f"row.`{text}`").alias("text"))
    dropped = stage(_grouped(docs).where(~F.col("kept")).select("uid"), "dropped")
    return join_small(rows, dropped, ["uid"], "left_anti").select("row.*")
