"""From raw documents to token ids: five stages, each written as Parquet and read again.

A stage drops what the one before staged, so write its result before the next
is called. Stages take (spark, docs, sf_dir) and return a DataFrame. All but the last
return the columns of ``documents``. Mixing has a random part (a hash of id and
text), and trained scores have no SQL twin, so ``ORACLE_SQL`` is None; the
tests compare ``run`` with a version without Spark.

Defined cases, as the stages define them: NULL texts count as empty and are
judged, grouped and encoded like any text; NULL ids train nothing, and stay in a
group of copies only where it has no other; of rows that repeat an id and a text
one stays; very long texts go through whole; columns beyond those of documents
pass the filtering stages unchanged, whatever they are called; without labels
nothing can be learnt, and the share of toxic labels (0.5) stands for every
score, so that all documents go; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers

from sparkgrid.llm import distinct_bpe, exact_dedup, mixing, near_dedup, toxicity
from sparkgrid.llm.common import documents
from sparkgrid.session import remove_folder, staging_as, staging_path

_staged: list[str] = []


def frugal(function):
    """A stage that first drops the tables which the stage before staged: what that returned is written by now."""
    @wraps(function)
    def stage(spark, docs, sf_dir):
        while _staged:
            remove_folder(spark, _staged.pop())
        with staging_as(spark, function.__name__) as folder:
            _staged.append(folder)
            return function(spark, docs, sf_dir)
    return stage


@frugal
def without_toxic(spark, docs, sf_dir):
    """Documents that the string-kernel machine does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.clean_documents(docs, labels)


@frugal
def without_copies(spark, docs, sf_dir):
    """Of equal texts the one with the largest id."""
    return exact_dedup.kept_documents(docs)


@frugal
def without_near_copies(spark, docs, sf_dir):
    """Of each near-duplicate group the document with the smallest id."""
    return near_dedup.kept_documents(docs)


@frugal
def mixed(spark, docs, sf_dir):
    """A sample in which sources, languages and topics have their target weights."""
    return mixing.sampled_documents(docs)


@frugal
def encoded(spark, docs, sf_dir):
    """Token ids of each document, checked by decoding them."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return distinct_bpe.encode_and_decode(docs, path, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("mixing", mixed),
    ("byte-level BPE", encoded),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = staging_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
