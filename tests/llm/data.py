"""Small documents with every awkward case, and what plain Python makes of them."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])
WORDS = [a + b for a in ("tha", "wer", "lo", "min", "gra", "ée", "Sto") for b in ("n", "rt", "sel", "ü", "kap", "x")]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    """Prose, exact and near copies, odd white space, NULLs, empty and long texts, repeated rows and ids."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randint(3, 200)) + rng.choice(["", ".", "\n" + sentence(rng, 9)]) for _ in range(n)]
    base = sentence(rng, 120).split(" ")
    for k in range(12):  # a group of near copies
        copy = list(base)
        copy[5 * k + 3] = f"changed{k}"
        texts.append(" ".join(copy))
    texts += [texts[0], texts[0].upper(), texts[1], texts[1], texts[2].upper(), " ".join(base)] * 2
    texts += ["", "", None, " ", "one", "One", "two words", "a b c d", "a  b\t c\r\nd", "\n\n a \n", "é", "É",
              "x<|endoftext|>y <|endoftext|>", "İstanbul ſtrange K  wide space", "中文字 🙂🙂 Ⅷ ½"]
    texts += [sentence(rng, 30_000), "same same same " * 4000]
    texts += [texts[-1][:-1] + "!"]
    out = [(1000 - k if k % 2 else k, t, ("en", "fr", None, "xx")[k % 4], ("hot", "hot", "cold", None)[k % 4],
            None if t is None else len(t)) for k, t in enumerate(texts)]
    out += [(None, texts[0], "en", "hot", 1), (None, "without an id", None, None, None)]
    out += [out[5], out[5], (out[6][0], "another text under a known id", "de", "hot", 3)]
    rng.shuffle(out)
    return out


def frame(spark, data: list[tuple], partitions: int = 4):
    return spark.createDataFrame(data, SCHEMA).repartition(partitions)


def with_clashes(df):
    """Columns with the names of results and of helpers."""
    from pyspark.sql import functions as F
    names = ["keep_id", "kept", "row", "group", "uid", "digit", "size", "n_tokens", "score", "rules", "found", "id",
             "topic", "weight", "key", "number", "document", "tokens", "label", "count"]
    return df.withColumns({name: F.lit(f"own {name}") for name in names})


def ascii_lower(text: str | None) -> str:
    return (text or "").encode("utf-8").lower().decode("utf-8")
