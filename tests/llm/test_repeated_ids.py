"""Near duplicates where all rows share an id or have none."""

import random

from sparkgrid.llm import near_dedup
from tests.llm import data


def test_rows_meet_only_themselves(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        text = data.sentence(rng, 60)
        rows += [(None if k % 2 else 7, text + tail, "en", "s", 1) for tail in (" one", " two")]
    joined, join_small = [], near_dedup.join_small

    def counted(left, right, keys, *rest):
        out = join_small(left, right, keys, *rest)
        if keys in (["id"], ["uid"]):
            joined.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "join_small", counted)
    found = near_dedup.near_duplicates(data.frame(spark, rows)).collect()
    assert joined == [120] and len(found) == 120 and sum(r.kept for r in found) == 60
