"""Similarities other than 0.85, which op2 and the pipeline take."""

from itertools import combinations

import numpy as np
import pyarrow.parquet as pq

from quillon.llm import near_dedup
from quillon.llm.common import read_table

from . import brute

SF = "/root/testdata/sf0.01"


def grouped(docs, percent):
    """Least doc_id of each document's group, by all pairs."""
    sets = {i: brute.shingles(t) for i, t in docs}
    owners, root = {}, {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for x in s:
            owners.setdefault(x, []).append(i)
    for a, b in {p for o in owners.values() for p in combinations(sorted(o), 2)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in sets}


def test_080_links_more(spark):
    # 105 words make 101 shingles; one word changed in the middle loses 5 on each side, two far apart lose 10.
    words = [f"w{i}" for i in range(105)]
    two = [f"x{i}" if i in (30, 60) else w for i, w in enumerate(words)]  # 91 of 111 shared: 0.8198
    three = [f"y{i}" if i in (20, 50, 80) else w for i, w in enumerate(words)]  # 86 of 116 with the first: 0.741
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(two)), (3, " ".join(three))], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup.drop_near(docs, percent=80).collect()) == [1, 3]
    assert sorted(r.doc_id for r in near_dedup.drop_near(docs).collect()) == [1, 2, 3]


def test_080_equals_brute_force(spark):
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    got = near_dedup.near_components(read_table(spark, SF, "documents"), percent=80).collect()
    assert {r.doc_id: r.component_id for r in got} == grouped(list(zip(t["doc_id"], t["text"], strict=True)), 80)


def test_bands_seldom_miss_080():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(60):
        sets = []
        for _ in range(50):
            both, one, two = np.split(rng.integers(0, 2**63, 250, dtype=np.uint64), [200, 225])
            sets += [np.concatenate([both, one]), np.concatenate([both, two])]  # 200 of 250: 0.8
        keys = near_dedup.signature_columns(sets)[2]
        missed += int((~(keys[::2] == keys[1::2]).any(axis=1)).sum())
    assert missed <= 2  # 3,000 pairs at 3e-5
