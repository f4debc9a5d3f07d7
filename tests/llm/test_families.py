"""Families of near copies that settle only in part: long chains of groups with several members each."""

import random

import pytest

from docgraph.llm import near_copies

from .test_operators import brute_components


def drifting(groups, tag, seed):
    """(id, text) of a chain of groups.  Neighbours share 7 of 13 rare words; what else a set has is a tail of 7 frequent ones.

    Members of a group have the same rare words and other tails, so they aren't similar; members of neighbours are where
    their tails are equal.
    """
    r = random.Random(seed)
    tails = [[f"{tag}tail{k}x{j}" for j in range(7)] for k in range(4)]
    out = [" ".join(t * 12) for t in tails]
    for g in range(groups):
        rare = [f"{tag}rare{6 * g + j}" for j in range(13)]
        out += [" ".join(rare + t) for t in r.sample(tails, 2)]
    return out


@pytest.mark.parametrize("order", ["up", "down", "mixed"])
def test_drifting_chains(spark, order):
    texts = [t for k, groups in enumerate((4, 5, 7, 9, 12, 16, 20, 30)) for t in drifting(groups, f"c{k}", k)]
    ids = list(range(len(texts)))
    if order != "up":
        ids = ids[::-1] if order == "down" else random.Random(1).sample(ids, len(ids))
    table = list(zip(ids, texts, strict=True))
    df = spark.createDataFrame(table, "doc_id long, text string")
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in near_copies.near_copy_classes(df, 1, 50).collect()}
    assert out == brute_components(table, 1, 50)
