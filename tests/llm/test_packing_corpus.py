"""Packing weighs terms by all documents, not by those of a shard."""

from docgraph.llm import packing


def test_neighbours_by_the_whole_corpus(spark):
    """Within the first shard apples are rarer than bananas; in the corpus they are common."""
    table = [(0, "the apple banana"), (1, "the apple"), (2, "the banana"), (3, "the banana " + " ".join(map(str, range(1000, 1300))))]
    table += [(4 + i, f"the apple {i}") for i in range(60)]
    df = spark.createDataFrame(table, "doc_id long, text string").coalesce(1)
    at = {r.doc_id: (r.sequence_id, r.offset) for r in packing.pack_documents(df, shard_tokens=300).collect()}
    assert at[0] < at[2] < at[1]
