"""Minimax contiguous sharding of groups of equal texts, by DataFrame operations alone.

The groups of equal texts are the atoms.  They stand in one fixed order: larger groups first, ties by the
SHA-256 of their text.  In that order the sequence of sizes is told completely by a histogram (size, number of
groups), whose length is at most sqrt(2 x bytes of the corpus) and in practice a few hundred thousand rows; this
is all that reaches the driver, as lines of text and then arrays of numbers (14 million entries, some 300 MB, were every size of a 100 TB corpus its own).  There the smallest feasible shard capacity is found by binary search, each
candidate checked greedily, and the sequence is cut under that capacity, each cut as near to an even share as
the capacity allows.  A cut is a pair (size, hash of the first group behind it), so that
rows find their shard by 39 comparisons, without a join and without ranking the groups.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: What a row costs besides its text.
ROW_BYTES = 16


class Runs:
    """Atoms in descending size as runs of equal sizes; positions count atoms.  Arrays of numbers: 32 bytes a run."""

    def __init__(self, sizes: Sequence[int], counts: Sequence[int]):
        order = np.argsort(-np.asarray(sizes, np.int64), kind="stable")
        self.sizes, counts = np.asarray(sizes, np.int64)[order], np.asarray(counts, np.int64)[order]
        self.count, self.bytes = (np.concatenate((np.zeros(1, np.int64), np.cumsum(x))) for x in (counts, self.sizes * counts))
        self.n, self.total = int(self.count[-1]), int(self.bytes[-1])

    def run_of(self, i: int) -> tuple[int, int]:
        """The size of the run that holds the atom after the first ``i``, and its place there."""
        r = int(np.searchsorted(self.count, i, side="right")) - 1
        return int(self.sizes[r]), i - int(self.count[r])

    def before(self, i: int) -> int:
        """Bytes of the first ``i`` atoms."""
        r = min(int(np.searchsorted(self.count, i, side="right")), len(self.sizes)) - 1
        return int(self.bytes[r]) + (i - int(self.count[r])) * int(self.sizes[r])

    def last_within(self, limit: int) -> int:
        """The most atoms from the start whose bytes are at most ``limit``."""
        if limit >= self.total:
            return self.n
        r = int(np.searchsorted(self.bytes, limit, side="right")) - 1
        return int(self.count[r]) + (limit - int(self.bytes[r])) // int(self.sizes[r])

    def first_beyond(self, limit: int) -> int:
        """The fewest atoms from the start whose bytes are at least ``limit``."""
        if limit <= 0:
            return 0
        r = int(np.searchsorted(self.bytes, limit)) - 1
        return int(self.count[r]) + -(-(limit - int(self.bytes[r])) // int(self.sizes[r]))


def feasible(runs: Runs, start: int, shards: int, capacity: int) -> bool:
    """Greedy check: fill shard after shard to the capacity."""
    for _ in range(shards):
        if start == runs.n:
            return True
        start = runs.last_within(runs.before(start) + capacity)
    return start == runs.n


def cut_positions(runs: Runs, shards: int) -> list[int]:
    """The ``shards - 1`` cuts, as numbers of atoms before them.

    An atom larger than the mean of what is left fills a shard of its own; in descending order those come first.
    The rest is cut by the smallest capacity under which the greedy check succeeds.
    """
    cuts: list[int] = []
    if not runs.n:
        return [0] * (shards - 1)
    start = 0
    while len(cuts) < shards - 1 and start < runs.n and runs.run_of(start)[0] * (shards - len(cuts)) > runs.total - runs.before(start):
        start += 1
        cuts.append(start)
    left = shards - len(cuts)
    if start == runs.n:
        return cuts + [runs.n] * (left - 1)
    rest = runs.total - runs.before(start)
    low, high = max(-(-rest // left), runs.run_of(start)[0]), rest
    while low < high:
        mid = (low + high) // 2
        if feasible(runs, start, left, mid):
            high = mid
        else:
            low = mid + 1
    earliest, end = [], runs.n
    for _ in range(left - 1):  # a cut further left would leave more than the capacity for the shards behind it
        end = max(start, runs.first_beyond(runs.before(end) - low))
        earliest.append(end)
    for k, least in enumerate(reversed(earliest)):
        here = runs.before(start)
        even = here + (runs.total - here) // (left - k)
        i = runs.last_within(even)
        if i < runs.n and even - runs.before(i) > runs.before(i + 1) - even:
            i += 1
        start = min(max(i, least, start), runs.last_within(here + low))
        cuts.append(start)
    return cuts


def shard_documents(docs: DataFrame, shards: int = 40, buckets: int = 256) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of ``docs`` (doc_id, text).

    Law ``bytes``: sizes are near equal, groups of equal texts are never split.  A null text counts no bytes and goes
    with the empty ones.  Repeated rows each get a slot.  A null doc_id is kept.  An empty table gives no rows.
    Other columns are ignored.  ``buckets`` splits each shard for numbering, so no task holds a whole shard.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = materialize(
        docs.select("doc_id", (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("atom")), "sizes"
    )
    atoms = materialize(base.groupBy("atom").agg(F.sum("size").alias("atom_size")), "atoms")
    runs = _runs(atoms.groupBy("atom_size").agg(F.count("*").alias("n")))
    cuts = [c for c in cut_positions(runs, shards) if c < runs.n]
    inside: dict[int, set[int]] = {}
    for c in cuts:
        size, k = runs.run_of(c)
        inside.setdefault(size, set()).add(k)
    first = _atoms_at(atoms, {s: x - {0} for s, x in inside.items() if x - {0}})
    shard = F.lit(0)
    for c in cuts:
        size, k = runs.run_of(c)
        behind = F.col("atom_size") < size
        behind = behind | (F.col("atom_size") == size) if k == 0 else behind | ((F.col("atom_size") == size) & (F.col("atom") >= first[size, k]))
        shard = shard + behind.cast("int")
    placed = materialize(
        base.join(atoms, "atom").select("doc_id", "size", "text_crc32", shard.alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int").alias("bucket")), "placed"
    )
    counted = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))  # shards x buckets rows at most
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    return placed.join(F.broadcast(offsets), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + rank - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _runs(histogram: DataFrame, groups: int = 256) -> Runs:
    """The histogram on the driver: ``groups`` lines of text, as a row for each entry would take ten times the memory."""
    entry = F.concat_ws(" ", F.col("atom_size").cast("string"), F.col("n").cast("string"))
    lines = histogram.groupBy(F.pmod("atom_size", F.lit(groups)).alias("g")).agg(F.concat_ws(" ", F.collect_list(entry)).alias("line")).collect()
    parts = [np.array(r.line.split(), np.int64).reshape(-1, 2) for r in lines]
    both = np.concatenate(parts) if parts else np.empty((0, 2), np.int64)
    return Runs(both[:, 0], both[:, 1])


def _atoms_at(atoms: DataFrame, wanted: dict[int, set[int]]) -> dict[tuple[int, int], str]:
    """The hashes at some places of some runs, ties of a run being in the order of their hashes.

    A run is split by the first 12 bits of the hash, so that only the 4096th parts which hold a cut are ranked.
    """
    if not wanted:
        return {}
    part = atoms.filter(F.col("atom_size").isin(list(wanted))).withColumn("head", F.substring("atom", 1, 3))
    counts: dict[int, list[tuple[str, int]]] = {}
    for r in part.groupBy("atom_size", "head").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r.atom_size, []).append((r.head, r.n))
    spots: dict[tuple[int, str, int], tuple[int, int]] = {}
    for size, places in wanted.items():
        seen = 0
        for head, n in sorted(counts[size]):
            for k in places:
                if seen <= k < seen + n:
                    spots[size, head, k - seen] = (size, k)
            seen += n
    pick = F.lit(False)
    for size, head, _ in spots:
        pick = pick | ((F.col("atom_size") == size) & (F.col("head") == head))
    ranked = part.filter(pick).withColumn("place", F.row_number().over(Window.partitionBy("atom_size", "head").orderBy("atom")) - 1)
    at = F.lit(False)
    for size, head, place in spots:
        at = at | ((F.col("atom_size") == size) & (F.col("head") == head) & (F.col("place") == place))
    return {spots[r.atom_size, r.head, r.place]: r.atom for r in ranked.filter(at).collect()}
