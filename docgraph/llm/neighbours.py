"""Approximate nearest neighbours: an inverted file of coarse cells with product-quantised residuals.

Cells and codebooks are fitted on a bounded sample; every row is assigned and encoded, and the index (cell, codes and a norm, not the
vectors) is written to the shared folder.  A query visits its nearest cells, as many as hold the wanted share of true neighbours
in the sample.  There asymmetric tables, made once a query, give distances to the codes; the best of all the cells a query visits are its one
short list, whose original vectors are fetched and ranked again by exact distance.

What moves is the index once, each query once for each cell (and block of a large cell) that it visits, its short lists, and the
vectors once, to meet the short lists.  A task holds one block of codes and a batch of queries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SAMPLE_ROWS, CODES = 8192, 256
PART_DIMS = 2  #: dimensions that a code stands for
MOST_CELLS = SAMPLE_ROWS // 8  #: so that a centre has some rows of the sample
BLOCK_ROWS = 1 << 16  #: rows of a cell that a task holds
SHORTLIST, REACHED = 80, 0.97  #: rows that are ranked again; share of the sample's neighbours that the visited cells hold


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, in slices of bounded memory."""
    half = (centres**2).sum(1) / 2
    return np.concatenate([(half - x[s : s + 8192] @ centres.T).argmin(1) for s in range(0, max(len(x), 1), 8192)])


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    draw = np.random.default_rng(seed)
    x_own = np.unique(x, axis=0)
    centres = x_own[draw.permutation(len(x_own))[:k]].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass
class Quantiser:
    centres: np.ndarray  #: cells x dimensions
    books: list[np.ndarray]  #: for each part, codes x its dimensions
    edges: np.ndarray  #: bounds of the parts

    def parts(self, x: np.ndarray):
        return [x[:, s:e] for s, e in zip(self.edges[:-1], self.edges[1:], strict=True)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest(x, self.centres)
        rest = x - self.centres[cell]
        return cell, np.stack([_nearest(r, b) for r, b in zip(self.parts(rest), self.books, strict=True)], 1).astype(np.uint8)

    def decoded(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centres[cell] + np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], 1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Products of each query's parts with each code: queries x parts x codes, whatever the cell."""
        out = np.zeros((len(queries), len(self.books), CODES))
        for j, (x, b) in enumerate(zip(self.parts(queries), self.books, strict=True)):
            out[:, j, : len(b)] = x @ b.T
        return out


def fit_quantiser(x: np.ndarray, cells: int) -> Quantiser:
    centres = kmeans(x, min(cells, len(x)), 11)
    rest = x - centres[_nearest(x, centres)]
    edges = np.unique(np.linspace(0, x.shape[1], max(1, x.shape[1] // PART_DIMS) + 1).astype(int))
    return Quantiser(centres, [kmeans(rest[:, s:e], CODES, 13 + s) for s, e in zip(edges[:-1], edges[1:], strict=True)], edges)


def cells_to_visit(x: np.ndarray, centres: np.ndarray, k: int, reached: float = REACHED, asked: int = 256) -> int:
    """The fewest nearest cells of a query that hold a share ``reached`` of the true neighbours, by a sample."""
    if len(centres) < 2 or len(x) < 2:
        return len(centres)
    own = np.random.default_rng(17).permutation(len(x))[:asked]
    q = x[own]
    d = (x**2).sum(1)[None] - 2 * q @ x.T
    d[np.arange(len(own)), own] = np.inf
    near = np.argsort(d, 1)[:, : min(k, len(x) - 1)]
    order = np.argsort((centres**2).sum(1) / 2 - q @ centres.T, 1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None], 1)
    found = np.sort(np.take_along_axis(place, _nearest(x, centres)[near], 1).ravel())
    return int(found[min(len(found) - 1, int(np.ceil(reached * len(found))) - 1)]) + 1


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not zero, every component finite."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


_SCAN = "cell int, block int, side int, vec_id long, norm double, codes binary, v array<double>"


def nearest_neighbours(embeddings: DataFrame, every: int = 100, k: int = 10, shortlist: int = SHORTLIST, probes: int | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose vec_id is divisible by ``every``.

    ``embeddings`` has vec_id and embedding.  Score is the Euclidean distance of the original vectors in doubles; ties go
    to the smaller vec_id; a query's own vec_id is no candidate.  Vectors that are null, zero, hold null or non-finite
    components, or have another length than most of the sample take no part, nor does a null vec_id.  Repeated rows are
    candidates each; a vec_id with several vectors asks once, with the least of them.  ``probes`` is how many cells a query visits; by
    default the sample tells (``cells_to_visit``).  An empty table gives no rows.  Other columns are ignored.
    """
    spark = embeddings.sparkSession
    clean = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("raw"), F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sample = [r.v for r in clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = max(set(lengths := [len(v) for v in sample]), key=lambda n: (lengths.count(n), -n))
    clean = clean.filter(F.size("v") == width)
    x = np.array([v for v in sample if len(v) == width], float)
    cells = min(MOST_CELLS, max(1, 1 << int(np.log2(max(clean.count(), 2) ** 0.5 / 2))))
    model = spark.sparkContext.broadcast(fit_quantiser(x, cells))
    visits = min(probes or cells_to_visit(x, model.value.centres, k), len(model.value.centres))

    def encode(batches):
        for b in batches:
            if b.num_rows:
                own = _matrix(b["v"], width)
                cell, codes = model.value.encode(own)
                norm = (model.value.decoded(cell, codes) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(cell, pa.int32()), pa.array(norm), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "cell", "norm", "codes"])

    index = materialize(clean.select("vec_id", "v").mapInArrow(encode, "vec_id long, cell int, norm double, codes binary"), "index")
    counts = np.zeros(len(model.value.centres), np.int64)
    for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect():  # one row a cell
        counts[r.cell] = r.n
    blocks = np.maximum(1, -(-counts // BLOCK_ROWS))
    asked = materialize(clean.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "asked")

    def ask(batches):
        """Each query for each block of the cells it visits: the nearest, and more until they hold enough rows."""
        for b in batches:
            if not b.num_rows:
                continue
            own, ids = _matrix(b["v"], width), b["vec_id"].to_numpy()
            near = np.argsort((model.value.centres**2).sum(1) / 2 - own @ model.value.centres.T, axis=1, kind="stable")
            enough = 1 + (np.cumsum(counts[near], 1) <= 4 * k).sum(1)
            take = np.minimum(np.maximum(visits, enough), len(counts))
            for start in range(0, len(ids), 64):
                rows = [(i, c, s) for i in range(start, min(start + 64, len(ids))) for c in near[i, : take[i]].tolist() if counts[c] for s in range(blocks[c])]
                which, n = np.array([r[0] for r in rows]), len(rows)
                columns = [pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array(np.ones(n, np.int32)), pa.array(ids[which]), pa.nulls(n, pa.float64()), pa.nulls(n, pa.binary()), pa.array(list(own[which]), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "block", "side", "vec_id", "norm", "codes", "v"])

    def scan(batches):
        """Rows by cell and block, codes before queries: the short list of each query in each block."""
        q, at, ids, norm, codes = model.value, None, [], [], []

        def search(place, asked_by, vectors):
            nonlocal ids, norm, codes
            if isinstance(ids, list):
                ids, norm = np.concatenate(ids), np.concatenate(norm)
                order = np.argsort(ids, kind="stable")
                codes = np.frombuffer(b"".join(codes), np.uint8).reshape(len(ids), -1)[order].astype(np.int64) + np.arange(len(q.books)) * CODES
                ids, norm = ids[order], norm[order]
            found = []
            for query, vector, table in zip(asked_by, vectors, q.tables(vectors), strict=True):
                guess = norm - 2 * (table.ravel()[codes].sum(1) + vector @ q.centres[place[0]])
                guess[ids == query] = np.inf
                some = np.flatnonzero(guess <= np.partition(guess, shortlist - 1)[shortlist - 1]) if len(ids) > shortlist else np.arange(len(ids))
                some = some[np.argsort(guess[some], kind="stable")][:shortlist]  # ties by vec_id
                some = some[ids[some] != query]
                found.append((np.full(len(some), query), ids[some], guess[some]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[j] for f in found])) for j in range(3)], names=["query_id", "vec_id", "guess"])

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b[c].to_numpy() for c in ("cell", "block", "side")], 1)
            cuts = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))), len(key))
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                place, part = tuple(key[s, :2].tolist()), b.slice(s, e - s)
                if place != at:
                    at, ids, norm, codes = place, [], [], []
                if key[s, 2] == 0:
                    ids.append(part["vec_id"].to_numpy())
                    norm.append(part["norm"].to_numpy())
                    codes += part["codes"].to_pylist()
                elif len(ids):
                    for t in range(0, e - s, 64):
                        some = part.slice(t, 64)
                        yield search(place, some["vec_id"].to_numpy(), _matrix(some["v"], width))

    of_cell = F.element_at(F.array(*[F.lit(int(n)) for n in blocks]), F.col("cell") + 1)
    block = F.pmod(F.xxhash64("vec_id"), of_cell).cast("int")
    left = index.select("cell", block.alias("block"), F.lit(0).alias("side"), "vec_id", "norm", "codes", F.lit(None).cast("array<double>").alias("v"))
    both = left.unionByName(asked.mapInArrow(ask, _SCAN)).repartition("cell", "block").sortWithinPartitions("cell", "block", "side")
    found = both.select("cell", "block", "side", "vec_id", "norm", "codes", "v").mapInArrow(scan, "query_id long, vec_id long, guess double").groupBy("query_id", "vec_id").agg(F.min("guess").alias("guess"))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("guess", "vec_id"))
    short = found.withColumn("place", first).filter(F.col("place") <= shortlist).select("query_id", "vec_id")
    theirs = clean.select("vec_id", F.col("raw")).join(short, "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    exact = F.sqrt(F.aggregate(F.zip_with(F.col("raw").cast("array<double>"), F.col("q"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, d: total + d))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return theirs.select("query_id", "vec_id", exact.alias("score")).select("query_id", place.cast("int").alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
