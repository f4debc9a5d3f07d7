"""N-gram Jaccard join by grouped prefixes.

Documents become sets of hashed word n-grams.  Under one order of all n-grams two sets that are similar enough share k
n-grams within their prefixes, the first ``size - ceil(t * size) + k`` of them.  The order puts what is frequent last: a
table of fixed size counts the n-grams of all documents, and hashes break ties.

Equal sets are one set.  Sets with equal prefix and size are one group; groups meet at the n-grams of their prefixes
and pass filters on size, position and number shared.  First each group goes to the one that it shares most with, and
each member to its group's first: a forest, whose roots are families.  Its links are verified, and the roots of what holds are
labels.  What is left is verified in two ways, so that no link between labels is lost: the members of a family with
several labels are compared block by block, where each set travels once for each block of its family and only links
come out; group pairs between families are expanded to members, pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, materialize, packed, releasing, unpacked
from .components import connected_components, roots
from .suffixes import Spool

COUNTERS, SLICES = 1 << 22, 64
BLOOM_BITS = 1 << 27  #: at most; a filter that gets full passes more and loses nothing
CHUNK = 1 << 20
BLOCK_SETS, BLOCK_BYTES = 512, 32 << 20  #: most that a block of a family holds, whichever is less, but one set
PAIRS, RUN_BYTES = 1 << 19, 16 << 20  #: group pairs that a task holds, and bytes of each column of an n-gram's postings
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    return h ^ (h >> np.uint64(29))


class _Numbers(dict):
    """A number for each word in order of arrival, and the words' hashes by number."""

    def __init__(self):
        super().__init__()
        self.hashes = np.empty(1 << 12, np.uint64)

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        if i == len(self.hashes):
            self.hashes = np.append(self.hashes, np.empty(i, np.uint64))
        self.hashes[i] = xxhash.xxh3_64_intdigest(word)
        return i


class Shingler:
    """Sets of hashed word n-grams; words are split at ASCII white space and A-Z are lower-cased."""

    def __init__(self, words: int):
        self.words, self.numbers = words, _Numbers()

    def ngrams(self, texts: list) -> tuple[np.ndarray, list[tuple[int, int]], dict[int, np.ndarray]]:
        """Hashes of all n-grams of whole texts one after another, each text's part, and the hash of texts shorter than an n-gram."""
        if len(self.numbers) > 100_000:
            self.numbers = _Numbers()
        words, parts, short = [], [], {}
        for i, text in enumerate(texts):
            own = text.encode("utf-8", "surrogatepass").lower().split() if text else []
            parts.append((len(words), max(len(words), len(words) + len(own) - self.words + 1)))
            words += own
            if 0 < len(own) < self.words:
                short[i] = np.array([len(own)], np.uint64)
                for w in own:
                    short[i] = _mix(short[i] * _M1 + np.uint64(xxhash.xxh3_64_intdigest(w)))
        at = np.array(list(map(self.numbers.__getitem__, words)), np.int64)
        a = self.numbers.hashes[at]
        n = max(0, len(a) - self.words + 1)
        h = a[:n].copy()
        for k in range(1, self.words):
            h = h * _M1 + a[k : k + n]
            h ^= h >> np.uint64(33)
        return _mix(h), parts, short

    def sets(self, texts: list) -> Iterator[np.ndarray]:
        """The sorted distinct hashes of each whole text."""
        h, parts, short = self.ngrams(texts)
        for i, (s, e) in enumerate(parts):
            if i in short:
                yield short[i]
                continue
            own = np.sort(h[s:e])
            yield own[np.append(True, own[1:] != own[:-1])] if len(own) else own


def required(size, percent: int):
    """The least overlap of a set of this size with one that is similar."""
    return -(-percent * size // 100)


def common_least(size, percent: int):
    """How many n-grams two similar sets of about this size share, at least, within their prefixes.

    The first k common n-grams of two sets that share m or more stand among the first size - m + k of either.  More than
    one is asked, so that n-grams that meet by chance, or in one passage, make no candidates.
    """
    return np.minimum(required(size, percent), 2 + size // 20)


def frequency_classes(docs: DataFrame, words: int) -> np.ndarray:
    """A class for each counter: how far the n-grams it counts, over all documents, exceed what chance puts there.

    Tasks send their counters by slices; a slice's counters are summed one by one as they come, and its classes, four
    megabytes of them in all at any size, go to the driver.
    """
    width = COUNTERS // SLICES

    def run(batches):
        counts, shingler = np.zeros(COUNTERS, np.uint32), Shingler(words)
        for b in batches:
            texts = b["text"].to_pylist()
            for s, e in by_bytes(texts, CHUNK):
                h, parts, short = shingler.ngrams(texts[s:e])
                for own in (*(h[i:j] for i, j in parts), *short.values()):
                    np.add.at(counts, (own % np.uint64(COUNTERS)).astype(np.int64), 1)
        for i, part in enumerate(counts.reshape(SLICES, -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packed(part)], pa.binary())], names=["slice", "counts"])

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b["slice"].to_pylist(), b["counts"], strict=True):
                total.setdefault(i, np.zeros(width, np.int64))
                total[i] += unpacked(x.as_py(), np.uint32, width)
        for i, x in total.items():
            middle = float(np.median(x))  # no n-gram, however frequent, moves it
            usual = middle + 4 * middle**0.5 + 8
            classes = np.where(x > usual, 1 + 2 * np.log2(np.maximum(x / usual, 1)), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([classes.tobytes()], pa.binary())], names=["slice", "classes"])

    rows = docs.select("text").mapInArrow(releasing(run), "slice int, counts binary").repartition(SLICES, "slice").mapInArrow(merge, "slice int, classes binary")
    out = np.zeros((SLICES, width), np.uint8)
    for r in rows.collect():  # SLICES rows
        out[r.slice] = np.frombuffer(r.classes, np.uint8)
    return out.ravel()


_SIGNED = "doc_id long, n long, s1 long, s2 long, p1 long, p2 long, prefix binary"


def _signatures(docs: DataFrame, words: int, percent: int, classes) -> DataFrame:
    """doc_id, n, a signature of the set (s1, s2), one of its prefix (p1, p2) and the prefix (hashes in the common order)."""

    def run(batches):
        shingler, order = Shingler(words), classes.value
        for b in batches:
            texts = b["text"].to_pylist()
            n, sign, prefix = [], [], []
            for s, e in by_bytes(texts, CHUNK):
                for h in shingler.sets(texts[s:e]):
                    rank = order[(h % np.uint64(COUNTERS)).astype(np.int64)]
                    size = len(h) - required(len(h), percent) + int(common_least(len(h), percent)) if len(h) else 0
                    n.append(len(h))
                    prefix.append(h[np.argsort(rank, kind="stable")[:size]].tobytes())
                    sign.append(xxhash.xxh3_128_digest(h.tobytes()) + xxhash.xxh3_128_digest(prefix[-1]))
            four = np.frombuffer(b"".join(sign), "<i8").reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), *(pa.array(four[:, k]) for k in range(4)), pa.array(prefix, pa.binary())], names=["doc_id", "n", "s1", "s2", "p1", "p2", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(releasing(run), _SIGNED)


_POSTINGS = "bucket int, token binary, grp binary, n binary, pos binary"


def _emit_postings(buckets: int):
    def run(batches):
        for b in batches:
            prefixes = [np.frombuffer(x, np.uint64) for x in b["prefix"].to_pylist()]
            size = [len(p) for p in prefixes]
            if not sum(size):
                continue
            token = np.concatenate(prefixes)
            grp, n = np.repeat(np.array(b["grp"], np.int64), size), np.repeat(np.array(b["n"], np.int64), size)
            pos = np.concatenate([np.arange(s) for s in size])
            bucket = (_mix(token) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.append(np.flatnonzero(np.append(True, np.diff(bucket[order]) > 0)), len(order))
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                r = order[s:e]
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[r[0]])], pa.int32())] + [pa.array([x[r].astype(k).tobytes()], pa.binary()) for x, k in ((token, "<u8"), (grp, "<i8"), (n, "<u4"), (pos, "<u4"))], names=["bucket", "token", "grp", "n", "pos"])

    return run


def _fits(na, pa_, nb, pb, percent: int):
    """Size and position filters: whether sets that share the n-gram at these places can be similar."""
    need = -(-percent * (na + nb) // (100 + percent))
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (1 + np.minimum(pa_, pb) + np.minimum(na - pa_ - 1, nb - pb - 1) >= need)


_SHARED = "hub boolean, token long, grp long, n long, pos long"


def _shared(percent: int):
    """Of a bucket, the postings whose n-gram two groups have that fit, and (as hub rows: grp, token = other group, n = shared, pos = least to share) whom each meets first and nearest."""

    def run(table: pa.Table) -> pa.Table:
        token, grp, n, pos = (np.concatenate([np.frombuffer(x, k) for x in table[c].to_pylist()]).astype(np.int64) for c, k in (("token", "<i8"), ("grp", "<i8"), ("n", "<u4"), ("pos", "<u4")))
        order = np.argsort(token, kind="stable")
        token, grp, n, pos = token[order], grp[order], n[order], pos[order]
        same = token[1:] == token[:-1]
        keep = np.append(same, False) | np.append(False, same)
        token, grp, n, pos = token[keep], grp[keep], n[keep], pos[keep]
        order = np.lexsort((grp, n, token))
        order = order[np.append(True, np.diff(token[order]) | np.diff(grp[order]) | np.diff(n[order]) != 0)[: len(order)]]  # a repeated row's are one
        token, grp, n, pos = token[order], grp[order], n[order], pos[order]
        # the nearest sizes stand beside; where they don't fit, none does, and two alone have to fit wholly
        beside = (token[1:] == token[:-1]) & (100 * n[:-1] >= percent * n[1:])
        alone = beside & ~np.append(False, token[2:] == token[:-2]) & ~np.append(token[2:] == token[:-2], False)
        beside &= ~alone | _fits(n[:-1], pos[:-1], n[1:], pos[1:], percent)
        keep = (np.append(beside, False) | np.append(False, beside))[: len(token)]  # of none, none
        token, grp, n, pos = token[keep], grp[keep], n[keep], pos[keep]
        links = []
        if len(token):
            first = np.append(True, token[1:] != token[:-1])
            run_of = np.cumsum(first) - 1
            by_grp = np.lexsort((grp, token))
            least = by_grp[np.flatnonzero(first)][run_of]  # the run's least group
            here = np.arange(len(token))
            for other in (least, np.where(first, here, here - 1)):
                ok = (grp != grp[other]) & _fits(n, pos, n[other], pos[other], percent)
                a, b = grp[ok], grp[other[ok]]
                least_n = np.minimum(n[ok], n[other[ok]])
                links.append(np.stack([np.maximum(a, b), np.minimum(a, b), common_least(least_n, percent)], 1))
            pairs, count = np.unique(np.concatenate(links), axis=0, return_counts=True)
        else:
            pairs, count = np.empty((0, 3), np.int64), np.empty(0, np.int64)
        columns = [np.append(token, pairs[:, 1]), np.append(grp, pairs[:, 0]), np.append(n, count), np.append(pos, pairs[:, 2])]
        return pa.table([pa.array(np.append(np.zeros(len(token), bool), np.ones(len(pairs), bool))), *map(pa.array, columns)], names=["hub", "token", "grp", "n", "pos"])

    return run


def _rest(percent: int):
    """Group pairs of each run of postings (sorted by token) that aren't wholly within one label or one family, with how often they meet."""

    def of_run(grp, n, pos, low, high, family) -> Iterator[np.ndarray]:
        for s in range(0, len(grp), 1024):  # blocks, so that memory stays bounded
            i = np.arange(s, min(s + 1024, len(grp)))
            end = int(np.searchsorted(n, n[i[-1]] * 100 // percent, side="right"))
            for t in range(s, end, 1024):
                j = np.arange(t, min(t + 1024, end))
                settled = (low[i] == high[i])[:, None] & (low[j] == high[j])[None] & (low[i][:, None] == low[j][None])
                settled |= family[i][:, None] == family[j][None]
                ok = ~settled & (i[:, None] < j[None]) & _fits(n[i][:, None], pos[i][:, None], n[j][None], pos[j][None], percent)
                a, b = np.nonzero(ok)
                i_, j_ = i[a], j[b]
                a, b = grp[i_], grp[j_]
                yield np.stack([np.minimum(a, b), np.maximum(a, b), common_least(np.minimum(n[i_], n[j_]), percent)], 1)

    def flush(found: list[np.ndarray]):
        pairs, count = np.unique(np.concatenate(found), axis=0, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2]), pa.array(count.astype(np.int64))], names=["g", "h", "least", "shared"])

    def run(batches):
        run_of, found, size = _Run(), [], 0

        def pairs():
            for b in batches:
                columns = [np.array(b[c], np.int64) for c in ("token", "grp", "n", "pos", "low", "high", "family")]
                token = columns[0]
                cuts = np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token)) if len(token) else np.zeros(1, np.int64)
                for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if run_of.n and run_of.token != token[s]:
                        yield from of_run(*run_of.take())
                    run_of.put(int(token[s]), [c[s:e] for c in columns[1:]])
            if run_of.n:
                yield from of_run(*run_of.take())

        for p in pairs():
            found.append(p)
            size += len(p)
            if size > PAIRS:
                yield flush(found)
                found, size = [], 0
        if found:
            yield flush(found)

    return run


class _Run:
    """The postings of one n-gram, which may come in several batches, in files beyond RUN_BYTES a column."""

    def __init__(self):
        self.token, self.n, self.columns = 0, 0, [Spool("<i8", RUN_BYTES) for _ in range(6)]

    def put(self, token: int, columns: list[np.ndarray]) -> None:
        self.token, self.n = token, self.n + len(columns[0])
        for spool, c in zip(self.columns, columns, strict=True):
            spool.put(c)

    def take(self) -> list[np.ndarray]:
        out = [s.array() for s in self.columns]
        self.n, self.columns = 0, [Spool("<i8", RUN_BYTES) for _ in range(6)]
        return out


def _bloom(ids: DataFrame, count: int):
    """A bit table that holds the ids, of at most BLOOM_BITS bits."""
    bits = min(BLOOM_BITS, 1 << max(14, (16 * max(count, 1)).bit_length()))
    width = bits // 8 // SLICES

    def run(batches):
        table = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for k in _bloom_places(np.array(b["id"], np.int64), bits):
                np.bitwise_or.at(table, k >> 3, (128 >> (k & 7)).astype(np.uint8))
        for i, p in enumerate(table.reshape(SLICES, -1)):
            if p.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packed(p)], pa.binary())], names=["slice", "bits"])

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b["slice"].to_pylist(), b["bits"], strict=True):
                total[i] = total.get(i, 0) | unpacked(x.as_py(), np.uint8, width)
        for i, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["slice", "bits"])

    out = np.zeros((SLICES, width), np.uint8)
    for r in ids.select("id").mapInArrow(run, "slice int, bits binary").repartition(SLICES, "slice").mapInArrow(merge, "slice int, bits binary").collect():  # 16 MB at most
        out[r.slice] = np.frombuffer(r.bits, np.uint8)
    return out.ravel(), bits


def _bloom_places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    a = _mix(ids.astype(np.uint64) * _M1 + np.uint64(1))
    return [((a >> np.uint64(s)) % np.uint64(bits)).astype(np.int64) for s in (0, 20, 37)]


def _sets_of(docs: DataFrame, words: int, model) -> DataFrame:
    """doc_id and set (hashes in order, packed) of the documents that the bit table holds."""

    def run(batches):
        shingler, (table, bits) = Shingler(words), model.value
        for b in batches:
            ids = np.array(b["doc_id"], np.int64)
            hit = np.ones(len(ids), bool)
            for k in _bloom_places(ids, bits):
                hit &= (table[k >> 3] >> (7 - (k & 7))) & 1 > 0
            rows = np.flatnonzero(hit)
            texts = [b["text"][i].as_py() for i in rows]
            for s, e in by_bytes(texts, CHUNK):
                sets = [_sent(h) for h in shingler.sets(texts[s:e])]
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows[s:e]]), pa.array(sets, pa.binary())], names=["doc_id", "set"])

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(releasing(run), "doc_id long, set binary")


def _sent(hashes: np.ndarray) -> bytes:
    """A set on its way: all bits of its hashes, as steps from one to the next, whose upper bytes are small and compress, behind their number."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    return len(hashes).to_bytes(4, "little") + packed(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def _received(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    planes = unpacked(memoryview(raw)[4:], np.uint8, 8 * n).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _pair_places(pairs: DataFrame, star: int = 2000) -> DataFrame:
    """Where sets go for ``pairs`` (a, b): each to the place of its b; a b with many pairs has a place for each ``star`` of them."""
    size = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(star)).cast("int").alias("places"))
    spread = pairs.join(size, "b").select(F.col("a").alias("doc_id"), "b", F.pmod(F.xxhash64("a"), F.col("places")).cast("int").alias("i"), F.lit(1).alias("side"))
    hubs = size.select(F.col("b").alias("doc_id"), "b", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("i"), F.lit(0).alias("side"))
    return spread.unionByName(hubs).select("doc_id", F.col("b").alias("home"), F.lit(-1).alias("s"), "i", F.lit(-1).alias("t"), F.lit(0).alias("j"), "side")


def _block_places(members: DataFrame, percent: int) -> DataFrame:
    """Where sets go for families (rep, n, family): classes of size are split into blocks; blocks meet in their class and with the next.

    A set that is similar to one of class s is of class s - 1 to s + 1.
    """
    m = members.withColumn("s", F.floor(F.log("n") / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int"))
    size = m.groupBy("family", "s").agg(F.ceil(F.greatest(F.count("*") / F.lit(BLOCK_SETS), F.sum("n") * F.lit(8.0 / BLOCK_BYTES))).cast("int").alias("k"))
    at = m.join(size, ["family", "s"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    same = at.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        "rep", "family", "s", F.least("own", "j").alias("i"), F.col("s").alias("t"), F.greatest("own", "j").alias("j"), F.lit(0).alias("side")
    )
    other = size.select("family", F.col("s").alias("s2"), F.col("k").alias("k2"))
    each = F.explode(F.sequence(F.lit(0), F.col("k2") - 1))
    up = at.withColumn("s2", F.col("s") + 1).join(other, ["family", "s2"]).withColumn("j", each).select("rep", "family", "s", F.col("own").alias("i"), F.col("s2").alias("t"), "j", F.lit(0).alias("side"))
    down = at.withColumn("s2", F.col("s") - 1).join(other, ["family", "s2"]).withColumn("i", each).select("rep", "family", F.col("s2").alias("s"), "i", F.col("s").alias("t"), F.col("own").alias("j"), F.lit(1).alias("side"))
    return same.unionByName(up).unionByName(down).select(F.col("rep").alias("doc_id"), F.col("family").alias("home"), "s", "i", "t", "j", "side")


def _overlaps(sets: list[np.ndarray], width: int = 1 << 14) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0-1 matrices over the elements that two sets have."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, name, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[name] > 1
    name, owner = np.unique(name[keep], return_inverse=True)[1], owner[keep]
    out = np.zeros((len(sets), len(sets)))
    order = np.argsort(name, kind="stable")
    name, owner = name[order], owner[order]
    for low in range(0, int(name[-1]) + 1 if len(name) else 0, width):
        s, e = np.searchsorted(name, (low, low + width))
        grid = np.zeros((len(sets), width), np.float32)
        grid[owner[s:e], name[s:e] - low] = 1
        out += grid @ grid.T
    return out


def _block_links(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that bind a place's similar sets: each set's links to others not yet bound to it."""
    size = np.array([len(x) for x in sets])
    common = _overlaps(sets)
    similar = (100 * common >= percent * (size[:, None] + size[None] - common)) & (common > 0)
    bound, out = np.arange(len(ids)), []
    for i in range(len(ids)):
        for j in np.flatnonzero(similar[i, :i]).tolist():
            if bound[i] != bound[j]:
                bound[bound == bound[i]] = bound[j]
                out.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
    return out


def _verified(docs: DataFrame, dest: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) with |A and B| * 100 >= percent * |A or B| among the sets that meet at places.

    At a place of pairs (t < 0) the sets of side 1 are compared with that of side 0; at a place of blocks all are
    compared with each other, and enough links come out to bind what is bound.
    """
    dest = materialize(dest, "places")
    ids = dest.select(F.col("doc_id").alias("id"))
    model = docs.sparkSession.sparkContext.broadcast(_bloom(ids, dest.agg(F.approx_count_distinct("doc_id")).first()[0]))
    place = ["home", "s", "i", "t", "j"]
    rows = _sets_of(docs, words, model).join(dest, "doc_id").select(*place, "side", F.col("doc_id").alias("a"), "set").repartition(*place).sortWithinPartitions(*place, "side", "a")

    def run(batches):
        at, names, sets = None, [], []

        def blocks_done():
            found = _block_links(names, sets, percent) if len(names) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            a_out, b_out = [], []
            for *here, side, a, raw in zip(*(batch[c].to_pylist() for c in (*place, "side", "a", "set")), strict=True):
                x = _received(raw)
                if here != at:
                    if at is not None and at[3] >= 0:
                        yield blocks_done()
                    at, names, sets = here, [], []
                if here[3] >= 0 or side == 0:
                    names.append(a)
                    sets.append(x)
                    continue
                for base in sets:
                    spot = np.searchsorted(base, x)
                    common = int((base[np.minimum(spot, len(base) - 1)] == x).sum())
                    if 100 * common >= percent * (len(base) + len(x) - common):
                        a_out.append(a)
                        b_out.append(here[0])
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])
        if at is not None and at[3] >= 0:
            yield blocks_done()

    found = materialize(rows.mapInArrow(releasing(run), "a long, b long"), "verified")
    model.destroy()
    return found


def _least_shared(percent: int):
    """What a set of size n shares at least with a similar one, as that is as small as can be."""
    least_size = F.ceil(F.col("n") * percent / 100)
    return F.least(F.ceil(least_size * percent / 100), 2 + F.floor(least_size / 20))


def _enough(runs: DataFrame, percent: int) -> DataFrame:
    """Postings of groups that have as many as two similar sets must share."""
    good = runs.groupBy("grp").agg(F.count("*").alias("c"), F.max("n").alias("n")).filter(F.col("c") >= _least_shared(percent)).select("grp")
    return runs.join(good, "grp")


def _apart(runs: DataFrame, percent: int, rounds: int = 1) -> DataFrame:
    """Postings whose n-gram two families have, of groups that keep enough of them."""
    for _ in range(rounds):
        apart = runs.groupBy("token").agg(F.min("family").alias("l"), F.max("family").alias("h")).filter("l <> h").select("token")
        runs = _enough(runs.join(apart, "token"), percent)
    return runs


def _toward(runs: DataFrame, percent: int) -> DataFrame:
    """Parents (a, b) of families: of a group's family and the one that most have where it shares enough n-grams the larger goes to the smaller."""
    count = runs.groupBy("token", "family").agg(F.count("*").alias("c"))
    most = count.groupBy("token").agg(F.max(F.struct("c", (-F.col("family")).alias("f"))).alias("m")).select("token", (-F.col("m.f")).alias("most"))
    shared = runs.join(most, "token").filter("family <> most").groupBy("grp", "family", "most").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    near = shared.filter(F.col("c") >= _least_shared(percent))
    return near.select(F.greatest("family", "most").alias("a"), F.least("family", "most").alias("b")).groupBy("a").agg(F.min("b").alias("b"))


def near_copy_classes(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Documents link when the Jaccard similarity of their sets of word n-grams is at least ``percent`` / 100; a component's
    id is the least doc_id that links reach.  With fewer words than an n-gram has, the whole sequence is one; without
    words or text a set is empty and linked with nothing.  A row with a null doc_id is kept, linked
    with nothing, and its component is null.  Rows with one doc_id are one document with the links of all their texts, and
    each has the size of its own.  Repeated rows repeat.  An empty table gives no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    classes = spark.sparkContext.broadcast(frequency_classes(docs, words))
    signed = materialize(_signatures(docs, words, percent, classes), "signatures")
    classes.destroy()
    key = ["s1", "s2", "n"]
    known = signed.filter("n > 0 and doc_id is not null")
    reps = known.groupBy(*key, "p1", "p2").agg(F.min("doc_id").alias("rep"))
    reps = materialize(reps, "reps")
    firsts = reps.groupBy("p1", "p2", "n").agg(F.min("rep").alias("grp"))
    sets = materialize(reps.join(firsts, ["p1", "p2", "n"]).select(*key, "rep", "grp"), "sets")
    groups = known.join(sets.filter("grp = rep").select(*key, F.col("grp").alias("doc_id")), [*key, "doc_id"], "left_semi").select(F.col("doc_id").alias("grp"), "n", "prefix")
    size = signed.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0))).first()[0]
    buckets = max(4, size // (4 << 20))
    postings = groups.mapInArrow(_emit_postings(buckets), _POSTINGS).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(releasing(_shared(percent)), _SHARED)
    postings = materialize(postings, "postings")

    met = postings.filter("hub").groupBy("grp", "token", "pos").agg(F.sum("n").alias("shared")).filter("shared >= pos")
    best = met.groupBy("grp").agg(F.max(F.struct("shared", (-F.col("token")).alias("low"))).alias("x")).select(F.col("grp").alias("a"), (-F.col("x.low")).alias("b"))
    best = materialize(best, "best")
    members = sets.filter("rep <> grp").select(F.col("rep").alias("a"), F.col("grp").alias("b"))
    linked = _verified(docs, _pair_places(best.unionByName(members)), words, percent)
    labels = roots(linked).withColumnsRenamed({"node": "rep", "root": "label"})
    families = roots(best).withColumnsRenamed({"node": "grp", "root": "family"})
    named = sets.select("rep", "grp", "n").join(labels, "rep", "left").join(families, "grp", "left")
    named = materialize(named.select("rep", "grp", "n", F.coalesce("label", "rep").alias("label"), F.coalesce("family", "grp").alias("family")), "named")

    span = named.groupBy("grp").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("family").alias("family"))
    runs = materialize(_apart(postings.filter("not hub").select("token", "grp", "n", "pos").join(span, "grp"), percent), "runs")
    joined = roots(materialize(_toward(runs, percent), "toward")).withColumnsRenamed({"node": "family", "root": "whole"})
    whole = F.coalesce("whole", "family").alias("family")
    named = materialize(named.join(joined, "family", "left").select("rep", "grp", "n", "label", whole), "named2")
    runs = materialize(_apart(runs.join(joined, "family", "left").select("token", "grp", "n", "pos", "low", "high", whole), percent), "runs2")

    split = named.groupBy("family").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l <> h").select("family")
    blocks = _block_places(materialize(named.join(split, "family").select("rep", "n", "family"), "split"), percent)
    rest = runs.repartition("token").sortWithinPartitions("token", "n", "grp").select("token", "grp", "n", "pos", "low", "high", "family").mapInArrow(releasing(_rest(percent)), "g long, h long, least long, shared long")
    rest = materialize(rest.groupBy("g", "h", "least").agg(F.sum("shared").alias("shared")).filter("shared >= least").select("g", "h"), "rest")
    x, y = (named.select(F.col("grp").alias(g), F.col("rep").alias(r), F.col("label").alias(c)) for g, r, c in (("g", "b", "lb"), ("h", "a", "la")))
    more = materialize(rest.join(x, "g").join(y, "h").filter("la <> lb").select("a", "b").distinct(), "second")
    more = _verified(docs, _pair_places(more).unionByName(blocks), words, percent)
    component = materialize(connected_components(linked.unionByName(more).unionByName(_same_document(known, sets))), "components")
    whole = sets.join(component, sets.rep == component.node, "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", *key).join(whole, key, "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id"))


def _same_document(known: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between a doc_id that has several sets and their first documents."""
    several = known.groupBy("doc_id").agg(F.min("s1").alias("l"), F.max("s1").alias("h"), F.min("s2").alias("l2"), F.max("s2").alias("h2")).filter("l <> h or l2 <> h2").select("doc_id")
    own = materialize(known.join(several, "doc_id", "left_semi").select("doc_id", "s1", "s2", "n").distinct(), "several")
    return own.join(sets, ["s1", "s2", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
