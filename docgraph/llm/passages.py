"""Removal of repeated passages by suffix sorting.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller doc_id.

1. Of every ``length``-byte window of a text the least hashed K-gram is its anchor.  Equal windows have equal
   anchors, so a window can only repeat where its anchor's hash does.  Hashes meet in buckets, packed, each once a batch.
2. Around each anchor whose hash repeats, the stretch that holds just the windows of that anchor is cut out.
   Stretches of one hash meet in one shard; equal stretches of a batch travel once, with the least doc_id.
3. Where a hash has one stretch, all its documents but the least repeat it.  The others of a shard are sorted by external induced
   sorting (see ``suffixes``).  Where neighbours share ``length`` bytes, the windows are equal and the least doc_id keeps its own.
   A shard is read as a stream, and what grows with it is in files beyond a budget.
4. The marks return to the documents.  Exact copies of a document are found by hash first and stay out of 1, 2 and 3.

What goes from every task to every bucket, shard or part grows with the square of the corpus in number, so tasks gather
HASHED bytes or HELD stretches before they send, and buckets, shards and parts are as large as memory allows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, releasing
from .suffixes import BLOCK, BUDGET, Spool, blocks, room, suffix_array

PIECE = 1 << 20  #: bytes of a text that are hashed at once
HELD = 250_000  #: stretches that a task holds before it sends them
HASHED = 8 << 20  #: bytes of texts whose hashes a task sends together
GRAM = 24  #: bytes that seldom repeat without a passage that does; shorter ones do so the more, the larger the corpus is
BUCKET_BYTES, SHARD_BYTES = 32 << 20, 12 << 20  #: bytes of the corpus for each bucket of hashes and each shard of stretches
PART_BYTES = 16 << 20  #: bytes of the corpus for each part that marks go back to
_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram(length: int) -> int:
    """Bytes of an anchor; a window has ``length - gram + 1`` of them, 64 at most."""
    return max(1, min(length // 2, GRAM), length - 63)


def _gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-gram, put together from those of powers of two."""
    h = (raw.astype(np.uint64) + np.uint64(1)) * _ODD
    out, done, size = None, 0, 1
    while size <= k:
        if k & size:
            n = len(raw) - done - size + 1
            out = h[:n].copy() if out is None else (out[:n] * _ODD) ^ h[done : done + n]
            done += size
        if 2 * size <= k:
            x = h[:-size] * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            x += h[size:]
            x *= np.uint64(0x94D049BB133111EB)
            h = x ^ (x >> np.uint64(32))
        size *= 2
    out = out * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        s = min(have, width - have)
        values = np.minimum(values[:-s], values[s:])
        have += s
    return values


_SPOT = np.uint64((1 << 24) - 1)


def anchors(raw: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, spans) of each gram that is the first least hashed of some windows, for texts that stand one after another.

    ``starts`` ends with the length of all.  Spans has how far before the place the first of those windows begins
    (times 64) and how far the last.  Hashes are compared by their upper 40 bits with the place behind, so that one running
    minimum tells both.
    """
    k, out = gram(length), []
    for at in range(0, len(raw) - length + 1, PIECE):
        x = _gram_hashes(raw[at : at + PIECE + length - 1], k)
        place = (_least(x & ~_SPOT | np.arange(len(x), dtype=np.uint64), length - k + 1) & _SPOT).astype(np.int64)
        n = len(place)
        inside = np.ones(n, bool)  # windows that cross into the next text are none
        for s in starts[1:-1][(starts[1:-1] > at) & (starts[1:-1] < at + n + length)].tolist():
            inside[max(0, s - at - length + 1) : max(0, s - at)] = False
        window = np.flatnonzero(inside)
        place = place[window]
        if not len(place):
            continue
        change = np.flatnonzero(place[1:] != place[:-1])
        first, last = np.append(0, change + 1), np.append(change, len(place) - 1)
        p = place[first]
        out.append((p + at, x[p], ((p - window[first]) << 6 | (p - window[last])).astype(np.uint16)))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint16)
    place, h, spans = (np.concatenate(c) for c in zip(*out, strict=True))
    again = np.flatnonzero(place[1:] == place[:-1])  # an anchor with windows in two pieces
    spans[again + 1] = (spans[again] & np.uint16(0xFFC0)) | (spans[again + 1] & np.uint16(63))
    keep = np.ones(len(place), bool)
    keep[again] = False
    return place[keep], h[keep], spans[keep]


def _small(raw: bytes) -> bytes:
    """Bytes on their way, compressed behind their number."""
    return len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def _large(raw: bytes) -> bytes:
    return pa.decompress(memoryview(raw)[4:], int.from_bytes(raw[:4], "little"), "zstd", asbytes=True)


def _squeezed(a: np.ndarray, kind: str, steps: bool = False) -> bytes:
    """An array on its way: as ``kind``, of steps if asked, byte planes apart, compressed."""
    a = (np.diff(a, prepend=a.dtype.type(0)) if steps else a).astype(kind)
    return _small(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def _restored(raw: bytes, kind: str, steps: bool = False) -> np.ndarray:
    planes = np.frombuffer(_large(raw), np.uint8)
    size = np.dtype(kind).itemsize
    a = np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()
    return np.cumsum(a, dtype=a.dtype) if steps else a


def _bytes(text) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


_HASHES = pa.schema([("bucket", pa.int64()), ("known", pa.bool_()), ("docs", pa.binary()), ("keys", pa.binary()), ("doc", pa.binary()), ("place", pa.binary()), ("near", pa.binary()), ("spans", pa.binary()), ("hash", pa.binary())])
_PARTS = pa.schema([("part", pa.int64()), ("docs", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()), ("items", pa.binary())])
_STRETCHES = pa.schema([("shard", pa.int64()), ("known", pa.bool_()), ("docs", pa.binary()), ("keys", pa.binary()), ("at", pa.binary()), ("windows", pa.binary()), ("which", pa.binary()), ("texts", pa.binary()), ("sizes", pa.binary()), ("hashes", pa.binary())])
_ITEMS = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("items", pa.binary())])
_FLAG = np.dtype([("place", "<u4"), ("spans", "<u2")])
_MARK = np.dtype([("at", "<u4"), ("windows", "<u8")])


def _spark(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} { {'int64': 'long', 'bool': 'boolean'}.get(str(f.type), str(f.type))}" for f in schema)


def _emit_hashes(length: int, buckets: int):
    def send(ids, keys, raws, serial):
        starts = np.append(0, np.cumsum([len(r) for r in raws]))
        place, h, spans = anchors(np.frombuffer(b"".join(raws), np.uint8), starts, length)
        doc = np.searchsorted(starts, place, side="right") - 1
        place = place - starts[doc]
        yield from _hash_rows(np.array(ids, np.int64), np.array(keys, np.int64), doc, place, spans, h, buckets, serial)

    def run(batches):
        ids, keys, raws, size, serial = [], [], [], 0, 0
        for b in batches:
            for doc, key, text in zip(b["doc_id"].fill_null(-(1 << 63)).to_pylist(), b["tkey"].to_pylist(), b["text"], strict=True):
                raw = _bytes(text.as_py())
                if len(raw) < length:
                    continue
                if raws and (size + len(raw) > HASHED or len(raws) == 1 << 16):
                    yield from send(ids, keys, raws, serial)
                    ids, keys, raws, size, serial = [], [], [], 0, serial + 1
                ids.append(doc)
                keys.append(key)
                raws.append(raw)
                size += len(raw)
        if raws:
            yield from send(ids, keys, raws, serial)

    return run


def _hash_rows(ids, keys, doc, place, spans, h, buckets, serial):
    """One row for each bucket, in which a hash stands once; where two documents of a batch share it, their places are known to repeat."""
    if not len(h):
        return
    order = np.argsort(h, kind="stable")  # documents stand in their order already
    h, doc, place, spans = h[order], doc[order], place[order], spans[order]
    first = np.append(True, h[1:] != h[:-1])
    group = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    several = np.minimum.reduceat(ids[doc], starts) != np.maximum.reduceat(ids[doc], starts)
    known = several[group]
    send = first | ~known  # a hash that repeats within one document keeps all its places
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    rest = (h // np.uint64(buckets)).astype(np.uint64) >> np.uint64(8)
    for told, rows in ((False, np.flatnonzero(send)), (True, np.flatnonzero(known))):
        key = bucket[rows] if not told else np.full(len(rows), -1 - serial % buckets)
        long = place[rows] >> 16 > 0  # rows of two-byte places and of four-byte ones
        by = np.argsort(((key + buckets) * 2 + long << 40) + order[rows], kind="stable")  # documents and places in their order
        rows, key, long = rows[by], key[by], long[by]
        cuts = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (long[1:] != long[:-1]))), len(key)) if len(key) else []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            r = rows[s:e]
            present, local = np.unique(doc[r], return_inverse=True)
            yield pa.RecordBatch.from_pylist(
                [{"bucket": int(key[s]), "known": told, "docs": _squeezed(ids[present], "<i8", True), "keys": _squeezed(keys[present], "<u4"), "doc": _squeezed(local, "<u2", True), "place": _squeezed(place[r], "<u4", True) if long[s] else b"", "near": b"" if long[s] else _squeezed(place[r], "<u2", True), "spans": _squeezed(spans[r], "<u2"), "hash": b"" if told else rest[r].astype("<u4").tobytes()}],
                schema=_HASHES,
            )


def _by_document(ids, keys, items, part=None):
    """(documents, their keys, bounds, items): items of a document together, and documents of a part, which is told by their ids."""
    order = np.lexsort((keys, ids) if part is None else (keys, ids, part))
    ids, keys, items = ids[order], keys[order], items[order]
    first = np.append(True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]))[: len(ids)]
    return ids[first], keys[first], np.append(np.flatnonzero(first), len(ids)), items


def _part(ids: np.ndarray, parts: int) -> np.ndarray:
    return ((ids.astype(np.uint64) * _ODD) >> np.uint64(33)).astype(np.int64) % parts


def _packed(ids, keys, items, parts: int) -> pa.Table:
    """Items on their way back to their documents, one row for each part of the documents."""
    d, k, cuts, x = _by_document(ids, keys, items, _part(ids, parts))
    part, rows = _part(d, parts), []
    ends = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(d)).tolist() if len(d) else []
    for s, e in zip(ends[:-1], ends[1:], strict=True):
        rows.append({"part": int(part[s]), "docs": _squeezed(d[s:e], "<i8", True), "keys": _squeezed(k[s:e], "<u4"), "counts": _squeezed(np.diff(cuts[s : e + 1]), "<u4"), "items": x[cuts[s] : cuts[e]].tobytes()})
    return pa.Table.from_pylist(rows, schema=_PARTS)


def _unpacked(kind: np.dtype):
    def run(table: pa.Table) -> pa.Table:
        ids, keys, items = [], [], []
        for row in table.to_pylist():
            n = _restored(row["counts"], "<u4")
            ids.append(np.repeat(_restored(row["docs"], "<i8", True), n))
            keys.append(np.repeat(_restored(row["keys"], "<u4").astype(np.int64), n))
            items.append(np.frombuffer(row["items"], kind))
        d, k, cuts, x = _by_document(*(np.concatenate(c) for c in (ids, keys, items)))
        return pa.Table.from_arrays([pa.array(d), pa.array(k), pa.array([x[s:e].tobytes() for s, e in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], schema=_ITEMS)

    return run


def _repeated(table: pa.Table, parts: int) -> pa.Table:
    """The anchors of a bucket whose hash stands in two documents, and those known before."""
    ids, keys, flags, hashes, sure = [], [], [], [], []
    for r in table.to_batches():
        for i in range(r.num_rows):
            row = {c: r[c][i].as_py() for c in ("known", "docs", "keys", "doc", "place", "near", "spans", "hash")}
            doc = _restored(row["doc"], "<u2", True)
            ids.append(_restored(row["docs"], "<i8", True)[doc])
            keys.append(_restored(row["keys"], "<u4")[doc])
            flag = np.empty(len(doc), _FLAG)
            flag["place"] = _restored(row["near"], "<u2", True) if row["near"] else _restored(row["place"], "<u4", True)
            flag["spans"] = _restored(row["spans"], "<u2")
            flags.append(flag)
            hashes.append(np.zeros(len(doc), np.uint32) if row["known"] else np.frombuffer(row["hash"], "<u4"))
            sure.append(np.full(len(doc), row["known"]))
    ids, keys, flags, hashes, sure = (np.concatenate(x) for x in (ids, keys, flags, hashes, sure))
    order = np.argsort(hashes, kind="stable")
    first = np.append(True, hashes[order][1:] != hashes[order][:-1])
    starts = np.flatnonzero(first)
    several = np.minimum.reduceat(ids[order], starts) != np.maximum.reduceat(ids[order], starts)
    hit = sure.copy()
    hit[order] |= several[np.cumsum(first) - 1]
    return _packed(ids[hit], keys[hit], flags[hit], parts)


def stretches(raw_size: int, flags: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window) of the stretch around each flagged anchor of a text."""
    found = np.unique(np.frombuffer(flags, _FLAG))
    place, spans = found["place"].astype(np.int64), found["spans"].astype(np.int64)
    a, z = place - (spans >> 6), place - (spans & 63)
    ok = (z + length <= raw_size) & (a >= 0)  # else of another row with this key
    return place[ok], a[ok], z[ok]


class _Held:
    """Stretches of a task that wait to be sent, equal ones together."""

    def __init__(self, length: int):
        self.length, self.raws, self.parts, self.used, self.n = length, [], [], 0, 0

    def add(self, doc: int, key: int, raw: bytes, flags: bytes) -> None:
        place, a, z = stretches(len(raw), flags, self.length)
        if len(place):
            self.parts.append((np.full(len(place), doc), np.full(len(place), key), place + self.used, a, a + self.used, z - a + 1))
            self.raws.append(raw)
            self.used += len(raw)
            self.n += len(place)

    def groups(self):
        """Occurrences (document, key, place) in groups of equal stretches, least document first, with the groups' hash and text.

        Returns doc, key, at, windows, group; and of each group its hash, where its text begins, and its size.
        """
        text = np.frombuffer(b"".join(self.raws) + b"\0" * 8, np.uint8)
        doc, key, place, at, begin, windows = (np.concatenate([p[k] for p in self.parts]) for k in range(6))
        words = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
        size = windows + self.length - 1
        h = _hashed(words, place, np.full(len(place), gram(self.length)))
        whole = _hashed(words, begin, size)
        order = np.lexsort((doc, whole, h))
        doc, key, at, windows, begin, size, h, whole = (x[order] for x in (doc, key, at, windows, begin, size, h, whole))
        new = np.append(True, (h[1:] != h[:-1]) | (whole[1:] != whole[:-1]) | (size[1:] != size[:-1]))
        same = np.flatnonzero(~new)
        new[same[~_equal(words, begin[same], begin[same - 1], size[same])]] = True  # hashes only bring together what is compared
        first = np.flatnonzero(new)
        return doc, key, at, windows, np.cumsum(new) - 1, h[first], begin[first], size[first], text


def _pieces(size: np.ndarray):
    """(place within, bytes that count) of the words of eight bytes of texts of these sizes, word by word."""
    for k in range(0, int(size.max(initial=0)), 8):
        yield k, np.minimum(size - k, 8)


def _masked(words: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n bytes from each place on as a number, 0 where n is not positive."""
    x = words[np.minimum(at, len(words) - 1)]
    return np.where(n > 0, x & (np.uint64(2**64 - 1) >> ((8 - np.clip(n, 1, 8)).astype(np.uint64) * np.uint64(8))), np.uint64(0))


def _hashed(words: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    h = size.astype(np.uint64) * _ODD
    for k, n in _pieces(size):
        h = (h ^ _masked(words, at + k, n)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _equal(words: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.ones(len(a), bool)
    for k, n in _pieces(size):
        out &= _masked(words, a + k, n) == _masked(words, b + k, n)
    return out


def _emit_stretches(length: int, shards: int):
    everything, serial = 2**64 - 1, 0

    def send(held: _Held) -> Iterator[pa.RecordBatch]:
        nonlocal serial
        doc, key, at, windows, group, *texts = held.groups()
        least = doc[np.append(True, group[1:] != group[:-1])][group]
        known = doc > least  # another document has the whole stretch
        own = np.flatnonzero(~known)
        yield from _stretch_rows(doc[own], key[own], at[own], group[own], *texts, shards)
        rows = np.flatnonzero(known)
        rows = rows[np.lexsort((at[rows], key[rows], doc[rows]))]
        for s in range(0, len(rows), 50_000):
            r = rows[s : s + 50_000]
            bits = np.uint64(everything) >> (np.uint64(64) - windows[r].astype(np.uint64))
            yield pa.RecordBatch.from_pylist([{"shard": -1 - serial % shards, "known": True, **_owners(doc[r], key[r], at[r]), "windows": bits.tobytes(), "which": b"", "texts": b"", "sizes": b"", "hashes": b""}], schema=_STRETCHES)
            serial += 1

    def run(batches):
        held = _Held(length)
        for b in batches:
            for doc, key, text, places in zip(b["doc_id"].to_pylist(), b["tkey"].to_pylist(), b["text"], b["items"].to_pylist(), strict=True):
                if not places:
                    continue
                held.add(doc, key, _bytes(text.as_py()), places)
                if held.n > HELD:
                    yield from send(held)
                    held = _Held(length)
        if held.n:
            yield from send(held)

    return run


def _owners(doc: np.ndarray, key: np.ndarray, at: np.ndarray) -> dict[str, bytes]:
    return {"docs": _squeezed(doc, "<i8", True), "keys": _squeezed(key, "<u4"), "at": _squeezed(at, "<u4")}


def _stretch_rows(doc, key, at, group, hashes, begin, size, text, shards: int) -> Iterator[pa.RecordBatch]:
    """A row for each shard: occurrences by group, and the groups' texts in order of their hashes."""
    shard = (hashes % np.uint64(shards)).astype(np.int64)  # of each group; groups are in order of their hashes
    by = np.argsort(shard[group], kind="stable")
    to = shard[group[by]]
    cuts = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to))
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        r = by[s:e]
        names, which = np.unique(group[r], return_inverse=True)
        n = size[names]
        ends = np.cumsum(n)
        flat = np.repeat(begin[names] - (ends - n), n) + np.arange(int(ends[-1]))
        row = {"shard": int(to[s]), "known": False, **_owners(doc[r], key[r], at[r]), "windows": b"", "which": _squeezed(which, "<i4", True), "texts": _small(text[flat].tobytes()), "sizes": _squeezed(n, "<u2")}
        yield pa.RecordBatch.from_pylist([row | {"hashes": _squeezed((hashes[names] >> np.uint64(32)).astype(np.int64), "<u4", True)}], schema=_STRETCHES)


class _Shard:
    """A shard's stretches and whose they are, in memory up to the budget of each array and beyond in files.

    Texts are told apart while they fit; then ``whole`` says no, and a text may stand twice, which costs time and changes nothing.
    """

    def __init__(self, budget: int):
        self.budget, self.number, self.used, self.whole = budget, {}, 0, True
        self.docs, self.keys, self.at, self.which, self.hashes = (Spool(k, budget) for k in ("<i8", "<u4", "<u4", "<i8", "<u4"))
        self.text, self.sizes = Spool(np.uint8, budget), Spool("<u2", budget)

    def add(self, row: dict) -> None:
        sizes, text, hashes = _restored(row["sizes"], "<u2"), _large(row["texts"]), _restored(row["hashes"], "<u4", True)
        cuts = np.append(0, np.cumsum(sizes.astype(np.int64))).tolist()
        own = [text[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        if self.used > self.budget:
            self.number, self.used, self.whole = {}, 0, False
        before = self.sizes.n
        fresh = [k for k, t in enumerate(own) if t not in self.number]
        self.number.update((own[k], before + i) for i, k in enumerate(fresh))
        self.used += sum(len(own[k]) + 150 for k in fresh)
        names = np.array([self.number[t] for t in own], np.int64)
        self.text.put(np.frombuffer(b"".join(own[k] + b"\xff" for k in fresh), np.uint8) + np.uint8(1))  # 255 is no byte of UTF-8 and becomes the end mark 0
        self.sizes.put(sizes[fresh])
        self.hashes.put(hashes[fresh])
        self.which.put(names[_restored(row["which"], "<i4", True)])
        for spool, name, kind, steps in ((self.docs, "docs", "<i8", True), (self.keys, "keys", "<u4", False), (self.at, "at", "<u4", False)):
            spool.put(_restored(row[name], kind, steps))

    def marks(self, length: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Blocks of (document, key, place, windows that a smaller document has too) of the occurrences that have some."""
        docs, which = self.docs.array(), self.which.array()
        rows = (docs, which, self.text.array(), self.sizes.array(), self.hashes.array() if self.whole else None)
        keys, at = self.keys.array(), self.at.array()
        self.number = {}
        for s, e, bits in repeated_windows(*rows, length, self.budget):
            hit = np.flatnonzero(bits)
            yield docs[s:e][hit], keys[s:e][hit].astype(np.int64), at[s:e][hit], bits[hit]


def _sort_shards(length: int, parts: int, budget: int = BUDGET):
    """Work on a stream of stretches by shard, one shard at a time."""

    def marked(ids, keys, at, windows) -> Iterator[pa.RecordBatch]:
        marks = np.empty(len(ids), _MARK)
        marks["at"], marks["windows"] = at, windows
        yield from _packed(ids, keys, marks, parts).to_batches()

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, shard = None, None
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b[c][i].as_py() for c in b.schema.names}
                if row["known"]:
                    yield from marked(_restored(row["docs"], "<i8", True), _restored(row["keys"], "<u4").astype(np.int64), _restored(row["at"], "<u4"), np.frombuffer(row["windows"], "<u8"))
                    continue
                if row["shard"] != now:
                    if shard is not None:
                        for found in shard.marks(length):
                            yield from marked(*found)
                    now, shard = row["shard"], _Shard(budget)
                shard.add(row)
        if shard is not None:
            for found in shard.marks(length):
                yield from marked(*found)

    return run


def repeated_windows(docs: np.ndarray, which: np.ndarray, text: np.ndarray, sizes: np.ndarray, hashes: np.ndarray | None, length: int, budget: int = BUDGET) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, bits) of blocks of occurrences: for each a bit for each window that a smaller document has too.

    Occurrences are documents and numbers of stretches (``which``); ``text`` has the stretches one after another, each with its end mark.
    Equal windows have one anchor, so they stand in stretches of one hash: where a hash has a single stretch, all its windows
    repeat as the stretch does, and only stretches of hashes that have several are sorted.  Without ``hashes`` all are.  Hashes
    that agree in the part of them that is sent are sorted together, which changes nothing.
    """
    n = len(sizes)
    least = room(n, np.int64, budget)
    least[:] = np.iinfo(np.int64).max
    for s, e in blocks(len(docs)):
        np.minimum.at(least, which[s:e], docs[s:e])
    several = room(n, bool, budget)
    if hashes is None:
        several[:] = True
    else:
        _, group, count = np.unique(hashes, return_inverse=True, return_counts=True)
        several[:] = count[group] > 1
    first = _first_documents(text, sizes, least, several, length, budget)
    starts = _running(n, budget, lambda s, e: np.where(several[s:e], sizes[s:e].astype(np.int64) - length + 1, 0))
    for s, e in blocks(len(docs), BLOCK // 4):
        own, doc = which[s:e], docs[s:e]
        windows = sizes[own].astype(np.int64) - length + 1
        every = np.uint64(2**64 - 1) >> (np.uint64(64) - windows.astype(np.uint64))
        bits = np.where((doc > least[own]) & ~several[own], every, np.uint64(0))
        rows = np.flatnonzero(several[own])
        rows = rows[np.argsort(-windows[rows], kind="stable")]  # those with most windows first
        at, low, found = starts[own[rows]], doc[rows], np.zeros(len(rows), np.uint64)
        left = np.searchsorted(-windows[rows], -np.arange(64), side="left").tolist()  # how many have more than w windows
        for w in range(64):
            n = left[w]
            found[:n] |= (first[at[:n] + w] < low[:n]).astype(np.uint64) << np.uint64(w)
        bits[rows] = found
        yield s, e, bits


def _running(n: int, budget: int, of) -> np.ndarray:
    """Sums of what is before each of n values, and of all; ``of`` gives the values of a block."""
    out, total = room(n + 1, np.int64, budget), 0
    for s, e in blocks(n):
        out[s + 1 : e + 1] = total + np.cumsum(of(s, e))
        total = int(out[e])
    return out


def _first_documents(text: np.ndarray, sizes: np.ndarray, least: np.ndarray, several: np.ndarray, length: int, budget: int) -> np.ndarray:
    """The least document of each window of the stretches that ``several`` tells, one after another, by sorting their suffixes."""
    chosen, kept, at = Spool(np.int64, budget), Spool(np.uint8, budget), 0
    for s, e in blocks(len(sizes), BLOCK // 64):
        each = sizes[s:e].astype(np.int64) + 1
        end = at + int(each.sum())
        kept.put(text[at:end][np.repeat(several[s:e], each)])
        chosen.put(np.flatnonzero(several[s:e]) + s)
        at = end
    chosen, joined = chosen.array(), kept.array()
    starts = _running(len(chosen), budget, lambda s, e: sizes[chosen[s:e]].astype(np.int64) + 1)
    owners = room(len(joined), np.int32, budget)
    for s, e in blocks(len(chosen), BLOCK // 64):
        owners[starts[s] : starts[e]] = np.repeat(np.arange(s, e, dtype=np.int32), np.diff(starts[s : e + 1]))
    base = _running(len(chosen), budget, lambda s, e: sizes[chosen[s:e]].astype(np.int64) - length + 1)
    first = room(int(base[-1]), np.int64, budget)
    carry: tuple | None = None

    def settle(owner, spot, run):
        new = run < length
        new[0] = True
        group = np.cumsum(new) - 1
        low = np.minimum.reduceat(least[chosen[owner]], np.flatnonzero(new))
        first[spot] = low[group]

    for sa, lcp in suffix_array(joined, length, budget):
        owner = owners[sa]
        place = sa - starts[owner]
        # a suffix in between that is no window has no common prefix of this length with its neighbours
        run = np.minimum(lcp, length).astype(np.int64)
        ok = np.flatnonzero(place + length < starts[owner + 1] - starts[owner])
        owner, spot, run = owner[ok], base[owner[ok]] + place[ok], run[ok]
        if carry is not None:
            owner, spot, run = np.append(carry[0], owner), np.append(carry[1], spot), np.append(carry[2], run)
        if not len(owner):
            continue
        cut = np.flatnonzero(run < length)
        cut = int(cut[-1]) if len(cut) else 0  # the last group may go on in the next block
        if cut:
            settle(owner[:cut], spot[:cut], run[:cut])
        carry = owner[cut:], spot[cut:], run[cut:]
    if carry is not None and len(carry[0]):
        settle(*carry)
    return first


def covered(n: int, marks: bytes | None, length: int) -> np.ndarray:
    """Which of n bytes a marked window covers."""
    edge = np.zeros(n + 1, np.int64)
    found = np.frombuffer(marks or b"", _MARK)
    if not len(found):
        return np.zeros(n, bool)
    row, w = np.nonzero((found["windows"][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1))
    at = found["at"][row].astype(np.int64) + w
    edge += np.bincount(at, minlength=n + 1) - np.bincount(at + length, minlength=n + 1)
    return np.cumsum(edge[:-1]) > 0


def _by_parts(found: DataFrame, parts: int, kind: np.dtype) -> DataFrame:
    """What was found, as doc_id, tkey and items."""
    return found.repartition(parts, "part").groupBy("part").applyInArrow(releasing(_unpacked(kind)), _spark(_ITEMS))


def find_repeats(docs: DataFrame, length: int = 50, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the columns ``keep`` as kept0, kept1 and so on, marks (windows to remove) and first_id of every row.

    first_id is the least doc_id with this text.  See ``remove_passages`` for what holds for nulls and ties.  All
    three joins take the same columns, so that the texts are shuffled once.
    """
    more = [F.col(c).alias(f"kept{i}") for i, c in enumerate(keep)]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").bitwiseAND(0xFFFFFFFF).alias("tkey"), *more)
    names = [f"kept{i}" for i in range(len(keep))]
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    info = materialize(docs.select("doc_id", "tkey", F.sha2(text, 256).alias("sha"), F.octet_length(text).alias("n")), "texts")
    total = info.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets, shards, parts = max(4, total // BUCKET_BYTES), max(4, total // SHARD_BYTES), max(4, total // PART_BYTES)
    firsts = info.filter(F.col("n") >= length).groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    copies = info.join(firsts.filter("copies > 1"), "sha").filter("doc_id > first_id").groupBy("doc_id", "tkey").agg(F.min("first_id").alias("first_id"))
    hashes = docs.join(copies, ["doc_id", "tkey"], "left_anti").mapInArrow(releasing(_emit_hashes(length, buckets)), _spark(_HASHES))
    flags = hashes.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(releasing(lambda t: _repeated(t, parts)), _spark(_PARTS))
    places = _by_parts(flags, parts, _FLAG)
    cut = docs.join(places, ["doc_id", "tkey"], "left").mapInArrow(releasing(_emit_stretches(length, shards)), _spark(_STRETCHES))
    sorted_ = cut.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(releasing(_sort_shards(length, parts)), _spark(_PARTS))
    marks = _by_parts(sorted_, parts, _MARK).withColumnRenamed("items", "marks")
    known = marks.join(copies, ["doc_id", "tkey"], "full")
    return docs.join(known, ["doc_id", "tkey"], "left").select("doc_id", "text", *names, "marks", "first_id")


def removed(raw: bytes, marks, first_id, length: int) -> np.ndarray:
    if first_id is not None:
        return np.ones(len(raw), bool)
    return covered(len(raw), marks, length)


def passage_digests(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; see ``remove_passages``."""

    def run(batches):
        for b in batches:
            rows = []
            for text, marks, first in zip(b["text"], b["marks"].to_pylist(), b["first_id"].to_pylist(), strict=True):
                raw = _bytes(text.as_py())
                if first is None and not marks:
                    rows.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                    continue
                gone = removed(raw, marks, first, length)
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return find_repeats(docs, length).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_passages(docs: DataFrame, length: int = 50, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text without repeated passages, n_removed (bytes) and the columns ``keep`` of every row of ``docs`` (doc_id, text).

    A character goes only if all its bytes do.  A null text stays null and counts as empty.  Rows with the same doc_id
    don't remove each other's bytes, so repeated rows fare alike.  A null doc_id neither removes nor loses
    anything.  An empty table gives no rows.  Other columns are ignored.
    """

    def run(batches):
        for b in batches:
            texts, gone_n = [], []
            for text, marks, first in zip(b["text"].to_pylist(), b["marks"].to_pylist(), b["first_id"].to_pylist(), strict=True):
                if text is None or (first is None and not marks):
                    texts.append(text)
                    gone_n.append(0)
                    continue
                raw = _bytes(text)
                gone = removed(raw, marks, first, length)
                data = np.frombuffer(raw, np.uint8)
                char = np.cumsum((data & 0xC0) != 0x80) - 1
                whole = np.ones(char[-1] + 1 if len(char) else 0, bool)
                whole[char[~gone]] = False
                gone = whole[char]
                texts.append(data[~gone].tobytes().decode("utf-8", "surrogatepass"))
                gone_n.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(texts, pa.string()), pa.array(gone_n, pa.int64()), *(b[f"kept{i}"] for i in range(len(keep)))], names=["doc_id", "text", "n_removed", *keep])

    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return find_repeats(docs, length, keep).mapInArrow(run, "doc_id long, text string, n_removed long" + kept)
