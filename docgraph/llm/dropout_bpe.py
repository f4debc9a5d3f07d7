"""SentencePiece encoding with seeded merge dropout, and decoding.

Byte-pair merges of a published SentencePiece model are taken from an agenda, best score first and leftmost among
equals.  Each candidate merge is skipped if a keyed hash of (seed, document, place of the unit, place of the merge) falls below the dropout
rate, so every occurrence of a word has its own segmentation, each is reproducible, and all decode to the text.

A unit is a run of spaces with the word behind it; no piece of the vocabulary reaches from a word into a space, so units are
segmented apart.  What a unit becomes depends on nothing but which of its possible merges are skipped: for short units these are
the bits of a number, and within a chunk equal (unit, number) are segmented once.  Units of like length run through the
agenda together as arrays, one merge of each in a round.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

SPACE = "▁"
NEVER = np.int32(2**31 - 1)
CHUNK, LONG = 4 << 20, 64
SHORT = 11  #: characters of a unit whose merges have a bit each: SHORT * (SHORT - 1) / 2 of 64
SPELLED = 22  #: bits of the hashes by which parts of units are known for pieces
_UNIT = re.compile(" +[^ ]*|[^ ]+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _spelled(h: np.ndarray, symbol) -> np.ndarray:
    h = (h ^ symbol) * _M1
    return h ^ (h >> np.uint64(29))


def _bit(start, end):
    """The number of the part start..end of a short unit."""
    return (end - 1) * (end - 2) // 2 + start


def _happens(salts, start, end, rate):
    """What the keyed hash says of the merge of characters start..end."""
    h = _mix(salts + (start.astype(np.uint64) << np.uint64(32) | end.astype(np.uint64)) * _M1)
    return (h >> np.uint64(11)).astype(np.float64) >= rate * 2.0**53


class MergeModel:
    """Pieces and merges of a BPE model with byte fallback.

    Symbols are ids of pieces; a character without a piece is UNKNOWN + its code point and becomes its UTF-8 bytes at the end.
    """

    UNKNOWN = 1 << 20

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain, self.byte_ids, self.raw = {}, {}, []
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                plain[piece] = i
                self.raw.append(piece.replace(SPACE, " ").encode())
        self.byte_table = np.array([self.byte_ids[b] for b in range(256)], np.int32)
        self.char_ids = np.arange(0x110000, dtype=np.int32) + self.UNKNOWN
        for piece, i in plain.items():
            if len(piece) == 1:
                self.char_ids[ord(piece)] = i
        self.char_ids[ord(" ")] = plain[SPACE]
        self.char_ids[ord(SPACE)] = ord(SPACE) + self.UNKNOWN  # what spells the space sign itself stays apart from spaces
        long = [(p, i) for p, i in plain.items() if len(p) > 1]
        order = sorted(long, key=lambda x: -sp.get_score(x[1]))
        self.piece_of_rank = np.array([i for _, i in order], np.int32)
        keys, ranks = [], []
        for rank, (piece, _) in enumerate(order):
            for k in range(1, len(piece)):
                left, right = piece[:k], piece[k:]
                a = plain.get(left, ord(left) + self.UNKNOWN if len(left) == 1 else None)
                b = plain.get(right, ord(right) + self.UNKNOWN if len(right) == 1 else None)
                if a is not None and b is not None:
                    keys.append(a << 22 | b)
                    ranks.append(rank)
        self._table(np.array(keys, np.int64), np.array(ranks, np.int32))
        self.spelled = np.zeros(1 << SPELLED, bool)
        for piece in plain:
            if 1 < len(piece) <= SHORT:
                h = np.zeros(1, np.uint64)
                for c in self.char_ids[[ord(x) if x != SPACE else ord(" ") for x in piece]]:
                    h = _spelled(h, np.uint64(c))
                self.spelled[h >> np.uint64(64 - SPELLED)] = True

    def _table(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing with linear probes."""
        self.bits = max(16, int(8 * len(keys)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER, np.int32)
        at, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            free = self.keys[at[left]] == -1
            _, one = np.unique(at[left], return_index=True)
            take = np.zeros(len(left), bool)
            take[one] = True
            take &= free
            self.keys[at[left[take]]], self.ranks[at[left[take]]] = keys[left[take]], ranks[left[take]]
            left = left[~take]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _M1) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merge_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the piece that a and b make, lower is better; NEVER if none."""
        keys = a.astype(np.int64) << 22 | b
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], NEVER)
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.ranks[at[left[hit]]]
            left = left[~hit & (found != -1)]
        return out

    def possible(self, units: list[str]) -> np.ndarray:
        """For each short unit a bit for each part that may be a piece, so that a merge may make it; a few more bits cost time and change nothing."""
        size = np.array([len(u) for u in units])
        flat = self.char_ids[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
        ends, out = np.cumsum(size), np.zeros(len(units), np.uint64)
        by = np.argsort(-size, kind="stable")  # long ones first: those that have a place stand in front
        begin, left = (ends - size)[by], np.searchsorted(-size[by], -np.arange(SHORT + 1), side="right").tolist()
        found = np.zeros(len(units), np.uint64)
        for start in range(SHORT - 1):
            h = np.zeros(left[start + 1], np.uint64)
            for end in range(start + 1, SHORT + 1):
                n = left[end]  # units of at least ``end`` characters
                if not n:
                    break
                h = _spelled(h[:n], flat[begin[:n] + end - 1])
                if end > start + 1:
                    found[:n] |= self.spelled[h >> np.uint64(64 - SPELLED)].astype(np.uint64) << np.uint64(_bit(start, end))
        out[by] = found
        return out

    def segment(self, units: list[str], salts: np.ndarray, rate: float, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all units (or of those that ``which`` numbers), one after another, and how many each has.

        ``salts`` of units of up to SHORT characters are the bits of the merges that are skipped; of longer ones, keys of the hash
        that tells.
        """
        which = np.arange(len(units)) if which is None else which
        length = np.array([len(u) for u in units], np.int64)
        flat = self.char_ids[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)]
        begin, size = (np.cumsum(length) - length)[which], length[which]
        counts, parts = np.zeros(len(which), np.int64), []
        groups = np.select([size <= 6, size <= SHORT, size <= 16, size <= 32, size <= LONG], [6, SHORT, 16, 32, LONG], 0)
        for width in (6, SHORT, 16, 32, LONG):
            members = np.flatnonzero(groups == width)
            for s in range(0, len(members), 50_000):
                rows = members[s : s + 50_000]
                grid = np.arange(width)[None] < size[rows][:, None]
                symbols = np.full((len(rows), width), -1, np.int32)
                symbols[grid] = flat[(begin[rows][:, None] + np.arange(width))[grid]]
                found, n = self._agenda(symbols, size[rows], salts[rows], rate, width <= SHORT)
                counts[rows] = n
                parts.append((rows, found[np.arange(width)[None] < n[:, None]]))
        for i in np.flatnonzero(groups == 0).tolist():
            found = self.segment_one(flat[begin[i] : begin[i] + size[i]], salts[i], rate)
            counts[i] = len(found)
            parts.append((np.array([i]), found))
        out, ends = np.empty(int(counts.sum()), np.int32), np.cumsum(counts)
        for rows, found in parts:
            n = counts[rows]
            out[np.repeat(ends[rows] - np.cumsum(n), n) + np.arange(len(found))] = found
        return out, counts

    def _kept(self, salts, start, end, rate, short: bool):
        """Whether the merge of characters start..end happens."""
        if short:
            return (salts >> _bit(start, end).astype(np.uint64)) & np.uint64(1) == 0
        return _happens(salts, start, end, rate)

    def _agenda(self, symbols, size, salts, rate, short) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of each row once no merge is left, and how many."""
        n, width = symbols.shape
        rows, done, count = np.arange(n), np.full((n, width), -1, np.int32), np.zeros(n, np.int64)
        ends = np.broadcast_to(np.arange(1, width + 1, dtype=np.int32), (n, width)).copy()
        rank = np.full((n, width), NEVER, np.int32)  # of the merge of a symbol with the next
        pair = np.arange(width - 1)[None] < (size - 1)[:, None]
        i, j = np.nonzero(pair)
        rank[i, j] = self.merge_ranks(symbols[i, j], symbols[i, j + 1])
        hit = np.flatnonzero(rank[i, j] != NEVER)
        i, j = i[hit], j[hit]
        drop = ~self._kept(salts[i], j, j + 2, rate, short)
        rank[i[drop], j[drop]] = NEVER
        columns = np.arange(width)
        while n:
            at = rank.argmin(1)
            best = rank[np.arange(n), at]
            ended = best == NEVER
            if ended.any():
                done[rows[ended]], count[rows[ended]] = symbols[ended], size[ended]
                on = ~ended
                rows, symbols, size, salts, ends, rank, at, best = rows[on], symbols[on], size[on], salts[on], ends[on], rank[on], at[on], best[on]
                n = len(rows)
                if not n:
                    break
            line = np.arange(n)
            ends[line, at] = ends[line, at + 1]
            symbols[line, at] = self.piece_of_rank[best]
            # close the gap
            source = np.minimum(columns[None] + (columns[None] > at[:, None]), width - 1)
            symbols, ends, rank = (np.take_along_axis(x, source, 1) for x in (symbols, ends, rank))
            size = size - 1
            symbols[line, size] = -1
            rank[line, size - 1] = NEVER
            rank[line, at] = NEVER
            for left in (at - 1, at):
                r = np.flatnonzero((left >= 0) & (left + 1 < size))
                a = left[r]
                found = self.merge_ranks(symbols[r, a], symbols[r, a + 1])
                some = np.flatnonzero(found != NEVER)
                begin = np.where(a[some] > 0, ends[r[some], np.maximum(a[some] - 1, 0)], 0)
                kept = self._kept(salts[r[some]], begin, ends[r[some], a[some] + 1], rate, short)
                found[some[~kept]] = NEVER
                rank[r, a] = found
        return done, count

    def segment_one(self, symbols: np.ndarray, salt, rate: float) -> np.ndarray:
        """The same agenda for one unit, with a heap over linked symbols."""
        import heapq

        n = len(symbols)
        short = n <= SHORT
        sym, before, after, end = symbols.tolist(), list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
        first = self.merge_ranks(symbols[:-1], symbols[1:])
        kept = self._kept(np.full(max(n - 1, 0), salt, np.uint64), np.arange(n - 1), np.arange(2, n + 1), rate, short)
        heap = [(int(r), i, i + 1, i + 2) for i, (r, k) in enumerate(zip(first, kept, strict=True)) if r != NEVER and k]
        heapq.heapify(heap)
        while heap:
            r, i, j, e = heapq.heappop(heap)
            if sym[i] < 0 or after[i] != j or j >= n or sym[j] < 0 or end[j] != e:
                continue
            if self.piece_of_rank[r] < 0 or int(self.merge_ranks(np.array([sym[i]]), np.array([sym[j]]))[0]) != r:
                continue
            sym[i], sym[j], end[i], after[i] = int(self.piece_of_rank[r]), -1, end[j], after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n:
                    q = int(self.merge_ranks(np.array([sym[a]]), np.array([sym[b]]))[0])
                    if q != NEVER and self._kept(np.array([salt], np.uint64), np.array([a]), np.array([end[b]]), rate, short)[0]:
                        heapq.heappush(heap, (q, a, b, end[b]))
        return np.array([s for s in sym if s >= 0], np.int32)

    def with_bytes(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become their bytes."""
        odd = np.flatnonzero(ids >= self.UNKNOWN)
        if not len(odd):
            return ids, counts
        spelled = {c: self.byte_table[list(chr(c).encode("utf-8", "surrogatepass"))] for c in np.unique(ids[odd] - self.UNKNOWN).tolist()}
        owner = np.repeat(np.arange(len(counts)), counts)
        size = np.ones(len(ids), np.int64)
        for i in odd.tolist():
            size[i] = len(spelled[ids[i] - self.UNKNOWN])
        out = np.repeat(ids, size)
        at = np.append(0, np.cumsum(size))
        for i in odd.tolist():
            out[at[i] : at[i + 1]] = spelled[ids[i] - self.UNKNOWN]
        return out, np.bincount(owner, weights=size, minlength=len(counts)).astype(np.int64)

    def decode(self, ids: list[int]) -> str:
        """The text of a document's ids: pieces joined, without the space that encoding put first."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


@lru_cache(2)
def load_model(path: str) -> MergeModel:
    return MergeModel(path)


class _Numbers(dict):
    """A number for each unit in order of arrival."""

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        return n


def encode_texts(model: MergeModel, texts: list, names: list, seed: int, rate: float) -> list[np.ndarray]:
    """Ids of each whole text; ``names`` key the hashes, so a text's segmentation depends on nothing else."""
    number, owner, which = _Numbers(), [], []
    for t in texts:
        units = _UNIT.findall(" " + t) if t else []
        owner.append(len(units))
        which += map(number.__getitem__, units)
    if not which:
        return [np.empty(0, np.int32)] * len(texts)
    units, which, owner = list(number), np.array(which), np.array(owner)
    key = np.array([zlib.crc32(str(n).encode()) for n in names], np.uint64)
    place = np.arange(len(which)) - np.repeat(np.cumsum(owner) - owner, owner)
    salts = _mix(_mix(np.repeat(key, owner) * _M1 + place.astype(np.uint64)) + np.uint64((seed & 0xFFFFFFFF) * int(_M2) & 2**64 - 1))
    short, bits = np.array([len(u) <= SHORT for u in units]), np.zeros(len(units), np.uint64)
    if rate > 0:
        bits[short] = model.possible([u for u, s in zip(units, short.tolist(), strict=True) if s])
    state = np.where(short[which], _skipped(salts, bits[which], rate), salts if rate > 0 else np.uint64(0))
    # equal (unit, state) once; hashes bring them together
    order = np.argsort((which.astype(np.uint64) * _M2 ^ state) * _M1, kind="stable")
    first = np.append(True, (which[order][1:] != which[order][:-1]) | (state[order][1:] != state[order][:-1]))
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(first) - 1
    one = order[first]
    ids, counts = model.with_bytes(*model.segment(units, state[one], rate, which[one]))
    starts = np.append(0, np.cumsum(counts))[:-1]
    size = counts[back]
    ends = np.cumsum(size)
    flat = ids[np.repeat(starts[back] - (ends - size), size) + np.arange(int(ends[-1]))]
    cuts = np.append(0, ends)[np.append(0, np.cumsum(owner))]
    return [flat[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]


def _skipped(salts: np.ndarray, bits: np.ndarray, rate: float) -> np.ndarray:
    """Of the possible merges of each occurrence (``bits``) those that its hash skips."""
    out = np.zeros(len(salts), np.uint64)
    if rate <= 0:
        return out
    for end in range(2, SHORT + 1):
        for start in range(end - 1):
            k = np.uint64(_bit(start, end))
            on = np.flatnonzero(bits >> k & np.uint64(1))
            if len(on):
                skip = on[~_happens(salts[on], np.array([start]), np.array([end]), rate)]
                out[skip] |= np.uint64(1) << k
    return out


def encode_documents(docs: DataFrame, path: str | None = None, seed: int = 1, rate: float = 0.1, digest: bool = False) -> DataFrame:
    """doc_id and ids of every row of ``docs`` (doc_id, text); with ``digest`` n_tokens, ids_crc32, decoded_crc32 and lossless instead.

    A null or empty text has no ids and decodes to an empty one.  A null doc_id is kept; repeated rows repeat.  An empty
    table gives no rows.  Other columns are ignored.  ``rate`` 0 gives the model's own segmentation.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches):
        model = load_model(path)
        for b in batches:
            names, texts = b["doc_id"].to_pylist(), b["text"].to_pylist()
            for s, e in by_bytes(texts, CHUNK):
                found = encode_texts(model, texts[s:e], names[s:e], seed, rate)
                ids = pa.array(names[s:e], pa.int64())
                if not digest:
                    yield pa.RecordBatch.from_arrays([ids, pa.array([f.tolist() for f in found], pa.list_(pa.int32()))], names=["doc_id", "ids"])
                    continue
                decoded = [model.decode(f.tolist()) for f in found]
                columns = [
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([zlib.crc32(f.astype("<u4").tobytes()) for f in found], pa.int64()),
                    pa.array([zlib.crc32(d.encode("utf-8", "surrogatepass")) for d in decoded], pa.int64()),
                    pa.array([d == (t or "") for d, t in zip(decoded, texts[s:e], strict=True)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "lossless"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, lossless boolean" if digest else "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of every row of ``encoded`` (doc_id, ids); null ids give a null text."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches):
        model = load_model(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([None if x is None else model.decode(x) for x in b["ids"].to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
