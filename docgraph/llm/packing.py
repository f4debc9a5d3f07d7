"""Packing by lexical retrieval: sequences are filled with documents that BM25 finds near.

Token ids are made once and written; document frequencies, number and mean length are counted over all documents.  Each
document's heaviest term (by its BM25 weight, of those that another document has too) deals it to its shard, whatever file it came from, so
documents of one matter meet.  A term that would fill more than a shard is split by the documents' hashes.

A shard has an inverted index over token ids, weighted by the corpus's counts; the window's seed document asks it for unused
neighbours, which fill the window in order of their scores.  Documents of other shards are not asked for.  The last one is
cut at the window's end, and what is left of it is the next seed.  A partition's last window is cut at powers of two, so nothing is
padded.  A task holds one shard at a time.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, releasing

WINDOW, SHARD_TOKENS = 1024, 1 << 21
PARTITION_SHARDS = 2  #: shards that a partition holds, about
DENSE = 8  #: a term of more than one of so many documents of a shard has a row of weights instead of a list
SPECIAL = "<|endoftext|>"
K1, B = 1.2, 0.75
NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class TokenIds:
    """Ids of the byte-level BPE vocabulary.  ``ranks`` (the same vocabulary) is faster; texts that spell a special token take ``model``."""

    def __init__(self, model: str, ranks: str):
        import tiktoken

        self.model, self.slow = model, None
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        """The ids of a whole text, then 0."""
        if not text:
            ids = []
        elif SPECIAL in text:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.model)
            ids = self.slow.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array([*ids, 0], np.uint32)


class Statistics:
    """What BM25 takes from a corpus: the documents that have each token id, their number and mean length."""

    def __init__(self, df: np.ndarray, n: int, tokens: int):
        self.df, self.n, self.mean = df, n, tokens / max(n, 1)


def corpus_statistics(counts: DataFrame) -> Statistics:
    """The sum of all tasks' ``counts`` (term, c); as many rows as the vocabulary has ids reach the driver.  Term -1 counts documents, -2 ids."""
    found = {r.term: r.c for r in counts.groupBy("term").agg(F.sum("c").alias("c")).collect()}
    n, tokens = found.pop(-1, 0), found.pop(-2, 0)
    df = np.zeros(max(found, default=0) + 1, np.int64)
    df[list(found)] = list(found.values())
    return Statistics(df, n, tokens)


class Index:
    """BM25 over the token ids of a shard's documents; by the ``corpus`` that they are of, or by themselves."""

    def __init__(self, docs: list[np.ndarray], corpus: Statistics | None = None):
        size = np.array([len(d) for d in docs])
        key = np.repeat(np.arange(len(docs)), size) << 32 | np.concatenate(docs).astype(np.int64)
        key.sort()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        tf = np.diff(np.append(first, len(key))).astype(np.float32)
        key = key[first]
        doc, term = key >> 32, key & 0xFFFFFFFF
        self.bounds = np.searchsorted(doc, np.arange(len(docs) + 1))
        self.terms, place = np.unique(term, return_inverse=True)
        self.own = place  # terms of each document, in the order of ``bounds``
        held = np.bincount(place, minlength=len(self.terms))
        df, n, mean = (corpus.df[self.terms], corpus.n, corpus.mean) if corpus else (held, len(docs), size.mean())
        idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
        norm = K1 * (1 - B + B * size / mean).astype(np.float32)
        weight = idf[place] * tf * (K1 + 1) / (tf + norm[doc])
        self.n = len(docs)
        frequent = held * DENSE > self.n
        self.row = np.where(frequent, np.cumsum(frequent) - 1, -1)
        self.rows = np.zeros((int(frequent.sum()), self.n), np.float32)
        on = frequent[place]
        self.rows[self.row[place[on]], doc[on]] = weight[on]
        order = np.flatnonzero(~on)
        order = order[np.argsort(place[order], kind="stable")]
        self.postings, self.weights = doc[order], weight[order]
        self.lists = np.append(0, np.cumsum(np.where(frequent, 0, held)))

    def neighbours(self, doc: int, used: np.ndarray, most: int) -> np.ndarray:
        """Unused documents that share a term, best first, ties by place; ``most`` at least where there are so many."""
        terms = self.own[self.bounds[doc] : self.bounds[doc + 1]]
        row = self.row[terms]
        dense, terms = self.rows[row[row >= 0]].sum(0), terms[row < 0]
        start, size = self.lists[terms], self.lists[terms + 1] - self.lists[terms]
        at = np.repeat(start - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        score = np.bincount(self.postings[at], weights=self.weights[at], minlength=self.n) + dense
        score[used] = 0
        found = np.flatnonzero(score)
        if len(found) > most:
            found = found[score[found] >= np.partition(score[found], -most)[-most]]
        return found[np.argsort(-score[found], kind="stable")]


class Packer:
    """Fills windows; the open one goes on from shard to shard."""

    def __init__(self, first_id: int):
        self.sequence, self.filled, self.rows, self.open = first_id, 0, [], []

    def _row(self, doc, ids: np.ndarray, start: int, take: int, offset: int) -> None:
        self.rows.append((doc, start, take, zlib.crc32(ids[start : start + take].astype("<u4").tobytes()), len(ids), self.sequence, offset))

    def put(self, doc, ids: np.ndarray, start: int, count: int) -> int:
        """Place up to ``count`` ids from ``start`` in the open window; returns how many found room."""
        take = min(count, WINDOW - self.filled)
        self.open.append((doc, ids, start, take))
        self.filled += take
        if self.filled == WINDOW:
            offset = 0
            for doc, ids, start, n in self.open:
                self._row(doc, ids, start, n, offset)
                offset += n
            self.sequence, self.filled, self.open = self.sequence + 1, 0, []
        return take

    def finish(self) -> None:
        """The open window as sequences whose lengths are powers of two."""
        left = self.filled
        pieces, self.open, self.filled = self.open[::-1], [], 0
        while left:
            size, offset = 1 << (left.bit_length() - 1), 0
            while offset < size:
                doc, ids, start, n = pieces.pop()
                take = min(n, size - offset)
                self._row(doc, ids, start, take, offset)
                offset += take
                if take < n:
                    pieces.append((doc, ids, start + take, n - take))
            self.sequence, left = self.sequence + 1, left - size


def pack_shard(packer: Packer, names: list, docs: list[np.ndarray], corpus: Statistics | None = None) -> None:
    """Place every id of every document: seeds in order, each followed by its unused neighbours."""
    index = Index(docs, corpus)
    used = np.zeros(len(docs), bool)
    done = [len(d) // WINDOW * WINDOW for d in docs]
    for i, d in enumerate(docs):
        used[i] = done[i] == len(d)
    seed, free, queue = None, 0, []
    while True:
        if not queue:
            while free < len(docs) and used[free]:
                free += 1
            if free == len(docs):
                return
            found = index.neighbours(seed, used, 16) if seed is not None else []
            queue = [int(i) for i in found] or [free]
        i = queue.pop(0)
        if used[i]:
            continue
        used[i] = True
        if packer.filled == 0:
            seed, queue = i, [int(j) for j in index.neighbours(i, used, 16)]
        while done[i] < len(docs[i]):
            room = WINDOW - packer.filled
            took = packer.put(names[i], docs[i], done[i], len(docs[i]) - done[i])
            done[i] += took
            if took == room and done[i] < len(docs[i]):  # what is left seeds the next window
                seed, queue = i, [int(j) for j in index.neighbours(i, used, 16)]
        if packer.filled == 0:
            queue = []


def heaviest_term(ids: np.ndarray, corpus: Statistics) -> int:
    """The term with the largest BM25 weight in a document, of those that another has too, the smaller of equals; -1 without one."""
    terms, tf = np.unique(ids, return_counts=True)
    df = corpus.df[terms]
    weight = np.log1p((corpus.n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / corpus.mean))
    weight[df < 2] = -1
    at = int(weight.argmax())
    return int(terms[at]) if weight[at] >= 0 else -1


_MIX = 0x9E3779B97F4A7C15


def _place(term: int, raw: bytes, parts: int) -> int:
    """Where a document goes: by its term, and if that is split by a hash of its ids."""
    h = (term + 2) * _MIX + (zlib.crc32(raw) % parts if parts > 1 else 0) * 0xBF58476D1CE4E5B9
    return (h & (1 << 64) - 1) >> 33


def pack_documents(docs: DataFrame, model: str | None = None, ranks: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """NAMES of every piece of every row of ``docs`` (doc_id, text): sequences of at most WINDOW ids.

    A null text counts as empty and still has its end id.  A null doc_id is kept and repeated rows each get pieces.
    An empty table gives no rows.  Other columns are ignored.  ``model`` and ``ranks`` are paths of the vocabulary.
    """
    model = model or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    schema = pa.schema([(n, pa.int64()) for n in NAMES])

    def drain(packer: Packer) -> pa.RecordBatch:
        columns = list(zip(*packer.rows, strict=True)) or [()] * len(NAMES)
        packer.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    written = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("term", pa.int64()), ("c", pa.int64())])

    def encoded(batches) -> Iterator[pa.RecordBatch]:
        """The ids of each document, then the task's counts."""
        encode = TokenIds(model, ranks)
        df, n, tokens = np.zeros(1 << 16, np.int64), 0, 0
        for b in batches:
            out = []
            for text in b["text"]:
                ids = encode(text.as_py())
                if (top := int(ids.max())) >= len(df):
                    df = np.append(df, np.zeros(top + 1, np.int64))
                df[ids] += 1  # once for an id, however often it is there
                tokens += len(ids)
                out.append(_stored(ids))
            n += len(out)
            none = pa.nulls(len(out), pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(out, pa.binary()), none, none], schema=written)
        terms = np.flatnonzero(df)
        columns = [pa.nulls(len(terms) + 2, pa.int64()), pa.nulls(len(terms) + 2, pa.binary()), pa.array(np.append(terms, (-1, -2))), pa.array(np.append(df[terms], (n, tokens)))]
        yield pa.RecordBatch.from_arrays(columns, schema=written)

    def dealt(batches) -> Iterator[pa.RecordBatch]:
        stats = corpus.value
        for b in batches:
            raws = b["ids"].to_pylist()
            places = []
            for raw in raws:
                term = heaviest_term(_loaded(raw), stats)
                most = stats.df[term] if term >= 0 else stats.n  # no more documents than these go by this term
                places.append(_place(term, raw, int(most * stats.mean // shard_tokens) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), b["doc_id"], b["ids"]], names=["place", "doc_id", "ids"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        packer, whole = Packer(base), Packer(base | 1 << 39)
        names, held, tokens = [], [], 0
        for b in batches:
            for doc, raw in zip(b["doc_id"].to_pylist(), b["ids"], strict=True):
                ids = _loaded(raw.as_py())
                for start in range(0, len(ids) // WINDOW * WINDOW, WINDOW):
                    whole.put(doc, ids, start, WINDOW)
                names.append(doc)
                held.append(ids)
                tokens += len(ids)
                if tokens >= shard_tokens:
                    pack_shard(packer, names, held, corpus.value)
                    yield drain(packer)
                    yield drain(whole)
                    names, held, tokens = [], [], 0
        if held:
            pack_shard(packer, names, held, corpus.value)
        packer.finish()
        yield drain(packer)
        yield drain(whole)

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(encoded), "doc_id long, ids binary, term long, c long")
    ids = materialize(ids, "ids")
    stats = corpus_statistics(ids.filter("term is not null").select("term", "c"))
    corpus = docs.sparkSession.sparkContext.broadcast(stats)
    parts = max(1, int(stats.n * stats.mean) // (PARTITION_SHARDS * shard_tokens))
    placed = ids.filter("term is null").select("doc_id", "ids").mapInArrow(dealt, "place long, doc_id long, ids binary")
    met = placed.repartition(parts, "place").sortWithinPartitions("place", "doc_id").select("doc_id", "ids")
    return met.mapInArrow(releasing(run), ", ".join(f"{n} long" for n in NAMES))


def _stored(ids: np.ndarray) -> bytes:
    """Ids as they are written: two bytes each where all fit, else four; the last byte tells."""
    small = int(ids.max()) < 1 << 16
    return ids.astype("<u2" if small else "<u4").tobytes() + (b"\2" if small else b"\4")


def _loaded(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if raw[-1] == 2 else "<u4", (len(raw) - 1) // raw[-1]).astype(np.uint32)
