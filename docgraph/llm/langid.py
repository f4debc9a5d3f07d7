"""Language identification by rank-order n-gram profiles and out-of-place distance.

A profile lists the most frequent n-grams (n from 1 to 5, within words that are padded by a blank) in order of
frequency.  A document's own list is compared with each language's: an n-gram costs the difference of its
two ranks, or the length of the profile where the language lacks it.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out

#: n-grams in a profile, longest n-gram, and documents of each language that profiles are made of.
PROFILE, LONGEST, SAMPLE = 300, 5, 500
_ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _codes() -> np.ndarray:
    """Code point to letter code: the code point of a letter, 0 for what is none."""
    points = np.arange(sys.maxunicode + 1)
    letter = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return np.where(letter, points, 0).astype(np.uint32)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text, as ascending keys (64-bit hashes), and their counts; empty without letters."""
    c = _codes()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
    c = np.concatenate(([np.uint64(0)], c, [np.uint64(0)]))
    c = c[(c > 0) | np.concatenate(([True], c[:-1] > 0))]  # one blank between words
    if not c.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    letter, inner = c > 0, np.ones(len(c), bool)
    key = (c + np.uint64(1)) * _ODD
    parts = [key[letter]]
    for n in range(2, LONGEST + 1):
        key = (key[:-1] ^ (key[:-1] >> np.uint64(29))) * _ODD + c[n - 1 :] + np.uint64(n)
        inner = inner[:-1] & letter[n - 2 : -1] if n > 2 else inner[:-1]
        parts.append(key[inner])
    key = np.concatenate(parts)
    key ^= key >> np.uint64(32)
    key = key.view(np.int64)
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.diff(np.append(first, len(key)))


def ranked(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent keys in order of frequency, ties by key."""
    if len(keys) > size:
        keep = counts >= np.partition(counts, -size)[-size]
        keys, counts = keys[keep], counts[keep]
    return keys[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """All languages' ranks in one table: row of an n-gram, column of a language."""

    def __init__(self, by_lang: dict[str, list[int]]):
        self.langs = sorted(by_lang)
        self.keys = np.unique(np.array([k for x in by_lang.values() for k in x], np.int64))
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), PROFILE, np.int64)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.keys, np.array(by_lang[lang], np.int64)), j] = np.arange(len(by_lang[lang]))
        self.misses = np.full(len(self.langs), PROFILE)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score; ``und`` and 0 for no letters, or if nothing was learned."""
        keys, counts = ngram_counts(text) if text else (np.empty(0), np.empty(0))
        if not len(keys) or not self.langs:
            return "und", 0.0
        top = ranked(keys, counts)
        at = np.searchsorted(self.keys, top)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != top)] = len(self.keys)
        ranks = self.ranks[at]
        cost = np.where(ranks == PROFILE, PROFILE, np.abs(ranks - np.arange(len(top))[:, None])).sum(0)
        best = int(cost.argmin())
        return self.langs[best], float(1 - cost[best] / (PROFILE * len(top)))


def train_profiles(docs: DataFrame, per_language: int = SAMPLE) -> Profiles:
    """Profiles from at most ``per_language`` documents of each non-null language, none of them held out.

    The sample is the rows whose hashed doc_id is smallest.  Only the profiles reach the driver.
    """
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.select("doc_id", "lang").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_language)
    sample = rows.join(F.broadcast(chosen.select("doc_id", "lang").distinct()), ["doc_id", "lang"])  # per_language ids of a language

    def count(batches):
        for b in batches:
            by_lang: dict[str, list] = {}
            for text, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(ngram_counts(text))
            for lang, found in by_lang.items():
                keys, where = np.unique(np.concatenate([k for k, _ in found]).astype(np.int64), return_inverse=True)
                n = np.bincount(where, weights=np.concatenate([c for _, c in found]), minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("place", place).filter(F.col("place") <= PROFILE)
    by_lang: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "place").collect():
        by_lang.setdefault(r.lang, []).append(r.gram)
    return Profiles(by_lang)


def identify_language(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text).

    A null text, or one without a letter, is ``und`` with score 0.  Ties go to the first language by name.  A null
    doc_id is kept and is not held out.  Repeated rows repeat.  An empty table gives no rows.  Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        for b in batches:
            found = [model.value.predict(t.as_py()) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
