"""Quality rules by line labelling: a linear-chain conditional random field marks lines content or boilerplate.

Each line of a text gets features; Viterbi decoding finds the best sequence of the two labels over the whole
text, and the share of content decides whether the document stays.  The weights are fitted here, by maximum
likelihood, on a bounded sample of labelled documents whose lines take the document's label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

SYMBOLS, UPPER, DIGITS, STOPS = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:?"
FEATURES = ("bias", "symbols", "capitals", "digits", "bangs", "stops", "ends", "short", "long", "repeated", "same_words", "mean_word")
SAMPLE_DOCS, SAMPLE_LINES, CONTENT_SHARE, LEAST_WORDS = 3000, 256, 0.5, 50
_SPACES = b" \t\n\x0b\x0c\r"


def line_features(line: bytes, words: list[bytes], repeated: bool) -> tuple[float, ...]:
    n, w = len(line), len(words)

    def count(chars: bytes) -> int:
        return n - len(line.translate(None, chars))

    inked = max(1, sum(map(len, words)))
    return (
        1.0, min(1.0, 2 * count(SYMBOLS) / w), count(UPPER) / inked, count(DIGITS) / inked, min(1.0, 2 * line.count(b"!") / w), min(1.0, 2 * count(STOPS) / w),
        float(line.rstrip(_SPACES)[-1:] in (b".", b"?", b"!")), float(w < 4), float(w >= 20), float(repeated), 1 - len(set(words)) / w, min(2.0, inked / w / 8),
    )


def text_lines(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Features and bytes of the lines that have a word, and how many of them equal an earlier one."""
    seen: set[bytes] = set()
    rows, size, again = [], [], 0
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        if words := line.split():
            repeated = line in seen
            seen.add(line)
            again += repeated
            rows.append(line_features(line, words, repeated))
            size.append(len(line))
    return np.array(rows, float).reshape(-1, len(FEATURES)), np.array(size, float), again


@dataclass
class Crf:
    """Scores of content (1) against boilerplate (0): a weight for each feature, and of each step from label to label."""

    emit: np.ndarray
    step: np.ndarray

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best labels (Viterbi); ties go to content."""
        gain = (x @ self.emit).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        zero, one, back = 0.0, 0.0, []
        for i, e in enumerate(gain):
            if i:
                from0, from1 = (zero + s00, zero + s01), (one + s10, one + s11)
                back.append((from1[0] >= from0[0], from1[1] >= from0[1]))
                zero, one = max(from0[0], from1[0]), max(from0[1], from1[1])
            one += e
        label = one >= zero
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return np.array(out[::-1][: len(gain)], bool)


#: What holds until labels teach otherwise: every line is content.
UNTRAINED = Crf(np.array([1.0] + [0.0] * (len(FEATURES) - 1)), np.zeros((2, 2)))


def fit_crf(texts: list[tuple[np.ndarray, np.ndarray]], steps: int = 150, rate: float = 0.3, ridge: float = 0.01) -> Crf:
    """Maximum likelihood by forward and backward sums over (features, labels) of each text; sequences are cut at 64 lines."""
    pieces = [(x[i : i + 64], y[i : i + 64]) for x, y in texts for i in range(0, len(x), 64)]
    if not pieces or not 0 < sum(y.sum() for _, y in pieces) < sum(len(y) for _, y in pieces):
        return UNTRAINED
    n, m = len(pieces), max(len(x) for x, _ in pieces)
    x, y, on = np.zeros((n, m, len(FEATURES))), np.zeros((n, m), int), np.zeros((n, m), bool)
    for i, (a, b) in enumerate(pieces):
        x[i, : len(a)], y[i, : len(a)], on[i, : len(a)] = a, b, True
    pair = on[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][pair], y[:, 1:][pair]), 1)
    total = on.sum()
    w, t = np.zeros(len(FEATURES)), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    for k in range(1, steps + 1):
        e = np.stack([np.zeros((n, m)), x @ w], 2)
        a, b = np.zeros((n, m, 2)), np.zeros((n, m, 2))
        a[:, 0] = e[:, 0]
        for i in range(1, m):
            a[:, i] = np.where(on[:, i, None], e[:, i] + np.logaddexp(a[:, i - 1, :1] + t[0], a[:, i - 1, 1:] + t[1]), a[:, i - 1])
        for i in range(m - 2, -1, -1):
            r = e[:, i + 1] + b[:, i + 1]
            b[:, i] = np.where(on[:, i + 1, None], np.logaddexp(t[:, 0] + r[:, :1], t[:, 1] + r[:, 1:]), 0)
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        p1 = np.exp(a[:, :, 1] + b[:, :, 1] - z[:, None]) * on
        both = np.exp(a[:, :-1, :, None] + t + (e + b)[:, 1:, None, :] - z[:, None, None, None]) * pair[:, :, None, None]
        grads = [np.einsum("nm,nmf->f", y * on - p1, x) / total - ridge * w, (seen - both.sum((0, 1))) / total - ridge * t]
        for j, (g, v) in enumerate(zip(grads, (w, t), strict=True)):
            moments[2 * j] = 0.9 * moments[2 * j] + 0.1 * g
            moments[2 * j + 1] = 0.99 * moments[2 * j + 1] + 0.01 * g * g
            v += rate * (moments[2 * j] / (1 - 0.9**k)) / (np.sqrt(moments[2 * j + 1] / (1 - 0.99**k)) + 1e-8)
    return Crf(w, t)


def train_crf(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Crf:
    """Fit on at most ``sample_docs`` labelled documents that aren't held out, those with the smallest hashed doc_id, and of each on its first ``sample_lines`` lines.

    The lines of a document of quality 1 are content, but for those that equal an earlier line; other lines are
    boilerplate.  Rows with a null doc_id, text or quality teach nothing.
    """
    chosen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)

    def lines(batches):
        for b in batches:
            for doc, quality, text in zip(b["doc_id"].to_pylist(), b["quality"].to_pylist(), b["text"].to_pylist(), strict=True):
                x = text_lines(text)[0][:sample_lines]
                y = (x[:, FEATURES.index("repeated")] == 0) & (quality >= 1)
                yield pa.RecordBatch.from_pylist([{"doc_id": doc, "x": x.tobytes(), "y": y.astype(np.int8).tobytes()}], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.binary()), ("y", pa.binary())])
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    rows = sorted(sample.mapInArrow(lines, "doc_id long, x binary, y binary").collect())  # 100 bytes for each of sample_docs x sample_lines lines at most
    return fit_crf([(np.frombuffer(r.x, float).reshape(-1, len(FEATURES)), np.frombuffer(r.y, np.int8)) for r in rows])


def repeated_words(words: list[bytes]) -> int:
    """Words within 3-word windows that the text has twice or more, the first included."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    n = len(ids)
    if n < 2_000_000:
        key = (a[:-2] * n + a[1:-1]) * n + a[2:]
    else:
        key = np.unique(np.stack([a[:-2], a[1:-1], a[2:]], 1), axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = order[np.append(same, False) | np.insert(same, 0, False)]
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[twice + k] = True
    return int(covered.sum())


def judge(text: str | None, crf: Crf) -> tuple[int, int, int, int, int, bool, bool, float]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the content share of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    inked = raw.translate(None, _SPACES)
    chars = len(inked.translate(None, bytes(range(128, 192))))  # without continuation bytes
    symbols, repeats = len(raw) - len(raw.translate(None, SYMBOLS)), repeated_words(words)
    x, size, again = text_lines(text)
    failed = n < LEAST_WORDS or 100 * repeats > 50 * n
    share = float(size[crf.decode(x)].sum() / size.sum()) if len(x) else 0.0
    return n, chars, symbols, again, repeats, failed, not failed and share >= CONTENT_SHARE, share


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def label_documents(docs: DataFrame, crf: Crf, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, NAMES and the columns ``keep`` for every row of ``docs`` (doc_id, text).

    A null text has no words, so that it fails.  Repeated rows repeat and a null doc_id is kept.  A line whose labels tie is
    content; a share of just CONTENT_SHARE is kept.  An empty table gives no rows.  Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(crf)
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]

    def run(batches):
        for b in batches:
            found = [judge(t.as_py(), model.value) for t in b["text"]]
            columns = list(zip(*found, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b[c] for c in ("doc_id", *keep)] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", *keep, *NAMES])

    rows = docs.select("doc_id", *[c for c in keep if c != "text"], "text")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep))
    return rows.mapInArrow(run, schema + ", n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double")


