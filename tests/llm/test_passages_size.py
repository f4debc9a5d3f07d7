"""What op1_suffix_dedup sends and sorts: no more than it must, as it is this that grows with the corpus."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docgraph.llm import passages


def _batches(texts, rows):
    ids = list(range(len(texts)))
    for s in range(0, len(texts), rows):
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[s : s + rows], pa.int64()), "tkey": pa.array(ids[s : s + rows], pa.int64()), "text": pa.array(texts[s : s + rows], pa.string())})


def test_hashes_of_small_batches_are_sent_together():
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefgh ", k=400)) for _ in range(100)]
    sent = list(passages._emit_hashes(50, 8)(_batches(texts, 2)))
    assert len(sent) <= 8  # one row a bucket, not one a bucket and batch
    docs = {d for b in sent for r in b.to_pylist() for d in passages._restored(r["docs"], "<i8", True).tolist()}
    assert docs == set(range(100))


def test_short_stretches_that_repeat_are_not_flagged():
    """Phrases of 18 bytes in every document, and no passage of 50."""
    rng = random.Random(6)
    phrases = ["".join(rng.choices("abcdefgh", k=18)) for _ in range(20)]
    texts = [" ".join(rng.choice(phrases) + "".join(rng.choices("abcdefgh", k=12)) for _ in range(20)) for _ in range(100)]
    rows = pa.Table.from_batches(passages._emit_hashes(50, 1)(_batches(texts, 100)))
    assert passages._repeated(rows.filter(pc.equal(rows["bucket"], 0)), 4).num_rows == 0
    assert not any(r for r in rows["known"].to_pylist())


def test_items_come_back_from_many_parts():
    rng = np.random.default_rng(7)
    ids, keys = rng.integers(-500, 500, 5000), rng.integers(0, 2, 5000)
    items = np.arange(5000).astype("<u4")
    rows = passages._packed(ids, keys, items, 300)
    assert len(set(rows["part"].to_pylist())) == rows.num_rows <= 300
    back = {(r["doc_id"], r["tkey"]): np.frombuffer(r["items"], "<u4").tolist() for r in passages._unpacked(np.dtype("<u4"))(rows).to_pylist()}
    assert back == {(d, k): items[(ids == d) & (keys == k)].tolist() for d, k in set(zip(ids.tolist(), keys.tolist(), strict=True))}
    assert passages._packed(ids[:0], keys[:0], items[:0], 300).num_rows == 0


def test_copies_are_not_hashed(spark, tmp_path, monkeypatch):
    real, path = passages._emit_hashes, str(tmp_path / "seen")

    def spied(length, buckets):
        work = real(length, buckets)

        def noted(batches):
            for b in batches:
                with open(path, "a") as f:
                    f.writelines(f"{d}\n" for d in b["doc_id"].to_pylist())
                yield b

        return lambda batches: work(noted(batches))

    monkeypatch.setattr(passages, "_emit_hashes", spied)
    text, other = "".join(random.Random(8).choices("abcdefgh", k=200)), "".join(random.Random(9).choices("abcdefgh", k=100))
    docs = [(k, text) for k in range(30)] + [(30, other + text[20:120]), (31, None), (None, text)]
    rows = {r.doc_id: r for r in passages.passage_digests(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    seen = open(path).read().split()
    assert set(seen) & {str(k) for k in range(1, 30)} == set() and {"0", "30"} <= set(seen)
    assert [rows[k].n_removed for k in (0, 1, 29, 30, 31, None)] == [0, 200, 200, 100, 0, 0]
