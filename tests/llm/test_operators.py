"""The operators against brute force, exact round trips and held-out accuracy, on small tables with awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgraph.llm import boilerplate, chat, dropout_bpe, langid, near_copies, neighbours, packing, passages, rules, sharding, suffixes
from docgraph.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int"
random.seed(3)
WORDS = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "eta", "theta", "iota", "kappa", "the", "of", "and"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ".", "s"]) for _ in range(n))


PASSAGE = prose(60, 99)


def rows():
    out = [(i, prose(30 + i % 40, i), "en", "s", 1, 0.0, 1) for i in range(40)]
    base = prose(120, 7)
    out += [(100 + i, base, "en", "s", 1, 0.0, 1) for i in range(5)]  # exact copies
    for i in range(12):  # near copies of different size of change
        w = base.split()
        for k in range(i // 2):
            w[(17 * k + i) % len(w)] = f"new{i}x{k}"
        out.append((200 + i, " ".join(w), "en", "s", 1, 0.0, 1))
    out += [(300 + i, prose(20, 500 + i) + "\n" + PASSAGE + "\n" + prose(15, 600 + i), "de", "s", 1, 0.0, 1) for i in range(6)]
    out += [(400, None, None, None, None, None, None), (401, "", "en", "s", 0, 0.0, 1), (402, "one", "en", "s", 3, 0.0, 1), (403, "two words", "en", "s", 9, 0.0, 1), (404, " \n\t ", "en", "s", 4, 0.0, 1)]
    out += [(405, "日本語のテキスト" * 200, "ja", "s", 1, 0.0, 1), (406, "x" * 5000, "en", "s", 1, 0.0, 1), (407, "a b ▁ c<|endoftext|>", "en", "s", 1, 0.0, 1)]
    out += [out[0], out[0]]  # repeated rows
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# suffix sorting and passages


@pytest.mark.parametrize("trial", range(120))
def test_suffix_array(trial, monkeypatch):
    """Any bytes, with and without an end mark, in memory and, with budgets of a few bytes, with all levels of the recursion in files."""
    draw = np.random.default_rng(trial)
    for name, values in (("BLOCK", (7, 37, 1 << 20)), ("LANE_NAMES", (2, 5, 40, 8192)), ("NAME_BYTES", (48, 10**9))):
        monkeypatch.setattr(suffixes, name, int(draw.choice(values)))
    t = draw.integers(0, int(draw.choice([1, 2, 3, 4, 20, 256])), int(draw.integers(1, 300))).astype(np.uint8)
    if trial % 3 == 0:
        t = np.tile(t[: max(1, len(t) // 7)], 7)
    if trial % 5 == 0:
        t = np.repeat(t, int(draw.integers(1, 6)))[:400]
    depth, raw = int(draw.integers(1, 60)), bytes(t)
    found = list(suffixes.suffix_array(t, depth, budget=int(draw.choice([50, 300, 10**8]))))
    sa, lcp = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    assert sorted(sa.tolist()) == list(range(len(t)))
    heads = [raw[i : i + depth] for i in sa]
    assert heads == sorted(heads)
    for a, b, n in zip(heads, heads[1:], lcp[1:].tolist(), strict=False):
        assert n == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_suffix_array_far_beyond_memory(monkeypatch):
    """A text of ten times the budget: queues, types, names and orders are in files, and the peak stays about the text's own size."""
    import tracemalloc

    draw = np.random.default_rng(0)
    monkeypatch.setattr(suffixes, "BLOCK", 1 << 14)
    words = [bytes(draw.integers(97, 123, int(draw.integers(2, 9))).astype(np.uint8)) for _ in range(400)]
    t = np.frombuffer(b" ".join(words[int(i)] for i in draw.zipf(1.3, 400_000) % 400)[:2_000_000], np.uint8)
    raw, last, n = bytes(t), b"", 0
    tracemalloc.start()
    for at, _ in suffixes.suffix_array(t, 50, len(t) // 10):
        for i in at[::97].tolist():  # in order, here and there
            assert last <= raw[i : i + 50]
            last = raw[i : i + 50]
        n += len(at)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(t) and peak < 5_000_000  # the five or six arrays of eight bytes a byte would be 90 million


@pytest.mark.parametrize("trial", range(40))
def test_shard_of_stretches(trial, monkeypatch):
    """Repeated windows of a shard, however little of it is in memory."""
    r, length = random.Random(trial), 12
    for module in (suffixes, passages):
        monkeypatch.setattr(module, "BLOCK", [64, 4096][trial % 2])
    base = "".join(r.choice("abcd") for _ in range(60))
    raws = []
    for _ in range(6):
        t = list(base)
        for _ in range(r.randint(0, 3)):
            t[r.randrange(60)] = r.choice("abcdxyz")
        raws.append("".join(t).encode())
    shard, rows = passages._Shard(r.choice([50, 2000, 1 << 20])), list(enumerate(raws))
    r.shuffle(rows)
    for part in (rows[:3], rows[3:]):
        held = passages._Held(length)
        for doc, raw in part:
            place, _, spans = passages.anchors(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), length)
            flags = np.empty(len(place), passages._FLAG)
            flags["place"], flags["spans"] = place, spans
            held.add(doc, 7, raw, flags.tobytes())
        doc, key, at, _, group, *texts = held.groups()
        for b in passages._stretch_rows(doc, key, at, group, *texts, 1):
            shard.add({c: b[c][0].as_py() for c in b.schema.names})
    got = {(d, a + w) for ids, _, at, bits in shard.marks(length) for d, a, b in zip(ids.tolist(), at.tolist(), bits.tolist(), strict=True) for w in range(64) if b >> w & 1}
    first: dict[bytes, int] = {}
    for d, raw in enumerate(raws):
        for k in range(len(raw) - length + 1):
            first.setdefault(raw[k : k + length], d)
    assert got == {(d, k) for d, raw in enumerate(raws) for k in range(len(raw) - length + 1) if first[raw[k : k + length]] < d}


def brute_passages(table, length):
    first, out = {}, {}
    for i, t in table:
        if i is None:
            continue
        raw = (t or "").encode()
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            first[s] = min(first.get(s, i), i)
    for i, t in table:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if i is not None and first[raw[k : k + length]] < i:
                gone[k : k + length] = True
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out.setdefault(i, []).append((len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("length", [50, 100])
def test_passages(spark, docs, length):
    got = {}
    for r in passages.passage_digests(docs, length).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {k: sorted(v) for k, v in got.items()} == brute_passages([(r.doc_id, r.text) for r in docs.collect()], length)


def test_passages_in_small_pieces(spark, docs, monkeypatch):
    """Many batches, buckets and shards."""
    ids = [r[0] for r in rows()]
    raws = [(r[1] or "").encode() for r in rows()]
    data, starts = np.frombuffer(b"".join(raws), np.uint8), np.append(0, np.cumsum([len(r) for r in raws]))
    whole = passages.anchors(data, starts, 50)
    monkeypatch.setattr(passages, "PIECE", 301)
    for a, b in zip(whole, passages.anchors(data, starts, 50), strict=True):
        assert (a == b).all()
    assert len(ids) == len(raws)


def test_removed_text_is_whole_characters(spark, docs):
    out = {r.doc_id: r for r in passages.remove_passages(docs, 50, keep=("lang",)).collect()}
    assert out[300].text.count(PASSAGE) == 1 and all(PASSAGE not in out[300 + i].text for i in range(1, 6))
    assert out[400].text is None and out[101].text == "" and out[0].lang == "en"


def test_passages_empty(empty):
    assert passages.passage_digests(empty).count() == 0


# language


def test_language_held_out(spark):
    words = {"aa": ["bar", "bor", "bir"], "bb": ["kek", "kuk", "kyk"]}
    table = [(i, " ".join(random.choice(words[lang]) for _ in range(30)), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    df = spark.createDataFrame(table + [(900, None, "aa"), (901, "123 !?", "bb"), (None, "bar bor", None)], "doc_id long, text string, lang string")
    out = langid.identify_language(df, langid.train_profiles(df)).collect()
    truth = {i: lang for i, _, lang in table}
    assert all(r.lang_pred == truth[r.doc_id] for r in out if r.held_out and r.doc_id in truth)
    assert {r.lang_pred for r in out if r.doc_id in (900, 901)} == {"und"} and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)


def test_ngrams_by_brute_force():
    text, want = "Ab, cab AB", {}
    for word in ("_ab_", "_cab_", "_ab_"):
        for n in range(1, 6):
            for k in range(len(word) - n + 1):
                g = word[k : k + n]
                if g != "_" and "_" not in g[1:-1]:
                    want[g] = want.get(g, 0) + 1
    keys, counts = langid.ngram_counts(text)
    assert sorted(counts.tolist()) == sorted(want.values()) and len(keys) == len(want)


def test_language_empty(empty):
    assert langid.identify_language(empty, langid.train_profiles(empty)).count() == 0


# shards


def brute_capacity(sizes, shards):
    low = max(max(sizes), -(-sum(sizes) // shards))
    while True:
        used, room = 1, low
        for s in sizes:
            if s > room:
                used, room = used + 1, low
            room -= s
        if used <= shards:
            return low
        low += 1


@pytest.mark.parametrize("seed", range(25))
def test_cuts_are_minimax(seed):
    r = random.Random(seed)
    sizes = sorted((r.choice([1, 5, 5, 9, 40]) for _ in range(r.randint(1, 60))), reverse=True)
    k = r.randint(1, 8)
    own = sorted(set(sizes))
    cuts = [0, *sharding.cut_positions(sharding.Runs(own, [sizes.count(s) for s in own]), k), len(sizes)]
    assert cuts == sorted(cuts) and len(cuts) == k + 1
    assert max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)) == brute_capacity(sizes, k)


def test_shards(spark, docs):
    out = sharding.shard_documents(docs, 7, 3).collect()
    assert len(out) == docs.count()
    texts = {r.doc_id: (r.text or "") for r in docs.collect()}
    place, slots = {}, {}
    for r in out:
        assert r["size"] == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.grown_shard is None and r.law == "bytes"
        assert place.setdefault(texts[r.doc_id], r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_empty(empty):
    assert sharding.shard_documents(empty).count() == 0


# SentencePiece


def test_merges_equal_the_library(docs):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, sp = dropout_bpe.load_model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [r[1] or "" for r in rows()] + ["  two  blanks \n", "\u0000 x", "q" * 100 + " y"]
    for t, ids in zip(texts, dropout_bpe.encode_texts(model, texts, list(range(len(texts))), 1, 0.0), strict=True):
        assert dropout_bpe.SPACE in t or ids.tolist() == sp.encode(t)
        assert model.decode(ids.tolist()) == t


def test_dropout(spark, docs, empty):
    import public_tokenizers

    model = dropout_bpe.load_model(public_tokenizers.path("piece_bpe_32k.model"))
    units = [" " + w * k for w in WORDS for k in (1, 2, 3)]
    salts = np.arange(len(units)).astype(np.uint64) * np.uint64(977)
    salts = np.array([int(x) * 7919 & int(model.possible([u])[0]) if len(u) <= dropout_bpe.SHORT else int(x) for u, x in zip(units, salts, strict=True)], np.uint64)
    ids, counts = model.segment(units, salts, 0.4)
    cuts = np.append(0, np.cumsum(counts))
    for k, u in enumerate(units):  # the agenda of arrays is the agenda of a heap
        assert model.segment_one(model.char_ids[[ord(c) for c in u]], salts[k], 0.4).tolist() == ids[cuts[k] : cuts[k + 1]].tolist()
    one, two = (dropout_bpe.encode_documents(docs, seed=s, rate=0.2) for s in (1, 2))
    again = dropout_bpe.encode_documents(docs, seed=1, rate=0.2)
    a, b, c = ({r.doc_id: r.ids for r in x.collect()} for x in (one, two, again))
    assert a == c and a != b
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r.doc_id: r.text for r in dropout_bpe.decode_documents(one).collect()} == texts
    assert dropout_bpe.encode_documents(docs, digest=True).filter("not lossless").count() == 0
    assert dropout_bpe.encode_documents(empty).count() == 0


# chat


def test_template_language():
    run = lambda t, **v: "".join(x for x, _ in chat.compile_template(t)(v))
    assert run("{% for x in xs %}{{ x.a | upper }}{% if x.b == 1 %}!{% elif not x.b %}?{% else %}{{ x['b'] ~ '.' }}{% endif %}{% endfor %}", xs=[{"a": "p", "b": 1}, {"a": "q"}, {"a": "r", "b": 7}]) == "P!Q?R7."
    assert chat.fold(chat.parse("a{% if 1 == 1 %}b{{ 'c' ~ 2 }}{% else %}{{ x }}{% endif %}d")) == [("text", "abc2d")]
    for bad in ("{% if x %}", "{{ x.__class__() }}", "{{ x | open }}", "{% endfor %}", "{{ 'a }}", "{% import os %}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)
    assert run("{{ x.__class__ }}", x=[1]) == ""


@pytest.mark.parametrize("text", ["", "<|im_end|>", r"<\|im_end|><\\|", "<", "<\\", "a<|b\\<|", "<|im_start|>assistant\nhi"])
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_line(chat.escape_line(text + "\n%0A")) == text + "\n%0A"


def test_conversations(spark):
    turns = [(1, 0, "user", "hi <|im_end|>\n"), (1, 1, "assistant", "<\\|x"), (1, 2, None, None), (2, 0, "assistant", None), (2, 0, "assistant", "b"), (None, 0, "us\ner%", "z"), (3, 5, "assistant", "é☃")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit(1))
    out = {r.conv_id: r for r in chat.conversation_digests(df).collect()}
    shown = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    for cid in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == cid), key=lambda t: (t[1], t[2] or "", t[3] or ""))
        said = "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert out[cid].n_turns == len(own)
        assert out[cid].turns_sha256 == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own).encode()).hexdigest()
        assert (out[cid].loss_chars, out[cid].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert out[cid].formatted_chars == len(shown[cid].formatted)
        assert "".join(chat.unescape(shown[cid].formatted[s.start : s.end]) for s in shown[cid].loss) == said
    assert chat.conversation_digests(df.limit(0)).count() == 0


# quality rules


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again, covered = set(), 0, set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    for k, g in enumerate(grams):
        if grams.count(g) > 1:
            covered |= {k, k + 1, k + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def test_base_rules(spark, docs, empty):
    out = boilerplate.label_documents(docs, boilerplate.UNTRAINED)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(texts[r.doc_id])
        assert r.kept == (not r.base_failed)
    assert boilerplate.label_documents(empty, boilerplate.UNTRAINED).count() == 0


def test_viterbi_is_the_best_path():
    draw = np.random.default_rng(0)
    crf = boilerplate.Crf(draw.normal(size=len(boilerplate.FEATURES)), draw.normal(size=(2, 2)))
    for n in range(1, 8):
        x = draw.normal(size=(n, len(boilerplate.FEATURES)))
        gain = x @ crf.emit

        def score(y):
            return sum(g for g, v in zip(gain, y, strict=True) if v) + sum(crf.step[a, b] for a, b in zip(y, y[1:], strict=False))

        best = max((tuple(int(v) for v in format(k, f"0{n}b")) for k in range(2**n)), key=score)
        assert np.isclose(score(crf.decode(x).astype(int).tolist()), score(best))


def test_crf_learns(spark):
    good, bad = [prose(80, i).replace(". ", ".\n") for i in range(60)], ["\n".join("BUY!! NOW###" for _ in range(4)) + f"\nCALL {i}!!" for i in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(None, 1), (3, None)], "doc_id long, quality int")
    crf = boilerplate.train_crf(df, labels)
    out = {r.doc_id: r.content_share for r in boilerplate.label_documents(df, crf).collect()}
    assert all(out[i] > 0.9 for i in range(60)) and all(out[i] < 0.1 for i in range(60, 120))
    assert boilerplate.train_crf(df, labels.limit(0)) is boilerplate.UNTRAINED


# nearest neighbours


def test_neighbours(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(900, 16)).astype(np.float32)
    x[300:420] = x[7]
    table = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1100, [0.0] * 16), (1200, [None] + [1.0] * 15), (1300, [float("nan")] * 16), (1400, [float("inf")] * 16), (1500, [1.0, 2.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    hit = 0
    out = neighbours.nearest_neighbours(df).collect()
    assert {r.query_id for r in out} == set(range(0, 900, 100))
    for q in range(0, 900, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        own = sorted((r["rank"], r.vec_id, r.score) for r in out if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, 11)) and all(np.isclose(d[v], s) for _, v, s in own)
        assert [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        true = [v for v in np.lexsort((np.arange(900), d)) if v != q][:10]
        hit += len(set(true) & {v for _, v, _ in own})
    assert hit >= 0.9 * 90
    few = neighbours.nearest_neighbours(df.filter("vec_id in (0, 1, 2)")).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r["rank"])] and len(few) == 2
    assert neighbours.nearest_neighbours(df.limit(0)).count() == 0


# near copies


def brute_components(table, words, percent):
    sets = {}
    for i, t in table:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    ids, comp = sorted(sets), {i: i for i in sets}
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * len(sets[a] | sets[b]):
                low, high = sorted((comp[a], comp[b]))
                comp = {k: low if v == high else v for k, v in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in ids}


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_near_copies(spark, docs, words, percent):
    out = near_copies.near_copy_classes(docs, words, percent).collect()
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], words, percent)
    assert len(out) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want


def test_large_family_of_near_copies(spark):
    """Copies that are close to each other, some beyond the threshold, so that families aren't one component."""
    base, table = prose(60, 1).split(), []
    for i in range(150):
        w, r = list(base), random.Random(i)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"odd{r.randrange(40)}"
        table.append((i, " ".join(w)))
    df = spark.createDataFrame(table, "doc_id long, text string")
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in near_copies.near_copy_classes(df, 3, 90).collect()}
    assert out == brute_components(table, 3, 90)


def test_near_copies_empty(empty, spark):
    assert near_copies.near_copy_classes(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (1, None)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_copies.near_copy_classes(odd).collect()} == {(None, None), (1, 1)}


def test_near_copies_without_or_with_repeated_ids(spark):
    """Rows without a doc_id meet nothing, also beside a document -1; rows of one doc_id are one document with the links of all their texts."""
    base, table = prose(60, 1).split(), []
    for i in range(40):
        w, r = list(base), random.Random(i)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"odd{r.randrange(40)}"
        table.append((i - 1, " ".join(w)))
    schema = "doc_id long, text string"
    want = brute_components(table, 3, 90)
    more = spark.createDataFrame(table + [(None, table[k][1]) for k in (0, 3, 3, 17)], schema)
    out = [(r.doc_id, (r.n_shingles, r.component_id)) for r in near_copies.near_copy_classes(more, 3, 90).collect()]
    assert {i: x for i, x in out if i is not None} == want and sum(i is None and x[1] is None for i, x in out) == 4
    a, b, c, d = (prose(50, 900 + k) for k in range(4))
    rows = [(3, a), (5, a), (5, b), (9, b), (9, c), (7, c), (8, d), (8, d), (6, None), (6, "")]
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in near_copies.near_copy_classes(spark.createDataFrame(rows, schema), 3, 90).collect()}
    assert {i: k for i, _, k in found} == {3: 3, 5: 3, 9: 3, 7: 3, 8: 8, 6: 6}


def test_roots(spark):
    from docgraph.llm.components import roots

    parents = [(k, k - 1) for k in range(2, 40)] + [(60, 50), (61, 50), (50, 45)]
    found = {r.node: r.root for r in roots(spark.createDataFrame(parents, "a long, b long")).collect()}
    assert found == {**{k: 1 for k in range(2, 40)}, 60: 45, 61: 45, 50: 45}


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 45), (60, 60)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(1, 31)}, 40: 40, 45: 40, 50: 40}


# quality classifier


def test_rules(spark):
    r = random.Random(0)
    table = [(i, prose(60, i) if i % 3 else " ".join(r.choice(["###", "BUY!!", "$$$"]) for _ in range(40))) for i in range(400)] + [(900, None), (901, "")]
    df = spark.createDataFrame(table, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("n_words", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = rules.train_classifier(df, labels)
    out = rules.score_quality(df, model).collect()
    held = [o for o in out if o.held_out and o.doc_id < 400]
    assert held and all(o.predicted == int(o.doc_id % 3 > 0) for o in held) and all(0 <= o.score <= 1 for o in out) and len(out) == 402
    stats = rules.with_statistics(df, "doc_id").collect()
    ours = dict(zip((s["_kept"].doc_id for s in stats), model.scores(np.array([[s[f] for f in rules.FEATURES] for s in stats])), strict=True))
    assert all(np.isclose(ours[o.doc_id], o.score) for o in out)
    assert all(o.score == 0.5 for o in rules.score_quality(df, rules.train_classifier(df, labels.limit(0))).collect())
    assert rules.score_quality(df.limit(0), model).count() == 0


# packing


def test_packing(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    unique = docs.dropDuplicates(["doc_id"])
    out = packing.pack_documents(unique.coalesce(1), shard_tokens=3000).collect()
    texts = {r.doc_id: r.text for r in unique.collect()}
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(texts)
    for i, pieces in by.items():
        ids, at = np.array([*model.encode(texts[i] or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    sizes = []
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        sizes.append(at)
    assert max(sizes) <= 1024 and all(x & (x - 1) == 0 for x in sizes)  # nothing is padded
    assert packing.pack_documents(empty).count() == 0
    assert packing.pack_documents(docs).agg(F.sum("length")).first()[0] > sum(sizes)  # repeated rows count


def test_bm25_by_brute_force():
    draw = np.random.default_rng(2)
    shard = [draw.integers(0, 40, int(draw.integers(3, 60))).astype(np.uint32) for _ in range(30)]
    index, used = packing.Index(shard), np.zeros(30, bool)
    used[[3, 9]] = True
    mean = np.mean([len(d) for d in shard])

    def score(q, d):
        total = 0
        for t in set(shard[q].tolist()) & set(shard[d].tolist()):
            df, tf = sum(t in x for x in shard), int((shard[d] == t).sum())
            total += np.log1p((30 - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(shard[d]) / mean))
        return total

    found = index.neighbours(5, used, 30).tolist()
    want = [d for d in range(30) if not used[d] and score(5, d) > 0]
    assert sorted(found) == want
    assert all(score(5, a) >= score(5, b) - 1e-4 for a, b in zip(found, found[1:], strict=False))
