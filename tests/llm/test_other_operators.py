import hashlib
import random
import re
import zlib
from collections import defaultdict
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenoweave.llm import near_vectors, pieces, quotations, sharding, toxicity, warc
from phenoweave.llm.queries import vocabulary

# Sharding


def test_hilbert_curve_is_a_path():
    for bits, dims in ((3, 2), (2, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        at = sharding.hilbert_index(grid, bits)
        assert sorted(at) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(at)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


@pytest.mark.parametrize("n", [24, 5])
def test_shards_are_equal_and_gapless(make_documents, odd_texts, some_texts, n):
    rows = odd_texts + some_texts
    got = sharding.document_shards(make_documents(rows), n).collect()
    want = sorted((i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append((r.slot, r.curve))
    assert set(slots) == set(range(n)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    order = [c for s in range(n) for _, c in sorted(slots[s])]
    assert order == sorted(order)
    assert all(sorted(x for x, _ in v) == list(range(len(v))) for v in slots.values())


def test_shards_of_few_and_no_rows(make_documents, tmp_path):
    assert sharding.document_shards(make_documents([])).count() == 0
    few = sharding.document_shards(make_documents([(1, "a"), (2, None), (2, None)]))
    assert sorted((r.shard, r.slot) for r in few.collect()) == [(0, 0), (1, 0), (2, 0)]
    sharding.write_shards(few, str(tmp_path / "shards"))
    assert few.sparkSession.read.parquet(str(tmp_path / "shards")).count() == 3
    with pytest.raises(ValueError):
        sharding.hilbert_shards(make_documents([(1, "a")]).withColumn("slot", F.lit(1)), ["lang"], 2)


# WARC

PAGE = "<html>" + "é" * 600


@pytest.fixture
def pages(spark):
    time = datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
    rows = [
        (1, "http://www.b.example.com/x/?q=1#top", PAGE, time), (2, "https://user@a.example.com:80/", PAGE, time), (3, None, None, time), (4, "http://a.example.com/y\r\nz", "", None),
        (5, "http://a.example.com", "WARC/1.1\r\n\r\n\r\n\r\nsmall", time), (5, "http://a.example.com", "WARC/1.1\r\n\r\n\r\n\r\nsmall", time), (None, "http://c.example.com/", PAGE, time), (7, "http://c.example.com/", PAGE, time),
        (8, "http://c.example.com/", "x" * 300_000, time), (9, "http://c.example.com/", "small", time), (10, "http://d.example.com/", "small", time),
    ]
    return spark.createDataFrame([(*r, "e", 3) for r in rows], "page_id long, url string, html string, time timestamp, offset string, run int")


def test_archives_round_trip(pages):
    got = warc.capture_index(pages).collect()
    payloads = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    last = defaultdict(lambda: -1)
    for i, p in payloads:
        last[p] = max(last[p], i if i is not None else -1)
    revisit = lambda i, p: len(p) >= 1000 and i != last[p]
    want = sorted((i or -1, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit(i, p) else "response", last[p] if revisit(i, p) else -1) for i, p in payloads)
    assert sorted((r.capture_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in got) == want
    keys = {r.capture_id: r.urlkey for r in got}
    assert keys[1] == "com,example,b)/x/?q=1" and keys[2] == "com,example,a)/" and keys[3] == ""


def test_index_is_in_global_order(spark):
    rows = [(i, f"http://h{i % 7}.example.com/{i % 3}" if i % 2 else "http://hot.example.com/", f"page {i}") for i in range(900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("time", F.timestamp_seconds(F.col("page_id") % 50))
    path = warc.checkpoint_folder(spark) + "/order-test"
    warc.write_archives(pages, path, archive_bytes=30_000)
    runs = warc.durable(warc.sorted_runs(warc.read_runs(spark, path)), "runs")
    assert runs.select("archive").distinct().count() > 5
    merged = warc.merge_runs(runs, per_range=100).withColumn("part", F.spark_partition_id()).collect()
    assert len({r.part for r in merged}) > 3 and len(merged) == 900
    keys = [(r.urlkey, r.timestamp, r.capture_id) for r in merged]
    assert keys == sorted(keys)
    assert warc.capture_index(pages.limit(0)).count() == 0


def test_loser_tree():
    random.seed(1)
    for k in range(1, 12):
        runs = [sorted(random.choices(range(40), k=random.randint(0, 30))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)
    assert list(warc.LoserTree([])) == []


def test_broken_archives_are_errors():
    record = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [bytes(b) for *_, b in warc.parse_archive(memoryview(record * 2))] == [b"abc"] * 2
    for broken in (record[:-1], record[5:], b"WARC/1.1\r\nContent"):
        with pytest.raises(ValueError):
            list(warc.parse_archive(memoryview(broken)))


# Toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 4000")
    return documents, spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


def test_scorers_bound_the_rows_of_a_batch(spark):
    """Whole texts of a batch are held by the worker and by Spark; 10,000 rows of long ones were too many."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    documents = spark.createDataFrame([(i, f"some words {i}") for i in range(4500)], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    sizes = lambda: [r.n for r in documents.mapInArrow(lambda batches: (toxicity.pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()]
    try:
        spark.conf.set(key, "10000")
        assert toxicity.remove_toxic(documents, labels).count() <= 4500
        assert sum(sizes()) == 4500 and max(sizes()) <= 2000
        spark.conf.set(key, "10000")
        pieces.encode(documents, vocabulary("piece_bpe_32k.model"))
        assert max(sizes()) <= 2000
        spark.conf.set(key, "300")
        pieces.encode(documents, vocabulary("piece_bpe_32k.model"))
        assert max(sizes()) <= 300
    finally:
        spark.conf.set(key, before)


def test_held_out_accuracy(corpus):
    documents, labels = corpus
    rows = toxicity.toxicity(documents, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows} == {True}
    good, bad = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.95
    assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_disguised_words_are_restored(corpus, make_documents, odd_texts):
    documents, labels = corpus
    disguised = ["such a m0r0n here", "you are an 1d10t", "what a l o s e r is", "stuuupiiid thing", "w0rthle$$ stuff"]
    rows = odd_texts + [(1_000_001 + i, t) for i, t in enumerate(disguised)]
    more = make_documents(rows)
    scored = toxicity.toxicity(documents.select("doc_id", "text").unionByName(more.select("doc_id", "text")), labels, keep=True)
    got = {r.doc_id: r for r in scored.filter("doc_id > 1000000").collect()}
    words = {w.word for r in got.values() for w in r.restored}
    assert len(words & {"moron", "idiot", "loser", "stupid", "worthless"}) >= 3
    assert sum(r.predicted for r in got.values()) >= 3


@pytest.fixture(scope="module")
def fitted(corpus):
    documents, labels = corpus
    return toxicity.fit(documents, labels, toxicity.shared_counts(documents)), toxicity.count_ngrams(documents)


def test_a_large_vocabulary_alone_is_clean(spark, fitted, corpus, monkeypatch):
    """A text of 50,000 distinct words without any feature scores like a text without words."""
    model, counts = fitted
    monkeypatch.setattr(toxicity, "fit", lambda *a, **k: model)
    monkeypatch.setattr(toxicity, "count_ngrams", lambda *a, **k: counts)
    rng = random.Random(7)
    words = {"".join(rng.choice("qxzjkvw") for _ in range(9)) for _ in range(60_000)}
    docs = spark.createDataFrame([(1, " ".join(sorted(words)[:50_000])), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, corpus[1]).collect()}
    assert got[1] == got[2] == got[3] < 0.5
    assert toxicity.remove_toxic(docs, corpus[1]).count() == 3


def test_weak_evidence_equals_a_plain_mean(monkeypatch):
    ratios = np.random.default_rng(3).normal(size=1 << 20).astype(np.float32) / 20
    texts = ["", None, "abc", "abcd", "Ünïcödé text, 12 ...", "abcd" * 400_000, "zyxw"]
    want = []
    for t in texts:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        symbols = toxicity.folded(raw).tolist()
        codes = [((symbols[k] * 32 + symbols[k + 1]) * 32 + symbols[k + 2]) * 32 + symbols[k + 3] for k in range(len(symbols) - 3)]
        want.append(float(np.clip(np.mean([float(ratios[c]) for c in codes]), -toxicity.WEAK, toxicity.WEAK)) if codes else 0.0)
    assert toxicity.weak_evidence(toxicity.pa.array(texts), ratios) == pytest.approx(want, abs=1e-9)


def test_many_rare_features_are_learnt(spark):
    """700 insults, each in a few toxic rows only, and a toxic text with 40 near copies that fill no model."""
    rng = random.Random(5)
    letters = "bcdfghjklmnprstvw"
    name = lambda: "".join(rng.choice(letters) + rng.choice("aeiou") for _ in range(2))[:3]
    insults = sorted({name() for _ in range(4000)})[:700]
    plain = [f"w{k}q" for k in range(3000)]
    rows, labels = [], []
    for k in range(14_000):
        bad = k < 1000
        rows.append((k, " ".join(rng.sample(plain, 12) + [insults[(10 * k + i) % 700] for i in range(10 * bad)])))
        labels.append((k, int(bad)))
    for k in range(40):
        rows.append((20_000 + k, " ".join([f"copied{c}" for c in letters] + [f"x{k}x"])))
        labels.append((20_000 + k, 1))
    documents, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    keys, weights, constant, _ = toxicity.fit(documents, marks, toxicity.shared_counts(documents))
    hasher = toxicity.WordHasher()

    def weight(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        at, _ = toxicity._places(hasher.hashes(raw, np.array([0]), np.array([len(raw)])), keys)
        return float(weights[at].sum())

    assert len(insults) == 700 and sum(weight(w) > 0 for w in insults) >= 690
    assert weight("copiedb") == 0


def test_spaced_and_doubled_words_are_restored(fitted):
    deobfuscator, hasher = toxicity.Deobfuscator(toxicity.CharacterModel(fitted[1])), toxicity.WordHasher()
    texts = {
        "such a m0r0n here": "moron", "you are an 1d10t": "idiot", "what a l o s e r is": "loser", "stuuupiiid thing": "stupid", "w0rthle$$ stuff": "worthless",
        "you are a m o r o n": "moron", "a m 0 r o n": "moron", "so an i d 1 o t": "idiot", "what l  o  s  e  r it is": "loser", "a l - o - s - e - r!": "loser",
        "l.o.s.e.r": "loser", "l·o·s·e·r": "loser", "L\u2009O\u2009S\u2009E\u2009R": "loser", "stuppid": "stupid", "iiddiioott": "idiot", "": "", "f u n": "fun", "an a s s": "ass", "(a-s-s)": "ass", "c l a s s": "class",
    }
    found = {row: {w for _, w in r} for row, _, r in toxicity.text_features(toxicity.pa.array(list(texts)), hasher, deobfuscator, keep=True)}
    assert not [t for row, (t, w) in enumerate(texts.items()) if w and w not in found[row]], found
    # Rows do not share a run, and tables of numbers are none.
    rows = toxicity.pa.array(["a l o", "s e r", "1 2 3 4", None])
    got = list(toxicity.text_features(rows, hasher, deobfuscator, keep=True))
    assert [row for row, _, _ in got] == [0, 1, 2, 3] and "loser" not in {w for _, _, r in got for _, w in r} and not got[2][2]


def test_odd_inputs(spark, make_documents, odd_texts, corpus):
    _, labels = corpus
    docs = make_documents(odd_texts)
    unlabelled = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, unlabelled).collect()} == {0.0}
    kept = toxicity.remove_toxic(docs, unlabelled)
    assert kept.columns == docs.columns and kept.count() == len(odd_texts)
    assert toxicity.toxicity(make_documents([]), labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).count() == len(odd_texts)


def test_ngrams_cover_all_texts(make_documents, some_texts):
    rows = some_texts[:40] + [(9999, None)]
    counts = toxicity.count_ngrams(make_documents(rows))
    text = [re.sub(rb"[^a-z\x80-\xff]", b" ", t.encode().lower()) for _, t in rows if t]
    assert counts.sum() >= sum(max(0, len(t) - 3) for t in text)
    code = lambda w: sum((ord(c) - 96 if c != " " else 0) << (5 * (3 - k)) for k, c in enumerate(w))
    assert counts[code("the ")] >= sum(len(re.findall(b"(?=the )", t)) for t in text) > 0


# Vectors


def links(vectors, threshold=0.95):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    out = np.zeros((len(vectors), len(vectors)), bool)
    for i, a in enumerate(vectors):
        for j, b in enumerate(vectors):
            if i != j and good[i] and good[j] and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                out[i, j] = x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold
    return out


@pytest.mark.parametrize("block", [256, 7])
def test_vector_links_equal_brute_force(spark, block):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 32))
    vectors = [list(map(float, (c + 0.12 * rng.normal(size=32)).astype(np.float32))) for c in np.repeat(centre, 8, axis=0)]
    vectors += [vectors[0]] * 30 + [[2 * x for x in vectors[1]], None, [], [0.0] * 32, [float("nan")] * 32, [None] + [1.0] * 31, [float("inf")] * 32, [1.0, 2.0], [2.0, 4.0]]
    ids = [*range(1, len(vectors)), None]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>, label int, node string")
    got = {(r.vec_id): (r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(df, block=block).collect()}
    near = links(vectors)
    parent = list(range(len(vectors)))
    root = lambda x: x if parent[x] == x else root(parent[x])
    for i, j in zip(*np.nonzero(near)):
        parent[root(i)] = root(j)
    for i, name in enumerate(ids):
        members = [ids[k] for k in range(len(ids)) if root(k) == root(i) and ids[k] is not None]
        least = min(members, default=None)
        assert got[name] == (near[i].sum(), least, name == least), name
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


# Quotations


def test_quotations_link_and_order(spark):
    rows = [
        (1, 0, "user", "First message here.\nIt has two lines."), (1, 1, "assistant", "Unrelated answer"),
        (1, 2, "user", "> first MESSAGE here\nI agree."), (1, 3, "assistant", "> > First message here.\n> I agree!\nSo do I\n> nobody said this"),
        (1, 4, "user", ">First message here.\n> It has two lines.\nok"), (1, 4, "user", ">First message here.\n> It has two lines.\nok"),
        (2, 0, "user", "> I agree."), (2, 1, "user", None), (None, None, None, ""), (2, 2, "user", "> quoted later"), (2, 3, "user", "quoted later"), (3, 0, "user", "line\n" * 3000 + "> line"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, hash string, thread int")
    got = quotations.reply_ordered(df).collect()
    assert len(got) == len(rows)
    about = {(r.conv_id, r.turn): r for r in got}
    assert [(r.conv_id, r.turn) for r in got if r.conv_id == 1] == [(1, 0), (1, 2), (1, 3), (1, 4), (1, 4), (1, 1)]
    assert about[1, 2].reply_to == 0 and about[1, 2].text == "I agree." and about[1, 2].n_linked == 1
    third = about[1, 3]
    assert (third.reply_to, third.thread, third.depth, third.n_quotes, third.n_linked, third.text) == (2, 0, 2, 3, 2, "So do I")
    assert about[1, 4].reply_to == 0 and about[2, 0].reply_to is None and about[2, 0].n_quotes == 1 and about[2, 2].n_linked == 0
    assert about[2, 1].text is None and about[None, None].text == ""
    assert about[3, 0].reply_to is None
    assert quotations.reply_ordered(df.limit(0)).count() == 0


def test_parts_of_messages_link(spark):
    first = "Opening words here.\n\nA second paragraph\nof three lines\nand no more.\n\nThe closing words."
    rows = [
        (1, 0, first), (1, 1, "Something else.\nof three lines"),
        (1, 2, "> A second paragraph\n> of three lines\n> and no more.\nYes."), (1, 3, "> of three lines\n> and no more.\nHm."),
        (1, 4, "> Opening words here.\n>\n> The closing words.\nNo."), (1, 5, "> Opening words here.\n> A second paragraph\n> and no more.\nOne left out."),
        (1, 6, "> Said by nobody\n> at all"), (1, 7, "> A second paragraph of three\n> lines and no more.\nWrapped anew."), (1, 8, "> Said by nobody\n> Something else.\nHalf."),
        (2, 0, "> Opening words here.\n> and no more."),
    ]
    got = quotations.reply_ordered(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()
    about = {(r.conv_id, r.turn): (r.n_quotes, r.n_linked, r.reply_to) for r in got}
    assert [about[1, t] for t in range(2, 9)] == [(1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 0, None), (1, 1, 0), (1, 1, 1)]
    assert about[2, 0] == (1, 0, None)


def test_long_reply_chains(spark):
    rows = [(1, i, "user", (f"> message number {i - 1}\n" if i else "") + f"message number {i}") for i in range(70)]
    got = quotations.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.turn, r.depth, r.thread) for r in got] == [(i, i, 0) for i in range(70)]
