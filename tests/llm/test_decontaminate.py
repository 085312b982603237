import hashlib
import re

import pytest

from phenoweave.llm.decontaminate import contamination, remove_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, n=10):
    windows = []
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        windows += [(str(item) if item is not None else "null", w[i : i + k]) for i in range(len(w) - k + 1) if k]
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    found.add(item)
        out.append((doc or -1, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog while nine cats sleep"), (2, "Short item"), (10, "short  ITEM!"), (None, "nobody knows this"),
    (3, None), (4, "..."), (1, "The quick brown fox jumps over the lazy dog while nine cats sleep"), (5, "word"), (6, "é Éa 日本"),
]
TEXTS = [
    (20, "so THE quick-brown fox: jumps over the lazy dog while nine cats sleep, yes"), (21, "quick brown fox jumps over the lazy dog while nine"),
    (22, "a short item and a short item"), (23, "nobody knows this short\nitem"), (24, "é Éa 日本 é éa 日本"), (25, "sho rt item"),
]


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame([(i, t, "extra") for i, t in ITEMS], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("per_block", [400_000, 3])
def test_equals_brute_force(make_documents, odd_texts, benchmark, per_block):
    rows = odd_texts + TEXTS
    got = contamination(make_documents(rows), benchmark, windows_per_block=per_block).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute(rows, ITEMS)


@pytest.mark.parametrize("per_block", [400_000, 3])
def test_documents_and_spans_go(make_documents, odd_texts, benchmark, per_block):
    rows = odd_texts + TEXTS
    docs = make_documents(rows)
    clean = remove_contaminated(docs, benchmark, windows_per_block=per_block)
    assert clean.columns == docs.columns
    bad = {r[0] for r in brute(rows, ITEMS) if r[5]}
    assert sorted(r.doc_id or -1 for r in clean.collect()) == sorted(i or -1 for i, _ in rows if (i or -1) not in bad)
    cut = {r.doc_id: r.text for r in remove_contaminated(docs, benchmark, mode="span", windows_per_block=per_block).collect()}
    assert cut[20] == "so yes" and cut[22] == "a and a " and cut[21] == cut[5] == "" and cut[25] == "sho rt item"
    assert cut[1] is None


def test_empty_tables(spark, make_documents, benchmark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = contamination(make_documents(TEXTS), none).collect()
    assert len(got) == len(TEXTS) and not any(r.contaminated for r in got)
    assert contamination(make_documents([]), benchmark).count() == 0
    assert remove_contaminated(make_documents([]), benchmark).count() == 0
    with pytest.raises(ValueError):
        remove_contaminated(make_documents([]), benchmark, mode="other")


def test_one_block_of_windows_at_a_time(spark, make_documents, monkeypatch):
    events, broadcast = [], type(spark.sparkContext).broadcast

    def sent(context, value):
        block = broadcast(context, value)
        if isinstance(value, dict) and "table" in value:
            events.append("sent")
            destroy = block.destroy
            block.destroy = lambda *a: (events.append("gone"), destroy(*a))
        return block

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", sent)
    benchmark = spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(30))) for k in range(5)], "item_id long, text string")
    docs = make_documents([(k, f"so w{k}x" + f" w{k}x".join(map(str, range(30)))) for k in range(7)])
    got = contamination(docs, benchmark, windows_per_block=40).collect()
    assert events == ["sent", "gone"] * (len(events) // 2) + ["sent"] and len(events) >= 5
    assert {r.doc_id: (r.n_hit, r.items) for r in got} == {k: (30, [str(k)]) if k < 5 else (0, []) for k in range(7)}
