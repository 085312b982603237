import random
import re
from collections import Counter

import numpy as np
import pytest

from phenoweave.llm import near_text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bag(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute(rows):
    """Smallest id of each row's class, by position."""
    bags = [None if t is None else bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = bags[i], bags[j]
            same = a is not None and b is not None and similarity(a, b) >= 0.8
            if same or (a is None and b is None and rows[i][1] is not None and rows[i][1] == rows[j][1]):
                parent[root(i)] = root(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(doc)
    least = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return [least[root(i)] for i in range(len(rows))]


@pytest.fixture(scope="module")
def rows(odd_texts):
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = random.choices(vocabulary, k=150)
    out = list(odd_texts) + [(12, ""), (13, "  x \t"), (14, "word, word")]
    for i in range(100, 160):  # one group of near copies, some too far from the middle
        w = list(base)
        for _ in range(i % 7):
            w[random.randrange(len(w))] = random.choice(vocabulary)
        out.append((i, " ".join(w)))
    for i in range(200, 220):
        out.append((i, " ".join(random.choices(vocabulary, k=random.randint(1, 60)))))
    for i in range(220, 240):  # repeats make weights matter
        out.append((i, "again and again we say " * (i - 215)))
    out += [(300, out[20][1]), (301, out[20][1].upper()), (301, out[20][1].upper())]
    return out


def test_classes_equal_brute_force(make_documents, rows):
    got = near_text.near_duplicates(make_documents(rows)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)
    assert sorted(((r.doc_id, r.class_id) for r in got), key=key) == sorted(((d, c) for (d, _), c in zip(rows, brute(rows))), key=key)


def test_one_of_each_class_stays(make_documents, rows):
    docs = make_documents(rows)
    got = near_text.remove_near_duplicates(docs)
    assert got.columns == docs.columns
    kept = got.collect()
    classes = {c for (d, t), c in zip(rows, brute(rows)) if t is not None and c is not None}
    assert sorted(r.doc_id for r in kept if r.text is not None and r.doc_id is not None) == sorted(classes)
    assert sum(r.text is None for r in kept) == sum(t is None for _, t in rows)
    assert near_text.remove_near_duplicates(make_documents([])).count() == 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(4)
    elements = rng.integers(0, 2**63, 60, dtype=np.uint64)
    a, b = rng.integers(0, 7, 60), rng.integers(0, 7, 60)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    found = []
    for _ in range(40):
        salt = near_text.mix(elements ^ rng.integers(0, 2**63, dtype=np.uint64))
        owner, weight = np.repeat([0, 1], 60), np.concatenate([a, b])
        there = weight > 0
        table = near_text.bag_min_hash(np.concatenate([salt, salt])[there], owner[there], weight[there], 2, 120)
        found.append((table[0] == table[1]).mean())
    assert abs(np.mean(found) - want) < 4 * np.sqrt(want * (1 - want) / (40 * 120))


@pytest.mark.parametrize("columns", [4096, 16])
def test_tiles_find_every_link(monkeypatch, columns):
    monkeypatch.setattr(near_text, "COLUMNS", columns)
    random.seed(2)
    base = [random.randrange(60) for _ in range(40)]
    bags = [Counter([x if random.random() > k / 300 else random.randrange(200) for x in base]) for k in range(24)]
    arrays = [np.sort(np.array(list(c.elements()), np.uint64)) for c in bags]
    parent = list(range(24))
    root = lambda x: x if parent[x] == x else root(parent[x])
    for a in range(10):
        for b in range(10, 24):
            if similarity(bags[a], bags[b]) >= 0.8:
                parent[root(a)] = root(b)
    want = [root(x) for x in range(24)]
    links = near_text.tile_links(arrays, 10, 0.8)
    parent = list(range(24))
    for a, b in links:
        assert a < 10 <= b and similarity(bags[a], bags[b]) >= 0.8 and root(a) != root(b)
        parent[root(a)] = root(b)
    assert len(set(want)) == len({root(x) for x in range(24)}) < 24


def test_overlap_counts_repeats():
    a, b = (np.sort(np.array(v, np.uint64)).tobytes() for v in ([1, 1, 1, 2], [1, 1, 3]))
    assert near_text.bag_overlap(a, b) == (2, 5)
    assert near_text.bag_overlap(a, b"") == (0, 4)
