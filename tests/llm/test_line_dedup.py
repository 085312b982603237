import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from phenoweave.llm import line_dedup

HOT = "This very common line has more than forty characters in it."


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows):
    holders = defaultdict(list)
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            ids = holders.get(key(line), [])
            if len(ids) >= 5:
                named = [i for i in ids if i is not None]
                if (doc != max(named)) if named else doc is not None:
                    continue
            kept.append(line)
        out.append((doc or -1, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.fixture(scope="module")
def rows(odd_texts):
    out = list(odd_texts)
    for i in range(100, 140):
        out.append((i, f"own line {i}\n  {HOT.upper() if i % 2 else HOT}\t\n" + (f"{HOT}\n" if i % 7 == 0 else "") + f"another line that only few documents share, {i % 10}"))
    out += [(None, HOT), (139, out[-1][1]), (200, "é" * 39), (201, " " + "É" * 40 + " ")]
    out += [(300 + i, "É" * 40) for i in range(4)] + [(None, "Only rows without an id hold this line, all five of them.")] * 5
    return out


@pytest.mark.parametrize("broadcast_bytes", [line_dedup.BROADCAST_BYTES, 0])
def test_equals_brute_force(make_documents, rows, broadcast_bytes):
    docs = make_documents(rows)
    got = line_dedup.line_report(docs, broadcast_bytes=broadcast_bytes).collect()
    assert sorted((r.doc_id or -1, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == brute(rows)
    cut = line_dedup.remove_shared_lines(docs, broadcast_bytes=broadcast_bytes)
    assert cut.columns == docs.columns
    want = brute(rows)
    assert sorted((r.doc_id or -1, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in cut.collect()) == sorted((w[0], w[3]) for w in want)
    assert sum(w[2] for w in want) > 50


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.uint64))
    table = line_dedup.PerfectHash.build(keys)
    assert sorted(table.index(keys)) == list(range(len(keys)))
    assert line_dedup.PerfectHash.build(keys[:0]).size == 0
    assert sum(len(b) for b in table.bits) * 8 < 5 * len(keys)
    with pytest.raises(ValueError):
        line_dedup.PerfectHash.build(np.array([1, 1], np.uint64))


def test_shards_tell_strangers_apart():
    rng = np.random.default_rng(2)
    index, mark = rng.integers(-(2**62), 2**62, 5000), rng.integers(-(2**62), 2**62, 5000)
    shard = line_dedup.Shard(line_dedup.pack_shard(index, mark, np.full(5000, 5, np.int32), np.arange(5000), np.ones(5000, bool)))
    yes = np.ones(5000, bool)
    assert shard.drops(index, mark, np.full(5000, -1), yes).all()
    assert not shard.drops(index, mark, np.arange(5000), yes).any()
    assert not shard.drops(index, mark + 1, np.full(5000, -1), yes).any()
    assert not shard.drops(rng.integers(-(2**62), 2**62, 5000), mark, np.full(5000, -1), yes).any()


def test_empty_table(make_documents):
    for size in (0, 1 << 20):
        assert line_dedup.line_report(make_documents([]), broadcast_bytes=size).count() == 0


def test_random_lines(make_documents):
    random.seed(7)
    pool = [f"{i:02d} " + "pooled line of some length that repeats" for i in range(30)]
    rows = [(i, "\n".join(random.choices(pool, k=random.randint(0, 6)))) for i in range(80)]
    got = line_dedup.line_report(make_documents(rows)).collect()
    assert sorted((r.doc_id or -1, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == brute(rows)
