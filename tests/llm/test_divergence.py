import re
from collections import Counter, defaultdict

import pytest

from phenoweave.llm import divergence

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, min_docs, top):
    """All rows by dense counting; ``rows`` are (text, lang, source)."""
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(TERM, (text or "").translate(FOLD))
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    kept = {lang: sorted(t for t, n in d.items() if n >= min_docs) for lang, d in docs.items()}
    share = lambda n, total, v: 1 + 10**9 * (n + 5) // (total + 5 * v)
    p, counts = {}, {}
    for (lang, source), c in groups.items():
        v = kept.get(lang, [])
        total = sum(c[t] for t in v)
        p[lang, source], counts[lang, source] = {t: share(c[t], total, len(v)) for t in v}, c
    out = set()
    for lang, source in groups:
        v = kept.get(lang, [])
        whole = Counter()
        for (other, s), c in groups.items():
            if other == lang:
                whole.update({t: c[t] for t in v})
        q = {t: share(whole[t], sum(whole.values()), len(v)) for t in v}
        mine = p[lang, source]
        pairs = [(-sum(abs(mine[t] - p[lang, s][t]) for t in v), s) for other, s in groups if other == lang and s != source]
        terms = [(q[t] - mine[t], t) for t in v if counts[lang, source][t] and mine[t] > q[t]]
        for part, items in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
            out |= {(lang, source, part, item, -value, r + 1) for r, (value, item) in enumerate(items)}
    return out


def report(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def frame(spark, rows):
    # Extra columns bear names that the operator uses inside.
    return spark.createDataFrame([(*r, "x", 1, None) for r in rows], "text string, lang string, source string, g string, t int, terms string")


@pytest.mark.parametrize("bits,broadcast", [(64, 500_000), (64, 10), (6, 500_000), (6, 3), (11, 500_000)])
def test_equals_dense_counts(spark, some_texts, odd_texts, monkeypatch, bits, broadcast):
    monkeypatch.setattr(divergence, "BROADCAST_TERMS", broadcast)
    rows = [(t, ["en", "de", None][i % 3], f"src{i % 5}" if i % 7 else None) for i, (_, t) in enumerate(some_texts)]
    rows += [(t, "en", "odd") for _, t in odd_texts] + [("copy of a hot text Éa éa", "en", "src1")] * 90
    rows += [("few words", "lonely", "only"), (None, "lonely", "other"), ("1 2 3", "", "zz"), ("", "en", "ﬁ")]
    found = divergence.source_divergence(frame(spark, rows), min_docs=6, top=7, bits=bits)
    assert report(found) == expected(rows, 6, 7)


def test_many_sources_and_tiles(spark, some_texts, monkeypatch):
    monkeypatch.setattr(divergence, "TILE_SOURCES", 3)
    monkeypatch.setattr(divergence, "TILE_TERMS", 20)
    rows = [(t, "en", f"s{i % 11}") for i, (_, t) in enumerate(some_texts[:80])]
    assert report(divergence.source_divergence(frame(spark, rows), min_docs=4)) == expected(rows, 4, 50)


def test_ties_and_no_rows(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(80)] + ["ｚ", "𝒜x", "é"]
    rows = [(" ".join(words), "en", "a")] * 3 + [("nothing here", "en", "b")] * 3
    found = divergence.source_divergence(frame(spark, rows), min_docs=2, top=50)
    assert report(found) == expected(rows, 2, 50)
    assert divergence.source_divergence(frame(spark, rows).filter("lang = 'none'")).collect() == []
