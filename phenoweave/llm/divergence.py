"""How the sources of each language differ in their vocabulary, with late string materialisation.

Counting shuffles digests of terms, never terms. Digests seen in enough documents
are looked up again in the texts, where the smallest and the largest string of a
digest show whether it stands for several terms; those are counted anew by their
strings and split. From then on a term is a number, and its text joins back only
to the rows that are returned.

Shares are whole numbers: ``p = 1 + floor(10^9 (n + 5) / (N + 5 V))`` with ``n``
the occurrences of a term in a group, ``N`` their sum over the kept terms and
``V`` the number of kept terms of the language. Part ``pair`` gives the distance
of a source to each other source of its language, the sum of ``abs(p - q)`` over all kept
terms; terms that occur in neither are counted at once. Part ``term`` gives the
terms that a source has more of than its language.

Defined cases: null texts, languages and sources count as empty ones; a term is a
run of ASCII letters and characters beyond ASCII, A-Z as a-z; a source without kept terms
still has distances; a language without kept terms has distances of 0; a language
of one source has no pairs; terms of equal value are ranked by their UTF-8 bytes;
extra columns are ignored; a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from phenoweave.llm.words import WordHasher, slices, text_buffer
from phenoweave.session import durable

MIN_DOCS, TOP = 30, 50
SLICE = 8 << 20  # bytes of texts that are counted together
BROADCAST_TERMS = 500_000  # digests of 8 bytes sent to all executors; beyond that strings are not filtered before their shuffle
TILE_SOURCES, TILE_TERMS = 64, 2048
WHOLE = 1_000_000_000
TILE = "a long, b long, delta long"
COUNTS, STRINGS = "lang string, source string, digest long, docs long, n long", "lang string, digest long, low string, high string"
SPLITS = "lang string, source string, text string, docs long, n long"


class TermReader:
    """Terms of Arrow string columns, lower-cased, as spans of bytes with 64-bit digests."""

    def __init__(self, bits: int = 64) -> None:
        self.hasher, self.shift = WordHasher(), np.uint64(64 - bits)
        code = np.arange(256)
        self.lower = np.where((code >= 65) & (code <= 90), code + 32, code).astype(np.uint8)
        self.hasher.is_word = ((code | 32) >= 97) & ((code | 32) <= 122) & (code < 128) | (code >= 128)

    def slices(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, last row, bytes, starts, ends, row, digest) of the terms of some texts at a time."""
        raw_all, offsets_all = text_buffer(column)
        for i, j in slices(offsets_all, SLICE):
            raw, offsets = self.lower[raw_all[offsets_all[i] : offsets_all[j]]], offsets_all[i : j + 1] - offsets_all[i]
            starts, ends, bounds = self.hasher.spans(raw, offsets)
            row = np.repeat(np.arange(j - i), np.diff(bounds))
            yield i, j, raw, starts, ends, row, self.hasher.hashes(raw, starts, ends) >> self.shift


def strings_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as an Arrow string column."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[at])])


def unequal(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, piece: int = 100_000) -> np.ndarray:
    """Which terms are not byte for byte the term at place ``first[k]``."""
    size = ends - starts
    out = size != size[first]
    for a in range(0, len(starts), piece):
        same = a + np.flatnonzero(~out[a : a + piece] & (first[a : a + piece] != np.arange(a, min(a + piece, len(starts)))))
        n = size[same]
        begin = np.cumsum(n) - n
        inside = np.arange(n.sum()) - np.repeat(begin, n)
        differs = raw[np.repeat(starts[same], n) + inside] != raw[np.repeat(starts[first[same]], n) + inside]
        out[same[np.unique(np.repeat(np.arange(len(same)), n)[differs])]] = True
    return out


def _groups(batch: pa.RecordBatch, i: int, j: int) -> tuple[np.ndarray, list, list]:
    """Number of each row's (lang, source), and these pairs."""
    langs, sources = (batch.column(c).slice(i, j - i).dictionary_encode() for c in (0, 1))
    pair = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    seen, number = np.unique(pair, return_inverse=True)
    names = [langs.dictionary.to_pylist(), sources.dictionary.to_pylist()]
    return number, [names[0][p // len(names[1])] for p in seen], [names[1][p % len(names[1])] for p in seen]


def _summed(code: np.ndarray, row: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code, group, documents, occurrences) of terms numbered ``code`` in the rows of numbered groups."""
    # Rows are renumbered by group, so that one sort orders by code, group and row.
    order = np.argsort(group, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    pair, times = np.unique(code * len(order) + rank[row], return_counts=True)
    of, where = pair // len(order), group[order][pair % len(order)]
    first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (where[1:] != where[:-1])])) if len(pair) else np.zeros(0, np.int64)
    docs = np.diff(np.append(first, len(pair)))
    return of[first], where[first], docs, np.add.reduceat(times, first) if len(first) else docs


def _count(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(lang, source, digest, docs, n) of slices of the texts."""
    reader = TermReader(bits)
    for batch in batches:
        for i, j, _, _, _, row, digest in reader.slices(batch.column(2)):
            group, langs, sources = _groups(batch, i, j)
            known, code = np.unique(digest, return_inverse=True)
            of, where, docs, n = _summed(code, row, group)
            names = [pa.DictionaryArray.from_arrays(pa.array(where, pa.int32()), pa.array(x, pa.string())).dictionary_decode() for x in (langs, sources)]
            columns = [*names, pa.array(known[of].view(np.int64)), pa.array(docs, pa.int64()), pa.array(n, pa.int64())]
            yield from _pieces(columns, ["lang", "source", "digest", "docs", "n"])


def _spell(batches: Iterator[pa.RecordBatch], bits: int, wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(lang, digest, low, high) of slices: smallest and largest string of each digest, of the ``wanted`` ones if they are given."""
    reader = TermReader(bits)
    for batch in batches:
        for i, j, raw, starts, ends, row, digest in reader.slices(batch.column(1)):
            langs = batch.column(0).slice(i, j - i).dictionary_encode()
            known, first, code = np.unique(digest, return_index=True, return_inverse=True)
            asked = np.ones(len(known), bool) if wanted is None else _member(known, wanted)
            at = np.flatnonzero(asked[code])
            if not len(at):
                continue
            low = strings_of(raw, starts[first], ends[first]).to_pylist() if (odd := unequal(raw, starts, ends, first[code]) & asked[code]).any() else None
            pair = np.unique(code[at] * len(langs.dictionary) + langs.indices.to_numpy()[row[at]])
            of, where = pair // len(langs.dictionary), pair % len(langs.dictionary)
            texts = strings_of(raw, starts[first[of]], ends[first[of]]).cast(pa.string())
            least = most = texts
            if low is not None:
                # A digest of several strings here: their smallest and largest, whatever the language.
                ends_of = {}
                for k in np.flatnonzero(odd):
                    word, c = bytes(raw[starts[k] : ends[k]]).decode(), int(code[k])
                    a, b = ends_of.get(c, (low[c], low[c]))
                    ends_of[c] = (min(a, word), max(b, word))
                least, most = (pa.array([ends_of[c][s] if c in ends_of else t for c, t in zip(of.tolist(), texts.to_pylist())], pa.string()) for s in (0, 1))
            names = pa.DictionaryArray.from_arrays(pa.array(where, pa.int32()), langs.dictionary).dictionary_decode()
            yield from _pieces([names, pa.array(known[of].view(np.int64)), least, most], ["lang", "digest", "low", "high"])


def _split(batches: Iterator[pa.RecordBatch], bits: int, wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(lang, source, text, docs, n) of slices, of the terms with the ``wanted`` digests, each string by itself."""
    reader = TermReader(bits)
    for batch in batches:
        for i, j, raw, starts, ends, row, digest in reader.slices(batch.column(2)):
            at = np.arange(len(digest)) if wanted is None else np.flatnonzero(_member(digest, wanted))
            group, langs, sources = _groups(batch, i, j)
            texts = strings_of(raw, starts[at], ends[at]).cast(pa.string()).dictionary_encode()
            of, where, docs, n = _summed(texts.indices.to_numpy().astype(np.int64), row[at], group)
            names = [pa.DictionaryArray.from_arrays(pa.array(where, pa.int32()), pa.array(x, pa.string())).dictionary_decode() for x in (langs, sources)]
            yield from _pieces([*names, texts.dictionary.take(pa.array(of)), pa.array(docs, pa.int64()), pa.array(n, pa.int64())], ["lang", "source", "text", "docs", "n"])


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values if len(among) else np.zeros(len(values), bool)


def _pieces(columns: list, names: list[str], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names)
    for k in range(0, whole.num_rows, rows):
        yield whole.slice(k, rows)


def _sent(digests: DataFrame) -> Broadcast:
    """The sorted digests for all tasks; None where they are too many for that."""
    few = digests.select("digest").distinct().limit(BROADCAST_TERMS + 1).toArrow()
    values = None if few.num_rows > BROADCAST_TERMS else np.sort(few.column("digest").to_numpy().view(np.uint64))
    return digests.sparkSession.sparkContext.broadcast(values)


def kept_terms(rows: DataFrame, min_docs: int = MIN_DOCS, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Kept terms (lang, t, text) and their counts in the groups (lang, source, t, n); ``t`` numbers a term.

    ``rows`` has lang, source and text, none of them null.
    """
    narrow = rows.select("lang", "source", "text")
    sums = lambda df, *by: df.groupBy(*by).agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    counts = durable(sums(narrow.mapInArrow(lambda b: _count(b, bits), COUNTS), "lang", "source", "digest"), "term-counts")
    often = durable(counts.groupBy("lang", "digest").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("lang", "digest"), "term-digests")
    wanted = _sent(often)
    strings = rows.select("lang", "text").mapInArrow(lambda b: _spell(b, bits, wanted.value), STRINGS)
    # Without filter, the strings of rare digests go no further than this join.
    spelt = durable(strings.join(often, ["lang", "digest"], "left_semi").groupBy("lang", "digest").agg(F.min("low").alias("low"), F.max("high").alias("high")), "term-strings")
    several = spelt.filter("low <> high").select("lang", "digest")
    single = spelt.filter("low = high").select("lang", "digest", F.col("low").alias("text"))
    if several.isEmpty():
        terms = durable(single.withColumn("t", F.monotonically_increasing_id()), "terms")
        return terms.select("lang", "t", "text"), counts.join(terms, ["lang", "digest"]).select("lang", "source", "t", "n")
    # Digests that stand for several terms are split: in every language, their strings are counted themselves.
    shared = several.select("digest").distinct()
    split_by = _sent(shared)
    split = durable(sums(narrow.mapInArrow(lambda b: _split(b, bits, split_by.value), SPLITS), "lang", "source", "text"), "term-splits")
    if split_by.value is None:
        single = single.limit(0)  # all terms were counted by their strings
    texts = split.groupBy("lang", "text").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("lang", F.lit(None).cast("long").alias("digest"), "text")
    terms = durable(single.join(shared, "digest", "left_anti").unionByName(texts).withColumn("t", F.monotonically_increasing_id()), "terms")
    found = counts.join(terms.filter("digest is not null"), ["lang", "digest"]).select("lang", "source", "t", "n").unionByName(
        split.join(terms.filter("digest is null").drop("digest"), ["lang", "text"]).select("lang", "source", "t", "n")
    )
    return terms.select("lang", "t", "text"), found


def share(n: Column, total: Column, terms: Column) -> Column:
    """Whole-number share of ``n`` of ``total`` occurrences among ``terms`` kept terms."""
    above = F.lit(WHOLE).cast("decimal(10,0)") * (n + 5).cast("decimal(19,0)")
    return F.when(total + terms > 0, F.call_function("div", above, (total + 5 * terms).cast("decimal(20,0)")) + 1)


def tile_distances(tile: pd.DataFrame) -> pd.DataFrame:
    """Sum over the terms of one tile of ``abs(p - q)``, less that of a term neither has, for each two sources.

    Rows without ``t`` name the sources of the tile and their share of a term that they do not have.
    """
    sources = tile[tile.t.isna()]
    g, base = sources.g.to_numpy(), sources.base.to_numpy(np.int64)
    rows = tile[tile.t.notna()]
    code, _ = pd.factorize(rows.t)
    shares = np.repeat(base[None], code.max() + 1 if len(code) else 0, 0)
    order = np.argsort(g)
    shares[code, order[np.searchsorted(g, rows.g.to_numpy(), sorter=order)]] = rows.p.to_numpy(np.int64)
    a, b, delta = [], [], []
    same = bool((sources.low == sources.high).iloc[0]) if len(sources) else True
    home = sources.home.to_numpy()
    for i in range(len(g)):
        # Within a block every pair once; of two blocks, the pairs across.
        others = np.arange(i + 1, len(g)) if same else np.flatnonzero(home > home[i])
        if len(others):
            a.append(np.full(len(others), g[i]))
            b.append(g[others])
            delta.append(np.abs(shares[:, others] - shares[:, [i]]).sum(0) - len(shares) * np.abs(base[others] - base[i]))
    joined = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, delta))
    return pd.DataFrame(dict(zip(("a", "b", "delta"), joined)))


def _distances(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(a, b, delta) for every two groups of a language, both ways.

    ``groups``: lang, g, base, terms, sources; ``shares``: g, t, p. Sources are dealt into blocks and terms into
    buckets, so that a tile holds two blocks of sources and one bucket of terms, however many there are.
    """
    blocks, buckets = F.ceil(F.col("sources") / TILE_SOURCES), F.ceil(F.col("terms") / TILE_TERMS)
    dealt = groups.filter("terms > 0 and sources > 1").select("lang", "g", "base", F.pmod(F.xxhash64("g"), blocks).alias("home"), blocks.alias("blocks"), buckets.alias("buckets"))
    met = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    tiles = dealt.withColumn("other", met).withColumn("low", F.least("home", "other")).withColumn("high", F.greatest("home", "other"))
    names = tiles.select("lang", "low", "high", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"), "g", "home", "base", F.lit(None).cast("long").alias("t"), F.lit(None).cast("long").alias("p"))
    rows = shares.join(tiles, "g").select("lang", "low", "high", F.pmod(F.xxhash64("t"), F.col("buckets")).alias("bucket"), "g", "home", "base", "t", "p")
    sums = names.unionByName(rows).groupBy("lang", "low", "high", "bucket").applyInPandas(tile_distances, TILE).groupBy("a", "b").agg(F.sum("delta").alias("delta"))
    return sums.unionByName(sums.select(F.col("b").alias("a"), F.col("a").alias("b"), "delta"))


def source_divergence(
    documents: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
    min_docs: int = MIN_DOCS, top: int = TOP, bits: int = 64,
) -> DataFrame:
    """(lang, source, part, item, value, rank): distances between sources, and the terms each has most above its language.

    ``bits`` is the width of a term's digest.
    """
    empty = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = documents.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("text"))
    terms, found = kept_terms(rows, min_docs, bits)
    named = durable(rows.select("lang", "source").distinct().withColumn("g", F.monotonically_increasing_id()), "term-groups")
    counts = durable(found.join(named, ["lang", "source"]).select("lang", "g", "t", "n"), "kept-counts")
    sizes = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    sums = counts.groupBy("lang", "g").agg(F.sum("n").alias("total"))
    of_lang = sums.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    sources = named.groupBy("lang").agg(F.count("*").alias("sources"))
    groups = durable(
        named.join(sums, ["lang", "g"], "left").join(sizes, "lang", "left").join(of_lang, "lang", "left").join(sources, "lang")
        .na.fill(0, ["total", "terms", "lang_total"])
        .withColumn("base", F.coalesce(share(F.lit(0).cast("long"), F.col("total"), F.col("terms")), F.lit(0).cast("long"))),
        "term-group-sizes",
    )
    shares = durable(
        counts.join(groups.select("g", "total", "terms"), "g").select("lang", "g", "t", "n", share(F.col("n"), F.col("total"), F.col("terms")).alias("p")),
        "term-shares",
    )
    one = groups.select("lang", "source", F.col("g").alias("a"), F.col("base").alias("base_a"), "terms")
    two = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("b"), F.col("base").alias("base_b"))
    absent = F.col("terms") * F.abs(F.col("base_a") - F.col("base_b"))
    pairs = one.join(two, "lang").filter("a <> b").join(_distances(groups, shares.select("g", "t", "p")), ["a", "b"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", (absent + F.coalesce("delta", F.lit(0))).alias("value")
    )
    by_term = shares.groupBy("lang", "t").agg(F.sum("n").alias("n")).join(groups.select("lang", "lang_total", "terms").distinct(), "lang")
    of_term = by_term.select("t", share(F.col("n"), F.col("lang_total"), F.col("terms")).alias("q"))
    above = shares.join(of_term, "t").filter("p > q").select("g", "t", (F.col("p") - F.col("q")).alias("value"))
    # Ties at the last rank stay until their texts decide.
    first = above.withColumn("at", F.rank().over(Window.partitionBy("g").orderBy(F.desc("value")))).filter(F.col("at") <= top)
    spelt = first.join(terms.select("t", F.col("text").alias("item")), "t").join(groups.select("g", "lang", "source"), "g").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked(pairs).unionByName(ranked(spelt).filter(F.col("rank") <= top))
