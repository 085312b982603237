"""Toxicity scores of deobfuscated text.

A character 4-gram model is counted over all documents. Tokens that look
disguised (letters next to digits or signs that imitate letters, a letter twice in
a row, three or more single letters or signs in a row with gaps of a few bytes)
become lattices of what each character may stand for and, between single letters,
of where words end; a Viterbi search under noisy-channel costs and the language
model restores the words. Words and word beginnings of the text and of its restored
words, known by 64-bit hashes, feed a logistic model: a word that is no feature
adds nothing to a score, however many of them a text has. Weak evidence, how much
likelier the text's character 4-grams are among toxic rows on average, ranks texts of
the same features; it is bounded to half a nat.

The classifier is fitted on a bounded sample of labelled rows (``sample``
parameter); everything else covers all documents.

Defined cases: null and empty texts get the score of a text without features;
null labels are left out, of several labels of a document the largest counts;
a null id is held out; without labelled rows of both kinds every score is 0;
extra columns are ignored by the scores and kept by :func:`remove_toxic`.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from phenoweave.llm.words import WordHasher, mix, slices, text_buffer
from phenoweave.session import bound_batches, durable

ORDER = 4
LETTER = 5  # bits of a folded character: 0 boundary, 1-26 letters, 27 others
PREFIXES = (4, 5, 6, 7, 8)  # bytes
SAMPLE = 20_000  # labelled rows the classifier is fitted on
SIGNATURE, BANDS, ALIKE = 32, 16, 0.5  # near copies among these rows: minima, bands of them, share of equal ones
CONTEXT = (1 << (LETTER * (ORDER - 1))) - 1
# Letters that digits and signs imitate.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
SUBSTITUTED, REPEATED, DROPPED = 1.0, 0.4, 2.0  # channel costs in nats
WAYS, MARGIN = 4, 8.0  # restorations of a token that count: so many, and so many nats behind the best
GAP = 5  # bytes between single letters of one run
RESTORED = 20_000  # restored tokens remembered by one worker process
REMEMBERED_LENGTH = 64  # longer tokens are not remembered
WEAK, PRIOR_ROWS = 0.5, 10.0  # bound of the weak evidence in nats, and rows of the whole corpus mixed into the rarer kind
UNIT = 1 << 40  # of summed shares, which are whole numbers so that their order does not matter


def folded(raw: np.ndarray) -> np.ndarray:
    """Language-model symbols of bytes."""
    table = np.zeros(256, np.uint32)
    table[97:123] = table[65:91] = np.arange(1, 27)
    table[128:] = 27
    return table[raw]


def _codes(raw: np.ndarray) -> np.ndarray:
    """Numbers of the 4-grams that begin at each byte but the last three."""
    symbols = folded(raw)
    n = max(0, len(symbols) - ORDER + 1)
    code = np.zeros(n, np.uint32)
    for k in range(ORDER):
        code = (code << LETTER) | symbols[k : k + n]
    return code


def _collected(found: DataFrame, size: int) -> np.ndarray:
    """Sums (code, n) as an array; the alphabet fixes its size."""
    rows = found.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    return out


def _emitted(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(total)
    for i in range(0, len(at), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 50_000], pa.int64()), pa.array(total[at[i : i + 50_000]], pa.int64())], ["code", "n"])


def count_ngrams(documents: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of all character 4-grams of all texts; the table's size is fixed by the alphabet."""
    size = 1 << (LETTER * ORDER)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            raw, offsets = text_buffer(batch.column(0))
            for i, j in slices(offsets, 1 << 20):
                for a in range(int(offsets[i]), int(offsets[j]), 1 << 20):
                    code = _codes(raw[a : min(a + (1 << 20) + ORDER - 1, int(offsets[j]))])
                    if len(code):
                        total += np.bincount(code, minlength=size)
        yield from _emitted(total)

    return _collected(documents.select(text).mapInArrow(count, "code long, n long"), size)


def _log_ratios(rows: DataFrame, counts: np.ndarray, positive: float, negative: float) -> np.ndarray:
    """Per 4-gram the log of how much likelier it is among toxic rows than among others.

    ``rows`` (text, y, share) are the sample; every row counts its share, however long it is.
    """
    size = len(counts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * size)
        for batch in batches:
            raw, offsets = text_buffer(batch.column(0))
            kinds, shares = batch.column(1).to_numpy() > 0, batch.column(2).to_numpy()
            for row in range(batch.num_rows):
                code = _codes(raw[offsets[row] : offsets[row + 1]])
                if len(code):
                    at, n = np.unique(code, return_counts=True)
                    total[at + size * int(kinds[row])] += np.floor(n * (shares[row] * UNIT / len(code)))
        yield from _emitted(total.astype(np.int64))

    found = _collected(rows.mapInArrow(count, "code long, n long"), 2 * size) / UNIT
    # Both kinds get the same share of the corpus, so that 4-grams that neither has say nothing.
    prior = PRIOR_ROWS / min(positive, negative) * (counts + 1e-9) / (counts + 1e-9).sum()
    return np.log((found[size:] / positive + prior) / (found[:size] / negative + prior)).astype(np.float32)


def weak_evidence(column: pa.Array, ratios: np.ndarray) -> np.ndarray:
    """Mean log ratio of each text's 4-grams, within the bound; 0 for texts without any."""
    raw, offsets = text_buffer(column)
    out = np.zeros(len(column))
    for i, j in slices(offsets, 1 << 20):
        sums = np.zeros(j - i)
        for a in range(int(offsets[i]), int(offsets[j]), 1 << 20):
            value = ratios[_codes(raw[a : min(a + (1 << 20) + ORDER - 1, int(offsets[j]))])]
            # 4-grams that run into the next text are left out.
            until = np.clip(np.maximum(offsets[i + 1 : j + 1] - ORDER + 1, offsets[i:j]) - a, 0, len(value))
            run = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
            sums += run[until] - run[np.minimum(np.clip(offsets[i:j] - a, 0, len(value)), until)]
        out[i:j] = sums / np.maximum(np.diff(offsets[i : j + 1]) - ORDER + 1, 1)
    return np.clip(out, -WEAK, WEAK)


class CharacterModel:
    """Log probability of a character after the three before it, smoothed by shorter contexts."""

    def __init__(self, counts: np.ndarray) -> None:
        n = 1 << LETTER
        four = counts.reshape(n, n, n, n).astype(np.float64)
        smooth = np.full(n, 1 / 28)
        for level in (four.sum((0, 1, 2)), four.sum((0, 1)), four.sum(0), four):
            smooth = (level + 4.0 * smooth) / (level.sum(-1, keepdims=True) + 4.0)
        self.log = array("f", np.log(smooth).astype(np.float32).tobytes())

    def restore(self, token: str, spaced: bool = False) -> list[str]:
        """Likely words behind a token of ASCII letters, digits and imitating signs, or texts of words behind a ``spaced`` one; the best first."""
        log = self.log
        # By the last three symbols: the best few (cost, word as a chain of its letters).
        states: dict[int, list[tuple]] = {0: [(0.0, None)]}
        previous = ""
        for c in token.lower():
            plain = "a" <= c <= "z"
            if not plain and c not in LEET:
                continue  # a separator of single letters
            options = [(c, 0.0)] if plain else [(o, SUBSTITUTED) for o in LEET[c]]
            if spaced:  # a word may end here
                for context, ways in list(states.items()):
                    extra = log[context << LETTER]
                    ended = [(cost - extra, (word, " ")) for cost, word in ways if word and word[1] != " "]
                    if ended:
                        states.setdefault((context << LETTER) & CONTEXT, []).extend(ended)
            fresh: dict = {}
            for context, ways in states.items():
                for cost, word in _best(ways):
                    if word and word[1] != " " and c == previous:  # the character repeats the one before
                        fresh.setdefault(context, []).append((cost + REPEATED, word))
                    elif c in "!|+$":  # plain punctuation
                        fresh.setdefault(context, []).append((cost + DROPPED, word))
                    for o, extra in options:
                        s = (context << LETTER) | (ord(o) - 96)
                        fresh.setdefault(s & CONTEXT, []).append((cost + extra - log[s], (word, o)))
            states, previous = {context: _best(ways) for context, ways in fresh.items()}, c
        ends = sorted([(cost - log[context << LETTER], word) for context, ways in states.items() for cost, word in ways], key=lambda x: x[0])
        texts = []
        for cost, word in ends[:WAYS]:
            if cost <= ends[0][0] + MARGIN:
                letters = []
                while word:
                    word, o = word
                    letters.append(o)
                texts.append("".join(reversed(letters)).strip())
        return list(dict.fromkeys(texts))


def _best(ways: list[tuple]) -> list[tuple]:
    return ways if len(ways) == 1 else sorted(ways, key=lambda x: x[0])[:WAYS]


class Deobfuscator:
    """Finds disguised tokens in a byte buffer and restores them."""

    def __init__(self, model: CharacterModel) -> None:
        self.model, self.known = model, {}
        code = np.arange(256)
        self.letter = ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122))
        self.sign = np.isin(code, [ord(c) for c in LEET])

    def joined(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts and ends of the disguised tokens without gaps; ``offsets`` bound the rows."""
        if len(raw) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        letter, sign = self.letter[raw], self.sign[raw]
        member = letter | sign
        lower = np.where(letter, raw | 32, raw)
        mark = (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:]) | (letter[:-1] & (lower[:-1] == lower[1:]))
        begin, end = _runs(member, offsets)
        chosen = np.unique(np.searchsorted(begin, np.flatnonzero(mark), "right") - 1)
        return begin[chosen], end[chosen]

    def spaced(self, raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts and ends of the runs of three or more single letters or signs."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        word = is_word[raw]
        # Punctuation of two and three bytes parts letters, as ASCII punctuation does.
        two = np.flatnonzero(raw[:-1] == 0xC2)
        three = np.flatnonzero((raw[:-2] == 0xE2) & ((raw[1:-1] == 0x80) | (raw[1:-1] == 0x81)))
        for at in (two, two + 1, three, three + 1, three + 2):
            word[at] = False
        begin, end = _runs(word, offsets)
        lone = begin[(end - begin == 1) & (self.letter | self.sign)[raw[begin]]]
        if not len(lone):
            return none
        long = word.copy()
        long[lone] = False
        sign = self.sign[raw] & ~word
        beside = np.zeros(len(raw), bool)
        beside[1:] |= long[:-1]
        beside[:-1] |= long[1:]
        at = np.union1d(lone, np.flatnonzero(sign & ~beside))
        passed = np.cumsum(long)
        row = np.searchsorted(offsets, at, "right")
        near = (np.diff(at) <= GAP + 1) & (passed[at[1:]] == passed[at[:-1]]) & (row[1:] == row[:-1])
        first = np.flatnonzero(np.concatenate([[True], ~near]))
        last = np.append(first[1:], len(at)) - 1
        letters = np.concatenate([[0], np.cumsum(self.letter[raw[at]])])
        runs = (last - first >= 2) & (letters[last + 1] > letters[first])
        return at[first[runs]], at[last[runs]] + 1

    def restore(self, token: str, spaced: bool) -> str:
        """The words that may be behind a token, but itself."""
        found = self.known.get((token, spaced))
        if found is None:
            texts = self.model.restore(token, spaced)
            if spaced:  # the letters may also be one word, as they stand or restored
                texts += ["".join(c for c in token.lower() if "a" <= c <= "z"), *self.model.restore(token)]
            found = " ".join(dict.fromkeys(w for text in texts for w in text.split() if w != token.lower()))
            if len(token) <= REMEMBERED_LENGTH:
                if len(self.known) >= RESTORED:
                    self.known.clear()
                self.known[token, spaced] = found
        return found


def _runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; runs end at row ends."""
    start, end = member.copy(), member.copy()
    start[1:] &= ~member[:-1]
    end[:-1] &= ~member[1:]
    firsts, lasts = offsets[:-1][offsets[:-1] < len(member)], offsets[1:][offsets[1:] > 0] - 1
    start[firsts], end[lasts] = member[firsts], member[lasts]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def text_features(column: pa.Array, hasher: WordHasher, deobfuscator: Deobfuscator, keys: np.ndarray | None = None, keep: bool = False) -> Iterator[tuple[int, np.ndarray, list]]:
    """(row, distinct feature hashes, [(token, restored)]) of each text; with sorted ``keys`` the features' places among
    them instead, tokens only with ``keep``."""
    raw_all, offsets_all = text_buffer(column)
    for i, j in slices(offsets_all, 1 << 20):
        raw, offsets = raw_all[offsets_all[i] : offsets_all[j]], offsets_all[i : j + 1] - offsets_all[i]
        starts, ends, bounds = hasher.spans(raw, offsets)
        features, owners = _hashed(raw, starts, ends, hasher)
        rows = [np.searchsorted(bounds, owners, "right") - 1]
        restored: dict[int, list] = {}
        for spaced in (False, True):
            begin, end = deobfuscator.spaced(raw, offsets, hasher.is_word) if spaced else deobfuscator.joined(raw, offsets)
            if not len(begin):
                continue
            # Each distinct token is restored and hashed once.
            _, first, token = np.unique(hasher.hashes(raw, begin, end), return_index=True, return_inverse=True)
            found = [deobfuscator.restore(bytes(raw[begin[k] : end[k]]).decode("utf-8", "replace"), spaced) for k in first]
            row = np.searchsorted(offsets, begin, "right") - 1
            if keep:
                for k in np.flatnonzero(np.array([bool(w) for w in found])[token]):
                    seen = bytes(raw[begin[k] : end[k]]).decode("utf-8", "replace")
                    restored.setdefault(int(row[k]), []).extend([(seen, w) for w in found[token[k]].split()])
            words = np.frombuffer("".join(found).encode(), np.uint8)
            ends = np.concatenate([[0], np.cumsum([len(w) for w in found])])
            s, e, firsts = hasher.spans(words, ends)
            more, owners = _hashed(words, s, e, hasher)
            of = np.searchsorted(firsts, owners, "right") - 1
            order = np.argsort(of, kind="stable")
            cut = np.searchsorted(of[order], np.arange(len(found) + 1))
            pair = np.unique((row.astype(np.int64) << 32) | token)
            at = pair & 0xFFFFFFFF
            n = cut[at + 1] - cut[at]
            features = np.concatenate([features, more[order][np.repeat(cut[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]])
            rows.append(np.repeat(pair >> 32, n))
        owner = np.concatenate(rows)
        if keys is not None:
            features, hit = _places(features, keys)
            owner = owner[hit]
        order = np.lexsort((features, owner))
        features, owner = features[order], owner[order]
        new = np.ones(len(owner), bool)
        new[1:] = (features[1:] != features[:-1]) | (owner[1:] != owner[:-1])
        features, owner = features[new], owner[new]
        cuts = np.searchsorted(owner, np.arange(j - i + 1))
        for row in range(j - i):
            yield i + row, features[cuts[row] : cuts[row + 1]], restored.get(row, [])


def _places(features: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places among the sorted ``keys`` of the features that are there, and which these are."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(keys, features)
    hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == features)
    return at[hit], hit


def _hashed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of their longer beginnings, and the word each belongs to."""
    parts, owners = [hasher.hashes(raw, starts, ends)], [np.arange(len(starts))]
    for k in PREFIXES:
        longer = np.flatnonzero(ends - starts > k)
        parts.append(hasher.hashes(raw, starts[longer], starts[longer] + k) + np.uint64(k))
        owners.append(longer)
    return np.concatenate(parts), np.concatenate(owners)


def held_out(doc_id):
    """Whether a document is kept from the learner: one in five, by its id; null ids are."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(True))


def fit(
    documents: DataFrame, labels: DataFrame, counts: Broadcast, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE
) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Sorted feature hashes, their weights, the constant and the log ratios of 4-grams, learnt from at most about ``sample`` labelled rows.

    ``counts`` is :func:`shared_counts` of the corpus.
    """
    spark, shared = documents.sparkSession, counts
    usable = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    n = usable.count()
    share = min(1.0, sample / max(n, 1))
    # A sample by the id's hash: the same rows on every run; its size is bounded, so it may be broadcast.
    chosen = usable.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, deobfuscator = WordHasher(), _deobfuscator(shared.value)
        for batch in batches:
            rows = [f for _, f, _ in text_features(batch.column(2), hasher, deobfuscator)]
            columns = [
                batch.column(0), batch.column(1), pa.array([f.view(np.int64) for f in rows], pa.list_(pa.int64())),
                pa.array([_signature(f).view(np.int64) for f in rows], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "y", "features", "signature"])

    ident = usable.schema["id"].dataType.simpleString()
    every = durable(
        documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select("id", "y", "text")
        .mapInArrow(run, f"id {ident}, y int, features array<long>, signature array<long>"),
        "toxic-sample",
    )
    rows = every.select("id", "y", "features", F.xxhash64("signature").alias("copy"))
    # Rows with the same or nearly the same features and the same label count together as one row.
    kinds_of = every.select("y", F.xxhash64("signature").alias("copy"), "signature").groupBy("y", "copy").agg(F.count("*").alias("n"), F.first("signature").alias("signature")).orderBy("y", "copy").toArrow()
    shares = _shares(kinds_of)
    rows = durable(rows.join(F.broadcast(spark.createDataFrame(shares, "y int, copy long, share double")), ["y", "copy"]).drop("copy"), "toxic-sample")
    kinds = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.sum("share").alias("n")).collect()}
    positive, negative = sum(v for k, v in kinds.items() if k > 0), sum(v for k, v in kinds.items() if k <= 0)
    if not positive or not negative:
        return np.zeros(0, np.uint64), np.zeros(0, np.float32), -math.inf, np.zeros(1 << (LETTER * ORDER), np.float32)
    base = positive / (positive + negative)
    seen = durable(
        rows.select("y", "share", F.explode("features").alias("f")).groupBy("f")
        .agg(F.sum(F.when(F.col("y") > 0, F.col("share")).otherwise(0.0)).alias("p"), F.sum("share").alias("n")).filter("p > 0"),
        "toxic-features",
    )
    # Signed root of the surplus of positives: features with a chance surplus stay below the bar. The root says little of
    # fewer than four positives: these need Chernoff's bound on the chance of such a surplus among all features tried.
    z = (F.col("p") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
    part = F.least(F.col("p") / F.col("n"), F.lit(1.0))
    surplus = F.col("p") * F.log(part / base) + F.when(part < 1, (F.col("n") - F.col("p")) * F.log((1 - part) / (1 - base))).otherwise(0.0)
    bar = math.log(max(seen.count(), 1))
    keys = np.sort(seen.filter((F.col("p") > 3.999) & (z > 5) | (part > base) & (surplus > bar)).select("f").toArrow().column("f").to_numpy().view(np.uint64))
    known = spark.sparkContext.broadcast(keys)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_places(np.array(f, np.int64).view(np.uint64), known.value)[0] for f in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], ["id", "y", "share", "f"])

    data = rows.select("id", "y", "share", "features").mapInArrow(place, f"id {ident}, y int, share double, f array<long>").orderBy("id").toArrow()
    counts_of = np.array([len(f) for f in data.column("f").to_pylist()], np.int64)
    at = np.array([k for f in data.column("f").to_pylist() for k in f], np.int64)
    y = (data.column("y").to_numpy() > 0).astype(np.float64)
    w, b = _logistic(np.repeat(np.arange(len(y)), counts_of), at, len(keys), y, data.column("share").to_numpy())
    known.unpersist()
    texts = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(rows.select("id", "y", "share").distinct()), "id")
    return keys, w, b, _log_ratios(texts.select("text", "y", "share"), counts.value["counts"], float(positive), float(negative))


def _signature(features: np.ndarray) -> np.ndarray:
    """Minima of the features under fixed permutations."""
    if not len(features):
        return np.zeros(SIGNATURE, np.uint64)
    return np.array([mix(features ^ mix(np.array([k + 1], np.uint64))).min() for k in range(SIGNATURE)], np.uint64)


def _shares(signatures: pa.Table) -> pd.DataFrame:
    """(y, copy, share): one over the rows of the near copies of (y, copy), which has ``n`` rows with one signature."""
    y, n = signatures.column("y").to_numpy(), signatures.column("n").to_numpy()
    minima = np.array(signatures.column("signature").to_pylist(), np.int64).reshape(len(y), SIGNATURE)
    parent = list(range(len(y)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for band in np.split(minima, BANDS, axis=1):
        first: dict[tuple, int] = {}
        for k, key in enumerate(map(tuple, band.tolist())):
            other = first.setdefault((y[k], *key), k)
            if other != k and (minima[k] == minima[other]).mean() >= ALIKE:
                parent[root(k)] = root(other)
    group = np.array([root(k) for k in range(len(y))], np.int64)
    total = np.bincount(group, weights=n, minlength=len(y)) if len(y) else np.zeros(0)
    return pd.DataFrame({"y": y.astype(np.int32), "copy": signatures.column("copy").to_numpy(), "share": 1.0 / total[group] if len(y) else np.zeros(0)})


def _logistic(rows: np.ndarray, columns: np.ndarray, width: int, y: np.ndarray, share: np.ndarray, penalty: float = 0.2, centre: float = 0.7, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Logistic regression by projected Newton steps, each solved by conjugate gradients; the constant is not penalised.

    Row ``rows[k]`` has feature ``columns[k]``; a row counts ``share`` times.
    Words that mostly come together would share one word's weight, and one alone would not be enough. So the ridge
    pulls a weight towards ``centre`` times the log odds of its feature alone, and no weight is negative, as
    features are chosen for their surplus of positives.
    """
    positive, negative = float(share @ y), float(share @ (1 - y))
    p = np.bincount(columns, (share * y)[rows], width) + 1.0
    n = np.bincount(columns, (share * (1 - y))[rows], width) + 1.0
    goal = np.append(np.maximum(centre * np.log(p / (positive + 2) / (n / (negative + 2))), 0), 0)
    ridge = np.full(width + 1, penalty)
    ridge[-1] = 1e-6
    least = np.zeros(width + 1)
    least[-1] = -np.inf

    def times(beta: np.ndarray) -> np.ndarray:
        return np.bincount(rows, beta[columns], len(y)) + beta[-1]

    def back(values: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(columns, values[rows], width), values.sum())

    def loss(beta: np.ndarray) -> float:
        t = times(beta)
        return float(share @ (np.logaddexp(0, t) - y * t) + 0.5 * (ridge * (beta - goal) ** 2).sum())

    beta = goal.copy()
    beta[-1] = math.log(positive / negative)
    now = loss(beta)
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-np.clip(times(beta), -30, 30)))
        gradient = ridge * (beta - goal) - back(share * (y - chance))
        free = (beta > least) | (gradient < 0)
        curve = share * chance * (1 - chance)
        scale = np.where(free, ridge + back(curve), 1.0)
        # Conjugate gradients over the free weights, scaled by the diagonal.
        step, rest = np.zeros_like(beta), np.where(free, gradient, 0.0)
        way = scaled = rest / scale
        size, enough = rest @ scaled, 1e-16 * (rest @ rest)
        for _ in range(10 * (width + 1)):
            if rest @ rest <= enough:
                break
            bent = np.where(free, ridge * way + back(curve * times(way)), 0.0)
            length = size / (way @ bent)
            step, rest = step + length * way, rest - length * bent
            scaled = rest / scale
            size, before = rest @ scaled, size
            way = scaled + size / before * way
        size = 1.0
        while (then := loss(moved := np.maximum(beta - size * step, least))) > now and size > 1e-6:
            size /= 2
        if then > now or np.abs(moved - beta).max() < 1e-6:
            break
        beta, now = moved, then
    return beta[:-1].astype(np.float32), float(beta[-1])


def _deobfuscator(state: dict) -> Deobfuscator:
    if "deobfuscator" not in state:
        state["deobfuscator"] = Deobfuscator(CharacterModel(state["counts"]))
    return state["deobfuscator"]


def shared_counts(documents: DataFrame, text: str = "text") -> Broadcast:
    """The corpus's 4-gram counts for all tasks; a worker process builds one language model of them."""
    return documents.sparkSession.sparkContext.broadcast({"counts": count_ngrams(documents, text)})


def _scorer(documents: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample: int, keep: bool = False):
    """A function from a string column to (scores, restored tokens), to be called in tasks."""
    bound_batches(documents.sparkSession)
    counts = shared_counts(documents, text)
    keys, weights, constant, ratios = fit(documents, labels, counts, doc_id, text, label, sample)
    learnt = documents.sparkSession.sparkContext.broadcast({"keys": keys, "weights": weights, "constant": constant, "ratios": ratios})

    def score(column: pa.Array, hasher: WordHasher) -> tuple[list[float], list[list]]:
        state, scores, restored = learnt.value, [], []
        weak = weak_evidence(column, state["ratios"])
        for row, features, found in text_features(column, hasher, _deobfuscator(counts.value), state["keys"], keep):
            total = float(state["weights"][features].sum(dtype=np.float64)) + float(weak[row]) + state["constant"]
            scores.append(1 / (1 + math.exp(-total)) if total > -700 else 0.0)
            restored.append(found)
        return scores, restored

    return score


def toxicity(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, keep: bool = False
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document; with ``keep`` also its ``restored`` tokens."""
    score = _scorer(documents, labels, doc_id, text, label, sample, keep)
    ident = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            scores, restored = score(batch.column(2), hasher)
            columns = [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            names = ["doc_id", "held_out", "score", "predicted"]
            if keep:
                columns.append(pa.array([[{"token": t, "word": w} for t, w in r] for r in restored], pa.list_(pa.struct([("token", pa.string()), ("word", pa.string())]))))
                names.append("restored")
            yield pa.RecordBatch.from_arrays(columns, names)

    return documents.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {ident}, held_out boolean, score double, predicted int" + ", restored array<struct<token:string,word:string>>" * keep
    )


def remove_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """``documents`` that score below ``threshold``, with all their columns."""
    score, at = _scorer(documents, labels, doc_id, text, label, sample), documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            yield batch.filter(pa.array([s < threshold for s in score(batch.column(at), hasher)[0]], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
