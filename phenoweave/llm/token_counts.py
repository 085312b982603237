"""Token counts of a byte-level BPE vocabulary with a whole-token shortcut.

Offline, every vocabulary string is checked: it must be a single pre-token, and
its own merges must end in itself. A pre-token that is such a string counts one
token without any merging; only the others are merged, once per distinct
pre-token while a bounded cache has room. Special strings inside a text are one
token each and cut the text, as the library does by default.

Defined cases: a null or empty text has no tokens and no bytes; repeated rows are
counted alike; extra columns are not looked at.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from phenoweave.llm.merging import MergeTable

# Fixed value: the pre-token pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Merged pre-tokens remembered by one worker process; longer ones are never remembered.
CACHE, CACHED_LENGTH = 400_000, 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary's strings."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (chr(256 + i) for i in range(256))
    return [chr(b) if b in plain else next(others) for b in range(256)]


def prove_whole_tokens(spec: dict) -> tuple[set[str], dict[tuple[int, int], tuple[int, int]], list[int]]:
    """Vocabulary strings (as text) that encode alone as one token, the merges and each byte's symbol."""
    import regex

    vocab, letters = spec["model"]["vocab"], byte_letters()
    pairs = {}
    for rank, m in enumerate(spec["model"]["merges"]):
        a, b = m if isinstance(m, list) else m.split(" ")
        pairs[(vocab[a], vocab[b])] = (rank, vocab[a + b])
    byte_of, pattern = {c: b for b, c in enumerate(letters)}, regex.compile(PATTERN)
    candidates = []
    for piece, i in vocab.items():
        try:
            text = bytes(byte_of[c] for c in piece).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if pattern.findall(text) == [text]:
            candidates.append((text, i, [vocab[c] for c in piece]))
    merged = MergeTable(pairs).merge([c[2] for c in candidates])
    return {text for (text, i, _), m in zip(candidates, merged) if m == [i]}, pairs, [vocab[c] for c in letters]


class TokenCounter:
    """Counts tokens of whole texts."""

    def __init__(self, whole: set[str], pairs: dict, symbols: list[int], specials: list[str]) -> None:
        import regex

        self.table, self.symbols, self.n_whole = MergeTable(pairs), symbols, len(whole)
        self.counts = dict.fromkeys(whole, 1)
        self.find = regex.compile(PATTERN).findall
        # The longest of several special strings at a place wins.
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        counts = self.counts
        if len(counts) > CACHE + self.n_whole:  # forget the oldest merged pre-tokens
            for t in list(itertools.islice(counts, self.n_whole, self.n_whole + CACHE // 2)):
                del counts[t]
        totals, rows = [], []
        for text in texts:
            parts = self.cut.split(text) if self.cut is not None and self.cut.search(text) else [text]
            totals.append(len(parts) - 1)
            rows.append([t for p in parts for t in self.find(p)] if len(parts) > 1 else self.find(text))
        new = list(dict.fromkeys([t for tokens in rows for t in tokens if t not in counts]))
        symbols = self.symbols
        for t, merged in zip(new, self.table.merge([[symbols[b] for b in t.encode()] for t in new])):
            counts[t] = len(merged)
        totals = [n + sum(map(counts.__getitem__, tokens)) for n, tokens in zip(totals, rows)]
        for t in new:
            if len(t) > CACHED_LENGTH:
                del counts[t]
        return totals


def count_tokens(documents: DataFrame, tokenizer_json: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each document.

    ``tokenizer_json`` is the content of the vocabulary file: its strings are proved
    on the driver (a fixed number) and sent along.
    """
    spec = json.loads(tokenizer_json)
    whole, pairs, symbols = prove_whole_tokens(spec)
    specials = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
    if any(t[k] for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("special strings that take their surroundings along are not handled")
    shared = documents.sparkSession.sparkContext.broadcast({"parts": (whole, pairs, symbols, specials)})
    ident = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value
        if "counter" not in state:
            state["counter"] = TokenCounter(*state["parts"])
        counter = state["counter"]
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, 256):
                batch = whole_batch.slice(start, 256)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                tokens = counter.count(texts)
                columns = [
                    batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {ident}, n_bytes long, n_tokens long, over_limit boolean"
    )
