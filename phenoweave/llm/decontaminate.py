"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Items are cut into windows of ``n`` consecutive words (a shorter item with at
least one word is one window). Document windows are looked up by hash; hits are
verified word by word before they count.

Defined cases: null or word-free texts have no words and no hits; a null item id
is named ``null``; items without words never hit; repeated items and documents
count like any other; an empty benchmark hits nothing. Extra columns are ignored
by :func:`contamination` and passed through by :func:`remove_contaminated`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from phenoweave.llm.words import WordHasher, rows_to_batch, slices, text_buffer, window_hashes, windows_of_rows
from phenoweave.session import durable

#: Distinct (window, item) pairs in one broadcast: some 100 bytes each.
WINDOWS_PER_BLOCK = 400_000
WINDOW_SCHEMA = "item string, length int, words string"
SPANS = "array<struct<first:long,length:int,item:string>>"


def item_windows(benchmark: DataFrame, n: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item, length, words) windows; words are lower-cased and joined by spaces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("item", pa.string()), ("length", pa.int32()), ("words", pa.string())])
        hasher = WordHasher()
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            names = batch.column(0).to_pylist()
            starts, ends, bounds = hasher.spans(raw, offsets)
            for row, name in enumerate(names):
                words = [bytes(raw[s:e]).lower().decode() for s, e in zip(starts[bounds[row] : bounds[row + 1]], ends[bounds[row] : bounds[row + 1]])]
                length = min(n, len(words))
                if length:
                    found = sorted({" ".join(words[i : i + length]) for i in range(len(words) - length + 1)})
                    for i in range(0, len(found), 10_000):
                        part = found[i : i + 10_000]
                        yield rows_to_batch(schema, [[name] * len(part), [length] * len(part), part])

    named = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text"))
    return named.mapInArrow(cut, WINDOW_SCHEMA).distinct()


def _blocks(benchmark: DataFrame, n: int, item_id: str, text: str, per_block: int) -> Iterator[tuple[object, bool]]:
    """Broadcast n-gram sets of bounded size that together hold every window, each fetched when asked for, and whether it is the last."""
    spark = benchmark.sparkSession
    windows = durable(item_windows(benchmark, n, item_id, text), "benchmark-windows")
    count = max(1, math.ceil(windows.count() / per_block))
    for i in range(count):
        rows = windows.filter(F.pmod(F.xxhash64("item", "words"), F.lit(count)) == i).toArrow()
        yield spark.sparkContext.broadcast({"table": rows}), i == count - 1


def _index(shared: dict) -> dict[int, tuple]:
    """Per window length: sorted hashes, and the words and item of each; built once per worker process."""
    if "index" not in shared:
        table, hasher, index = shared["table"], WordHasher(), {}
        lengths = table.column("length").to_numpy()
        for length in np.unique(lengths):
            part = table.filter(pa.array(lengths == length)).combine_chunks()
            raw, offsets = text_buffer(part.column("words").combine_chunks() if isinstance(part.column("words"), pa.ChunkedArray) else part.column("words"))
            starts, ends, bounds = hasher.spans(raw, offsets)
            words = hasher.hashes(raw, starts, ends)
            keys = np.concatenate([window_hashes(words[a:b], int(length)) for a, b in zip(bounds, bounds[1:])])
            order = np.argsort(keys, kind="stable")
            index[int(length)] = (keys[order], part.column("words").to_pylist(), part.column("item").to_pylist(), order)
        shared["index"] = index
    return shared["index"]


def find_spans(column: pa.Array, shared: dict, hasher: WordHasher) -> Iterator[tuple[int, int, list]]:
    """(row, number of words, verified [(first word, length, item)]) of each text."""
    index = _index(shared)
    raw_all, offsets_all = text_buffer(column)
    for i, j in slices(offsets_all, 1 << 20):
        raw = raw_all[offsets_all[i] : offsets_all[j]]
        offsets = offsets_all[i : j + 1] - offsets_all[i]
        starts, ends, bounds = hasher.spans(raw, offsets)
        words = hasher.hashes(raw, starts, ends)
        found: dict[int, list] = {}
        for length, (keys, texts, items, order) in index.items():
            hashes, first, rows = windows_of_rows(words, bounds, length)
            lo = np.searchsorted(keys, hashes, "left")
            hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == hashes) if len(keys) else []
            for k in hit:
                f, row = int(first[k]), int(rows[k])
                actual = b" ".join(bytes(raw[s:e]) for s, e in zip(starts[f : f + length], ends[f : f + length])).lower().decode()
                at = int(lo[k])
                while at < len(keys) and keys[at] == hashes[k]:
                    if texts[order[at]] == actual:
                        found.setdefault(row, []).append((f - int(bounds[row]), length, items[order[at]]))
                    at += 1
        for row in range(j - i):
            yield i + row, int(bounds[row + 1] - bounds[row]), found.get(row, [])


def _covered(spans: list) -> int:
    """Words inside any of the (first, length, ...) spans."""
    total, reach = 0, 0
    for first, length in sorted({(s[0], s[1]) for s in spans}):
        total += max(0, first + length - max(first, reach))
        reach = max(reach, first + length)
    return total


def contamination(
    documents: DataFrame, benchmark: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", windows_per_block: int = WINDOWS_PER_BLOCK,
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated) of each document.

    A benchmark whose windows exceed one broadcast is scanned in blocks; the hits of
    earlier blocks travel with the documents.
    """
    ident = documents.schema[doc_id].dataType.simpleString()
    current, last = _collect_spans(
        documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", benchmark, n, item_id, item_text, windows_per_block
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _with_spans(batches, 1, last):
            counts, rows = [f[0] for f in found], [f[1] for f in found]
            hit = [_covered(r) for r in rows]
            items = [sorted({s[2] for s in r}) for r in rows]
            columns = [
                batch.column(0), pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                pa.array(items, pa.list_(pa.string())), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                pa.array([h > 0 for h in hit], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"])

    return current.mapInArrow(
        finish, f"doc_id {ident}, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean"
    )


def _with_spans(batches: Iterator[pa.RecordBatch], at: int, block) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches with (number of words, spans of all blocks so far) per row; the last column holds earlier blocks' spans."""
    hasher = WordHasher()
    for batch in batches:
        before = batch.column(batch.num_columns - 1).to_pylist()
        yield batch, [
            (count, [(s["first"], s["length"], s["item"]) for s in before[row] or ()] + spans)
            for row, count, spans in find_spans(batch.column(at), block.value, hasher)
        ]


def _collect_spans(
    documents: DataFrame, text: str, benchmark: DataFrame, n: int, item_id: str, item_text: str, per_block: int
) -> tuple[DataFrame, object]:
    """``documents`` plus a last column with the spans of all blocks but one, and that last block."""
    name = "spans"
    while name in documents.columns:
        name += "_"
    at = documents.columns.index(text)
    current = documents.withColumn(name, F.lit(None).cast(SPANS))

    def gather(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, found in _with_spans(batches, at, block):
                spans = [[{"first": a, "length": b, "item": c} for a, b, c in f[1]] for f in found]
                columns = [*batch.columns[:-1], pa.array(spans, batch.schema.field(batch.num_columns - 1).type)]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        return run

    for block, last in _blocks(benchmark, n, item_id, item_text, per_block):
        if last:
            break
        current = durable(current.mapInArrow(gather(block), current.schema), "decontaminate")
        block.destroy()  # its hits are written
    return current, block


def remove_contaminated(
    documents: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "document", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", windows_per_block: int = WINDOWS_PER_BLOCK,
) -> DataFrame:
    """``documents`` without contaminated rows (``mode='document'``) or without the hit words (``'span'``).

    A removed span takes the separators behind it along. Columns stay as they are.
    """
    if mode not in ("document", "span"):
        raise ValueError(f"unknown mode: {mode}")
    at = documents.columns.index(text)
    current, last = _collect_spans(documents, text, benchmark, n, item_id, item_text, windows_per_block)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch, found in _with_spans(batches, at, last):
            columns = list(batch.columns[:-1])
            schema = pa.schema(list(batch.schema)[:-1])
            if mode == "span":
                texts = columns[at].to_pylist()
                for row, (_, spans) in enumerate(found):
                    if spans:
                        texts[row] = _cut(texts[row], spans, hasher)
                columns[at] = pa.array(texts, schema.field(at).type)
            out = pa.RecordBatch.from_arrays(columns, schema=schema)
            yield out if mode == "span" else out.filter(pa.array([not spans for _, spans in found], pa.bool_()))

    return current.mapInArrow(clean, documents.schema)


def _cut(text: str, spans: list, hasher: WordHasher) -> str:
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = hasher.spans(raw, np.array([0, len(raw)]))
    keep, reach = [], 0
    for first, length in sorted({(s[0], s[1]) for s in spans}):
        begin = int(starts[first])
        if begin > reach:
            keep.append(bytes(raw[reach:begin]))
        after = first + length
        reach = max(reach, int(starts[after]) if after < len(starts) else int(ends[-1]))
    keep.append(bytes(raw[reach:]))
    return b"".join(keep).decode()
