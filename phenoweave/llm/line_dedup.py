"""Removal of lines that many documents share, by a sharded minimal perfect hash.

Distinct line hashes with their document counts go to shards; each shard becomes a
minimal perfect hash with arrays of fingerprints, counts and keepers. Documents
probe the arrays. Small arrays are broadcast and probed while the texts are read;
larger ones stay where they are, and only the hashes of lines travel to them,
dealt out over several copies of a shard so that no line is hot.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z
lower-cased. Keys of at least ``least_chars`` code points in at least
``least_docs`` rows lose all their lines but those of the largest id. Fingerprint
and index hash are 64 bits each, so unequal lines do not meet in practice.

Defined cases: a null or empty text is one empty line and stays as it is; rows
with a null id keep no shared line, unless all rows of the line have null ids
(then all keep it); rows that repeat an id count as documents of their own and
are treated alike; extra columns are kept by :func:`remove_shared_lines`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from phenoweave.session import durable

SPACE = " \t\n\x0b\x0c\r"
KEYS_PER_SHARD, LEAST_SHARDS = 50_000, 64
#: Arrays up to this size are broadcast to the documents' tasks.
BROADCAST_BYTES = 48 << 20
COPIES = 16  # of each shard, where line hashes travel
GAMMA, LEVELS = 2.0, 40


def line_hash(line: str, least: int) -> tuple[int, int] | None:
    """Index hash and fingerprint of a line's key; None for keys that are too short."""
    key = line.strip(SPACE)
    if len(key) < least:
        return None
    digest = hashlib.blake2b(key.encode().lower(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    h = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bits, each key alone at its bit in one level."""

    def __init__(self, bits: list[np.ndarray]) -> None:
        self.bits = bits
        self.before, total = [], 0
        for level in bits:
            sums = np.cumsum(np.unpackbits(level).astype(np.int64)) if len(level) else np.zeros(0, np.int64)
            self.before.append(sums + total)
            total += int(sums[-1]) if len(sums) else 0
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        bits, left = [], keys.astype(np.uint64)
        while len(left):
            if len(bits) == LEVELS:
                raise ValueError("keys are not distinct")
            size = (int(GAMMA * len(left)) + 64) // 8 * 8
            at = (_mix(left, len(bits)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(np.packbits(alone))
            left = left[~alone[at]]
        return cls(bits)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key (0 .. size - 1); of keys outside the set -1 or any number."""
        out = np.full(len(keys), -1, np.int64)
        left, keys = np.arange(len(keys)), keys.astype(np.uint64)
        for level, (bits, sums) in enumerate(zip(self.bits, self.before)):
            if not len(left):
                break
            at = (_mix(keys[left], level) % np.uint64(len(bits) * 8)).astype(np.int64)
            hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            out[left[hit]] = sums[at[hit]] - 1
            left = left[~hit]
        return out


def pack_shard(index: np.ndarray, fingerprint: np.ndarray, count: np.ndarray, keeper: np.ndarray, has_keeper: np.ndarray) -> bytes:
    """Perfect hash bits and the arrays in its order."""
    table = PerfectHash.build(index.view(np.uint64))
    place = table.index(index.view(np.uint64))
    arrays = [np.empty_like(a) for a in (fingerprint, count, keeper, has_keeper)]
    for out, values in zip(arrays, (fingerprint, count, keeper, has_keeper)):
        out[place] = values
    head = np.array([len(index), len(table.bits), *[len(b) for b in table.bits]], np.int64)
    return head.tobytes() + b"".join(b.tobytes() for b in table.bits) + b"".join(a.tobytes() for a in arrays)


class Shard:
    """A packed shard, ready to be probed."""

    def __init__(self, data: bytes) -> None:
        n, levels = np.frombuffer(data, np.int64, 2)
        sizes = np.frombuffer(data, np.int64, levels, 16)
        at, bits = 16 + 8 * int(levels), []
        for size in sizes:
            bits.append(np.frombuffer(data, np.uint8, int(size), at))
            at += int(size)
        self.table = PerfectHash(bits)
        self.fingerprint = np.frombuffer(data, np.int64, n, at)
        self.count = np.frombuffer(data, np.int32, n, at + 8 * n)
        self.keeper = np.frombuffer(data, np.int64, n, at + 12 * n)
        self.has_keeper = np.frombuffer(data, np.bool_, n, at + 20 * n)

    def drops(self, index: np.ndarray, fingerprint: np.ndarray, ids: np.ndarray, has_id: np.ndarray) -> np.ndarray:
        """Which (line, document) pairs lose the line."""
        at = self.table.index(index.view(np.uint64))
        known = at >= 0
        at = np.maximum(at, 0)
        known &= self.fingerprint[at] == fingerprint
        kept = np.where(self.has_keeper[at], has_id & (self.keeper[at] == ids), ~has_id)
        return known & ~kept


def shared_lines(documents: DataFrame, least_chars: int = 40, least_docs: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(index, fingerprint, n, keeper): distinct line keys in at least ``least_docs`` rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                ids, first, second = [], [], []
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = {h for line in (t or "").split("\n") if len(line) >= least_chars and (h := line_hash(line, least_chars))}
                    ids.extend([i] * len(found))
                    first.extend([h[0] for h in found])
                    second.extend([h[1] for h in found])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64())], ["id", "index", "fingerprint"])

    lines = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(cut, "id long, index long, fingerprint long")
    return lines.groupBy("index", "fingerprint").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= least_docs)


def build_shards(lines: DataFrame) -> tuple[DataFrame, int]:
    """One row (shard, data) per shard of ``lines``, and the number of shards."""
    lines = durable(lines, "shared-lines")
    shards = max(LEAST_SHARDS, -(-lines.count() // KEYS_PER_SHARD))

    def pack(key, table):
        # Index hashes that collide under different fingerprints: the fingerprint joins the index.
        column = lambda n, kind: table.column(n).to_numpy().astype(kind)
        keeper = table.column("keeper").combine_chunks()
        data = pack_shard(
            column("index", np.int64) ^ _turn(column("fingerprint", np.int64)), column("fingerprint", np.int64),
            np.minimum(column("n", np.int64), 2**31 - 1).astype(np.int32), np.asarray(keeper.fill_null(0)).astype(np.int64), np.asarray(keeper.is_valid()),
        )
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([data], pa.binary())})

    shard = F.pmod(F.col("index"), F.lit(shards))
    return durable(lines.withColumn("shard", shard).groupBy("shard").applyInArrow(pack, "shard long, data binary"), "line-shards"), shards


def _turn(x: np.ndarray) -> np.ndarray:
    return ((x.view(np.uint64) << np.uint64(17)) | (x.view(np.uint64) >> np.uint64(47))).view(np.int64)


def _probe(shard: Shard, index: np.ndarray, fingerprint: np.ndarray, ids: np.ndarray, has_id: np.ndarray) -> np.ndarray:
    return shard.drops(index ^ _turn(fingerprint), fingerprint, ids, has_id)


def _split(texts: list, least: int) -> tuple[list, list, list, list, list]:
    """Per text its lines; and row, line number, index and fingerprint of each line that is long enough."""
    lines, rows, numbers, first, second = [], [], [], [], []
    for row, t in enumerate(texts):
        own = (t or "").split("\n")
        lines.append(own)
        for number, line in enumerate(own):
            if len(line) >= least:
                h = line_hash(line, least)
                if h is not None:
                    rows.append(row)
                    numbers.append(number)
                    first.append(h[0])
                    second.append(h[1])
    return lines, rows, numbers, first, second


def _kept_batches(batches: Iterator[pa.RecordBatch], id_at: int, text_at: int, least: int, dropped) -> Iterator[tuple[pa.RecordBatch, list, list]]:
    """(batch, kept texts, per row (lines, dropped)); ``dropped`` decides the pairs of a batch."""
    for whole in batches:
        for start in range(0, whole.num_rows, 1000):
            batch = whole.slice(start, 1000)
            texts = batch.column(text_at).to_pylist()
            lines, rows, numbers, first, second = _split(texts, least)
            owner = batch.column(id_at)
            rows_at = np.array(rows, np.int64)
            ids = np.asarray(owner.cast(pa.int64()).fill_null(0)).astype(np.int64)[rows_at]
            has_id = np.asarray(owner.is_valid())[rows_at]
            gone = dropped(batch, rows_at, np.array(first, np.int64), np.array(second, np.int64), ids, has_id)
            away: dict[int, set] = {}
            for k in np.flatnonzero(gone):
                away.setdefault(rows[k], set()).add(numbers[k])
            kept = [
                t if row not in away else "\n".join([x for n, x in enumerate(lines[row]) if n not in away[row]])
                for row, t in enumerate(texts)
            ]
            yield batch, kept, [(len(own), len(away.get(row, ()))) for row, own in enumerate(lines)]


def _decider(documents: DataFrame, least_chars: int, least_docs: int, doc_id: str, text: str, broadcast_bytes: int):
    """The documents to walk over (maybe with a last column of dropped line hashes) and the decision."""
    shards, count = build_shards(shared_lines(documents, least_chars, least_docs, doc_id, text))
    if (shards.agg(F.sum(F.octet_length("data"))).head()[0] or 0) <= broadcast_bytes:
        packed = {r["shard"]: bytes(r["data"]) for r in shards.collect()}
        shared = documents.sparkSession.sparkContext.broadcast({"packed": packed})

        def decide(batch, rows, index, fingerprint, ids, has_id):
            state = shared.value
            if "shards" not in state:
                state["shards"] = {k: Shard(v) for k, v in state["packed"].items()}
            out, where = np.zeros(len(index), bool), index % count
            for k in np.unique(where):
                if k in state["shards"]:
                    part = where == k
                    out[part] = _probe(state["shards"][k], index[part], fingerprint[part], ids[part], has_id[part])
            return out

        return documents, decide
    return _routed(documents, shards, count, least_chars, doc_id, text)


def _routed(documents: DataFrame, shards: DataFrame, count: int, least: int, doc_id: str, text: str):
    """Line hashes travel to the shards' copies; what is to be dropped comes back by document."""
    key = F.struct(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                _, rows, _, first, second = _split(part.column(2).to_pylist(), least)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(first, pa.int64()), pa.array(second, pa.int64())], ["id", "hash", "index", "fingerprint"])

    lines = documents.select(key["id"].alias("id"), key["text"].alias("hash"), F.col(text).alias("text")).mapInArrow(cut, "id long, hash long, index long, fingerprint long")
    refs = lines.select(
        F.pmod("index", F.lit(count)).cast("long").alias("shard"), F.pmod(F.xxhash64("id", "hash"), F.lit(COPIES)).cast("long").alias("copy"), F.lit(1).alias("kind"),
        F.lit(None).cast("binary").alias("data"), "id", "hash", "index", "fingerprint",
    )
    copies = shards.select(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COPIES - 1).cast("long"))).alias("copy"), F.lit(0).alias("kind"), "data",
        *[F.lit(None).cast("long").alias(c) for c in ("id", "hash", "index", "fingerprint")],
    )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, of = None, None
        for batch in batches:
            shard, copy, kind = (np.asarray(batch.column(i)) for i in range(3))
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(copy) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(shard)]):
                if a == b:
                    continue
                if kind[a] == 0:
                    current, of = Shard(batch.column(3)[int(a)].as_py()), (shard[a], copy[a])
                elif of == (shard[a], copy[a]):
                    part = batch.slice(int(a), int(b - a))
                    ids = part.column(4)
                    gone = _probe(
                        current, np.asarray(part.column(6)), np.asarray(part.column(7)), np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid())
                    )
                    hit = part.filter(pa.array(gone))
                    yield pa.RecordBatch.from_arrays([hit.column(i) for i in (4, 5, 6, 7)], ["id", "hash", "index", "fingerprint"])

    keys = ["shard", "copy"]
    drops = refs.unionByName(copies).repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(probe, "id long, hash long, index long, fingerprint long")
    name = "dropped"
    while name in documents.columns:
        name += "_"
    of_doc = drops.groupBy(F.struct("id", "hash").alias("key_")).agg(F.collect_set(F.struct("index", "fingerprint")).alias(name))
    # Both parts of the key are null-safe: xxhash64 is never null, and a null id is replaced with a flag.
    safe = lambda k: [F.coalesce(k["id"], F.lit(0)).alias("i_"), k["id"].isNull().alias("n_"), k["text" if k is key else "hash"].alias("h_")]
    left = documents.select(F.struct("*").alias("row_"), *safe(key))
    joined = left.join(of_doc.select(*safe(F.col("key_")), name), ["i_", "n_", "h_"], "left").select("row_.*", name)

    def decide(batch, rows, index, fingerprint, ids, has_id):
        sets = [{(h["index"], h["fingerprint"]) for h in hs or ()} for hs in batch.column(batch.num_columns - 1).to_pylist()]
        return np.array([(a, b) in sets[r] for r, a, b in zip(rows, index.tolist(), fingerprint.tolist())], bool)

    return joined, decide


def line_report(
    documents: DataFrame, least_chars: int = 40, least_docs: int = 5, doc_id: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each document."""
    narrow = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    current, decide = _decider(narrow, least_chars, least_docs, "doc_id", "text", broadcast_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, kept, counts in _kept_batches(batches, 0, 1, least_chars, decide):
            columns = [
                batch.column(0), pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64()),
                pa.array([hashlib.sha256((t or "").encode()).hexdigest() for t in kept], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return current.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string")


def remove_shared_lines(
    documents: DataFrame, least_chars: int = 40, least_docs: int = 5, doc_id: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``documents`` with shared lines taken out of their text; other columns stay as they are."""
    current, decide = _decider(documents, least_chars, least_docs, doc_id, text, broadcast_bytes)
    id_at, text_at, n = documents.columns.index(doc_id), documents.columns.index(text), len(documents.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, kept, _ in _kept_batches(batches, id_at, text_at, least_chars, decide):
            columns = list(batch.columns[:n])
            columns[text_at] = pa.array(kept, batch.schema.field(text_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:n]))

    return current.mapInArrow(run, documents.schema)
