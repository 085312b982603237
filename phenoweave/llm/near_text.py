"""Near-duplicate documents by BagMinHash signatures of their word shingles.

Documents are multisets of ``SHINGLE`` consecutive words (fewer words: one
shingle of all). Every weight level interval (0, 1], (1, 2], (2, 4], ... of a
shingle carries a Poisson process; a point has a time, a register and a unit of
weight, and counts if the shingle's multiplicity reaches that unit. A register
keeps the earliest time, so two registers agree with the probability of the
weighted Jaccard similarity. Points come in order of time and a shingle stops
when its next point is later than all registers.

Equal word sequences are one node. Nodes that agree in a band of registers meet
in a bucket and are verified against its smallest node, the pivot. The links to all
pivots give first classes; two nodes of one class need no further comparison. Of the
nodes that met a pivot, those outside their largest first class are compared with all
of them, in tiles of bounded blocks; a tile returns a spanning forest of its links,
never pairs. Classes are the connected components of verified links.

Defined cases: documents without words are equal if their texts are; a null text
is alone; repeated rows are copies; a null id never is a class id, unless all
ids of a class are null; extra columns are kept by
:func:`remove_near_duplicates` and ignored otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from phenoweave.llm.words import WordHasher, mix, slices, text_buffer, windows_of_rows
from phenoweave.operators.graph import connected_components
from phenoweave.session import durable

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5  # a link of similarity 0.8 is missed by all bands once in 14,000
FAR_BLOCK, NEAR_BLOCK = 128, 256  # nodes on the two sides of a tile
COLUMNS = 4096  # shared elements of a tile multiplied at once
PAIRS_PER_COPY = 64  # pairs of one pivot that one copy of its shingles serves
NO_ID = -(1 << 63)


def shingles(words: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle, rows ascending; a row of fewer words has one."""
    hashes, _, rows = windows_of_rows(words, bounds, size)
    counts = np.diff(bounds)
    for length in range(1, size):
        short = np.flatnonzero(counts == length)
        if len(short):
            at = bounds[short][:, None] + np.arange(length)
            folded = np.full(len(short), length, np.uint64)
            for k in range(length):
                folded = mix(folded * np.uint64(0x2545F4914F6CDD1D) + words[at[:, k]])
            hashes, rows = np.concatenate([hashes, folded]), np.concatenate([rows, short])
    return hashes, rows


def bag_min_hash(elements: np.ndarray, owner: np.ndarray, weight: np.ndarray, rows: int, registers: int) -> np.ndarray:
    """Signatures (rows x registers) of weighted sets: element hash, set and whole weight of each entry."""
    table = np.full(rows * registers, np.inf)
    level = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    # An entry has one process per level interval it reaches into.
    entry = np.repeat(np.arange(len(elements)), level + 1)
    depth = np.arange(len(entry)) - np.repeat(np.cumsum(level + 1) - level - 1, level + 1)
    low = np.where(depth == 0, 0, 1 << np.maximum(depth - 1, 0))
    rate = np.where(depth == 0, 1, low).astype(np.float64)
    seed = mix(elements[entry] + depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    reach, owner, weight = low + rate, owner[entry], weight[entry]
    time, worst, step = np.zeros(len(entry)), np.full(rows, np.inf), 0
    while len(seed):
        step += 1
        draw = mix(seed + np.uint64((step * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log1p(-(draw >> np.uint64(11)).astype(np.float64) / (1 << 53)) / rate
        alive = time < worst[owner]
        if not alive.all():
            seed, owner, weight, low, rate, reach, time, draw = (a[alive] for a in (seed, owner, weight, low, rate, reach, time, draw))
            if not len(seed):
                break
        other = mix(draw)
        spot = owner * registers + (other % np.uint64(registers)).astype(np.int64)
        part = np.flatnonzero(reach > weight)  # intervals only partly below the weight: thin by the point's unit
        if len(part):
            unit = low[part] + 1 + ((other[part] >> np.uint64(24)) % rate[part].astype(np.uint64)).astype(np.int64)
            counted = np.ones(len(seed), bool)
            counted[part] = unit <= weight[part]
            np.minimum.at(table, spot[counted], time[counted])
        else:
            np.minimum.at(table, spot, time)
        touched = np.flatnonzero(np.bincount(owner, minlength=rows))
        worst[touched] = table.reshape(rows, registers)[touched].max(axis=1)
    return table.reshape(rows, registers)


def signatures(words: np.ndarray, bounds: np.ndarray, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> np.ndarray:
    """Band hashes (documents x bands) of documents given by word hashes."""
    hashes, owner = shingles(words, bounds, size)
    key, weight = np.unique((owner.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)), return_counts=True)
    docs = len(bounds) - 1
    table = bag_min_hash(mix(key & np.uint64((1 << 44) - 1)), (key >> np.uint64(44)).astype(np.int64), weight, docs, bands * rows)
    bits = np.ascontiguousarray(table).view(np.uint64).reshape(docs, bands, rows)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), (docs, bands)).copy()
    for k in range(rows):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + bits[:, :, k])
    return out.view(np.int64)


def node_key(words: np.ndarray, text: bytes | None) -> bytes:
    """Name of a word sequence; of a text without words the name of the text."""
    if len(words):
        return hashlib.blake2b(words.tobytes(), digest_size=16).digest()
    return hashlib.blake2b(b"text" + text, digest_size=16).digest()


def _hashed(column: pa.Array, hasher: WordHasher) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list]]:
    """(first row, end row, word hashes, bounds, node names) of slices of a text column; null texts have no name."""
    raw_all, offsets_all = text_buffer(column)
    valid = np.asarray(column.is_valid())
    for i, j in slices(offsets_all, 2 << 20):
        raw, offsets = raw_all[offsets_all[i] : offsets_all[j]], offsets_all[i : j + 1] - offsets_all[i]
        starts, ends, bounds = hasher.spans(raw, offsets)
        words = hasher.hashes(raw, starts, ends)
        names = [node_key(words[bounds[k] : bounds[k + 1]], bytes(raw[offsets[k] : offsets[k + 1]]) if bounds[k] == bounds[k + 1] else None) if valid[i + k] else None for k in range(j - i)]
        yield i, j, words, bounds, names


def sign_documents(documents: DataFrame, doc_id: str, text: str, size: int = SHINGLE) -> DataFrame:
    """(id, node, bands) of every document; bands are null without words, the node of a null text too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for i, j, words, bounds, names in _hashed(batch.column(1), hasher):
                table = signatures(words, bounds, size=size)
                bands = pa.array([row if b > a else None for row, a, b in zip(table.tolist(), bounds, bounds[1:])], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names, pa.binary()), bands], ["id", "node", "bands"])

    return documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, node binary, bands array<long>")


def _node_shingles(documents: DataFrame, nodes: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(node, bag) of the wanted ``nodes`` (id, node): sorted shingle hashes, each as often as it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            wanted = batch.column(1)
            for i, j, words, bounds, names in _hashed(batch.column(2), hasher):
                hashes, owner = shingles(words, bounds, size)
                order = np.lexsort((hashes, owner))
                hashes, cuts = hashes[order], np.searchsorted(owner[order], np.arange(j - i + 1))
                found = [(name, hashes[cuts[k] : cuts[k + 1]].tobytes()) for k, name in enumerate(names) if name is not None and name == wanted[i + k].as_py()]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], ["node", "bag"])

    texts = documents.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("text"))
    found = texts.join(nodes, "id").select("id", "node", "text").mapInArrow(run, "node binary, bag binary")
    return found.groupBy("node").agg(F.first("bag").alias("bag"))


def bag_overlap(a: bytes, b: bytes) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted multisets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    ux, nx = np.unique(x, return_counts=True)
    uy, ny = np.unique(y, return_counts=True)
    at = np.searchsorted(uy, ux)
    at[at == len(uy)] = 0
    same = uy[at] == ux if len(uy) else np.zeros(len(ux), bool)
    common = int(np.minimum(nx[same], ny[at[same]]).sum())
    return common, len(x) + len(y) - common


def _with_bags(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """``pairs`` (src, dst, ...) plus src_bag and dst_bag.

    The bag of a ``src`` with many partners is copied, so its pairs part.
    """
    copies = pairs.groupBy("src").agg(F.ceil(F.count("*") / PAIRS_PER_COPY).cast("int").alias("copies"))
    left = bags.withColumnsRenamed({"node": "src", "bag": "src_bag"}).join(copies, "src").select(
        "src", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "src_bag"
    )
    right = pairs.join(copies, "src").withColumn("copy", F.pmod(F.xxhash64("dst"), F.col("copies")).cast("int"))
    right = right.join(bags.withColumnsRenamed({"node": "dst", "bag": "dst_bag"}), "dst")
    return left.join(right, ["src", "copy"]).select(*pairs.columns, "src_bag", "dst_bag")


def tested(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """(src, dst, linked): whether the multisets of each pair are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(batch.column(2), batch.column(3)):
                common, union = bag_overlap(a.as_buffer(), b.as_buffer())
                linked.append(common >= threshold * union - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["src", "dst", "linked"])

    return _with_bags(pairs.select("src", "dst"), bags).mapInArrow(run, "src binary, dst binary, linked boolean")


def tile_links(bags: list[np.ndarray], cut: int, threshold: float) -> list[tuple[int, int]]:
    """Spanning forest of the links between the first ``cut`` multisets and the others."""
    sizes = np.array([len(b) for b in bags])
    occurrence = [np.arange(len(b)) - np.searchsorted(b, b) for b in bags]
    elements = np.concatenate([mix(b + o.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for b, o in zip(bags, occurrence)])
    _, column, counts = np.unique(elements, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(bags)), sizes)
    shared = counts[column] > 1  # only they add to an overlap
    number = np.cumsum(counts > 1) - 1
    row, column = row[shared], number[column[shared]]
    common = np.zeros((cut, len(bags) - cut), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((len(bags), COLUMNS), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        common += part[:cut] @ part[cut:].T
    union = sizes[:cut, None] + sizes[None, cut:] - common
    parent, out = list(range(len(bags))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(*(x.tolist() for x in np.nonzero(common >= threshold * union - 1e-6))):
        x, y = root(i), root(cut + j)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((i, cut + j))
    return out


def _links(members: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Links (src, dst) among ``members`` (bucket, node) of the same bucket that span their classes."""
    pivots = members.groupBy("bucket").agg(F.min("node").alias("src"))
    met = members.join(pivots, "bucket").filter("src <> node").select("src", F.col("node").alias("dst")).distinct()
    seen = durable(tested(durable(met, "near-met"), bags, threshold), "near-tested")
    star = seen.filter("linked").select("src", "dst")
    # Nodes of one class by the pivots' own links need no comparison; the largest such class of a pivot is its home.
    known = durable(connected_components(star), "near-known").withColumnsRenamed({"node": "dst"})
    named = durable(seen.join(known, "dst", "left").select("src", "dst", F.coalesce("component", "dst").alias("component")), "near-named")
    sizes = named.groupBy("src", "component").agg(F.count("*").alias("n"))
    far = sizes.groupBy("src").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("home")).filter("n > home.n").select(
        "src", F.col("home.component").alias("home"), F.ceil((F.col("n") - F.col("home.n")) / FAR_BLOCK).cast("int").alias("far_blocks"),
        F.ceil(F.col("n") / NEAR_BLOCK).cast("int").alias("near_blocks"),
    )
    rows = durable(named.join(far, "src"), "near-far")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda seed, n: F.pmod(F.xxhash64("dst", F.lit(seed)), F.col(n)).cast("int")
    left = rows.filter("component <> home").select("src", "dst", F.lit(0).alias("side"), block(1, "far_blocks").alias("i"), every("near_blocks").alias("j"))
    right = rows.select("src", "dst", F.lit(1).alias("side"), every("far_blocks").alias("i"), block(2, "near_blocks").alias("j"))
    filled = left.unionByName(right).join(bags.withColumnRenamed("node", "dst"), "dst")

    def compare(key, table):
        side = table.column("side").to_numpy()
        order = np.argsort(side, kind="stable")
        cut = int((side == 0).sum())
        nodes, bags = table.column("dst").to_pylist(), table.column("bag").to_pylist()
        found = tile_links([np.frombuffer(bags[k], np.uint64) for k in order], cut, threshold) if 0 < cut < len(order) else []
        pairs = [(nodes[order[a]], nodes[order[b]]) for a, b in found if nodes[order[a]] != nodes[order[b]]]
        return pa.table({"src": pa.array([p[0] for p in pairs], pa.binary()), "dst": pa.array([p[1] for p in pairs], pa.binary())})

    tiles = filled.select("src", "i", "j", "side", "dst", "bag").groupBy("src", "i", "j").applyInArrow(compare, "src binary, dst binary")
    return durable(star.unionByName(tiles), "near-links")


def near_classes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """(id, node, class_id, kept) of every document; one (id, node) of each class is kept, that of the smallest id."""
    signed = durable(sign_documents(documents, doc_id, text, size), "near-signed")
    nodes = durable(
        signed.filter("node is not null").groupBy("node")
        .agg(F.min(F.coalesce("id", F.lit(NO_ID))).alias("id"), F.first("bands", True).alias("bands")),
        "near-nodes",
    )
    spread = nodes.filter("bands is not null").select("node", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    members = durable(spread.join(shared, "bucket"), "near-members")
    wanted = members.select("node").distinct().join(nodes.select("id", "node"), "node").select("id", "node")
    bags = durable(_node_shingles(documents, wanted, doc_id, text, size), "near-bags")
    classes = durable(connected_components(_links(members, bags, threshold)), "near-components")
    whole = signed.select("id", "node").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = whole.filter("component is not null").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("best"))
    return whole.join(best, "component", "left").select(
        "id", "node", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("class_id"),
        F.coalesce(F.col("id").eqNullSafe(F.col("best.id")) & (F.col("node") == F.col("best.node")), F.lit(True)).alias("kept"),
    )


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, kept): a row per document with the smallest id of its class."""
    return near_classes(documents, doc_id, text, threshold).select(F.col("id").alias("doc_id"), "class_id", "kept")


def remove_near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of ``documents``, with all columns; rows with a null text stay."""
    kept = durable(
        near_classes(documents, doc_id, text, threshold).filter("kept and node is not null")
        .groupBy(F.coalesce("id", F.lit(NO_ID)).alias("id_"), F.col("node").alias("node_")).agg(F.count("*").alias("n_")),
        "near-kept",
    )
    at = documents.columns.index(text)
    # A helper column tells the rows wanted from those that only share their id.
    rows = documents.filter(F.col(text).isNotNull()).select(F.struct("*").alias("row_"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id_"), F.col(text).alias("text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, j, _, _, names in _hashed(batch.column(3), hasher):
                keep[i:j] = [name == batch.column(2)[i + k].as_py() for k, name in enumerate(names)]
            yield batch.select(["row_", "id_", "node_", "n_"]).filter(pa.array(keep))

    joined = rows.join(kept, "id_").select("row_", "id_", "node_", "text_", "n_")
    schema = joined.drop("text_").schema
    found = joined.mapInArrow(run, schema)
    single = found
    if not kept.filter("n_ > 1").isEmpty():  # repeated rows: one of each
        single = found.dropDuplicates(["id_", "node_"])
    return single.select("row_.*").unionByName(documents.filter(F.col(text).isNull())) if at >= 0 else documents
