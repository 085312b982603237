"""SentencePiece encoding and decoding for merge-type vocabularies.

Pairs of adjacent symbols wait in an agenda ordered by the score of the piece
they would form, then by position; the best pair that is still adjacent is
merged until the agenda is empty. Characters left over without a piece become
byte pieces. No piece of such a vocabulary has a space mark behind another
character, none holds a line break, and no piece has certain stops behind certain letters,
so a text falls apart into segments that never merge with each other; each
distinct segment is encoded once per worker process while a bounded cache has
room, and its ids are compared with the sentencepiece library's. The model's own rules say
what the normal form of a text is (where they do not, every text's is compared), and each cut
of every text is looked up among the neighbours inside pieces: where none is there, no merge
crosses a cut and the ids of the segments are those of the text. A text that fails is encoded again in one piece and compared as a whole;
a difference that stays is an error.

Defined cases: a null or empty text has no tokens and decodes to the empty text;
repeated rows are encoded alike; extra columns are not looked at.
"""

from __future__ import annotations

import codecs
import hashlib
import itertools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from phenoweave.llm.merging import MergeTable
from phenoweave.llm.words import slices, text_buffer
from phenoweave.session import bound_batches

MARK = "▁"
STOPS = ",.;:!?"
#: Segments remembered by one worker process, in two halves: a full one becomes the older one, whose segments
#: move over when they are met again.
CACHE = 300_000
#: Segments compared with the library in one text.
COMPARED = 2_000
#: Segments longer than this many characters are not remembered.
CACHED_LENGTH = 64
#: Texts are encoded together up to so many bytes, or one by one.
BYTES_AT_ONCE = 1 << 20


class _Symbols(dict):
    """Symbols of characters; those above the vocabulary stand for characters without a piece."""

    def __init__(self, ids: dict[str, int], n: int) -> None:
        super().__init__((c, i) for c, i in ids.items() if len(c) == 1)
        self.n = n

    def __missing__(self, c: str) -> int:
        self[c] = symbol = self.n + ord(c)
        return symbol


class PieceModel:
    """Pieces, scores and byte pieces of a merge-type model, read through the library."""

    def __init__(self, proto: bytes) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        lib = self.library
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.bytes_of = {i: int(self.pieces[i][3:5], 16) for i in range(n) if lib.is_byte(i)}
        self.byte_ids = [0] * 256
        for i, b in self.bytes_of.items():
            self.byte_ids[b] = i
        normal = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        self.skipped = {i for i in range(n) if lib.is_control(i)}
        self.decimals = [str(i) for i in range(n)]
        # What a token stands for: bytes beyond ASCII are lone surrogates until a whole text is there.
        self.texts = ["" if i in self.skipped else p for i, p in enumerate(self.pieces)]
        for i, b in self.bytes_of.items():
            self.texts[i] = bytes([b]).decode("ascii", "surrogateescape")
        self.beyond = np.array([i in self.bytes_of and self.bytes_of[i] > 127 for i in range(n)])
        separable = all(MARK not in p.lstrip(MARK) and ("\n" not in p) for p in self.ids) and len(self.bytes_of) == 256 and MARK in self.ids
        if not separable or lib.decode(lib.encode(" x\n ")) != " x\n ":
            raise ValueError("the model is not a plain merge-type vocabulary with byte pieces")
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, i in enumerate(sorted(normal, key=lambda i: -lib.get_score(i))):
            p = self.pieces[i]
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    best[(a, b)] = (rank, i)
        self.table = MergeTable(best)
        # Words are cut before a stop. No piece has a stop behind a character of the class that words are read with:
        # a stop behind a letter parts nothing, and what else the class matches (² in '².') is taken out of it.
        before = {c: {p[k - 1] for p in self.ids for k in range(1, len(p)) if p[k] == c} for c in STOPS}
        stops = [c for c in STOPS if not any(x.isalpha() for x in before[c])]
        outside = "".join(sorted({re.escape(x) for c in stops for x in before[c] if re.match(r"[^\W\d_]", x)}))
        ends = f"[{''.join(stops)}{MARK}\n]|$"
        self.segments = re.compile(f"{MARK}*[^\\W\\d_{outside}]+(?={ends})|\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
        #: Neighbouring characters inside pieces.
        self.inside = np.unique(_neighbours("\0".join(self.ids)))
        self.plain = _plain(proto)
        self.line = lib.encode("\n")
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.changed: dict[str, str] = {}
        self.symbols = _Symbols(self.ids, n)

    def normalise(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def merge(self, segments: list[str]) -> list[list[int]]:
        """Token ids of each segment."""
        n, symbol = len(self.pieces), self.symbols.__getitem__
        merged = self.table.merge([list(map(symbol, s)) for s in segments])
        # What is above the vocabulary is a character without a piece.
        return [
            ids if max(ids) < n else [t for i in ids for t in ([i] if i < n else [self.byte_ids[b] for b in chr(i - n).encode()])]
            for ids in merged
        ]

    def decode(self, ids: list[int]) -> str:
        """Text of tokens, the space before the first one included; runs of byte pieces are read as UTF-8."""
        text = "".join([self.texts[i] for i in ids])
        if self.beyond[ids].any():
            codecs.register_error("each-alone", _each_alone)
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "each-alone")
        return text.replace(MARK, " ")

    def learn(self, new: list[str]) -> None:
        """Encode segments; those whose tokens do not stand for the segment itself are noted."""
        known, texts = self.cache, self.texts
        merged = self.merge(new)
        self.compare(new, merged)
        for s, ids in zip(new, merged):
            known[s] = array("i", ids).tobytes()
            if "".join([texts[i] for i in ids]) != s and (decoded := self.decode(ids)) != s.replace(MARK, " "):
                self.changed[s] = decoded

    def compare(self, segments: list[str], merged: list[list[int]]) -> None:
        """Compare the ids of segments with the library's, many in one text: no merge crosses a line break."""
        lead, stop = self.line[:-1], self.line[-1:]
        for k in range(0, len(segments), COMPARED):
            ours = list(lead)
            for ids in merged[k : k + COMPARED]:
                ours += stop
                ours += ids
            text = "\n" + "\n".join(segments[k : k + COMPARED]).replace(MARK, " ")
            if ours != self.library.encode(text, num_threads=1):
                for s, ids in zip(segments[k : k + COMPARED], merged[k : k + COMPARED]):
                    theirs = self.library.encode("\n" + s.replace(MARK, " "))[len(self.line) :]
                    if ids != theirs:
                        raise ValueError(f"differs from the library: {s[:1000]!r}: {ids[:100]} and {theirs[:100]}")
                raise ValueError(f"differs from the library: {text[:1000]!r}")

    def torn(self, normal: list[str], split: list[list[str]]) -> set[int]:
        """Texts whose segments are not all of them, or with a cut between neighbours that some piece holds."""
        flat = list(itertools.chain.from_iterable(split))
        joined, out = "".join(flat), set()
        if joined != "".join(normal):
            out.update(i for i, segments in enumerate(split) if "".join(segments) != normal[i])
        if len(flat) > 1:
            cut = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)))[:-1] - 1
            pair = _neighbours(joined)[cut]
            at = np.minimum(np.searchsorted(self.inside, pair), len(self.inside) - 1)
            held = np.flatnonzero(self.inside[at] == pair)
            if len(held):
                # A cut is behind the segment of its number; the last one of a text is none.
                ends = np.cumsum([len(segments) for segments in split])
                out.update(int(i) for k in held for i in [np.searchsorted(ends, k, "right")] if ends[i] != k + 1)
        return out

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[list[int], bytes, str]]:
        """Token ids of each text, the same in decimals joined by commas, and the text they stand for.

        Byte pieces of a character lie in one segment, so a text's tokens stand for what its segments' tokens stand for.
        """
        if len(self.cache) > CACHE // 2:
            self.older, self.cache = self.cache, {}
        known, older, decimal = self.cache, self.older, self.decimals.__getitem__
        normal = [self.normalise(t) for t in texts]
        split = [self.segments.findall(t) for t in normal]
        missed = set(itertools.chain.from_iterable(split)).difference(known)
        new = [s for s in missed if s not in older]
        known.update((s, older[s]) for s in missed if s in older)
        self.learn(new)
        torn = self.torn(normal, split)
        for i, (text, whole, segments) in enumerate(zip(texts, normal, split)):
            if i not in torn and (self.plain or self.library.normalize(text) == whole):
                ids = np.frombuffer(b"".join(map(known.__getitem__, segments)), np.int32).tolist()
                decoded = whole[1:].replace(MARK, " ")
                if self.changed and not self.changed.keys().isdisjoint(segments):
                    decoded = "".join([self.changed.get(s, s.replace(MARK, " ")) for s in segments])[1:]
            else:
                # The whole text in one agenda, without segments.
                ids, theirs = self.merge([whole])[0] if text else [], self.library.encode(text, num_threads=1)
                if ids != theirs:
                    raise ValueError(f"differs from the library: {text[:1000]!r}: {ids[:100]} and {theirs[:100]}")
                decoded = self.decode(ids)[1:]
            yield ids, ",".join(map(decimal, ids)).encode(), decoded
        for s in new:
            if len(s) > CACHED_LENGTH:
                del known[s]
                self.changed.pop(s, None)


def _neighbours(text: str) -> np.ndarray:
    """Each character and the next one as one number."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return codes[:-1] << 32 | codes[1:]


def _plain(proto: bytes) -> bool:
    """Whether the model says that its normal form is a space mark before the text and one for each space; False if it cannot be read."""
    try:
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:
        return False
    model = sentencepiece_model_pb2.ModelProto.FromString(proto)
    rules = model.normalizer_spec
    return (
        not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces
        and not rules.remove_extra_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
    )


def _each_alone(error: UnicodeDecodeError) -> tuple[str, int]:
    """One replacement character for every byte that is no UTF-8, as the library has it."""
    return "\ufffd" * (error.end - error.start), error.end


def encode(documents: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document; with ``keep`` also ``ids`` and ``decoded``.

    ``model`` is the content of the vocabulary file, so executors need no file.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast({"proto": model})
    ident = documents.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {ident}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value
        if "model" not in state:
            state["model"] = PieceModel(state["proto"])
        model = state["model"]
        for whole in batches:
            for start, end in slices(text_buffer(whole.column(1))[1], BYTES_AT_ONCE):
                texts = [t or "" for t in whole.column(1).slice(start, end - start).to_pylist()]
                counts, shas, decoded_shas, all_ids, all_texts = [], [], [], [], []
                for ids, decimals, decoded in model.encode_batch(texts):
                    counts.append(len(ids))
                    shas.append(hashlib.sha256(decimals).hexdigest())
                    decoded_shas.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if keep:
                        all_ids.append(ids)
                        all_texts.append(decoded)
                columns = [whole.column(0).slice(start, end - start), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded_shas, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: bytes, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded) of token id arrays; null arrays decode to the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast({"proto": model})
    ident = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value
        if "model" not in state:
            state["model"] = PieceModel(state["proto"])
        for batch in batches:
            texts = [state["model"].decode(x or []) for x in batch.column(1).to_pylist()]
            texts = [t[1:] if t.startswith(" ") else t for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "decoded"])

    return encoded.select(F.col(key).alias(key), F.col(ids).alias("ids")).mapInArrow(run, f"`{key}` {ident}, decoded string")
