import hashlib
import json
import random

import pytest

from phenoweave.llm import merging, pieces, token_counts
from phenoweave.llm.queries import vocabulary

PIECES, BYTES = vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_pieces_equal_the_library(make_documents, odd_texts, some_texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=PIECES)
    rows = odd_texts + some_texts
    got = pieces.encode(make_documents(rows), PIECES, keep=True).collect()
    assert len(got) == len(rows)
    want = sorted((i or -1, len(ids := library.encode(t or "")), sha(",".join(map(str, ids))), sha(library.decode(ids))) for i, t in rows)
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert all(sha(r.decoded) == r.decoded_sha256 and len(r.ids) == r.n_tokens for r in got)


def test_decode_round_trip(spark, make_documents, some_texts):
    encoded = pieces.encode(make_documents(some_texts[:50]), PIECES, keep=True)
    got = {r.doc_id: r.decoded for r in pieces.decode(encoded, PIECES).collect()}
    assert got == dict(some_texts[:50])
    empty = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.decoded for r in pieces.decode(empty, PIECES).collect()} == {""}


def test_pieces_of_random_strings():
    model = pieces.PieceModel(PIECES)
    random.seed(3)
    texts = ["".join(random.choice("ab eth.,!?▁\n é7ñ(") for _ in range(random.randint(1, 90))) for _ in range(600)]
    for text, (ids, decimals, decoded) in zip(texts, model.encode_batch(texts)):
        assert decimals == ",".join(map(str, ids)).encode()
        assert ids == model.library.encode(text), repr(text)
        assert decoded == model.library.decode(ids)
    # Runs of byte pieces that are no UTF-8 among others.
    some = [*model.bytes_of, *model.bytes_of, *range(260, 2000, 17)]
    for _ in range(400):
        ids = [model.ids[pieces.MARK], *random.choices(some, k=12)]
        assert model.decode(ids)[1:] == model.library.decode(ids), ids


def test_stops_behind_number_signs_are_not_cut_off():
    model = pieces.PieceModel(PIECES)
    random.seed(4)
    texts = ["an area of 5 km². Then", "m².", "x² = m².", "½. ¾! x³, Ⅳ; ①: ²?", "².m".join("ab")]
    texts += ["".join(random.choice("abm²³¹½¾①Ⅳ٣१,.;:!? ▁\n") for _ in range(random.randint(1, 60))) for _ in range(600)]
    for text, (ids, *_) in zip(texts, model.encode_batch(texts)):
        assert ids == model.library.encode(text), repr(text)


def test_no_piece_holds_a_cut():
    model = pieces.PieceModel(PIECES)
    for piece in model.ids:
        for text in (piece, f"a{piece}", f"{piece}a", f"²{piece}"):
            cuts = [m.end() for m in model.segments.finditer(text)][:-1]
            assert all(text[a:b] not in model.ids for c in cuts for a in range(c) for b in range(c + 1, len(text) + 1)), text


def test_a_difference_between_whole_texts_is_mended():
    """Segments that cut a piece: the text is encoded again in one agenda, and no other text is touched."""
    import re

    model = pieces.PieceModel(PIECES)
    model.segments = re.compile("[^.]+|[.]")
    texts = ["an area of 5 km². Then", "plain", ""]
    assert [(ids, decoded) for ids, _, decoded in model.encode_batch(texts)] == [(model.library.encode(t), t) for t in texts]
    model.table = merging.MergeTable({})
    with pytest.raises(ValueError, match="differs from the library"):
        list(model.encode_batch(["an area of 5 km². Then"]))


def test_a_difference_from_the_library_is_an_error():
    model = pieces.PieceModel(PIECES)
    model.table = merging.MergeTable({})
    with pytest.raises(ValueError, match="differs from the library"):
        list(model.encode_batch(["hello"]))


def test_whole_texts_are_not_encoded_twice():
    """Segments are compared with the library once, and a full cache keeps what is met again."""
    model, seen = pieces.PieceModel(PIECES), []
    library, encode = model.library, model.library.encode
    texts = ["the same words again, and again. " * 40, "the same\n words² ▁ ", "", "\n\n"]
    want = [encode(t) for t in texts]

    class Counted:
        def encode(self, text, **options):
            seen.append(text)
            return encode(text, **options)

        normalize = library.normalize

    model.library = Counted()
    assert [ids for ids, *_ in model.encode_batch(texts)] == want
    assert sum(map(len, seen)) < len(texts[0]) / 2
    model.cache.update((f"filler{i}", b"") for i in range(pieces.CACHE // 2))
    del seen[:]
    assert [ids for ids, *_ in model.encode_batch(texts)] == want and not seen
    model.plain = False  # a model that does not say how it normalises
    assert [ids for ids, *_ in model.encode_batch(texts)] == want and not seen
    model.normalise = lambda text: "▁" + text.upper()
    with pytest.raises(ValueError, match="differs from the library"):
        list(model.encode_batch(["the"]))


def test_counts_equal_the_library(make_documents, odd_texts, some_texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(BYTES.decode())
    rows = odd_texts + some_texts
    got = token_counts.count_tokens(make_documents(rows), BYTES.decode()).collect()
    lengths = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    want = sorted((i or -1, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(rows, lengths))
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_whole_tokens_are_proved():
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(BYTES.decode())
    whole, pairs, symbols = token_counts.prove_whole_tokens(json.loads(BYTES))
    assert len(whole) > 45_000 and " the" in whole
    sample = sorted(whole)[::97]
    assert all(len(e.ids) == 1 for e in library.encode_batch(sample))


def test_rows_and_heaps_merge_alike():
    _, pairs, symbols = token_counts.prove_whole_tokens(json.loads(BYTES))
    table = merging.MergeTable(pairs)
    random.seed(5)
    words = [[symbols[b] for b in "".join(random.choice("aehnt rs") for _ in range(random.randint(2, 60))).encode()] for _ in range(300)]
    assert table.merge(words) == [table._merge_long(w) for w in words]
    assert table.merge([]) == [] and table.merge([[]]) == [[]]


def test_empty_tables(make_documents):
    assert pieces.encode(make_documents([]), PIECES).count() == 0
    assert token_counts.count_tokens(make_documents([]), BYTES.decode()).count() == 0
