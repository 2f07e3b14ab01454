from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from rowferry.llm import pieces
from rowferry.llm.charmap import Normalizer, read_charmap

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check(df, library):
    texts = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in df.collect()))
    found = sorted(
        (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
        for r in pieces.round_trip(df, PATH).collect()
    )
    expected = []
    for missing, ident, text in texts:
        ids = library.encode(text, add_eos=True)
        expected.append((missing, ident, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids))))
    assert found == sorted(expected)


def test_documents(documents, library):
    check(documents, library)


def test_odd_rows(odd, nothing, library):
    check(odd, library)
    assert pieces.round_trip(nothing, PATH).count() == 0


def test_spans_cover_the_text(odd):
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for r in pieces.encode_documents(odd, PATH).collect():
        text = texts[r["doc_id"]].encode()
        bounds = r["bounds"]
        assert len(bounds) == len(r["ids"]) + 1 and bounds[-1] == len(text) and bounds == sorted(bounds)
        assert b"".join(text[a:b] for a, b in zip(bounds, bounds[1:])) == text[bounds[0] :]


def test_decoding_gives_the_text_back(odd):
    # The vocabulary writes a space as this mark, so a mark in a text comes back as a space.
    texts = {(r["doc_id"], (r["text"] or "").replace("▁", " ")) for r in odd.collect()}
    back = pieces.decode_documents(pieces.encode_documents(odd, PATH), PATH).collect()
    assert {tuple(r) for r in back} == texts


def test_random_texts(library):
    model, random_ = pieces.PieceModel(PATH), random.Random(4)
    letters = " \n\t   ab.,'s12é　▁😀世<s></s>\0"
    texts = ["".join(random_.choice(letters) for _ in range(random_.randint(0, 30))) for _ in range(1500)]
    assert [ids.tolist() for ids, _ in model.encode(texts)] == library.encode(texts)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_compiled_character_maps(rule):
    theirs = sentencepiece.SentencePieceNormalizer(
        rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True
    )
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(theirs.serialized_model_proto())
    mine = Normalizer(read_charmap(proto.normalizer_spec.precompiled_charsmap), True, True, True)
    random_ = random.Random(2)
    letters = "  aA b\n\té é　Ａｂ①㍿ﬁ½Ⅳ가힣각​­ﷺ世"
    for _ in range(600):
        text = "".join(random_.choice(letters) for _ in range(random_.randint(0, 25)))
        normal, origin = mine.normalize(text)
        assert normal == theirs.normalize(text), repr(text)
        assert len(origin) == len(normal.encode()) + 1 and list(origin) == sorted(origin)


def test_a_replaced_key_keeps_its_place():
    normal, origin = Normalizer({"ﬁ": "fi", "é": "é", "1/2": "½"}, False, False, False).normalize("aﬁ 1/2b")
    assert normal == "afi ½b"
    assert origin.tolist() == [0, 1, 1, 4, 5, 5, 8, 9]
