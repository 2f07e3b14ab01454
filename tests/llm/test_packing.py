from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rowferry.llm import packing
from rowferry.llm.byte_bpe import ByteBpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(df, library, capacity=packing.CAPACITY):
    rows = packing.pack(df, PATH, capacity).collect()
    whole = Counter()
    for r in df.select("doc_id", "text").collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % capacity or capacity
        bounds = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            whole[r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == whole
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(r["length"] for r in rows)
    return len(sequences), -(-total // capacity)


def test_documents_are_packed_tightly(documents, library):
    used, bound = check(documents, library)
    assert used <= 1.02 * bound + 1


def test_odd_rows(odd, nothing, library):
    check(odd, library, capacity=64)
    assert packing.pack(nothing, PATH).count() == 0


def test_long_documents_are_full_but_for_the_first_piece():
    assert packing.cuts(10, 4) == [0, 2, 6, 10]
    assert packing.cuts(8, 4) == [0, 4, 8]
    assert packing.cuts(3, 4) == [0, 3]


def test_plan_packs_every_document_once():
    random.seed(3)
    for _ in range(30):
        capacity = random.choice([16, 64, 256])
        counts = Counter(random.randint(1, capacity) for _ in range(random.randint(1, 400)))
        bins = packing.pack_lengths(dict(counts), capacity)
        packed = Counter()
        for repeats, bin_ in bins:
            assert 0 < sum(bin_) <= capacity
            for length in bin_:
                packed[length] += repeats
        assert packed == counts


def test_two_smaller_documents_replace_the_smallest():
    # Greedy leaves 10 + 4 of 16; instead of the 4, 3 + 3 fill the bin.
    bins = packing.pack_lengths({10: 1, 4: 1, 3: 2}, 16)
    assert sorted(bins[0][1]) == [3, 3, 10]


def test_the_plan_does_not_grow_with_the_documents():
    few = packing.pack_lengths({length: 10 for length in range(1, 200)}, 256)
    many = packing.pack_lengths({length: 10_000_000 for length in range(1, 200)}, 256)
    assert len(many) < 20 * len(few)


def test_words_are_encoded_as_the_library_does(library):
    bpe, random_ = ByteBpe(PATH), random.Random(1)
    assert bpe.fast is not None
    letters = list(" \n\t  ab.,'s12é　 \x1c\u0085") + ["<|endoftext|>", "don't"]
    texts = ["".join(random_.choice(letters) for _ in range(random_.randint(0, 25))) for _ in range(2000)]
    for text, ids in zip(texts, bpe.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_white_space(library):
    text = " " * 1_200_000 + "x"
    assert np.frombuffer(next(iter(ByteBpe(PATH).encode([text]))), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_new_words_cost_no_more_than_encoding_them():
    """Texts of words that hardly repeat: what is kept of words must not cost more than the encoding."""
    import time

    bpe, choice = ByteBpe(PATH), random.Random(2)
    parts = [[" ".join("".join(choice.choices("abcdefghij", k=choice.randint(5, 12))) for _ in range(1000)) for _ in range(150)] for _ in range(3)]

    def seconds(run):
        times = []
        for texts in parts:
            start = time.process_time()
            run(texts)
            times.append(time.process_time() - start)
        return min(times)

    plain = seconds(lambda texts: [bpe.fast.encode_to_numpy(text).tobytes() for text in texts])
    assert seconds(lambda texts: list(bpe.encode(texts))) < 1.5 * plain
