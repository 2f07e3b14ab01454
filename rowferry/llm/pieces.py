"""SentencePiece encoding with the source span of every piece, and decoding.

Texts are normalised here, through the model's compiled character map, which
keeps the source byte of every normalised byte (``charmap``). The library then cuts the
normalised text into pieces, with a copy of the model that normalises
nothing. The lengths of the pieces lead from the normalised bytes back to spans of the
original text.

In a BPE model no piece goes on over a word's end unless the vocabulary
has one with a space mark behind another character. Where it has none, words are
encoded one by one and remembered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .charmap import SPACE, Normalizer, read_charmap

CACHE_WORDS = 400_000
LONG_WORD = 256
GROUP_CHARS = 2_000_000
_UNITS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_BPE, _UNKNOWN, _USER_DEFINED, _BYTE = 2, 2, 4, 6  # the format's numbers of model and piece types


class PieceModel:
    """A loaded model: normaliser, segmentation and decoder."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            blob = file.read()
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(blob)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        spec, suffix = proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix
        self.normalizer = Normalizer(
            read_charmap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces,
            spec.escape_whitespaces, suffix,
        )
        kinds = [piece.type for piece in proto.pieces]
        self.unknown = kinds.index(_UNKNOWN)
        self.sizes = np.array([1 if p.type == _BYTE else len(p.piece.encode()) for p in proto.pieces])
        self.end = self.library.eos_id()
        self.by_words = (
            proto.trainer_spec.model_type == _BPE
            and _USER_DEFINED not in kinds
            and not any(re.search(f"[^{SPACE}]{SPACE}", p.piece) for p in proto.pieces if p.type not in (3, _UNKNOWN))
        )
        spec.precompiled_charsmap, spec.name = b"", "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.words: dict[str, bytes] = {}  # a space mark and a word -> ids

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, dtype="<i4").tobytes() for ids in self.segmenter.encode(texts, num_threads=1)]

    def _segment(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of normalised texts."""
        if not self.by_words:
            yield from self._ids(texts)
            return
        split = [text.split(SPACE) for text in texts]
        # What follows the first mark has a mark before it; where marks stand together, the units are cut with care.
        split = [
            _UNITS.findall(text) if words[0] or "" in words[1:] else words[1:] for text, words in zip(texts, split)
        ]
        careful = [bool(text) and (len(text) != len(words) + sum(map(len, words))) for text, words in zip(texts, split)]
        known = self.words
        units = {SPACE + w for words, c in zip(split, careful) if not c for w in words}
        units.update(chain.from_iterable(words for words, c in zip(split, careful) if c))
        if len(known) + len(units) > CACHE_WORDS:
            known.clear()
        unseen = list(units.difference(known))
        known.update(zip(unseen, self._ids(unseen)))
        for words, c in zip(split, careful):
            yield b"".join(map(known.__getitem__, words if c else [SPACE + w for w in words]))
        for unit in unseen:
            if len(unit) > LONG_WORD:
                del known[unit]

    def encode(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per text: its ids, and the bounds of their spans in the text's UTF-8 bytes (one more than ids).

        Piece i comes from the bytes bounds[i] to bounds[i + 1]. Pieces of a byte of an
        unknown character have that byte; a dummy prefix alone has an empty span.
        """
        for group in _groups(texts):
            normal = [self.normalizer.normalize(text) for text in group]
            for (text, origin), raw in zip(normal, self._segment([text for text, _ in normal])):
                ids = np.frombuffer(raw, dtype="<i4")
                sizes = self.sizes[ids]
                if (ids == self.unknown).any():
                    sizes = np.array([len(p.encode()) for p in self.segmenter.encode(text, out_type=str)], dtype=np.int64)
                yield ids, origin[np.concatenate(([0], np.cumsum(sizes)))]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def _groups(texts: Iterable[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size > GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _columns(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def encode_documents(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, ids (without end id), bounds (of the pieces' spans in the text's UTF-8 bytes).

    A null text counts as empty and has no ids. Ids may be null or repeat. Other
    columns are not read. No shuffle; an empty table gives an empty result.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(model_path)
        for batch in batches:
            for ident, (ids, bounds) in zip(batch.column(0).to_pylist(), model.encode(batch.column(1).to_pylist())):
                values = [pa.array([ident], pa.int64()), pa.array([ids], pa.list_(pa.int32())), pa.array([bounds], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(values, ["doc_id", "ids", "bounds"])

    return _columns(docs, doc_id, text).mapInArrow(run, "doc_id bigint, ids array<int>, bounds array<bigint>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids). Null ids give an empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(model_path)
        for batch in batches:
            texts = [model.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, text string")


_DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, covered_bytes bigint"


def round_trip(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode with an end id, decode, and keep only digests (ids and spans are many times the text).

    One row per row: doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes: the bytes of the
    text that lie in spans of pieces. Nulls and other cases as in ``encode_documents``.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(model_path)
        decimal = [str(i) for i in range(len(model.sizes))]
        for batch in batches:
            counts, encoded, decoded, covered = [], [], [], []
            for ids, bounds in model.encode(batch.column(1).to_pylist()):
                every = [*ids.tolist(), model.end]
                counts.append(len(every))
                encoded.append(hashlib.sha256(" ".join(map(decimal.__getitem__, every)).encode()).hexdigest())
                decoded.append(hashlib.sha256(model.decode(every).encode()).hexdigest())
                covered.append(int(bounds[-1] - bounds[0]))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]
            columns.append(pa.array(covered, pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, [field.split()[0] for field in _DIGESTS.split(", ")])

    return _columns(docs, doc_id, text).mapInArrow(run, _DIGESTS)
