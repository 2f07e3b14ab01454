"""Token ids of whole texts by a byte-level BPE vocabulary."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import tiktoken
from tokenizers import Tokenizer

END_ID = 0

# Fixed value: how a byte-level vocabulary of this kind cuts a text into words.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters such a vocabulary writes bytes with: printable bytes as themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """The ids that ``tokenizers`` gives without adding special tokens, as little-endian unsigned 32-bit numbers.

    Texts are encoded by ``tiktoken``, several times as fast, over the same vocabulary;
    this needs ids in the order of the merges. Texts with special tokens
    inside, and vocabularies of another kind, are left to ``tokenizers``. No words are kept: where most are new,
    keeping them costs more than encoding, and it gains little where they repeat.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = [token["content"] for token in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.fast = self._ranked(spec, set(special))

    @staticmethod
    def _ranked(spec: dict, special: set[str]) -> tiktoken.Encoding | None:
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        merges = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in spec["model"]["merges"]]
        vocabulary = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        ordered = [vocabulary.get(m, -1) for m in merges]
        if not plain or spec.get("normalizer") or ordered != sorted(set(ordered)) or -1 in ordered:
            return None
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items()}
        return tiktoken.Encoding("words", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        if self.fast is not None and not (self.special and self.special.search(text)):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:  # a stretch of white space too long for its patterns
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        return map(self.whole, texts)
