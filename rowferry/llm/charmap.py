"""Text normalisation through a model's compiled character map, with the source place of every byte.

The map is a double-array trie over UTF-8 bytes, followed by the replacements.
At each place the longest key that begins there is replaced; a character
without a key stays. Only places where a key can begin are looked at, the rest of the
text is copied as it is.
"""

from __future__ import annotations

import re
import struct

import numpy as np

SPACE = "▁"
_ANY_SPACE = " "


def _trie_entries(trie: np.ndarray) -> dict[bytes, int]:
    """All keys of a double-array trie with their values."""
    found: dict[bytes, int] = {}
    stack = [(0, b"")]
    labels = np.arange(1, 256, dtype=np.uint32)
    while stack:
        at, key = stack.pop()
        unit = int(trie[at])
        base = at ^ ((unit >> 10) << ((unit & 0x200) >> 6))
        if unit & 0x100:
            found[key] = int(trie[base]) & 0x7FFFFFFF
        places = base ^ labels
        inside = labels[places < len(trie)]
        # A unit with its label and no leaf flag is a child.
        for label in inside[(trie[base ^ inside] & np.uint32(0x800000FF)) == inside]:
            stack.append((base ^ int(label), key + bytes([int(label)])))
    return found


def read_charmap(blob: bytes) -> dict[str, str]:
    """The replacements of a compiled character map; keys that are no whole characters are left out."""
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    replacements = blob[4 + size :]
    out = {}
    for key, at in _trie_entries(np.frombuffer(blob, "<u4", size // 4, 4)).items():
        try:
            out[key.decode()] = replacements[at : replacements.index(b"\0", at)].decode()
        except UnicodeDecodeError:
            continue
    return out


class Normalizer:
    """What a model does to a text before it is cut into pieces."""

    def __init__(self, charmap: dict[str, str], dummy_prefix: bool, one_space: bool, escape: bool, suffix: bool = False):
        self.charmap = charmap
        self.lengths = sorted({len(key) for key in charmap}, reverse=True)
        firsts = "".join(re.escape(c) for c in sorted({key[0] for key in charmap}))
        self.first = re.compile(f"[{firsts}]") if firsts else None
        self.dummy_prefix, self.one_space, self.escape, self.suffix = dummy_prefix, one_space, escape, suffix

    def _edits(self, text: str) -> list[tuple[int, int, str]]:
        """(begin, end, replacement) in characters, from left to right."""
        found, at = [], 0
        while match := self.first.search(text, at):
            begin = match.start()
            for length in self.lengths:
                key = text[begin : begin + length]
                if len(key) == length and key in self.charmap:
                    found.append((begin, begin + length, self.charmap[key]))
                    at = begin + length
                    break
            else:
                at = begin + 1
        return found

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the byte of ``text`` it comes from.

        A replaced key gives all bytes of its replacement the key's first byte. The
        dummy prefix comes from the first byte of what follows it.
        """
        source = np.frombuffer(text.encode(), dtype=np.uint8)
        origin = None
        if self.first is not None and (edits := self._edits(text)):
            text, origin = self._replaced(text, edits)
        return self._spaced(text, origin, len(source))

    @staticmethod
    def _replaced(text: str, edits: list[tuple[int, int, str]]) -> tuple[str, np.ndarray]:
        parts, places, at, byte = [], [], 0, 0
        for begin, end, replacement in edits:
            kept, gone = text[at:begin], text[begin:end]
            parts += [kept, replacement]
            size = len(kept.encode())
            places.append(np.arange(byte, byte + size))
            byte += size
            places.append(np.full(len(replacement.encode()), byte))
            byte += len(gone.encode())
            at = end
        tail = text[at:]
        parts.append(tail)
        places.append(np.arange(byte, byte + len(tail.encode())))
        return "".join(parts), np.concatenate(places)

    def _spaced(self, text: str, origin: np.ndarray | None, end: int) -> tuple[str, np.ndarray]:
        """Spaces as the model wants them; ``origin`` (null: every byte comes from itself) follows."""
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        width = np.ones(len(raw), dtype=np.int64)
        space = raw == 0x20
        if self.one_space and space.any():
            before = np.concatenate(([True], space[:-1]))
            kept = ~(space & before)
            last = np.flatnonzero(~space)
            kept[(last[-1] + 1 if len(last) else 0) :] = False
            width[~kept] = 0
            text = raw[kept].tobytes().decode()
            space &= kept
        if not len(text):
            return "", np.array([end])
        if self.escape:
            width[space] = len(SPACE.encode())
            text = text.replace(_ANY_SPACE, SPACE)
        places = np.repeat(np.arange(len(raw)) if origin is None else origin, width)
        blank = SPACE if self.escape else _ANY_SPACE
        if self.dummy_prefix and self.suffix:
            text += blank
            places = np.concatenate((places, np.full(len(blank.encode()), end)))
        elif self.dummy_prefix:
            text = blank + text
            places = np.concatenate((np.full(len(blank.encode()), places[0]), places))
        return text, np.append(places, end)
