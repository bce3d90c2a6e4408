"""Token ids by a given tokenizer file, piece by piece.

A byte-level tokenizer splits a text by a pattern and encodes every match for itself, so
distinct matches go through the library's model, many in one call, and are remembered (a
bounded number of them).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

#: The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 characters for
#: themselves, the other bytes, in order, from U+0100 on.  FF isn't used in UTF-8 and stands for a space here.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_CHARS = np.arange(256, dtype="<u4")
_OTHERS = np.setdiff1d(_CHARS, _PRINTABLE)
_CHARS[_OTHERS] = 0x100 + np.arange(len(_OTHERS))
_CHARS[0xFF] = ord(" ")


#: Texts without a character from here on are split by the standard library's engine.
PLAIN = 0x3000


def _class(expression: str) -> str:
    """The characters under PLAIN that match, as the inside of a character class."""
    match = regex.compile(expression).match
    out, start = [], None
    for c in range(PLAIN + 1):
        inside = c < PLAIN and match(chr(c)) is not None
        if inside and start is None:
            start = c
        if not inside and start is not None:
            out.append(f"\\u{start:04x}-\\u{c - 1:04x}")
            start = None
    return "".join(out)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """``regex.findall`` of a pattern.  Where it uses only the classes of letters, numbers and white
    space, texts of characters under PLAIN go through the same pattern with these classes
    written out, which the standard library's faster engine takes."""
    full = regex.compile(pattern).findall
    letters, numbers, space = _class(r"\p{L}"), _class(r"\p{N}"), _class(r"\s")
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]")
    for name, inside in ((r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\S", f"[^{space}]"), (r"\s", f"[{space}]")):
        plain = plain.replace(name, inside)
    if re.search(r"\\[^u]|\(\?[^!=:]|[*+?]\+|&&|--", plain):  # anything else may differ
        return full
    quick, beyond = re.compile(plain).findall, re.compile(f"[\\u{PLAIN:04x}-\U0010ffff]").search
    return lambda text: full(text) if beyond(text) else quick(text)


class PieceIds(dict):
    """A match of the split pattern to its number; ``flat`` holds the ids of all numbers, one after the
    other, and ``ends`` where those of each begin and end.

    Matches that aren't remembered go through the library's model together, since a call for each
    costs more than their merging.  A text that holds a token added to the file
    (``<|endoftext|>``) is encoded by the library as a whole, so that such a token gets its own
    id, as by ``Tokenizer.encode``."""

    #: Bytes that remembered matches take, those of each besides its characters (about), and matches of texts that are held at once.
    BYTES, EACH, GROUP = 90_000_000, 170, 50_000

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = splitter(public_tokenizers.PATTERN)
        # the same model; no character that stands for a byte is white space
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = WhitespaceSplit()
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.size, self.new = 0, []
        self.flat, self.ends = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n

    def _learn(self) -> None:
        """Ids of the new matches.  Byte FF, which UTF-8 doesn't use, goes between them."""
        if not self.new:
            return
        joined = "\udcff".join(self.new).encode("utf-8", "surrogateescape")
        found = self.words.encode(_CHARS[np.frombuffer(joined, np.uint8)].tobytes().decode("utf-32-le"), add_special_tokens=False)
        counts = np.bincount(np.array(found.word_ids, np.int64), minlength=len(self.new))
        self.flat = np.concatenate([self.flat, np.array(found.ids, "<u4")])
        self.ends = np.concatenate([self.ends, self.ends[-1] + counts.cumsum()])
        self.size += len(joined) + self.EACH * len(self.new)
        self.new = []

    def _group(self, split: list[list[str]], whole: dict[int, bytes]) -> Iterator[bytes]:
        if self.size >= self.BYTES:
            self._forget()
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64)
        self._learn()
        first, counts = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        at = np.concatenate([[0], counts.cumsum()])  # where each match's ids begin in this group
        ids = self.flat[np.repeat(first - at[:-1], counts) + np.arange(at[-1])]
        bounds = at[[0, *accumulate(map(len, split))]].tolist()
        for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
            yield whole[i] if i in whole else ids[low:high].tobytes()

    def each(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in order, as little-endian unsigned 32-bit bytes."""
        split, whole, held = [], {}, 0
        for text in texts:
            if any(t in text for t in self.added):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                whole[len(split)] = np.array(ids, "<u4").tobytes()
                split.append([])
                held += len(ids)
            else:
                split.append(self.split(text))
                held += len(split[-1])
            if held >= self.GROUP:
                yield from self._group(split, whole)
                split, whole, held = [], {}, 0
        yield from self._group(split, whole)


@lru_cache(maxsize=2)
def piece_ids(path: str) -> PieceIds:
    """One per worker process, so that what it remembers serves all of its tasks."""
    return PieceIds(path)
