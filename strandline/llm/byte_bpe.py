"""Ids of a byte-level BPE tokenizer file, text by text, with a memo of what stands between spaces.

A pre-token of the file's pattern holds a space only as its first character or inside a run of white space. So where a single space
has other characters than white space on both sides a pre-token starts, and what stands between such spaces encodes alone, with its
space. A text in which every space is single is cut at its spaces and each part is looked up; any other text is encoded whole.
Parts that are new are encoded by the rank file of the same vocabulary if all their characters lie in blocks whose letters, digits and
white space the two libraries class alike; others, and parts that hold a special token's string, by the tokenizer file's own library.
The memo is emptied when full, so a worker's memory stays bounded.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable

#: Latin, Greek and Cyrillic, general punctuation and currency: characters that all versions of the libraries class alike.
PLAIN = re.compile("[\\x00-\\x7f\xa1-ͷ΄-҂Ҋ-ԯ‐-‧‰-⁞₠-₿]*")
#: Parts that a memo holds, and the longest part it keeps.
MOST, LONGEST = 300_000, 64


class Unsafe(Exception):
    """A part can't be encoded alone."""


class Memo(dict):
    """make(part) for parts between single spaces; raises Unsafe for a part that is empty or has white space at an end."""

    def __init__(self, make: Callable, most: int = MOST):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, part: str):
        if not part or part[0].isspace() or part[-1].isspace():
            raise Unsafe
        got = self.make(part)
        if len(part) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[part] = got
        return got


class ByteBPE:
    """Encoder of a tokenizer file. special: whether special tokens' strings in a text count as these tokens."""

    def __init__(self, file: str, ranks: str | None = None, special: bool = True):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(file)
        self.lib.encode_special_tokens = not special
        added = [t.content for t in self.lib.get_added_tokens_decoder().values()] if special else []
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        if any(" " in t for t in added):
            raise ValueError("special tokens with spaces inside")
        self.quick = _ranked(ranks) if ranks else None
        if self.quick and any(self.quick.encode_ordinary(t) != self.lib.encode(t, add_special_tokens=False).ids for t in ("It's 12,5 naïve  words\n\n of\tthat", " αбß--")):
            raise ValueError("the rank file has another vocabulary")
        self.first, self.later = Memo(self._packed), Memo(lambda part: self._packed(" " + part))

    def ids(self, text: str) -> list[int]:
        """Ids of a text, special tokens at its ends not added."""
        if self.quick and PLAIN.fullmatch(text) and not self.added.search(text):
            return self.quick.encode_ordinary(text)
        return self.lib.encode(text, add_special_tokens=False).ids

    def _packed(self, text: str) -> bytes:
        return array("I", self.ids(text)).tobytes()

    def packed(self, text: str) -> bytes:
        """Ids as unsigned 32-bit numbers in the byte order of the machine."""
        head, *rest = text.split(" ")
        try:
            return b"".join([self.first[head], *map(self.later.__getitem__, rest)])
        except Unsafe:
            return self._packed(text)

    def token_bytes(self) -> list[bytes]:
        """Bytes of each id: the file writes every byte as a character of its own."""
        table = {c: b for b, c in _byte_characters().items()}
        shown = self.lib.get_vocab(with_added_tokens=False)
        out = [b""] * (max(shown.values(), default=-1) + 1)
        for token, i in shown.items():
            out[i] = bytes([table[c] for c in token])
        return out


def _ranked(file: str):
    import public_tokenizers
    import tiktoken

    with open(file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes of Latin-1 stand for themselves, the others in order for what follows U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + n) for n, b in enumerate(others)}


_ENCODERS: dict[tuple, ByteBPE] = {}


def encoder(file: str, ranks: str | None = None, special: bool = True) -> ByteBPE:
    """The encoder of a tokenizer file, kept for the life of a Python worker."""
    key = file, ranks, special
    if key not in _ENCODERS:
        _ENCODERS[key] = ByteBPE(*key)
    return _ENCODERS[key]
