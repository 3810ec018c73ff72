"""Ids of whole texts from a tokenizer file, word by word with a bounded memory of words.

The library encodes every distinct word once per worker and memory; a text's
ids are its words' ids in a row. That is exact where words can't influence
each other, which holds for both kinds of file:

- ``attached``: byte-level BPE whose pre-tokens carry a leading space. A
  pre-token always ends before white space, and what precedes a pre-token
  doesn't matter, so a text can be cut before each run of plain white space.
- ``dropped``: white space only separates.

A text with white space other than space, tab and line ends (or signs that
libraries class differently) goes to the library whole in the first kind. A
probe compares both ways when a tokenizer is loaded.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np

from tillwater.llm.common import keeps

#: Words that a worker learns before it lets go of those it hasn't met since it learnt as many before.
REMEMBERED = 700_000

_CHUNKS = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: White space of either library, or of Python, less the plain kinds above.
_ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_PROBE = "It's  a probe:\tx1y,\n\nthe  END... don't \r\n stopé 中文 '' 's ' s\n"


class _Words(dict):
    """Word to packed ids; a word that isn't there is encoded by the library."""

    def __init__(self, encode, prefix: str):
        super().__init__()
        self.encode, self.prefix, self.older = encode, prefix, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        out = self.older.get(word)
        if out is None:
            out = self.encode(self.prefix + word if word[:1] != "\n" else word)
        self[word] = out
        return out


class TextIds:
    """Packed ids of texts; ``width`` is the bytes of an id, 2 where the vocabulary allows it."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        if kind not in ("attached", "dropped"):
            raise ValueError(f"no such kind of tokenizer: {kind}")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # such strings in a text are ordinary text
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.kind = kind
        self.spaced, self.plain = _Words(self.whole, " "), _Words(self.whole, "")
        if self.packed(_PROBE) != self.whole(_PROBE):
            raise ValueError(f"{path} isn't a tokenizer of kind {kind}")

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def packed(self, text: str) -> bytes:
        if self.kind == "dropped":
            words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            return b"".join(map(self.plain.__getitem__, words))
        if _ODD_SPACE.search(text):
            return self.whole(text)
        lines = text.replace("\n", " \n")
        if "  " in lines or "\n " in lines or "\t" in text or "\r" in text or text[-1:] in (" ", "\n"):
            return b"".join(map(self.plain.__getitem__, _CHUNKS.findall(text)))
        words = lines.split(" ")
        return self.plain[words[0]] + b"".join(map(self.spaced.__getitem__, words[1:]))

    def unsigned32(self, packed: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return np.frombuffer(packed, f"<u{self.width}").astype("<u4").tobytes()


@lru_cache(maxsize=2)
def text_ids(path: str, kind: str) -> TextIds:
    """One per worker process, until another operator needs the room."""
    keeps("tokens", text_ids.cache_clear)
    return TextIds(path, kind)
