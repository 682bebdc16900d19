"""Token ids of the byte-level vocabulary, by chunks that repeat."""

from __future__ import annotations

import json
import re
from array import array
from functools import cached_property, lru_cache

END = "<|endoftext|>"
_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?!\S)")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Recent(dict):
    """A bounded memo: two generations, of which the older goes when the younger is full."""

    def __init__(self, make, most: int = 120_000, longest: int = 64):
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class ByteTokens:
    """ids(text) equals the tokenizers library's ids for the vocabulary file, as little-endian unsigned 32-bit integers.

    A space before a visible character always starts a new pre-token, so texts are cut there and each
    distinct chunk is encoded once.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        vocab, alphabet = json.load(open(path, encoding="utf-8"))["model"]["vocab"], byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items()}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self._fast = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self._bare, self._spaced = Recent(self._one, 10_000), Recent(lambda chunk: self._one(" " + chunk))

    @cached_property
    def exact(self):
        """The library's own tokenizer, which is loaded only for texts that hold an added token."""
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(self.path)
        exact.no_truncation()
        exact.no_padding()
        return exact

    def _one(self, chunk: str) -> bytes:
        ids = self.exact.encode(chunk, add_special_tokens=False).ids if END in chunk else self._fast(chunk)
        return array("I", ids).tobytes()

    def ids(self, text: str) -> bytes:
        parts = _CUT.split(text) if _ODD.search(text) else text.split(" ")
        return self._bare[parts[0]] + b"".join(map(self._spaced.__getitem__, parts[1:]))


@lru_cache(maxsize=2)
def byte_tokens(path: str) -> ByteTokens:
    return ByteTokens(path)
