"""BPE encoding and decoding with forced boundaries."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.common import arrow_rows
from rowmill.llm.tokens import Recent, byte_alphabet


class ForcedBoundaryBpe:
    """Encodes as the tokenizers library does with the vocabulary file, and decodes.

    Two byte symbols that stand side by side inside no token of the vocabulary can never be merged across, so
    the place between them is a certain cut. Pre-tokens are cut at all such places, each fragment is encoded on
    its own, and the ids are concatenated. Added tokens are matched first, in the raw text.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, self.suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        self.vocab = model["vocab"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.symbol = {b: c for c, b in byte_alphabet().items()}
        self.names = {i: t for t, i in (self.vocab | self.added).items()}
        self.digits = {i: str(i) for i in self.names}
        inner, last = set(), set()
        for token in self.vocab:
            whole = bool(self.suffix) and token.endswith(self.suffix) and len(token) > len(self.suffix)
            body = token[: -len(self.suffix)] if whole else token
            inner.update(zip(body, body[1:]))
            if whole and len(body) > 1:
                last.add((body[-2], body[-1]))
        self.joined, self.joined_last = inner, last if self.suffix else inner
        self._split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self._added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self._fragments = Recent(self._merge, 20_000)
        self._tokens = Recent(self._token, 90_000)
        self._chunks = Recent(self._chunk, 120_000)

    def cuts(self, symbols: str) -> list[str]:
        """A pre-token's fragments; the suffix that ends words goes with the last symbol of the last one."""
        pairs = list(zip(symbols, symbols[1:]))
        end = "\0" if self.suffix else ""
        if self.joined.issuperset(pairs[:-1]) and self.joined_last.issuperset(pairs[-1:]):
            return [symbols + end]
        out, start = [], 0
        for k, pair in enumerate(pairs):
            if pair not in (self.joined if k < len(pairs) - 1 else self.joined_last):
                out.append(symbols[start : k + 1])
                start = k + 1
        return [*out, symbols[start:] + end]

    def _merge(self, fragment: str) -> tuple[int, ...]:
        """Merge the pair of lowest rank, leftmost first, until none is left; a heap keeps long fragments cheap. A trailing NUL marks a word's end."""
        part: list[str | None] = list(fragment.rstrip("\0"))
        if fragment.endswith("\0"):
            part[-1] += self.suffix
        n, ranks = len(part), self.ranks
        if n <= 48:
            rank, none = ranks.get, len(ranks)
            near = [rank(pair, none) for pair in zip(part, part[1:])]
            while near and (low := min(near)) < none:
                k = near.index(low)
                part[k] += part.pop(k + 1)
                del near[k]
                if k:
                    near[k - 1] = rank((part[k - 1], part[k]), none)
                if k < len(near):
                    near[k] = rank((part[k], part[k + 1]), none)
        else:
            before, after = list(range(-1, n - 1)), [*range(1, n), -1]
            heap = [(r, k, part[k], part[k + 1]) for k in range(n - 1) if (r := ranks.get((part[k], part[k + 1]))) is not None]
            heapify(heap)
            while heap:
                _, k, a, b = heappop(heap)
                j = after[k]
                if part[k] != a or j < 0 or part[j] != b:
                    continue
                part[k], part[j] = a + b, None
                after[k] = after[j]
                if after[k] >= 0:
                    before[after[k]] = k
                    if (r := ranks.get((part[k], part[after[k]]))) is not None:
                        heappush(heap, (r, k, part[k], part[after[k]]))
                if (i := before[k]) >= 0 and (r := ranks.get((part[i], part[k]))) is not None:
                    heappush(heap, (r, i, part[i], part[k]))
        return tuple(self.vocab[p] for p in part if p is not None)

    def _token(self, token: str) -> tuple[int, ...]:
        symbols = token if token.isascii() and token.isalnum() else "".join(map(self.symbol.__getitem__, token.encode("utf-8")))
        cut = self.cuts(symbols)
        return self._merge(cut[0]) if len(cut) == 1 else tuple(chain.from_iterable(map(self._fragments.__getitem__, cut)))

    def _plain(self, text: str) -> list[int]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return list(chain.from_iterable(map(self._tokens.__getitem__, self._split.findall(text.lower()))))

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        if not chunk:
            return ()
        last = chunk[-1]
        body = chunk[:-1] if last in ".,;:!?" else chunk
        if body.isalpha():  # one word, perhaps with a mark behind it
            if not body.isascii():
                body = unicodedata.normalize("NFC", body).replace("Σ", "σ")
            body = body.lower()
            if body.isalpha():
                return self._tokens[body] if len(body) and last.isalpha() else self._tokens[body] + self._tokens[last]
        out, at = [], 0
        for m in self._added.finditer(chunk) if self._added and "<" in chunk else ():
            out += [*self._plain(chunk[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return tuple(out + self._plain(chunk[at:]))

    def encode(self, text: str | None) -> list[int]:
        """ids of a text; no pre-token and no added token has a space in it, so chunks between spaces are independent."""
        return list(chain.from_iterable(map(self._chunks.__getitem__, (text or "").split(" "))))

    def decode(self, ids: list[int]) -> str:
        """The tokens' names with spaces between them, as decode() of a file without a decoder gives; ids out of the vocabulary are skipped."""
        try:
            return " ".join(map(self.names.__getitem__, ids))
        except (KeyError, IndexError):
            return " ".join(self.names[i] for i in ids if i in self.names)


@lru_cache(maxsize=2)
def forced_boundary_bpe(path: str) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path)


def encode(docs: DataFrame, *, vocab: str) -> DataFrame:
    """doc_id, ids array<int>, decoded for every row of docs (doc_id, text).

    Null and empty texts have no ids and decode to the empty text. Rows that repeat are encoded each, null ids
    stay null, other columns are ignored, and an empty table gives no rows. Memory is bounded by one text and the memo.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = forced_boundary_bpe(vocab)
        for ids, texts in arrow_rows(batches, "doc_id", "text", most=500):
            tokens = [bpe.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.list_(pa.int32())), pa.array(map(bpe.decode, tokens), pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode()'s rows."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
