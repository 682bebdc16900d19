"""Language identification by unigram piece models with all segmentations summed."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowmill.llm.common import arrow_rows, remainder
from rowmill.llm.tokens import byte_alphabet

#: Probability of a letter that no piece covers, cells of a batch of words, and how often sums of longer words are rescaled.
FLOOR, CELLS, RESCALE = 1e-7, 200_000, 16
_RUN = re.compile(r"[^\W\d_]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> list[str]:
    """Pieces of a byte-level vocabulary file that are whole characters, in lower case, a leading space being a word's start."""
    alphabet = byte_alphabet()
    out = set()
    for token in json.load(open(path, encoding="utf-8"))["model"]["vocab"]:
        try:
            piece = bytes(alphabet[c] for c in token).decode("utf-8").lower()
        except (UnicodeDecodeError, KeyError):
            continue
        if piece.strip() and all(c.isalpha() or (c == " " and k == 0) for k, c in enumerate(piece)):
            out.add(piece)
    return sorted(out)


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters."""
    words = _RUN.findall(text.lower())
    if not text.isascii():  # digits of other kinds count as word characters, but are no letters
        words = [p for w in words for p in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]
    return words


class Trie:
    """Pieces as a trie whose edges lie in an open hash table; every edge is found within the longest run of probes that building it met."""

    def __init__(self, pieces: list[str]):
        edges, end = {}, [-1]
        for number, piece in enumerate(pieces):
            node = 0
            for c in piece:
                key = node << 21 | ord(c)
                if key not in edges:
                    edges[key] = len(end)
                    end.append(-1)
                node = edges[key]
            end[node] = number
        self.end, bits = np.array(end, np.int64), max(4, (4 * len(edges)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.child, self.probes = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64), 1
        for key, child in edges.items():
            slot, n = ((key * int(_MUL)) & 0xFFFFFFFFFFFFFFFF) >> (64 - bits), 1
            while self.keys[slot] >= 0:
                slot, n = (slot + 1) & self.mask, n + 1
            self.keys[slot], self.child[slot], self.probes = key, child, max(self.probes, n)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The children of nodes by a letter; -1 where there is none."""
        key = node << 21 | code
        slot = ((key.view(np.uint64) * _MUL) >> self.shift).view(np.int64)
        out = np.where(self.keys[slot] == key, self.child[slot], -1)
        left = np.flatnonzero((out < 0) & (self.keys[slot] >= 0))
        for _ in range(self.probes - 1):
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & self.mask
            here = self.keys[slot[left]]
            good = here == key[left]
            out[left[good]] = self.child[slot[left[good]]]
            left = left[~good & (here >= 0)]
        return out

    def at(self, codes: np.ndarray, i: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(end, rows, piece) for all pieces that begin at one place of words of one length."""
        rows, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        for j in range(i + 1, codes.shape[1] + 1):
            node = self.step(node, codes[rows, j - 1])
            alive = node >= 0
            rows, node = rows[alive], node[alive]
            if not len(rows):
                return
            piece = self.end[node]
            some = piece >= 0
            if some.any():
                yield j, rows[some], piece[some]


class PieceModel:
    """For each language a probability for each piece; a text's is that of its words, and a word's is the sum over all its segmentations.

    Characters in no piece count as one unknown piece with one small probability in every language. All pieces of
    the vocabulary are used, words may be of any length, and words of one length are scored together.
    """

    def __init__(self, pieces: list[str], languages: list[str]):
        self.pieces, self.languages = pieces, languages
        self.logp = np.zeros((len(pieces), len(languages)))
        self.trie, self.longest = Trie(pieces), max(map(len, pieces), default=1)

    def forward(self, codes: np.ndarray, prob: np.ndarray, kept: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For every beginning of words of one length the sum over all its segmentations, and the logarithm of what it was divided by.

        Sums of longer words are rescaled now and then, so that none vanishes. `kept` gets each place's pieces.
        """
        n, length = codes.shape
        alpha = np.zeros((length + 1, n, prob.shape[1]))
        log = np.zeros((length + 1 if length > 2 * RESCALE else 1, n, prob.shape[1]))
        alpha[0] = 1
        for i in range(length):
            if len(log) > 1 and i and i % RESCALE == 0:
                most = alpha[i].copy()
                alpha[i : i + self.longest + 1] /= most
                log[i:] += np.log(most)
            alpha[i + 1] += alpha[i] * FLOOR
            found = list(self.trie.at(codes, i))
            for j, rows, piece in found:
                p = prob[piece] if j > i + 1 else np.maximum(prob[piece], FLOOR) - FLOOR
                alpha[j, rows] += alpha[i, rows] * p
            if kept is not None:
                kept.append(found)
        return alpha, log

    def _batches(self, words: dict[str, float] | list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
        """Words of one length, with a space before them, and their letters."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, some in by_length.items():
            step = max(1, CELLS // (length + 1))
            for at in range(0, len(some), step):
                part = some[at : at + step]
                yield part, np.frombuffer(" ".join(["", *part]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), length + 1).astype(np.int64)

    def word_logp(self, words: list[str]) -> np.ndarray:
        """Log probability of each different word in each language."""
        out = np.zeros((len(words), len(self.languages)))
        prob, where = np.exp(self.logp), {w: k for k, w in enumerate(words)}
        for part, codes in self._batches(words):
            alpha, log = self.forward(codes, prob)
            out[[where[w] for w in part]] = np.log(alpha[-1]) + log[-1]
        return out

    def fit(self, counts: list[Counter], rounds: int = 3, smooth: float = 0.1) -> None:
        """Expectation-maximisation for each language over its words' counts, from how often each piece is a substring."""
        for lang, count in enumerate(counts):
            groups = [(codes, np.array([count[w] for w in part], float)) for part, codes in self._batches(count)]
            prob = None
            for _ in range(rounds):
                got = np.full(len(self.pieces), smooth)
                for codes, n in groups:
                    self._expect(codes, n, prob, got)
                prob = got / got.sum()
            with np.errstate(divide="ignore"):
                self.logp[:, lang] = np.log(prob) if prob is not None else -np.log(len(self.pieces))

    def _expect(self, codes: np.ndarray, n: np.ndarray, prob: np.ndarray | None, got: np.ndarray) -> None:
        """Add how often each piece is expected in the words, n times each."""
        length = codes.shape[1]
        if prob is None:
            for i in range(length):
                for _, rows, piece in self.trie.at(codes, i):
                    got += np.bincount(piece, n[rows] / length, minlength=len(got))
            return
        kept: list = []
        alpha, log = self.forward(codes, prob[:, None], kept)
        alpha, log = alpha[:, :, 0], log[:, :, 0]
        whole = np.log(alpha[-1]) + log[-1]
        beta, after = np.zeros((length + 1, len(codes))), np.zeros(len(codes))
        beta[length] = 1
        for i in range(length - 1, -1, -1):
            share = n * np.exp(log[min(i, len(log) - 1)] + after - whole)
            beta[i] = beta[i + 1] * FLOOR
            for j, rows, piece in kept[i]:
                p = np.maximum(prob[piece], FLOOR if j == i + 1 else 0)
                got += np.bincount(piece, share[rows] * alpha[i, rows] * p * beta[j, rows], minlength=len(got))
                beta[i, rows] += (p - FLOOR if j == i + 1 else p) * beta[j, rows]
            if len(log) > 1 and i % RESCALE == 0:
                most = beta[i].copy()
                beta[i : i + self.longest + 1] /= most
                after = after + np.log(most)

    def predict(self, texts: list[str | None], memo: "Scored") -> list[tuple[str, float]]:
        """(language, share of its probability) of whole texts; "und" with 0 where no letter is."""
        split = [words_of(t) if t else [] for t in texts]
        memo.add({w for words in split for w in words}, self)
        out = []
        for words in split:
            if not words:
                out.append(("und", 0.0))
                continue
            total = memo.rows[np.fromiter(map(memo.at.__getitem__, words), np.int64, len(words))].sum(axis=0)
            scaled = (total - total.max()) / len(words) ** 0.5  # words of one text are not independent
            share = np.exp(scaled) / np.exp(scaled).sum()
            out.append((self.languages[int(np.argmax(total))], float(share.max())))
        return out


class Scored:
    """Words scored so far, at most so many besides those of one call; emptied when full."""

    def __init__(self, most: int = 200_000):
        self.most, self.at, self.rows = most, {}, None

    def add(self, words: set[str], model: PieceModel) -> None:
        if len(self.at) + len(words) > self.most:
            fresh = list(words)
            self.at, self.rows = {}, None
        else:
            fresh = list(words.difference(self.at))
        start = len(self.at)
        self.at.update(zip(fresh, range(start, start + len(fresh))))
        if self.rows is None or start + len(fresh) > len(self.rows):
            grown = np.zeros((max(self.most, start + len(fresh)), len(model.languages)))
            if self.rows is not None:
                grown[:start] = self.rows[:start]
            self.rows = grown
        self.rows[start : start + len(fresh)] = model.word_logp(fresh)


@lru_cache(maxsize=1)
def _scored(stamp: str) -> Scored:
    """A worker's memo, kept from task to task for the same model."""
    return Scored()


def train(docs: DataFrame, *, vocab: str, per_language: int = 250, max_chars: int = 8_000_000) -> PieceModel | None:
    """Fitted on at most per_language documents of each language, of max_chars characters together, outside the held-out fold; None where there are none.

    Spark keeps the first few ids of each language in every task before any shuffle, so a language with most of the rows costs no more.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 4) != 2))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id"))
    ids, used = [], Counter()
    for r in known.select("lang", "doc_id", F.length("text").alias("n")).withColumn("nth", nth).where(F.col("nth") <= per_language).orderBy("lang", "nth").collect():
        if used[r["lang"]] + r["n"] <= max_chars:
            used[r["lang"]] += r["n"]
            ids.append(r["doc_id"])
    counts: dict[str, Counter] = {}
    for r in known.where(F.col("doc_id").isin(ids)).select("lang", "text").collect() if ids else []:
        counts.setdefault(r["lang"], Counter()).update(words_of(r["text"]))
    languages = sorted(counts)
    if not any(counts.values()):
        return None
    model = PieceModel(vocabulary(vocab), languages)
    model.fit([counts[lang] for lang in languages])
    return model


def identify(docs: DataFrame, model: PieceModel | None) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs (doc_id, text).

    Null texts and texts without a letter are "und" with score 0, as is everything where nothing was learned;
    between languages that are equally likely the first by name is chosen.
    Rows that repeat are predicted each, null ids stay null, other columns are ignored. No shuffle; whole texts.
    """

    stamp = hashlib.sha256(model.logp.tobytes()).hexdigest() if model else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _scored(stamp)
        for ids, texts in arrow_rows(batches, "doc_id", "text", most=400):
            found = model.predict(texts, memo) if model else [("und", 0.0)] * len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
