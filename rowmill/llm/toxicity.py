"""Toxicity by votes of the nearest labelled examples, found by exact TF-IDF cosine in a block-max inverted index."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.common import arrow_rows, one_thread, release
from rowmill.llm.labelled import sample

#: Examples of a block, blocks scored first, letters of a stem, words of a passage, passages of a text that are asked about first, passages searched together,
#: and the share of examples from which a term's lists are dense.
BLOCK, EARLY, STEM, WINDOW, ASKED, BATCH, DENSE = 64, 4, 5, 6, 4, 1024, 6
#: Of votes in single precision: passages weighed together, postings a passage from which a term takes part in the product, halvings of the row to the
#: number of groups that bound the k-th best cosine, and what no cosine (as a share of it) and no vote is off by.
ROUGH, DEAR, HALVE, OFF, WRONG = 256, 6, 4, 4e-6, 2e-5
_WORD = re.compile(r"[^\W\d_]+")
_SPACED = "".join(c if c.isalpha() else " " for c in map(chr, range(128)))


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    low = (text or "").lower()
    return low.translate(_SPACED).split() if low.isascii() else _WORD.findall(low)


def terms_of(word: str) -> tuple[str, ...]:
    """A word's terms: itself, and of a longer one its first five letters marked with a star."""
    return (word, word[:STEM] + "*") if len(word) > STEM else (word,)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for every range, one after the other."""
    before = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(start - before, length)


def _only(some: np.ndarray, total: int, window: np.ndarray, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms of some of `total` passages, which are numbered anew."""
    number = np.full(total, -1)
    number[some] = np.arange(len(some))
    window = number[window]
    here = window >= 0
    return window[here], term[here], weight[here]


def _alike(rows: np.ndarray) -> np.ndarray:
    """An order that puts alike rows side by side: halves by the strongest direction, down to a block."""
    todo, out = [np.arange(len(rows))], []
    while todo:
        own = todo.pop()
        if len(own) <= BLOCK:
            out.append(own)
            continue
        part = rows[own] - rows[own].mean(axis=0)
        axis = part[np.argmax((part * part).sum(axis=1))]
        for _ in range(12):
            axis = part.T @ (part @ axis)
            axis = axis / max(1e-12, float(np.sqrt(axis @ axis)))
        own = own[np.argsort(part @ axis, kind="stable")]
        cut = -(-len(own) // BLOCK // 2) * BLOCK
        todo += [own[cut:], own[:cut]]
    return np.concatenate(out) if out else np.empty(0, np.int64)


class Words(dict):
    """Numbers of words met so far, and for each the numbers of its term and stem (-1: none); terms of no example get numbers beyond the vocabulary's."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary, self.other = vocabulary, {}
        self.term, self.stem = array("q"), array("q")

    def __missing__(self, word: str) -> int:
        numbers = []
        for t in terms_of(word):
            number = self.vocabulary.get(t)
            numbers.append(self.other.setdefault(t, len(self.vocabulary) + len(self.other)) if number is None else number)
        self.term.append(numbers[0])
        self.stem.append(numbers[1] if len(numbers) > 1 else -1)
        self[word] = out = len(self)
        return out

    def numbers(self) -> tuple[np.ndarray, np.ndarray]:
        return (np.frombuffer(self.term, np.int64), np.frombuffer(self.stem, np.int64)) if self.term else (np.empty(0, np.int64),) * 2


class BlockMaxIndex:
    """Inverted lists of all terms of all examples, cut into blocks of 64 examples, each with its term's largest weight there.

    An example is a labelled document, a query a passage of 6 words; both are vectors over words and stems with
    weight (1 + log tf) * log((1 + n + s) / (df + s)), s a share of n, of length one. For a passage, the sum of a block's largest
    weights times the passage's is no less than any cosine in the block. The two blocks of the largest bounds
    are scored first; every other block whose bound reaches the k-th best cosine so far is scored too, and the rest
    skipped, so the k nearest are exact. The features of a text are the three strongest votes of all its passages and their number. All passages
    are weighed by cosines in single precision, and those that can be among the three strongest, by the errors these may have, are asked, so the
    strongest votes are exact. Of these, the four are asked first whose mean cosine to all examples of label 1 exceeds that to all of label 0
    most, and then only those that still can be. A logistic function, fitted on the examples with each left out of its own votes, makes a score of the features.
    """

    def __init__(self, texts: list[str], labels: list[int], ids: list[int] | None = None, k: int = 31, smooth: float = 0.06, odds: float = 1.0):
        counts = [Counter(t for w, n in Counter(words_of(text)).items() for t in terms_of(w) * n) for text in texts]
        first: dict[tuple, int] = {}
        for i, c in enumerate(counts):  # equal examples with equal labels are one
            first.setdefault((labels[i], frozenset(c.items())), i)
        own = [i for i in first.values() if counts[i]]
        counts = [counts[i] for i in own]
        df = Counter(t for c in counts for t in c)
        self.k, n = k, len(own)
        self.vocabulary = {t: i for i, t in enumerate(sorted(df))}
        held = np.array([df[t] for t in self.vocabulary], float)
        idf = np.log(1 + n / (np.append(held, 0) + max(1, smooth * n)))
        self.idf = idf  # the last one is that of terms in no example
        row = np.repeat(np.arange(n), [len(c) for c in counts])
        term = np.array([self.vocabulary[t] for c in counts for t in c], np.int64)
        weight = (1 + np.log(np.array([f for c in counts for f in c.values()], float))) * idf[term]
        weight = weight / np.sqrt(np.bincount(row, weight * weight, minlength=n))[row]
        del counts, df, first  # most of what the driver holds

        frequent = np.full(len(self.vocabulary) + 1, -1)
        top = np.argsort(-held, kind="stable")[:512]
        frequent[top] = np.arange(len(top))
        dense = np.zeros((n, len(top)))
        some = frequent[term] >= 0
        dense[row[some], frequent[term[some]]] = weight[some]
        order = _alike(dense)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.label = np.array([labels[own[i]] for i in order], float)
        self.example = np.array([(ids or range(len(texts)))[own[i]] for i in order], np.int64)
        self.prior = float(np.clip(self.label.mean(), 0.01, 0.99)) if n else 0.5

        self.blocks = -(-n // BLOCK)
        common = np.flatnonzero(held > n / DENSE)  # dense lists, a tile of them for each block
        self.dense = np.full(len(self.vocabulary), -1)
        self.dense[common] = np.arange(len(common))
        self.tiles = np.zeros((self.blocks, len(common), BLOCK))
        toxic = np.array([labels[i] for i in own], float)
        mean = [np.bincount(term, weight * (toxic == y)[row], minlength=len(self.vocabulary)) / max(1, (toxic == y).sum()) for y in (0, 1)]
        self.lean = mean[1] - mean[0]
        row = place[row]
        self.wide = -(-n // (1 << HALVE)) << HALVE
        self.row, self.usual = frequent, held[top]
        self.rows = np.zeros((len(top), self.wide), np.float32)
        some = frequent[term] >= 0
        self.rows[frequent[term[some]], row[some]] = weight[some]
        sort = np.argsort(term, kind="stable")
        self.at, self.light = row[sort], weight[sort].astype(np.float32)
        self.postings = np.searchsorted(term[sort], np.arange(len(self.vocabulary) + 1))
        some = self.dense[term] >= 0
        self.tiles[row[some] // BLOCK, self.dense[term[some]], row[some] % BLOCK] = weight[some]
        row, term, weight = row[~some], term[~some], weight[~some]
        sort = np.lexsort((row, term))
        row, term, weight = row[sort], term[sort], weight[sort]
        self.place, self.weight = (row % BLOCK).astype(np.int16), weight
        key = term * (n // BLOCK + 1) + row // BLOCK
        start = np.flatnonzero(np.diff(key, prepend=-1))
        self.start, self.length = start, np.diff(np.append(start, len(key)))
        self.block, self.most = row[start] // BLOCK, np.maximum.reduceat(weight, start) if len(start) else weight
        self.lists = np.searchsorted(term[start], np.arange(len(self.vocabulary) + 1))
        self.words: Words | None = None
        self.most_common = self.tiles.max(axis=2).T if n else np.empty((0, 0))
        self.scale, self.bias = np.zeros(4), 0.0
        if n:
            at = np.full(len(texts), -1)
            at[own] = place
            self._calibrate([texts[i] for i in own], np.array([labels[i] for i in own]), at[own], odds)

    def passages(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of each text's passages, and for each term of a passage: passage, term, weight)."""
        split = [words_of(t) for t in texts]
        size = np.array([len(w) for w in split], np.int64)
        count = -(-size // WINDOW)
        if self.words is None or len(self.words) > 400_000:
            self.words = Words(self.vocabulary)
        word = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, int(size.sum()))
        at = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        window = np.repeat(np.cumsum(count) - count, size) + at // WINDOW
        term, stem = self.words.numbers()
        other = stem[word] >= 0
        key, tf = np.unique(np.append(window << 32 | term[word], window[other] << 32 | stem[word[other]]), return_counts=True)
        window, term = key >> 32, key & 0xFFFFFFFF
        weight = (1 + np.log(tf)) * self.idf[np.minimum(term, len(self.vocabulary))]
        norm = np.sqrt(np.bincount(window, weight * weight, minlength=int(count.sum())))
        good = term < len(self.vocabulary)
        return count, window[good], term[good], weight[good] / norm[window[good]]

    def neighbours(self, count: int, window: np.ndarray, term: np.ndarray, weight: np.ndarray, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, place, cosine) of the k nearest examples of each of `count` passages, nearest first, ties to the earlier place; only those with a
        term in common. `without` names an example for each passage that does not count."""
        none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if not len(term) or not self.blocks:
            return none
        heavy = self.dense[term] >= 0
        common = np.zeros((count, self.tiles.shape[1]))
        common[window[heavy], self.dense[term[heavy]]] = weight[heavy]
        window, term, weight = window[~heavy], term[~heavy], weight[~heavy]
        low = self.lists[term]
        n = self.lists[term + 1] - low
        entry = _ranges(low, n)
        of, w = np.repeat(window, n), np.repeat(weight, n)
        pair = of * self.blocks + self.block[entry]
        bound = np.bincount(pair, w * self.most[entry], minlength=count * self.blocks).reshape(count, self.blocks) + common @ self.most_common

        def scored(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(passage, first place, 64 cosines) of every wanted block."""
            box = np.flatnonzero(wanted.ravel())
            who, block = box // self.blocks, box % self.blocks
            slot = np.zeros(wanted.size, np.int64)
            slot[box] = np.arange(len(box))
            here = wanted.ravel()[pair]
            e, size = entry[here], self.length[entry[here]]
            posting = _ranges(self.start[e], size)
            at = np.repeat(slot[pair[here]] * BLOCK, size) + self.place[posting]
            score = np.bincount(at, np.repeat(w[here], size) * self.weight[posting], minlength=len(box) * BLOCK).reshape(-1, BLOCK).astype(np.float64, copy=False)
            for b in np.unique(block):
                mine = np.flatnonzero(block == b)
                score[mine] += common[who[mine]] @ self.tiles[b]
            if without is not None:
                own = without[who] - block * BLOCK
                here = (own >= 0) & (own < BLOCK)
                score[here, own[here]] = 0
            return who, block * BLOCK, score

        def reaching(who: np.ndarray, first: np.ndarray, score: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            row, col = np.nonzero(score >= np.maximum(least - 1e-9, 1e-15)[who][:, None])
            return who[row], first[row] + col, score[row, col]

        early = min(EARLY, self.blocks)
        wanted = np.zeros(bound.shape, bool)
        np.put_along_axis(wanted, np.argpartition(-bound, early - 1, axis=1)[:, :early], True, axis=1)
        who, first, score = scored(wanted)
        kth = np.zeros(count)
        if early * BLOCK >= self.k:
            kth = np.partition(score.reshape(count, -1), -self.k, axis=1)[:, -self.k]
        found = reaching(who, first, score, kth)
        more = (bound > 0) & ~wanted & (bound >= kth[:, None] - 1e-9)
        self.skipped = 1 - float((more.sum() + wanted.sum()) / more.size)
        if more.any():
            found = tuple(np.concatenate(pair) for pair in zip(found, reaching(*scored(more), kth)))
        who, place, score = found
        order = np.lexsort((place, -np.round(score, 12), who))
        who, place, score = who[order], place[order], score[order]
        keep = np.arange(len(who)) - np.searchsorted(who, who) < self.k
        return who[keep], place[keep], score[keep]

    def _asked(self, count: np.ndarray, window: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The passages that are asked about first, by text: those that lean most to label 1, of equals the earlier."""
        total = int(count.sum())
        lean = np.bincount(window, weight * self.lean[term], minlength=total)
        of = np.repeat(np.arange(len(count)), count)
        order = np.lexsort((np.arange(total), -np.round(lean, 12), of))
        nth = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        return np.sort(order[nth < ASKED])

    def _vote(self, toxic: np.ndarray, clean: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The vote of neighbours with these sums of cosines, `found` in all."""
        toxic, clean = toxic / self.prior, clean / (1 - self.prior)
        return toxic / np.maximum(toxic + clean, 1e-12) * found / self.k

    def _rough(self, count: int, window: np.ndarray, term: np.ndarray, weight: np.ndarray, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """What the vote of each of `count` passages is at least and at most, from its cosines to all examples in single precision.

        Of the frequent terms, those with most postings for the passages at hand are a product of dense rows. The largest k + 1 maxima of groups of
        examples are cosines of different ones, so the k + 1 largest cosines are among those that reach the least of these. Where the k-th and the next are too close to tell, the bounds are wide.
        """
        least, most = np.zeros(count), np.zeros(count)
        if not len(term) or not self.blocks:
            return least, most
        first = np.full(count, len(self.rows))  # passages of one most frequent term side by side, so that a product has few terms
        here = self.row[term] >= 0
        np.minimum.at(first, window[here], self.row[term[here]])
        order = np.argsort(first, kind="stable")
        begin, size = np.searchsorted(window, order), np.bincount(window, minlength=count)[order]
        entry = _ranges(begin, size)
        window, term, weight = np.repeat(np.arange(count), size), term[entry], weight[entry]
        without = None if without is None else without[order]
        label, groups = (self.label == 1).astype(np.int32), self.wide >> HALVE
        scores, best = np.empty((ROUGH, self.wide), np.float32), np.empty((ROUGH, groups), np.float32)
        hits, steps = np.empty((ROUGH, self.wide), bool), np.arange(1)
        edge = np.searchsorted(window, np.arange(0, count + ROUGH, ROUGH))
        held = np.diff(self.postings)
        for b, at in enumerate(range(0, count, ROUGH)):
            size, part = min(ROUGH, count - at), slice(edge[b], edge[b + 1])
            who, t, w = window[part] - at, term[part], weight[part].astype(np.float32)
            row = self.row[t]
            often = np.flatnonzero(np.bincount(row[row >= 0], minlength=len(self.usual)) * self.usual > DEAR * size)
            number = np.full(len(self.usual) + 1, -1)
            number[often] = np.arange(len(often))
            row = number[row]
            whole, light = row >= 0, row < 0
            common = np.zeros((size, len(often)), np.float32)
            common[who[whole], row[whole]] = w[whole]
            score = np.matmul(common, self.rows[often], out=scores[:size])
            flat = score.reshape(-1)
            who, t, w = who[light], t[light], w[light]
            low, n = self.postings[t], held[t]
            before = np.cumsum(n) - n
            entry = np.repeat(low - before, n)
            if len(entry) > len(steps):
                steps = np.arange(len(entry) * 5 // 4)
                cell, cosine = np.empty(len(steps), np.int64), np.empty(len(steps), np.float32)
            if len(entry):
                entry += steps[: len(entry)]
                cells = self.at.take(entry, out=cell[: len(entry)], mode="clip")
                cells += np.repeat(who * self.wide, n)
                cosines = self.light.take(entry, out=cosine[: len(entry)], mode="clip")
                cosines *= np.repeat(w, n)
                np.add.at(flat, cells, cosines)
            if without is not None:
                own = np.flatnonzero(without[at : at + size] >= 0)
                score[own, without[at + own]] = 0
            floor = np.full(size, 1e-30, np.float32)
            if groups > self.k:
                most_of = np.max(score.reshape(size, -1, groups), axis=1, out=best[:size])
                floor = np.maximum(floor, np.partition(most_of, groups - self.k - 1, axis=1)[:, groups - self.k - 1])
            eight = np.greater_equal(score, floor[:, None], out=hits[:size]).reshape(-1).view(np.uint64)
            some = np.flatnonzero(eight != 0)
            hit = np.flatnonzero(eight[some].view(bool))
            hit = some[hit >> 3] * 8 + (hit & 7)
            who = hit // self.wide
            n = np.bincount(who, minlength=size)
            top = np.zeros((size, max(int(n.max()), self.k + 1)), np.int32)  # cosines' bits, which sort as they do; the last bit is the label
            top[who, np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)] = flat[hit].view(np.int32) & -2 | label[hit - who * self.wide]
            top = np.sort(top, axis=1)[:, -self.k - 1 :]
            toxic, near = top[:, 1:] & 1, (top & -2).view(np.float32).astype(float)
            found = np.count_nonzero(near[:, 1:], axis=1)
            ones = (near[:, 1:] * toxic).sum(axis=1)
            vote = self._vote(ones, near[:, 1:].sum(axis=1) - ones, found)
            sure = (near[:, 0] == 0) | (near[:, 1] - near[:, 0] > OFF * near[:, 1])
            least[at : at + size] = np.where(sure, np.maximum(vote - WRONG, 0), 0)
            most[at : at + size] = np.where(sure & (found > 0), vote + WRONG, found / self.k)
        least[order], most[order] = least.copy(), most.copy()
        return least, most

    def _ask(self, asked: np.ndarray, total: int, window: np.ndarray, term: np.ndarray, weight: np.ndarray, without: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The vote of each passage of `asked`, and pairs of its number there and an example near to it, nearest first."""
        window, term, weight = _only(asked, total, window, term, weight)
        vote, near = np.zeros(len(asked)), [np.empty((2, 0), np.int64)]
        edge = np.searchsorted(window, np.arange(0, len(asked) + BATCH, BATCH))
        for b, at in enumerate(range(0, len(asked), BATCH)):
            size, part = min(BATCH, len(asked) - at), slice(edge[b], edge[b + 1])
            who, place, cosine = self.neighbours(size, window[part] - at, term[part], weight[part], None if without is None else without[asked[at : at + size]])
            toxic = np.bincount(who, cosine * self.label[place], minlength=size)
            clean = np.bincount(who, cosine * (1 - self.label[place]), minlength=size)
            vote[at : at + size] = self._vote(toxic, clean, np.bincount(who, minlength=size))
            near.append(np.stack([who + at, self.example[place]]))
        return vote, np.concatenate(near, axis=1)

    def _votes(self, texts: list[str | None], without: np.ndarray | None = None) -> tuple[np.ndarray, list[list[int]]]:
        """For each text its features, and as evidence the examples nearest to its strongest passage."""
        count, *passage = self.passages(texts)
        total, of = int(count.sum()), np.repeat(np.arange(len(texts)), count)
        own = None if without is None else without[of]
        least, most = self._rough(total, *passage, own)
        begin = np.cumsum(count) - count

        def able(some: np.ndarray) -> np.ndarray:
            """Those of some passages that can be among the three strongest of their texts."""
            third = np.zeros(len(texts))
            third[count > 2] = least[np.lexsort((-least, of))[begin[count > 2] + 2]]
            return some[(most[some] > 0) & (most[some] >= third[of[some]])]

        some = able(np.arange(total))
        first = some[self._asked(np.bincount(of[some], minlength=len(texts)), *_only(some, total, *passage))]
        vote, near = self._ask(first, total, *passage, own)
        least[first] = vote
        more = able(np.setdiff1d(some, first, assume_unique=True))
        vote_more, near_more = self._ask(more, total, *passage, own)
        near_more[0] += len(first)
        asked, vote, (who, example) = np.append(first, more), np.append(vote, vote_more), np.append(near, near_more, axis=1)
        each = np.bincount(of[asked], minlength=len(texts))
        order = np.lexsort((asked, -vote, of[asked]))
        begin = np.cumsum(each) - each
        top = np.zeros((len(texts), 3))
        for j in range(3):
            have = each > j
            top[have, j] = vote[order[begin[have] + j]]
        cut = np.searchsorted(who, np.arange(len(asked) + 1))
        best = [order[b] if n else -1 for b, n in zip(begin, each)]
        evidence = [example[cut[p] : cut[p + 1]].tolist() if p >= 0 else [] for p in best]
        return np.column_stack([np.log((top + 0.02) / (1.02 - top)), np.log1p(count)]), evidence

    def _calibrate(self, texts: list[str], labels: np.ndarray, places: np.ndarray, odds: float) -> None:
        """Logistic regression by Newton's method, with label 1 weighing `odds` times what label 0 does in all."""
        x = np.concatenate([np.empty((0, 4)), *(self._votes(texts[k : k + 200], places[k : k + 200])[0] for k in range(0, len(texts), 200))])
        x = np.column_stack([x, np.ones(len(x))])
        held = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        share = np.where(labels == 1, odds / held, 1 / (1 - held)) / (1 + odds) / len(labels)
        b = np.zeros(5)
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            slope = x.T @ (share * (p - labels)) + 1e-4 * b
            curve = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(5)
            b -= np.clip(np.linalg.solve(curve, slope), -2, 2)
        self.scale, self.bias = b[:4], float(b[4])

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[int]]]:
        """(score, evidence) of each text: the calibrated votes, and the ids of the examples nearest to the strongest passage."""
        features, evidence = self._votes(texts)
        return 1 / (1 + np.exp(-np.clip(features @ self.scale + self.bias, -30, 30))), evidence


def train(docs: DataFrame, labels: DataFrame, *, toxic: int = 700, clean: int = 1500, max_chars: int = 6_000_000, miss: float = 4.0) -> BlockMaxIndex | None:
    """Examples are so many labelled documents of each label at most, of max_chars characters together, outside the held-out fold; None where there are none.

    Scores are calibrated for the labels' own shares, a miss weighing as much as `miss` false alarms.
    """
    ids, texts, y, share = sample(docs, labels, "toxic", mod=3, held=1, per_class={0: clean, 1: toxic}, max_chars=max_chars)
    index = BlockMaxIndex(texts, y, ids, odds=miss * share / max(1e-9, 1 - share)) if texts else None
    release()
    return index


def score(docs: DataFrame, index: BlockMaxIndex | None, *, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted and evidence (doc_ids of the examples nearest to the strongest passage) for every row of docs (doc_id, text).

    Texts without words, null and empty ones among them, get the calibrated score of no passage; without
    examples every score is 0. Rows that repeat are scored each, null ids stay null, other columns are
    ignored. Every passage of every whole text votes; no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for ids, texts in arrow_rows(batches, "doc_id", "text", most=100):
            scores, evidence = index.score(texts) if index else (np.zeros(len(ids)), [[]] * len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, evidence array<long>")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
