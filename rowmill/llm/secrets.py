"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

The network learns from the corpus: what the fixed patterns find is a finding, with the words that announce it cut
away, and other candidates of the same texts are none; made findings of more kinds are added to both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowmill.llm.common import arrow_rows, release

#: Fixed patterns. A kind's matches are leftmost and do not overlap; those that fail the length are dropped.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex")
#: What the network scores: a whole run of token characters.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# --- the network -------------------------------------------------------------------------------------------
BEFORE, AFTER, WIDTH, FILTERS, EMBED, PIECE = 24, 8, 5, 24, 12, 50_000


def codes_of(text: str) -> np.ndarray:
    """A code for each character: 1 for any beyond ASCII; 0 is kept for padding."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(code < 128, code + 1, 1)


Shown = tuple[np.ndarray, int, int]


def shown(code: np.ndarray, start: int, end: int) -> Shown:
    """The whole candidate with its context and one padding at either side, and where the candidate begins and ends in that."""
    first = max(0, start - BEFORE)
    return np.concatenate([[0], code[first:start], code[start:end], code[end : end + AFTER], [0]]), start - first + 1, end - first + 1


class CharNetwork:
    """Embedding, convolution, ReLU, maximum over each region (before, the whole candidate, after), logistic output. Candidates of any length."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "e": rng.normal(0, 0.3, (129, EMBED)),
            "w": rng.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH, EMBED, FILTERS)),
            "c": np.zeros(FILTERS),
            "o": rng.normal(0, 0.2, 3 * FILTERS),
            "b": np.zeros(1),
        }
        self.cut = 0.0  # logit from which a candidate is a finding
        self.scale = (1.0, 0.0)

    @staticmethod
    def _flat(batch: list[Shown]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All candidates in one row with padding between them; where their characters are, and where each region begins among these."""
        pad = np.zeros(WIDTH // 2, np.int64)
        flat = np.concatenate([pad, *(x for row, _, _ in batch for x in (row, pad))])
        size = np.array([len(row) for row, _, _ in batch])
        begin = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat((np.arange(len(batch)) + 1) * len(pad), size)
        region = np.stack([begin, begin + [a for _, a, _ in batch], begin + [b for _, _, b in batch]], axis=1).ravel()
        return flat, at, region

    def forward(self, flat: np.ndarray, at: np.ndarray, region: np.ndarray) -> np.ndarray:
        """The regions' maxima, a row for each candidate. Every character's share of the convolution is a table, so memory is bounded in pieces."""
        table = self.p["e"] @ self.p["w"]  # place in the window, character, filter
        top = np.zeros((len(region), FILTERS))
        for start in range(0, len(at), PIECE):
            part = at[start : start + PIECE]
            conv = self.p["c"] + sum(table[k][flat[part + k - WIDTH // 2]] for k in range(WIDTH))
            low, high = np.searchsorted(region, start, "right") - 1, np.searchsorted(region, start + len(part))
            here = np.maximum(np.append(region[low:high], start)[: high - low] - start, 0)
            top[low:high] = np.maximum(top[low:high], np.maximum.reduceat(conv, here, axis=0))
        return top.reshape(-1, 3 * FILTERS)

    def logits(self, batch: list[Shown]) -> np.ndarray:
        return self.forward(*self._flat(batch)) @ self.p["o"] + self.p["b"][0] if batch else np.zeros(0)

    def gradient(self, batch: list[Shown], label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss."""
        flat, at, region = self._flat(batch)
        p = self.p
        table = p["e"] @ p["w"]
        conv = p["c"] + sum(table[k][flat[at + k - WIDTH // 2]] for k in range(WIDTH))
        where = np.stack([a + conv[a:b].argmax(axis=0) for a, b in zip(region, np.append(region[1:], len(at)))])
        best = np.take_along_axis(conv, where, axis=0)
        top = np.maximum(best, 0).reshape(len(batch), -1)
        dz = (1 / (1 + np.exp(-np.clip(top @ p["o"] + p["b"][0], -30, 30))) - label) / len(batch)
        dbest = (dz[:, None] * p["o"]).reshape(best.shape) * (best > 0)
        slots = [flat[at[where] + k - WIDTH // 2] * FILTERS + np.arange(FILTERS) for k in range(WIDTH)]  # only the maxima count
        dtable = np.stack([np.bincount(s.ravel(), dbest.ravel(), minlength=len(p["e"]) * FILTERS).reshape(-1, FILTERS) for s in slots])
        return {"o": top.T @ dz, "b": np.array([dz.sum()]), "c": dbest.sum(axis=0), "w": p["e"].T @ dtable, "e": (dtable @ p["w"].transpose(0, 2, 1)).sum(axis=0)}

    def train(self, rows: list[Shown], label: np.ndarray, steps: int = 400, batch: int = 64, rate: float = 0.01, seed: int = 8) -> None:
        """Adam over batches that hold as many findings as others."""
        rng = np.random.default_rng(seed)
        sides = [np.flatnonzero(label == y) for y in (0, 1)]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(side, batch // 2) for side in sides])
            for k, g in self.gradient([rows[i] for i in pick], label[pick]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.p[k] = self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, rows: list[Shown], label: np.ndarray, recall: float) -> None:
        """Platt scaling on rows kept apart, and the highest cut that keeps the wanted recall there, whatever else it lets through."""
        z = self.logits(rows)
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            a, b = a - 0.05 * ((p - label) * z).mean(), b - 0.05 * (p - label).mean()
        self.scale = (float(a), float(b))
        found = np.sort(z[label == 1])
        self.cut = float(found[int((1 - recall) * len(found))])

    def score(self, rows: list[Shown]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.logits(rows) + self.scale[1], -30, 30)))


def made_findings(count: int, seed: int) -> tuple[list[Shown], np.ndarray]:
    """A made set of labelled findings, half of them true: keys, tokens and hashes after words that announce them, and what only looks like them (words with
    numbers, versions, dates, paths, addresses, long numbers, identifiers)."""
    rng = np.random.default_rng(seed)
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    draw = lambda chars, a, b: "".join(chars[i] for i in rng.integers(0, len(chars), rng.integers(a, b)))
    word = lambda: draw(lower, 2, 9)
    secret = [
        lambda: draw(lower + upper + digit, 20, 48),
        lambda: draw(lower + upper + digit + "+/", 22, 64) + "=",
        lambda: draw("abcdef" + digit, 20, 64),
        lambda: "AKIA" + draw(upper + digit, 16, 17),
        lambda: "ghp_" + draw(lower + upper + digit, 30, 40),
        lambda: "sk-" + draw(lower + upper + digit, 24, 48),
        lambda: draw(upper + digit, 18, 40),
        lambda: draw(lower + digit, 18, 40),
    ]
    plain = [
        lambda: f"{word()}-{word()}-{word()}-{word()}-{rng.integers(0, 99)}",
        lambda: f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}-{word()}-{word()}",
        lambda: f"{word()}/{word()}/{word()}/{word()}{rng.integers(0, 9)}",
        lambda: f"{word()}_{word()}_{word()}_v{rng.integers(0, 20)}",
        lambda: draw(digit, 16, 24),
        lambda: f"{rng.integers(1000, 9999)}-{rng.integers(1000, 9999)}-{rng.integers(1000, 9999)}-{rng.integers(1000, 9999)}",
        lambda: f"+{draw(digit, 2, 3)}-{draw(digit, 3, 4)}-{draw(digit, 3, 4)}-{draw(digit, 4, 5)}",
        lambda: word() + word() + word() + str(rng.integers(0, 2030)),
        lambda: "".join(word() for _ in range(int(rng.integers(4, 9)))),
        lambda: "".join(word() for _ in range(int(rng.integers(4, 9)))).title(),
        lambda: "".join(word() for _ in range(int(rng.integers(4, 9)))).upper(),
        lambda: "=" * int(rng.integers(8, 20)) + str(rng.integers(0, 9)) + "=" * int(rng.integers(8, 20)),
    ]
    rows, label = [], []
    for k in range(count):
        positive = k % 2 == 0
        body = (secret if positive else plain)[rng.integers(0, len(secret if positive else plain))]()
        lead = " ".join(word() for _ in range(4)) + (rng.choice([" key: ", " token ", " auth=", " id ", " ", " bearer "]) if positive else rng.choice([" ", " see ", " call ", " at ", "\n"]))
        text = lead + body + rng.choice([" ", ". ", "\n", ", "]) + word()
        rows.append(shown(codes_of(text), len(lead), len(lead) + len(body)))
        label.append(float(positive))
    return rows, np.array(label)


def _split(rows: list, label: np.ndarray) -> tuple[tuple, tuple]:
    """Three in four to learn from, and every fourth kept apart, in a mixed order."""
    apart = np.random.default_rng(5).permutation(len(rows)) % 4 == 3
    return tuple(([r for r, x in zip(rows, apart) if x == side], label[apart == side]) for side in (False, True))


def corpus_findings(docs: DataFrame, *, texts: int, findings: int, longest: int = 400) -> tuple[list[Shown], np.ndarray]:
    """Labelled findings of the corpus: from some `texts` rows (those of the smallest hashes of their ids) at most so many of each label.

    A base finding is one, without the words that announce it; a candidate outside all base findings is none. To learn
    from, and only there, those of over `longest` characters are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (column,) in arrow_rows(batches, "text"):
            out = []
            for text in column:
                base, _ = find(text, None)
                for kind, a, b in base:
                    value = ASSIGN.match(text, a, b).start(2) if kind == "assign" else a
                    out.append((1, text[max(0, a - BEFORE) : a], text[value:b], text[b : b + AFTER]))
                out += [(0, text[max(0, a - BEFORE) : a], text[a:b], text[b : b + AFTER]) for a, b in candidates(text or "", base)]
            yield pa.RecordBatch.from_pylist([dict(zip(("y", "before", "body", "after"), r)) for r in out if len(r[2]) <= longest], schema=pa.schema([("y", pa.int32()), *((c, pa.string()) for c in ("before", "body", "after"))]))

    rows = docs.count()
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(23)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, texts / max(1, rows)))
    chosen = docs.where(part).select("text")
    if docs.where(part).count() > 2 * texts:  # only where ids repeat much; a limit reads all in one task
        chosen = chosen.limit(2 * texts)
    seen = chosen.mapInArrow(run, "y int, before string, body string, after string")
    order = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("body", "before", "after"), "body", "before", "after"))
    found = sorted(tuple(r)[:4] for r in seen.withColumn("nth", order).where(F.col("nth") <= findings).collect())
    made = [shown(codes_of(before + body + after), len(before), len(before) + len(body)) for _, before, body, after in found]
    return made, np.array([float(y) for y, *_ in found])


def train(docs: DataFrame, *, recall: float = 0.98, texts: int = 20_000, findings: int = 1500, made: int = 3000) -> CharNetwork:
    """Trained on the corpus's findings and made ones, calibrated on every fourth of them kept apart. Repeats itself on the same rows."""
    rows, label = made_findings(made, 11)
    own, y = corpus_findings(docs, texts=texts, findings=findings)
    parts = [_split(rows, label), _split(own, y)]
    learn, apart = (([r for part in parts for r in part[k][0]], np.concatenate([part[k][1] for part in parts])) for k in (0, 1))
    net = CharNetwork()
    net.train(*learn)
    net.calibrate(*apart, recall)
    return net


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Where the candidates outside the base spans are."""
    taken: list[list[int]] = []
    for _, a, b in base:
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    spots, k = [], 0
    for m in CANDIDATE.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k == len(taken) or taken[k][0] >= m.end():
            spots.append(m.span())
    return spots


def find(text: str | None, net: CharNetwork | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): every candidate outside the base spans is scored by the network; findings have the kind "network"."""
    text = text or ""
    base = base_spans(text)
    spots = candidates(text, base) if net else []
    if not spots:
        return base, base
    code, more = codes_of(text), []
    for at in range(0, len(spots), 256):
        part = spots[at : at + 256]
        more += [("network", *s) for s, z in zip(part, net.logits([shown(code, *s) for s in part])) if z >= net.cut]
    order = {k: i for i, k in enumerate((*KINDS, "network"))}
    return base, sorted(base + more, key=lambda s: (s[1], order[s[0]]))


SPANS = "array<struct<kind:string,start:long,end:long>>"


def scan(docs: DataFrame, *, recall: float = 0.98) -> DataFrame:
    """doc_id, base spans and all spans for every row of docs (doc_id, text); code points, end exclusive. Building the result trains the network.

    Null and empty texts have no spans, repeated rows are scanned each, null ids stay null, other columns are
    ignored, an empty table gives no rows. Whole texts are scanned in one pass, without a shuffle.
    """
    net = train(docs, recall=recall)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in arrow_rows(batches, "doc_id", "text"):
            found = [find(t, net) for t in texts]
            as_rows = lambda k: pa.array([[dict(zip(("kind", "start", "end"), s)) for s in f[k]] for f in found], kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), as_rows(0), as_rows(1)], names=["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, base {SPANS}, spans {SPANS}")


def digests(scanned: DataFrame) -> DataFrame:
    """The counts, the hash of the base spans and all spans as text."""
    written = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select("doc_id", *map(count, KINDS), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def redact(docs: DataFrame, *, mark: str = "[SECRET]", recall: float = 0.98) -> DataFrame:
    """docs with every finding replaced by the mark and n_chars to match; no row goes, null texts stay null."""
    net = train(docs, recall=recall)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            out = []
            for text in batch.column(at).to_pylist():
                parts, end = [], 0
                for _, a, b in find(text, net)[1]:
                    if b > end:
                        parts += [text[end:a], mark] if a >= end else []
                        end = b
                out.append("".join([*parts, text[end:]]) if parts else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
        release()

    cleaned = docs.mapInArrow(clean, docs.schema)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned
