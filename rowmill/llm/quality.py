"""Document quality by attention-based multiple-instance learning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.llm.common import one_thread, release
from rowmill.llm.labelled import sample

WORDS, BINS = 64, 129
FEATURES, HIDDEN, GATES = BINS + 3, 16, 8


def passages(text: str | None) -> np.ndarray:
    """A row for each run of 64 words: shares of every ASCII character and of all others, how many words are distinct, how many repeat the one before, mean length."""
    words = (text or "").split()
    parts = [words[k : k + WORDS] for k in range(0, len(words), WORDS)] or [[]]
    data = [" ".join(p).encode("utf-8", "surrogatepass") for p in parts]
    size = np.array([len(d) for d in data])
    which = np.repeat(np.arange(len(parts)) * BINS, size)
    shares = np.bincount(which + np.minimum(np.frombuffer(b"".join(data), np.uint8), BINS - 1), minlength=len(parts) * BINS).reshape(-1, BINS)
    n = np.array([max(1, len(p)) for p in parts])
    extra = np.array([[len(set(p)), sum(map(str.__eq__, p, p[1:]))] for p in parts]) / n[:, None]
    return np.column_stack([np.sqrt(shares / np.maximum(size, 1)[:, None]), extra, np.log1p(size / n) / 3]).astype(np.float32)


class AttentionMil:
    """h = tanh(Wx + b) for each passage; attention softmax(w . (tanh(Vh) * sigmoid(Uh))); logistic output on the weighted mean of h."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        init = lambda a, b: rng.normal(0, a**-0.5, (a, b))
        self.p = {"W": init(FEATURES, HIDDEN) * 2, "b": np.zeros(HIDDEN), "V": init(HIDDEN, GATES), "U": init(HIDDEN, GATES), "w": init(GATES, 1)[:, 0], "o": init(HIDDEN, 1)[:, 0], "c": np.zeros(1)}
        self.mean, self.std, self.scale = np.zeros(FEATURES), np.ones(FEATURES), (1.0, 0.0)

    def _forward(self, x: np.ndarray, start: np.ndarray):
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = np.exp(np.clip((v * u) @ p["w"], -30, 30))
        bag = np.repeat(np.arange(len(start)), np.diff([*start, len(x)]))
        a = e / np.add.reduceat(e, start)[bag]
        z = np.add.reduceat(a[:, None] * h, start, axis=0)
        return h, v, u, a, bag, z, z @ p["o"] + p["c"][0]

    def gradient(self, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean weighted logistic loss, with a small penalty on W."""
        x, start = np.concatenate(bags), np.cumsum([0, *(len(b) for b in bags[:-1])])
        h, v, u, a, bag, z, s = self._forward(x, start)
        ds = (1 / (1 + np.exp(-s)) - y) * weight / len(bags)
        dz = ds[:, None] * self.p["o"]
        dh, da = a[:, None] * dz[bag], (dz[bag] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, start)[bag])
        dv, du = de[:, None] * self.p["w"] * u * (1 - v * v), de[:, None] * self.p["w"] * v * u * (1 - u)
        dh = (dh + dv @ self.p["V"].T + du @ self.p["U"].T) * (1 - h * h)
        return {"o": z.T @ ds, "c": np.array([ds.sum()]), "w": (v * u).T @ de, "V": h.T @ dv, "U": h.T @ du, "W": x.T @ dh + 1e-4 * self.p["W"], "b": dh.sum(axis=0)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 0.01, seed: int = 4) -> None:
        rng = np.random.default_rng(seed)
        every = np.concatenate(bags)
        self.mean, self.std = every.mean(axis=0), every.std(axis=0) + 0.02
        bags = [(b - self.mean) / self.std for b in bags]
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
        order = rng.permutation(len(bags))
        apart, own = order[: len(order) // 5], order[len(order) // 5 :]
        m1, m2, step = {k: 0 * v for k, v in self.p.items()}, {k: 0 * v for k, v in self.p.items()}, 0
        for _ in range(epochs):
            own = rng.permutation(own)
            for at in range(0, len(own), batch):
                pick = own[at : at + batch]
                step += 1
                for k, g in self.gradient([bags[k] for k in pick], y[pick], weight[pick]).items():
                    m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.999 * m2[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        if len(set(y[apart])) == 2:
            s = np.array([self._forward(bags[k], np.array([0]))[-1][0] for k in apart])
            a, b = 1.0, 0.0
            for _ in range(300):
                q = (1 / (1 + np.exp(-np.clip(a * s + b, -30, 30))) - y[apart]) * weight[apart]
                a, b = a - 0.05 * (q * s).mean(), b - 0.05 * q.mean()
            self.scale = (max(float(a), 0.05), float(b))

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        start = np.cumsum([0, *(len(b) for b in bags[:-1])])
        s = self._forward((np.concatenate(bags) - self.mean) / self.std, start)[-1]
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * s + self.scale[1], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = 700) -> AttentionMil:
    """Fitted on at most per_class labelled documents of each label outside the held-out fold; with one label or none, untrained weights and an even start."""
    _, texts, y, _ = sample(docs, labels, "quality", mod=4, held=2, per_class={0: per_class, 1: per_class})
    model = AttentionMil()
    if texts:
        model.fit([passages(t) for t in texts], np.array(y, float))
    return model


def _scores(model: AttentionMil, texts: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(model.score([passages(t) for t in texts.slice(k, 200).to_pylist()]) for k in range(0, len(texts), 200))])


def score(docs: DataFrame, model: AttentionMil, *, threshold: float = 0.7) -> DataFrame:
    """docs' columns and score, predicted: every passage of every whole text is encoded and weighed.

    Null, empty and blank texts are one empty passage and get a score like any other; rows that repeat are
    scored each; columns named score or predicted are replaced. No shuffle.
    """
    names = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    kept = docs.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_scores(model, batch.column(batch.schema.get_field_index("text"))))], names=[*names, "score"])
        release()

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, model: AttentionMil, *, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score at least the threshold, with docs' columns as they are, whatever their names. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column(batch.schema.get_field_index("text"))) >= threshold))
        release()

    return docs.mapInArrow(run, docs.schema)
