"""Quality classifier: histogram gradient-boosted trees over statistics of a text.

Trees are complete binary trees in flat arrays, and all texts of a batch walk them together. The fit is
on a bounded sample of labelled rows (MOST_LABELS, by the hash of the id); scoring covers every text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices, texts
from .language import held_out

#: Labelled rows that a fit reads at most.
MOST_LABELS = 20_000
#: Characters whose shares are statistics, then words that end in one of the last group.
GROUPS = ("0123456789", "|", "!?", ".", ",", "%$&*#@^~", "<>{}[]()", "=+/\\_", ":;", "-\"'", " \t", "\n")


def statistics(text: str) -> list[float]:
    """Statistics of a whole text; an empty text has zeros."""
    words = text.split()
    n, w = max(1, len(text)), max(1, len(words))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.bincount(np.minimum(codes, 255), minlength=256)
    out = [np.log1p(len(text)), np.log1p(len(words))]
    out += [counts[[ord(c) for c in g]].sum() / n for g in GROUPS]
    lower = text.lower()
    changed = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
    upper = (changed != codes).sum() if len(changed) == len(codes) else sum(map(str.isupper, text))
    out += [upper / n, (codes > 127).sum() / n]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    out += [lengths.mean(), lengths.std(), np.log1p(lengths.max()), (lengths <= 2).sum() / w, (lengths >= 15).sum() / w]
    seen = Counter(words)
    out += [len(seen) / w, max(seen.values(), default=0) / w]
    out += [len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1)]
    lines = [x for x in text.split("\n") if x.strip()]
    out += [np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), len(text) / max(1, len(lines)) / 100]
    out += [sum(not x[-1].isalnum() for x in words) / w, sum(not any(map(str.isalpha, x)) for x in seen) / w, sum(x.isupper() for x in words) / w]
    out += [sum(x[0].isupper() and not x.isupper() for x in words) / w]
    return out


@dataclass(frozen=True)
class Trees:
    """feature, threshold: trees x inner nodes, node k has children 2k + 1 and 2k + 2; leaf: trees x leaves."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        depth = int(self.leaf.shape[1]).bit_length() - 1
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, smooth: float = 1.0, least: float = 5.0) -> Trees:
    """Logistic loss, Newton leaves. Without rows, or with one label, a constant."""
    inner = (1 << depth) - 1
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Trees(float(np.log((share + 1e-3) / (1 - share + 1e-3))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, 1 << depth)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    share = y.mean()
    start = float(np.log(share / (1 - share)))
    total, made = np.full(len(y), start), []
    offsets = np.arange(x.shape[1]) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            slot = ((node - first)[:, None] * (x.shape[1] * bins) + offsets + binned).ravel()
            size = width * x.shape[1] * bins
            hg = np.bincount(slot, np.repeat(g, x.shape[1]), size).reshape(width, -1, bins).cumsum(2)
            hh = np.bincount(slot, np.repeat(h, x.shape[1]), size).reshape(width, -1, bins).cumsum(2)
            tg, th = hg[:, :1, -1:], hh[:, :1, -1:]
            gain = hg**2 / (hh + smooth) + (tg - hg) ** 2 / (th - hh + smooth) - tg**2 / (th + smooth)
            gain[(hh < least) | (th - hh < least)] = 0
            for k in range(width):
                best = int(gain[k].argmax())
                j, b = divmod(best, bins)
                if gain[k].flat[best] > 1e-9 and b < len(cuts[j]):
                    feature[first + k], threshold[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, 1 << depth) / (np.bincount(at, h, 1 << depth) + smooth)
        total += leaf[at]
        made.append((feature, threshold, leaf))
    return Trees(start, *(np.stack(z) for z in zip(*made, strict=True)))


def _statistics(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array([statistics(t) for t in texts(b)], float)
            yield pa.record_batch([b.column("_id"), b.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["_id", "y", "x"])

    return docs.mapInArrow(run, f"_id {docs.schema['_id'].dataType.simpleString()}, y int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELS) -> Trees:
    """Fits on at most `most` labelled ids, chosen by the hash of the id; an id labelled twice takes the larger label.

    Of an id with several rows, the one of least statistics is fitted, so the model does not depend on the order of rows.
    """
    known = labels.select(labels[id_col].alias("_id"), labels[label_col].cast("int").alias("y")).where("_id is not null and y is not null").groupBy("_id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("_id", F.lit(7)), "_id").limit(most)
    # Bounded by `most`, so it can be sent to all executors.
    rows = docs.select(docs[id_col].alias("_doc"), docs[text_col].cast("string").alias("text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_id", "y", "text")
    found = _statistics(rows).groupBy("_id", "y").agg(F.min("x").alias("x")).toPandas()
    x = np.array(found["x"].tolist(), float).reshape(len(found), len(statistics("")))
    order = np.lexsort((*x.T[:3], found["y"].to_numpy())) if len(found) else np.zeros(0, np.int64)
    return fit(x[order], found["y"].to_numpy(float)[order])


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of each row; null texts count as empty."""
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = given.value.score(np.array([statistics(t) for t in texts(b)], float).reshape(b.num_rows, -1)) if b.num_rows else np.zeros(0)
            yield pa.record_batch([b.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return own.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from the labels whose crc32(doc_id) mod 5 is not 0."""
    model = train(docs, labels.where(~held_out(labels[id_col], 5, 0)), id_col=id_col, **options)
    found = score(docs, model, id_col, options.get("text_col", "text"))
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
