"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Indicators of byte n-grams and of repeated words are scaled by the classes'
log-count ratios; a linear hinge-loss model is then fitted to the scaled,
length-normalised indicators by dual coordinate descent, and its margin is
turned into a probability by logistic calibration on rows kept out of that fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Indicator space: all byte 1- and 2-grams, hashed 3-grams, and places for repeats.
REPEATS = 32
BIGRAMS = 256 + 65_536
DIM = 1 << 18


class Indicators:
    """Sorted distinct indicator ids of a text, through one reused mask instead of a sort."""

    def __init__(self) -> None:
        import numpy as np

        self.np = np
        self.mask = np.zeros(DIM, bool)

    def repeats(self, raw: bytes) -> list[int]:
        """Which word n-grams of "same as the word before (or two, three before)" occur, and how often by powers of two."""
        np, w = self.np, raw.split()
        out = []
        if len(w) > 3:
            code = np.fromiter(map(zlib.crc32, w), np.int64, len(w))
            for lag in (1, 2, 3):
                same = code[lag:] == code[:-lag]
                share = int(np.count_nonzero(same)) / len(w)
                if share:
                    out.append((lag - 1) * 10 + min(6, int(share * 8)))
                if (same[1:] & same[:-1]).any():
                    out.append((lag - 1) * 10 + 8)
                if len(same) > 2 and (same[2:] & same[1:-1] & same[:-2]).any():
                    out.append((lag - 1) * 10 + 9)
        return out

    def __call__(self, text: str | None):
        np, raw = self.np, (text or "").encode("utf-8", "surrogatepass")
        b = np.frombuffer(raw, np.uint8).astype(np.int64)
        mask = self.mask
        mask[b] = True
        if len(b) > 1:
            pair = b[:-1] * 256 + b[1:]
            mask[256 + pair] = True
            if len(b) > 2:
                mask[BIGRAMS + ((pair[:-1] * 256 + b[2:]) * 2_654_435_761 >> 7) % (DIM - BIGRAMS - REPEATS)] = True
        for i in self.repeats(raw):
            mask[DIM - REPEATS + i] = True
        found = np.flatnonzero(mask)
        mask[found] = False
        return found.astype(np.int32)


@dataclass
class Model:
    """``weight`` has ratio times fitted weight for each indicator, ``square`` the squared ratio."""

    weight: object
    square: object
    bias: float
    slope: float
    shift: float

    def margin(self, ids) -> float:
        norm = float(self.square[ids].sum())
        return float(self.weight[ids].sum()) / (norm**0.5 + 1e-9) + self.bias

    def score(self, ids) -> float:
        import math

        z = self.slope * self.margin(ids) + self.shift
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def fit_margin(x: list, y: list[int], cost: float, smooth: float, epochs: int, seed: int) -> tuple:
    """(ratio * w, ratio squared, bias) of the hinge-loss model; classes are weighted to equal mass."""
    import numpy as np

    counts = {1: np.full(DIM, smooth), -1: np.full(DIM, smooth)}
    for ids, label in zip(x, y):
        counts[label][ids] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())
    scaled = [ratio[ids] / (np.sqrt((ratio[ids] ** 2).sum()) + 1e-9) for ids in x]
    n_pos = max(1, sum(label > 0 for label in y))
    most = {1: cost * len(y) / (2 * n_pos), -1: cost * len(y) / (2 * max(1, len(y) - n_pos))}
    w, bias, dual, rng = np.zeros(DIM), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    curve = [float(v @ v) + 1.0 for v in scaled]
    for _ in range(epochs):
        moved = 0.0
        for k in rng.permutation(len(y)):
            ids, v, label = x[k], scaled[k], y[k]
            new = min(max(dual[k] - (label * (float(w[ids] @ v) + bias) - 1) / curve[k], 0.0), most[label])
            step = (new - dual[k]) * label
            if step:
                w[ids] += step * v
                bias += step
                moved = max(moved, abs(step))
                dual[k] = new
        if moved < 1e-3:
            break
    return ratio * w, ratio**2, bias


def calibrate(margins: list[float], y: list[int]) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, with Platt's softened targets."""
    import numpy as np

    z, n1, n0 = np.asarray(margins), sum(v > 0 for v in y), sum(v < 0 for v in y)
    t = np.where(np.asarray(y) > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - t) * z).sum() + 1e-3 * a, (p - t).sum()])
        h = (p * (1 - p))[:, None, None] * np.stack([np.stack([z * z, z], 1), np.stack([z, np.ones_like(z)], 1)], 1)
        step = np.linalg.solve(h.sum(axis=0) + 1e-3 * np.eye(2), g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def fit(x: list, y: list[int], cost: float = 10.0, smooth: float = 1.0, epochs: int = 12, seed: int = 0) -> Model:
    """One class, or no rows at all, gives a constant score."""
    import numpy as np

    if len({*y}) < 2 or len(y) < 10:
        flat = np.zeros(DIM, np.float32)
        return Model(flat, flat, 0.0, 1.0, float(np.log((sum(v > 0 for v in y) + 1) / (sum(v < 0 for v in y) + 1))))
    aside = [i % 4 == 0 for i in range(len(y))]
    part = [[v for v, out in zip(s, aside) if not out] for s in (x, y)]
    slope, shift = 1.0, 0.0
    if len({*part[1]}) == 2:
        trial = Model(*fit_margin(*part, cost, smooth, epochs, seed), slope, shift)
        slope, shift = calibrate([trial.margin(v) for v, out in zip(x, aside) if out], [v for v, out in zip(y, aside) if out])
    weight, square, bias = fit_margin(x, y, cost, smooth, epochs, seed)
    return Model(weight.astype(np.float32), square.astype(np.float32), bias, slope, shift)


def held_out(id_col: Column) -> Column:
    """Rows no label may be learned from: CRC-32 of the id as text divides by 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id_col: str = "doc_id", sample_rows: int = 6000, seed: int = 3, **options) -> Model:
    """Fits on at most ``sample_rows`` labelled rows that are not held out, those of the smallest seeded hashes.

    A document labelled more than once counts with its mean, rounded; null
    labels and ids are skipped. Only the sample's indicator ids reach the driver.
    """

    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        of = Indicators()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([of(t.as_py()).tolist() for t in batch.column(2)], pa.list_(pa.int32()))], ["id", "y", "ids"])

    marked = labels.select(F.col(id_col).alias("lid"), F.col(label).alias("l")).where(F.col("l").isNotNull() & ~held_out(F.col("lid")))
    chosen = marked.groupBy("lid").agg((F.avg("l") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("lid", F.lit(seed)), "lid").limit(sample_rows)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text).alias("body"))
    taken = slim.join(F.broadcast(chosen), F.col("id") == F.col("lid")).select("id", "y", "body")
    kind = dict(slim.dtypes)["id"]
    rows = taken.mapInArrow(run, f"id {kind}, y int, ids array<int>").groupBy("id").agg(F.first("y").alias("y"), F.first("ids").alias("ids")).orderBy("id").toArrow()
    x = [v.values.to_numpy() if v.values is not None else np.zeros(0, np.int32) for v in rows.column("ids")]
    return fit(x, [1 if v else -1 for v in rows.column("y").to_pylist()], **options)


def score(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """One row per input row: ``id_col, held_out, score, predicted``; whole texts, no shuffle.

    Null and empty texts get the model's score of a text without n-grams. A null
    id counts as held out; repeated rows score alike; no rows give no rows;
    other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB, whatever the data

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        of, model_ = Indicators(), shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([model_.score(of(t.as_py())) for t in batch.column(2)], pa.float64())], ["id", "held_out", "score"])

    slim = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text).alias("body"))
    scored = slim.mapInArrow(run, f"id {dict(slim.dtypes)['id']}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
