"""Toxicity of texts: a logistic classifier that is held to one score when identity terms are swapped."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from attesta.session import materialise

#: Bounds of the fit: labelled rows of each class that are used, and features that are kept.
SAMPLE_PER_CLASS = 8_000
FEATURES = 4_096
MIN_DOCUMENTS = 5
STEM = 5
STEPS = 300
RIDGE = 1.0
SWAP_PENALTY = 4.0

#: Group mentions that may be exchanged for each other, with a neutral word at the end of each list (fixed values).
IDENTITY = (
    ("women", "men", "people"), ("woman", "man", "person"), ("girls", "boys", "children"), ("female", "male", "human"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "people"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "religious"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "young"),
    ("black", "white", "asian", "latino", "african", "european", "american", "local"),
    ("immigrants", "refugees", "foreigners", "natives", "people"),
    ("frauen", "männer", "menschen"), ("juden", "muslime", "christen", "menschen"), ("ausländer", "einheimische", "leute"),
    ("femmes", "hommes", "gens"), ("juifs", "musulmans", "chrétiens", "gens"), ("étrangers", "immigrés", "habitants"),
    ("mujeres", "hombres", "personas"), ("judíos", "musulmanes", "cristianos", "personas"), ("extranjeros", "inmigrantes", "vecinos"),
)
_WORD = re.compile(r"[^\W\d_]+")
_NEXT = {w: g[(i + 1) % len(g)] for g in reversed(IDENTITY) for i, w in enumerate(g[:-1])}
_NEUTRAL = {w: g[-1] for g in reversed(IDENTITY) for w in g[:-1]}


def counts(words: list[str]) -> dict[str, int]:
    """Words and word beginnings with their counts. A beginning has a mark that no word has."""
    found = Counter(words)
    out = dict(found)
    for word, n in found.items():
        if len(word) >= STEM:
            stem = "^" + word[:STEM]
            out[stem] = out.get(stem, 0) + n
    return out


def split(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def swapped(words: list[str]) -> list[list[str]]:
    """The same sentence with other groups: each term's neighbour in its list, and the neutral word."""
    if not any(w in _NEXT for w in words):
        return []
    return [[m.get(w, w) for w in words] for m in (_NEXT, _NEUTRAL)]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        """Probability of the label, 0 to 1. A text without words has the score of the bias alone."""
        weights, z = self.weights, self.bias
        for feature, n in counts(split(text)).items():
            w = weights.get(feature)
            if w is not None:
                z += w * _strength(n)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _strength(n: int) -> float:
    return 1.0 + min(n, 8) / 8


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """(y, text) of the `per_class` labelled rows of smallest hash in each class, and the weight of a row of each class.

    Labels with a null id or a null or unknown value are left out. Only bounded tables of ids are broadcast.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("key"), F.col(label).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    picked = None
    for y in sizes:
        one = known.filter(F.col("y") == y).orderBy(F.xxhash64("key"), "key").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    if picked is None:
        return docs.select(F.lit(0).alias("y"), F.col(text).alias("text")).limit(0), {}
    rows = docs.select(F.col(id_col).alias("key"), F.col(text).alias("text")).join(F.broadcast(picked), "key").select("y", "text")
    return rows, {y: n / min(n, per_class) for y, n in sizes.items()}


def choose(rows: DataFrame, weight: dict[int, float], limit: int) -> list[str]:
    """Features that part the classes best, by log odds times the root of their count. Counts combine in the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[y].update(counts(split(text)).keys())
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([seen[0][n] for n in names], pa.int64()), pa.array([seen[1][n] for n in names], pa.int64())],
            ["feature", "n0", "n1"],
        )

    each = rows.mapInArrow(count, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    a = F.col("n0") * weight.get(0, 1.0) + 0.5
    b = F.col("n1") * weight.get(1, 1.0) + 0.5
    total = rows.groupBy().agg(F.count_if(F.col("y") == 0).alias("t0"), F.count_if(F.col("y") == 1).alias("t1")).first()
    odds = F.log(b / (total["t1"] * weight.get(1, 1.0) + 1)) - F.log(a / (total["t0"] * weight.get(0, 1.0) + 1))
    ranked = each.filter(F.col("n0") + F.col("n1") >= MIN_DOCUMENTS).select("feature", (F.abs(odds) * F.sqrt(F.col("n0") + F.col("n1"))).alias("gain"))
    top = [r["feature"] for r in ranked.orderBy(F.desc("gain"), "feature").limit(limit).collect()]
    terms = set(top) | set(_NEXT) | set(_NEUTRAL.values())
    return sorted(terms | {"^" + t[:STEM] for t in terms & (set(_NEXT) | set(_NEUTRAL.values())) if len(t) >= STEM})


def _design(rows: DataFrame, features: list[str]) -> list:
    """Sparse rows of the sample: label, features and strengths, and those of each swapped form."""
    number = {f: i for i, f in enumerate(features)}

    def encode(words: list[str]) -> tuple[list[int], list[float]]:
        pairs = sorted((number[f], _strength(n)) for f, n in counts(words).items() if f in number)
        return [i for i, _ in pairs], [v for _, v in pairs]

    @pandas_udf("at array<int>, by array<float>, swaps array<struct<at: array<int>, by: array<float>>>")
    def encoded(text: pd.Series) -> pd.DataFrame:
        out = []
        for words in map(split, text):
            at, by = encode(words)
            out.append((at, by, [dict(zip(("at", "by"), encode(s))) for s in swapped(words)]))
        return pd.DataFrame(out, columns=["at", "by", "swaps"])

    return rows.select("y", encoded("text").alias("e")).select("y", "e.*").collect()  # bounded by the sample


class _Sparse:
    def __init__(self, rows: list[tuple[list[int], list[float]]], width: int):
        sizes = [len(at) for at, _ in rows]
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), sizes)
        self.col = np.concatenate([np.array(at, np.int64) for at, _ in rows]) if rows else np.zeros(0, np.int64)
        self.value = np.concatenate([np.array(by, np.float64) for _, by in rows]) if rows else np.zeros(0)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * r[self.row], self.width)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
        per_class: int = SAMPLE_PER_CLASS, limit: int = FEATURES, penalty: float = SWAP_PENALTY) -> Model:
    """Weighted logistic loss, a ridge, and the squared change of log odds under each identity swap.

    The sample is bounded by `per_class` rows of each class; its rows are weighted back to all labelled
    rows. With labels of one class only, or none, every score is that class's share, or a half.
    """
    rows, weight = sample(docs, labels, id_col, text, label, per_class)
    if len(weight) < 2:
        return Model({}, 20.0 if 1 in weight else -20.0 if 0 in weight else 0.0)
    rows = materialise(rows, "labelled")
    features = choose(rows, weight, limit)
    design = _design(rows, features)
    return descend(design, features, weight, penalty)


def descend(design: list, features: list[str], weight: dict[int, float], penalty: float, steps: int = STEPS) -> Model:
    """Accelerated gradient descent with per-coordinate step sizes; the same rows give the same model."""
    design = sorted(design, key=lambda r: (r["y"], r["at"], r["by"]))
    y = np.array([r["y"] for r in design], np.float64)
    if not len(y):
        return Model({}, 0.0)
    per_row = np.array([weight.get(int(v), 1.0) for v in y])
    per_row /= per_row.mean()
    x = _Sparse([(r["at"], r["by"]) for r in design], len(features))
    changes = []
    for r in design:
        for s in r["swaps"] or []:
            d = dict(zip(s["at"], s["by"]))
            for i, v in zip(r["at"], r["by"]):
                d[i] = d.get(i, 0.0) - v
            d = {i: v for i, v in d.items() if v}
            changes.append((list(d), list(d.values())))
    change = _Sparse(changes, len(features))
    # Diagonal majoriser: |x_ij| times the row's sum of |x| bounds the curvature.
    reach = x.times(np.ones(x.width)) + 1
    scale = np.bincount(x.col, x.value * (per_row * reach)[x.row], x.width) / 4 + RIDGE
    spread = np.bincount(change.row, np.abs(change.value), change.n) if change.n else np.zeros(0)
    if change.n:
        scale += 2 * penalty * np.bincount(change.col, np.abs(change.value) * spread[change.row], x.width)
    bias_scale = (per_row * reach).sum() / 4
    w, b = np.zeros(x.width), float(np.log((per_row * y).sum() / (per_row * (1 - y)).sum()))
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x.times(v) + c, -500, 500)))
        residual = per_row * (p - y)
        gradient = x.back(residual) + RIDGE * v
        if change.n:
            gradient += 2 * penalty * change.back(change.times(v))
        new_w, new_b = v - gradient / scale, c - residual.sum() / bias_scale
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return Model({f: float(a) for f, a in zip(features, w) if abs(a) > 1e-9}, float(b))


def score(docs: DataFrame, model: Model, text: str = "text"):
    """Score of each whole text; null counts as empty."""

    @pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return scores(docs[text])
