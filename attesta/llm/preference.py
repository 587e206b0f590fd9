"""Quality of texts: Bradley-Terry scores, learned from pairs of which one text is preferred to the other."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from attesta.llm.toxicity import sample
from attesta.session import materialise

#: Bounds of the fit: labelled rows of each class, and pairs in which each row of the larger class stands.
SAMPLE_PER_CLASS = 6_000
PAIRS_PER_ROW = 4
#: Word shapes are counted in so many hashed bins.
SHAPES = 96
STATISTICS = 20
RIDGE = 1e-3
STEPS = 50
#: Score of a text that stands exactly on the cut.
CUT_SCORE = 0.3


class _Kinds(dict):
    """Kind of a character by code point, filled as characters are met."""

    def __missing__(self, point: int) -> str:
        ch = chr(point)
        kind = ("A" if ch.isupper() else "a") if ch.isalpha() else "0" if ch.isdigit() else ch
        self[point] = kind
        return kind


_kinds = _Kinds()
_NO_LETTERS = str.maketrans("", "", "Aa0")
_words: dict[str, tuple[int, int, int, int, str]] = {}


def shape(kinds: str) -> str:
    """Kinds of a word's characters with runs as one sign, up to eight signs: `Thing,` is `Aa,`."""
    out = ""
    for kind in kinds:
        if out[-1:] != kind:
            out += kind
            if len(out) == 8:
                break
    return out


def _described(word: str) -> tuple[int, int, int, int, str]:
    """Bin of the word's shape, its capitals, other letters and digits, and its remaining signs."""
    found = _words.get(word)
    if found is None:
        if len(_words) >= 100_000:  # a cache; it starts anew rather than grow with the data
            _words.clear()
        kinds = word.translate(_kinds)
        signs = "" if word.isalpha() else kinds.translate(_NO_LETTERS)
        capitals, digits = kinds.count("A"), kinds.count("0")
        found = zlib.crc32(shape(kinds).encode("utf-8", "replace")) % SHAPES, capitals, len(word) - capitals - digits - len(signs), digits, signs
        _words[word] = found
    return found


def features(text: str | None) -> np.ndarray:
    """Statistics of a whole text and the shares of its word shapes. Null and empty texts have all zeros."""
    out = np.zeros(STATISTICS + SHAPES)
    words = (text or "").split()
    if not words:
        return out
    n, chars = len(words), len(text)
    lines = [line for line in map(str.strip, text.split("\n")) if line]
    count = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    shapes = [0] * SHAPES
    capitals = digits = letters = 0
    others: dict[str, int] = {}
    for word, times in count.items():
        at, upper, lower, number, signs = _described(word)
        shapes[at] += times
        capitals, letters, digits = capitals + upper * times, letters + lower * times, digits + number * times
        for sign in signs:
            others[sign] = others.get(sign, 0) + times
    out[STATISTICS:] = np.array(shapes) / n
    size, raw = int(lengths.sum()), text.encode("utf-8", "replace")
    top = [k for _, k in count.most_common(3)]
    out[:STATISTICS] = (
        1, np.log(n), np.log(len(lines)), n / chars, lengths.mean(), lengths.std(), lengths.max() / (1 + lengths.mean()),
        len(count) / n, np.log(len(count)) / np.log(n + 1), top[0] / n, sum(top) / n,
        len(set(zip(words, words[1:]))) / max(1, n - 1), sum(map(eq, words, words[1:])) / n, len(set(lines)) / len(lines),
        capitals / size, digits / size, sum(others.values()) / size, max(others.values(), default=0) / size,
        len(zlib.compress(raw, 1)) / len(raw), sum(line[-1].isalnum() for line in lines) / len(lines),
    )
    return out


@dataclass(frozen=True)
class Ranking:
    """Weights over standardised features; a text's log strength is their product."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    quantile: float
    constant: float | None = None

    def strength(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1, rising with the strength; CUT_SCORE exactly on the cut."""
        if self.constant is not None:
            return np.full(len(rows), self.constant)
        z = self.strength(rows) - self.cut + np.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def pairs_of(preferred: int, other: int, per_row: int = PAIRS_PER_ROW) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (preferred, other) of preference pairs: each row of the larger class with `per_row` different rows of the other, in turn."""
    n, small = max(preferred, other), min(preferred, other)
    k = min(per_row, small)
    many = np.repeat(np.arange(n), k)
    few = (many * k + np.tile(np.arange(k), n)) % small
    return (many, few) if preferred >= other else (few, many)


def descend(differences: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """Weights of least mean logistic loss log(1 + exp(-w.d)) over preference differences, by damped Newton steps."""
    m, width = differences.shape
    w = np.zeros(width)

    def loss(v: np.ndarray) -> float:
        return float(np.logaddexp(0, -differences @ v).mean() + ridge * (v @ v) / 2)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(differences @ w, -500, 500)))
        gradient = -differences.T @ p / m + ridge * w
        hessian = (differences * (p * (1 - p))[:, None]).T @ differences / m + ridge * np.eye(width)
        step = np.linalg.solve(hessian, gradient)
        size = 1.0
        while (then := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        if then >= now - 1e-12:
            break
        w, now = w - size * step, then
    return w


def cut_at(strength: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(cut, quantile) of the strengths: the score quantile that leaves the least labelled weight on the wrong side.

    The cut lies halfway between the neighbours; among equally good quantiles it is the middle one.
    """
    order = np.argsort(strength, kind="stable")
    s, g, w = strength[order], good[order], weight[order]
    wrong = np.concatenate([[0], np.cumsum(w * g)]) + (w * ~g).sum() - np.concatenate([[0], np.cumsum(w * ~g)])
    allowed = np.concatenate([[True], s[1:] > s[:-1], [True]])
    best = np.flatnonzero(allowed & (wrong <= wrong[allowed].min() + 1e-9))
    at = int(best[len(best) // 2])
    low, high = s[max(at - 1, 0)], s[min(at, len(s) - 1)]
    cut = low + 1e-9 if at == len(s) else high - 1e-9 if at == 0 else (low + high) / 2
    return float(cut), float(w[:at].sum() / w.sum())


def learn(rows: np.ndarray, y: np.ndarray, weight: dict[int, float], per_row: int = PAIRS_PER_ROW) -> Ranking:
    """A ranking from labelled feature rows; `weight` is what a row of each class stands for."""
    mean, scale = rows.mean(axis=0), rows.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    x = np.clip((rows - mean) / scale, -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    i, j = pairs_of(len(good), len(bad), per_row)
    weights = descend(x[good[i]] - x[bad[j]])
    cut, quantile = cut_at(x @ weights, y == 1, np.array([weight[int(v)] for v in y]))
    return Ranking(mean, scale, weights, cut, quantile)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
        per_class: int = SAMPLE_PER_CLASS, per_row: int = PAIRS_PER_ROW) -> Ranking:
    """A ranking from labels 1 (preferred) and 0.

    A bounded sample of labelled rows, `per_class` of the smallest hashes in each class, gives the pairs; only
    their features come to the driver. Rows are weighted back to all labels for the cut. Null ids and other
    label values are left out; with labels of one class, or none, every score is that class, or a half.
    """
    rows, weight = sample(docs, labels, id_col, text, label, per_class)
    if len(weight) < 2:
        nothing = np.zeros(STATISTICS + SHAPES)
        return Ranking(nothing, nothing + 1, nothing, 0.0, 0.0, 1.0 if 1 in weight else 0.0 if 0 in weight else 0.5)

    @pandas_udf("array<double>")
    def described(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    found = materialise(rows, "preferred").select("y", described("text").alias("x")).collect()  # bounded by the sample
    found.sort(key=lambda r: (r["y"], r["x"]))
    y = np.array([r["y"] for r in found])
    if len(set(y)) < 2:  # labels of documents that are not there
        return Ranking(*(np.zeros(STATISTICS + SHAPES) + k for k in (0, 1, 0)), 0.0, 0.0, float(y[0]) if len(y) else 0.5)
    generator = np.random.default_rng(0)  # pairs must not follow the order of the features
    order = generator.permutation(len(y))
    return learn(np.array([r["x"] for r in found])[order], y[order], weight, per_row)


def score(docs: DataFrame, ranking: Ranking, text: str = "text") -> Column:
    """Score of each whole text; null counts as empty."""

    @pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(ranking.score(np.array([features(t) for t in texts])))

    return scores(docs[text])


def keep_best(docs: DataFrame, ranking: Ranking, text: str = "text") -> DataFrame:
    """The documents above the cut, all columns."""
    return docs.filter(score(docs, ranking, text) >= F.lit(CUT_SCORE))
