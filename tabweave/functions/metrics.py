"""Scores of token lists against a reference, a batch at a time: tokens and n-grams are numbers, and all counting is done on arrays."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .batches import parts


class Pairs:
    """The tokens of predictions and of truths; a token, and an n-gram, has the same number wherever it stands."""

    def __init__(self, predictions: list, truths: list):
        both = [*predictions, *truths]
        self.rows = len(predictions)
        self.size = np.array([len(x) for x in both], np.int64)
        self.of = np.repeat(np.arange(len(both)), self.size)
        self.at = np.arange(self.size.sum()) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.unit = pd.factorize(np.array([t for x in both for t in x], dtype=object))[0].astype(np.int64) if self.size.sum() else np.zeros(0, np.int64)
        self.gram, self.n = self.unit, 1

    def longer(self) -> None:
        """From n-grams to those of one token more: pairs of an n-gram and the token after it are numbered anew."""
        self.n += 1
        follow = self.unit[self.n - 1 :]
        pair = self.gram[: len(follow)] * (self.unit.max(initial=0) + 1) + follow
        self.gram = np.unique(pair, return_inverse=True)[1].astype(np.int64)

    def matched(self) -> np.ndarray:
        """For each pair, how many n-grams of the prediction the truth has too, each as often as it has it."""
        some = self.at[: len(self.gram)] + self.n <= self.size[self.of[: len(self.gram)]]
        of, gram = self.of[: len(self.gram)][some], self.gram[some]
        kinds = self.gram.max(initial=0) + 1
        mine = of < self.rows
        a, many = np.unique(of[mine] * kinds + gram[mine], return_counts=True)
        b, often = np.unique((of[~mine] - self.rows) * kinds + gram[~mine], return_counts=True)
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        return np.bincount(a[i] // kinds, np.minimum(many[i], often[j]), self.rows)


def f1(predictions: list, truths: list) -> np.ndarray:
    """Token F1; where one has no token, whether neither has."""
    pairs = Pairs(predictions, truths)
    a, b = pairs.size[: pairs.rows], pairs.size[pairs.rows :]
    return np.where((a == 0) | (b == 0), (a == b).astype(float), 2 * pairs.matched() / np.maximum(a + b, 1))


def bleu(predictions: list, truths: list, orders: tuple[int, ...]) -> np.ndarray:
    """(orders, pairs): BLEU with even weights up to each order, one reference, and 0.1 for orders without a match; 0 where no token matches."""
    pairs = Pairs(predictions, truths)
    a, b = pairs.size[: pairs.rows], pairs.size[pairs.rows :]
    logs = []
    for n in range(1, max(orders) + 1):
        if n > 1:
            pairs.longer()
        m = pairs.matched()
        if n == 1:
            none = m == 0
        logs.append(np.log(np.where(m > 0, m, 0.1) / np.maximum(1, a - n + 1)))
    short = np.where(a > b, 1.0, np.exp(1 - b / np.maximum(a, 1)))
    return np.stack([np.where(none, 0.0, short * np.exp(sum(logs[:n]) / n)) for n in orders])


def adaptive_bleu_of(predictions: list, truths: list) -> np.ndarray:
    """BLEU-1 for up to three tokens, the mean of orders 1 and 2 for up to seven, else of 1, 2 and 4."""
    one, two, four = bleu(predictions, truths, (1, 2, 4))
    size = np.array([len(p) for p in predictions])
    return np.where(size <= 3, one, np.where(size <= 7, (one + two) / 2, (one + two + four) / 3))


#: Characters of both texts, or cells of both tables, that are counted at once, unless a single pair has more.
MOST_CHARS, MOST_CELLS = 1 << 20, 1 << 17


def _tokens(texts: pd.Series) -> list:
    return [(t or "").split() for t in texts]


def _by_parts(score: Callable[[list, list], np.ndarray], a: pd.Series, b: pd.Series, tokens: Callable[[pd.Series], list], most: int) -> pd.Series:
    """The scores of a batch, a part of it at a time: a pair's score doesn't hang on the others."""
    sizes = np.array([len(x) if x is not None else 0 for x in a], np.int64) + np.array([len(x) if x is not None else 0 for x in b], np.int64)
    return pd.Series(np.concatenate([score(tokens(a[i:j]), tokens(b[i:j])) for i, j in parts(sizes, most)]))


@F.pandas_udf(DoubleType())
def token_f1(prediction: pd.Series, truth: pd.Series) -> pd.Series:
    return _by_parts(f1, prediction, truth, _tokens, MOST_CHARS)


@F.pandas_udf(DoubleType())
def adaptive_bleu(prediction: pd.Series, truth: pd.Series) -> pd.Series:
    return _by_parts(adaptive_bleu_of, prediction, truth, _tokens, MOST_CHARS)


@F.pandas_udf(DoubleType())
def table_bleu(prediction: pd.Series, truth: pd.Series) -> pd.Series:
    """Of two arrays of cell tokens."""
    return _by_parts(lambda p, t: bleu(p, t, (4,))[0], prediction, truth, list, MOST_CELLS)
