"""Batches of rows in parts, so that what a step holds follows the part."""

import numpy as np


def parts(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(begin, end) of runs of rows whose sizes add up to some `most` each, unless a single row has more. No row gives one empty run."""
    ends = np.cumsum(np.asarray(sizes, np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), len(ends)]
    return list(zip(cuts, cuts[1:], strict=False))
