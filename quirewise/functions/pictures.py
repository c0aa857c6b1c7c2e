"""Difference hashes of pages that are set as pictures, by whole numbers only."""

from __future__ import annotations

import numpy as np

#: Characters of a set line; rows and columns of the grid that is hashed; each row gives one bit less than it has columns.
COLUMNS, GRID = 72, (8, 9)


def difference_hashes(texts: list[str]) -> np.ndarray:
    """64 bits of each text's picture: whether a cell of its grid is brighter than its right neighbour, row by row.

    A text is set in lines of ``COLUMNS`` characters, each dark unless it is a blank
    or a control character.  The grid's cells are the picture's area averages.
    """
    height, width = GRID
    sizes = np.array([len(t) for t in texts], np.int64)
    dark = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32) > 32
    rows = np.maximum(-(-sizes // COLUMNS), 1)
    first = np.cumsum(rows) - rows
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = (np.repeat(first, sizes) + at // COLUMNS) * width + at % COLUMNS * width // COLUMNS
    ink = np.bincount(place[dark], minlength=rows.sum() * width).reshape(-1, width)
    above = np.concatenate([np.zeros((1, width), np.int64), ink.cumsum(0)])
    # Edges of the grid's rows, in parts of a line.
    edges = rows[:, None] * np.arange(height + 1)
    line = first[:, None] + edges // height
    until = above[line] * height + (above[np.minimum(line + 1, len(ink))] - above[line]) * (edges % height)[:, :, None]
    cells = np.diff(until, axis=1)
    return np.packbits((cells[:, :, :-1] < cells[:, :, 1:]).reshape(len(texts), -1), axis=1).view(">i8").ravel().astype(np.int64)
