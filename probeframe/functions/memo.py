"""Results of small readers for rows that repeat, kept on Arrow arrays between the batches of a Python worker."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

#: Distinct rows that are remembered; beyond, memory starts anew, so that it is bounded.
MOST = 50_000


class Memo:
    """Calls ``read`` for rows that it hasn't met; what repeats is taken from earlier results.

    ``read`` gets a list of distinct rows (texts, or tuples of several columns')
    and returns an Arrow array with an element for each.
    """

    def __init__(self, read: Callable[[list], pa.Array], most: int = MOST):
        self.read, self.most = read, most
        self.places: dict = {}
        self.results: pa.Array | None = None

    def __call__(self, rows: list) -> pa.Array:
        new = [r for r in dict.fromkeys(rows) if r not in self.places]
        if self.results is not None and len(self.places) + len(new) > self.most:
            self.places, self.results = {}, None
            new = list(dict.fromkeys(rows))
        if new or self.results is None:
            made = self.read(new)
            self.places.update(zip(new, range(len(self.places), len(self.places) + len(new)), strict=True))
            self.results = made if self.results is None else pa.concat_arrays([self.results, made])
        return self.results.take(pa.array([self.places[r] for r in rows], pa.int64()))
