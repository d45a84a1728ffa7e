"""Directives as the search for the best match sees them: action, trigger and concept groups."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from corroborate.functions import vocabulary as V
from corroborate.operators.overlap import Judge, _spans

# Workers receive the functions of this module by value and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CONTAINMENT, CONCEPT = V.CONTAINMENT_WEIGHT, V.CONCEPT_WEIGHT
# Pairs of trigger classes that are compared ahead.
GRID = 1 << 20


class _Directives:
    """Order, groups and triggers of some directives; equal triggers are one class."""

    def __init__(self, table: pa.Table):
        self.order = table.column("order").to_numpy() if "order" in table.column_names else None
        self.own = table.column("own").to_numpy() if "own" in table.column_names else None

        def matrix(name: str) -> np.ndarray:
            flat = pc.list_flatten(table.column(name)).to_numpy()
            return flat.astype(np.int64).reshape(len(table), -1) if len(flat) else np.zeros((len(table), 0), np.int64)

        self.action, flags = matrix("action_flags"), matrix("trigger_flags")
        lists = table.column("trigger").combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        ends, keys = lists.offsets.to_numpy().astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)
        ends = ends - ends[:1]
        marked = table.column("has_trigger").to_numpy(zero_copy_only=False).astype(bool)
        classes: dict[bytes, int] = {}
        raw, size = keys.tobytes(), len(flags[:1].tobytes())
        packed = flags.tobytes()
        self.of = np.array([classes.setdefault(raw[8 * a : 8 * b] + packed[size * i : size * i + size] + bytes([m]), len(classes)) for i, (a, b, m) in enumerate(zip(ends.tolist(), ends[1:].tolist(), marked.tolist()))], np.int64)
        lead = np.zeros(len(classes), np.int64)
        lead[self.of[::-1]] = np.arange(len(self.of))[::-1]
        self.count, self.flags, self.marked = len(classes), flags[lead], marked[lead]
        self.size = (ends[1:] - ends[:-1])[lead]
        self.start = np.cumsum(self.size) - self.size
        self.keys = keys[_spans(ends[lead], self.size)]


class DirectiveJudge(Judge):
    """Scores directives by min(trigger, action); what is found already comes with the seekers.

    A pair whose action scores by groups is among what was found, so a better one has an action
    that agrees in words at least as much.
    """

    seeker_columns = ("have", "have_order", "own", "trigger", "has_trigger", "action_flags", "trigger_flags")
    other_columns = ("trigger", "has_trigger", "action_flags", "trigger_flags")

    def state(self, seekers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return seekers.column("have").to_numpy().copy(), seekers.column("have_order").to_numpy().copy()

    def side(self, table: pa.Table) -> _Directives:
        return _Directives(table)

    def _triggers(self, seekers: _Directives, others: _Directives, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Similarity of the triggers of each pair of classes; infinite where neither has one."""
        words, which = np.unique(others.keys, return_inverse=True)
        held = np.sort(which * others.count + np.repeat(np.arange(others.count), others.size))
        keys = seekers.keys[_spans(seekers.start[i], seekers.size[i])]
        pair = np.repeat(np.arange(len(i)), seekers.size[i])
        shared = np.zeros(len(i), np.int64)
        if len(words):
            at = np.minimum(np.searchsorted(words, keys), len(words) - 1)
            want = at * others.count + j[pair]
            met = (words[at] == keys) & (held[np.minimum(np.searchsorted(held, want), len(held) - 1)] == want)
            shared = np.bincount(pair[met], minlength=len(i))
        return np.where(seekers.marked[i] | others.marked[j], np.maximum(_raw(shared, seekers.size[i], others.size[j]), _groups(seekers.flags[i], others.flags[j])), np.inf)

    def _grid(self, seekers: _Directives, others: _Directives) -> np.ndarray | None:
        """All pairs of classes, if they are few; kept until other sides come."""
        if getattr(self, "_of", None) is None or self._of[0] is not seekers or self._of[1] is not others:
            grid = None
            if seekers.count * others.count <= GRID:
                i, j = np.divmod(np.arange(seekers.count * others.count), others.count)
                grid = self._triggers(seekers, others, i, j).reshape(seekers.count, others.count)
            self._of = (seekers, others, grid)
        return self._of[2]

    def top(self, seekers: _Directives, others: _Directives) -> np.ndarray | float:
        grid = self._grid(seekers, others)
        return 1.0 if grid is None else np.minimum(grid.max(axis=1), 1.0)[seekers.of]

    def _trigger(self, seekers: _Directives, others: _Directives, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        grid = self._grid(seekers, others)
        mine, theirs = seekers.of[i], others.of[j]
        if grid is not None:
            return grid[mine, theirs]
        some, which = np.unique(mine * others.count + theirs, return_inverse=True)
        return self._triggers(seekers, others, some // others.count, some % others.count)[which]

    def ceiling(self, seekers: _Directives, others: _Directives, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.where(others.order[j] == seekers.own[i], -2.0, np.minimum(self._trigger(seekers, others, i, j), 1.0))

    def score(self, seekers: _Directives, others: _Directives, i: np.ndarray, j: np.ndarray, raw: np.ndarray) -> np.ndarray:
        action = np.maximum(raw, _groups(seekers.action[i], others.action[j]))
        return np.minimum(action, self._trigger(seekers, others, i, j))


def _raw(shared: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``token_similarity`` of sets of these sizes."""
    some = (left > 0) & (right > 0)
    union, smaller = np.where(some, left + right - shared, 1), np.where(some, np.minimum(left, right), 1)
    return np.where(some, np.maximum(shared / union, shared / smaller * CONTAINMENT), 0.0)


def _groups(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What the overlap of groups is worth, from a flag for each group."""
    least = np.minimum(left.sum(axis=1), right.sum(axis=1))
    return np.where(least > 0, CONCEPT * ((left & right).sum(axis=1) / np.maximum(least, 1)), 0.0)
