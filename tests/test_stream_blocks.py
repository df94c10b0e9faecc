"""Streamed visits: subjects are held in blocks, so that calls for state and timers do not grow with the subjects."""

import numpy as np
import pandas as pd

from eventloom.streaming import visits as X

GAP, GRACE = 10, 20


class _Handle:
    """State and timers of one key, and the calls made for them."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def _call(self, f):
        self.calls += 1
        return f()

    def exists(self):
        return self._call(lambda: self.value is not None)

    def get(self):
        return self._call(lambda: self.value)

    def update(self, value):
        self._call(lambda: setattr(self, "value", value))

    def clear(self):
        self._call(lambda: setattr(self, "value", None))

    def listTimers(self):
        return self._call(lambda: list(self.timers))

    def registerTimer(self, at):
        self._call(lambda: self.timers.add(at))

    def deleteTimer(self, at):
        self._call(lambda: self.timers.discard(at))


class _Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_block_costs_the_calls_of_one_key():
    handle, second = _Handle(), 1_000_000
    processor = X._VisitProcessor(GAP * second, GRACE * second)
    processor.init(handle)
    rng = np.random.default_rng(2)
    subject, t = rng.integers(0, 64, 2000), rng.integers(0, 3000, 2000) * second
    frames = [pd.DataFrame({"subject_id": s, "t": v}) for s, v in zip(np.array_split(subject, 3), np.array_split(t, 3))]
    assert not list(processor.handleInputRows((0,), iter(frames), _Now(0)))
    assert handle.calls <= 4 and len(handle.timers) == 1
    told = pd.concat(processor.handleExpiredTimer((0,), _Now(10**9), None))
    assert handle.value is None and not handle.timers and handle.calls <= 8
    want = []
    for s in np.unique(subject):
        mine = np.sort(t[subject == s])
        cuts = np.flatnonzero(np.diff(mine, prepend=mine[0] - GAP * second) >= GAP * second)
        want += [(s, v[0], v[-1], len(v), False) for v in np.split(mine, cuts[1:])]
    assert sorted(told.itertuples(index=False, name=None)) == sorted(want)


def test_held_blocks_come_back():
    block = X.BlockState(GAP, GRACE)
    assert block.take(np.array([7, -3, 7, 7]), np.array([0, 5, 100, 3])) == []
    block.timer = 4
    again = X.BlockState(GAP, GRACE, block.held())
    assert again.held() == block.held() and again.timer == 4
    assert sorted(again.tell(4)) == [(-3, 5, 5, 1), (7, 0, 3, 2)]
    assert again.take(np.array([7, 7]), np.array([1, 300])) == [(7, 0, 3, 1)]
