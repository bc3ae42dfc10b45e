"""Motions of one stream, sample by sample: the buffer of a time window and the rules over it."""

from __future__ import annotations

from collections import deque

import numpy as np

from .geometry import MotionConfig, MotionRule

#: What is held of a sample for J and Z, in this order.
SAMPLE = MotionConfig().sample


def turning_points(path: np.ndarray, deadband: float) -> np.ndarray:
    """The path's first value and its extremes between turns of more than the deadband; the last one may still move on."""
    points = [path[0], path[0]]
    for x in path:
        way = points[-1] - points[-2]
        step = x - points[-1]
        if step * way > 0 or (way == 0 and abs(step) > deadband):
            points[-1] = x
        elif way != 0 and abs(step) > deadband:
            points.append(x)
    return np.array(points)


def stroke_signs(path: np.ndarray, c: MotionConfig, least: float | None = None) -> np.ndarray:
    """+1 and -1 for the ways between turning points that are long enough."""
    ways = np.diff(turning_points(path, c.deadband))
    return np.sign(ways[np.abs(ways) >= (c.z_stroke if least is None else least)]).astype(int)


class MotionBuffer:
    """The samples of a stream's last window_ms, as the config's ``sample`` names their values."""

    def __init__(self, config: MotionConfig, held: list | None = None) -> None:
        self.config, self.held = config, deque(map(tuple, held or ()))
        self.place = {name: k for k, name in enumerate(config.sample)}

    def clear(self) -> None:
        self.held.clear()

    def column(self, name: str) -> np.ndarray:
        k = self.place[name]
        return np.array([s[k] for s in self.held], float)

    def moved(self, name: str) -> float:
        """From the first sample to the last one."""
        k = self.place[name]
        return self.held[-1][k] - self.held[0][k]

    def travel(self, axis: str = "x", lookback_ms: float | None = None) -> float:
        """How far the centroid moved along an axis in the window or its last lookback_ms; 0 without samples."""
        if not self.held:
            return 0.0
        t, way = self.column("t_ms"), self.column(f"c{axis}")
        return float(np.ptp(way if lookback_ms is None else way[t >= t[-1] - lookback_ms]))

    def add(self, sample: tuple) -> tuple[str, int] | None:
        """A motion that this sample completes, as its name and first frame; the buffer is empty then."""
        self.held.append(tuple(sample))
        while self.held[0][0] < sample[0] - self.config.window_ms:
            self.held.popleft()
        if len(self.held) < self.config.min_samples:
            return None
        name = next((r.name for r in self.config.signs if self._holds(r)), None)
        if name is None:
            return None
        first = self.held[0][1]
        self.held.clear()
        return name, int(first)

    def _holds(self, r: MotionRule) -> bool:
        """Whether a rule holds over the window.  The costly tests come last."""
        c, k = self.config, self.place[r.shape]
        if r.drop is not None and not self.moved(f"{r.tip}_y") > r.drop:
            return False
        if sum(s[k] for s in self.held) < c.shape_ratio * len(self.held):
            return False
        if r.travel is not None and self.travel(r.travel_axis, r.travel_ms) < r.travel:
            return False
        if r.hook is not None:
            t, x = self.column("t_ms"), self.column(f"{r.tip}_x")
            hook = x[t >= t[-1] - (t[-1] - t[0]) / 3]
            if not abs(hook[-1] - hook[0]) > r.hook:
                return False
        last = stroke_signs(self.column(f"{r.tip}_{r.stroke_axis}"), c, r.stroke)[-r.strokes :] if r.strokes else ()
        return len(last) == r.strokes and bool((np.diff(last) != 0).all())

    def candidate(self) -> bool:
        """Whether a sign's hand shape is held lately and its finger moves."""
        c = self.config
        recent = [s for s in self.held if s[0] >= self.held[-1][0] - c.lookback_ms]
        if len(recent) < 3:
            return False
        for r in c.signs:
            k = self.place[r.shape]
            if sum(s[k] for s in recent) >= c.shape_ratio * len(recent):
                x, y = self.place[f"{r.tip}_x"], self.place[f"{r.tip}_y"]
                return bool(np.hypot(recent[-1][x] - recent[0][x], recent[-1][y] - recent[0][y]) > c.deadband)
        return False
