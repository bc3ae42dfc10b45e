"""Landmark frames: normalisation, hand shapes and motion over time windows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Indices of landmark points (fixed values of the hand model).
WRIST, MIDDLE_MCP = 0, 9
TIPS = {"index": (8, 6), "middle": (12, 10), "ring": (16, 14), "pinky": (20, 18)}
N_POINTS = 21


@dataclass(frozen=True)
class MotionRule:
    """A motion sign as data: a hand shape that is held while a fingertip moves.

    fingers: those that are stretched out, all others are not.  tip: the finger
    whose tip is followed.  Each test that is not None must hold over the
    window: the tip falls by more than ``drop`` from its first to its last
    sample; in the last third of the window's time it moves sideways by more
    than ``hook``; the hand's centre moves by ``travel`` at least along
    travel_axis (in the last travel_ms, if given); and the last ``strokes``
    strokes of the tip along stroke_axis, each of at least ``stroke``, alternate.
    """

    name: str
    fingers: tuple[str, ...]
    tip: str
    drop: float | None = None
    hook: float | None = None
    travel: float | None = None
    travel_axis: str = "x"
    travel_ms: int | None = None
    strokes: int = 0
    stroke: float = 0.25
    stroke_axis: str = "x"

    @property
    def shape(self) -> str:
        """The name of the column that tells whether a sample has the hand shape."""
        return {("pinky",): "i_shape", ("index",): "point_shape"}.get(self.fingers, "_".join((*self.fingers, "shape")))


@dataclass(frozen=True)
class MotionConfig:
    """Thresholds of motions; rules: the signs in the order in which they are tested, J and Z by these thresholds if None."""

    window_ms: int = 650
    min_samples: int = 8
    shape_ratio: float = 0.7
    j_drop: float = 0.5
    j_hook: float = 0.25
    z_stroke: float = 0.25
    z_drop: float = 0.3
    z_travel: float = 0.3
    deadband: float = 0.08
    lookback_ms: int = 180
    rules: tuple[MotionRule, ...] | None = None

    @property
    def signs(self) -> tuple[MotionRule, ...]:
        if self.rules is not None:
            return self.rules
        return MotionRule("J", ("pinky",), "pinky", drop=self.j_drop, hook=self.j_hook), MotionRule("Z", ("index",), "index", drop=self.z_drop, travel=self.z_travel, strokes=3, stroke=self.z_stroke)

    @property
    def sample(self) -> tuple[str, ...]:
        """What the signs need of a frame, by name: its time and number, the hand shapes, the tips and the centre."""
        shapes = dict.fromkeys(r.shape for r in self.signs)
        tips = dict.fromkeys(f"{r.tip}_{c}" for r in self.signs for c in ("x", "y"))
        return ("t_ms", "frame_no", *shapes, *tips, "cx", "cy")


def _point(i: int) -> Column:
    return F.col("landmarks")[i]


def _size(w: float = 1.0, h: float = 1.0) -> Column:
    dx = (_point(MIDDLE_MCP)["x"] - _point(WRIST)["x"]) * w
    dy = (_point(MIDDLE_MCP)["y"] - _point(WRIST)["y"]) * h
    size = F.sqrt(dx * dx + dy * dy)
    return F.when(size == 0, 1e-6).otherwise(size)


def hand_frame(frames: DataFrame, w: float = 640.0, h: float = 480.0) -> DataFrame:
    """frames with ``features``: 42 numbers in the hand's own frame, mirrored so that the third point lies right."""
    sized = frames.withColumn("_size", _size(w, h))
    ux = (_point(MIDDLE_MCP)["x"] - _point(WRIST)["x"]) * w / F.col("_size")
    uy = (_point(MIDDLE_MCP)["y"] - _point(WRIST)["y"]) * h / F.col("_size")
    axes = sized.withColumns({"_ux": ux, "_uy": uy})
    x = lambda p: (p["x"] - _point(WRIST)["x"]) * w
    y = lambda p: (p["y"] - _point(WRIST)["y"]) * h
    local = F.transform("landmarks", lambda p: F.struct(((x(p) * F.col("_uy") - y(p) * F.col("_ux")) / F.col("_size")).alias("x"), ((x(p) * F.col("_ux") + y(p) * F.col("_uy")) / F.col("_size")).alias("y")))
    turned = axes.withColumn("_local", local).withColumn("_sign", F.when(F.col("_local")[2]["x"] < 0, -1.0).otherwise(1.0))
    return turned.withColumn("features", F.flatten(F.transform("_local", lambda p: F.array(p["x"] * F.col("_sign"), p["y"])))).drop("_size", "_ux", "_uy", "_local", "_sign")


def samples(frames: DataFrame, *more: str, signs: tuple[MotionRule, ...] = ()) -> DataFrame:
    """stream_id, frame_no, t_ms, i_shape, point_shape, fingertips and centroid in hand widths, what signs need besides, and more columns of frames."""
    sized = frames.withColumn("_size", _size())
    r = lambda i: (_point(i)["x"] - _point(WRIST)["x"]) * (_point(i)["x"] - _point(WRIST)["x"]) + (_point(i)["y"] - _point(WRIST)["y"]) * (_point(i)["y"] - _point(WRIST)["y"])
    out = {name: r(tip) > r(pip) for name, (tip, pip) in TIPS.items()}
    mean = lambda c: F.aggregate("landmarks", F.lit(0.0), lambda a, p: a + p[c]) / N_POINTS / F.col("_size")
    signs = (*MotionConfig().signs, *signs)
    only = lambda fingers: reduce(and_, [out[n] if n in fingers else ~out[n] for n in TIPS])
    return sized.select(
        "stream_id",
        "frame_no",
        "t_ms",
        *[F.col(c) for c in ("label",) if c in frames.columns],
        *[only(fingers).alias(shape) for shape, fingers in {r.shape: r.fingers for r in signs}.items()],
        *[(_point(TIPS[n][0])[c] / F.col("_size")).alias(f"{n}_{c}") for n in dict.fromkeys(r.tip for r in signs) for c in ("x", "y")],
        mean("x").alias("cx"),
        mean("y").alias("cy"),
        *more,
    )


def motion_window(frames: DataFrame, c: MotionConfig = MotionConfig()) -> DataFrame:
    """samples with the statistics of the time window that ends at each frame."""
    w = Window.partitionBy("stream_id").orderBy("t_ms").rangeBetween(-c.window_ms, 0)
    near = Window.partitionBy("stream_id").orderBy("t_ms").rangeBetween(-c.lookback_ms, 0)
    held = lambda name, over: F.count_if(F.col(name)).over(over)
    n, m = F.count("*").over(w), F.count("*").over(near)
    moved = lambda f: F.sqrt(F.pow(F.col(f"{f}_x") - F.first(f"{f}_x").over(near), 2) + F.pow(F.col(f"{f}_y") - F.first(f"{f}_y").over(near), 2))
    i_like, p_like = held("i_shape", near) >= c.shape_ratio * m, held("point_shape", near) >= c.shape_ratio * m
    return samples(frames).select(
        "*",
        n.alias("n"),
        F.min("t_ms").over(w).alias("t0"),
        held("i_shape", w).alias("n_i"),
        held("point_shape", w).alias("n_point"),
        (held("i_shape", w) >= c.shape_ratio * n).alias("i_held"),
        (held("point_shape", w) >= c.shape_ratio * n).alias("point_held"),
        (F.max("cx").over(w) - F.min("cx").over(w)).alias("travel"),
        (F.max("cy").over(w) - F.min("cy").over(w)).alias("rise"),
        (F.col("pinky_y") - F.first("pinky_y").over(w)).alias("j_fall"),
        (F.col("index_y") - F.first("index_y").over(w)).alias("z_fall"),
        F.collect_list(F.struct("t_ms", "pinky_x", "index_x", "frame_no")).over(w).alias("buffer"),
        ((m >= 3) & (i_like | p_like) & (F.when(i_like, moved("pinky")).otherwise(moved("index")) > c.deadband)).alias("candidate"),
    )


def motion_diagnostics(frames: DataFrame, c: MotionConfig = MotionConfig()) -> DataFrame:
    """stream_id, frame_no and the live values of the rules over each frame's window.

    status is 'n/min_samples samples' until the window has enough of them, and
    the values are null then: span_ms, n_i, n_point, j_drop, j_hook, n_strokes,
    z_drift and hand_travel, rounded to three places.
    """
    w = motion_window(frames, c).withColumn("_path", F.transform("buffer", lambda b: b["index_x"]))
    third = F.filter("buffer", lambda b: b["t_ms"] >= F.col("t_ms") - (F.col("t_ms") - F.col("t0")) / 3)
    hook = F.abs(F.element_at(third, -1)["pinky_x"] - third[0]["pinky_x"])
    enough = F.col("n") >= c.min_samples
    told = lambda x: F.when(enough, x)
    values = {"j_drop": F.col("j_fall"), "j_hook": hook, "z_drift": F.col("z_fall"), "hand_travel": F.col("travel")}
    return w.select(
        "stream_id",
        "frame_no",
        F.when(~enough, F.concat(F.col("n").cast("string"), F.lit(f"/{c.min_samples} samples"))).alias("status"),
        told(F.col("t_ms") - F.col("t0")).alias("span_ms"),
        told(F.col("n_i")).alias("n_i"),
        told(F.col("n_point")).alias("n_point"),
        told(F.size(strokes("_path", c)).cast("long")).alias("n_strokes"),
        *[told(F.round(v, 3) + F.lit(0.0)).alias(k) for k, v in values.items()],
    )


def hand_travel(frames: DataFrame, axis: str = "x", lookback_ms: int | None = None, c: MotionConfig = MotionConfig()) -> DataFrame:
    """stream_id, frame_no, travel: how far the centroid moved along an axis in the window, or in its last lookback_ms."""
    if axis not in ("x", "y"):
        raise ValueError("axis must be x or y")
    w = Window.partitionBy("stream_id").orderBy("t_ms").rangeBetween(-min(c.window_ms, c.window_ms if lookback_ms is None else lookback_ms), 0)
    return samples(frames).select("stream_id", "frame_no", (F.max(f"c{axis}").over(w) - F.min(f"c{axis}").over(w)).alias("travel"))


def strokes(path: str, c: MotionConfig = MotionConfig(), least: float | None = None) -> Column:
    """Directions (+1, -1) of the strokes of the path in a column: the ways between its turning points that are long enough.

    A turning point is an extreme from which the path goes back by more than the deadband.
    """
    start = "named_struct('turn', p[0], 'tip', p[0], 'ways', cast(array() as array<double>))"
    step = f"""(a, x) -> case
        when (x - a.tip) * (a.tip - a.turn) > 0 or (a.tip = a.turn and abs(x - a.tip) > {c.deadband}) then named_struct('turn', a.turn, 'tip', x, 'ways', a.ways)
        when a.tip <> a.turn and abs(x - a.tip) > {c.deadband} then named_struct('turn', a.tip, 'tip', x, 'ways', array_append(a.ways, a.tip - a.turn))
        else a end"""
    ways = f"transform(array({path}), p -> aggregate(p, {start}, {step}, a -> array_append(a.ways, a.tip - a.turn)))[0]"
    return F.expr(f"transform(filter({ways}, w -> abs(w) >= {c.z_stroke if least is None else least}), w -> cast(sign(w) as int))")


def plain_signs(frames: DataFrame, c: MotionConfig = MotionConfig()) -> DataFrame:
    """stream_id, frame_no, start_frame, and for each sign a boolean is_<name>: its rule over the plain time window, as if nothing had fired."""
    over = lambda ms: Window.partitionBy("stream_id").orderBy("t_ms").rangeBetween(-ms, 0)
    w = over(c.window_ms)
    n = F.count("*").over(w)
    picked = lambda name: F.transform("_buffer", lambda b: b[name])
    turns = lambda s: F.forall(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda i: F.coalesce(F.get(s, i - 1) != F.get(s, i), F.lit(True)))
    held = samples(frames, signs=c.signs).withColumns({"_n": n, "_t0": F.min("t_ms").over(w), "_buffer": F.collect_list(F.struct(*c.sample)).over(w)})
    tests = {}
    for k, r in enumerate(c.signs):
        held = held.withColumn(f"_path{k}", picked(f"{r.tip}_{r.stroke_axis}"))
        third = F.filter("_buffer", lambda b: b["t_ms"] >= F.col("t_ms") - (F.col("t_ms") - F.col("_t0")) / 3)
        away = over(min(c.window_ms, c.window_ms if r.travel_ms is None else r.travel_ms))
        shaped = F.count_if(F.col(r.shape)).over(w) >= c.shape_ratio * n
        cheap = [F.col("_n") >= c.min_samples, F.col(f"_shaped{k}")]
        held = held.withColumns({f"_shaped{k}": shaped, f"_fall{k}": F.col(f"{r.tip}_y") - F.first(f"{r.tip}_y").over(w), f"_travel{k}": F.max(f"c{r.travel_axis}").over(away) - F.min(f"c{r.travel_axis}").over(away)})
        cheap += [F.col(f"_fall{k}") > r.drop] * (r.drop is not None) + [F.col(f"_travel{k}") >= (r.travel or 0.0)] * (r.travel is not None)
        costly = [F.abs(F.element_at(third, -1)[f"{r.tip}_x"] - third[0][f"{r.tip}_x"]) > r.hook] if r.hook is not None else []
        if r.strokes:
            last = F.slice(F.reverse(strokes(f"_path{k}", c, r.stroke)), 1, r.strokes)
            costly.append((F.size(last) == r.strokes) & turns(last))
        # The costly tests come after the cheap ones.
        tests[f"is_{r.name.lower()}"] = F.when(reduce(and_, cheap), reduce(and_, costly, F.lit(True))).otherwise(False)
    return held.select("stream_id", "frame_no", F.col("_buffer")[0]["frame_no"].alias("start_frame"), *[v.alias(k) for k, v in tests.items()])


def motion_rules(frames: DataFrame, c: MotionConfig = MotionConfig()) -> DataFrame:
    """stream_id, frame_no, start_frame, is_<name> of each sign, n_strokes (of the index finger), travel, candidate: over the plain window."""
    w = motion_window(frames, c).withColumn("_path", F.transform("buffer", lambda b: b["index_x"]))
    moves = F.when(F.col("n") >= c.min_samples, F.size(strokes("_path", c))).otherwise(0).cast("long")
    told = w.select("stream_id", "frame_no", moves.alias("n_strokes"), F.round("travel", 6).alias("travel"), "candidate")
    return plain_signs(frames, c).join(told, ["stream_id", "frame_no"])


def bounding_box(frames: DataFrame, w: int = 640, h: int = 480, margin: int = 20) -> DataFrame:
    """stream_id, frame_no and the box around the points in pixels."""
    side = lambda c, size, f, sign: ((f(F.transform("landmarks", lambda p: p[c])) * size).cast("int") + sign * margin)
    return frames.select("stream_id", "frame_no", side("x", w, F.array_min, -1).alias("x0"), side("y", h, F.array_min, -1).alias("y0"), side("x", w, F.array_max, 1).alias("x1"), side("y", h, F.array_max, 1).alias("y1"))
