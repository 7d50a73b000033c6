"""Order-dependent folds over the rows of a track.

Each fold is a step function of (state, row). fold() runs it batch by batch over rows that Spark has
dealt by key and sorted, so a track of any length streams through one task; streaming/ runs the same
steps with keyed state.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import joins


def fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, dict], dict], fields: str) -> DataFrame:
    """df and the columns `fields` (DDL) that step(state, row) returns for each row, in the order of each key."""
    own = [f.strip().split()[0] for f in fields.split(",")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), None
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                key = tuple(row[k] for k in keys)
                if key != at:
                    at, state = key, start()
                out.append(step(state, row))
            made = pd.DataFrame(out, columns=own, index=frame.index)
            yield pd.concat([frame, made], axis=1)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, f"{kinds}, {fields}")


def _missing(x) -> bool:
    return x is None or x != x


def wrap(a):
    return (a + math.pi) % (2 * math.pi) - math.pi


@dataclass
class FilterConfig:
    """Noise and gates of the track filter. Gates, priors and noise levels."""

    q_vel: float = 1.5
    q_vz: float = 0.5
    q_yaw: float = math.radians(2.0)
    q_yaw_rate: float = math.radians(5.0)
    q_scale: float = 1e-3
    gates: dict = field(default_factory=lambda: {"pos": 25.0, "vel": 16.0, "alt": 16.0, "heading": 9.0, "scale": 25.0})
    sigma0: tuple = (5000.0, 5000.0, 100.0, 50.0, 50.0, 50.0, math.pi, math.radians(30.0), 0.3)
    sigma_v: float = 2.0
    sigma_yaw_rate: float = math.radians(1.0)
    sigma_heading: float = math.radians(15.0)
    straight: float = math.radians(2.0)
    least_speed: float = 5.0
    least_displacement: float = 30.0


#: What step() needs of a row; missing parts are null or NaN.
MEASURED = ("t", "vx", "vy", "yaw_rate", "alt", "alt_sigma", "fix_x", "fix_y", "fix_sigma")
FILTERED = "x_e double, y_n double, speed double, yaw double, scale double, sigma_pos double, vo_ok boolean, fix_ok boolean, fix_d2 double"
#: A track's state as one row.
HELD = "t double, x array<double>, p array<double>, moved array<double>, fix array<double>"
#: The states of many tracks as one row, one after the other.
HELD_ALL = HELD.replace("t double", "t array<double>")
#: Places in the state: east, north, up, their rates, yaw, its rate, scale of the motion.
E, N, UP, VE, VN, YAW, TURN, SCALE = 0, 1, 2, 3, 4, 6, 7, 8


class TrackFilter:
    """Gated linear filter of nine states for many tracks at once: arrays with a row a track.

    step() takes one row each of different tracks, so a partition's tracks advance together.
    """

    def __init__(self, cfg: FilterConfig | None = None, held: tuple | None = None):
        self.cfg = cfg or FilterConfig()
        self.t, self.x, self.p = np.empty(0), np.empty((0, 9)), np.empty((0, 9, 9))
        self.moved, self.fix = np.empty((0, 2)), np.empty((0, 2))
        if held is not None:
            self.t, self.x, self.moved, self.fix = np.array(held[:1]), *(np.array([v]) for v in (held[1], held[3], held[4]))
            self.p = np.array(held[2]).reshape(1, 9, 9)

    def held(self) -> tuple:
        """The state of the only track, in the order of HELD."""
        return float(self.t[0]), self.x[0].tolist(), self.p[0].ravel().tolist(), self.moved[0].tolist(), self.fix[0].tolist()

    def held_all(self) -> tuple:
        """The states of all tracks, in the order of HELD_ALL."""
        return tuple(v.ravel().tolist() for v in (self.t, self.x, self.p, self.moved, self.fix))

    @classmethod
    def of_all(cls, cfg: FilterConfig | None, held: tuple) -> TrackFilter:
        """Tracks that held_all() has kept."""
        out, n = cls(cfg), len(held[0])
        out.t, out.x, out.p, out.moved, out.fix = (np.array(v, float).reshape(n, *shape) for v, shape in zip(held, ((), (9,), (9, 9), (2,), (2,))))
        return out

    def grow(self, n: int) -> None:
        """Room for n tracks; new ones have not begun."""
        if more := n - len(self.t):
            start = np.zeros((more, 9))
            start[:, SCALE] = 1.0
            self.t, self.x = np.append(self.t, np.full(more, np.nan)), np.concatenate([self.x, start])
            self.p = np.concatenate([self.p, np.tile(np.diag(np.square(self.cfg.sigma0)), (more, 1, 1))])
            self.moved, self.fix = np.concatenate([self.moved, np.zeros((more, 2))]), np.concatenate([self.fix, np.full((more, 2), np.nan)])

    def _advance(self, i: np.ndarray, dt: np.ndarray) -> None:
        c, x, p, on = self.cfg, self.x[i], self.p[i], dt[:, None]
        place, rate = [E, N, UP, YAW], [VE, VN, UP + 3, TURN]
        x[:, place] += on * x[:, rate]
        x[:, YAW] = wrap(x[:, YAW])
        p[:, place] += on[..., None] * p[:, rate]
        p[:, :, place] += dt[:, None, None] * p[:, :, rate]
        drift = (np.array([c.q_vel, c.q_vel, c.q_vz, c.q_yaw_rate]) * on * on) ** 2 / 3
        noise = np.concatenate([drift[:, :3], (np.array([c.q_vel, c.q_vel, c.q_vz]) * on) ** 2, drift[:, 3:] + (c.q_yaw * on) ** 2, (c.q_yaw_rate * on) ** 2, (c.q_scale * on) ** 2], axis=1)
        p[:, range(9), range(9)] += noise
        self.x[i], self.p[i] = x, (p + p.transpose(0, 2, 1)) / 2

    def _measure(self, i: np.ndarray, h: np.ndarray, z: np.ndarray, r: np.ndarray, gate: str, angle: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Measurements z = h x with noise r of tracks i: which passed their gate, and their squared distances."""
        if not len(i):
            return np.empty(0, bool), np.empty(0)
        x, p = self.x[i], self.p[i]
        off = z - (h @ x[..., None])[..., 0]
        if angle:
            off = wrap(off)
        hp = h @ p
        solved = np.linalg.solve(hp @ h.transpose(0, 2, 1) + r, np.concatenate([hp, off[..., None]], axis=2))
        d2 = (off * solved[..., 9]).sum(axis=1)
        ok = d2 <= self.cfg.gates[gate]
        i, x, p, h, r, gain, off = i[ok], x[ok], p[ok], h[ok], r[ok], solved[ok, :, :9].transpose(0, 2, 1), off[ok]
        x = x + (gain @ off[..., None])[..., 0]
        x[:, YAW] = wrap(x[:, YAW])
        rest = np.eye(9) - gain @ h
        p = rest @ p @ rest.transpose(0, 2, 1) + gain @ r @ gain.transpose(0, 2, 1)
        self.x[i], self.p[i] = x, (p + p.transpose(0, 2, 1)) / 2
        return ok, d2

    def step(self, i: np.ndarray, row: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """One row each of the tracks i, in the order predict, velocity, altitude, heading, position.

        A fix in a track's first row is its start, with the velocity of the motion if that is known.
        """
        c, n = self.cfg, len(i)
        pick = lambda *states: np.tile(np.eye(9)[list(states)], (n, 1, 1))
        noise = lambda *var: np.stack([np.broadcast_to(v, (n,)) for v in var], axis=1)[..., None] * np.eye(len(var))
        turned = lambda: (lambda s, k: np.stack([row["vx"] * s + row["vy"] * k, row["vx"] * k - row["vy"] * s], axis=1))(np.sin(self.x[i, YAW]), np.cos(self.x[i, YAW]))
        moves, fixed = ~np.isnan(row["vx"]), ~np.isnan(row["fix_x"])
        new, at = np.isnan(self.t[i]), np.stack([row["fix_x"], row["fix_y"]], axis=1)
        begun = new & fixed
        if begun.any():
            j = i[begun]
            self.x[j, :2] = self.fix[j] = at[begun]
            self.p[j, E, E] = self.p[j, N, N] = row["fix_sigma"][begun] ** 2
            both = begun & moves
            j = i[both]
            self.x[j, VE : VN + 1] = turned()[both]
            self.p[j, VE, VE] = self.p[j, VN, VN] = 25.0
        dt = np.where(new, 0.0, row["t"] - self.t[i])
        self.t[i] = row["t"]
        self._advance(i[dt > 0], dt[dt > 0])
        raw = turned()
        var = c.sigma_v**2 + self.p[i, SCALE, SCALE] * (row["vx"] ** 2 + row["vy"] ** 2)
        z = np.concatenate([self.x[i, SCALE, None] * raw, row["yaw_rate"][:, None]], axis=1)
        vo = np.zeros(n, bool)
        vo[moves] = self._measure(i[moves], pick(VE, VN, TURN)[moves], z[moves], noise(var, var, c.sigma_yaw_rate**2)[moves], "vel")[0]
        on = moves & (dt > 0)
        self.moved[i[on]] += raw[on] * dt[on, None]  # also if the gate refused it
        high = ~np.isnan(row["alt"])
        self._measure(i[high], pick(UP)[high], row["alt"][high, None], noise(row["alt_sigma"] ** 2)[high], "alt")
        ve, vn = self.x[i, VE], self.x[i, VN]
        ahead = (np.abs(self.x[i, TURN]) <= c.straight) & (np.hypot(ve, vn) >= c.least_speed)
        self._measure(i[ahead], pick(YAW)[ahead], np.arctan2(ve, vn)[ahead, None], noise(c.sigma_heading**2)[ahead], "heading", True)
        again = fixed & ~begun
        fix, d2 = begun.copy(), np.where(begun, 0.0, np.nan)
        var = row["fix_sigma"] ** 2
        fix[again], d2[again] = self._measure(i[again], pick(E, N)[again], at[again], noise(var, var)[again], "pos")
        shift, size = at - self.fix[i], np.hypot(*self.moved[i].T)
        far = again & fix & (size >= c.least_displacement) & (np.hypot(*shift.T) >= c.least_displacement)
        h = np.zeros((n, 2, 9))
        h[:, :, SCALE] = self.moved[i]
        var = 2 * var + (0.05 * size) ** 2
        self._measure(i[far], h[far], shift[far], noise(var, var)[far], "scale")
        j = i[again & fix]
        self.fix[j], self.moved[j] = at[again & fix], 0.0
        x = self.x[i]
        return {
            "x_e": x[:, E], "y_n": x[:, N], "speed": np.hypot(x[:, VE], x[:, VN]), "yaw": x[:, YAW], "scale": x[:, SCALE],
            "sigma_pos": np.sqrt(self.p[i, E, E] + self.p[i, N, N]), "vo_ok": np.where(moves, vo, None), "fix_ok": np.where(fixed, fix, None), "fix_d2": d2,
        }


def filter_step(f: TrackFilter, row: dict) -> dict:
    """One row of the only track of f."""
    f.grow(1)
    out = f.step(np.zeros(1, np.int64), {c: np.array([row.get(c)], float) for c in MEASURED})
    return {k: None if v[0] is None or v[0] != v[0] else v[0] for k, v in out.items()}


def stepped(tracks: TrackFilter, frame: pd.DataFrame, own: np.ndarray) -> pd.DataFrame:
    """What the filter gives for the rows of a frame, in its order; own are the rows' tracks. The n-th rows of all tracks step together."""
    row = {c: frame[c].to_numpy(float, na_value=np.nan) if c in frame else np.full(len(frame), np.nan) for c in MEASURED}
    turn = pd.Series(own).groupby(own).cumcount().to_numpy()  # how many rows of its track came before in this batch
    by = np.argsort(turn, kind="stable")
    made: dict[str, list] = {}
    for at in np.split(by, np.flatnonzero(np.diff(turn[by])) + 1):
        for name, v in tracks.step(own[at], {c: x[at] for c, x in row.items()}).items():
            made.setdefault(name, []).append(v)
    return pd.DataFrame({name: np.concatenate(v) for name, v in made.items()}, index=frame.index[by]).sort_index()


def filter_tracks(df: DataFrame, keys: list[str], order: tuple[str, ...] = (), cfg: FilterConfig | None = None) -> DataFrame:
    """The track filter over each key in the order of t; see TrackFilter.step().

    Tracks are dealt by key and a partition's rows sorted by time, so that its tracks advance together: a
    task holds one batch of rows and a kilobyte of state for each of its tracks.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tracks, places = TrackFilter(cfg), {}
        for frame in frames:
            if not len(frame):
                continue
            names = zip(*[frame[k].astype(object).where(frame[k].notna(), None) for k in keys])
            own = np.array([places.setdefault(name, len(places)) for name in names])
            tracks.grow(len(places))
            yield pd.concat([frame, stepped(tracks, frame, own)], axis=1)

    return df.repartition(*keys).sortWithinPartitions("t", *order, *keys).mapInPandas(run, f"{kinds}, {FILTERED}")


def _smooth_step(s: dict, row: dict) -> dict:
    """Four states (lat, lon and rates) with Q = 1e-5, R = 1e-4; a keyframe resets, a row without fix only predicts."""
    f = np.eye(4)
    f[0, 2] = f[1, 3] = 1.0
    fix = not _missing(row["lat"])
    if "x" not in s or fix and row["keyframe"]:
        if not fix:
            return {"s_lat": None, "s_lon": None}
        s["x"], s["p"] = np.array([row["lat"], row["lon"], 0.0, 0.0]), np.eye(4)
        return {"s_lat": row["lat"], "s_lon": row["lon"]}
    x, p = f @ s["x"], f @ s["p"] @ f.T + 1e-5 * np.eye(4)
    if fix:
        h = np.eye(4)[:2]
        gain = p @ h.T @ np.linalg.inv(h @ p @ h.T + 1e-4 * np.eye(2))
        x, p = x + gain @ (np.array([row["lat"], row["lon"]]) - h @ x), (np.eye(4) - gain @ h) @ p
    s["x"], s["p"] = x, p
    return {"s_lat": x[0], "s_lon": x[1]}


def smooth_tracks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(lat, lon, keyframe) -> s_lat, s_lon by a constant-velocity filter."""
    return fold(df, keys, order, dict, _smooth_step, "s_lat double, s_lon double")


def ema_tracks(df: DataFrame, keys: list[str], order: list[str], alpha: float = 0.3, jump_m: float = 70.0) -> DataFrame:
    """Exponential smoothing of (lat, lon, keyframe): keyframes reset it, jumps from the last smoothed point are refused."""

    def step(s: dict, row: dict) -> dict:
        lat, lon, last = row["lat"], row["lon"], s.get("last")
        if _missing(lat) or _missing(lon):
            return {"s_lat": None, "s_lon": None, "accepted": False}
        if last is not None and not row["keyframe"]:
            dx = (lon - last[1]) * 111111.0 * math.cos(math.radians(last[0]))
            if math.hypot((lat - last[0]) * 111111.0, dx) > jump_m:
                return {"s_lat": None, "s_lon": None, "accepted": False}
            lat, lon = last[0] * (1 - alpha) + lat * alpha, last[1] * (1 - alpha) + lon * alpha
        s["last"] = (lat, lon)
        return {"s_lat": lat, "s_lon": lon, "accepted": True}

    return fold(df, keys, order, dict, step, "s_lat double, s_lon double, accepted boolean")


def gate_vs_last(df: DataFrame, keys: list[str], order: list[str], ratio: float = 1.5, jump_m: float = 500.0) -> DataFrame:
    """Rejects (x, y, scale) that change scale or jump too far against the last accepted row."""

    def step(s: dict, row: dict) -> dict:
        last = s.get("last")
        why = None
        if last is not None:
            if max(row["scale"] / last[2], last[2] / row["scale"]) > ratio:
                why = "scale_change"
            elif math.hypot(row["x"] - last[0], row["y"] - last[1]) > jump_m:
                why = "jump"
        if why is None:
            s["last"] = (row["x"], row["y"], row["scale"])
        return {"gate_reason": why}

    return fold(df, keys, order, dict, step, "gate_reason string")


#: Seconds between runs of the appearance and the structural channel in each mode.
PERIODS = {"BOOTSTRAP": (1.0, 2.0), "TRACK": (4.0, 8.0), "WEAK": (1.0, 2.0), "RELOCALIZE": (0.5, 1.0)}


def thin_step(period: Callable[[dict], float]):
    def step(s: dict, row: dict) -> dict:
        run = not row.get("obstructed") and (s.get("last") is None or row["t"] - s["last"] >= period(row) or period(row) <= 0)
        if run:
            s["last"] = row["t"]
        return {"runs": bool(run)}

    return step


def thin_schedule(df: DataFrame, keys: list[str], channel: int = 0, order: tuple[str, ...] = ()) -> DataFrame:
    """Runs of a channel (0 appearance, 1 structural) of rows (t, mode, obstructed): at least a period apart."""
    return fold(df, keys, ["t", *order], dict, thin_step(lambda row: PERIODS[row["mode"]][channel]), "runs boolean")


def sticky_window(df: DataFrame, keys: list[str], order: list[str], radius: int = 3, threshold: int = 1) -> DataFrame:
    """Centre of the map window of tiles (x, y): it moves only when a tile leaves radius - threshold about it."""

    def step(s: dict, row: dict) -> dict:
        at = s.get("at")
        moved = at is None or max(abs(row["x"] - at[0]), abs(row["y"] - at[1])) > radius - threshold
        if moved:
            at = s["at"] = (row["x"], row["y"])
        return {"center_x": at[0], "center_y": at[1], "recentred": moved}

    return fold(df, keys, order, dict, step, "center_x long, center_y long, recentred boolean")


def streak_states(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """TRACK, WEAK or RELOCALIZE from streaks of high and low confidence of rows (confidence, success); starts in RELOCALIZE."""

    def step(s: dict, row: dict) -> dict:
        state, high, low = s.get("s", ("RELOCALIZE", 0, 0))
        conf = row["confidence"]
        if not row["success"] or conf < 0.40:
            low, high = low + 1, 0
        else:
            low, high = max(0, low - 1), high + 1 if conf >= 0.62 else 0
        if state == "TRACK":
            state = "WEAK" if low >= 2 else state
        elif state == "WEAK":
            state = "RELOCALIZE" if low >= 4 and conf < 0.40 else "TRACK" if high >= 2 else state
        elif high >= 2:
            state = "WEAK"
        s["s"] = (state, high, low)
        return {"state": state, "high": high, "low": low}

    return fold(df, keys, order, dict, step, "state string, high int, low int")


def bootstrap_seed(fixes: DataFrame, keys: list[str], frames: int, radius_m: float) -> DataFrame:
    """Seed of each track from its first `frames` distinct frames of fixes (frame, x, y, in metres).

    The fix with most distinct frames within radius_m (the earliest of equal ones) leads; the seed is
    the mean of the last fix of each frame within its radius.
    """
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy("frame"))
    first = fixes.withColumn("_f", rank).filter(F.col("_f") <= frames).withColumn("_key", F.struct(*keys))
    near = _within(first, radius_m)
    lead = F.max_by(F.struct("x", "y", "n_frames"), F.struct("n_frames", -F.col("frame"), -F.col("x"), -F.col("y")))
    lead = near.groupBy("_key").agg(lead.alias("_lead"), F.max("_f").alias("_n")).filter(F.col("_n") >= frames)
    inside = first.join(lead, "_key").filter(F.hypot(F.col("x") - F.col("_lead.x"), F.col("y") - F.col("_lead.y")) <= radius_m)
    last = inside.groupBy("_key", "frame").agg(F.max_by(F.struct("x", "y"), F.struct("ord", "x", "y")).alias("p"))
    return last.groupBy("_key").agg(F.avg("p.x").alias("seed_x"), F.avg("p.y").alias("seed_y"), F.count("*").alias("n_frames")).select("_key.*", "seed_x", "seed_y", "n_frames")


def _within(points: DataFrame, r: float) -> DataFrame:
    around = F.array(*map(F.lit, (-1, 0, 1)))
    cell = points.withColumn("_cx", F.floor(F.col("x") / r)).withColumn("_cy", F.floor(F.col("y") / r))
    look = cell.withColumn("_i", F.explode(around)).withColumn("_j", F.explode(around))
    look = look.withColumn("_cx", F.col("_cx") + F.col("_i")).withColumn("_cy", F.col("_cy") + F.col("_j"))
    other = cell.select("_key", "_cx", "_cy", F.col("x").alias("_ox"), F.col("y").alias("_oy"), F.col("frame").alias("_of"))
    hit = look.join(other, ["_key", "_cx", "_cy"]).filter(F.hypot(F.col("x") - F.col("_ox"), F.col("y") - F.col("_oy")) <= r)
    return hit.groupBy("_key", "frame", "_f", "x", "y").agg(F.count_distinct("_of").alias("n_frames"))


def fuse_channels(fixes: DataFrame, motion: DataFrame, keys: list[str], cfg: FilterConfig | None = None) -> DataFrame:
    """Agreement gate, then the filter: motion rows (t, frame, vx, vy, yaw_rate) and fixes (frame, channel, x, y, sigma).

    Within a frame motion comes first, then the appearance fix, then the structural one.
    """
    ok = joins.consistency_gate(fixes, [*keys, "frame"])
    none = F.lit(None).cast("double")
    times = motion.select(*keys, "frame", "t")
    rows = motion.select(*keys, "frame", "t", F.lit(0).alias("ord"), "vx", "vy", "yaw_rate", none.alias("fix_x"), none.alias("fix_y"), none.alias("fix_sigma"), F.lit(None).cast("string").alias("reject_code"))
    placed = ok.join(times, [*keys, "frame"])
    take = lambda c: F.when(F.col("agreed"), F.col(c))
    rows = rows.unionByName(placed.select(
        *keys, "frame", "t", F.when(F.col("channel") == "appearance", 1).otherwise(2).alias("ord"), none.alias("vx"), none.alias("vy"), none.alias("yaw_rate"),
        take("x").alias("fix_x"), take("y").alias("fix_y"), take("sigma").alias("fix_sigma"), "reject_code",
    ))
    out = filter_tracks(rows, keys, ("ord",), cfg)
    code = F.coalesce("reject_code", F.when(~F.col("fix_ok"), "ekf_gate"))
    return out.withColumn("reject_code", code).withColumn("reject_value", F.when(~F.col("fix_ok"), F.col("fix_d2")))
