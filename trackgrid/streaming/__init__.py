"""Keyed operators and enrichment on streams; each works on a batch table too."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import joins
from ..operators import state as fold


def _stateful(df: DataFrame, key: str, order: tuple[str, ...], fields: str, state: str, start, step, pack, unpack) -> DataFrame:
    """Run step(state, row) over the rows of each key in the order of (t, order), with the state kept between batches.

    Rows before the last time seen are dropped and counted in `late`, which each row carries; rows at that
    time are not late.
    """
    own = [f.strip().split()[0] for f in fields.split(",")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(_: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames)).sort_values(["t", *order], kind="stable")  # a micro-batch of one key
        s, last, late = (start(), None, 0) if not held.exists else (unpack(held.get[2:]), *held.get[:2])
        rows, out = [], []
        for row in frame.to_dict("records"):
            if last is not None and row["t"] < last:
                late += 1
                continue
            last = row["t"]
            rows.append(row)
            out.append(step(s, row) | {"late": late})
        held.update((last, late, *pack(s)))
        if rows:
            yield pd.concat([pd.DataFrame(rows)[list(frame.columns)], pd.DataFrame(out)[[*own, "late"]]], axis=1)

    return df.groupBy(key).applyInPandasWithState(run, f"{kinds}, {fields}, late long", f"last double, late long, {state}", "append", GroupStateTimeout.NoTimeout)


def hysteresis_stream(df: DataFrame, key: str, flag: str, entry: int, exit: int, order: tuple[str, ...] = ()) -> DataFrame:
    """windows.hysteresis() on a stream of (key, t, flag)."""

    def step(s: list, row: dict) -> dict:
        s[0], s[1] = (s[0] + 1, 0) if row[flag] else (0, s[1] + 1)
        s[2] = s[0] >= entry if row[flag] and not s[2] else s[2] and (row[flag] or s[1] < exit)
        return {"is_on": bool(s[2])}

    return _stateful(df, key, order, "is_on boolean", "up long, down long, is_on boolean", lambda: [0, 0, False], step, tuple, list)


def schedule_stream(df: DataFrame, key: str, channel: int = 0, order: tuple[str, ...] = ()) -> DataFrame:
    """state.thin_schedule() on a stream of (key, t, mode, obstructed), or of (key, t, sigma, accepted, obstructed) with the
    mode that windows.track_mode() gives, which then is a column of the result."""
    given = "mode" in df.columns

    def mode(s: dict, row: dict) -> str:
        gap = row["t"] - s["fix"] if s.get("fix") is not None else 1e9
        if row["accepted"]:
            s["fix"] = row["t"]
        return "TRACK" if row["sigma"] < 60 and gap < 5 else "WEAK" if row["sigma"] < 200 and gap < 30 else "RELOCALIZE"

    thin = fold.thin_step(lambda row: fold.PERIODS[row["mode"]][channel])

    def step(s: dict, row: dict) -> dict:
        if given:
            return thin(s, row)
        now = mode(s, row)
        return {"mode": now} | thin(s, row | {"mode": now})

    return _stateful(
        df, key, order, "runs boolean" if given else "mode string, runs boolean", "fix double, run double", dict, step, lambda s: (s.get("fix"), s.get("last")),
        lambda v: {k: x for k, x in zip(("fix", "last"), v) if x is not None},
    )


def trailing_stream(df: DataFrame, key: str, seconds: float, order: tuple[str, ...] = ()) -> DataFrame:
    """Count and mean of `value` over the last `seconds` of each row, on a stream of (key, t, value).

    The state of a key holds the rows of the last `seconds` only. A row counts itself and those before it.
    """

    def step(s: list, row: dict) -> dict:
        s[0].append(row["t"])
        s[1].append(row["value"])
        first = next(i for i, t in enumerate(s[0]) if t >= row["t"] - seconds)
        del s[0][:first], s[1][:first]
        return {"n": len(s[1]), "mean": sum(s[1]) / len(s[1])}

    return _stateful(
        df, key, order, "n long, mean double", "ts array<double>, xs array<double>", lambda: [[], []], step, tuple, lambda v: [list(v[0]), list(v[1])]
    )


def filter_tracks_stream(df: DataFrame, key: str, cfg: fold.FilterConfig | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """state.filter_tracks() on a stream; rows older than the last processed one are dropped and counted."""
    return _stateful(df, key, order, fold.FILTERED, fold.HELD, lambda: fold.TrackFilter(cfg), fold.filter_step, fold.TrackFilter.held, lambda v: fold.TrackFilter(cfg, v))


class _Ordered(StatefulProcessor):
    """The rows of a group of tracks wait in buckets of time until the watermark has passed them; a timer then lets the due
    ones go on in the order of (t, order). The group's tracks step together; their states are one row of arrays."""

    def __init__(self, kinds: dict[str, str], key: str, order: tuple[str, ...], seconds: float, cfg: fold.FilterConfig | None):
        self.kinds, self.key, self.order, self.seconds, self.cfg = kinds, key, order, seconds, cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long", ", ".join(f"`{c}` array<{k}>" for c, k in self.kinds.items()))
        self.tracks = handle.getValueState("tracks", f"names array<{self.kinds[self.key]}>, {fold.HELD_ALL}")
        self.timer = handle.getValueState("timer", "ms long")

    def _wait(self, frame: pd.DataFrame) -> None:
        """Put rows in their buckets, and the timer to the first one's time."""
        known = {k[0] for k in self.waiting.keys()}
        for bucket, part in frame.groupby(np.floor(frame["t"] / self.seconds).astype(int)):
            key, new = (int(bucket),), [_plain(part[c]) for c in self.kinds]
            if key[0] in known:
                new = [[*old, *more] for old, more in zip(self.waiting.getValue(key), new)]
            self.waiting.updateValue(key, tuple(new))
        first = int(np.ceil(frame["t"].min() * 1000))
        held = self.timer.get() if self.timer.exists() else None
        if held is None or first < held[0]:
            if held is not None:
                self.handle.deleteTimer(held[0])
            self.handle.registerTimer(first)
            self.timer.update((first,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._wait(pd.concat(list(rows)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        open_ = [(k[0], v) for k, v in self.waiting.iterator() if k[0] * self.seconds * 1000 <= now]
        for bucket, _ in open_:
            self.waiting.removeKey((bucket,))
        held = self.tracks.get() if self.tracks.exists() else None
        places = {name: i for i, name in enumerate(held[0])} if held else {}
        frame = pd.DataFrame({c: [x for _, v in open_ for x in v[i]] for i, c in enumerate(self.kinds)})
        at = list(self.kinds).index(self.key)
        due = (frame["t"] * 1000 <= now).to_numpy()
        names = [x for _, v in open_ for x in v[at]]
        frame["_own"] = [places.setdefault(name, len(places)) if on else -1 for name, on in zip(names, due)]
        if not due.all():
            self._wait(frame[~due])
        elif starts := [k[0] for k in self.waiting.keys()]:  # the next bucket's first row
            self._again(min(starts))
        rows = frame[due].sort_values(["t", *self.order], kind="stable").reset_index(drop=True)
        tracks = fold.TrackFilter.of_all(self.cfg, held[1:]) if held else fold.TrackFilter(self.cfg)
        tracks.grow(len(places))
        made = fold.stepped(tracks, rows, rows["_own"].to_numpy())
        self.tracks.update((list(places), *tracks.held_all()))
        yield pd.concat([rows.drop(columns="_own"), made], axis=1)

    def _again(self, bucket: int) -> None:
        first = int(np.ceil(min(self.waiting.getValue((bucket,))[list(self.kinds).index("t")]) * 1000))
        self.handle.registerTimer(first)
        self.timer.update((first,))


def _plain(column: pd.Series) -> list:
    """Python values, null where one is missing."""
    return [None if x is None or x != x else x for x in column.astype(object)]


def filter_tracks_ordered(df: DataFrame, key: str, late: float, order: tuple[str, ...] = (), cfg: fold.FilterConfig | None = None, groups: int = 128) -> DataFrame:
    """state.filter_tracks() on a stream whose rows come up to `late` seconds of event time after later ones.

    Rows of a track wait until the watermark, `late` seconds behind the latest t of all tracks, has passed
    them, and are then filtered in the order of (t, order): the rows are those of the batch filter, however
    they came; t is in seconds and positive. Rows behind the watermark are dropped by Spark and counted, see late_rows(). Rows within
    `late` seconds of the end wait for more. Tracks are dealt in `groups` by hash: one call takes the due rows of a group
    and steps its tracks together. Needs a RocksDB state store, see typed_state().
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    timed = df.withColumn("_time", F.timestamp_seconds("t")).withWatermark("_time", f"{round(late * 1000)} milliseconds")
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + f", {fold.FILTERED}"
    grouped = timed.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")).groupBy("_group")
    return grouped.transformWithStateInPandas(_Ordered(kinds, key, order, max(late, 1.0), cfg), schema, "append", "EventTime")


@contextmanager
def typed_state(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, as map states and timers need it."""
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def late_rows(query: StreamingQuery) -> int:
    """Rows that a stream has dropped as they came behind the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def enrich_stream(df: DataFrame, segments: DataFrame, t: str = "t", most: int = joins.FEW) -> DataFrame:
    """Segment labels (segment_id, start, end) for stream rows: a stream-static join.

    Up to `most` segments are broadcast; more are cut into cells of their mean length, which rows meet by an
    equi-join.
    """
    seg = segments.select("segment_id", "start", "end")
    inside = (F.col(t) >= F.col("start")) & (F.col(t) < F.col("end"))
    if joins.is_few(seg, most):
        return df.join(F.broadcast(seg), inside, "left").drop("start", "end")
    width = seg.agg(F.avg(F.col("end") - F.col("start"))).first()[0] or 1.0
    cut = seg.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    return df.join(cut, (F.floor(F.col(t) / width) == F.col("_cell")) & inside, "left").drop("start", "end", "_cell")


def agl_stream(df: DataFrame, dem: DataFrame, cell_deg: float) -> DataFrame:
    """Height over the grid cell (row, col, elev) that a stream row (lat, lon, alt) lies in: a stream-static join.

    Rows and columns count from the north-west corner of the globe. Bilinear heights need several cells
    of a row and so an aggregation; on a stream the nearest cell keeps the join stateless.
    """
    row, col = F.floor((90 - F.col("lat")) / cell_deg), F.floor((F.col("lon") + 180) / cell_deg)
    at = df.withColumn("row", row).withColumn("col", col)
    return at.join(dem.select("row", "col", "elev"), ["row", "col"], "left").withColumn("agl_m", F.col("alt") - F.col("elev")).drop("row", "col")


def kpi_stream(df: DataFrame, key: str) -> DataFrame:
    """Rows, accepted fixes and accept rate of each run, for update mode."""
    accepted = F.sum(F.when(F.col("accepted"), 1).otherwise(0))
    return df.groupBy(key).agg(F.count("*").alias("frames"), accepted.alias("accepts"), (accepted / F.count("*")).alias("accept_rate"))


def history_stream(df: DataFrame, key: str, event_time: str, seconds: int, step: int, late: str = "1 minute") -> DataFrame:
    """Count and mean of `value` over the last seconds, every `step` seconds; late rows up to a watermark count."""
    w = F.window(event_time, f"{seconds} seconds", f"{step} seconds")
    return df.withWatermark(event_time, late).groupBy(key, w.alias("w")).agg(F.count("value").alias("n"), F.avg("value").alias("mean"))


def write_state_stream(df: DataFrame, path: str, checkpoint: str):
    """Append a stream to Parquet, all that is there now; a later call goes on from the checkpoint."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
