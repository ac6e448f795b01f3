"""Live streams on Structured Streaming: stateful features and triggers, control commands, results per batch.

State is kept per stream by transformWithStateInPandas. The reference semantics have no event time: rows of a stream are
taken in the order of `t` within a batch and batches in order of arrival. with_event_time() adds watermarks as Spark
knows them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


class Delta(StatefulProcessor):
    """Delta regression with a delay of `reach` frames; a row with end = true flushes the stream."""

    def __init__(self, reach: int = 2):
        self.reach = reach

    def init(self, handle) -> None:
        self.buffer = handle.getValueState("buffer", "json string")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        import json

        state = json.loads(self.buffer.get()[0]) if self.buffer.exists() else {"frames": [], "next": 0}
        frames, at = state["frames"], state["next"]  # frames: (t, vec) from next - reach on
        out, ended = [], False
        for pdf in rows:
            for r in pdf.sort_values("t").itertuples():
                ended |= bool(r.end)
                if r.vec is not None and len(r.vec):
                    frames.append([int(r.t), list(map(float, r.vec))])
        first = state.get("first", 0)
        k, norm = self.reach, 2 * sum(i * i for i in range(1, self.reach + 1))
        last = first + len(frames) - 1
        ready = last if ended else last - k
        while at <= ready:
            get = lambda i: np.array(frames[min(max(i, 0), last) - first][1])
            d = sum(i * (get(at + i) - get(at - i)) for i in range(1, k + 1)) / norm
            out.append((key[0], frames[at - first][0], d.tolist()))
            at += 1
        drop = max(0, at - k - first)
        frames, first = frames[drop:], first + drop
        if ended:
            self.buffer.clear()
        else:
            self.buffer.update((json.dumps({"frames": frames, "next": at, "first": first}),))
        yield pd.DataFrame(out, columns=["stream", "t", "delta"])

    def close(self) -> None:
        pass


class MapMean(StatefulProcessor):
    """Running mean with a prior: (sum + weight prior) / (n + weight); the sum of a segment becomes the next prior when
    end is true. The state keeps segments back to `frames` frames."""

    def __init__(self, weight: float = 100.0, frames: int = 500):
        self.weight, self.frames = weight, frames

    def init(self, handle) -> None:
        self.state = handle.getValueState("sums", "json string")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        import json

        s = json.loads(self.state.get()[0]) if self.state.exists() else {"n": 0, "sum": 0.0, "prior": None, "old": []}
        out = []
        for pdf in rows:
            for r in pdf.sort_values("t").itertuples():
                s["n"], s["sum"] = s["n"] + 1, s["sum"] + float(r.x)
                m = s["sum"] / s["n"] if s["prior"] is None else (s["sum"] + self.weight * s["prior"]) / (s["n"] + self.weight)
                out.append((key[0], int(r.t), float(r.x) - m))
                if r.end:
                    s["old"] = [[s["n"], s["sum"]], *s["old"]]
                    held = 0
                    for i, (n, _) in enumerate(s["old"]):
                        held += n
                        if held >= self.frames:
                            s["old"] = s["old"][: i + 1]
                            break
                    s["prior"] = sum(x for _, x in s["old"]) / sum(n for n, _ in s["old"])
                    s["n"], s["sum"] = 0, 0.0
        self.state.update((json.dumps(s),))
        yield pd.DataFrame(out, columns=["stream", "t", "x"])

    def close(self) -> None:
        pass


class EnergyNorm(StatefulProcessor):
    """Clamps and scales a stream's energy with the maximum of the segment before; the first segment's maximum so far
    stands in until there is one."""

    def __init__(self, floor: float, escale: float = 1.0):
        self.floor, self.escale = floor, escale

    def init(self, handle) -> None:
        self.tops = handle.getValueState("tops", "before double, now double")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        before, now = self.tops.get() if self.tops.exists() else (None, None)
        out = []
        for pdf in rows:
            for r in pdf.sort_values("t").itertuples():
                e = float(r.x)
                now = e if now is None else max(now, e)
                top = now if before is None else before
                out.append((key[0], int(r.t), 1 - (top - min(max(e, top - self.floor), top)) * self.escale))
                if r.end:
                    before, now = now, None
        self.tops.update((before, now))
        yield pd.DataFrame(out, columns=["stream", "t", "x"])

    def close(self) -> None:
        pass


class Endpointer(StatefulProcessor):
    """Segments of chunks (stream, chunk, active, end): closes after more than `tail` idle chunks or at the end, cuts at
    `most` chunks. Emits (stream, first_chunk, last_chunk, active)."""

    def __init__(self, tail: int, most: int = 1_000_000):
        self.tail, self.most = tail, most

    def init(self, handle) -> None:
        self.open = handle.getValueState("open", "first long, last long, active long")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        first, last, active = self.open.get() if self.open.exists() else (-1, -1, 0)
        out = []
        for pdf in rows:
            for r in pdf.sort_values("chunk").itertuples():
                c = int(r.chunk)
                if first >= 0 and (c - last > self.tail + (1 if r.active else 0) or c - first >= self.most):
                    out.append((key[0], first, min(last + self.tail, c - 1), active))
                    first, active = -1, 0
                if r.active:
                    first, last, active = (c if first < 0 else first), c, active + 1
                if r.end and first >= 0:
                    out.append((key[0], first, min(last + self.tail, c), active))
                    first, active = -1, 0
        if first >= 0:
            self.open.update((first, last, active))
        else:
            self.open.clear()
        yield pd.DataFrame(out, columns=["stream", "first_chunk", "last_chunk", "active"])

    def close(self) -> None:
        pass


def stateful(df: DataFrame, processor: StatefulProcessor, schema: str, mode: str = "append") -> DataFrame:
    """A processor over (stream, …); needs the RocksDB state store."""
    return df.groupBy("stream").transformWithStateInPandas(processor, schema, mode, "none")


def with_event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Rows with a watermark; a time without zone is cast first, which watermarks need."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def sliding(df: DataFrame, column: str, size: str, step: str | None = None) -> DataFrame:
    """Counts and mean of `value` per stream and window, tumbling without a step."""
    w = F.window(column, size, step) if step else F.window(column, size)
    return df.groupBy("stream", w.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("stream", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean")


def sessions(df: DataFrame, column: str, gap: str) -> DataFrame:
    return df.groupBy("stream", F.session_window(column, gap).alias("w")).agg(F.count("*").alias("n")).select("stream", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


# --- control ------------------------------------------------------------------------------------------------------
#: The events that this engine raises, and what a callback is given: the number of a batch, or the name of what changed.
EVENTS = {
    "batch_begin": "number", "batch_end": "number", "batch_skipped": "number", "paused": None, "resumed": None, "terminated": None, "ended": None,
    "grammars_changed": "version", "process_added": "name", "process_removed": "name", "process_activated": "name", "process_deactivated": "name", "process_selected": "name",
}


class Control:
    """The state that commands change: running, paused or ended; processes and grammars, which change at batch
    boundaries only."""

    def __init__(self, grammars=None):
        from cadenza.operators.grammar import GrammarSet

        self.state, self.grammars = "running", grammars or GrammarSet()
        self.processes: dict[str, bool] = {}
        self.current: str | None = None
        self.on_change = "terminate"
        self.callbacks: dict[str, list[Callable]] = {}
        self.wait: list[tuple] = []

    def bind(self, event: str, function: Callable) -> None:
        if event not in EVENTS:
            raise ValueError(event)
        self.callbacks.setdefault(event, []).append(function)

    def fire(self, event: str, *args) -> None:
        for f in self.callbacks.get(event, []):
            f(*args)

    def command(self, name: str, target: str | None = None, payload=None):
        """Takes a command; what it changes waits for apply(), questions are answered at once."""
        name = name.upper()
        if name == "STATUS":
            return self.state
        if name == "VERSION":
            return self.grammars.version
        if name == "GRAMINFO":
            return {g: (x["name"], x["active"]) for g, x in self.grammars.live.items()}
        if name == "LISTPROCESS":
            return dict(self.processes)
        if name in ("DIE", "PAUSE", "TERMINATE", "RESUME", "INPUTONCHANGE", "CHANGEGRAM", "ADDGRAM", "DELGRAM", "ACTIVATEGRAM", "DEACTIVATEGRAM", "SYNCGRAM", "CURRENTPROCESS", "SHIFTPROCESS", "ADDPROCESS", "DELPROCESS", "ACTIVATEPROCESS", "DEACTIVATEPROCESS", "ADDWORD"):
            self.wait.append((name, target, payload))
            return None
        raise ValueError(f"unknown command {name}")

    def apply(self) -> None:
        """At a batch boundary: everything that waits, in order."""
        for name, target, payload in self.wait:
            if name in ("PAUSE", "TERMINATE", "RESUME", "DIE"):
                self.state = {"PAUSE": "paused", "TERMINATE": "paused", "RESUME": "running", "DIE": "ended"}[name]
                self.fire({"PAUSE": "paused", "TERMINATE": "terminated", "RESUME": "resumed", "DIE": "ended"}[name])
            elif name == "INPUTONCHANGE":
                self.on_change = target
            elif name in ("ADDGRAM", "CHANGEGRAM"):
                if name == "CHANGEGRAM":
                    for g in list(self.grammars.live):
                        self.grammars.request("delete", g)
                self.grammars.add(target, *payload)
            elif name in ("DELGRAM", "ACTIVATEGRAM", "DEACTIVATEGRAM"):
                self.grammars.request({"D": "delete", "A": "activate"}.get(name[0], "") if name != "DEACTIVATEGRAM" else "deactivate", int(target))
            elif name == "ADDWORD":
                self.grammars.add_words(int(target), payload)
            elif name == "CURRENTPROCESS":
                self.current = target
                self.fire("process_selected", target)
            elif name == "SHIFTPROCESS" and self.processes:
                names = sorted(self.processes)
                self.current = names[(names.index(self.current) + 1) % len(names)] if self.current in names else names[0]
                self.fire("process_selected", self.current)
            elif name == "ADDPROCESS":
                self.processes[target] = True
                self.fire("process_added", target)
            elif name == "DELPROCESS":
                if self.processes.pop(target, None) is not None:
                    self.fire("process_removed", target)
            elif name in ("ACTIVATEPROCESS", "DEACTIVATEPROCESS") and target in self.processes:
                self.processes[target] = name == "ACTIVATEPROCESS"
                self.fire("process_activated" if self.processes[target] else "process_deactivated", target)
        self.wait.clear()
        if self.grammars.update():
            self.fire("grammars_changed", self.grammars.version)


def run_batches(df: DataFrame, control: Control, consume: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Starts a query that applies control at each batch boundary and hands running batches to consume."""

    def each(batch: DataFrame, number: int) -> None:
        control.apply()
        if control.state == "running":
            control.fire("batch_begin", number)
            consume(batch, number)
            control.fire("batch_end", number)
        else:
            control.fire("batch_skipped", number)

    writer = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class Plugins:
    """Functions by slot: audio and feature sources, post-processing, mixture calculation, results."""

    SLOTS = ("audio_source", "audio_post", "feature_source", "feature_post", "mixture", "result", "startup", "language")

    def __init__(self):
        self.bound: dict[str, list[Callable]] = {s: [] for s in self.SLOTS}

    def register(self, slot: str, function: Callable) -> None:
        self.bound[slot].append(function)

    def through(self, slot: str, df: DataFrame) -> DataFrame:
        """The table passed through every function of a slot."""
        for f in self.bound[slot]:
            df = f(df)
        return df
