"""Keyed state that ends: cooldown of requests and segments of speech, with event-time timers.

Both need the session's state in RocksDB (``STATE_STORE``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import BLOCK_GAP, BLOCK_SECONDS, COOLDOWN_S

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def use_state_store(spark: SparkSession) -> None:
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)


def _micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


def _one_timer(handle: StatefulProcessorHandle, at: int | None) -> None:
    """Leaves one timer, at the given milliseconds, or none."""
    for old in list(handle.listTimers()):
        if old != at:
            handle.deleteTimer(old)
    if at is not None:
        handle.registerTimer(at)


class Cooldown(StatefulProcessor):
    """Keeps the time of a key's last request until the watermark is so far beyond it that no request can be too early."""

    def __init__(self, seconds: int) -> None:
        self.span = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values(["ts", "request_id"], kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for now in _micros(found["ts"]):
            out.append(last is not None and now - last < self.span)
            last = now if last is None else max(last, now)
        self.last.update((last,))
        _one_timer(self.handle, (last + self.span) // 1000 + 1)
        yield pd.DataFrame({"key": key[0], "request_id": found["request_id"].to_numpy(), "suppressed": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"key": [], "request_id": [], "suppressed": []}).astype({"key": str, "request_id": "int64", "suppressed": bool})

    def close(self) -> None:
        pass


def cooldown(requests: DataFrame, seconds: int = COOLDOWN_S, late: str = "10 minutes") -> DataFrame:
    """(key, request_id, suppressed) of a stream (key, request_id, ts): requests less than ``seconds`` after the key's one before.

    Requests later than ``late`` are dropped. A key's state is removed once no accepted request can fall into its time.
    """
    use_state_store(requests.sparkSession)
    keyed = requests.withWatermark("ts", late).groupBy("key")
    return keyed.transformWithStateInPandas(Cooldown(seconds), "key string, request_id long, suppressed boolean", "append", "EventTime")


SEGMENT = "document_id long, turn long, part int, speaker string, start double, end double, n_units long, confidence double, text string"
_UNIT = "at long, speaker string, start double, end double, word string, score double"
_OPEN = "turn long, part int, speaker string, base double, start double, last double, end double, n long, score double, words string, at long"


class Segments(StatefulProcessor):
    """Puts a document's units in order behind the watermark and folds them into its open segment.

    A segment ends with another speaker, a pause, or when it is full; a pause is also certain once the watermark has
    passed it, so the last segment needs no unit after it. Then only the number of the turn is kept.
    """

    def __init__(self, gap: float, seconds: float) -> None:
        self.gap, self.seconds = gap, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.units, self.open, self.turn = handle.getListState("units", _UNIT), handle.getValueState("open", _OPEN), handle.getValueState("turn", "turn long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))
        columns = ("speaker", "start", "end", "word", "score")
        plain = found[list(columns)].astype(object).where(found[list(columns)].notna(), None)
        self.units.appendList([(at, *unit) for at, unit in zip(_micros(found["ts"]), plain.itertuples(index=False, name=None), strict=True)])
        yield self.settled(key[0], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.settled(key[0], timerValues.getCurrentWatermarkInMs())

    def settled(self, document: int, watermark: int) -> pd.DataFrame:
        """Segments that ended, after all units behind the watermark were folded in."""
        held = list(self.units.get())
        ready = sorted((u for u in held if u[0] // 1000 < watermark), key=lambda u: (u[2], u[3]))
        waiting = [u for u in held if u[0] // 1000 >= watermark]
        turn = self.turn.get()[0] if self.turn.exists() else 0
        now = list(self.open.get()) if self.open.exists() else None
        out = []
        for at, speaker, start, end, word, score in ready:
            if now is None or speaker != now[2] or start - now[5] > self.gap:
                out += [now] if now else []
                turn += 1
                now = [turn, 0, speaker, start, start, end, end, 0, 0.0, "", at]
            elif end - now[3] > self.seconds:
                out.append(now)
                now = [turn, now[1] + 1, speaker, start, start, end, end, 0, 0.0, "", at]
            words = word if not now[7] else f"{now[9]} {word}"
            now = [*now[:5], end, max(now[6], end), now[7] + 1, now[8] + score, words, at + round((end - start) * 1e6)]
        paused = None if now is None else int(now[10] + self.gap * 1e6) // 1000 + 1
        if paused is not None and watermark > paused and not waiting:
            out.append(now)
            now = paused = None
        self.turn.update((turn,))
        if now is None:
            self.open.clear()
        else:
            self.open.update(tuple(now))
        if waiting:
            self.units.put(waiting)
        else:
            self.units.clear()
        next_at = [u[0] // 1000 + 1 for u in waiting] + ([paused] if paused else [])
        _one_timer(self.handle, max(min(next_at), watermark + 1) if next_at else None)
        rows = [(document, s[0], s[1], s[2], s[4], s[6], s[7], s[8] / s[7], s[9]) for s in out]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SEGMENT.split(", ")])

    def close(self) -> None:
        pass


def segments(units: DataFrame, gap: float = BLOCK_GAP, seconds: float = BLOCK_SECONDS, late: str = "10 seconds") -> DataFrame:
    """The segments of ``transcripts.segments`` from a stream (document_id, ts, start, end, speaker, word, score).

    ``ts`` is when a unit starts; units may come in any order within ``late``, later ones are dropped.
    """
    use_state_store(units.sparkSession)
    keyed = units.withWatermark("ts", late).groupBy("document_id")
    ended = keyed.transformWithStateInPandas(Segments(gap, seconds), SEGMENT, "append", "EventTime")
    return ended.withColumn("confidence", F.round("confidence", 4))
