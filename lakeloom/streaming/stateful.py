"""Keyed state with timers: a response cache whose entries expire, and ratings that follow games in the order of their dates.

Both need the RocksDB state store (see use_rocksdb) and event time with a watermark.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lakeloom.operators.ratings import ELO_HOME, ELO_K, ELO_START, elo_step


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _millis(t: pd.Timestamp) -> int:
    return int(t.value // 1_000_000)


class _Cache(StatefulProcessor):
    """State of a request: its response and when it expires, in milliseconds. A timer drops it when the watermark has passed that."""

    def __init__(self, fetch: Callable[[str], str], ttl_ms: int, key: str, time: str):
        self.fetch, self.ttl, self.names = fetch, ttl_ms, [key, time, "response", "served"]
        self.time = time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "response string, expires long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.entry.get() if self.entry.exists() else None
        out = []
        for t in pd.concat(rows)[self.time].sort_values():
            now = _millis(t)
            served = held is not None and now < held[1]
            if not served:
                if held is not None:
                    self.handle.deleteTimer(held[1])
                held = (self.fetch(key[0]), now + self.ttl)
                self.handle.registerTimer(held[1])
            out.append((key[0], t, held[0], served))
        self.entry.update(held)
        yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists() and self.entry.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        return iter(())

    def close(self) -> None:
        pass


def cached_stream(requests: DataFrame, key: str, time: str, fetch: Callable[[str], str], ttl_seconds: float, late: str = "10 minutes") -> DataFrame:
    """(key, time, response, served) for each request: the response that is held for its key, or a fresh one where none is held or it has expired by the
    request's time. Entries expire ttl_seconds after they were fetched. A request that is late by a batch is served what is held then."""
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    rows = requests.select(key, time).withWatermark(time, late)
    return rows.groupBy(key).transformWithStateInPandas(_Cache(fetch, int(ttl_seconds * 1000), key, time), f"{key} {kinds[key]}, {time} {kinds[time]}, response string, served boolean", "Append", "EventTime")


_GAME = ["game_id", "home_team_id", "away_team_id", "home_score", "away_score", "is_neutral_site"]


class _Elo(StatefulProcessor):
    """State of a season: ratings by team, and games that wait by day until the watermark has passed it, so that late ones take their place."""

    def __init__(self, kinds: dict[str, str], start: float, k: float, edge: float):
        self.kinds, self.start, self.k, self.edge = kinds, start, k, edge

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ratings = handle.getMapState("ratings", f"team {self.kinds['home_team_id']}", "rating double")
        self.waiting = handle.getMapState("waiting", "day long", "games string")  # as JSON

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for t, day in pd.concat(rows).groupby("at"):
            at = _millis(t)
            held = json.loads(self.waiting.getValue((at,))[0]) if self.waiting.containsKey((at,)) else []
            plain = lambda x: None if pd.isna(x) else x.item() if hasattr(x, "item") else x
            held += [[*map(plain, g)] for g in day[_GAME].itertuples(index=False)]
            self.waiting.updateValue((at,), (json.dumps(held),))
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if not self.waiting.containsKey((at,)):
            return
        out = []
        rating = lambda t: self.ratings.getValue((t,))[0] if self.ratings.containsKey((t,)) else self.start
        for game, home, away, hs, as_, neutral in sorted(json.loads(self.waiting.getValue((at,))[0]), key=lambda g: g[0]):
            eh, ea = rating(home), rating(away)
            out.append((key[0], game, eh, ea))
            if hs is not None and as_ is not None:
                step = elo_step(eh, ea, hs - as_, bool(neutral), self.k, self.edge)
                self.ratings.updateValue((home,), (eh + step,))
                self.ratings.updateValue((away,), (ea - step,))
        self.waiting.removeKey((at,))
        yield pd.DataFrame(out, columns=["season", "game_id", "home_elo", "away_elo"])

    def close(self) -> None:
        pass


def elo_stream(games: DataFrame, late: str = "7 days", start: float = ELO_START, k: float = ELO_K, home_edge: float = ELO_HOME) -> DataFrame:
    """ratings.elo over a stream: (season, game_id, home_elo, away_elo) before each game, given out when no earlier game can come any more. games as there,
    with `at`, the game's day as a timestamp; a game may come `late` after games of later days. Timers of a season fire in the order of days."""
    kinds = {f.name: f.dataType.simpleString() for f in games.schema.fields}
    rows = games.select("season", "at", *_GAME).withWatermark("at", late)
    return rows.groupBy("season").transformWithStateInPandas(_Elo(kinds, start, k, home_edge), f"season {kinds['season']}, game_id {kinds['game_id']}, home_elo double, away_elo double", "Append", "EventTime")
