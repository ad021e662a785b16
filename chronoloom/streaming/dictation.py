"""Dictation as streams with state of their own: chunks of frames with replay after a hard cut, and merging of overlapping tokens.

Each operator is a fold with plain state (`Chunks`, `TokenMerge`), run by Structured Streaming with keyed value and list states, or over a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

RATE = 16_000
CHUNK = "no long, context_start long, core_start long, end long, reason string, replay_start long, replayed long"
TOKEN = "text string, start long, end long"
NEVER = -(2**62)


@dataclass
class Chunks:
    """Cores that neither share nor lose samples, each with some context before it.

    A core ends at a hard limit; or once it is long enough, has a voice in it, and silence follows; or at its release. After a hard cut the last frames
    are fed again (`replay_start` is the first one's place, `replayed` their samples); after a pause nothing is.
    """

    hard: int = 25 * RATE
    silence: int = 10_400
    least: int = 3 * RATE
    overlap: int = 2 * RATE
    shortest: int = 320
    longest: int = 640
    at: int = 0
    core: int = 0
    voice: int = 0
    no: int = 0
    tail: list[tuple[int, int]] = field(default_factory=list)

    def push(self, size: int, voiced: bool) -> list[tuple]:
        if not self.shortest <= size <= self.longest:
            raise ValueError("a frame is shorter or longer than frames may be")
        self.tail.append((self.at, size))
        self.at += size
        while self.tail and self.tail[0][0] < self.at - self.overlap:
            self.tail.pop(0)
        if voiced:
            self.voice = self.at
        if self.at - self.core >= self.hard:
            return [self._cut("hard_limit")]
        if self.at - self.core >= self.least and self.voice > self.core and self.at - self.voice >= self.silence:
            return [self._cut("semantic_endpoint")]
        return []

    def release(self) -> list[tuple]:
        return [self._cut("release")] if self.at > self.core else []

    def _cut(self, reason: str) -> tuple:
        again = self.tail if reason == "hard_limit" else []
        out = (self.no, max(0, self.core - self.overlap), self.core, self.at, reason, again[0][0] if again else None, sum(s for _, s in again))
        self.no, self.core, self.tail = self.no + 1, self.at, list(again)
        return out


@dataclass
class TokenMerge:
    """Tokens of chunks that overlap, each accepted once.

    A token goes if one of the same text, in any case, that shares time with it is accepted already; or if it ends no later than what was accepted before its
    chunk and shares time with any. Accepted tokens are kept until they ended `horizon` before the newest begins.
    """

    horizon: int = 60 * RATE
    kept: list[tuple[str, int, int]] = field(default_factory=list)
    reach: int = NEVER

    def push(self, tokens: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        out, reach = [], self.reach
        for text, start, end in tokens:
            shared = [t for t, a, b in self.kept if a < end and start < b]
            if any(t.casefold() == text.casefold() for t in shared) or (end <= reach and shared):
                continue
            self.kept.append((text, start, end))
            out.append((text, start, end))
            self.reach = max(self.reach, end)
        if tokens:
            last = max(start for _, start, _ in tokens)
            self.kept = [t for t in self.kept if t[2] > last - self.horizon]
        return out


def _chunk_rows(frames: pd.DataFrame, fold: Chunks, last: float | None, idle: float) -> tuple[list[tuple], Chunks, float | None]:
    """What frames give, in the order of time; a gap of over `idle` seconds releases what there is and begins anew. Also the fold and its last time."""
    out, fresh = [], {f.name: getattr(fold, f.name) for f in fields(fold) if f.name in ("hard", "silence", "least", "overlap", "shortest", "longest")}
    for row in frames.sort_values(["time", "frame"]).itertuples(index=False):
        now = row.time.timestamp()
        if last is not None and now - last > idle:
            out += fold.release()
            fold = Chunks(**fresh)
        out += fold.push(int(row.size_), bool(row.voiced))
        last = now
    return out, fold, last


class ChunkProcessor(StatefulProcessor):
    """Counters in a value state, the frames that may be fed again in a list state, and a timer that releases a session once it is idle."""

    def __init__(self, key: str, idle: float, settings: dict[str, int]) -> None:
        self.key, self.idle, self.settings = key, idle, settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", "at long, core long, voice long, no long, last double")
        self.tail = handle.getListState("tail", "start long, size long")

    def _load(self) -> tuple[Chunks, float | None]:
        fold = Chunks(**self.settings)
        if not self.counters.exists():
            return fold, None
        fold.at, fold.core, fold.voice, fold.no, last = self.counters.get()
        fold.tail = [tuple(x) for x in self.tail.get()] if self.tail.exists() else []
        return fold, last

    def _frame(self, name: object, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(name, *r) for r in rows], columns=[self.key, *(c.split()[0] for c in CHUNK.split(", "))]).astype({"replay_start": "Int64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fold, last = self._load()
        out, fold, last = _chunk_rows(pd.concat(list(rows)), fold, last, self.idle)
        self.counters.update((fold.at, fold.core, fold.voice, fold.no, last))
        if fold.tail:
            self.tail.put(fold.tail)
        else:
            self.tail.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((last + self.idle) * 1000))
        yield self._frame(key[0], out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fold, _ = self._load()
        self.counters.clear()
        self.tail.clear()
        yield self._frame(key[0], fold.release())

    def close(self) -> None:
        pass


class MergeProcessor(StatefulProcessor):
    """Accepted tokens that later ones may still share time with, in a list state."""

    def __init__(self, key: str, horizon: int) -> None:
        self.key, self.horizon = key, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reach = handle.getValueState("reach", "reach long")
        self.kept = handle.getListState("kept", TOKEN)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        merge = TokenMerge(self.horizon)
        if self.reach.exists():
            merge.reach = self.reach.get()[0]
            merge.kept = [tuple(x) for x in self.kept.get()] if self.kept.exists() else []
        out = _merged(pd.concat(list(rows)), merge)
        self.reach.update((merge.reach,))
        if merge.kept:
            self.kept.put(merge.kept)
        else:
            self.kept.clear()
        yield pd.DataFrame([(key[0], *t) for t in out], columns=[self.key, "text", "start", "end"])

    def close(self) -> None:
        pass


def _merged(tokens: pd.DataFrame, merge: TokenMerge) -> list[tuple[str, int, int]]:
    out = []
    for _, chunk in tokens.sort_values(["chunk", "start", "end", "text"]).groupby("chunk", sort=True):
        out += merge.push([(t.text, int(t.start), int(t.end)) for t in chunk.itertuples(index=False)])
    return out


def _stateful(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _frames(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, "time", "frame", F.col("size").alias("size_"), "voiced")


def chunk_stream(frames: DataFrame, key: str, *, idle: float = 30.0, lateness: str = "10 seconds", **settings: int) -> DataFrame:
    """Chunks (key, no, context_start, core_start, end, reason, replay_start, replayed) of a stream of frames (key, time, frame, size, voiced).

    Frames are taken by time and then `frame`; a micro-batch must not go back behind the one before. A session that is idle for `idle` seconds is
    released once the watermark has passed that, or when its next frame comes, and its numbers begin anew.
    """
    _stateful(frames)
    kind = frames.schema[key].dataType.simpleString()
    timed = _frames(frames, key).withWatermark("time", lateness)
    return timed.groupBy(key).transformWithStateInPandas(ChunkProcessor(key, idle, settings), f"{key} {kind}, {CHUNK}", "append", "EventTime")


def chunk_batch(frames: DataFrame, key: str, *, idle: float = 30.0, until: float | None = None, **settings: int) -> DataFrame:
    """The same chunks from a batch, a session's frames in one task as in the stream; `until`: sessions idle by then are released at the end, all without it."""
    kind = frames.schema[key].dataType.simpleString()

    def run(name: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, fold, last = _chunk_rows(pdf, Chunks(**settings), None, idle)
        if until is None or last + idle < until:
            out += fold.release()
        return pd.DataFrame([(*name, *r) for r in out], columns=[key, *(c.split()[0] for c in CHUNK.split(", "))]).astype({"replay_start": "Int64"})

    return _frames(frames, key).groupBy(key).applyInPandas(run, f"{key} {kind}, {CHUNK}")


def merge_stream(tokens: DataFrame, key: str, *, horizon: int = 60 * RATE) -> DataFrame:
    """Accepted tokens (key, text, start, end) of a stream of chunks' tokens (key, chunk, text, start, end), each as soon as it is accepted.

    Chunks of a key come in order, a chunk within one micro-batch; its tokens are taken by time and then text.
    """
    _stateful(tokens)
    kind = tokens.schema[key].dataType.simpleString()
    return tokens.select(key, "chunk", "text", "start", "end").groupBy(key).transformWithStateInPandas(MergeProcessor(key, horizon), f"{key} {kind}, {TOKEN}", "append", "None")


def merge_batch(tokens: DataFrame, key: str, *, horizon: int = 60 * RATE) -> DataFrame:
    """The same tokens from a batch."""
    kind = tokens.schema[key].dataType.simpleString()

    def run(name: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*name, *t) for t in _merged(pdf, TokenMerge(horizon))], columns=[key, "text", "start", "end"])

    return tokens.select(key, "chunk", "text", "start", "end").groupBy(key).applyInPandas(run, f"{key} {kind}, {TOKEN}")
