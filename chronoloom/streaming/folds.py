"""Ordered folds over one session's frames, used by batch and streaming alike.

A fold is a class with `push(row) -> list of results` and `flush() -> list of results`; its state is what `state()` gives and
`restore` takes, plain values that Spark can keep between micro-batches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

SAMPLE_RATE = 16_000


@dataclass
class SpeechSessions:
    """Regions of frames at or above a threshold: a silence of at least `silence` closes one, short ones go, padded
    neighbours that touch are one with the larger score. Frames must not go back in time."""

    threshold: float = 0.5
    silence: int = 4_800
    least: int = 4_000
    pad: int = 1_600
    start: int = -1
    last: int = 0
    score: float = 0.0
    ready: tuple[int, int, float] | None = None
    clock: int = 0

    def state(self) -> tuple:
        ready = self.ready or (-1, -1, 0.0)
        return (self.start, self.last, self.score, *ready, self.clock)

    def restore(self, state: tuple) -> SpeechSessions:
        self.start, self.last, self.score, a, b, s, self.clock = state
        self.ready = None if a < 0 else (a, b, s)
        return self

    def _close(self) -> list[tuple[int, int, float]]:
        out = []
        if self.start >= 0 and self.last - self.start >= self.least:
            region = (max(0, self.start - self.pad), self.last + self.pad, self.score)
            if self.ready and region[0] <= self.ready[1]:
                self.ready = (self.ready[0], max(self.ready[1], region[1]), max(self.ready[2], region[2]))
            else:
                out += [self.ready] if self.ready else []
                self.ready = region
        self.start = -1
        return out

    def push(self, start: int, end: int, score: float) -> list[tuple[int, int, float]]:
        if start < self.clock:
            raise ValueError("a frame goes back in time")
        self.clock = start
        if score < self.threshold or end <= start:
            return []
        out = []
        if self.start >= 0 and start - self.last >= self.silence:
            out = self._close()
        if self.start < 0:
            self.start, self.score, self.last = start, score, end
        self.last, self.score = max(self.last, end), max(self.score, score)
        return out

    def flush(self) -> list[tuple[int, int, float]]:
        out = self._close()
        out += [self.ready] if self.ready else []
        self.ready = None
        return out


@dataclass
class Router:
    """The label in force: another one takes over after `needed` confident observations of it in a row."""

    needed: int = 2
    sure: float = 0.6
    current: str = ""
    pending: str = ""
    count: int = 0

    def push(self, label: str | None, confidence: float | None) -> str:
        """An unknown label or confidence is no evidence and keeps what is pending."""
        if label is None or confidence is None:
            return self.current
        if confidence < self.sure or label == self.current:
            self.pending, self.count = "", 0
        elif not self.current:
            self.current = label
        else:
            self.count = self.count + 1 if label == self.pending else 1
            self.pending = label
            if self.count >= self.needed:
                self.current, self.pending, self.count = label, "", 0
        return self.current


@dataclass
class Chunker:
    """Contiguous chunks of a stream: closed at a hard limit, or at a pause once they are long enough."""

    limit: int = 25 * SAMPLE_RATE
    least: int = 3 * SAMPLE_RATE
    pause: int = 10_400
    start: int | None = None
    end: int = 0
    quiet: int = 0

    def push(self, start: int, size: int, voiced: bool) -> list[tuple[int, int, str]]:
        if self.start is None:
            self.start = self.end = start
        if start != self.end:
            raise ValueError("a frame doesn't start where the one before it ended")
        self.end, out = start + size, []
        self.quiet = 0 if voiced else self.quiet + size
        if self.end - self.start >= self.limit:
            out = [(self.start, self.end, "limit")]
        elif self.end - self.start >= self.least and self.quiet >= self.pause:
            out = [(self.start, self.end, "pause")]
        if out:
            self.start, self.quiet = self.end, 0
        return out

    def flush(self) -> list[tuple[int, int, str]]:
        out = [(self.start, self.end, "release")] if self.start is not None and self.end > self.start else []
        self.start = None
        return out


@dataclass
class StablePrefix:
    """Tokens of a growing hypothesis: those stable and older than `hold` are committed in order, up to the first unstable one."""

    hold: int = 45 * SAMPLE_RATE
    near: int = SAMPLE_RATE // 2
    committed: list[tuple[str, int, int]] = field(default_factory=list)
    pending: list[tuple[str, int, int, bool]] = field(default_factory=list)

    def push(self, tokens: list[tuple[str, int, int, bool]], now: int) -> list[tuple[str, int, int]]:
        """Replace the pending tokens by the hypothesis's that aren't committed yet (same text, start within `near`)."""
        done = self.committed[-1][2] if self.committed else -1
        seen = {(t.casefold(), s) for t, s, _ in self.committed[-64:]}
        fresh = [t for t in tokens if t[2] > done and not any(t[0].casefold() == c and abs(t[1] - s) <= self.near for c, s in seen)]
        self.pending, out = fresh, []
        while self.pending and self.pending[0][3] and self.pending[0][2] <= now - self.hold:
            out.append(self.pending.pop(0)[:3])
        self.committed += out
        return out

    def flush(self) -> list[tuple[str, int, int]]:
        out = [t[:3] for t in self.pending]
        self.committed, self.pending = self.committed + out, []
        return out
