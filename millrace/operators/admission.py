"""Replay of admission control over a trace: A1."""

from __future__ import annotations

import heapq
from collections import deque

from pyspark.sql import DataFrame

from millrace.operators.sequential import folded

MODES = ("passthrough", "static", "bounded_queue")


class Gateway:
    """One gateway's state: when each running request ends, and who waits. Releases come before arrivals at the same time; the queue is first in, first out."""

    def __init__(self, mode: str, cap: int, queue: int, deadline_s: float) -> None:
        if mode not in MODES:
            raise ValueError(mode)
        self.mode, self.cap, self.queue, self.deadline = mode, cap, queue, deadline_s
        self.ends: list[float] = []
        self.waiting: deque[tuple[float, float, tuple]] = deque()  # arrival, service, tag

    def _release(self, now: float) -> list[tuple]:
        """Outcomes of waiting requests up to a time."""
        out = []
        while True:
            free = self.ends[0] if len(self.ends) >= self.cap else None
            if self.waiting and (free is None or self.waiting[0][0] + self.deadline < free) and self.waiting[0][0] + self.deadline < now:
                at, _, tag = self.waiting.popleft()
                out.append((*tag, "shed_deadline", self.deadline))
            elif self.ends and self.ends[0] <= now:
                t = heapq.heappop(self.ends)
                while self.waiting and self.waiting[0][0] + self.deadline < t:
                    at, _, tag = self.waiting.popleft()
                    out.append((*tag, "shed_deadline", self.deadline))
                if self.waiting:
                    at, service, tag = self.waiting.popleft()
                    heapq.heappush(self.ends, t + service)
                    out.append((*tag, "admitted", t - at))
            else:
                return out

    def offer(self, at: float, service: float, tag: tuple) -> list[tuple]:
        """Outcomes known once a request arrives: of those that waited, and of this one unless it waits now."""
        if self.mode == "passthrough":
            return [(*tag, "admitted", 0.0)]
        out = self._release(at)
        if len(self.ends) < self.cap:
            heapq.heappush(self.ends, at + service)
            return [*out, (*tag, "admitted", 0.0)]
        if self.mode == "static" or len(self.waiting) >= self.queue:
            return [*out, (*tag, "shed_capacity", 0.0)]
        self.waiting.append((at, service, tag))
        return out

    def close(self) -> list[tuple]:
        return self._release(float("inf")) if self.mode == "bounded_queue" else []


def replayed(trace: DataFrame, key: str, mode: str = "bounded_queue", cap: int = 36, queue: int = 36, deadline_s: float = 0.25) -> DataFrame:
    """key, request_id, outcome (admitted, shed_capacity, shed_deadline), wait_s for each row of key, request_id, at_s, service_s.

    One gateway serves a key's requests in order of arrival, which is a sequence by nature: a key's rows stream through one task that holds the running and
    the waiting requests only. Null times are no requests. Ties in time go by request_id."""
    kind = dict(trace.dtypes)
    rows = trace.where("at_s is not null").select(key, "request_id", "at_s", "service_s").na.fill({"service_s": 0.0})
    return folded(rows, [key], ["at_s", "request_id"], lambda: Gateway(mode, cap, queue, deadline_s), lambda g, r: g.offer(r["at_s"], max(0.0, r["service_s"]), (r["request_id"],)), f"{key} {kind[key]}, request_id {kind['request_id']}, outcome string, wait_s double", lambda g: g.close())
