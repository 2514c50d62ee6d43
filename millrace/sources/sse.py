"""Server-sent events: S11, S12."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.sequential import folded


def content_event(payload: Column) -> Column:
    """Whether an event carries text."""
    return F.coalesce(F.get_json_object(payload, "$.choices[0].delta.content") != "", F.lit(False))


class EventBuffer:
    """The tail of a stream that isn't a whole event yet. Chunks come in order of arrival; each character is looked at a fixed number of times."""

    def __init__(self) -> None:
        self.tail: list[str] = []
        self.event = 0

    def feed(self, chunk: str) -> list[tuple[int, str]]:
        """(event, payload) of the events that a chunk ends."""
        text, out = chunk.replace("\r", ""), []
        if self.tail and text[:1] == "\n" and self.tail[-1].endswith("\n"):
            self.tail[-1] = self.tail[-1][:-1]  # a blank line that is split over two chunks
            text = "\n" + text
        parts = text.split("\n\n")
        for raw in parts[:-1]:
            whole = "".join([*self.tail, raw])
            self.tail = []
            data = [s[5:].removeprefix(" ") for s in whole.split("\n") if s.startswith("data:")]
            if data:
                out.append((self.event, "\n".join(data)))
            self.event += 1
        if parts[-1]:
            self.tail.append(parts[-1])
        return out


def events(chunks: DataFrame, key: str = "request_id", seq: str = "seq", text: str = "chunk", at: str = "at_s") -> DataFrame:
    """Key, event, payload, at_s, done, content of a stream's chunks.

    An event ends at a blank line, also where that is split over chunks, and comes at the time of the chunk that ends it; its data lines are joined. A rest without
    a blank line is no event. Lines may end with CR LF. A stream passes its task in order and only its unfinished event is kept, so it may be of any length; null keys and null chunks are left out."""
    rows = chunks.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, seq, text, F.col(at).cast("double").alias(at))
    kind = dict(rows.dtypes)[key]
    out = folded(rows, [key], [seq], EventBuffer, lambda buffer, row: [(*e, row[at]) for e in buffer.feed(row[text])], f"{key} {kind}, event int, payload string, at_s double")
    return out.withColumns({"done": F.trim("payload") == "[DONE]", "content": content_event(F.col("payload"))})
