"""Problem 6: held-out items whose passages stand in a corpus.

Method: q-gram lemma filtering. A passage of m characters that stands in a text with at most k edits shares at least
m - q + 1 - k*q of its q-grams with it, all within a band of diagonals. Hits of the items' q-grams are counted by text, item
and overlapping band; bands that reach the bound are verified by banded alignment, word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.codes import WindowHashes, code_points
from millrace.session import cut

#: Items of at most so many characters go to all tasks whole; of a larger set only a filter does.
BLOCK_CHARS = 4_000_000
#: Bits of that filter (16 MB). Where a set fills it, more positions are sent, none is lost.
FILTER_BITS = 27
#: Parts that the positions of one hash are split into.
SALTS = 8
#: Characters of corpus taken at once in a task.
BATCH_CHARS = 2_000_000
_BITS = 24
_FOLD: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """For each code point its lower-case letter or digit, or a space."""
    if not _FOLD:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalnum():
                low = ch.lower()
                table[c] = ord(low[0])
        _FOLD.append(table)
    return _FOLD[0]


def words_of(text: str) -> str:
    """The words of a text in lower case, with one space around each; plain form of folded()."""
    low = "".join(chr(fold_table()[ord(c)]) for c in text)
    return " " + " ".join(re.findall(r"[^ ]+", low)) + " " if low.strip() else " "


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts, each between spaces and a zero, and where each starts; last comes the end."""
    codes, ends = code_points(["  " + t + " \0" for t in texts])
    mapped = fold_table()[codes]
    mapped[ends[1:] - 1] = 0
    space = mapped == 32
    keep = np.ones(len(mapped), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    starts = np.concatenate([[0], np.cumsum(keep)])[ends]
    return mapped[keep], starts


class Index:
    """The q-grams of a block of items. texts: words_of() each passage's source; item: its id."""

    def __init__(self, items: list[tuple[int, str]], words: int, q: int, edits: int) -> None:
        self.words, self.q, self.edits = words, q, edits
        self.item, self.texts, self.windows, self.least = [], [], [], []
        hashes, owner, place = [], [], []
        for item_id, text in items:
            own = words_of(text)
            at = [k for k, c in enumerate(own) if c == " "]
            if len(at) <= words:
                continue
            spans = [(at[k], at[k + words] + 1) for k in range(len(at) - words)]
            shortest = min(b - a for a, b in spans)
            width = max(1, min(q, (shortest - edits) // (edits + 1)))
            if width < q:  # so short a passage shares no whole q-gram for certain; it is looked for by itself
                raise ValueError(f"a passage of {shortest} characters is too short for q-grams of {q} with {edits} edits")
            codes, _ = code_points([own])
            h = WindowHashes(codes).quick(q)
            hashes.append(h)
            owner.append(np.full(len(h), len(self.texts), np.int32))
            place.append(np.arange(len(h), dtype=np.int32))
            self.item.append(item_id)
            self.texts.append(own)
            self.windows.append(spans)
            self.least.append(shortest - q + 1 - edits * q)
        #: All q-grams, in the order of their places.
        self.by_place = h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        h = h[order]
        self.hash, first = np.unique(h, return_index=True)
        self.first = np.concatenate([first, [len(h)]])
        self.owner = np.concatenate(owner)[order] if owner else np.zeros(0, np.int32)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, np.int32)
        self.least = np.array(self.least, np.int64)
        self.seen: np.ndarray | None = None

    def filter(self) -> np.ndarray:
        if self.seen is None:
            self.seen = np.zeros(1 << _BITS, bool)
            self.seen[(self.hash >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return self.seen

    def _reached(self, t: int, places: np.ndarray) -> list[tuple[int, int]]:
        """A text's windows that have as many hits as the lemma asks of each; places: of its q-grams that were hit, in order."""
        a, e = np.array(self.windows[t]).T
        hits = np.searchsorted(places, e - self.q, "right") - np.searchsorted(places, a, "left")
        return [self.windows[t][k] for k in np.flatnonzero(hits >= e - a - self.q + 1 - self.edits * self.q)]

    def found(self, ids: np.ndarray, texts: list[str]) -> list[tuple[int, int]]:
        """(item id, document id) of the texts that hold a passage."""
        codes, starts = folded(texts)
        h = WindowHashes(codes).quick(self.q)
        hit = np.flatnonzero(self.filter()[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(hit) or not len(self.hash):
            return []
        at = np.searchsorted(self.hash, h[hit])
        at[at == len(self.hash)] = 0
        true = self.hash[at] == h[hit]
        hit, at = hit[true], at[true]
        many = self.first[at + 1] - self.first[at]
        entry = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        hit = np.repeat(hit, many)
        doc = np.searchsorted(starts, hit, "right") - 1
        diagonal = hit - starts[doc] - self.place[entry]
        frame = pd.concat([pd.DataFrame({"doc": doc, "text": self.owner[entry], "band": band, "place": self.place[entry]}) for band in band_of(diagonal, self.edits)])
        groups = frame.groupby(["doc", "text", "band"], sort=False)
        frame["n"] = groups["place"].transform("size")
        frame = frame[frame["n"].to_numpy() >= self.least[frame["text"].to_numpy()]]
        out: set[tuple[int, int]] = set()
        for (d, t, b), places in frame.groupby(["doc", "text", "band"], sort=False)["place"]:
            if (self.item[t], ids[d]) in out:
                continue
            own = codes[starts[d] : starts[d + 1] - 1]
            if holds(own, self.texts[t], self._reached(t, np.unique(places.to_numpy())), int(b), self.edits):
                out.add((self.item[t], int(ids[d])))
        return list(out)


def band_of(diagonal: np.ndarray, edits: int) -> list[np.ndarray]:
    """The bands that each diagonal lies in: itself without edits, else two that overlap by half, so that all diagonals of a passage lie within one of them."""
    band = max(1, 2 * edits)
    return [diagonal] if not edits else [2 * (diagonal // band), 2 * ((diagonal + edits) // band) - 1]


def holds(own: np.ndarray, text: str, windows: list[tuple[int, int]], band: int, edits: int) -> bool:
    """Whether a text's codes hold one of an item's passages on a band of diagonals, up to the edit budget."""
    if not windows:
        return False
    if not edits:
        plain_text = own.tobytes().decode("utf-32-le", "surrogatepass")
        return any(plain_text[a + band : e + band] == text[a:e] for a, e in windows if a + band >= 0)
    width = max(1, 2 * edits)
    low = band // 2 * width - (edits if band % 2 else 0)
    return banded(code_points([text])[0], own, np.array(windows), low, low + width - 1, edits)


def banded(item: np.ndarray, text: np.ndarray, windows: np.ndarray, low: int, high: int, edits: int) -> bool:
    """Whether one of an item's windows stands in a text with at most so many edits, starting on the diagonals from low to high.

    Banded alignment of all windows at once: a row for each window, a column for each diagonal that the budget lets an alignment reach; one step for each character. Along a row an insertion costs one, which a running minimum adds up."""
    low, high = low - 2 * edits, high + 2 * edits
    diagonals = np.arange(low, high + 1)
    starts, sizes = windows[:, 0], windows[:, 1] - windows[:, 0]
    far = edits + 1
    place = starts[:, None] + diagonals[None, :]  # in the text, of the next character
    cost = np.where((place >= 0) & (place <= len(text)), 0, far)
    padded = np.concatenate([text, np.zeros(1, text.dtype)])
    done = np.zeros(len(windows), bool)
    for i in range(int(sizes.max(initial=0))):
        live = i < sizes
        wanted = item[np.minimum(starts + i, len(item) - 1)]
        at = place + i
        inside = (at >= 0) & (at < len(text))
        same = np.where(inside, padded[np.clip(at, 0, len(text))] == wanted[:, None], False)
        step = np.where(inside, cost + ~same, far)
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)  # a character of the passage that the text lacks
        step = np.minimum.accumulate(step - diagonals, axis=1) + diagonals  # characters that only the text has
        step = np.where((at + 1 >= 0) & (at + 1 <= len(text)), np.minimum(step, far), far)
        cost = np.where(live[:, None], step, cost)
        ended = i + 1 == sizes
        done |= ended & (cost.min(axis=1) <= edits)
        if done.any():
            return True
        if (cost[live].min(initial=far)) > edits:
            return False
    return False


def _batched(b: pd.DataFrame) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Consecutive texts of about BATCH_CHARS; a longer one by itself."""
    ids, texts = b["doc_id"].to_numpy(np.int64), b["text"].tolist()
    start, held = 0, 0
    for k, t in enumerate(texts):
        if k > start and held + len(t) > BATCH_CHARS:
            yield ids[start:k], texts[start:k]
            start, held = k, 0
        held += len(t) + 4
    if start < len(texts):
        yield ids[start:], texts[start:]


def leaks(docs: DataFrame, items: DataFrame, words: int = 13, q: int = 16, edits: int = 0, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, doc_id: the documents that hold at least so many consecutive words of an item's text, up to an edit budget in characters.

    docs: doc_id, text; items: item_id, text (an item may have several rows). Null ids and null texts hold nothing, items of fewer words can't leak;
    empty tables give no rows. Passages so short that the lemma leaves no shared q-gram are refused with ValueError: take a smaller q.
    The corpus is read once. Up to block_chars characters of items go to all tasks, where hits are counted and verified on the spot; of more items only a filter of fixed size does, and hits meet the items' q-grams by shuffle.
    """
    spark = docs.sparkSession
    items = items.where("text is not null and item_id is not null").select("item_id", "text")
    docs = docs.where("text is not null and doc_id is not null").select("doc_id", "text")
    if (items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) > block_chars:
        return _sharded(docs, items, words, q, edits)
    index = spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in items.collect()], words, q, edits))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [x for ids, texts in _batched(b) for x in index.value.found(ids, texts)]
            yield pd.DataFrame(out, columns=["item_id", "doc_id"])

    return docs.mapInPandas(search, "item_id long, doc_id long").distinct()


def _sharded(docs: DataFrame, items: DataFrame, words: int, q: int, edits: int) -> DataFrame:
    """leaks() for any number of items. A filter of 2**FILTER_BITS bits over their q-grams goes to the tasks; a corpus position that passes it is sent once, to where the items' q-grams of that hash are, and counted by text, item and band. Text and item of the bands that
    reach the lemma's bound come together for the alignment. A q-gram that many items have meets many, which is what such items share; frequent hashes of the corpus are spread over copies of the items' side."""
    spark = docs.sparkSession
    items = cut(items.distinct().withColumn("text_id", F.xxhash64("item_id", "text")))

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text_id, item_id, text in zip(b["text_id"], b["item_id"], b["text"]):
                index = Index([(item_id, text)], words, q, edits)
                if index.texts:
                    yield pd.DataFrame({"hash": index.by_place.view(np.int64), "text_id": text_id, "place": np.arange(len(index.by_place), dtype=np.int32), "least": index.least[0]})

    known = cut(items.mapInPandas(grams, "hash long, text_id long, place int, least long"))
    bit = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    seen = known.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - FILTER_BITS}) & 63 as int))")).alias("bits")).toPandas()  # at most 2**(FILTER_BITS - 6) rows
    packed = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    packed[seen["word"].to_numpy(np.int64)] = seen["bits"].to_numpy(np.int64).view(np.uint64)
    bits = spark.sparkContext.broadcast(packed)

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, texts in _batched(b):
                codes, starts = folded(texts)
                h = WindowHashes(codes).quick(q)
                top = h >> np.uint64(64 - FILTER_BITS)
                hit = np.flatnonzero(bits.value[(top >> np.uint64(6)).astype(np.int64)] >> (top & np.uint64(63)) & np.uint64(1))
                doc = np.searchsorted(starts, hit, "right") - 1
                yield pd.DataFrame({"hash": h[hit].view(np.int64), "doc_id": ids[doc], "at": (hit - starts[doc]).astype(np.int32)})

    # a hash that many positions have is split into parts by text; each part meets its own copy of the items' q-grams
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    sent = docs.mapInPandas(hits, "hash long, doc_id long, at int").withColumn("salt", salt)
    met = sent.join(known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["hash", "salt"])
    diagonal = F.col("at") - F.col("place")
    width = max(1, 2 * edits)
    bands = F.array(diagonal) if not edits else F.array(2 * F.floor(diagonal / width), 2 * F.floor((diagonal + edits) / width) - 1)
    counted = met.select("doc_id", "text_id", "least", F.explode(bands).alias("band")).groupBy("doc_id", "text_id", "band").agg(F.count(F.lit(1)).alias("n"), F.first("least").alias("least")).where("n >= least")
    asked = cut(counted.groupBy("doc_id", "text_id").agg(F.collect_list("band").alias("bands")))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text, item_id, item, bands in zip(b["doc_id"], b["text"], b["item_id"], b["item"], b["bands"]):
                codes, starts = folded([text])
                index = Index([(item_id, item)], words, q, edits)
                if any(holds(codes[: starts[1] - 1], index.texts[0], index.windows[0], int(band), edits) for band in bands):
                    out.append((item_id, doc_id))
            yield pd.DataFrame(out, columns=["item_id", "doc_id"])

    both = asked.join(items.withColumnRenamed("text", "item"), "text_id").join(docs, "doc_id")
    return both.select("doc_id", "text", "item_id", "item", "bands").mapInPandas(verify, "item_id long, doc_id long").distinct()
