"""Problem 5: texts of varying length into sequences of fixed capacity.

Method: conflict-constrained best fit. Open sequences are ordered by what is left in them and carry bitmaps of the sources and
duplicate clusters that they hold; from the tightest sequence that has room the search goes on until one has no conflict.
Items go in by falling size, within groups of bounded size that are packed side by side.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.frames import plain
from millrace.llm.copies import canonical
from millrace.session import stored

#: Where the public tokenizers' files lie, unless a path is given.
TOKENIZERS = "/opt/tokenizers"
#: Tokens packed in one group; a sequence is lost at most once for each group.
GROUP_TOKENS = 20_000_000
#: Sources that are told apart where a sequence may hold one text of each only; more share a bit.
SOURCE_BITS = 64
ITEMS = "doc_id long, piece int, start int, size int, source string, cluster long"
PLACED = "sequence_id string, slot int, doc_id long, piece int, start int, size int, offset int"
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict[str, object] = {}


def encoder(path: str):
    """The byte-level tokenizer of a .tiktoken file, loaded once for a process."""
    if path not in _LOADED:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens, cluster (of texts with the same letters and digits) of doc_id, text, source. Rows without an id are left out, a null text has no tokens; whole texts are encoded, special tokens' strings as ordinary text."""
    path = tokenizer or os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]
            yield plain(pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n_tokens": np.array(n, np.int32), "cluster": b["cluster"]}))

    rows = docs.where("doc_id is not null").select("doc_id", "text", "source", F.xxhash64(F.coalesce(F.nullif(canonical(F.col("text")), F.lit("")), F.col("text"))).alias("cluster"))
    return rows.mapInPandas(count, "doc_id long, source string, n_tokens int, cluster long")


def pieces(counts: DataFrame, capacity: int) -> DataFrame:
    """ITEMS: a text that fits is one item; a longer one full pieces and a rest. Texts without tokens give none."""
    rows = counts.where("n_tokens > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / capacity).cast("int"))))
    start = F.col("piece") * capacity
    return rows.select("doc_id", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("n_tokens") - start).cast("int").alias("size"), "source", "cluster")


class _View:
    """Open sequences by room left; a bitmap says which amounts of room occur. What was moved since is dropped when it is met."""

    def __init__(self, capacity: int) -> None:
        self.rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.some = 0

    def add(self, s: int, room: int) -> None:
        self.rooms[room].append(s)
        self.some |= 1 << room


class Sequences:
    """Open sequences with bitmaps of the sources and clusters that they hold. With `sources` (how many there are) each source sees those sequences only that don't hold it, so none is looked at in vain."""

    def __init__(self, capacity: int, sources: int = 0) -> None:
        self.capacity, self.sources = capacity, sources
        self.views = [_View(capacity) for _ in range(max(1, sources))]
        self.room: list[int] = []
        self.held: list[tuple[int, int]] = []  # bitmaps of sources and clusters
        self.count: list[int] = []

    def place(self, size: int, source: int, cluster_bits: int, copies: int = 1) -> list[tuple[int, int, int]]:
        """(sequence, slot, offset) for each of some copies of an item: the tightest sequences that take one. They are met in one walk from the tightest on, as a sequence that has a copy takes no other."""
        view, out, room = self.views[source if self.sources else 0], [], size
        while len(out) < copies:
            left = view.some >> room
            if not left:
                break
            room += (left & -left).bit_length() - 1
            stack, kept = view.rooms[room], []
            while stack and len(out) < copies:
                s = stack.pop()
                sources, clusters = self.held[s]
                if self.room[s] != room or self.sources and sources >> source & 1:
                    continue
                if clusters & cluster_bits == cluster_bits:
                    kept.append(s)  # perhaps a copy of this text is there (the bitmap may be wrong in this direction only)
                    continue
                out.append(self._put(s, size, source, cluster_bits))
            stack.extend(reversed(kept))
            if not stack:
                view.some &= ~(1 << room)
            room += 1
        while len(out) < copies:
            self.room.append(self.capacity)
            self.held.append((0, 0))
            self.count.append(0)
            out.append(self._put(len(self.room) - 1, size, source, cluster_bits))
        return out

    def _put(self, s: int, size: int, source: int, cluster_bits: int) -> tuple[int, int, int]:
        sources, clusters = self.held[s]
        sources |= 1 << source
        self.held[s] = (sources, clusters | cluster_bits)
        offset, slot = self.capacity - self.room[s], self.count[s]
        self.room[s] -= size
        self.count[s] += 1
        if self.room[s]:
            for k, view in enumerate(self.views):
                if not self.sources or not sources >> k & 1:
                    view.add(s, self.room[s])
        return s, slot, offset


def fill(items: pd.DataFrame, capacity: int, one_of_source: bool, name: str) -> pd.DataFrame:
    """PLACED for one group. Items go in by falling size; copies follow one another and are placed together, so that time is linear in their number too."""
    items = items.sort_values(["size", "cluster", "piece", "doc_id"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    codes, names = pd.factorize(np.array([hash_of(x) % SOURCE_BITS for x in items["source"]]) if one_of_source else np.zeros(len(items), int))
    bins = Sequences(capacity, len(names) if one_of_source else 0)
    cluster, piece, size = items["cluster"].to_numpy(np.int64).view(np.uint64), items["piece"].to_numpy(), items["size"].to_numpy()
    new = np.flatnonzero(np.concatenate([[True], (cluster[1:] != cluster[:-1]) | (piece[1:] != piece[:-1]) | (size[1:] != size[:-1]) | (codes[1:] != codes[:-1])])) if len(items) else []
    out: list[tuple[int, int, int]] = []
    for at, upto in zip(new, [*new[1:], len(items)]):
        c = int(cluster[at])
        # two of 256 bits say which clusters a sequence holds; pieces of one text aren't copies of each other
        bits = 1 << (c & 255) | 1 << ((c >> 8 ^ int(piece[at]) * 0x9E37) & 255)
        out += bins.place(int(size[at]), int(codes[at]), bits, int(upto - at))
    placed = items[["doc_id", "piece", "start", "size"]].copy()
    s, slot, offset = (np.array(x, np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    placed.insert(0, "sequence_id", [f"{name}-{k}" for k in s])
    placed.insert(1, "slot", slot.astype(np.int32))
    placed["offset"] = offset.astype(np.int32)
    return plain(placed)


def hash_of(text: str | None) -> int:
    return sum((k + 1) * ord(c) for k, c in enumerate(text or ""))


def packed(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, one_of_source: bool = False, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """PLACED: for each piece of each text its sequence, its slot and offset there, and where in the text it starts, in tokens.

    docs: doc_id (unique), text, source. Copies of a text (the same letters and digits in order, as in copies.py) never share a sequence; with one_of_source no two texts of a source do either (by a
    bitmap of 64, so some sources count as one). A text longer than capacity, and only such, is cut, into full sequences and a rest. Null and
    empty texts take no room and have no row; an empty table gives none. Groups are made by a hash of the id and hold about group_tokens tokens
    each, whatever the size of the corpus, so no key can grow one.
    """
    items = stored(pieces(token_counts(docs, tokenizer), capacity), "items")
    tokens = items.agg(F.sum("size")).first()[0] or 0
    groups = max(1, round(tokens / group_tokens))

    def fill_group(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return fill(part, capacity, one_of_source, str(key[0]))

    return items.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("g")).applyInPandas(fill_group, PLACED)


def padding(placed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: sequences, items, tokens, padding, padding_share, least (the fewest sequences that the tokens need)."""
    one = placed.agg(F.countDistinct("sequence_id").alias("sequences"), F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens"))
    room = F.col("sequences") * capacity
    return one.select("sequences", "items", "tokens", (room - F.col("tokens")).alias("padding"), F.try_divide(room - F.col("tokens"), room).alias("padding_share"), F.ceil(F.col("tokens") / capacity).alias("least"))
