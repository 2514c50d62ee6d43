"""Problem 2: answers that stop before their own end.

Method: a backward character n-gram model. For the last characters of a value, read backwards from its end in up to five
lengths, the model knows how often they stood at the end of a sentence and how often a sentence went on after them. The log-odds
of the two are compared with a threshold that follows from each language's, column's and source's own mixture.

The whole corpus is counted, in one pass: the short contexts in tables of fixed size, of the longer ones those that some value ends
with, since no others are asked for. What values end alike, length limits and mixtures come from all values too.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.frames import plain
from millrace.llm.codes import SECOND_BASE, WindowHashes, code_points
from millrace.llm.joins import with_hot_keys
from millrace.llm.language import language, words_in
from millrace.session import cut, stored

#: Lengths of the contexts.
ORDERS = (3, 5, 8, 12, 18)
#: So many of them, the shortest, are counted in this many buckets each; longer ones by their hash.
DENSE, BUCKET_BITS = 2, 20
#: Bits of the filter for each key of a longer context that some value ends with, and the logarithms of its least and most bits (128 MB). Beyond that more is counted than asked for, and none less.
KEY_BITS, LEAST_BITS, MOST_BITS = 16, 16, 30
#: Of a sample that judged() is asked for: a stratum (source, column and block of its first letter) with at least this share of all characters gets as much of the sample as any other such; so there are at most 1/HOT_STRATUM of them.
HOT_STRATUM = 0.001
#: No value is cut whose log-odds are above this: nothing then speaks for a cut.
LEAST_ODDS = -0.7
#: Weight, in occurrences, of what a shorter context says.
LEAN = 1.0
#: Log-odds beyond which the mixture of a source can't move the threshold.
MOST_PRIOR = 3.0
#: The same for values that end with a digit and a stop, which may be a number cut in two.
STOPPED_PRIOR = 8.0
_CHUNK = 1 << 13
#: Bits of the filter that are set at once, and groups that the tables of short contexts are first summed in.
_FILTER_CHUNK, _SUM_GROUPS = 1 << 20, 32
BATCH_CHARS = 1_000_000

# What stands in place of the missing rest of a text.
MARK = re.compile(r"(?:\s*(?:\.{3,}|…|\[(?:\.\.\.|…|truncated|cut|cut off|continued|more)\]?|\((?:truncated|cut off|continued)\)?|<(?:truncated|cut|snip)>?|�+|\\u[0-9a-fA-F]{0,4}|\\x[0-9a-fA-F]{0,2}|\\|&#?[a-zA-Z0-9]{0,6}|\[[a-z]{0,9}))+\s*$")
#: A value that only stands for a missing one, in brackets.
STAND_IN = re.compile(r"^[\[(<][^\])>]{1,30}[\])>]$")
# Stops, those that a space follows and those of scripts without spaces, and what may close after them.
STOPS, WIDE_STOPS, CLOSERS = ".!?؟।॥۔։።", "。！？｡．", "\"'”’)]*_`»」』）】》›"
_END = re.compile(f"[{re.escape(STOPS + WIDE_STOPS)}][{re.escape(CLOSERS)}]*$")

_TABLE: list[np.ndarray] = []
_STOP_TABLE: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Lower-case letters, 0 for each digit, a space for white space, plain quotes; anything else as it is."""
    if not _TABLE:
        table = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x3000):
            ch = chr(c)
            if ch.isspace() or c in (0x200B, 0xFEFF):
                table[c] = 32
            elif ch.isdigit():
                table[c] = 48
            else:
                table[c] = ord(ch.lower()[0])
        table[[0x2018, 0x2019]] = 39
        table[[0x201C, 0x201D]] = 34
        _TABLE.append(table)
    return _TABLE[0]


def _stop_kinds() -> np.ndarray:
    """0 for each letter, 1 for a stop that a space follows, 3 for one of scripts without spaces."""
    if not _STOP_TABLE:
        table = np.zeros(0x110000, np.uint8)
        table[[ord(c) for c in STOPS]] = 1
        table[[ord(c) for c in WIDE_STOPS]] = 3
        _STOP_TABLE.append(table)
    return _STOP_TABLE[0]


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded codes of all texts, runs of spaces as one, each text after ORDERS[-1] marks of a start; and where each starts and the last ends."""
    lead = "\2" * ORDERS[-1]
    codes, ends = code_points([lead + t for t in texts])
    mapped = _fold()[codes]
    space = mapped == 32
    keep = np.ones(len(mapped), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return mapped[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def _keys(hashes: np.ndarray, k: int) -> np.ndarray:
    """Keys of contexts of the k-th length: a bucket for the short ones, of which there are few different, else the hash."""
    if k < DENSE:
        return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) + (k << BUCKET_BITS)
    return hashes.view(np.int64)


def stripped(text: str) -> tuple[str, bool]:
    """A text without marks of a cut and spaces at its end, however long, and whether there was a mark. A text of marks only is left as it is."""
    bare = text.rstrip()
    width = 80
    while True:  # look further back as long as all that was looked at is marks
        tail = bare[-width:]
        mark = MARK.search(tail)
        if not mark or mark.start() or width >= len(bare):
            break
        width *= 2
    if not mark or not tail[: mark.start()].strip() and width >= len(bare):
        return bare, False
    return bare[: len(bare) - len(tail) + mark.start()], True


def _open(text: str) -> bool:
    """Whether a code block is open at the end."""
    return text.count("```") % 2 == 1


class Known:
    """A set of keys as bits, two for each key. A key of the set always passes; few others do."""

    def __init__(self, packed: np.ndarray) -> None:
        self.packed, self.bits = packed, (len(packed) * 64).bit_length() - 1

    @staticmethod
    def place(keys: np.ndarray, bits: int, which: int) -> np.ndarray:
        if which:
            keys = (keys ^ keys >> np.uint64(29)) * np.uint64(SECOND_BASE)
        return keys >> np.uint64(64 - bits)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys that pass."""
        some = np.arange(len(keys))
        for which in range(2):
            at = self.place(keys[some], self.bits, which)
            some = some[(self.packed[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)]
        return some


def known_keys(own: DataFrame) -> Known:
    """The keys of the longer contexts that values end with. own: as of endings(). The more there are, the larger the filter."""
    keys = cut(own.select(F.explode(F.array(*[f"key{k}" for k in range(DENSE, len(ORDERS))])).alias("key")).distinct())
    bits = min(max(LEAST_BITS, (keys.count() * KEY_BITS).bit_length()), MOST_BITS)
    size = min(1 << bits, _FILTER_CHUNK)

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.concatenate([Known.place(b["key"].to_numpy().view(np.uint64), bits, which) for which in range(2)]).astype(np.int64)
            yield pd.DataFrame({"chunk": at // size, "bit": at % size})

    def packed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        of = np.zeros(size, np.uint8)
        of[part["bit"].to_numpy()] = 1
        return pd.DataFrame({"chunk": [key[0]], "bits": [zlib.compress(np.packbits(of, bitorder="little").tobytes(), 1)]})

    whole = np.zeros((1 << bits) // size * (size // 64), np.uint64).reshape(-1, size // 64)
    for r in keys.mapInPandas(places, "chunk long, bit long").groupBy("chunk").applyInPandas(packed, "chunk long, bits binary").collect():
        whole[r["chunk"]] = np.frombuffer(zlib.decompress(r["bits"]), np.uint64)
    return Known(whole.reshape(-1))


class Counts:
    """Counts of the contexts of some lengths within one task, (went on, ended) of each: short ones by bucket, longer ones by hash. known: which of the longer ones are counted; None for all."""

    def __init__(self, orders: range = range(len(ORDERS)), known: Known | None = None) -> None:
        self.orders, self.known = orders, known
        self.dense = np.zeros(2 * DENSE << BUCKET_BITS, np.int64)
        self.keys: list[np.ndarray] = []
        self.sums: list[np.ndarray] = []

    def add(self, texts: list[str], around: dict[int, tuple[int, int]] | None = None) -> None:
        """around: by place in the list, how many folded characters at a text's start and end only stand around it and are counted elsewhere."""
        codes, ends = folded(texts)
        n = len(codes)
        last = np.zeros(n, bool)
        last[ends[1:] - 1] = True
        after2 = np.concatenate([codes[2:], [2, 2]])
        kinds = _stop_kinds()[codes]
        stop, wide = kinds > 0, kinds > 1
        later = lambda x, by, fill: np.concatenate([x[by:], np.full(by, fill)])
        next_stop, stop2 = later(stop, 1, False), later(stop, 2, False)
        after, last_next = later(codes, 1, 2), later(last, 1, True)
        ended = (next_stop & (later(wide, 1, False) | (after2 == 32) | stop2 | last_next) | stop & ((after == 32) | wide)) & ~last
        counted = ~last & (codes != 2)  # the end of a whole text is no evidence: it may be cut
        for k, (before, behind) in (around or {}).items():
            counted[ends[k] : ends[k] + ORDERS[-1] + before] = False
            counted[ends[k + 1] - behind : ends[k + 1]] = False
        hashes = WindowHashes(codes)
        at = np.flatnonzero(counted)  # where a context ends
        for k in self.orders:
            order = ORDERS[k]
            found = hashes.quick_at(at - (order - 1), order)
            if k < DENSE:
                np.add.at(self.dense, _keys(found, k) * 2 + ended[at], 1)
                continue
            if self.known:  # a longer context that a value ends with has a shorter one that it ends with too
                some = self.known.holds(found)
                at, found = at[some], found[some]
            of, distinct = pd.factorize(_keys(found, k))
            self.keys.append(distinct)
            self.sums.append(np.bincount(of * 2 + ended[at], minlength=2 * len(distinct)).reshape(-1, 2))

    def overflow(self, most: int = 2_000_000) -> Iterator[pd.DataFrame]:
        """What a task holds is bounded: beyond so many keys they are summed, and given out where that doesn't leave half of them."""
        if sum(map(len, self.keys)) > most:
            (frame,) = self.long()
            self.keys, self.sums = [], []
            if 2 * len(frame) > most:
                yield frame
            else:
                self.keys, self.sums = [frame["key"].to_numpy()], [frame[["went_on", "ended"]].to_numpy()]

    def long(self) -> Iterator[pd.DataFrame]:
        if self.keys:
            at, distinct = pd.factorize(np.concatenate(self.keys))
            sums = np.concatenate(self.sums)
            on, ended = np.bincount(at, sums[:, 0], len(distinct)), np.bincount(at, sums[:, 1], len(distinct))
            yield pd.DataFrame({"key": distinct, "went_on": on.astype(np.int64), "ended": ended.astype(np.int64)})

    def short(self) -> Iterator[pd.DataFrame]:
        parts = self.dense.reshape(-1, 2 * _CHUNK)
        some = np.flatnonzero(parts.any(axis=1))
        if len(some):
            yield pd.DataFrame({"key": some, "part": [zlib.compress(parts[k].tobytes(), 1) for k in some]})


def pieces(text: str) -> Iterator[tuple[str, tuple[int, int]]]:
    """A text in parts of about BATCH_CHARS, each between what its contexts reach before and after it; and how many folded characters that is on either side."""

    def size(part: str) -> int:
        return len(folded([part])[0]) - ORDERS[-1]

    def reach(part: Callable[[int], str], least: int) -> str:
        width = 4 * least
        while size(part(width)) < least and width < len(text):
            width *= 2
        return part(width)

    start = 0
    while start < len(text):
        end = start + BATCH_CHARS
        while end < len(text) and _fold()[ord(text[end])] == 32:  # runs of spaces stay whole
            end += 1
        before = reach(lambda n: text[max(start - n, 0) : start], ORDERS[-1]) if start else ""  # noqa: B023
        behind = reach(lambda n: text[end : end + n], 2) if end < len(text) else ""  # noqa: B023
        yield before + text[start:end] + behind, (size(before), size(behind))
        start = end


def in_batches(texts: list[str]) -> Iterator[tuple[list[str], dict[int, tuple[int, int]]]]:
    """The texts in lists of about BATCH_CHARS, a longer text in several; and what Counts.add() has to know of its parts."""
    held, around, size = [], {}, 0
    for t in texts:
        for part, beside in pieces(t) if len(t) > BATCH_CHARS else [(t, (0, 0))]:
            if beside != (0, 0):
                around[len(held)] = beside
            held.append(part)
            size += len(part)
            if size > BATCH_CHARS:
                yield held, around
                held, around, size = [], {}, 0
    if held:
        yield held, around


def counted(texts: DataFrame, known: Broadcast | None = None) -> DataFrame:
    """key, went_on, ended, part: counts of the contexts of a column `text`, summed within each task. Longer contexts have a row each, those in `known` (a Known; None for all); short ones tables in parts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counts(known=known and known.value)
        for b in batches:
            for held, around in in_batches(b["text"].tolist()):
                counts.add(held, around)
                for frame in counts.overflow():
                    yield frame.assign(part=None)
        for frame in counts.long():
            yield frame.assign(part=None)
        for frame in counts.short():
            yield frame.assign(went_on=0, ended=0)

    return texts.select("text").mapInPandas(count, "key long, went_on long, ended long, part binary")


def long_counts(texts: DataFrame) -> DataFrame:
    """key, went_on, ended: counts of all longer contexts of a column `text`."""
    return _long(counted(texts))


def _long(parts: DataFrame) -> DataFrame:
    return parts.where("part is null").groupBy("key").agg(F.sum("went_on").alias("went_on"), F.sum("ended").alias("ended"))


def _short(parts: DataFrame) -> np.ndarray:
    """Counts of the short contexts: (went on, ended) by bucket, a table of fixed size."""

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "part": [zlib.compress(sum(np.frombuffer(zlib.decompress(x), np.int64) for x in part["part"]).tobytes(), 1)]})

    schema = "key long, part binary"
    dense = np.zeros((DENSE << BUCKET_BITS) // _CHUNK * 2 * _CHUNK, np.int64).reshape(-1, 2 * _CHUNK)
    some = parts.where("part is not null").groupBy("key", F.pmod(F.xxhash64("part"), F.lit(_SUM_GROUPS)).alias("group")).applyInPandas(add, schema)
    for r in some.groupBy("key").applyInPandas(add, schema).collect():
        dense[r["key"]] = np.frombuffer(zlib.decompress(r["part"]), np.int64)
    return dense.reshape(-1, 2)


def _stratum() -> F.Column:
    return F.xxhash64(F.coalesce("source", F.lit("\0")), F.coalesce("field_name", F.lit("\0")), "block")


def _with_block(values: DataFrame) -> DataFrame:
    """values with `block`: 256 code points that the first letter is of; ideographs and syllables of East Asia are one."""
    return values.withColumn("block", F.least(F.lit(0x2E), F.shiftright(F.ascii(F.regexp_extract("text", r"\p{L}", 0)), 8)))


def sizes_of(values: DataFrame) -> DataFrame:
    """source, field_name, block, n_chars, n_bytes, n: how many values there are of each length."""
    known = _with_block(values.where("text is not null"))
    return known.groupBy("source", "field_name", "block", F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes")).agg(F.count(F.lit(1)).alias("n"))


def sampled(values: DataFrame, sizes: DataFrame, chars: int) -> DataFrame:
    """A part of the values, which only judged(sample_chars=) counts, by a hash of id and column: all if they have no more than `chars` characters, else about so many.

    Strata below HOT_STRATUM give in proportion to their size; what these leave goes evenly to the others, of which there are at most 1000."""
    strata = cut(sizes.groupBy(_stratum().alias("stratum")).agg(F.sum(F.col("n_chars") * F.col("n")).alias("chars")))
    total = strata.agg(F.sum("chars")).first()[0] or 0
    values = values.where("text is not null")
    if total <= chars:
        return values
    hot = {r["stratum"]: r["chars"] for r in strata.where(F.col("chars") >= HOT_STRATUM * total).collect()}
    rest = chars / total
    left, level = chars - rest * (total - sum(hot.values())), 0.0
    for k, size in enumerate(sorted(hot.values())):
        level = left / (len(hot) - k)
        if size >= level:
            break
        left -= size
    rates = values.sparkSession.createDataFrame([(k, min(1.0, level / n)) for k, n in hot.items()] or [(0, rest)], "stratum long, rate double")
    known = _with_block(values).withColumn("stratum", _stratum()).join(F.broadcast(rates), "stratum", "left")
    return known.where(F.pmod(F.xxhash64("record_id", "field_name"), F.lit(1_000_000)) < F.coalesce("rate", F.lit(rest)) * 1_000_000).select(*values.columns)


FINALS = "record_id long, field_name string, source string, lang string, n_chars int, n_bytes int, open boolean, marked boolean, stopped boolean, keys array<long>, whole long"


def finals(values: DataFrame) -> DataFrame:
    """FINALS of the values that don't plainly end with a stop: keys of their final contexts, shortest first, and a hash of their last 48 characters."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, tails = [], []
            for record_id, field, source, text in zip(b["record_id"], b["field_name"], b["source"], b["text"]):
                bare, marked = stripped(text)
                is_open = _open(text)
                if (len(bare) < 200 and words_in(bare) < 2 or len(bare) < 40 and STAND_IN.search(bare)) and not is_open:
                    continue  # of one word nothing tells whether it goes on
                if bare.endswith("```") and not is_open:
                    continue  # a block that is closed
                stopped = not marked and bool(_END.search(bare[-12:]))
                if not (is_open or not stopped or bare[-2:-1].isdigit() and bare[-1] == "."):
                    continue
                rows.append((record_id, field, source, language(text), len(text), len(text.encode("utf-8", "surrogatepass")), is_open, marked, stopped))
                tails.append(bare[-200:])  # what the longest context and the last 48 characters take
            if not rows:
                continue
            codes, ends = folded(tails)
            hashes = WindowHashes(codes)
            stop = ends[1:]
            frame = pd.DataFrame(rows, columns=["record_id", "field_name", "source", "lang", "n_chars", "n_bytes", "open", "marked", "stopped"])
            keys = [_keys(hashes.quick(n)[stop - n], k) for k, n in enumerate(ORDERS)]
            frame["keys"] = list(np.stack(keys, axis=1))
            # texts whose last 48 characters are equal count once, since a cut text may have copies
            frame["whole"] = hashes.of(np.maximum(stop - 48, ends[:-1]), stop).view(np.int64)
            yield plain(frame)

    return values.where("text is not null and record_id is not null").select("record_id", "field_name", "source", "text").mapInPandas(read, FINALS)


def endings(rows: DataFrame) -> DataFrame:
    """ending, key0 to key4, n: each different ending (by its longest context) once, and of how many different texts it is. rows: FINALS. Texts are counted before they are joined, so an ending that a third of all rows have is one row."""
    counts = rows.select("keys", "whole").distinct().groupBy("keys").agg(F.count(F.lit(1)).alias("n"))
    return cut(counts.select(F.col("keys")[len(ORDERS) - 1].alias("ending"), *[F.col("keys")[k].alias(f"key{k}") for k in range(len(ORDERS))], "n"))


def ending_odds(own: DataFrame, model: DataFrame, dense: np.ndarray, base: float) -> DataFrame:
    """ending, odds: for each ending its log-odds of an end, against those of any place. own: as of endings(); model: key, went_on, ended of the longer contexts; dense: of the short ones.

    A length's evidence is the model's, and the other texts of the whole corpus that end alike; it leans on the next shorter length."""
    orders = range(len(ORDERS))
    shared = own.sparkSession.sparkContext.broadcast(dense if dense.max() >= 2**31 else dense.astype(np.int32))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(DENSE):
                at = shared.value[b[f"key{k}"].to_numpy()].astype(np.int64)
                b[f"on{k}"], b[f"end{k}"] = at[:, 0], at[:, 1]
            yield b

    odds = own.mapInPandas(look, ", ".join(["ending long", *[f"key{k} long" for k in orders], "n long", *[f"on{k} long, end{k} long" for k in range(DENSE)]]))
    for k in orders:  # from few different keys to many
        odds = odds.join(own.groupBy(f"key{k}").agg((F.sum("n") - 1).alias(f"alike{k}")), f"key{k}")
    longer = range(DENSE, len(ORDERS))
    keyed = own.select("ending", F.posexplode(F.array(*[f"key{k}" for k in longer])).alias("k", "key")).join(model, "key")
    seen = keyed.groupBy("ending").pivot("k", list(range(len(longer)))).agg(F.first("went_on").alias("on"), F.first("ended").alias("end"))
    odds = odds.join(seen, "ending", "left")
    share = F.lit(base)
    for k in orders:
        on, end = (F.col(f"on{k}"), F.col(f"end{k}")) if k < DENSE else (F.coalesce(f"{k - DENSE}_on", F.lit(0)), F.coalesce(f"{k - DENSE}_end", F.lit(0)))
        share = (end + F.col(f"alike{k}") + LEAN * share) / (on + end + F.col(f"alike{k}") + LEAN)
    share = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), share))
    return odds.select("ending", (F.log(share / (1 - share)) - float(np.log(base / (1 - base)))).alias("odds"))


def _spikes(sizes: DataFrame) -> DataFrame:
    """source, field_name, unit, size, excess: lengths in characters or bytes that a source's answers have far more often than the lengths around. sizes: as of sizes_of()."""
    units = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("size")) for u in ("n_chars", "n_bytes")])).alias("s")
    n = sizes.select("source", "field_name", units, "n").groupBy("source", "field_name", "s.unit", "s.size").agg(F.sum("n").alias("count"))
    near = Window.partitionBy("source", "field_name", "unit").orderBy("size").rangeBetween(-60, 60)
    around = n.withColumn("expected", (F.sum("count").over(near) - F.col("count")) / 120.0)
    return around.where((F.col("count") >= 5) & (F.col("size") > 100) & (F.col("count") > 8 * F.col("expected") + 4)).select("source", "field_name", "unit", "size", F.log(F.col("count") / (F.col("expected") + 0.1)).alias("excess"))


def with_excess(rows: DataFrame, chars: DataFrame, nbytes: DataFrame) -> DataFrame:
    """rows with x_chars and x_bytes of their source, field and length; a null source is a source of its own."""
    for spikes, unit in ((chars, "n_chars"), (nbytes, "n_bytes")):
        s = spikes.withColumnsRenamed({c: f"_{c}" for c in ("source", "field_name", unit)})
        on = [rows[c].eqNullSafe(s[f"_{c}"]) for c in ("source", "field_name")] + [rows[unit] == s[f"_{unit}"]]
        rows = rows.join(s, on, "left").drop("_source", "_field_name", f"_{unit}")
    return rows


def judged(values: DataFrame, sample_chars: int | None = None) -> DataFrame:
    """record_id, field_name, source, lang, log_odds (of a complete value), prior, cut: the values that might be cut, each with its verdict.

    values: record_id, field_name, source, text. Null ids, null and blank values and values of one word (in scripts without spaces, of one letter) are no case; a value that is there twice under one id and name is judged once. A value inside
    an open code block is cut, whatever the model says. Marks of a cut at the end (dots, a replacement character, half an escape) are taken off first and what is left is judged. An empty table gives no rows.
    The model counts all values, unless sample_chars asks for about so many characters of them.
    """
    sizes = cut(sizes_of(values))
    rows = cut(finals(values).dropDuplicates(["record_id", "field_name"]))
    own = endings(rows)
    known = values.sparkSession.sparkContext.broadcast(known_keys(own))
    texts = values.where("text is not null") if sample_chars is None else sampled(values, sizes, sample_chars)
    parts = stored(counted(texts, known), "contexts")
    model, dense = _long(parts), _short(parts)
    total = dense[: 1 << BUCKET_BITS].sum(axis=0)
    base = min(max(total[1] / max(total.sum(), 1), 1e-9), 0.5)
    spikes = cut(_spikes(sizes))
    chars = spikes.where("unit = 'n_chars'").select("source", "field_name", F.col("size").alias("n_chars"), F.col("excess").alias("x_chars"))
    size = F.explode(F.array(*[F.col("size") - k for k in range(4)]))
    nbytes = spikes.where("unit = 'n_bytes'").select("source", "field_name", size.alias("n_bytes"), "excess").groupBy("source", "field_name", "n_bytes").agg(F.max("excess").alias("x_bytes"))
    rows = rows.withColumn("ending", F.col("keys")[len(ORDERS) - 1])
    at = with_excess(with_hot_keys(rows, cut(ending_odds(own, model, dense, base)), ["ending"]), chars, nbytes)
    odds = F.col("odds")
    excess = F.greatest(F.coalesce("x_chars", F.lit(0.0)), F.coalesce("x_bytes", F.lit(0.0)))
    scored_rows = cut(at.select("record_id", "field_name", "source", "lang", "stopped", F.when(F.col("open"), -20.0).otherwise(odds - excess - F.when(F.col("marked"), 2.0).otherwise(0.0)).alias("log_odds")))
    bins = scored_rows.where("not stopped").groupBy("source", "field_name", "lang", F.round(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), "log_odds")), 1).alias("bin")).count()
    mixture = bins.groupBy("source").applyInPandas(_mixture, "source string, field_name string, lang string, prior double")
    keyed = scored_rows.join(mixture, scored_rows["source"].eqNullSafe(mixture["source"]) & scored_rows["field_name"].eqNullSafe(mixture["field_name"]) & scored_rows["lang"].eqNullSafe(mixture["lang"]), "left")
    prior = F.when(F.col("stopped"), STOPPED_PRIOR).otherwise(F.greatest(F.lit(-MOST_PRIOR), F.least(F.lit(MOST_PRIOR), F.coalesce("prior", F.lit(0.0)))))
    return keyed.select("record_id", scored_rows["field_name"], scored_rows["source"], scored_rows["lang"], "log_odds", prior.alias("prior"), ((F.col("log_odds") + prior < 0) & (F.col("log_odds") < LEAST_ODDS)).alias("cut"))


def _mixture(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """Log-odds that a value without a plain end is complete, for a source's columns and languages, by expectation maximisation over its own log-odds; small groups lean on the whole source."""

    def share(x: np.ndarray, n: np.ndarray, start: float, weight: float) -> float:
        p = start
        for _ in range(100):
            post = 1 / (1 + np.exp(-(x + np.log(p / (1 - p)))))
            new = ((post * n).sum() + weight * start) / (n.sum() + weight)
            new = min(max(new, 0.02), 0.98)
            if abs(new - p) < 1e-6:
                break
            p = new
        return p

    x, n = part["bin"].to_numpy(), part["count"].to_numpy(float)
    base = share(x, n, 0.5, 2.0)
    out = []
    for (field, lang), g in part.groupby(["field_name", "lang"], dropna=False):
        p = share(g["bin"].to_numpy(), g["count"].to_numpy(float), base, 20.0)
        out.append((key[0], field, None if pd.isna(lang) else lang, float(np.log(p / (1 - p)))))
    return plain(pd.DataFrame(out, columns=["source", "field_name", "lang", "prior"]))


def truncated(values: DataFrame) -> DataFrame:
    """record_id, field_name, source of the values that were cut off."""
    return judged(values).where("cut").select("record_id", "field_name", "source")


def truncation_shares(values: DataFrame) -> DataFrame:
    """source, answers, cut, cut_share: for each source the share of its non-null answers that are cut. A null source is a source of its own."""
    n = values.where("text is not null").groupBy("source").agg(F.count(F.lit(1)).alias("answers"))
    c = truncated(values).groupBy("source").agg(F.count(F.lit(1)).alias("cut"))
    n, c = n.withColumn("s", F.coalesce("source", F.lit("\0"))), c.select(F.coalesce("source", F.lit("\0")).alias("s"), "cut")
    return n.join(c, "s", "left").select("source", "answers", F.coalesce("cut", F.lit(0)).alias("cut"), (F.coalesce("cut", F.lit(0)) / F.col("answers")).alias("cut_share"))
