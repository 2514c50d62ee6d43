"""Problem 7: passages of at least a given length that stand verbatim in more than one text.

Method: sliding sentence spans. A text is cut into sentences, and a sentence longer than a window is cut again at places
that its own characters decide, so that every common passage of min_chars holds a whole run of consecutive pieces,
the same in both texts. Runs are hashed and joined globally; a run that always follows the same run is covered by it and
needs no look of its own; what is left is compared character by character.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.frames import plain
from millrace.llm.codes import SECOND_BASE, WindowHashes, code_points, sliding_min
from millrace.llm.joins import with_hot_keys
from millrace.session import cut, stored

#: Characters that decide whether a text is cut at a place: so many after it, and two before.
CONTEXT = 12
#: Groups of texts up to this size are compared in a task, larger ones by hashes of all their windows.
SMALL_GROUP = 256
#: Characters taken at once in a task.
BLOCK = 2_000_000
RUNS = "hash long, doc_id long, ord int, start int, size int"
#: A run that one block of texts holds so often goes past the grouping by its hash, with one row in its place; so no group gets more than this from a block.
HOT_IN_BLOCK = 8
#: Rows of one run that meet in a task when runs are linked to their neighbours; more are spread.
SALT_ROWS = 100_000
#: Tables of up to so many rows (of 16 and 60 bytes) are broadcast, larger ones joined by shuffle.
SMALL_IDS, SMALL_REGIONS = 100_000, 100_000
#: Bits of a sent run's start, size and number.
_START, _SIZE, _ORD = 31, 12, 19
_INDEX = (1 << 24) - 1
_PLAIN = np.uint64(1 << 63)


def window_of(min_chars: int) -> tuple[int, int]:
    """(window, least length of a run), such that min_chars characters always hold a whole run.

    Of the places whose context lies in them, the first window's lowest and the last window's lowest are cuts in every text that has
    these characters, and so are all cuts between; a run goes on to the first cut after its least length, which is there before the last."""
    places = min_chars - 2 - CONTEXT + 1
    window = max(4, int(0.28 * min_chars))
    return window, places + 1 - 2 * window


def cuts(codes: np.ndarray, real: np.ndarray, window: int) -> tuple[np.ndarray, WindowHashes]:
    """Places where pieces start: in each window of places the one of lowest rank; starts of sentences rank before all others. real: which places belong to a text."""
    hashes = WindowHashes(codes)
    rank = hashes.quick(CONTEXT)
    n = len(rank)
    before, before2 = np.concatenate([[0], codes[: n - 1]]), np.concatenate([[0, 0], codes[: n - 2]])[:n]
    sentence = (before == 10) | ((before == 32) & ((before2 == 46) | (before2 == 33) | (before2 == 63)))
    rank = np.where(sentence, rank >> np.uint64(1), rank | _PLAIN)
    rank = np.where(real[:n] & real[CONTEXT - 1 : CONTEXT - 1 + n], rank, ~np.uint64(0))
    keys = (rank & ~np.uint64(_INDEX)) | np.arange(n, dtype=np.uint64)
    chosen = np.unique(sliding_min(keys, window) & np.uint64(_INDEX)).astype(np.int64)
    return chosen[rank[chosen] != ~np.uint64(0)], hashes


def runs_of(ids: np.ndarray, texts: list[str], window: int, least: int) -> pd.DataFrame:
    """From each cut the run of consecutive pieces that first reaches the least length, as RUNS."""
    gap = "\0" * window
    codes, ends = code_points([t + gap for t in texts])
    real = np.ones(len(codes), bool)
    for k in range(1, window + 1):
        real[ends[1:] - k] = False
    at, hashes = cuts(codes, real, window)
    owner = np.searchsorted(ends, at, "right") - 1
    until = np.searchsorted(at, at + least)
    whole = np.flatnonzero(until < len(at))
    whole = whole[owner[whole] == owner[until[whole]]]
    first = np.searchsorted(owner, owner[whole])
    begin, end = at[whole], at[until[whole]]
    return pd.DataFrame({"hash": hashes.of(begin, end).view(np.int64), "doc_id": ids[owner[whole]], "ord": (whole - first).astype(np.int32), "start": (begin - ends[owner[whole]]).astype(np.int32), "size": (end - begin).astype(np.int32)})


def blocks(ids: np.ndarray, texts: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Consecutive texts of about BLOCK characters; a longer text is a block of its own."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        if k > start and held + len(t) > BLOCK:
            yield ids[start:k], texts[start:k]
            start, held = k, 0
        held += len(t) + 64
    if start < len(texts):
        yield ids[start:], texts[start:]


def long_text_runs(doc_id: int, text: str, window: int, least: int) -> Iterator[pd.DataFrame]:
    """Runs of one text of more characters than indexes can count, by overlapping stretches; runs that both stretches have come once."""
    step, over, done = BLOCK, 8 * window, -1
    for k, at in enumerate(range(0, len(text), step)):
        part = runs_of(np.array([doc_id]), [text[max(0, at - over) : at + step + over]], window, least)
        part["start"] += max(0, at - over)
        part = part[(part["start"] > done) & ((part["start"] < at + step) | (at + step >= len(text)))]
        if k:
            part = part[part["start"] >= at]
        part["ord"] = (part["start"] // 2).astype(np.int32)  # not consecutive: such runs are all looked at
        yield part


_SENT = "hash long, doc_id long, place long"


def _sent(part: pd.DataFrame) -> pd.DataFrame:
    """RUNS as they are sent: start, size, ord and a sign in one number. The sign says that the run is frequent and goes on ungrouped."""
    place = part["start"].to_numpy(np.int64) | part["size"].to_numpy(np.int64) << _START | np.minimum(part["ord"].to_numpy(np.int64), (1 << _ORD) - 1) << (_START + _SIZE)
    out = pd.DataFrame({"hash": part["hash"].to_numpy(), "doc_id": part["doc_id"].to_numpy(), "place": place})
    if not len(out):
        return out
    _, at, n = np.unique(out["hash"].to_numpy(), return_inverse=True, return_counts=True)
    many = n[at] >= HOT_IN_BLOCK
    if not many.any():
        return out
    out.loc[many, "place"] |= np.int64(-1) << 62  # its own row, marked
    _, first = np.unique(at[many], return_index=True)
    stand = out[many].iloc[first].assign(place=np.int64(1) << 62)  # a row that only says that there are others
    return pd.concat([out, stand], ignore_index=True)


class _Groups:
    """Rows of hash, doc_id, place, sorted by hash, as they come: those of hashes that several texts have. What is held over is the last hash's rows while they are of one text."""

    def __init__(self) -> None:
        self.held: pd.DataFrame | None = None
        self.last, self.several = None, False

    def take(self, b: pd.DataFrame, at_end: bool = False) -> pd.DataFrame:
        if self.held is not None:
            b = pd.concat([self.held, b], ignore_index=True)
        h, doc, place = b["hash"].to_numpy(), b["doc_id"].to_numpy(), b["place"].to_numpy()
        if not len(b):
            return b
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        known = np.logical_or.reduceat((place < 0) | (place == 1 << 62), new) | (np.minimum.reduceat(doc, new) < np.maximum.reduceat(doc, new))
        if self.several and h[0] == self.last:
            known[0] = True
        keep = np.repeat(known, np.diff(np.concatenate([new, [len(h)]])))
        self.last, self.several, self.held = h[-1], bool(known[-1]), None
        if not self.several and not at_end:
            self.held = b.iloc[new[-1] :]
        return b[keep & (place != 1 << 62)]


def repeated_runs(docs: DataFrame, min_chars: int) -> DataFrame:
    """RUNS of doc_id, text: all that stand in more than one text, and such as are frequent in one.

    Each run is sent once, 24 bytes, to where its hash is grouped, and read there in sorted order; those that a block already knows to be frequent are spread evenly instead, so that no group is large.
    Passages of more than 5,000 characters aren't looked for as such (ValueError): they hold shorter ones."""
    window, least = window_of(min_chars)
    if window + least >= 1 << _SIZE:
        raise ValueError(f"passages of {min_chars} characters give runs too long to send")

    def of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, texts in blocks(b["doc_id"].to_numpy(np.int64), b["text"].tolist()):
                if len(texts) == 1 and len(texts[0]) > 3 * BLOCK:
                    for part in long_text_runs(ids[0], texts[0], window, least):
                        yield _sent(part)
                else:
                    yield _sent(runs_of(ids, texts, window, least))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups = _Groups()
        for b in batches:
            yield _unpacked(groups.take(b))
        if groups.held is not None:
            yield _unpacked(groups.take(groups.held.iloc[:0], at_end=True))

    def _unpacked(b: pd.DataFrame) -> pd.DataFrame:
        p = b["place"].to_numpy() & ((1 << 62) - 1)
        return pd.DataFrame({"hash": b["hash"].to_numpy(), "doc_id": b["doc_id"].to_numpy(), "ord": (p >> (_START + _SIZE)).astype(np.int32), "start": (p & ((1 << _START) - 1)).astype(np.int32), "size": (p >> _START & ((1 << _SIZE) - 1)).astype(np.int32)})

    sent = docs.mapInPandas(of_batches, _SENT)
    return sent.repartition(F.when(F.col("place") < 0, F.xxhash64("doc_id", "place")).otherwise(F.col("hash"))).sortWithinPartitions("hash").mapInPandas(keep, RUNS)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, rep, copies: the smallest id with the same text and how many have it, for texts that more than one document has. docs: doc_id, text."""
    keyed = cut(docs.select("doc_id", F.unhex(F.md5("text")).alias("key"), F.xxhash64("text").alias("check")).distinct())
    same = keyed.groupBy("key", "check").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return with_hot_keys(keyed, same, ["key", "check"]).select("doc_id", "rep", "copies")


def _regions(found: DataFrame) -> DataFrame:
    """hash, n, doc_id, start, size, upto: the runs to look at, each with the end of the runs it covers. found: RUNS and n.

    A run is covered by the one before it if wherever it stands that one stands before it, at the same distance, and as often."""
    by_doc = Window.partitionBy("doc_id").orderBy("start")
    linked = found.withColumns({"prev_ord": F.lag("ord").over(by_doc), "prev_hash": F.lag("hash").over(by_doc), "prev_n": F.lag("n").over(by_doc), "prev_start": F.lag("start").over(by_doc)})
    linked = linked.withColumn("link", F.when(F.col("prev_ord") == F.col("ord") - 1, F.xxhash64("prev_hash", F.col("start") - F.col("prev_start"))))
    links = linked.groupBy("hash").agg(F.first("n").alias("_n"), F.count("link").alias("n_link"), F.min("link").alias("link_min"), F.max("link").alias("link_max")).where("link_min = link_max")
    # a frequent run's rows are spread over several copies of its one row
    copies = lambda n: F.ceil(F.col(n) / SALT_ROWS)
    links = links.select("*", F.explode(F.sequence(F.lit(0), (copies("_n") - 1).cast("int"))).alias("salt"))
    marked = linked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), copies("n")).cast("int")).join(links, ["hash", "salt"], "left").drop("salt", "_n").withColumn(
        "covered", F.coalesce((F.col("n_link") == F.col("n")) & (F.col("link_min") == F.col("link")) & (F.col("prev_n") == F.col("n")), F.lit(False))
    )
    numbered = marked.withColumn("region", F.sum(F.when(F.col("covered"), 0).otherwise(1)).over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min_by(F.struct("hash", "n", "start", "size"), "start")
    return numbered.groupBy("doc_id", "region").agg(first.alias("r"), F.max(F.col("start") + F.col("size")).alias("upto")).select("doc_id", "r.*", "upto")


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


MATCHES = "doc_a long, start_a int, doc_b long, start_b int, size int"
COVERED = "doc_id long, start int, upto int, later boolean"
_LOOKED = "hash long, n long, doc_id long, start int, size int, before string, after string"
_Row = tuple[int, int, str, str]  # doc_id, start, left (reversed), right (from the run on)


def _matches(rows: list[_Row], min_chars: int) -> Iterator[tuple[int, int, int, int]]:
    """(i, j, back, size) of the verified matches within one group: its i-th and j-th row share `size` characters, `back` of them before the run."""
    for i, (da, _, la, ra) in enumerate(rows):
        for j in range(i + 1, len(rows)):
            db, _, lb, rb = rows[j]
            if da == db:
                continue
            back = _common(la, lb)
            size = back + _common(ra, rb)
            if size >= min_chars:
                yield i, j, back, size


def _pairs_of(rows: list[_Row], min_chars: int) -> list[tuple]:
    """MATCHES of one group."""
    out = []
    for i, j, back, size in _matches(rows, min_chars):
        (da, sa, *_), (db, sb, *_) = sorted((rows[i], rows[j]))
        out.append((da, sa - back, db, sb - back, size))
    return out


def _covered_of(rows: list[_Row], min_chars: int) -> list[tuple]:
    """COVERED of one group: for each row what it shares with any other, in disjoint stretches, and again what it shares with texts of smaller ids."""
    found: dict[tuple[int, bool], list[tuple[int, int]]] = {}
    for i, j, back, size in _matches(rows, min_chars):
        for k, other in ((i, j), (j, i)):
            own = (rows[k][1] - back, rows[k][1] - back + size)
            for later in (False, True) if rows[other][0] < rows[k][0] else (False,):
                found.setdefault((k, later), []).append(own)
    out = []
    for (k, later), spans in found.items():
        start, upto = None, None
        for a, e in sorted(spans):
            if upto is None or a > upto:
                if upto is not None:
                    out.append((rows[k][0], start, upto, later))
                start, upto = a, e
            upto = max(upto, e)
        out.append((rows[k][0], start, upto, later))
    return out


class Passages:
    """The passages of at least min_chars that stand verbatim in more than one text of docs.

    docs: doc_id (unique), text. Null ids, null texts and texts shorter than min_chars take no part; a row that is there twice counts once; an empty table gives no rows. Of equal texts only
    the one with the smallest id is compared; `members` has the rest. Only such runs as stand in several texts are ever brought together with text, and what a group of up to SMALL_GROUP
    places shares is compared character by character. Larger groups go by all their windows of min_chars, each known by two independent 64 bit hashes: texts that hold a window are one class, and
    no pairs are made of it unless pairs() is asked for them.
    """

    def __init__(self, docs: DataFrame, min_chars: int = 200) -> None:
        self.min_chars = min_chars
        self.docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars))
        #: doc_id, rep, copies of equal texts.
        self.members = cut(classes(self.docs))
        others = self.members.where("doc_id <> rep").select("doc_id")
        reps = self.docs.join(F.broadcast(others) if others.count() <= SMALL_IDS else others, "doc_id", "left_anti")
        found = cut(repeated_runs(reps, min_chars))
        found = with_hot_keys(found, cut(found.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))), ["hash"])
        regions = cut(_regions(found.where("n > 1")))
        wanted = regions.groupBy("doc_id").agg(F.collect_list(F.struct("hash", "n", "start", "size", "upto")).alias("regions"))
        if regions.count() <= SMALL_REGIONS:
            wanted = F.broadcast(wanted)
        near = min_chars

        def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for doc_id, text, regions in zip(b["doc_id"], b["text"], b["regions"]):
                    for r in regions:
                        s = r["start"]
                        rows.append((r["hash"], r["n"], doc_id, s, r["size"], text[max(0, s - near) : s], text[s : r["upto"] + near]))
                yield plain(pd.DataFrame(rows, columns=["hash", "n", "doc_id", "start", "size", "before", "after"]))

        self.looked = stored(reps.join(wanted, "doc_id").mapInPandas(contexts, _LOOKED), "passages")
        self._marks: DataFrame | None = None

    def _groups(self, of: Callable[[list[_Row], int], list[tuple]], schema: str) -> DataFrame:
        """What a function gives for each group of up to SMALL_GROUP places."""
        min_chars, names = self.min_chars, [c.split()[0] for c in schema.split(", ")]

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key, held = None, []
            for b in batches:
                out = []
                for h, doc, start, before, after in zip(b["hash"], b["doc_id"], b["start"], b["before"], b["after"]):
                    if h != key:
                        out += of(held, min_chars)
                        key, held = h, []
                    held.append((doc, start, before[::-1], after))
                yield pd.DataFrame(out, columns=names)
            yield pd.DataFrame(of(held, min_chars), columns=names)

        return self.looked.where(F.col("n") <= SMALL_GROUP).repartition("hash").sortWithinPartitions("hash").mapInPandas(compare, schema)

    def marks(self) -> DataFrame:
        """class, doc_id, start, size, first: of the groups beyond SMALL_GROUP, the windows that several texts hold, each by two hashes as `class`; those that always follow another such window are covered by it, which `size` says.

        first: the smallest id of a text that holds it."""
        if self._marks is not None:
            return self._marks
        min_chars = self.min_chars

        def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for doc, start, before, after in zip(b["doc_id"], b["start"], b["before"], b["after"]):
                    own = before + after
                    if len(own) < min_chars:
                        continue
                    codes, _ = code_points([own])
                    at = np.arange(len(own) - min_chars + 1)
                    one, two = (h.of(at, at + min_chars).view(np.int64) for h in (WindowHashes(codes), WindowHashes(codes, SECOND_BASE)))
                    yield pd.DataFrame({"hash": one, "check": two, "doc_id": np.full(len(at), doc, np.int64), "start": (start - len(before) + at).astype(np.int32)})

        every = self.looked.where(F.col("n") > SMALL_GROUP).mapInPandas(windows, "hash long, check long, doc_id long, start int")
        held = cut(every.distinct())
        several = held.groupBy("hash", "check").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
        known = cut(with_hot_keys(held, cut(several.select("hash", "check", "n", "first")), ["hash", "check"]))
        reach = _regions(known.select(F.xxhash64("hash", "check").alias("hash"), "n", "doc_id", F.col("start").alias("ord"), "start", F.lit(min_chars).alias("size")))
        own = reach.select("doc_id", "start", (F.col("upto") - F.col("start")).cast("int").alias("size")).join(known, ["doc_id", "start"])
        self._marks = cut(own.select(F.struct("hash", "check").alias("class"), "doc_id", "start", "size", "first"))
        return self._marks

    def matches(self) -> DataFrame:
        """MATCHES between different texts of groups up to SMALL_GROUP, so at most so many for each place. They may overlap and repeat."""
        return self._groups(_pairs_of, MATCHES)

    def covered(self) -> DataFrame:
        """COVERED: stretches of texts that other texts hold too, and again (later) those that a text of a smaller id holds. No pairs are made; equal texts have the stretches of the one that is compared."""
        marks = self.marks().select("doc_id", "start", (F.col("start") + F.col("size")).alias("upto"), "first")
        large = marks.select("doc_id", "start", "upto", F.explode(F.when(F.col("first") < F.col("doc_id"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("later"))
        return self._groups(_covered_of, COVERED).unionByName(large)


def islands(covered: DataFrame) -> DataFrame:
    """doc_id, later, start, upto: the stretches of COVERED put together, disjoint."""
    order = Window.partitionBy("doc_id", "later").orderBy("start", "upto")
    reach = F.max("upto").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = covered.withColumn("new", F.when(F.coalesce(F.col("start") > reach, F.lit(True)), 1).otherwise(0)).withColumn("island", F.sum("new").over(order))
    return marked.groupBy("doc_id", "later", "island").agg(F.min("start").alias("start"), F.max("upto").alias("upto")).drop("island")


def pairs(docs: DataFrame, min_chars: int = 200) -> DataFrame:
    """doc_id_a, doc_id_b: all pairs of documents with min_chars consecutive characters in common, smaller id first. Their number grows with the square of a class; doc_classes() has the same in one row for each document."""
    found = Passages(docs, min_chars)
    marks = found.marks().select("class", "doc_id")
    large = marks.alias("x").join(marks.alias("y"), "class").where("x.doc_id < y.doc_id").select(F.col("x.doc_id").alias("doc_a"), F.col("y.doc_id").alias("doc_b"))
    linked = found.matches().select("doc_a", "doc_b").unionByName(large).distinct()
    a, b = (found.members.select(F.col("rep").alias(f"doc_{k}"), F.col("doc_id").alias(f"own_{k}")) for k in "ab")
    between = linked.join(a, "doc_a", "left").join(b, "doc_b", "left").select(F.coalesce("own_a", "doc_a").alias("x"), F.coalesce("own_b", "doc_b").alias("y"))
    within = a.join(b, a["doc_a"] == b["doc_b"]).where("own_a < own_b").select(F.col("own_a").alias("x"), F.col("own_b").alias("y"))
    return between.unionByName(within).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def doc_classes(docs: DataFrame, min_chars: int = 200) -> DataFrame:
    """doc_id, class_id, copies, links: one row for each document that shares a passage. class_id: the smallest id with the same text; copies: how many have it; links: how many different texts share a passage with it, in
    groups of up to SMALL_GROUP one by one, in larger ones as the largest of its classes less itself (so at least so many). Linear in the places that are shared."""
    found = Passages(docs, min_chars)
    m = found.matches()
    few = m.select(F.col("doc_a").alias("rep"), F.col("doc_b").alias("other")).unionByName(m.select(F.col("doc_b").alias("rep"), F.col("doc_a").alias("other"))).distinct().groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    marks = cut(found.marks().select("class", "doc_id").distinct())
    sizes = marks.groupBy("class").agg((F.count(F.lit(1)) - 1).alias("links"))
    many = with_hot_keys(marks, sizes, ["class"]).groupBy(F.col("doc_id").alias("rep")).agg(F.max("links").alias("links"))
    links = few.unionByName(many).groupBy("rep").agg(F.max("links").alias("links"))
    of = found.members.withColumnRenamed("doc_id", "own")
    rows = links.join(of, "rep", "full").select(F.coalesce("own", "rep").alias("doc_id"), F.col("rep").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
    return rows.distinct()


def _sizes(docs: DataFrame, min_chars: int) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars)).select("doc_id", F.length("text").cast("long").alias("n_chars")).distinct()


def shares(docs: DataFrame, min_chars: int = 200) -> DataFrame:
    """doc_id, n_chars, shared_chars, share: how much of each text stands in other texts too, in passages of at least min_chars. Texts that share nothing have no row. No pairs are made."""
    found = Passages(docs, min_chars)
    covered = islands(found.covered().where("not later")).groupBy("doc_id").agg(F.sum(F.col("upto") - F.col("start")).alias("covered"))
    rows = _sizes(docs, min_chars).join(found.members.select("doc_id", "copies"), "doc_id", "left").join(covered, "doc_id", "left")
    shared = F.when(F.col("copies").isNotNull(), F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
    return rows.select("doc_id", "n_chars", shared.cast("long").alias("shared_chars"), (shared / F.col("n_chars")).alias("share")).where("shared_chars > 0")


# A sentence starts after a line break, and after a stop and a space.
_SENTENCE_START = re.compile(r"(?<=\n)|(?<=[.!?] )")


def first_only(docs: DataFrame, min_chars: int = 200) -> DataFrame:
    """doc_id, n_chars, sentences, removed, text: the documents without the sentences that lie whole in passages of at least min_chars that a document of a smaller id holds too. What is first stays; a copy of a whole text loses all of it.

    Every document with an id and a text has its row."""
    found = Passages(docs, min_chars)
    later = islands(found.covered().where("later")).groupBy("doc_id").agg(F.collect_list(F.struct("start", "upto")).alias("spans"))
    copies = found.members.where("doc_id <> rep").select("doc_id", F.lit(True).alias("copy"))
    rows = docs.select("doc_id", "text").where("doc_id is not null and text is not null").distinct().join(later, "doc_id", "left").join(copies, "doc_id", "left")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text, spans, copy in zip(b["doc_id"], b["text"], b["spans"], b["copy"]):
                spans = [] if spans is None else sorted((s["start"], s["upto"]) for s in spans)
                starts = [0, *(m.start() for m in _SENTENCE_START.finditer(text) if 0 < m.start() < len(text)), len(text)] if text else [0]
                kept, removed, k = [], 0, 0
                for a, e in zip(starts, starts[1:]):
                    while k < len(spans) and spans[k][1] < e:
                        k += 1
                    if copy is True or k < len(spans) and spans[k][0] <= a:
                        removed += 1
                    else:
                        kept.append(text[a:e])
                out.append((doc_id, len(text), len(starts) - 1, removed, "".join(kept)))
            yield plain(pd.DataFrame(out, columns=["doc_id", "n_chars", "sentences", "removed", "text"]))

    return rows.mapInPandas(read, "doc_id long, n_chars long, sentences int, removed int, text string")
