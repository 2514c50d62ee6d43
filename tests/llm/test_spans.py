import random

from pyspark.sql import functions as F

from millrace.llm import spans
from tests.conftest import rows


def brute(docs, n):
    by = {}
    for d, t in docs:
        for k in range(len(t or "") - n + 1):
            by.setdefault(t[k : k + n], set()).add(d)
    return {(a, b) for s in by.values() for a in s for b in s if a < b}


def shared(docs, n):
    by = {}
    for d, t in docs:
        for k in range(len(t or "") - n + 1):
            by.setdefault(t[k : k + n], set()).add(d)
    out = {}
    for d, t in docs:
        hit = set()
        for k in range(len(t or "") - n + 1):
            if len(by[t[k : k + n]]) > 1:
                hit |= set(range(k, k + n))
        if hit:
            out[d] = len(hit)
    return out


def made(seed, n_docs=120, n=60):
    rng = random.Random(seed)
    line = lambda: " ".join("".join(rng.choice("abcdefgé😀") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 14))) + rng.choice([". ", "\n", " ", "? "])
    boiler = "".join(line() for _ in range(3))
    docs = []
    for d in range(n_docs):
        t = "".join(line() for _ in range(rng.randint(0, 12)))
        if d % 3 == 0 and docs:
            src = docs[rng.randrange(len(docs))][1]
            size = rng.choice([n - 1, n, n + 1, 2 * n])
            a = rng.randint(0, max(0, len(src) - size))
            b = rng.randint(0, len(t))
            t = t[:b] + src[a : a + size] + t[b:]
        if d % 5 == 0:
            t = boiler + t
        if d % 11 == 0 and docs:
            t = docs[rng.randrange(len(docs))][1]
        if d % 17 == 0:
            t += "ab" * rng.randint(20, 80)
        docs.append((d, t))
    return docs + [(n_docs, None), (n_docs + 1, ""), (n_docs + 2, "-" * (n - 1)), (n_docs + 3, "-" * (3 * n)), (n_docs + 4, "-" * (2 * n))]


def test_against_brute_force(spark):
    for seed in (1, 2, 3):
        docs = made(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hash", F.lit("clash"))
        got = rows(spans.pairs(df, 60))
        assert len(got) == len(set(got)) and set(got) == brute(docs, 60)


def test_large_groups(spark, monkeypatch):
    monkeypatch.setattr(spans, "SMALL_GROUP", 3)
    monkeypatch.setattr(spans, "HOT_IN_BLOCK", 4)
    docs = made(4)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert set(rows(spans.pairs(df, 60))) == brute(docs, 60)


def test_shares(spark):
    docs = made(5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in spans.shares(df, 60).collect()}
    want = shared(docs, 60)
    assert {k: r.shared_chars for k, r in got.items()} == want
    assert all(abs(r.share - r.shared_chars / r.n_chars) < 1e-12 for r in got.values())


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spans.pairs(df).count() == 0 and spans.shares(df).count() == 0


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK", 3000)
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh .\n") for _ in range(20_000))
    docs = [(1, long), (2, "x" * 50 + long[7_950:8_200] + "y" * 50), (3, long[2_900:3_150]), (4, "z" * 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert set(rows(spans.pairs(df))) == {(1, 2), (1, 3)}


def later(docs, n):
    """For each text the places that a text of a smaller id holds, in stretches of n."""
    first, out = {}, {}
    for d, t in sorted(docs):
        for k in range(len(t or "") - n + 1):
            first.setdefault(t[k : k + n], d)
    for d, t in docs:
        out[d] = {p for k in range(len(t or "") - n + 1) if first[t[k : k + n]] < d for p in range(k, k + n)}
    return out


def test_first_only(spark, monkeypatch):
    docs = made(6)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    gone, want = later(docs, 60), {}
    for d, t in docs:
        if t is not None:
            starts = [k for k in range(len(t)) if k == 0 or t[k - 1] == "\n" or k > 1 and t[k - 1] == " " and t[k - 2] in ".!?"]
            parts = list(zip(starts, [*starts[1:], len(t)]))
            kept = [(a, e) for a, e in parts if not gone[d] >= set(range(a, e))]
            want[d] = (len(t), len(parts), len(parts) - len(kept), "".join(t[a:e] for a, e in kept))
    for small in (256, 3):
        monkeypatch.setattr(spans, "SMALL_GROUP", small)
        assert {r[0]: tuple(r[1:]) for r in rows(spans.first_only(df, 60))} == want


def test_classes(spark, monkeypatch):
    docs = made(7)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    links, texts = {}, dict(docs)
    for a, b in brute(docs, 60):
        for x, y in ((a, b), (b, a)):
            links.setdefault(x, set()).update({texts[y]} - {texts[x]})
    same = lambda d: [o for o, t in docs if t == texts[d]]
    want = {(d, min(same(d)), len(same(d)), len(n)) for d, n in links.items()}
    monkeypatch.setattr(spans, "SMALL_GROUP", 100_000)
    assert set(rows(spans.doc_classes(df, 60))) == want
    monkeypatch.setattr(spans, "SMALL_GROUP", 3)
    got = rows(spans.doc_classes(df, 60))
    assert {r[:3] for r in got} == {r[:3] for r in want} and all(n <= len(links[d]) for d, _, _, n in got)


def test_long_passages(spark):
    """Sizes of runs that don't fit in eight bits."""
    rng = random.Random(12)
    docs = made(9, 60, 600)
    docs += [(1000 + k, "".join(rng.choice("abc d.\n") for _ in range(3000))) for k in range(6)]
    docs += [(2000 + k, docs[-1 - k][1][500 : 1100 + k] + "tail") for k in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert set(rows(spans.pairs(df, 600))) == brute(docs, 600)
    assert {r.doc_id: r.shared_chars for r in spans.shares(df, 600).collect()} == shared(docs, 600)


def test_run_in_a_twentieth_of_all_texts(spark):
    """Frequent runs of a block are spread; no hash gets more rows from a block than HOT_IN_BLOCK."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    notice = " ".join(word() for _ in range(60)) + "."
    docs = [(d, " ".join(word() for _ in range(80)) + (" " + notice if d % 20 == 0 else "")) for d in range(2000)]
    sent = spans._sent(spans.runs_of(__import__("numpy").arange(2000), [t for _, t in docs], *spans.window_of(200)))
    assert sent[sent["place"] >= 0].groupby("hash").size().max() < spans.HOT_IN_BLOCK
    found = spans.shares(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id for r in found.collect()} == {d for d in range(2000) if d % 20 == 0}


def test_groups_come_in_any_batches():
    import pandas as pd

    rng = random.Random(14)
    data = sorted((rng.randrange(40), rng.randrange(5), k, rng.random() < 0.03) for k in range(300))
    frame = pd.DataFrame({"hash": [h for h, *_ in data], "doc_id": [d for _, d, *_ in data], "place": [1 << 62 if s else k for *_, k, s in data]})
    docs, stands = {}, {h for h, *_, s in data if s}
    for h, d, *_ in data:
        docs.setdefault(h, set()).add(d)
    want = [k for h, _, k, s in data if not s and (len(docs[h]) > 1 or h in stands)]
    for size in (1, 7, 300):
        groups, got = spans._Groups(), []
        for at in range(0, 300, size):
            got += groups.take(frame.iloc[at : at + size].reset_index(drop=True))["place"].tolist()
        if groups.held is not None:
            got += groups.take(groups.held.iloc[:0], at_end=True)["place"].tolist()
        assert sorted(got) == sorted(want)
