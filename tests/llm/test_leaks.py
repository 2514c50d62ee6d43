import random
import re

import pytest

from millrace.llm import leaks
from tests.conftest import rows

WORD = re.compile(r"[^\W_]+")


def brute(docs, items, n=13):
    out = set()
    for i, t in items:
        w = WORD.findall((t or "").lower())
        for k in range(len(w) - n + 1):
            own = " " + " ".join(w[k : k + n]) + " "
            out |= {(i, d) for d, x in docs if x and own in " " + " ".join(WORD.findall(x.lower())) + " "}
    return out


def made(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"word{k}" for k in range(60)] + ["a", "of", "é", "42", "Straße"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(text(rng.randint(5, 40)))) for k in range(40)] + [(99, None), (98, "")]
    docs = []
    for d in range(300):
        w = text(rng.randint(0, 120))
        if d % 4 == 0:
            src = items[rng.randrange(40)][1].split()
            n = rng.choice([12, 13, 14, len(src)])
            a = rng.randint(0, max(0, len(src) - n))
            w[len(w) // 2 : len(w) // 2] = src[a : a + n]
        docs.append((d, rng.choice([" ", ", ", "\r\n", " -- ", "&amp;"]).join(x.upper() if d % 3 else x for x in w)))
    return docs + [(1000, None), (1001, ""), (1002, "x" * 200_000)], items


def test_against_brute_force(spark):
    docs, items = made()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("text", "text")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 20
    assert set(rows(leaks.leaks(d, i))) == want
    assert set(rows(leaks.leaks(d, i, block_chars=2000))) == want


def test_nothing(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert leaks.leaks(d.where("false"), i).count() == 0 and leaks.leaks(d, i.where("false")).count() == 0 and leaks.leaks(d, i).count() == 0


def test_with_edits(spark):
    passage = "the quick brown fox jumps over the lazy dog while seven small birds watch from a high wall"
    docs = [(1, "before " + passage.replace("brown", "bruwn") + " after"), (2, passage), (3, passage.replace("quick brown fox", "slow green cat").replace("seven small", "eight large")), (4, passage.replace("lazy ", "lazzy "))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(7, passage)], "item_id long, text string")
    assert sorted(r.doc_id for r in leaks.leaks(d, i, words=17, q=8, edits=2).collect()) == [1, 2, 4]
    assert [r.doc_id for r in leaks.leaks(d, i, words=17).collect()] == [2]


def distance_within(passage, text):
    """Least edits of a passage against any part of a text, and the diagonals where such alignments start."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_banded():
    codes = lambda t: leaks.code_points([t])[0]
    run = lambda p, t, low, high, edits: leaks.banded(codes(p), codes(t), leaks.np.array([(0, len(p))]), low, high, edits)
    assert run("abc", "xxabcx", 2, 2, 0) and run("abcd", "xxabdx", 2, 2, 1) and not run("abcd", "xxaxyx", 2, 2, 1) and not run("abc", "", 0, 3, 1)
    rng = random.Random(5)
    for _ in range(400):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(3, 9))) for _ in range(2))
        for edits in (0, 1, 2):
            assert run(p, t, -len(p), len(t), edits) == (distance_within(p, t) <= edits)


def test_edits_against_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    items = [(k, " ".join(word() for _ in range(20))) for k in range(12)]
    docs = []
    for d in range(120):
        own = [word() for _ in range(rng.randint(5, 30))]
        if d % 2:
            passage = list(" ".join(items[rng.randrange(12)][1].split()[3:16]))
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(1, len(passage) - 1)
                passage[at : at + rng.randint(0, 1)] = rng.choice(["x", "", "y"])
            own[len(own) // 2 : len(own) // 2] = ["".join(passage)]
        docs.append((d, " ".join(own)))
    want = set()
    for i, t in items:
        w = t.split()
        for d, x in docs:
            if any(distance_within(" " + " ".join(w[k : k + 13]) + " ", leaks.words_of(x)) <= 2 for k in range(len(w) - 12)):
                want.add((i, d))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(want) > 20
    assert set(rows(leaks.leaks(d, i, q=8, edits=2))) == want
    assert set(rows(leaks.leaks(d, i, q=8, edits=2, block_chars=10))) == want


def test_too_short_for_the_lemma(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    with pytest.raises(ValueError):
        leaks.leaks(d, i, words=2, q=16)
