from pyspark.sql import functions as F

from millrace.llm import copies, records
from tests.conftest import rows


def key(*parts):
    return tuple("".join(c for c in (p or "").casefold() if c.isalnum()) for p in parts)


def test_against_brute_force(spark):
    base = ["Hello, World 1", "hello world 1", "HELLO\tWORLD\n1!", "Größe", "GRÖSSE", "größer", "", None, "...", "été", "ÉTÉ", "1.5", "15", "x" * 100_000, "X" * 100_000]
    data = [(k, a, b, base[(k * 3) % 4]) for k, (a, b) in enumerate((a, b) for a in base for b in base[:5])]
    df = spark.createDataFrame(data, "id long, p string, c string, r string")
    got = set(rows(copies.copy_members(copies.keyed(df, "id", ["p", "c", "r"]))))
    groups = {}
    for k, p, c, r in data:
        groups.setdefault(key(p, c, r), []).append(k)
    assert got == {(min(v), x) for v in groups.values() for x in v if x != min(v)}
    counts = {r.record_id: r.copies for r in copies.copy_groups(copies.keyed(df, "id", ["p", "c", "r"])).collect()}
    assert counts == {min(v): len(v) for v in groups.values()}


def test_hot_group(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "Same!").otherwise(F.col("id").cast("string")).alias("p"))
    m = copies.copy_members(copies.keyed(df, "id", ["p"]))
    assert m.where("record_id = 0").count() == 9_999 and m.count() == 9_999


def test_hot_group_by_broadcast(spark):
    df = spark.range(33_000).select("id", F.when(F.col("id") % 3 == 0, "Same!").otherwise(F.col("id").cast("string")).alias("p"))
    assert copies.copy_members(copies.keyed(df, "id", ["p"])).count() == 10_999


def test_nothing_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (1, "a"), (2, "b")], "id long, p string")
    assert copies.copy_members(copies.keyed(df, "id", ["p"])).count() == 0
    assert copies.copy_members(copies.keyed(df.where("false"), "id", ["p"])).count() == 0
    assert copies.copy_groups(copies.keyed(df.where("false"), "id", ["p"])).count() == 0


def test_collision_is_seen(spark):
    keys = spark.createDataFrame([(1, bytearray(b"k"), 7), (2, bytearray(b"k"), 8), (3, bytearray(b"k"), 8)], "id long, key binary, check long")
    g = copies.copy_groups(keys).orderBy("record_id").collect()
    assert [(r.record_id, r.copies, r.collided) for r in g] == [(1, 1, True), (2, 2, True)]
    assert rows(copies.copy_members(keys)) == [(2, 3)]


def test_record_shapes(spark):
    chat = spark.createDataFrame([(1, "s", "p", [("a", "assistant"), ("p", "user")], [("sys", "system"), ("p", "user"), ("b", "assistant")]), (2, None, None, [], None)], "row_id long, source string, prompt string, chosen array<struct<content:string,role:string>>, rejected array<struct<content:string,role:string>>")
    assert rows(records.chat_pairs(chat), "row_id") == [(1, "s", "p", "a", "b"), (2, None, None, None, None)]
    lines = ['{"rejected": "b", "chosen": [{"content": "a", "role": "assistant"}], "prompt": "p\\u00e9", "extra": 1}', '{"prompt": "x", "chosen": "[1] note", "rejected": null}', "{bad", None]
    raw = spark.createDataFrame([(k, x, "s") for k, x in enumerate(lines)], "row_id long, raw string, source string")
    assert rows(records.raw_pairs(raw), "row_id") == [(0, "s", "pé", "a", "b"), (1, "s", "x", "[1] note", None), (2, "s", None, None, None), (3, "s", None, None, None)]


def test_ways_to_write_a_letter(spark):
    """Composed and decomposed accents and full-width letters are the same; an accented letter isn't its plain one."""
    df = spark.createDataFrame([(1, "caf\u00e9 ABC 12"), (2, "cafe\u0301 abc 12"), (3, "CAF\u00c9 \uff21\uff22\uff23 \uff11\uff12"), (4, "cafe abc 12"), (5, "x\u00b2"), (6, "x2")], "id long, p string")
    assert sorted(rows(copies.copy_members(copies.keyed(df, "id", ["p"])))) == [(1, 2), (1, 3)]
