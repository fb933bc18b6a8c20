import random

import pytest

from quillfold.operators.dedup import near_duplicates


def sequential(rows, num=9, den=10, n=5):
    import re

    kept, dup = [], set()
    for key, text in sorted(rows):
        t = re.findall(r"[a-z0-9']+", text.lower())
        s = {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
        if s and any(den * len(s & k) >= num * len(s | k) for k in kept):
            dup.add(key)
        elif s:
            kept.append(s)
    return dup


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("klmnopq")
    rows, key = [], 0
    for _ in range(6):
        base = [word() for _ in range(rnd.randint(20, 90))]
        for _ in range(rnd.randint(1, 9)):
            t = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                t[rnd.randrange(len(t))] = word()
            rows.append((key, " ".join(t)))
            key += 1
    # a third of everything is one text, and a few rows are too short for any shingle
    rows += [(key + i, rows[0][1]) for i in range(len(rows) // 2)]
    rows += [(1000 + i, "too short") for i in range(3)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,pivots,hot", [(1, 4, 1000), (2, 1, 3), (3, 2, 2)])
def test_equals_the_sequential_rule(spark, seed, pivots, hot):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "id long, text string")
    got = near_duplicates(df, "id", "text", "id", pivots=pivots, hot_rows=hot)
    assert {r["id"] for r in got.filter("is_duplicate").collect()} == sequential(rows)
    assert got.count() == len(rows)


def test_lower_threshold(spark):
    rows = [(1, "run the tests and then push the branch to main"), (2, "run the tests and then push the branch to dev"), (3, "write the report for the whole team by friday noon")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = near_duplicates(df, "id", "text", "id", threshold=(7, 10), with_match=True)
    assert {(r["id"], r["duplicate_of"]) for r in got.filter("is_duplicate").collect()} == {(2, 1)}
    strict = near_duplicates(df, "id", "text", "id")
    assert strict.filter("is_duplicate").count() == 0


def test_only_rare_prefixes_leave_the_sets(spark):
    """What is shuffled of a set is a tenth of it, without shingles that nobody shares and with boilerplate last."""
    from quillfold.operators import dedup

    common = list(range(10_000, 10_060))
    rows = [(i, i, sorted([*common, *range(100 * i, 100 * i + 4), 5_000 + i // 2])) for i in range(40)]
    rows += [(100, 100, list(range(20_000, 20_065)))]
    df = spark.createDataFrame(rows, "_key long, _ord long, h array<long>").selectExpr("*", "size(h) AS n")
    found = {r["_key"]: r for r in dedup.prefixes(df, 9, 10).collect()}
    assert set(found) == set(range(40))  # nothing shares a shingle with row 100
    for i, r in found.items():
        assert r["alone"] == 4 and r["toks"] == [5_000 + i // 2, *common[:2]]  # 65 - 59 + 1 places in all
    index = dedup.prefix_index(df, df.filter("_key = 39").select("_key"), 9, 10)
    assert {(r["rep"], r["pos"], r["df"]) for r in index.filter("tok = 5003").collect()} == {(6, 4, 2), (7, 4, 2)}
    assert index.filter("tok = 5019").isEmpty() and {r["df"] for r in index.filter("tok = 10000").collect()} == {39}
