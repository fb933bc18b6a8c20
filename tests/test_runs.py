import random

import pytest
from pyspark.sql import functions as F

from quillfold.functions import runs
from quillfold.functions.text import tok_alnum, window_hashes


@pytest.mark.parametrize("n", [1, 3, 5])
def test_same_classes_as_the_column_functions(spark, monkeypatch, n):
    """Equal windows have equal hashes, others do not; order, nulls, empty texts and odd letters agree."""
    rnd = random.Random(n)
    words = ["a", "b", "it's", "K", "İx", "É", "x1", "''", "-", "\n", "tab\tbed", "9", "漢字"]
    texts = [None, "", "  ", "one", "a b c a b c"] + [" ".join(rnd.choice(words) for _ in range(rnd.randrange(30))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    mine = {r.id: r.h for r in runs.shingle_hashes(df.select("id", "t"), F.col("t"), n, distinct=False).collect()}
    theirs = {r.id: r.h for r in df.select("id", window_hashes(tok_alnum(F.coalesce("t", F.lit(""))), n).alias("h")).collect()}
    pairs = {(a, b) for i in mine for a, b in zip(mine[i], theirs[i], strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    sets = {r.id: r.h for r in runs.shingle_hashes(df.select("id", "t"), F.col("t"), n).collect()}
    assert sets == {i: sorted(set(h)) for i, h in mine.items()}


def test_long_texts_and_no_rows(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    df = spark.createDataFrame([(1, long), (2, "w1 w2 w3"), (3, long)], "id int, t string").coalesce(1)
    got = {r.id: r.h for r in runs.shingle_hashes(df, F.col("t"), 3, distinct=False).collect()}
    assert len(got[1]) == 199_998 and got[1] == got[3] and got[2] == [got[1][1]]
    assert runs.shingle_hashes(df.limit(0), F.col("t"), 3).collect() == []
