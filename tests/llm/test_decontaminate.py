from __future__ import annotations

from llm_helpers import no_documents, odd_documents, prose

from quillfold.llm import decontaminate as d

ITEMS = [
    (1, "A train leaves with 40 passengers and Alice rides it for 3 hours at 75 km before 40 more board the train."),
    (2, prose(77, 40)), (3, prose(78, 6)), (4, "too short item"), (5, None), (6, ""), (None, prose(79, 30)), (7, prose(77, 40)),
    (8, "Then each of the red birds and the 3.14 blue cats and 1,000 mice went home."),
]
PLANTED = {
    10: "before it. A train leaves with 52 passengers and Bob rides it for 4 hours at 80 miles before 52 more board the train. after",
    11: prose(1, 30) + ". A train leaves with 52 passengers and Bob rides it for 4 hours at 80 km before 53 more board the train.",  # 40 -> 52 and 53
    12: prose(2, 300) + "\n" + prose(77, 40).upper() + "!! " + prose(3, 300),
    13: " ".join(prose(77, 40).split()[:16]) + " and then " + prose(4, 50),
    14: " ".join(prose(77, 40).split()[:9]) + " and then " + prose(4, 50),  # too little of it
    15: prose(5, 20) + " " + prose(78, 6) + " " + prose(6, 20),
    16: prose(5, 20) + " too short item " + prose(6, 20),
    17: prose(8, 200),
    18: "So then each of the red birds and the 2.5 blue cats and 20 mice went home again.",
    19: "ITEM: " + prose(77, 40).upper() + ".",
}


def test_hits(spark):
    docs = spark.createDataFrame(list(PLANTED.items()), "doc_id long, text string").unionByName(odd_documents(spark).select("doc_id", "text"))
    bench = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, code string")
    found = {r.doc_id: (r["items"], r.verbatim) for r in d.contaminated(docs, bench).collect()}
    assert found == {10: ([1], False), 12: ([2], True), 13: ([2], True), 15: ([3], True), 18: ([8], False), 19: ([2], True)}
    kept = d.without_contaminated(docs, bench)
    assert {r.doc_id for r in kept.collect()} == (set(PLANTED) - set(found)) | {r.doc_id for r in odd_documents(spark).collect()}
    odd = odd_documents(spark)
    assert sorted(map(repr, d.without_contaminated(odd, bench).collect())) == sorted(map(repr, odd.collect()))


def test_verbatim_items_are_found_like_by_search(spark):
    """Every document that holds a whole item is found, no other, wherever it stands and however often it is repeated."""
    items = [(i, prose(1000 + i, 12 + i % 30)) for i in range(40)]
    docs = []
    for i in range(200):
        held = items[i % 40][1] if i % 3 == 0 else ""
        docs.append((i, f"{prose(i, i % 50)} {held} {prose(-i, (7 * i) % 90)}"))
    docs += [(9, docs[9][1]), (None, docs[12][1])]
    found = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = sorted(((i, [k for k, t in items if f" {t} " in x]) for i, x in docs if any(f" {t} " in x for _, t in items)), key=repr)
    assert sorted(((r.doc_id, r["items"]) for r in found), key=repr) == want


def test_windows_shared_by_many_items(spark):
    """Every item is found of which a document holds twelve words running, whatever it shares with other items."""
    base = prose(5, 12)
    items = [(i, f"{base} {prose(100 + i, 3)}") for i in range(5)] + [(50, base)]
    docs = [(1, f"x {base} {prose(103, 3)} y"), (2, f"x {base} y")]
    found = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    told = {r.doc_id: r["items"] for r in found}
    runs = lambda t: {tuple(t.split()[k : k + 12]) for k in range(len(t.split()) - 11)}
    assert told == {i: [k for k, t in items if runs(t) & runs(x)] for i, x in docs}
    assert told[2] == [0, 1, 2, 3, 4, 50]


def test_families_of_any_size(spark):
    """A stem brings up every item of its family, verbatim or re-parameterised, with 32 items as with 40."""
    for size in (32, 40):
        stem = "{} trains leave the old station and each of them carries {} tired people home over {} long miles of rail in the night."
        items = [(i, f"{stem.format(12, i + 50, 7)} {prose(100 + i, 10)}") for i in range(size)] + [(99, f"{stem.format(1, 2, 3)} {prose(7, 4)}")]
        told = f"before. {stem.format(31, 45, 8)} {prose(900, 10)}"
        docs = [(1, told), (2, f"see: {stem.format(12, 53, 7)}"), (3, "and each of them carries 4 tired people away"), (4, f"x {prose(103, 10)} y")]
        found = {r.doc_id: r["items"] for r in d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
        everyone = [*range(size), 99]
        assert found == {1: everyone, 2: everyone}


def test_verbatim_copies_of_figures_names_and_unspaced_scripts(spark):
    items = [
        (1, "Compute 12 + 34 - 5 * 6 / 7 = 8 and 9"), (2, "we met Alice, Bob, Carol, Dave, Erin, Frank, Grace, Heidi and Ivan"), (3, "3 4 km 7 9"),
        (4, "\u6c34\u7684\u6cb8\u70b9\u662f\u591a\u5c11\u5ea6\uff1f"), (5, "\u65e5\u672c\u306e\u9996\u90fd\u306f\u3069\u3053\u3067\u3059\u304b\u3002"),
        (6, "1990 12 4.5 1,000 77 1991 13 4.7 1,020 78 1992 15 4.9 1,040 80 1993 19 5.1 1,050 81"),
    ]
    docs = [(i, f"{prose(i, 20)} so {t} so {prose(-i, 20)}") for i, t in items]
    docs += [
        (7, "so \u8bf7\u95ee\u6c34\u7684\u6cb8\u70b9\u662f\u591a\u5c11\u5ea6\u3002"), (8, "\u300c\u65e5\u672c\u306e\u9996\u90fd\u306f\u3069\u3053\u3067\u3059\u304b\u300d"),
        (11, "Compute 12 + 34 - 5 * 6 / 7 = 8 and 10"), (12, "so 3 4 km 7 8 so"), (14, "\u6c34\u7684\u6cb8\u70b9\u662f"),
    ]
    found = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r["items"], r.verbatim) for r in found} == {**{i: ([i], True) for i in range(1, 7)}, 7: ([4], True), 8: ([5], True)}


def test_capitals_after_any_mark(spark):
    items = [(1, "What is the capital of France?"), (2, "Compute the sum of all primes below ten"), (3, "Alice owns five apples and seven green pears"), (4, "Sort each list of words.\nThen print every second word of it.")]
    marks = ["- ", "* ", "1) ", "**", "\u2014 ", "\u201c", "so ", "x, ", "end. ", "q: ", "(", "\n", "\u2022 ", "| "]
    docs, want = [], {}
    for i, (item, text) in enumerate(items):
        for k, mark in enumerate(marks):
            docs.append((100 * i + k, f"it said {mark}{text} and so on"))
            want[100 * i + k] = ([item], True)
            if item == 3:
                docs.append((900 + k, f"it said {mark}{text.replace('Alice', 'Bob')} and so on"))
                want[900 + k] = ([item], False)
    docs += [(1000, f"it said {items[3][1].replace(chr(10), ' ')} so"), (1001, "it said. What is the price of France? so"), (1002, "Where is the best capital of France? so")]
    want[1000] = ([4], True)
    found = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r["items"], r.verbatim) for r in found} == want


def test_no_rows(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(no_documents(spark), bench).collect() == []
    assert d.contaminated(odd_documents(spark), bench).collect() == []
    assert len(d.without_contaminated(odd_documents(spark), bench).collect()) == 11
