from quillfold.functions import cleaning as C
from quillfold.functions import text as T


def test_fences_and_runs(one):
    assert one(C.strip_fenced_code, "a\n```py\nx\n```\nb", "a\n~~~\nopen") == ["a\n\n\nb", "a\n\n"]
    block = "a\n    x\n    y\n    z\nb"
    short = "a\n    x\n    y\nb"
    assert one(C.strip_indented_blocks, block, short, "a\n\tx\n\ty\n\tz") == ["a\n\nb", short, "a\n"]
    listing = "Start here.\none two\nthree four\nfive six\nseven eight\nDone."
    assert one(C.strip_pasted_output, listing, "Traceback\nkeep me.", "one\ntwo\nthree\nfine.") == [
        "Start here.\nDone.", "keep me.", "one\ntwo\nthree\nfine.",
    ]


def test_output_line_ends_a_run(one):
    text = "one two\nthree four\nPASS all\nfive six\nseven eight"
    assert one(C.strip_pasted_output, text) == ["one two\nthree four\nfive six\nseven eight"]


def test_masks(one):
    assert one(C.mask_urls_paths, "see https://a.b/c now", "in /usr/local/bin or ~/notes/x") == ["see [url] now", "in [path] or [path]"]
    assert one(C.mask_file_refs, "look @src/App.jsx here", "at main.ts:33:2 ok", "a b@c.d") == ["look here", "at [ref] ok", "a b@c.d"]
    assert one(C.collapse_ws, "  a \t b\n\n\n\nc ") == ["a b\n\nc"]


def test_verdicts(spark):
    rows = [
        (1, "This is a perfectly ordinary sentence that somebody typed by hand."),
        (2, "too short"),
        (3, "```\n" + "x = 1\n" * 60 + "```\nok then"),
        (4, "1234 5678 %% 99 88 77 66 55 44 33 22 11 00."),
        (5, ""),
    ]
    out = {r["i"]: r["rejected"] for r in C.clean_text(spark.createDataFrame(rows, "i int, text string")).collect()}
    assert out == {1: None, 2: "too-short", 3: "mostly-stripped", 4: "mostly-symbols", 5: "mostly-stripped"}


def test_passages(one):
    long = "One two three. " * 50
    got = one(lambda c: C.normalize_passage(c, 10), "# Head\n- **item** one", long, "word " * 30)
    assert got[0] == "item one"
    assert got[1] == "One two three. One two three. One two three."
    assert got[2] == " ".join(["word"] * 10)


def test_tokenisers_stay_apart(one):
    s = "Don't-stop 42 Ächt!"
    assert one(T.tok_alnum, s) == [["don't", "stop", "42", "cht"]]
    assert one(T.tok_alpha, s) == [["don't", "stop", "cht"]]
    assert one(T.tok_retrieval, s) == [["don't-stop", "cht"]]
    assert one(T.sentences_plain, 'He left." She stayed. Ok') == [['He left." She stayed.', "Ok"]]
    assert one(T.sentences_quote, 'He left." She stayed. Ok') == [["He left.", "She stayed.", "Ok"]]


def test_windows(one):
    assert one(lambda c: T.windows(T.tok_alnum(c), 3), "a b c d", "a b") == [["a b c", "b c d"], []]


def test_draw_matches_md5(spark):
    import hashlib

    got = spark.range(1).select(T.draw(7, "p", "k")).first()[0]
    assert got == int(hashlib.md5(b"7|p|k").hexdigest()[:8], 16) / 2**32


def test_a_filter_on_the_verdict_cleans_once(spark):
    """A text goes through the steps once, whatever is asked of the result."""
    texts = spark.range(3).selectExpr("id", "concat('It was é 1, 2. ', repeat('words here ', CAST(8 * id AS INT)), 'at main.ts:33:2 or x.ts:y') AS text")
    out = C.clean_text(texts).filter("rejected IS NULL").select("id", "word_count", "alpha_ratio")
    assert out._jdf.queryExecution().executedPlan().toString().count("https?://") == 1
    one = "It was é 1, 2. " + "words here " * 8 + "at [ref] or x.ts:y"
    alpha = sum(c.isascii() and (c.isalpha() or c in "' ") for c in one) / len(one)
    assert [(r.id, r.word_count) for r in out.collect()] == [(0, 9), (1, 25), (2, 41)] and abs(out.collect()[1].alpha_ratio - alpha) < 1e-12
    none = C.clean_text(spark.createDataFrame([(None,)], "text string")).first()
    assert (none.clean, none.stripped_ratio, none.alpha_ratio, none.word_count, none.rejected) == (None, 1.0, 0.0, None, "mostly-stripped")
