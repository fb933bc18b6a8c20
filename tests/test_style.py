import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillfold.functions.runs import Words
from quillfold.functions.text import CONTRACTION, count_matches, tok_alpha
from quillfold.operators import augment, delta, panel, retrieval, spelling, stylometry
from quillfold.operators.overlap import top_overlap
from quillfold.session import cut_lineage


def test_spelling_rules(spark):
    words = ["research", "finance", "verify", "commit", "together", "because", "writing"]
    dictionary = spark.createDataFrame([(w,) for w in words], "word string")
    text = "we reserach financing verified committed togehter zzz qwertyuiop Rathore because writng don't"
    docs = spark.createDataFrame([(1, text, "raw"), (2, text, "narrative")], "id int, text string, register string")
    got = {r["word"]: r["verdict"] for r in spelling.spell_check(docs, dictionary, "id").collect()}
    assert got == {"reserach": "misspelling", "togehter": "misspelling", "writng": "misspelling", "zzz": "out_of_vocabulary", "qwertyuiop": "out_of_vocabulary", "don": "out_of_vocabulary"}
    table = spelling.build_error_table(docs, dictionary, "id", "register")
    assert table.count() == 0  # each error is commoner than its unseen correction
    seen = docs.union(spark.createDataFrame([(3, "research research research together together together writing writing writing", "raw")], docs.schema))
    table = {(r["correct"], r["variant"], r["n"], tuple(r["registers"])) for r in spelling.build_error_table(seen, dictionary, "id", "register").collect()}
    assert table == {("research", "reserach", 2, ("narrative", "raw")), ("together", "togehter", 2, ("narrative", "raw")), ("writing", "writng", 2, ("narrative", "raw"))}


def test_one_edit_equals_enumeration(spark):
    rnd = random.Random(5)
    make = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(3, 6)))
    words, dictionary = sorted({make() for _ in range(60)}), sorted({make() for _ in range(60)})

    def edits(w):
        abc = "abcdefghijklmnopqrstuvwxyz"
        out = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)}
        out |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in abc} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in abc}
        return out

    want = {(w, e) for w in words for e in edits(w) & set(dictionary) if e != w and len(e) >= 3}
    as_df = lambda ws: spark.createDataFrame([(w,) for w in ws], "word string")
    got = {(r["word"], r["correct"]) for r in spelling.one_edit_matches(as_df(words), as_df(dictionary)).collect()}
    assert got == want


def test_mtld(one):
    varied = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    got = one(lambda c: stylometry.mtld_of_tokens(stylometry.tok_alpha(c)), "a b c", "the cat " * 30, varied)
    assert got[0] == 0.0
    assert 2 <= got[1] <= 4
    assert got[2] == 60.0


def test_features_of_one_pass_equal_the_columns(spark):
    """Texts are measured in one pass without their tokens leaving it; a text that is null is not measured."""
    rnd = random.Random(8)
    bits = ["One two.", "three!)", " \n\n", "\t", "it's", "We'll've", "a's't", "—", " – ", "x–y", "**bold** ", "\n**b**", ". .", "..", ";", ":", ",", "é", "İK'd", "\u00a0", "\x0b", "\x1c", "?\"  ", "lower. ", "word "]
    texts = ["", " \n", "a", "No end", "One. two! Three?", *("".join(rnd.choice(bits) for _ in range(rnd.randint(1, 90))) for _ in range(200))]
    docs = spark.createDataFrame([*enumerate(texts), (1000, None)], "id int, text string")
    out = stylometry.style_features(docs, "id")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "regexp" not in plan and "EvalPython" not in plan
    got = {r["id"]: r.asDict() for r in out.collect()}
    t = F.col("text")
    patterns = {
        "comma": ",", "semicolon": ";", "em_dash": "—", "period": r"\.", "colon": ":", "contraction": CONTRACTION,
        "en_dash": r"\w–\w|\s–\s|–\s", "doubled_period": r"\.\s+\.", "bold_mid_paragraph": r"(?<=[^\n\r])\*\*[^*\n]+\*\*",
    }
    told = docs.filter("id < 1000").select(
        "id", stylometry.sentence_stats(t).alias("s"), F.size(tok_alpha(t)).alias("n"), stylometry.mtld_of_tokens(tok_alpha(t)).alias("mtld"),
        *[count_matches(t, p).alias(name) for name, p in patterns.items()],
    )
    for r in told.collect():
        f, s = got[r["id"]], r["s"]
        assert (f["sentence_count"], f["word_count"], f["mtld"]) == (s["sentences"], r["n"], r["mtld"])
        assert [f[c] for c in ("mean_sentence_words", "sd_sentence_words", "p10_sentence_words", "p90_sentence_words")] == [s[c] for c in ("mean", "sd", "p10", "p90")]
        assert f["lowercase_start_rate"] == (s["lower"] / s["alpha"] if s["alpha"] else 0.0)
        for name in patterns:
            per = 1000 if name in ("en_dash", "doubled_period", "bold_mid_paragraph") else 100
            assert f[f"{name}_rate"] == r[name] / max(r["n"], 1) * per
    assert got[1000]["word_count"] is None and got[1000]["mtld"] is None and got[1000]["comma_rate"] is None


def test_known_words_are_not_counted_per_document(spark):
    """Counts per document and word follow the join with the verdicts."""
    docs = spark.createDataFrame([(1, "verify don't don qwertyuiop"), (1, "don"), (None, "don verify")], "id int, text string")
    checked = spelling.spell_check(docs, spark.createDataFrame([("verify",)], "word string"), "id")
    assert checked._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() == "Aggregate"
    got = {(r["id"], r["word"]): (r["n"], r["verdict"]) for r in checked.collect()}
    assert got == {(1, "don"): (3, "out_of_vocabulary"), (1, "qwertyuiop"): (1, "out_of_vocabulary"), (None, "don"): (1, "out_of_vocabulary")}


def test_tokens_of_bytes_equal_the_patterns(spark):
    """Tokens with their counts, and which are always capitalised, as the two patterns find them."""
    rnd = random.Random(4)
    bits = ["One", "one", "ONE", "iPhone", "Iphone", "'tis", "'Tis", "don't", "Don't", "É'a'", "é", "\u212a", "İ", "''", "'", "3d", "x_y", "–", "\x1c", "\n"]
    texts = ["", *(rnd.choice(["", " "]).join(rnd.choice(bits) + rnd.choice(["", " ", "."]) for _ in range(25)) for _ in range(120))]
    docs = spark.createDataFrame([*enumerate(texts), (1000, None)], "id int, text string")
    got = {(r["id"], r["raw"]): (r["word"], r["n"], r["proper"]) for r in spelling.token_table(docs, "id").collect()}
    want, low = {}, {r["id"]: r["low"] for r in docs.select("id", F.lower("text").alias("low")).collect()}
    for i, t in enumerate(texts):
        forms = re.findall("[A-Za-z][A-Za-z']*", t)
        for w, n in Counter(re.findall("[a-z']+", low[i])).items():
            same = [f for f in forms if f.lower() == w]
            want[i, w] = (w.split("'")[0], n, bool(same) and all(f[0].isupper() for f in same))
    assert got == want


def test_word_lists_tell_settled_words_once(monkeypatch):
    """Whatever a task holds, a word's rows have enough documents in all, or all its texts; settled words come without texts."""
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["the", "The", "of", "don't", "x'", f"w{chr(97 + rnd.randint(0, 25))}", f"Q{chr(97 + rnd.randint(0, 25))}"]) for _ in range(12)) for _ in range(150)]
    docs = Counter(w for t in texts for w in set(t.lower().split()))
    for held, few in ((1 << 20, 1), (60, 1), (60, 1 << 16), (1 << 20, 1 << 16)):
        monkeypatch.setattr(spelling, "HELD", held)
        monkeypatch.setattr(spelling, "FEW", few)
        lists, rows, parts = spelling.WordLists(8), [], 0
        tell = lambda: zip(*(c.to_pylist() for c in lists.told()), strict=True)  # noqa: E731, B023
        for i in range(0, 150, 10):
            if lists.add(pa.array(range(i, i + 10)), Words([t.encode() for t in texts[i : i + 10]])):
                rows += tell()
                parts += 1
        if lists.parts:
            rows += tell()
        assert (parts > 0) == (held == 60)
        told, sure = Counter(), {raw for raw, _, _, x in rows if not x}
        for raw, n, judged, x in rows:
            told[raw] += n
            assert not x or (n == len(x) and judged == any(not e["proper"] for e in x))
        assert sure and "don't" not in sure and "x'" not in sure
        for w, n in docs.items():
            assert told[w] >= 8 if w in sure else told[w] == n
            assert w not in sure or n >= 8
            if w not in sure:
                want = {i: (c, not any(f == w for f in t.split())) for i, t in enumerate(texts) if (c := t.lower().split().count(w))}
                assert {e["key"]: (e["n"], e["proper"]) for raw, _, _, x in rows if raw == w for e in x} == want


def test_verdicts_by_word_equal_those_by_token(spark):
    """Verdicts from lists of a word's texts, where settled words have none, are those from all tokens."""
    rnd = random.Random(9)
    pool = ["together", "Together", "writing", "don't", "DON", "reserach's", "research", "writ'ing"]
    rare = ["togehter", "writng", "Writng", "reserach", "zzzq", "qwertyuiop's", "Rathore", "researching"]
    texts = [" ".join([rnd.choice(pool) for _ in range(15)] + rnd.sample(rare, 2) * rnd.randint(0, 2)) for _ in range(60)]
    docs = spark.createDataFrame([*((i // 2, t) for i, t in enumerate(texts)), (None, "zzzq together"), (7, None), (8, "")], "id int, text string").repartition(3)
    table = cut_lineage(stylometry.measured(docs, "id", settled=15))
    lists = table.filter("raw IS NOT NULL")
    assert lists.filter("size(held) = 0 AND docs = 15").count() > 0 and table.filter("raw IS NULL").count() == docs.count()
    got = spelling.listed_verdicts(lists, 15, "id").groupBy("id", "word", "verdict").agg(F.sum("n").alias("n"))
    want = spelling.spell_check(docs, spelling.document_frequency_dictionary(docs, "id", 15), "id")
    cells = lambda df: sorted(map(str, df.select("id", "word", "verdict", "n").collect()))
    assert cells(got) == cells(want) and {r["verdict"] for r in want.collect()} == {"misspelling", "out_of_vocabulary"}
    told = lambda df: {r["id"]: r.asDict() for r in df.filter("id <> 7").collect()}
    assert told(stylometry.style_features(docs, "id", rows=table.filter("raw IS NULL"))).keys() == told(docs).keys()


def test_stems_as_rows_equal_the_variants(spark):
    words = ["s", "es", "bes", "runn", "running", "tried", "tries", "iest", "happily", "menment", "dd", "added", "sees", "nnness", "café's", "oed", "plain"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    want = {(r["word"], v) for r in df.select("word", spelling.morph_variants(F.col("word")).alias("v")).collect() for v in r["v"]}
    got = {(r["word"], r["v"]) for r in spelling.stems(df).collect()}
    assert got | {(w, w) for w in words} == want


def brute_chunks(words, least):
    out, n, start = [], 0, 0
    for i, w in enumerate(words):
        n += w
        if n >= least:
            out.append(list(range(start, i + 1)))
            start, n = i + 1, 0
    if start < len(words):
        rest = list(range(start, len(words)))
        if out:
            out[-1] += rest
        else:
            out.append(rest)
    return out


def test_chunks_equal_the_sequential_walk(spark):
    rnd = random.Random(3)
    sizes = [rnd.choice([0, 3, 40, 70, 130]) for _ in range(97)]
    rows = [("a", i, w) for i, w in enumerate(sizes)] + [("b", 0, 5), ("b", 1, 6)]
    df = spark.createDataFrame(rows, "g string, ord long, words int")
    for block, fan in ((4, 3), (25, 32), (1000, 2)):  # several levels of tables, one, none
        got = delta.aggregate_chunks(df, "g", "ord", min_words=100, block=block, fan=fan).collect()
        by = {}
        for r in got:
            by.setdefault((r["g"], r["chunk"]), []).append(r["ord"])
        assert [sorted(by[k]) for k in sorted(by) if k[0] == "a"] == brute_chunks(sizes, 100)
        assert sorted(by[("b", 0)]) == [0, 1]


def test_two_sample_profile_gives_root_two(spark):
    a, b = [0.01 * (i % 7) for i in range(150)], [0.02 * (i % 5) for i in range(150)]
    df = spark.createDataFrame([(a, b)], "a_freqs array<double>, b_freqs array<double>")
    both = spark.createDataFrame([(a,), (b,)], "freqs array<double>")
    d = delta.burrows_delta(df, delta.reference_profile(both)).first()["delta"]
    assert abs(d - 2**0.5) < 1e-9


def test_band(spark):
    rnd = random.Random(1)
    rows = [("big", i, [rnd.random() / 50 for _ in range(150)]) for i in range(12)] + [("few", i, [0.1] * 150) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, k int, freqs array<double>")
    one, two = (
        {r["g"]: r for r in delta.within_band(x, "g", "k", iterations=40).collect()} for x in (df, df.repartition(3))
    )
    assert one["few"]["underpowered"] and one["few"]["median"] is None
    assert one["big"]["iterations"] == 40 and one["big"]["low"] <= one["big"]["median"] <= one["big"]["high"]
    assert abs(one["big"]["median"] - two["big"]["median"]) < 1e-9
    judged = spark.createDataFrame([(0.25, 0.3, False), (0.9, 0.3, False), (0.2, 0.3, True)], "o double, h double, u boolean")
    got = [r[0] for r in judged.select(delta.judge_band(F.col("o"), F.col("h"), F.col("u"))).collect()]
    assert got == [True, False, None]


@pytest.mark.parametrize("few, bits", [(64, 10), (1, 3), (0, 10)])
def test_band_equals_the_plain_split(spark, monkeypatch, few, bits):
    """Halves found by counting are the halves of a sorted list, whatever the slices."""
    monkeypatch.setattr(delta, "CANDIDATES", few)
    monkeypatch.setattr(delta, "SLICE_BITS", bits)
    rnd = random.Random(5)
    rows = [("xy"[i % 2], i, [rnd.random() if p % 3 else 0.25 for p in range(150)]) for i in range(41)]
    df = spark.createDataFrame(rows, "g string, k int, freqs array<double>").repartition(3)
    got = {r["g"]: r for r in delta.within_band(df, "g", "k", iterations=25, seed=3).collect()}
    for g in "xy":
        docs = {k: np.array(f) for x, k, f in rows if x == g}
        sd = np.std(list(docs.values()), axis=0, ddof=1)
        draw = lambda it, k: int(hashlib.md5(f"3|band|{it}|{k}".encode()).hexdigest()[:8], 16)
        found = []
        for it in range(1, 26):
            order = sorted(docs, key=lambda k: (draw(it, k), k))
            half = len(order) // 2
            a, b = (np.mean([docs[k] for k in part], axis=0) for part in (order[:half], order[half:]))
            found.append(np.mean(np.abs(a - b)[sd > 1e-12] / sd[sd > 1e-12]))
        assert abs(got[g]["median"] - np.median(found)) < 1e-9 and abs(got[g]["low"] - np.percentile(found, 2.5)) < 1e-9
        assert got[g]["iterations"] == 25 and got[g]["documents"] == len(docs)


def test_few_clusters_widen_the_interval(spark):
    few = [("r", f"d{i % 2}", i % 2 == 0) for i in range(40)]
    many = [("r", f"d{i % 20}", (i * 7) % 3 == 0) for i in range(40)]
    width = lambda rows: (lambda r: r["ci_high"] - r["ci_low"])(
        panel.cluster_bootstrap(spark.createDataFrame(rows, "register string, author_doc string, correct boolean"), "register", iterations=300).first()
    )
    assert width(few) > width(many)
    votes = spark.createDataFrame([(1, 1, "A", 2.0, ""), (1, 2, "B", 4.0, "odd"), (2, 1, "none", 1.0, "x")], "pair_id int, ord int, vote string, confidence double, tell string")
    pairs = spark.createDataFrame([(1, "A"), (2, "B")], "pair_id int, author_side string")
    got = {r["pair_id"]: (r["guess"], r["correct"], r["confidence"], r["tell"]) for r in panel.majority_vote(votes, pairs).collect()}
    assert got == {1: ("A", True, 3.0, "odd"), 2: (None, None, None, None)}


def brute_mmr(queries, pool, n, budget, threshold):
    import re

    out = {}
    toks = lambda s: {w for w in re.findall(r"[a-z][a-z'-]+", s.lower()) if len(w) > 2}

    def grams(s):
        t = re.findall(r"[a-z0-9']+", s.lower())
        return {tuple(t[i : i + 5]) for i in range(len(t) - 4)}

    for qid, reg, seed in queries:
        q = toks(seed)
        ranked = sorted((r for r in pool if r[1] == reg), key=lambda r: (-len(toks(r[3]) & q) / max(len(toks(r[3])), 1) ** 0.5, r[0]))
        picked, total = [], 0
        for r in ranked:
            if len(picked) >= n:
                break
            if picked and total + r[2] > budget:
                continue
            g = grams(r[3])
            if any(g and grams(p[3]) and len(g & grams(p[3])) / len(g | grams(p[3])) > threshold for p in picked):
                continue
            picked.append(r)
            total += r[2]
        out[qid] = {p[0] for p in picked}
    return out


@pytest.mark.parametrize("budget", [1, 30, 1 << 16])
def test_mmr_equals_the_greedy_walk(spark, budget):
    rnd = random.Random(9)
    vocabulary = [a + b + "x" for a in "bcdfg" for b in "aeiou"]
    pool = []
    for i in range(40):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(8, 40))]
        if i % 4 and pool:
            words = pool[-1][3].split()
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        pool.append((i, "r" if i % 5 else "s", len(words), " ".join(words)))
    pool += [(90, "r", 0, None), (91, "r", 0, "")]
    queries = [(q, "r" if q % 3 else "s", " ".join(rnd.choice(vocabulary) for _ in range(5))) for q in range(6)] + [(7, "r", "nothing alike"), (8, "none", "bax"), (9, "r", None)]
    got = retrieval.exemplars_mmr(
        spark.createDataFrame(queries, "query_id long, register string, seed string"),
        spark.createDataFrame(pool, "doc_id long, register string, word_count long, text string"),
        max_words=70,
        shortlist=2,
        budget=budget,
    ).collect()
    mine = {q[0]: {r["doc_id"] for r in got if r["query_id"] == q[0]} for q in queries}
    assert mine == brute_mmr([(q, r, s or "") for q, r, s in queries], [(i, r, w, t or "") for i, r, w, t in pool], 3, 70, 0.3)


@pytest.mark.parametrize("budget", [1, 25, 400, 1 << 16])
def test_bounded_search_equals_all_pairs(spark, budget):
    """Rare and common tokens, one in every item, one in no item; two groups; ties."""
    rnd = random.Random(budget)
    items = []
    for i in range(120):
        tokens = {0} | {int(rnd.paretovariate(0.7)) % 200 + 1 for _ in range(rnd.randint(0, 30))}
        items.append((i, i % 2, sorted(tokens), math.sqrt(len(tokens)), rnd.choice([1.0, 0.7])))
    queries = [(q, q % 2, sorted({0, 999} | {rnd.randrange(1, 60) for _ in range(rnd.randint(1, 12))})) for q in range(12)]
    frames = spark.createDataFrame(queries, "query_id long, grp long, tokens array<long>"), spark.createDataFrame(items, "item long, grp long, tokens array<long>, root double, boost double")
    got = {(r.query_id, r["rank"]): (r.item, round(r.score, 9)) for r in top_overlap(*frames, 5, lambda df: F.log(F.lit(61.0) / (df + 0.5)), budget).collect()}
    want = {}
    df = {g: Counter(t for i in items if i[1] == g for t in i[2]) for g in (0, 1)}
    for q, g, asked in queries:
        scored = []
        for i, h, tokens, root, boost in items:
            shared = set(asked) & set(tokens)
            if h == g and shared:
                scored.append((-sum(round(math.log(61.0 / (df[g][t] + 0.5)) * 1e9) for t in shared) / 1e9 / root * boost, i))
        want |= {(q, k + 1): (i, round(-s, 9)) for k, (s, i) in enumerate(sorted(scored)[:5])}
    assert got == want


def test_noise_is_seeded_and_bounded(spark):
    docs = spark.createDataFrame([(1, "Because the research is because of research. " * 40)], "id int, text string")
    errors = spark.createDataFrame([("because", "becuase", 3), ("research", "reserach", 1)], "correct string, variant string, n long")
    first, again = (augment.inject_errors(docs, errors, "id", 10.0).first()["noisy"] for _ in range(2))
    assert first == again and first.count("ecuase") == 1 and first.startswith("Becuase") and first.count("reserach") == 1
    assert augment.inject_errors(docs, errors, "id", None).first()["noisy"] == docs.first()["text"]
    assert augment.inject_errors(docs, errors.limit(0), "id", 10.0).first()["noisy"] == docs.first()["text"]


@pytest.mark.parametrize("seed", [1, 2])
def test_noise_equals_repeated_searches(spark, seed):
    """Words that are variants of others, capitals, apostrophes, weights far apart; a draw looked up in a sorted list."""
    rnd = random.Random(seed)
    words = ["from", "form", "the", "teh", "Because", "don't", "dont", "it", "it's", "über", "a_b", "7th"]
    docs = [(i, " ".join(rnd.choice(words) + rnd.choice(["", ".", ","]) for _ in range(rnd.randrange(120)))) for i in range(30)] + [(99, None), (98, "")]
    table = [("from", "form", 900), ("form", "from", 30), ("the", "teh", 5), ("because", "becuase", 1), ("don't", "dont", 40), ("it", "ti", 0), ("nowhere", "x", 7), ("dont", "don't", None)]
    errors = spark.createDataFrame(table, "correct string, variant string, n long")
    got = {r.id: r.noisy for r in augment.inject_errors(spark.createDataFrame(docs, "id int, text string"), errors, "id", 60.0, seed).collect()}
    ordered = sorted(((c, v, max(1, n or 1)) for c, v, n in table), key=lambda r: (-r[2], r[0], r[1]))
    total = sum(r[2] for r in ordered)
    for key, text in docs:
        now, used = text or "", set()
        budget = math.floor(60.0 / 1000 * len((text or "").split()) + 0.5)
        for k in range(12 * budget):
            at = math.floor(int(hashlib.md5(f"{seed}|{key}|{k}".encode()).hexdigest()[:8], 16) / 4294967296.0 * total)
            for c, v, n in ordered:
                if at < n:
                    break
                at -= n
            if len(used) >= budget or c in used:
                continue
            hit = re.search(rf"(?<![A-Za-z0-9_]){re.escape(c)}(?![A-Za-z0-9_])", now, re.I | re.A)
            if hit:
                new = v[0].upper() + v[1:] if hit.group()[0] == hit.group()[0].upper() else v
                now, used = now[: hit.start()] + new + now[hit.end() :], used | {c}
        assert got[key] == (now if text else text)


def test_weighted_draws_cover_the_table(spark):
    rnd = random.Random(4)
    table = [(f"c{i:03d}", "v", rnd.choice([1, 1, 2, 500])) for i in range(200)]
    errors = spark.createDataFrame(table, "correct string, variant string, n long")
    rows = augment.cumulative_weights(errors).orderBy("low").collect()
    want, at = [], 0
    for c, v, n in sorted(table, key=lambda r: (-r[2], r[0])):
        want.append((c, v, at, at + n))
        at += n
    assert [(r.correct, r.variant, r.low, r.high) for r in rows] == want and {r.total for r in rows} == {at}
    rolls = spark.createDataFrame([(i, i / 997) for i in range(997)], "i int, roll double")
    got = augment.weighted_draws(rolls, errors).collect()
    assert {(r.i, r.correct) for r in got} == {(i, next(c for c, _, a, b in want if a <= math.floor(i / 997 * at) < b)) for i in range(997)} and len(got) == 997


def test_draws_are_the_keyed_draws(spark, monkeypatch):
    """Many digests at once, of keys of all lengths, against one by one, and without a digest call per short key."""
    import hashlib

    keys = [str(i) for i in range(300)] + ["", "é漢", "x" * 40, "y" * 47, "y" * 48, "z" * 60, "w" * 200]
    want = [[int(hashlib.md5(f"1|band|{it}|{k}".encode()).hexdigest()[:8], 16) for it in range(1, 121)] for k in keys]
    assert delta._draws(1, keys, 120).tolist() == want
    assert delta._draws(1, [], 5).shape == (0, 5)
    monkeypatch.setattr(delta, "hashlib", None)
    assert delta._draws(1, keys[:300], 120).tolist() == want[:300]
