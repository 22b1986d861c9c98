"""Hard negatives, languages and phrases against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventflow.llm import collocations as C
from eventflow.llm import hard_negatives as H
from eventflow.llm import language_id as L
from eventflow.llm import queries as Q

# hard negatives


def mined(rows, is_anchor, positives=5, negatives=3):
    """What the contract says, row by row; rows equal in id, label and scaled vector once."""
    own = set()
    for i, vector, label in rows:
        if i is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        own.add((i, label, tuple(math.floor(256 * float(np.float32(x))) for x in vector)))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, q in own:
        if not is_anchor(i):
            continue
        scored = sorted((-dot(q, p), j, m) for j, m, p in own if j != i)
        for s, j, _ in [r for r in scored if r[2] == label][:positives]:
            near = [(t, k) for t, k, m in scored if m != label and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(i, j, n, k, -s, -t) for n, (t, k) in enumerate(near[:negatives], 1)]
    return sorted(out)


def vectors(n=700, dims=24, seed=5):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0.1, 0.3) for _ in range(dims)], rng.choice([0, 0, 0, 1, 2])) for i in range(n)]
    hot = rows[3][1]
    rows += [(n + i, hot, i % 3) for i in range(120)]  # one vector with many ids and labels
    rows += [rows[5], rows[5], rows[50], (50, rows[51][1], 1), (2000, [0.5], 1), (2001, [], 1), (2002, [0.5] * dims + [2.0], 2)]
    rows += [(2003, None, 1), (2004, [0.1] * dims, None), (2005, [None] * dims, 1), (2006, [math.nan] * dims, 1), (2050, [math.inf] * dims, 1), (None, hot, 1)]
    return rows


@pytest.mark.parametrize("slot_rows,part_anchors", [(10_000, 1_000), (60, 4)])
def test_mined(spark, slot_rows, part_anchors):
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumns({
        "id": F.lit("x"), "q": F.lit(1), "anchor": F.lit(True), "slot": F.lit(0), "part": F.lit("p"), "place": F.lit(3)})
    got = H.hard_negatives(frame, F.col("vec_id") % 50 == 0, slot_rows=slot_rows, part_anchors=part_anchors)
    assert sorted(map(tuple, got.collect())) == mined(rows, lambda i: i % 50 == 0)


def test_nothing_to_mine(spark):
    frame = spark.createDataFrame(vectors(), "vec_id bigint, embedding array<float>, label int")
    assert H.hard_negatives(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert H.hard_negatives(frame, F.lit(False)).count() == 0
    assert H.hard_negatives(frame, F.lit(None).cast("boolean")).count() == 0


def test_large_numbers_stay_exact():
    """Beyond 2^53 the columns are integers, beyond 2^63 Python's."""
    rng = random.Random(2)
    for size, kind in ((2**10, np.float64), (2**28, np.int64), (2**31 - 1, object)):
        rows = [[rng.randint(-size, size) for _ in range(40)] for _ in range(300)]
        table = pa.table({"id": pa.array(range(300), pa.int64()), "label": pa.array([0] * 300, pa.int64()), "q": pa.array(rows, pa.list_(pa.int32()))})
        columns = H.Columns(table, 40, size)
        assert columns.kind is kind
        scores = sorted(((-sum(x * y for x, y in zip(rows[0], r)), i) for i, r in enumerate(rows)))
        ids, values = H.first(columns, *H.scan(columns, np.array(rows[0]), np.arange(300), [(-math.inf, math.inf)], 7), 7)
        assert [(-v, i) for i, v in zip(ids, values)] == scores[:7]


def test_bounds_leave_few_candidates():
    """With one loud dimension the bitmap shrinks before all columns are read."""
    rng = np.random.default_rng(1)
    rows = rng.integers(-3, 4, (4000, 64))
    rows[:, 7] = rng.integers(-900, 900, 4000)
    table = pa.table({"id": pa.array(range(4000), pa.int64()), "label": pa.array([0] * 4000, pa.int64()), "q": pa.array(rows.tolist(), pa.list_(pa.int32()))})
    columns = H.Columns(table, 64, 900)
    query = np.ones(64, np.int64)
    query[7] = 500
    left, _ = H.scan(columns, query, np.arange(4000), [(-math.inf, math.inf)], 5)
    assert len(left) <= H.FEW


# languages

TEXTS = {"en": "the of and to in that is was for it with as his on be at by had are but from", "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au",
         "ελ": "και το να του η της με που την από για είναι στο οι δεν τα θα ένα"}


def said(lang, seed, n=30):
    rng = random.Random(seed)
    return " ".join(rng.choice(TEXTS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def learnt(spark):
    rows = [(i, said(lang, i), lang, "x") for i, lang in enumerate(random.Random(1).choices(list(TEXTS), k=400))]
    rows += [(1000, None, "en", "x"), (1001, "the of", None, "x"), (1002, "", "fr", "x"), (1003, "12 34", "xx", "x"), (None, said("en", 5), "en", "x")] + rows[:3]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, best string")
    return docs, L.Identifier(docs)


def test_odd_texts(spark, learnt):
    docs, model = learnt
    texts = [None, "", " \n\t", "123 -- !?", "the", "LE DE", "και", "the of " * 200_000, "x" * 500_000, "é", "́́", "日本語のテキスト", "the of", "the of", "½ ²"]
    frame = spark.createDataFrame([(i, t, "k", 7.5, "m") for i, t in enumerate(texts)], "doc_id int, text string, lang string, score double, margin string")
    rows = {r.doc_id: r for r in model.identify(frame).collect()}
    assert len(rows) == len(texts) and set(rows[0].asDict()) == {"doc_id", "text", "lang", "margin", "lang_pred", "score", "accepted"}
    assert [i for i, r in rows.items() if r.lang_pred == "und"] == [0, 1, 2, 3, 10, 14] and all(rows[i].score == 0 and not rows[i].accepted for i in (0, 1, 2, 3))
    assert rows[4].lang_pred == rows[7].lang_pred == "en" and rows[5].lang_pred == "fr" and rows[6].lang_pred == "ελ"
    assert all(0 <= r.score <= 1 for r in rows.values()) and rows[12].score == rows[13].score
    assert rows[4].margin == "m" and rows[4].lang == "k"


def test_nothing_learnt(spark, learnt):
    docs, _ = learnt
    none = L.Identifier(docs.filter("lang is null"))
    assert {(r.lang_pred, r.score) for r in none.identify(docs).collect()} == {("und", 0.0)}
    assert L.languages(docs.limit(0)).count() == 0
    one = L.Identifier(docs.filter("lang = 'en'"))
    assert {r.lang_pred for r in one.identify(docs.filter("lang = 'fr' and text <> ''")).collect()} == {"en"}


def test_probabilities_add_up(spark):
    """After each known context the probabilities of all characters and of an unseen one add up to 1, size by size as by hand."""
    words = [("a", "abra", 3), ("a", "cadabra", 2), ("a", "bar", 1)]
    rows = L.kneser_ney(spark.createDataFrame(words, "lang string, word string, n bigint"), 3).collect()
    p = {r.gram: math.exp(r.logp) for r in rows}
    weight = {r.gram: math.exp(r.back) for r in rows if r.back is not None}
    letters = {g for g in p if len(g) == 1}

    def chance(gram):
        if gram in p:
            return p[gram]
        return weight.get(gram[:-1], 1.0) * chance(gram[1:]) if len(gram) > 1 else 0.0

    unseen = 1 - sum(p[x] for x in letters)  # the first characters' share of an even spread over one letter more
    assert 0 < unseen < 1
    for context in weight:
        rest = unseen * math.prod(weight[context[i:]] for i in range(len(context)))
        assert sum(chance(context + x) for x in letters) + rest == pytest.approx(1.0)
    grams = Counter()
    for _, w, n in words:
        padded = "  " + w + " "
        for i in range(len(w) + 1):
            grams[padded[i:i + 3]] += n
    assert {r.gram: r.n for r in rows if r.size == 3} == grams
    assert {r.gram: r.n for r in rows if r.size == 2} == Counter(g[1:] for g in grams)


def test_scores_are_the_models(spark, learnt):
    """The arrays give what the table of grams says, character by character."""
    _, model = learnt
    tables = model.model
    assert all((np.diff(keys.astype(object)) > 0).all() for keys, _, _ in tables["sizes"])
    words = ["the", "être", "θα", "zzz", "q"]
    together, alone = L.score_words(tables, words), np.concatenate([L.score_words(tables, [w]) for w in words])
    assert np.allclose(together, alone) and (together < 0).all()
    assert tables["langs"][int(together[0].argmax())] == "en"


def test_small_models_keep_short_grams(spark):
    words = spark.createDataFrame([("a", w, 1 + i % 9) for i, w in enumerate("".join(random.Random(i).choices("abcdefg", k=6)) for i in range(300))], "lang string, word string, n bigint")
    grams = L.kneser_ney(words).cache()
    total = grams.count()
    few = L.frequent(grams, total // 3).cache()
    assert few.count() <= total // 3 and few.filter("size = 1").count() == grams.filter("size = 1").count()
    longest = few.agg(F.max("size")).first()[0]
    assert few.filter(F.col("size") < longest).count() == grams.filter(F.col("size") < longest).count()
    assert L.frequent(grams, total).count() == total


def test_the_driver_holds_little(spark, learnt, monkeypatch):
    """Counts of a size are made once, the model is sent once, and what is not needed is not in it."""
    words = spark.createDataFrame([("a", "abra", 3), ("b", "bar", 1)], "lang string, word string, n bigint")
    plan = L.kneser_ney(words)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") <= 10 and "Generate" not in plan
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or send(self, value))
    docs, _ = learnt
    model = L.Identifier(docs)
    model.identify(docs).collect()
    assert sum(isinstance(x, dict) and "sizes" in x for x in sent) == 1
    keys, p, back = model.model["sizes"][-1]
    assert len(keys) == len(p) > 0 and len(back) == 0


def test_held_out_languages(spark):
    sf_dir = "/root/testdata/sf0.1"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = Q.QUERIES["op12_language_id"](spark, sf_dir).collect()
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert len(held) > 2000 and sum(held) >= 0.99 * len(held)


# phrases


def found(rows, top, least):
    """Every phrase counted, cut and compared."""
    out = []
    pieces: dict[str, list] = {}
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for end in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(end, "\n")
        pieces.setdefault(lang if lang is not None else "und", []).extend(p.replace("\t", " ").split(" ") for p in low.split("\n"))
    for lang, parts in pieces.items():
        f = Counter()
        for words in ([w for w in p if w] for p in parts):
            for k in range(1, 5):
                f.update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
        n = sum(c for g, c in f.items() if len(g) == 1)
        phrases = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        within = Counter()
        for g, c in phrases.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    within[g[i:i + k]] = max(within[g[i:i + k]], c)
        kept = []
        for g, a in phrases.items():
            if g in within and 100 * within[g] >= 80 * a:
                continue
            cuts = [(math.floor(Fraction(2_000_000 * a, f[g[:k]] + f[g[k:]])), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g))]
            score, _, left, right = min(cuts)
            kept.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def chatter(seed, n=220):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(400)]
    common = ["one two Three four five", "same line again", "tick tick tick tick tick tick"]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(rng.randint(1, 6))] + rng.choices(common, k=2)
        rows.append((rng.choice([". ", "\n", ", ", "  \t", "!"]).join(parts), rng.choice(["aa", "aa", "aa", "b", None])))
    return rows + [(None, "aa"), ("", "b"), ("\t \n", None), ("ÉÉ éé ÉÉ", "b")] + [("copied text of a large group", "aa")] * 300


@pytest.mark.parametrize("top,frontier,vocabulary", [(2000, 10**6, 10**6), (7, 10**6, 10**6), (25, 40, 10**6), (25, 10**6, 3)])
def test_phrases(spark, top, frontier, vocabulary):
    rows = chatter(top)
    docs = spark.createDataFrame([(t, g, 1, "x", 2) for t, g in rows], "text string, lang string, n int, phrase string, f int").repartition(5)
    got = C.collocations(docs, top=top, least=5, frontier=frontier, vocabulary=vocabulary)
    assert sorted(map(tuple, got.collect())) == found(rows, top, 5)


def test_no_phrases(spark):
    docs = spark.createDataFrame([("one two", "a")], "text string, lang string")
    assert C.collocations(docs).count() == 0 and C.collocations(docs.limit(0)).count() == 0
    assert C.collocations(docs).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_scores_beyond_64_bits(spark):
    a, of = 3 * 10**17, 7 * 10**17 + 1
    got = spark.range(1).select(F.lit(a).alias("a"), F.lit(of).alias("b")).select(F.expr(C.scaled("a", "b")).alias("s")).first().s
    assert got == 2_000_000 * a // of


def test_shared_hashes_are_told_apart(monkeypatch):
    """With one hash for all n-grams, sets and counts stay exact."""
    monkeypatch.setattr(C, "_mixed", lambda columns: np.zeros(len(columns[0]), np.uint64))
    columns = [np.array([1, 2, 3, 4]), np.array([5, 6, 7, 8])]
    grams = C.Grams(columns, [np.array([True, False, True, False])])
    assert grams.find([np.array([3, 3, 9, 1]), np.array([7, 5, 9, 5])]).tolist() == [2, -1, -1, 0]
    counted = C._counted([np.array([1, 2, 1, 1]), np.array([5, 5, 5, 6])]).to_pylist()
    total = Counter()
    for r in counted:
        total[r["a"], r["b"]] += r["n"]
    assert total == {(1, 5): 2, (2, 5): 1, (1, 6): 1}
