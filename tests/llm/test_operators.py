"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventflow.llm import chat_format, decontamination, exact_dedup, html_extract, line_dedup, minhash, packing, token_counts, tokens, toxicity, url_filter
from eventflow.llm.components import components
from eventflow.llm.queries import RULES, tokenizer

DOCS = "doc_id bigint, text string, lang string, h bigint, n_words string, score string, removed string"


def docs(spark, rows):
    """Documents with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", 1, "x", "y", "z") for i, t in rows], DOCS)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8))) + rng.choice(("", "", "", "", ".")) for _ in range(n))


LONG = prose(0, 60_000)
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (None, "one two three"), (6, LONG), (7, "x" * 200_000), (8, "é ß"), (9, None)]


# url filters

def test_urls(spark):
    urls = [(1, "http://A.Example.NET/en/x?y"), (2, "http://example.net/de/"), (3, "https://example.com/de/1"), (4, "https://x.org/fr/"),
            (5, None), (6, "no url"), (7, "http://example.net"), (8, "http://example.net/english"), (8, "http://example.net/english"), (9, "://net/#a/b"),
            (10, "http://notexample.com/de/1"), (None, "http://net/")]
    frame = spark.createDataFrame(urls, "page_id int, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))
    got = sorted(tuple(r) for r in url_filter.filter_urls(frame, RULES).select("page_id", "host", "path", "rule", "verdict").collect() if r.page_id)
    assert got == [
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "example.net", "/de/", "net/", "block"), (3, "example.com", "/de/1", "example.com/de/", "block"),
        (4, "x.org", "/fr/", "org/fr/", "allow"), (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "example.net", "", None, "allow"),
        (8, "example.net", "/english", "net/", "block"), (8, "example.net", "/english", "net/", "block"), (9, "net", "/", "net/", "block"),
        (10, "notexample.com", "/de/1", None, "allow")]
    assert url_filter.filter_urls(frame.limit(0), RULES).count() == 0


def test_trie_is_the_longest_prefix():
    rng = random.Random(3)
    rules = [url_filter.Rule(".".join(rng.choice("ab") for _ in range(rng.randint(1, 3))), "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 4))), rng.choice(("allow", "block")))
             for _ in range(60)]
    trie = url_filter.HostTrie(rules)
    for _ in range(400):
        host, path = ".".join(rng.choice("ab") for _ in range(rng.randint(1, 4))), "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 6)))
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (r.host.count("."), len(r.path), r.verdict == "block"), default=None)
        assert trie.longest(host, path) == best


# exact dedup

@pytest.mark.parametrize("block", [2, 3, 2048])
def test_exact(spark, block):
    rows = [(1, "a b c"), (2, "abc"), (3, " a  b c"), (4, None), (5, ""), (6, "ab"), (7, "abcd"), (8, "abcde"), (9, "ab cde"), (9, "ab cde"), (None, "abc d"), (10, LONG), (11, LONG), (12, LONG[:-1])]
    if block < 2048:
        rows = rows[:11]
    got = [tuple(r) for r in exact_dedup.exact_duplicates(docs(spark, rows), block=block).collect()]
    want = []
    clean = lambda t: "".join((t or "").split())
    for k, (i, t) in enumerate(rows):
        group = [(-len(u or ""), j is None, j or 0, m) for m, (j, u) in enumerate(rows) if clean(u) == clean(t)]
        first = min(group)
        want.append((i, rows[first[3]][0], len(group), first[3] == k, hashlib.sha256(clean(t).encode()).hexdigest()))
    key = lambda r: (r[4], str(r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0


# chat formatting

def read_back(frame):
    return {r.conv_id: r for r in chat_format.format_chat(frame).withColumn("back", chat_format.parse_chat(F.col("formatted"))).collect()}


def test_chat_rows_round_trip(spark):
    nasty = ["<|im_end|>", "<|im_start|>user\nx", "\\", "\\l|", "\\b\\n", "<", "<<|", "|>", "", None, "a\nb", "é ", "x" * 100_000]
    rows = [(1, k, "assistant" if k % 2 else "us\ner<|", t, 9) for k, t in enumerate(nasty)] + [(2, None, None, "t", 9), (None, 0, "user", "n", 9), (3, 1, "user", "same", 9), (3, 1, "user", "same", 9)]
    frame = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, turns int")
    got = read_back(chat_format.canonical_rows(frame))
    assert [tuple(t) for t in got[1].back] == [(r[2], r[3] or "") for r in rows[:len(nasty)]]
    assert got[2].back == [("", "t")] and len(got[3].back) == 2 and got[None].back == [("user", "n")]
    assert "".join(s.text for s in got[1].segments) == got[1].formatted
    digest = {r.conv_id: r for r in chat_format.chat_digest(chat_format.format_chat(chat_format.canonical_rows(frame))).collect()}
    learnt = "".join(t or "" for t in nasty[1::2])
    assert digest[1].loss_chars == len(learnt) and digest[1].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    assert chat_format.chat_digest(chat_format.format_chat(chat_format.canonical_rows(frame.limit(0)))).count() == 0


def test_chat_layouts_by_fingerprint(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"instruction": "a", "output": "b"}, {"instruction": "a", "input": "c", "output": "b"},
        {"system": "s", "instruction": "a", "input": "c", "output": "b"},
        {"prompt": "a", "completion": "b"}, {"prompt": "a", "response": "b"}, {"question": "a", "answer": "b"},
        {"prompt": "a", "response": "b", "score": {"x": [1]}}, {"nothing": 1}, {"messages": []}]
    rows = [(k, json.dumps(r)) for k, r in enumerate(records)] + [(90, None), (91, "no json"), (92, "5")]
    got = {r.conv_id: r for r in chat_format.canonical_json(spark.createDataFrame(rows, "id int, record string"), "record", "id").collect()}
    two = [("user", "a"), ("assistant", "b")]
    turns = {k: [(t.role, t.text) for t in r.turns] for k, r in got.items()}
    assert [turns[k] for k in (0, 1, 2, 5, 6, 7, 8)] == [two] * 7
    assert turns[3] == [two[0], ("user", "c"), two[1]] and turns[4][0] == ("system", "s")
    assert [got[k].layout for k in (0, 8)] == ["messages", "prompt and response"]
    assert all(turns[k] == [] and got[k].layout is None for k in (9, 90, 91, 92)) and turns[10] == []
    typed = spark.createDataFrame([("a", "b", 3)], "prompt string, completion string, extra int")
    assert [(t.role, t.text) for t in chat_format.canonical_rows(typed).first().turns] == two
    with pytest.raises(ValueError):
        chat_format.canonical_rows(spark.range(1))


# tokens

def test_counts_of_odd_texts(spark):
    from tokenizers import Tokenizer
    path = tokenizer("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(5)
    pieces = ["a", "don't", " ", "  ", "\n", "\t", " ", " ", "᠎", "<|endoftext|>", "é", "123", "...", "\x1c", "x y", "日本"]
    rows = ODD + [(100 + k, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))) for k in range(300)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs(spark, rows), path).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False)), n > 512) for i, t in rows), key=str)
    assert got == want
    assert token_counts.token_counts(docs(spark, []), path).count() == 0


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 10)
    counter = tokens.Counter(tokenizer("byte_bpe_50k.json"))
    text = prose(1, 200)
    assert counter.count([text]) == counter.count([text])


def test_packing_of_odd_texts(spark):
    from tokenizers import Tokenizer
    path = tokenizer("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(6)
    rows = ODD + [(100 + k, "".join(rng.choice(["a", "don't", " ", "  ", "\n", " ", " ", "<|endoftext|>", "É", "é", "12", "..."]) for _ in range(rng.randint(0, 40)))) for k in range(200)]
    packed = packing.pack(docs(spark, rows), path).collect()
    assert len({r.sequence_id for r in packed}) == len(packed)
    whole = {}
    for r in sorted(packed, key=lambda r: r.start):
        assert len(r.ids) == 4 * r.length == 4 << r.bucket
        whole.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for i, t in rows:
        if i not in (5,):
            assert [x for _, ids in whole[i] for x in ids] == tok.encode(t or "", add_special_tokens=False).ids + [2]
    assert len(whole[5]) == 2 * len(packing.binary_lengths(len(tok.encode("one", add_special_tokens=False).ids) + 1, 4096))
    assert packing.pack(docs(spark, []), path).count() == 0
    assert packing.binary_lengths(10_000, 4096) == [4096, 4096, 1024, 512, 256, 16]


def test_packing_gives_memory_back(spark, monkeypatch):
    import pyarrow as pa
    from eventflow.llm import common
    path, sent, freed = tokenizer("word_bpe_49k.json"), [], []
    monkeypatch.setattr(common, "kept", lambda held={("other", "Model", 1): "large"}: held)
    monkeypatch.setattr(packing, "give_back", lambda: freed.append(1))
    frame = docs(spark, [(1, "one")])
    with monkeypatch.context() as m:
        m.setattr(type(frame), "mapInArrow", lambda self, f, schema: sent.append(f))
        packing.pack(frame, path)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["ab " * 400_000] * 3), pa.array([0, 0, 0])], ["doc_id", "text", "task"])
    encoders = []
    for _ in range(2):
        assert sum(b.num_rows for b in sent[0](iter([batch])))
        assert [name[:2] for name in common.kept()] == [("eventflow.llm.tokens", "Encoder")]
        encoders += common.kept().values()
    assert encoders[0] is encoders[1] and len(freed) == 6  # words stay known; each text is a group of its own


def test_forget_gives_memory_back():
    import os
    import subprocess
    import sys
    code = """
import re, numpy as np, pyarrow as pa
from eventflow.llm.common import forget
def own(): return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10
before = own()
small = [np.ones(1000) for _ in range(10_000)]
arrow = [pa.array(["x" * 2000] * 100) for _ in range(400)]
kept, most = small[::500], own()
del small, arrow
forget()
print(before, most, own())
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=100)
    before, most, after = map(int, done.stdout.split()[-3:])
    assert most - before > 140 and after - before < 30


# near-dedup

def brute_components(rows, percent=85):
    sets = [minhash.shingles(t or "") for _, t in rows]
    of = {i: i for i, _ in rows}

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and minhash.similar(sets[a], sets[b], percent):
                x, y = sorted((top(rows[a][0]), top(rows[b][0])))
                of[y] = x
    return [(i, len(s), top(i), top(i) == i) for (i, _), s in zip(rows, sets)]


def near_rows(seed=0):
    """Groups of near copies around the limit, chains, and a passage that many texts share."""
    rng = random.Random(seed)
    rows, shared = [(0, None), (1, ""), (2, "a b"), (3, "A  b"), (4, "one two three four five"), (5, "x")], prose(99, 60)
    for g in range(12):
        words = prose(g + 10, 150).split()
        for _ in range(rng.randint(2, 14)):
            for _ in range(rng.choice((0, 1, 1, 2, 3))):
                words[rng.randrange(len(words))] = prose(rng.randrange(10**6), 1)
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + k, prose(500 + k, 30) + " " + shared) for k in range(30)]
    rng.shuffle(rows)
    return rows


def test_near_duplicates_are_all_found(spark):
    rows = near_rows()
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs(spark, rows)).collect())
    assert got == sorted(brute_components(rows))


def test_near_duplicates_of_other_groups(spark):
    rows = near_rows(1)
    assert sorted(tuple(r) for r in minhash.near_duplicates(docs(spark, rows)).collect()) == sorted(brute_components(rows))


def test_near_odd_rows(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, ODD)).collect()), key=str)
    of = {r[0]: r for r in got}
    assert of[1] == (1, 0, 1, True) and of[3] == (3, 0, 3, True) and of[4] == (4, 1, 4, True) and of[5] == (5, 1, 4, False) and of[None] == (None, 1, None, True)
    assert len(got) == len(ODD) and of[6][1] == len(minhash.shingles(LONG))
    kept = minhash.drop_near_duplicates(docs(spark, ODD))
    assert kept.count() == len(ODD) - 2 and kept.columns == docs(spark, []).columns
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = base[:3000], base[1000:]
    s = minhash.signatures([a, b], 512)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.08
    big = minhash.signatures([np.concatenate([base] * 20), base], 64)
    assert (big[0] == big[1]).all()


def test_components(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (20, 21)] + [(k, k + 1) for k in range(100, 140)] + [(300, k) for k in range(301, 330)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()))
    assert got[4] == 1 and got[9] == 7 and got[140] == 100 and got[329] == 300 and 5 not in got


# line dedup

def test_passages(spark):
    passage, other = prose(7, 70), prose(8, 45)
    rows = [(k, f"{prose(100 + k, 40)} {passage} {prose(200 + k, 30)}") for k in range(5)] + [(10, prose(9, 100) + "\n" + other), (11, prose(12, 90) + "\n" + other),
            (20, passage), (21, None), (22, ""), (None, passage), (30, LONG), (31, LONG), (31, LONG), (32, "a " * 300)]
    frame = docs(spark, rows)
    out = line_dedup.with_removed(frame)
    assert out.columns == frame.drop("removed").columns + ["removed"]
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r.text)
    old = dict(rows)
    assert got[0] == [old[0]] and got[10] == [old[10]] and got[11] == [old[11]] and got[21] == [None] and got[None] == [passage]
    for k in range(1, 5):
        assert passage not in got[k][0] and got[k][0].startswith(prose(100 + k, 40)) and got[k][0].endswith(prose(200 + k, 30))
    assert got[20] == [""] and got[30] == [LONG] and got[31] == ["", ""] and got[32] == [old[32]]
    assert line_dedup.drop_repeated(frame).columns == frame.columns
    assert line_dedup.with_removed(docs(spark, [])).count() == 0


def gone_words(texts, n):
    """By brute force, the places of words in n words that a text with a smaller id has too."""
    first = {}
    for i, t in sorted(texts.items()):
        ws = t.split()
        for k in range(len(ws) - n + 1):
            first.setdefault(tuple(ws[k:k + n]), i)
    return {i: {k + j for k in range(len(ws) - n + 1) if first[tuple(ws[k:k + n])] < i for j in range(n)}
            for i, ws in ((i, t.split()) for i, t in texts.items())}


def removed_words(spark, texts, n=50):
    out = line_dedup.with_removed(docs(spark, list(texts.items())), n).collect()
    return {r.doc_id: {k for s in r.removed for k in range(s.start, s.start + s.words)} for r in out}


def test_passages_hardly_long_enough(spark):
    texts = {}
    for k in range(60):  # 48 to 67 words, in two documents amid other prose
        passage = prose(1000 + k, 48 + k % 20)
        for half in (0, 1):
            texts[2 * k + half] = f"{prose(3000 + 2 * k + half, 70)} {passage} {prose(5000 + 2 * k + half, 70)}"
    wanted = gone_words(texts, 50)
    assert sum(map(bool, wanted.values())) == 54 and removed_words(spark, texts) == wanted


def test_passages_without_line_ends(spark):
    plain = lambda seed, n: prose(seed, n).replace(".", "")
    texts = {}
    for k in range(80):  # 50 to 80 words, or one line of 9 words 12 times
        passage = plain(1000 + k, 50 + k % 31) if k < 60 else " ".join([plain(1000 + k, 9)] * 12)
        for half in (0, 1):
            texts[2 * k + half] = f"{plain(3000 + 2 * k + half, 70)} {passage} {plain(5000 + 2 * k + half, 70)}"
    texts |= {200: "a " * 300, 201: "b " + "a " * 120}
    wanted = gone_words(texts, 50)
    assert sum(map(bool, wanted.values())) == 81 and removed_words(spark, texts) == wanted


def test_lines_are_short_and_cut_alike():
    words = line_dedup.words_of([prose(3, 4000) + " a" * 50])[0]
    begins = np.flatnonzero(line_dedup.line_begins(words, line_dedup.LINE))
    assert np.diff(begins).max() <= line_dedup.LINE and np.diff(begins).mean() > 1.5
    part = np.flatnonzero(line_dedup.line_begins(words[1000:2000], line_dedup.LINE)) + 1000
    inner = lambda x: set(x[(x >= 1003) & (x < 1997)].tolist())
    assert inner(begins) == inner(part)


def test_different_chunks_of_one_name(spark):
    """Near copies of one text, each with other words changed, and passages cut short at either end."""
    rng, base = random.Random(4), prose(77, 400).split()
    texts = {}
    for k in range(40):
        ws = list(base)
        for at in rng.sample(range(len(ws)), rng.randint(0, 6)):
            ws[at] = f"new{k}x{at}"
        low, high = sorted(rng.sample(range(len(ws)), 2))
        texts[k] = " ".join(ws if k % 3 else ws[low:high])
    texts[40] = texts[5]
    wanted = gone_words(texts, 50)
    assert sum(map(bool, wanted.values())) > 20 and removed_words(spark, texts) == wanted
    small = {k: " ".join(t.split()[:60]) for k, t in texts.items()}
    assert removed_words(spark, small, 12) == gone_words(small, 12)


def test_chunks_resist_shifts():
    passage = prose(7, 300)
    a, b = (set(line_dedup.chunks_of([prose(s, n) + " " + passage]).hash.tolist()) for s, n in ((1, 50), (2, 83)))
    alone = line_dedup.chunks_of([passage]).hash
    assert len(a & b) >= 0.8 * len(alone)


# decontamination

def brute_hits(text, items, window=13):
    words = decontamination.words(text or "")
    hit, found = set(), set()
    for item, t in items:
        ws = decontamination.words(t or "")
        size = min(window, len(ws))
        grams = {tuple(ws[k:k + size]) for k in range(len(ws) - size + 1)} if ws else set()
        for k in range(len(words) - size + 1 if size else 0):
            if tuple(words[k:k + size]) in grams:
                hit |= set(range(k, k + size))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def test_windows_of_many_items():
    """The benchmark is ranked once, however many shards are searched."""
    rng = random.Random(11)
    items = [(i, " ".join(f"v{rng.randint(0, 5000)}" for _ in range(rng.choice([3, 13, 20])))) for i in range(100_000)]
    held = decontamination.Items(items, 13)
    ranks = dict(held.tables)
    for shard in range(3):
        asked = [rng.randrange(len(items)) for _ in range(40)]
        texts = [f"x y {items[k][1]} z {' '.join(items[k][1].split()[:12])}" for k in asked]
        for k, (n_words, n_hit, matches) in zip(asked, decontamination.match_shard(texts, held)):
            size = len(items[k][1].split())
            assert (str(k), 2, 0, size) in matches and size <= n_hit < n_words - 2
            assert all(items[int(i)][1].split()[b:b + n] == texts[asked.index(k)].split()[a:a + n] for i, a, b, n in matches)
    assert all(held.tables[k] is v for k, v in ranks.items())


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination(spark, block_bytes):
    items = [(1, prose(1, 40)), (2, prose(2, 13)), (3, prose(3, 5)), (4, "One-two"), (5, None), (6, "..."), (7, prose(1, 40)[10:]), (7, prose(4, 20))]
    rng = random.Random(1)
    rows = ODD + [(100 + k, " ".join(rng.choice([prose(1, 40), prose(1, 40)[30:150], prose(2, 13), prose(3, 5), prose(3, 4), "one TWO", prose(k, 30), prose(4, 15)]) for _ in range(rng.randint(1, 6)))) for k in range(80)]
    bench = spark.createDataFrame(items, "item_id int, text string")
    out = decontamination.judged(docs(spark, rows), bench, block_bytes=block_bytes).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out), key=str)
    assert got == sorted(((i, *brute_hits(t, items)) for i, t in rows), key=str)
    whole = next(r for r in decontamination.find_matches(docs(spark, [(1, "x y " + prose(1, 40) + " z")]), bench).collect())
    assert max(m.length for m in whole.matches) == len(decontamination.words(prose(1, 40))) and min(m.start for m in whole.matches) == 2
    kept = decontamination.decontaminate(docs(spark, rows), bench)
    assert kept.columns == docs(spark, []).columns and kept.count() == sum(not r[5] for r in got)
    assert decontamination.judged(docs(spark, []), bench).count() == 0
    assert {r.n_hit for r in decontamination.judged(docs(spark, rows), bench.limit(0)).collect()} == {0}


# toxicity

def test_toxicity_of_odd_rows(spark):
    rows = ODD + [(1000 + k, prose(k, 40) + (" you idiot, moron and scum" if k % 3 == 0 else "")) for k in range(300)]
    labels = spark.createDataFrame([(1000 + k, int(k % 3 == 0), None) for k in range(300)] + [(None, 1, 1), (5, None, 1), (77, 1, 1)], "doc_id bigint, toxic int, x int")
    got = toxicity.toxicity(docs(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(r.score is not None for r in got)
    of = {r.doc_id: r for r in got}
    assert all(of[1000 + k].predicted == int(k % 3 == 0) for k in range(300))
    assert of[None].held_out is False and of[2].predicted == 0
    kept = toxicity.drop_toxic(docs(spark, rows), labels)
    assert kept.columns == docs(spark, []).columns and kept.count() == len(rows) - 100
    assert toxicity.toxicity(docs(spark, rows), labels.limit(0)).filter("score = 0").count() == len(rows)
    assert toxicity.toxicity(docs(spark, []), labels).count() == 0


def test_features():
    lexicon = toxicity.Lexicon(frozenset({"vile"}), frozenset({"odd"}), frozenset({"stemm"}))
    x = dict(zip(toxicity.FEATURES, toxicity.features("You are VILE, v1le! odd stemmed.", lexicon)))
    assert x["near_you"] > 0 and x["masked_hits"] > 0 and x["stems"] > 0 and x["weak"] > 0 and x["capitals"] > 0
    assert not any(toxicity.features("", lexicon))


# html

@pytest.fixture(scope="module")
def field():
    return html_extract.generated_field()


def test_pages(spark, field):
    page = ('<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>'
            '<div class="cookie-banner">We use cookies to serve you.</div><article><h1>The &amp;amp title &amp</h1><p>First <b>bold</b>er\n  text&nbsp;here &lt;x&gt;.<p>Second one'
            '<br>goes on, with words enough to be read.<div class="ad">Buy this thing now.</div></article><section class="comments"><p>I was first, said a reader.</p></section>'
            '<form><label>Name</label></form><footer>&copy; 2020 Somebody.</footer>')
    rows = [(1, page), (2, None), (3, ""), (4, "<<<>>"), (4, "<<<>>"), (5, "<article>" + "<p>Some words that say a thing.</p>" * 5000), (None, "<p"), (6, "<script>never closed <p>x</p>"),
            (7, "<!-- open"), (8, "<div " * 2000)]
    frame = spark.createDataFrame([(i, f"u{i}", h, 5) for i, h in rows], "page_id int, url string, html string, text int")
    out = html_extract.extract(frame, field)
    assert out.columns == ["page_id", "url", "text"]
    got = {r.page_id: r.text for r in out.collect()}
    assert got[1] == "The &amp title & First bolder text here <x>. Second one goes on, with words enough to be read."
    assert got[2] == got[3] == got[6] == got[7] == "" and got[5] == " ".join(["Some words that say a thing."] * 5000)
    assert html_extract.extract(frame.limit(0), field).count() == 0


@pytest.mark.parametrize("before", [
    "<script>for(var i=0;i<n;i++){f(i)}</script>", "<SCRIPT>if(a<b && c>d){g('<p>')}</Script >", "<script><!-- never closed </script>",
    "<script>a='</scripts>';b='it';if(a<b){}</script\n>", "<style>a<b{}</style>", "<title>a<b</title>",
    "<template><script>i<n;</script></template>", '<datalist id="d"><option value="1"><option>two</datalist>'])
def test_pages_with_common_scripts(before):
    article = "<article><p>Some words that say a thing.</p></article>"
    for page in (before + article + "<p>More.</p>", before + before + article + before + "<p>More.</p>"):
        assert [b.text for b in html_extract.blocks_of(page)] == ["Some words that say a thing.", "More."]


def test_field_on_other_generated_pages(field):
    rng = random.Random(1234)
    right = total = 0
    for _ in range(100):
        page, kept = html_extract.labelled_page(rng)
        blocks = html_extract.blocks_of(page)
        wanted = [int(b.text in kept) for b in blocks]
        right += sum(a == b for a, b in zip(wanted, field.decode(html_extract.features_of(blocks))))
        total += len(blocks)
    assert right >= 0.98 * total


def test_decoding_is_the_best_path(field):
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        x = rng.normal(size=(n, len(html_extract.NAMES)))
        scores = x @ field.state
        best = max((sum(scores[k, p[k]] for k in range(n)) + sum(field.step[a, b] for a, b in zip(p, p[1:])), p)
                   for p in np.ndindex(*(2,) * n))[1]
        assert field.decode(x) == list(best)


# pages written by hand, apart from the generator: wrappers whose classes speak of other parts

ARTICLE = "<h1>Title of it</h1><p>A first paragraph that says something long enough to count as text.</p><p>Short one.</p>"
AROUND = ("<nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav>{}<div class='sidebar'><h3>Related</h3><p>Another story you may like to read "
          "today.</p></div><section class=comments><h2>Comments</h2><div class=comment><p>I think so too, very nice indeed and more words to say here."
          "</p></div></section><footer>&copy; 2024 x.example</footer>")


@pytest.mark.parametrize("page", [
    *[f"<html><body class='{c}'>{AROUND.format(f'<article>{ARTICLE}</article>')}</body></html>" for c in ("has-sidebar", "single comments-open", "header-fixed", "menu-open modal-ready")],
    *[f"<html><body>{AROUND.format(f'<article class={c!r}>{ARTICLE}</article>')}</body></html>" for c in ("post tags-x", "hentry sidebar-left", "story")],
    *[f"<html><body>{AROUND.format(f'<div class={c!r}><article>{ARTICLE}</article></div>')}</body></html>" for c in ("vintage-modality", "with-ads", "siteHeader layout")],
    f"<html><body><form id=page-form>{AROUND.format(f'<article>{ARTICLE}</article>')}</form></body></html>",
    f"<body><form><header class=header><main>{ARTICLE}</main></header></form></body>",
    f"<body class=no-footer>{AROUND.format(f'<div id=content>{ARTICLE}</div>')}</body>",
    f"<article>{ARTICLE.replace('<p>A', '<p class=it' + chr(39) + 's>A')}</article>",
    f"<article>{ARTICLE.replace('<p>S', '<p title = x y=' + chr(34) + '>' + chr(34) + '>S')}</article>"])
def test_wrappers_do_not_hide_the_article(field, page):
    assert html_extract.main_text(page, field) == "Title of it A first paragraph that says something long enough to count as text. Short one."


@pytest.mark.parametrize("part", ["<a ", "<div class=x>t", "<p>x</zz>", '<a ="', "<a ='\"", "<!--", "<i><b>x", "<![CDATA[", "</div>", "<p class=a b='"])
def test_hostile_pages_take_linear_time(part):
    import time
    page = part * (1_000_000 // len(part)) + '"'
    began = time.process_time()
    html_extract.blocks_of(page)
    assert time.process_time() - began < 5


# rules beyond one block, columns of one's own

def test_rules_in_blocks(spark):
    rng = random.Random(9)
    rules = [url_filter.Rule(".".join(rng.choice("ab") for _ in range(rng.randint(1, 3))), "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 3))), rng.choice(("allow", "block")))
             for _ in range(40)]
    urls = [(i, "http://" + ".".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) + "/" + "".join(rng.choice("ab/") for _ in range(4))) for i in range(200)] + [(999, None)]
    frame = spark.createDataFrame(urls, "page_id int, url string")
    rows = [sorted(map(tuple, url_filter.filter_urls(frame, rules, block_rules=n).collect()), key=repr) for n in (1000, 7)]
    assert rows[0] == rows[1] and any(r[5] == "block" for r in rows[0])


def test_stages_keep_columns_named_like_their_own(spark):
    passage = prose(3, 80)
    rows = [(1, passage + " one", 7, "r", "m"), (2, "two " + passage, 8, "s", "n"), (3, prose(4, 30), 9, None, "o")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int, removed string, matches string").withColumns({
        "n_hit": F.lit(-1), "contaminated": F.lit("c"), "items_sha256": F.lit(0.5), "n_items": F.lit("i")})
    items = spark.createDataFrame([("q", prose(4, 30))], "item_id string, text string")
    clean = decontamination.decontaminate(frame, items)
    assert clean.columns == frame.columns and sorted(map(tuple, clean.collect())) == sorted(tuple(r) for r in frame.collect() if r.doc_id != 3)
    left = line_dedup.drop_repeated(frame)
    assert left.columns == frame.columns and {r.doc_id: r.removed for r in left.collect()} == {1: "r", 2: "s", 3: None}
    assert {r.doc_id: r.text for r in left.collect()}[2] == "two "


def test_queries_run_from_any_folder(tmp_path):
    """Without the repository on the workers' path."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = (f"import sys; sys.path.insert(0, {root!r})\nimport __spark_entry__ as e\nfrom pyspark.sql import SparkSession\n"
            "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
            "for name in ('op1_url_filter', 'op4_html_extract', 'op6_decontamination', 'op7_token_counts', 'op8_toxicity', 'op11_hard_negatives'):\n"
            "    print(name, e.queries()[name](spark, '/root/testdata/sf0.001').count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert done.returncode == 0 and done.stdout.count("op") == 6, done.stderr[-2000:]


def test_encoder_looks_words_up_together():
    """Ids of texts encoded together are the tokenizer's for each alone; each distinct word of a group is looked up once."""
    import public_tokenizers

    from eventflow.llm import tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, plain, learnt = tokens.Encoder(path), tokens.load(path), []
    learn = encoder._learn
    encoder._learn = lambda words: learnt.append(len(words)) or learn(words)
    texts = ["the cat, the Cat", "", " ", "a  b\n c ", "\n", "ß É θα", "<|x|> A", "the " * 3000, "﻿ x​y", ""]
    for group in (texts, texts[::-1], texts[1:2], texts[:1]):
        assert [x.tolist() for x in encoder.encode(group)] == [plain.encode(t, add_special_tokens=False).ids for t in group]
    assert encoder.encode([]) == [] and learnt[0] == len(set(" ".join(tokens.lowered(t).replace("\n", " ") for t in texts).split(" ")))


def test_encoder_sends_plain_words_together(tmp_path, monkeypatch):
    """Many distinct words cost few calls of the model, and the ids are the tokenizer's, also without marks of last tokens."""
    import json

    import public_tokenizers

    from eventflow.llm import tokens

    class Counted:
        def __init__(self, kind):
            self.kind, self.calls = kind, 0

        def __getattr__(self, name):
            self.calls += 1
            return getattr(self.kind, name)

    rng = random.Random(7)
    letters = [*"abcdefghijklmnopqrstuvwxyz", *"\u00df\u00e0\u00e9\u00ed\u00f6\u00f8\u00ff"]
    words = ["".join(rng.choices(letters, k=rng.randint(1, 14))) + rng.choice(["", "", ",", ".)", "--", "_", "'s", "</w>", "7", "\u00f7"]) for _ in range(5000)]
    texts = [" ".join(words[k:k + 500]) for k in range(0, 5000, 500)] + ["", "  x  ", "\u00d7 a\u0300 A\u0300 ,", "w" * 3000]
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, plain = tokens.Encoder(path), tokens.load(path)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    encoder.model = Counted(encoder.model)
    assert [x.tolist() for x in encoder.encode(texts)] == want and encoder.model.calls < 20
    known = encoder.model.calls
    assert [x.tolist() for x in encoder.encode(texts[::-1])] == want[::-1] and encoder.model.calls == known
    monkeypatch.setattr(tokens, "NUMBERED", 100)
    assert [x.tolist() for t in texts for x in encoder.encode([t])] == want

    unmarked = tokens.Encoder(path)
    unmarked.last[:] = False  # as if no token told where its word ends
    assert [x.tolist() for x in unmarked.encode(texts)] == want

    with open(path) as f:
        other = json.load(f)
    other["model"]["end_of_word_suffix"] = None
    (tmp_path / "other.json").write_text(json.dumps(other))
    plain = tokens.load(str(tmp_path / "other.json"))
    got = tokens.Encoder(str(tmp_path / "other.json")).encode(texts)
    assert [x.tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
