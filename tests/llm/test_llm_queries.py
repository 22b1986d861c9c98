"""The registered queries next to their SQL, and brute force where SQL cannot say it."""

from __future__ import annotations

import zlib

import pytest

from check_queries import compare, connect
from eventflow.llm import queries as Q
from eventflow.llm.chat_format import format_chat

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(spark, name):
    rows, wrong = compare(spark, connect(SF_DIR), name, Q.QUERIES[name], Q.SQL[name], SF_DIR)
    assert wrong is None and rows > 0


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def test_counts_are_the_librarys(spark, documents):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(Q.tokenizer("byte_bpe_50k.json"))
    got = Q.QUERIES["op7_token_counts"](spark, SF_DIR).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {
        i: (len(t.encode()), n := len(tok.encode(t, add_special_tokens=False)), n > 512) for i, t in documents.items()}


def test_pieces_are_whole_documents(spark, documents):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(Q.tokenizer("word_bpe_49k.json"))
    rows = Q.QUERIES["op3_packing"](spark, SF_DIR).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    assert all(r.length & (r.length - 1) == 0 and r.length <= 4096 for r in rows)
    of = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        of.setdefault(r.doc_id, []).append(r)
    for i, text in documents.items():
        ids, at = tok.encode(text, add_special_tokens=False).ids + [2], 0
        for r in of[i]:
            piece = ids[at:at + r.length]
            assert r.start == at and len(piece) == r.length and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece))
            at += r.length
        assert at == len(ids)
    assert sorted(rows, key=lambda r: r.sequence_id) == sorted(rows, key=lambda r: (r.length, r.sequence_id))


def windows(texts: dict, n: int = 50) -> dict:
    """The documents of each run of n words."""
    found = {}
    for i, text in texts.items():
        words = text.split()
        for k in range(len(words) - n + 1):
            found.setdefault(tuple(words[k:k + n]), set()).add(i)
    return found


def test_repeated_passages_go(spark, documents):
    got = {r.doc_id: r for r in Q.QUERIES["op2_line_dedup"](spark, SF_DIR).collect()}
    assert set(got) == set(documents)
    before = {w: d for w, d in windows(documents).items() if len(d) > 1}
    later = set().union(*(d - {min(d)} for d in before.values()))
    for i, text in documents.items():
        assert i in later or got[i].text == text
        assert len(got[i].text.split()) == len(text.split()) - got[i].n_removed_words
    after = {w: d for w, d in windows({i: r.text for i, r in got.items()}).items() if len(d) > 1}
    assert not after


def test_toxicity_of_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in Q.QUERIES["op8_toxicity"](spark, sf_dir).collect()]
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(toxic[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in toxic]
    bad = [p for t, p in held if t]
    good = [p for t, p in held if not t]
    assert sum(bad) >= 0.9 * len(bad) and sum(good) <= 0.03 * len(good)


def test_native_plans(spark):
    for name in ("op9_chat_format", "op10_exact_dedup"):
        plan = Q.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InArrow" not in plan and "ExistingRDD" not in plan


def test_chat_queries_read_back(spark):
    assert format_chat is not None
    rows = {r.conv_id: r for r in Q.QUERIES["op9_chat_format"](spark, SF_DIR).collect()}
    assert rows[-1].n_turns == 2 and rows[-1].loss_chars == len(Q.CONTROL)
