"""Alignment by segments against whole texts, tokenized and aligned one by one."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from newsloom.llm import token_alignment as T

RNG = random.Random(8)
PATHS = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def groups_of(texts):
    """For each text its groups of ids, or None, from the whole text by the tokenizers."""
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    # Byte-level characters by their rule: bytes that print stand for themselves.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    chars = dict(zip(map(chr, shown), shown)) | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    names = {v: k for k, v in a.get_vocab().items()}
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        whole = (" " + text).encode()
        one = [(k, bytes(chars[c] for c in names[k])) for k in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(k, bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode()) for k in b.encode(text) for p in [b.id_to_piece(k)]]
        if b"".join(x for _, x in one) != whole or b"".join(x for _, x in two) != whole:
            out.append(None)
            continue
        ends = []
        for side in (one, two):
            at, found = 0, []
            for k, x in side:
                at += len(x)
                found.append((at, k))
            ends.append(found)
        cuts = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        low, groups = 0, []
        for cut in cuts:
            groups.append(tuple([k for e, k in side if low < e <= cut] for side in ends))
            low = cut
        out.append(groups)
    return out


def brute(texts):
    groups = groups_of(texts)
    docs = Counter(p for g in groups if g for p in {(x, y) for one, two in g for x in one for y in two})
    most: dict = {}
    for (x, _), n in docs.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for g in groups:
        if g is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for one, two in g for x in one for y in two]
        said = ";".join(f"{','.join(map(str, one))}|{','.join(map(str, two))}" for one, two in g)
        out.append((sum(len(o) for o, _ in g), sum(len(t) for _, t in g), len(g), len(links), sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links), hashlib.sha256(said.encode()).hexdigest()))
    return out


def compare(spark, texts, **options):
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, n_a int, segment string").repartition(2)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in T.align_documents(docs, **options).collect()}
    want = dict(enumerate(brute(texts)))
    assert len(got) == len(texts)
    for i in want:
        assert got[i] == want[i], (i, texts[i])


@pytest.fixture(scope="module")
def texts():
    odd = ["▁", "\x00", "　", "\xa0", "\x85", " ", "\x1c", "é", "é", "日本語", "🙂", "👩‍👩‍👧", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "'s", "'ll", ";\r", "{\r\n", ".", "0123", "ﬁ", "﻿", "İ", "ß"]
    space = [" ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", " \n ", "\x0b", "   \t", ""]
    words = [*odd, *("".join(RNG.choice("abcdefgs'") for _ in range(RNG.randint(1, 9))) for _ in range(80)), "the", "Hello", "running", "function()"]
    out = ["".join(RNG.choice(words[1:]) + RNG.choice(space) for _ in range(RNG.randint(1, 40))) for _ in range(250)]
    out += ["".join(RNG.choice(words) + RNG.choice(space) for _ in range(6)) for _ in range(40)]
    out += ["", None, " ", "  ", "\n", " \n", "\n ", "a", " a", "a ", "a  ", "\ta", "x" * 5000, "ab " * 3000, "日本" * 800, *out[:5]]
    return out


@pytest.mark.parametrize("chunk_chars, range_chars", [(16_000_000, 8_000_000), (900, 500)])
def test_documents_equal_whole_alignments(spark, texts, chunk_chars, range_chars):
    """In one chunk a task and one range, and in many of both."""
    compare(spark, texts, chunk_chars=chunk_chars, range_chars=range_chars)


def test_whole_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    compare(spark, [r["text"] for r in rows])


def test_null_and_string_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1 << 60, "c")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_groups"]) for r in T.align_documents(docs).collect()), key=str)
    assert got == [(1 << 60, 1), (None, 2), (None, 2)]
    assert T.align_documents(docs.limit(0)).collect() == []
    named = spark.createDataFrame([("k", None), ("m", "")], "name string, body string")
    assert sorted((r["doc_id"], r["n_a"], r["groups_sha256"]) for r in T.align_documents(named, "name", "body").collect()) == [("k", 0, ""), ("m", 0, "")]


def test_cuts_are_only_where_no_entry_merges_across():
    assert T.safe_spaces(["a b", "x\r", " \n", "\t\t"]) == "\n\t"
    pair = T.pair(*PATHS)
    assert " " in pair.spaces and "\r" not in pair.spaces
    text = " a b　 c\r\n d;\r e\n\nf \t g "
    assert "".join(pair.segments(text)) == text
    assert [s for s in pair.segments(text) if s] == [" a", " b　 c\r\n d;\r e", "\n\nf", " \t g", " "]


def test_documents_are_counted_alike_in_parts():
    """Counts of pairs don't depend on how many documents are looked at together."""
    import pandas as pd

    segments = [[1, 2], [2], [], [3, 4, 1]]
    left = pd.DataFrame({"ks": [T.packed([0, 2]), T.packed([1, 3])], "spelt": [T.packed([1, 1]), T.packed([1, 1])], "sizes": [T.packed([2, 0]), T.packed([1, 3])], "pairs": [T.packed([1, 2]), T.packed([2, 3, 4, 1])]})
    codes = [[0, 0, 1], [1], [], [2], [3, 1, 0], [3]] * 3
    right = pd.DataFrame({"codes": [T.packed(c) for c in codes]})
    want = Counter(p for c in codes for p in {p for k in c for p in segments[k]})
    for step in (1, 3, 400_000):
        got = T.linked_documents(left, right, step)
        assert dict(zip(got["pair"].tolist(), got["docs"].tolist(), strict=True)) == want
