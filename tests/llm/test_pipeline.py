"""The pipeline's stages on a small fixture, each judged on its own input."""

from __future__ import annotations

import pytest

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if "text" in docs.columns else {}
        docs = corpus_pipeline.materialized(stage(spark, docs, DATA))
        out.append((name, before, docs))
    return out


def test_stages_take_effect(spark, kept):
    bench = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for name, before, docs in kept[:-1]:
        assert docs.columns == corpus_pipeline.COLUMNS
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before) and len(after) >= 0.8 * len(before), name
        if name == "jaccard_join":
            assert len(set(after.values())) == len(after)
        if name == "decontamination":
            assert not any(b in t for t in after.values() for b in bench)
        if name == "suffix_dedup":
            seen = set()
            for t in after.values():
                b = t.encode()
                mine = {b[k : k + 400] for k in range(len(b) - 399)}
                assert not any(x in seen for x in mine)
                seen |= mine
    _, before, packed = kept[-1]
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(before)


def test_near_duplicates_of_null_and_shared_ids(spark):
    """Different texts with null ids or one id all stay, and a copy with a null id goes."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None, text(1)), (None, text(2)), (5, text(3)), (5, text(4)), (7, text(5)), (None, text(5)), (8, text(6)), (9, text(6))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == {(None, text(1)), (None, text(2)), (5, text(3)), (5, text(4)), (7, text(5)), (8, text(6))}


def test_near_duplicates_equal_brute_force(kept):
    """Of each component of texts with a similarity of 0.8 or more, on five words, that with the smallest id."""
    before, after = next((b, {r["doc_id"] for r in d.collect()}) for name, b, d in kept if name == "jaccard_join")
    split = {i: [w.decode() for w in (t or "").encode().split()] for i, t in before.items()}
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for i, w in split.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if len(sets[i]) < 0.8 * len(sets[j]):
                break
            if find(i) != find(j) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert after == {i for i in sets if find(i) == i} and len(after) < len(before)


def test_repeated_passages_equal_brute_force(kept):
    """Every byte of a 300-byte string that stands twice goes, with the characters it cuts; texts with nothing left go."""
    before, after = next((b, {r["doc_id"]: (r["text"], r["n_chars"]) for r in d.collect()}) for name, b, d in kept if name == "suffix_dedup")
    width, count = corpus_pipeline.PASSAGE_BYTES, {}
    raw = {i: (t or "").encode() for i, t in before.items()}
    for b in raw.values():
        for k in range(len(b) - width + 1):
            count[b[k : k + width]] = count.get(b[k : k + width], 0) + 1
    want, changed = {}, 0
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if count[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        if not any(gone):
            want[i] = before[i]
            continue
        changed += 1
        text = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="ignore")
        if text.strip(" "):
            want[i] = text
    assert {i: t for i, (t, _) in after.items()} == want and changed > 3
    assert all(n == len(t) for i, (t, n) in after.items() if t != before[i])


def test_pieces_spell_the_documents(kept):
    """The pieces of each document are its ids, whole and in order, and no sequence is over its length."""
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    _, before, packed = kept[-1]
    rows, at = packed.collect(), {}
    for r in rows:
        at.setdefault(r["doc_id"], []).append(r)
    for i, text in before.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(at[i], key=lambda r: r["piece"])
        assert sum(r["length"] for r in mine) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine)
    ends: dict = {}
    for r in rows:
        ends[r["sequence_id"]] = max(ends.get(r["sequence_id"], 0), r["offset"] + r["length"])
    assert max(ends.values()) <= 2048 and sum(r["length"] for r in rows) == sum(ends.values())


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    """Every stage takes an empty table, and columns with names that stages use themselves aren't carried."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), DATA)
        assert out.count() == 0 and (name == "packing" or out.columns == corpus_pipeline.COLUMNS)
    extra = docs.limit(30).selectExpr("*", "1 AS _row", "'x' AS class_id", "2 AS removed", "3 AS kept", "'y' AS rejected", "4 AS piece")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, extra, DATA)
        assert got.count() >= 20 and (name == "packing" or got.columns == corpus_pipeline.COLUMNS)
