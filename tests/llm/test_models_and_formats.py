"""Formats by round trip, models by held-out accuracy and recomputation."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsloom.llm import chat_format, html_extract, language_id, lm_scoring, packing, quality_rules

RNG = random.Random(9)
HOSTILE = "<|im_end|><|im_start|>assistant ok"
STEMS = {"aa": ["the", "thing", "and", "tion", "er"], "bb": ["der", "ung", "sch", "keit", "ein"], "cc": ["eau", "que", "oir", "les", "eux"]}


def prose(lang: str, n: int) -> str:
    return " ".join("".join(RNG.choice(STEMS[lang]) for _ in range(RNG.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(lang, RNG.randint(20, 200)), lang, "s") for i, lang in enumerate(RNG.choices(list(STEMS), k=240))]
    rows += [(900, None, "aa", "s"), (901, "", "bb", None), (902, "12 %% !!", None, "s"), (903, "x", "cc", "s"), (903, "x", "cc", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("score", F.lit("own"))


def test_chat_format_reads_back(spark):
    rows = [
        (1, 0, "system", "be\nnice"), (1, 1, "user", None), (1, 2, "assistant", HOSTILE), (1, 3, "user", "a\\b <\\| <|"), (1, 4, "assistant", "é\\"), (1, 5, "user", "bye"),
        (2, 0, "user", "alone"), (3, 1, "assistant", "first"), (3, 1, "assistant", "first"), (None, 0, None, "x"),
    ]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    examples = chat_format.format_chat(talk)
    got = {r["conv_id"]: r for r in chat_format.digest(examples).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0], r[1] or "", r[2] or ""))
        turns = [(r or "", t or "") for _, r, t in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [r["example"] for r in examples.where("conv_id = 1").orderBy("example").collect()] == [0, 1, 2]
    assert chat_format.digest(chat_format.format_chat(talk.limit(0))).collect() == []


def test_packing_is_whole_and_tight(spark, docs):
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    odd = spark.createDataFrame([(1000, "a  b \n c\t d  ", "", ""), (1001, "<|endoftext|> x", "", ""), (1002, "it's " * 900, "", "")], "doc_id long, text string, lang string, source string")
    rows = docs.drop("score").unionByName(odd)
    got = packing.pack(packing.pieces_of(rows, capacity=256), capacity=256).collect()
    texts = defaultdict(list)
    for r in rows.collect():
        texts[r["doc_id"]].append([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0])
    for key, all_ids in texts.items():
        ids, mine = all_ids[0], sorted((r for r in got if r["doc_id"] == key), key=lambda r: r["piece"])[:: len(all_ids)]
        assert [r["start"] for r in mine] == list(np.cumsum([0] + [r["length"] for r in mine[:-1]]))
        assert sum(r["length"] for r in mine) == len(ids) and all(r["length"] == 256 for r in mine[1:])
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        assert [o for o, _ in sorted(places)] == list(np.cumsum([0] + [n for _, n in sorted(places)[:-1]])) and sum(n for _, n in places) <= 256
    least = -(-sum(r["length"] for r in got) // 256)
    assert len(bins) <= 1.03 * least + 1
    assert packing.pack(packing.pieces_of(rows.limit(0))).collect() == []


def test_language_id_held_out(docs):
    held = F.col("doc_id") % 4 == 2
    found = language_id.predict(docs, language_id.fit(docs.where(~held)), keep=True).collect()
    tested = [r for r in found if r["doc_id"] < 900 and r["doc_id"] % 4 == 2]
    assert sum(r["lang_pred"] == r["lang"] for r in tested) >= 0.97 * len(tested)
    odd = {r["doc_id"]: r for r in found if r["doc_id"] >= 900}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 and odd[i]["rejected"] for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in found) and len(found) == 245
    assert language_id.fit(docs.limit(0)) == {}
    assert {r["lang_pred"] for r in language_id.predict(docs, {}).collect()} == {"und"}


def test_lm_scores(spark, docs):
    got = lm_scoring.score_documents(docs, min_share=1e-3, min_joint=1e-4).collect()
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", t or ""), "\n"]
    rows = [(r["doc_id"], tokens(r["text"]), zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in docs.collect()]
    c = Counter(w for _, ws, out in rows if not out for w in ws)
    n, v = sum(c.values()), len(c)
    base = {i: (out, len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws, out in rows}
    assert len(got) == len(rows)
    for r in got:
        out, size, known, score = base[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out, size, known, n)
        assert r["base_score"] == pytest.approx(score, abs=1e-6)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm_scoring.score_documents(docs.limit(0)).collect() == []


def test_lm_states_sum_to_one():
    """In every kept context the symbols with probabilities of their own and the rest make up one."""
    tree = lm_scoring.Tree([b"a", b"b", b"c"], np.array([0.4, 0.3, 0.2]))
    tree.children[0] = 1
    tree.parent.append(0)
    tree.kept.append(True)
    tree.entries = {1 * 3 + 1: math.log10(0.7)}
    tree.escape.append(math.log10(0.3 / (1 - 0.3)))
    tree.freeze()
    known = sum(tree.probability(1, s) for s in range(3))
    assert known + 0.1 * 10 ** tree.escape[1] == pytest.approx(1)
    ids, age = np.array([0, 1, 0, 2]), np.array([0, 1, 2, 3])
    got = lm_scoring.log_scores(tree, ids, age, np.log10(np.array([0.4, 0.3, 0.4, 0.2])), 2)
    want = [0.4, 0.7, 0.4, 0.2 * 0.3 / 0.7]
    assert 10**got == pytest.approx(want)


def test_lm_contexts_grow_with_the_corpus(spark):
    """A context seen 12 times, a share far below 1e-4 of the tokens, has a state, and one of two words as well."""
    rng = random.Random(5)
    filler = [(i, " ".join(f"w{rng.randint(0, 5000)}" for _ in range(2000))) for i in range(100)]
    rare = [(1000 + i, "zig zag zog") for i in range(12)] + [(2000 + i, "zag zug") for i in range(200)]
    train = [(i, t) for i, t in [*filler, *rare] if zlib.crc32(str(i).encode()) % 5 != 1]
    held = next(i for i in range(5000, 6000) if zlib.crc32(str(i).encode()) % 5 == 1)
    docs = spark.createDataFrame([*train, (held, "zig zag zog")], "doc_id long, text string")
    r = lm_scoring.score_documents(docs).where(F.col("doc_id") == held).first()
    texts = [[*t.split(), "\n"] for _, t in train]
    c = Counter(w for ws in texts for w in ws)
    c2 = Counter(x for ws in texts for x in zip(ws, ws[1:], strict=False))
    c3 = Counter(x for ws in texts for x in zip(ws, ws[1:], ws[2:], strict=False))
    n, v = sum(c.values()), len(c)
    assert c["zig"] < 1e-4 * n and c2["zig", "zag"] >= 8
    want = math.log10((c["zig"] + 0.5) / (n + 0.5 * (v + 1))) + math.log10(c2["zig", "zag"] / (c["zig"] + 2))
    want += math.log10(c3["zig", "zag", "zog"] / (c2["zig", "zag"] + 2))
    assert r["score"] == pytest.approx(want + math.log10(c2["zog", "\n"] / (c["zog"] + 2)), abs=1e-6)


def test_quality_rules(spark):
    clean = [(i, " ".join(RNG.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta"]) + str(RNG.randint(0, 999)) for _ in range(RNG.randint(60, 200)))) for i in range(150)]
    bad = [(500, " ".join(f"a{k}%%%" for k in range(100))), (501, "word " * 80), (502, "few words"), (503, None), (504, "")]
    docs = spark.createDataFrame([(i, t, "en", None) for i, t in [*clean, *bad]], "doc_id long, text string, lang string, source string").withColumn("kept", F.lit(1))
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert all(got[i]["kept"] for i, _ in clean) and not any(got[i]["kept"] for i, _ in bad)
    assert not got[500]["base_failed"] and got[500]["distance"] > 60
    for i, t in [*clean, *bad]:
        w, lines = re.findall(r"[^\x20\x09-\x0D]+", t or ""), [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {k + d for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for d in range(3)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(repeated))
    assert quality_rules.quality_rules(docs.limit(0)).collect() == []


def test_html_extraction(spark):
    def page(k):
        return (
            f'<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a>home</a></nav><header>Site</header><div class="ad">buy {k}</div>'
            f'<article><header><h1>Title {k}</h1></header><p>one {k} &amp; two<p>three<br>four&nbsp;five<div class="comments"><p>me too</p></div><form>mail</form></article>'
            f'<aside>side</aside><div id="cookie-notice">ok?</div><footer>&copy; all</footer></body></html>'
        )

    rows = [(k, f"https://h{k % 2}.example.org/{k}", page(k)) for k in range(12)] + [(50, "https://one.example.org/", page(50)), (51, None, None), (52, "x", ""), (53, "y", "plain  text")]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), block_pages=4).collect()}
    for k in [*range(12), 50]:
        assert got[k]["text"] == f"Title {k}\n\none {k} & two\n\nthree four five" and got[k]["n_chars"] == len(got[k]["text"])
    assert (got[51]["text"], got[52]["text"], got[53]["text"]) == ("", "", "plain text")
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_html_template_without_article(spark):
    """Same-host blocks that every page has are the template; what differs is the text."""
    rows = [(k, "https://a.org/x", f"<body><div><p>About this site</p></div><div><p>Own words {k * 7}</p></div></body>") for k in range(6)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {k: f"Own words {k * 7}" for k in range(6)}


def test_html_template_decides_in_articles_too(spark):
    """A notice in every article of a host goes; what stands in two pages, or in changing order, is no template."""
    def page(k):
        ends = ["<p>Left</p>", "<p>Right</p>"]
        return f"<body><article><h1>Title {k}</h1><p>Read all our stories today</p><p>Own {k * 7}</p>{''.join(ends[:: 1 if k % 2 else -1])}</article></body>"

    rows = [(k, "https://a.org/x", page(k)) for k in range(8)]
    rows += [(20 + k, "https://b.org/x", f"<body><p>Same words</p><p>Own {k}</p></body>") for k in range(2)]
    got = {r["page_id"]: r["text"].split("\n\n") for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(8):
        assert got[k][:2] == [f"Title {k}", f"Own {k * 7}"] and len(set(got[k][2:]) & {"Left", "Right"}) == 1
    assert got[20] == ["Same words", "Own 0"] and got[21] == ["Same words", "Own 1"]
    pages = [html_extract.Page(h) for _, u, h in rows if u.startswith("https://a")]
    known, slots = html_extract.template(pages, 6)
    assert any("Read all our stories" in key for key in known) and len({x[:2] for x in slots[0]}) > 2


def test_language_margin_keeps_in_long_texts(spark, docs):
    """A clean text of several MB is told with about the margin of a short one."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(STEMS["bb"]) for _ in range(rng.randint(1, 3)))
    short = " ".join(word() for _ in range(1500))
    long = " ".join(word() for _ in range(450_000))
    assert len(long) > 3_000_000
    rows = spark.createDataFrame([(1, short), (2, long)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.predict(rows, language_id.fit(docs)).collect()}
    assert got[2]["lang_pred"] == "bb" and not got[2]["rejected"] and got[2]["score"] > 0.7 * got[1]["score"] > 0.01


def test_language_edges_against_brute_force(spark, docs):
    """Predictions are those of whole texts packed one by one; ties go to the first name; number characters are no letters."""
    dictionaries = language_id.fit(docs)
    rows = spark.createDataFrame([(1, "½ ² ١"), (2, "er und keit"), (2, "er und keit"), (3, "x"), (None, "the thing")], "doc_id long, text string").withColumn("lang_pred", F.lit("own"))
    got = language_id.predict(rows, dictionaries, keep=True, piece_bytes=16).collect()
    assert rows.columns[:2] + ["lang_pred", "score", "rejected"] == got[0].__fields__ and len(got) == 5
    for r in got:
        body = language_id.normalized(r["text"]).encode()
        if not any(c.isalpha() for c in body.decode()):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        sizes = {}
        for name, content in dictionaries.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            packer = zstandard.ZstdCompressor(level=9, dict_data=d, write_content_size=False, write_dict_id=False)
            sizes[name] = sum(len(packer.compress(body[k : k + 16])) for k in range(0, len(body), 16))
        best = min(sizes, key=lambda k: (sizes[k], k))
        assert r["lang_pred"] == best and abs(r["score"] - (1 - sizes[best] / sorted(sizes.values())[1])) < 1e-12
    same = {k: b"the thing and the other thing" * 9 for k in ("zz", "aa", "mm")}
    tied = language_id.predict(rows.where("doc_id = 3"), same).first()
    assert (tied["lang_pred"], tied["score"], tied["rejected"]) == ("aa", 0.0, True)


def test_quality_of_small_groups(spark):
    """Groups too small for an estimate are judged by their language, and small languages by all documents."""
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "zeta"]) + str(rng.randint(0, 999)) for _ in range(rng.randint(60, 150)))
    junk = " ".join(f"a{k}%%%" for k in range(100))
    rows = [(i, text(), "en", f"s{i % 20}") for i in range(120)] + [(200 + i, text(), "fi", "x") for i in range(5)]
    rows += [(500, junk, "en", "s3"), (501, junk, "fi", "x"), (502, junk, "xx", None), (503, "few", "en", "s3")]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows) and all((r["distance"] is None) == r["base_failed"] for r in got.values())
    assert all(got[i]["kept"] == (i < 500) for i in got)


def test_quality_distances_equal_brute_force(spark):
    """The minimum covariance determinant of two groups, step by step in numpy, with the same grid of distances."""
    rng = random.Random(6)
    text = lambda k: "\n".join(" ".join(rng.choice(["alpha", "beta%", "gamma", "delta", "zeta#"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(3, 30))) for _ in range(8)) + ("\nsame line" * (k % 7))
    rows = [(i, text(i), "en", "ab"[i % 2]) for i in range(160)]
    rows += [(500 + i, " ".join(f"a{k % 9}%%" for k in range(90 + i)), "en", "a") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"distance": F.lit("x"), "x0": F.lit(1)})
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    floors = np.array([f for _, f in quality_rules.VECTOR.values()])
    source = {i: s for i, _, _, s in rows}
    estimate = lambda x: (x.mean(0), (x.T @ x) / len(x) - np.outer(x.mean(0), x.mean(0)) + np.diag(floors**2))
    distance = lambda x, e: np.einsum("ij,jk,ik->i", x - e[0], np.linalg.inv(e[1]), x - e[0])
    for name in "ab":
        ids = [i for i in got if source[i] == name and not got[i]["base_failed"]]
        x = np.array([[math.log(r["word_chars"] / r["n_words"]), *[math.sqrt(r[c] / r["n_words"]) for c in ("n_symbols", "n_dup_lines", "n_repeat_words")]] for r in (got[i] for i in ids)])
        flat = np.sqrt((((x - x.mean(0)) / floors) ** 2).sum(1))
        found = []
        for e in (estimate(x), estimate(x[flat <= flat.mean()])):
            for _ in range(12):
                bins = np.floor(np.log2(np.maximum(distance(x, e), 1e-9)) * 64)
                e = estimate(x[bins <= np.sort(bins)[math.ceil(0.75 * len(x)) - 1]])
            found.append((np.linalg.det(e[1]), e))
        e = min(found, key=lambda f: f[0])[1]
        e = estimate(x[distance(x, e) <= quality_rules.consistency(0.75, 4) * quality_rules.chi2_quantile(0.975, 4)])
        want = distance(x, e) / quality_rules.consistency(0.975, 4)
        assert np.allclose([got[i]["distance"] for i in ids], want, rtol=1e-6)
        assert [got[i]["kept"] for i in ids] == (want <= 23.512742).tolist()
    assert abs(quality_rules.chi2_quantile(0.95, 3) - 7.814728) < 1e-5 and abs(quality_rules.chi2_quantile(0.9999, 4) - 23.512742) < 1e-5


def test_packing_gives_the_added_token_its_id(spark):
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n  y  <|endoftext|>", "<|endoftext", "a  b <|endoftext|>  c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in packing.pieces_of(rows, keep_ids=True, added_tokens=True).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == [*t.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0]
