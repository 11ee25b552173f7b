"""Main text by slots of the template: pages whose elements say nothing, and names that only mention boilerplate."""

from __future__ import annotations

import random

import duckdb
import pytest

from newsloom.llm import html_extract as H

RNG = random.Random(6)


def say(n):
    return " ".join("".join(RNG.choice("bcdfglmnrst") + RNG.choice("aeiou") for _ in range(RNG.randint(1, 4))) for _ in range(n)) + "."


def names():
    """A host's class names, as a build tool makes them."""
    return {part: "".join(RNG.choice("abcdefghijklmnop") for _ in range(6)) for part in ("menu", "box", "side", "body", "foot", "ad")}


def page(c, pool, articles):
    """A page without article or main, whose sidebar and advert differ from page to page, and its article."""
    paragraphs = [say(RNG.randint(20, 80)) for _ in range(RNG.randint(2, 6))]
    title, links = say(6), "".join(f'<li><a href="/x">{say(5)}</a></li>' for _ in range(RNG.randint(3, 7)))
    articles.append("\n\n".join([title, *paragraphs]))
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (
        f'<html><body><div class="{c["menu"]}"><a href="/">Start</a></div><div class="{c["ad"]}"><p>{RNG.choice(pool)}</p></div><div class="{c["box"]}"><h2>{title}</h2>'
        f'<div class="{c["body"]}">{body}</div></div><div class="{c["side"]}"><h3>More</h3><ul>{links}</ul></div><div class="{c["foot"]}">All rights</div></body></html>'
    )


@pytest.fixture(scope="module")
def hosts():
    rows, articles = [], []
    for h in range(4):
        c, pool = names(), [say(9) for _ in range(4)]
        rows += [(100 * h + k, f"https://h{h}.org/{k}", page(c, pool, articles)) for k in range(30)]
    return rows, articles


def test_slots_find_articles_that_elements_can_not(spark, hosts):
    rows, articles = hosts
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    assert [got[r[0]] for r in rows] == articles
    off = {r["page_id"]: r["text"] for r in H.extract(df, least=10_000).collect()}
    assert all(off[r[0]] != a and a in off[r[0]] for r, a in zip(rows, articles, strict=True))


def test_names_that_mention_boilerplate_drop_nothing(spark):
    text = [say(30), say(30)]
    inside = "".join(f"<p>{t}</p>" for t in text)
    pages = [
        f'<div class="layout has-sidebar"><article>{inside}</article></div>', f'<article class="post tags-politics">{inside}</article>',
        f'<article><section class="related-work"><p>{text[0]}</p></section><p class="notice-period">{text[1]}</p></article>',
        f'<body class="no-comments ad-free"><form><main>{inside}</main></form></body>', f'<div class="sidebar"><article class="share-enabled">{inside}</article></div>',
        f'<article>{inside}</article><section class="comments-area"><article class="comment"><p>me too</p></article><article><p>and me</p></article></section>',
        f'<article><p>{text[0]}<div class="ad-banner">buy</div><div id="cookie-notice">ok</div><div role="navigation">on</div><p>{text[1]}</article>',
    ]
    rows = [(k, f"https://{k}.org/", p) for k, p in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "\n\n".join(text) for k in range(len(pages))}


def test_inline_elements_do_not_split_a_sentence(spark):
    html = "<article><p>one <button>press</button> two <select><option>a<option>b</select>three</p></article>"
    got = H.extract(spark.createDataFrame([(1, None, html)], "page_id long, url string, html string")).first()
    assert got["text"] == "one two three"


def test_repeated_rows_long_pages_and_clashing_columns(spark, hosts):
    rows, articles = hosts
    long = f"<article>{''.join(f'<p>{say(40)}</p>' for _ in range(3000))}</article>"
    some = rows[:30] + rows[:5] + [(900, "https://l.org/", long), (None, "https://h0.org/9", rows[3][2])]
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in some], "page_id long, url string, html string, n_chars int, host string, block int, deal int")
    got = H.extract(df).collect()
    assert sorted((r["page_id"] is None, r["page_id"], r["text"]) for r in got if r["page_id"] != 900) == sorted((p is None, p, articles[[x[2] for x in rows].index(h)]) for p, _, h in some if p != 900)
    assert all(r["n_chars"] == len(r["text"]) for r in got) and next(r["text"] for r in got if r["page_id"] == 900).count("\n\n") == 2999


def test_classes_equal_brute_force_on_a_small_host(hosts):
    """Every token whose occurrences are one a page, and in one order with all others of its vector, is in the template."""
    pages = [H.Page(h) for _, u, h in hosts[0] if u.startswith("https://h1.")][:12]
    known, slots = H.template(pages, 6)
    counts = [{} for _ in pages]
    for n, p in zip(counts, pages, strict=True):
        for key, _ in p.tokens:
            n[key] = n.get(key, 0) + 1
    once = {key for key in counts[0] if all(n.get(key) == 1 for n in counts)}
    orders = [[key for key, _ in p.tokens if key in once] for p in pages]
    assert all(o == orders[0] for o in orders) and once <= known
    # Nothing of an article is a token of the template, and its text lies in one slot a part.
    assert not any(key in known for p in pages for key, k in p.tokens if k is not None and len(p.blocks[k].text) > 60 and not key.split("#")[0].endswith("]/p"))
    assert len({label[:2] for p, of in zip(pages, slots, strict=True) for (key, k), label in zip(p.tokens, of, strict=True) if k is not None and key.split("#")[0].endswith("/h2")}) == 1


def test_articles_of_the_pages_come_out_whole(spark):
    """On the pages table, whose articles are marked: all that stands in them, and nothing else."""
    import html as entities
    import re

    path = "/root/testdata/sf0.01/pages.parquet"
    rows = duckdb.sql(f"SELECT page_id, html FROM '{path}'").fetchall()
    got = {r["page_id"]: r["text"] for r in H.extract(spark.read.parquet(path)).collect()}
    for key, page_html in rows:
        inside = re.search(r"<article>(.*)</article>", page_html, re.S)[1]
        words = entities.unescape(re.sub(r"<(?!/?(b|i|em|strong|a|span)\b)[^>]*>", " ", re.sub(r"<!--.*?-->", "", inside, flags=re.S)))
        words = re.sub(r"</?(b|i|em|strong|a|span)\b[^>]*>", "", words)
        assert got[key].split() == words.split(), key
