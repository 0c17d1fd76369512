"""Inputs on which operators once lost or changed data, and cases of their docstrings: long texts, ties, repeats, hot keys."""

import hashlib
import itertools
import random
import time
import zlib

import numpy as np
import pytest

pytest.importorskip("gaugeline.llm")
import pyarrow as pa  # noqa: E402

from gaugeline.llm import bytes as B  # noqa: E402
from gaugeline.llm import html_text, token_files, url_filter, warc  # noqa: E402
from gaugeline.llm.queries import HOST_RULES, PATTERN_RULES, tokenizer_file  # noqa: E402


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


# ------------------------------------------------------------------ hashes


@pytest.mark.parametrize("n", [16, 64, 256, 512, 1024, 4096])
def test_regular_words_do_not_collide(n):
    """For a polynomial modulo 2^64 such words collide, whatever its base."""
    data, offsets = B.utf8(pa.array([thue_morse(n), thue_morse(n, "ba"), thue_morse(n) + "\0", thue_morse(n)]))
    h = B.hashes(data, *B.spans(data, offsets)[:2])
    assert h[0] == h[3] and len(set(h.tolist())) == 3


def test_hashes_differ_for_all_short_words():
    some = ["".join(x) for k in (1, 2, 3) for x in itertools.product("ab\0é", repeat=k)] + ["a" * k for k in range(5, 600, 7)]
    data, offsets = B.utf8(pa.array(some))
    h = B.hashes(data, offsets[:-1], offsets[1:])
    assert len(set(h.tolist())) == len(some)


def test_stretches_never_cut_words():
    rng = random.Random(1)
    text = " ".join("x" * rng.randrange(1, 40) for _ in range(300))
    data, offsets = B.utf8(pa.array([text]))
    found = [d.tobytes().decode() for d, _ in B.stretches(data, offsets, 50)]
    assert "".join(found) == text and [w for s in found for w in s.split()] == text.split() and len(found) > 20


# ------------------------------------------------------------------ token files


def expected_tokens(rows, path):
    own = token_files.Encoder(path).tokenizer
    out = []
    for i, t in rows:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return out


def test_regular_texts_keep_their_own_tokens(spark):
    rows = [(1, thue_morse(1024)), (2, thue_morse(1024, "ba")), (3, "a " * 3000 + thue_morse(4096))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_rows(spark, df, tokenizer_file()).collect())
    assert got == expected_tokens(rows, tokenizer_file())


def test_an_id_of_most_rows_gets_several_shards(spark):
    rng = random.Random(4)
    rows = [(7, f"copy {rng.randrange(10**6)} of the hot id") for _ in range(300)] + [(k, f"text {k}") for k in range(100)] + [(None, f"null {k}") for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    manifest = token_files.write_tokens(df, token_files.work_folder(spark, "hot"), tokenizer_file(), shard_bytes=1000)
    assert manifest.count() > 8 and manifest.agg({"n_docs": "max"}).first()[0] < 150
    got = sorted(token_files.read_tokens(manifest).collect(), key=lambda r: r["start"])
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(((i is None, i or 0), n, c) for i, n, c in expected_tokens(rows, tokenizer_file()))
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])])[:-1].tolist()
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))


# ------------------------------------------------------------------ main text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p>Words before <a href="/hidden-gems">gems</a> and after.</p></article>', "Words before gems and after."),
        ('<article><p title="a hidden valley">A valley lies behind the hills.</p></article>', "A valley lies behind the hills."),
        ('<article><p data-hidden="false" data-id="share-3">Data say nothing.</p></article>', "Data say nothing."),
        ('<article><p>One <span style="display:none">x</span>two <label>name</label> three.</p></article>', "One two three."),
        ('<article><div>One <span hidden><div>x</div></span></div><p>Two.</p></article>', "One\nTwo."),
        ("<div>A short sentence.</div>", "A short sentence."),
        ('<article><p>Text.</p><p class="share">Share it</p></article>', "Text."),
        ("<article><p>a<script>b</script ><p>c</article>", "a\nc"),
        ("<article><p>Fish &amp; chips &#8212; now &lt;b&gt;</p></article>", "Fish & chips \u2014 now <b>"),
    ],
)
def test_article_text_is_whole(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("part", ["<b>" + "<div>" * 1000 + "</b>" * 1000, "<script>" + "</script " * 5000, '<div class="ad">' * 1000 + "<article>" + "<p>x" * 1000])
def test_deep_pages_take_linear_time(part):
    def seconds(n):
        began = time.perf_counter()
        html_text.main_text(part * n)
        return time.perf_counter() - began

    seconds(1)
    assert seconds(8) < 40 * max(seconds(1), 0.02)


def test_main_text_is_the_cheapest_labelling():
    """Against all labellings of pages with up to ten blocks; of equal ones, that with the least text."""
    rng = random.Random(7)
    makers = ["<p>{}</p>", "<div>{}</div>", "<li>{}</li>", '<p><a href="#">{}</a></p>', '<div class="sidebar">{}</div>', "<h2>{}</h2>", '<div class="post">{}</div>']
    for _ in range(60):
        body = "".join(rng.choice(makers).format(" ".join("word" for _ in range(rng.randrange(1, 30)))) for _ in range(rng.randrange(1, 11)))
        page = rng.choice(["<article>{}</article>", "<div>{}</div>", "<main>{}</main>", "{}"]).format(body)
        found = html_text.blocks(page)
        score = [b.score() for b in found]
        bias = 0 if any(x > 0 for x in score) else html_text.BIAS
        cost = [round(1000 * (x if x == html_text.BAD else x - bias)) for x in score]
        last, edges = {}, []
        for i, b in enumerate(found):
            edges += [(i - 1, i, 300)] * (i > 0) + ([(last[id(b.container)], i, 500)] if id(b.container) in last else [])
            last[id(b.container)] = i

        def energy(labels, cost=cost, edges=edges):
            return sum(max(0, c) if not x else max(0, -c) for c, x in zip(cost, labels, strict=True)) + sum(c for i, j, c in edges if labels[i] != labels[j])

        every = list(itertools.product((0, 1), repeat=len(found)))
        least = min(map(energy, every))
        best = min((x for x in every if energy(x) == least), key=sum)
        assert html_text.main_text(page) == "\n".join(b.text for b, x in zip(found, best, strict=True) if x)


def test_repeated_and_long_pages(spark):
    long = "<article>" + "<p>some words of prose</p>" * 20_000 + "</article>"
    df = spark.createDataFrame([(1, "u", long, 1), (1, "u", long, 2), (2, "u", "<nav>x</nav>", 3)], "page_id long, url string, html string, text int")
    got = html_text.extract(df).collect()
    assert sorted((r["page_id"], r["n_chars"], r["text"] == "\n".join(["some words of prose"] * 20_000)) for r in got) == [(1, 20 * 20_000 - 1, True)] * 2 + [(2, 0, False)]


# ------------------------------------------------------------------ url filters


def test_hosts_with_line_ends_fit_their_rules(spark):
    urls = ["x://a\nb.org/en/", "x://a.com/b.org\n/zzz", "x://casino-win.a\nb/", "x://a\nb.example.org/es/\n", "x://org", "x://org/\n"]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, HOST_RULES, PATTERN_RULES).collect()}
    assert got[0] == ("a\nb.org", "org/", "allow") and got[1] == ("a.com", None, "allow") and got[3] == ("a\nb.example.org", "example.org/es/", "block")
    assert got[4] == ("org", None, "allow") and got[5] == ("org", "org/", "allow")
    assert got[2][1:] == (None, "block")


def test_many_rules_and_ties(spark):
    rules = [url_filter.HostRule(f"site{k}.net/", "block") for k in range(2000)] + [url_filter.HostRule("b.net/aa", "allow"), url_filter.HostRule("net/b/aa", "block"), url_filter.HostRule("b.net/aa", "block")]
    df = spark.createDataFrame([(1, "h://x.site1999.net/"), (2, "h://b.net/aaa"), (3, "h://b.net/b/aa"), (1, "h://x.site1999.net/")], "page_id long, url string")
    got = sorted((r["page_id"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, rules).collect())
    assert got == [(1, "site1999.net/", "block"), (1, "site1999.net/", "block"), (2, "b.net/aa", "allow"), (3, "net/b/aa", "block")]


# ------------------------------------------------------------------ archives


def test_null_page_ids_revisit(spark):
    body = "<p>" + "z" * 2000
    df = spark.createDataFrame([(None, "u", body), (4, "u", body), (None, "u", body + "other"), (None, "v", body + "other")], "page_id long, url string, html string")
    got = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in warc.page_rows(spark, df).collect())
    assert got == [("4", "response", "None"), ("None", "response", "None"), ("None", "response", "None"), ("None", "revisit", "4")]


def test_salvage_of_many_damaged_members_is_linear():
    """Thousands of false starts of one kind and none of the other: the rest of the file isn't searched again for each."""
    import io

    good = warc.member(warc.record("response", 1, "http://a/", b"x" * 50, hashlib.sha1(b"x" * 50).hexdigest()))

    def found(n):
        began = time.perf_counter()
        rows = list(warc.salvage(io.BytesIO((warc.GZIP + b"junk" * 20) * n + good)))
        assert isinstance(rows[0], warc.Gap) and rows[0].end == 83 * n and len(rows) == 2 and rows[1][1].payload == b"x" * 50
        return time.perf_counter() - began

    found(10)
    assert found(16_000) < 40 * max(found(2000), 0.02)
