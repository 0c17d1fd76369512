import io
import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("gaugeline.llm")
from gaugeline.llm import bytes as B  # noqa: E402
from gaugeline.llm import decontaminate, html_text, lm_score, media, near_dup, quality, token_files, url_filter, warc  # noqa: E402


def test_words_hash_alike_wherever_they_stand():
    data, offsets = B.utf8(pa.array(["one two  one", None, "", " two\tone"]))
    starts, ends, before = B.spans(data, offsets)
    h = B.hashes(data, starts, ends)
    assert before.tolist() == [0, 3, 3, 3, 5]
    assert h[0] == h[2] == h[4] and h[1] == h[3] != h[0]


def test_words_longer_than_a_window():
    long = "x" * (B.LONG * 2 + 5)
    data, offsets = B.utf8(pa.array([f"a {long}", long]))
    h = B.hashes(data, *B.spans(data, offsets)[:2])
    assert h[1] == h[2]


def test_pieces_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (0, 10, 3, 50, 1)] + [None]})
    cut = list(B.pieces(iter([batch]), "text", 12))
    assert sum(c.num_rows for c in cut) == 6 and [x for c in cut for x in c.column(0).to_pylist()] == batch.column(0).to_pylist()


def test_shingles_of_short_texts():
    data, offsets = B.utf8(pa.array(["a b", "", "a b c d e f"]))
    starts, ends, before = B.spans(data, offsets)
    _, at = B.shingles(B.hashes(data, starts, ends), before, 5)
    assert at.tolist() == [0, 1, 1, 3]


# ------------------------------------------------------------------ signatures


@pytest.mark.parametrize(("n", "shared"), [(200, 160), (15, 12), (1, 1), (2000, 1900)])
def test_signature_agreement_estimates_jaccard(n, shared):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 62, 2 * n, dtype=np.uint64)
    e = np.concatenate([base[:n], base[:shared], base[n : 2 * n - shared]])
    s = near_dup.dart_signatures(e, None, np.array([0, n, 2 * n]), 1500)
    assert abs((s[0] == s[1]).mean() - shared / (2 * n - shared)) < 0.05


def test_weighted_signatures():
    rng = np.random.default_rng(5)
    e = rng.integers(0, 1 << 62, 80, dtype=np.uint64)
    a, b = rng.integers(1, 9, 80).astype(float), rng.integers(1, 9, 80).astype(float)
    s = near_dup.dart_signatures(np.concatenate([e, e]), np.concatenate([a, b]), np.array([0, 80, 160]), 2000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05


# ------------------------------------------------------------------ tokens


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return str(public.path(token_files.TOKENIZER))


def test_encoder_agrees_with_whole_texts(tokenizer):
    rng = random.Random(3)
    alphabet = ["word", " ", "  ", "\n", "\t", "'s", "12", "a1", ".", "!!", "é", "ß", " ", "　", "日本", "😀", "<|endoftext|>", "\x1c", "don't", "-", "_", "\r\n", "…"]
    texts = ["", None, "   ", " a", "a ", "\n\n a"] + ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(400)]
    own = token_files.Encoder(tokenizer)
    want = own.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [x.tolist() for x in own.encode_column(pa.array(texts, pa.string()))] == [e.ids for e in want]


def test_shard_round_trip_and_damage():
    docs = [(-5, b""), (3, b"abc" * 50), (3, b"other"), (9, b"\0" * 1000)]
    out = io.BytesIO()
    token_files.write_shard(iter(docs), out)
    shard = token_files.Shard(io.BytesIO(out.getvalue()))
    assert [(int(i), shard.read(k)) for k, i in enumerate(shard.ids)] == docs
    assert shard.find(3) == [b"abc" * 50, b"other"] and shard.find(4) == []
    raw = bytearray(out.getvalue())
    raw[int(shard.at[1]) + 12] ^= 1
    with pytest.raises(Exception):  # noqa: B017 - the frame's or the table's checksum
        token_files.Shard(io.BytesIO(bytes(raw))).read(1)
    with pytest.raises(ValueError):
        token_files.Shard(io.BytesIO(b"no seek table at all, but long enough"))


# ------------------------------------------------------------------ html


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
<div class="cookie-notice"><p>We use cookies and say so in a text that is long enough to look like content to a counter of words.</p></div>
<div id="sidebar-wrapper"><article><h1>Title &amp; more</h1><p>First   <b>para</b>graph&nbsp;here, <a href=x>linked</a>.<p>Second &#233; &lt;tag&gt;<br>line
<div class="ad">Buy now</div><ul><li>one<li>two</ul><form><p>Your address</p></form></article></div>
<section id="comments"><article class="comment"><p>I liked this very much, thank you for the long and good article, really.</p></article></section>
<aside><p>Aside</p></aside><script>if (a<b) document.write("<p>x</p>")</script><footer>&copy; me</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more\nFirst paragraph here, linked.\nSecond é <tag> line\none\ntwo"


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- open", "<script>x", "</p></div>", "<div>" * 3000, "<table><tr><td>a<td>b"])
def test_odd_pages_do_not_fail(page):
    assert isinstance(html_text.main_text(page), str)


def test_minimum_cut_against_all_labellings():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(1, 8)
        costs = [rng.randrange(-20, 21) for _ in range(n)]
        edges = [(i, j, rng.randrange(0, 15)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

        def value(label):
            return sum(c for c, x in zip(costs, label) if c > 0 and not x) - sum(c for c, x in zip(costs, label) if c < 0 and x) + sum(c for i, j, c in edges if label[i] != label[j])

        best = min(value([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert value(html_text.source_side(costs, edges)) == best


# ------------------------------------------------------------------ decontamination


def _slow_alignment(item, passage):
    h = [[0.0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a == b else -0.5), h[i - 1][j] - 0.5, h[i][j - 1] - 0.5)
    return max(map(max, h))


def test_alignment_against_the_plain_recurrence():
    rng = np.random.default_rng(2)
    items = [rng.integers(0, 6, rng.integers(1, 15)).astype(np.uint64) * np.uint64(4) for _ in range(50)]
    passages = [rng.integers(0, 6, rng.integers(0, 25)).astype(np.uint64) * np.uint64(4) for _ in range(50)]
    for (score, begin, end), i, p in zip(decontaminate.alignments(items, passages), items, passages, strict=True):
        assert score == pytest.approx(_slow_alignment(i.tolist(), p.tolist()))
        assert _slow_alignment(i.tolist(), p[begin:end].tolist()) == pytest.approx(score)


def test_matcher_finds_edited_copies_and_leaves_others():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [" ".join(rng.choices(vocabulary, k=rng.randrange(12, 50))) for _ in range(30)]
    m = decontaminate.Matcher.of(list(range(30)), items)
    texts, want = [], set()
    for k in range(60):
        words = rng.choices(vocabulary, k=200)
        if k % 2:
            edited = [w if rng.random() > 0.15 else rng.choice(vocabulary) for w in items[k % 30].split()]
            words[50:50] = [w.upper() + "," for w in edited]
            want.add((k, k % 30))
        texts.append(" ".join(words))
    found = m.hits(pa.array([*texts, None, ""]), 0.4)
    assert {(t, i) for t, i, *_ in found} == want
    assert m.hits(pa.array([items[0]]), 0.4)[0][:3] == (0, 0, 1.0)


@pytest.mark.parametrize("seen", ["front", "back"])
def test_copies_of_half_an_item_that_is_leaked_thousands_of_times(spark, seen):
    """The whole of the first item is leaked, and half of the second: the other copies are those of the halves."""
    items = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(2)]
    half = [" ".join(t.split()[20:] if seen == "back" else t.split()[:20]) for t in items]
    texts = [items[0]] * 1500 + [half[0]] * 20 + [f"{half[1]} and {k} more words" for k in range(1000)]
    texts += [" ".join(f"v{n}x{k}" for k in range(200)) for n in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert found == {(n, 0) for n in range(1520)} | {(n, 1) for n in range(1520, 2520)}
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, benchmark).select("doc_id").orderBy("doc_id").collect()] == list(range(2520, 2820))


def test_bound_is_never_below_the_alignment(monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(12)]
    items = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 30))) for _ in range(20)]
    texts = [" ".join(w for w in items[k % 20].split() + rng.choices(vocabulary, k=20) if rng.random() < 0.8) for k in range(40)]
    m = decontaminate.Matcher.of(list(range(20)), items)
    whole = m.hits(pa.array(texts), 0.4)
    monkeypatch.setattr(decontaminate, "PLACES", 50)
    assert whole and m.hits(pa.array(texts), 0.4) == whole
    monkeypatch.setattr(decontaminate.Matcher, "bounds", lambda self, hashed, item, first, end: np.full(len(item), 1e9))
    assert m.hits(pa.array(texts), 0.4) == whole


# ------------------------------------------------------------------ media and archives


def test_media_round_trip():
    texts = ["", None, "a", "é" * 64, "x" * 64, "".join(chr(i % 0x250) for i in range(3000)), "q" * 600_000]
    rows, at = media.payloads(*B.utf8(pa.array(texts, pa.string())))
    stored = media.encode(rows, at)
    for k, images in enumerate(media.decode(stored)):
        assert b"".join(t.tobytes() for _, t in images) == rows[at[k] : at[k + 1]].tobytes()
    assert stored[0] == stored[1]


def test_decoder_reads_any_byte_and_reports_damage():
    rows = np.random.default_rng(0).integers(0, 256, (40, 64), dtype=np.uint8)
    stored = media.encode(rows, np.array([0, 40]))[0]
    assert b"".join(t.tobytes() for _, t in media.decode([stored])[0]) == rows.tobytes()
    bad = media.decode([stored[:-30], b"", None, b"GIF89a", stored[:2] + stored[25:]])
    assert all(isinstance(x, str) for x in bad)


def test_decoder_with_sampling_and_ac_terms():
    """Two components, luminance 2x1, hand-coded: DC differences and an AC run that must be skipped."""
    bits = ""
    dc, ac = {s: format(c, f"0{n}b") for c, n, s in media.canonical(media.DC_COUNTS, media.DC_SYMBOLS)}, {0: "0", 0x11: "10"}
    for diff in (5, 3, 0):  # two luminance blocks, then chroma
        n = abs(diff).bit_length()
        bits += dc[n] + (format(diff, f"0{n}b") if n else "") + ac[0x11] + "1" + ac[0]
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    seg = media._segment
    head = b"\xff\xd8" + seg(0xDB, bytes([0, 8, *[1] * 63])) + seg(0xC0, bytes([8, 0, 8, 0, 16, 2, 1, 0x21, 0, 2, 0x11, 0]))
    head += seg(0xC4, b"\0" + media.DC_COUNTS + media.DC_SYMBOLS) + seg(0xC4, b"\x10" + bytes([1, 1, *[0] * 14]) + bytes([0, 0x11])) + seg(0xDA, bytes([2, 1, 0, 2, 0, 0, 63, 0]))
    (frame, thumb), = media.decode([head + scan + b"\xff\xd9"])[0]
    assert (frame.width, frame.height) == (16, 8) and thumb.tolist() == [[133, 136]]


def _records(n):
    import hashlib

    return [warc.record("response", k, f"http://a/{k}", b"payload %d" % k * 40, hashlib.sha1(b"payload %d" % k * 40).hexdigest()) for k in range(n)]


def test_salvage_after_damage():
    packed = [warc.member(r) for r in _records(6)]
    raw = bytearray(b"".join(packed))
    raw[len(packed[0]) + len(packed[1]) + 40] ^= 0x55
    found = list(warc.salvage(io.BytesIO(b"junk" + bytes(raw)[:-15])))
    assert [x[1].headers["warc-page-id"] for x in found if isinstance(x, tuple)] == ["0", "1", "3", "4"]
    gaps = [x for x in found if isinstance(x, warc.Gap)]
    assert len(gaps) == 3 and gaps[0].start == 0 and gaps[0].end == 4
    assert sum(g.end - g.start for g in gaps) == 4 + len(packed[2]) + len(packed[5]) - 15


def test_salvage_plain_archives():
    records = _records(4)
    broken = records[1].replace(b"payload 1", b"payload X", 1)
    found = list(warc.salvage(io.BytesIO(records[0] + broken + records[2] + b"zzz" + records[3])))
    assert [x[1].headers["warc-page-id"] if isinstance(x, tuple) else x.reason for x in found] == ["0", "payload digest differs", "2", "neither a member nor a version line", "3"]
    assert list(warc.salvage(io.BytesIO(b""))) == []


# ------------------------------------------------------------------ scores


def test_runs_end_at_each_byte():
    codes, at = lm_score.runs(*B.utf8(pa.array(["ab", None])))
    assert at.tolist() == [0, 3, 4]
    assert codes.tolist() == [ord("a"), ord("a") << 8 | ord("b"), ord("a") << 16 | ord("b") << 8, 0]
