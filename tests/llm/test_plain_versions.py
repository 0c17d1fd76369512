"""Quality scores, media and the pipeline against slow, plain computations, and the pipeline on awkward tables."""

import hashlib
import math
import os
import random
import struct
import zlib

import numpy as np
import pytest
import zstandard

pytest.importorskip("gaugeline.llm")
from pyspark.sql import functions as F  # noqa: E402

from gaugeline.llm import decontaminate, media, quality  # noqa: E402

# ------------------------------------------------------------------ quality


def labelled(spark):
    rng = random.Random(31)
    good = lambda: " ".join(rng.choice(["river", "stone", "walked", "slowly", "the", "over", "light"]) for _ in range(rng.randrange(20, 90)))
    bad = lambda: " ".join(rng.choice(["BUY!!", "cheap", "$$$", "click", "here", "free"]) for _ in range(rng.randrange(20, 90)))
    rows = [(k, good() if k % 2 else bad()) for k in range(400)]
    rows += [(500, None), (501, ""), (502, rows[1][1]), (502, rows[1][1]), (503, "river stone " * 40_000), (None, "x")]
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in rows], "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)] + [(503, 1), (501, 0), (500, 0)], "doc_id long, quality int")
    return rows, docs, labels


def test_scores_equal_plain_compression(spark):
    rows, docs, labels = labelled(spark)
    model = quality.fit(docs, labels)
    sides = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.bad, model.good)]

    def plain(text):
        raw = (text or "").encode()
        blocks = [raw[k : k + 1024] for k in range(0, len(raw), 1024)]
        bad, good = (sum(len(s.compress(b)) for b in blocks) for s in sides)
        return 1 / (1 + math.exp(-(model.slope * (bad - good) / max(1, len(raw)) + model.intercept)))

    got = quality.classify(docs, model).collect()
    assert sorted((str(r["doc_id"]), round(r["score"], 9)) for r in got) == sorted((str(i), round(plain(t), 9)) for i, t in rows)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 502)}) == 1
    assert [r["predicted"] for r in got if r["doc_id"] == 503] == [1]


def test_curve_is_at_the_optimum():
    rng = np.random.default_rng(2)
    x, y = np.concatenate([rng.normal(0, 1, 80), rng.normal(1, 1, 40)]) * 0.01, np.repeat([0, 1], [80, 40])
    weight = rng.uniform(0.5, 2, 120)
    slope, intercept = quality.fit_curve(x, y, weight)
    unit = x.std()
    soft = np.where(y == 1, 41 / 42, 1 / 82)

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * x + b)))
        return -(weight * (soft * np.log(p) + (1 - soft) * np.log(1 - p))).sum() + 0.0005 * ((a * unit) ** 2 + b**2)

    best = loss(slope, intercept)
    assert all(loss(slope + da / unit, intercept + db) >= best for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))


def test_excerpts_reach_over_the_whole_text(spark):
    text = "".join(f"{k:07d}," for k in range(40_000))
    rows = spark.createDataFrame([(1, text), (2, text[:4096]), (3, ""), (4, None)], "i int, text string")
    got = {r["i"]: r["e"] for r in rows.select("i", quality.excerpt(F.col("text"), 4096).alias("e")).collect()}
    n = len(text) - 1024
    assert got[1] == "".join(text[k * n // 3 :][:1024] for k in range(4)) and got[2] == text[:4096] and got[3] == "" and got[4] is None


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_labels_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.classify(docs, quality.fit(docs, labels, learn_from=~quality.held_out(F.col("doc_id"))))
    rows = scored.filter("held_out").join(labels, "doc_id").select("score", "quality").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    area = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert len(rows) > 40 and area > 0.85


# ------------------------------------------------------------------ media


def plain_images(data):
    """(width, height, DC values in order) of each grey baseline JPEG in a row, decoded one bit at a time."""
    at, out = 0, []
    while at < len(data):
        assert data[at : at + 2] == b"\xff\xd8"
        at += 2
        tables, quantiser = {}, None
        while data[at + 1] != 0xDA:
            marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            body = data[at + 4 : at + 2 + size]
            if marker == 0xC0:
                height, width = struct.unpack(">HH", body[1:5])
                assert body[5] == 1
            while marker == 0xC4 and body:
                codes, code, k = {}, 0, 17
                for length in range(1, 17):
                    for _ in range(body[length]):
                        codes[(length, code)] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[body[0]] = codes
                body = body[k:]
            if marker == 0xDB:
                quantiser = body[1]
            at += 2 + size
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
        end = at
        while data[end] != 0xFF or data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
            end += 1
        scan, at = data[at:end], end + 2
        assert data[end + 1] == 0xD9
        pieces = [bytes(p) for p in _intervals(scan)]
        values = []
        for piece in pieces:
            bits = "".join(f"{b:08b}" for b in piece.replace(b"\xff\0", b"\xff"))
            k, dc = 0, 0

            def symbol(codes):
                nonlocal k
                for length in range(1, 17):
                    if (length, int(bits[k : k + length] or "0", 2)) in codes and k + length <= len(bits):
                        k += length
                        return codes[(length, int(bits[k - length : k], 2))]
                return None

            while len(bits) - k >= 8 or "0" in bits[k:]:
                n = symbol(tables[0])
                if n is None:
                    break
                raw = int(bits[k : k + n] or "0", 2)
                k += n
                dc += raw if not n or raw >= 1 << n - 1 else raw - (1 << n) + 1
                assert symbol(tables[0x10]) == 0
                values.append(round(dc * quantiser / 8 + 128))
        out.append((width, height, values))
    return out


def _intervals(scan):
    begin = k = 0
    while k < len(scan) - 1:
        if scan[k] == 0xFF and 0xD0 <= scan[k + 1] <= 0xD7:
            yield scan[begin:k]
            begin = k = k + 2
        else:
            k += 1
    yield scan[begin:]


def test_stored_media_against_a_plain_decoder(spark):
    rng = random.Random(6)
    rows = [(1, "abc"), (2, ""), (3, None), (4, "".join(chr(rng.randrange(1, 0x2000)) for _ in range(500))), (5, "abc"), (6, "\0" * 64), (7, "z" * 130)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, media string")
    stored = media.store(docs)
    bytes_of = {r["doc_id"]: bytes(r["media"]) for r in stored.collect()}
    for r in media.features(stored).collect():
        raw = (dict(rows)[r["doc_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        own = bytes_of[r["doc_id"]]
        images = plain_images(own)
        assert bytes(v for _, _, values in images for v in values) == payload
        assert (r["media_bytes"], r["media_sha256"]) == (len(own), hashlib.sha256(own).hexdigest())
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        # The feature: size of all images, and which cells of an 8 x 8 grid of means are above their mean.
        pixels = np.frombuffer(payload, np.uint8).reshape(-1, images[0][0] // 8)
        edges = [[k * n // 8 for k in range(9)] for n in pixels.shape]
        grid = []
        for a, b in zip(edges[0][:-1], edges[0][1:], strict=True):
            for c, d in zip(edges[1][:-1], edges[1][1:], strict=True):
                cell = pixels[a : max(b, a + 1), c : max(d, c + 1)]
                grid.append(cell.mean())
        above = [int(x > np.mean(grid)) for x in grid]
        want = f"{images[0][0]}x{sum(i[1] for i in images)}*{len(images)}:{int(''.join(map(str, above)), 2):016x}"
        assert r["feature"] == want
    assert bytes_of[1] == bytes_of[5]


# ------------------------------------------------------------------ pipeline


def run_pipeline(spark, tmp_path, rows, schema, labels):
    import corpus_pipeline

    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return corpus_pipeline.run(spark, str(tmp_path)).collect()


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, and columns named like the operators' own, or with a dot."""
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    rows = [(k, text(60), "en", "a", 1) for k in range(40)] + [(50, None, None, None, None), (51, "", "en", None, 0), (None, text(50), "en", "b", 1), (52, text(60_000), "en", "b", 1), (0, None, "en", "a", 1)]
    rows += [rows[0], rows[0]]
    full = [(*r, 7, "n", 1, 2.5) for r in rows]
    got = run_pipeline(spark, tmp_path, full, DOCS + ", copies int, row string, raw int, `a.b` double", [])
    ids = {r["doc_id"] for r in got}
    assert ids <= {r[0] for r in rows} and len(ids) > 20
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert [s for s, _ in starts] == np.concatenate([[0], np.cumsum([n for _, n in starts])])[:-1].tolist()


def test_pipeline_on_empty_tables(spark, tmp_path):
    assert run_pipeline(spark, tmp_path, [], DOCS, []) == []


# ------------------------------------------------------------------ contamination


def plain_alignment(item, text):
    """Best Smith-Waterman score of two word lists: 1 for equal words, -0.5 for others and for gaps."""
    row, best = [0.0] * (len(text) + 1), 0.0
    for a in item:
        new = [0.0]
        for k, b in enumerate(text, 1):
            new.append(max(0.0, row[k - 1] + (1 if a == b else -0.5), row[k] - 0.5, new[k - 1] - 0.5))
        row, best = new, max(best, *new)
    return best


def test_contamination_against_all_alignments(spark):
    """Every text against every item, edited at rates on both sides of the threshold, also so that no three item words stay in a row."""
    rng = random.Random(17)
    word = lambda: f"w{rng.randrange(600)}"
    items = [[word() for _ in range(n)] for n in (3, 5, 8, 20, 40, 90)]
    rows = []
    for k in range(150):
        text = [word() for _ in range(rng.randrange(0, 60))]
        if k % 3:
            source = items[rng.randrange(len(items))]
            a = rng.randrange(len(source))
            part = source[a : a + rng.randrange(2, len(source) + 1)]
            rate = rng.choice([0, 0.1, 0.3, 0.5])
            part = [w for x in part for w in ([x] if rng.random() > rate else rng.choice([[], [word()], [x, word()]]))]
            at = rng.randrange(len(text) + 1)
            text = text[:at] + part + text[at:]
        rows.append((k, ", ".join(text)))
    every = lambda item, n, f: [w for i, x in enumerate(item) for w in (f(x) if i % n == n - 1 else [x])]
    for k, item in enumerate(items[2:]):
        edits = [every(item, 3, lambda x: [word()]), every(item, 2, lambda x: [x, word()]), every(item, 1, lambda x: [x, word()]), every(item, 3, lambda x: []), every(item, 2, lambda x: [word()])]
        rows += [(1000 + 10 * k + e, ", ".join([*(word() for _ in range(15)), *text, *(word() for _ in range(15))])) for e, text in enumerate(edits)]
    want, without = set(), 0
    for k, t in rows:
        own = t.replace(",", "").split()
        for j, item in enumerate(items):
            score = plain_alignment(item, own)
            if score >= max(0.4 * len(item), min(6, 0.8 * len(item))) - 1e-9:
                want.add((k, j, round(score / len(item), 6)))
                without += not {tuple(own[i : i + 3]) for i in range(len(own) - 2)} & {tuple(item[i : i + 3]) for i in range(len(item) - 2)}
    bench = spark.createDataFrame([(j, " ".join(i)) for j, i in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], round(r["score"], 6)) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == want and 12 < len(want) < 140 and without >= 6
