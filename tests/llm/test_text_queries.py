"""The operators on small DataFrames: planted cases, nulls, ties, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("gaugeline.llm")
from pyspark.sql import functions as F  # noqa: E402

from gaugeline.llm import decontaminate, html_text, lm_score, media, mixing, near_dup, quality, token_files, url_filter, warc  # noqa: E402
from gaugeline.llm.queries import HOST_RULES, PATTERN_RULES, tokenizer_file  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=4000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def edited(rng, text, rate):
    return " ".join(w if rng.random() > rate else f"e{rng.randrange(10**6)}" for w in text.split())


def frame(spark, rows):
    """Rows (doc_id, text, source) with extra columns whose names operators use inside."""
    full = [(i, t, "en", s, len(t or ""), 1, 2, "x") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS + ", d1 int, copies int, node string")


def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingle_counts(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows, weighted=False):
    """Least doc_id of each row's class by all pairs."""
    sets = [shingle_counts(t) if weighted else Counter(set(shingle_counts(t))) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common, union = (sets[a] & sets[b]).total(), (sets[a] | sets[b]).total()
            if sets[a] == sets[b] or common >= 0.8 * union - 1e-9 and common:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    ids = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            ids.setdefault(find(k), []).append(i)
    return [min(ids[find(k)]) if find(k) in ids else None for k in range(len(rows))]


def near_rows():
    rng = random.Random(11)
    rows, k = [], 0
    for _ in range(25):
        base = words(rng, rng.randrange(30, 200))
        for rate in (0, 0, 0.01, 0.02, 0.5)[: rng.randrange(1, 6)]:
            rows.append((k, edited(rng, base, rate), "a"))
            k += 1
    hub = words(rng, 150)
    rows += [(1000 + j, edited(rng, hub, 0.012), "b") for j in range(40)]
    shared = words(rng, 60)
    rows += [(2000 + j, shared + " " + words(rng, 60), "b") for j in range(40)]
    rows += [(3000, None, "c"), (3001, "", "c"), (3002, "  \n", "c"), (3003, "One two", None), (3004, "one  TWO", None), (3005, "one two three", "c"), (7, rows[7][1], "a")]
    # Lines repeated more and less often: the same shingles in other numbers.
    line, tail = words(rng, 12) + " ", words(rng, 30)
    rows += [(4000 + n, line * n + tail, "d") for n in (2, 3, 30, 32, 36, 200)] + [(4500, words(rng, 1) * 1, "d"), (4501, ("again " * 3000).strip(), "d"), (4502, ("again " * 3400).strip(), "d")]
    return rows


@pytest.mark.parametrize(("weighted", "gate"), [(True, True), (True, False), (False, True)])
def test_near_duplicates_against_all_pairs(spark, weighted, gate):
    rows = near_rows()
    got = {}
    for r in near_dup.class_ids(frame(spark, rows), weighted=weighted, gate=gate).collect():
        got.setdefault(r["doc_id"], set()).add(r["class_id"])
    want = {}
    for (i, _, _), c in zip(rows, brute_classes(rows, weighted), strict=True):
        want.setdefault(i, set()).add(c)
    assert got == want


def test_group_of_copies_edited_more_and_less(spark):
    """Pairs on both sides of the threshold: some copies hang on others only, some on none."""
    rng = random.Random(21)
    base = words(rng, 150)
    rows = [(k, edited(rng, base, rng.choice([0.005, 0.02, 0.04, 0.08])), "a") for k in range(160)]
    rows += [(500 + k, edited(rng, rows[k][1], 0.01), "a") for k in range(0, 160, 20)]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.class_ids(frame(spark, rows)).collect()}
    want = dict(zip([i for i, _, _ in rows], brute_classes(rows), strict=True))
    assert len(set(want.values())) > 20 and got == want


def test_dedup_keeps_one_row_of_each_class(spark):
    rows = near_rows()
    kept = near_dup.dedup(frame(spark, rows))
    assert kept.columns[-3:] == ["d1", "copies", "node"]
    classes = set(brute_classes(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(classes)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, x) for x in range(101, 160)] + [(200, 201), (201, 200), (5, 5)]
    one, got = ({r["node"]: r["comp"] for r in near_dup.components(spark.createDataFrame(edges, "a long, b long"), small=small).collect()} for small in (1000, 0))
    assert one == got
    assert got == {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}


def test_near_duplicates_without_rows(spark):
    assert near_dup.class_ids(empty(spark)).count() == 0
    assert near_dup.dedup(empty(spark)).count() == 0


def test_url_filter_cases(spark):
    urls = [
        (1, "https://www.Example.org/en/17?x=1"), (2, "http://example.org/es/a"), (3, "http://notexample.org/es/a"), (4, "http://a.example.com/fr/x#y"), (5, "http://a.example.com/de/"), (6, "http://x.net/de/"),
        (7, None), (8, "no scheme.org/"), (9, "ftp://org/a"), (10, "http://b.org"), (11, "http://blog.casino-win.example.net/en/1"), (12, "http://casino-win.example.com/fr/1"), (13, "://host.org/a/b?c://d"), (14, ""), (1, "https://www.Example.org/en/17?x=1"),
    ]
    df = spark.createDataFrame([(i, u, "r", "v") for i, u in urls], "page_id long, url string, rule string, host string")
    got = {r["page_id"]: tuple(r)[1:5] for r in url_filter.filter_urls(df, HOST_RULES, PATTERN_RULES).collect()}
    assert got == {
        1: ("www.example.org", "/en/17", "example.org/en/1", "block"), 2: ("example.org", "/es/a", "example.org/es/", "block"), 3: ("notexample.org", "/es/a", "org/", "allow"), 4: ("a.example.com", "/fr/x", "com/fr/", "allow"),
        5: ("a.example.com", "/de/", "com/de/", "block"), 6: ("x.net", "/de/", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("org", "/a", "org/", "allow"), 10: ("b.org", "", None, "allow"),
        11: ("blog.casino-win.example.net", "/en/1", None, "block"), 12: ("casino-win.example.com", "/fr/1", "com/fr/", "allow"), 13: ("host.org", "/a/b", "org/", "allow"), 14: ("", "", None, "allow"),
    }
    assert url_filter.filter_urls(df.limit(0), HOST_RULES).count() == 0


def fill(sizes, weights, most):
    """Targets by repeated resharing."""
    w = {s: weights[k % len(weights)] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, target, free = sum(sizes.values()), dict.fromkeys(sizes, 0.0), set(sizes)
    while free:
        level = (total - sum(target[s] for s in sizes if s not in free)) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        for s in free:
            target[s] = most * sizes[s] if s in over else level * w[s]
        if not over:
            break
        free -= over
    return target


def test_mixing_targets_and_takes(spark):
    rng = random.Random(2)
    rows = [(k, words(rng, rng.randrange(0, 40)), rng.choice(["a", "b", "b", "b", "b", "b", "c", "d", None])) for k in range(3000)]
    rows += [(5000, None, "a"), (None, "x y", "b"), (1, "a a a", "b"), (5001, "z", "tiny")]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = fill(sizes, (5, 2, 1), 3)
    taken = {}
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, x in taken.items():
        assert abs(x - want[s]) <= 40
    again = mixing.mix(frame(spark, rows[::-1])).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(empty(spark)).count() == 0


def test_larger_shares_take_supersets(spark):
    rng = random.Random(3)
    df = frame(spark, [(k, words(rng, 10), "a") for k in range(500)])
    small = {r["doc_id"] for r in mixing.mix(df, share=0.3).filter("taken > 0").collect()}
    large = {r["doc_id"] for r in mixing.mix(df, share=0.6).filter("taken > 0").collect()}
    assert small < large


def test_token_rows(spark):
    rng = random.Random(5)
    rows = [(k * 3 - 50, words(rng, rng.randrange(0, 30)), "a") for k in range(200)] + [(None, "null id", "a"), (1, None, "b"), (1, "é\u3000x", "b"), (1, None, "b"), (10**12, "", "b")]
    path = tokenizer_file()
    manifest = token_files.write_tokens(frame(spark, rows), token_files.work_folder(spark, "t"), path, shard_bytes=1500)
    assert manifest.count() > 3
    got = token_files.read_tokens(manifest).collect()
    own = token_files.Encoder(path).tokenizer
    at, want = 0, []
    coded = [(i is not None, i or 0, [*own.encode(t or "", add_special_tokens=False).ids, 0]) for i, t, _ in rows]
    for known, i, ids in sorted(coded, key=lambda x: (x[0], x[1], b"".join(y.to_bytes(2, "little") for y in x[2]))):
        want.append((i if known else None, at, len(ids), zlib.crc32(b"".join(y.to_bytes(4, "little") for y in ids))))
        at += len(ids)
    assert sorted((tuple(r)[:4] for r in got), key=lambda r: r[1]) == want
    assert token_files.token_rows(spark, empty(spark), path).count() == 0


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>a b</p></article>", 5), (2, None, None, 5), (None, "v", "", 5)], "page_id long, url string, html string, n_chars int")
    got = sorted((tuple(r) for r in html_text.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", "a b", 3), (2, None, "", 0), (None, "v", "", 0)], key=str)


def test_contaminated_rows(spark):
    rng = random.Random(6)
    items = [(k, words(rng, 30)) for k in range(8)] + [(8, None), (9, ""), (10, "short one"), (None, words(rng, 20))]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    rows = [(k, words(rng, 80), "a") for k in range(40)]
    rows[3] = (3, words(rng, 40) + " " + edited(rng, items[2][1], 0.1) + " " + words(rng, 40), "a")
    rows[4] = (4, items[5][1].upper(), "a")
    rows += [(50, None, "a"), (51, "", "a"), (52, "Short, one!", "a"), (4, items[5][1], "b"), (53, "before " + items[11][1], "b")]
    docs = frame(spark, rows)
    found = decontaminate.contaminated(docs, bench)
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect() if r["item_id"] is not None) == [(3, 2), (4, 5), (4, 5), (52, 10)]
    assert [r["doc_id"] for r in found.filter("item_id is null").collect()] == [53]
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(i for i, _, _ in rows if i not in (3, 4, 52, 53))
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_contamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 20)
    rng = random.Random(8)
    items = [(k, words(rng, 25)) for k in range(6)]
    docs = frame(spark, [(k, words(rng, 20) + " " + t, "a") for k, t in items])
    found = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(k, k) for k in range(6)]


def test_media_rows(spark):
    rows = [(1, "abc", "a"), (2, "abc", "a"), (3, None, "a"), (4, "", "a"), (None, "x" * 64, "a"), (5, "é" * 40_000, "a")]
    for r in media.features(media.store(frame(spark, rows))).collect():
        text = next(t for i, t, _ in rows if i == r["doc_id"]) or ""
        raw = text.encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["reason"] is None
    bad = spark.createDataFrame([(1, 3, bytearray(b"not a jpeg")), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert [r["reason"] is not None for r in media.features(bad).collect()] == [True, True]


def test_feature_covers_all_images_of_a_long_text(spark):
    first = "q" * (media.MAX_ROWS * media.ROW)
    found = media.features(media.store(frame(spark, [(1, first + "a" * 400_000, "a"), (2, first + "z" * 400_000, "a"), (3, first, "a")]))).collect()
    feature = {r["doc_id"]: r["feature"] for r in found}
    size = {k: f.split(":")[0] for k, f in feature.items()}
    assert feature[1] != feature[2] and size[1] == size[2] == f"512x{8 * (8191 + 6250)}*2" and size[3] == "512x65528*1"


def test_warc_urls_with_line_ends_of_unicode(spark):
    body = "<p>" + "y" * 1200
    rows = [(k, f"http://a/{c}b{c}", body) for k, c in enumerate("\u0085\u2028\u2029\u00a0")] + [(9, "http://a/\u2028", body)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["url"], r["record_type"], r["refers_to"]) for r in warc.page_rows(spark, df).collect()}
    assert got == {k: (url, "response" if k == 9 else "revisit", None if k == 9 else 9) for k, url, _ in rows}


def test_warc_page_rows_fail_if_a_page_is_lost(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"u{k}", f"page {k}") for k in range(4)], "page_id long, url string, html string")
    write = warc.write
    monkeypatch.setattr(warc, "write", lambda *a, **k: write(*a, **k).selectExpr("path", "n_records + 1 AS n_records", "n_bytes"))
    with pytest.raises(Exception, match="records of"):
        warc.page_rows(spark, df).collect()


def test_warc_rows(spark):
    big, other = "<p>" + "é" * 600, "<p>" + "x" * 997
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (3, "bad url", other), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "u", other), (9, "again", big)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, payload string")
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.page_rows(spark, df).collect()), key=str)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        same = [j for j, _, x in rows if x == h and j is not None]
        revisit = len(raw) >= 1000 and same and i != max(same)
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.page_rows(spark, df.limit(0)).count() == 0


def test_language_model_rows(spark):
    import math

    rng = random.Random(9)
    rows = [(k, words(rng, rng.randrange(0, 40), 300), "a") for k in range(120)] + [(None, "null id", "a"), (500, None, "a"), (501, "", "a"), (1, "W1 w1 unseenword", "a")]
    docs = frame(spark, rows)
    got = lm_score.score(docs, lm_score.training(F.col("doc_id"))).collect()
    token = lambda t: [*re.findall(r"[^\x20\x09-\x0d]+", (t or "").lower()), None]
    count = {}
    for i, t, _ in rows:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            for w in token(t):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    want = sorted(((i is None, i or 0, len(token(t)), sum(w in count for w in token(t)), round(sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in token(t)), 6)) for i, t, _ in rows))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert lm_score.score(empty(spark), lm_score.training(F.col("doc_id"))).count() == 0
    nothing = lm_score.score(docs, F.lit(False)).collect()
    assert {(r["n_known"], r["train_tokens"]) for r in nothing} == {(0, 0)}


def test_quality_rows(spark):
    rng = random.Random(10)
    rows = [(k, words(rng, 60, 200) if k % 3 else " ".join(w.upper() + "!!" for w in words(rng, 60, 200).split()), "a") for k in range(300)] + [(900, None, "a"), (901, "", "a"), (None, "x", "a")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(200)] + [(900, 1, 0), (5000, 0, 0), (None, 1, 0), (3, None, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, quality.fit(docs, labels, learn_from=~quality.held_out(F.col("doc_id")))).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    right = [r["predicted"] == int(r["doc_id"] % 3 > 0) for r in got if r["doc_id"] is not None and 200 <= r["doc_id"] < 300]
    assert sum(right) / len(right) > 0.95
    one_class = quality.fit(docs, labels.filter("quality = 1"))
    assert {r["score"] for r in quality.classify(docs, one_class).collect()} == {0.5}
    assert quality.classify(empty(spark), one_class).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Each stage's decision on its own input, end to end, against plain checks."""
    import corpus_pipeline

    rng = random.Random(12)
    item = words(rng, 30)
    rows = [(k, words(rng, 80, 400), "ab"[k % 2]) for k in range(120)]
    rows += [(200 + k, rows[k][1], "a") for k in range(5)] + [(300, words(rng, 30) + " " + item + " " + words(rng, 30), "a")]
    rows += [(400 + k, " ".join(w.upper() + "!!" for w in words(rng, 80, 400).split()), "b") for k in range(60)]
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 400), 0) for i, _, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen[name] = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
        assert name == "tokens" or docs.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    clean = set(range(120))
    assert seen["quality"] == sorted(clean | set(range(200, 205)) | {300})
    assert seen["near_duplicates"] == sorted(clean | {300})
    assert seen["decontamination"] == sorted(clean)
    assert set(seen["mix"]) <= clean and seen["tokens"] == seen["mix"]
