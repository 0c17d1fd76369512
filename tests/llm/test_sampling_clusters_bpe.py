"""Importance resampling, centroid clustering and byte-pair encoding against plain versions, and on awkward tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import bpe, centroids, importance
from gaugeline.llm.bytes import utf8
from gaugeline.llm.queries import tokenizer_file

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


# ------------------------------------------------------------------ importance resampling


def grams(text):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().translate(LOWER))
    return len(words), [zlib.crc32(b" ".join(words[i : i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_resample(docs, target):
    own = [(i, *grams(t)) for i, t in docs]
    s, t = collections.Counter(), collections.Counter()
    for _, _, buckets in own:
        s.update(buckets)
    for text in target:
        t.update(grams(text)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    rows = []
    for i, n, buckets in own:
        weight = sum(map(gain, buckets))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    places = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(places[: 5 * len(places) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=repr)


def resampled(spark, docs, target):
    rows = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"))
    return sorted(map(tuple, rows.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_resampling_equals_a_plain_version(spark):
    rng = random.Random(5)
    words = ["Alpha", "beta", "GAMMA", "dölta", "ÉTÉ", "x9", "漢字", "naïve", "-", "'s", "a_b", "\t", "\x00", "1,2"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(150)]
    docs += [(None, None), (200, None), (201, ""), (202, docs[3][1]), (3, docs[3][1]), (3, docs[3][1]), (None, "one two " * 15), (203, "word " * 30_000)]
    target = [docs[7][1], None, "", "alpha beta gamma"]
    got = resampled(spark, docs, target)
    assert got == plain_resample(docs, target)
    assert sum(r[5] is not None for r in got) >= 5


def test_texts_beyond_a_piece_are_whole(spark, monkeypatch):
    rng = random.Random(6)
    docs = [(i, " ".join(f"w{rng.randint(0, 50)}" for _ in range(n))) for i, n in enumerate([0, 1, 2, 3, 400, 900, 30])] + [(9, "a  b " * 200), (10, "z" * 3000 + " y x"), (11, "p\nq r")]
    monkeypatch.setattr(importance, "PIECE", 64)
    part = pa.record_batch({"text": [docs[5][1]]})
    assert len(list(importance._shown(part))) > 20
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    # The tasks' own modules have the usual size, so the generator is run here.
    rows = [r for batch in frame.toArrow().to_batches() for part in importance.pieces(iter([batch]), "text", 64) for r in shown_buckets(part)]
    assert [sorted(r) for r in rows] == [sorted(grams(t)[1]) for _, t in docs]


def shown_buckets(part):
    con = importance.connection()
    found = [[] for _ in range(part.num_rows)]
    for piece in importance._shown(part):
        con.register("piece", piece)
        con.execute(importance.FEATURES.format(buckets=10_000))
        for r, bucket in con.execute("SELECT r, bucket FROM features").fetchall():
            found[r].append(bucket)
    con.close()
    return found


def test_resampling_of_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "one two three", 5, 6, 7, 8)], "doc_id long, text string, bucket int, rank int, `range` int, `a.b` int")
    assert importance.resample(none, none).collect() == []
    row = importance.resample(some, none).first()
    assert (row["doc_id"], row["n_features"], row["rank"]) == (1, 6, None)
    assert row["weight"] == 6 * math.floor(1000 * math.log((10_000 + 6) / (2 * 10_000)))


# ------------------------------------------------------------------ centroid clustering


def plain_clusters(vectors, k=16, rounds=3):
    own = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    table = [v for _, v in sorted(own, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda v: min((square(v, c), n) for n, c in enumerate(table))
    for _ in range(rounds):
        members = collections.defaultdict(list)
        for _, v in own:
            members[place(v)[1]].append(v)
        for n, vs in members.items():
            table[n] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    rows = [(i, *place(v)) for i, v in own]
    total = collections.Counter()
    for _, d, n in rows:
        total[n] += d
    long = lambda d: min(d, centroids.MOST)
    return sorted([(i, n, long(d), long(total[n]), long(total.total()), table[n]) for i, d, n in rows], key=repr)


def clustered(spark, vectors, kind="float"):
    frame = spark.createDataFrame(vectors, f"vec_id long, embedding array<{kind}>")
    return sorted([(*r[:5], list(r[5])) for r in centroids.cluster(frame).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid").collect()], key=repr)


def test_clusters_equal_a_plain_version(spark):
    rng = np.random.default_rng(3)
    some = [(i, [float(x) for x in np.float32(rng.normal(size=64) * rng.choice([0.05, 1.0, 4.0]))]) for i in range(300)]
    some += [(400, some[5][1]), (5, some[5][1]), (5, some[5][1]), (None, some[6][1]), (None, some[7][1])]
    some += [(401, None), (402, []), (403, [0.5] * 63), (404, [0.5] * 65), (405, [0.5] * 63 + [None]), (406, [0.5] * 63 + [float("nan")]), (407, [0.5] * 63 + [float("-inf")])]
    some += [(500 + i, [0.0] * 64) for i in range(200)]
    got = clustered(spark, some)
    assert got == plain_clusters(some)
    assert len(got) == 505


def test_vectors_of_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    some = [(i, [float(x) for x in rng.normal(size=64) * (3e6 if i % 3 else 1.0)]) for i in range(60)]
    assert clustered(spark, some, "double") == plain_clusters(some)
    far = [(i, [(-1.0) ** i * 1e300] * 64) for i in range(20)]
    assert {r[2] for r in clustered(spark, far, "double")} <= {0, centroids.MOST}


def test_fewer_vectors_than_centroids_and_empty_tables(spark):
    few = [(i, [i / 64.0] * 64) for i in range(3)]
    assert clustered(spark, few) == plain_clusters(few)
    assert clustered(spark, []) == []
    frame = spark.createDataFrame([(1, [0.5] * 64, 1, 2)], "vec_id long, embedding array<float>, cluster int, v int")
    assert centroids.cluster(frame).count() == 1


@pytest.mark.parametrize("stride", [1, 7, 64])
def test_partial_distances_give_the_nearest(stride):
    rng = np.random.default_rng(stride)
    x, table = rng.integers(-3, 4, (500, 20)), rng.integers(-3, 4, (9, 20))
    whole = ((x[:, None, :] - table[None]) ** 2).sum(axis=2)
    which, distance = centroids.nearest(x, table, rng.permutation(20), stride)
    assert (which == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()


def test_dimensions_come_by_variance(spark):
    rows = [(i, [float(i % 2) * d for d in range(64)]) for i in range(10)]
    own = centroids.kept(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert centroids.by_variance(own) == list(range(63, -1, -1))


# ------------------------------------------------------------------ byte-pair encoding


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


ODD = [
    *"abcSTRélmvd's'' \t\n\r\x0b\x0c\x1c\x1f\x85\xa0     　.,!?-_0123९٣ßЖдж漢字👍‍́\x00\x7f½²ⅷ",
    *["'re", "'ve", "'ll", " '", "  ", "<|endoftext|>", "<|endo", "the ", " of", "ing", "don't"],
]


def test_encoding_and_decoding_equal_the_library(library):
    rng = random.Random(8)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 60))) for _ in range(4000)]
    texts += ["a" * 5000, " " * 3000, "'" * 999, "ab" * 4000, "\n" * 77 + "x", "漢" * 500, "é" * 301, "", None, "aaaaaaa aaaa aaa", "<|endoftext|><|endoftext|>"]
    own = bpe.encoder(tokenizer_file())
    got = own.encode(*utf8(pa.array(texts)))
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    raw, at = own.vocabulary.decode(np.concatenate([np.array(w, np.uint32) for w in want]), np.cumsum([0, *map(len, want)]))
    assert [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)] == [library.decode(w, skip_special_tokens=False) for w in want]


def test_random_ids_decode_as_the_library_does(library):
    rng, own = random.Random(9), bpe.encoder(tokenizer_file())
    for _ in range(1500):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(0, 9))]
        raw, _ = own.vocabulary.decode(np.array(ids, np.uint32), np.array([0, len(ids)]))
        assert raw.tobytes().decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_merging_side_by_side_equals_the_heap():
    rng, own = random.Random(10), bpe.encoder(tokenizer_file())
    words = [bytes(rng.choices(b"aabcdefgthein ", k=rng.randint(1, 60))) for _ in range(800)]
    ids, at = own.merged(words)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [own._heap_merged(w) for w in words]


def test_forced_pairs_stand_in_no_token():
    vocabulary = bpe.encoder(tokenizer_file()).vocabulary
    tokens = list(vocabulary.bytes_of.values())
    inside = {t[k : k + 2] for t in tokens for k in range(len(t) - 1)}
    assert vocabulary.forced.sum() == 65_536 - len(inside)
    assert vocabulary.forced[ord("a"), ord(" ")] and not vocabulary.forced[ord(" "), ord("a")]


def test_other_kinds_of_files_are_refused():
    plain = {"model": {"type": "BPE"}, "pre_tokenizer": {"type": "ByteLevel"}, "added_tokens": []}
    bpe._refuse_others(plain)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {"type": "WordPiece"}}, {"added_tokens": [{"content": "<x>", "lstrip": True}]}, {"truncation": {"max_length": 5}}):
        with pytest.raises(ValueError):
            bpe._refuse_others(plain | change)


def test_tables_are_encoded_and_decoded(spark, library):
    texts = [None, "", "Hello  world's end\n", "same", "same", "long " * 40_000, "<|endoftext|> x"]
    docs = spark.createDataFrame([(None if k == 3 else k, t, "i", "o") for k, t in enumerate(texts)], "doc_id long, text string, ids string, `a.b` string")
    for n in (1, 3):
        rows = bpe.decode(bpe.encode(docs.repartition(n), tokenizer_file()), tokenizer_file()).collect()
        got = sorted(([-1 if r["doc_id"] is None else r["doc_id"], np.frombuffer(bytes(r["ids"]), "<u4").tolist(), r["text"]] for r in rows), key=repr)
        assert got == sorted(([-1 if k == 3 else k, library.encode(t or "", add_special_tokens=False).ids, t or ""] for k, t in enumerate(texts)), key=repr)
    none = docs.filter(F.lit(False))
    assert bpe.decode(bpe.encode(none, tokenizer_file()), tokenizer_file()).collect() == []
