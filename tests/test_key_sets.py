"""Ordered digests, key sets of the leakage comparison, and time joins over slices."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import asof, keysets, quality
from gaugeline.operators.digests import JSON_LIST, ordered_digests


def test_digests_are_those_of_the_sorted_keys(spark):
    groups = {"a": [10, 9, 100, -3, 9], "b": ["x", "10", "9", "a b", "é"], None: [1], "big": list(range(5000))}
    rows = [(g, str(k)) for g, keys in groups.items() for k in keys] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, k string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {r["g"]: (r["n_keys"], r["keys_hash"]) for r in ordered_digests(df, ["g"], "k").collect()}
        as_json = {r["g"]: r["keys_hash"] for r in ordered_digests(df, ["g"], "k", form=JSON_LIST).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    order = lambda keys: sorted(map(str, keys), key=lambda k: (not k.lstrip("-").isdigit(), int(k) if k.lstrip("-").isdigit() else 0, k))
    assert got == {g: (len(keys), hashlib.sha256("\n".join(order(keys)).encode()).hexdigest()) for g, keys in groups.items()}
    assert as_json["big"] == hashlib.sha256(json.dumps(list(range(5000)), separators=(",", ":")).encode()).hexdigest()
    two = ordered_digests(df.withColumn("h", F.lit(1)), ["g", "h"], "k").filter("g = 'big'").first()
    assert (two["h"], two["n_keys"]) == (1, 5000)
    assert ordered_digests(df.limit(0), ["g"], "k").count() == 0


def hash_of(keys):
    return hashlib.sha256(json.dumps(sorted(keys), separators=(",", ":")).encode()).hexdigest()


GOOD = {"ledger": {("ev3", "calibration"): [1, 2, 3], ("ev3", "evaluation"): [4, 5], ("vrmt", "calibration"): [1, 2], ("vrmt", "evaluation"): [3]}, "ev3": {1: "calibration", 2: "calibration", 3: "calibration", 4: "evaluation", 5: "evaluation"}, "vrmt": {1: "calibration", 2: "calibration", 3: "evaluation"}, "eligible": [4, 5]}
CASES = {
    "good": (None, {}),
    "extra rows in a stream": (None, {"ev3": GOOD["ev3"] | {9: "evaluation"}}),
    "no evaluation keys": ("missing_persisted_h3_keys_or_partition_hash", {"ledger": GOOD["ledger"] | {("ev3", "evaluation"): []}}),
    "no eligible keys": ("missing_persisted_h3_keys_or_partition_hash", {"eligible": []}),
    "overlap": ("persisted_calibration_evaluation_overlap", {"ledger": GOOD["ledger"] | {("ev3", "evaluation"): [3, 4, 5]}}),
    "other overlap": ("persisted_vive_calibration_evaluation_overlap", {"ledger": GOOD["ledger"] | {("vrmt", "evaluation"): [2, 3]}}),
    "foreign key": ("invalid_eligible_evaluation_fitting_keys", {"eligible": [4, 5, 77]}),
    "calibration key is eligible": ("invalid_eligible_evaluation_fitting_keys", {"eligible": [3, 4]}),
    "lost row": ("missing_persisted_stream_ids", {"ev3": {k: p for k, p in GOOD["ev3"].items() if k != 5}}),
    "row moved": ("missing_persisted_stream_ids", {"vrmt": GOOD["vrmt"] | {3: "calibration"}}),
    "no tracking": ("missing_persisted_stream_ids", {"ledger": {k: v for k, v in GOOD["ledger"].items() if k[0] == "ev3"}}),
}


@pytest.fixture(scope="module")
def told(spark):
    ledger, frames, eligible = [], {"ev3": [], "vrmt": []}, []
    for name, (_, change) in CASES.items():
        case = GOOD | change
        ledger += [(name, s, p, keys, hash_of(keys)) for (s, p), keys in case["ledger"].items()]
        for s in frames:
            frames[s] += [(name, k, p) for k, p in case[s].items()]
        eligible += [(name, k) for k in case["eligible"]]
    ledger += [("wrong hash", s, p, keys, "0" if s == "vrmt" else hash_of(keys)) for (s, p), keys in GOOD["ledger"].items()] + [("twice", s, p, keys, hash_of(keys)) for (s, p), keys in GOOD["ledger"].items()]
    for name in ("wrong hash", "twice"):
        for s in frames:
            frames[s] += [(name, k, p) for k, p in GOOD[s].items()] + ([(name, 2, "calibration")] if name == "twice" else [])
        eligible += [(name, 4)]
    of = lambda rows: spark.createDataFrame(rows, "trial_id string, source_row_index long, partition string")
    book = spark.createDataFrame(ledger, "trial_id string, stream string, partition string, source_rows array<long>, identity_hash string")
    rows = keysets.leakage(of(frames["ev3"]), of(frames["vrmt"]), book, spark.createDataFrame(eligible, "trial_id string, source_row_index long")).collect()
    return {r["trial_id"]: r for r in rows}


def test_trials_are_refused_for_the_first_reason(told):
    want = {name: reason for name, (reason, _) in CASES.items()} | {"wrong hash": "partition_hash_mismatch", "twice": "missing_persisted_stream_ids"}
    assert {name: r["reason"] for name, r in told.items()} == want


def test_arms_are_counted_and_hashed(told):
    r = told["good"]
    assert (r["split_count"], r["full_count"], r["eligible_count"], r["split_excludes"], r["full_includes"]) == (3, 5, 2, True, True)
    assert (r["split_hash"], r["full_hash"], r["eligible_hash"]) == (hash_of([1, 2, 3]), hash_of([1, 2, 3, 4, 5]), hash_of([4, 5]))
    assert not told["calibration key is eligible"]["split_excludes"] and len({x["partition_hash"] for x in told.values()}) > 3


def test_by_default_all_evaluation_keys_are_eligible(spark):
    rows = spark.createDataFrame([("t", k, p) for k, p in GOOD["ev3"].items()], "trial_id string, source_row_index long, partition string")
    book = spark.createDataFrame([("t", s, p, [1, 2, 3] if p == "calibration" else [4, 5], hash_of([1, 2, 3] if p == "calibration" else [4, 5])) for s in ("ev3", "vrmt") for p in ("calibration", "evaluation")], "trial_id string, stream string, partition string, source_rows array<long>, identity_hash string")
    r = keysets.leakage(rows, rows, book).first()
    assert (r["reason"], r["eligible_count"]) == (None, 2)


@pytest.mark.parametrize("slice_s", [0.7, 5.0, 1000.0])
def test_slices_of_a_trial_give_the_same_rows(spark, slice_s):
    q = spark.createDataFrame([("a", k, float(t)) for k, t in enumerate([0, 1, 1, 2.5, 7, 7.0, 30, 55, 99])] + [("b", 50, 3.0), ("a", 51, None), (None, 52, 1.0)], "trial_id string, source_row_index long, t double")
    s = spark.createDataFrame([("a", k, float(t), float(10 * k)) for k, t in enumerate([0.5, 1, 1, 6.9, 7, 40, 41, 60])] + [("a", 90, None, 5.0), (None, 91, 0.0, 1.0), (None, 92, 2.0, 3.0)], "trial_id string, source_row_index long, t double, v double")
    for join in (asof.zero_order_hold, asof.linear):
        whole, cut = (sorted(map(tuple, join(q, s, ["v"], sample_order="source_row_index", **o).collect()), key=repr) for o in ({}, {"slice_s": slice_s}))
        assert whole == cut and any(r[-1] for r in cut)
    whole, cut = (sorted(map(tuple, asof.nearest_gap(q, s, **o).collect()), key=repr) for o in ({}, {"slice_s": slice_s}))
    assert whole == cut
    whole, cut = (sorted(map(tuple, asof.partner_after(s, ["v"], 6.0, 0.5, slice_s=x).collect()), key=repr) for x in (None, slice_s))
    assert whole == cut and cut


def test_a_single_trial_is_sorted_by_slices(spark):
    q = spark.range(1000).selectExpr("'a' as trial_id", "id as source_row_index", "cast(id as double) as t")
    plan = asof.linear(q, q.selectExpr("trial_id", "t", "t as v"), ["v"], slice_s=10.0)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__slice" in plan.replace("_groupingexpression", "__slice")


def test_common_keys_come_from_one_aggregate_for_any_number_of_arms(spark):
    from gaugeline.operators import support

    arms = {f"a{k:02d}": spark.createDataFrame([(1, 5), (1, 5), (2, k), (None, 7)], "g int, k int") for k in range(65)}
    out = support.common_keys(arms, ["k"], ["g"])
    assert sorted(map(tuple, out.collect()), key=repr) == [(1, "5"), (None, "7")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("+- == Initial Plan ==")[0].count("Exchange hashpartitioning") == 1


def test_trials_of_few_and_of_many_keys_are_hashed_alike(spark, monkeypatch):
    lines = spark.range(60).select((F.col("id") % 7 % 3).alias("trial_id"), F.col("id").alias("source_row_index"), F.when(F.col("id") % 2 == 0, "calibration").otherwise("evaluation").alias("partition"))
    ledger = quality.ledger(lines.withColumn("stream", F.lit("ev3")).unionByName(lines.withColumn("stream", F.lit("vrmt"))))
    got = {}
    for most in (1000, 20):
        monkeypatch.setattr(keysets, "SMALL", most)
        got[most] = sorted(map(tuple, keysets.leakage(lines, lines, ledger).collect()))
    assert got[1000] == got[20] and all(r[-1] is None for r in got[20])
