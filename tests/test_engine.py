import datetime as dt
import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tenura import contracts
from tenura.functions import columns as c
from tenura.operators import checks, curve, evaluation, facts, features, movement, promote, release
from tenura.plans import marts, serve
from tenura.plans.registry import QUERIES, Warehouse, shown
from tenura.sources import readers

D = dt.date
TX = "subscriber_token binary, payment_method_id int, payment_plan_days int, plan_list_price long, actual_amount_paid long, is_auto_renew int, transaction_date date, membership_expire_date date, is_cancel int"


def tx(token=b"a" * 12, method=1, days=30, price=100, paid=100, auto=0, day=D(2000, 6, 1), expiry=D(2000, 7, 1), cancel=0):
    return (token, method, days, price, paid, auto, day, expiry, cancel)


def test_contract_is_complete():
    assert contracts.contract_problems() == []
    broken = {"x": contracts.T.StructType([contracts.T.StructField("a", contracts.T.StringType())])}
    assert contracts.contract_problems(broken)


def test_strict_csv(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("msno,is_churn\nx,1\ny,0\n")
    assert [tuple(r) for r in readers.read_family(spark, "labels", str(good)).collect()] == [("x", 1), ("y", 0)]
    drift = tmp_path / "drift.csv"
    drift.write_text("msno,churned\nx,1\n")
    with pytest.raises(ValueError, match="drift"):
        readers.read_family(spark, "labels", str(drift))
    bad = tmp_path / "bad.csv"
    bad.write_text("msno,is_churn\nx,maybe\n")
    with pytest.raises(Exception):
        readers.read_family(spark, "labels", str(bad)).collect()
    with pytest.raises(ValueError):
        readers.assert_schema(readers.read_family(spark, "labels", str(good)), contracts.FAMILIES["members"])


def test_canonical_sentinels(spark):
    rows = spark.createDataFrame([("m", 1, 20, "", -1, 0), ("n", 2, 30, "male", 7, 20170102)], contracts.FAMILIES["members"])
    a, b = facts.canonical("members", rows).collect()
    assert (a["gender"], a["registration_method_code"], a["registration_date"]) == (None, None, None)
    assert b["registration_date"] == D(2017, 1, 2) and len(b["subscriber_token"]) == 12
    rows = spark.createDataFrame([("m", 20170131, 1, 2, 3, 4, 5, 6, -3.5)], contracts.FAMILIES["listening"])
    r = facts.canonical("listening", rows, "v1").first()
    assert (r["total_secs"], r["total_secs_was_negative"], r["activity_month"]) == (0.0, True, 201701)


def test_dedup_keeps_lineage(spark):
    rows = [(*tx(), "v1"), (*tx(), "v2"), (*tx(paid=90), "v2"), (*tx(paid=80), "v1"), (*tx(paid=80), "v1")]
    df = spark.createDataFrame(rows, TX + ", source_version string")
    got = {r["actual_amount_paid"]: r["source_versions"] for r in facts.dedup_transactions(df).collect()}
    assert got == {100: "v1+v2", 90: "v2", 80: "v1"}
    r = facts.dedup_controls(df).first()
    assert (r["source_rows"], r["accepted_rows"], r["removed_rows"], r["within_version_removed"], r["cross_version_events"]) == (5, 3, 2, 1, 1)
    again = facts.dedup_transactions(facts.dedup_transactions(df).drop("event_key").withColumnRenamed("source_versions", "source_version"))
    assert again.count() == 3


def test_listening_gate(spark):
    schema = "subscriber_token binary, activity_date date, num_25 int, num_50 int, num_75 int, num_985 int, num_100 int, num_unq int, total_secs double, total_secs_was_negative boolean, source_version string, activity_month int"
    row = lambda day, v: (b"a", day, 1, 0, 0, 0, 0, 1, 1.0, False, v, 200001)
    good = spark.createDataFrame([row(D(2000, 1, 1), "v1"), row(D(2000, 1, 2), "v2")], schema)
    facts.require_valid_listening(facts.listening_controls(good, ("source_version",)))
    for bad in ([row(D(2000, 1, 1), "v1")] * 2, [row(D(2000, 1, 2), "v1"), row(D(2000, 1, 2), "v2")]):
        with pytest.raises(ValueError):
            facts.require_valid_listening(facts.listening_controls(spark.createDataFrame(bad, schema), ("source_version",)))


def test_gap_boundary_and_bands(spark):
    got = spark.createDataFrame([(None,), (29,), (30,), (-5,)], "gap int").select(c.churn_from_gap(F.col("gap"))).collect()
    assert [r[0] for r in got] == [1, 0, 1, 0]
    got = spark.createDataFrame([(x,) for x in (None, 0, 1, 5, 6, 15, 16)], "d int").select(c.engagement_segment(F.col("d"))).collect()
    assert [r[0] for r in got] == ["Dormant", "Dormant", "Light", "Light", "Steady", "Steady", "High"]
    got = spark.createDataFrame([(x,) for x in (9, 10, 37, 99, 100, None)], "a int").select(c.age_band_start(F.col("a"))).collect()
    assert [r[0] for r in got] == [None, 10, 30, 90, None, None]


def test_same_day_order_and_cutoff_safety(spark):
    windows = spark.createDataFrame([("w", D(2000, 6, 20), D(2000, 6, 21), D(2000, 7, 20), D(2000, 8, 20))], "label_window string, history_cutoff date, expiration_window_start date, expiration_window_end date, renewal_observation_end date")
    rows = [tx(cancel=1, expiry=D(2000, 6, 2)), tx(cancel=0, expiry=D(2000, 9, 1)), tx(day=D(2000, 6, 21), paid=7), tx(day=D(2000, 3, 1), paid=5), tx(token=b"b" * 12, day=D(2000, 6, 25))]
    df = facts.dedup_transactions(spark.createDataFrame([(*r, "v1") for r in rows], TX + ", source_version string"))
    seq = {(r["transaction_date"], r["is_cancel"]): r["same_day_sequence"] for r in features.sequenced(df).filter(F.col("subscriber_token") == b"a" * 12).collect()}
    assert seq[(D(2000, 6, 1), 0)] == 1 and seq[(D(2000, 6, 1), 1)] == 2
    out = features.subscription_features(df, windows).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["subscription_event_count_lifetime"], r["subscription_event_count_30d"], r["gross_receipts_lifetime"], r["cancellation_event_count_30d"]) == (3, 2, 205, 1)
    assert r["effective_expiration_date"] == D(2000, 6, 2) and r["latest_is_cancel"] == 1
    gaps = features.renewal_gaps(df, windows).collect()
    assert [(g["gap_days"], g["is_churn"]) for g in gaps] == [(19, 0)]


def test_invariants_hold_on_the_table(spark, small):
    w = Warehouse(spark, small, contracts.Settings(minimum_group=5))
    snapshot = w.stored_snapshot
    report = checks.counted(
        ("unique", checks.repeated_keys(snapshot, ["subscriber_token", "label_window"])), ("cutoff", checks.unsafe(snapshot)),
        ("segments", checks.unaccepted(snapshot, "engagement_segment", list(w.settings.segments))), ("outcomes", checks.unreconciled(marts.retention_overview(snapshot))),
    )
    checks.gate(report)
    worst = checks.reconciled(marts.retention_overview(snapshot), w.labels, w.transactions, w.listening, w.windows).agg(F.max("error")).first()[0]
    assert worst <= 1e-6
    public = {"cohort": marts.public(marts.renewal_cohort(snapshot), 5), "segment": marts.public(marts.subscription_segment(snapshot), 5)}
    assert checks.private_columns(public, contracts.DEFAULT.denied_columns) == []
    assert checks.private_columns({"snapshot": snapshot}, contracts.DEFAULT.denied_columns)
    keys = {"cohort": ["label_window", "registration_cohort_month"], "segment": ["label_window", "dimension", "segment_key"]}
    assert checks.small_groups(public, keys, 5).isEmpty()
    with pytest.raises(ValueError):
        checks.gate(checks.counted(("all", snapshot)))


def test_one_shuffle_by_subscriber(spark, small):
    plan = Warehouse(spark, small).subscription._jdf.queryExecution().executedPlan().toString()
    # one for the deduplication on all nine columns, then one by subscriber for ranking and aggregation
    assert len(re.findall(r"Exchange hashpartitioning\(subscriber_token#\d+, \d+\)", plan)) == 1 and plan.count("Exchange hashpartitioning") == 2
    reads = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert reads and all("o_shippriority" not in line for line in reads)


def test_calibration_and_decile(spark):
    scored = spark.createDataFrame([(0, 0.0, "a"), (0, 0.0, "b"), (1, 1.0, "c"), (1, 1.0, "d")], "y int, p double, tie_breaker string")
    assert evaluation.calibration_error(scored).first()[0] == 0
    ties = spark.createDataFrame([(int(k == 0), 0.5, f"{k:02d}") for k in range(10)], "y int, p double, tie_breaker string")
    r = evaluation.top_decile(ties).first()
    assert (r["top_decile_rows"], r["top_decile_lift"]) == (1, 10.0)
    bad = spark.createDataFrame([(0, None), (0, float("nan")), (1, 1.2), (1, 0.3)], "y int, p double")
    assert evaluation.invalid_scores(bad).count() == 3
    assert not evaluation.DENIED & {*evaluation.NUMERIC, *evaluation.CATEGORICAL}
    assert evaluation.ships(0.06, 0.01, 0.02, 3.0, 2.0) and not evaluation.ships(0.04, 0.01, 0.02, 3.0, 2.0)
    assert evaluation.decision(True, True, 0.1) == "ship_challenger_repeat_only" and evaluation.decision(True, False, 0.0) == "retain_baseline"


CURVE = [(100, 0.8, 60.0, 60, 6000.0, 9000.0), (200, 0.4, 80.0, 80, 8000.0, 9500.0), (300, 0.1, 90.0, 90, 9000.0, 9900.0)]
CURVE_SCHEMA = "contacts long, minimum_score double, expected_churners double, observed_churners long, risk_weighted_payment_proxy double, selected_payment_proxy double"


def test_scenario_arithmetic(spark):
    points = spark.createDataFrame(CURVE, CURVE_SCHEMA)
    got = {r["case_name"]: r for r in curve.outcomes(points, curve.Scenario(200, 0.4, 1.0, 4.0, 0.2, 0.1)).collect()}
    r = got["expected"]
    assert (r["simulated_retained_subscribers"], r["simulated_retained_gross_receipt_proxy"], r["total_spend"], r["simulated_net_value"], r["break_even_lift"]) == (16, 1600, 1000, 600, 0.125)
    assert got["low"]["assumed_lift"] == pytest.approx(0.1) and got["high"]["assumed_lift"] == pytest.approx(0.3)
    none = curve.outcomes(points, curve.Scenario(0)).filter("case_name = 'expected'").first()
    assert none["contacts"] == 0 and none["simulated_roi"] is None and none["break_even_lift"] is None and not none["break_even_feasible"] and none["capacity_utilization"] is None
    assert curve.selected_point(points, curve.Scenario(300, 0.5)).first()["contacts"] == 100
    clipped = curve.outcomes(points, curve.Scenario(300, 0.0, 0.0, 0.0, 0.9, 0.5)).filter("case_name = 'high'").first()
    assert clipped["assumed_lift"] == 1.0 and clipped["simulated_roi"] is None


@pytest.mark.parametrize("bad", [{"capacity": -1}, {"capacity": 301}, {"capacity": 50}, {"capacity": 100.5}, {"capacity": 200, "minimum_score": 1.1}, {"capacity": 200, "assumed_lift": -0.1}, {"capacity": 200, "lift_uncertainty": 0.6}, {"capacity": 200, "contact_cost": float("nan")}, {"capacity": 200, "offer_cost": float("inf")}])
def test_scenario_refuses(bad):
    with pytest.raises(ValueError):
        curve.Scenario(**bad).validated(300, 100)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 1)), min_size=1, max_size=60))
def test_prefix_sums_are_global(spark, rows):
    data = [(p / 5, y, 10 * k, f"{k:03d}") for k, (p, y) in enumerate(rows)]
    df = spark.createDataFrame(data, "p double, y int, receipts long, tie_breaker string")
    got = {r["tie_breaker"]: (r["rank"], r["total"]) for r in curve.prefix_sums(df, [F.col("p").desc(), F.col("tie_breaker").asc()], {"total": F.col("receipts")}).collect()}
    run = 0
    for k, r in enumerate(sorted(data, key=lambda x: (-x[0], x[3])), 1):
        run += r[2]
        assert got[r[3]] == (k, run)


def test_release(spark, tmp_path, small):
    salt = release.new_salt()
    assert release.publication_salt(spark, salt) == salt != release.new_salt()
    for bad in ("xyz", "", "F" * 64, None):
        with pytest.raises(ValueError):
            release.publication_salt(spark, bad)
    w = Warehouse(spark, small)
    sources = {"member": w.members, "subscription_transaction": w.transactions, "churn_label": w.labels, "listening_day": w.listening}
    tables = {n: release.released(n, df, salt) for n, df in sources.items()}
    assert all(tuple(df.columns) == release.COLUMNS[n] for n, df in tables.items())
    for r in release.verification(tables, sources).collect():
        assert r["released_rows"] == r["fact_rows"] and r["null_keys"] == r["repeated_keys"] == 0
    for n in ("member", "churn_label"):
        assert release.wrong_pseudonyms(n, tables[n], sources[n], salt).isEmpty()
        assert release.wrong_pseudonyms(n, tables[n], sources[n], release.new_salt()).count() > 0
    release.write_release(tables, str(tmp_path / "release"))
    said = release.write_manifest(spark, str(tmp_path / "release"))
    assert said["rows"] == sum(df.count() for df in sources.values()) and release.manifest_problems(spark, str(tmp_path / "release")) == []
    promote.write_report(spark, said | {"rows": said["rows"] + 1, "files": said["files"][1:] + [{"path": "member/none.parquet", "rows": 1, "bytes": 1}]}, str(tmp_path / "release/manifest.json"))
    assert {p.split(" ", 1)[1] for p in release.manifest_problems(spark, str(tmp_path / "release"))} == {"don't add up", "is missing", "isn't listed"}
    files = {r["table_name"]: r for r in release.verified_files(spark, str(tmp_path / "release")).collect()}
    assert all(files[n]["rows"] == df.count() and files[n]["bytes"] > 0 for n, df in sources.items())
    assert sorted(p.name for p in (tmp_path / "release/subscription_transaction").glob("part=*")) == ["part=0", "part=1"]
    assert readers.read_partitioned(spark, str(tmp_path / "release/churn_label")).count() == w.labels.count()
    with pytest.raises(Exception):
        release.write_release(tables, str(tmp_path / "release"))
    shared = tables["member"].join(tables["churn_label"], "subscriber_key", "left_semi").count()
    assert shared == w.labels.select("subscriber_token").distinct().count()


def test_promotion_and_replay(spark, tmp_path):
    out = str(tmp_path / "facts")
    df = spark.range(5)
    mark = promote.fingerprint("contract", [("a", 1, 2), ("b", 3, 4)])
    assert mark == promote.fingerprint("contract", [("b", 3, 4), ("a", 1, 2)]) != promote.fingerprint("contract", [("a", 1, 3), ("b", 3, 4)])
    assert promote.build(spark, out, {"t": df}, mark)["tables"] == {"t": 5}
    assert promote.build(spark, out, {"t": df}, mark)["status"] == "unchanged"

    def refuse(rows):
        raise ValueError("gate")

    with pytest.raises(ValueError):
        promote.build(spark, out, {"t": df}, "f" * 64, gate=refuse)
    assert spark.read.parquet(f"{out}/t").count() == 5 and [p.name for p in tmp_path.iterdir()] == ["facts"]
    promote.counted_write(spark.range(9), str(tmp_path / "next/t"))

    def fail():
        raise RuntimeError("injected")

    with pytest.raises(RuntimeError):
        promote.promote(spark, str(tmp_path / "next"), out, fail)
    assert spark.read.parquet(f"{out}/t").count() == 5
    promote.promote(spark, str(tmp_path / "next"), out)
    assert spark.read.parquet(f"{out}/t").count() == 9
    assert json.loads(json.dumps({"bytes": promote.allocated(spark, out)}))["bytes"] > 0
    with pytest.raises(OSError):
        promote.require_ceiling(spark, out, 1)
    with pytest.raises(OSError):
        promote.require_space(str(tmp_path), 1 << 60)


def test_controls_and_forbidden_keys(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("w", 5.0)], "control_id string, expected_value double")
    b = spark.createDataFrame([("x", 2.0), ("z", 1.0), ("w", 5.0)], "control_id string, actual_value double")
    checks.require_controls(checks.compared_controls(a, a.withColumnRenamed("expected_value", "actual_value")))
    assert {r["control_id"]: r["problem"] for r in checks.compared_controls(a, b).collect()} == {"x": "differs", "y": "missing", "z": "not expected", "w": None}
    with pytest.raises(ValueError, match="x: differs; y: missing; z: not expected"):
        checks.require_controls(checks.compared_controls(a, b))
    zipped = checks.placed(a.drop("expected_value"), b.select("control_id").limit(2), "control_id", ["control_id"])
    assert {r["position"]: (r["expected"], r["actual"]) for r in zipped.collect()} == {1: ("w", "x"), 2: ("x", "z"), 3: ("y", None)}
    assert checks.forbidden_keys({"a": [{"msno": 1}], "b": {"gender": 2}}, frozenset({"msno", "gender"})) == ["$.a[0].msno", "$.b.gender"]
    got = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (3.0, 2.0)], "a double, e double").select(checks.relative_error(F.col("a"), F.col("e"))).collect()
    assert [r[0] for r in got] == [0.0, 1.0, 0.5]


def test_star_schema_and_boundaries(spark, small):
    from tenura.plans import bi

    w = Warehouse(spark, small)
    assert bi.schema_problems(w.star) == []
    broken = w.star | {"dim_label_window": w.star["dim_label_window"].select("history_cutoff", "label_window"), "more": spark.range(1)}
    del broken["fct_renewal_cohort"]
    assert len(bi.schema_problems(broken)) == 3
    with pytest.raises(ValueError, match="instead of"):
        bi.contract(w.star | {"dim_label_window": spark.range(1)})
    cached = curve.CachedCurve.of(spark.createDataFrame(CURVE, CURVE_SCHEMA))
    checked = curve.boundary_checks(cached, 100, curve.Scenario(200, 0.1, 0.5, 2.0, 0.12, 0.04))
    assert len(checked) == 11 and all(checked.values())
    cached.points["minimum_score"][2] = 0.9
    assert not curve.boundary_checks(cached, 100, curve.Scenario(200, 0.1, 0.5, 2.0, 0.12, 0.04))["whole_prefixes"]


def test_serving_refuses_and_bounds(spark, small):
    w = Warehouse(spark, small)
    with pytest.raises(ValueError):
        w.store.overview_row("1999-01")
    for bad in (0, 241, 1.5, True):
        with pytest.raises(ValueError):
            w.store.cohort_rows(w.last, bad)
    with pytest.raises(ValueError):
        w.store.segment_rows(w.last, "gender")
    with pytest.raises(ValueError):
        w.private.profile("zz", w.last)
    assert not hasattr(w.store, "subscribers") and not hasattr(serve.PublicStore, "profile")
    body = serve.envelope(w.store.status(), "public", "r1", label_window=w.last)
    assert len(body["data"]) == 2 and body["meta"]["filters"] == {"label_window": w.last}


def test_movement_tone(spark):
    rows = [("a", 0.0639, 0.9361, 100, 10, 0.1, 5), ("b", 0.0899, 0.9101, 100, 10, 0.1, 5)]
    df = spark.createDataFrame(rows, "label_window string, observed_churn_rate double, observed_renewal_rate double, active_subscribers long, gross_receipts_30d long, cancellation_event_rate double, listening_active_days_30d long")
    got = {r["metric"]: r for r in movement.movements(df, "b", "a").collect()}
    assert got["observed_churn_rate"]["shown_delta"] == 2.6 and got["observed_churn_rate"]["tone"] == "adverse"
    assert got["observed_renewal_rate"]["tone"] == "adverse" and got["active_subscribers"]["tone"] == "context"


@pytest.mark.parametrize("name", ["retention_overview", "subscription_segment", "score_curve", "movement_overview", "dedup_control_totals", "timing_percentiles", "model_curve_totals", "metric_prevalence_reference", "scenario_cached"])
def test_against_other_engine(spark, small, name):
    import os

    import duckdb

    from tenura.plans import registry

    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    df = QUERIES[name].run(spark, small)
    mine = sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())
    rel = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert names == df.columns
    theirs = sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rel.fetchall())
    assert mine == theirs


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert shown(spark.range(1), "id:i").columns == ["id"]


@pytest.mark.parametrize("by", [(), ("g",)])
def test_top_decile_with_all_scores_different(spark, by):
    import numpy as np

    n = 1_000_000 if not by else 50_000
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    df = spark.range(n).select((h / float(1 << 40)).alias("p"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("int").alias("y"), F.lpad(F.col("id").cast("string"), 8, "0").alias("tie_breaker"), (F.col("id") % 3).alias("g"))
    df = df.withColumn("p", F.when(F.col("g") == 2, 0.5).otherwise(F.col("p")))  # a group whose scores are all the same
    got = {r["g"] if by else 0: r for r in evaluation.top_decile(df, by).collect()}
    rows = df.toPandas()
    for g, part in rows.groupby("g") if by else [(0, rows)]:
        part = part.sort_values(["p", "tie_breaker"], ascending=[False, True])
        k = int(np.ceil(len(part) * 0.1))
        assert got[g]["top_decile_rows"] == k and got[g]["top_decile_churn_rate"] == pytest.approx(part["y"][:k].mean())
        assert got[g]["top_decile_lift"] == pytest.approx(part["y"][:k].mean() / part["y"].mean())


def test_built_warehouse_is_read_back(spark, tmp_path, small):
    from tenura.plans import warehouse

    folder = str(tmp_path / "warehouse")
    first = warehouse.build(spark, small, folder)
    assert first["status"] == "built" and first["rebuilt"] == ["tables", "scores"]
    assert warehouse.build(spark, small, folder)["status"] == "unchanged"
    stored, live = warehouse.StoredWarehouse(spark, folder), Warehouse(spark, small)
    for name in ("overview", "segments", "review_transactions"):
        a, b = getattr(stored, name), getattr(live, name)
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert any("retention_overview" in f for f in stored.store.overview.inputFiles())
    plan = stored.store.overview._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and "Join" not in plan and "Exchange" not in plan
    points = stored.curve.orderBy("contacts").collect()
    limits = [r["minimum_score"] for r in points]
    for request in (curve.Scenario(300, limits[0] - 0.01, 120.0, 900.0, 0.2, 0.1), curve.Scenario(0), curve.Scenario(100, 1.0), curve.Scenario(200, 0.0, 0.0, 0.0, 0.9, 0.5)):
        want = {r["case_name"]: r.asDict() for r in curve.outcomes(stored.curve, request).collect()}
        for case in stored.cached_curve.outcomes(request):
            for name, value in case.items():
                assert value == want[case["case_name"]][name] or value == pytest.approx(want[case["case_name"]][name], nan_ok=True), name
    with pytest.raises(ValueError):
        curve.CachedCurve.read(spark, f"{stored.folder}/score_curve.json", 0)
    files = serve.write_static(stored.store, str(tmp_path / "static"), "r1")
    assert len(files) == 2 + 2 * 7 + 6 and all((tmp_path / "static" / f).exists() for f in files)
    names = frozenset({"subscriber_token", "msno", "event_key"})
    assert checks.leaks(spark, str(tmp_path / "static"), names).isEmpty()
    serve.write_csv(stored.private.subscribers(stored.last).select(F.lower(F.hex("subscriber_token")).alias("t")), str(tmp_path / "static/private.csv"))
    assert checks.leaks(spark, str(tmp_path / "static"), names).count() == 20


def test_tables_are_built_without_a_model(spark, tmp_path, small):
    """A build for what reads tables alone fits no model; the next whole build adds model and curve to the same tables, and then both stay."""
    from tenura.plans import registry, warehouse

    folder, fitted = str(tmp_path / "warehouse"), warehouse.evaluation.fit
    try:
        warehouse.evaluation.fit = None
        tables = warehouse.build(spark, small, folder, scored=False)
        assert tables["rebuilt"] == ["tables"] and "model" not in tables
        assert warehouse.build(spark, small, folder, scored=False)["status"] == "unchanged"
    finally:
        warehouse.evaluation.fit = fitted
    whole = warehouse.build(spark, small, folder)
    assert whole["rebuilt"] == ["scores"] and whole["places"] == tables["places"] and whole["tables"] == tables["tables"]
    assert warehouse.build(spark, small, folder, scored=False)["status"] == warehouse.build(spark, small, folder)["status"] == "unchanged"
    assert warehouse.StoredWarehouse(spark, folder).curve.count() > 0
    reads = {n for n, q in registry.QUERIES.items() if {"curve", "cached_curve", "scores", "model"} & set(q.build.__code__.co_names) and "w" in q.build.__code__.co_varnames and n.startswith("model_")}
    assert reads <= {n for n, q in registry.QUERIES.items() if q.scored}


def test_review_events_are_sequenced_for_reviewed_subscribers_only(spark, small):
    live = Warehouse(spark, small, contracts.Settings(review_subscribers=20))
    whole = marts.review_transactions(live.review, features.sequenced(live.transactions), live.settings.review_events)
    got = sorted(map(str, live.review_transactions.collect()))
    assert got == sorted(map(str, whole.collect())) and got
    plan = live.review_transactions._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[plan.index("RepartitionByExpression") :]


def test_the_built_curve_is_the_saved_models(spark, tmp_path):
    """Every point is a prefix sum of the scores that the saved model gives; a changed model rebuilds only what follows from it."""
    from tenura.plans import warehouse

    folder, tables = str(tmp_path / "warehouse"), "/root/testdata/sf0.01"
    first = warehouse.build(spark, tables, folder)
    stored = warehouse.StoredWarehouse(spark, folder)
    assert first["model"]["kind"] == "logistic"
    rows = stored.model.score(stored.features).toPandas()
    rows = rows[rows["is_repeat_subscriber"] == 1].sort_values(["p", "tie_breaker"], ascending=[False, True])
    points = stored.curve.orderBy("contacts").collect()
    assert [r["contacts"] for r in points] == [*range(100, len(rows) + 1, 100), *([len(rows)] if len(rows) % 100 else [])]
    assert rows["p"].nunique() > 100
    for r in points:
        top = rows[: r["contacts"]]
        money = top["latest_actual_amount_paid"].clip(lower=0).astype(float)
        assert r["minimum_score"] == pytest.approx(top["p"].iloc[-1], abs=1e-8) and r["expected_churners"] == pytest.approx(top["p"].sum(), abs=1e-3)
        assert r["observed_churners"] == top["is_churn"].sum() and r["selected_payment_proxy"] == money.sum()
        assert r["risk_weighted_payment_proxy"] == pytest.approx((top["p"] * money).sum(), rel=1e-9)
    again = warehouse.build(spark, tables, folder, contracts.Settings(score_model="prevalence"))
    assert again["rebuilt"] == ["scores"] and again["places"] == first["places"] and again["model"]["kind"] == "prevalence"
    other = warehouse.StoredWarehouse(spark, folder, contracts.Settings(score_model="prevalence"))
    assert other.version != stored.version and other.scores.select("p").distinct().count() == 1
    assert other.snapshot.inputFiles() == stored.snapshot.inputFiles() and stored.curve.count() == len(points)
    finer = warehouse.build(spark, tables, folder, contracts.Settings(group_size=50))
    assert finer["rebuilt"] == ["scores"] and warehouse.StoredWarehouse(spark, folder).curve.count() > len(points)
    assert warehouse.build(spark, tables, folder, contracts.Settings(minimum_group=50))["rebuilt"] == ["tables", "scores"]


def test_a_curve_is_the_same_of_any_layout(spark):
    rows = spark.range(3000).select((F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)).alias("p"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 977 * 13 - 50).alias("receipts"), F.sha2(F.col("id").cast("string"), 256).alias("tie_breaker"))
    found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for n in (1, 7, 200):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found.append(sorted(map(tuple, curve.score_curve(rows.repartition(n)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found[0] == found[1] == found[2] and len(found[0]) == 30


def test_models_are_saved_and_loaded(spark, tmp_path, small, monkeypatch):
    w = Warehouse(spark, small)
    rows = evaluation.features(w.stored_snapshot, w.last, w.first)
    for kind in ("logistic", "boosted", "prevalence"):
        model = evaluation.fit(rows.filter("bucket < 5"), rows.filter("bucket >= 5"), kind, evaluation.Parameters(iterations=3, least_rows=5))
        assert model.kind == kind
        model.save(spark, str(tmp_path / kind))
        again = evaluation.ChurnModel.load(spark, str(tmp_path / kind))
        a, b = ({r["tie_breaker"]: r["p"] for r in m.score(rows).select("tie_breaker", "p").collect()} for m in (model, again))
        assert a == pytest.approx(b) and all(0 < p < 1 for p in a.values()) and (len(set(a.values())) == 1) == (kind == "prevalence")
        assert evaluation.invalid_scores(again.score(rows)).isEmpty()
    one = evaluation.fit(rows.filter("is_churn = 1"), rows, "logistic")
    assert one.kind == "prevalence" and evaluation.invalid_scores(one.score(rows)).isEmpty()
    missing = rows.withColumn("tenure_days", F.when(F.col("bucket") > 2, F.col("tenure_days"))).withColumn("latest_is_cancel", F.lit(None).cast("int"))
    medians = evaluation.medians_of(missing)
    table = missing.toPandas()
    monkeypatch.setattr(evaluation, "SMALL", 10)
    assert evaluation.medians_of(missing) == medians
    assert medians == pytest.approx({c: float(table[c].astype(float).median()) for c in evaluation.NUMERIC})
    coded = evaluation.typed(missing, medians)
    assert coded.filter("n_tenure_days IS NULL OR c_latest_is_cancel <> '-1'").isEmpty()


def test_logistic_margin_is_the_pipelines(spark, small):
    """The expression of a fitted model gives what Spark's own transformers give."""
    import numpy as np
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.functions import vector_to_array

    w, kept = Warehouse(spark, small), []
    rows = evaluation.features(w.stored_snapshot, w.last, w.first)
    plain = Pipeline.fit
    Pipeline.fit = lambda self, *a: kept.append(plain(self, *a)) or kept[-1]
    try:
        model = evaluation.fit(rows.filter("bucket < 5"), rows, "logistic").scorer
    finally:
        Pipeline.fit = plain
    assert isinstance(kept[0], PipelineModel)
    medians = {c: n[0] for c, n in model.numbers.items()}
    want = kept[0].transform(evaluation.typed(rows, medians)).select(vector_to_array("rawPrediction")[1].alias("m")).collect()
    assert sorted(r["margin"] for r in model.with_margin(rows).collect()) == pytest.approx(sorted(r["m"] for r in want))
    assert np.isfinite([r["margin"] for r in model.with_margin(rows.withColumn("latest_payment_method_id", F.lit(999))).collect()]).all()


@pytest.mark.parametrize("size", [250_000, 400])
def test_bootstrap_against_a_plain_one(spark, size):
    import numpy as np

    n = 1500
    rng = np.random.default_rng(5)
    y, base, p = (rng.random(n) < 0.3).astype(int), rng.uniform(0.01, 0.99, n), np.round(rng.uniform(0, 0.98, n), 2) + 0.013
    scored = spark.createDataFrame([(f"{k:05d}", int(y[k]), float(p[k]), float(base[k])) for k in range(n)], "tie_breaker string, y int, p double, base double").repartition(6)
    sample = evaluation.stratified_sample(scored, size, 7).toPandas()
    hashes = {r["tie_breaker"]: r["h"] for r in scored.select("tie_breaker", F.xxhash64("tie_breaker", F.lit(7)).alias("h")).collect()}
    yes = round(size * y.sum() / n)
    want = set()
    for value, k in ((1, yes), (0, size - yes)):
        own = sorted((i for i in range(n) if y[i] == value), key=lambda i: hashes[f"{i:05d}"])
        want |= {f"{i:05d}" for i in (own if size >= n else own[:k])}
    assert set(sample["tie_breaker"]) == want and len(sample) == min(size, n)
    sample = sample.sort_values(["p", "tie_breaker"], ascending=[False, True]).reset_index(drop=True)
    values = []
    for k in range(12):
        drawn = sample.iloc[np.random.default_rng([7, k]).integers(0, len(sample), len(sample))]
        loss = lambda q: -np.where(drawn["y"] == 1, np.log(q.clip(evaluation.EPSILON, 1 - evaluation.EPSILON)), np.log(1 - q.clip(evaluation.EPSILON, 1 - evaluation.EPSILON))).mean()  # noqa: E731, B023
        bins = (drawn["p"] * 10).astype(int)
        ece = sum((bins == b).mean() * abs(drawn["y"][bins == b].mean() - drawn["p"][bins == b].mean()) for b in set(bins))
        top = drawn.sort_values(["p", "tie_breaker"], ascending=[False, True])[: int(np.ceil(len(drawn) * 0.1))]
        values.append([(loss(drawn["base"]) - loss(drawn["p"])) / loss(drawn["base"]), loss(drawn["base"]), loss(drawn["p"]), ece, top["y"].mean() / drawn["y"].mean()])
    got = {r["measure"]: (r["low"], r["high"]) for r in evaluation.bootstrap(scored, 12, size, 7).collect()}
    for name, column in zip(evaluation.MEASURES, np.array(values).T, strict=True):
        assert got[name] == pytest.approx((np.quantile(column, 0.025), np.quantile(column, 0.975)), rel=1e-9), name
    assert evaluation.bootstrap(scored.limit(0), 5).count() == 0


def test_block_draws_are_a_multinomial():
    import numpy as np

    n, size = 2_300, 500
    each = np.array([[evaluation.block_draws(n, b, k, 7, size) for b in range(5)] for k in range(2_000)])
    before, draws = each[..., 0], each[..., 1]
    assert (draws.sum(axis=1) == n).all() and (before[:, 0] == 0).all() and (before[:, 1:] == draws.cumsum(axis=1)[:, :-1]).all()
    share = np.array([500, 500, 500, 500, 300]) / n
    assert draws.mean(axis=0) == pytest.approx(n * share, rel=0.01)
    assert np.cov(draws.T) == pytest.approx(n * (np.diag(share) - np.outer(share, share)), abs=40)


def test_bootstrap_draws_from_every_row(spark):
    """More rows than a block: replicates are those of a plain bootstrap of the whole table, not of a sample of it."""
    import numpy as np

    n, first = 260_000, 250_000
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    scored = spark.range(n).select(
        F.sha2(F.col("id").cast("string"), 256).alias("tie_breaker"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) / float(1 << 30) < chance / 3).cast("int").alias("y"),
        (F.round(chance, 3) * 0.9 + 0.0123).alias("p"), (0.1 + 0.1 * chance).alias("base"))
    table = scored.toPandas().sort_values(["p", "tie_breaker"], ascending=[False, True])
    y, p, base = (table[c].to_numpy() for c in ("y", "p", "base"))
    values = []
    for k in range(5):
        inside = np.random.default_rng([7, k, 0, 2]).binomial(n, first / n)
        drawn = np.sort(np.concatenate([np.random.default_rng([7, k]).integers(0, first, inside), first + np.random.default_rng([7, k, 1]).integers(0, n - first, n - inside)]))
        yes, q = y[drawn], p[drawn]
        base_loss, loss = (-np.where(yes == 1, np.log(x), np.log(1 - x)).mean() for x in (base[drawn], q))
        bins = (q * 10).astype(int)
        ece = sum((bins == b).mean() * abs(yes[bins == b].mean() - q[bins == b].mean()) for b in set(bins))
        values.append([(base_loss - loss) / base_loss, base_loss, loss, ece, yes[: n // 10].mean() / yes.mean()])
    found = [{r["measure"]: (r["low"], r["high"]) for r in evaluation.bootstrap(df, 5, seed=7).collect()} for df in (scored.repartition(7), scored.orderBy("base"))]
    for name, column in zip(evaluation.MEASURES, np.array(values).T, strict=True):
        assert found[0][name] == pytest.approx((np.quantile(column, 0.025), np.quantile(column, 0.975)), rel=1e-9), name
    assert found[0] == found[1]


def test_bootstrap_blocks_cut_the_top_decile_anywhere(spark):
    """Where every row has a score of its own, the best tenth of the draws is the same whatever blocks they are added up in."""
    import numpy as np

    n, size = 1_000, 90
    rng = np.random.default_rng(3)
    y, p = (rng.random(n) < 0.3).astype(int), np.sort(rng.random(n))[::-1]
    for k in range(20):
        weight = np.zeros(n, int)
        for b in range(12):
            own = min(size, n - b * size)
            drawn = np.random.default_rng([7, k, b]).integers(0, own, evaluation.block_draws(n, b, k, 7, size)[1])
            weight[b * size : b * size + own] = np.bincount(drawn, minlength=own)
        best = np.repeat(y, weight)[: n // 10]
        parts = [evaluation.block_sums((y[b * size : (b + 1) * size], p[b * size : (b + 1) * size], p[b * size : (b + 1) * size]), n, b, 20, 7, size)[k] for b in range(12)]
        assert weight.sum() == n and sum(parts)[3] == best.sum() and sum(parts)[2] == (weight * y).sum()


def test_model_decision_weighs_every_row(spark, tmp_path, monkeypatch):
    """A challenger that is better on all rows passes, though it is worse on the 250,000 with the smallest hashes."""
    from types import SimpleNamespace

    from tenura.plans import registry

    churned = F.col("id") % 25 == 0
    rows = spark.range(260_000).select(F.sha2(F.col("id").cast("string"), 256).alias("tie_breaker"), churned.cast("int").alias("y"), F.when(churned, 0.9).otherwise(0.01).alias("p"), F.lit(1).alias("is_repeat_subscriber"))
    first = evaluation.stratified_sample(rows, 250_000).select("tie_breaker", F.lit(True).alias("first"))
    close = F.when(F.col("y") == 1, 0.91).otherwise(0.009)
    rows.join(first, "tie_breaker", "left").withColumn("base", F.when(F.col("first"), close).otherwise(0.5)).write.parquet(str(tmp_path / "scored"))
    monkeypatch.setattr(registry, "_both", lambda w: spark.read.parquet(str(tmp_path / "scored")))
    found = {r["scope"]: r for r in QUERIES["model_decision"].build(SimpleNamespace(spark=spark)).collect()}
    assert found["all"]["gate_passed"] and found["repeat"]["gate_passed"] and found["new"]["challenger_ece"] is None
    assert {r["decision"] for r in found.values()} == {"ship_challenger"}


def test_constant_false_branch_is_pruned(spark, small):
    plan = QUERIES["constant_false_branch"].run(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_controls_versions_and_row_groups(spark, tmp_path, small):
    import pyarrow.parquet as pq

    (tmp_path / "controls.csv").write_text("control_id,measure_id,expected_value\na,x,1.5\nb,x,2\n")
    assert {r["control_id"]: r["expected_value"] for r in readers.read_controls(spark, str(tmp_path / "controls.csv")).collect()} == {"a": 1.5, "b": 2.0}
    (tmp_path / "twice.csv").write_text("control_id,measure_id,expected_value\na,x,1\na,x,2\n")
    with pytest.raises(ValueError):
        readers.read_controls(spark, str(tmp_path / "twice.csv"))
    assert promote.counted_write(spark.range(250_000).coalesce(1), str(tmp_path / "v1")) == 250_000
    meta = pq.ParquetFile(next((tmp_path / "v1").glob("*.parquet"))).metadata
    assert max(meta.row_group(k).num_rows for k in range(meta.num_row_groups)) <= promote.ROW_GROUP
    promote.counted_write(spark.range(3).withColumn("more", F.lit("x")), str(tmp_path / "v2"))
    both = readers.read_versions(spark, str(tmp_path / "v1"), str(tmp_path / "v2"))
    assert both.columns == ["id", "more"] and both.count() == 250_003 and both.filter("more = 'x'").count() == 3
    scored = spark.createDataFrame([("a", 0.5), ("b", 1.0)], "tie_breaker string, p double")
    assert evaluation.require_scores(scored, scored) is scored
    for bad in (scored.limit(1), scored.unionByName(scored.limit(1)), scored.withColumn("p", F.lit(1.5))):
        with pytest.raises(ValueError):
            evaluation.require_scores(bad, scored)
    with pytest.raises(ValueError):
        evaluation.require_allowed(("tenure_days", "gender"))
