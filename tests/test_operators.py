"""Literal rows for the traps: nulls, ties, bad text, empty groups."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from radiolens.functions.numbers import bounded, number
from radiolens.functions.scalar import decode_label, encode_alphabetical, top_probabilities
from radiolens.operators import asof, clean, evaluate, explore, labels, requests, rules, selection
from radiolens.plans.ordered import LogOrder
from radiolens.sources import documents, logs, store

T0 = dt.datetime(2024, 1, 1)


def one(df, column):
    return [r[column] for r in df.collect()]


def test_number_accepts_only_finite_decimals(spark):
    texts = ["12.5", " -3 ", "1e2", ".5", "5d", "nan", "inf", "", None, "0x1", "1,5", "7."]
    df = spark.createDataFrame([(t,) for t in texts], "x string").select(number("x").alias("x"))
    assert one(df, "x") == [12.5, -3.0, 100.0, 0.5, None, None, None, None, None, None, None, 7.0]


def test_bounded_keeps_null(spark):
    df = spark.createDataFrame([(-200.0,), (None,), (-50.0,), (0.0,)], "x double")
    assert one(df.select(bounded("x", -120.0, -25.0).alias("x")), "x") == [-120.0, None, -50.0, -25.0]


def test_first_of_multi_and_blank_rows(spark):
    df = spark.createDataFrame([(" -80, -91", " "), ("-70 ", "x"), ("  ", ""), (None, " ")], "a string, b string")
    assert one(clean.first_of_multi(df, ["a"]), "a") == ["-80", "-70 ", "  ", None]
    assert clean.drop_blank_rows(df).count() == 3  # a NULL cell is not blank text


def test_time_of_day(spark):
    df = spark.createDataFrame([("10:20:30.5",), ("at 1:02:03.250 x",), ("10:20:30",), ("25:00:00.1",), (None,)], "t string")
    got = one(clean.parse_time_of_day(df, "t"), "t")
    assert got == [dt.datetime(1970, 1, 1, 10, 20, 30, 500000), dt.datetime(1970, 1, 1, 1, 2, 3, 250000), None, None, None]


def test_clean_umts_headers(spark):
    header = list(clean.UMTS_NAMES)
    rows = [
        ("10:20:30.5", "1", "10, 20", "5,6", "-200", "9", "-80", "7"),
        ("10:20:30.5", "1", "10, 20", "5,6", "-200", "9", "-80", "7"),
        ("bad", "1", "10", "5", "-90", "-9", None, None),
        ("10:20:31.5", "1", "10", "5", "n/a", "-9", None, None),
        (" ", " ", " ", " ", " ", " ", " ", " "),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in header))
    got = clean.clean_umts(clean.rename_columns(logs.validate_columns(df)), time_of_day=True).collect()
    assert len(got) == 1
    assert (got[0]["psc"], got[0]["uarfcn"], got[0]["rscp"], got[0]["ecn0"]) == (5.0, 10.0, -120.0, 5.0)
    with pytest.raises(ValueError, match="RSCP"):
        logs.validate_columns(df.drop("RSCP (active)"))


def samples(rng, n, start=0):
    return [(start + i, int(rng.integers(0, 3)), T0 + dt.timedelta(seconds=int(rng.integers(0, 200)))) for i in range(n)]


@pytest.mark.parametrize("plan", ["keyed", "chunked"])
def test_asof_equals_pandas(spark, plan):
    rng = np.random.default_rng(3)
    left, right = samples(rng, 150), [(*r, float(r[0])) for r in samples(rng, 60, 1000)]
    l = spark.createDataFrame(left, "event_id bigint, s int, ts timestamp")
    r = spark.createDataFrame(right, "event_id bigint, s int, ts timestamp, v double")
    got = {x["event_id"]: x["v"] for x in asof.asof_nearest(l, r, "ts", 2.0, ["s"], plan=plan, chunk_rows=20).collect()}
    pl = pd.DataFrame(left, columns=["event_id", "s", "ts"]).sort_values(["ts", "event_id"])
    pr = pd.DataFrame(right, columns=["rid", "s", "ts", "v"]).sort_values(["ts", "rid"])
    want = pd.merge_asof(pl, pr, on="ts", by="s", direction="nearest", tolerance=pd.Timedelta("2s"))
    assert got == {int(i): (None if pd.isna(v) else v) for i, v in zip(want["event_id"], want["v"])}


def test_asof_ties_and_tolerance(spark):
    l = spark.createDataFrame([(1, T0)], "event_id bigint, ts timestamp")

    def match(*seconds):
        rows = [(10 + i, T0 + dt.timedelta(seconds=s), float(i)) for i, s in enumerate(seconds)]
        r = spark.createDataFrame(rows, "event_id bigint, ts timestamp, v double")
        return one(asof.asof_nearest(l, r, "ts", 2.0), "v")[0]

    assert match(-1, 1) == 0.0  # equal distance: the earlier row
    assert match(-2) == 0.0 and match(2) == 0.0  # inclusive
    assert match(-2.5, 2.1) is None
    assert match(0, 0) == 1.0  # same time: the last one
    assert match(1, 1) == 0.0  # future: the first one


def umts(spark, values):
    rows = [(i, T0 + dt.timedelta(seconds=i), *v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "event_id bigint, ts timestamp, psc int, rscp double, ecn0 double, rscp_det double")


CELL = LogOrder(("ts", "event_id"), ("psc",))


def test_labels_and_null_cells(spark):
    df = umts(spark, [(1, -80.0, -12.0, None)] * 3 + [(None, -112.0, -16.0, -111.0)] * 4)
    assert one(labels.label_interference(df, CELL).orderBy("event_id"), "interference") == [0, 0, 1, 0, 0, 0, 0]
    assert one(labels.label_outage(df, CELL).orderBy("event_id"), "panne_probable") == [0] * 7
    # the instant context fires without a cell, the streak does not
    assert one(labels.label_congestion(df, CELL).orderBy("event_id"), "congestion_probable") == [0, 0, 0, 1, 1, 1, 1]


def test_outage_by_drop(spark):
    df = umts(spark, [(1, -60.0, -5.0, None), (1, -80.0, -5.0, None), (1, -110.0, -5.0, None), (1, -60.0, -15.0, None)])
    assert one(labels.label_outage(df, CELL).orderBy("event_id"), "panne_probable") == [0, 0, 0, 1]


def test_encode_and_decode(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("c",)], "x string")
    got = {r["x"]: r["x_enc"] for r in encode_alphabetical(df, "x").collect()}
    assert got == {"a": 0, "b": 1, "c": 2, None: -1}
    codes = spark.createDataFrame([("0",), ("3.0",), ("9",), ("x",), (None,)], "c string")
    assert one(decode_label(codes, "c"), "label") == ["Acceptable", "Tres bonne", "9", "x", None]


def test_top_probabilities_ties_keep_order(spark):
    df = spark.sql("select map('b', 0.3D, 'a', 0.3D, 'c', 0.4D) as p")
    assert [(e["key"], e["value"]) for e in one(top_probabilities(df, "p"), "top")[0]] == [("c", 0.4), ("b", 0.3)]


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


@pytest.mark.parametrize("plan", ["keyed", "chunked"])
def test_curve_areas(spark, plan):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 80), rng.integers(0, 12, 80) / 12
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y_true int, y_proba double")
    got = evaluate.curve_areas(df, plan=plan).first()
    assert got["roc_auc"] == pytest.approx(brute_auc(y, s))
    points = [(0.0, 1.0)]
    for t in sorted(set(s), reverse=True):
        said = s >= t
        points.append(((y[said] == 1).sum() / (y == 1).sum(), (y[said] == 1).mean()))
    area = sum((r2 - r1) * (p1 + p2) / 2 for (r1, p1), (r2, p2) in zip(points, points[1:]))
    assert got["pr_auc"] == pytest.approx(area)
    single = evaluate.curve_areas(df.where("y_true = 1"), plan=plan).first()
    assert single["roc_auc"] is None and single["pr_auc"] is None


def test_threshold_prefers_the_lowest_of_equals(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.6), (0, 0.2)], "y_true int, y_proba double")
    got = evaluate.optimize_threshold(df, "recall").first()
    assert got["threshold"] == 0.05 and got["best_score"] == 1.0
    assert evaluate.optimize_threshold(df, "f1").first()["threshold"] == pytest.approx(0.25)


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0, 0.1)], "y_true int, y_pred int, y_proba double")
    got = evaluate.binary_metrics(df).first()
    assert (got["precision"], got["recall"], got["f1"], got["accuracy"]) == (0.0, 0.0, 0.0, 1.0)
    assert evaluate.error_rates(df).first()["verdict"] == evaluate.NO_MISSES


def test_selection_first_of_equals(spark):
    rows = [("t", "B", 1, 0.5, 0.5, 0.5, 0.5, None), ("t", "A", 0, 0.5, 0.5, 0.5, 0.5, 0.9)]
    df = spark.createDataFrame(rows, "task string, model string, place int, recall double, roc_auc double, f1 double, cv_roc_auc double, pr_auc double")
    assert selection.select_weighted(df).first()["model"] == "A"
    assert selection.select_lexicographic(df, {}).first()["model"] == "A"  # missing metric is last


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 10, 10)], "v double")
    got = {r["bin"]: r["n"] for r in explore.histogram(df, "v", 5).collect()}
    assert got == {0: 2, 1: 1, 4: 2}
    flat = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert {r["bin"]: r["n"] for r in explore.histogram(flat, "v", 5).collect()} == {2: 2}  # as numpy bins it


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "a int, b string")
    assert explore.duplicate_count(df).first()[0] == 1


def test_trailing_max_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 2)), T0 + dt.timedelta(seconds=float(rng.integers(0, 300)) / 2), float(rng.integers(-99, 0)))
            for _ in range(300)]
    df = spark.createDataFrame(rows, "psc int, ts timestamp, rscp double")
    got = {(r["psc"], r["at"]): r["peak"] for r in rules.trailing_max(df, "psc", "rscp", 30).collect()}
    epoch = dt.datetime(1970, 1, 1)
    for psc, ts, _ in rows:
        want = max(v for p, t, v in rows if p == psc and ts - dt.timedelta(seconds=30) <= t <= ts)
        assert got[(psc, (ts - epoch) // dt.timedelta(microseconds=1))] == want


def test_ping_pong(spark):
    cells = [371, 371, 370, 370, 371, 372, 371]
    df = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=i), 1, c) for i, c in enumerate(cells)],
                               "event_id bigint, ts timestamp, session_id int, pci int")
    got = rules.ping_pong(df, LogOrder(("ts", "event_id"), ("session_id",))).orderBy("event_id").collect()
    assert [(r["event_id"], r["pci"], r["via"]) for r in got] == [(4, 371, 370), (6, 371, 372)]


def test_ping_pong_across_chunks(spark):
    """Long stays, gaps in the cell and borders of chunks anywhere."""
    rng = np.random.default_rng(8)
    cells = [None if c == 3 else int(c) for c in np.repeat(rng.integers(0, 4, 60), rng.integers(1, 6, 60))]
    df = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=i), i % 2, c) for i, c in enumerate(cells)],
                               "event_id bigint, ts timestamp, session_id int, pci int")
    want = []
    for session in (0, 1):
        visits = []
        for i, c in enumerate(cells):
            if i % 2 == session and (not visits or visits[-1][1] != c):
                visits.append((i, c))
        want += [(i, c, via) for (_, a), (_, via), (i, c) in zip(visits, visits[1:], visits[2:]) if c is not None and a == c]
    order = LogOrder(("ts", "event_id"), ("session_id",), chunk_rows=7, plan="chunked")
    got = rules.ping_pong(df, order).collect()
    assert sorted((r["event_id"], r["pci"], r["via"]) for r in got) == sorted(want) and len(want) > 5


def test_duration_alarm_needs_more_than_the_limit(spark):
    df = umts(spark, [(1, -80.0, -15.0, None)] * 61 + [(1, -80.0, -5.0, None)] + [(1, -80.0, -15.0, None)] * 62)
    got = rules.duration_alarms(df, F.col("ecn0") < -14, 60, CELL).collect()
    assert [(r["samples"], r["duration_s"]) for r in got] == [(62, 61.0)]


def test_requests(spark):
    df = spark.createDataFrame([({k: 1.0 for k in requests.QOS_KEYS},), ({"rsrp": 1.0},)], "f map<string,double>")
    assert one(requests.route_task(df, "f"), "task") == ["qos", "coverage"]
    text = spark.createDataFrame([(" ", "x", "3")], "a string, b string, c string")
    got = requests.coerce_inputs(text, ["a", "b", "c"]).first()
    assert (got["a"], got["b"], got["c"], got["invalid"]) == (0.0, None, 3.0, ["b"])
    assert len(requests.BOUNDS) == 20
    stats = spark.createDataFrame([("x", 10.0, 2.0)], "feature string, mean double, std double")
    assert requests.bounds_from_stats(stats).first() == Row(feature="x", lo=4.0, hi=16.0)


def test_read_documents(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.md").write_text("one\ntwo", encoding="utf-8")
    (tmp_path / "a" / "b" / "x.md").write_text("deux é", encoding="utf-8")
    (tmp_path / "a" / "n.txt").write_text("no", encoding="utf-8")
    got = {r["source"]: r["text"] for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"knowledge_base/a/x.md": "one\ntwo", "knowledge_base/a/b/x.md": "deux é"}


def test_documents_written_and_read(spark, tmp_path):
    """One file per id in few folders; lines, accents and empty texts come back, rows of one id share its file."""
    texts = {i: f"é {i}\nend" for i in range(50)} | {50: "", 51: None}
    rows = spark.createDataFrame([*texts.items(), (7, "more")], "doc_id bigint, text string").coalesce(1)
    for root in (str(tmp_path / "a"), (tmp_path / "b").as_uri(), "file:" + str(tmp_path / "c d")):
        documents.write_documents(rows, root, "doc_id", folder=10)
        got = documents.read_documents(spark, root, "*.txt").collect()
        found = {int(r["source"].rsplit("=", 1)[1].removesuffix(".txt")): r["text"] for r in got}
        assert len(got) == 52 and sorted(found.pop(7).split("\n")) == sorted(["é 7", "end", "more", ""])
        assert found == {i: (t or "") + "\n" for i, t in texts.items() if i != 7}
    folders = [p for p in (tmp_path / "a").rglob("*") if p.is_dir()]
    assert len(folders) <= 6 and not [p for p in (tmp_path / "a").rglob(".*")]


def test_files_are_listed_by_tasks(spark, tmp_path):
    """The driver keeps no list of the files; what is read is what Spark's reader finds."""
    names = ["x.txt", "a/_h.txt", "a/.h.txt", "a/_k=1.txt", "_b/y.txt", "_c=2/y.txt", "d/e/f/g é%20.txt", "d/n.md", "d/empty.txt"]
    for i, name in enumerate(names):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if "empty" in name else b"\xef\xbb\xbfone\r\ntwo \xff %d" % i)
    (tmp_path / "none").mkdir()
    got = documents.read_documents(spark, str(tmp_path), "*.txt")
    assert not [f for f in got.inputFiles() if f.endswith(".txt")]
    theirs = spark.read.text(str(tmp_path), wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    place = F.substring_index(F.url_decode("_metadata.file_path"), str(tmp_path) + "/", -1)
    want = theirs.select(F.concat(F.lit("knowledge_base/"), place), F.hex(F.encode("value", "UTF-8"))).collect()
    assert sorted(map(tuple, got.select("source", F.hex(F.encode("text", "UTF-8"))).collect())) == sorted(map(tuple, want))
    assert documents.read_documents(spark, str(tmp_path / "none"), "*.txt").count() == 0


def test_read_log_encodings(spark, tmp_path):
    text = "Time;Zone\n10:00:00.1;Très bonne\n"
    for name, encoding in (("u", "utf-8"), ("s", "utf-8-sig"), ("l", "latin1")):
        (tmp_path / f"{name}.csv").write_text(text, encoding=encoding)
        df = logs.read_log(spark, str(tmp_path / f"{name}.csv"))
        assert df.columns == ["Time", "Zone"] and df.first()["Zone"] == "Très bonne"


def test_device_log(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("Timestamp,Network provi. , NetworkType,RSRP,Velocity(km/h)\n2025-08-31 22:12:02.008, airtel,LTE,-99 dBm,11.05 km/h\n")
    df = logs.parse_device_log(logs.read_log(spark, str(path), sep=","), ["RSRP", "Velocity(km/h)"], ["Network provi."])
    assert df.first()["Network provi."] == "airtel" and df.first()["RSRP"] == -99.0 and df.first()["Velocity(km/h)"] == 11.05


def test_sample_is_capped(spark):
    assert store.sample_rows(spark.range(3000), ["id"], 5000).count() == 1000
