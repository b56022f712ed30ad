"""Cases worked out by hand."""

import datetime as dt
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartier.functions import dates, keys, numbers, text
from quartier.operators import aggregates, corpus, evaluation, forecast, joins, models, retrieval, series, spatial, validation
from quartier.sources import normalize, store

D = dt.date


def one(spark, column, schema="x string", rows=((None,),)):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(column).collect()]


def test_keys(spark):
    cases = {"3007390001": "3007390001", "  3007390001  ": "3007390001", "3-00739-0001": "3007390001", "03007390001": "3007390001", "300739001": "0300739001",
             "1": "0000000001", "1000010001": "1000010001", "": None, "   ": None, "N/A": None, "UNKNOWN": None, "0": None, None: None, "3007390001.0": "0073900010"}
    assert one(spark, keys.normalize_key(F.col("x")), rows=[(k,) for k in cases]) == list(cases.values())
    assert one(spark, keys.normalize_key(F.col("x"), strip_fraction=True), rows=[("3007390001.0",)]) == ["3007390001"]
    pairs = [("2", "1"), ("1", None), ("1", "0000000000"), (None, "1")]
    assert one(spark, keys.resolve_key(F.col("x"), F.col("b")), "x string, b string", pairs) == ["1", "1", "1", None]
    names = ["a", "", "été", "x" * 300]
    assert one(spark, keys.uuid5(uuid.NAMESPACE_URL, F.col("x")), rows=[(n,) for n in names]) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    assert one(spark, keys.uuid5(uuid.NAMESPACE_DNS, F.col("x"), hyphens=False), rows=[("a",)]) == [uuid.uuid5(uuid.NAMESPACE_DNS, "a").hex]


def test_dates(spark):
    rows = [(D(2020, 3, 2),), (D(2024, 11, 4),), (D(2023, 4, 3),)]
    flags = dates.regime_flags(spark.createDataFrame(rows, "week_start date")).collect()
    assert [[r[i] for i in range(1, 6)] for r in flags] == [[True, False, False, False, False], [False, True, True, True, False], [False, True, False, False, False]]
    q = [tuple(r) for r in dates.quarters_between(spark, D(2023, 11, 5), D(2024, 5, 1), D(2024, 5, 10)).collect()]
    assert q == [("2023-Q4", D(2023, 10, 1), D(2023, 12, 31)), ("2024-Q1", D(2024, 1, 1), D(2024, 3, 31)), ("2024-Q2", D(2024, 4, 1), D(2024, 5, 10))]
    assert [r[0] for r in dates.week_calendar(spark, D(2024, 1, 3), D(2024, 1, 15)).collect()] == [D(2024, 1, 1), D(2024, 1, 8), D(2024, 1, 15)]


def test_numbers(spark):
    assert one(spark, numbers.safe_rate(F.col("a"), F.col("b")), "a int, b int", [(1, 3), (1, 0), (None, 2)]) == [0.3333, None, None]
    hot, cold = numbers.degree_days(F.col("x"))
    assert [tuple(r) for r in spark.createDataFrame([(10.0,), (20.5,), (None,)], "x double").select(hot, cold).collect()] == [(8.0, 0.0), (0.0, 2.5), (None, None)]
    ring = [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]]
    df = spark.createDataFrame([(ring,)], "rings array<array<struct<x:double,y:double>>>")
    c = df.select(numbers.centroid(F.col("rings")).alias("c"), numbers.polygon_area(F.col("rings")).alias("a")).first()
    assert c.a == 3.0 and abs(c.c.lon - 3.5 / 3) < 1e-9
    assert one(spark, numbers.decile_label(F.col("x")), "x int", [(1,), (10,), (11,)]) == ["very low", "very high", None]


LEGAL = """§151.02 Duty to keep free of rodents
"Rodent" means any rat or mouse. "Harborage" shall mean a place of shelter. See §151.03(a) and Article 151.
(a) Every owner shall act.
(b) As said in Title 24, and §151.03(a).
§151.03 Sites
(a) First rule. (1) inner
"""


def test_legal_text(spark):
    df = spark.createDataFrame([("d", LEGAL), ("e", "no mark"), ("f", None)], "doc_id string, text string")
    got = [(r.doc_id, r.citation, r.parent_citation, r.title) for r in corpus.split_sections(df).orderBy("doc_id", "position").collect()]
    assert got == [("d", "§151.02", None, "Duty to keep free of rodents"), ("d", "§151.02(a)", "§151.02", ""), ("d", "§151.02(b)", "§151.02", ""),
                   ("d", "§151.03", None, "Sites"), ("d", "§151.03(a)", "§151.03", ""), ("e", "§(full)", None, "")]
    r = df.where("doc_id = 'd'").select(text.defined_terms(F.col("text")).alias("t"), text.cross_refs(F.col("text")).alias("c")).first()
    assert r.t == {"rodent": "any rat or mouse", "harborage": "a place of shelter"}
    assert r.c == ["§151.02", "§151.03(a)", "Article 151", "Title 24", "§151.03"]
    built = corpus.link_parents(corpus.build_corpus(df, "law", "doc_id", max_tokens=4))
    ids = {x.citation: x for x in built.where("document = 'd'").collect()}
    assert ids["§151.02(a)"].parent_chunk_id == ids["§151.02(parent)"].chunk_id and ids["§151.02(parent)"].parent_chunk_id is None
    assert all(x.content_with_prefix.startswith("From law d §") and len(x.version_hash) == 64 for x in ids.values())


def test_titles_may_stand_on_the_next_line(spark):
    text = "Preamble\n§1.1\nDuty of owners\nKeep it clean.\n(a) Each day\n(b) Each  night \n§ 2-10 Title here\nBody\n§3.1"
    got = corpus.split_sections(spark.createDataFrame([("x", text), ("y", None), ("z", " no marks ")], "doc_id string, text string")).collect()
    assert [(r.doc_id, r.position, r.citation, r.parent_citation, r.title, r.content, r.depth, r.has_children) for r in got] == [
        ("x", 0, "§1.1", None, "Duty of owners", "Keep it clean.\n(a) Each day\n(b) Each  night", 0, True),
        ("x", 1, "§1.1(a)", "§1.1", "", "Each day", 1, False),
        ("x", 2, "§1.1(b)", "§1.1", "", "Each  night", 1, False),
        ("x", 3, "§2-10", None, "Title here", "Body", 0, False),
        ("x", 4, "§3.1", None, "", "", 0, False),
        ("z", 0, "§(full)", None, "", "no marks", 0, False),
    ]


def test_null_keys_are_inserted_once(spark):
    rows = spark.createDataFrame([(None, 1), (1, 2)], "k int, v int")
    assert store.upsert(rows.limit(0), rows, ["k"], on_conflict="nothing").count() == 2
    assert store.upsert(rows, rows, ["k"], on_conflict="nothing").count() == 2
    chunks = spark.createDataFrame([(None, "h", 1)], "chunk_id string, version_hash string, v int")
    assert corpus.upsert_chunks(chunks, chunks.withColumn("v", F.lit(2))).first().v == 1


def test_group_models_are_calibrated_on_their_last_rows(spark):
    at, to = models.isotonic_steps(np.array([0.1, 0.2, 0.2, 0.5, 0.7, 0.9]), np.array([0, 1, 0, 0, 1, 1]))
    assert at.tolist() == [0.1, 0.2, 0.5, 0.7, 0.9] and to.tolist() == pytest.approx([0, 1 / 3, 1 / 3, 1, 1])
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    rows = [("g", w, float(v), float(rng.random() < 1 / (1 + np.exp(-3 * v)))) for v, w in zip(x, weeks(400), strict=True)]
    df = spark.createDataFrame(rows, "g string, week_start date, x double, y double")
    got = models.group_models(df, df, "g", ["x"], "y", date="week_start").toPandas().sort_values("x")
    assert got["group_score"].is_monotonic_increasing and got["group_score"].between(0, 1).all()
    late = got.sort_values("week_start").tail(80)
    assert abs(late["group_score"].mean() - late["y"].mean()) < 1e-6  # monotone means keep the sum


def test_exact_quantiles(spark):
    rng = random.Random(4)
    for n in (0, 1, 2, 7, 500):
        values = [rng.choice([rng.random(), 0.5, None]) for _ in range(n)] if n > 2 else [0.25] * n
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got = aggregates.exact_quantiles(df, "v", [0, 0.1, 0.33, 0.9, 1]).first()
        held = [v for v in values if v is not None]
        assert (got is None or got[0] is None) if not held else got[0] == pytest.approx(np.quantile(held, [0, 0.1, 0.33, 0.9, 1]).tolist())


def test_chunk_windows(spark):
    for n in (1, 450, 461, 462, 846, 847, 1242, 1243):
        words = [f"w{i}" for i in range(n)]
        df = spark.createDataFrame([("d", " ".join(words))], "doc_id string, text string")
        got = [r.content.split() for r in corpus.chunk_sections(corpus.split_sections(df)).orderBy("part").collect()]
        want, start = [], 0
        if int(n * 1.3) <= 600:
            want = [words]
        else:
            while True:
                want.append(words[start : start + 450])
                if start + 450 >= n:
                    break
                start += 396
        assert got == want, n


def test_recursive_split(spark):
    rng = random.Random(0)
    t = "\n\n".join(". ".join(" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(3, 40))) for _ in range(5)) for _ in range(8)) + "x" * 5000
    got = [r.content for r in corpus.split_recursive(spark.createDataFrame([("d", t)], "doc_id string, text string"), 400, 60).orderBy("part").collect()]
    assert max(map(len, got)) <= 400 and sum(map(len, got)) >= len(t) * 0.9
    assert all(c in t for c in got)


def test_crosswalk(spark):
    rows = [("BK0101", "BK2201", 0.6), ("BK0101", "BK2202", 0.4), ("MN2501", "MN2501", 1.0), ("QN9901", "QN9901", 0.54), ("QN9901", "QN9902", 0.36)]
    x = spatial.normalize_crosswalk(spark.createDataFrame(rows, "src string, dst string, weight double"))
    assert [round(r[0], 9) for r in x.groupBy("src").agg(F.sum("weight").alias("w")).select("w").collect()] == [1.0] * 3
    values = spark.createDataFrame([("BK0101", 12345.67), ("none", 5.0)], "src string, value double")
    assert abs(spatial.allocate(values, x).agg(F.sum("value")).first()[0] - 12345.67) < 1e-6
    gaps = spatial.crosswalk_gaps(x, spark.createDataFrame([("MN2501",), ("ZZ",)], "id string"), "id").collect()
    assert [(g.kind, g.id) for g in gaps] == [("missing", "ZZ")]
    named = normalize.resolve_columns(spark.createDataFrame(rows, "NTA10 string, NTA20 string, PCT double"), {"src": ["nta2010", "nta10"], "weight": ["pct"]})
    assert named.columns == ["src", "weight"]
    with pytest.raises(ValueError, match="tried a, b"):
        normalize.resolve_columns(named, {"x": ["a", "b"]})


def box(x0, y0, x1, y1):
    return [[(float(x0), float(y0)), (float(x1), float(y0)), (float(x1), float(y1)), (float(x0), float(y1))]]


def test_polygons(spark):
    schema = "nta_id string, rings array<array<struct<x:double,y:double>>>"
    polys = spark.createDataFrame([("A", box(0, 0, 1, 1)), ("B", box(1, 0, 2, 1)), ("C", box(2, 0, 3, 1)), ("X", box(9, 9, 10, 10))], schema)
    got = {r.nta_id: r.neighbors for r in spatial.queen_adjacency(polys).collect()}
    assert got == {"A": ["B"], "B": ["A", "C"], "C": ["B"], "X": []}
    pts = [(1, 0.5, 0.5), (2, 1.0, 0.5), (3, 2.5, 0.999), (4, 5.0, 5.0), (5, None, 1.0), (6, 9.5, 9.5)]
    found = spatial.within_join(spark.createDataFrame(pts, "id int, lon double, lat double"), polys, 0.3)
    assert sorted((r.id, r.nta_id) for r in found.collect()) == [(1, "A"), (3, "C"), (6, "X")]
    hole = spark.createDataFrame([("H", [*box(0, 0, 4, 4), *box(1, 1, 3, 3)])], schema)
    inside = spatial.within_join(spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0)], "id int, lon double, lat double"), hole, 1.0)
    assert [r.id for r in inside.collect()] == [1]


def test_upserts(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 3)], "k int, v string, w int")
    s = spark.createDataFrame([(2, "x", 9), (2, "y", 8), (3, "c", 7), (None, "m", 6)], "k int, v string, w int")
    key = lambda df: sorted(((r.k, r.v, r.w) for r in df.collect()), key=str)
    assert key(store.upsert(t, s, ["k"], order=["w"])) == sorted([(1, "a", 1), (2, "x", 9), (3, "c", 7), (None, "m", 6)], key=str)
    assert key(store.upsert(t, s, ["k"], ["v"], order=["w"])) == sorted([(1, "a", 1), (2, "x", 2), (3, "c", 7), (None, "m", 3)], key=str)
    again = store.upsert(store.upsert(t, s, ["k"]), s, ["k"])
    assert key(again) == key(store.upsert(t, s, ["k"]))
    assert len(key(store.upsert(t, s.where("k = 3"), ["k"], on_conflict="nothing"))) == 4


def test_normalisers(spark):
    cols = "inspectionid inspectiondate bbl bin boro block lot result inspection_type jobprogress latitude longitude".split()
    base = ["INS-001", "2024-03-15T00:00:00.000", "3007390001", "3012345", "3", "739", "1", "Active Rat Signs", "Initial", "2", "40.6892", "-73.9442"]
    rows = [base, [None, *base[1:]], [*base[:2], "NOT_A_BBL", *base[3:]], [*base[:2], None, *base[3:]], [*base[:4], "X", *base[5:10], None, None]]
    got = normalize.normalize_inspections(spark.createDataFrame(rows, cols)).collect()
    assert [(r.bbl, r.raw_bbl_missing, r.borough, r.lon) for r in got] == [
        ("3007390001", False, 3, -73.9442), (None, True, 3, -73.9442), (None, False, 3, -73.9442), ("3007390001", False, None, None)]
    assert got[0].inspection_date == D(2024, 3, 15)
    lots = normalize.normalize_lots(spark.createDataFrame([("1000010002", "1000010001", "3.0", "", "1", "MN01 ")], "bbl string, appbbl string, unitsres string, yearbuilt string, landuse string, nta string")).first()
    assert (lots.bbl, lots.unitsres, lots.yearbuilt, lots.landuse, lots.nta2020) == ("1000010001", 3, None, "01", "MN01")
    permits = normalize.normalize_permits({
        "dob_now": spark.createDataFrame([("B1", "2024-01-05T00", "1"), (None, "2024-01-05", "1")], "job_filing_number string, issued_date string, bbl string"),
        "legacy": spark.createDataFrame([("7", "bad date here", "A1")], "job__ string, issuance_date string, job_type string"),
    }).collect()
    assert [(r.permit_key, r.issuance_date, r.source) for r in permits] == [("dob_now_B1_2024-01-05", D(2024, 1, 5), "now"), ("legacy_7_bad date h", None, "legacy")]
    w = normalize.normalize_weather(spark.createDataFrame([("2024-01-01", 8.0, None), ("2024-01-02", None, None)], "time string, tavg double, prcp double")).collect()
    assert [(r.date, r.hdd, r.cdd) for r in w] == [(D(2024, 1, 1), 10.0, 0.0)]


def weeks(n, start=D(2021, 1, 4)):
    return [start + dt.timedelta(weeks=i) for i in range(n)]


def test_folds(spark):
    rows = [(f"MN{a:04d}", w, (a + i) % 3 == 0) for a in range(5) for i, w in enumerate(weeks(104))]
    df = spark.createDataFrame(rows, "nta_id string, week_start date, label boolean")
    train = validation.holdout_split(df).where("role = 'train'").drop("role")
    folds = validation.expanding_folds(train)
    assert folds.select("fold").distinct().count() == 5
    validation.assert_no_leak(folds)
    with pytest.raises(ValueError, match="leaks"):
        validation.assert_no_leak(folds, gap_days=60)
    with pytest.raises(ValueError, match="Not enough weeks"):
        validation.expanding_folds(df.where("week_start < DATE '2021-03-10'"))
    with pytest.raises(ValueError, match="gap_days"):
        validation.expanding_folds(train, gap_days=0)


def test_metrics(spark):
    rng = np.random.default_rng(0)
    y = (rng.random(500) < 0.3).astype(int)
    p = np.round(rng.random(500) * 0.6 + 0.4 * y * rng.random(500), 2)
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p, strict=True))], "id int, y int, p double")
    got = validation.metric_bundle(df, "y", "p", "id").first()
    order = np.argsort(-p, kind="stable")
    ap, tp, seen, last = 0.0, 0, 0, 0.0
    for v in sorted(set(p), reverse=True):
        tp, seen = tp + y[p == v].sum(), seen + (p == v).sum()
        ap, last = ap + (tp / y.sum() - last) * tp / seen, tp / y.sum()
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])
    assert abs(got.average_precision - ap) < 1e-9 and abs(got.roc_auc - auc) < 1e-9
    assert abs(got.brier - np.mean((p - y) ** 2)) < 1e-9
    assert abs(got.top_decile_lift - y[order[:50]].mean() / y.mean()) < 1e-9
    perfect = spark.createDataFrame([(i, int(i < 20), 1 - i / 200) for i in range(200)], "id int, y int, p double")
    assert validation.top_decile_lift(perfect, "y", "p", "id").first()[0] == 10.0


def test_deciles(spark):
    s = spark.createDataFrame([(x,) for x in (0.0, 0.05, 0.15, 0.55, 0.99, 1.0, None)], "s double")
    th = spark.createDataFrame([([i / 10 for i in range(1, 11)],)], "thresholds array<double>")
    assert [r.decile for r in aggregates.assign_decile(s, "s", th, "floor").collect()] == [1, 1, 1, 5, 9, 10, None]
    assert [r.decile for r in aggregates.assign_decile(s, "s", th, "ceil").collect()] == [1, 1, 2, 6, 10, 10, None]
    assert aggregates.decile_thresholds(s.limit(0), "s").first().thresholds == [i / 10 for i in range(1, 11)]
    assert aggregates.decile_thresholds(s, "s", exact=False).first().thresholds[9] == 1.0


def test_reports(spark):
    r = spark.createDataFrame([("a", 500, 10), ("z", 0, 0)], "source string, total long, unmatched long")
    got = {x.source: (x.total, x.unmatched, x.pct) for x in aggregates.merge_reports(r, r.where("source = 'a'").withColumn("unmatched", F.lit(5))).collect()}
    assert got == {"a": (1000, 15, 1.5), "z": (0, 0, 0.0)}
    assert aggregates.profile(None, "gone", spark=spark).first().rows == -1


def test_pixels(spark):
    rows = [("A", "q", 1, y, x, float(10 * y + x), 4, 5.0) for y in range(5) for x in range(4)]
    df = spark.createDataFrame(rows, "area string, quarter string, band int, y int, x int, value double, scl int, cloud double")
    crop = aggregates.centre_crop(df, 2)
    assert sorted((r.y, r.x, r.value) for r in crop.collect()) == [(0, 0, 11.0), (0, 1, 12.0), (1, 0, 21.0), (1, 1, 22.0)]
    z = aggregates.band_zscore(crop, spark.createDataFrame([(1, 11.0, 1.0)], "band int, mean double, std double"))
    assert sorted(round(r.value, 3) for r in z.collect()) == [0.0, 1.0, 10.0, 11.0]
    assert aggregates.median_composite(df, done=df.select("area", "quarter").distinct()).count() == 0


def test_expand_parents(spark):
    chunks = spark.createDataFrame([("p1", "a b c"), ("p2", "a b c d e f g h"), ("p3", "x")], "chunk_id string, content_with_prefix string")
    hits = spark.createDataFrame([(1, 1, "c1", "p1", "w w", "W1"), (1, 2, "c2", "p2", "w", "W2"), (1, 3, "c3", "p3", "w", "W3"), (2, 1, "c4", None, "w", "W4")], "query_id int, rank int, chunk_id string, parent_chunk_id string, content string, content_with_prefix string")
    got = {(r.query_id, r.rank): r.content_with_prefix for r in joins.expand_parents(hits, chunks, 9).collect()}
    assert got == {(1, 1): "a b c\n\n---\n\nW1", (1, 2): "W2", (1, 3): "x\n\n---\n\nW3", (2, 1): "W4"}


def test_fusion_and_retrieval(spark):
    ranked = lambda ids: spark.createDataFrame([(1, i + 1, c) for i, c in enumerate(ids)], "query_id int, rank int, chunk_id string")
    fused = [r.chunk_id for r in retrieval.rrf([ranked("ABC"), ranked("BCD")]).orderBy("rank").collect()]
    assert fused == ["B", "C", "A", "D"]
    assert retrieval.rrf([ranked("ABCDEFGH"), ranked("HGFEDCBA")], top_k=5).count() == 5
    texts = ["rats live in the walls", "mice live in fields", "containers for refuse", ""]
    docs = spark.createDataFrame([(str(i), t, t, None) for i, t in enumerate(texts)], "chunk_id string, content string, content_with_prefix string, parent_chunk_id string")
    q = spark.createDataFrame([(1, "rats in walls"), (2, "refuse"), (3, "")], "query_id int, text string")
    for lexical in (True, False):
        got = retrieval.retrieve(q, docs, lexical_only=lexical, top_k=1).collect()
        assert {(r.query_id, r.chunk_id) for r in got if r.query_id < 3} == {(1, "0"), (2, "2")}
    both = [r.chunk_id for r in retrieval.bm25_top_k(q.where("query_id = 1"), retrieval.lexical_index(docs), 5, "all").collect()]
    assert both == ["0"]


def test_series(spark):
    rows = [("a", w, float(i)) for i, w in enumerate(weeks(60)) if i != 7] + [("b", w, 1.0) for w in weeks(10)]
    df = spark.createDataFrame(rows, "nta_id string, week_start date, v double")
    lagged = {r.week_start: r for r in series.lags(df.where("nta_id = 'a'"), "v", (1,)).collect()}
    calendar = {r.week_start: r for r in series.lags(df.where("nta_id = 'a'"), "v", (1,), mode="calendar").collect()}
    assert lagged[weeks(9)[8]].v_lag_1w == 6.0 and calendar[weeks(9)[8]].v_lag_1w is None
    full = series.regularize(df)
    assert full.where("nta_id = 'a'").count() == 60 and full.where("v = 0 AND nta_id = 'a'").count() == 2
    assert {r.nta_id for r in series.min_length(df).select("nta_id").distinct().collect()} == {"a"}
    fc = forecast.forecast(full, "nta_id", "week_start", "v", clip=(0.0, 1e9))
    assert fc.count() == 12 and fc.where("p10 <= p50 AND p50 <= p90").count() == 12
    with pytest.raises(ValueError):
        series.lags(df, "v", mode="other")


def test_models(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"{b}{a}", w, b, float(x), float(z), int(x + 0.3 * e > 0)) for b in ("MN", "BX") for a in range(4) for w in weeks(80) for x, z, e in [rng.normal(size=3)]]
    df = spark.createDataFrame(rows, "nta_id string, week_start date, borough string, x double, z double, y int").withColumn("key", F.concat_ws("|", "nta_id", "week_start")).cache()
    split = validation.holdout_split(df)
    train, test = (split.where(F.col("role") == r).drop("role") for r in ("train", "test"))
    metrics, model, oof = models.train_and_evaluate(train, test, ["x", "z"], "y", models.fit_logistic, "key", n_folds=2)
    held = metrics.where("stage = 'test'").first()
    assert held.roc_auc > 0.9 and oof.count() > 0
    assert models.ablation_table(metrics).first().cv_mean > 0.9
    why = models.linear_attribution(test, model, ["x", "z"], 1).first()
    assert why.top_factors[0].feature == "x"
    grouped = models.group_models(train.where("borough = 'MN'"), test.withColumn("prior", F.lit(0.5)), "borough", ["x", "z"], "y", fallback="prior")
    status = {r.borough: r.status for r in grouped.select("borough", "status").distinct().collect()}
    assert status == {"MN": "ok", "BX": "skipped_no_training"}
    assert validation.roc_auc(grouped.where("borough = 'MN'"), "y", "score").first()[0] > 0.9
    store.registry_save(model, str(tmp_path), "logistic", "v1", {"auc": 1})
    again = store.registry_load(spark, str(tmp_path), "logistic")
    scored = models.materialize_scores(test, again, "v1", ["x", "z"])
    assert scored.where("risk_decile BETWEEN 1 AND 10").count() == test.count()
    with pytest.raises(KeyError):
        store.registry_load(spark, str(tmp_path), "none")
    fused, iso = models.fit_fusion(oof.drop("score"), ["x", "z"], "y", oof.drop("score"))
    assert models.apply_fusion(test, fused, iso).where("fused_score BETWEEN 0 AND 1").count() == test.count()


def test_regressions(spark):
    rows = [("m", D(2024, 1, d), 100.0) for d in range(1, 8)] + [("m", D(2024, 1, 8), 94.0), ("m", D(2024, 1, 9), 96.0)]
    got = evaluation.regressions(spark.createDataFrame(rows, "metric string, ts date, value double")).orderBy("ts").collect()
    assert [r.regressed for r in got] == [False] * 7 + [True, False]


def test_files(spark, tmp_path):
    (tmp_path / "spans.jsonl").write_text('{"trace_id":"a","span_id":"b","name":"n","start_time_ns":1000000000,"end_time_ns":3500000000,"status":"OK"}\nnot json\n')
    assert [r.duration_ms for r in store.read_spans(spark, str(tmp_path / "spans.jsonl")).collect()] == [2500.0]
    (tmp_path / "p.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"nta2020":"A","ntaname":"x"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,1],[0,1]]]}},'
        '{"type":"Feature","properties":{"nta2020":"B"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,1]]]]}}]}')  # fmt: skip
    got = {r.nta_id: (r.area, len(r.rings[0])) for r in store.read_polygons(spark, str(tmp_path / "p.geojson")).collect()}
    assert got == {"A": (2.0, 4), "B": (1.0, 4)}
    (tmp_path / "c.csv").write_text(" BBL ,Nta\n001,x\n")
    assert normalize.read_strings(spark, str(tmp_path / "c.csv")).first().asDict() == {"bbl": "001", "nta": "x"}
    df = spark.createDataFrame([("A", D(2024, 1, 1), 0.5)], "nta_id string, week_start date, score double")
    store.write_oof(df, str(tmp_path / "oof"))
    assert store.read_oof(spark, str(tmp_path / "oof")).collect() == df.select("nta_id", "week_start", "score").collect()


def _two_classes(spark, n=400):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] > 0.3).astype(float)
    rows = [(i, float(a), float(b), float(c), float(t)) for i, ((a, b, c), t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double"), x, y


def test_boosted_trees_and_importances(spark):
    df, _, y = _two_classes(spark)
    model = models.fit_gbt(df, ["a", "b", "c"], "y", rounds=10)
    got = models.positive_score(model.transform(df)).orderBy("id").toPandas()["score"].to_numpy()
    assert ((got > 0.5) == (y > 0)).mean() > 0.98
    top = models.tree_importances(df, model, 2).collect()
    assert [r.feature for r in top][0] == "a" and top[0].importance > 0.8 and len(top) == 2


def test_shallow_network_separates(spark):
    df, _, y = _two_classes(spark)
    model = models.fit_mlp(df, ["a", "b", "c"], "y", hidden=(8, 4))
    got = models.positive_score(model.transform(df)).orderBy("id").toPandas()["score"].to_numpy()
    assert ((got > 0.5) == (y > 0)).mean() > 0.97


def test_logistic_equals_newton(spark):
    """Ridge logistic regression on standardised features, by Newton's method; attributions add up to the logit."""
    df, x, y = _two_classes(spark)
    rng = np.random.default_rng(5)
    y = (rng.random(len(y)) < 1 / (1 + np.exp(-x[:, 0] - 0.5 * x[:, 1]))).astype(float)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id int, a double, b double, c double, y double")
    model = models.fit_logistic(df, ["a", "b", "c"], "y")
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    a, w = np.column_stack([np.ones(len(z)), z]), np.zeros(4)
    ridge = np.diag([0.0, 1.0, 1.0, 1.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-a @ w))
        w += np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + ridge, a.T @ (y - q) - ridge @ w)
    got = models.positive_score(model.transform(df)).orderBy("id").toPandas()["score"].to_numpy()
    assert np.abs(got - 1 / (1 + np.exp(-a @ w))).max() < 1e-4
    told = models.linear_attribution(df, model, ["a", "b", "c"], 2).orderBy("id").collect()
    sums = np.array([sum(c.contribution for c in r.contributions) for r in told])
    assert np.abs(sums + model.stages[-1].intercept - np.log(got / (1 - got))).max() < 1e-6
    assert all(abs(r.top_factors[0]["contribution"]) >= abs(r.top_factors[1]["contribution"]) for r in told)


def test_principal_components_equal_svd(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 5)) @ np.diag([5, 3, 2, 1, 0.5]) + 7
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "nta_id int, v array<double>")
    out, shares = models.pca_embeddings(df, "v", 3)
    got = np.array([r.pca for r in out.orderBy("nta_id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.abs(np.abs(got) - np.abs(u[:, :3] * s[:3])).max() < 1e-6
    assert shares == pytest.approx((s**2 / (s**2).sum())[:3].tolist())


def test_callers_own_forecaster(spark):
    import pandas as pd

    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, 5.0)], "nta_id string, t int, v double")

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"nta_id": [pdf["nta_id"].iloc[0]], "p50": [pdf.sort_values("t")["v"].iloc[-1]]})

    assert sorted(map(tuple, forecast.forecast_with(df, "nta_id", last, "nta_id string, p50 double").collect())) == [("a", 4.0), ("b", 5.0)]


def test_recursive_split_keeps_all_words_within_size(spark):
    rng = random.Random(9)
    texts = ["\n\n".join(" ".join("w" * rng.randint(1, 30) for _ in range(rng.randint(1, 120))) + "." for _ in range(rng.randint(1, 12))) for _ in range(12)] + ["".join(rng.choice("abcdefgh") for _ in range(5000)), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for i, text in enumerate(texts):
        parts = [r.content for r in corpus.split_recursive(df.where(f"doc_id = {i}"), 400, 80).orderBy("part").collect()]
        assert all(0 < len(p) <= 400 for p in parts) and bool(parts) == bool(text)
        at = 0
        for p in parts:  # each piece stands in the text, none begins beyond the end of what is covered
            begin = (text or "").find(p, max(0, at - 480))
            assert 0 <= begin and not (text[at:begin].strip() if begin > at else "")
            at = max(at, begin + len(p))
        assert not (text or "")[at:].strip()
