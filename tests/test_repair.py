import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmend.config import TID, Config
from cellmend.operators import detect, domain as dom, evaluate, features, model, repair, stats
from cellmend.plans.constraints import parse
from cellmend.session import Dataset, RepairSession
from cellmend.streaming.monitor import suspicious


@pytest.fixture(scope="module")
def small(spark):
    """Zip and City of six tuples, one city missing."""
    rows = [(0, "10", "a"), (1, "10", "a"), (2, "10", "b"), (3, "20", "c"), (4, "20", "c"), (5, "20", "_nan_")]
    d = Dataset(spark.createDataFrame(rows, "_tid_ long, Zip string, City string"), Config.of(cor_strength=0.1, nb_cor_strength=0.1, domain_thresh_1=0.0, feature_norm=False))
    d.constraints = [parse("t1&t2&EQ(t1.Zip,t2.Zip)&IQ(t1.City,t2.City)", d.attributes)]
    return d


def _found(d):
    pruned = stats.pruned_pairs(d.pairs, d.single, 0.0)
    found = dom.cell_candidates(d.raw, d.attributes, ["City", "Zip"], pruned, stats.correlated(d.corr, 0.1))
    return found.withColumn("_cid_", d.cell_id(F.col(TID), F.col("attribute")))


def _by_cell(df, *cols):
    return {(r[TID], r["attribute"]): tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_detection(small):
    cells = detect.detect_errors(small, [detect.NullDetector(), detect.ViolationDetector()])
    assert {(r[TID], r["attribute"], r["_cid_"]) for r in cells.collect()} == {(t, a, 2 * t + i) for t in range(6) for i, a in enumerate(["Zip", "City"])}


def test_statistics(small):
    assert {(r["attribute"], r["value"]): r["n"] for r in stats.frequencies(small.single).collect()} == {("Zip", "10"): 3, ("Zip", "20"): 3, ("City", "a"): 2, ("City", "b"): 1, ("City", "c"): 2}
    pairs = {(r["v1"], r["v2"]): r["n"] for r in stats.co_occurrences(small.pairs).where("a1 = 'Zip'").collect()}
    assert pairs == {("10", "a"): 2, ("10", "b"): 1, ("20", "c"): 2}
    corr = {(r["x"], r["y"]): r["corr"] for r in small.corr.collect()}
    assert corr["Zip", "City"] == pytest.approx(1.0) and corr["City", "Zip"] == pytest.approx(0.540852, abs=1e-6) and corr["Zip", "Zip"] == 1.0


def test_domains_and_posterior(small):
    found = _found(small)
    domains = _by_cell(found, "domain")
    assert domains[0, "City"] == ["a", "b"] and domains[3, "City"] == ["c"] and domains[5, "City"] == ["c"] and domains[0, "Zip"] == ["10"]
    filled = dom.initial_domain(dom.fill_domains(found, small.single, 45, 5))
    full = _by_cell(filled, "domain", "fixed", "init_index")
    assert full[0, "Zip"] == (["10", "20"], dom.SINGLE_VALUE, 0)
    assert full[3, "City"] == (["c", "a", "b"], dom.SINGLE_VALUE, 0)
    assert full[5, "City"] == (["c", "a", "b"], dom.SINGLE_VALUE, -1)
    assert full[2, "City"] == (["a", "b"], dom.NOT_SET, 1)
    bayes = dom.NaiveBayes(small.raw, small.attributes, small.single, small.pairs, stats.correlated(small.corr, 0.1), 6)
    p = {(r["_vid_"], r["val_idx"]): r["p"] for r in bayes.predict(filled).collect()}
    assert p[1, 0] == pytest.approx(10 / 11) and p[1, 1] == pytest.approx(1 / 11)
    low = _by_cell(dom.reprune(filled, bayes.predict(filled), 0.0, 10, 0.9), "weak_label", "fixed", "weak_label_idx")
    assert low[2, "City"] == ("a", dom.WEAK_LABEL, 0) and low[0, "City"] == ("a", dom.NOT_SET, 0)
    high = _by_cell(dom.reprune(filled, bayes.predict(filled), 0.0, 10, 0.95), "weak_label", "fixed", "domain")
    assert high[2, "City"] == ("b", dom.NOT_SET, ["a", "b"])
    # all candidates below the threshold: all stay; a cap of one keeps the best and the initial one
    assert _by_cell(dom.reprune(filled, bayes.predict(filled), 2.0, 10, 0.95), "domain")[2, "City"] == ["a", "b"]
    assert _by_cell(dom.reprune(filled, bayes.predict(filled), 0.0, 1, 0.95), "domain")[0, "City"] == ["a"]


@pytest.mark.parametrize("limit", [200_000, 10])
def test_random_candidates_come_from_all_values(spark, monkeypatch, limit):
    monkeypatch.setattr(dom, "BROADCAST_VALUES", limit)
    names = [f"v{i}" for i in range(300)] + ["only"]
    single = spark.createDataFrame([("a", v, 2) for v in names[:-1]] + [("a", "_nan_", 9), ("b", "only", 1)], "attribute string, value string, n long")
    found = spark.createDataFrame([(i, "a", 2 * i, names[i % 300], [names[i % 300]]) for i in range(600)] + [(0, "b", 1, "only", ["only"]), (700, "a", 1400, "_nan_", [])], "_tid_ long, attribute string, _cid_ long, init_value string, domain array<string>")
    rows = {r["_cid_"]: r for r in dom.fill_domains(found, single, 45, 5).collect()}
    assert sorted(rows) == [2 * i for i in range(600)]
    seen = set()
    for c, r in rows.items():
        own, *sample = r["domain"]
        assert own == names[c // 2 % 300] and len(sample) == 5 and sample == sorted(set(sample) - {own}) and r["fixed"] == dom.SINGLE_VALUE
        seen |= set(sample)
    assert len(seen) > 290 and seen <= set(names[:-1])
    assert len({tuple(r["domain"][1:]) for r in rows.values()}) > 590


def test_feature_values(small):
    domain = dom.initial_domain(_found(small).where("size(domain) > 0").withColumn("fixed", F.lit(0)))

    def rows(f):
        f.setup(small)
        return {(r["_vid_"], r["val_idx"], r["feat"]): r["x"] for r in f.rows(domain, 2).collect()}

    freq = rows(features.FreqFeaturizer())
    assert freq[1, 0, 1] == pytest.approx(1 / 3) and freq[1, 1, 1] == pytest.approx(1 / 6) and freq[0, 0, 0] == 0.5
    occur = rows(features.OccurAttrFeaturizer())
    assert occur[1, 0, 2] == pytest.approx(2 / 3) and occur[1, 1, 2] == pytest.approx(1 / 3) and (10, 0, 1) not in occur
    init = rows(features.InitAttrFeaturizer())
    assert init[5, 1, 1] == 1 and init[5, 0, 1] == -1 and init[11, 0, 1] == -1
    sim = rows(features.InitSimFeaturizer())
    assert sim[1, 0, 1] == -1.0 and sim[1, 1, 1] == -1.0
    counts = {(r["_vid_"], r["val_idx"], r["feat"]): r["x"] for r in features.violation_counts(domain, small.raw, small.constraints).collect()}
    assert counts[1, 0, 1] == 1 and counts[1, 1, 1] == 1 and counts[7, 0, 1] == 1 and counts[5, 1, 1] == 2 and (5, 0, 1) not in counts
    assert counts[0, 0, 0] == 1 and counts[4, 0, 0] == 2 and counts[10, 0, 0] == 2
    lang = rows(features.LangModelFeaturizer())
    assert sum(x * x for (v, i, f), x in lang.items() if (v, i) == (1, 0)) == pytest.approx(1.0)


def test_violation_counts_equal_pairs(spark):
    rnd = random.Random(3)
    rows = [(i, *(rnd.choice(["0", "1", "_nan_"]) for _ in range(3))) for i in range(30)]
    d = Dataset(spark.createDataFrame(rows, "_tid_ long, a string, b string, c string"), Config.of())
    values = spark.createDataFrame([(t, x, t * 3 + i, t * 3 + i, ["0", "1", "2"], rows[t][i + 1]) for t in range(30) for i, x in enumerate("abc")], "_tid_ long, attribute string, _cid_ long, _vid_ long, domain array<string>, init_value string")
    for text in ("t1&t2&EQ(t1.a,t2.a)&EQ(t1.b,t2.b)&IQ(t1.c,t2.c)", "t1&t2&EQ(t1.a,t2.a)&IQ(t1.c,t2.c)"):
        for r in features.relaxations([parse(text, d.attributes)]):
            cands = dom.candidates(values).where(F.col("attribute") == r.predicate.left.name).select("_vid_", TID, "val_idx", "rv_val")
            own = d.raw.select(TID, *(F.col(c).alias(f"_1_{c}") for c in d.attributes))
            fast = features.by_counts(r)(cands.join(own, TID), d.raw)
            slow = features.pairwise(cands.join(own, TID), d.raw, r, 1 << 40)
            assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect())) != []


def test_order_constraints_count_at_every_size(spark, monkeypatch):
    """By default no number of pairs turns counts into 0 or 1 (the large plan is made, not run)."""
    dc = parse("t1&t2&LT(t1.a,t2.a)&GT(t1.b,t2.b)", ["a", "b"])
    r = next(r for r in features.relaxations([dc]) if r.predicate.left.name == "a")

    def counted(n):
        raw = spark.range(n).select(F.col("id").alias(TID), (F.col("id") % 5).cast("string").alias("a"), (F.col("id") % 3).cast("string").alias("b"))
        rows = raw.select(F.col(TID).alias("_vid_"), TID, F.lit(0).alias("val_idx"), F.lit("2").alias("rv_val"), F.col("a").alias("_1_a"), F.col("b").alias("_1_b"))
        return features.pairwise(rows, raw, r, Config.of().max_pairs)

    mine, theirs = ("<", ">") if r.role == "t1" else (">", "<")
    less = {"<": lambda x, y: x < y, ">": lambda x, y: x > y}
    want = {i: sum(less[mine](2, j % 5) and less[theirs](i % 3, j % 3) for j in range(30) if j != i) for i in range(30)}
    assert {x["_vid_"]: x["x"] for x in counted(30).collect()} == {i: c for i, c in want.items() if c}
    monkeypatch.setattr(features, "exists", lambda *a: pytest.fail("0 or 1 in place of counts"))
    assert counted(50_000).columns == ["_vid_", "val_idx", "x"]


def test_relaxed_order_predicate_has_two_roles(small):
    dc = parse("t1&t2&EQ(t1.Zip,t2.Zip)&LT(t1.City,t2.City)", small.attributes)
    names = [r.describe() for r in features.relaxations([dc])]
    assert len(names) == 3 == len(set(names))


def test_gradient_equals_differences():
    cells = model._Cells(np.array([0, 1, 1, 3, 4]), np.array([0, 0, 1, 1, 2]), np.array([1.0, 2.0, -1.0, 0.5, 3.0]), np.array([0, 2]), np.array([2, 3]), np.array([1, 2]))
    w = np.array([0.3, -0.2, 0.1])
    g, loss, _ = cells.gradient(w)
    for i in range(3):
        e = np.zeros(3)
        e[i] = 1e-6
        assert g[i] == pytest.approx((cells.gradient(w + e)[1] - cells.gradient(w - e)[1]) / 2e-6, abs=1e-6)
    assert loss == pytest.approx(sum(-math.log(p) for p in (math.exp(0.8) / (math.exp(0.3) + math.exp(0.8)), math.exp(0.3) / (1 + math.exp(-0.1) + math.exp(0.3)))), abs=1e-9)
    assert cells.take(1, 2).gradient(w)[1] + cells.take(0, 1).gradient(w)[1] == pytest.approx(loss)


@pytest.fixture(scope="module")
def planted(spark):
    """City determines state; one state of twenty is wrong, one missing."""
    rows = [(i, f"city{i % 5}", f"state{i % 5}" if i not in (3, 12) else "wrong", None if i == 7 else f"x{i % 3}") for i in range(60)]
    return spark.createDataFrame(rows, "_tid_ long, city string, state string, other string")


@pytest.mark.parametrize("settings", [{}, {"trainer": "distributed", "epochs": 8}, {"estimator": "logistic"}, {"optimizer": "sgd", "momentum": 0.5, "weight_norm": True}])
def test_session_repairs_planted_errors(spark, planted, settings):
    s = RepairSession(spark, **({"cor_strength": 0.3, "nb_cor_strength": 0.3, "domain_thresh_1": 0.0, "weak_label_thresh": 0.9, "epochs": 10, "learning_rate": 0.05, "print_fw": True} | settings))
    s.load_data("planted", df=planted)
    s.load_dcs(lines=["t1&t2&EQ(t1.city,t2.city)&IQ(t1.state,t2.state)"])
    s.detect_errors([detect.NullDetector(), detect.ViolationDetector()])
    s.setup_domain()
    report = s.repair_errors([features.FreqFeaturizer(), features.OccurAttrFeaturizer(), features.ConstraintFeaturizer(), features.InitAttrFeaturizer(0.1)])
    assert [r["featurizer"] for r in report] == ["FreqFeaturizer", "OccurAttrFeaturizer", "ConstraintFeaturizer", "InitAttrFeaturizer"]
    states = {r[TID]: r["state"] for r in s.repaired.collect()}
    assert len(states) == 60 and states[3] == "state3" and states[12] == "state2"
    clean = spark.createDataFrame([(i, "state", f"state{i % 5}") for i in range(60)], "t long, a string, v string")
    result = s.evaluate(clean, "t", "a", "v")
    assert (result.total_errors, result.detected_errors, result.correct_repairs) == (2, 2, 2)
    assert result.total_errors >= result.detected_errors >= result.correct_repairs
    assert result.recall == 1.0 and 0 < result.precision <= 1.0
    probs = [sum(r["distribution"]) for r in s.cell_distr.collect()]
    assert all(abs(p - 1) < 1e-9 for p in probs)
    s.close()


@pytest.mark.parametrize("trainer", ["auto", "exact"])
def test_training_does_not_depend_on_max_exact(spark, trainer):
    """Ranges of cells give the same steps as all at once, whole batches across ranges included."""
    rnd = random.Random(2)
    cells = [(i * 3, ["a", "b", "c"][: rnd.randint(2, 3)], rnd.randint(0, 1)) for i in range(101)]
    domain = spark.createDataFrame([(v, len(d)) for v, d, _ in cells], "_vid_ long, domain_size int")
    labels = spark.createDataFrame([(v, y) for v, _, y in cells], "_vid_ long, label int")
    rows = spark.createDataFrame([(v, i, f, rnd.random()) for v, d, _ in cells for i in range(len(d)) for f in range(4) if v % 5], "_vid_ long, val_idx int, feat int, x double")
    infos = [features.FeatInfo("f", 4, True, 1.0, list("pqrs"))]
    fits = [model.fit(rows, domain, labels, infos, Config.of(trainer=trainer, epochs=3, batch_size=8, learning_rate=0.05, max_exact=m)) for m in (1_000_000, 300)]
    for other in fits[1:]:
        assert other.w.tolist() == fits[0].w.tolist()
        assert other.history == fits[0].history


def test_nothing_to_repair_is_refused(spark):
    s = RepairSession(spark)
    with pytest.raises(RuntimeError):
        s.detect_errors([detect.NullDetector()])
    s.load_data("clean", df=spark.createDataFrame([(0, "a", "b"), (1, "a", "b")], "_tid_ long, x string, y string"))
    with pytest.raises(ValueError, match="no cell is suspected"):
        s.detect_errors([detect.NullDetector()])
    t = RepairSession(spark)  # one value for each attribute: nothing to choose from
    t.load_data("bare", df=spark.createDataFrame([(0, "a", "b"), (1, "a", None)], "_tid_ long, x string, y string"))
    t.detect_errors([detect.NullDetector()])
    with pytest.raises(ValueError, match="no cell has a candidate"):
        t.setup_domain()


def test_unary_constraint_features(spark):
    d = Dataset(spark.createDataFrame([(0, "m", "wife"), (1, "f", "wife"), (2, "m", "son")], "_tid_ long, sex string, kin string"), Config.of())
    d.constraints = [parse('t1&EQ(t1.sex,"m")&EQ(t1.kin,"wife")', d.attributes)]
    domain = spark.createDataFrame([(t, a, t * 2 + i, v) for t in range(3) for i, (a, v) in enumerate([("sex", ["f", "m"]), ("kin", ["son", "wife"])])], "_tid_ long, attribute string, _vid_ long, domain array<string>")
    got = {(r["_vid_"], r["val_idx"], r["feat"]) for r in features.violation_counts(domain, d.raw, d.constraints).collect()}
    assert got == {(0, 1, 0), (2, 1, 0), (1, 1, 1), (5, 1, 1)}


def test_repaired_keeps_rows_and_shows_real_nulls(spark):
    raw = spark.createDataFrame([(0, "a", "_nan_"), (1, "b", "y")], "_tid_ long, p string, q string")
    cells = spark.createDataFrame([(1, "p", "c")], "_tid_ long, attribute string, rv_value string")
    assert sorted(map(tuple, repair.repaired(raw, cells, ["p", "q"]).collect())) == [(0, "a", None), (1, "c", "y")]
    assert sorted(map(tuple, repair.repaired(raw, cells, ["p", "q"], nulls=False).collect()))[0] == (0, "a", "_nan_")


def test_metrics_without_a_base_are_zero(spark):
    row = spark.createDataFrame([(0, 0, 0, 0, 0, 0)], "detected_errors long, total_errors long, correct_repairs long, total_repairs long, total_repairs_grdt_correct long, total_repairs_grdt_incorrect long")
    out = evaluate.metrics(row).first()
    assert (out["precision"], out["recall"], out["repair_recall"], out["f1"], out["repair_f1"]) == (0, 0, 0, 0, 0)


def test_stream_monitor(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(0, "x", "_nan_"), (1, "y", "z")], "_tid_ long, a string, b string").write.parquet(path)
    dc = [parse("t1&EQ(t1.a,'y')", ["a", "b"])]
    stream = suspicious(spark.readStream.schema("_tid_ long, a string, b string").parquet(path), ["a", "b"], dc)
    q = stream.writeStream.format("memory").queryName("suspects").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.sql("SELECT * FROM suspects").collect()} == {(0, "b"), (1, "a")}
    with pytest.raises(ValueError):
        suspicious(spark.range(0), [], [parse("t1&t2&EQ(t1.a,t2.a)", ["a"])])
