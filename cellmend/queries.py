"""Queries over the star-schema tables, one for each operator or a few, and their SQL forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import NULL, TID, Config
from .operators import detect, evaluate, features, model, repair, stats
from .operators import domain as dom
from .plans.constraints import parse
from .plans.violations import semi_join, split, violating
from .session import Dataset, RepairSession
from .sources import tables

#: Settings of the queries below: correlations, pruning, weak labels.
CORR, PRUNE, WEAK = 0.4, 0.05, 0.8
_FIXED_WEIGHTS = (0.7, 0.3, 1.5)


# ---- inputs -------------------------------------------------------------------------------------


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dataset(df: DataFrame, na_values=None) -> Dataset:
    """``df`` (its first column the tuple id) as the engine's table."""
    key, *rest = df.columns
    ids = df.select(F.col(key).cast("long").alias(TID), *(F.col(c).cast("string").alias(c) for c in rest))
    return Dataset(tables.fill(tables.prepare(ids, na_values, drop_empty=False)).withColumn(TID, F.col(TID).cast("long")), Config.of(cor_strength=CORR, nb_cor_strength=CORR, domain_thresh_1=PRUNE, weak_label_thresh=WEAK, feature_norm=False))


def _part(spark, sf_dir) -> Dataset:
    return _dataset(_read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), ["PROMO"])


def _orders(spark, sf_dir) -> Dataset:
    return _dataset(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


def _customer(spark, sf_dir) -> Dataset:
    return _dataset(_read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), ["HOUSEHOLD"])


def _geo_frame(spark, sf_dir, corrupt: bool = True) -> DataFrame:
    """Customers with nation and region; some regions of customers are made wrong."""
    c, n, r = (_read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    # nation and region are tables of a fixed size
    rows = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    wrong = (F.col("c_custkey") % 97 == 0) & (F.col("c_nationkey") < 8)
    region = F.when(wrong, "CORRUPT").otherwise(F.col("r_name")) if corrupt else F.col("r_name")
    return rows.select("c_custkey", F.col("c_nationkey").alias("nation_key"), "n_name", region.alias("r_name"), F.col("c_mktsegment").alias("segment"))


_GEO_DC = "t1&t2&EQ(t1.nation_key,t2.nation_key)&IQ(t1.r_name,t2.r_name)"
_GEO_DC2 = "t1&t2&EQ(t1.n_name,t2.n_name)&EQ(t1.segment,t2.segment)&IQ(t1.r_name,t2.r_name)"


def _geo(spark, sf_dir) -> Dataset:
    d = _dataset(_geo_frame(spark, sf_dir), ["HOUSEHOLD"])
    d.constraints = [parse(_GEO_DC, d.attributes)]
    return d


def _truth(spark, sf_dir) -> DataFrame:
    clean = _geo_frame(spark, sf_dir, corrupt=False)
    attributes = clean.columns[1:]
    long = clean.select("c_custkey", *(F.col(a).cast("string").alias(a) for a in attributes)).unpivot("c_custkey", attributes, "attribute", "correct_val")
    return tables.ground_truth(long, "c_custkey", "attribute", "correct_val")


# ---- Spark queries ------------------------------------------------------------------------------


def _cells_out(df: DataFrame) -> DataFrame:
    return df.select(F.col(TID).alias("tid"), "attribute")


def null_cells(spark, sf_dir):
    d = _customer(spark, sf_dir)
    detector = detect.NullDetector()
    detector.setup(d)
    return _cells_out(detector.detect())


def _violations(d: Dataset, text: str) -> DataFrame:
    return violating(d.raw, parse(text, d.attributes)).select(F.col(TID).alias("tid"))


def dc_unary(spark, sf_dir):
    return _violations(_orders(spark, sf_dir), 't1&EQ(t1.o_orderstatus,"f")&EQ(t1.o_orderpriority,"1-urgent")')


def dc_eq_iq(spark, sf_dir):
    return _violations(_part(spark, sf_dir), "t1&t2&EQ(t1.p_name,t2.p_name)&EQ(t1.p_size,t2.p_size)&IQ(t1.p_brand,t2.p_brand)")


def dc_eq_lt(spark, sf_dir):
    return _violations(_customer(spark, sf_dir), "t1&t2&EQ(t1.c_nationkey,t2.c_nationkey)&LT(t1.c_mktsegment,t2.c_mktsegment)")


def dc_gt(spark, sf_dir):
    return _violations(_customer(spark, sf_dir), "t1&t2&EQ(t1.c_nationkey,t2.c_nationkey)&GT(t1.c_mktsegment,t2.c_mktsegment)")


def dc_gte(spark, sf_dir):
    """Equal values count, so a tuple's own pair is left out: a semi-join."""
    return _violations(_part(spark, sf_dir), "t1&t2&EQ(t1.p_name,t2.p_name)&EQ(t1.p_brand,t2.p_brand)&GTE(t1.p_size,t2.p_size)")


def dc_const_binary(spark, sf_dir):
    return _violations(_part(spark, sf_dir), 't1&t2&EQ(t1.p_type,"economy")&EQ(t1.p_name,t2.p_name)&EQ(t1.p_size,t2.p_size)&IQ(t1.p_brand,t2.p_brand)')


def dc_semi_join(spark, sf_dir):
    d = _part(spark, sf_dir)
    dc = parse("t1&t2&EQ(t1.p_name,t2.p_name)&EQ(t1.p_brand,t2.p_brand)&LTE(t1.p_size,t2.p_size)", d.attributes)
    return semi_join(d.raw, d.raw, split(dc)[2], False).select(F.col(TID).alias("tid"))


def detected_cells(spark, sf_dir):
    d = _geo(spark, sf_dir)
    return detect.detect_errors(d, [detect.NullDetector(), detect.ViolationDetector()]).select(F.col(TID).alias("tid"), "attribute", F.col("_cid_").alias("cid"))


def active_attributes(spark, sf_dir):
    d = _geo(spark, sf_dir)
    names = dom.active_attributes(detect.detect_errors(d, [detect.NullDetector(), detect.ViolationDetector()]))
    return spark.createDataFrame([(a,) for a in names], "attribute string")


def errors_loader(spark, sf_dir):
    errors = _read(spark, sf_dir, "customer").where("c_custkey % 97 = 0 AND c_nationkey < 8").select(F.col("c_custkey").alias("id"), F.lit("r_name").alias("attr"))
    d = _geo(spark, sf_dir)
    return detect.detect_errors(d, [detect.ErrorsLoaderDetector(errors, "id", "attr")]).select(F.col(TID).alias("tid"), "attribute", F.col("_cid_").alias("cid"))


def stats_single(spark, sf_dir):
    return stats.frequencies(_orders(spark, sf_dir).single)


def stats_pair(spark, sf_dir):
    return stats.co_occurrences(_part(spark, sf_dir).pairs)


def attr_correlation(spark, sf_dir):
    return _geo(spark, sf_dir).corr.select("x", "y", F.round("corr", 6).alias("corr"))


def correlated_attrs(spark, sf_dir):
    return stats.correlated(_geo(spark, sf_dir).corr, CORR)


def pruned_pairs(spark, sf_dir):
    d = _part(spark, sf_dir)
    return stats.pruned_pairs(d.pairs, d.single, PRUNE).select("a1", "v1", "a2", "v2", "n", "freq")


def _found(d: Dataset) -> DataFrame:
    pruned = stats.pruned_pairs(d.pairs, d.single, PRUNE)
    found = dom.cell_candidates(d.raw, d.attributes, dom.active_attributes(_dk(d)), pruned, stats.correlated(d.corr, CORR)).where(F.size("domain") > 0)
    return found.withColumn("_cid_", d.cell_id(F.col(TID), F.col("attribute")))


def _domain(d: Dataset) -> DataFrame:
    return d.keep("domain", lambda: dom.initial_domain(_found(d).withColumn("fixed", F.lit(dom.NOT_SET))))


def cell_domain(spark, sf_dir):
    rows = _domain(_geo(spark, sf_dir))
    return rows.select(F.col(TID).alias("tid"), "attribute", F.array_join("domain", "|").alias("domain"), "domain_size", "init_value", "init_index")


def pos_values(spark, sf_dir):
    return dom.pos_values(_domain(_geo(spark, sf_dir))).select(F.col("_cid_").alias("cid"), F.col(TID).alias("tid"), "attribute", "rv_val", "val_id")


def domain_info(spark, sf_dir):
    return dom.domain_info(_domain(_geo(spark, sf_dir)))


def filled_domain(spark, sf_dir):
    d = _geo(spark, sf_dir)
    rows = dom.initial_domain(dom.fill_domains(_found(d), d.single, 45, 5))
    return rows.select(F.col(TID).alias("tid"), "attribute", "domain", "domain_size", "init_value", "init_index", "fixed")


def _posterior(d: Dataset) -> DataFrame:
    return d.keep("posterior", lambda: dom.NaiveBayes(d.raw, d.attributes, d.single, d.pairs, stats.correlated(d.corr, CORR), d.n_rows).predict(_domain(d)))


def nb_posterior(spark, sf_dir):
    d = _geo(spark, sf_dir)
    rows = dom.candidates(_domain(d)).join(_posterior(d), ["_vid_", "val_idx"])
    return rows.select(F.col("_vid_").alias("cid"), "rv_val", F.round("p", 6).alias("p"))


def _inferred(d: Dataset) -> DataFrame:
    return repair.inferred_values(_posterior(d).withColumnRenamed("p", "prob"), _domain(d))


def nb_argmax(spark, sf_dir):
    return _inferred(_geo(spark, sf_dir)).select(F.col("_vid_").alias("cid"), "inferred_val_idx", "inferred_val", F.round("prob", 6).alias("prob"))


def _dk(d: Dataset) -> DataFrame:
    return d.keep("dk", lambda: detect.detect_errors(d, [detect.NullDetector(), detect.ViolationDetector()]))


def _labelled(d: Dataset) -> DataFrame:
    return d.keep("labelled", lambda: dom.reprune(_domain(d), _posterior(d), 0.01, 10, WEAK))


def weak_labels(spark, sf_dir):
    d = _geo(spark, sf_dir)
    rows = _labelled(d).join(features.weak_labels(_labelled(d), _dk(d)), "_vid_")
    return rows.select(F.col("_vid_").alias("cid"), F.array_join("domain", "|").alias("domain"), "weak_label", "fixed", "label", "is_clean")


def repruned_single(spark, sf_dir):
    """Cells of one candidate are marked as such, and pass the second pruning as they are."""
    d = _geo(spark, sf_dir)
    marked = dom.initial_domain(_found(d).withColumn("fixed", F.when(F.size("domain") == 1, dom.SINGLE_VALUE).otherwise(dom.NOT_SET)))
    rows = dom.reprune(marked, _posterior(d), 0.01, 10, WEAK)
    return rows.select(F.col("_vid_").alias("cid"), F.array_join("domain", "|").alias("domain"), "weak_label", "weak_label_idx", "fixed")


def _features(d: Dataset, featurizer: features.Featurizer, classes: int = 10) -> DataFrame:
    featurizer.setup(d)
    return featurizer.rows(_domain(d), classes)


def _feature_rows(d: Dataset, rows: DataFrame) -> DataFrame:
    return rows.select(F.col("_vid_").alias("cid"), "val_idx", "feat", F.round(F.col("x").cast("double"), 6).alias("x"))


def feat_initattr(spark, sf_dir):
    d = _geo(spark, sf_dir)
    return _feature_rows(d, _features(d, features.InitAttrFeaturizer()))


def feat_freq(spark, sf_dir):
    d = _geo(spark, sf_dir)
    return _feature_rows(d, _features(d, features.FreqFeaturizer()))


def feat_occur(spark, sf_dir):
    d = _geo(spark, sf_dir)
    return _feature_rows(d, _features(d, features.OccurAttrFeaturizer()))


def feat_norm(spark, sf_dir):
    d = _geo(spark, sf_dir)
    return _feature_rows(d, features.unit_length(_features(d, features.FreqFeaturizer())))


def feat_constraint(spark, sf_dir):
    d = _geo(spark, sf_dir)
    domain = _domain(d)  # of what the first constraint suspects
    d.constraints.append(parse(_GEO_DC2, d.attributes))
    return _feature_rows(d, features.violation_counts(domain, d.raw, d.constraints))


def feat_constraint_norm(spark, sf_dir):
    d = _geo(spark, sf_dir)
    return _feature_rows(d, _features(d, features.ConstraintFeaturizer()))


def feat_constraint_pairs(spark, sf_dir):
    """An order predicate: pairs are counted by a join on the nation."""
    d = _geo(spark, sf_dir)
    domain = _domain(d)
    d.constraints = [parse("t1&t2&EQ(t1.nation_key,t2.nation_key)&LT(t1.r_name,t2.r_name)", d.attributes)]
    return _feature_rows(d, features.violation_counts(domain, d.raw, d.constraints))


def feat_constraint_exists(spark, sf_dir):
    d = _geo(spark, sf_dir)
    relaxed = features.relaxations(d.constraints)[1]  # the inequality
    own = d.raw.select(TID, F.col("nation_key").alias("_1_nation_key"))
    rows = dom.candidates(_domain(d)).where("attribute = 'r_name'").select("_vid_", TID, "val_idx", "rv_val").join(own, TID)
    theirs = d.raw.select(*(F.col(c).alias(f"_2_{c}") for c in d.raw.columns))
    on = (F.col("_1_nation_key") == F.col("_2_nation_key")) & (F.col("rv_val") != F.col(f"_2_{relaxed.predicate.right.name}")) & (F.col(TID) != F.col(f"_2_{TID}"))
    return features.exists(rows, theirs, on).select(F.col("_vid_").alias("cid"), "val_idx", F.col("x").cast("long").alias("x"))


def feat_unary(spark, sf_dir):
    """A constraint on one tuple: a candidate violates it or not."""
    d = _geo(spark, sf_dir)
    domain = _domain(d)
    d.constraints = [parse('t1&EQ(t1.segment,"building")&EQ(t1.r_name,"corrupt")', d.attributes)]
    return _feature_rows(d, features.violation_counts(domain, d.raw, d.constraints))


def assembled_features(spark, sf_dir):
    """Four featurizers' rows, numbered one after the other."""
    d = _geo(spark, sf_dir)
    rows, _ = features.assemble(d, _domain(d), [features.InitAttrFeaturizer(), features.FreqFeaturizer(), features.OccurAttrFeaturizer(), features.ConstraintFeaturizer()])
    return _feature_rows(d, rows)


def _fixed_scores(d: Dataset) -> tuple[DataFrame, list[float]]:
    a = len(d.attributes)
    parts = [(_features(d, features.InitAttrFeaturizer()), 0), (_features(d, features.FreqFeaturizer()), a), (_features(d, features.ConstraintFeaturizer()), 2 * a)]
    rows = None
    for df, at in parts:
        df = df.select("_vid_", "val_idx", (F.col("feat") + at).alias("feat"), F.col("x").cast("double").alias("x"))
        rows = df if rows is None else rows.unionByName(df)
    n = len(features.relaxations(d.constraints))
    return rows, [_FIXED_WEIGHTS[0]] * a + [_FIXED_WEIGHTS[1]] * a + [-_FIXED_WEIGHTS[2]] * n


def cond_logit_scores(spark, sf_dir):
    d = _geo(spark, sf_dir)
    rows, w = _fixed_scores(d)
    return model.predict(rows, _domain(d), w).select(F.col("_vid_").alias("cid"), "val_idx", F.round("prob", 6).alias("prob"))


def _repairs(d: Dataset) -> DataFrame:
    """Likeliest values by naive Bayes of the suspected cells."""
    suspected = _domain(d).join(_dk(d).select("_cid_"), "_cid_", "left_semi")
    return d.keep("repairs", lambda: repair.inferred_cells(suspected, _inferred(d)))


def total_errors(spark, sf_dir):
    d = _geo(spark, sf_dir)
    return evaluate.total_errors(d.raw, d.attributes, _truth(spark, sf_dir))


def correct_repairs(spark, sf_dir):
    d = _geo(spark, sf_dir)
    return evaluate.correct_repairs(d.raw, d.attributes, _truth(spark, sf_dir), _repairs(d))


def total_repairs(spark, sf_dir):
    d = _geo(spark, sf_dir)
    return evaluate.total_repairs(_domain(d), _repairs(d))


def repairs_grdt(spark, sf_dir):
    d = _geo(spark, sf_dir)
    return evaluate.repairs_with_truth(_domain(d), _repairs(d), _truth(spark, sf_dir))


def detected_errors(spark, sf_dir):
    d = _geo(spark, sf_dir)
    return evaluate.detected_errors(_domain(d), _dk(d), _truth(spark, sf_dir))


def eval_report(spark, sf_dir):
    d = _geo(spark, sf_dir)
    rows = evaluate.metrics(evaluate.counts(d.raw, d.attributes, _domain(d), _dk(d), _truth(spark, sf_dir), _repairs(d)))
    return rows.select(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "repair_recall", "f1", "repair_f1")), "detected_errors", "total_errors", "correct_repairs", "total_repairs", "total_repairs_grdt")


def weak_label_stats(spark, sf_dir):
    d = _geo(spark, sf_dir)
    return evaluate.weak_label_stats(_labelled(d), _dk(d), _truth(spark, sf_dir), _repairs(d))


def repaired_table(spark, sf_dir):
    d = _geo(spark, sf_dir)
    return repair.repaired(d.raw, _repairs(d), d.attributes).withColumnRenamed(TID, "tid")


def init_sim(spark, sf_dir):
    d = _geo(spark, sf_dir)
    return _feature_rows(d, _features(d, features.InitSimFeaturizer()))


def lang_features(spark, sf_dir):
    d = _geo(spark, sf_dir)
    return _feature_rows(d, _features(d, features.LangModelFeaturizer()))


def logistic_posterior(spark, sf_dir):
    d = _geo(spark, sf_dir)
    occur = features.OccurAttrFeaturizer()
    occur.setup(d)
    estimator = dom.Logistic(lambda x: occur.rows(x, 1), len(d.attributes) ** 2, 20)
    estimator.train(_domain(d))
    return estimator.predict(_domain(d)).select(F.col("_vid_").alias("cid"), "val_idx", F.round("p", 3).alias("p"))


def _session(spark, sf_dir, **settings) -> RepairSession:
    s = RepairSession(spark, cor_strength=CORR, nb_cor_strength=CORR, weak_label_thresh=0.99, domain_thresh_1=0.0, epochs=5, batch_size=32, learning_rate=0.05, **settings)
    frame = _geo_frame(spark, sf_dir)
    s.load_data("customers", df=frame.withColumnRenamed("c_custkey", TID), na_values=["HOUSEHOLD"])
    s.load_dcs(lines=[_GEO_DC])
    s.detect_errors([detect.NullDetector(), detect.ViolationDetector()])
    s.setup_domain()
    return s


def _featurizers() -> list[features.Featurizer]:
    return [features.InitAttrFeaturizer(0.3), features.FreqFeaturizer(), features.OccurAttrFeaturizer(), features.ConstraintFeaturizer()]


def end_to_end_repair(spark, sf_dir):
    """The whole session; the repaired table."""
    s = _session(spark, sf_dir)
    s.repair_errors(_featurizers())
    return s.repaired.withColumnRenamed(TID, "tid")


def distributed_repair(spark, sf_dir):
    """The session with the trainer that takes gradients on the cluster; inferred values."""
    s = _session(spark, sf_dir, trainer="distributed")
    s.repair_errors(_featurizers())
    return s.inferred_cells.select(F.col(TID).alias("tid"), "attribute", "rv_value")


def weight_summary(spark, sf_dir):
    s = _session(spark, sf_dir, print_fw=True)
    rows = s.repair_errors(_featurizers())
    return spark.createDataFrame([(r["featurizer"], r["size"], r["min"], r["max"], r["avg"], r["abs_avg"]) for r in rows], "featurizer string, size int, min double, max double, avg double, abs_avg double")


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    null_cells, dc_unary, dc_eq_iq, dc_eq_lt, dc_gt, dc_gte, dc_const_binary, dc_semi_join, detected_cells, active_attributes, errors_loader,
    stats_single, stats_pair, attr_correlation, correlated_attrs, pruned_pairs, cell_domain, pos_values, domain_info, filled_domain,
    nb_posterior, nb_argmax, weak_labels, repruned_single, feat_initattr, feat_freq, feat_occur, feat_norm, feat_constraint, feat_constraint_norm,
    feat_constraint_pairs, feat_constraint_exists, feat_unary, assembled_features, cond_logit_scores, total_errors, correct_repairs, total_repairs, repairs_grdt,
    detected_errors, eval_report, weak_label_stats, repaired_table, init_sim, lang_features, logistic_posterior, end_to_end_repair,
    distributed_repair, weight_summary,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


# ---- the same in SQL ----------------------------------------------------------------------------

_PART = "raw AS (SELECT p_partkey AS tid, lower(p_name) AS p_name, lower(p_brand) AS p_brand, coalesce(lower(nullif(p_type, 'PROMO')), '_nan_') AS p_type, CAST(p_size AS VARCHAR) AS p_size FROM part)"
_ORDERS = "raw AS (SELECT o_orderkey AS tid, CAST(o_custkey AS VARCHAR) AS o_custkey, lower(o_orderstatus) AS o_orderstatus, lower(o_orderpriority) AS o_orderpriority FROM orders)"
_CUSTOMER = "raw AS (SELECT c_custkey AS tid, CAST(c_nationkey AS VARCHAR) AS c_nationkey, coalesce(lower(nullif(c_mktsegment, 'HOUSEHOLD')), '_nan_') AS c_mktsegment FROM customer)"
_GEO = """raw AS (SELECT c_custkey AS tid, CAST(c_nationkey AS VARCHAR) AS nation_key, lower(n_name) AS n_name,
    CASE WHEN c_custkey % 97 = 0 AND c_nationkey < 8 THEN 'corrupt' ELSE lower(r_name) END AS r_name,
    coalesce(lower(nullif(c_mktsegment, 'HOUSEHOLD')), '_nan_') AS segment
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _cells_sql(attributes: list[str]) -> str:
    return "cells AS (" + " UNION ALL ".join(f"SELECT tid, '{a}' AS attribute, {a} AS value, {i} AS idx FROM raw" for i, a in enumerate(attributes)) + ")"


_GEO_ATTRS = ["nation_key", "n_name", "r_name", "segment"]
_STATS = """single AS (SELECT attribute, value, count(*) AS n FROM cells GROUP BY ALL),
pairs AS (SELECT a.attribute AS a1, a.value AS v1, b.attribute AS a2, b.value AS v2, count(*) AS n FROM cells a JOIN cells b ON a.tid = b.tid AND a.attribute <> b.attribute GROUP BY ALL)"""
_CORR = """total AS (SELECT count(*)::DOUBLE AS t FROM raw),
alone AS (SELECT attribute, -sum(n / t * ln(n / t)) AS h, count(*) AS ndv FROM single, total GROUP BY attribute),
joint AS (SELECT a1, a2, -sum(n / t * ln(n / t)) AS h FROM pairs, total GROUP BY a1, a2),
corr AS (SELECT x.attribute AS x, y.attribute AS y, CASE WHEN x.ndv = 1 THEN 0.0 WHEN x.attribute = y.attribute THEN 1.0 ELSE 1.0 - (j.h - y.h) / ln(x.ndv) END AS corr
    FROM alone x CROSS JOIN alone y LEFT JOIN joint j ON j.a1 = x.attribute AND j.a2 = y.attribute)"""
_DOMAIN = f"""edges AS (SELECT x, y FROM corr WHERE corr > {CORR} AND x <> y),
pruned AS (SELECT p.*, s.n AS freq FROM pairs p JOIN single s ON s.attribute = p.a1 AND s.value = p.v1 WHERE v1 <> '_nan_' AND v2 <> '_nan_' AND p.n > {PRUNE} * s.n),
cands AS (SELECT c.tid, e.x AS attribute, p.v2 AS v FROM cells c JOIN edges e ON e.y = c.attribute JOIN pruned p ON p.a1 = c.attribute AND p.v1 = c.value AND p.a2 = e.x
    WHERE e.x IN (SELECT attribute FROM dk) UNION SELECT tid, attribute, value FROM cells WHERE attribute IN (SELECT attribute FROM dk) AND value <> '_nan_'),
pos AS (SELECT k.tid, k.attribute, c.tid * 4 + c.idx AS cid, c.value AS init_value, k.v, row_number() OVER (PARTITION BY k.tid, k.attribute ORDER BY k.v) - 1 AS val_idx, count(*) OVER (PARTITION BY k.tid, k.attribute) AS size
    FROM cands k JOIN cells c ON c.tid = k.tid AND c.attribute = k.attribute)"""
_NB = """lik AS (SELECT p.cid, p.val_idx, sum(ln(greatest(coalesce(q.n, 0) - 1, 0.1)) - ln(f.n)) AS s FROM pos p JOIN single f ON f.attribute = p.attribute AND f.value = p.v
    JOIN edges e ON e.x = p.attribute JOIN cells c ON c.tid = p.tid AND c.attribute = e.y AND c.value <> '_nan_'
    LEFT JOIN pairs q ON q.a1 = p.attribute AND q.v1 = p.v AND q.a2 = c.attribute AND q.v2 = c.value GROUP BY p.cid, p.val_idx),
score AS (SELECT p.*, ln(f.n / t) + coalesce(l.s, 0) AS z FROM pos p JOIN single f ON f.attribute = p.attribute AND f.value = p.v CROSS JOIN total LEFT JOIN lik l ON l.cid = p.cid AND l.val_idx = p.val_idx),
stable AS (SELECT *, exp(z - max(z) OVER (PARTITION BY cid)) AS e FROM score),
post AS (SELECT *, e / sum(e) OVER (PARTITION BY cid) AS p FROM stable)"""
_BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY p DESC, val_idx) AS r FROM post) WHERE r = 1)"
_DK = """dk AS (SELECT tid, attribute, tid * 4 + idx AS cid FROM cells WHERE value = '_nan_' UNION
    SELECT c.tid, c.attribute, c.tid * 4 + c.idx FROM cells c JOIN raw a ON a.tid = c.tid WHERE c.attribute IN ('nation_key', 'r_name') AND EXISTS (SELECT 1 FROM raw b WHERE a.nation_key = b.nation_key AND a.r_name <> b.r_name))"""
_TRUTH = """clean AS (SELECT c_custkey AS tid, CAST(c_nationkey AS VARCHAR) AS nation_key, lower(n_name) AS n_name, lower(r_name) AS r_name, lower(c_mktsegment) AS segment
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
truth AS (""" + " UNION ALL ".join(f"SELECT tid, '{a}' AS attribute, {a} AS truth FROM clean" for a in _GEO_ATTRS) + ")"
_REPAIRS = "repairs AS (SELECT b.tid, b.attribute, b.v AS rv_value, b.init_value FROM best b JOIN dk ON dk.cid = b.cid)"
_LABELS = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY p DESC, val_idx) AS r, max(p) OVER (PARTITION BY cid) AS top FROM post),
kept AS (SELECT * FROM ranked WHERE ((p >= 0.01 OR top < 0.01) AND r <= 10) OR v = init_value),
labelled AS (SELECT k.cid, any_value(k.tid) AS tid, any_value(k.attribute) AS attribute, string_agg(k.v, '|' ORDER BY k.v) AS domain, list(k.v ORDER BY k.v) AS vs, any_value(k.init_value) AS init_value,
    any_value(CASE WHEN b.v <> b.init_value AND b.p >= {WEAK} THEN b.v ELSE b.init_value END) AS weak_label, any_value(CASE WHEN b.v <> b.init_value AND b.p >= {WEAK} THEN 1 ELSE 0 END) AS fixed
    FROM kept k JOIN best b ON b.cid = k.cid GROUP BY k.cid)"""

_GEO_BASE = f"WITH {_GEO}, {_cells_sql(_GEO_ATTRS)}, {_STATS}, {_CORR}"
_GEO_DOMAIN = f"{_GEO_BASE}, {_DK}, {_DOMAIN}"
_GEO_NB = f"{_GEO_DOMAIN}, {_NB}, {_BEST}"
_GEO_EVAL = f"{_GEO_NB}, {_TRUTH}, {_REPAIRS}"
_ERRORS = "errs AS (SELECT c.tid, c.attribute, c.value, t.truth FROM cells c JOIN truth t ON t.tid = c.tid AND t.attribute = c.attribute WHERE c.value <> t.truth)"
_COUNTS = f"""{_ERRORS}, counted AS (SELECT
    (SELECT count(*) FROM (SELECT DISTINCT cid, tid, attribute, init_value FROM pos) p JOIN truth t ON t.tid = p.tid AND t.attribute = p.attribute JOIN dk ON dk.cid = p.cid WHERE p.init_value <> t.truth) AS detected_errors,
    (SELECT count(*) FROM errs) AS total_errors,
    (SELECT count(*) FROM errs e JOIN repairs r ON r.tid = e.tid AND r.attribute = e.attribute AND r.rv_value = e.truth) AS correct_repairs,
    (SELECT count(*) FROM repairs WHERE init_value <> rv_value) AS total_repairs,
    (SELECT count(*) FROM repairs r JOIN truth t ON t.tid = r.tid AND t.attribute = r.attribute WHERE init_value <> rv_value) AS total_repairs_grdt)"""
#: Violation counts by pairs of rows: every relaxed predicate of the two constraints.
_PAIR_COUNTS = """counts AS (
    SELECT p.cid, p.val_idx, 0 AS feat, count(*) AS x FROM pos p JOIN raw a ON a.tid = p.tid JOIN raw b ON b.tid <> a.tid AND p.v = b.nation_key AND a.r_name <> b.r_name WHERE p.attribute = 'nation_key' GROUP BY ALL UNION ALL
    SELECT p.cid, p.val_idx, 1, count(*) FROM pos p JOIN raw a ON a.tid = p.tid JOIN raw b ON b.tid <> a.tid AND a.nation_key = b.nation_key AND p.v <> b.r_name WHERE p.attribute = 'r_name' GROUP BY ALL"""
_PAIR_COUNTS_2 = """ UNION ALL
    SELECT p.cid, p.val_idx, 3, count(*) FROM pos p JOIN raw a ON a.tid = p.tid JOIN raw b ON b.tid <> a.tid AND p.v = b.segment AND a.n_name = b.n_name AND a.r_name <> b.r_name WHERE p.attribute = 'segment' GROUP BY ALL UNION ALL
    SELECT p.cid, p.val_idx, 4, count(*) FROM pos p JOIN raw a ON a.tid = p.tid JOIN raw b ON b.tid <> a.tid AND a.n_name = b.n_name AND a.segment = b.segment AND p.v <> b.r_name WHERE p.attribute = 'r_name' GROUP BY ALL"""
_W = _FIXED_WEIGHTS

ORACLE: dict[str, str] = {
    "null_cells": f"WITH {_CUSTOMER}, {_cells_sql(['c_nationkey', 'c_mktsegment'])} SELECT tid, attribute FROM cells WHERE value = '_nan_'",
    "dc_unary": f"WITH {_ORDERS} SELECT tid FROM raw WHERE o_orderstatus = 'f' AND o_orderpriority = '1-urgent'",
    "dc_eq_iq": f"WITH {_PART} SELECT tid FROM raw a WHERE EXISTS (SELECT 1 FROM raw b WHERE a.p_name = b.p_name AND a.p_size = b.p_size AND a.p_brand <> b.p_brand)",
    "dc_eq_lt": f"WITH {_CUSTOMER} SELECT tid FROM raw a WHERE EXISTS (SELECT 1 FROM raw b WHERE a.c_nationkey = b.c_nationkey AND a.c_mktsegment < b.c_mktsegment)",
    "dc_gt": f"WITH {_CUSTOMER} SELECT tid FROM raw a WHERE EXISTS (SELECT 1 FROM raw b WHERE a.c_nationkey = b.c_nationkey AND a.c_mktsegment > b.c_mktsegment)",
    "dc_gte": f"WITH {_PART} SELECT tid FROM raw a WHERE EXISTS (SELECT 1 FROM raw b WHERE a.tid <> b.tid AND a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_size >= b.p_size)",
    "dc_const_binary": f"WITH {_PART} SELECT tid FROM raw a WHERE p_type = 'economy' AND EXISTS (SELECT 1 FROM raw b WHERE a.p_name = b.p_name AND a.p_size = b.p_size AND a.p_brand <> b.p_brand)",
    "dc_semi_join": f"WITH {_PART} SELECT tid FROM raw a WHERE EXISTS (SELECT 1 FROM raw b WHERE a.tid <> b.tid AND a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_size <= b.p_size)",
    "detected_cells": f"WITH {_GEO}, {_cells_sql(_GEO_ATTRS)}, {_DK} SELECT tid, attribute, cid FROM dk",
    "active_attributes": f"WITH {_GEO}, {_cells_sql(_GEO_ATTRS)}, {_DK} SELECT DISTINCT attribute FROM dk",
    "errors_loader": "SELECT c_custkey AS tid, 'r_name' AS attribute, c_custkey * 4 + 2 AS cid FROM customer WHERE c_custkey % 97 = 0 AND c_nationkey < 8",
    "stats_single": f"WITH {_ORDERS}, {_cells_sql(['o_custkey', 'o_orderstatus', 'o_orderpriority'])} SELECT attribute, value, count(*) AS n FROM cells GROUP BY ALL",
    "stats_pair": f"WITH {_PART}, {_cells_sql(['p_name', 'p_brand', 'p_type', 'p_size'])}, {_STATS} SELECT a1, a2, v1, v2, n FROM pairs WHERE v1 <> '_nan_' AND v2 <> '_nan_'",
    "attr_correlation": f"{_GEO_BASE} SELECT x, y, round(corr, 6) AS corr FROM corr",
    "correlated_attrs": f"{_GEO_BASE} SELECT x, y FROM corr WHERE corr > {CORR} AND x <> y",
    "pruned_pairs": f"WITH {_PART}, {_cells_sql(['p_name', 'p_brand', 'p_type', 'p_size'])}, {_STATS} SELECT a1, v1, a2, v2, p.n, s.n AS freq FROM pairs p JOIN single s ON s.attribute = a1 AND s.value = v1 WHERE v1 <> '_nan_' AND v2 <> '_nan_' AND p.n > {PRUNE} * s.n",
    "cell_domain": f"{_GEO_DOMAIN} SELECT tid, attribute, string_agg(v, '|' ORDER BY v) AS domain, count(*)::INT AS domain_size, any_value(init_value) AS init_value, coalesce(max(CASE WHEN v = init_value THEN val_idx END), -1)::INT AS init_index FROM pos GROUP BY tid, attribute",
    "pos_values": f"{_GEO_DOMAIN} SELECT cid, tid, attribute, v AS rv_val, (val_idx + 1)::INT AS val_id FROM pos",
    "domain_info": f"{_GEO_DOMAIN} SELECT count(DISTINCT cid) AS n_vars, max(size)::INT AS max_domain FROM pos",
    "nb_posterior": f"{_GEO_NB} SELECT cid, v AS rv_val, round(p, 6) AS p FROM post",
    "nb_argmax": f"{_GEO_NB} SELECT cid, val_idx::INT AS inferred_val_idx, v AS inferred_val, round(p, 6) AS prob FROM best",
    "weak_labels": f"{_GEO_NB}, {_LABELS} SELECT l.cid, domain, weak_label, l.fixed, (CASE WHEN weak_label <> '_nan_' AND (dk.cid IS NULL OR l.fixed <> 0) THEN list_position(vs, weak_label) - 1 ELSE -1 END)::INT AS label, (weak_label <> '_nan_' AND dk.cid IS NULL)::INT AS is_clean FROM labelled l LEFT JOIN dk ON dk.cid = l.cid",
    "repruned_single": f"""{_GEO_NB}, {_LABELS}, lone AS (SELECT DISTINCT cid FROM pos WHERE size = 1),
    marked AS (SELECT l.cid, domain, vs, CASE WHEN a.cid IS NULL THEN weak_label ELSE init_value END AS weak_label, CASE WHEN a.cid IS NULL THEN l.fixed ELSE 2 END::INT AS fixed FROM labelled l LEFT JOIN lone a ON a.cid = l.cid)
    SELECT cid, domain, weak_label, (coalesce(nullif(list_position(vs, weak_label), 0), 0) - 1)::INT AS weak_label_idx, fixed FROM marked""",
    "feat_initattr": f"{_GEO_DOMAIN} SELECT cid, val_idx::INT AS val_idx, (cid % 4)::INT AS feat, CASE WHEN v = init_value THEN 1.0 ELSE -1.0 END::DOUBLE AS x FROM pos",
    "feat_freq": f"{_GEO_DOMAIN} SELECT cid, val_idx::INT AS val_idx, (cid % 4)::INT AS feat, round(s.n / t, 6) AS x FROM pos p JOIN single s ON s.attribute = p.attribute AND s.value = p.v, total",
    "feat_occur": f"{_GEO_DOMAIN} SELECT cid, val_idx::INT AS val_idx, (cid % 4 * 4 + c.idx)::INT AS feat, round(q.n / f.n, 6) AS x FROM pos p JOIN cells c ON c.tid = p.tid AND c.attribute <> p.attribute AND c.value <> '_nan_' JOIN pairs q ON q.a1 = p.attribute AND q.v1 = p.v AND q.a2 = c.attribute AND q.v2 = c.value JOIN single f ON f.attribute = c.attribute AND f.value = c.value",
    "feat_norm": f"{_GEO_DOMAIN}, f AS (SELECT cid, val_idx, s.n / t AS x FROM pos p JOIN single s ON s.attribute = p.attribute AND s.value = p.v, total) SELECT cid, val_idx::INT AS val_idx, (cid % 4)::INT AS feat, round(x / sqrt(sum(x * x) OVER (PARTITION BY cid)), 6) AS x FROM f",
    "feat_constraint": f"{_GEO_DOMAIN}, {_PAIR_COUNTS}{_PAIR_COUNTS_2}) SELECT cid, val_idx::INT AS val_idx, feat, x::DOUBLE AS x FROM counts",
    "feat_constraint_norm": f"{_GEO_DOMAIN}, {_PAIR_COUNTS}) SELECT cid, val_idx::INT AS val_idx, feat, round(x / sqrt(sum(x * x) OVER (PARTITION BY cid, feat)), 6) AS x FROM counts",
    "feat_constraint_pairs": f"""{_GEO_DOMAIN}, counts AS (
    SELECT p.cid, p.val_idx, 0 AS feat, count(*) AS x FROM pos p JOIN raw a ON a.tid = p.tid JOIN raw b ON b.tid <> a.tid AND p.v = b.nation_key AND a.r_name < b.r_name WHERE p.attribute = 'nation_key' GROUP BY ALL UNION ALL
    SELECT p.cid, p.val_idx, 1, count(*) FROM pos p JOIN raw a ON a.tid = p.tid JOIN raw b ON b.tid <> a.tid AND a.nation_key = b.nation_key AND p.v < b.r_name WHERE p.attribute = 'r_name' GROUP BY ALL UNION ALL
    SELECT p.cid, p.val_idx, 2, count(*) FROM pos p JOIN raw a ON a.tid = p.tid JOIN raw b ON b.tid <> a.tid AND a.nation_key = b.nation_key AND b.r_name < p.v WHERE p.attribute = 'r_name' GROUP BY ALL)
    SELECT cid, val_idx::INT AS val_idx, feat, x::DOUBLE AS x FROM counts""",
    "feat_constraint_exists": f"{_GEO_DOMAIN} SELECT cid, val_idx::INT AS val_idx, 1::BIGINT AS x FROM pos p JOIN raw a ON a.tid = p.tid WHERE p.attribute = 'r_name' AND EXISTS (SELECT 1 FROM raw b WHERE b.tid <> a.tid AND a.nation_key = b.nation_key AND p.v <> b.r_name)",
    "feat_unary": f"""{_GEO_DOMAIN} SELECT p.cid, val_idx::INT AS val_idx, 0 AS feat, 1.0::DOUBLE AS x FROM pos p JOIN raw a ON a.tid = p.tid WHERE p.attribute = 'segment' AND p.v = 'building' AND a.r_name = 'corrupt'
    UNION ALL SELECT p.cid, val_idx::INT, 1, 1.0::DOUBLE FROM pos p JOIN raw a ON a.tid = p.tid WHERE p.attribute = 'r_name' AND p.v = 'corrupt' AND a.segment = 'building'""",
    "assembled_features": f"""{_GEO_DOMAIN}, {_PAIR_COUNTS})
    SELECT cid, val_idx::INT AS val_idx, (cid % 4)::INT AS feat, CASE WHEN v = init_value THEN 1.0 ELSE -1.0 END::DOUBLE AS x FROM pos
    UNION ALL SELECT cid, val_idx::INT, (4 + cid % 4)::INT, round(s.n / t, 6) FROM pos p JOIN single s ON s.attribute = p.attribute AND s.value = p.v, total
    UNION ALL SELECT cid, val_idx::INT, (8 + cid % 4 * 4 + c.idx)::INT, round(q.n / f.n, 6) FROM pos p JOIN cells c ON c.tid = p.tid AND c.attribute <> p.attribute AND c.value <> '_nan_' JOIN pairs q ON q.a1 = p.attribute AND q.v1 = p.v AND q.a2 = c.attribute AND q.v2 = c.value JOIN single f ON f.attribute = c.attribute AND f.value = c.value
    UNION ALL SELECT cid, val_idx::INT, (24 + feat)::INT, round(x / sqrt(sum(x * x) OVER (PARTITION BY cid, feat)), 6) FROM counts""",
    "cond_logit_scores": f"""{_GEO_DOMAIN}, {_PAIR_COUNTS}), unit AS (SELECT cid, val_idx, x / sqrt(sum(x * x) OVER (PARTITION BY cid, feat)) AS x FROM counts),
    c AS (SELECT cid, val_idx, sum(x) AS x FROM unit GROUP BY ALL),
    z AS (SELECT p.cid, p.val_idx, {_W[0]} * CASE WHEN p.v = p.init_value THEN 1 ELSE -1 END + {_W[1]} * s.n / t - {_W[2]} * coalesce(c.x, 0) AS z FROM pos p JOIN single s ON s.attribute = p.attribute AND s.value = p.v CROSS JOIN total LEFT JOIN c ON c.cid = p.cid AND c.val_idx = p.val_idx)
    SELECT cid, val_idx::INT AS val_idx, round(exp(z) / sum(exp(z)) OVER (PARTITION BY cid), 6) AS prob FROM z""",
    "total_errors": f"{_GEO_EVAL}, {_ERRORS} SELECT count(*) AS total_errors FROM errs",
    "correct_repairs": f"{_GEO_EVAL}, {_COUNTS} SELECT correct_repairs FROM counted",
    "total_repairs": f"{_GEO_EVAL} SELECT count(*) AS total_repairs FROM repairs WHERE init_value <> rv_value",
    "repairs_grdt": f"{_GEO_EVAL} SELECT init_value = truth AS on_correct, count(*) AS n FROM repairs r JOIN truth t ON t.tid = r.tid AND t.attribute = r.attribute WHERE init_value <> rv_value GROUP BY 1",
    "detected_errors": f"{_GEO_EVAL}, {_COUNTS} SELECT detected_errors FROM counted",
    "eval_report": f"""{_GEO_EVAL}, {_COUNTS}, m AS (SELECT *, CASE WHEN total_repairs_grdt = 0 THEN 0 ELSE correct_repairs / total_repairs_grdt END AS p, CASE WHEN total_errors = 0 THEN 0 ELSE correct_repairs / total_errors END AS r, CASE WHEN detected_errors = 0 THEN 0 ELSE correct_repairs / detected_errors END AS rr FROM counted)
    SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(rr, 6) AS repair_recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1, round(CASE WHEN p + rr = 0 THEN 0 ELSE 2 * p * rr / (p + rr) END, 6) AS repair_f1, detected_errors, total_errors, correct_repairs, total_repairs, total_repairs_grdt FROM m""",
    "weak_label_stats": f"""{_GEO_EVAL}, {_LABELS} SELECT dk.cid IS NULL AS is_clean, l.fixed AS cell_status, r.rv_value IS NOT NULL AS is_inferred, l.init_value = truth AS init_eq_grdth, l.init_value = rv_value AS init_eq_infer,
    weak_label = l.init_value AS wl_eq_init, weak_label = truth AS wl_eq_grdth, weak_label = rv_value AS wl_eq_infer, truth = rv_value AS infer_eq_grdth, count(*) AS count
    FROM labelled l JOIN truth t ON t.tid = l.tid AND t.attribute = l.attribute LEFT JOIN dk ON dk.cid = l.cid LEFT JOIN repairs r ON r.tid = l.tid AND r.attribute = l.attribute GROUP BY ALL""",
    "repaired_table": f"""{_GEO_EVAL} SELECT raw.tid, """ + ", ".join(f"nullif(coalesce(max(CASE WHEN r.attribute = '{a}' THEN rv_value END), any_value(raw.{a})), '_nan_') AS {a}" for a in _GEO_ATTRS) + " FROM raw LEFT JOIN repairs r ON r.tid = raw.tid GROUP BY raw.tid",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


__all__ = ["NULL", "oracle_sql", "queries"]
