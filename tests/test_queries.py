"""Queries against their SQL forms on the smallest tables."""

import glob
import os

import pytest

from cellmend.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
@pytest.mark.parametrize("name", ["null_cells", "dc_eq_iq", "dc_gt", "dc_gte", "detected_cells", "stats_pair", "attr_correlation", "cell_domain", "nb_argmax", "repruned_single", "feat_constraint", "feat_unary", "assembled_features", "cond_logit_scores", "eval_report", "repaired_table"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    found = queries()[name](spark, DATA)
    columns = sorted(found.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in found.collect())
    result = con.execute(oracle_sql()[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in result.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
def test_flagship_returns(spark):
    """The whole session on the smallest tables, and a repair of each planted error that a majority outvotes."""
    rows = queries()["end_to_end_repair"](spark, DATA).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/customer.parquet").count()
    assert not any(r["r_name"] == "corrupt" for r in rows if r["tid"] % 97 == 0 and r["tid"] > 0)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
def test_similarity_feature_equals_plain_python(spark):
    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        return row[-1]

    def _next(row, x, b):
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        return new

    domain = {(r["cid"], r["val_id"] - 1): r["rv_val"] for r in queries()["pos_values"](spark, DATA).collect()}
    init = {r["tid"] * 4 + ["nation_key", "n_name", "r_name", "segment"].index(r["attribute"]): r["init_value"] for r in queries()["cell_domain"](spark, DATA).collect()}
    rows = queries()["init_sim"](spark, DATA).collect()
    assert len(rows) == len(domain)
    for r in rows:
        v, own = domain[r["cid"], r["val_idx"]], init[r["cid"]]
        want = -1.0 if v == own else 4 * common(v, own) / (len(v) + len(own)) - 1
        assert r["feat"] == r["cid"] % 4 and r["x"] == pytest.approx(want, abs=1e-5)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
@pytest.mark.parametrize("name", ["logistic_posterior", "assembled_features"])
def test_cells_are_never_broadcast(spark, name):
    """Tables of cells and candidates meet in a shuffle, however small their files are; only tables of counts may be broadcast."""
    plan = queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_tid_" in plan
    assert "BroadcastHashJoin [_tid_" not in plan and "BroadcastHashJoin [_vid_" not in plan
