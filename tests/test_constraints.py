import random

import pytest

from cellmend.plans.constraints import Attribute, ConstraintError, Literal, flip, is_symmetric, parse
from cellmend.plans.violations import semi_join, split, violating

SCHEMA = ["a", "b", "IQ x", "c"]


def test_parse_pair():
    dc = parse("t1&t2&EQ(t1.a,t2.a)&IQ(t1.b,t2.b)", SCHEMA)
    assert dc.tuples == ("t1", "t2")
    assert [p.op for p in dc.predicates] == ["=", "<>"]
    assert dc.components == ["a", "b"]
    assert dc.sql() == 't1."a"=t2."a" AND t1."b"<>t2."b"'


def test_parse_first_predicate_may_be_an_inequality_and_space_is_free():
    dc = parse(' t1 & t2 & IQ( t1.`IQ x` , t2.c ) & LTE(t1.a,"x, (y) & z") ', SCHEMA)
    assert dc.predicates[0].left == Attribute("t1", "IQ x")
    assert dc.predicates[1].right == Literal("x, (y) & z")


@pytest.mark.parametrize("text", [
    "t1&(t1.a,t1.b)", "t1&EQ(t1.a)", "t1&EQ(t1.a,t1.b,t1.c)", "t1&EQ(t2.a,t1.b)", "t1&EQ(t1.z,'x')", "t1&EQ(t1.a,'x)",
    "t1&EQ('x',t1.a)", "t1", "EQ(t1.a,'x')", "t1&t2&t3&EQ(t1.a,t2.a)", "t1&EQ(t1.a,t1.b", "t1&EQ&EQ(t1.a,'x')",
])
def test_parse_errors(text):
    with pytest.raises(ConstraintError):
        parse(text, SCHEMA)


def test_operators():
    assert [flip(o) for o in ("=", "<>", "<", ">", "<=", ">=")] == ["=", "<>", ">", "<", ">=", "<="]
    assert is_symmetric("=") and is_symmetric("<>") and not is_symmetric("<")


@pytest.mark.parametrize("text", [
    "t1&t2&EQ(t1.a,t2.a)&IQ(t1.b,t2.b)", "t1&t2&EQ(t1.a,t2.a)&LT(t1.b,t2.b)", "t1&t2&EQ(t1.a,t2.a)&GT(t1.b,t2.b)",
    "t1&t2&IQ(t1.b,t2.b)&EQ(t1.a,'1')", "t1&t2&EQ(t1.a,t2.a)&IQ(t1.b,t2.b)&EQ(t2.c,'0')", "t1&t2&EQ(t2.a,t1.a)&LT(t2.b,t1.b)",
    "t1&t2&EQ(t1.a,t2.a)&GTE(t1.b,t2.b)", "t1&t2&EQ(t1.a,t2.b)&EQ(t1.b,t2.a)", "t1&t2&EQ(t1.a,t2.a)&LT(t1.b,t2.c)&IQ(t1.c,t2.b)",
    "t1&EQ(t1.a,t1.b)", "t1&t2&EQ(t1.a,'2')", "r&s&EQ(r.a,s.a)&IQ(r.b,s.b)",
])
def test_violations_equal_brute_force(spark, text):
    rnd = random.Random(text)
    rows = [(i, *(rnd.choice(["0", "1", "2", "_nan_"]) for _ in range(3))) for i in range(40)]
    df = spark.createDataFrame(rows, "_tid_ long, a string, b string, c string")
    dc = parse(text, ["a", "b", "c"])
    at = {"a": 1, "b": 2, "c": 3}
    ops = {"=": lambda x, y: x == y, "<>": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}

    def holds(one, two):
        of = lambda o: o.value if isinstance(o, Literal) else (one if o.tuple == dc.tuples[0] else two)[at[o.name]]
        return all(ops[p.op](of(p.left), of(p.right)) for p in dc.predicates)

    alone = all(p.tuples == {dc.tuples[0]} for p in dc.predicates)
    want = sorted(r[0] for r in rows if (holds(r, r) if alone else any(holds(r, s) for s in rows if s[0] != r[0])))
    assert sorted(r[0] for r in violating(df, dc).collect()) == want


def test_semi_join_lets_tuples_be_their_own_partner_if_asked(spark):
    df = spark.createDataFrame([(0, "x")], "_tid_ long, a string")
    between = split(parse("t1&t2&EQ(t1.a,t2.a)", ["a"]))[2]
    assert semi_join(df, df, between, True).count() == 1
    assert semi_join(df, df, between, False).count() == 0
