"""Features of candidates, as rows (_vid_, val_idx, feat, x) without the zeros."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import NULL, TID
from ..functions.text import embed_udf, similarity_udf
from ..plans.constraints import Attribute, Constraint, Literal, Predicate, apply, flip
from ..sources.tables import by_cell, by_value, cells
from . import stats
from .domain import candidates

EMBEDDING = 10
_ROW = ("_vid_", "val_idx", "feat", "x")


@dataclass
class FeatInfo:
    name: str
    size: int
    learnable: bool
    init_weight: float | list[float]
    names: list[str] = field(default_factory=list)


class Featurizer(ABC):
    """Computes some features of each candidate; feat counts from 0 within the featurizer."""

    learnable = True

    def __init__(self, init_weight: float | list[float] = 1.0):
        self.init_weight = init_weight

    def setup(self, dataset) -> None:
        self.dataset = dataset

    @property
    def name(self) -> str:
        return type(self).__name__

    @abstractmethod
    def names(self) -> list[str]: ...

    @abstractmethod
    def rows(self, domain: DataFrame, classes: int) -> DataFrame:
        """classes: the largest domain's size."""

    def info(self) -> FeatInfo:
        names = self.names()
        if isinstance(self.init_weight, list) and len(self.init_weight) != len(names):
            raise ValueError(f"{self.name} needs {len(names)} weights, not {len(self.init_weight)}")
        return FeatInfo(self.name, len(names), self.learnable, self.init_weight, names)

    def _index(self, attribute):
        return self.dataset.attribute_index(attribute)


class InitAttrFeaturizer(Featurizer):
    """+1 for the initial value, -1 for others, at the cell's attribute; its weight is not learned."""

    learnable = False

    def names(self) -> list[str]:
        return list(self.dataset.attributes)

    def rows(self, domain: DataFrame, classes: int) -> DataFrame:
        # other attributes' columns are the same for all candidates and cancel in the softmax
        size = classes**-0.5 if self.dataset.config.feature_norm else 1.0
        return candidates(domain).select("_vid_", "val_idx", self._index(F.col("attribute")).alias("feat"), F.when(F.col("rv_val") == F.col("init_value"), size).otherwise(-size).alias("x"))


class InitSimFeaturizer(Featurizer):
    """2 * similarity to the initial value - 1, and -1 for the initial value itself."""

    learnable = False

    def names(self) -> list[str]:
        return list(self.dataset.attributes)

    def rows(self, domain: DataFrame, classes: int) -> DataFrame:
        rows = candidates(domain).select("_vid_", "val_idx", "attribute", "rv_val", "init_value")
        pairs = rows.where("rv_val <> init_value").select("rv_val", "init_value").distinct().withColumn("s", similarity_udf("rv_val", "init_value"))
        x = F.when(F.col("rv_val") == F.col("init_value"), -1.0).otherwise(2 * F.col("s") - 1)
        return by_cell(rows, pairs, ["rv_val", "init_value"], "left").select("_vid_", "val_idx", self._index(F.col("attribute")).alias("feat"), x.alias("x"))


class FreqFeaturizer(Featurizer):
    """The candidate's share of all tuples."""

    def names(self) -> list[str]:
        return list(self.dataset.attributes)

    def rows(self, domain: DataFrame, classes: int) -> DataFrame:
        d = self.dataset
        freq = stats.frequencies(d.single).select("attribute", F.col("value").alias("rv_val"), (F.col("n") / d.n_rows).alias("x"))
        return by_value(candidates(domain), freq, ["attribute", "rv_val"]).select("_vid_", "val_idx", self._index(F.col("attribute")).alias("feat"), "x")


class OccurAttrFeaturizer(Featurizer):
    """The candidate's share of the tuples with this tuple's value of another attribute."""

    def names(self) -> list[str]:
        return [f"{a} X {b}" for a in self.dataset.attributes for b in self.dataset.attributes]

    def rows(self, domain: DataFrame, classes: int) -> DataFrame:
        d = self.dataset
        context = cells(d.raw, d.attributes).where(F.col("value") != NULL).withColumnRenamed("attribute", "at")
        freq = stats.frequencies(d.single).select(F.col("attribute").alias("at"), "value", F.col("n").alias("freq"))
        both = stats.co_occurrences(d.pairs).select(F.col("a2").alias("at"), F.col("v2").alias("value"), F.col("a1").alias("attribute"), F.col("v1").alias("rv_val"), "n")
        share = by_value(both, freq, ["at", "value"]).select("at", "value", "attribute", "rv_val", (F.col("n") / F.col("freq")).alias("x"))
        rows = by_cell(candidates(domain).select("_vid_", TID, "attribute", "val_idx", "rv_val"), context, TID).where("at <> attribute")
        return by_value(rows, share, ["at", "value", "attribute", "rv_val"]).select("_vid_", "val_idx", (self._index(F.col("attribute")) * len(d.attributes) + self._index(F.col("at"))).alias("feat"), "x")


class LangModelFeaturizer(Featurizer):
    """The candidate's embedding, in its attribute's block."""

    def names(self) -> list[str]:
        return [f"{a}_emb_{i}" for a in self.dataset.attributes for i in range(EMBEDDING)]

    def rows(self, domain: DataFrame, classes: int) -> DataFrame:
        rows = candidates(domain).select("_vid_", "val_idx", "attribute", "rv_val")
        vectors = rows.select("rv_val").distinct().withColumn("e", embed_udf("rv_val"))
        return by_cell(rows, vectors, "rv_val").select("_vid_", "val_idx", "attribute", F.posexplode("e").alias("i", "x")).select("_vid_", "val_idx", (self._index(F.col("attribute")) * EMBEDDING + F.col("i")).alias("feat"), "x")


@dataclass(frozen=True)
class Relaxed:
    """A predicate of a constraint whose own side a candidate takes; ``role`` is the candidate's tuple."""

    dc: Constraint
    at: int
    role: str

    @property
    def predicate(self) -> Predicate:
        p = self.dc.predicates[self.at]
        return Predicate(flip(p.op), p.right, p.left) if isinstance(p.right, Attribute) and p.left.tuple != self.role else p

    @property
    def others(self) -> list[Predicate]:
        return [p for i, p in enumerate(self.dc.predicates) if i != self.at]

    def describe(self) -> str:
        return f"fixed pred: {' AND '.join(p.sql() for p in self.others) or 'TRUE'}, violation pred: {self.predicate.sql()}"


def relaxations(constraints: list[Constraint]) -> list[Relaxed]:
    """In order of constraint, predicate and role; a symmetric predicate between tuples has one role."""
    out = []
    for dc in constraints:
        for i, p in enumerate(dc.predicates):
            roles = [p.left.tuple]
            if len(p.tuples) == 2 and p.op not in ("=", "<>"):
                roles = list(dc.tuples)
            elif len(p.tuples) == 2:
                roles = [dc.tuples[0]]
            out += [Relaxed(dc, i, r) for r in roles]
    return out


class ConstraintFeaturizer(Featurizer):
    """How many violations each candidate would take part in, of length one over a cell's candidates."""

    def names(self) -> list[str]:
        return [r.describe() for r in relaxations(self.dataset.constraints)]

    def rows(self, domain: DataFrame, classes: int) -> DataFrame:
        counts = violation_counts(domain, self.dataset.raw, self.dataset.constraints, self.dataset.config.max_pairs)
        return unit_length(counts)


def violation_counts(domain: DataFrame, raw: DataFrame, constraints: list[Constraint], max_pairs: int = 0) -> DataFrame:
    parts = []
    for i, r in enumerate(relaxations(constraints)):
        cands = candidates(domain).where(F.col("attribute") == r.predicate.left.name).select("_vid_", TID, "val_idx", "rv_val")
        found = _count(cands, raw, r, max_pairs)
        parts.append(found.select("_vid_", "val_idx", F.lit(i).alias("feat"), F.col("x").cast("double").alias("x")))
    return reduce(DataFrame.unionByName, parts) if parts else domain.select("_vid_", F.lit(0).alias("val_idx"), F.lit(0).alias("feat"), F.lit(0.0).alias("x")).limit(0)


def _count(cands: DataFrame, raw: DataFrame, r: Relaxed, max_pairs: int) -> DataFrame:
    """(_vid_, val_idx, x) of the candidates with violations."""
    used = sorted({a.name for q in r.dc.predicates for a in (q.left, q.right) if isinstance(a, Attribute)})
    own = raw.select(TID, *(F.col(f"`{c}`").alias(f"_1_{c}") for c in used))
    raw = raw.select(TID, *(F.col(f"`{c}`") for c in used))
    rows = by_cell(cands, own, TID)
    p = r.predicate
    mine = lambda a: F.col(f"`_1_{a.name}`")
    if len(r.dc.tuples) == 1 or all(q.tuples <= {r.role} for q in r.dc.predicates):
        right = F.lit(p.right.value) if isinstance(p.right, Literal) else mine(p.right)
        keep = reduce(lambda a, b: a & b, [q.column(mine) for q in r.others], apply(p.op, F.col("rv_val"), right))
        return rows.where(keep).select("_vid_", "val_idx", F.lit(1).alias("x"))
    if counts := by_counts(r):
        return counts(rows, raw)
    return pairwise(rows, raw, r, max_pairs)


def by_counts(r: Relaxed):
    """For equalities and one inequality, each of one attribute: counts of groups instead of pairs.

    With the inequality relaxed, a tuple of key a and a candidate v differ from
    n(a) - 1 - (n(a, v) - [own value is v]) others; with an equality relaxed, they agree with
    n(rest, v) - n(rest, v, b), where b is the tuple's own value of the inequality's attribute.
    """
    preds = r.dc.predicates
    same = all(len(q.tuples) == 2 and q.left.name == q.right.name for q in preds)  # type: ignore[union-attr]
    apart = [q for q in preds if q.op == "<>"]
    if not same or len(apart) != 1 or len(preds) < 2 or any(q.op not in ("=", "<>") for q in preds):
        return None
    b, relaxed = apart[0].left.name, r.predicate
    keys = [q.left.name for q in r.others if q.op == "="]

    def counted(raw: DataFrame, names: list[str], alias: str) -> DataFrame:
        return raw.groupBy(*(F.col(f"`{c}`").alias(f"_k_{i}") for i, c in enumerate(names))).agg(F.count("*").alias(alias))

    def run(rows: DataFrame, raw: DataFrame) -> DataFrame:
        keyed = rows.select("_vid_", "val_idx", "rv_val", F.col(f"`_1_{b}`").alias("_b"), *(F.col(f"`_1_{c}`").alias(f"_k_{i}") for i, c in enumerate(keys)))
        names = [f"_k_{i}" for i in range(len(keys))]
        v = f"_k_{len(keys)}"
        if relaxed.op == "<>":
            all_of, with_v = counted(raw, keys, "_n"), counted(raw, [*keys, b], "_m")
            out = by_value(by_value(keyed, all_of, names).withColumn(v, F.col("rv_val")), with_v, [*names, v], "left")
            x = F.col("_n") - 1 - (F.coalesce("_m", F.lit(0)) - (F.col("_b") == F.col("rv_val")).cast("long"))
        else:
            a = relaxed.left.name
            out = by_value(keyed.withColumn(v, F.col("rv_val")), counted(raw, [*keys, a], "_n"), [*names, v])
            w = f"_k_{len(keys) + 1}"
            out = by_value(out.withColumn(w, F.col("_b")), counted(raw, [*keys, a, b], "_m"), [*names, v, w], "left")
            x = F.col("_n") - F.coalesce("_m", F.lit(0))
        return out.select("_vid_", "val_idx", x.alias("x")).where("x > 0")

    return run


def pairwise(rows: DataFrame, raw: DataFrame, r: Relaxed, max_pairs: int) -> DataFrame:
    """Counts pairs by a join; only if ``max_pairs`` is set, it tells 0 from 1 without an equality and with more pairs."""
    other = next(t for t in r.dc.tuples if t != r.role)
    theirs = raw.select(*(F.col(f"`{c}`").alias(f"_2_{c}") for c in raw.columns))
    of = lambda a: F.col(f"`_{1 if a.tuple == r.role else 2}_{a.name}`")
    p = r.predicate
    right = F.lit(p.right.value) if isinstance(p.right, Literal) else of(p.right)
    on = [q.column(of) for q in r.others] + [apply(p.op, F.col("rv_val"), right), F.col(TID) != F.col(f"_2_{TID}")]
    equality = any(q.op == "=" and len(q.tuples) == 2 for q in r.others) or (p.op == "=" and isinstance(p.right, Attribute) and p.right.tuple == other)
    condition = reduce(lambda a, b: a & b, on)
    if max_pairs and not equality and p.tuples != {r.role} and rows.count() * raw.count() > max_pairs:
        return exists(rows, theirs, condition)
    return rows.join(theirs.hint("merge" if equality else "shuffle_replicate_nl"), condition).groupBy("_vid_", "val_idx").agg(F.count("*").alias("x"))


def exists(rows: DataFrame, theirs: DataFrame, condition) -> DataFrame:
    return rows.join(theirs, condition, "left_semi").select("_vid_", "val_idx", F.lit(1).alias("x")).distinct()


def unit_length(rows: DataFrame) -> DataFrame:
    """Each feature of a cell divided by its length over the candidates."""
    w = Window.partitionBy("_vid_", "feat")
    return rows.withColumn("x", F.col("x") / F.greatest(F.sqrt(F.sum(F.col("x") * F.col("x")).over(w)), F.lit(1e-12)))


def assemble(dataset, domain: DataFrame, featurizers: list[Featurizer]) -> tuple[DataFrame, list[FeatInfo]]:
    """All features, numbered one after the other, and what they are."""
    infos, parts, at = [], [], 0
    classes = domain.agg(F.max("domain_size")).first()[0] or 1
    for f in featurizers:
        f.setup(dataset)
        info = f.info()
        rows = f.rows(domain, classes).select("_vid_", "val_idx", "feat", F.col("x").cast("double").alias("x"))
        if dataset.config.feature_norm and not isinstance(f, InitAttrFeaturizer):
            rows = unit_length(rows)
        parts.append(rows.withColumn("feat", (F.col("feat") + at).cast("int")))
        infos.append(info)
        at += info.size
    return reduce(DataFrame.unionByName, parts).where("x <> 0"), infos


def weak_labels(domain: DataFrame, dk_cells: DataFrame) -> DataFrame:
    """(_vid_, label, is_clean): label -1 where there is none; not clean unless labelled and not suspected."""
    rows = by_cell(domain, dk_cells.select("_cid_", F.lit(True).alias("dk")), "_cid_", "left")
    labelled = (F.col("weak_label") != NULL) & (F.col("dk").isNull() | (F.col("fixed") != 0))
    return rows.select("_vid_", F.when(labelled, F.col("weak_label_idx")).otherwise(-1).alias("label"), (labelled & F.col("dk").isNull()).cast("int").alias("is_clean"))
