"""Candidate values of cells, their posteriors, and weak labels."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import NULL, TID
from ..sources.tables import BROADCAST_VALUES, by_cell, by_value, cells
from . import stats

NOT_SET, WEAK_LABEL, SINGLE_VALUE = 0, 1, 2


def active_attributes(dk_cells: DataFrame) -> list[str]:
    """Attributes with a suspicious cell, sorted."""
    return [r[0] for r in dk_cells.select("attribute").distinct().orderBy("attribute").collect()]  # columns of one table


def cell_candidates(raw: DataFrame, attributes: list[str], active: list[str], pruned: DataFrame, edges: DataFrame) -> DataFrame:
    """(_tid_, attribute, init_value, domain): for all tuples and active attributes the sorted candidates.

    Candidates of a cell are the values that co-occur, after pruning, with the tuple's values of
    correlated attributes, and its own value. Lists are made for each (attribute, value) that
    gives candidates, before they meet the tuples.
    """
    wanted = edges.where(F.col("x").isin(active))
    given = pruned.join(F.broadcast(wanted), (F.col("a1") == F.col("y")) & (F.col("a2") == F.col("x")))  # an edge for each pair of attributes
    given = given.groupBy(F.col("a1").alias("at"), F.col("v1").alias("value"), "x").agg(F.collect_set("v2").alias("some"))
    context = cells(raw, attributes).where(F.col("value") != NULL).withColumnRenamed("attribute", "at")
    found = context.join(given, ["at", "value"]).groupBy(TID, F.col("x").alias("attribute")).agg(F.array_distinct(F.flatten(F.collect_list("some"))).alias("some"))
    own = cells(raw, active).withColumnRenamed("value", "init_value")
    init = F.when(F.col("init_value") != NULL, F.array("init_value")).otherwise(F.array().cast("array<string>"))
    some = F.coalesce("some", F.array().cast("array<string>"))
    return by_cell(own, found, [TID, "attribute"], "left").select(TID, "attribute", "init_value", F.array_sort(F.array_union(some, init)).alias("domain"))


def numbered_values(single: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attribute, at, value): the values of each attribute numbered from 0, and (attribute, n_values).

    Numbers go by hash buckets, so that no task sorts all values of an attribute.
    """
    values = stats.frequencies(single).select("attribute", "value", F.pmod(F.xxhash64("value"), F.lit(256)).alias("b"))
    per = values.groupBy("attribute", "b").agg(F.count("*").alias("c"))  # 256 rows for each attribute at most
    before = per.select("attribute", "b", (F.sum("c").over(Window.partitionBy("attribute").orderBy("b")) - F.col("c")).alias("before"))
    at = F.row_number().over(Window.partitionBy("attribute", "b").orderBy("value")) - 1 + F.col("before")
    return values.join(F.broadcast(before), ["attribute", "b"]).select("attribute", at.alias("at"), "value"), per.groupBy("attribute").agg(F.sum("c").alias("n_values"))


def drawn_values(lone: DataFrame, single: DataFrame, seed: int, k: int) -> DataFrame:
    """(_cid_, drawn): for each cell ``k`` different values of its attribute, all of them where there are no more.

    Every set of values is as likely (Floyd's sampling of their numbers, by a hash of seed, cell and step).
    """
    values, sizes = numbered_values(single)
    values = F.broadcast(values) if stats.frequencies(single).count() <= BROADCAST_VALUES else values
    n = F.col("n_values")
    pick = lambda j: F.pmod(F.xxhash64(F.lit(seed), F.col("_cid_"), j), j + 1)
    add = lambda have, j: F.concat(have, F.array(F.when(F.array_contains(have, pick(j)), j).otherwise(pick(j))))
    steps = F.sequence(F.greatest(n - k, F.lit(0)), n - 1)
    places = F.aggregate(steps, F.array().cast("array<bigint>"), add)
    rows = lone.select("_cid_", "attribute").join(F.broadcast(sizes), "attribute")  # a row for each attribute
    rows = rows.select("_cid_", "attribute", F.explode(places).alias("at"))
    return rows.join(values, ["attribute", "at"]).groupBy("_cid_").agg(F.collect_set("value").alias("drawn"))


def fill_domains(found: DataFrame, single: DataFrame, seed: int, max_sample: int) -> DataFrame:
    """Adds random values to domains of one candidate; ``fixed`` tells which.

    The value itself comes first, the sample sorted after it. Cells with neither value nor
    candidates, and those for which there is nothing to draw, are left out. Each cell draws from all
    values of its attribute, by hashes of seed and cell, so the draw is the same in every run.
    """
    alone = F.size("domain") <= 1
    # two more than needed: the candidate and the value itself may be drawn
    rows = by_cell(found, drawn_values(found.where(F.size("domain") == 1), single, seed, max_sample + 2), "_cid_", "left")
    rest = F.array_except(F.coalesce("drawn", F.array().cast("array<string>")), F.concat("domain", F.array("init_value")))
    drawn = F.transform(F.slice(F.array_sort(F.transform(rest, lambda v: F.struct(F.xxhash64(F.lit(seed), F.col("_cid_"), v).alias("h"), v.alias("v")))), 1, max_sample), lambda s: s["v"])
    rows = rows.withColumn("sample", F.when(alone, F.array_sort(drawn)))
    rows = rows.where(~alone | ((F.size("domain") == 1) & (F.size("sample") > 0)))
    return rows.select(TID, "attribute", "_cid_", "init_value", F.when(alone, F.concat("domain", "sample")).otherwise(F.col("domain")).alias("domain"), F.when(alone, SINGLE_VALUE).otherwise(NOT_SET).alias("fixed"))


def _finish(rows: DataFrame) -> DataFrame:
    """The columns of cell_domain; a cell's variable id is its cell id."""
    index = lambda v: (F.array_position("domain", F.col(v)) - 1).cast("int")
    return rows.select(
        TID, "attribute", "_cid_", F.col("_cid_").alias("_vid_"), "domain", F.size("domain").alias("domain_size"), "init_value",
        F.coalesce(index("init_value"), F.lit(-1)).alias("init_index"), "weak_label", F.coalesce(index("weak_label"), F.lit(-1)).alias("weak_label_idx"), "fixed",
    )


def initial_domain(filled: DataFrame) -> DataFrame:
    return _finish(filled.withColumn("weak_label", F.col("init_value")))


def candidates(domain: DataFrame) -> DataFrame:
    """One row for each (cell, candidate); val_idx counts from 0."""
    return domain.select("*", F.posexplode("domain").alias("val_idx", "rv_val"))


def pos_values(domain: DataFrame) -> DataFrame:
    return candidates(domain).select("_vid_", "_cid_", TID, "attribute", "rv_val", (F.col("val_idx") + 1).alias("val_id"))


def domain_info(domain: DataFrame) -> DataFrame:
    return domain.agg(F.count("_vid_").alias("n_vars"), F.coalesce(F.max("domain_size"), F.lit(0)).alias("max_domain"))


class Estimator(ABC):
    """Gives (_vid_, val_idx, p) of each candidate."""

    @abstractmethod
    def train(self, domain: DataFrame) -> None: ...

    @abstractmethod
    def predict(self, domain: DataFrame) -> DataFrame: ...


class NaiveBayes(Estimator):
    """p(v) ~ freq(v)/N * prod over correlated attributes of max(n(v, other value) - 1, 0.1) / freq(v)."""

    def __init__(self, raw: DataFrame, attributes: list[str], single: DataFrame, pairs: DataFrame, edges: DataFrame, n_rows: int):
        self.raw, self.attributes, self.single, self.pairs, self.edges, self.n_rows = raw, attributes, single, pairs, edges, n_rows

    def train(self, domain: DataFrame) -> None:
        """The counts are the model."""

    def predict(self, domain: DataFrame) -> DataFrame:
        rows = candidates(domain).select("_vid_", TID, "attribute", "val_idx", "rv_val")
        freq = stats.frequencies(self.single).select("attribute", F.col("value").alias("rv_val"), F.col("n").alias("freq"))
        rows = by_value(rows, freq, ["attribute", "rv_val"])
        edges = F.broadcast(self.edges.select(F.col("x").alias("attribute"), F.col("y").alias("at")))  # pairs of attributes
        context = cells(self.raw, self.attributes).where(F.col("value") != NULL).withColumnRenamed("attribute", "at")
        both = stats.co_occurrences(self.pairs).select(F.col("a1").alias("attribute"), F.col("v1").alias("rv_val"), F.col("a2").alias("at"), F.col("v2").alias("value"), "n")
        seen = by_value(by_cell(rows.join(edges, "attribute"), context, [TID, "at"]), both, ["attribute", "rv_val", "at", "value"], "left")
        less = F.greatest(F.coalesce(F.col("n") - 1, F.lit(0)).cast("double"), F.lit(0.1))
        part = seen.groupBy("_vid_", "val_idx").agg(F.sum(F.log(less) - F.log("freq")).alias("s"))
        logp = F.log(F.col("freq") / self.n_rows) + F.coalesce("s", F.lit(0.0))
        scored = by_cell(rows, part, ["_vid_", "val_idx"], "left").select("_vid_", "val_idx", logp.alias("score"))
        return softmax(scored).withColumnRenamed("prob", "p")


def softmax(scored: DataFrame) -> DataFrame:
    """(_vid_, val_idx, prob) from (_vid_, val_idx, score), stable for any scores."""
    cell = Window.partitionBy("_vid_")
    e = scored.withColumn("e", F.exp(F.col("score") - F.max("score").over(cell)))
    return e.select("_vid_", "val_idx", (F.col("e") / F.sum("e").over(cell)).alias("prob"))


def reprune(domain: DataFrame, posterior: DataFrame, thresh: float, max_domain: int, weak_label_thresh: float) -> DataFrame:
    """Keeps the likeliest candidates of each cell and the initial one, and sets weak labels.

    Candidates below ``thresh`` go, unless all are; of the others the ``max_domain`` of largest
    posterior stay (ties by position). The likeliest (ties: the first) becomes the weak label
    if it is not the initial value and its posterior is at least ``weak_label_thresh``.
    """
    single = domain.where(F.col("fixed") == SINGLE_VALUE)
    rows = by_cell(candidates(domain.where(F.col("fixed") != SINGLE_VALUE)), posterior, ["_vid_", "val_idx"])
    per = rows.groupBy("_vid_").agg(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("q"), "val_idx", F.col("rv_val").alias("v")))).alias("ranked"))
    good = F.filter("ranked", lambda s: -s["q"] >= thresh)
    good = F.when(F.size(good) > 0, good).otherwise(F.col("ranked"))
    top = F.get("ranked", F.lit(0))
    kept = F.transform(F.slice(good, 1, max_domain), lambda s: s["v"])
    init = F.when(F.col("init_value") != NULL, F.array("init_value")).otherwise(F.array().cast("array<string>"))
    strong = (top["v"] != F.col("init_value")) & (-top["q"] >= weak_label_thresh)
    rows = by_cell(domain.where(F.col("fixed") != SINGLE_VALUE).drop("domain", "weak_label", "fixed"), per, "_vid_")
    rows = rows.select(TID, "attribute", "_cid_", "init_value", F.array_sort(F.array_union(kept, init)).alias("domain"), F.when(strong, top["v"]).otherwise(F.col("init_value")).alias("weak_label"), F.when(strong, WEAK_LABEL).otherwise(NOT_SET).alias("fixed"))
    return _finish(rows).unionByName(single.select(*_finish(rows).columns))


class Logistic(Estimator):
    """A logistic regression on co-occurrence features of whether a candidate is the initial value."""

    def __init__(self, featurizer, n_features: int, epochs: int = 20):
        self.featurizer, self.n_features, self.epochs, self.model = featurizer, n_features, epochs, None

    def _vectors(self, domain: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        rows = candidates(domain).select("_vid_", "val_idx", "rv_val", "init_value")
        x = self.featurizer(domain).groupBy("_vid_", "val_idx").agg(F.map_from_entries(F.collect_list(F.struct("feat", "x"))).alias("m"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(self.n_features - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
        none = F.array_repeat(F.lit(0.0), self.n_features)
        rows = by_cell(rows, x, ["_vid_", "val_idx"], "left")
        return rows.withColumn("features", array_to_vector(F.when(F.col("m").isNull(), none).otherwise(dense))).withColumn("label", (F.col("rv_val") == F.col("init_value")).cast("double"))

    def train(self, domain: DataFrame) -> None:
        from pyspark.ml.classification import LogisticRegression

        rows = self._vectors(domain.where(F.col("init_value") != NULL))
        self.model = LogisticRegression(regParam=0.0, maxIter=self.epochs).fit(rows.select("features", "label"))

    def predict(self, domain: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        return self.model.transform(self._vectors(domain)).select("_vid_", "val_idx", vector_to_array("probability")[1].alias("p"))
