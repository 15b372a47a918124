"""A repair session: load, detect, propose, learn, repair, evaluate."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import TID, Config
from .operators import domain as dom
from .operators import evaluate as ev
from .operators import features as feats
from .operators import model, repair, stats
from .operators.detect import Detector, detect_errors
from .plans.constraints import Constraint, parse
from .sources import tables
from .sources.workspace import Workspace

log = logging.getLogger(__name__)


class Dataset:
    """The raw table of a session, its constraints, and statistics that are counted once.

    Each kept table is written once to the shared folder and read from there, so that no
    plan holds those of the steps before it.
    """

    def __init__(self, raw: DataFrame, config: Config, exclude: tuple[str, ...] = ()):
        self.config = config
        self.raw = raw
        self.attributes = [c for c in raw.columns if c != TID and c not in exclude]
        self.constraints: list[Constraint] = []
        self._kept: dict[str, DataFrame] = {}
        self._work: Workspace | None = None

    def keep(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._kept:
            self._work = self._work or Workspace(self.raw.sparkSession, "dataset")
            self._kept[name] = self._work.keep(make(), name)
        return self._kept[name]

    def forget(self) -> None:
        """Delete the kept tables; nothing that reads them can be used afterwards."""
        if self._work:
            self._work.close()
        self._kept.clear()

    @property
    def single(self) -> DataFrame:
        return self.keep("single", lambda: stats.single_counts(self.raw, self.attributes))

    @property
    def pairs(self) -> DataFrame:
        return self.keep("pairs", lambda: stats.pair_counts(self.raw, self.attributes))

    @property
    def corr(self) -> DataFrame:
        return self.keep("corr", lambda: stats.correlations(self.single, self.pairs, self.n_rows))

    @property
    def n_rows(self) -> int:
        if not hasattr(self, "_n"):
            self._n = self.raw.count()
        return self._n

    def attribute_index(self, attribute: Column) -> Column:
        """The place of an attribute in the table, as an expression."""
        return (F.array_position(F.array(*map(F.lit, self.attributes)), attribute) - 1).cast("int")

    def cell_id(self, tid: Column, attribute: Column) -> Column:
        return tid * len(self.attributes) + self.attribute_index(attribute)


class RepairSession:
    """Steps of a repair, each needing those before it.

    >>> session = RepairSession(spark, epochs=10)
    >>> session.load_data("hospital", path="hospital.csv")
    >>> session.load_dcs(path="constraints.txt")
    >>> session.detect_errors([NullDetector(), ViolationDetector()])
    >>> session.setup_domain()
    >>> session.repair_errors([InitAttrFeaturizer(), OccurAttrFeaturizer(), FreqFeaturizer(), ConstraintFeaturizer()])
    >>> session.evaluate(truth, "tid", "attribute", "correct_val")
    """

    def __init__(self, spark: SparkSession, **settings):
        self.spark, self.config = spark, Config.of(**settings)
        self.dataset: Dataset | None = None

    def _need(self) -> Dataset:
        if self.dataset is None:
            raise RuntimeError("no data is loaded")
        return self.dataset

    def load_data(self, name: str, path: str | None = None, df: DataFrame | None = None, na_values=None, entity_col: str | None = None, src_col: str | None = None) -> DataFrame:
        """Load a CSV file or a DataFrame (whose columns become text) as the table ``name``.

        ``entity_col`` gives tuple ids; ``src_col`` is kept but is no attribute. Without tuple ids the
        prepared input is written before its rows are numbered, so that numbers cannot change
        with another evaluation of the source.
        """
        exclude = tuple(c for c in (src_col,) if c)
        raw = tables.read_csv(self.spark, path, na_values, (TID, *exclude)) if path else tables.prepare(df, na_values, (TID, *exclude))
        work = Workspace(self.spark, "input")
        if TID not in raw.columns:
            raw = tables.with_tids(work.keep(raw, "rows"), entity_col)
        raw = tables.fill(raw).withColumn(TID, F.col(TID).cast("long"))
        self.name = name
        self.dataset = Dataset(raw, self.config, exclude)
        self.dataset.raw = self.dataset.keep("raw", lambda: raw)
        work.close()
        self.dataset.raw.createOrReplaceTempView(name)
        return self.dataset.raw

    def get_raw_data(self) -> DataFrame:
        return self._need().raw

    def get_attributes(self) -> list[str]:
        return list(self._need().attributes)

    def load_dcs(self, path: str | None = None, lines: list[str] | None = None) -> list[Constraint]:
        lines = lines if lines is not None else tables.constraint_lines(self.spark, path)
        self._need().constraints = [parse(x, self.dataset.attributes) for x in lines]
        return self.dataset.constraints

    def get_dcs(self) -> list[Constraint]:
        return self._need().constraints

    def set_constraints(self, constraints: list[Constraint]) -> None:
        self._need().constraints = list(constraints)

    def detect_errors(self, detectors: list[Detector]) -> DataFrame:
        """(_tid_, attribute, _cid_) of the suspected cells; it is an error if there are none."""
        self.dk_cells = self._need().keep("dk_cells", lambda: detect_errors(self.dataset, detectors))
        if not self.dk_cells.limit(1).count():
            raise ValueError("no cell is suspected: there is nothing to repair")
        return self.dk_cells

    def setup_domain(self) -> DataFrame:
        d, c = self._need(), self.config
        active = dom.active_attributes(self.dk_cells)
        pruned = stats.pruned_pairs(d.pairs, d.single, c.domain_thresh_1)
        found = dom.cell_candidates(d.raw, d.attributes, active, pruned, stats.correlated(d.corr, c.cor_strength))
        found = found.withColumn("_cid_", d.cell_id(F.col(TID), F.col("attribute")))
        first = d.keep("first_domain", lambda: dom.initial_domain(dom.fill_domains(found, d.single, c.seed, c.max_sample)))
        if c.weak_label_thresh == 1 and c.domain_thresh_2 == 0:
            self.domain = first
        else:
            if c.estimator == "naive_bayes":
                estimator: dom.Estimator = dom.NaiveBayes(d.raw, d.attributes, d.single, d.pairs, stats.correlated(d.corr, c.nb_cor_strength), d.n_rows)
            elif c.estimator == "logistic":
                occur = feats.OccurAttrFeaturizer()
                occur.setup(d)
                estimator = dom.Logistic(lambda x: occur.rows(x, 1), len(d.attributes) ** 2, c.estimator_epochs * 10)
            else:
                raise ValueError(f"estimator is naive_bayes or logistic, not {c.estimator!r}")
            estimator.train(first)
            posterior = d.keep("posterior", lambda: estimator.predict(first))
            self.domain = d.keep("domain", lambda: dom.reprune(first, posterior, c.domain_thresh_2, c.max_domain, c.weak_label_thresh))
        if not self.domain.limit(1).count():
            raise ValueError("no cell has a candidate value: prune less or load more data")
        self.domain.createOrReplaceTempView("cell_domain")
        dom.pos_values(self.domain).createOrReplaceTempView("pos_values")
        return self.domain

    def repair_errors(self, featurizers: list[feats.Featurizer]) -> list[dict] | None:
        """Learn, infer and repair; the report of weights if the settings ask for it."""
        d, c = self._need(), self.config
        rows, infos = feats.assemble(d, self.domain, featurizers)
        rows = d.keep("features", lambda: rows)
        if c.debug_path:
            rows.write.mode("overwrite").parquet(f"{c.debug_path}/train_features")
        labels = d.keep("labels", lambda: feats.weak_labels(self.domain, self.dk_cells))
        self.weights = model.fit(rows, self.domain, labels, infos, c)
        if c.verbose:
            for i, (loss, accuracy) in enumerate(self.weights.history):
                log.info("epoch %d: loss %.6f, accuracy %.4f", i + 1, loss, accuracy)
        targets = self.domain.join(labels.where("is_clean = 0").select("_vid_"), "_vid_", "left_semi")
        probs = d.keep("probs", lambda: model.predict(rows, targets, self.weights.used(c.weight_norm)))
        self.cell_distr = repair.distributions(probs)
        self.inferred = d.keep("inferred", lambda: repair.inferred_values(probs, targets))
        self.inferred_cells = d.keep("inferred_cells", lambda: repair.inferred_cells(targets, self.inferred))
        self.repaired = repair.repaired(d.raw, self.inferred_cells, d.attributes)
        self.repaired.createOrReplaceTempView(f"{self.name}_repaired")
        return self.weights.report() if c.print_fw else None

    def save_repaired(self, path: str) -> None:
        self.repaired.write.mode("overwrite").parquet(path)

    def evaluate(self, truth: str | DataFrame, tid_col: str, attr_col: str, val_col: str, na_values=None) -> ev.EvalReport:
        """Compare with a long table of true values, a CSV file or a DataFrame."""
        raw = tables.read_csv(self.spark, truth, na_values, clean=False) if isinstance(truth, str) else truth
        self.truth = tables.ground_truth(raw, tid_col, attr_col, val_col, na_values)
        d = self._need()
        report = ev.report(d.raw, d.attributes, self.domain, self.dk_cells, self.truth, self.inferred_cells)
        if self.config.verbose:
            log.info("weak labels:\n%s", ev.weak_label_stats(self.domain, self.dk_cells, self.truth, self.inferred_cells).orderBy("is_clean", "cell_status").toPandas().to_string())
        return report

    def close(self) -> None:
        if self.dataset:
            self.dataset.forget()
