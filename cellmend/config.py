"""Settings of a repair session."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

#: The value that stands for a missing one inside the engine: it equals itself in constraints
#: and correlations, and is left out of statistics, domains and labels.
NULL = "_nan_"
TID = "_tid_"


@dataclass
class Config:
    """Each setting comes from its default, then the environment variable CELLMEND_<NAME>, then the argument."""

    seed: int = 45
    learning_rate: float = 0.001
    optimizer: str = "adam"
    epochs: int = 20
    weight_decay: float = 0.01
    momentum: float = 0.0
    batch_size: int = 1
    weak_label_thresh: float = 0.90
    domain_thresh_1: float = 0.1
    domain_thresh_2: float = 0.0
    max_domain: int = 1_000_000
    max_sample: int = 5
    cor_strength: float = 0.05
    nb_cor_strength: float = 0.3
    feature_norm: bool = True
    weight_norm: bool = False
    estimator: str = "naive_bayes"
    #: The logistic estimator's solver takes the full gradient, ten steps for each epoch; it has no batches.
    estimator_epochs: int = 3
    estimator_batch_size: int = 32
    #: "auto" and "exact": minibatches in cell order on the driver, which holds about max_exact
    #: feature rows at once (the results do not depend on it); "distributed": full batches on the cluster.
    trainer: str = "auto"
    max_exact: int = 2_000_000
    #: If set, the pairs that a constraint without an equality may compare; beyond, its feature is 0 or 1, not a count.
    max_pairs: int = 0
    #: Does a tuple violate a constraint with itself?
    self_pairs: bool = False
    verbose: bool = False
    #: A bias is the same for all candidates of a cell, so it cancels in the softmax: accepted, without effect.
    bias: bool = False
    print_fw: bool = False
    debug_path: str = ""

    @classmethod
    def of(cls, **given) -> Config:
        kinds = {f.name: type(f.default) for f in fields(cls)}
        if unknown := sorted(set(given) - set(kinds)):
            raise TypeError(f"unknown settings: {', '.join(unknown)}")
        values = {n: _typed(os.environ[f"CELLMEND_{n.upper()}"], k) for n, k in kinds.items() if f"CELLMEND_{n.upper()}" in os.environ}
        values |= {n: _typed(v, kinds[n]) for n, v in given.items()}
        return cls(**values)


def _typed(value, kind: type):
    if kind is bool and isinstance(value, str):
        if value.lower() in ("1", "true", "yes"):
            return True
        if value.lower() in ("0", "false", "no", ""):
            return False
        raise ValueError(f"not a truth value: {value!r}")
    return kind(value)
