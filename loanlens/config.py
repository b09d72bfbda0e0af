"""Column roles and run settings.

The reference keeps these as module globals edited by hand; here they are
plain frozen dataclasses passed to every operator.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class RiskSchema:
    """Roles of the columns of one loan table.

    ``numeric`` lists every numeric column in table order, the two targets
    included (profiling reports them); ``features`` drops the targets.
    """

    flag: str
    amount: str
    categorical: tuple[str, ...]
    numeric: tuple[str, ...]
    key: str = "k"

    @property
    def targets(self) -> tuple[str, str]:
        return (self.flag, self.amount)

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(c for c in self.numeric if c not in self.targets)

    @staticmethod
    def hmeq() -> "RiskSchema":
        """The home-equity loan table the reference was written for."""
        # Column names of the reference input table.
        return RiskSchema(
            flag="TARGET_BAD_FLAG",
            amount="TARGET_LOSS_AMT",
            categorical=("REASON", "JOB"),
            numeric=(
                "TARGET_BAD_FLAG", "TARGET_LOSS_AMT", "LOAN", "MORTDUE", "VALUE",
                "YOJ", "DEROG", "DELINQ", "CLAGE", "NINQ", "CLNO", "DEBTINC",
            ),
            key="k",
        )

    @staticmethod
    def risk_frame() -> "RiskSchema":
        """The stand-in loan table derived from the TPC-H-like test tables."""
        return RiskSchema(
            flag="target_flag",
            amount="target_amt",
            categorical=("reason", "job"),
            numeric=(
                "target_flag", "target_amt", "loan", "quantity", "acctbal",
                "retailprice", "psize", "discount",
            ),
            key="k",
        )


@dataclass(frozen=True)
class RunConfig:
    """Settings of one run (the reference's main, tuning and network settings)."""

    seed: int = 1
    folds: int = 5
    max_depth: int = 5
    test_fraction: float = 0.2
    cap: float = 25_000.0
    feature_thresh: float = 0.05
    feature_thresh_dl: float = 0.005
    max_stepwise: int = 10
    # tree ensembles
    num_trees: int = 100
    boost_iters: int = 100
    step_size: float = 0.1
    max_bins: int = 256
    # networks
    epochs_classifier: int = 100
    epochs_regressor: int = 800
    dropout: float = 0.2
    activations: tuple[str, ...] = ("relu", "sigmoid", "tanh")
    hidden_layers: tuple[int, ...] = (1, 2)
    dropouts: tuple[bool, ...] = (True, False)
    scale_target: bool = True
    # evaluation
    drop_intermediate: bool = True
    # quantiles: "distributed" (exact, radix selection), "exact" (one aggregate), "approx"
    quantile_method: str = "distributed"
    quantile_accuracy: int = 100_000
    # "hash": one shared row-local split; "separate": a hash split per task;
    # "exact": ceil(test_fraction * n) test rows of each task's population
    split_mode: str = "hash"
    # preparation: fit medians / levels on the training split only (PRE10)
    fit_on_train: bool = False
    grid: dict = field(default_factory=lambda: dict(DEFAULT_GRID))

    def with_(self, **kw) -> "RunConfig":
        return replace(self, **kw)


# The reference's tuning grids (parameter names mapped to Spark ML).
DEFAULT_GRID = {
    "tree": {"maxDepth": [3, 5], "minInstancesPerNode": [1, 2]},
    "forest": {"maxDepth": [3, 5], "numTrees": [100, 200], "bootstrap": [True, False]},
    "boost": {"maxDepth": [3, 5], "maxIter": [100, 200], "stepSize": [0.01, 0.1]},
}
