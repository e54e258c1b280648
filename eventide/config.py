"""Parameters of a cohort run."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class CohortConfig:
    """Defaults are those of production runs; tests and oracle queries lower the caps so that they bind on small tables.

    Three rules say what is terminal: ``entity_terminal`` (a regular expression, found anywhere) makes an entity positive,
    ``row_terminal`` (an exact event) labels and trims rows, and events that equal it in upper case are never features.
    ``exclude_terminal_like_features`` also bars what matches ``entity_terminal``; ``keep_presence`` keeps entity-periods
    without a retained event as rows of zeros. Both are off by default.
    """

    cap_positive: int = 5_000
    cap_negative: int = 5_000
    max_rows: int = 10_000
    candidates: int = 3_000
    top_k: int = 500
    seed: int = 42
    test_percent: int = 10
    forced_periods: tuple[int, ...] = tuple(range(1997, 2007))
    entity_terminal: str = "(?i)DEATH"
    row_terminal: str = "DEATH"
    exclude_terminal_like_features: bool = False
    keep_presence: bool = False

    def fingerprint(self) -> str:
        return hashlib.sha256(repr(sorted(asdict(self).items())).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class BoostingConfig:
    """Gain ranking by trees grown leaf by leaf."""

    rounds: int = 200
    leaves: int = 64
    step_size: float = 0.1
    min_rows: int = 20
    min_hessian: float = 1e-3
    max_bins: int = 255
    #: Tasks that train together; 0: one for each ``task_cells`` counts, as far as there are slots, of ``task_bytes`` at most.
    tasks: int = 0
    task_cells: int = 1 << 20
    task_bytes: int = 256 << 20


@dataclass(frozen=True)
class EmbeddingConfig:
    """A network with one hidden layer of ``width``, whose activations are the embeddings."""

    width: int = 192
    folds: int = 10
    epochs: int = 200
    rate: float = 1e-2
    weight_decay: float = 1e-4
    seed: int = 42
    tasks: int = 0
    task_rows: int = 512
    task_bytes: int = 256 << 20


@dataclass(frozen=True)
class AutoencoderConfig:
    factor: float = 1.5
    epochs: int = 10_000
    rate: float = 1e-3
    weight_decay: float = 0.0
    alpha: float = 5e-4
    seed: int = 42
    #: Tasks that train together; 0: one for each ``task_rows`` rows, as far as there are slots, of ``task_bytes`` at most.
    tasks: int = 0
    task_rows: int = 512
    task_bytes: int = 256 << 20
    keep_every: int = 2_500

    def fingerprint(self) -> str:
        """Of what decides about the result."""
        own = {k: v for k, v in asdict(self).items() if k not in ("tasks", "task_rows", "task_bytes", "keep_every", "epochs")}
        return hashlib.sha256(repr(sorted(own.items())).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class TreeConfig:
    """The grid that each unit's tree is chosen from, by mean f1 over ``folds``."""

    max_depths: tuple[int, ...] = (5, 6, 7, 8, 9)
    balanced: tuple[bool, ...] = (True, False)
    impurities: tuple[str, ...] = ("gini", "entropy")
    min_rows: int = 50
    max_leaves: int = 8
    folds: int = 5
    least_f1: float = 0.5

    def grid(self) -> list[dict]:
        return [{"balanced": b, "impurity": i, "max_depth": d, "min_rows": self.min_rows, "max_leaves": self.max_leaves} for b in self.balanced for i in self.impurities for d in self.max_depths]

    def fingerprint(self) -> str:
        return hashlib.sha256(repr(sorted(asdict(self).items())).encode()).hexdigest()[:16]
