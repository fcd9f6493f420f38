"""Settings: defaults, and a file or mapping that overrides them."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field

from loomwright.functions import rules as R


@dataclass(frozen=True)
class Segmentation:
    weights: tuple[float, float, float] = R.SEGMENT_WEIGHTS
    threshold: float = R.SEGMENT_THRESHOLD
    weak: float = R.WEAK
    weak_gap: int = R.WEAK_GAP
    least_actions: int = 2


@dataclass(frozen=True)
class Graph:
    document_order: bool = True
    numbered_steps: bool = True
    discourse: bool = True


@dataclass(frozen=True)
class Similarity:
    pair_weights: tuple[float, float, float] = (0.4, 0.4, 0.2)
    query_weights: tuple[float, float] = (0.6, 0.4)
    cluster_threshold: float = R.CLUSTER_THRESHOLD
    gap: float = R.ALIGN_GAP
    graph_width: int = 24
    graph_nodes: int = 25


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 5
    min_score: float = 0.25
    evidence: int = 8


@dataclass(frozen=True)
class Settings:
    segmentation: Segmentation = field(default_factory=Segmentation)
    graph: Graph = field(default_factory=Graph)
    similarity: Similarity = field(default_factory=Similarity)
    retrieval: Retrieval = field(default_factory=Retrieval)
    duplicate_cosine: float = 0.9
    list_separators: int = 3
    embed_dim: int = R.EMBED_DIM


def _merge(into, values: dict):
    if not isinstance(values, dict):
        raise ValueError(f"{type(into).__name__} wants a mapping, not {type(values).__name__}")
    known = {f.name: getattr(into, f.name) for f in dataclasses.fields(into)}
    unknown = values.keys() - known.keys()
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return dataclasses.replace(into, **{k: _merge(known[k], v) if dataclasses.is_dataclass(known[k]) else tuple(v) if isinstance(known[k], tuple) else v for k, v in values.items()})


def load(path: str | None = None, values: dict | None = None) -> Settings:
    """Defaults, overridden by a YAML file (an empty one overrides nothing) and then by ``values``."""
    settings = Settings()
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            settings = _merge(settings, yaml.safe_load(f) or {})
    return _merge(settings, values or {})
