"""Every threshold of the engine, as one frozen value. `now` is injected; nothing reads the clock."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace
from datetime import datetime


@dataclass(frozen=True)
class Params:
    now: datetime = datetime(2024, 1, 31)
    # gate
    gate_min_len: int = 5
    gate_max_len: int = 300
    # channels
    vec_top_k: int = 20
    bm25_top_k: int = 20
    fused_top_k: int = 15
    rerank_top_k: int = 5
    vec_floor: float = 0.62
    legacy_vec_floor: float = 0.60
    bm25_floor: float = 0.62
    upper_floor: float = 0.62
    rerank_floor: float = 0.5
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_idf_floor: float = 0.25
    rank_order: str = "global"
    # fusion
    rrf_k: int = 60
    single_penalty: float = 0.7
    dual_boost: float = 1.8
    single_drop: float = 0.5
    rrf_entity_boost: float = 0.15
    graph_boost: float = 0.15
    importance_slope: float = 0.5
    decay_depth: float = 0.25
    decay_days: float = 540.0
    # graph
    entity_limit: int = 5
    neighbour_limit: int = 4
    kg_strong: float = 0.7
    kg_weak: float = 0.60
    kg_top: int = 5
    kg_weight: float = 0.61
    assoc_hops: int = 2
    assoc_neighbours: int = 6
    assoc_activation: float = 0.1
    assoc_decay: float = 0.5
    assoc_cap: int = 20
    alias_floor: float = 0.7
    # writing
    dedup_skip: float = 0.82
    dedup_update: float = 0.80
    candidate_floor: float = 0.80
    resolve_floor: float = 0.55
    cluster_floor: float = 0.90
    max_entity_len: int = 12
    token_ttl_seconds: int = 300
    repeat_seconds: int = 10
    inactivity_seconds: int = 180

    def with_(self, **changes) -> Params:
        return replace(self, **changes)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, default=str)

    @classmethod
    def from_env(cls, env: dict[str, str], prefix: str = "PALIMPSEST_") -> Params:
        """Environment values override defaults; booleans are 1/true/yes/on."""
        out = {}
        for f in fields(cls):
            value = env.get(prefix + f.name.upper())
            if value is None:
                continue
            kind = type(getattr(cls(), f.name))
            out[f.name] = value.lower() in ("1", "true", "yes", "on") if kind is bool else datetime.fromisoformat(value) if kind is datetime else kind(value)
        return cls(**out)


def env_list(value: str | None, default: list[str]) -> list[str]:
    """A list setting: split on newlines, else on commas."""
    if not value or not value.strip():
        return default
    return [x.strip() for x in value.split("\n" if "\n" in value else ",") if x.strip()]


DEFAULT = Params()
