"""Settings that are kept in a database's manifest, and the reports of its maintenance."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

from .errors import InvalidConfig

METRICS = ("cosine", "l2", "ip")


@dataclass
class IndexConfig:
    metric: str = "cosine"
    m: int = 16
    m0: int = 32
    ml: float = 1 / math.log(16)
    ef_construction: int = 200
    ef_search: int = 50
    mode: str = "graph"  # inert, kept for those that set it


@dataclass
class StorageConfig:
    fsync: bool = True
    snapshot_interval_sec: int = 3600  # inert


@dataclass
class QueryConfig:
    default_top_k: int = 10
    ef_search: int = 80  # inert: the default ef is that of the index
    exploration_factor: float = 1.1  # inert


@dataclass
class Config:
    dim: int
    index: IndexConfig = field(default_factory=IndexConfig)
    storage: StorageConfig = field(default_factory=StorageConfig)
    query: QueryConfig = field(default_factory=QueryConfig)

    def check(self) -> Config:
        if self.dim < 1:
            raise InvalidConfig("the embedding dimension must be at least 1")
        if self.index.metric not in METRICS:
            raise InvalidConfig(f"metric must be one of {METRICS}")
        return self

    def to_dict(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_dict(d: dict) -> Config:
        return Config(d["dim"], IndexConfig(**d["index"]), StorageConfig(**d["storage"]), QueryConfig(**d["query"])).check()


@dataclass
class OptimizeRequest:
    force_full_compaction: bool = True
    checkpoint_only: bool = False
    repair_indexes: bool = False
    indexes: bool = True  # keep postings and cells of the new version


@dataclass
class OptimizeReport:
    records_compacted: int = 0
    space_reclaimed_bytes: int = 0
    graph_edges_repaired: int = 0  # the number of records whose derived columns were made anew
