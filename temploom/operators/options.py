"""Miner configuration."""
from __future__ import annotations

from dataclasses import asdict, dataclass

from temploom.errors import InvalidConfig
from temploom.functions.masks import Mask


@dataclass(frozen=True)
class MinerOptions:
    sim_threshold: float = 0.4
    depth: int = 4
    max_clusters_per_leaf: int = 100
    parametrize_numeric_tokens: bool = True
    wildcard: str = "<*>"
    path_delimiters: str = ""
    first_line_path_delimiters: str = ""
    first_line_only: bool = False
    masks: tuple[Mask, ...] = ()

    def __post_init__(self) -> None:
        if self.depth < 2:
            raise InvalidConfig("depth must be at least 2")
        if not 0.0 <= self.sim_threshold <= 1.0:
            raise InvalidConfig("sim_threshold must lie in [0, 1]")
        if self.max_clusters_per_leaf < 1:
            raise InvalidConfig("max_clusters_per_leaf must be at least 1")

    @property
    def prefix_len(self) -> int:
        return self.depth - 2

    @property
    def active_delimiters(self) -> str:
        """The first-line set counts only in first-line mode and when it isn't empty."""
        return self.first_line_path_delimiters if self.first_line_only and self.first_line_path_delimiters else self.path_delimiters

    def to_json_dict(self) -> dict:
        """All options but the masks, which are never stored."""
        return {k: v for k, v in asdict(self).items() if k != "masks"}
