"""Thresholds and sizes of the fact pipeline."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Defaults of every tunable; ``from_toml`` overlays any of them by name."""

    drop_below: float = 0.60
    accept_from: float = 0.85
    duplicate_above: float = 0.85
    supersede_from: float = 0.70
    supersede_below: float = 0.85
    demote_below: float = 0.75
    min_human_turns: int = 4
    chunk_max_tokens: int = 4000
    chunk_overlap_tokens: int = 200
    promote_projects: int = 3
    synthesis_facts: int = 3
    cluster_from: float = 0.75
    max_cluster: int = 10
    dim: int = 768
    tool_result_bytes: int = 500
    code_block_lines: int = 20
    overlap_paragraphs: int = 5
    curation_tail_bytes: int = 24_000
    list_limit: int = 20
    search_limit: int = 10
    recall_limit: int = 5

    @classmethod
    def from_toml(cls, path: str | Path) -> Settings:
        """Values from the tables of a TOML file, whatever their nesting; unknown names are ignored."""
        flat: dict = {}

        def walk(table: dict) -> None:
            for k, v in table.items():
                walk(v) if isinstance(v, dict) else flat.__setitem__(k, v)

        walk(tomllib.loads(Path(path).read_text()))
        known = {f.name for f in fields(cls)}
        return replace(cls(), **{k: v for k, v in flat.items() if k in known})
