"""Column names, limits and model settings in one immutable object."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


def _folder(name: str, default: str) -> str:
    return os.environ.get(name, default)


@dataclass(frozen=True)
class Settings:
    entity_id: str = "entity_id"
    name: str = "business_name"
    address: str = "business_address"
    country: str = "country"
    name_norm: str = "name_norm"
    address_norm: str = "address_norm"
    country_norm: str = "country_norm"
    left_id: str = "source1_entity_id"
    right_id: str = "candidate_entity_id"
    matches: str = "matched_entity_ids"
    common_key_cap: int = 200  # candidate rows of a key beyond which the capped strategies leave it out
    top_k: int = 50
    grams: tuple[int, ...] = (3, 4, 5)
    bucket_chars: int = 2
    beta: float = 0.5
    val_fraction: float = 0.15
    negatives_per_positive: float = 4.0
    hard_share: float = 0.5
    seed: int = 42
    max_iter: int = 400
    max_depth: int = 6
    step_size: float = 0.05
    subsampling: float = 0.8
    split_universe: str = "labeled"  # or "all_s1"
    data_dir: str = field(default_factory=lambda: _folder("TESSERA_DATA_DIR", "data"))
    output_dir: str = field(default_factory=lambda: _folder("TESSERA_OUTPUT_DIR", "output"))
    predictions_name: str = "matching_results.tsv"
    candidates_name: str = "candidate_pairs.tsv"

    @property
    def directory_columns(self) -> list[str]:
        return [self.entity_id, self.name, self.address, self.country]

    @property
    def truth_columns(self) -> list[str]:
        return [self.left_id, self.matches]


DEFAULTS = Settings()

#: Words dropped from the end of a name when asked for, and spellings of countries.
LEGAL_SUFFIXES = ["inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "pvt", "private", "plc"]
COUNTRY_ALIASES = {"us": "us", "usa": "us", "united states": "us", "united states of america": "us", "in": "in", "india": "in", "fr": "fr", "france": "fr"}
