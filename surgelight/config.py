"""Settings of the pipeline, with the meaning and the defaults of the configuration file."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from typing import Any


@dataclass(frozen=True)
class TokenFilters:
    """Rules for cleaned tokens; 0 or False turns a rule off."""

    enabled: bool = True
    max_length: int = 30
    min_character_diversity: float = 0.3
    min_character_diversity_lower_limit: int = 8
    max_character_repetition: float = 0.5
    max_case_alternations: float = 0.4
    max_number_letter_mix: float = 0.3
    reject_hashtags: bool = True
    reject_urls: bool = True
    reject_all_caps_long: bool = True
    all_caps_lower_limit: int = 5
    remove_urls: bool = True


@dataclass(frozen=True)
class Settings:
    #: Tokens of the frequency window.
    window: int = 2_000_000
    #: Token files that make up the window.
    token_persist_files: int = 20
    #: Files between two rebuilds of the frequency classes.
    rebuild_every_files: int = 10
    #: Messages of a batch.
    batch: int = 15_000
    #: Batches of the window of recent messages.
    window_batches: int = 3
    freq_classes: int = 7
    #: Length of the counter arrays, the modulus of the key parts.
    bw_array_len: int = 1000
    z_score: float = 3.5
    min_token_len: int = 2
    #: Classes (from 0) in which no busy words are looked for.
    skip_frequency_classes: tuple[int, ...] = ()
    min_count_threshold: int = 0
    #: "skip": tokens without a class are not counted; "least_frequent": they belong to the last class.
    unknown_tokens: str = "skip"
    #: "sliding": the window covers the last files; "as_coded": new minus old use since the last rebuild, never below 0.
    window_mode: str = "sliding"
    token_filters: TokenFilters = field(default_factory=TokenFilters)
    filter_file: str | None = None
    state_dir: str = "state"
    log_dir: str = "logs"

    def __post_init__(self) -> None:
        if not self.log_dir:
            raise ValueError("log_dir must not be empty")
        if self.freq_classes <= 0:
            raise ValueError("freq_classes must be positive")
        if self.token_persist_files <= 0 or self.batch <= 0 or self.bw_array_len <= 0:
            raise ValueError("token_persist_files, batch and bw_array_len must be positive")

    @property
    def file_tokens(self) -> int:
        return max(1, self.window // self.token_persist_files)

    @classmethod
    def of(cls, values: dict[str, Any]) -> Settings:
        """From the nested mapping of a configuration file; unknown keys are ignored, as they are read by no stage."""
        known = {f.name for f in fields(cls)}
        out = {k: v for k, v in values.items() if k in known and v is not None and k != "token_filters"}
        rules = values.get("token_filters") or {}
        out["token_filters"] = TokenFilters(**{f.name: rules[f.name] for f in fields(TokenFilters) if rules.get(f.name) is not None})
        words = values.get("filter") or {}
        if words.get("enabled"):
            out["filter_file"] = words.get("filter_file")
        if (values.get("persistence") or {}).get("state_dir"):
            out["state_dir"] = values["persistence"]["state_dir"]
        out["skip_frequency_classes"] = tuple(out.get("skip_frequency_classes", ()))
        return cls(**out)

    @classmethod
    def read(cls, path: str) -> Settings:
        """From a YAML file, or a JSON file of the same form (``.json``); ``log_dir`` must be given."""
        with open(path, encoding="utf-8") as f:
            if path.endswith(".json"):
                values = json.load(f) or {}
            else:
                try:
                    import yaml
                except ImportError as e:
                    raise RuntimeError("reading a YAML file needs PyYAML; use JSON, or build Settings directly") from e
                values = yaml.safe_load(f) or {}
        if not values.get("log_dir"):
            raise ValueError("log_dir is required")
        return cls.of(values)
