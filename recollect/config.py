"""Settings in layers: defaults, a file's section, the environment, a session's overrides."""

from __future__ import annotations

import os
import tomllib
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

STRATEGIES = ("session_only", "every_prompt", "topic_change")
MODES = ("local", "remote")


@dataclass(frozen=True)
class Lifecycle:
    """How sessions remember. Unknown strategies fall back to topic_change."""

    enabled: bool = True
    recall_strategy: str = "topic_change"
    orient_budget: int = 1500
    recall_budget: int = 500
    topic_threshold: float = 0.7
    observe_tool_calls: bool = True
    distill_turns: bool = True
    learn_from_errors: bool = True

    def over(self, values: Mapping | None) -> Lifecycle:
        """With the values that are named; others stay."""
        known = {f.name for f in fields(self)}
        out = replace(self, **{k: v for k, v in (values or {}).items() if k in known})
        return out if out.recall_strategy in STRATEGIES else replace(out, recall_strategy="topic_change")


@dataclass(frozen=True)
class Settings:
    """Where items live and what makes embeddings; mode None means not set up."""

    mode: str | None = None
    data_dir: str = ""
    embedding_provider: str = "local"
    llm_provider: str = "none"
    coreference: bool = False


def load(path: str | None, env: Mapping[str, str] | None = None, prefix: str = "RECOLLECT_") -> Settings:
    """Settings of a TOML file, then of the environment, which wins. A bad file leaves things unset with a warning; a bad mode in the environment is an error."""
    env, out = os.environ if env is None else env, Settings()
    if path and os.path.exists(path):
        try:
            with open(path, "rb") as f:
                raw = tomllib.load(f)
            known = {f.name for f in fields(Settings)}
            out = replace(out, **{k: v for section in raw.values() if isinstance(section, dict) for k, v in section.items() if k in known})
            if out.mode is not None and out.mode not in MODES:
                warnings.warn(f"mode {out.mode!r} is none of {MODES}", stacklevel=2)
                out = replace(out, mode=None)
        except (tomllib.TOMLDecodeError, OSError) as error:
            warnings.warn(f"{path} cannot be read: {error}", stacklevel=2)
    for name, cast in (("mode", str), ("data_dir", str), ("embedding_provider", str), ("llm_provider", str)):
        if value := env.get(prefix + name.upper()):
            if name == "mode" and value not in MODES:
                raise ValueError(f"{prefix}MODE is {value!r}, none of {MODES}")
            out = replace(out, **{name: cast(value)})
    return out
