"""Settings of a selection, their precedence and the rules between them."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, fields

METHODS = ("learnability", "high_loss_clusters", "middle_perplexity", "embedding", "longest_reasoning", "learnability_baseline", "random")


@dataclass(frozen=True)
class SelectionConfig:
    """What is None was not set, and gives way to a file's value and then to the default."""

    size: int | None = None
    method: str | None = None
    n_clusters: int | None = None
    n_sample_per_cluster: int | None = None
    softmax: bool | None = None
    checkpoints: str | None = None
    all_samples: bool | None = None
    cluster_features: str | None = None
    seed: int | None = None
    niter: int | None = None
    compat: bool | None = None
    #: For the learnability baseline: as_written takes the rows that improve least, improvement those that improve most.
    order: str | None = None
    #: By source: clusters and samples; `other` for those not named, which get none without it.
    sources: dict[str, tuple[int, int]] | None = None

    def merged(self, file: dict) -> SelectionConfig:
        """Explicit settings, then the file's, then the defaults; checked."""
        values = {f.name: getattr(self, f.name) for f in fields(self)}
        unknown = set(file) - set(values)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        for name, value in {**DEFAULTS, **file}.items():
            if values[name] is None:
                values[name] = value
        return SelectionConfig(**values).checked()

    def checked(self) -> SelectionConfig:
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {', '.join(METHODS)}")
        if self.cluster_features not in ("raw", "standardized"):
            raise ValueError("cluster_features must be raw or standardized")
        if self.size is None and not self.all_samples and not self.sources:
            raise ValueError("size is required")
        if self.order not in (None, "as_written", "improvement"):
            raise ValueError("order must be as_written or improvement")
        if self.sources and (self.softmax or self.n_clusters is not None or self.method not in ("learnability", "high_loss_clusters")):
            raise ValueError("sources go with a method of clusters, without softmax or n_clusters")
        if self.softmax and self.n_clusters is not None:
            raise ValueError("n_clusters does not go with softmax")
        if self.n_sample_per_cluster is not None and not self.softmax:
            raise ValueError("n_sample_per_cluster needs softmax")
        if self.all_samples and "clusters" not in self.method:
            raise ValueError("all_samples needs a method of clusters")
        from tamis.operators.losses import parse_checkpoints

        named = parse_checkpoints(self.checkpoints) if self.checkpoints else None
        if self.method == "longest_reasoning" and named:
            raise ValueError("longest_reasoning takes no checkpoints")
        if self.method in ("middle_perplexity", "embedding") and named is not None and len(named) != 1:
            raise ValueError(f"{self.method} takes one checkpoint")
        if self.method == "learnability_baseline" and named is not None and len(named) != 2:
            raise ValueError("learnability_baseline takes exactly two checkpoints")
        return self


DEFAULTS = {"method": "learnability", "softmax": False, "all_samples": False, "cluster_features": "raw", "seed": 42, "niter": 20, "compat": False}


def read_settings(path: str | None, overrides: Iterable[str] = ()) -> dict:
    """The settings of a JSON or, by its ending, YAML file, with overrides such as size=500 or sources.web=[4,100].

    An override's value is read as JSON and is text if it isn't any; a dot leads into a nested setting. Without a file
    there are only overrides; an empty file has no settings. YAML needs PyYAML.
    """
    found: dict = {}
    if path:
        with open(path, encoding="utf-8") as handle:
            text = handle.read()
        if path.lower().endswith((".yaml", ".yml")):
            try:
                import yaml
            except ModuleNotFoundError as error:
                raise ValueError(f"{path} is YAML, and PyYAML isn't there; give JSON") from error
            found = yaml.safe_load(text) or {}
        elif text.strip():
            found = json.loads(text)
        if not isinstance(found, dict):
            raise ValueError(f"{path} has to hold settings by name")
    for item in overrides:
        name, given, value = item.partition("=")
        if not given or not all(name.split(".")):
            raise ValueError(f"an override is name=value, not {item}")
        at, (*outer, last) = found, name.split(".")
        for part in outer:
            at[part] = at.get(part) or {}
            at = at[part]
            if not isinstance(at, dict):
                raise ValueError(f"{name}: {part} holds a value, not settings")
        try:
            at[last] = json.loads(value)
        except json.JSONDecodeError:
            at[last] = value
    if found.get("sources"):
        found["sources"] = {source: tuple(pair) for source, pair in found["sources"].items()}
    return found
