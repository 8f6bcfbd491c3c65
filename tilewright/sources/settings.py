"""Project settings from TOML: every key known, every value of its kind and in its range."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """How a value is read, and what must hold for it."""

    kind: Callable
    holds: Callable = lambda _: True
    said: str = ""


def _many(kind: Callable) -> Callable:
    return lambda values: tuple(kind(v) for v in values)


_WHOLE = Rule(int)
_SOME = Rule(int, lambda x: x > 0, "positive")
_TEXT, _PATH = Rule(str), Rule(str)
_PART = Rule(float, lambda x: 0 < x < 1, "strictly between zero and one")

# Sections, their keys, and what their values may be.
REQUIRED = {
    "reproducibility": {"seed": _WHOLE},
    "device": {"mode": Rule(str, lambda x: x in ("auto", "cpu", "cuda"), "one of auto, cpu, cuda")},
    "outputs": {"artifacts_dir": _PATH, "experiments_dir": _PATH},
    "dataset": {
        "adapter": _TEXT, "root": _PATH, "catalog": _PATH, "expected_count": _SOME,
        "expected_shape": Rule(_many(int), lambda x: len(x) == 3 and min(x) > 0, "three positive numbers"),
        "bands": Rule(_many(str), lambda x: len(set(x)) == len(x), "unique"), "value_scale": Rule(float, lambda x: x > 0, "positive"),
    },
    "split": {"manifest": _PATH, "train_fraction": _PART, "validation_fraction": _PART, "test_fraction": _PART, "seed": _WHOLE, "stratify_by_label": Rule(bool)},
    "loader": {"batch_size": _SOME, "num_workers": Rule(int, lambda x: x >= 0, "not negative"), "pin_memory": Rule(bool)},
    "visualization": {"samples": _SOME, "lower_percentile": Rule(float), "upper_percentile": Rule(float), "composites": Rule(lambda x: {k: tuple(v) for k, v in x.items()})},
}
OPTIONAL = {
    "model": {
        "statistics_csv": _PATH, "embedding_dim": _SOME,
        "cnn_channels": Rule(_many(int), lambda x: len(x) == 3 and all(c > 0 and c % 8 == 0 for c in x), "three positive multiples of 8"),
        "vit_patch_size": _SOME, "vit_width": _SOME, "vit_depth": _SOME, "vit_heads": _SOME, "vit_mlp_ratio": _SOME,
    },
    "training": {
        "epochs": _SOME, "batch_size": Rule(int, lambda x: x >= 2, "at least 2"), "learning_rate": Rule(float, lambda x: x > 0, "positive"),
        "weight_decay": Rule(float, lambda x: x >= 0, "not negative"), "temperature": Rule(float, lambda x: x > 0, "positive"),
        "retrieval_ks": Rule(_many(int), lambda x: x and x[0] > 0 and all(a < b for a, b in zip(x, x[1:], strict=False)), "positive and increasing"),
    },
    "embedding": {
        "models": Rule(_many(str), lambda x: x and set(x) <= {"cnn", "vit"} and len(set(x)) == len(x), "cnn, vit or both"),
        "checkpoint_filename": Rule(str, lambda x: x and os.path.basename(x) == x, "a file name, not a path"), "batch_size": _SOME,
    },
}


def load_settings(text: str, root: str | None = None) -> dict[str, dict[str, object]]:
    """Settings by section; paths are joined to ``root``, if given. Missing and unknown names are errors, and so are values out of range."""
    given, known = tomllib.loads(text), REQUIRED | OPTIONAL
    if REQUIRED.keys() - given.keys() or given.keys() - known.keys():
        raise ValueError(f"missing sections {sorted(REQUIRED.keys() - given.keys())}, unknown sections {sorted(given.keys() - known.keys())}")
    out: dict[str, dict[str, object]] = {}
    for section, values in given.items():
        rules = known[section]
        if set(values) != set(rules):
            raise ValueError(f"[{section}] lacks {sorted(set(rules) - set(values))}, has unknown {sorted(set(values) - set(rules))}")
        out[section] = {}
        for key, rule in rules.items():
            value = rule.kind(values[key])
            if not rule.holds(value):
                raise ValueError(f"{section}.{key} must be {rule.said}")
            out[section][key] = os.path.join(root, value) if root and rule is _PATH else value
    _check_together(out)
    return out


def _check_together(s: dict[str, dict]) -> None:
    """Rules over several keys."""
    data, split, view = s["dataset"], s["split"], s["visualization"]
    model = s.get("model", {"vit_patch_size": 1, "vit_width": 1, "vit_heads": 1})
    fractions = sum(split[f"{n}_fraction"] for n in ("train", "validation", "test"))
    for ok, said in (
        (len(data["bands"]) == data["expected_shape"][0], "dataset.bands and the first of dataset.expected_shape disagree"),
        (abs(fractions - 1) <= 1e-9, f"train, validation and test fractions add up to {fractions}, not to one"),
        (0 <= view["lower_percentile"] < view["upper_percentile"] <= 100, "percentiles must rise between 0 and 100"),
        (all(len(c) == 3 and set(c) <= set(data["bands"]) for c in view["composites"].values()), "composites are made of three of dataset.bands"),
        (all(n % model["vit_patch_size"] == 0 for n in data["expected_shape"][1:]), "patches of model.vit_patch_size do not fill the image"),
        (model["vit_width"] % model["vit_heads"] == 0, "model.vit_heads do not share model.vit_width evenly"),
    ):
        if not ok:
            raise ValueError(said)
