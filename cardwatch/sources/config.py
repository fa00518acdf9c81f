"""Rule sets and model settings from YAML."""

from __future__ import annotations

from pathlib import Path
from typing import Any

import yaml

from cardwatch.operators.decision import Policy
from cardwatch.operators.rules import Rule, check_rules

CONFIG_DIR = Path(__file__).resolve().parent.parent / "config"


def load_yaml(path: str | Path) -> dict[str, Any]:
    with open(path, encoding="utf-8") as handle:
        return yaml.safe_load(handle) or {}


def rules_from_dicts(items: list[dict[str, Any]]) -> list[Rule]:
    return check_rules(
        [Rule(item["code"], item["severity"], item["description"], item.get("when") or {}) for item in items]
    )


def load_rules(path: str | Path | None = None) -> list[Rule]:
    return rules_from_dicts(load_yaml(path or CONFIG_DIR / "rules.yaml").get("rules") or [])


def load_model_settings(path: str | Path | None = None, profile: str | None = None) -> dict[str, Any]:
    """The settings, with the values of a named profile of the file in place of its own."""
    settings = load_yaml(path or CONFIG_DIR / "model.yaml")
    profiles = settings.pop("profiles", {})
    for section, values in profiles[profile].items() if profile else ():
        settings[section] |= values
    return settings


def load_policy(path: str | Path | None = None) -> Policy:
    return Policy(**load_model_settings(path).get("decision", {}))
