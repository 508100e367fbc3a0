"""Settings from a TOML file, each with a default."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

from .functions import rules


@dataclass
class General:
    enabled: bool = True
    log_level: str = "info"


@dataclass
class Timing:
    base_interval_seconds: int = 5
    battery_interval_seconds: int = 15
    idle_interval_seconds: int = 60
    min_interval_seconds: int = 3
    max_interval_seconds: int = 60
    idle_threshold_seconds: int = 30
    scroll_debounce_ms: int = 1000
    focus_debounce_ms: int = 500


@dataclass
class ChangeDetection:
    hash_sensitivity: int = 8
    title_change_triggers_extract: bool = True
    hash_algorithm: str = "mean"


@dataclass
class Extractors:
    accessibility_enabled: bool = True
    chrome_extension_enabled: bool = True
    ocr_enabled: bool = True
    ocr_fallback_only: bool = True
    accessibility_binary_path: str | None = None
    ocr_binary_path: str | None = None


@dataclass
class Privacy:
    blocked_apps: list[str] = field(default_factory=lambda: list(rules.DEFAULT_BLOCKED_GLOBS))
    redact_credit_cards: bool = True
    redact_ssn: bool = True
    redact_api_keys: bool = True
    redact_emails: bool = False
    redact_phone_numbers: bool = False


@dataclass
class MultiDisplay:
    enabled: bool = True
    capture_all_displays: bool = True


@dataclass
class Config:
    general: General = field(default_factory=General)
    timing: Timing = field(default_factory=Timing)
    change_detection: ChangeDetection = field(default_factory=ChangeDetection)
    extractors: Extractors = field(default_factory=Extractors)
    privacy: Privacy = field(default_factory=Privacy)
    multi_display: MultiDisplay = field(default_factory=MultiDisplay)


def _filled(kind: type, given: dict[str, Any]) -> Any:
    own = kind()
    for f in fields(kind):
        if f.name in given:
            now = getattr(own, f.name)
            setattr(own, f.name, _filled(type(now), given[f.name]) if is_dataclass(now) else given[f.name])
    return own


def read_config(path: str) -> Config:
    """The file's settings; a missing or broken file has the defaults."""
    try:
        with open(path, "rb") as f:
            return _filled(Config, tomllib.load(f))
    except (OSError, tomllib.TOMLDecodeError, AttributeError, TypeError):
        return Config()
