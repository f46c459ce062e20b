"""Settings from the environment or a mapping; values that don't parse are passed over."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import replace

from ..functions.vocab import SERVER_THRESHOLDS
from ..operators.pipeline import Config

PREFIX = "SPARKREDACT_"


def _number(env: Mapping[str, str], name: str, kind: Callable, default):
    try:
        return kind(env[PREFIX + name])
    except (KeyError, ValueError):
        return default


def label_thresholds(text: str) -> dict[str, float]:
    """``label:threshold,label:threshold``; parts without a number are left out."""
    out = {}
    for part in text.split(","):
        label, colon, value = part.partition(":")
        try:
            out[label.strip()] = float(value)
        except ValueError:
            continue
    return out


def from_env(env: Mapping[str, str] | None = None) -> Config:
    env = os.environ if env is None else env
    base = Config.server()
    by_label = dict(SERVER_THRESHOLDS) | label_thresholds(env.get(PREFIX + "LABEL_THRESHOLDS", ""))
    return replace(base, review=_number(env, "REVIEW_THRESHOLD", float, base.review), auto_redact=_number(env, "AUTO_REDACT_THRESHOLD", float, base.auto_redact), per_minute=_number(env, "RATE_LIMIT_RPM", int, base.per_minute), by_label=by_label)
