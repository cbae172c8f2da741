"""Settings of the detection rules, checked on the driver before any job starts."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

PRIVILEGE_CHANGE = "INSIDER.PRIVILEGE_CHANGE"
SPLITTING = "AML.TRANSACTION_SPLITTING"
CIRCULAR = "AML.CIRCULAR_TRANSFER"

# Default settings.
ADMINISTRATIVE_TERMS = (
    "access", "limit", "auth", "fraud", "monitoring", "kyc", "risk", "payee", "beneficial", "account",
    "view_only", "api", "batch", "wire", "forex", "screen",
)
PROFILE_FIELDS = ("spending_limit", "wire_transfer_limit", "risk_rating", "beneficial_owner", "account_type")


def _need(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def _number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


@dataclass(frozen=True)
class RuleConfig:
    """``from_mapping`` takes known settings over the defaults and checks them."""

    enabled: bool = True

    @classmethod
    def from_mapping(cls, settings: Mapping | None = None):
        known = {f.name for f in fields(cls)}
        config = replace(cls(), **{k: v for k, v in (settings or {}).items() if k in known})
        _need(isinstance(config.enabled, bool), "'enabled' must be boolean")
        return config.checked()

    def checked(self):
        return self


@dataclass(frozen=True)
class PrivilegeConfig(RuleConfig):
    qualifying_administrative_categories: tuple = ADMINISTRATIVE_TERMS
    qualifying_profile_change_fields: tuple = PROFILE_FIELDS
    matching_timestamp: str = "exact"
    require_matching_employee: bool = True
    minimum_qualifying_events: int = 1

    def checked(self):
        lists = ("qualifying_administrative_categories", "qualifying_profile_change_fields")
        for name in lists:
            values = getattr(self, name)
            good = isinstance(values, (list, tuple)) and values
            good = good and all(isinstance(v, str) and v.strip() for v in values)
            _need(bool(good), f"'{name}' must be a non-empty list of strings")
        _need(self.matching_timestamp == "exact", "'matching_timestamp' must be 'exact'")
        _need(isinstance(self.require_matching_employee, bool), "'require_matching_employee' must be boolean")
        _need(self.minimum_qualifying_events == 1, "'minimum_qualifying_events' must be 1")
        return replace(self, **{n: tuple(v.strip().lower() for v in getattr(self, n)) for n in lists})


@dataclass(frozen=True)
class SplittingConfig(RuleConfig):
    time_window_hours: float = 48
    minimum_outgoing_transactions: int = 3
    below_reporting_boundary: float = 10000

    def checked(self):
        _need(_number(self.time_window_hours) and self.time_window_hours > 0, "'time_window_hours' must be positive")
        n = self.minimum_outgoing_transactions
        _need(isinstance(n, int) and not isinstance(n, bool) and n >= 3, "'minimum_outgoing_transactions' must be 3 or more")
        b = self.below_reporting_boundary
        _need(_number(b) and b > 0, "'below_reporting_boundary' must be positive")
        return self


@dataclass(frozen=True)
class CircularConfig(RuleConfig):
    time_window_hours: float = 48
    minimum_transactions: int = 3
    max_hops: int | None = None

    def checked(self):
        _need(_number(self.time_window_hours) and self.time_window_hours > 0, "'time_window_hours' must be positive")
        n = self.minimum_transactions
        _need(isinstance(n, int) and not isinstance(n, bool) and n >= 3, "'minimum_transactions' must be 3 or more")
        _need(self.max_hops is None or self.max_hops >= n, "'max_hops' must not be below 'minimum_transactions'")
        return self


def settings_for(configuration: Mapping | None, rule_id: str) -> Mapping:
    """The settings stored under the rule id, else the whole mapping."""
    configuration = configuration or {}
    own = configuration.get(rule_id)
    return own if isinstance(own, Mapping) else configuration


def load_configuration(path: str) -> dict[str, dict]:
    """The ``rules`` object of a JSON file."""
    try:
        with open(path, encoding="utf-8") as source:
            document = json.load(source)
    except (OSError, json.JSONDecodeError) as error:
        raise ValueError(f"cannot load rule configuration {path}") from error
    rules = document.get("rules") if isinstance(document, Mapping) else None
    _need(isinstance(rules, Mapping), "rule configuration must contain a 'rules' object")
    _need(all(isinstance(v, Mapping) for v in rules.values()), "every configured rule must map to an object")
    return {k: dict(v) for k, v in rules.items()}
