"""Cleaning ranges, phase patterns and rules, with presets and their validation."""

from __future__ import annotations

import copy
import hashlib
import json
import re

#: Keep ranges of each signal; values outside become null.
CLEAN_RANGES = {
    "TV": (50, 1500),
    "RR": (1, 40),
    "PIP": (0, 50),
    "PEEP": (0, 25),
    "ETCO2": (5, 80),
    "FICO2": (0, 10),
    "FIO2": (21, 100),
    "ETO2": (5, 100),
    "Agent_Et": (0, 18),
    "Agent_Fi": (0, 18),
    "FIN2O": (0, 80),
    "ETN2O": (0, 80),
    "HR": (30, 200),
    "SPO2": (50, 100),
    "nSBP": (50, 250),
    "nMAP": (30, 180),
    "nDBP": (20, 150),
}
#: Ceiling of each agent's concentration, its name, and its potency at age 40.
AGENT_MAX = {"S": 12.0, "I": 12.0, "D": 18.0, "N": 12.0}
AGENT_NAMES = {"S": "Sevoflurane", "D": "Desflurane", "I": "Isoflurane", "N": "None"}
MAC_AGE40 = {"S": 1.8, "I": 1.2, "D": 6.6}
MAC_AGE_COEF, N2O_MAC_AGE40 = -0.00269, 104.0
#: Event names that begin and end the airway, and minutes around them.
PHASES = {
    "intubation": ("intubat", "airway (secured|placed|established)", "(lma|laryngeal mask).*(placed|inserted)"),
    "extubation": ("extubat", "airway removed", "(lma|laryngeal mask).*removed"),
    "induction_after_min": 10,
    "emergence_before_min": 10,
    "event_pad_min": 5,
}
PHASE_NAMES = ("pre_induction", "induction", "maintenance", "emergence", "post_emergence")
#: What one minute at warn, one at critical and one composite episode add to a score.
WEIGHTS = {"warn": 1, "critical": 3, "composite": 5}

_ALL_BUT_MAINTENANCE = ("pre_induction", "induction", "emergence", "post_emergence")
_AWAKE = ("pre_induction", "emergence", "post_emergence")
#: The rules. ``above``/``below`` are two-step thresholds (warn, critical) on ``signal``;
#: ``where`` is a condition in SQL; ``severity`` is that of rules with one step; ``run`` is rows in a row.
RULES = {
    "pip_high": {"signal": "PIP", "above": (30, 35)},
    "pip_rising": {"signal": "PIP_slope", "where": "PIP_slope >= 0.5 and PIP >= 20", "severity": "warn", "run": 5},
    "peep_high": {"signal": "PEEP", "above": (12, 15)},
    "peep_zero_long": {"signal": "PEEP", "where": "PEEP <= 0 and TV >= 200 and RR >= 6", "severity": "info", "run": 15, "skip": _ALL_BUT_MAINTENANCE},
    "tv_low_mlkg": {"signal": "TV_mlkg", "below": (4, 3), "where": "likely_mech_vent", "skip": _AWAKE},
    "tv_high_mlkg": {"signal": "TV_mlkg", "above": (10, 12), "skip": _AWAKE},
    "tv_abs_extreme": {"signal": "TV", "where": "coalesce(Age, 40) >= 16 and (TV < 100 or TV > 1000)", "severity": "warn", "skip": _AWAKE},
    "rr_low": {"signal": "RR", "below": (6, 4), "where": "TV >= 200", "skip": _AWAKE},
    "rr_high": {"signal": "RR", "above": (20, 30), "skip": _AWAKE},
    "etco2_high": {"signal": "ETCO2", "above": (50, 60)},
    "etco2_low": {"signal": "ETCO2", "below": (28, 22), "where": "ETCO2 > 0", "skip": ("pre_induction", "induction", "post_emergence")},
    "etco2_zero_vent": {"signal": "ETCO2", "where": "ETCO2 = 0 and TV >= 200 and RR >= 8", "severity": "critical", "run": 3, "skip": ("pre_induction", "post_emergence")},
    "fio2_high_long": {"signal": "FIO2", "where": "FIO2 >= 90 and t_min >= 15", "severity": "info", "run": 30, "skip": _ALL_BUT_MAINTENANCE},
    "fio2_room_air_vent": {"signal": "FIO2", "where": "FIO2 <= 25 and TV >= 200 and RR >= 6", "severity": "warn", "run": 5, "skip": ("pre_induction", "post_emergence")},
    "agent_high": {"signal": "MAC_total_Et", "above": (1.5, 2.0)},
    "agent_low_maint": {"signal": "MAC_Et", "where": "case_frac between 0.2 and 0.8 and Agent != 'N' and MAC_Et < 0.3 and coalesce(ETN2O, 0) < 30", "severity": "warn", "skip": _ALL_BUT_MAINTENANCE},
    "agent_drift": {"signal": "Agent_Et_drift", "where": "Agent_Et_drift >= case when Agent = 'D' then 1.5 else 0.5 end and Agent is not null", "severity": "info", "run": 5, "skip": _ALL_BUT_MAINTENANCE},
    "agent_fi_et_gap": {"signal": "Agent_Fi_Et_gap", "where": "case_frac between 0.15 and 0.85 and Agent_Fi_Et_gap >= case Agent when 'S' then 1 when 'I' then 1 when 'D' then 3 end", "severity": "info", "run": 10, "skip": _ALL_BUT_MAINTENANCE},
    "spo2_low": {"signal": "SPO2", "below": (92, 88)},
    "hr_high": {"signal": "HR", "above": (120, 140)},
    "hr_low": {"signal": "HR", "below": (45, 40)},
    "map_low": {"signal": "nMAP", "below": (60, 50)},
}
#: Rules over the rules that fired in the same minute.
COMPOSITES = {
    "compliance_concern": {"signal": "PIP_slope", "all": ("pip_rising",), "where": "coalesce(TV_slope, 0) <= 5", "severity": "warn"},
    "hypoventilation_pattern": {"signal": "ETCO2", "all": ("etco2_high",), "any": ("tv_low_mlkg", "rr_low"), "severity": "warn"},
    "desat_with_vent_issue": {"signal": "SPO2", "all": ("spo2_low",), "any": ("pip_high", "etco2_zero_vent", "tv_low_mlkg"), "severity": "critical"},
}
#: What the presets change.
PRESETS = {
    "default": {},
    "strict": {"pip_high": (28, 32), "etco2_high": (48, 55), "spo2_low": (94, 90)},
    "lenient": {"pip_high": (35, 40), "etco2_high": (55, 65), "spo2_low": (90, 85)},
}


class ConfigError(ValueError):
    """A configuration that no query should run with."""


def rules(preset: str = "default", base: dict | None = None) -> dict:
    """The rules with a preset's thresholds laid over them, validated."""
    if preset not in PRESETS:
        raise ConfigError(f"unknown preset {preset!r}")
    out = copy.deepcopy(base or RULES)
    for name, steps in PRESETS[preset].items():
        if name in out:
            out[name]["above" if "above" in out[name] else "below"] = steps
    validate(out)
    return out


def validate(candidate: dict, ranges: dict | None = None, phases: dict | None = None) -> None:
    """Thresholds in order, known phases, positive runs, ranges with low under high, patterns that compile."""
    for name, rule in candidate.items():
        for key, ordered in (("above", lambda w, c: c >= w), ("below", lambda w, c: c <= w)):
            if key in rule and not ordered(*rule[key]):
                raise ConfigError(f"{name}: critical must lie beyond warn")
        if rule.get("run", 1) < 1:
            raise ConfigError(f"{name}: a run has at least one row")
        if unknown := set(rule.get("skip", ())) - set(PHASE_NAMES):
            raise ConfigError(f"{name}: unknown phases {sorted(unknown)}")
        if not {"above", "below", "severity"} & set(rule):
            raise ConfigError(f"{name}: neither thresholds nor a severity")
    for name, (low, high) in (ranges or CLEAN_RANGES).items():
        if low >= high:
            raise ConfigError(f"{name}: low must be under high")
    for role in ("intubation", "extubation"):
        for pattern in (phases or PHASES)[role]:
            try:
                re.compile(pattern)
            except re.error as error:
                raise ConfigError(f"{role}: {pattern!r} is no pattern") from error


def preset_hash(config: dict) -> str:
    """First 16 hexadecimal digits of the SHA-256 of the sorted JSON form."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]


def check_parameters(n_cases: int = 50, pad_minutes: float = 5, max_rows: int = 1_000_000, min_rows: int = 30) -> None:
    """Bounds of a run's parameters."""
    for name, value, low, high in (("n_cases", n_cases, 1, 500), ("pad_minutes", pad_minutes, 0, 120), ("max_rows", max_rows, 1000, 5_000_000), ("min_rows", min_rows, 5, 5_000_000)):
        if not low <= value <= high:
            raise ConfigError(f"{name} must be from {low} to {high}, not {value}")
