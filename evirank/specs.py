"""Typed request and evaluation specs: every field is known, checked and has its default stated here."""

from __future__ import annotations

import json
from dataclasses import MISSING, dataclass, field, fields
from pathlib import Path
from typing import get_args, get_origin, get_type_hints


class SpecError(ValueError):
    pass


def _read(kind, value, where: str):
    """A value as a type: dataclasses by their fields, lists and maps by their parts; what does not fit is an error that says where."""
    origin = get_origin(kind)
    if origin is list:
        if not isinstance(value, list):
            raise SpecError(f"{where} must be a list")
        return [_read(get_args(kind)[0], v, f"{where}[{i}]") for i, v in enumerate(value)]
    if origin is dict:
        if not isinstance(value, dict):
            raise SpecError(f"{where} must be a map")
        return {str(k): _read(get_args(kind)[1], v, f"{where}.{k}") for k, v in value.items()}
    if type(None) in get_args(kind):
        return None if value is None else _read(next(k for k in get_args(kind) if k is not type(None)), value, where)
    if hasattr(kind, "__dataclass_fields__"):
        if not isinstance(value, dict):
            raise SpecError(f"{where or 'the spec'} must be a map")
        hints = get_type_hints(kind)
        unknown = sorted(set(value) - set(hints))
        if unknown:
            raise SpecError(f"unknown in {where or 'the spec'}: {', '.join(map(str, unknown))}")
        missing = [f.name for f in fields(kind) if f.name not in value and f.default is MISSING and f.default_factory is MISSING]
        if missing:
            raise SpecError(f"missing in {where or 'the spec'}: {', '.join(missing)}")
        made = kind(**{k: _read(hints[k], v, f"{where}.{k}".lstrip(".")) for k, v in value.items()})
        getattr(made, "check", lambda _: None)(where)
        return made
    if kind is float and isinstance(value, (int, float, str)) and not isinstance(value, bool):
        try:
            return float(value)  # YAML reads 2.5e-6 as a number, but 2.5E-6 or 1e-6 as text
        except ValueError as e:
            raise SpecError(f"{where} must be a number") from e
    if kind is object:
        return value
    if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
        raise SpecError(f"{where} must be {kind.__name__}, not {value!r}")
    return value


@dataclass(frozen=True)
class Disease:
    input: str
    concept_id: str | None = None


@dataclass(frozen=True)
class Scope:
    allowed_consequences: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class MechanismRule:
    clingen_hi_scores_for_lof: list[int] = field(default_factory=list)
    burden_max_p: float = 0.0

    def check(self, where: str) -> None:
        if not 0 <= self.burden_max_p <= 1:
            raise SpecError(f"{where}.burden_max_p must lie from 0 to 1")


@dataclass(frozen=True)
class Cohort:
    disease_relationship: str

    def check(self, where: str) -> None:
        if self.disease_relationship not in ("exact", "broader", "narrower", "related", "unrelated"):
            raise SpecError(f"{where}.disease_relationship is unknown: {self.disease_relationship}")


@dataclass(frozen=True)
class Screening:
    llm_profile: str | None = None
    batch_size: int = 10
    max_tokens: int | None = None
    concurrency: int = 4
    max_llm_requests: int = 0
    max_input_tokens: int = 1_500_000
    max_output_tokens: int = 300_000
    audit_fraction: float = 0.1
    audit_seed: int = 42

    def check(self, where: str) -> None:
        if self.batch_size < 1 or not 0 <= self.audit_fraction <= 1:
            raise SpecError(f"{where} needs a batch_size from 1 and an audit_fraction from 0 to 1")


@dataclass(frozen=True)
class DeepRead:
    llm_profile: str | None = None
    max_units_per_paper: int = 15
    max_chars_per_paper: int = 9000
    max_chars_per_call: int = 45_000
    max_llm_requests: int = 20
    concurrency: int = 2
    download_timeout_s: int = 600


@dataclass(frozen=True)
class Literature:
    disease_terms: list[str] = field(default_factory=list)
    variant_terms: list[str] = field(default_factory=list)
    gene_aliases: list[str] = field(default_factory=list)
    pubtator_diseases: list[str] = field(default_factory=list)
    screening: Screening = field(default_factory=Screening)
    deep_read: DeepRead = field(default_factory=DeepRead)


@dataclass(frozen=True)
class Request:
    """What is asked for one gene and disease: routes, scope, the rule for the mechanism, and how literature is read."""

    gene: str
    disease: Disease
    flank: int = 2000
    routes: dict[str, bool] = field(default_factory=dict)
    literature_dir: str | None = None
    manual_variants: list[dict[str, object]] = field(default_factory=list)
    case_cohorts: dict[str, Cohort] = field(default_factory=dict)
    scope: Scope = field(default_factory=Scope)
    mechanism_rule: MechanismRule = field(default_factory=MechanismRule)
    screen_context: dict[str, object] = field(default_factory=dict)
    policy: str | None = None
    requested_panel_size: int | None = None
    literature: Literature = field(default_factory=Literature)

    def check(self, where: str) -> None:
        if self.flank < 0:
            raise SpecError("flank must not be negative")
        if not any(self.routes.values()) and not self.manual_variants:
            raise SpecError("a request needs a route or manual variants")


@dataclass(frozen=True)
class ScoreSet:
    role: str
    readout: str
    abnormal_max: float | None = None
    normal_min: float | None = None

    def check(self, where: str) -> None:
        if self.role not in ("primary", "secondary"):
            raise SpecError(f"{where}.role is unknown: {self.role}")
        if (self.abnormal_max is None) != (self.normal_min is None) or (self.abnormal_max is not None and self.abnormal_max > self.normal_min):
            raise SpecError(f"{where} needs both thresholds, abnormal_max not above normal_min, or neither")


@dataclass(frozen=True)
class Evaluation:
    """A run and the measured score sets that it is held against; a set without thresholds has no classes."""

    run: str
    score_sets: dict[str, ScoreSet]

    def check(self, where: str) -> None:
        if sum(s.role == "primary" for s in self.score_sets.values()) != 1:
            raise SpecError("an evaluation has one primary score set")


def read_spec(kind, said: dict):
    return _read(kind, said, "")


def load_spec(kind, path: str):
    """A spec from YAML, where a parser is installed, else from JSON."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml
    except ImportError:
        return read_spec(kind, json.loads(text))
    return read_spec(kind, yaml.safe_load(text))
