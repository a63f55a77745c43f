"""Scoring profiles: anchored inputs, modes that inherit, mechanism branches and gates, checked as a whole and compiled to columns of one projection."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evirank.operators import composite as CO
from evirank.operators.ranking import first_match


class ProfileError(ValueError):
    pass


#: Raw inputs that the parts of a profile read, besides those of its mechanism branches.
DISEASE_INPUTS = ("gwas_pip", "gwas_log10_p", "clinvar_classification", "clinvar_review_stars", "disease_match_type", "cohort_normalized_recurrence", "gnomad_af", "segregation_support")
FUNCTIONAL_INPUTS = ("evidence_directness", "model_system_relevance", "replication_count", "mave_functional_class")
EDITING_INPUTS = {"predicted_efficiency": "pegrna_predicted_efficiency", "design_count": "pegrna_design_count", "bystander": "bystander_risk", "off_target": "off_target_risk", "indel_length": "indel_length"}
PARTS, DISEASE_PARTS = ("disease", "functional", "mechanism", "editability"), ("fine_mapping", "clinical_evidence", "recurrence", "rarity", "segregation")
#: Scores from which on, and up to which, a missense change counts as damaging or tolerated, and the gate of each class (fixed values).
DAMAGING, TOLERATED = 0.7, 0.3
GATES = {"ptv": "ptv", "synonymous": "synonymous", "inframe_indel": "inframe_indel", "splice": "splice_lof", "noncoding": "noncoding_other"}


@dataclass(frozen=True)
class Anchor:
    """How one raw input becomes a number from 0 to 1, whatever else is scored."""

    name: str
    kind: str
    values: dict[str, float] = field(default_factory=dict)
    unmapped: float | None = None
    points: tuple[tuple[float, float], ...] = ()
    log: bool = False
    low: float = 0.0
    high: float = 1.0
    invert: bool = False

    @classmethod
    def read(cls, name: str, said: dict) -> Anchor:
        known = {"type", "note", "map", "unmapped", "breakpoints", "values", "log_scale", "lo", "hi", "invert"}
        if set(said) - known:
            raise ProfileError(f"anchor {name}: unknown {sorted(set(said) - known)}")
        kind = said.get("type")
        values = {("true" if k is True else "false" if k is False else str(k)): float(v) for k, v in (said.get("map") or {}).items()}
        at, to = said.get("breakpoints") or [], said.get("values") or []
        if kind in ("categorical", "boolean"):
            if not values:
                raise ProfileError(f"anchor {name}: a {kind} one needs a map")
        elif kind == "piecewise":
            if not at or len(at) != len(to) or list(at) != sorted(at):
                raise ProfileError(f"anchor {name}: breakpoints must ascend and have a value each")
        elif kind in ("linear_clamp", "identity"):
            if said.get("lo", 0.0) == said.get("hi", 1.0):
                raise ProfileError(f"anchor {name}: hi must differ from lo")
        else:
            raise ProfileError(f"anchor {name}: unknown type {kind}")
        if any(not 0 <= v <= 1 for v in [*values.values(), *to]):
            raise ProfileError(f"anchor {name}: a value lies outside 0 to 1")
        return cls(name, kind, values, said.get("unmapped"), tuple((float(a), float(b)) for a, b in zip(at, to, strict=True)), bool(said.get("log_scale")), float(said.get("lo", 0.0)), float(said.get("hi", 1.0)), bool(said.get("invert")))

    def of(self, raw: Column) -> Column:
        """The anchored value; null stays null, and a category that is neither mapped nor has a fallback fails the job."""
        if self.kind in ("categorical", "boolean"):
            text = F.translate(F.lower(F.trim(raw.cast("string"))), " /", "__")
            key = F.regexp_replace(text, r"^(-?\d+)\.0$", "$1")
            other = F.lit(float(self.unmapped)) if self.unmapped is not None else F.raise_error(F.concat(F.lit(f"{self.name}: unknown category "), key)).cast("double")
            out = F.when(raw.isNotNull(), first_match([(key == k, v) for k, v in self.values.items()], other))
        elif self.kind == "piecewise":
            out = CO.piecewise(raw.cast("double"), list(self.points), self.log)
        elif self.kind == "linear_clamp":
            out = (raw.cast("double") - self.low) / (self.high - self.low)
        else:
            out = raw.cast("double")
        out = 1 - out if self.invert else out
        return F.when(raw.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), out)))


def _sums_to_one(weights: dict[str, float], what: str) -> dict[str, float]:
    if not math.isclose(sum(weights.values()), 1.0, abs_tol=1e-6):
        raise ProfileError(f"weights of {what} sum to {sum(weights.values()):.6f}, not 1")
    return {k: float(v) for k, v in weights.items()}


def _named(weights: dict, names: tuple[str, ...], what: str) -> dict[str, float]:
    if set(weights) != set(names):
        raise ProfileError(f"{what} must name {', '.join(names)}")
    return _sums_to_one(weights, what)


def _modes(said: dict) -> dict[str, dict]:
    """Modes with what they inherit, however far up; a composition is not inherited."""
    out = {}

    def whole(name: str, below: tuple[str, ...] = ()) -> dict:
        if name in below or name not in said:
            raise ProfileError(f"mode {below[-1] if below else name} inherits in a circle" if name in below else f"mode {below[-1]} inherits from unknown {name}")
        own = dict(said[name])
        parent = own.pop("inherits", None)
        above = {k: v for k, v in whole(parent, (*below, name)).items() if k != "composition"} if parent else {}
        return {**above, **own}

    for name in said:
        mode = whole(name)
        if "weights" not in mode or not 0 <= mode.get("novelty_alpha", -1) <= 1:
            raise ProfileError(f"mode {name} needs weights and a novelty_alpha from 0 to 1")
        if "composition" in mode:
            _sums_to_one(mode["composition"], f"the composition of {name}")
        out[name] = {"weights": _named(mode["weights"], PARTS, f"mode {name}"), "alpha": float(mode["novelty_alpha"]), "composition": mode.get("composition")}
    return out


@dataclass(frozen=True)
class Profile:
    version: dict[str, str]
    anchors: dict[str, Anchor]
    branches: dict[str, dict[str, float]]
    gates: dict[str, dict[str, float]]
    modes: dict[str, dict]
    disease: dict[str, float]
    editability: dict[str, float]
    bonus: float
    forbidden: tuple[str, ...]

    @classmethod
    def read(cls, scoring: dict, anchors: dict, branches: dict, gating: dict) -> Profile:
        """A profile from its four documents. Whatever a part refers to must be there: nothing defaults, and all gaps are named at once."""
        parts = scoring["components"]
        if parts["functional"].get("aggregation", "max") != "max":
            raise ProfileError("functional evidence is aggregated by max")
        made = cls(
            {"scoring": str(scoring["version"]), "anchors": str(anchors["version"]), "branches": str(branches["version"]), "gating": str(gating["version"])},
            {n: Anchor.read(n, dict(a or {})) for n, a in anchors["anchors"].items()},
            {c: _sums_to_one(w, f"branch {c}") for c, w in branches["branches"].items()},
            {m: {k: float(v) for k, v in g.items()} for m, g in gating["gating"].items()},
            _modes(scoring["ranking_modes"]), _named(parts["disease"], DISEASE_PARTS, "disease"), _named(parts["editability"], tuple(EDITING_INPUTS), "editability"),
            float(parts["functional"].get("replication_bonus", 0.0)), tuple(scoring.get("validation", {}).get("forbid_fields_in_scoring", ())),
        )
        absent = sorted(set(made.inputs()) - set(made.anchors))
        if absent:
            raise ProfileError(f"inputs without an anchor: {', '.join(absent)}")
        return made

    @classmethod
    def load(cls, folder: str) -> Profile:
        """The profile whose scoring.yaml in this folder names the other files."""
        try:
            import yaml
        except ImportError as e:
            raise ProfileError("profiles in YAML need a YAML reader") from e

        read = lambda name: yaml.safe_load((Path(folder) / name).read_text())
        scoring = read("scoring.yaml")
        return cls.read(scoring, read(scoring.get("anchors", "anchors.yaml")), read(scoring["mechanism_branches"]), read(scoring["mechanism_gating"]))

    def inputs(self) -> list[str]:
        """Every raw input that some score reads."""
        return list(dict.fromkeys([*(n for w in self.branches.values() for n in w), *DISEASE_INPUTS, *FUNCTIONAL_INPUTS, *EDITING_INPUTS.values()]))

    def gate_key(self, cls: Column, damage: Column, functional_site: Column) -> Column:
        missense = F.when(F.coalesce(functional_site, F.lit(False)), "missense_in_functional_site").when(damage <= TOLERATED, "missense_predicted_tolerated").otherwise("missense_predicted_lof")
        return first_match([(cls == c, g) for c, g in GATES.items()] + [(cls == "missense", missense)], "default")

    def scored(self, df: DataFrame, mode: str, inputs: dict[str, Column], cls: Column, mechanism: Column, functional: Column, saturation: Column, functional_site: Column) -> DataFrame:
        """df with disease, functional, mechanism_before, gate_key, gate, mechanism, editability and composite.

        inputs: raw inputs by name; one that is not given is absent for all rows. A consequence class without a branch fails the job, since another class's
        predictors are no substitute. Parts without any input are null and leave the composite's weights to the others.
        """
        if mode not in self.modes:
            raise ProfileError(f"unknown mode {mode}")
        wrong = sorted((set(inputs) - set(self.inputs())) | (set(inputs) & set(self.forbidden)))
        if wrong:
            raise ProfileError(f"no inputs of this profile: {', '.join(wrong)}")
        value = lambda n: self.anchors[n].of(inputs[n]) if n in inputs else F.lit(None).cast("double")
        clinical = value("clinvar_classification") * value("clinvar_review_stars") * value("disease_match_type")
        parts = (F.coalesce(value("gwas_pip"), value("gwas_log10_p")), clinical, value("cohort_normalized_recurrence"), value("gnomad_af"), value("segregation_support"))
        disease = CO.weighted([(self.disease[n], v) for n, v in zip(DISEASE_PARTS, parts, strict=True)])
        branch = first_match([(cls == c, CO.weighted([(w, value(n)) for n, w in weights.items()])) for c, weights in self.branches.items()], F.raise_error(F.concat(F.lit("no branch for class "), F.coalesce(cls, F.lit("null")))).cast("double"))
        key = self.gate_key(cls, inputs.get("alphamissense_score", F.lit(None)).cast("double"), functional_site)
        table = [(mechanism == m, first_match([(key == k, F.struct(F.lit(k).alias("key"), F.lit(v).alias("gate"))) for k, v in g.items()], F.struct(F.lit("default" if "default" in g else "ungated").alias("key"), F.lit(g.get("default", 1.0)).alias("gate")))) for m, g in self.gates.items()]
        gate = first_match(table, F.struct(F.lit("ungated").alias("key"), F.lit(1.0).alias("gate")))
        editing = CO.weighted([(w, value(EDITING_INPUTS[n])) for n, w in self.editability.items()])
        out = df.withColumns({"disease": disease, "functional": functional.cast("double"), "mechanism_before": branch, "__gate": gate, "editability": editing, "__saturation": saturation})
        out = out.withColumns({"gate_key": F.when(F.col("mechanism_before").isNotNull(), F.col("__gate.key")), "gate": F.when(F.col("mechanism_before").isNotNull(), F.col("__gate.gate"))})
        out = out.withColumn("mechanism", F.col("mechanism_before") * F.col("gate"))
        own = self.modes[mode]
        total = CO.composite([(own["weights"][p], F.col(p)) for p in PARTS], F.col("__saturation"), own["alpha"])
        return out.withColumn("composite", total).drop("__gate", "__saturation")
