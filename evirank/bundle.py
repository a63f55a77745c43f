"""Frozen inputs, derived results and replay: a run is a folder whose digests name its content."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evirank import canonical
from evirank.functions.text import general
from evirank.operators import features as FE
from evirank.operators.evidence import one_kind_of_source
from evirank.operators.ranking import first_match
from evirank.policy import Policy
from evirank.sources.tables import write_json, write_jsonl

#: Frozen tables and the order of their rows; those of OPTIONAL may be left out.
FROZEN = {"variants": ["variant_id"], "annotations": ["variant_id"], "evidence": ["link_id"]}
OPTIONAL = {"provenance": ["variant_id"], "exclusions": ["mention_id"]}
SCOPE = {"gene": "", "disease": "", "synthetic": False, "mentions": 0, "routes": {}, "observation_search": "not_searched", "source_failures": []}
# The columns of the ranked table.
CSV_COLUMNS = (
    "primary_channel", "stratum", "tier_rank", "tie_group_id", "tie_group_size", "display_index",
    "variant_id", "label", "hgvs_c", "hgvs_p", "K", "O", "P_predictor", "P", "ordering_tuple", "characterization",
    "roles", "consequence_terms", "k_basis", "o_search_status", "editing_status", "flags",
    "contributing_link_ids", "discovery_routes", "source_refs", "literature_evidence", "policy_id", "policy_status",
)
LISTED_EXCLUSIONS = 100


def freeze(tables: dict[str, DataFrame], mechanism: str, policy: Policy, out: str, scope: dict | None = None, snapshots: DataFrame | None = None) -> dict:
    """Write the frozen tables (Parquet for derive, canonical JSON lines for audit) and their digests.

    scope: what the report says about the run, see SCOPE. snapshots (snapshot_id, is_synthetic): the job fails if they are not all of the scope's kind.
    """
    scope = SCOPE | (scope or {})
    if set(scope) - set(SCOPE):
        raise ValueError(f"unknown scope {sorted(set(scope) - set(SCOPE))}")
    if snapshots is not None:
        one_kind_of_source(snapshots, scope["synthetic"]).count()
    folder = Path(out)
    folder.mkdir(parents=True, exist_ok=True)
    digests = {}
    for name, order in (FROZEN | {k: v for k, v in OPTIONAL.items() if k in tables}).items():
        tables[name].write.mode("overwrite").parquet(str(folder / f"{name}.parquet"))
        plain = tables[name].select(*(F.to_json(c).alias(c) if t.startswith("map") else F.col(c) for c, t in tables[name].dtypes))
        digests[name] = write_jsonl(plain, str(folder / f"{name}.jsonl"), order)
    frozen = {"digests": digests, "evidence_digest": canonical.digest(sorted(digests.items())), "policy_id": policy.policy_id, "policy_digest": policy.digest, "mechanism": mechanism, "scope": scope, "code_digest": code_digest()}
    write_json(frozen, str(folder / "frozen.json"))
    return frozen


def code_digest() -> str:
    """One digest over the package's source files, by name."""
    root = Path(__file__).resolve().parent
    return canonical.digest([[str(f.relative_to(root)), hashlib.sha256(f.read_bytes()).hexdigest()] for f in sorted(root.rglob("*.py")) if "llm" not in f.parts])


def _verified(folder: Path, policy: Policy) -> dict:
    frozen = json.loads((folder / "frozen.json").read_text())
    if frozen["policy_digest"] != policy.digest:
        raise ValueError("the policy is not the one this bundle was frozen with")
    for name, digest in frozen["digests"].items():
        if hashlib.sha256((folder / f"{name}.jsonl").read_bytes()).hexdigest() != digest:
            raise ValueError(f"frozen table {name} was altered")
    return frozen


def csv_line(cells: list[Column]) -> Column:
    """Cells as one line: a cell is quoted only if it holds a comma, a quote or a line break; null is empty."""
    text = [F.coalesce(c.cast("string"), F.lit("")) for c in cells]
    return F.concat_ws(",", *(F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in text))


def no_provenance(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "variant_id string, routes array<string>, refs array<string>, lit array<string>, hgvs_c string, hgvs_p string")


def export_rows(ranked: DataFrame, provenance: DataFrame, policy_id: str, policy_status: str, observation_search: str) -> DataFrame:
    """The ranked table as text columns: ranks, features and where each allele was found. Alleles without provenance stay, with empty cells."""
    j = ranked.join(provenance, "variant_id", "left")
    p = F.when(F.col("p_predictor").isNull(), "").when(F.col("p").isNotNull(), general(F.col("p"))).otherwise(F.col("p_status"))
    links = F.transform(F.array_sort(F.map_entries("contributing_link_ids")), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], ",")))
    cells = {
        "primary_channel": "channel", "K": "k", "O": "o", "P_predictor": "p_predictor", "P": p, "ordering_tuple": F.concat_ws("|", "ordering_tuple"), "roles": F.concat_ws(";", "roles"), "consequence_terms": F.concat_ws(";", "consequence_terms"),
        "o_search_status": F.lit(observation_search), "editing_status": F.lit("not_assessed"), "flags": F.concat_ws(";", "flags"), "contributing_link_ids": F.array_join(links, ";"), "discovery_routes": F.concat_ws(";", "routes"),
        "source_refs": F.concat_ws(";", "refs"), "literature_evidence": F.concat_ws(";", "lit"), "policy_id": F.lit(policy_id), "policy_status": F.lit(policy_status),
    }
    text = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    return j.select(*(text(cells.get(c, c)).alias(c) for c in CSV_COLUMNS))


def ranked_csv(rows: DataFrame, strata: tuple[str, ...]) -> list[str]:
    """Lines of the ranked table by channel, stratum and place; few rows for each gene, so they are gathered on the driver."""
    place = first_match([(F.col("stratum") == s, i) for i, s in enumerate(strata)], 99)
    lines = rows.orderBy("primary_channel", place, F.col("display_index").cast("bigint")).select(csv_line([F.col(c) for c in CSV_COLUMNS]).alias("line"))
    return [",".join(CSV_COLUMNS), *(r["line"] for r in lines.toLocalIterator())]


def report_lines(frozen: dict, policy: Policy, ranked: DataFrame, rows: DataFrame, exclusions: DataFrame | None) -> list[str]:
    """The report: scope and notices, strata with what does not tell rows apart, ranked rows, and at most LISTED_EXCLUSIONS exclusions."""
    scope = frozen["scope"]
    out = [f"# Nomination report: {scope['gene']} / {scope['disease']}", ""]
    if scope["synthetic"]:
        out += ["> **Synthetic fixture run.** Nothing here is an observation about a real gene or allele.", ""]
    out += [f"> Profile `{frozen['policy_id']}` is **{policy.status}**; ranks are proposals for review.", ""]
    if scope["source_failures"]:
        out += ["> **Partial run.** Sources failed: " + "; ".join(scope["source_failures"]), ""]
    excluded = {r["status"]: r["count"] for r in exclusions.groupBy("status").count().collect()} if exclusions is not None else {}  # one row for each status
    out += ["## Scope", "", f"- Mechanism {frozen['mechanism']}, evidence {frozen['evidence_digest']}"]
    out += [f"- Route {route}: {n} mentions" for route, n in sorted(scope["routes"].items())]
    out += [f"- Mentions: {scope['mentions']}; alleles: {ranked.count()}; excluded: {sum(excluded.values())}", f"- Observation sources: {scope['observation_search']}"]
    out += [f"- Excluded as {status}: {n}" for status, n in sorted(excluded.items())]
    out += ["", "## Strata", "", "| channel | stratum | n | tiers | largest tie | same for all | p missing |", "|-|-|-|-|-|-|-|"]
    warnings = []
    strata = FE.report(ranked).withColumn("place", first_match([(F.col("stratum") == s, i) for i, s in enumerate(policy.strata)], 99))
    for r in strata.orderBy("channel", "place").collect():
        same = [k[4:].upper() for k in ("key_k", "key_o", "key_p") if r[f"{k}_degenerate"]]
        out.append(f"| {r['channel']} | {r['stratum']} | {r['n']} | {r['n_tiers']} | {r['largest_tie_group']} | {', '.join(same) or '-'} | {r['p_missing']} |")
        where = f"{r['channel']}/{r['stratum']}"
        predictor = policy.predictors.get(r["stratum"])
        warnings += [f"- {where}: {k} is the same for all {r['n']}" for k in same if r["n"] > 1 and not (k == "P" and predictor is None)]
        warnings += [f"- {where}: all {r['n']} are tied"] if r["n"] > 1 and r["n_tiers"] == 1 else []
        warnings += [f"- {where}: no predictor is declared"] if predictor is None else []
    out += (["", "Warnings:", "", *warnings] if warnings else []) + ["", "## Ranked alleles"]
    now = None
    place = first_match([(F.col("stratum") == s, i) for i, s in enumerate(policy.strata)], 99)
    for r in rows.orderBy("primary_channel", place, F.col("display_index").cast("bigint")).toLocalIterator():
        if now != (now := (r["primary_channel"], r["stratum"])):
            out += ["", f"### {now[0]} / {now[1]}", "", "| tier | allele | K | O | P | characterization | sources | flags |", "|-|-|-|-|-|-|-|-|"]
        tie = f" (of {r['tie_group_size']})" if r["tie_group_size"] != "1" else ""
        papers = sum(x.startswith("PMID:") for x in r["source_refs"].split(";"))
        sources = r["discovery_routes"].replace(";", ", ") + (f"; {papers} PMID" if papers else "")
        out.append(f"| {r['tier_rank']}{tie} | {r['label']} {r['hgvs_p'] or r['hgvs_c']} | {r['K']} | {r['O']} | {r['P'] or '-'} | {r['characterization']} | {sources or '-'} | {r['flags'] or '-'} |")
    out += ["", "## Excluded mentions", ""]
    listed = sum(n for status, n in excluded.items() if status != "out_of_scope")
    if excluded.get("out_of_scope"):
        out += [f"{excluded['out_of_scope']} resolved mentions are outside the scope.", ""]
    if listed:
        out += ["| mention | status | reason |", "|-|-|-|"]
        out += [f"| {r['mention_id']} | {r['status']} | {r['reason']} |" for r in exclusions.where("status <> 'out_of_scope'").orderBy("mention_id").limit(LISTED_EXCLUSIONS).collect()]
        out += [f"{listed - LISTED_EXCLUSIONS} more are in the exclusions."] if listed > LISTED_EXCLUSIONS else []
    elif not excluded:
        out.append("None.")
    return out


def derive(spark: SparkSession, bundle: str, policy: Policy, out: str) -> dict:
    """Features, ranks, report and manifest from a bundle that is first verified; nothing depends on time or place."""
    folder, target = Path(bundle), Path(out)
    frozen = _verified(folder, policy)
    target.mkdir(parents=True, exist_ok=True)
    tables = {n: spark.read.parquet(str(folder / f"{n}.parquet")) for n in frozen["digests"]}
    features = FE.derive_features(tables["variants"], tables["annotations"], tables["evidence"], frozen["mechanism"], policy)
    ranked = FE.rank_features(features, policy).persist()
    digests = {"features": write_jsonl(features.withColumn("contributing_link_ids", F.to_json("contributing_link_ids")), str(target / "features.jsonl"), ["variant_id"])}
    rows = export_rows(ranked, tables.get("provenance", no_provenance(spark)), policy.policy_id, policy.status, frozen["scope"]["observation_search"])
    for name, lines in (("ranked_variants.csv", ranked_csv(rows, policy.strata)), ("report.md", report_lines(frozen, policy, ranked, rows, tables.get("exclusions")))):
        data = ("\n".join(lines) + "\n").encode()
        (target / name).write_bytes(data)
        digests[name] = hashlib.sha256(data).hexdigest()
    ranked.unpersist()
    manifest = {"status": "partial" if frozen["scope"]["source_failures"] else "complete", "derived": digests, "content_digest": canonical.digest(sorted(digests.items())), **frozen}
    write_json(manifest, str(target / "manifest.json"))
    return manifest


def replay(spark: SparkSession, bundle: str, policy: Policy, earlier: str, out: str) -> bool:
    """Derive again and compare with an earlier result byte by byte (by digest)."""
    before = json.loads((Path(earlier) / "manifest.json").read_text())
    return derive(spark, bundle, policy, out)["content_digest"] == before["content_digest"]
