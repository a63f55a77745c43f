"""Row types, the value-with-a-reason struct, and the enumerations that results are written in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = "2.1.0-draft"

# The data contract.
ALLELE_TYPES = ("snv", "deletion", "insertion", "delins", "mnv")
IDENTITY_STATUSES = ("resolved", "ambiguous", "insufficient", "ref_mismatch", "unsupported", "unmapped")
EXACT_MATCHES = ("exact_genomic", "transcript_supported_exact")
OBSERVED_STATUSES = ("value_present", "not_searched", "searched_not_found", "not_available", "access_denied", "not_applicable", "unsupported", "failed")
NEEDS_REASON = ("failed", "unsupported", "not_applicable", "access_denied")
INSTALLING = ("exact_allele_edit", "allele_construct")
QUERY_DISEASE = ("exact", "approved_synonym")
ACCEPTED_STATES = ("accepted_auto", "accepted_human")
CONCORDANCE = {"concordant": 3, "partial": 2, "not_assessable": 1, "discordant": 0}
OBSERVATION_TIER = {"case_controlled": 3, "case_uncontrolled": 2, "related_condition": 1, "none": 0}


def observed(value: T.DataType) -> T.StructType:
    """A value and why it is or is not there."""
    return T.StructType([
        T.StructField("status", T.StringType()), T.StructField("value", value), T.StructField("source_snapshot_ids", T.ArrayType(T.StringType())),
        T.StructField("reason_code", T.StringType()), T.StructField("retrieval_event_id", T.StringType()),
    ])


def _observed(status, value: Column, snapshots, reason, event) -> Column:
    text = F.lit(None).cast("string")
    return F.struct(
        F.lit(status).alias("status"), value.alias("value"), (F.array(*snapshots) if snapshots else F.array().cast("array<string>")).alias("source_snapshot_ids"),
        (F.lit(reason) if reason is not None else text).alias("reason_code"), (F.lit(event) if event is not None else text).alias("retrieval_event_id"),
    )


def present(value: Column, snapshot: Column) -> Column:
    return _observed("value_present", value, [snapshot], None, None)


def absent(status: str, kind: str = "double", reason: str | None = None, snapshots=(), event: str | None = None) -> Column:
    return _observed(status, F.lit(None).cast(kind), list(snapshots), reason, event)


def observed_valid(o: Column) -> Column:
    """The rules that tie a status to value, reason, retrieval and sources."""
    there = o["status"] == "value_present"
    sources = F.coalesce(F.size(o["source_snapshot_ids"]), F.lit(0)) > 0
    return (
        o["status"].isin(*OBSERVED_STATUSES)
        & (there == o["value"].isNotNull())
        & (~o["status"].isin(*NEEDS_REASON) | o["reason_code"].isNotNull())
        & ((o["status"] != "searched_not_found") | (o["retrieval_event_id"].isNotNull() & sources))
        & (~there | sources)
    )


MENTION = "mention_id string, raw_text string, route string, assembly string, chrom string, pos bigint, ref string, alt string, roles array<string>, resolution_method string, resolution_status string, resolution_note string, source_refs array<string>, ordinal bigint"
DECISION = "decision_id string, link_id string, claim_id string, claim_revision int, reviewer_type string, human_review string, effective_state string, sequence bigint"
LINK = "link_id string, claim_id string, claim_revision int, mention_id string, identity_match string, disease_relationship string"
