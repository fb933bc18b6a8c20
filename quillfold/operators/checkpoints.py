"""Human checkpoints: the registry, raising, resolving, and the open queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Type, blocking, required evidence, allowed resolutions, event emitted on resolution.
REGISTRY = (
    ("CAPTCHA_REQUIRED", True, (), ("solved", "abandoned"), None),
    ("MFA_REQUIRED", True, (), ("completed", "abandoned"), None),
    ("ACCOUNT_REQUIRED", True, (), ("authenticated", "skipped"), "state_changed"),
    ("ELIGIBILITY_AMBIGUOUS", True, ("rules_url",), ("eligible", "not_eligible", "decline_to_state"), "eligibility_screened"),
    ("FINANCIAL_FIELD_REVIEW", True, ("field_label",), ("value_provided", "leave_blank", "abandoned"), None),
    ("LEGAL_ATTESTATION_REQUIRED", True, ("attestation_text",), ("affirmed", "declined"), "attestation_recorded"),
    ("SIGNATURE_REQUIRED", True, (), ("signed", "declined"), "attestation_recorded"),
    ("RECOMMENDATION_REQUIRED", True, ("recommender_name",), ("requested", "received", "abandoned"), "recommendation_requested"),
    ("DOCUMENT_UPLOAD_REQUIRED", True, ("document_kind",), ("uploaded", "skipped"), "artifact_added"),
    ("APPLICATION_FEE", True, ("fee_evidence",), ("paid", "abandoned"), None),
    ("FIELD_MAPPING_UNCERTAIN", False, ("field_label", "confidence"), ("value_provided", "leave_blank", "mapping_confirmed"), None),
    ("BLOCKED_FIELD_PRESENT", True, ("field_label",), ("handled", "abandoned"), None),
    ("SUBMIT_APPROVAL", True, ("filled_screenshot", "rendered_digest"), ("approved", "rejected"), None),
    ("AWARD_NOTICE_REVIEW", True, ("notice_source", "notice_ref"), ("verified_win", "not_a_win", "scam_suspected"), "artifact_added"),
    ("PDF_DRAFT_REVIEW", True, ("draft_pdf_path",), ("reviewed", "abandoned"), None),
    ("PORTAL_MALFUNCTION", True, ("error_detail",), ("retry", "abandoned"), None),
    ("SCORING_FAILED", False, ("batch_size",), ("scored_manually", "skipped"), None),
    ("SUSPECTED_PROMPT_INJECTION", False, ("listing_url", "patterns"), ("benign", "malicious", "skipped"), None),
    ("CORPUS_AUTHORSHIP_UNVERIFIED", True, ("sourceId", "excerpt", "wordCount"), ("author_wrote_it", "llm_assisted", "not_mine", "unsure"), "corpus_doc_verified"),
    ("EVAL_PREREGISTRATION_REVIEW", True, ("prereg_sha256", "bands", "primary_endpoint"), ("signed", "revised", "abandoned"), "eval_preregistered"),
    ("VOICE_REGISTER_DRIFT", False, ("requested_register", "nearest_register", "violated_features"), ("ship_anyway", "regenerate", "dropped"), None),
    ("CORPUS_SKELETON_LEAK", False, ("sourceId", "violation", "skeleton"), ("accepted", "rewritten", "dropped"), None),
)
RESOLVER_ROLES = ("human",)
QUEUE_CONTEXT = (
    "slug", "name", "fieldLabel", "path", "reason", "situation", "url", "portal", "competingRules", "reasons",
    "batchSize", "patterns", "listing_url",
)


def registry(spark: SparkSession) -> DataFrame:
    rows = [(t, b, list(e), list(r), list(RESOLVER_ROLES), emits) for t, b, e, r, emits in REGISTRY]
    return spark.createDataFrame(
        rows,
        "checkpoint_type string, blocking boolean, required_evidence array<string>, allowed_resolutions array<string>, "
        "resolver_roles array<string>, emits string",
    )


def checkpoint_id(kind: Column, application_id: Column, discriminator: Column) -> Column:
    text = F.concat_ws("|", kind, F.coalesce(application_id, F.lit("")), F.coalesce(discriminator, F.lit("")))
    return F.concat(F.lit("cp_"), F.substring(F.sha2(text, 256), 1, 12))


def raise_checkpoints(proposed: DataFrame, known: DataFrame, open_now: DataFrame) -> DataFrame:
    """Proposals (``checkpoint_type, application_id, discriminator, evidence map``) with ``outcome``.

    An unregistered type is refused; an already open checkpoint is left alone; the same id proposed
    twice is raised once. Missing evidence is recorded and does not stop the raise.
    """
    keyed = proposed.withColumn(
        "checkpoint_id", checkpoint_id(F.col("checkpoint_type"), F.col("application_id"), F.col("discriminator"))
    )
    once = keyed.groupBy("checkpoint_id").agg(
        F.min_by(F.struct(*[c for c in keyed.columns if c != "checkpoint_id"]), "ord").alias("p")
    ).select("checkpoint_id", "p.*")
    # the registry is a fixed dimension of 22 rows
    joined = once.join(F.broadcast(known), "checkpoint_type", "left").join(
        open_now.select("checkpoint_id", F.lit(True).alias("_open")), "checkpoint_id", "left"
    )
    outcome = (
        F.when(F.col("allowed_resolutions").isNull(), "refused-unregistered").when(F.col("_open"), "already-open").otherwise("raised")
    )
    missing = F.array_except(F.coalesce("required_evidence", F.array().cast("array<string>")), F.map_keys("evidence"))
    return joined.select(
        "checkpoint_id", "checkpoint_type", "application_id", "blocking", outcome.alias("outcome"), missing.alias("missing_evidence")
    )


def resolve_checkpoints(resolutions: DataFrame, open_now: DataFrame, known: DataFrame) -> DataFrame:
    """Resolutions (``checkpoint_id, resolution, resolved_by, role, evidence map``) judged in order.

    ``outcome`` is accepted or the first reason to reject; accepted rows name the follow-up event
    and its effect.
    """
    opened = open_now.select("checkpoint_id", "checkpoint_type", "application_id", F.col("evidence").alias("_had"))
    joined = resolutions.join(opened, "checkpoint_id", "left").join(F.broadcast(known), "checkpoint_type", "left")
    no_map = F.create_map().cast("map<string,string>")
    have = F.array_union(F.map_keys(F.coalesce("_had", no_map)), F.map_keys(F.coalesce("evidence", no_map)))
    missing = F.array_except("required_evidence", have)
    role = F.coalesce("role", F.lit("human"))
    outcome = (
        F.when(F.col("checkpoint_type").isNull(), "not-open")
        .when(~F.array_contains(F.col("allowed_resolutions"), F.col("resolution")), "resolution-not-allowed")
        .when(~F.array_contains(F.col("resolver_roles"), role), "role-not-allowed")
        .when(F.length(F.trim(F.coalesce("resolved_by", F.lit("")))) == 0, "no-resolver")
        .when(F.size(missing) > 0, F.concat(F.lit("missing-evidence: "), F.array_join(missing, ",")))
        .otherwise("accepted")
    )
    r, t = F.col("resolution"), F.col("checkpoint_type")
    effect = (
        F.when(t == "ELIGIBILITY_AMBIGUOUS", F.when(r == "eligible", "pass").when(r == "not_eligible", "disqualified").otherwise("declined_to_state"))
        .when(t == "ACCOUNT_REQUIRED", F.when(r == "authenticated", "AUTHENTICATED").otherwise("DISCOVERED"))
        .when(t == "AWARD_NOTICE_REVIEW", F.when(r == "verified_win", "verified").when(r == "scam_suspected", "suspected-scam").otherwise("unverified"))
        .when(t.isin("LEGAL_ATTESTATION_REQUIRED", "SIGNATURE_REQUIRED"), F.when(r.isin("affirmed", "signed"), "affirmed").otherwise("not-affirmed"))
        .otherwise(r)
    )
    ok = F.col("outcome") == "accepted"
    return (
        joined.withColumn("outcome", outcome)
        .withColumn("emits", F.when(ok, F.col("emits")))
        .withColumn("effect", F.when(ok & F.col("emits").isNotNull(), effect))
        .select("checkpoint_id", "checkpoint_type", "application_id", "resolution", "outcome", "emits", "effect")
    )


def open_queue(opened: DataFrame) -> DataFrame:
    """Open checkpoints, blocking first, then oldest; the context keeps allow-listed keys only."""
    context = F.from_json("context", "map<string,string>")
    safe = F.map_filter(context, lambda k, _: k.isin(*QUEUE_CONTEXT))
    return opened.withColumn("context", safe).orderBy(F.desc("blocking"), "created_at", "checkpoint_id")
