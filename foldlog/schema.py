"""The event envelope, the payload fields that operators read, and the allowed values."""

from __future__ import annotations

#: One row per event. Streams are ordered by stream_position (1, 2, ...), the log by global_position.
EVENT_DDL = (
    "event_id string, stream_id string, stream_position bigint, global_position bigint, event_type string, "
    "event_version int, payload string, metadata string, recorded_at timestamp_ntz"
)
#: Fields that any operator reads from a payload; others are ignored and cost nothing.
PAYLOAD_DDL = (
    "application_id string, applicant_id string, requested_amount_usd double, agent_id string, session_id string, "
    "model_version string, risk_tier string, confidence_score double, recommended_limit_usd double, analysis_duration_ms double, "
    "fraud_score double, rule_id string, failure_reason string, orchestrator_agent_id string, recommendation string, "
    "contributing_agent_sessions array<string>, model_versions map<string,string>, reviewer_id string, `override` boolean, "
    "override_reason string, final_decision string, approved_amount_usd double, screening_result string, "
    "required_rules array<string>, integrity_hash string, previous_hash string, events_hashed bigint, reason string, "
    "cleared_by string, regulation_set string, entity_type string, regulatory_basis string"
)

# Names that must equal those in stored logs.
STATES = (
    "SUBMITTED", "AWAITING_ANALYSIS", "ANALYSIS_COMPLETE", "COMPLIANCE_REVIEW", "PENDING_DECISION", "APPROVED_PENDING_HUMAN",
    "DECLINED_PENDING_HUMAN", "REFERRED", "FINAL_APPROVED", "FINAL_DECLINED")
SESSION_TYPES = (
    "AgentContextLoaded", "DecisionOrchestratorSessionStarted", "CreditAnalysisCompleted", "FraudScreeningCompleted",
    "DecisionGenerated", "SessionTerminated", "AgentSessionClosed")
SESSION_PARTIAL = ("AgentContextLoaded", "CreditAnalysisRequested", "FraudScreeningRequested", "ComplianceCheckRequested")
CONTEXT_PARTIAL = (
    "CreditAnalysisRequested", "FraudScreeningRequested", "ComplianceCheckRequested", "AgentContextLoaded", "DecisionOrchestratorSessionStarted")
SESSION_ENDS = ("SessionTerminated", "AgentSessionClosed")
CONFIDENCE_FLOOR = 0.6
