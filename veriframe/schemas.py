"""Schemas of the tables, declared and never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

#: Codes that a gold label may carry; predicted ones stay open. Fixed values.
MARKERS = (
    "none", "unknown", "hallucination", "off_topic_answer", "incomplete_answer", "context_mixing", "contradiction", "unsupported_claim",
    "reason_hallucinated_fact", "reason_off_topic_answer", "reason_irrelevant_chunk_used", "reason_chunk_fact_mixup", "reason_incomplete_answer",
    "reason_false_verification", "reason_outdated_fact", "reason_answer_for_operator", "reason_other", "reason_reveals_ai_identity",
    "reason_wrong_navigation", "reason_missed_complaint_handoff", "reason_missed_chunk_conditions",
)

#: Written forms for spark.read.schema().
CASE = "id string, question string, context string, answer string, faithfulness int, relevance int, marker string"
PREDICTION = (
    "id string, faithfulness_pred int, relevance_pred int, marker_pred string, raw_output string, invalid_output boolean, "
    "faithfulness_prob double, relevance_prob double, prob_method string, scores map<string,double>"
)
SCORES = "id string, scores map<string,double>, p_faith double, p_rel double"
FOLDS_FILE = (
    "schema_version int, corpus struct<path:string,sha256:string,n:int>, "
    "config struct<n_folds:int,n_repeats:int,seed:int,near_dup_threshold:double,use_chunk_key:boolean>, assignment map<string,array<int>>"
)
FOLDS = "id string, repeat int, fold int"
ID_LIST = "id string, pos bigint"
CHOICE = "text string, finish_reason string, tokens array<struct<token:string,logprob:double,top:map<string,double>>>"
SAMPLE_CACHE = "id string, samples array<string>"


def struct(spec: str) -> T.StructType:
    return T.StructType.fromDDL(spec)
