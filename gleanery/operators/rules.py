"""Ordered question screening: small talk, blocks, sensitive topics, explicit allows, then optional models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import constants as K
from gleanery.config import DEFAULTS, Settings
from gleanery.functions import text as T


def _decision(allowed: bool, reason, redirect: str = "", small_talk: bool = False, reply: str = "") -> Column:
    return F.struct(F.lit(allowed).alias("allowed"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"),
                    F.lit(redirect).alias("redirect_msg"), F.lit(small_talk).alias("small_talk"), F.lit(reply).alias("canned_reply"))


def rule_decision(question: Column) -> Column:
    """Struct decided by the first matching rule, or null when no rule matches."""
    q = T.strip(question)
    arms = [(T.matches(q, p, True), _decision(True, "small_talk", small_talk=True, reply=r)) for p, r in K.SMALL_TALK]
    arms += [(T.matches(q, p, True), _decision(False, "rule_block", r)) for p, r in K.BLOCK_RULES]
    arms += [(T.matches(q, p, True), _decision(False, "sensitive_flag", K.SENSITIVE_REPLY)) for p in K.SENSITIVE_RULES]
    arms += [(T.matches(q, p, ci), _decision(True, "rule_allow")) for p, ci in K.ALLOW_RULES]
    out = F.when(*arms[0])
    for condition, value in arms[1:]:
        out = out.when(condition, value)
    return out


def check(
    questions: DataFrame,
    text_col: str = "text",
    classify: Callable[[Column], Column] | None = None,
    policy: Callable[[Column], Column] | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Append the decision's fields.

    ``classify`` gives the probability that a question no rule decided is unrelated; ``policy`` tells whether a
    sensitive question must be blocked (skipped in mode "rules"). Both may wrap a pandas UDF; a null answer, like a
    missing model, lets the question pass.
    """
    q = F.col(text_col)
    empty = T.strip(F.coalesce(q, F.lit(""))) == ""
    staged = questions.withColumn("_rule", rule_decision(q))
    undecided = _decision(True, "classifier_fallback_allow")
    if classify is not None:
        p = classify(q)
        label = lambda verdict: F.concat(F.lit(f"classifier_{verdict} (score="), F.format_number(p, 2), F.lit(")"))
        undecided = F.when(p >= settings.guardrail_threshold, _decision(False, label("block"), K.OUT_OF_SCOPE_REPLY)).when(
            p.isNotNull(), _decision(True, label("allow"))).otherwise(_decision(True, "classifier_error_allow"))
    decided = F.when(F.col("_rule").isNotNull(), F.col("_rule")).otherwise(undecided)
    if policy is not None and settings.guardrail_mode != "rules":
        blocked = policy(q)
        decided = F.when(F.col("_rule.reason") == "sensitive_flag", F.when(blocked, _decision(False, "llm_policy_block", K.POLICY_REPLY)).when(
            ~blocked, _decision(True, "llm_policy_allow")).otherwise(_decision(True, "llm_policy_error_allow"))).otherwise(decided)
    final = F.when(empty, _decision(False, "empty_query", K.EMPTY_REPLY)).otherwise(decided)
    return staged.withColumn("_d", final).select(*questions.columns, "_d.*")


def consent(message: Column) -> Column:
    """Reading of an answer to the personalization question: "yes", "question" or "no"."""
    low = F.lower(T.strip(message))
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    return F.when(has(K.CONSENT_YES), "yes").when(has(K.CONSENT_QUESTION) & ~has(K.CONSENT_NO), "question").otherwise("no")
