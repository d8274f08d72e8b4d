"""Guardrail predicates and safety flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .text import any_of, cleaned


def _found(text: Column, patterns: list[str]) -> Column:
    return any_of(F.lower(cleaned(text)), patterns)


def injection_risk(text: Column) -> Column:
    return _found(text, V.INJECTION)


def bias_sensitive(text: Column) -> Column:
    return _found(text, V.BIAS)


def refusal(text: Column) -> Column:
    return _found(text, V.REFUSAL)


def loaded(text: Column) -> Column:
    return _found(text, V.LOADED)


def safety_flags(question: Column, answer: Column, citations: Column, tool_calls: Column) -> Column:
    """Flags in fixed order; citations and tool calls are counts."""
    flags = F.array(
        F.when(injection_risk(question), "prompt_injection_risk"),
        F.when(bias_sensitive(question), "bias_sensitive_request"),
        F.when(F.coalesce(citations, F.lit(0)) == 0, "low_support"),
        F.when(refusal(answer), "grounded_refusal"),
        F.when(F.coalesce(tool_calls, F.lit(0)) > 0, "tool_augmented"),
        F.when(loaded(answer), "loaded_language_in_answer"),
    )
    return F.array_compact(flags)
