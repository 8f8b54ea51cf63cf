"""Parsing of a judge's replies, and its prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a judge is asked to answer with.
LIKELY, DIFFERENT, UNCERTAIN, SKIPPED = "LIKELY_DUPLICATE", "DIFFERENT", "UNCERTAIN", "SKIPPED"
EVIDENCE, NO_EVIDENCE, ERROR = "EVIDENCE", "NO_EVIDENCE", "ERROR"


def screen_verdict(reply: Column) -> Column:
    """Of a screening reply; no reply, or neither word, is uncertain."""
    said = F.upper(reply)
    return F.when(F.contains(said, F.lit(LIKELY)), F.lit(LIKELY)).when(F.contains(said, F.lit(DIFFERENT)), F.lit(DIFFERENT)).otherwise(F.lit(UNCERTAIN))


def is_evidence(reply: Column) -> Column:
    """Whether a per-view reply claims evidence; no reply claims none."""
    said = F.upper(reply)
    return F.coalesce(F.contains(said, F.lit(EVIDENCE)) & ~F.contains(said, F.lit(NO_EVIDENCE)), F.lit(False))


def view_verdict(reply: Column) -> Column:
    return F.when(reply.isNull(), F.lit(ERROR)).when(is_evidence(reply), F.lit(EVIDENCE)).otherwise(F.lit(NO_EVIDENCE))


def angle_prompt(template: str, angle: Column) -> Column:
    """A template with one %d for the angle in degrees."""
    return F.format_string(template, angle)
