"""Lint on a stream: findings with their level for each sheet, as the batch operators give them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from markwright.operators.lint import lint
from markwright.operators.rules import apply_severity


def lint_stream(sheets: DataFrame, applicable: DataFrame) -> DataFrame:
    """(doc_id, pack_id, check, line_no, detail, rule_id, level) from a streaming (doc_id, pack_id, text); rules are static."""
    return apply_severity(lint(sheets, None, "doc_id", "pack_id"), applicable)
