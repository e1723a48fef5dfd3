"""Validation of JSON records by rules: the errors of a record, in the order of the rules.

A record is JSON text. Its top-level values are kept as text, so that a field of the wrong kind
is told apart from one that is missing; a null value counts as present, as a wrong one. What is
no JSON object has the one error ``record: not an object``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Routes, families, tool modes and failure modes that records may name.
ROUTES = ("answer", "ask", "verify", "date_bound_answer", "abstain", "re_anchor", "execute", "refuse")
FAMILIES = ("volatile_current", "stale_premise_trap", "stable_control", "date_boundary", "query_neutrality", "ambiguous_time_frame", "freshness_long_run")
TOOL_MODES = ("no_tool", "tool_available", "tool_available_or_no_tool")
FAILURE_MODES = ("stale_commitment", "unsupported_current_claim", "missing_date_boundary", "over_verification_on_stable", "fabricated_citation", "false_clarifying_question_on_stable", "stale_premise_accepted", "query_contamination", "verification_started_not_completed", "no_response")
TASK_FIELDS = ("id", "suite", "family", "domain", "language", "user_prompt", "temporal_volatility", "requires_current_verification", "tool_mode", "expected_routes", "disallowed_routes", "primary_metric")
LABEL_FIELDS = ("task_id", "allowed_routes", "preferred_route", "disallowed_routes", "failure_modes_to_check")


def _listed(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


class Rules:
    """Rules over one JSON column; each method gives an array of errors."""

    def __init__(self, record: Column):
        self.fields = F.from_json(record, "map<string,string>")

    def there(self, field: str) -> Column:
        return F.coalesce(F.map_contains_key(self.fields, F.lit(field)), F.lit(False))

    def value(self, field: str) -> Column:
        return F.element_at(self.fields, F.lit(field))

    def _when(self, test: Column, field: str, why: str) -> Column:
        return F.when(test, F.array(F.lit(f"field '{field}': {why}"))).otherwise(F.array().cast("array<string>"))

    def required(self, fields: tuple[str, ...]) -> Column:
        return F.concat(*(self._when(~self.there(f), f, "missing") for f in fields))

    def one_of(self, field: str, values: tuple[str, ...], why: str | None = None) -> Column:
        good = F.coalesce(self.value(field).isin(*values), F.lit(False))
        return self._when(self.there(field) & ~good, field, why or f"not in {_listed(values)}")

    def named(self, field: str, values: tuple[str, ...], what: str) -> Column:
        """A single name; the error cites it."""
        good = F.coalesce(self.value(field).isin(*values), F.lit(False))
        cited = F.coalesce(F.concat(F.lit("'"), self.value(field), F.lit("'")), F.lit("None"))
        return F.when(self.there(field) & ~good, F.array(F.concat(F.lit(f"field '{field}': {what} "), cited))).otherwise(F.array().cast("array<string>"))

    def list_of(self, field: str, values: tuple[str, ...], what: str, filled: bool) -> Column:
        """A list, not empty if ``filled``, of known names; one error for each other name."""
        items = F.from_json(self.value(field), "array<string>")
        is_list = F.coalesce(F.trim(self.value(field)).startswith("["), F.lit(False)) & items.isNotNull()
        bad = ~is_list | (F.size(items) == 0) if filled else ~is_list
        other = F.filter(items, lambda x: x.isNull() | ~x.isin(*values))
        told = F.transform(other, lambda x: F.concat(F.lit(f"field '{field}': {what} "), F.coalesce(F.concat(F.lit("'"), x, F.lit("'")), F.lit("None"))))
        wrong = F.array(F.lit(f"field '{field}': must be {'non-empty list' if filled else 'list'}"))
        none = F.array().cast("array<string>")
        return F.when(~self.there(field), none).when(bad, wrong).otherwise(F.coalesce(told, none))

    def all(self, *errors: Column) -> Column:
        return F.when(self.fields.isNull(), F.array(F.lit("record: not an object"))).otherwise(F.concat(*errors))


def task_errors(record: Column) -> Column:
    r = Rules(record)
    return r.all(
        r.required(TASK_FIELDS), r.one_of("family", FAMILIES), r.one_of("tool_mode", TOOL_MODES),
        r.list_of("expected_routes", ROUTES, "unknown route", True), r.list_of("disallowed_routes", ROUTES, "unknown route", False),
        r.one_of("temporal_volatility", ("low", "medium", "high"), "must be low|medium|high"), r.one_of("primary_metric", ("route_correctness",), "v0.1 uses 'route_correctness'"),
    )


def label_errors(record: Column) -> Column:
    r = Rules(record)
    return r.all(
        r.required(LABEL_FIELDS), r.list_of("allowed_routes", ROUTES, "unknown route", True), r.named("preferred_route", ROUTES, "unknown route"),
        r.list_of("disallowed_routes", ROUTES, "unknown route", False), r.list_of("failure_modes_to_check", FAILURE_MODES, "unknown failure mode", False),
    )
