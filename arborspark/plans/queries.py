"""The registered queries."""

from __future__ import annotations

from arborspark.plans import content_plans, facet_plans, git_plans, rule_plans, text_plans, tree_plans  # noqa: F401 - they register
from arborspark.plans.registry import QUERIES, Query
from arborspark.plans.rule_plans import q_visible_totals  # noqa: F401 - the flagship


def queries() -> dict[str, Query]:
    return dict(QUERIES)
