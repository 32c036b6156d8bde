"""Resource budgets and the errors that report them."""

from __future__ import annotations

from dataclasses import dataclass


class BudgetExceededError(Exception):
    """A document took more than its budget allows."""

    def __init__(self, budget: str, limit: int, actual: int):
        super().__init__(f"Budget exceeded: {budget} limit={limit} actual={actual}")
        self.payload = {"code": "BUDGET_EXCEEDED", "budget": budget, "limit": limit, "actual": actual}

    def __reduce__(self):
        return type(self), (self.payload["budget"], self.payload["limit"], self.payload["actual"])


@dataclass(frozen=True)
class Budgets:
    """Limits per document; None means unlimited."""

    maxInputBytes: int | None = None  # noqa: N815
    maxBufferedBytes: int | None = None  # noqa: N815
    maxNodes: int | None = None  # noqa: N815
    maxDepth: int | None = None  # noqa: N815
    maxTraceEvents: int | None = None  # noqa: N815
    maxTraceBytes: int | None = None  # noqa: N815
    maxTimeMs: int | None = None  # noqa: N815

    def enforce(self, budget: str, actual: int) -> None:
        limit = getattr(self, budget)
        if limit is not None and actual > limit:
            raise BudgetExceededError(budget, limit, actual)


UNLIMITED = Budgets()
