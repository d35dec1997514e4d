"""Runnable queries over the given tables, each with its SQL counterpart where one exists."""

from quaymetrics.plans import (  # noqa: F401
    evaluation,
    experiments,
    fixtures,
    joins,
    loans,
    mobility,
    policy,
    projections,
    quality,
    selections,
    sources,
    streams,
    trade,
    vintages,
)
