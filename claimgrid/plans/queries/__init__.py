"""Queries over the driver tables, each with the SQL it must agree with."""

from claimgrid.plans.queries.base import ORACLES, QUERIES  # noqa: F401
from claimgrid.plans.queries import text, reconcile, files, grouped, similar, contracts, events, clusters, findings  # noqa: F401,E402
