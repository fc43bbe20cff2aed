"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from surgelight.plans import core, general, trips

QUERIES = core.QUERIES | trips.QUERIES | general.QUERIES
ORACLES = core.ORACLES | trips.ORACLES | general.ORACLES
flagship = core.flagship
