"""Every query of the transit library, with its SQL."""

from __future__ import annotations

from headway.plans import city, engine, footpaths, journeys, layovers, lines, search, service, tracks
from headway.streaming import fixes as streamed

FLAGSHIP = "a_hierarchy"
MODULES = (engine, service, city, lines, tracks, layovers, journeys, footpaths, search, streamed)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
