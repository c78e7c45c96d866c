"""All queries of the library outside the training-data subpackage, and their SQL."""

from __future__ import annotations

from tidewater.plans import bundles, clustered, details, factors, glass, intake, integrals, layouts, learning, network, planning, policies, pricing, provenance, relational, replays, resampled, river, samples, seasons, sections, streams, validation

PLANS = (network, river, validation, integrals, seasons, policies, replays, pricing, bundles, glass, samples, resampled, clustered, factors, sections, layouts, learning, planning, provenance, intake, relational, details, streams)
#: Plans over generated layouts: they read no table, so they are library code and not queries.
GENERATED = {
    "hex_layout", "solar_states", "field_efficiency", "zone_stats", "geometry_checks", "ray_efficiency", "mooring", "design_pareto", "worst_cases",
    "spaced_mirrors", "sobol_designs", "pruning_variants",
}
QUERIES: dict = {k: v for p in PLANS for k, v in p.QUERIES.items() if k not in GENERATED}
ORACLES: dict = {k: v for p in PLANS for k, v in p.ORACLES.items() if k not in GENERATED}
