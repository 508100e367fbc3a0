"""Queries of this subpackage and their reference SQL."""

from __future__ import annotations

from . import clustering, contamination, impact_search, lattice, packing, periodicity, quality, secrets, sharding, simhash, substring_dedup, toxicity, warc

QUERIES = {
    "op1_decontamination": contamination.op1_decontamination,
    "op2_packing": packing.op2_packing,
    "op3_warc": warc.op3_warc,
    "op4_sharding": sharding.op4_sharding,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality": quality.op6_quality,
    "op7_lattice": lattice.op7_lattice,
    "op8_secrets": secrets.op8_secrets,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_simhash": simhash.op10_simhash,
    "op11_periodic_runs": periodicity.op11_periodic_runs,
    "op12_ball_clusters": clustering.op12_ball_clusters,
    "op13_impact_search": impact_search.op13_impact_search,
}
ORACLES: dict[str, str] = {
    "op1_decontamination": contamination.ORACLE_SQL,
    "op3_warc": warc.ORACLE_SQL,
    "op6_quality": quality.ORACLE_SQL,
    "op9_substring_dedup": substring_dedup.ORACLE_SQL,
    "op11_periodic_runs": periodicity.ORACLE_SQL,
    "op12_ball_clusters": clustering.ORACLE_SQL,
    "op13_impact_search": impact_search.ORACLE_SQL,
}
