"""All catalogue queries: name -> (spark, sf_dir) -> DataFrame, and name -> checking SQL."""

from __future__ import annotations

from lesionlens.plans import catalog_case, catalog_checks, catalog_files, catalog_voxel

QUERIES = {**catalog_voxel.QUERIES, **catalog_case.QUERIES, **catalog_checks.QUERIES, **catalog_files.QUERIES}
ORACLES = {**catalog_voxel.ORACLES, **catalog_case.ORACLES, **catalog_checks.ORACLES, **catalog_files.ORACLES}
