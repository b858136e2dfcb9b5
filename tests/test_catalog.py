"""Queries against DuckDB on the smallest tables: one per operator family, all with LESIONLENS_ALL=1.

``check_oracles.py`` runs the whole catalogue on larger tables.
"""

import os

import pytest

import check_oracles
from __spark_entry__ import entry
from lesionlens.plans import catalog

SF = os.environ.get("LESIONLENS_TEST_SF", "/root/testdata/sf0.001")
FAMILIES = (
    "voxel_scan", "reconstruct_match", "dice", "surface_voxels", "surface_dice", "connected_components", "lesion_match",
    "morphology", "grid_per_case", "crossfit_select", "crossfit_per_case", "tta_mean", "masked_zscore", "paired_join",
    "bootstrap_paired", "source_target_gap", "domain_summary", "spearman", "partial_rho_table", "mann_whitney", "kruskal",
    "bh_fdr", "qcut_median", "standardize", "missing_modalities", "discover_cases", "table_digest", "manifest",
    "json_flatten", "geometry_violations", "avg_rank_ranged", "quantiles_ranged", "suffix_min_ranged", "lookup_salted",
    "lesion_match_tiles", "grid_per_case_tiles", "ensemble_mean", "count_guard",
)
CHECKED = sorted(catalog.ORACLES) if os.environ.get("LESIONLENS_ALL") else FAMILIES
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return check_oracles.connect(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    problem = check_oracles.compare(spark, con, SF, name)[1]
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry(spark).columns == ["case_id", "region", "dice"]
