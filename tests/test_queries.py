"""Registered queries against their check SQL on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from aerolake.plans import catalog
from aerolake.plans.fixtures import TABLES
from tests.conftest import SF

SAMPLE = """b1_pose_filter_counts b2_filter_scenes b4_video_frames b5_confidence_filter_stats b9_normal_edge b15_normalize_set_warp
b18_audit_views c2_project_join c5_frustum_pairs c9_asof_pose c12_nn_join d6_split_tree d7_assign_seams_members d8_temporal_chunks_merged
e1_fit_sim3 e5_align_chunks_yaw_translation f2_trajectory_error f6_pose_auc f11_benchmark_rollup g5_stratified_sample g7_coverage_fill
g14_plan_dynamic_batches g15_plan_balanced_batches h3_rasterize a2_ingest_cameras a3_recon_observations a3_recon_images_lines
b13_augment_poses d10_order_spatial e7_balance_statistics e9_align_parent_graph_scenes e11_icp_rigid g9_sample_random_walk_scenes
g11_sample_tree_scenes""".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(table):
    cols = sorted(table.column_names)
    data = table.select(cols).to_pydict()
    fix = lambda v: "~" if v is None or v != v else round(v, 4) + 0.0 if isinstance(v, float) else v
    return cols, sorted((tuple(fix(data[c][i]) for c in cols) for i in range(table.num_rows)), key=lambda r: tuple(map(str, r)))


def test_every_query_has_a_check():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLES) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    got = rows(entry.queries()[name](spark, SF).toArrow())
    assert got == rows(con.execute(entry.oracle_sql()[name]).to_arrow_table())
    assert got[1]
