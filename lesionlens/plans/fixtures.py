"""Inputs of the catalogue, derived from the given star-schema tables.

Each fixture is one SQL text over whole tables in the common subset of Spark and ANSI SQL, so a query and
its check read the same rows. Values that are ranked, tied or thresholded come from integers.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

SIDE = 20  # voxels per axis of the derived volumes

FIXTURES = {
    # voxels on a 20^3 grid: line items scattered over suppliers' volumes
    "voxels": """
        select case_id, cast(case_id % 5 as int) as fold, z, y, x, cast(ref_lab as tinyint) as ref_lab,
               cast(pct_wt / 100.0e0 as float) as p_wt, cast(pct_tc / 100.0e0 as float) as p_tc,
               cast(pct_et / 100.0e0 as float) as p_et, pct_wt, pct_tc, pct_et,
               cast(case when pct_et > 50 then 3 when pct_tc > 50 then 1 when pct_wt > 50 then 2 else 0 end
                    as tinyint) as export_lab
        from (
          select l_suppkey as case_id,
                 cast((l_orderkey * 31 + l_linenumber * 7) % 20 as int) as z,
                 cast((l_partkey * 17 + l_linenumber * 3) % 20 as int) as y,
                 cast(cast(l_quantity as bigint) % 20 as int) as x,
                 min(case when (l_orderkey + l_partkey) % 3 = 0 then 0
                          when l_returnflag = 'A' then 1 when l_returnflag = 'N' then 2 else 3 end) as ref_lab,
                 max(cast(round(l_extendedprice) as bigint) % 101) as pct_wt,
                 max(cast(round(l_tax * 100) as bigint) * 12) as pct_tc,
                 max(cast(round(l_discount * 100) as bigint) * 10) as pct_et
          from {lineitem} group by 1, 2, 3, 4) v""",
    # raw member predictions: the line number names the ensemble member
    "members": """
        select l_suppkey as case_id, l_linenumber as member,
               cast((l_orderkey * 31 + l_linenumber * 7) % 20 as int) as z,
               cast((l_partkey * 17 + l_linenumber * 3) % 20 as int) as y,
               cast(cast(l_quantity as bigint) % 20 as int) as x,
               cast(max(cast(round(l_extendedprice) as bigint) % 101) / 100.0e0 as float) as p_wt,
               cast(max(cast(round(l_tax * 100) as bigint) * 12) / 100.0e0 as float) as p_tc,
               cast(max(cast(round(l_discount * 100) as bigint) * 10) / 100.0e0 as float) as p_et
        from {lineitem} group by 1, 2, 3, 4, 5""",
    # image intensities in cents, channel by line number
    "image": """
        select l_suppkey as case_id, cast((l_linenumber - 1) % 4 as int) as channel,
               cast((l_orderkey * 31 + l_linenumber * 7) % 20 as int) as z,
               cast((l_partkey * 17 + l_linenumber * 3) % 20 as int) as y,
               cast(cast(l_quantity as bigint) % 20 as int) as x,
               max(cast(round(l_extendedprice * 100) as bigint)) / 100.0e0 as intensity,
               max(case when l_returnflag = 'N' then 1 else 0 end) as inside
        from {lineitem} group by 1, 2, 3, 4, 5""",
    # seven configurations of one score table
    "scores": """
        select concat('c', cast(l_linenumber as string)) as config, l_partkey as case_id,
               case when max(cast(round(l_discount * 100) as bigint)) = 0 then null
                    else max(cast(round(l_discount * 100) as bigint)) / 10.0e0 end as dsc_et,
               max(cast(round(l_tax * 100) as bigint)) / 8.0e0 as dsc_tc,
               max(cast(l_quantity as bigint)) / 50.0e0 as dsc_wt
        from {lineitem} group by l_linenumber, l_partkey""",
    # one row per case: orders play the voxels of a case, status the reference, priority the prediction
    "features": """
        select case_id, fold, domain, cast(wt_volume as bigint) as wt_volume, cast(tc_volume as bigint) as tc_volume,
               cast(et_volume as bigint) as et_volume, cast(wt_pred as bigint) as pred_wt_volume,
               cast(tc_pred as bigint) as pred_tc_volume, cast(et_pred as bigint) as pred_et_volume,
               2.0e0 * et_tp / nullif(et_pred + et_volume, 0) as et_dice,
               2.0e0 * tc_tp / nullif(tc_pred + tc_volume, 0) as tc_dice,
               2.0e0 * wt_tp / nullif(wt_pred + wt_volume, 0) as wt_dice,
               (2.0e0 * et_tp / nullif(et_pred + et_volume, 0) + 2.0e0 * tc_tp / nullif(tc_pred + tc_volume, 0)
                + 2.0e0 * wt_tp / nullif(wt_pred + wt_volume, 0)) / 3.0e0 as mean_dice,
               et_volume * 1.0e0 / nullif(wt_volume, 0) as et_wt_ratio,
               max_cents * 1.0e0 / nullif(sum_cents, 0) as largest_fraction, cast(n_large as bigint) as n_large
        from (
          select c_custkey as case_id, cast(c_custkey % 5 as int) as fold, c_mktsegment as domain,
                 sum(case when o_orderstatus in ('F', 'O') then 1 else 0 end) as wt_volume,
                 sum(case when o_orderstatus = 'F' or (o_orderstatus = 'O' and o_totalprice < 100000) then 1 else 0 end) as tc_volume,
                 sum(case when o_orderstatus = 'F' then 1 else 0 end) as et_volume,
                 sum(case when o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM') then 1 else 0 end) as wt_pred,
                 sum(case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end) as tc_pred,
                 sum(case when o_orderpriority = '1-URGENT' then 1 else 0 end) as et_pred,
                 sum(case when o_orderstatus in ('F', 'O') and o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM') then 1 else 0 end) as wt_tp,
                 sum(case when (o_orderstatus = 'F' or (o_orderstatus = 'O' and o_totalprice < 100000))
                           and o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end) as tc_tp,
                 sum(case when o_orderstatus = 'F' and o_orderpriority = '1-URGENT' then 1 else 0 end) as et_tp,
                 max(cast(round(o_totalprice * 100) as bigint)) as max_cents,
                 sum(cast(round(o_totalprice * 100) as bigint)) as sum_cents,
                 sum(case when o_totalprice >= 200000 then 1 else 0 end) as n_large
          from {customer} left join {orders} on c_custkey = o_custkey group by c_custkey, c_mktsegment) f""",
    # volume files in two naming conventions, one modality left out now and then, some doubled, some unrelated
    "inventory": """
        select case when c_custkey % 2 = 0
                    then concat('case-', cast(c_custkey as string), '-', modality, '.nii.gz')
                    else concat('case-', cast(c_custkey as string), '_', channel, '.nii.gz') end as path
        from {customer} cross join (
          select 't1n' as modality, '0000' as channel union all select 't1c', '0001'
          union all select 't2f', '0002' union all select 't2w', '0003') m
        where not (c_acctbal > 9000 and modality = 't2w')
        union all select concat('case-', cast(c_custkey as string), '-t1n.nii.gz') from {customer} where c_acctbal < 0
        union all select concat('note-', cast(s_suppkey as string), '.nii.gz') from {supplier}""",
    # pseudo p values, family by return flag, some missing
    "pvalues": """
        select l_returnflag as family, l_suppkey as test_id,
               case when (sum(cast(l_quantity as bigint)) * 37 + l_suppkey * 101) % 9973 < 500 then null
                    else (1 + (sum(cast(l_quantity as bigint)) * 37 + l_suppkey * 101) % 9973) / 10000.0e0 end as p_value
        from {lineitem} group by l_returnflag, l_suppkey""",
    # score rows with the scorer's own aggregate rows mixed in
    "subjects": """
        select concat('case-', lpad(cast(p_partkey as string), 6, '0'), '-seg.nii.gz') as subject_id, p_retailprice as value
        from {part}
        union all select concat('mean-', s_name), s_acctbal from {supplier}
        union all select concat('case-', cast(s_suppkey as string), '-seg.nii.gz'), s_acctbal from {supplier}""",
}


# Rows of these go to the task of their voxel before they are grouped: hardly any share a voxel, so that a task grouping ahead of
# the shuffle would hold all rows of its scan split.
CELL = (
    "l_suppkey", "cast((l_orderkey * 31 + l_linenumber * 7) % 20 as int)", "cast((l_partkey * 17 + l_linenumber * 3) % 20 as int)",
    "cast(cast(l_quantity as bigint) % 20 as int)",
)
GROUPED = {"voxels": ("lineitem", CELL), "members": ("lineitem", CELL), "image": ("lineitem", CELL)}
GROUPED_ROWS = (500_000, 2_000_000)  # of them a task, about 350 bytes each: the first up to UNSORTED tasks, the second at most
UNSORTED = 200  # rows for more tasks than this are held and sorted as they are sent (spark.shuffle.sort.bypassMergeThreshold)


def tables_of(text: str) -> list[str]:
    return list(dict.fromkeys(n for _, n, _, _ in string.Formatter().parse(text) if n))


def grouping_tasks(rows: int) -> int:
    """Tasks that group so many rows; neither their rows nor those held for sending grow with the table."""
    few, most = (-(-rows // n) for n in reversed(GROUPED_ROWS))
    return max(few, min(most, UNSORTED))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = FIXTURES[name]
    tables = {t: table(spark, sf_dir, t) for t in tables_of(text)}
    if name in GROUPED:
        source, by = GROUPED[name]
        tasks = grouping_tasks(tables[source].count())  # in the files' footers
        if tasks > spark.sparkContext.defaultParallelism:
            tables[source] = tables[source].repartition(tasks, *[F.expr(e) for e in by])
    return spark.sql(text, **tables)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ansi(name: str) -> str:
    """The fixture's text with plain table names."""
    text = FIXTURES[name]
    return text.format(**{t: t for t in tables_of(text)})
