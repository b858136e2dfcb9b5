"""Catalogue, data-quality part: inventories, reconciliation, digests, JSON documents and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from lesionlens.functions.scalars import case_id
from lesionlens.operators import guards, inventory as inv
from lesionlens.plans.check_sql import fx, with_
from lesionlens.plans.fixtures import fixture, table
from lesionlens.sources import readers


def _files(spark, sf):
    return inv.parse_inventory(fixture(spark, sf, "inventory"))


def parse_modality(spark, sf):
    return _files(spark, sf)


def case_id_q(spark, sf):
    df = fixture(spark, sf, "inventory").select(F.concat(F.lit("/data/in/"), "path").alias("path"))
    pages = table(spark, sf, "pages").select(F.col("url").alias("path"))
    return df.unionByName(pages).select("path", case_id("path").alias("case_id"))


def dup_modalities(spark, sf):
    return inv.duplicate_modalities(_files(spark, sf))


def missing_modalities(spark, sf):
    return inv.missing_modalities(_files(spark, sf)).select("case_id", F.concat_ws(",", "missing").alias("missing"))


def channel_map(spark, sf):
    return inv.channel_map(_files(spark, sf))


def _folds(spark, sf):
    """Prediction files by nation's fold, those of customers in debt twice; labels and exports with gaps."""
    c = table(spark, sf, "customer").withColumn("fold", F.expr("cast(c_nationkey % 5 as int)"))
    name = lambda folder, suffix: F.concat(F.lit(folder), "c_name", F.lit(suffix)).alias("path")
    one = c.select("fold", name("p/", ".npz"))
    again = c.where("c_acctbal < 0").select(F.expr("cast((fold + 1) % 5 as int)").alias("fold"), name("p/", ".npz"))
    labels = c.where("c_mktsegment <> 'MACHINERY'").select(name("l/", ".nii.gz"))
    return one.unionByName(again), labels, c.select("fold", name("p/", ".nii.gz"))


def discover_cases(spark, sf):
    return inv.discover_cases(*_folds(spark, sf))[0]


def discover_violations(spark, sf):
    return inv.discover_cases(*_folds(spark, sf))[1]


def _metric_rows(spark, sf):
    """Metric rows by nation's fold, a split by each customer's last order."""
    metrics = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), F.expr("cast(c_nationkey % 5 as int)").alias("fold"))
    last = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(F.max("o_orderkey").alias("o"))
    return metrics, last.select("case_id", F.expr("cast(o % 5 as int)").alias("fold"))


def fold_mismatch(spark, sf):
    return guards.fold_mismatch(*_metric_rows(spark, sf))


def fold_leak_guard(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.expr("cast(o_orderkey % 5 as int)").alias("fold"))
    return guards.fold_leaks(o, "case_id", "fold")


def count_guard(spark, sf):
    return guards.count_guard(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], table(spark, sf, "orders").count())


def reconcile_sets(spark, sf):
    users = table(spark, sf, "events").select(F.col("user_id").alias("id"))
    buyers = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    return guards.reconcile(users, buyers, ["id"])


def content_digest(spark, sf):
    return guards.content_digest(table(spark, sf, "documents"), "text").select("doc_id", "sha256")


def table_digest(spark, sf):
    return guards.table_digest(guards.content_digest(table(spark, sf, "documents"), "text"))


def label_manifest(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.explode(F.array("quality", "toxic")).alias("lab"))
    # some files are named for no case: their cases lack a file, and they have no labels
    case = F.when(F.col("doc_id") % 17 == 3, -1 - F.col("doc_id")).otherwise(F.col("doc_id"))
    files = table(spark, sf, "documents").select(case.alias("doc_id"), "text", F.concat(case.cast("string"), F.lit(".nii.gz")).alias("name"))
    out = guards.manifest(labels, files, "doc_id", "lab", "text", "name")
    return out.withColumn("labels", F.concat_ws(",", F.col("labels").cast("array<string>")))


def _summaries(spark, sf):
    """A summary document per user, built from event properties and parsed back as JSON."""
    text = F.concat(
        F.lit('{"prediction_file": "/out/'), F.col("event_id").cast("string"), F.lit('.nii.gz", "reference_file": "/ref/'),
        F.col("event_id").cast("string"), F.lit('.nii.gz", "metrics": {"(1, 2, 3)": {"Dice": 0.5, "FP": '),
        F.get_json_object("props", "$.k"), F.lit(', "FN": 2}, "(3,)": {"Dice": '),
        (F.get_json_object("props", "$.k").cast("int") / F.lit(128.0)).cast("string"), F.lit(', "FP": 1, "FN": '),
        F.get_json_object("props", "$.k"), F.lit("}}}"),
    )
    item = "prediction_file string, reference_file string, metrics map<string, struct<Dice double, FP double, FN double>>"
    rows = table(spark, sf, "events").select(F.col("user_id").alias("fold"), F.from_json(text, item).alias("m"))
    return rows.select("fold", F.array("m").alias("metric_per_case"))


def json_flatten(spark, sf):
    return readers.flatten_summary(_summaries(spark, sf))


def map_explode(spark, sf):
    return readers.explode_map(table(spark, sf, "events"), "props", ["event_id"])


def posexplode_splits(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    text = F.format_string('[{"val": ["a%d"]}, {"val": ["b%d", "c%d"]}, {"val": []}]', "l_partkey", "l_suppkey", "l_linenumber")
    rows = t.select(text.alias("document"))
    return readers.explode_splits(rows, "document").groupBy("fold", "case_id").agg(F.count(F.lit(1)).alias("n"))


def _geometries(spark, sf):
    """Headers from embedding vectors: 16 affine entries, 3 sizes; the output differs in known ways by id."""
    e = table(spark, sf, "embeddings")
    affine = F.transform(F.slice("embedding", 1, 16), lambda v: v.cast("double"))
    shape = F.array(*[(F.pmod(F.col("vec_id") * k, F.lit(7)) + 100).cast("int") for k in (1, 2, 3)])
    ref = e.select("vec_id", affine.alias("affine"), shape.alias("shape"))
    kind = F.col("vec_id") % 5
    delta = F.when(kind == 1, 1e-9).when(kind == 2, 1e-7).when(kind == 3, 1e-3).otherwise(0.0)
    moved = F.transform("affine", lambda v, i: v + F.when(i == 0, delta).otherwise(0.0))
    size = F.transform("shape", lambda v, i: v + F.when((kind == 4) & (i == 2), 1).otherwise(0))
    short = F.when(F.col("vec_id") % 50 == 0, F.slice(moved, 1, 12)).otherwise(moved)
    out = ref.select("vec_id", short.alias("affine"), size.alias("shape"))
    renamed = lambda k, r, far: F.when(F.col("vec_id") % k == r, far - F.col("vec_id")).otherwise(F.col("vec_id"))
    return ref.withColumn("vec_id", renamed(31, 4, -1)), out.withColumn("vec_id", renamed(29, 3, -1_000_000_000))  # each side has cases that the other lacks


def geometry_guard(spark, sf):
    ref, out = _geometries(spark, sf)
    exact = guards.geometry_matches(ref, out, "vec_id").withColumnRenamed("matches", "exact")
    near = guards.geometry_matches(ref, out, "vec_id", 1e-5).withColumnRenamed("matches", "near")
    return exact.join(near, "vec_id")


def geometry_violations(spark, sf):
    ref, out = _geometries(spark, sf)
    return guards.geometry_violations(ref, out, "vec_id", 1e-5).select(
        "vec_id", "reason", F.concat_ws("x", F.col("ref_shape").cast("array<string>")).alias("ref_shape"),
        F.concat_ws("x", F.col("out_shape").cast("array<string>")).alias("out_shape"))


QUERIES = {
    "parse_modality": parse_modality, "case_id": case_id_q, "dup_modalities": dup_modalities,
    "missing_modalities": missing_modalities, "channel_map": channel_map, "discover_cases": discover_cases,
    "discover_violations": discover_violations, "fold_mismatch": fold_mismatch, "fold_leak_guard": fold_leak_guard,
    "count_guard": count_guard, "reconcile_sets": reconcile_sets, "content_digest": content_digest,
    "table_digest": table_digest, "manifest": label_manifest, "json_flatten": json_flatten, "map_explode": map_explode,
    "posexplode_splits": posexplode_splits, "geometry_guard": geometry_guard, "geometry_violations": geometry_violations,
}

I = fx("inventory")
PARSED = ("parsed", r"""select path, coalesce(nullif(regexp_extract(path, '^(.*)-(t1n|t1c|t2f|t2w)\.nii\.gz$', 1), ''), regexp_extract(path, '^(.+)_(0000|0001|0002|0003)\.nii\.gz$', 1)) as case_id,
    coalesce(nullif(regexp_extract(path, '^(.*)-(t1n|t1c|t2f|t2w)\.nii\.gz$', 2), ''),
      case regexp_extract(path, '^(.+)_(0000|0001|0002|0003)\.nii\.gz$', 2) when '0000' then 't1n' when '0001' then 't1c' when '0002' then 't2f' when '0003' then 't2w' end) as modality
  from inventory""")
NAMED = ("named", """select path, case_id, modality, case modality when 't1n' then '0000' when 't1c' then '0001' when 't2f' then '0002' else '0003' end as channel
  from parsed where modality is not null""")
FOLDS = ("found", """select cast(c_nationkey % 5 as int) as fold, c_name as case_id, c_mktsegment as seg, false as again from customer
    union all select cast((c_nationkey + 1) % 5 as int), c_name, c_mktsegment, true from customer where c_acctbal < 0""")
KIND = ("g", """with e as (select vec_id as v, vec_id % 5 as kind, vec_id % 50 = 0 as short, 100 + vec_id % 7 as a, 100 + (2 * vec_id) % 7 as b,
      100 + (3 * vec_id) % 7 as c, cast(embedding[1] as double) as e0 from embeddings),
    r as (select case when v % 31 = 4 then -1 - v else v end as vec_id, * from e), o as (select case when v % 29 = 3 then -1000000000 - v else v end as vec_id, * from e)
    select coalesce(r.vec_id, o.vec_id) as vec_id, coalesce(r.kind, o.kind) as kind, coalesce(r.short, o.short) as short, coalesce(r.a, o.a) as a,
      coalesce(r.b, o.b) as b, coalesce(r.c, o.c) as c, coalesce(r.e0, o.e0) as e0, r.v is not null as in_ref, o.v is not null as in_out
    from r full join o on r.vec_id = o.vec_id""")
GEOM_EXACT = "in_ref and in_out and not short and kind <> 4 and e0 + (case kind when 1 then 1e-9 when 2 then 1e-7 when 3 then 1e-3 else 0.0e0 end) = e0"
GEOM_NEAR = "in_ref and in_out and not short and kind not in (3, 4)"

ORACLES = {
    "parse_modality": with_(I, PARSED, NAMED) + "select path, case_id, modality, channel from named",
    "case_id": with_(I) + r"""select path, case when path like '%.nii.gz' then regexp_extract(path, '([^/]*)\.nii\.gz$', 1)
        else regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1') end as case_id
        from (select concat('/data/in/', path) as path from inventory union all select url from pages) t""",
    "dup_modalities": with_(I, PARSED, NAMED) + "select case_id, modality, count(*) as n_files from named group by 1, 2 having count(*) > 1",
    "missing_modalities": with_(I, PARSED, NAMED) + """select c.case_id, string_agg(m.modality, ',' order by m.modality) as missing
        from (select distinct case_id from named) c cross join (select unnest(['t1n', 't1c', 't2f', 't2w']) as modality) m
        where not exists (select 1 from named n where n.case_id = c.case_id and n.modality = m.modality) group by 1""",
    "channel_map": with_(I, PARSED, NAMED) + "select path as source, concat(case_id, '_', channel, '.nii.gz') as destination from named",
    "discover_cases": with_(FOLDS) + "select row_number() over (order by fold, case_id) - 1 as case_index, fold, case_id, concat('p/', case_id, '.npz') as path from found",
    "discover_violations": with_(FOLDS) + """select 'several folds' as reason, case_id from found group by case_id having count(distinct fold) > 1
        union all select 'no label', case_id from found where seg = 'MACHINERY'
        union all select 'no export', case_id from found where again""",
    "fold_mismatch": """select c_custkey as case_id, cast(c_nationkey % 5 as int) as fold, f as split_fold from customer
        left join (select o_custkey, cast(max(o_orderkey) % 5 as int) as f from orders group by 1) o on o_custkey = c_custkey
        where f is null or f <> c_nationkey % 5""",
    "fold_leak_guard": "select o_custkey as case_id, count(distinct o_orderkey % 5) as n_folds from orders group by 1 having count(distinct o_orderkey % 5) > 1",
    "count_guard": """select * from (select count(*) as n_rows, (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem)) as n_distinct,
        (select count(*) from orders) as expected from lineitem) t where n_rows <> n_distinct or n_rows <> expected""",
    "reconcile_sets": """select coalesce(d.id, l.id) as id, case when l.id is null then 'missing' when d.id is null then 'extra' else 'ok' end as status
        from (select distinct user_id as id from events) d full outer join (select distinct o_custkey as id from orders) l on l.id = d.id""",
    "content_digest": "select doc_id, sha256(text) as sha256 from documents",
    "table_digest": with_(("h", "select sha256(text) as s from documents")) + """select n_rows, sha256(concat_ws('|', n_rows, a, b, c, d)) as digest from (
        select count(*) as n_rows, """ + ", ".join(
            f"sum(cast(concat('0x', substr(s, {1 + 16 * k}, 16)) as ubigint)) as {n}" for k, n in enumerate("abcd")) + " from h) t",
    "manifest": """with p as (select distinct doc_id, lab from (select doc_id, quality as lab from labels union all select doc_id, toxic from labels) t),
        q as (select doc_id, string_agg(cast(lab as varchar), ',' order by lab) as labels, bool_and(lab in (0, 1, 2, 3)) as valid from p group by 1),
        f as (select doc_id, concat(doc_id, '.nii.gz') as file, sha256 from (
          select case when doc_id % 17 = 3 then -1 - doc_id else doc_id end as doc_id, sha256(text) as sha256 from documents) x),
        j as (select doc_id, file, coalesce(labels, '') as labels, valid, sha256,
              case when f.sha256 is null then 'missing' when q.labels is null then 'extra' else 'ok' end as status from q full join f using (doc_id))
        select *, (select count(distinct doc_id) from j where status = 'ok') as n_cases from j""",
    "json_flatten": with_(("e", "select event_id, user_id, cast(json_extract_string(props, '$.k') as int) as k from events"))
        + """select cast(event_id as varchar) as case_id, user_id as fold, concat('/out/', event_id, '.nii.gz') as prediction_path,
        concat('/ref/', event_id, '.nii.gz') as reference_path, 0.5e0 as wt_dice, cast(k as double) as wt_fp, 2.0e0 as wt_fn,
        cast(null as double) as tc_dice, cast(null as double) as tc_fp, cast(null as double) as tc_fn, k / 128.0e0 as et_dice, 1.0e0 as et_fp,
        cast(k as double) as et_fn from e""",
    "map_explode": "select event_id, 'k' as key, json_extract_string(props, '$.k') as value from events",
    "posexplode_splits": """select fold, case_id, count(*) as n from (
        select 0 as fold, concat('a', l_partkey) as case_id from lineitem union all select 1, concat('b', l_suppkey) from lineitem
        union all select 1, concat('c', l_linenumber) from lineitem) t group by 1, 2""",
    "geometry_guard": with_(KIND) + f"select vec_id, {GEOM_EXACT} as exact, {GEOM_NEAR} as near from g",
    "geometry_violations": with_(KIND) + f"""select vec_id, case when not in_out then 'missing' when not in_ref then 'extra' when kind = 4 then 'shape' else 'affine' end as reason,
        case when in_ref then concat(a, 'x', b, 'x', c) else '' end as ref_shape,
        case when in_out then concat(a, 'x', b, 'x', c + case when kind = 4 then 1 else 0 end) else '' end as out_shape from g where not ({GEOM_NEAR})""",
}
