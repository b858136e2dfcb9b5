"""One query for each operator, over whole tables with production parameters, and the SQL it is checked with."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from lesionlens.llm import decontaminate, exact_dedup, language_id, lexical_search, mixing, near_dup, phrases, quality, substring_dedup, suffix_dedup, token_counts, toxicity, url_filter
from lesionlens.llm.columns import held_out, sized
from lesionlens.llm.sampling import labelled_sample
from lesionlens.session import checkpoint_root, materialize


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def with_fold(scored: DataFrame, least: float) -> DataFrame:
    predicted = (F.col("score") >= least).cast("int").alias("predicted")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", predicted)


def op1_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = exact_dedup.verdicts(table(spark, sf, "documents"), exact_dedup.new_index(spark))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op2_near_dup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.components(table(spark, sf, "documents"))


def op3_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("held_out", held_out("doc_id"))
    model = language_id.train(docs.where("not held_out"))
    return language_id.predict(docs, model, keep=["held_out"])


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    sample = labelled_sample(docs, table(spark, sf, "labels"), "toxic", toxicity.FIT_ROWS)
    return with_fold(toxicity.predict(docs, toxicity.train(sample)), 0.5)


def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf, "documents")).drop("kept_text")


def op6_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of ``documents`` as they stand after a history: labelled documents come as drafts of half their text and are revised, and
    a copy of each comes under another id and is deleted; that batch is applied twice and the ledger compacted."""
    ledger = token_counts.TokenLedger(spark, f"{checkpoint_root(spark).rstrip('/')}/token-ledger-{uuid4().hex}")
    docs = table(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    labelled = sized(materialize(table(spark, sf, "labels").select("doc_id", F.lit(True).alias("draft")).distinct(), "labelled"))
    drafts = docs.join(labelled, "doc_id", "left_semi")
    half = F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    first = docs.join(labelled, "doc_id", "left").withColumn("text", F.when(F.col("draft"), half).otherwise(F.col("text")))
    passing = drafts.withColumn("doc_id", -1 - F.col("doc_id"))
    ledger.apply("first texts, and passing documents", first.drop("draft").unionByName(passing))
    changes = drafts.withColumn("gone", F.lit(False)).unionByName(passing.withColumns({"gone": F.lit(True), "text": F.lit(None).cast("string")}))
    for _ in range(2):  # the second time is a replay
        ledger.apply("whole texts, and deletions", changes, delete=F.col("gone"))
    ledger.compact()
    return ledger.rollup()


def op7_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge(table(spark, sf, "pages"))


def op8_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    queued, line = mixing.mix(table(spark, sf, "documents"))
    return mixing.taken(queued, line).select("doc_id", "size", "source_size", "target", "taken")



def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality.train(labelled_sample(docs, table(spark, sf, "labels"), "quality", quality.FIT_ROWS))
    return with_fold(quality.predict(docs, model), 0.3)


def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf, "documents")).drop("kept")


def op13_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    found = lexical_search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_near_dup, op3_language_id, op4_toxicity, op5_substring_dedup, op6_token_counts, op7_url_filter, op8_decontamination, op9_mixing, op10_quality, op11_collocations, op12_suffix_dedup, op13_lexical_search)}

OP1_SQL = """
with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)
"""

OP5_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, unnest(range(1, len(w) - 33)) as i, w from d),
h as (select doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) as h from p),
r as (select h from h group by h having count(*) > 1),
g as (select distinct doc_id, unnest(range(i, i + 35)) as i from h join r using (h)),
k as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
j as (select k.doc_id, string_agg(word, ' ' order by k.i) as kept, count(*) as n from k anti join g on k.doc_id = g.doc_id and k.i = g.i group by k.doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join j using (doc_id)
"""

OP9_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         md5('7:' || doc_id) as place from documents),
q as (
  select *, coalesce(sum(size) over (partition by source order by place, doc_id, size
                                     rows between unbounded preceding and 1 preceding), 0) as start from d),
s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as turn from d group by source),
w as (select *, [3, 1, 2][(turn % 3 + 1)::int] as weight, source_size * 2 as lim from s),
l as (
  select *, (sum(source_size) over () * 1.5::double
             - coalesce(sum(lim) over (order by lim::double / weight, turn rows between unbounded preceding and 1 preceding), 0)::double)
            / sum(weight) over (order by lim::double / weight, turn rows between current row and unbounded following)::double as level
  from w),
f as (select *, lim::double / weight <= level as reached from l),
t as (
  select source, source_size,
         case when reached then lim::double else weight * max(case when not reached then level end) over () end as target
  from f),
v as (select *, start + unnest([0, source_size]) as first_word from q join t on q.source is not distinct from t.source),
y as (select *, case when first_word < target and first_word + size > target then 1 else size end as step from v where size > 0),
c as (select *, unnest(range(0, size, step)) as cut from y),
x as (select *, least(step, size - cut) as words, first_word + cut as begins from c),
r as (
  select *, coalesce(sum(words) over (order by case when begins < target and begins + words > target then 1.0000000000000002::double else (begins + words) / target end,
                                     '=' || source nulls first, begins rows between unbounded preceding and 1 preceding), 0) as before
  from (select doc_id, source, start, words, begins, target from x) x),
u as (
  select doc_id, source, start, sum(greatest(0, least(words, (select floor(sum(size) * 1.5::double)::bigint from d) - before)))::bigint as taken
  from r group by all)
select q.doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken
from q join t on q.source is not distinct from t.source
left join u on u.doc_id is not distinct from q.doc_id and u.source is not distinct from q.source and u.start = q.start and q.size > 0
"""

OP11_SQL = r"""
with d as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from d),
p as (select lang, w, unnest(range(1, len(w) + 1)) as i from w),
o as (select lang, w, i, unnest(range(1, least(4, len(w) - i + 1) + 1)) as s from p),
g as (select lang, w[i:i + s - 1] as g, count(*)::hugeint as f from o group by all),
n as (select lang, sum(f)::bigint as n from g where len(g) = 1 group by lang),
c as (select lang, g, f from g where len(g) > 1 and f >= 30),
k as (select lang, g, f as a, unnest(range(1, len(g))) as k from c),
x as (
  select k.lang, k.g, a, k, l.f as l, r.f as r, (2000000 * a) // (l.f + r.f) as score
  from k join g l on l.lang = k.lang and l.g = k.g[1:k] join g r on r.lang = k.lang and r.g = k.g[k + 1:len(k.g)]),
s as (select *, row_number() over (partition by lang, g order by score, k) as turn from x),
m as (select lang, g, f, unnest(range(2, len(g))) as s from c where len(g) > 2),
j as (select lang, g, f, s, unnest(range(1, len(g) - s + 2)) as i from m),
b as (select lang, g[i:i + s - 1] as g, max(f) as longer from j group by all),
z as (select s.* from s left join b on b.lang = s.lang and b.g = s.g where turn = 1 and not coalesce(100 * longer >= 80 * a, false)),
q as (
  select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank,
         array_to_string(g, ' ') as phrase, a::bigint as a, l::bigint as l, r::bigint as r, score::bigint as score from z)
select lang, rank, phrase, a, l, r, n, score from q join n using (lang) where rank <= 2000
"""

OP12_SQL = """
with d as (select row_number() over () as k, doc_id, encode(coalesce(text, '')) as x from documents),
p as (select k, x, unnest(range(0, octet_length(x) - 199)) as i from d),
h as (select k, i, md5(array_slice(x, i + 1, i + 200)) as h from p),
r as (select h from h group by h having count(*) > 1),
w as (select k, i, case when i - lag(i) over (partition by k order by i) <= 200 then 0 else 1 end as new from h join r using (h)),
s as (select k, i, sum(new) over (partition by k order by i) as run from w),
g as (select k, run, min(i) as a, max(i) + 200 as b from s group by k, run),
e as (select k, a, b, coalesce(lag(b) over (partition by k order by a), 0) as before from g),
j as (
  select k, count(*) as n_spans, sum(b - a) as n_removed, max(b) as b,
         string_agg(case when a > before then hex(array_slice(x, before + 1, a)) else '' end, '' order by a) as kept
  from e join d using (k) group by k)
select doc_id, octet_length(x)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(case when n_spans is null then x
                   else unhex(kept || case when b < octet_length(x) then hex(array_slice(x, b + 1, octet_length(x))) else '' end) end) as kept_sha256
from d left join j using (k)
"""

OP13_SQL = r"""
with d as (
  select row_number() over () as k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
s as (select count_if(len(w) > 0)::bigint as nn, sum(len(w))::bigint as ll from d),
i as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
o as (select k, doc_id, len(w)::bigint as n, unnest(w) as term from d),
t as (select k, doc_id, n, term, count(*)::bigint as tf from o where term in (select term from i) group by all),
f as (select term, count(*)::bigint as df from t group by term),
p as (
  select item_id, k, doc_id,
         sum(floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)))::bigint
             * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::bigint as score
  from i join t using (term) join f using (term), s group by item_id, k, doc_id),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from p where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 50
"""

ORACLES = {"op11_collocations": OP11_SQL, "op12_suffix_dedup": OP12_SQL, "op13_lexical_search": OP13_SQL, "op1_exact_dedup": OP1_SQL, "op5_substring_dedup": OP5_SQL, "op9_mixing": OP9_SQL}
