"""Registered queries of the training-data operators, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotlake.llm import (
    chat,
    clustering,
    decontamination,
    embedding_dedup,
    minhash,
    mixing,
    pii,
    quality,
    repeats,
    repetition,
    search,
    toxicity,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _query(name: str, check: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check
        return fn

    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


SIZED = r"""sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
         md5(concat('mix/', coalesce(cast(doc_id as varchar), '-'))) as place
  from documents)"""


@_query(
    "op4_source_mixing",
    f"""
with recursive {SIZED},
sources as (
  select source, sum(size)::bigint as source_size,
         ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as weight
  from sized group by source),
ranked as (
  select *, row_number() over (order by source_size::hugeint * 3 / weight, source nulls last) as k from sources),
totals as (select coalesce(sum(source_size), 0)::bigint as total, coalesce(sum(weight), 1)::bigint as weights, count(*) as n from sources),
fill as (
  select 0::bigint as k, total as left_over, weights, false as done from totals
  union all
  select f.k + 1, (f.left_over - 3 * r.source_size)::bigint, (f.weights - r.weight)::bigint, false
  from fill f join ranked r on r.k = f.k + 1
  where 3 * r.source_size::hugeint * f.weights < r.weight::hugeint * f.left_over),
level as (select * from fill order by k desc limit 1),
targets as (
  select r.source, r.source_size, case when r.k <= l.k then (3 * r.source_size)::double
         else (r.weight * l.left_over)::double / l.weights::double end as target
  from ranked r, level l),
parts as (
  select *, case when target >= 3 * source_size then 3 when source_size = 0 then 0 else floor(target / source_size) end::int as whole
  from targets),
running as (
  select d.doc_id, d.source, d.size, p.source_size, p.target, p.whole,
         greatest(0.0::double, p.target - p.whole * p.source_size) as rest,
         coalesce(sum(d.size) over (partition by d.source order by d.place rows between unbounded preceding and 1 preceding), 0) as before
  from sized d join parts p on d.source is not distinct from p.source)
select doc_id, size::bigint as size, source_size, target,
       (size * (whole + case when before < rest and (rest - before) * 2 >= size then 1 else 0 end))::bigint as taken
from running
""",
)
def source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.planned(_table(spark, folder, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


WORDS5 = r"""worded as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents)"""


@_query(
    "op5_near_duplicates",
    f"""
with recursive {WORDS5},
runs as (
  select doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                        when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
  from worded),
sets as (select distinct doc_id, s from runs),
sizes as (select doc_id, count(*) as n from sets group by 1),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as m from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y
  where 100 * m >= 85 * (p.n + q.n - m)),
reach as (
  select doc_id as x, doc_id as r from documents
  union
  select l.y, reach.r from reach join links l on l.x = reach.x)
select d.doc_id, coalesce(max(z.n), 0)::bigint as n_shingles, min(r.r) as component_id, d.doc_id = min(r.r) as kept
from documents d join reach r on r.x = d.doc_id left join sizes z on z.doc_id = d.doc_id
group by d.doc_id
""",
)
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"), percent=85)


@_query("op7_warc_reassembly")
def warc_reassembly(spark: SparkSession, folder: str) -> DataFrame:
    return warc.page_records(_table(spark, folder, "pages")).drop("whole")


@_query("op3_quality_classifier")
def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query("op9_toxicity_classifier")
def toxicity_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query("op8_embedding_near_dedup")
def embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, folder, "embeddings"))


@_query("op10_pii_surrogates")
def pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return pii.replace_entities(_table(spark, folder, "documents"), count="n_entities").select("doc_id", "n_entities", "text")


@_query("op1_benchmark_decontamination")
def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.benchmark_matches(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_query(
    "op6_chat_perspectives",
    """
with said as (
  select conv_id, turn, coalesce(role, 'unknown') as speaker, replace(coalesce(text, ''), '<|im_', '<|im' || chr(8288) || '_') as text
  from conversations where conv_id is not null),
people as (select distinct conv_id, speaker as participant from said where speaker <> 'system'),
parts as (
  select p.conv_id, p.participant, s.turn, s.speaker, s.text,
         '<|im_start|>' || case when s.speaker = p.participant then 'assistant' when s.speaker = 'system' then 'system'
           else 'user name=' || replace(s.speaker, '<|im_', '<|im' || chr(8288) || '_') end || chr(10) as head,
         s.text || '<|im_end|>' || chr(10) as rest, s.speaker = p.participant as own
  from people p join said s on s.conv_id = p.conv_id)
select conv_id, participant, count(*)::int as n_turns,
       string_agg(head || rest, '' order by turn nulls first, speaker, text) as text,
       string_agg(length(head) || ':0,' || length(rest) || case when own then ':1' else ':0' end, ',' order by turn nulls first, speaker, text) as mask,
       sum(length(head) + length(rest))::bigint as n_chars,
       sum(case when own then length(rest) else 0 end)::bigint as n_trained
from parts group by conv_id, participant
""",
)
def chat_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    views = chat.rotate_perspectives(_table(spark, folder, "conversations"))
    run = lambda m: F.concat_ws(":", m["length"].cast("string"), m["trained"].cast("int").cast("string"))
    return views.withColumn("mask", F.array_join(F.transform("mask", run), ","))


@_query("op2_repeated_spans")
def repeated_spans(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.remove_repeats(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", repeats.kept_digest())


def _twice(width: int) -> str:
    """Characters of the words inside windows of ``width`` words that their text holds twice or more, and the number of these words."""
    return f"""
cover{width} as (
  select k, count(*) as n, sum(chars) as chars from (
    select distinct h.k, p.i, p.chars
    from (select k, i from (
            select k, i, count(*) over (partition by k, s) as times
            from (select k, i, array_to_string(w[i:i + {width - 1}], ' ') as s
                  from (select k, w, unnest(range(1, len(w) - {width - 2})) as i from worded12 where len(w) >= {width})))
          where times > 1) h
    join places p on p.k = h.k and p.i between h.i and h.i + {width - 1})
  group by k)"""


_WIDTHS = list(repetition.MOST_IN_NGRAMS)
_SHARES = " and ".join([f"100 * dup_chars_{w} <= {most} * word_chars" for w, most in repetition.MOST_IN_NGRAMS.items()])


@_query(
    "op12_repetition_rules",
    rf"""
with worded12 as (
  select row_number() over () as k, doc_id, coalesce(text, '') as text,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w
  from documents),
places as (select k, i, length(w[i]) as chars from (select k, w, unnest(range(1, len(w) + 1)) as i from worded12)),
lines as (
  select k, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) as chars,
         row_number() over (partition by k, line order by i) as again
  from (select k, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from worded12)
  where regexp_matches(line, '[^\x20\x09-\x0D]')),
lined as (
  select k, count(*) as n_lines, count(*) filter (again > 1) as n_dup_lines, coalesce(sum(chars) filter (again > 1), 0) as dup_line_chars
  from lines group by k),
{",".join(_twice(w) for w in (3, *_WIDTHS))},
counted as (
  select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
         coalesce(dup_line_chars, 0)::bigint as dup_line_chars, coalesce(cover3.n, 0)::bigint as n_repeat_words,
         {", ".join(f"coalesce(cover{w}.chars, 0)::bigint as dup_chars_{w}" for w in _WIDTHS)}
  from worded12 left join lined using (k) {" ".join(f"left join cover{w} using (k)" for w in (3, *_WIDTHS))})
select *, n_words < {repetition.LEAST_WORDS} or 100 * n_repeat_words > {repetition.MOST_REPEATED} * n_words as base_failed,
       not (n_words < {repetition.LEAST_WORDS} or 100 * n_repeat_words > {repetition.MOST_REPEATED} * n_words)
       and 100 * dup_line_chars <= {repetition.MOST_IN_LINES} * word_chars and {_SHARES} as kept
from counted
""",
)
def repetition_rules(spark: SparkSession, folder: str) -> DataFrame:
    m = F.col("rules")
    judged = repetition.with_rules(_table(spark, folder, "documents"), "rules")
    inside = [m["dup_chars"][k].alias(f"dup_chars_{w}") for k, w in enumerate(_WIDTHS)]
    return judged.select("doc_id", *[m[c].alias(c) for c in repetition.COUNTS], *inside, m["base_failed"].alias("base_failed"), m["kept"].alias("kept"))


def _lloyd(rounds: int) -> str:
    """Rounds of assignment and update over ``kept`` (vec_id, v) from ``c0`` (j, c)."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} as (
  select vec_id, v, arg_min(j, (d, j)) as j, min(d) as d from (
    select k.k, k.vec_id, k.v, c.j, list_sum(list_transform(list_zip(k.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d
    from kept k cross join c{r} c) group by k, vec_id, v)"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} as (
  select c.j, coalesce(m.c, c.c) as c from c{r} c left join (
    select j, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as c from (
      select j, i, sum(v[i])::bigint as s, count(*) as n from a{r}, (select unnest(range(1, {clustering.DIMS + 1})) as i) group by j, i) group by j) m on m.j = c.j)"""
            )
    return ",\n".join(steps)


@_query(
    "op11_centroid_clustering",
    f"""
with kept as (
  select row_number() over () as k, vec_id, list_transform(embedding, lambda x: floor({clustering.SCALE} * x::double)::bigint) as v from embeddings
  where len(embedding) = {clustering.DIMS} and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
c0 as (
  select (row_number() over (order by h, v) - 1)::int as j, v as c
  from (select sha256('{clustering.SEED}:' || vec_id::varchar) as h, v from kept) order by h, v limit {clustering.CLUSTERS}),
{_lloyd(clustering.ROUNDS)}
select vec_id, a.j as cluster, d as distance, (sum(d) over (partition by a.j))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
       sha256(array_to_string(c.c, ',')) as centroid_sha256
from a{clustering.ROUNDS} a join c{clustering.ROUNDS} c on c.j = a.j
""",
)
def centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.cluster_vectors(_table(spark, folder, "embeddings"))


@_query(
    "op13_ranked_search",
    rf"""
with termed as (
  select row_number() over () as k, doc_id, regexp_extract_all(translate(text, '{search.UPPER}', '{search.LOWER}'), '{search.TERM}') as t
  from documents),
lengths as (select k, doc_id, len(t)::bigint as n from termed where len(t) > 0),
totals as (select count(*)::bigint as docs, sum(n)::bigint as terms from lengths),
wanted as (
  select item_id, term, count(*)::bigint as times
  from (select item_id, unnest(regexp_extract_all(translate(text, '{search.UPPER}', '{search.LOWER}'), '{search.TERM}')) as term from benchmark)
  group by item_id, term),
postings as (
  select k, term, count(*)::bigint as tf from (select k, unnest(t) as term from termed)
  where term in (select term from wanted) group by k, term),
weights as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w
  from (select term, count(*)::bigint as df from postings group by term), totals),
gains as (
  select p.k, p.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))) as gain
  from postings p join weights using (term) join lengths l on l.k = p.k, totals),
scored as (
  select item_id, doc_id, sum(times * gain)::bigint as score
  from wanted join gains using (term) join lengths using (k) group by item_id, doc_id, k),
ranked as (
  select item_id, (row_number() over (partition by item_id order by score desc, doc_id nulls last))::int as rank, doc_id, score
  from scored where score > 0)
select * from ranked where rank <= {search.TOP}
""",
)
def ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.ranked_documents(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
