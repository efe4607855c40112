"""Catalog tables derived from the given parquet tables, as SQL both engines accept.

``{name}`` stands for another table: in Spark it is bound to a DataFrame, in the check SQL it
becomes a common table expression. Nothing is filtered out or capped: every derived table
covers the whole of its source.
"""

from __future__ import annotations

import re
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotlake.plans.spread import size_for

SOURCES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# name -> SQL for both engines, or (Spark SQL, DuckDB SQL) where the dialects differ.
DERIVED: dict[str, str | tuple[str, str]] = {
    "sequences": "select n_nationkey as id, n_name as name, n_regionkey as sort_order from {nation}",
    "frames": """
        select 2 * s_suppkey as id, s_nationkey as sequence_id, 2 * s_suppkey as frame_index,
               case when s_acctbal >= 0 then concat(lower(n_name), '/', s_name, '.png') end as relative_path,
               256 as width, 128 as height, s_acctbal > 4000 as reviewed
        from {supplier} join {nation} on s_nationkey = n_nationkey
        union all
        select 2 * c_custkey + 1, c_nationkey, 2 * c_custkey + 1,
               case when c_mktsegment = 'MACHINERY' then concat(c_name, '.jpg')
                    when c_acctbal >= 0
                    then concat(lower(n_name), '/', lower(c_mktsegment), '/', c_name, '.jpg') end,
               256, 128, c_acctbal > 4000
        from {customer} join {nation} on c_nationkey = n_nationkey""",
    "label_defs": """
        select ascii(name) as id, name,
               case name when 'N' then concat('#', substr(md5(name), 1, 3))
                         when 'R' then 'grey' else concat('#', substr(md5(name), 1, 6)) end as color,
               name = 'N' as is_instance, 100 - ascii(name) as sort_order
        from (select distinct l_returnflag as name from {lineitem}) t""",
    "mask_runs_raw": """
        select 2 * l_suppkey as frame_id, ascii(l_returnflag) as label_id, l_linenumber as value,
               l_orderkey % 128 as y, l_partkey % 224 as x0,
               l_partkey % 224 + 1 + cast(l_quantity as int) % 32 as x1
        from {lineitem}""",
    # Pen strokes: one short run per order, on the frames its lines point at.
    "stroke_runs": """
        select 2 * l_suppkey as frame_id, l_partkey % 128 as y, l_orderkey % 240 as x0,
               l_orderkey % 240 + 1 + l_linenumber as x1
        from {lineitem}""",
    "shape_nodes": """
        select shape_id, frame_id, label_id, count(*) over (partition by shape_id) >= 3 as closed,
               count(*) over (partition by shape_id) >= 3 and label_id <> 65 as filled, node,
               cast(x as double) as x, cast(y as double) as y,
               cast(x - bend as double) as in_x, cast(y as double) as in_y,
               cast(x + bend as double) as out_x, cast(y as double) as out_y, bend > 0 as smooth
        from (
          select l_orderkey as shape_id,
                 2 * first_value(l_suppkey) over (partition by l_orderkey
                     order by l_linenumber, l_partkey, l_suppkey, l_returnflag) as frame_id,
                 ascii(first_value(l_returnflag) over (partition by l_orderkey
                     order by l_linenumber, l_partkey, l_suppkey, l_returnflag)) as label_id,
                 row_number() over (partition by l_orderkey
                     order by l_linenumber, l_partkey, l_suppkey, l_returnflag) as node,
                 l_partkey % 256 as x, l_suppkey * 7 % 128 as y,
                 case when l_returnflag = 'R' then 4 else 0 end as bend
          from {lineitem}) t""",
    "points": """
        select o_orderkey as point_id, 2 * l_suppkey as frame_id, cast(l_partkey % 256 as double) as px,
               cast(o_custkey % 128 as double) as py
        from (select l_orderkey, l_suppkey, l_partkey from {lineitem} group by 1, 2, 3) t
        join {orders} on o_orderkey = l_orderkey""",
    # Each frame is paired with the next one of its kind.
    "registrations": """
        select a.id, a.sequence_id, a.id as reference_frame_id, b.id as moving_frame_id,
               case when a.reviewed and a.id % 4 = 0 then 'null'
                    when a.reviewed
                    then concat('[1,0,', cast(a.id % 7 as varchar(10)), ',0,1,-2,0.0001,0,1]') end as homography,
               case when a.id % 4 = 0 then 'tps' else 'homography' end as transform_type
        from {frames} a join {frames} b on b.id = a.id + 2""",
    "keypoint_pairs": """
        select 2 * l_suppkey as registration_id, l_orderkey * 8 + l_linenumber as sort_order,
               cast(l_partkey % 256 as double) as ref_x, cast(l_orderkey % 128 as double) as ref_y,
               cast(l_partkey % 256 + 3 + l_linenumber % 3 as double) as moving_x,
               cast(l_orderkey % 128 - 2 + l_linenumber % 2 as double) as moving_y
        from {lineitem}""",
    "choices": """
        select 2 * doc_id + 1 as frame_id, 'quality' as task_name, 0 as pos,
               cast(quality as varchar(10)) as selected, false as is_multilabel from {labels}
        union all select 2 * doc_id + 1, 'flags', 0, 'toxic', true from {labels} where toxic = 1
        union all select 2 * doc_id + 1, 'flags', 1, 'good', true from {labels} where quality = 1""",
    "texts": """
        select 2 * doc_id + 1 as frame_id, lang as label_name, text as content from {documents}""",
    "edits": """
        select event_id as seq, ts as modified_at, user_id as frame_id, event_type as field, value from {events}""",
    "pixels": (
        """
        select vec_id as frame_id, (i - 1) div 8 as y, cast((i - 1) % 8 as bigint) as x,
               cast(floor((cast(element_at(embedding, i) as double) + 1) * 127.5) as int) as r,
               cast(floor((cast(element_at(embedding, (i + 20) % 64 + 1) as double) + 1) * 127.5) as int) as g,
               cast(floor((cast(element_at(embedding, (i + 41) % 64 + 1) as double) + 1) * 127.5) as int) as b
        from {embeddings} lateral view explode(sequence(1, 64)) t as i""",
        """
        select vec_id as frame_id, (i - 1) // 8 as y, (i - 1) % 8 as x,
               cast(floor((cast(embedding[i] as double) + 1) * 127.5) as int) as r,
               cast(floor((cast(embedding[(i + 20) % 64 + 1] as double) + 1) * 127.5) as int) as g,
               cast(floor((cast(embedding[(i + 41) % 64 + 1] as double) + 1) * 127.5) as int) as b
        from {embeddings}, (select unnest(range(1, 65)) as i) t""",
    ),
    # Files as a folder scan returns them: path, bytes and image size.
    "files": (
        """
        select concat(case when lang = 'fr' then '' else concat(lang, '/', source, '/') end, 'doc', doc_id,
                      case when doc_id % 3 = 0 then '.png' when doc_id % 3 = 1 then '.jpg' else '.PNG' end) as path,
               concat(unhex(case lang when 'en' then '89504E470D0A1A0A' when 'fr' then 'FFD8FF' when 'de' then '424D'
                                 else '' end), encode(text, 'UTF-8')) as content,
               cast(n_chars as int) as width, 64 as height
        from {documents}""",
        """
        select concat(case when lang = 'fr' then '' else concat(lang, '/', source, '/') end, 'doc', doc_id,
                      case when doc_id % 3 = 0 then '.png' when doc_id % 3 = 1 then '.jpg' else '.PNG' end) as path,
               unhex(case lang when 'en' then '89504E470D0A1A0A' when 'fr' then 'FFD8FF' when 'de' then '424D'
                                 else '' end) || encode(text) as content,
               cast(n_chars as int) as width, 64 as height
        from {documents}""",
    ),
}

_REF = re.compile(r"\{(\w+)\}")


def references(sql: str) -> list[str]:
    return list(dict.fromkeys(_REF.findall(sql)))


def check_sql(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` for DuckDB with the derived tables it needs in front."""
    known: dict[str, str] = {k: (v if isinstance(v, str) else v[1]) for k, v in DERIVED.items()}
    known.update(extra or {})
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for name in references(sql):
            if name in known and name not in ordered:
                visit(known[name])
                ordered.append(name)

    visit(body)
    plain = lambda sql: _REF.sub(lambda m: m.group(1), sql)
    texts = [body, *[known[name] for name in ordered]]
    used = {name: sum(len(re.findall(r"\{" + name + r"\}", text)) for text in texts) for name in ordered}
    ctes = ",\n".join(
        f"{name} as {'materialized ' if used[name] > 1 and name not in known[name] else ''}({plain(known[name])})"
        for name in ordered
    )
    return (f"with recursive {ctes}\n" if ctes else "") + plain(body)


class Tables:
    """The given and derived tables of one scale folder, as DataFrames by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        size_for(spark, folder)
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.__dict__.get("_made", {}):
            return self._made[name]
        if name in SOURCES:
            made = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        elif name in DERIVED:
            made = self.sql(DERIVED[name] if isinstance(DERIVED[name], str) else DERIVED[name][0])
        else:
            raise AttributeError(name)
        self._made[name] = made
        return made

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{name: getattr(self, name) for name in references(text)})

    # Nested forms the operators take.

    @property
    def shapes(self) -> DataFrame:
        """One row per shape with its nodes in order."""
        node = F.struct("node", "x", "y", "in_x", "in_y", "out_x", "out_y", "smooth")
        grouped = self.shape_nodes.groupBy("shape_id", "frame_id", "label_id", "closed", "filled").agg(
            F.array_sort(F.collect_list(node)).alias("nodes")
        )
        return grouped.withColumn(
            "nodes", F.transform("nodes", lambda n: n.dropFields("node"))
        )

    @property
    def classifications(self) -> DataFrame:
        grouped = self.choices.groupBy("frame_id", "task_name", "is_multilabel").agg(
            F.array_sort(F.collect_list(F.struct("pos", "selected"))).alias("picked")
        )
        return grouped.select(
            "frame_id",
            "task_name",
            F.transform("picked", lambda p: p["selected"]).alias("selected_classes"),
            "is_multilabel",
        )

    @property
    def annotated_frames(self) -> DataFrame:
        return self.mask_runs_raw.select("frame_id").distinct()
