"""Queries p1 and p5 and their plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.incremental import replay_runs
from ..operators.snapshots import block_changes
from ..session import scratch, table

#: The normalized body of column {0} in DuckDB.
BODY = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '[ \t\f\v]+\n', chr(10), 'g'), '[ \t\f\v]+$', ''), '^\n+', ''), '\n+$', '')"
DIGEST = "nullif(regexp_replace(lower(trim({0})), '^sha256:', ''), '')"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = replay_runs(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "ingest_runs"), scratch(spark, "target"))
    return state.changes().selectExpr("cast(run_id as int) as run_id", "source", "id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_changes(table(spark, sf_dir, "block_snapshots"))


QUERIES = {"p1_found": p1_found, "p5_found": p5_found}

SQL = {
    "p1_found": rf"""
with rows as (
  select regexp_replace(source, '^(\./)+', '') as source, id, rev, loaded_at,
         coalesce({DIGEST.format('body_hash')}, sha256({BODY.format('text')})) as body
  from chunks where id is not null and id <> ''),
runs as (select run_id, started_at, row_number() over (order by started_at, run_id) as n from (select distinct run_id, started_at from ingest_runs where status = 'ok' and started_at is not null)),
state as (
  select n, run_id, source, id, arg_max(body, (rev, body)) as body
  from runs join rows on loaded_at <= started_at group by all)
select a.run_id, a.source, a.id from state a left join state b on b.n = a.n - 1 and a.source = b.source and a.id = b.id
where b.n is null or a.body <> b.body""",
    "p5_found": rf"""
with last as (select snap_no, max(delivery) as delivery, lag(snap_no) over (order by snap_no) as before from block_snapshots group by snap_no),
state as (
  select snap_no, before, source, coalesce(chunk_id, marker_id) as id,
         arg_max(coalesce(sha256({BODY.format('content')}), {DIGEST.format('body_hash')}), loaded_at) as body
  from block_snapshots join last using (snap_no, delivery) group by all),
pairs as (
  select a.snap_no, a.source, a.id, a.body as new, b.body as old from state a left join state b on b.snap_no = a.before and a.source = b.source and a.id = b.id where a.before is not null
  union all
  select l.snap_no, b.source, b.id, null, b.body from state b join last l on l.before = b.snap_no
  where not exists (select 1 from state a where a.snap_no = l.snap_no and a.source = b.source and a.id = b.id))
select snap_no, source, id, case when old is null then 'added' when new is null then 'removed' else 'changed' end as change
from pairs where old is null or new is null or left(old, least(length(old), length(new))) <> left(new, least(length(old), length(new)))""",
}
