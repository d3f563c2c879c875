"""Queries of problem 1 and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuemill.operators.intervals import cue_periods, small_gap_audit
from cuemill.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cue_periods(table(spark, sf_dir, "supervisions", "track_id", "start", "duration"))


def p1_small_gap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = table(spark, sf_dir, "supervisions", "track_id", "start", "duration")
    return small_gap_audit(cues, table(spark, sf_dir, "validation_results", "track_id", "gaps_too_small"))


_PERIODS = """
with spans as (
  select track_id, cast(round_even(1000 * start, 0) as bigint) a, cast(round_even(1000 * (start + duration), 0) as bigint) b
  from supervisions where start is not null and duration > 0
), marked as (
  select *, max(b) over (partition by track_id order by a, b rows between unbounded preceding and 1 preceding) reach from spans where b > a
), islands as (
  select *, sum(case when reach is null or a > reach then 1 else 0 end) over (partition by track_id order by a, b rows unbounded preceding) island from marked
), periods as (
  select track_id, island, min(a) start_ms, max(b) end_ms from islands group by track_id, island
), gaps as (
  select track_id, lag(end_ms) over (partition by track_id order by start_ms) start_ms, start_ms end_ms from periods
), listed as (
  select track_id, 'period' kind, start_ms, end_ms from periods
  union all
  select track_id, case when end_ms - start_ms < 80 then 'small_gap' else 'gap' end, start_ms, end_ms from gaps where start_ms is not null
)
"""

QUERIES = {"p1_found": p1_found, "p1_small_gap_audit": p1_small_gap_audit}
ORACLES = {
    "p1_found": _PERIODS + "select track_id, kind, start_ms, end_ms from listed",
    "p1_small_gap_audit": _PERIODS
    + """, counted as (
  select track_id, count(*) filter (kind = 'period') periods, count(*) filter (kind <> 'period') gaps,
    count(*) filter (kind = 'small_gap') small_gaps,
    cast(sum(case when kind = 'period' then end_ms - start_ms else 0 end) as bigint) covered_ms
  from listed group by track_id
), told as (select track_id, cast(max(gaps_too_small) as bigint) delivered from validation_results group by track_id)
select track_id, periods, gaps, small_gaps, covered_ms, delivered, delivered = small_gaps as agrees
from counted left join told using (track_id)""",
}
