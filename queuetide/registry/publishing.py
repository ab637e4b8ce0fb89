"""Sinks over the given tables: append, fan-out, documents, snapshots, run history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import ID, KEY, TS, VALUE
from ..operators.latest import latest_per_key
from ..operators.scoring import drift, score_predictions, summarise_backtest
from ..plans import models
from ..session import scratch_path
from ..sinks import snapshots, writers
from .aggregates import SCORED_SQL, scored_rows
from .catalog import query, r6, rounded
from .joins import G15, grid15, grid5
from .tables import view, with_views


@query("append_obs", with_views("""
select row_number() over (order by timestamp, airport, queue) as id, timestamp, airport, queue from obs
where id % 2 = 0
union all
select (select count(*) from obs where id % 2 = 0) + row_number() over (order by timestamp, airport, queue), timestamp, airport, queue
from obs where id % 2 = 1""", "obs"))
def append(spark, sf):
    """Two batches appended to one table; the second continues the ids."""
    path, obs = scratch_path(spark, "obs"), view(spark, sf, "obs")
    for part in (0, 1):
        writers.append_obs(obs.where(F.col(ID) % 2 == part), path)
    return spark.read.parquet(path).select(ID, TS, KEY, VALUE)


@query("fan_out", with_views("""
select s.sink, s.status, cast(case when s.status = 'ok' then n end as bigint) as rows
from (values ('archive', 'ok'), ('broken', 'failed'), ('latest', 'ok')) s(sink, status)
left join (select 'archive' as sink, count(*) as n from obs union all
           select 'latest', count(distinct airport) from obs) using (sink)""", "obs"))
def fan(spark, sf):
    """One batch to an archive, to a sink that fails, and to a table of latest rows."""
    root = scratch_path(spark, "fan")

    def broken(batch):
        raise OSError("disk gone")

    sinks = {"archive": lambda b: b.write.parquet(f"{root}/archive"), "broken": broken,
             "latest": lambda b: latest_per_key(b).write.parquet(f"{root}/latest")}
    status = writers.fan_out(view(spark, sf, "obs"), sinks)
    counts = (spark.read.parquet(f"{root}/archive").agg(F.lit("archive").alias("sink"), F.count(F.lit(1)).alias("rows"))
              .unionByName(spark.read.parquet(f"{root}/latest").agg(F.lit("latest").alias("sink"),
                                                                    F.count(F.lit(1)).alias("rows"))))
    return status.select("sink", "status").join(counts, "sink", "left")


@query("latest_documents", with_views("""
select cast(id as varchar) as document_id, '{"id":"' || id || '","queue":"' || queue || '","timestamp":"' || timestamp
  || '","airport":"' || airport || '"}' as document
from obs qualify row_number() over (partition by airport order by id desc) = 1""", "obs"))
def documents(spark, sf):
    return writers.latest_documents(view(spark, sf, "obs"))


@query("published_forecast", with_views("""
select airport, max(timestamp) as timestamp, cast(count(*) as double) as mean from obs where id % 2 = 1 group by airport""", "obs"))
def published(spark, sf):
    """Two good runs, a failing one, and failing and good retries of the second; what is read is the second."""
    path, obs = scratch_path(spark, "forecast"), view(spark, sf, "obs")

    def run(part):
        return lambda: obs.where(F.col(ID) % 2 == part).groupBy(KEY).agg(
            F.max(TS).alias(TS), F.count(F.lit(1)).cast("double").alias("mean"))

    def failing():
        return obs.select(F.raise_error(F.lit("source went away")).alias("mean"))

    for number, build in ((1, run(0)), (2, run(1)), (3, failing), (2, failing), (2, run(0))):
        snapshots.refresh(spark, path, number, f"2024-02-0{number} 00:00:00", build)
    return snapshots.last_good(spark, path)


@query("run_history_drift", with_views("""
select generated_at, model, round(mae, 6) as mae, round(rmse, 6) as rmse, round(wql, 6) as wql,
  round(mae - lag(mae) over w, 6) as mae_change, round(rmse - lag(rmse) over w, 6) as rmse_change,
  round(wql - lag(wql) over w, 6) as wql_change
from (select timestamp '2024-02-01' + to_days(cast(run as int)) as generated_at, model, avg(abs(y - mean)) as mae,
    sqrt(avg((y - mean) * (y - mean))) as rmse, 2 * avg(q_loss) / avg(abs(y)) as wql
  from (select *, unnest([0, 1]) as run, list_avg(list_filter([greatest(0.1 * (y - q10), -0.9 * (y - q10)) + 0 * q10,
      greatest(0.5 * (y - q50), -0.5 * (y - q50)) + 0 * q50, greatest(0.9 * (y - q90), -0.1 * (y - q90)) + 0 * q90],
      lambda v: v is not null)) as q_loss from rows)
  where run = 0 or horizon_h > 2 group by all)
window w as (partition by model order by generated_at)""", extra={"rows": SCORED_SQL}))
def history(spark, sf):
    path, rows = scratch_path(spark, "runs"), scored_rows(spark, sf)
    for day, part in (("2024-02-01", rows), ("2024-02-02", rows.where("horizon_h > 2"))):
        writers.append_run(summarise_backtest(score_predictions(part)), path, day)
    out = drift(spark.read.parquet(path))
    return rounded(out, *[c for c in out.columns if c not in ("generated_at", "model")])


@query("training_metadata", with_views("""
select count(*) as n_train_full, count(distinct airport) as airports, max(slot) - interval 7 day as cutoff,
  (select count(*) from grid where slot >= (select max(slot) from grid) - interval 7 day) as n_valid,
  timestamp '2024-02-01' as trained_at, 365 as train_days, 7 as holdout_days
from (select airport, time_bucket(interval '5 minutes', timestamp) as slot, avg(queue) as queue from obs
      where queue >= 0 group by all) as grid""".replace("(select count(*) from grid where slot >= (select max(slot) from grid)",
                                                      "(select count(*) from g5 where slot >= (select max(slot) from g5)"),
                                    "obs", extra={"g5": "select airport, time_bucket(interval '5 minutes', timestamp) as slot "
                                                  "from obs where queue >= 0 group by all"}))
def metadata(spark, sf):
    from ..operators.scoring import holdout_metrics

    grid = grid5(spark, sf)
    train, valid = models.time_split(grid)
    predicted = models.constant_model(valid.withColumn("y", F.col(VALUE)))
    out = writers.training_metadata(grid, holdout_metrics(predicted), "2024-02-01", 365, 7)
    return out.select("n_train_full", "airports", "cutoff", "n_valid", "trained_at", "train_days", "holdout_days")




@query("expired_snapshots", with_views("""
select cast(extract(day from slot) % 5 as bigint) as run_id, count(*) as rows, round(sum(queue), 6) as total
from grid where extract(day from slot) % 5 in (1, 3, 4) group by all""", "obs", extra=G15))
def expired(spark, sf):
    """Five runs with an expiry after each: the newest two stay, and the one that was being read."""
    path, grid = scratch_path(spark, "snapshots"), grid15(spark, sf)
    rows = grid.withColumn("run_id", (F.dayofmonth("slot") % 5).cast("bigint"))

    def publish(k: int) -> None:
        snapshots.publish_forecast(rows.where(F.col("run_id") == k), path, k, f"2024-02-0{k + 1} 00:00:00")
        snapshots.expire(spark, path, 2, f"2024-02-0{k + 1} 00:00:00")

    publish(0)
    publish(1)
    with snapshots.reading(spark, path, "2024-03-01 00:00:00"):
        for k in (2, 3, 4):
            publish(k)
    left = [spark.read.parquet(f"{path}/{r['folder']}") for r in snapshots.manifest(spark, path).collect()]
    out = left[0]
    for more in left[1:]:
        out = out.unionByName(more)
    return out.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"), r6(F.sum(VALUE)).alias("total"))
