"""The job state machine over events as commands."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.plans import jobs
from tessera.queries.registry import query


@query(
    """WITH RECURSIVE c AS (SELECT user_id AS job, event_id AS at, row_number() OVER w AS seq,
      CASE event_type WHEN 'signup' THEN 'submit' WHEN 'click' THEN 'claim' WHEN 'view' THEN CASE WHEN event_id % 4 = 0 THEN 'recover' WHEN event_id % 4 = 1 THEN 'submit' ELSE 'renew' END WHEN 'purchase' THEN 'settle' ELSE 'cancel' END AS command,
      CAST(count(*) FILTER (WHERE event_type = 'click') OVER (w ROWS UNBOUNDED PRECEDING) - CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS fence,
      CASE WHEN event_id % 2 = 0 THEN 'succeeded' ELSE 'failed' END AS outcome, 400 AS lease FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    s(job, seq, state, fence, lease_end, interest, accepted, refused) AS (
      SELECT DISTINCT job, CAST(0 AS BIGINT), 'none', 0, CAST(NULL AS BIGINT), 0, 0, 0 FROM c
      UNION ALL
      SELECT s.job, c.seq,
        CASE WHEN NOT ok THEN state WHEN command = 'submit' AND live THEN state WHEN command = 'submit' THEN 'queued' WHEN command = 'claim' THEN 'running' WHEN command = 'settle' THEN outcome
          WHEN command = 'cancel' AND interest = 1 THEN 'cancelled' WHEN command = 'recover' THEN 'queued' ELSE state END,
        CASE WHEN ok AND command = 'claim' THEN s.fence + 1 ELSE s.fence END,
        CASE WHEN NOT ok THEN lease_end WHEN command IN ('claim', 'renew') THEN c.at + lease WHEN command IN ('settle', 'recover') OR (command = 'submit' AND NOT live) OR (command = 'cancel' AND interest = 1) THEN NULL ELSE lease_end END,
        CASE WHEN NOT ok THEN interest WHEN command = 'submit' AND live THEN interest + 1 WHEN command = 'submit' THEN 1 WHEN command = 'cancel' THEN interest - 1 ELSE interest END,
        accepted + CAST(ok AS INTEGER), refused + CAST(NOT ok AS INTEGER)
      FROM s JOIN c ON c.job = s.job AND c.seq = s.seq + 1,
        LATERAL (SELECT state IN ('queued', 'running') AS live, state = 'running' AND lease_end <= c.at AS expired, state = 'running' AND lease_end > c.at AND s.fence = c.fence AS holds) f,
        LATERAL (SELECT coalesce(CASE command WHEN 'submit' THEN true WHEN 'claim' THEN state = 'queued' OR expired WHEN 'renew' THEN holds WHEN 'settle' THEN holds WHEN 'cancel' THEN live ELSE expired END, false) AS ok) g)
    SELECT job, state, fence, lease_end, interest, accepted, refused FROM s QUALIFY row_number() OVER (PARTITION BY job ORDER BY seq DESC) = 1"""
)
def job_replay(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    k, kind = F.col("event_id"), F.col("event_type")
    command = F.when(kind == "signup", "submit").when(kind == "click", "claim").when(kind == "view", F.when(k % 4 == 0, "recover").when(k % 4 == 1, "submit").otherwise("renew")).when(kind == "purchase", "settle").otherwise("cancel")
    claims = F.count(F.when(kind == "click", 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.when(k % 5 == 0, 1).otherwise(0)
    commands = t.events.select(
        F.col("user_id").alias("job"), k.alias("seq"), command.alias("command"), claims.cast("int").alias("fence"), k.alias("at"), F.lit(400).cast("long").alias("lease"), F.when(k % 2 == 0, "succeeded").otherwise("failed").alias("outcome")
    )
    return jobs.replay(commands)
