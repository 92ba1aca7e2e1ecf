"""Jobs as folds over their commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States that a job doesn't leave.
SETTLED = ("succeeded", "failed", "cancelled")
_STATE = "struct<state:string,fence:int,lease_end:bigint,interest:int,accepted:int,refused:int>"


def step(job: Column, c: Column) -> Column:
    """The job after one command (command, fence, at, lease, outcome).

    * ``submit`` makes a queued job, or adds interest to one that isn't settled; a settled one starts anew.
    * ``claim`` takes a queued job, or a running one whose lease has run out, under the next fence.
    * ``renew`` and ``settle`` need the current fence and a lease that still runs.
    * ``cancel`` takes one interest away; with none left the job is cancelled.
    * ``recover`` queues a running job again whose lease has run out.

    What a command may not do changes nothing but ``refused``.
    """
    state, kind = job["state"], c["command"]
    live = state.isin("queued", "running")
    expired = (state == "running") & (job["lease_end"] <= c["at"])
    holds = (state == "running") & (job["lease_end"] > c["at"]) & (job["fence"] == c["fence"])

    def to(new_state: Column, fence=None, lease_end=None, interest=None) -> Column:
        fields = (new_state.alias("state"), F.coalesce(fence, F.lit(0)) if fence is not None else job["fence"], lease_end if lease_end is not None else job["lease_end"], interest if interest is not None else job["interest"], job["accepted"] + 1, job["refused"])
        return F.struct(*fields).cast(_STATE)

    no_lease = F.lit(None).cast("bigint")
    refused = F.struct(state, job["fence"], job["lease_end"], job["interest"], job["accepted"], job["refused"] + 1).cast(_STATE)
    return (
        F.when((kind == "submit") & live, to(state, interest=job["interest"] + 1))
        .when(kind == "submit", to(F.lit("queued"), lease_end=no_lease, interest=F.lit(1)))
        .when((kind == "claim") & ((state == "queued") | expired), to(F.lit("running"), fence=job["fence"] + 1, lease_end=c["at"] + c["lease"]))
        .when((kind == "renew") & holds, to(state, lease_end=c["at"] + c["lease"]))
        .when((kind == "settle") & holds, to(c["outcome"], lease_end=no_lease))
        .when((kind == "cancel") & live & (job["interest"] > 1), to(state, interest=job["interest"] - 1))
        .when((kind == "cancel") & live, to(F.lit("cancelled"), lease_end=no_lease, interest=F.lit(0)))
        .when((kind == "recover") & expired, to(F.lit("queued"), lease_end=no_lease))
        .otherwise(refused)
    )


def replay(commands: DataFrame) -> DataFrame:
    """Each job's state after all its commands (job, seq, command, fence, at, lease, outcome), in order of ``seq``.

    A job's commands are gathered: they are as many as one job's life has.
    """
    start = F.struct(F.lit("none"), F.lit(0), F.lit(None), F.lit(0), F.lit(0), F.lit(0)).cast(_STATE)
    gathered = commands.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("seq", "command", "fence", "at", "lease", "outcome"))).alias("c"))
    return gathered.select("job", F.aggregate("c", start, step).alias("j")).select("job", "j.*")
