"""Daily activity, instability memory, coherence and alerts of an event series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import logistic, min_max

# One row a day: the calendar bounds every window here, whatever the events' number.
def _all():
    return Window.partitionBy(F.lit(0))


def _in_order():
    return _all().orderBy("day")


DECAY, GAIN = 0.78, 0.22


def daily(catalogue: DataFrame) -> DataFrame:
    """Gap-filled days with count, largest magnitude and both scaled to 0..1."""
    found = catalogue.groupBy(F.to_date("ts").alias("day")).agg(F.count("magnitude").alias("n_events"), F.max("magnitude").alias("max_mag"))
    span = found.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null")
    days = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    full = days.join(found, "day", "left").select("day", F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("max_mag", F.lit(0.0)).alias("max_mag"))
    return full.select("*", min_max(F.col("max_mag"), _all()).alias("mag_n"), min_max(F.col("n_events"), _all()).alias("cnt_n"))


def with_memory(days: DataFrame) -> DataFrame:
    """memory_t = 0.78 memory_(t-1) + 0.22 (mag + cnt): a fold over the ordered days."""
    ordered = days.agg(F.array_sort(F.collect_list(F.struct("day", "n_events", "max_mag", "mag_n", "cnt_n"))).alias("d"))

    def step(acc, x):
        last = F.coalesce(F.get(acc, F.size(acc) - 1)["memory"], F.lit(0.0))
        return F.concat(acc, F.array(F.struct(*[x[c].alias(c) for c in ("day", "n_events", "max_mag", "mag_n", "cnt_n")], (last * DECAY + (x["mag_n"] + x["cnt_n"]) * GAIN).alias("memory"))))

    empty = F.array().cast("array<struct<day:date,n_events:bigint,max_mag:double,mag_n:double,cnt_n:double,memory:double>>")
    return ordered.select(F.inline(F.aggregate("d", empty, step)))


def with_probability(days: DataFrame) -> DataFrame:
    accel = F.col("mag_n") * 0.28 + F.col("cnt_n") * 0.26 + F.col("memory") * 0.08
    prob = days.withColumn("prob", logistic(accel, 5.5, 0.42))
    return prob.withColumn("prob_delta", F.col("prob") - F.coalesce(F.lag("prob").over(_in_order()), F.lit(0.0)))


def with_coherence(days: DataFrame) -> DataFrame:
    """Run flags of rising probability, rolling variances, stability and scores."""

    def rolling(n: int):
        frame = _in_order().rowsBetween(1 - n, 0)
        return F.when(F.count("prob").over(frame) == n, F.var_samp("prob").over(frame)).otherwise(0.0)

    rising = [F.coalesce(F.lag("prob_delta", i).over(_in_order()), F.lit(0.0)) > 0 for i in (1, 2)]
    out = days.withColumn("coherence", (F.col("prob_delta") > 0) & rising[0]).withColumn("strong_coherence", F.col("coherence") & rising[1])
    out = out.withColumn("prob_var_3", rolling(3)).withColumn("prob_var_5", rolling(5)).withColumn("stability", 1 / (1 + F.col("prob_var_3") * 10 + F.col("prob_var_5") * 5))
    score = F.col("prob") * 0.4 + F.col("memory") * 0.3 + F.col("coherence").cast("int") * 0.2 + F.col("stability") * 0.1
    out = out.withColumn("coherence_score", score)
    return out.withColumn("quality_score", F.col("coherence_score") * 0.5 + F.col("prob") * 0.3 + F.col("stability") * 0.2)


def with_state(days: DataFrame) -> DataFrame:
    p = F.col("prob")
    state = F.when((p > 0.65) & F.col("strong_coherence"), "strong").when((p > 0.55) & F.col("coherence"), "confirmed").when(p > 0.45, "early").when(p > 0.35, "pressure").otherwise("quiet")
    return days.withColumn("state", state)


def alerts(days: DataFrame) -> DataFrame:
    """Alert days with their first applicable reason.  The quality threshold is the
    upper quartile of the whole series, so this is a batch operator."""
    before = days.select(
        "*", F.coalesce(F.lag("quality_score").over(_in_order()), F.lit(0.0)).alias("_q"), F.coalesce(F.lag("state").over(_in_order()), F.lit("quiet")).alias("_s"), F.percentile("quality_score", 0.75).over(_all()).alias("_t")
    )
    p, q = F.col("prob"), F.col("quality_score")
    reason = F.when((q >= F.col("_t")) & F.col("strong_coherence"), "quality_coherent").when((q > F.col("_q") + 0.12) & (p > 0.40), "quality_jump")
    reason = reason.when(F.col("state").isin("confirmed", "strong") & (F.col("state") != F.col("_s")), "state_escalation").when((p > 0.65) & F.col("strong_coherence"), "breakout")
    return before.where(p > 0.35).select("day", "state", "prob", q.alias("quality"), reason.alias("reason")).where("reason is not null")


def status(days: DataFrame, last: int = 7) -> DataFrame:
    """One row: status and trend of the last days."""
    tail = days.orderBy(F.desc("day")).limit(last)
    one = tail.agg(F.avg("prob").alias("avg_prob"), F.max("prob").alias("max_prob"), (F.max_by("prob", "day") - F.min_by("prob", "day")).alias("change"))
    m, c = F.col("max_prob"), F.col("change")
    named = F.when(m > 0.65, "strong activity").when(m > 0.55, "elevated activity").when(m > 0.45, "early signals").otherwise("quiet")
    return one.select("avg_prob", "max_prob", named.alias("status"), F.when(c > 0.1, "increasing").when(c < -0.1, "decreasing").otherwise("stable").alias("trend"))


def state_diff(current: DataFrame, previous: DataFrame, only_common: bool = False) -> DataFrame:
    """Keys (key, value) whose value changed; a missing previous value is a change
    unless only common keys count."""
    old = previous.select("key", F.col("value").alias("old_value"))
    return current.join(old, "key", "inner" if only_common else "left").where(~F.col("value").eqNullSafe(F.col("old_value"))).select("key", "old_value", F.col("value").alias("new_value"))


def alert_level(status_row: DataFrame, changed) -> DataFrame:
    """Level and colour from the status and whether anything changed."""
    high = (F.col("max_prob") >= 0.60) | F.col("trend").contains("increasing") | F.col("status").contains("elevated")
    medium = (F.col("max_prob") >= 0.35) | (F.col("avg_prob") >= 0.12)
    level = F.when(~changed, "low").when(high, "high").when(medium, "medium").otherwise("low")
    colour = F.when(~changed, "green").when(high, "red").when(medium, "orange").otherwise("gold")
    return status_row.select("*", level.alias("level"), colour.alias("colour"))
