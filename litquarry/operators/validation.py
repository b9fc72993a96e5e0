"""What raters see of their work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def user_pages(usages: DataFrame, *, as_of: Column, days: int = 7) -> DataFrame:
    """One row for each rater of ``usages`` (paper_id, analysis, rater, at): claims and finished analyses, and both day by day.

    ``at`` is when a usage was decided, null if it is open. An analysis is finished if none of its usages is open, and counts for
    every rater who decided any of them, at the time of its last decision. The week goes back ``days`` from ``as_of``;
    the series are of so many days up to its day, days without a claim as 0.
    """
    decided = usages.where(F.col("at").isNotNull())
    today = lambda c: F.to_date(c) == F.to_date(as_of)
    week = lambda c: F.col(c) >= as_of - F.expr(f"INTERVAL {days} DAYS")
    claims = decided.groupBy("rater").agg(F.count("*").alias("total"), F.count_if(today("at")).alias("today"), F.count_if(week("at")).alias("week"))
    finished = usages.groupBy("analysis").agg(F.max("at").alias("last"), F.count("*").alias("_n"), F.count("at").alias("_k")).where("_n = _k").select("analysis", "last")
    part = decided.select("rater", "analysis").distinct().join(finished, "analysis")
    done = part.groupBy("rater").agg(F.count("*").alias("analyses"), F.count_if(today("last")).alias("analyses_today"), F.count_if(week("last")).alias("analyses_week"))
    back = F.date_diff(F.to_date(as_of), F.to_date("at"))
    recent = decided.withColumn("_day", back).where((F.col("_day") >= 0) & (F.col("_day") < days))
    each = recent.groupBy("rater", "_day").agg(F.count("*").alias("n"), F.count_distinct("paper_id").alias("papers"))
    # at most ``days`` rows a rater
    listed = each.groupBy("rater").agg(F.map_from_entries(F.collect_list(F.struct("_day", F.struct("n", "papers")))).alias("_days"))
    series = lambda c: F.transform(F.sequence(F.lit(days - 1), F.lit(0)), lambda d: F.coalesce(F.try_element_at("_days", d)[c], F.lit(0)))
    met = claims.join(done, "rater", "left").join(listed, "rater", "left").fillna(0, ["analyses", "analyses_today", "analyses_week"])
    told = met.withColumns({"claims_per_day": series("n"), "papers_per_day": series("papers")}).drop("_days")
    return told.withColumns({"most_claims": F.array_max("claims_per_day"), "most_papers": F.array_max("papers_per_day")})
