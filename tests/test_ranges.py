"""Windows inside validity ranges, archive calls and raters' pages on hand-made rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from litquarry.operators import joins, materialize, validation


def at(day):
    return None if day is None else dt.datetime(2000, 1, 1) + dt.timedelta(days=day)


def test_windows_inside_ranges_against_all_pairs(spark):
    rnd = random.Random(6)
    day = lambda: rnd.choice([None, *range(0, 3000)]) if rnd.random() < 0.1 else rnd.randrange(3000)
    ranges = [(rnd.choice(["hot"] * 8 + ["b", None]), a, None if rnd.random() < 0.05 else a + rnd.choice([-5, 0, 3, 40, 900])) for a in (rnd.randrange(3000) for _ in range(60))]
    rows = [(k, rnd.choice(["hot"] * 8 + ["b", "none", None]), day(), day()) for k in range(300)]
    rows = [(k, g, a, b if a is None or b is None else a + abs(b - a) % 60) for k, g, a, b in rows] + [(900, "hot", ranges[0][1], ranges[0][2])]
    found = joins.contained_join(
        spark.createDataFrame([(k, g, at(a), at(b)) for k, g, a, b in rows], "k int, g string, a timestamp, b timestamp").repartition(5), spark.createDataFrame([(g, at(f), at(t)) for g, f, t in ranges], "g string, f timestamp, t timestamp"),
        keys=["g"], window=("a", "b"), valid=("f", "t"), as_of=F.lit(at(2500)), days=100,
    )
    got = {r["k"]: r["inside"] for r in found.collect()}
    end = lambda t: 2500 if t is None else t
    want = {k: g is not None and a is not None and b is not None and any(h == g and f <= a and b <= end(t) and f <= end(t) for h, f, t in ranges) for k, g, a, b in rows}
    assert got == want and 20 < sum(want.values()) < 250


def test_archive_calls(spark):
    entries = [("s", "i", 0, 10, 1.0, 5.0), ("s", "i", 20, None, 7.0, None), ("s", "dark", 0, 10, None, None)]
    calls = [
        (1, "s", "i", 1, 2, 2.0, 3.0, [], []), (2, None, "i", 1, 2, None, None, ["no source"], []), (3, "s", None, 1, 2, None, None, ["no instrument"], []), (4, "s", "other", None, None, None, None, ["unknown combination"], []),
        (5, "s", "i", None, None, 6.5, 7.5, [], ["no time range"]), (6, "s", "i", 9, 21, 4.0, 6.0, ["time range not valid", "wavelength range not valid"], []), (7, "s", "i", 30, 40, None, None, [], []), (8, "s", "i", 30, 99, None, None, ["time range not valid"], []),
        (9, "s", "dark", 1, 2, 1.0, 2.0, ["wavelength range not valid"], []), (10, None, None, 1, 2, None, None, ["no instrument"], []),
    ]
    schema = "source string, instrument string, {}, low double, high double"
    told = materialize.archive_checks(
        spark.createDataFrame([(c[0], c[1], c[2], at(c[3]), at(c[4]), *c[5:7]) for c in calls], "k int, " + schema.format("a timestamp, b timestamp")), spark.createDataFrame([(s, i, at(f), at(t), lo, hi) for s, i, f, t, lo, hi in entries], schema.format("f timestamp, t timestamp")),
        as_of=F.lit(at(50)),
    )
    assert {r["k"]: (r["errors"], r["warnings"]) for r in told.collect()} == {c[0]: (c[7], c[8]) for c in calls}


def test_user_pages(spark):
    rows = [(1, "1-a", 7, 100), (1, "1-a", 8, 99), (1, "1-b", 7, None), (2, "2-a", 7, 94), (2, "2-b", 7, 93), (3, "3-a", 9, 50), (4, "4-a", 10, None)]
    found = validation.user_pages(spark.createDataFrame([(p, a, r, at(d)) for p, a, r, d in rows], "paper_id int, analysis string, rater int, at timestamp"), as_of=F.lit(at(100)))
    got = {r["rater"]: r.asDict() for r in found.collect()}
    assert set(got) == {7, 8, 9}
    assert got[7] == {"rater": 7, "total": 3, "today": 1, "week": 3, "analyses": 3, "analyses_today": 1, "analyses_week": 3, "claims_per_day": [1, 0, 0, 0, 0, 0, 1], "papers_per_day": [1, 0, 0, 0, 0, 0, 1], "most_claims": 1, "most_papers": 1}
    assert (got[8]["analyses"], got[8]["analyses_today"], got[8]["today"]) == (1, 1, 0) and got[9]["claims_per_day"] == [0] * 7
