from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from lexiloom.operators.timestamps import normalise, offset_intervals, zone_intervals

NY, BER = "America/New_York", "Europe/Berlin"
CASES = [
    ("2018-03-25T00:27:22+00:00", NY, "mdy", "2018-03-25T00:27:22Z"), ("1430781053400", None, None, "2015-05-04T23:10:53Z"), ("1643296256", None, None, "2022-01-27T15:10:56Z"), ("20211108", NY, "mdy", "2021-11-08"),
    ("20200928T233006", "Europe/Madrid", "dmy", "2020-09-28T21:30:06Z"), ("13/04/2020 03:21", BER, "dmy", "2020-04-13T01:21:00Z"), ("3/12/2020", NY, "mdy", "2020-03-12"), ("3/12/2020", BER, "dmy", "2020-12-03"),
    ("2012년 7월 14일 오전 4:52", "America/Los_Angeles", "mdy", "2012-07-14T11:52:00Z"), ("2013년 3월 15일 오후 12:19", "America/Los_Angeles", "mdy", "2013-03-15T19:19:00Z"), ("October 26, 2015 at 12:04 am", "Asia/Seoul", "mdy", "2015-10-25T15:04:00Z"),
    ("Sun, 16 Dec 2018 13:20:16 +0100", BER, "dmy", "2018-12-16T12:20:16Z"), ("February 22, 2016 4:26 a.m. JST", None, None, "2016-02-21T19:26:00Z"), ("2022/06/01 04:38 EDT", NY, "mdy", "2022-06-01T08:38:00Z"),
    ("2020-05-01 10:00 EST", "Australia/Sydney", "dmy", "2020-05-01T00:00:00Z"), ("Oct. 25th 2017", NY, "mdy", "2017-10-25"), ("{{start date|2020|4|26|df=y}}", None, None, "2020-04-26"), ("2012. 2. 23.", None, None, "2012-02-23"), ("2011-2", None, None, "2011-02"),
    ("Feb 2020", None, None, "2020-02"), ("2013", None, None, "2013"), ("2011-01-06 20:10 (UTC+9)", None, None, "2011-01-06T11:10:00Z"), ("2024-01-04 (premiere)<ref>x, p. 3</ref>", None, None, "2024-01-04"),
    ("2020-11-01 01:30:00", NY, "mdy", "2020-11-01T05:30:00Z"), ("2020-03-08 02:30:00", NY, "mdy", "2020-03-08T07:30:00Z"), ("2020-01-01 10:00", None, None, None), ("August 9, 2011 at 4:07 pm", "UTC", None, "2011-08-09T16:07:00Z"),
    ("2012-02-30", NY, "mdy", None), ("0000-00-00", NY, "mdy", None), ("2022-13-25", NY, "mdy", None), ("yesterday", NY, "mdy", None), ("", NY, "mdy", None), (None, NY, "mdy", None), ("2020-01-01 25:00", NY, "mdy", None), ("2020-01-01", "No/Zone", "mdy", "2020-01-01"),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, *c[:3], "x") for i, c in enumerate(CASES)], "row_id bigint, text string, zone string, date_order string, norm0 string")
    zones = df.select("zone").distinct()
    got = {r.row_id: r.norm for r in normalise(df, zone_intervals(zones)).collect()}
    assert {i: (CASES[i][0], got[i]) for i in got} == {i: (c[0], c[3]) for i, c in enumerate(CASES)}


def test_empty(spark):
    df = spark.createDataFrame([], "text string, zone string, date_order string")
    assert normalise(df, zone_intervals(df.select("zone"))).count() == 0


def test_intervals_against_zoneinfo():
    for zone in (NY, "Australia/Sydney", "Asia/Jakarta"):
        spans = offset_intervals(zone, 2005, 2026)
        tz = ZoneInfo(zone)
        t = datetime(2006, 1, 1)
        while t < datetime(2025, 1, 1):
            local = int((t - datetime(1970, 1, 1)).total_seconds())
            offs = [o for a, b, o in spans if a <= local < b]
            first, second = (t.replace(tzinfo=tz, fold=f).utcoffset().total_seconds() for f in (0, 1))
            real = t.replace(tzinfo=tz).astimezone(timezone.utc).astimezone(tz).replace(tzinfo=None) == t
            assert len(offs) == (0 if not real else 1 if first == second else 2)
            if real:
                assert max(offs) == first
            t += timedelta(minutes=30 * 37)


def test_years_of_any_distance(spark):
    zones = ("Asia/Seoul", NY, BER, "Australia/Sydney", "America/Sao_Paulo")
    times = [datetime(y, m, 9, 12, 30) for y in (1500, 1799, 1883, 1895, 1901, 2037, 2099, 2100, 2101, 2105, 2222, 2400, 3000, 9998) for m in (1, 4, 7, 10)]
    rows = [(t.strftime("%m/%d/") + f"{t.year:04d}" + " 12:30", z, "mdy", t) for t in times for z in zones]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "row_id bigint, text string, zone string, date_order string")
    got = {r.row_id: r.norm for r in normalise(df, zone_intervals(df.select("zone").distinct())).collect()}
    utc = lambda r: r[3].replace(tzinfo=ZoneInfo(r[1])).astimezone(timezone.utc)
    assert got == {i: f"{utc(r).year:04d}" + utc(r).strftime("-%m-%dT%H:%M:%SZ") for i, r in enumerate(rows)}


def test_planning_takes_little_of_the_driver(spark):
    df = spark.createDataFrame([("2020-03-08 02:30", NY, "mdy", "2020-03-08T07:30:00Z")], "text string, zone string, date_order string, want string")
    plan = normalise(df, zone_intervals(df.select("zone")))
    jvm = spark.sparkContext._jvm
    threads = jvm.java.lang.management.ManagementFactory.getThreadMXBean()
    allocated = next(m for m in jvm.java.lang.Class.forName("com.sun.management.ThreadMXBean").getMethods() if m.getName() == "getCurrentThreadAllocatedBytes")
    none = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 0)
    before = allocated.invoke(threads, none)
    plan._jdf.queryExecution().executedPlan()
    assert allocated.invoke(threads, none) - before < 1e9
    assert [r.norm == r.want for r in plan.collect()] == [True]
