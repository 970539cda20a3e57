import itertools
import random
from datetime import datetime, timezone

import pytest

from tallyframe.functions import timetext as X
from tallyframe.operators import instants as I

US = 1_000_000


def utc(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * US


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2009-03-08T05:10:11.250Z", utc(2009, 3, 8, 5, 10, 11) + 250_000),
        ("2008-11-29T20:21:14-06:00[America/Chicago]", utc(2008, 11, 30, 2, 21, 14)),
        ("20160714T0334-0500", utc(2016, 7, 14, 8, 34)),
        ("Thu, 07 Mar 2019 19:20:00 +0530", utc(2019, 3, 7, 13, 50)),
        ("2011-08-20 23:45 PDT", utc(2011, 8, 21, 6, 45)),
        ("2012-07-24T14:00Z", utc(2012, 7, 24, 14)),
        ("1244985900", 1244985900 * US),
        ("1636269300123", 1636269300123 * 1000),
        ("1533934200000001", 1533934200000001),
        (" 2011-01-02 03:04 CET ", utc(2011, 1, 2, 2, 4)),
    ],
)
def test_instants(text, want):
    got = X.readings(text)
    assert [(k, v) for _, k, v, _ in got] == [(X.INSTANT, want)]


@pytest.mark.parametrize(
    "text",
    [
        None, "", "NA", "2561", "1299", "25:10 PM", "13:00 PM", "0:10 AM", "24:75", "00/00/0000 00:00",
        "2009-02-30 10:00", "12345", "2012-13-01T00:00", "2012-01-01 10:00 XYZT", "٣٠", "--:--", "2024:1",
    ],
)
def test_no_reading(text):
    assert X.readings(text) == []


def test_local_readings():
    assert {(X.FORMATS[f], v // X.DAY + X.EPOCH) for f, _, v, _ in X.readings("03/04/2021 10:00")} == {
        ("slash_dm", datetime(2021, 4, 3).toordinal()), ("slash_md", datetime(2021, 3, 4).toordinal()),
    }
    assert len(X.readings("25/04/2021 10:00")) == 1 and len(X.readings("04/04/2021 10:00")) == 1
    for text, clock in (
        ("5", 5), ("35", 35), ("955", 595), ("2400", 1440), ("1:50a", 110), ("12:05 AM", 5), ("12:05p", 725),
        ("3:20 PM", 920), ("18:29", 1109), ("24:00", 1440),
    ):
        assert [(k, v) for _, k, v, _ in X.readings(text)] == [(X.CLOCK, clock * X.MINUTE)], text
    assert X.readings("17-Oct-09 2400")[0][2] == X.readings("2009-10-18 00:00")[0][2]
    assert X.readings("Nov 6, 2022 1:10am")[0][2] == X.readings("20221106 0110")[0][2]


FIELDS = [I.TimeField("sched", "oz"), I.TimeField("dep", "oz", "nearest", "sched"), I.TimeField("arr", "dz", "after", "dep")]
SCHEMA = "id long, feed string, zone string, y int, m int, d int, sched string, dep string, arr string, oz string, dz string, extra string"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, "f", *r, "x") for i, r in enumerate(rows)], SCHEMA)
    out = I.normalise_times(df, "id", "feed", "zone", ("y", "m", "d"), FIELDS, **kw).collect()
    return {(r.id, r.column_name): (r.status, r.utc_us) for r in out}


NY, LA = "America/New_York", "America/Los_Angeles"


def test_rules(spark):
    got = run(
        spark,
        [
            (None, 2020, 6, 1, "2350", "0010", "0130", NY, LA),  # departs after midnight, lands next day there
            (None, 2020, 6, 1, "0010", "2355", "0300", NY, NY),  # departs the evening before
            (None, 2020, 3, 8, "0230", "0310", "0500", NY, NY),  # a skipped time
            (None, 2020, 11, 1, "0130", "0155", "0400", NY, NY),  # repeated times
            ("+05:30", 2020, 6, 1, "2400", "NA", "0300", NY, NY),  # end of the day; nothing to follow
            (None, 2020, 6, 1, "NA", "0700", "07/06/2020 10:00", NY, NY),
            (None, 2020, 6, 1, "0700", "0700", "0700", None, "No/Where"),
            ("UTC", None, None, None, "0700", "01/02/2020 07:00", "0800", NY, NY),
        ],
    )
    assert got[0, "sched"] == ("ok", utc(2020, 6, 2, 3, 50)) and got[0, "dep"] == ("ok", utc(2020, 6, 2, 4, 10)) and got[0, "arr"] == ("ok", utc(2020, 6, 2, 8, 30))
    assert got[1, "dep"] == ("ok", utc(2020, 6, 1, 3, 55)) and got[1, "arr"] == ("ok", utc(2020, 6, 1, 7))
    assert got[2, "sched"] == ("skipped", None) and got[2, "dep"] == ("ok", utc(2020, 3, 8, 7, 10)) and got[2, "arr"] == ("ok", utc(2020, 3, 8, 9))
    assert got[3, "sched"][0] == "repeated" and got[3, "dep"][0] == "repeated" and got[3, "arr"] == ("ok", utc(2020, 11, 1, 9))
    assert got[4, "sched"] == ("ok", utc(2020, 6, 1, 18, 30)) and got[4, "dep"] == ("no_time", None) and got[4, "arr"] == ("no_anchor", None)
    assert got[5, "dep"] == ("no_anchor", None) and got[5, "arr"] == ("ok", utc(2020, 6, 7, 14))
    assert got[6, "sched"] == ("no_zone", None)
    assert got[7, "sched"] == ("no_anchor", None) and got[7, "dep"][0] == "ok"


def test_swapped_days_take_the_nearest_and_runs_dont_change_that(spark):
    rows = [(None, 2020, 6, 1, f"{d:02d}/{m:02d}/2020 10:00", None, None, "UTC", "UTC") for d, m in [(6, 1), (1, 6), (5, 6), (6, 5), (25, 5), (12, 1)]]
    for length in (1, 2, 4096):
        got = run(spark, rows, run_length=length)
        days = [datetime.fromtimestamp(got[i, "sched"][1] / US, timezone.utc).strftime("%m-%d") for i in range(6)]
        # 12 January is 141 days before 1 June, 1 December 183 days after it
        assert days == ["06-01", "06-01", "06-05", "06-05", "05-25", "01-12"]


def test_viterbi_prefers_the_running_format_on_ties():
    day = 100
    both = lambda: [(6, X.LOCAL, (day + 5) * X.DAY, None), (7, X.LOCAL, (day - 5) * X.DAY, None)]
    only = [(7, X.LOCAL, day * X.DAY, None)]
    assert [c[0] for c in I.viterbi([only, both(), only], [day, day, day])] == [7, 7, 7]
    assert I.viterbi([[], both(), []], [day] * 3)[0] is None
    near = [(6, X.LOCAL, (day + 4) * X.DAY, None), (7, X.LOCAL, (day - 5) * X.DAY, None)]
    assert I.viterbi([only, near, only], [day, day, day])[1][0] == 6


def brute(options, days):
    best = None
    for combo in itertools.product(*[range(len(o)) for o in options]):
        c = 0.0
        for n, k in enumerate(combo):
            o = options[n][k]
            if len(options[n]) > 1 and days[n] is not None:
                c += abs(o[2] // X.DAY - days[n]) * I.NEAR
            if n:
                c += I.step_cost(options[n - 1][combo[n - 1]], o)
        if best is None or c < best - 1e-9:
            best = c
    return best


def test_runs_chained_are_as_cheap_as_one_run():
    rng = random.Random(8)
    for _ in range(150):
        n = rng.randint(1, 9)
        options = [[(rng.choice([6, 7]), X.LOCAL, rng.randint(0, 6) * X.DAY, None) for _ in range(rng.choice([1, 2, 2]))] for _ in range(n)]
        days = [rng.choice([None, 3]) for _ in range(n)]
        cuts = sorted(rng.sample(range(1, n), min(n - 1, rng.randint(0, 3)))) if n > 1 else []
        bounds = list(zip([0, *cuts], [*cuts, n]))
        both = I.chain([I.ends(options[a:b], days[a:b]) for a, b in bounds])
        chosen = [r for (a, b), e in zip(bounds, both) for r in I.viterbi(options[a:b], days[a:b], *e)]
        assert brute([[c] for c in chosen], days) + sum(
            abs(c[2] // X.DAY - d) * I.NEAR for c, o, d in zip(chosen, options, days) if len(o) > 1 and d is not None
        ) == pytest.approx(brute(options, days))


def test_only_the_order_decides_and_cuts_dont_matter(spark):
    # Without a date of its own a row's swapped day is told by the format its feed is running in, across any cut.
    swapped = lambda k: (None, None, None, None, f"0{k}/0{k + 1}/2020 10:00", None, None, "UTC", "UTC")
    plain = lambda t: (None, None, None, None, t, None, None, "UTC", "UTC")
    rows = [plain("01/25/2020 10:00"), swapped(2), swapped(3), plain("04/25/2020 10:00"), plain("25/05/2020 10:00"), swapped(6), swapped(7), plain("25/08/2020 10:00")]
    results = [run(spark, rows, run_length=n) for n in (1, 2, 3, 100)]
    assert all(r == results[0] for r in results)
    month = [datetime.fromtimestamp(results[0][i, "sched"][1] / US, timezone.utc).month for i in range(8)]
    assert month == [1, 2, 3, 4, 5, 7, 8, 8]


def test_empty(spark):
    assert run(spark, []) == {}
