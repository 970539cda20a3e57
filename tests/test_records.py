import csv
import io
import random
import re

from pyspark.sql import types as T

from tallyframe.sources import records

SCHEMA = T.StructType([
    T.StructField("a", T.IntegerType()), T.StructField("t", T.IntegerType()), T.StructField("s", T.StringType()),
    T.StructField("b", T.LongType()),
])
CHECKS = {"t": records.hhmm, "s": records.matches(r"^N[A-Z0-9]{2,5}$")}


def brute(line):
    """Character by character, as the rules are worded."""
    line = line or ""
    if line.endswith("\r"):
        line = line[:-1]
    fields, i, ok = [], 0, True
    while True:
        if i < len(line) and line[i] == '"':
            j, buf = i + 1, ""
            while True:
                if j >= len(line):
                    ok = False
                    break
                if line[j] == '"':
                    if j + 1 < len(line) and line[j + 1] == '"':
                        buf += '"'
                        j += 2
                        continue
                    break
                buf += line[j]
                j += 1
            i = j + 1
            if ok and i < len(line) and line[i] != ",":
                ok = False
        else:
            j = line.find(",", i)
            j = len(line) if j < 0 else j
            buf = line[i:j]
            if '"' in buf:
                ok = False
            i = j
        if not ok:
            return "quoting", None
        fields.append(buf)
        if i >= len(line):
            break
        i += 1
    if len(fields) != 4:
        return "columns", None
    vals = [f.strip(" \t") for f in fields]
    vals = [None if v in ("", "NA") else v for v in vals]
    out = []
    for k, v in enumerate(vals):
        if v is None or k == 2:
            out.append(v)
            continue
        if not re.fullmatch(r"[+-]?[0-9]+", v) or not -(1 << (31 if k < 2 else 63)) <= int(v) < 1 << (31 if k < 2 else 63):
            return "value", None
        out.append(int(v))
    if out[1] is not None and not (0 <= out[1] <= 2400 and out[1] % 100 < 60):
        return "value", None
    if out[2] is not None and not re.fullmatch(r"N[A-Z0-9]{2,5}", out[2]):
        return "value", None
    return None, tuple(out)


CASES = [
    None, "", "\r", "1,2,N12,3", "1,2,N12,3\r", '"1","2","N12","3"', '1,2,"N,12",3', '1,2,"N""12",3', '1,2,N"12,3',
    '1,2,"N12" ,3', '1,2, "N12",3', '1,2,"N12,3', '""1,2,N12,3',
    "1,2,N12", "1,2,N12,", "1,2,N12,3,", ",,,", "NA,NA,NA,NA", ' 1 ,\t2400, N123 ," 3 "', "1,2401,N12,3",
    "1,960,N12,3", "+1,0,N12,-9223372036854775808", "1,2,N12,9223372036854775808",
    "2147483648,2,N12,3", "-2147483648,2,N12,3", "000000000000000000001,2,N12,3", "1_0,2,N12,3", "١,2,N12,3",
    "1,2,N1,3", "1,2,N123456,3", "1,2,n12,3", "1.0,2,N12,3", '"","","",""', '""",2,N12,3',
    "x" * 100_000, "1,2," + '"' + "," * 5000 + '",3', "é,2,N12,3", "1,-5,N12,3",
]


def random_lines(n):
    rng = random.Random(4)
    return ["".join(rng.choice(['"', ",", "1", "N12", " ", "NA", '""', "\r", "é", "-"]) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_against_brute_force(spark):
    lines = CASES + random_lines(3000)
    rows = [(i, line, "x") for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "id long, line string, b string").repartition(3)
    parsed = records.parse_records(df, "line", SCHEMA, CHECKS)
    assert parsed.columns == ["id", "b", "reason", "field", "record"]
    for r in parsed.collect():
        want = brute(lines[r.id])
        assert (r.reason, None if r.record is None else tuple(r.record)) == want, (lines[r.id], r)


def test_round_trip_through_csv(spark):
    rng = random.Random(2)
    values = [(rng.randint(-9, 9), 100, "N" + "".join(rng.choice('AB"') for _ in range(3)), 5) for _ in range(200)]
    buf = io.StringIO()
    csv.writer(buf, lineterminator="\n").writerows(values)
    df = spark.createDataFrame([(x,) for x in buf.getvalue().splitlines()], "line string")
    got = [tuple(r.record) for r in records.parse_records(df, "line", SCHEMA).collect()]
    assert got == values


def test_split_and_empty(spark):
    df = spark.createDataFrame([(1, "1,2,N12,3"), (2, "oops"), (3, "1,2,?,3")], "id long, line string")
    good, bad = records.split(records.parse_records(df, "line", SCHEMA, CHECKS))
    assert [tuple(r) for r in good.collect()] == [(1, 1, 2, "N12", 3)]
    assert sorted((r.id, r.reason, r.field) for r in bad.collect()) == [(2, "columns", None), (3, "value", "s")]
    assert records.parse_records(df.where("false"), "line", SCHEMA).count() == 0
