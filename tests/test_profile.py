import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tallyframe.operators import profile
from tallyframe.sources import footers

COLS = ["v", "code", "flag", "wide"]


def make(path, rows, groups):
    table = pa.table({
        "load_id": pa.array([r[0] for r in rows], pa.int32()), "v": pa.array([r[1] for r in rows], pa.int32()),
        "code": pa.array([r[2] for r in rows], pa.string()), "flag": pa.array([r[3] for r in rows], pa.int32()),
        "wide": pa.array([r[4] for r in rows], pa.int64()),
    })
    pq.write_table(table, path, row_group_size=groups)


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    d = tmp_path_factory.mktemp("p")
    rng = random.Random(1)
    files = [
        [(1, rng.choice([None, 1, 2, 99]), rng.choice(["a", "b", None]), 0, i) for i in range(500)],  # one load, constant flag
        [(2, None, "a", 1, i * 7) for i in range(300)],  # all null
        [(rng.choice([1, 3, None]), rng.randint(-5, 5), rng.choice("abcz"), rng.choice([0, 1, 2]), rng.randint(0, 10**6)) for i in range(900)],
    ]
    for i, rows in enumerate(files):
        make(f"{d}/f{i}.parquet", rows, 250)
    return str(d), [r for rows in files for r in rows]


RULES = {"v": profile.Rule(lambda c: c.between(-5, 10), profile.steps(0, 3)), "code": profile.one_of(["a", "b", "c"]), "flag": profile.one_of([0, 1])}


def test_profile_against_brute_force(spark, data):
    path, rows = data
    out = {(r.load_id, r.column_name): r for r in profile.profile(spark, path, "load_id", RULES).collect()}
    loads = {r[0] for r in rows}
    assert set(out) == {(ld, c) for ld in loads for c in COLS}
    ok = {"v": lambda x: -5 <= x <= 10, "code": lambda x: x in "abc", "flag": lambda x: x in (0, 1)}
    bucket = {"v": lambda x: (x >= 0) + (x >= 3), "code": lambda x: x, "flag": lambda x: x}
    for k, c in enumerate(COLS):
        everything = Counter(bucket[c](r[k + 1]) for r in rows if r[k + 1] is not None and ok[c](r[k + 1])) if c in ok else None
        for ld in loads:
            vals = [r[k + 1] for r in rows if r[0] == ld]
            known = [v for v in vals if v is not None]
            r = out[ld, c]
            assert (r.n_rows, r.n_null) == (len(vals), len(vals) - len(known))
            assert abs(r.n_distinct - len(set(known))) <= 0.06 * len(set(known))
            if known and c != "code":
                assert (r.min_num, r.max_num) == (min(known), max(known))
            if c not in ok:
                assert r.n_disallowed is None
            else:
                allowed = [v for v in known if ok[c](v)]
                assert r.n_disallowed == len(known) - len(allowed)
                if allowed:
                    own = Counter(map(bucket[c], allowed))
                    total = sum(everything.values())
                    assert r.drift == pytest.approx(sum(abs(own[b] / len(allowed) - n / total) for b, n in everything.items()) / 2)
                else:
                    assert r.drift is None


def test_settled_chunks_arent_read(spark, data, monkeypatch):
    path, _ = data
    got = {r.column_name: (r.chunks, r.settled) for r in profile.chunk_report(spark, path, "load_id").collect()}
    # Two chunks of f0, two of f1, four of f2: constant flags, the null column and the constant text of f1 need no reading.
    assert got == {"v": (8, 2), "code": (8, 2), "flag": (8, 4), "wide": (8, 0)}
    asked = []

    class Spy(pq.ParquetFile):
        def read_row_group(self, g, columns=None, **kw):
            asked.append(set(columns))
            return super().read_row_group(g, columns=columns, **kw)

    scan = profile._Scan(COLS, "load_id", {"v", "code", "flag"}, {"code"}, True)
    f = Spy(f"{path}/f1.parquet", read_dictionary=["code"])
    for g in range(f.num_row_groups):
        scan.group(f, g)
    assert asked == [{"wide"}, {"wide"}]


def test_dictionaries(spark, data):
    path, _ = data
    rows = footers.chunk_statistics(spark.createDataFrame([(f"file://{path}/f0.parquet",)], "file string"), ["code", "v"], "load_id").collect()
    assert len(rows) == 4
    for r in rows:
        assert set(r.candidates) == ({"a", "b"} if r.column_name == "code" else {"1", "2", "99"})


def test_footer_profile(spark, data):
    path, rows = data
    got = {r.column_name: r for r in profile.footer_profile(spark, path, "load_id").collect()}
    assert got["wide"].n_rows == len(rows) and got["v"].n_null == sum(r[1] is None for r in rows)
    assert (got["wide"].min_value, got["wide"].max_value) == (str(min(r[4] for r in rows)), str(max(r[4] for r in rows)))


def test_empty_table(spark, tmp_path):
    make(f"{tmp_path}/e.parquet", [], 10)
    assert profile.profile(spark, str(tmp_path), "load_id", RULES).count() == 0


def test_drift_of_wide_columns(spark, tmp_path):
    rng = random.Random(2)
    rows = [(ld, rng.randint(-60, 5000) + 2000 * (ld == 3), f"x{rng.randint(0, 3000) + 2000 * (ld == 3)}", 5, i) for ld in (1, 2, 3, None) for i in range(3000)]
    make(f"{tmp_path}/w.parquet", rows, 1500)
    few = [(r[0], r[1] // 20, r[2], r[3], r[4]) for r in rows]
    make(f"{tmp_path}/few.parquet", few, 1500)
    out = {(r.load_id, r.column_name): r.drift for r in profile.profile(spark, f"{tmp_path}/w.parquet", "load_id").collect()}
    assert all(d is not None for d in out.values())
    everything, own = Counter(r[2] for r in rows), Counter(r[2] for r in rows if r[0] == 3)
    assert out[3, "code"] == pytest.approx(sum(abs(own[b] / 3000 - n / 12000) for b, n in everything.items()) / 2)
    assert out[3, "v"] == pytest.approx(0.75 * 2000 / 5061, abs=0.06) and out[1, "v"] < 0.15
    assert out[1, "flag"] == 0 and max(out[ld, "wide"] for ld in (1, 2, 3, None)) < 0.01
    # A column with fewer than NARROW values is measured alike.
    narrow = {(r.load_id, r.column_name): r.drift for r in profile.profile(spark, f"{tmp_path}/few.parquet", "load_id").collect()}
    assert narrow[3, "v"] == pytest.approx(out[3, "v"], abs=0.06)


def test_odd_types_and_nan(spark, tmp_path):
    t = pa.table({
        "load_id": pa.array(["x", "x", None], pa.string()), "d": pa.array([float("nan"), 1.5, -0.0]), "b": pa.array([True, None, False]),
        "t": pa.array([0, 86_400_000_000, None], pa.timestamp("us")), "big": pa.array([2**60, 2**60 + 1, 2**60 + 1], pa.int64()),
        "l": pa.array([[1], [], None], pa.list_(pa.int32())), "e": pa.array(["", None, "é" * 5000]),
    })
    pq.write_table(t, f"{tmp_path}/o.parquet")
    for narrow in (512, 0):
        profile.NARROW = narrow
        try:
            out = {(r.load_id, r.column_name): r for r in profile.profile(spark, f"{tmp_path}/o.parquet", "load_id").collect()}
        finally:
            profile.NARROW = 512
        assert {c for _, c in out} == {"d", "b", "t", "big", "e"}
        x = out["x", "d"]
        assert (x.n_rows, x.n_null, x.n_distinct, x.min_num, x.max_num) == (2, 0, 2, 1.5, 1.5)
        assert out["x", "big"].n_distinct == 2 and out[None, "e"].n_distinct == 1 and out["x", "b"].n_null == 1
        assert (out["x", "t"].min_num, out["x", "t"].max_num) == (0.0, 86_400_000_000.0)
