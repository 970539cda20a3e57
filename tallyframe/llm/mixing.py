"""Sources mixed to target shares of all tokens, along a curriculum.

Every source has a weight that varies over training time t in [0, 1] (piecewise linear between knots). Weights sum to 1 at
every moment and each one's integral is the source's target share. A source's demand up to t is the integral of its
weight times the total; a document's place in its source's cumulated tokens is inverted through that demand to a position
in training, and documents are range-sorted by position.

The total is the largest one that keeps every share with no document used more than its source's ``max_repeats`` times:
the minimum of repeats * tokens / share. A source is used in whole passes plus a last partial one, each in its own hash
order. Cumulated tokens come from two-level prefix sums (hash buckets of about ``bucket_rows`` rows, then rows within a
bucket), so a source that holds most rows is never in one task. In the one bucket of a source in which its demand ends,
documents are taken in their order as long as they fit what is left of the demand, longer ones being passed over, and swapped
one for one while that fills more of it; so a share misses its target by less than the shortest document passed over, and
never by a long document that straddles the end.

Defined results: documents whose source is null or has no target aren't used, and appear in the report with target 0; a
target source without tokens is left out and the shares of the others are scaled up (the report shows it with 0); null
or empty texts carry no tokens but keep a place; equal rows are used as often as they occur; rows with null identifiers are
spread like any others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import written

MOST_SOURCES = 10_000


def fit_schedule(shares: dict[str, float], shapes: dict[str, list[float]], knots: list[float]) -> dict[str, list[float]]:
    """Weights at the knots, near the given shapes, that sum to 1 at every knot and integrate to the shares."""
    names = list(shares)
    t = np.array(knots, float)
    if t[0] != 0 or t[-1] != 1 or (np.diff(t) <= 0).any():
        raise ValueError("knots rise from 0 to 1")
    area = np.zeros(len(t))
    area[:-1] += np.diff(t) / 2
    area[1:] += np.diff(t) / 2
    target = np.array([shares[s] for s in names])
    w = np.array([shapes.get(s, [1.0] * len(t)) for s in names], float) * target[:, None]
    if (w < 0).any() or ((w @ area <= 0) & (target > 0)).any():
        raise ValueError("shapes must not be negative, nor 0 all along")
    for _ in range(10_000):
        w /= np.maximum(w.sum(0), 1e-300)
        now = w @ area
        if np.abs(now - target).max() < 1e-13:
            break
        w *= (target / np.maximum(now, 1e-300))[:, None]
    return dict(zip(names, w.tolist()))


def _position(u):
    """The moment at which a source's demand reaches ``u`` (as a share of the total)."""
    j = F.greatest(F.lit(1), F.least(F.size(F.filter("at", lambda c: c <= u)), F.size("at") - 1))
    here, t0, t1 = F.element_at("at", j), F.element_at("t", j), F.element_at("t", j + 1)
    w0, w1 = F.element_at("w", j), F.element_at("w", j + 1)
    slope, rest = (w1 - w0) / (t1 - t0), F.greatest(u - here, F.lit(0.0))
    root = F.sqrt(F.greatest(w0 * w0 + 2 * slope * rest, F.lit(0.0)))
    return F.least(F.lit(1.0), t0 + F.when(w0 + root > 0, 2 * rest / (w0 + root)).otherwise(F.lit(0.0)))


def plan_mix(
    docs: DataFrame, targets: list[tuple[str, float, int]], source: str = "source", size: str = "n_tokens",
    shapes: dict[str, list[float]] | None = None, knots: list[float] | None = None, total: float | None = None,
) -> list[dict]:
    """Per usable source: tokens there are, share, demand, passes and the schedule. The driver sees one row per target source."""
    if len(targets) > MOST_SOURCES:
        raise ValueError("too many sources for one mix")
    names = [s for s, _, _ in targets]
    have = {r[0]: (r.tokens, r.docs) for r in docs.where(F.col(source).isin(names)).groupBy(source).agg(
        F.sum(size).alias("tokens"), F.count(F.lit(1)).alias("docs"),
    ).collect()}
    usable = [(s, p, m) for s, p, m in targets if p > 0 and m > 0 and have.get(s, (0, 0))[0] > 0]
    if not usable:
        return []
    scale = sum(p for _, p, _ in usable)
    most = min(m * have[s][0] * scale / p for s, p, m in usable)
    total = most if total is None else min(total, most)
    knots = knots or [0.0, 1.0]
    weights = fit_schedule({s: p / scale for s, p, _ in usable}, shapes or {}, knots)
    out = []
    for s, p, _ in usable:
        w, t = np.array(weights[s]), np.array(knots)
        at = np.append(0.0, np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(t)))
        demand = p / scale * total
        out.append({
            "source": s, "tokens": int(have[s][0]), "docs": int(have[s][1]), "demand": float(demand),
            "total": float(total), "passes": int(np.ceil(demand / have[s][0] - 1e-9)), "t": [float(v) for v in t],
            "w": [float(v) for v in w], "at": [float(v) for v in at],
        })
    return out


def first_fit(sizes: np.ndarray, room: float) -> np.ndarray:
    """Which of the sizes, in this order, are taken into ``room``, passing over those that don't fit what is left."""
    taken = np.zeros(len(sizes), bool)
    at = 0
    while at < len(sizes):
        fits = np.cumsum(sizes[at:]) <= room
        n = int(fits.argmin()) if not fits.all() else len(fits)  # a run that fits as a whole
        taken[at : at + n] = True
        room -= float(sizes[at : at + n].sum())
        at += n
        later = np.flatnonzero(sizes[at:] <= room)
        if not len(later):
            break
        at += int(later[0])
    return swapped(sizes, taken, room)


def swapped(sizes: np.ndarray, taken: np.ndarray, room: float) -> np.ndarray:
    """``taken`` after the swaps of one taken for one longer untaken size that fill most of the room left, while there are any."""
    taken = taken.copy()
    while room >= 1:
        inside, outside = np.flatnonzero(taken), np.flatnonzero(~taken)
        if not len(inside) or not len(outside):
            break
        inside = inside[np.argsort(sizes[inside], kind="stable")]
        have, other = sizes[inside], sizes[outside]
        at = np.searchsorted(have, other - room)  # the shortest taken one whose swap still fits
        gain = np.where(at < len(have), other - have[np.minimum(at, len(have) - 1)], 0)
        k = int(gain.argmax())
        if gain[k] < 1:
            break
        taken[outside[k]], taken[inside[at[k]]] = True, False
        room -= float(gain[k])
    return taken


def mix(docs: DataFrame, plan: list[dict], ident: str = "doc_id", source: str = "source", size: str = "n_tokens", bucket_rows: int = 20_000) -> DataFrame:
    """(ident, source, copy_no, n_tokens, position), sorted by position."""
    spark = docs.sparkSession
    kind = docs.schema[ident].dataType.simpleString()
    empty = f"{ident} {kind}, source string, copy_no int, n_tokens bigint, position double"
    if not plan:
        return spark.createDataFrame([], empty)
    # One row per target source, at most MOST_SOURCES: small enough to broadcast at any size of the data.
    side = spark.createDataFrame(
        [(p["source"], p["tokens"], p["demand"], p["total"], p["passes"], max(1, p["docs"] // bucket_rows), p["t"], p["w"], p["at"]) for p in plan],
        "s string, have bigint, demand double, total double, passes int, buckets bigint, t array<double>, w array<double>, at array<double>",
    )
    order = F.when(F.col(f"`{ident}`").isNotNull(), F.xxhash64(F.col(f"`{ident}`"))).otherwise(F.xxhash64(F.monotonically_increasing_id()))
    d = docs.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{source}`").alias("s0"), F.col(f"`{size}`").cast("bigint").alias("n"), order.alias("key"))
    d = written(d.join(F.broadcast(side.select(F.col("s").alias("s0"))), "s0", "left_semi"), "mixed")
    copies = d.join(
        F.broadcast(side.select("s", "passes", "buckets")), F.col("s0") == F.col("s"),
    ).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    copies = copies.withColumn("h", F.xxhash64("key", "copy")).withColumn(
        "b", F.pmod(F.shiftrightunsigned("h", 20), F.col("buckets")),
    ).select("id", "s", "n", "copy", "h", "b")
    sums = copies.groupBy("s", "copy", "b").agg(F.sum("n").alias("in_bucket"))
    before = Window.partitionBy("s", "copy").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # buckets, not rows
    sums = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
    sums = sums.join(F.broadcast(side.select("s", "have", "demand")), "s").withColumn("before", F.col("copy") * F.col("have") + F.col("before"))
    sums = sums.withColumn("room", F.col("demand") + 1e-6 - F.col("before")).where("room >= 0").drop("have", "demand")
    sums = written(sums, "buckets")
    used = copies.join(sums, ["s", "copy", "b"])
    own = F.sum("n").over(Window.partitionBy("s", "copy", "b").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0))
    shape = ["id", "s", "n", "copy", "before", "own"]
    whole = used.where("in_bucket <= room").withColumn("own", own).select(*shape)

    def cut(t: pa.Table) -> pa.Table:
        t = t.sort_by([("h", "ascending"), ("id", "ascending")])
        n = t.column("n").to_numpy()
        took = first_fit(n, t.column("room")[0].as_py())
        t = t.filter(pa.array(took))
        return pa.table([*[t.column(c) for c in shape[:-1]], pa.array(np.cumsum(n[took]), pa.int64())], names=shape)

    last = used.where("in_bucket > room").groupBy("s", "copy", "b").applyInArrow(cut, f"id {kind}, s string, n bigint, copy int, before bigint, own bigint")
    placed = whole.unionByName(last).join(F.broadcast(side.drop("passes", "buckets")), "s")
    placed = placed.withColumn("position", _position((F.col("before") + F.col("own") - F.col("n") / 2) / F.col("total")))
    out = placed.select(F.col("id").alias(ident), F.col("s").alias("source"), F.col("copy").alias("copy_no"), F.col("n").alias("n_tokens"), "position")
    return out.orderBy("position", "source", ident, "copy_no")


def share_report(docs: DataFrame, mixed: DataFrame, targets: DataFrame, source: str = "source", size: str = "n_tokens") -> DataFrame:
    """Per source (targets and any other): tokens there are, used, target and actual share, uses of a document at most."""
    have = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("docs"), F.sum(size).alias("tokens"))
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.count(F.lit(1)).alias("used_docs"), (F.max("copy_no") + 1).alias("most_uses"))
    t = targets.select("source", "target_share", "max_repeats")
    both = have.join(t, have["source"].eqNullSafe(t["source"]), "full")
    all_sources = both.select(F.coalesce(have["source"], t["source"]).alias("source"), "docs", "tokens", "target_share", "max_repeats")
    out = all_sources.join(used, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = F.sum(zero("used_tokens")).over(Window.partitionBy(F.lit(1)))  # one row per source
    return out.select(
        "source", zero("docs").alias("docs"), zero("tokens").alias("tokens"), zero("used_docs").alias("used_docs"),
        zero("used_tokens").alias("used_tokens"), zero("most_uses").alias("most_uses"),
        zero("max_repeats").alias("max_repeats"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.coalesce(zero("used_tokens") / total, F.lit(0.0)).alias("actual_share"),
    )
