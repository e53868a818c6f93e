"""Draw samples whose category shares match given targets.

Per mix, the wanted shares of the strata are raked by iterative proportional fitting over the margins of the mix (each of its
columns, and its size), no cell above what the pool holds nor below its minimum: where a stratum is short, its neighbours in the same
margins take over, so that the margins still match.  Every record then gets a weighted exponential key ``-ln(u) / w`` from a hash of its
id, ``w`` being its raked chance, and the smallest keys up to the size of the mix are the first draw.  The repair keeps its rows
but for swaps at constant size: a stratum that came out below its minimum, or above or below its raked share by a row or more, takes its
next smallest keys or gives back its largest.  What remains of the targets is reported per stratum and per margin.

Scale: records meet the plan (mixes x cells, a few hundred rows) in a map-side join; the cut-off keys of mixes and strata
are found from one histogram of keys with partial aggregation, so no mix or stratum is ever sorted or
gathered in one task; only records in the one bucket that holds a cut-off are ranked, and the number of buckets
grows with the pool, so that bucket stays small.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwork.session import stage_table

#: Rows that targets may hold; they are read by the driver.
MAX_TARGET_ROWS = 100_000
#: Records of one key bucket, about.
BUCKET_ROWS = 50_000
PLAN_SCHEMA = "cell string, mix_id long, stratum string, weight double, scale double, buckets long, n_first long"


@dataclass
class Mixture:
    sample: DataFrame  # mix_id, stratum, rec_key, draw_key, first_draw: whether the record was in the first draw
    report: DataFrame  # mix_id, stratum, dims, wanted, available, share, raked, first_draw, drawn, gap, residual, dims_known

    def margins(self) -> DataFrame:
        """mix_id, dim, value, target, drawn, residual: rows by each single column of each mix."""
        dims, parts = F.split("dims", r"\|"), F.split("stratum", r"\|")
        each = self.report.where("dims_known").select("mix_id", "share", "drawn", F.explode(F.arrays_zip(dims.alias("dim"), parts.alias("value"))).alias("m"))
        sums = each.groupBy("mix_id", F.col("m.dim").alias("dim"), F.col("m.value").alias("value")).agg(F.sum("share").alias("target"), F.sum("drawn").alias("drawn"))
        return sums.withColumn("residual", F.col("target") - F.col("drawn"))


def rake(
    start: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]], least: np.ndarray, most: np.ndarray, rounds: int = 500, tol: float = 1e-9
) -> np.ndarray:
    """Masses per cell, between ``least`` and ``most``, whose margins match the targets as far as these bounds allow.

    A margin is (stratum index per cell or -1, target mass per stratum).  A margin that the bounds keep from its target keeps its
    residual; the last margin is fitted last.  Cells at a bound stay there and the others of the margin share the rest.
    """
    mass = np.clip(start.astype(float), least, most)
    for _ in range(rounds):
        before = mass.copy()
        for at, target in margins:
            for k, want in enumerate(target):
                mine = np.flatnonzero(at == k)
                for _ in range(len(mine) + 1):  # each step fixes at least one more cell at a bound
                    short = want - mass[mine].sum()
                    free = mine[(mass[mine] < most[mine]) if short > 0 else (mass[mine] > least[mine])]
                    held = mass[free].sum()
                    if abs(short) < 1e-12 or not held > 0:
                        break
                    mass[free] = np.clip(mass[free] * max(0.0, 1 + short / held), least[free], most[free])
        if np.max(np.abs(mass - before), initial=0.0) < tol:
            break
    return mass


@dataclass
class _Mix:
    mix_id: int
    size: int
    strata: list[str]
    n: np.ndarray  # records in the pool
    least: np.ndarray  # minimum, as far as the pool holds it
    mass: np.ndarray  # raked
    margins: list[tuple[np.ndarray, np.ndarray]]


def _mixes(cells: list[dict], targets: list[dict], labels: list[str]) -> list[_Mix]:
    """The raked masses of the strata of each mix whose columns are known."""
    mixes: dict[int, list[dict]] = {}
    for t in targets:
        if t["dims"] and all(d in labels for d in t["dims"].split("|")) and t["stratum"] is not None:
            mixes.setdefault(t["mix_id"], []).append(t)
    out = []
    for mix_id, rows in mixes.items():
        dims, pool = rows[0]["dims"].split("|"), rows[0]["pool_table"]
        held: dict[str, int] = {}
        for c in cells:
            if c["pool_table"] == pool and all(c[d] is not None for d in dims):
                name = "|".join(c[d] for d in dims)
                held[name] = held.get(name, 0) + c["n"]
        strata = sorted({r["stratum"] for r in rows})
        by = {r["stratum"]: r for r in rows}
        n = np.array([held.get(s, 0) for s in strata], float)
        size = float(rows[0]["sample_size"] or 0)
        share = np.array([float(by[s]["target_permille"] or 0) / 1000 * size for s in strata])
        least = np.minimum(n, [float(by[s]["min_rows"] or 0) for s in strata])
        margins = []
        for d in range(len(dims)):
            parts = [s.split("|")[d] if d < len(s.split("|")) else None for s in strata]
            index = {v: i for i, v in enumerate(sorted({v for v in parts if v is not None}))}
            at = np.array([index.get(v, -1) for v in parts])
            margins.append((at, np.bincount(at[at >= 0], share[at >= 0], minlength=len(index))))
        whole = (np.zeros(len(strata), int), np.array([max(least.sum(), min(size, n.sum()))]))
        mass = rake(share, [*margins, whole], least, n)
        out.append(_Mix(mix_id, int(round(mass.sum())), strata, n, least, mass, margins))
    return out


def _plan(cells: list[dict], mixes: list[_Mix], pools: dict[int, str], dims: dict[int, list[str]]) -> list[tuple]:
    """One row per mix and cell with a share: weight of a record, scale of the mix, buckets, size of the first draw."""
    out = []
    for m in mixes:
        own = [c for c in cells if c["pool_table"] == pools[m.mix_id] and all(c[d] is not None for d in dims[m.mix_id])]
        total = sum(c["n"] for c in own)
        at = {s: i for i, s in enumerate(m.strata)}
        for c in own:
            i = at.get("|".join(c[d] for d in dims[m.mix_id]))
            if i is not None and m.mass[i] > 0:
                out.append((c["cell"], m.mix_id, m.strata[i], float(m.mass[i] / m.n[i]), max(m.size, 1) / total, max(1024, total // BUCKET_ROWS), m.size))
    return out


def quotas(m: _Mix, drawn: np.ndarray) -> np.ndarray:
    """Whole rows per stratum after the repair: the first draw where it is within a row of the raked mass and no less than the minimum,
    swaps at constant size elsewhere, chosen so that the margins come out within a row of their raked sums, too."""
    low = np.maximum(np.ceil(m.least - 1e-9), np.floor(m.mass + 1e-9))
    high = np.minimum(m.n, np.ceil(m.mass - 1e-9))
    high = np.maximum(low, high)
    sums = [(at, np.bincount(at[at >= 0], m.mass[at >= 0], minlength=len(t))) for at, t in m.margins]
    best, rng = None, np.random.default_rng(len(drawn))
    for start in range(24):  # the first draw as it is, then with other roundings of single strata
        q = np.clip(drawn, low, high)
        if start:
            q = np.where(rng.random(len(q)) < 0.5, np.clip(np.floor(m.mass + rng.random(len(q))), low, high), q)
        q = _swap(q, m, low, high, sums)
        worst = max([abs(m.size - q.sum()), *(np.max(np.abs(_lack(at, want, q)), initial=0.0) for at, want in sums)])
        if best is None or worst < best[0]:
            best = worst, q
        if worst <= 1 + 1e-6:
            break
    return best[1].astype(np.int64)


def _lack(at: np.ndarray, want: np.ndarray, q: np.ndarray) -> np.ndarray:
    return want - np.bincount(at[at >= 0], q[at >= 0], minlength=len(want))


def _swap(q: np.ndarray, m: _Mix, low: np.ndarray, high: np.ndarray, sums: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Rows taken, given back or exchanged one by one while that lessens the squared gaps of the margins, at the size of the mix."""
    q = q.copy()
    for _ in range(6 * len(q) + 6):
        lacks = [np.where(at >= 0, _lack(at, want, q)[np.maximum(at, 0)], 0.0) if len(want) else np.zeros(len(q)) for at, want in sums]
        tie = 0.01 * (q - m.mass)
        add = np.where(q < high, sum((1 - 2 * x for x in lacks), 0.0) + tie, np.inf)
        take = np.where(q > low, sum((1 + 2 * x for x in lacks), 0.0) - tie, np.inf)
        short = m.size - q.sum()
        if short and np.isfinite((add if short > 0 else take).min()):
            k = int(np.argmin(add if short > 0 else take))
            q[k] += 1 if short > 0 else -1
            continue
        if short:
            break
        gain, pair = -1e-9, None
        for i in np.argsort(add, kind="stable")[:8]:
            if not np.isfinite(add[i]):
                break
            both = add[i] + take - 2 * sum(((at == at[i]) & (at >= 0) for at, _ in sums), np.zeros(len(q)))
            both[i] = np.inf
            j = int(np.argmin(both))
            if both[j] < gain:
                gain, pair = both[j], (int(i), j)
        if pair is None:
            break
        q[pair[0]] += 1
        q[pair[1]] -= 1
    return q


def match_proportions(spark: SparkSession, pool: DataFrame, targets: DataFrame, labels: list[str], seed: int = 7) -> Mixture:
    """``pool`` has ``pool_table``, ``rec_key`` (unique within its pool) and the columns ``labels``; ``targets`` is as ``mix_target``.

    Nulls: a record with a null label is in no stratum of that column; a null minimum, share or size counts as 0.
    Empty pool or empty targets: an empty sample, and a report in which every wanted record is a gap.  A mix of columns that
    are not in ``labels`` draws nothing and is reported with ``dims_known`` false.
    Ties of keys are broken by ``rec_key``.  Other columns of ``pool`` are ignored.
    """
    rows = [r.asDict() for r in targets.limit(MAX_TARGET_ROWS + 1).collect()]
    if len(rows) > MAX_TARGET_ROWS:
        raise ValueError("too many targets")
    cell = F.concat_ws("|", "pool_table", *[F.coalesce(F.col(c), F.lit("\0")) for c in labels])
    slim = stage_table(spark, pool.select("pool_table", F.col("rec_key").cast("string"), *labels, cell.alias("cell")), "pool")
    cells = [r.asDict() for r in slim.groupBy("cell", "pool_table", *labels).agg(F.count("*").alias("n")).collect()]
    mixes = _mixes(cells, rows, labels)
    dims = {r["mix_id"]: r["dims"].split("|") for r in rows if r["dims"]}
    plan = spark.createDataFrame(_plan(cells, mixes, {r["mix_id"]: r["pool_table"] for r in rows}, dims), PLAN_SCHEMA)

    # The plan has at most mixes x cells rows, all made on the driver just now.
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix_id", "rec_key"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    keyed = (
        slim.join(F.broadcast(plan), "cell")
        .withColumn("draw_key", -F.log(unit) / F.col("weight"))
        .withColumn("bucket", F.floor((1 - F.exp(-F.col("draw_key") * F.col("scale"))) * F.col("buckets")))
        .select("mix_id", "stratum", "rec_key", "draw_key", "bucket", "n_first")
    )
    counts = stage_table(spark, keyed.groupBy("mix_id", "stratum", "bucket", "n_first").agg(F.count("*").alias("n")), "keys")

    # the first draw: the key that ends it, per mix, and how many it took of each stratum
    by_mix = Window.partitionBy("mix_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        counts.groupBy("mix_id", "bucket", "n_first").agg(F.sum("n").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(by_mix), F.lit(0)))
        .where("before < n_first")
        .groupBy("mix_id", "n_first").agg(F.max(F.struct("bucket", "before")).alias("e"))
        .select("mix_id", F.col("e.bucket").alias("edge"), (F.col("n_first") - F.col("e.before")).alias("left"))
    )
    ends = stage_table(spark, ends, "ends")  # one row per mix
    in_mix = F.row_number().over(Window.partitionBy("mix_id").orderBy("draw_key", "rec_key"))
    last = keyed.join(F.broadcast(ends), "mix_id").where(F.col("bucket") == F.col("edge")).withColumn("place", in_mix).where("place <= left")
    last = stage_table(spark, last.select("mix_id", "stratum", "rec_key", "draw_key"), "last")
    limits = last.groupBy("mix_id").agg(F.max(F.struct("draw_key", "rec_key")).alias("last"))  # one row per mix
    full = counts.join(F.broadcast(ends), "mix_id").where("bucket < edge").groupBy("mix_id", "stratum").agg(F.sum("n").alias("n"))
    first = full.unionByName(last.groupBy("mix_id", "stratum").agg(F.count("*").alias("n"))).groupBy("mix_id", "stratum").agg(F.sum("n").alias("n"))
    drawn = {(r["mix_id"], r["stratum"]): r["n"] for r in first.collect()}  # at most one row per target

    out = []
    for m in mixes:
        d = np.array([drawn.get((m.mix_id, s), 0) for s in m.strata], float)
        out += [(m.mix_id, s, int(n), float(x), int(k), int(q)) for s, n, x, k, q in zip(m.strata, m.n, m.mass, d, quotas(m, d))]
    quota = spark.createDataFrame(out, "mix_id long, stratum string, available long, raked double, first_draw long, quota long")

    # the repaired draw: the key that ends each stratum
    by_stratum = Window.partitionBy("mix_id", "stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        counts.join(F.broadcast(quota), ["mix_id", "stratum"])
        .withColumn("before", F.coalesce(F.sum("n").over(by_stratum), F.lit(0)))
        .where("before < quota")
        .groupBy("mix_id", "stratum", "quota").agg(F.max(F.struct("bucket", "before")).alias("e"))
        .select("mix_id", "stratum", F.col("e.bucket").alias("cut"), (F.col("quota") - F.col("e.before")).alias("left"))
    )
    near = keyed.join(F.broadcast(stage_table(spark, cut, "cut")), ["mix_id", "stratum"]).where("bucket <= cut")
    kept = ["mix_id", "stratum", "rec_key", "draw_key"]
    rank = F.row_number().over(Window.partitionBy("mix_id", "stratum").orderBy("draw_key", "rec_key"))
    edge = near.where("bucket = cut").withColumn("place", rank).where("place <= left")
    sample = near.where("bucket < cut").select(*kept).unionByName(edge.select(*kept)).join(F.broadcast(limits), "mix_id")
    sample = sample.select(*kept, (F.struct("draw_key", "rec_key") <= F.col("last")).alias("first_draw"))
    share = F.coalesce(F.col("sample_size") * F.col("target_permille"), F.lit(0)) / 1000
    wanted = F.greatest(F.coalesce(F.col("min_rows"), F.lit(0)).cast("double"), share)
    known = F.coalesce(F.forall(F.split("dims", r"\|"), lambda d: d.isin(*labels)), F.lit(False))
    report = (
        targets.select("mix_id", "stratum", "dims", wanted.alias("wanted"), share.alias("share"), known.alias("dims_known"))
        .join(F.broadcast(quota.withColumnRenamed("quota", "drawn")), ["mix_id", "stratum"], "left")
        .fillna(0, ["available", "raked", "first_draw", "drawn"])
        .withColumn("gap", F.greatest(F.lit(0.0), F.col("wanted") - F.col("available")))
        .withColumn("residual", F.col("share") - F.col("drawn"))
    )
    return Mixture(sample, report)
