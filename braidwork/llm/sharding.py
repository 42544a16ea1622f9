"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix (DataFrame functions only).

Rows fall into P source buckets by a hash of their key. How many rows of each bucket go to each destination
cell is drawn from the multivariate hypergeometric law, so the P x C communication matrix has the distribution
that a uniformly random permutation would give, with exact row and column sums. Each bucket permutes its rows
locally, deals them out by its row of the matrix, and each cell permutes what it received.

A shard is one or more cells of nearly equal size, so a shard of any length is permuted by several tasks, and
slots need no second count: the sizes of all cells are known before a row moves. The matrix is drawn in two
steps (groups of buckets, then the buckets of each group in parallel), which leaves its law unchanged; its size
depends on P and C, both bounded, never on the number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.llm.common import materialise, set_aside

#: Rows that a bucket or cell should hold, and the bounds of their numbers.
ROWS_PER_TASK, MAX_BUCKETS, MAX_CELLS = 65_536, 4_096, 3_072
#: Times the mean that a bucket may hold before repeated keys are told apart.
UNEVEN = 4
#: Entries of the matrix that one task draws, and the most tasks that draw them.
DRAWS_PER_TASK, MAX_GROUPS = 65_536, 64
#: Draws by rejection: each try accepts with a chance of over 1/2.
TRIES = 64


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 7, brought back by the recurrence."""
    y = x + 7
    product = x
    for k in range(1, 7):
        product = product * (x + k)
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def _uniform(*keys) -> Column:
    """A number in (0, 1) that depends on the keys alone."""
    return (F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") + 0.5) * F.lit(2.0**-53)


def hypergeometric(good: Column, bad: Column, sample: Column, *keys) -> Column:
    """How many of `sample` balls drawn without replacement from good + bad are good.

    Ratio-of-uniforms rejection (Stadlober) with the squeeze tests; `keys` seed the draw, so a task that
    is run again draws the same number. Constant expected work at any size.
    """
    g, b, s = (c.cast("double") for c in (good, bad, sample))
    setup = F.struct(F.least(g, b).alias("lo"), F.greatest(g, b).alias("hi"), (g + b).alias("pop"), F.least(s, g + b - s).alias("m"))

    def with_mode(p: Column) -> Column:
        share = p.lo / p.pop
        dev = F.sqrt((p["pop"] - p.m) * s * share * (1 - share) / (p["pop"] - 1) + 0.5)
        mode = F.floor((p.m + 1) * (p.lo + 1) / (p["pop"] + 2)).cast("double")
        return F.struct(p.lo.alias("lo"), p.hi.alias("hi"), p.m.alias("m"), (p.m * share + 0.5).alias("centre"), dev.alias("dev"), mode.alias("mode"))

    def weight(p: Column, z: Column) -> Column:
        return _log_gamma(z + 1) + _log_gamma(p.lo - z + 1) + _log_gamma(p.m - z + 1) + _log_gamma(p.hi - p.m + z + 1)

    def draw(p: Column) -> Column:
        # 1.7155... = 2 sqrt(2 / e), 0.8989... = 3 - 2 sqrt(3 / e): the hat's width.
        width = 2 * math.sqrt(2 / math.e) * p.dev + (3 - 2 * math.sqrt(3 / math.e))
        top = F.least(F.least(p.m, p.lo) + 1, F.floor(p.centre + 16 * p.dev).cast("double"))

        def attempt(t: Column, peak: Column) -> Column:
            x, y = _uniform(*keys, t, F.lit(1)), _uniform(*keys, t, F.lit(2))
            inside = lambda v: F.when((v.w >= 0) & (v.w < top), _let(F.struct(v.x.alias("x"), F.floor(v.w).cast("double").alias("z")), test))

            def test(v: Column) -> Column:
                ratio = peak - weight(p, v.z)
                return _let(F.struct(v.x.alias("x"), v.z.alias("z"), ratio.alias("t")), lambda q: F.when((q.x * (4 - q.x) - 3 <= q.t) | ((q.x * (q.x - q.t) < 1) & (2 * F.log(q.x) <= q.t)), q.z))

            return _let(F.struct(x.alias("x"), (p.centre + width * (y - 0.5) / x).alias("w")), inside)

        found = _let(weight(p, p.mode), lambda peak: F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(None).cast("double"), lambda z, t: F.when(z.isNotNull(), z).otherwise(attempt(t, peak))))
        return _let(F.coalesce(found, p.mode), lambda z: F.when(g > b, p.m - z).otherwise(z))

    drawn = _let(setup, lambda p: _let(with_mode(p), lambda q: _let(draw(q), lambda z: F.when(q.m < s, g - z).otherwise(z))))
    return F.when((s <= 0) | (g <= 0), F.lit(0)).when(b <= 0, sample).when(s >= g + b, good).otherwise(drawn).cast("bigint")


def _deal(counts: Column, capacity: Column, seed: int) -> Column:
    """counts: array of (id, n); capacity: free places by cell. Gives the array of (id, n by cell)."""

    def row(left: Column, item: Column) -> Column:
        start = F.struct(item.n.alias("need"), F.aggregate(left, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("places"), F.expr("cast(array() as array<bigint>)").alias("out"))

        def cell(acc: Column, c: Column) -> Column:
            x = hypergeometric(c, acc.places - c, acc.need, F.lit(seed), item.id, F.size(acc.out))
            return _let(x, lambda x: F.struct((acc.need - x).alias("need"), (acc.places - c).alias("places"), F.concat(acc.out, F.array(x)).alias("out")))

        return F.aggregate(left, start, cell, lambda acc: acc.out)

    def step(acc: Column, item: Column) -> Column:
        return _let(row(acc.left, item), lambda r: F.struct(F.zip_with(acc.left, r, lambda a, b: a - b).alias("left"), F.concat(acc.rows, F.array(F.struct(item.id.alias("id"), r.alias("n")))).alias("rows")))

    zero = F.struct(capacity.alias("left"), F.expr("cast(array() as array<struct<id:int,n:array<bigint>>>)").alias("rows"))
    return F.aggregate(counts, zero, step, lambda acc: acc.rows)


def communication_matrix(counts: DataFrame, capacity: Column, n_buckets: int, cells: int, seed: int) -> DataFrame:
    """counts: (bucket int, n bigint). Gives (bucket, ends): ends[c] is where, in the bucket's local order, cell c ends."""
    n_groups = max(1, min(MAX_GROUPS, n_buckets * cells // DRAWS_PER_TASK))
    per_group = max(1, math.ceil(n_buckets / n_groups))
    groups = counts.groupBy((F.col("bucket") / per_group).cast("int").alias("id")).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct(F.col("bucket").alias("id"), "n"))).alias("members"))
    first = groups.agg(F.sort_array(F.collect_list(F.struct("id", "n", "members"))).alias("g"))
    if n_groups == 1:
        return _ends(groups.select(F.explode(_deal(F.col("members"), capacity, seed)).alias("r")))
    dealt = F.arrays_zip(_deal(F.transform("g", lambda x: F.struct(x.id.alias("id"), x.n.alias("n"))), capacity, seed).alias("d"), F.col("g").alias("g"))
    spread = first.select(F.explode(dealt).alias("x")).select(F.col("x.d.n").alias("capacity"), F.col("x.g.members").alias("members"), F.col("x.g.id").alias("grp")).repartition(n_groups, "grp")
    return _ends(spread.select(F.explode(_deal(F.col("members"), F.col("capacity"), seed + 1)).alias("r")))


def _ends(rows: DataFrame) -> DataFrame:
    running = F.aggregate("r.n", F.expr("cast(array() as array<bigint>)"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x)))
    return rows.select(F.col("r.id").alias("bucket"), running.alias("ends"))


def hypergeometric_shards(df: DataFrame, n_shards: int, key: str = "doc_id", seed: int = 20_011) -> DataFrame:
    """All rows and columns of df, with shard int in 0..n_shards-1 and slot long, gapless from 0 within the shard.

    Shard sizes differ by one row at most; which rows a shard gets and their order are a uniform shuffle under
    the seed. An empty df gives no rows; a null key is a key like any other; repeated rows each get a place of
    their own (in either order); texts are never looked at. Columns of df named shard or slot are replaced.
    Where a key (or null) has so many rows that its bucket is uneven, rows are stored with a number of their own first, and
    fall into buckets by key and number.
    """
    df, back = set_aside(df.drop("shard", "slot"), "_bucket", "_rank", "_ends", "_cell", "_number")
    n = df.count()
    n_buckets = 1 << (min(MAX_BUCKETS, max(64, -(-n // ROWS_PER_TASK))) - 1).bit_length()
    q = max(1, min(MAX_CELLS // n_shards, -(-n // (n_shards * ROWS_PER_TASK))))
    cells = n_shards * q
    share = lambda whole, parts, k: F.floor(whole / parts) + F.when(k < whole % parts, 1).otherwise(0)
    shard_size = lambda s: F.lit(n // n_shards).cast("bigint") + F.when(s < n % n_shards, 1).otherwise(0)
    capacity = F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda c: share(shard_size(F.floor(c / q)), F.lit(q), c % q).cast("bigint"))

    rows = df.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(n_buckets)).cast("int"))
    counts = rows.groupBy(F.col("_bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    if (counts.agg(F.max("n")).first()[0] or 0) > UNEVEN * max(1024, n // n_buckets):
        numbered = materialise(df.withColumn("_number", F.monotonically_increasing_id()), "numbered")
        rows = numbered.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), key, "_number"), F.lit(n_buckets)).cast("int"))
        counts = rows.groupBy(F.col("_bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    spread = ["_number"] if "_number" in rows.columns else []
    matrix = communication_matrix(counts, capacity, n_buckets, cells, seed).withColumnRenamed("bucket", "_bucket")

    order = lambda k: [F.xxhash64(F.lit(seed + k), key, *spread), F.col(key)]
    local = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order(2))) - 1)

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc.lo + acc.hi) / 2).cast("int")
        open_ = acc.lo < acc.hi
        right = F.col("_ends")[F.least(mid, F.lit(cells - 1))] <= F.col("_rank")
        return F.struct(F.when(open_ & right, mid + 1).otherwise(acc.lo).alias("lo"), F.when(open_ & ~right, mid).otherwise(acc.hi).alias("hi"))

    steps = F.sequence(F.lit(0), F.lit(cells.bit_length()))
    cell = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(cells).alias("hi")), halve, lambda a: a.lo)
    dealt = local.join(matrix.withColumnRenamed("ends", "_ends"), "_bucket").withColumn("_cell", cell).drop("_bucket", "_rank", "_ends")

    place = F.row_number().over(Window.partitionBy("_cell").orderBy(*order(3))) - 1
    k, size = F.col("_cell") % q, shard_size(F.floor(F.col("_cell") / q))
    start = k * F.floor(size / q) + F.least(k.cast("bigint"), size % q)
    return dealt.withColumn("slot", (start + place).cast("bigint")).withColumn("shard", F.floor(F.col("_cell") / q).cast("int")).drop("_cell", *spread).withColumnsRenamed(back)
