"""Order statistics and ranks that never gather one group in one task.

A class, a day or a source may hold a third of all rows. A plain ``row_number`` over such a
group sorts it in a single task, and ``percentile`` holds all its distinct values in memory.
The functions here split every group first and combine small per-part counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from crowdtide.scratch import materialize

HASH_BUCKETS_HEX = 4  # hex digits of the hash that name a bucket: 65,536 buckets
ROWS_PER_RANGE = 5_000_000
INTEGERS = ("byte", "short", "integer", "long")
ROWS_PER_TASK = 200_000  # of rows that are sorted or grouped in memory
CHARACTERS_PER_TASK = 6_000_000  # of text that is cut into terms
HOT_KEYS = 10_000  # as many keys at most can have more than such a part of all uses
HOT_IN_PLACE = 50_000  # the same, where rows of rarer keys only are moved


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Hash a scan with fewer splits than cores over all cores; larger scans stay as they are.

    For tables of long texts, where the work per byte is far more than the shuffle. ``scan``
    must be a plain scan, so that counting its splits runs nothing.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, key)


def dealt_texts(df: DataFrame, key: str, text_col: str, characters: int = CHARACTERS_PER_TASK) -> DataFrame:
    """Rows hashed by ``key`` over as many tasks as their texts need; the tasks grow in number, not in size.

    Adaptive execution leaves a stated number alone. Left to itself it joins texts to tasks by their
    compressed bytes, of which each gives about a hundred bytes of counted terms.
    """
    total = df.agg(F.sum(F.char_length(text_col))).first()[0] or 0
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-total // characters)), key)


def in_tasks(table: DataFrame, *keys: str, rows: int = ROWS_PER_TASK) -> DataFrame:
    """A written table hashed by its keys into tasks of about ``rows`` rows, a number that adaptive execution keeps."""
    return table.repartition(max(1, -(-table.count() // rows)), *keys)


def seeded_hash(id_col: Column, seed: int) -> Column:
    """Hash that orders rows at random, the same way in every run."""
    return F.md5(F.concat_ws("|", id_col.cast("string"), F.lit(str(seed))))


def uniform(seed: int, *cols: Column) -> Column:
    """Uniform number in [0, 1) that depends on the row's values only, not on its partition."""
    bits = F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11)
    return bits.cast("double") * F.lit(2.0**-53)


def digest_uniform(seed: int, id_col: Column) -> Column:
    """Uniform number in [0, 1) from an MD5 digest, which every SQL engine can repeat."""
    bits = F.conv(F.substring(seeded_hash(id_col, seed), 1, 13), 16, 10).cast("double")
    return bits * F.lit(2.0**-52)


def hash_rank(df: DataFrame, keys: Sequence[str], id_col: str, seed: int, out: str) -> DataFrame:
    """Position (from 0) of each row within its keys, in seeded random order.

    Hash prefixes split every group evenly, so no task sorts more than 1/65,536 of a group;
    the position is the rows in smaller buckets plus the position within the bucket.
    """
    keys = list(keys)
    marked = df.withColumn("_hr_hash", seeded_hash(F.col(id_col), seed)).withColumn(
        "_hr_bucket", F.conv(F.substring("_hr_hash", 1, HASH_BUCKETS_HEX), 16, 10).cast("int")
    )
    sizes = marked.groupBy(*keys, "_hr_bucket").agg(F.count(F.lit(1)).alias("_hr_n"))
    before = W.partitionBy(*keys).orderBy("_hr_bucket").rowsBetween(W.unboundedPreceding, -1)
    # Written, so that its size is known: a small table is broadcast and the rows stay in place.
    starts = materialize(sizes, "sizes").select(
        *[F.col(k).alias(f"_hr_k_{k}") for k in keys],
        F.col("_hr_bucket").alias("_hr_key"),
        F.coalesce(F.sum("_hr_n").over(before), F.lit(0)).alias("_hr_start"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_hr_k_{k}")) for k in keys] + [F.col("_hr_bucket") == F.col("_hr_key")]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    within = W.partitionBy(*keys, "_hr_bucket").orderBy("_hr_hash", id_col)
    return (
        marked.withColumn("_hr_within", F.row_number().over(within))
        .join(starts, condition)
        .withColumn(out, (F.col("_hr_start") + F.col("_hr_within") - 1).cast("long"))
        .drop("_hr_hash", "_hr_bucket", "_hr_within", "_hr_start", "_hr_key", *[f"_hr_k_{k}" for k in keys])
    )


def _ranges(df: DataFrame, order: Sequence[str | Column], values: dict[str, Column], partitions: int | None) -> DataFrame:
    """Rows with values in sorted range partitions, as many as the session's or as the rows need."""
    if partitions is None:
        rows = df.count()
        partitions = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_RANGE))
    ordered = [F.col(o) if isinstance(o, str) else o for o in order]
    names = [f"_rt_o{i}" for i in range(len(ordered))]
    marked = df.select("*", *[o.alias(n) for n, o in zip(names, ordered)], *[c.alias(n) for n, c in values.items()])
    return marked.repartitionByRange(partitions, *names).sortWithinPartitions(*names).drop(*names)


def _carried(parts: DataFrame, ends: dict[str, Column], names: list[str], columns: list[str]) -> DataFrame:
    """Add to every row what the earlier ranges sum up to; ``parts`` is written and has ``_rt_part``."""
    sums = materialize(parts.groupBy("_rt_part").agg(*[c.alias(f"_rt_end_{n}") for n, c in ends.items()]), "sums")
    before = W.orderBy("_rt_part").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    starts = sums.select(
        F.col("_rt_part").alias("_rt_from"), *[F.coalesce(F.sum(f"_rt_end_{n}").over(before), F.lit(0)).alias(f"_rt_start_{n}") for n in names]
    )
    return parts.join(starts, F.col("_rt_part") == F.col("_rt_from")).select(
        *columns, *[(F.col(f"_rt_start_{n}") + F.col(f"_rt_sum_{n}")).alias(n) for n in names]
    )


def running_totals(
    df: DataFrame, order: Sequence[str | Column], totals: dict[str, Column], partitions: int | None = None
) -> DataFrame:
    """Running sums over one global order; the rows are shuffled once, into sorted ranges.

    Each range sums as it streams by in Arrow batches and is written with its own sums; the ranges'
    starting values (one row per range) are joined to it. Null values count as zero. The order is
    rising and has no ties.
    """
    names = list(totals)
    ranges = _ranges(df, order, {f"_rt_sum_{n}": F.coalesce(c, F.lit(0)) for n, c in totals.items()}, partitions)
    kinds = {n: "long" if ranges.schema[f"_rt_sum_{n}"].dataType.typeName() in INTEGERS else "double" for n in names}
    ranges = ranges.select(*df.columns, *[F.col(f"_rt_sum_{n}").cast(kinds[n]).alias(f"_rt_sum_{n}") for n in names])
    made = StructType([*ranges.schema.fields])
    for n in names:
        made = made.add(f"_rt_value_{n}", kinds[n])
    made = made.add("_rt_part", "integer")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        sums = {n: pa.scalar(0, pa.int64() if kinds[n] == "long" else pa.float64()) for n in names}
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = dict(zip(batch.schema.names, batch.columns))
            for n in names:
                columns[f"_rt_value_{n}"] = columns[f"_rt_sum_{n}"]
                columns[f"_rt_sum_{n}"] = pc.cumulative_sum(columns[f"_rt_value_{n}"], start=sums[n])
                sums[n] = columns[f"_rt_sum_{n}"][-1]
            columns["_rt_part"] = pa.repeat(pa.scalar(part, pa.int32()), batch.num_rows)
            yield pa.RecordBatch.from_arrays([columns[n] for n in made.names], made.names)

    parts = materialize(ranges.mapInArrow(add_up, made), "ranges")
    return _carried(parts, {n: F.sum(f"_rt_value_{n}") for n in names}, names, df.columns)


def ordered_index(df: DataFrame, order: Sequence[str | Column], out: str, start: int = 0) -> DataFrame:
    """Number rows from ``start`` along a rising global order that has no ties, with one shuffle of the rows."""
    place = F.monotonically_increasing_id()  # the range's number and, below 2^33, the place in it
    ranges = _ranges(df, order, {}, None).withColumn("_rt_place", place)
    parts = materialize(
        ranges.select(
            *df.columns,
            F.shiftright("_rt_place", 33).cast("int").alias("_rt_part"),
            (F.col("_rt_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(f"_rt_sum_{out}"),
        ),
        "ranges",
    )
    numbered = _carried(parts, {out: F.max(f"_rt_sum_{out}")}, [out], df.columns)
    return numbered.withColumn(out, F.col(out) - 1 + F.lit(start).cast("long"))


def lookup(rows: DataFrame, table: DataFrame, key: str, uses: str, values: list[str], spread: str) -> DataFrame:
    """Rows with the table's values for their key; rows without one are dropped.

    ``table`` is written, has a row per key, and counts the key's uses. At most ``HOT_KEYS`` keys can
    have more than a ``HOT_KEYS``-th of all uses; only these are broadcast. Rows that have found
    their key there are spread by ``spread`` in the join of the others, which no key dominates.
    """
    limit = table.agg(F.sum(uses) / HOT_KEYS).scalar()
    small = table.filter(F.col(uses) > limit)
    hot = F.broadcast(small.select(F.col(key).alias("_hk"), F.struct(*values).alias("_hv")))
    marked = rows.join(hot, F.col(key) == F.col("_hk"), "left")
    kind = rows.schema[key].dataType
    unmet = F.col("_hk").isNull()
    cold = table.filter(F.col(uses) <= limit).select(
        F.col(key).alias("_ck"), F.lit(0).cast("long").alias("_cs"), F.struct(*values).alias("_cv")
    )
    asked = marked.withColumn("_k", F.when(unmet, F.col(key)).otherwise(F.lit("0").cast(kind))).withColumn(
        "_s", F.when(unmet, F.lit(0)).otherwise(F.xxhash64(spread).bitwiseOR(F.lit(1)))
    )
    found = asked.join(cold, (F.col("_k") == F.col("_ck")) & (F.col("_s") == F.col("_cs")), "left")
    value = F.coalesce("_hv", "_cv")
    return found.select(*rows.columns, value.alias("_v")).filter(F.col("_v").isNotNull()).select(
        *rows.columns, *[F.col(f"_v.{v}").alias(v) for v in values]
    )


def lookup_in_place(rows: DataFrame, table: DataFrame, key: str, uses: str, values: list[str]) -> DataFrame:
    """As ``lookup``, for written rows, which are read twice: only the rows of rarer keys are moved.

    The at most ``HOT_IN_PLACE`` keys with more than such a part of all uses meet their rows where these are.
    """
    limit = table.agg(F.sum(uses) / HOT_IN_PLACE).first()[0] or 0.0
    often = F.col(uses) > limit

    def found(part: DataFrame) -> DataFrame:
        return part.select(F.col(key).alias("_key"), *values)

    hot = F.broadcast(found(table.filter(often)))
    met = rows.join(hot, F.col(key) == F.col("_key"))
    unmet = rows.join(hot.select("_key"), F.col(key) == F.col("_key"), "left_anti")
    rare = unmet.join(found(table.filter(~often)), F.col(key) == F.col("_key"))
    return met.unionByName(rare).drop("_key")


def quantile_name(col: str, p: float) -> str:
    return f"{col}_q{round(p * 100)}"


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    probs: Sequence[float],
    in_memory_values: int = 1_000_000,
    splits: int = 1_000,
    also: dict[str, Column] | None = None,
    accuracy: int = 4_000,
) -> DataFrame:
    """Exact quantiles with linear interpolation, columns ``<col>_q<percent>``, in one way at every size.

    The first pass takes a mergeable sketch per group, beside the aggregates ``also``. Its cuts lie
    closely around the wanted ranks. The second pass counts the rows between cuts, and counts them by
    value where the sketch's error allows a wanted rank; the exact counts then tell where the ranks
    are. Should a sketch be worse than its bound, all values are counted instead. Where more than
    ``in_memory_values`` different values share the part of a rank, it is cut again, until the rank
    can be read off. Nulls are no values; groups without any keep their row, with nulls.
    """
    keys, cols, probs, also = list(keys), list(cols), [float(p) for p in probs], also or {}
    group = [*keys, "_c"]
    points = sorted({min(max(p + step / accuracy, 0.0), 1.0) for p in probs for step in (-3, 0, 3)})
    numbers = {c: F.col(c).cast("double") for c in cols}
    summary = materialize(
        df.groupBy(*keys).agg(
            *[c.alias(n) for n, c in also.items()],
            *[F.count(v).alias(f"_n_{c}") for c, v in numbers.items()],
            *[F.percentile_approx(v, points, accuracy).alias(f"_cuts_{c}") for c, v in numbers.items()],
        ),
        "sketches",
    )
    sketches = summary.select(
        *keys,
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("_c"), F.col(f"_n_{c}").alias("_n"), F.col(f"_cuts_{c}").alias("_cuts")) for c in cols
        ])),
    ).filter("_n > 0")
    # Ranks that may lie between two neighbouring cuts, by the error of their two ranks.
    error = F.col("_n") / accuracy + 1
    position = [(F.col("_n") - 1) * p for p in probs]
    near = []
    for low, high in zip([None, *points], [*points, None]):
        above = [F.lit(True) if low is None else F.ceil(x) >= F.col("_n") * low - error for x in position]
        under = [F.lit(True) if high is None else F.floor(x) <= F.col("_n") * high + error for x in position]
        near.append(reduce(or_, [a & u for a, u in zip(above, under)]))
    values = df.select(
        *keys, F.inline(F.array(*[F.struct(F.lit(c).alias("_c"), v.alias("_v")) for c, v in numbers.items()]))
    ).filter(F.col("_v").isNotNull())
    wanted = (
        sketches.select(*group, "_n", F.explode(F.array(*[F.lit(p) for p in probs])).alias("_q"))
        .withColumn("_pos", (F.col("_n") - 1) * F.col("_q"))
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))))
        .select(*group, "_q", "_pos", "_rank")
    )
    ranks = wanted.select(*group, "_rank").distinct()
    order = W.partitionBy(*group).orderBy("_part")  # a row between two cuts
    for flags in (near, [F.lit(True)] * len(near)):
        marked = _null_safe_join(values, sketches.select(*group, "_cuts", F.array(*flags).alias("_flags")), group)
        counted = (
            marked.withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).cast("long"))
            .withColumn("_near", F.element_at("_flags", (F.col("_part") + 1).cast("int")))
            .groupBy(*group, "_part", "_near", F.when(F.col("_near"), F.col("_v")).alias("_v"))
            .agg(F.count(F.lit(1)).alias("_w"))
        )
        counted = materialize(counted, "values")
        ends = (
            counted.groupBy(*group, "_part", "_near")
            .agg(F.sum("_w").alias("_pw"))
            .withColumn("_end", F.sum("_pw").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
        )
        start = F.col("_end") - F.col("_pw")
        located = materialize(
            _null_safe_join(ranks, ends, group)
            .filter((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= start))
            .select(*group, "_rank", (F.col("_rank") - start).alias("_left"), "_part", "_near"),
            "ranks",
        )
        if located.filter(~F.col("_near")).isEmpty():
            break
    located = located.drop("_near")
    held = located.select(*group, "_part").distinct()
    rows = materialize(
        _null_safe_join(counted.filter("_near").select(*group, "_v", "_w", "_part"), held, [*group, "_part"]), "values"
    )
    found = _read_off(rows, located, wanted, keys, cols, probs, in_memory_values, splits)
    if not keys:
        one = found.select(F.struct(*found.columns).alias("_q")).scalar()
        return summary.select(*also, one.alias("_q")).select(*also, "_q.*")
    return _null_safe_join(summary.select(*keys, *also), found, keys, "left")


def _read_off(
    rows: DataFrame,
    ranks: DataFrame,
    wanted: DataFrame,
    keys: list[str],
    cols: list[str],
    probs: list[float],
    limit: int,
    splits: int,
) -> DataFrame:
    """Values at the ranks; parts with more than ``limit`` different values are cut again first."""
    points = [i / splits for i in range(1, splits)]
    group = [*keys, "_c"]
    part = [*group, "_part"]
    while True:
        biggest = rows.groupBy(*part).count().agg(F.max("count")).first()[0] or 0
        if biggest <= limit:
            break
        cuts = rows.groupBy(*part).agg(F.percentile_approx("_v", points, 10 * splits).alias("_cuts"))
        split = (
            _null_safe_join(rows, cuts, part)
            .withColumn("_sub", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).cast("long"))
            .drop("_cuts")
        )
        split = materialize(split, "parts")
        order = W.partitionBy(*part).orderBy("_sub")  # at most ``splits`` rows per part
        ends = (
            split.groupBy(*part, "_sub")
            .agg(F.sum("_w").alias("_pw"))
            .withColumn("_end", F.sum("_pw").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
        )
        ranks = materialize(
            _null_safe_join(ranks, ends, part)
            .filter((F.col("_left") < F.col("_end")) & (F.col("_left") >= F.col("_end") - F.col("_pw")))
            .select(
                *group,
                "_rank",
                (F.col("_left") - (F.col("_end") - F.col("_pw"))).alias("_left"),
                (F.col("_part") * splits + F.col("_sub")).alias("_part"),
            ),
            "ranks",
        )
        kept = ranks.select(*part).distinct()
        rows = _null_safe_join(
            split.select(*group, "_v", "_w", (F.col("_part") * splits + F.col("_sub")).alias("_part")),
            kept,
            part,
        )
        rows = materialize(rows, "values")
    upto = W.partitionBy(*part).orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = (
        _null_safe_join(rows.withColumn("_end", F.sum("_w").over(upto)), ranks, part)
        .filter((F.col("_left") < F.col("_end")) & (F.col("_left") >= F.col("_end") - F.col("_w")))
        .select(*group, "_rank", "_v")
    )
    values = (
        _null_safe_join(wanted, found, [*group, "_rank"])
        .groupBy(*group, "_q", "_pos")
        .agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .withColumn("_value", F.col("_lo") + (F.col("_pos") - F.floor("_pos")) * (F.col("_hi") - F.col("_lo")))
    )
    return values.groupBy(*keys).agg(
        *[
            F.max(F.when((F.col("_c") == c) & (F.col("_q") == float(p)), F.col("_value"))).alias(
                quantile_name(c, p)
            )
            for c in cols
            for p in probs
        ]
    )


def _null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join that also matches null keys and keeps the left copy of them."""
    renamed = right.select(*[F.col(c).alias(f"_j_{c}") if c in on else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_j_{c}"))
    return left.join(renamed, condition, how).drop(*[f"_j_{c}" for c in on])
