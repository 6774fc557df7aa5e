"""Connected components of undirected links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crowdtide.scratch import Rounds


SALTS = 256


def with_least(rows: DataFrame, key: str, least: Column, name: str, salt: Column) -> DataFrame:
    """``rows`` with the least value of each key as ``name``; rows of a null key are dropped.

    A key's rows are dealt by ``salt`` to ``SALTS`` parts. Each part finds its least value, the parts of a key
    (at most ``SALTS`` rows) agree on one, and it goes back to the parts: no task gets all rows of a key.
    """
    dealt = rows.filter(F.col(key).isNotNull()).withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)))
    parts = dealt.groupBy(key, "_salt").agg(F.min(least).alias("_part"))
    whole = parts.groupBy(key).agg(F.collect_list("_salt").alias("_salts"), F.min("_part").alias(name))
    back = whole.select(key, F.explode("_salts").alias("_salt"), name)
    return dealt.join(back, [key, "_salt"]).drop("_salt")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    known = with_least(both, "a", F.least("a", "b"), "m", F.col("b"))
    return known.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    known = with_least(down, "a", F.col("b"), "m", F.col("b"))
    own, inner = (F.struct(F.col(end).alias("a"), F.col("m").alias("b")) for end in ("a", "b"))
    return known.select(F.inline(F.when(F.col("b") == F.col("m"), F.array(own)).otherwise(F.array(own, inner))))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link; the component is its smallest node.

    ``links`` has columns ``a`` and ``b``; repeated links, loops and nulls are ignored. Each
    round is written to the shared folder, so lineage stays short and a lost executor costs at
    most one round. Rounds go on until every link points at the root of a star. The links of a hub are
    dealt to many tasks; they never meet in one. The links are written before the first round: a round
    reads its links several times, and a plan that holds each of these readings takes much of the driver.
    """
    rounds = Rounds(links.sparkSession, "components")
    stars, _ = rounds.write(links.select("a", "b").filter("a <> b").distinct())
    before = None
    while True:
        stars = _small_star(_large_star(stars)).filter("a <> b").distinct()
        stars, total = rounds.write(
            stars, n=F.count(F.lit(1)), s=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        )
        state = (total["n"], total["s"])
        if state == before:
            break
        before = state
    roots = stars.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
