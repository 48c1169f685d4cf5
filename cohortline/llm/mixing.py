"""Mixing sources to target weights: weighted sampling without replacement by exponential keys, in built-in functions.

Every document draws a key -ln(u) / quality weight from a hash of itself. Within a source, documents come in the order
of their keys (so better ones tend to come first) until the source's budget of words is reached; complete epochs come
before that. The prefix sum of a source isn't computed in one task: the 52-bit range of keys is cut into 1024 parts,
whose sums are taken with partial aggregation, then the part in which the budget ends is cut again, until it holds few
rows. Only these are sorted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import pick, saved, table

BITS = 52
#: Rows of one source that are sorted in one task; a part with more is cut again while key bits are left.
SORTED_ROWS = 10_000
#: Sources up to this number are joined by broadcast (about 64 bytes each), more by a shuffle.
BROADCAST_SOURCES = 50_000


def _sources(base: DataFrame, budget: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """Target words of each source by water-filling. One row per source, so that its windows take one task."""
    by = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    all_rows = Window.partitionBy()
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.sum("source_size").over(all_rows) * F.lit(float(budget)) - before("cap")) / (F.sum("weight").over(all_rows) - before("weight"))
    by = by.withColumn("full", F.col("cap") / F.col("weight")).withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "sid", "level"))).over(all_rows)
    by = by.withColumn("at", first["level"])
    by = by.withColumn("target", F.least("cap", F.coalesce(F.col("at") * F.col("weight"), F.col("cap"))))
    goal = F.floor("target")
    return by.select(
        "sid", "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).alias("epochs"),
        F.when(F.col("source_size") > 0, F.pmod(goal, F.col("source_size"))).otherwise(0).alias("rest"),
    )


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", quality: DataFrame | None = None, budget: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), seed: str = "mix-1", sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """How often, and to which extent, each document goes into the mix: doc_id, source, size, source_size, target, taken.

    size: number of runs of characters other than space and \\t to \\r; 0 for a null or empty text. Sources by code
    point, null last, weigh `weights` in turn and share `budget` times all sizes; a target stops at `cap` times its
    source's size, and the excess goes to the others by weight until none is above. taken: words of the document in the
    mix; complete epochs first, then documents by their keys; the last of them gives the leading words that are missing,
    so that a source's sum is its target without the fraction. A document of size 0 takes 0.

    quality (doc_id, quality 0 or 1; other columns don't matter) doubles or halves the rate of a document's key; without
    a row, or with a null, the rate is 1; of several rows the mean counts. Repeated rows have equal keys, and one of
    them may be cut or left out; results agree as sets of rows. No rows give no rows."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    drawn = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    u = (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << BITS)
    base = pick(docs, doc_id=doc_id, text=text, source=source).select("doc_id", "source", words.alias("size"), (-F.ln(u)).alias("key"))
    if quality is not None:
        rates = pick(quality, q_id="doc_id", quality="quality").filter("q_id IS NOT NULL").groupBy("q_id").agg(F.avg("quality").alias("quality"))
        base = base.join(rates, F.col("doc_id") == F.col("q_id"), "left")
        rate = F.when(F.col("quality") >= 0.5, 2.0).when(F.col("quality") < 0.5, 0.5).otherwise(1.0)
        base = base.select("doc_id", "source", "size", (F.col("key") / rate).alias("key"))
    part = F.least(F.floor((1 - F.exp(-F.col("key"))) * float(1 << BITS)), F.lit((1 << BITS) - 1))
    base = saved(base.withColumn("part", part))
    sources = saved(_sources(base, budget, cap, weights))
    few = sources.count() <= BROADCAST_SOURCES
    small = F.broadcast if few else lambda x: x
    named = sources.withColumnRenamed("source", "of")
    rows = base.join(small(named), F.col("source").eqNullSafe(F.col("of"))).drop("of")

    open_ = sources.filter("rest > 0").select("sid", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    shift = BITS
    while True:
        wide = shift  # at which the prefixes are taken
        shift -= min(10, shift)
        inside = rows.drop("rest").join(small(open_), "sid").filter(F.shiftright("part", wide) == F.col("prefix"))
        sums = inside.groupBy("sid", F.shiftright("part", shift).alias("sub")).agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        run = F.sum("w").over(Window.partitionBy("sid").orderBy("sub").rowsBetween(Window.unboundedPreceding, 0))
        crossing = sums.withColumn("run", run).filter("before + run >= rest")
        first = F.min_by(F.struct("rest", "sub", F.expr("before + run - w").alias("b"), "n"), "sub").alias("x")
        open_ = saved(crossing.groupBy("sid").agg(first).select("sid", F.col("x.rest").alias("rest"), F.col("x.sub").alias("prefix"), F.col("x.b").alias("before"), F.col("x.n").alias("n")))
        if not shift or (open_.agg(F.max("n")).first()[0] or 0) <= sorted_rows:
            break
    here = rows.join(small(open_.select("sid", "prefix", "before")), "sid", "left").withColumn("sub", F.shiftright("part", shift))
    whole = F.col("epochs") * F.col("size")
    out = ["doc_id", "source", "size", "source_size", "target"]
    easy = here.filter("prefix IS NULL OR sub <> prefix").select(*out, (whole + F.when(F.col("sub") < F.col("prefix"), F.col("size")).otherwise(0)).cast("long").alias("taken"))
    prefix = F.sum("size").over(Window.partitionBy("sid").orderBy("key", F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    part_of = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before") - F.col("run") + F.col("size")))
    hard = here.filter("sub = prefix").withColumn("run", prefix).select(*out, (whole + part_of).cast("long").alias("taken"))
    return easy.unionByName(hard)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), quality=table(spark, sf_dir, "labels")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix-1:' || coalesce(cast(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS drawn
  FROM documents
), q AS (SELECT doc_id, avg(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
k AS (
  SELECT d.*, -ln((cast(('0x' || substr(drawn, 1, 13)) AS BIGINT) + 0.5) / 4503599627370496) / CASE WHEN quality >= 0.5 THEN 2.0 WHEN quality < 0.5 THEN 0.5 ELSE 1.0 END AS key
  FROM d LEFT JOIN q ON d.doc_id = q.doc_id
), s AS (
  SELECT source, sum(size)::DOUBLE AS source_size, 2 * sum(size)::DOUBLE AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
    row_number() OVER (ORDER BY source NULLS LAST) AS sid
  FROM d GROUP BY source
), l AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM s
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, (cap / weight, sid)) FROM l WHERE level <= cap / weight) * weight, cap)) AS target FROM l
), x AS (
  SELECT doc_id, size, cast(source_size AS BIGINT) AS source_size, target,
    CASE WHEN source_size > 0 THEN cast(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS epochs,
    CASE WHEN source_size > 0 THEN cast(floor(target) AS BIGINT) % cast(source_size AS BIGINT) ELSE 0 END AS rest,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, cast(epochs * size + greatest(0, least(size, rest - run + size)) AS BIGINT) AS taken FROM x
"""
