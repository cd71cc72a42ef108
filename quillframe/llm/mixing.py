"""Mixing sources to target weights by Poisson replication.

A source with share a of all characters and target weight w is repeated w / a times on average (its
rate). Each row gets a number in [0, 1) from a hash of the seed, its id and its text; the inverse of
the Poisson distribution with mean rate at that number says how often the row occurs. Rows are
exploded by their counts and shuffled globally: sorted by a hash of the seed, row and copy. The
hash's leading bits name the partition, as they spread evenly: no sampling pass is needed for equal
ranges. The hash also takes a row's place in the table read, so that equal rows, however many, don't
meet in one partition. Nothing is drawn at random, so lost tasks give the same rows again.

Defined results: weights default to equal ones for the sources that there are, NULL being a source
of its own; given weights are scaled to sum 1, and sources without a weight get none. Rows with NULL
text count 0 characters. Sources without characters have rate 0. Equal rows have equal counts.
Rates are statistics over all rows; an empty table gives an empty one. Texts of any length count
whole. Other columns pass through, whatever their names; one named like copy_col is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

SEED = 20261125
#: Sources above which the table of rates is joined by shuffle instead of sent to all executors.
BROADCAST_SOURCES = 10_000


def uniform(text: str) -> str:
    """SQL of a number in [0, 1) from the md5 of a string: 52 bits, exact in a double."""
    return f"cast(conv(substr(md5({text}), 1, 13), 16, 10) as bigint) / 4503599627370496.0D"


def rates(df: DataFrame, source_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """(source, rate) of every source that occurs; one aggregation over all rows."""
    sizes = df.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("chars"))
    if weights is None:
        weight: Column = F.when(F.col("chars") > 0, F.lit(1.0))
    else:
        if not weights or any(not math.isfinite(w) or w < 0 for w in weights.values()) or not sum(weights.values()):
            raise ValueError("weights must be finite, not negative, and not all 0")
        pairs = spark_map(weights)
        weight = F.when(F.col("chars") > 0, F.element_at(pairs, F.col("source"))) if any(weights) else F.lit(None)
    weighed = sizes.withColumn("weight", F.coalesce(weight, F.lit(0.0)))
    total = weighed.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weights"))
    rate = F.col("weight") * F.col("all_chars") / (F.col("all_weights") * F.col("chars"))
    return weighed.crossJoin(F.broadcast(total)).select("source", F.when((F.col("weight") > 0) & (F.col("chars") > 0), rate).otherwise(F.lit(0.0)).alias("rate"))


def spark_map(weights: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])


#: Inverse of the Poisson distribution at u for mean rate: how many of P(0), P(0)+P(1), ... are not
#: above u. The sum goes on to where what is left is below what u can tell. Means above 30 are sums of
#: means of at most 30 by quantiles of their own, so that exp(-mean) never vanishes.
_COUNT = """
aggregate(
  sequence(1, cast(ceil(rate + 12 * sqrt(rate)) as int) + 40),
  named_struct('p', exp(-rate), 'c', exp(-rate), 'n', cast(if(u >= exp(-rate), 1, 0) as bigint)),
  (s, k) -> named_struct('p', s.p * rate / k, 'c', s.c + s.p * rate / k, 'n', s.n + if(u >= s.c + s.p * rate / k, 1, 0)),
  s -> s.n)
"""
#: Largest mean that is inverted at once.
MEAN = 30.0


def replicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str, float] | None = None, seed: int = SEED, copy_col: str | None = None) -> DataFrame:
    """df with each row as often as its source's rate says, in a global random order.

    copy_col: if given, a column with the number of the copy from 0.
    """
    r = rates(df, source_col, text_col, weights)
    small = r.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    r = r.select(F.col("source").alias("_source"), "rate").where("rate > 0")
    ident = F.concat_ws(":", F.lit(str(seed)), F.coalesce(df[id_col].cast("string"), F.lit("")), F.md5(F.coalesce(df[text_col], F.lit(""))))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), df[source_col].cast("string").alias("_s"), ident.alias("_ident"), F.monotonically_increasing_id().alias("_at"))
    joined = rows.join(F.broadcast(r) if small else r, F.col("_s").eqNullSafe(F.col("_source")))
    # a mean above MEAN is drawn as several equal ones
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN)).cast("long")
    each = F.expr(f"transform(sequence(cast(1 as bigint), parts), j -> {uniform('concat(_ident, \":\", j)')})")
    counted = joined.withColumn("parts", draws).withColumn("rate", F.col("rate") / F.col("parts")).withColumn("us", each)
    counted = counted.withColumn("n", F.expr(f"aggregate(us, cast(0 as bigint), (a, u) -> a + {_COUNT})"))
    copies = counted.where("n > 0").select("row", "_ident", "_at", F.explode(F.expr("sequence(cast(0 as bigint), n - 1)")).alias("copy"))
    ordered = copies.withColumn("_order", F.xxhash64(F.lit(seed), "_ident", "copy", "_at"))
    # ranges of the hash (its 32 leading bits, as a number from 0) in order of the partitions
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.shiftright((F.shiftright("_order", 32) + (1 << 31)) * parts, 32).cast("int")
    mixed = ordered.repartitionById(parts, place).sortWithinPartitions("_order", "_ident", "copy", "_at")
    extra = [F.col("copy").alias(copy_col)] if copy_col else []
    return mixed.select(*[F.col("row").getField(c).alias(c) for c in df.columns if c.lower() != (copy_col or "").lower()], *extra)


def oracle_sql(source: str = "documents", seed: int = SEED) -> str:
    """(doc_id, source, copy, text) of replicate() with equal weights, in DuckDB's SQL."""
    return f"""
with recursive sizes as (
  select source, sum(length(text)) as chars from {source} group by source having sum(length(text)) > 0
), rates as (
  select source, 1.0::double * (select sum(chars) from sizes)::bigint / ((select count(*) from sizes)::double * chars::bigint) as rate0 from sizes
), parts as (
  select source, greatest(1, ceil(rate0 / {MEAN}))::int as parts, rate0 / greatest(1, ceil(rate0 / {MEAN}))::int as rate from rates
), steps as (
  select source, parts, rate, 0 as k, exp(-rate) as p, exp(-rate) as c from parts
  union all
  select source, parts, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) from steps where k < ceil(rate + 12 * sqrt(rate)) + 40
), bounds as (
  select source, parts, list(c order by k) as cs from steps group by source, parts
), u as (
  select d.doc_id, d.source, d.text, b.cs, ('0x' || substr(md5(concat('{seed}:', d.doc_id, ':', md5(coalesce(d.text, '')), ':', j)), 1, 13))::bigint / 4503599627370496.0::double as u
  from {source} d join bounds b on d.source is not distinct from b.source, unnest(range(1, b.parts + 1)) as t(j)
), n as (
  select doc_id, source, text, sum(len(list_filter(cs, lambda c: c <= u)))::bigint as n from u group by doc_id, source, text
)
select doc_id, source, text, unnest(range(n)) as copy from n where n > 0"""
