"""Mixing sources to target weights by Pareto order sampling.

Sources get targets in words: a budget shared by weight, where a target stops at a multiple of its source's size and
the excess is shared again by weight. Inside a source a document is expected ``e = min(most, rate * measure)`` times,
its measure growing with the square root of its size; the rate makes the expected words the target. The whole part of
``e`` is taken for certain; the rest ``p`` competes: documents are ranked by the odds of a random number divided by
the odds of ``p`` (Pareto order sampling), and taken in that order until the target's words are filled.

The random number comes from a keyed digest of id and text, so reruns and retries agree, whatever the partitioning.
Only sums leave the tasks: by measure for the rate, and by buckets of the rank for the place where the target is
filled. The bucket that holds it is split once more, and only documents of that last small piece are ordered. A source
with most of the rows is therefore never sorted or gathered, and the texts are not shuffled: each row decides by the
few numbers of its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.session import cut

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), text).cast("binary"))
    return docs.withColumns({
        "_size": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "_draw": F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"),
    }).withColumns({
        "_source": F.col(source_col),
        "_measure": F.greatest(F.floor(F.sqrt(F.col("_size").cast("double")) * 16), F.lit(1)).cast("long"),
    })


def _targets(sizes: DataFrame, weights, share: float, most: int) -> DataFrame:
    """``(_source, source_size, target)``: shares by weight, none above ``most`` times its source's size."""
    every = Window.partitionBy()
    order = every.orderBy(F.col("_source").asc_nulls_last())
    rank = every.orderBy("ratio", "place")
    level = (F.col("budget") - F.col("below")) / F.col("weight_on")
    cap = F.col("source_size") * F.lit(most)
    fits = F.col("weight") * level <= cap
    return (
        sizes.withColumns({"place": F.row_number().over(order) - 1, "budget": F.sum("source_size").over(every) * F.lit(float(share))})
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("ratio", cap.cast("double") / F.col("weight"))
        .withColumns({
            "below": F.coalesce(F.sum(cap).over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "weight_on": F.sum("weight").over(rank.rowsBetween(0, Window.unboundedFollowing)),
        })
        .withColumn("level", F.min(F.when(fits, F.struct("ratio", "place", level.alias("level")))).over(every)["level"])
        .select("_source", "source_size", F.coalesce(F.least(cap.cast("double"), F.col("weight") * F.col("level")), cap.cast("double")).alias("target"))
    )


def _rates(by_measure: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """The rate that makes the expected words of each source its target; null where every document is taken ``most`` times."""
    down = Window.partitionBy("_source").orderBy(F.col("_measure").desc())
    up = Window.partitionBy("_source").orderBy("_measure")
    rate = (F.col("target") - F.col("capped")) / F.col("open")
    return (
        by_measure.withColumns({
            "capped": F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.lit(most),
            "open": F.sum(F.col("words") * F.col("_measure")).over(up.rowsBetween(Window.unboundedPreceding, 0)),
        })
        .join(targets, F.col("_source").eqNullSafe(F.col("t_source")))
        .filter((F.col("open") > 0) & (rate * F.col("_measure") <= F.lit(most)))
        .groupBy("_source").agg(F.max(F.struct("_measure", rate.alias("rate")))["rate"].alias("rate"))
    )


def _with_rank(rows: DataFrame, most: int) -> DataFrame:
    """Adds certain copies ``_whole`` and the rank ``_rank`` in (0, 1); rows with nothing left to compete for rank at 2."""
    e = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(
        F.coalesce(F.least(F.col("rate") * F.col("_measure"), F.lit(float(most))), F.lit(float(most))))
    u = (F.col("_draw").cast("double") + 0.5) / F.lit(4503599627370496.0)
    odds = u * (1 - F.col("_part")) / ((1 - u) * F.col("_part"))
    return (
        rows.withColumn("_expect", e).withColumn("_whole", F.floor("_expect"))
        .withColumn("_part", F.col("_expect") - F.col("_whole"))
        .withColumn("_rank", F.when(F.col("_part") > 0, odds / (1 + odds)).otherwise(F.lit(2.0)))
    )


def _source_plan(rows: DataFrame, weights, share: float, most: int) -> DataFrame:
    """One row per source: ``source_size, target, rate`` and the rank up to which competing documents are taken."""
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    by_measure = cut(rows.groupBy("_source", "_measure").agg(F.sum("_size").alias("words"), F.count("*").alias("n")))
    sizes = by_measure.groupBy("_source").agg(F.sum("words").alias("source_size"))
    targets = cut(_targets(sizes, weights, share, most)).withColumnRenamed("_source", "t_source")
    rates = _rates(by_measure, targets, most).withColumnRenamed("_source", "r_source")
    plan = cut(targets.join(rates, same("t_source", "r_source"), "left").select("t_source", "source_size", "target", "rate"))
    ranked = _with_rank(rows.join(plan, same("_source", "t_source")), most).filter(F.col("_rank") < 2)
    whole = (
        _with_rank(by_measure.withColumn("_draw", F.lit(0)).join(plan, same("_source", "t_source")), most)
        .groupBy("_source").agg(F.sum(F.col("words") * F.col("_whole")).alias("certain"))
    )
    first = F.floor(F.col("_rank") * BUCKETS)
    second = F.floor((F.col("_rank") * BUCKETS - first) * BUCKETS)
    up = Window.partitionBy("_source")
    # where the target is filled: the first bucket whose end goes beyond what is left after the certain copies
    need = plan.join(whole.withColumnRenamed("_source", "w_source"), same("t_source", "w_source")).select(
        "t_source", (F.col("target") - F.col("certain")).alias("need"))

    def crossing(sums: DataFrame, need: DataFrame, key: str) -> DataFrame:
        run = sums.withColumn("upto", F.sum("words").over(up.orderBy(key)))
        return (
            run.join(need, same("_source", "t_source")).filter(F.col("upto") > F.col("need"))
            .groupBy("t_source").agg(F.min(F.struct(key, F.col("upto"), F.col("words"), F.col("need"))).alias("x"))
            .select("t_source", F.col(f"x.{key}").alias(key), (F.col("x.need") - (F.col("x.upto") - F.col("x.words"))).alias("need"))
        )

    one = ranked.withColumns({"b1": first, "b2": second})
    at = cut(crossing(one.groupBy("_source", "b1").agg(F.sum("_size").alias("words")), need, "b1"))
    inside = one.join(at.withColumnsRenamed({"t_source": "a_source", "b1": "a1"}).drop("need"), same("_source", "a_source") & (F.col("b1") == F.col("a1")))
    at2 = cut(crossing(inside.groupBy("_source", "b2").agg(F.sum("_size").alias("words")), at.drop("b1"), "b2"))
    piece = (
        inside.join(at2.withColumnsRenamed({"t_source": "c_source", "b2": "a2"}), same("_source", "c_source") & (F.col("b2") == F.col("a2")))
        .groupBy("_source", "_rank", "need").agg(F.sum("_size").alias("words"))
        .withColumn("upto", F.sum("words").over(up.orderBy("_rank")))
    )
    # within the last piece a rank is taken if that brings the words nearer to the target
    last = piece.groupBy("_source").agg(
        F.min("_rank").alias("low"), F.max(F.when(F.col("upto") * 2 - F.col("words") <= F.col("need") * 2, F.col("_rank"))).alias("top"))
    # nothing of the piece taken: stop just below it; a target that is never reached takes every competitor
    limit = F.when(F.col("l_source_hit").isNull(), F.lit(1.5)).when(F.col("top").isNull(), -F.col("low")).otherwise(F.col("top"))
    last = last.withColumnRenamed("_source", "l_source").withColumn("l_source_hit", F.lit(True))
    return plan.join(last, same("t_source", "l_source"), "left").select("t_source", "source_size", "target", "rate", limit.alias("limit"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=(3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 20) -> DataFrame:
    """Every row of ``docs`` with ``size, source_size, target, taken, copies`` (existing columns of these names give way).

    Sources are sorted by code point, null last as a source of its own; ``weights`` repeat over them. The budget is
    ``share`` times all words. A null text has no words; documents without words cost nothing and take part like
    others. Rows that agree in id and text have the same random number and are taken together, so repeated rows stay
    equal; other ties cannot occur but by a 52-bit collision and are treated alike. Null ids count as an empty id. An
    empty table, or one without any word, takes nothing.
    """
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "copies")]
    rows = _measured(docs, id_col, text_col, source_col, seed)
    plan = cut(_source_plan(cut(rows.select("_source", "_size", "_draw", "_measure")), weights, share, most))
    ranked = _with_rank(rows.join(plan, F.col("_source").eqNullSafe(F.col("t_source"))), most)
    low = (F.col("limit") < 0) & (F.col("_rank") < -F.col("limit"))
    extra = F.when(F.col("_rank") >= 2, 0).when(low | ((F.col("limit") >= 0) & (F.col("_rank") <= F.col("limit"))), 1).otherwise(0)
    return ranked.withColumn("_copies", (F.col("_whole") + extra).cast("long")).select(
        *keep, F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_copies")).alias("taken"),
        F.col("_copies").alias("copies"))


def expand_copies(mixed: DataFrame) -> DataFrame:
    """Each row as often as ``copies`` says; rows with none go."""
    keep = [c for c in mixed.columns if c not in ("size", "source_size", "target", "taken", "copies")]
    return mixed.filter(F.col("copies") > 0).select(*keep, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select(*keep)


def mix_sql(table: str = "documents", weights=(3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 20) -> str:
    """The same mix as SQL, with plain windows over whole sources."""
    return f"""
WITH m AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT AS draw
  FROM {table}),
d AS (SELECT *, greatest(floor(sqrt(size::DOUBLE) * 16), 1)::BIGINT AS measure FROM m),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place, (sum(source_size) OVER ())::BIGINT * {float(share)}::DOUBLE AS budget FROM s0),
s2 AS (SELECT *, ({list(weights)})[(place % {len(weights)})::INT + 1]::BIGINT AS weight, source_size * {most} AS cap FROM s1),
s3 AS (SELECT *, cap::DOUBLE / weight AS ratio FROM s2),
s4 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below,
         (sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weight_on FROM s3),
s5 AS (SELECT *, (budget - below) / weight_on AS level FROM s4),
s6 AS (SELECT level FROM s5 WHERE weight * level <= cap ORDER BY ratio, place LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, weight * (SELECT level FROM s6)), cap::DOUBLE) AS target FROM s3),
b AS (SELECT source, measure, sum(size)::BIGINT AS words FROM d GROUP BY source, measure),
r0 AS (SELECT b.*, target,
         coalesce(sum(words) OVER (PARTITION BY b.source ORDER BY measure DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * {most} AS capped,
         (sum(words * measure) OVER (PARTITION BY b.source ORDER BY measure ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS open
       FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
r AS (SELECT source, arg_max((target - capped) / open, measure) AS rate FROM r0
      WHERE open > 0 AND (target - capped) / open * measure <= {most} GROUP BY source),
e AS (SELECT d.*, t.source_size, t.target,
        CASE WHEN t.source_size = 0 THEN 0.0 ELSE coalesce(least(r.rate * measure, {float(most)}), {float(most)}) END AS expect
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN r ON d.source IS NOT DISTINCT FROM r.source),
p AS (SELECT *, floor(expect) AS whole, expect - floor(expect) AS part, (draw::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM e),
o AS (SELECT *, CASE WHEN part > 0 THEN u * (1 - part) / ((1 - u) * part) END AS odds FROM p),
k AS (SELECT *, odds / (1 + odds) AS rank, target - sum(size * whole) OVER (PARTITION BY source) AS need FROM o),
g AS (SELECT source, rank, any_value(need) AS need, sum(size)::BIGINT AS words FROM k WHERE rank IS NOT NULL GROUP BY source, rank),
h AS (SELECT *, (sum(words) OVER (PARTITION BY source ORDER BY rank))::BIGINT AS upto FROM g)
SELECT k.doc_id, k.size, k.source_size, k.target,
       (k.size * (k.whole + CASE WHEN h.upto * 2 - h.words <= h.need * 2 THEN 1 ELSE 0 END))::BIGINT AS taken,
       (k.whole + CASE WHEN h.upto * 2 - h.words <= h.need * 2 THEN 1 ELSE 0 END)::BIGINT AS copies
FROM k LEFT JOIN h ON k.source IS NOT DISTINCT FROM h.source AND k.rank = h.rank"""
