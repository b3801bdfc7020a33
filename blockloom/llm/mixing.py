"""Mixing sources to target weights by entropy balancing.

Targets are word totals per source.  Among all document weights w_d with

    sum over a source of w_d * size_d = its target,   0 <= w_d <= cap,

those closest in relative entropy to one for each document are exponentially
tilted: w_d = min(cap, exp(lambda_source * size_d)).  The multipliers solve the
convex dual; each Newton step aggregates gradient and Hessian over the
documents of every source.  Documents of one source and size have one weight, so
they are counted once, exactly, and the steps run over those counts.

The weights are document rates.  They become whole copies by systematic rounding
along each source's documents in order of size; what is then still missing or
too much, about one document's words, is made up by one copy more or less of a
few documents of each source.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.common import WORD, Scratch, quoted

UNIT = 1 << 30  # fractions of a rate are whole numbers of this part, so that their sums do not depend on order
RUN_ROWS = 256  # documents of a source and size class in one run, about
MOST_RUN = 65_536  # rows from which a run is dealt anew by row, as only rows of one id and size can fill it


def word_count(text_col: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(quoted(text_col)), F.lit("")), F.lit(WORD)).cast("long")


def numbered_sources(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Add ``sid``, the place of each source by code point from 0, null last.  Ranges of sources are numbered apart."""
    ranged = scratch.save(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranged")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ranged.withColumn("place", place).join(starts, "part").withColumn("sid", F.col("start") + F.col("place") - 1).drop("part", "start", "place")


def capped_targets(sources: DataFrame, cap: float, scratch: Scratch, rounds: int = 200) -> DataFrame:
    """Add ``target`` to (source, source_size, weight).

    Shares are by weight of what is left; a source whose share exceeds ``cap``
    times its size gets exactly that, and the excess is shared out again.
    """
    now = scratch.save(sources.withColumn("full", F.col("source_size") == 0), "targets-0")
    for k in range(1, rounds + 1):
        free, total, used, capped = now.agg(
            F.sum(F.when(~F.col("full"), F.col("weight"))),
            F.sum("source_size"),
            F.sum(F.when(F.col("full"), cap * F.col("source_size"))),
            F.count_if("full"),
        ).first()
        level = ((total or 0) - (used or 0.0)) / free if free else 0.0
        after = now.withColumn("full", F.col("full") | (F.lit(level) * F.col("weight") > cap * F.col("source_size")))
        if after.agg(F.count_if("full")).first()[0] == capped:
            break
        now = scratch.save(after, f"targets-{k}")
    else:
        raise RuntimeError("targets did not settle")
    return now.withColumn(
        "target",
        F.when(F.col("full"), cap * F.col("source_size")).otherwise(F.lit(level) * F.col("weight")).cast("double"),
    )


def tilted(lam: Column, size: Column, cap: float) -> Column:
    """The rate of a document; without a multiplier its source takes the cap."""
    return F.when(lam.isNull(), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(lam * size, F.lit(700.0)))))


def newton_multipliers(sources: DataFrame, counts: DataFrame, cap: float, scratch: Scratch, rounds: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """Add ``lam``, the dual multiplier, to (sid, source_size, target, full); null where every document takes the cap.

    ``counts`` is (sid, size, n), the documents of each source and size.  The
    gradient of the dual is the words taken less the target, its Hessian the
    sum of size squared times rate over the documents below the cap.  Newton
    steps are taken on the logarithm of the words taken, within a bracket that
    every step narrows.  Sums are of whole numbers, so reruns agree to the bit.
    """
    some = (F.col("source_size") > 0) & ~F.col("full")
    now = scratch.save(
        sources.filter(some).select("sid", "target", F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high")), "newton-0"
    )
    size, n = F.col("size").cast("double"), F.col("n")
    whole = lambda x: F.sum(F.round(x * n * (1 << 20)).cast("decimal(38,0)")).cast("double") / (1 << 20)
    for k in range(1, rounds + 1):
        rate = tilted(F.col("lam"), size, cap)
        state = now.join(counts, "sid").groupBy("sid", "target", "lam", "low", "high").agg(
            whole(size * rate).alias("taken"), whole(F.when(rate < cap, size * size * rate).otherwise(0.0)).alias("slope"), F.max(size).alias("largest")
        )
        off = F.abs(F.col("taken") - F.col("target")) / F.col("target")
        below = F.col("taken") < F.col("target")
        state = state.withColumns({"low": F.when(below, F.col("lam")).otherwise(F.col("low")), "high": F.when(below, F.col("high")).otherwise(F.col("lam"))})
        step = F.col("lam") - F.log(F.greatest(F.col("taken"), F.lit(1e-300)) / F.col("target")) * F.greatest(F.col("taken"), F.lit(1e-300)) / F.col("slope")
        inside = (F.col("low").isNull() | (step > F.col("low"))) & (F.col("high").isNull() | (step < F.col("high")))
        # without a bound on one side the multiplier doubles, or leaves 0 by one part of the largest size
        away = F.when(F.col("high").isNull(), F.greatest(2 * F.col("lam"), 1 / F.col("largest"))).when(F.col("low").isNull(), F.least(2 * F.col("lam"), -1 / F.col("largest")))
        new = F.when(off <= tolerance, F.col("lam")).when((F.col("slope") > 0) & inside, step).otherwise(F.coalesce(away, (F.col("low") + F.col("high")) / 2))
        settled = (off <= tolerance) | F.coalesce(F.col("high") - F.col("low") <= 1e-15 * F.abs(F.col("high")), F.lit(False))
        now = scratch.save(state.select("sid", "target", new.alias("lam"), "low", "high", settled.alias("settled")), f"newton-{k}")
        scratch.drop(f"newton-{k - 1}")
        if now.filter(~F.col("settled")).isEmpty():
            break
    else:
        raise RuntimeError("multipliers did not settle")
    return sources.join(now.select("sid", "lam"), "sid", "left")


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    cap: float = 3.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    also: str | None = None,
) -> DataFrame:
    """One row per document: id, size, source_size, target, rate, copies, taken.

    ``weights`` go round over the sources in code point order, null last.
    ``copies`` is how often the mix repeats the document and ``taken`` is
    copies * size; copies never exceed ``cap``.  A document without words, its
    text null among them, takes no part (rate, copies and taken 0); repeated rows
    are documents of their own; further columns of any name are ignored, but for
    the one that ``also`` names, which is handed on; an empty table gives an
    empty result.  Reruns agree: no step draws at random.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    extra = F.col(quoted(also)) if also else F.lit(None).cast("int")
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(source_col)).alias("source"), word_count(text_col).alias("size"), extra.alias("extra"))
    rows = scratch.save(rows.withColumn("rid", F.monotonically_increasing_id()), "sizes")
    sources = scratch.save(numbered_sources(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), scratch), "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    targets = scratch.save(capped_targets(sources.withColumn("weight", weight), cap, scratch), "targets")
    s = targets.select("sid", "source").alias("s")
    rows = rows.alias("r").join(s, F.col("r.source").eqNullSafe(F.col("s.source"))).select("sid", "id", "size", "extra", "rid")
    counts = scratch.save(rows.filter("size > 0").groupBy("sid", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    lams = scratch.save(newton_multipliers(targets, counts, cap, scratch).select("sid", "source_size", "target", "n", "lam"), "multipliers")

    # Runs of documents of about one size: (source, size class, salt), with no more than a bounded number of rows, however
    # many documents share a source and a size.
    rated = rows.filter("size > 0").join(lams.withColumnRenamed("n", "docs"), "sid").withColumn("rate", tilted(F.col("lam"), F.col("size").cast("double"), cap))
    fraction = F.round((F.col("rate") - F.floor("rate")) * UNIT).cast("long")
    rated = rated.withColumns(
        {
            "units": fraction,
            "cls": F.floor(F.log2(F.col("size").cast("double")) * 4).cast("int"),
            "salt": F.pmod(F.xxhash64("id", "size"), F.ceil(F.col("docs") / RUN_ROWS)).cast("int"),
        }
    )
    key = ["sid", "cls", "salt"]
    full = rated.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_RUN)
    full = scratch.save(full.select(*key, F.ceil(F.col("n") / RUN_ROWS).alias("more")), "full-runs")
    if not full.isEmpty():
        rated = rated.join(full, key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("rid"), F.col("more")), F.lit(0))).drop("more")
    else:
        rated = rated.withColumn("part", F.lit(0).cast("long"))
    key = [*key, "part"]
    per_run = scratch.save(rated.groupBy(*key).agg(F.sum("units").alias("units")), "runs")
    per_class = per_run.groupBy("sid", "cls").agg(F.sum("units").alias("units"))
    earlier = lambda w: F.coalesce(F.sum("units").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_class = per_class.select("sid", "cls", earlier(Window.partitionBy("sid").orderBy("cls")).alias("classes"))
    per_run = per_run.select(*key, earlier(Window.partitionBy("sid", "cls").orderBy("salt", "part")).alias("runs"))
    before = per_run.join(per_class, ["sid", "cls"]).select(*key, (F.col("classes") + F.col("runs")).alias("before"))
    here = F.sum("units").over(Window.partitionBy(*key).orderBy("size", "id", "rid").rowsBetween(Window.unboundedPreceding, 0))
    placed = rated.withColumn("here", here).join(before, key)
    upto = F.col("before") + F.col("here")
    copies = F.floor("rate") + F.floor(upto / UNIT) - F.floor((upto - F.col("units")) / UNIT)
    some = scratch.save(placed.select("rid", "id", "extra", "sid", "cls", "size", "source_size", "target", "rate", copies.cast("long").alias("copies")), "rounded")
    flips = corrections(some, cap)
    some = some.join(flips, "rid", "left").withColumn("copies", F.col("copies") + F.coalesce("delta", F.lit(0)))
    none = rows.filter("size = 0").join(lams, "sid").withColumns({"rate": F.lit(0.0), "copies": F.lit(0).cast("long")})
    out = ["id", "size", "source_size", "target", "rate", "copies", "extra"]
    found = some.select(*out).unionByName(none.select(*out)).withColumn("taken", F.col("copies") * F.col("size")).withColumnRenamed("id", id_col)
    return found.withColumnRenamed("extra", also) if also else found.drop("extra")


def corrections(rounded: DataFrame, cap: float) -> DataFrame:
    """(rid, delta): single copies more or less that bring each source's taken words next to its target.

    Candidates are one document to add and one to take away for each source and
    size class, so a source has at most a few hundred of them.
    """
    more = F.when(F.col("copies") + 1 <= cap, F.struct("id", "size", "rid"))
    less = F.when(F.col("copies") >= 1, F.struct("id", "size", "rid"))
    by_class = rounded.groupBy("sid", "cls").agg(
        F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.min(more).alias("more"), F.max(less).alias("less")
    )

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        missing = float(pdf["target"].iloc[0] - pdf["taken"].sum())
        found = [(c["size"], c["rid"], 1) for c in pdf["more"] if c is not None]
        found += [(c["size"], c["rid"], -1) for c in pdf["less"] if c is not None]
        chosen: dict[int, int] = {}
        for size, rid, sign in sorted(found, reverse=True):
            if rid not in chosen and abs(missing - sign * size) < abs(missing):
                chosen[rid] = sign
                missing -= sign * size
        return pd.DataFrame({"rid": list(chosen), "delta": list(chosen.values())}, dtype="int64")

    return by_class.groupBy("sid").applyInPandas(choose, "rid long, delta long")
