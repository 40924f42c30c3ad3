"""Mixing sources to target weights: entropy balancing of document rates.

Every document gets a rate (its expected number of copies). Among all rates
below the cap whose words add up to each source's target, those nearest to one
common rate are taken (smallest relative entropy). They have the form
``min(cap, base * exp(lambda_s * size / scale_s))``: each source has one dual
variable, found by Newton steps on the convex dual, each step an aggregation
over the table of (source, size, number of documents). Steps that leave the
bracket of a source's root are replaced by halving it.

Rates become copies size by size, largest first: what a size has taken too much
or too little is carried into the next one, so a source ends within about one of
its smallest documents of its target. Which documents of a size get a copy more
is decided by a keyed hash of their ids; only the one hash bucket in which that
number is reached is ranked.

All sums that decide something are integers or decimals, so they do not depend
on the order of rows and reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.numbering import numbered
from tidemark.llm.shared import column, materialize, ready_workers

CAP = 2                    # copies of a document at most
BUCKET_DOCS = 1024         # documents of a hash bucket, on average
MOST_BUCKETS = 65_536      # hash buckets of one size of a source at most
_STEPS = 80                # Newton steps at most
_STEPS_AT_ONCE = 4         # steps of one job; its result is written
_CLOSE = 0.5               # words off the target that end the steps, or this share of it where that is more
_CLOSE_SHARE = 1e-10
_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: int) -> DataFrame:
    """(source_no, source, source_size, target) from (source, source_size).

    Sources in code point order, null last, weigh ``weights`` in turn and share
    ``share`` times all sizes; a target stops at ``cap`` times its source's size and
    what is over is shared by the others by weight, until none is above.
    """
    rows, _ = numbered(sizes.orderBy(F.col("source").asc_nulls_last()), "mixing-sources")
    turn = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("row_number") % len(weights) + 1).cast("int"))
    state = rows.select(F.col("row_number").alias("source_no"), "source", "source_size", turn.cast("long").alias("weight"),
                        F.lit(False).alias("full"))
    total = state.agg(F.sum("source_size")).first()[0] or 0
    while True:
        seen = state.agg(F.sum(F.when(F.col("full"), F.col("source_size"))).alias("full"),
                         F.sum(F.when(~F.col("full"), F.col("weight"))).alias("weight"),
                         F.sum(F.when(~F.col("full"), 1)).alias("open")).first()
        rest = share * total - cap * (seen.full or 0)
        target = F.when(F.col("full"), (cap * F.col("source_size")).cast("double")) \
            .otherwise(F.lit(float(rest)) * F.col("weight") / F.lit(float(seen.weight or 1)))
        shared = state.withColumn("target", target)
        if not seen.open or not shared.where(~F.col("full") & (F.col("target") > cap * F.col("source_size"))).count():
            return materialize(shared.select("source_no", "source", "source_size", "target"), "mixing-targets")
        state = materialize(shared.withColumn("full", F.col("full") | (F.col("target") > cap * F.col("source_size"))).drop("target"),
                            "mixing-state")


def _exact(x: Column) -> Column:
    return F.sum(x.cast("decimal(28,6)")).cast("double")


def balanced(classes: DataFrame, goals: DataFrame, base: float, cap: int) -> DataFrame:
    """(source_no, size, n, rate): the rates of least relative entropy to ``base``.

    ``classes`` is (source_no, size, n), ``goals`` (source_no, source_size, target).
    A source at its cap has the rate ``cap`` throughout.
    """
    words = F.col("n") * F.col("size")
    scales = classes.groupBy("source_no").agg((_exact(words.cast("double") * F.col("size")) / _exact(words.cast("double"))).alias("scale"))
    open_goals = goals.where((F.col("target") > 0) & (F.col("target") < cap * F.col("source_size")))
    state = materialize(open_goals.join(scales, "source_no").select(
        "source_no", "target", "scale", F.lit(0.0).alias("dual"), F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("high"), F.lit(False).alias("done")), "mixing-dual")
    x = F.col("size") / F.col("scale")
    free = F.lit(float(base)) * F.exp(F.col("dual") * x)

    def step(state: DataFrame) -> DataFrame:
        sums = state.join(classes, "source_no", "left").groupBy(*state.columns).agg(
            _exact(words * F.least(free, F.lit(float(cap)))).alias("taken"),
            _exact(F.when(free < cap, words * x * free).otherwise(0.0)).alias("slope"))
        over = F.col("taken") - F.col("target")
        low = F.when(over < 0, F.col("dual")).otherwise(F.col("low"))
        high = F.when(over > 0, F.col("dual")).otherwise(F.col("high"))
        newton = F.when(F.col("slope") > 0, F.col("dual") - over / F.col("slope"))
        # outside the bracket: its middle, or a step of at most 4 where one side is not known yet
        wide = F.when(over < 0, F.least(newton, F.col("dual") + 4)).otherwise(F.greatest(newton, F.col("dual") - 4))
        middle = (F.col("low") + F.col("high")) / 2
        moved = F.when(F.col("low").isNotNull() & F.col("high").isNotNull(),
                       F.when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(middle)) \
            .otherwise(F.coalesce(wide, F.col("dual") + F.when(over < 0, 4.0).otherwise(-4.0)))
        close = F.abs(over) <= F.greatest(F.lit(_CLOSE), F.col("target") * _CLOSE_SHARE)
        ended = sums.withColumn("ends", F.col("done") | close | F.col("taken").isNull())
        kept = lambda now, was: F.when(F.col("ends"), F.col(was)).otherwise(now)
        bracketed = ended.withColumn("low", kept(low, "low")).withColumn("high", kept(high, "high"))
        return bracketed.select("source_no", "target", "scale", kept(moved, "dual").alias("dual"), "low", "high",
                                F.col("ends").alias("done"))

    for _ in range(_STEPS // _STEPS_AT_ONCE):
        if not state.where(~F.col("done")).limit(1).count():
            break
        for _ in range(_STEPS_AT_ONCE):
            state = step(state)
        state = materialize(state, "mixing-dual")
    full = goals.select("source_no", F.when(F.col("target") > 0, float(cap)).otherwise(0.0).alias("flat"))
    rated = classes.join(full, "source_no").join(state.select("source_no", "scale", "dual"), "source_no", "left")
    return rated.select("source_no", "size", "n", F.when(F.col("dual").isNull(), F.col("flat"))
                        .otherwise(F.least(free, F.lit(float(cap)))).alias("rate"))


def _rounded(sizes: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for the sizes of one source, largest first, with the words
    taken too much or too little so far carried on."""
    sizes = sizes.sort_values("size", ascending=False)
    owed, copies = 0.0, []
    for size, n, wanted, cap in zip(sizes["size"].tolist(), sizes["n"].tolist(), sizes["wanted"].tolist(), sizes["cap"].tolist()):
        number = min(max(round(wanted + owed / size), 0), cap * n) if size else min(round(wanted), cap * n)
        owed += (wanted - number) * size
        copies.append(number)
    out = sizes[["source_no", "size", "n"]].copy()
    out["copies"] = copies
    return out


def mix_documents(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: int = CAP, key: int = 1,
                  id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """How often the mix takes each document: ``doc_id``, ``size`` (words),
    ``source_size`` and ``target`` (words of its source), ``copies`` and ``taken`` (their words).

    Null and empty texts have size 0; they are copied at the common rate and take
    nothing. A null source is a source of its own, the last one. Repeated rows are
    documents each; among rows with one id and size, which are alike, any may get
    a copy more. The same rows give the same copies under any layout. A source
    whose documents are few and long can only come as near to its target as whole
    copies allow. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    doc_id = column(docs, id_column).cast("long")
    rows = materialize(docs.select(
        doc_id.alias("doc_id"), column(docs, source_column).alias("source"), n_words(column(docs, text_column)).alias("size"),
        F.xxhash64(doc_id, F.lit(key)).alias("hash")), "mixing-documents")
    by_size = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mixing-sizes")
    goals = targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap)
    named = goals.select("source_no", F.col("source").alias("named"))
    classes = materialize(by_size.join(named, F.col("source").eqNullSafe(F.col("named"))).select("source_no", "size", "n"),
                          "mixing-classes")
    rated = balanced(classes.where(F.col("size") > 0), goals, share, cap).unionByName(
        classes.where(F.col("size") == 0).withColumn("rate", F.lit(float(min(share, cap)))))
    ready_workers(spark)
    # one row per different size: at most sqrt(2 x words) of a source, and no more than words of its longest document
    whole = rated.select("source_no", "size", "n", (F.col("n") * F.col("rate")).alias("wanted"), F.lit(cap).cast("long").alias("cap")) \
        .groupBy("source_no").applyInPandas(_rounded, "source_no long, size long, n long, copies long")
    buckets = F.least(F.expr(f"n div {BUCKET_DOCS} + 1"), F.lit(MOST_BUCKETS).cast("long"))
    plan = materialize(whole.join(goals, "source_no").select(
        "source", "size", "source_size", "target", F.expr("copies div n").alias("least"), F.expr("copies % n").alias("more"),
        buckets.alias("buckets")), "mixing-plan")

    held = rows.join(plan.withColumnsRenamed({"source": "of", "size": "sized"}),
                     rows["source"].eqNullSafe(F.col("of")) & (rows["size"] == F.col("sized"))).drop("of", "sized") \
        .withColumn("bucket", F.pmod("hash", "buckets"))
    # buckets in order; the one in which ``more`` is reached is ranked, those before it get a copy more
    counts = held.where("more > 0").groupBy("source", "size", "more", "bucket").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = materialize(counts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
                        .where("before < more and before + n >= more")
                        .select(F.col("source").alias("of"), F.col("size").alias("sized"), F.col("bucket").alias("edge"),
                                (F.col("more") - F.col("before")).alias("needed")), "mixing-edges")
    placed = held.join(edges, held["source"].eqNullSafe(edges["of"]) & (held["size"] == edges["sized"]), "left")
    at_edge = F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("source", "size").orderBy("hash", F.col("doc_id").asc_nulls_last()))
    sure = placed.where(~at_edge).withColumn("extra", F.coalesce((F.col("bucket") < F.col("edge")).cast("long"), F.lit(0).cast("long")))
    ranked = placed.where(at_edge).withColumn("extra", (rank <= F.col("needed")).cast("long"))
    copies = F.col("least") + F.col("extra")
    return sure.unionByName(ranked).select("doc_id", "size", "source_size", "target", copies.alias("copies"),
                                           (copies * F.col("size")).alias("taken"))
