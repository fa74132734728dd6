"""Mixing sources to target weights by entropy balancing.

Sources share ``volume`` times all words by their weights; a source is used at most ``most``
times, and what it cannot take is shared among the others. The rates ``r`` of the documents
stay as close as possible to one copy each (least relative entropy) while each source's words
meet its target: ``sum(size * r) = target``. The solution tilts a document exponentially,
``r = exp(dual * size / scale)``, cut at ``most``; the convex dual is solved by Newton steps, several values a pass: one
aggregation over the documents (grouped by source and size first, so that equal documents travel as one count) evaluates a Newton step
and a grid over the bracket of the root, for all sources at once. A loop that does not converge is an error.

Rates become whole copies by carrying the remainder on: documents of a source are dealt into
buckets of bounded size by a hash, and in each, from long to short, as many further copies are added as the words owed are worth, to
the nearest copy. Since the shortest documents come last, what is still owed at the end of a bucket is at most half of its
shortest document. Rows that agree in id, source and size are one entry with a count: of ``n`` such rows any number may take one
copy more than the others.

Defined cases: a null text has size 0 and takes 0 words; a null source is a source of its own
and sorts last; of rows that agree in id, source and size some may take one copy more (those first in text order, repeated rows in the order of the
table); other columns are kept out of the decision; an empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from docfacts.llm.common import WORD, written

WEIGHTS = (5, 2, 1)
VOLUME = 1.5
MOST = 2.0
#: Passes over the documents before the loop gives up, and duals evaluated in each.
PASSES, DUALS = 40, 16
TOLERANCE = 1e-9
#: Rows of one entry that are numbered, or made, in one piece.
PIECE = 100_000
#: Documents rounded in one task.
BUCKET = 4_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, volume: float = VOLUME, most: float = MOST) -> DataFrame:
    """For each source its words and its target. One row a source, so the windows over all of them are small.

    The level ``c`` with ``sum(min(most * size, c * weight)) = volume * words`` is found in
    closed form: sources fill up in order of ``most * size / weight``.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*(F.lit(float(w)) for w in weights))
    listed = by_source.withColumn("weight", F.element_at(turn, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    listed = listed.withColumn("most", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    filled = before.rowsBetween(Window.unboundedPreceding, -1)
    rest = before.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    wanted = F.least(F.sum("source_size").over(everything) * F.lit(float(volume)), F.sum("most").over(everything))
    level = (wanted - F.coalesce(F.sum("most").over(filled), F.lit(0.0))) / F.sum("weight").over(rest)
    with_level = listed.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("most"))
    # The first source that does not fill up sets the level for all after it.
    common = F.min(F.when(F.col("fits"), F.struct(F.col("most") / F.col("weight"), F.col("level")))).over(everything)
    target = F.least(F.col("most"), F.coalesce(common["level"] * F.col("weight"), F.col("most")))
    return with_level.withColumn("target", target).select("source", "source_size", "target")


def balanced(sizes: DataFrame, goal: DataFrame, most: float = MOST) -> DataFrame:
    """The dual of each source: columns ``source, source_size, target, dual, scale``.

    ``sizes`` has one row for each source and size with the count ``n``.
    """
    scale = sizes.groupBy("source").agg(
        (F.sum(F.col("n") * F.col("size")) / F.greatest(F.sum("n"), F.lit(1))).alias("mean"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
    )
    mean = F.greatest(F.col("mean"), F.lit(1.0))
    shortest = F.greatest(F.coalesce("least", F.lit(1)), F.lit(1))
    share = F.try_divide(F.col("target"), F.col("source_size"))
    state = goal.join(scale, goal["source"].eqNullSafe(scale["source"])).select(
        goal["source"],
        "source_size",
        "target",
        mean.alias("scale"),
        # At the lower end every document takes its source's share or less, at the upper end the shortest is at the limit.
        F.when(share < 1, F.log(F.greatest(share, F.lit(1e-300))) * mean / shortest).otherwise(F.lit(0.0)).alias("low"),
        F.when(share < 1, F.lit(0.0)).otherwise(F.log(F.lit(most)) * mean / shortest + F.lit(1e-9)).alias("high"),
        F.lit(0.0).alias("newton"),
    )
    state = written(state, "balance")
    for _ in range(PASSES):
        grid = F.transform(F.sequence(F.lit(0), F.lit(DUALS - 2)), lambda k: F.col("low") + (F.col("high") - F.col("low")) * k / (DUALS - 2))
        tried = state.withColumn("duals", F.concat(F.array("newton"), grid))
        joined = sizes.join(tried, sizes["source"].eqNullSafe(tried["source"])).select(tried["*"], "size", "n")
        words = F.col("n") * F.col("size")
        sums = []
        for k in range(DUALS):
            rate = F.exp(F.col("duals")[k] * F.col("size") / F.col("scale"))
            sums.append(F.sum(words * F.least(rate, F.lit(most))).alias(f"words{k}"))
            sums.append(F.sum(F.when(rate < most, words * rate * F.col("size") / F.col("scale")).otherwise(0.0)).alias(f"slope{k}"))
        totals = joined.groupBy("source", "source_size", "target", "scale", "duals").agg(*sums)
        points = F.array(
            *(F.struct(F.abs(F.col(f"words{k}") - F.col("target")).alias("off"), F.col("duals")[k].alias("dual"), (F.col(f"words{k}") - F.col("target")).alias("error"), F.col(f"slope{k}").alias("slope")) for k in range(DUALS))
        )
        found = totals.select("source", "source_size", "target", "scale", points.alias("points")).withColumn("best", F.array_min("points"))
        low = F.array_max(F.transform(F.filter("points", lambda p: p["error"] <= 0), lambda p: p["dual"]))
        high = F.array_min(F.transform(F.filter("points", lambda p: p["error"] >= 0), lambda p: p["dual"]))
        best = F.col("best.dual")
        found = found.withColumns({"low": F.coalesce(low, best), "high": F.coalesce(high, best)})
        step = best - F.try_divide(F.col("best.error"), F.col("best.slope"))
        inside = (step > F.col("low")) & (step < F.col("high"))
        done = F.col("best.off") <= F.greatest(F.col("target"), F.lit(1.0)) * TOLERANCE
        tight = (F.col("high") - F.col("low")) <= F.greatest(F.abs(F.col("high")), F.lit(1.0)) * 1e-14
        stepped = found.select(
            "source", "source_size", "target", "scale", "low", "high", best.alias("dual"),
            F.when(inside, step).otherwise((F.col("low") + F.col("high")) / 2).alias("newton"), (done | tight).alias("done"),
        )
        state = written(stepped, "balance")
        if state.where("not done").isEmpty():
            return state.select("source", "source_size", "target", "dual", "scale")
        state = state.drop("dual", "done")
    raise RuntimeError(f"the dual did not converge in {PASSES} passes")


def _rounded(most: float):
    def rounded(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable")
        owed, taken, more = 0.0, [], []
        for size, n, rate in zip(rows["size"], rows["n"], rows["rate"]):
            whole = min(int(rate), int(most))
            owed += (rate - whole) * size * n
            further = min(n, max(0, int(owed / size + 0.5))) if size > 0 and whole < most else 0
            owed -= further * size
            taken.append(whole)
            more.append(further)
        return rows.assign(copies=taken, further=more)[["doc_id", "source", "size", "n", "copies", "further"]]

    return rounded


def mix(sizes: DataFrame, weights: tuple = WEIGHTS, volume: float = VOLUME, most: float = MOST) -> DataFrame:
    """Copies of each distinct ``doc_id, source, size``: these, ``source_size, target, n, copies, further``.

    Of the ``n`` rows ``further`` take one copy more than ``copies``.
    """
    rows = written(sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "sizes")
    counted = rows.groupBy("source", "size").agg(F.sum("n").alias("n"))
    goal = targets(counted.select("source", (F.col("size") * F.col("n")).alias("size")), weights, volume, most)
    counted = written(counted, "counted")
    duals = balanced(counted, written(goal, "targets"), most)
    documents = duals.join(rows.groupBy("source").agg(F.count("*").alias("documents")).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    documents = documents.withColumnRenamed("source", "s")
    rated = rows.join(documents, F.col("source").eqNullSafe(F.col("s"))).withColumns(
        {
            "rate": F.least(F.exp(F.col("dual") * F.col("size") / F.col("scale")), F.lit(most)),
            "bucket": F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("documents") / BUCKET)),
        }
    )
    dealt = rated.select("doc_id", "source", "size", "n", "rate", "bucket").groupBy("source", "bucket")
    copies = dealt.applyInPandas(_rounded(most), "doc_id long, source string, size long, n long, copies long, further long")
    goals = duals.select(F.col("source").alias("s"), "source_size", "target")
    return copies.join(goals, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def mixed_words(documents: DataFrame) -> DataFrame:
    """The mix as words taken: one row for each document row."""
    sized = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    plan = mix(written(sized, "sized"))
    # Rows of one entry are made from their count, in pieces.
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {PIECE}")), lambda k: F.struct((k * PIECE).alias("first"), (F.least(F.col("n"), (k + 1) * PIECE) - 1).alias("last")))
    cut = plan.select("doc_id", "size", "source_size", "target", "copies", "further", F.inline(pieces))
    rows = cut.select("doc_id", "size", "source_size", "target", "copies", "further", F.explode(F.sequence("first", "last")).alias("k"))
    taken = F.col("size") * (F.col("copies") + F.when(F.col("k") < F.col("further"), 1).otherwise(0))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The documents themselves, each as often as the mix takes it."""
    sized = documents.withColumns({"__mix_size": word_count(F.col("text")), "__mix_row": F.monotonically_increasing_id()})
    plan = written(mix(sized.select("doc_id", "source", F.col("__mix_size").alias("size"))), "copies")
    same = F.col("doc_id").eqNullSafe(F.col("__mix_d")) & F.col("source").eqNullSafe(F.col("__mix_s")) & (F.col("__mix_size") == F.col("__mix_z"))
    named = plan.select(F.col("doc_id").alias("__mix_d"), F.col("source").alias("__mix_s"), F.col("size").alias("__mix_z"), *(F.col(c).alias(f"__mix_{c}") for c in ("n", "copies", "further")))
    more = _with_further(sized.withColumn("__mix_text", F.xxhash64("text")), named.where("__mix_further > 0 and __mix_further < __mix_n"), same)
    kept = sized.join(named.where("__mix_copies + __mix_further > 0"), same).join(written(more, "further").withColumn("__mix_more", F.lit(1)), "__mix_row", "left")
    copies = F.expr("__mix_copies + if(__mix_further = __mix_n, 1, coalesce(__mix_more, 0))").cast("int")
    return kept.select(*(F.col(f"`{c}`") for c in documents.columns), F.explode(F.array_repeat(F.lit(1), copies))).select(*(F.col(f"`{c}`") for c in documents.columns))


def _with_further(rows: DataFrame, entries: DataFrame, same: Column) -> DataFrame:
    """The numbers of the rows that take one copy more, of entries of which only some do: those first by text digest, then by number.

    A large entry is numbered in pieces (one text digest, and at most ``PIECE`` numbers), from counts before each.
    """
    key = ["__mix_d", "__mix_s", "__mix_z"]
    slim = rows.select("doc_id", "source", "__mix_size", "__mix_row", "__mix_text").join(entries, same).select(*key, "__mix_further", "__mix_row", "__mix_text")
    placed = slim.withColumns({"entry": F.to_json(F.struct(*key)), "piece": F.expr(f"__mix_row div {PIECE}")})
    piece = ["entry", "__mix_text", "piece"]
    before = Window.partitionBy("entry").orderBy("__mix_text", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*piece).agg(F.count(F.lit(1)).alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy(*piece).orderBy("__mix_row")))
    return ranked.join(starts, piece).where("before + rank <= __mix_further").select("__mix_row")
