"""Mixing sources to target weights by entropy balancing.

The rates r of documents that stay nearest to 1 in entropy while each source's words
add up to its target are r = exp(lambda * size / mean size), cut at `most`. lambda
solves a convex dual with one unknown a source, by Newton steps kept inside a bracket.
Each step is one aggregation over a histogram (source, size, documents) that is built
once; documents are read once for it and once for the result. Rates are then rounded to
whole copies, from large documents to small ones with the error carried on, in blocks of
bounded length, so a source with a third of all rows is worked on in many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saccadia.llm.common import checkpointed, fresh, n_words, written

#: Documents in a rounding block, on average; a block is one short array.
BLOCK = 128
STEPS = 40


def source_targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """source, source_size, n_docs, target for (source, size) rows.

    Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all
    words; a target stops at `most` times its source's words and the excess goes to the
    others by weight. One row a source goes through a single task, no document rows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", ((rank - 1) % 3 + 1).cast("double")).withColumn("cap", most * F.col("source_size"))
    # water level: sources fill up in the order of cap / weight
    whole = Window.partitionBy()
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "all": F.sum("source_size").over(whole).cast("double"),
        "weights": F.sum("weight").over(whole),
        "full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "full_weight": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    level = (F.col("all") - F.col("full")) / (F.col("weights") - F.col("full_weight"))
    # every guess at which sources are full is at or below the true level, so the largest is it
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    target = F.least(F.col("cap"), F.col("weight") * F.col("level"))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def balance(hist: DataFrame, targets: DataFrame, most: float = 3.0, tolerance: float = 1e-4) -> DataFrame:
    """targets with `lam` and `mean`: r = least(most, exp(lam * size / mean)) meets the target.

    hist: source, size, n. Newton steps on every source at once, each one aggregation;
    a step that leaves the bracket is replaced by its middle. Steps end at `tolerance` of
    the target, well under what whole copies can meet.
    """
    mean = F.col("source_size") / F.greatest(F.col("n_docs"), F.lit(1))
    state = checkpointed(
        targets.coalesce(1).withColumns({
            "mean": F.greatest(mean, F.lit(1.0)), "lam": F.log(F.col("target") / F.col("source_size")) / 2, "lo": F.lit(-1e4), "hi": F.lit(1e4),
            "done": F.col("source_size") == 0,
        })
    )
    log_most = F.log(F.lit(float(most)))
    for _ in range(STEPS):
        s = state.select(F.col("source").alias("s"), "mean", "lam").filter(~F.col("done"))
        x = F.col("size") / F.col("mean")
        power = F.col("lam") * x
        free = power < log_most
        rate = F.when(free, F.exp(power)).otherwise(float(most))
        sums = (
            hist.filter("size > 0").join(s, F.col("source").eqNullSafe(F.col("s")))
            .groupBy("s").agg(
                # decimals add up alike in any order, so reruns take the same steps
                F.sum((F.col("n") * F.col("size") * rate).cast("decimal(38,9)")).cast("double").alias("took"),
                F.sum(F.when(free, F.col("n") * F.col("size") * x * rate).otherwise(0.0).cast("decimal(38,9)")).cast("double").alias("slope"),
            )
        )
        state = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        over = F.col("took") - F.col("target")
        state = state.withColumns({
            "done": F.col("done") | F.coalesce(F.abs(over) <= tolerance * F.greatest(F.col("target"), F.lit(1.0)), F.lit(True)),
            "lo": F.when(over < 0, F.col("lam")).otherwise(F.col("lo")),
            "hi": F.when(over >= 0, F.col("lam")).otherwise(F.col("hi")),
        })
        step = F.col("lam") - over / F.col("slope")
        inside = (F.col("slope") > 0) & (step > F.col("lo")) & (step < F.col("hi"))
        # the middle in steps of magnitude: the bracket is wide and the answer mostly small
        middle = F.when(F.col("lo") >= 0, F.sqrt(F.greatest("lo", F.lit(1e-6)) * F.col("hi"))).when(F.col("hi") <= 0, -F.sqrt(F.greatest(-F.col("hi"), F.lit(1e-6)) * -F.col("lo"))).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = checkpointed(state.withColumn("lam", F.when(F.col("done"), F.col("lam")).when(inside, step).otherwise(middle)).drop("took", "slope"))
        if state.filter(~F.col("done")).isEmpty():
            break
    else:
        raise RuntimeError(f"sources that miss their target after {STEPS} steps: {state.filter(~F.col('done')).count()}")
    return state.drop("lo", "hi", "done")


def mix_sources(docs: DataFrame, most: int = 3) -> DataFrame:
    """All columns of documents with size, source_size, target, rate and copies.

    size: words of the text (null or blank: 0, never more than one copy). copies is 0 to
    `most`; copies * size adds up to near the target of each source. The choice hangs on
    doc_id and text alone, so reruns agree; repeated rows count as documents of their own
    and get the same copies as one another only by chance of rank. A null source is a
    source, last in order. No rows give no rows. Clashing columns are replaced.
    """
    plain = docs.drop("size", "source_size", "target", "rate", "copies")
    sized = plain.withColumn("size", n_words(F.col("text")))
    hist = written(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    targets = source_targets(hist.select("source", (F.col("size") * F.col("n")).alias("size"), "n"), most)
    state = balance(hist, targets, most)

    # where each (source, size) begins in its source's order from large to small
    ahead = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    starts = hist.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    frame = (
        starts.join(state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select("s", F.col("size").alias("z"), "n", "ahead", "source_size", "target", F.least(F.lit(float(most)), F.exp(F.col("lam") * F.col("size") / F.col("mean"))).alias("rate"))
    )
    # documents of one size fall on its stretch of ranks by a hash, each block in BLOCK ranks
    # repeated rows are one row until here, and each has a spot of its own
    spot = F.pmod(F.xxhash64("doc_id", "th", "nth"), F.lit(1 << 30)) / float(1 << 30)
    same = sized.groupBy("doc_id", "source", "size", F.xxhash64("text").alias("th")).agg(F.count("*").alias("m"))
    keyed = same.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "m"))).select("doc_id", "source", "size", "th", spot.alias("spot"))
    placed = keyed.join(frame, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).select(
        "doc_id", "th", "source", "size", "rate", "source_size", "target", ((F.col("ahead") + F.col("spot") * F.col("n")) / BLOCK).cast("long").alias("block")
    )
    one = F.struct(F.negative("size").alias("down"), "th", "doc_id", "size", "rate", "source_size", "target")
    blocks = placed.groupBy("source", "block").agg(F.array_sort(F.collect_list(one)).alias("docs"))

    def take(acc, d):
        # whole copies nearest to what is due so far, carried from larger documents on
        due = acc["due"] + d["rate"] * d["size"]
        n = F.when(d["size"] == 0, F.lit(1)).otherwise(F.least(F.lit(most), F.greatest(F.lit(0), F.round(due / d["size"]).cast("int"))))
        return F.struct((due - n * d["size"]).alias("due"), F.concat(acc["out"], F.array(n)).alias("out"))

    zero = F.struct(F.lit(0.0).alias("due"), F.array().cast("array<int>").alias("out"))
    counts = F.aggregate("docs", zero, take, lambda acc: acc["out"])
    row = F.explode(F.arrays_zip(F.col("docs"), F.col("copies").alias("copies")))
    chosen = blocks.withColumn("copies", counts).select("source", row.alias("r")).select(
        F.col("r.docs.doc_id").alias("doc_id"), F.col("r.docs.th").alias("th"), "source", F.col("r.docs.size").alias("size"), F.col("r.docs.source_size").alias("source_size"), F.col("r.docs.target").alias("target"), F.col("r.docs.rate").alias("rate"), F.col("r.copies").alias("copies")
    )
    return chosen


def mixed(docs: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (copies * size) for each row."""
    return mix_sources(docs, most).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_documents(docs: DataFrame, most: int = 3) -> DataFrame:
    """documents with each row as often as the mix takes it (0 to `most` times), columns as they are.

    Rows that repeat doc_id, text and source share the copies of all of them: each takes the whole
    part of their mean, and one more by a chance, drawn from all columns, that makes up the
    rest. Reruns agree. Null texts count
    as one copy; a null source is a source; no rows give no rows.
    """
    kid, kth, ks, n, th = fresh(docs, "mix_id", "mix_th", "mix_source", "mix_copies", "mix_hash")
    chosen = mix_sources(docs, most).groupBy(F.col("doc_id").alias(kid), F.col("th").alias(kth), F.col("source").alias(ks)).agg(F.avg("copies").alias(n))
    marked = docs.withColumn(th, F.xxhash64("text"))
    joined = marked.join(chosen, marked["doc_id"].eqNullSafe(chosen[kid]) & (marked[th] == chosen[kth]) & marked["source"].eqNullSafe(chosen[ks]))
    chance = F.pmod(F.xxhash64(*docs.columns, F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor(n) + F.when(chance < F.col(n) - F.floor(n), 1).otherwise(0)
    return joined.withColumn(n, F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(docs.columns)
