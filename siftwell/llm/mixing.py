"""Mixing sources to target weights by temperature, with DataFrame functions only.

Every source's share p of all tokens is raised to an exponent between 0 (equal weights) and 1
(natural shares), and normalised. The exponent is found by bisection: the largest one whose
weights still have the wanted entropy, or the smallest one whose weights repeat no source
more often than allowed. A step of the bisection is an aggregate over the table of sources, so that table may
be long; several steps are taken by one job.

Weights times the budget are tokens per source. They are realised pass by pass: a pass is a permutation of the
source's documents (by md5 of seed, pass and id), cut into blocks by the leading digits of that hash. Passes
that fit are taken whole; of the last, blocks are taken up to the one in which the budget ends, and in that block documents
while the sum of tokens stays within the budget. Only block sums are ordered per source, and
only documents of the last block per source and pass, so a source may hold any share of all rows.

A null source is a source of its own. Null or empty texts have no tokens; they are taken with the
passes whose permutation reaches them. Rows with the same id and source stand next to each other in
a permutation and are ordered by their number of tokens; a null id counts as "". Very long texts count whole.
If no source has a token, or the table is empty, the result is empty. Further columns are passed on
by ``mixed`` and disturb nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.llm.common import materialize

LEVELS = 4  # bisection steps that one job takes
JOBS = 10
ROWS_PER_BLOCK = 4096
DIGITS = 9  # weights are rounded so that sums in any order give the same budget


def words_in(text: Column) -> Column:
    """Words of a text, runs of other than \\x20 and \\x09-\\x0D: the tokens that are budgeted by default."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_shares(rows: DataFrame) -> DataFrame:
    """source, rows, tokens, share of all tokens; sources with tokens only."""
    sums = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).where("tokens > 0")
    total = sums.agg(F.sum("tokens").cast("double").alias("total"))
    return sums.join(F.broadcast(total)).withColumn("p", F.col("tokens") / F.col("total")).drop("total")


def exponent(shares: DataFrame, entropy: float | None = None, repetition: float | None = None, budget: str | int = "total") -> float:
    """The exponent that meets the target, by bisection between 0 and 1.

    entropy: the wanted entropy of the weights as a part of that of equal weights; the largest exponent that reaches it.
    repetition: the most often that a source may be passed; the smallest exponent that keeps to it.
    """
    if (entropy is None) == (repetition is None):
        raise ValueError("give either an entropy or a repetition limit")
    low, high = 0.0, 1.0
    for _ in range(JOBS):
        inner = [low + (high - low) * i / (1 << LEVELS) for i in range(1, 1 << LEVELS)]
        points = shares.select("p", "tokens", F.explode(F.array(*(F.lit(a) for a in inner))).alias("a"))
        power = F.exp(F.col("a") * F.log("p"))
        found = points.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.col("a") * F.log("p")).alias("e"), F.max(power / F.col("p")).alias("most"), F.min(power / F.col("p")).alias("least"), F.count("*").alias("n"), F.sum("tokens").alias("total")).collect()
        if not found:
            return 1.0
        for row in sorted(found, key=lambda r: r.a):
            if entropy is not None:  # falls as the exponent grows
                ok = math.log(row.z) - row.e / row.z >= entropy * math.log(row.n)
            else:  # the most passes of a source: weight · budget / tokens, fall as the exponent grows
                size = {"total": 1 / row.z, "whole": 1 / row.least}.get(budget, None)
                passes = row.most * size if size is not None else row.most / row.z * budget / row.total
                ok = passes > repetition
            if ok:
                low = max(low, row.a)
            else:
                high = min(high, row.a)
                break
    return low if entropy is not None else high


def plan(rows: DataFrame, budget: str | int = "total", **target) -> DataFrame:
    """source, tokens, rows, weight, budgeted tokens of each source, and the exponent."""
    shares = materialize(source_shares(rows), "sources")
    a = round(exponent(shares, budget=budget, **target), DIGITS)
    power = F.exp(F.lit(a) * F.log("p"))
    z = shares.agg(F.sum(power).alias("z"), F.max(F.col("p") / power).alias("largest"), F.sum("tokens").alias("total"))
    weight = F.round(power / F.col("z"), DIGITS)
    if budget == "total":
        size = F.col("total").cast("double")
    elif budget == "whole":  # every source is passed once at least
        size = F.col("total") * F.col("largest") * F.col("z")
    else:
        size = F.lit(float(budget))
    tokens = F.floor(F.round(weight * size, 3)).cast("long")
    if budget == "whole":
        tokens = F.greatest(tokens, F.col("tokens"))
    return shares.join(F.broadcast(z)).select("source", "tokens", "rows", weight.alias("weight"), tokens.alias("budget"), F.lit(a).alias("exponent"))


def draw(documents: DataFrame, budget: str | int = "total", source: str = "source", id: str = "doc_id", tokens: Column | None = None, text: str = "text", seed: int = 0, **target) -> DataFrame:
    """What is taken: one row for each id, source and number of tokens, with the ``copies`` that the
    table has, the ``full`` passes of each, how many copies the ``last`` pass takes, weight and exponent.

    budget: tokens of the mix, a number, "total" (as many as there are) or "whole" (so many that each
    source is passed once at least). target: ``entropy`` or ``repetition``, see ``exponent``.
    """
    count = words_in(F.col(text)) if tokens is None else tokens
    key = F.coalesce(F.col(id).cast("string"), F.lit(""))
    rows = documents.select(key.alias("id"), F.col(source).cast("string").alias("source"), count.alias("tokens"))
    rows = materialize(rows, "tokens")
    sources = materialize(plan(rows, budget, **target), "plan")

    full = F.floor(F.col("budget") / F.col("total")).cast("long")
    sources = sources.withColumnRenamed("tokens", "total").withColumn("full", full).withColumn("rest", F.col("budget") - full * F.col("total"))
    # blocks of a permutation: its hash's first digits, more of them for longer sources
    depth = F.greatest(F.lit(0), F.ceil(F.log(F.col("rows") / float(ROWS_PER_BLOCK)) / math.log(16))).cast("int")
    sources = sources.withColumn("depth", depth)
    same = F.col("s.source").eqNullSafe(F.col("r.source"))
    joined = rows.alias("r").join(sources.alias("s"), same).select("r.id", "r.tokens", "s.source", "full", "rest", "depth", "weight", "exponent")
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.col("id")).cast("binary"))
    joined = joined.withColumn("place", place).withColumn("block", F.expr("left(place, depth)"))
    # of equal ids of a source, ordered by tokens, one row stands for all with the same number
    joined = joined.groupBy("source", "id", "tokens", "full", "rest", "depth", "weight", "exponent", "place", "block").agg(F.count("*").alias("copies"))

    blocks = joined.groupBy("source", "block").agg(F.sum(F.col("tokens") * F.col("copies")).alias("sum"))
    before = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    placed = joined.alias("j").join(blocks.alias("b"), F.col("j.source").eqNullSafe(F.col("b.source")) & (F.col("j.block") == F.col("b.block"))).select("j.*", "sum", "before")
    whole = placed.where("before + sum <= rest").withColumn("last", F.col("copies"))
    cut = placed.where("before + sum > rest AND before <= rest")
    order = W.partitionBy("source", "block").orderBy("place", "id", "tokens").rowsBetween(W.unboundedPreceding, -1)
    cut = cut.withColumn("before", F.col("before") + F.coalesce(F.sum(F.col("tokens") * F.col("copies")).over(order), F.lit(0)))
    # of equal rows, as many as fit
    fits = F.when(F.col("tokens") == 0, F.when(F.col("before") <= F.col("rest"), F.col("copies")).otherwise(0)).otherwise(
        F.greatest(F.lit(0), F.least(F.col("copies"), F.floor((F.col("rest") - F.col("before")) / F.col("tokens"))))
    )
    cut = cut.withColumn("last", fits.cast("long"))
    after = placed.where("before > rest").withColumn("last", F.lit(0).cast("long"))
    names = ["source", "id", "tokens", "copies", "full", "last", "weight", "exponent"]
    return whole.select(names).unionByName(cut.select(names)).unionByName(after.select(names))


def realised(documents: DataFrame, id: str = "doc_id", **options) -> DataFrame:
    """One row for each time that a document is taken: id, source, n_tokens, epoch, weight, exponent."""
    taken = draw(documents, id=id, **options)
    # passes that are whole take every copy, the last one some
    one = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    rows = taken.select("*", one).withColumn("epochs", F.col("full") + (F.col("copy") <= F.col("last")).cast("int"))
    kind = documents.schema[id].dataType
    out = rows.where("epochs > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)).alias("epoch"))
    return out.select(
        F.when(F.col("id") != "", F.col("id")).cast(kind).alias(id), "source", F.col("tokens").alias("n_tokens"), "epoch", "weight", "exponent"
    )


def mixed(documents: DataFrame, source: str = "source", id: str = "doc_id", text: str = "text", tokens: Column | None = None, **options) -> DataFrame:
    """The documents with all their columns, each as often as the mix takes it.

    Rows that share id, source and number of tokens are taken together: each as often as the least taken of them.
    """
    names = documents.columns
    count = words_in(F.col(text)) if tokens is None else tokens
    taken = draw(documents, source=source, id=id, text=text, tokens=tokens, **options)
    taken = taken.select(F.col("id").alias("__i"), F.col("source").alias("__s"), F.col("tokens").alias("__t"), (F.col("full") + F.floor(F.col("last") / F.col("copies"))).alias("__n"))
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.coalesce(F.col(id).cast("string"), F.lit("")).alias("i"), F.col(source).cast("string").alias("s"), count.alias("t"))
    hit = (F.col("i") == F.col("__i")) & F.col("s").eqNullSafe(F.col("__s")) & (F.col("t") == F.col("__t"))
    found = rows.join(taken.where("__n > 0"), hit).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    return found.select("row.*")
