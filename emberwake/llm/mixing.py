"""Mixing sources to target weights by weighted fair queueing. DataFrame and SQL functions only.

Each source plays its documents in a shuffled order, as often as needed. A document's virtual
finish time is the tokens its source has played by then, over the source's target weight. The
mix is the sequence of all plays in the order of their finish times, cut at the total budget.

No window covers a whole source or the whole mix: running sums are taken in two levels, over
cells of a hash (or of the finish time), whose totals are pre-aggregated, and within a cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import free

#: Words, as the size of a document.
WORDS = r"[^\x20\x09-\x0D]+"
#: Cells of the shuffle order, for each source, and of the finish time. Only running totals of cells stand in one task.
CELLS = 4096


def word_count(text) -> F.Column:
    """Number of WORDS matches; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: float = 2.0) -> DataFrame:
    """sizes(source, source_size), one row each -> adds target: the budget split by weight, none above most * size.

    Sources by code point, null last, take the weights in turn. Water filling in closed form: in the
    order of cap / weight, sources are capped as long as the level that the rest would get is above
    their cap. A table of sources: its windows hold one row for each source.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumn("cap", F.col("source_size") * most)
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    whole = W.partitionBy()
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing))
    leveled = weighed.withColumn("level", level).withColumn("open", F.col("cap") >= F.col("level") * F.col("weight"))
    first = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("level").alias("level")))).over(whole)
    return leveled.withColumn("least", first["level"]).select("source", "source_size", "weight", F.coalesce(F.least(F.col("cap"), F.col("least") * F.col("weight")), F.col("cap")).alias("target"))


def fair_queue(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All plays: (doc_id, source, size, copies, source_size, target, play, finish, taken).

    Rows of equal id, source and size are one unit of `copies` rows, played together. Units without
    words are played at no cost. The order is the finish time, then the shuffle key; `taken` marks
    the plays whose running total in that order is within the budget of share * all sizes. An empty
    table gives an empty result; a null id or source is a value like any other.
    """
    own = docs.select(docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"), word_count(docs[text_col]).alias("size"))
    units = own.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")).withColumn("cost", F.col("size") * F.col("copies"))
    sized = targets(units.groupBy("source").agg(F.sum("cost").alias("source_size")), share, weights, float(most))
    plays = units.select("*", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("play"))
    keyed = plays.withColumn("key", F.xxhash64(F.col("doc_id").cast("string"), "source", "size", "play", F.lit(seed)))
    cells = keyed.withColumn("cell", F.shiftrightunsigned("key", 64 - CELLS.bit_length() + 1) + F.col("play") * CELLS)
    totals = cells.groupBy("source", "cell").agg(F.sum("cost").alias("cell_cost"))
    offset = F.sum("cell_cost").over(W.partitionBy("source").orderBy("cell")) - F.col("cell_cost")
    known = totals.select("source", "cell", offset.alias("offset")).join(sized.select(F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s")))
    known = known.select(F.col("source").alias("_s"), F.col("cell").alias("_c"), "offset", "source_size", "target")
    played = F.col("offset") + F.sum("cost").over(W.partitionBy("source", "cell").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    joined = cells.join(known, F.col("source").eqNullSafe(F.col("_s")) & (F.col("cell") == F.col("_c")))
    timed = joined.withColumn("finish", F.coalesce(F.try_divide(played.cast("double"), F.col("target")), F.lit(0.0)))
    return _truncate(timed, share).select("doc_id", "source", "size", "copies", "source_size", "target", "play", "finish", "taken")


def _truncate(timed: DataFrame, share: float) -> DataFrame:
    """Marks what the budget holds, in the order of finish times: whole cells of it, and rows in the cell where it ends."""
    placed = timed.withColumn("slot", F.floor(F.least(F.col("finish"), F.lit(1e6)) * CELLS))
    totals = placed.groupBy("slot").agg(F.sum("cost").alias("slot_cost"), F.sum(F.when(F.col("play") == 0, F.col("cost")).otherwise(0)).alias("once"))
    running = F.sum("slot_cost").over(W.orderBy("slot"))
    slots = totals.select(F.col("slot").alias("_p"), (running - F.col("slot_cost")).alias("done"), "slot_cost", (F.sum("once").over(W.partitionBy()) * share).alias("budget"))
    known = placed.join(slots, F.col("slot") == F.col("_p"))
    ends = (F.col("done") + F.col("slot_cost") > F.col("budget")) & (F.col("done") < F.col("budget"))
    sure = known.where(~ends).withColumn("taken", F.col("done") + F.col("slot_cost") <= F.col("budget"))
    at = F.col("done") + F.sum("cost").over(W.partitionBy("slot").orderBy("finish", "key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    return sure.unionByName(known.where(ends).withColumn("taken", at <= F.col("budget")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the mix plays, one for each play, in no order, with `play` and `finish`; sort by finish for the sequence.

    Underscores are added to these two names where docs has such a column.
    """
    i, s, t = options.get("id_col", "doc_id"), options.get("source_col", "source"), options.get("text_col", "text")
    key, source, size, play, finish = free(docs.columns, "_i", "_s", "_n", "play", "finish")
    taken = fair_queue(docs, **options).where("taken")
    taken = taken.select(F.col("doc_id").alias(key), F.col("source").alias(source), F.col("size").alias(size), F.col("play").alias(play), F.col("finish").alias(finish))
    same = docs[i].eqNullSafe(taken[key]) & docs[s].cast("string").eqNullSafe(taken[source]) & (word_count(docs[t]) == taken[size])
    return docs.join(taken, same).drop(key, source, size)


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken), for each row of docs: taken is the words the mix takes of it, repeats counted."""
    plays = fair_queue(docs, **options)
    words = F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0))
    units = plays.groupBy("doc_id", "source", "size", "copies").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), words.alias("taken"))
    return units.select("doc_id", "size", "source_size", "target", "taken", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_")).drop("_")
