"""Mixing sources to target weights by Pareto order sampling.

A document's expected copies are proportional to its weight (by default about the logarithm of its size,
so that longer documents have somewhat better odds), at most ``most``, and bring its source to its target.
Their whole part is certain. The rest is its inclusion probability: within strata of like size, documents are
ranked by random odds over inclusion odds, and a fixed number of the lowest is taken once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm._shared import fresh, materialize, small

#: Bins of one cut of the order of a stratum; two cuts leave a millionth of it to sort.
_BINS = 1 << 10


def word_count(text: Column) -> Column:
    """Number of runs of bytes other than 0x20 and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """source, source_size, target of a table (source, source_size).

    Sources by code point, null last, weigh ``weights``, repeating. All words are shared by weight,
    targets stop at ``most`` times their source's size and the excess is shared again: all open
    targets rise at one level, found where sources ordered by cap over weight stop filling up.
    """
    # One row a source, so these windows without a key hold as many rows as there are sources.
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    given = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.withColumns({"weight": F.element_at(given, (F.col("place") % len(weights) + 1).cast("int")).cast("long"), "cap": F.col("source_size") * most})
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    upto, every = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0))
    open_ = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0))
    ranked = ranked.withColumns({"left": left, "open": open_})
    level = F.min(F.when(F.col("left") * F.col("weight") <= F.col("cap") * F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "place", "left", "open"))).over(every)
    ranked = ranked.withColumn("level", level)
    share = F.col("level.left").cast("double") * F.col("weight") / F.col("level.open")
    return ranked.select("source", "source_size", F.least(F.col("cap").cast("double"), share).alias("target"))


def _drawn(id_col: Column) -> Column:
    """A number in (0, 1) from 52 bits of the id's MD5, the same on every run."""
    digits = F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def _octave(size: Column) -> tuple[Column, Column]:
    """Binary digits of a size, and the power of two that it begins with."""
    digits = F.length(F.bin(size)).cast("long")
    return digits, F.pow(F.lit(2.0), digits - 1).cast("long")


def size_weight(size: Column) -> Column:
    """64 * (9 + log2 of the size), linear between powers of two, as a whole number; 0 without words."""
    digits, power = _octave(size)
    return F.when(size > 0, 64 * (8 + digits) + F.floor((size - power) * 64 / power)).otherwise(0).cast("long")


def stratum(size: Column) -> Column:
    """Four strata to an octave of sizes. Never null, so that joins by it need no filter that counts words again."""
    digits, power = _octave(size)
    return F.coalesce(F.when(size > 0, 4 * digits + F.floor((size - power) * 4 / power)).cast("long"), F.lit(0).cast("long"))


def expected_copies(most: int) -> Column:
    """Copies of a row with ``weight`` and its source's ``rate``; where all are at ``most`` there is no rate."""
    return F.when(F.col("weight") > 0, F.least(F.lit(float(most)), F.coalesce(F.col("rate") * F.col("weight"), F.lit(float(most))))).otherwise(0.0)


def source_rates(kinds: DataFrame, most: int) -> DataFrame:
    """source, rate: copies per weight that bring each source to its target, of a table (source, target, weight, words).

    Weights whose copies would pass ``most`` stop there, and the others share what is left: the rate
    rises until no further weight passes. Sums only; a round for each time that more weights stop.
    """
    rates = None
    while True:
        known = kinds.withColumn("rate", F.lit(0.0)) if rates is None else kinds.join(rates.select(F.col("source").alias("s"), "rate"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        full = F.coalesce(F.col("rate") * F.col("weight") >= F.lit(float(most)), F.lit(True)) & (F.col("weight") > 0)
        sums = known.groupBy("source").agg(F.max("target").alias("target"), F.sum(F.when(full, F.col("words")).otherwise(0)).alias("stopped"), F.sum(F.when(full, 0).otherwise(F.col("words") * F.col("weight"))).alias("mass"), F.count_if(full).alias("n"))
        new = F.when(F.col("mass") > 0, F.greatest(F.lit(0.0), F.col("target") - F.col("stopped") * most) / F.col("mass"))
        last, rates = rates, materialize(sums.select("source", "n", new.alias("rate")))
        if last is not None and rates.agg(F.sum("n")).first()[0] == last.agg(F.sum("n")).first()[0]:
            return rates.select("source", "rate")


def sample_sizes(strata: DataFrame) -> DataFrame:
    """source, stratum, take of rows (source, stratum, words, chances, n): expected words and copies by chance, and candidates.

    From the stratum of the longest documents on, each takes the number of documents that comes nearest to its
    expected words and to what the ones before it left over. A source has at most some 250 strata, in one array.
    """
    order = F.sort_array(F.collect_list(F.struct("stratum", "words", "chances", "n")), asc=False)

    def step(state: Column, one: Column) -> Column:
        mean = one["words"] / one["chances"]
        due = state["due"] + one["words"]
        take = F.least(one["n"], F.greatest(F.lit(0).cast("long"), F.floor(due / mean + 0.5)))
        return F.struct((due - take * mean).alias("due"), F.concat(state["out"], F.array(F.struct(one["stratum"].alias("stratum"), take.alias("take")))).alias("out"))

    start = F.struct(F.lit(0.0).alias("due"), F.expr("cast(array() as array<struct<stratum: bigint, take: bigint>>)").alias("out"))
    folded = strata.where("n > 0").groupBy("source").agg(order.alias("strata")).select("source", F.aggregate("strata", start, step, lambda state: state["out"]).alias("out"))
    return folded.select("source", F.inline("out"))


def plan_mixture(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row per source and stratum of ``rows`` (id, source, size, weight, stratum, drawn): source_size, target, rate, take and cut, the last row taken."""
    kinds = materialize(rows.groupBy("source", "stratum", "weight").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")))
    totals = kinds.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = materialize(source_targets(totals, weights, most))
    with_source = lambda df, other: df.join(other.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    known = with_source(kinds, targets)
    known = materialize(with_source(known, source_rates(known.select("source", "target", "weight", "words"), most)))
    copies = expected_copies(most)
    chance = copies - F.floor(copies)
    strata = known.where(chance > 0).groupBy("source", "stratum").agg(F.sum(chance * F.col("words")).alias("words"), F.sum(chance * F.col("n")).alias("chances"), F.sum("n").alias("n"))
    takes = sample_sizes(strata.where("words > 0"))
    key = lambda df, other: df.join(other.withColumnsRenamed({"source": "s", "stratum": "t"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("stratum") == F.col("t")), "left").drop("s", "t")
    plan = materialize(key(known.select("source", "stratum", "source_size", "target", "rate").distinct(), takes))
    return materialize(key(plan, _cuts(_ranked(rows, plan.withColumn("cut", F.lit(None).cast("struct<rank: double, id: string, size: bigint>")), most))))


def _cuts(ranked: DataFrame) -> DataFrame:
    """source, stratum, cut: the last row that each stratum takes. Counts of bins find the bin, then of its bins the one that is sorted."""
    own = ["source", "stratum"]
    pool = ranked.where("chance > 0 and take > 0").select(*own, "id", "size", "rank", "take", F.lit(0).cast("long").alias("before"))
    for level in (1, 2):
        bin_ = F.least(F.floor(F.col("rank") * _BINS**level), F.lit(_BINS**level - 1))
        counts = pool.groupBy(*own, "take", "before", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*own).orderBy("bin")) + F.col("before")
        last = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("take")) & (F.col("upto") - F.col("n") < F.col("take")))
        last = materialize(last.select(F.col("source").alias("s"), F.col("stratum").alias("t"), F.col("bin").alias("last_bin"), (F.col("upto") - F.col("n")).alias("past")))
        named = small(last, 64, last.count())
        pool = pool.join(named, F.col("source").eqNullSafe(F.col("s")) & (F.col("stratum") == F.col("t")) & (bin_ == F.col("last_bin"))).select(*own, "id", "size", "rank", "take", F.col("past").alias("before"))
    nth = F.row_number().over(Window.partitionBy(*own).orderBy("rank", F.col("id").cast("string"), "size")) + F.col("before")
    return pool.withColumn("nth", nth).where(F.col("nth") == F.col("take")).select(*own, _place().alias("cut"))


def _place() -> Column:
    return F.struct(F.col("rank"), F.col("id").cast("string").alias("id"), F.col("size"))


def _ranked(rows: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """``rows`` with their stratum's plan, certain whole copies, and the rank: Pareto's odds ratio q as q / (1 + q)."""
    named = plan.withColumnsRenamed({"source": "plan_source", "stratum": "plan_stratum"})
    df = rows.join(small(named, 256, plan.count()), F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("stratum") == F.col("plan_stratum"))).drop("plan_source", "plan_stratum")
    copies = expected_copies(most)
    df = df.withColumn("copies", copies).withColumn("whole", F.floor("copies")).withColumn("chance", F.col("copies") - F.col("whole"))
    odds = F.col("drawn") / (1 - F.col("drawn")) / (F.col("chance") / (1 - F.col("chance")))
    return df.withColumn("rank", F.when(F.col("chance") > 0, odds / (1 + odds)))


def _copies() -> Column:
    more = (F.col("chance") > 0) & (F.col("take") > 0) & (_place() <= F.col("cut"))
    return (F.col("whole") + F.coalesce(more, F.lit(False)).cast("long")).cast("long")


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight_col: str | None, *more: Column) -> DataFrame:
    """id, source, size, weight, stratum and drawn of each row, and ``more``. Sizes are a column before others use them, so each text is counted once."""
    key, given = F.col(id_col), [F.col(weight_col).cast("double").alias("weight")] if weight_col else []
    counted = docs.select(key.alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *given, _drawn(key).alias("drawn"), *more)
    weight = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)) if weight_col else size_weight(F.col("size"))
    return counted.withColumns({"weight": weight, "stratum": stratum(F.col("size"))})


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per document, with the words that the mix takes of it.

    Targets as in source_targets(). A document's expected copies are in proportion to ``weight_col``, or by
    default to size_weight(), and at most ``most``; together they bring the source to its target. Their whole
    part is certain. For the rest, Pareto's rule ranks the documents of a stratum by random odds over
    inclusion odds, and the fixed number of sample_sizes() is taken once more, lowest first. So a source
    ends about as near to its target as its short documents are long. Draws depend on the id alone, so
    reruns agree. Strata of any size are cut by counts; only a millionth of one is sorted.

    Null texts have size 0 and null sources are a source. Documents without words give 0; very long texts are
    counted whole. Rows that repeat an id are mixed row by row with the same draw, and rows alike in id and
    size share the answer at the end of the order. Negative or null weights count as 0. Other columns are not
    read, whatever their names; an empty table gives no rows.
    """
    rows = materialize(_rows(docs, id_col, text_col, source_col, weight_col))
    ranked = _ranked(rows, plan_mixture(rows, weights, most), most)
    return ranked.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"))


def mixed_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as mix_documents() takes it, all columns and whole texts.

    Null and empty texts have no words to take and go. Repeated rows are taken row by row; names never clash
    with the columns; an empty table stays empty.
    """
    (kept,) = fresh(docs, "mixed_row")
    rows = materialize(_rows(docs, id_col, text_col, source_col, weight_col))
    plan = plan_mixture(rows, weights, most)
    wide = _rows(docs, id_col, text_col, source_col, weight_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(kept))
    ranked = _ranked(wide, plan, most)
    return ranked.select(kept, F.explode(F.array_repeat(F.lit(0), _copies().cast("int")))).select(f"{kept}.*")
