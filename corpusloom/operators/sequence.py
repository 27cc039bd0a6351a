"""Operators over ordered rows: islands, runs, repairs, carry-forward, context, budgets.

Rules whose step depends on their own earlier results pass over a group's rows in order, in
one task; everything else is a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _window(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def islands(df: DataFrame, keys: list[str], order: list[str], same: list[str]) -> DataFrame:
    """Adds ``island``: a number that grows whenever a column of ``same`` changes."""
    w = _window(keys, order)
    new = F.lit(False)
    for c in same:
        new = new | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    marked = df.withColumn("_new", (first | new).cast("int"))
    return marked.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_islands(df: DataFrame, keys: list[str], order: list[str], same: list[str], text: str, sep: str = " ", count: str = "n") -> DataFrame:
    """One row for each island: its first columns, its texts joined in order, and the number of its rows as ``count``."""
    marked = islands(df, keys, order, same)
    rank = F.struct(*order)
    rest = [c for c in df.columns if c not in {*keys, text}]
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), sep).alias(text)
    return marked.groupBy(*keys, "island").agg(*[F.min_by(c, rank).alias(c) for c in rest], texts, F.count(F.lit(1)).alias(count))


def runs(df: DataFrame, keys: list[str], order: list[str], n: str, low: int = 3, high: int = 10) -> DataFrame:
    """Adds ``run``: a new one starts where a number of at most ``low`` follows one of at least ``high``
    and there is a next one, at most two greater."""
    w = _window(keys, order)
    after = F.lead(n).over(w)
    start = (F.col(n) <= low) & (F.lag(n).over(w) >= high) & (after <= F.col(n) + 2)
    marked = df.withColumn("_start", F.coalesce(start, F.lit(False)).cast("int"))
    return marked.withColumn("run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def chosen_run(sizes: Column, factor: float = 1.5) -> Column:
    """Index of the run to keep in an array of run sizes: the first, unless a later one is ``factor`` times the one held."""
    step = lambda a, x: F.struct((a["i"] + 1).alias("i"), F.when((a["i"] == 0) | (x >= a["size"] * factor), a["i"]).otherwise(a["best"]).alias("best"), F.when((a["i"] == 0) | (x >= a["size"] * factor), x).otherwise(a["size"]).alias("size"))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("best"), F.lit(0).cast("bigint").alias("size"))
    return F.aggregate(F.transform(sizes, lambda x: x.cast("bigint")), start, step, lambda a: a["best"])


def keep_run(df: DataFrame, keys: list[str], order: list[str], n: str, factor: float = 1.5) -> DataFrame:
    """The rows of the chosen run of every group."""
    marked = runs(df, keys, order, n)
    size = marked.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("size"))
    sizes = size.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "size"))), lambda x: x["size"]).alias("sizes"))
    best = sizes.select(*keys, chosen_run(F.col("sizes"), factor).cast("bigint").alias("run"))
    return marked.join(best, [*keys, "run"])


def _in_order(df: DataFrame, keys: list[str], order: list[str], change) -> DataFrame:
    """``change(rows)`` of each group's rows in order; a group is worked through in one task, in one pass."""
    return df.groupBy(*keys).applyInPandas(lambda pdf: change(pdf.sort_values(order, kind="stable")), df.schema)


def repaired(numbers: list[int]) -> list[int]:
    """Numbers with dropped hundreds and lone dips restored.

    Each is judged against the repaired one before it: if the expected number is 100 or more and greater by a
    multiple of 100, the hundreds were dropped; if the number is less than the one before and the next goes on
    by two from that, it is a dip.
    """
    out: list[int] = []
    for n, after in zip(numbers, [*numbers, None][1:], strict=True):
        due = out[-1] + 1 if out else n
        hundreds = n < due and due >= 100 and (due - n) % 100 == 0
        dip = n < due - 1 and after == due + 1
        out.append(due if hundreds or dip else n)
    return out


def repair_numbers(df: DataFrame, keys: list[str], order: list[str], n: str) -> DataFrame:
    """``df`` with ``n`` repaired in each group."""
    return _in_order(df, keys, order, lambda rows: rows.assign(**{n: repaired(rows[n].tolist())}))


def suffix_duplicates(df: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """Of rows with equal keys, those equal to the first go; others get ``suffix`` -r2, -r3, ... ('' for the first)."""
    w = _window(keys, order)
    first = F.first(text).over(w.rowsBetween(Window.unboundedPreceding, 0))
    kept = df.withColumn("_k", F.row_number().over(w)).withColumn("_same", F.col(text).eqNullSafe(first)).where("_k = 1 or not _same")
    rank = F.row_number().over(_window(keys, order))
    return kept.withColumn("suffix", F.when(rank == 1, "").otherwise(F.concat(F.lit("-r"), rank.cast("string")))).drop("_k", "_same")


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the last non-null ``value`` up to each row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def accepted_headings(df: DataFrame, keys: list[str], order: list[str], n: str) -> DataFrame:
    """The rows whose number continues the last accepted one by one, from 1."""

    def accept(rows):
        last, keep = 0, []
        for x in rows[n].tolist():
            keep.append(x == last + 1)
            last += keep[-1]
        return rows[keep]

    return _in_order(df, keys, order, accept)


def select_context(df: DataFrame, keys: list[str], order: list[str], anchor: Column, small: int = 30, opening: int = 2, around: int = 1, least: int = 8, cap: int = 120) -> DataFrame:
    """Anchored rows with their neighbours and the opening ones.

    Groups of at most ``small`` rows are taken whole; where fewer than ``least``
    rows would stay, the first ``cap``; never more than ``cap``.
    """
    w = _window(keys, order)
    whole = Window.partitionBy(*keys)
    df = df.withColumn("_a", F.coalesce(anchor, F.lit(False)).cast("int")).withColumn("_k", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(whole))
    df = df.withColumn("_in", (F.max("_a").over(w.rowsBetween(-around, around)) == 1) | (F.col("_k") <= opening))
    df = df.withColumn("_kept", F.sum(F.col("_in").cast("int")).over(whole))
    stay = (F.col("_n") <= small) | F.when(F.col("_kept") < least, F.col("_k") <= cap).otherwise(F.col("_in"))
    df = df.where(stay)
    return df.withColumn("_c", F.row_number().over(w)).where(F.col("_c") <= cap).drop("_a", "_k", "_n", "_in", "_kept", "_c")


def budget_prefix(df: DataFrame, keys: list[str], order: list[str], cost: str, cap: float) -> DataFrame:
    """The leading rows of each group whose running cost stays within ``cap``."""
    running = F.sum(cost).over(_window(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running", running).where(F.col("running") <= cap)


def budget_plan(df: DataFrame, group: str, order: list[str], cost: str, cap: float) -> DataFrame:
    """The rows of ``df`` that one budget pays for, group after group.

    A group ends at its first row that does not fit; a later group may still add cheaper ones. Rows beyond the
    budget by their own group alone end at a window. Those within pass in order through one task, which
    holds nothing but what was spent.
    """
    within = budget_prefix(df, [group], order, cost, cap).drop("running")

    def accept(batches):
        spent, now, shut = 0.0, None, False
        for pdf in batches:
            keep = []
            for g, c in zip(pdf[group], pdf[cost], strict=True):
                shut = shut and g == now
                now = g
                shut = shut or spent + c > cap
                keep.append(not shut)
                spent += 0 if shut else c
            yield pdf[keep]

    return within.orderBy(*order).coalesce(1).mapInPandas(accept, df.schema)


def chunk(order: Column, size: int) -> Column:
    """Number of the fixed-size chunk of a row number from 1."""
    return F.floor((order - 1) / size).cast("bigint")
