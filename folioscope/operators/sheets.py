"""Tables as sheets: header detection, column profiles, type inference, row chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import materialize

# Rows of a chunk, samples of a column, values that a type is inferred from and the share that must agree, rows of a preview.
ROWS, SAMPLES, SEEN, AGREE, PREVIEW = 40, 8, 200, 0.9, 5
NUMBER = r"^-?[\d,]*\.?\d+(?:[eE][-+]?\d+)?$"
CURRENCY = r"^[$€£¥]\s?-?[\d,]*\.?\d+$|^-?[\d,]*\.?\d+\s?(?:USD|EUR|GBP)$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?)?$"
BOOLEAN = ["true", "false", "yes", "no", "y", "n", "0", "1"]


def is_header(cells: Column) -> Column:
    """Whether an array of cells looks like labels: none empty, numeric, a date or longer than 80, and no two equal but for case."""
    ok = F.forall(cells, lambda c: (c != "") & ~c.rlike("(?U)" + NUMBER) & ~c.rlike("(?U)" + ISO_DATE) & (F.length(c) <= 80))
    low = F.transform(cells, lambda c: F.lower(c))
    return (F.size(cells) > 0) & ok & (F.size(F.array_distinct(low)) == F.size(low))


def cells_of(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(row, columns as text): rows numbered 1..n in order (ties by the cells), each exactly once. Null cells are ''; an empty table gives no rows.

    Rows are sorted by ranges and written once with their range's number. Ranges are counted, and numbered on, from what was written: a range partitioning planned twice could
    draw other borders. No single task sorts the table, and as many offsets as there are ranges are looked up.
    """
    text = [F.coalesce(X.strip(F.col(c).cast("string")), F.lit("")).alias(c) for c in columns]
    keys = [f"_o{i}" for i in range(len(order))]
    ranged = df.select(*[F.col(c).alias(k) for k, c in zip(keys, order)], *text).repartitionByRange(*keys)
    ranged = materialize(ranged.withColumn("_p", F.spark_partition_id()), "sheet")
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offs = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))  # one row a range
    w = Window.partitionBy("_p").orderBy(*keys, *columns)
    rows = ranged.withColumn("_r", F.row_number().over(w)).join(F.broadcast(offs), "_p")
    return rows.select((F.col("_off") + F.col("_r")).alias("row"), *columns)


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(position, column, dtype, non_empty, distinct_values, samples) of rows (row, columns as text).

    dtype: what at least 90 % of the first 200 non-empty values are, in the order currency, date, number, boolean; else text; 'empty' without values. Samples: the first 8 values that
    differ but for case, cut to 120 characters. One unpivot, then aggregates that combine before the shuffle.
    """
    cells = rows.select("row", F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(c).alias("value")) for i, c in enumerate(columns)])).alias("c")).select("row", "c.*")
    full = cells.where("value <> ''")
    base = cells.groupBy("position", "column").agg(F.sum((F.col("value") != "").cast("long")).alias("non_empty"), F.count_distinct(F.when(F.col("value") != "", F.col("value"))).alias("distinct_values"))
    # The first 200 of a column, by row: taken in each task first, then once more.
    w = Window.partitionBy("position").orderBy("row")
    head = full.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= SEEN)
    share = lambda c: F.avg(c.cast("double")) >= AGREE
    v = F.col("value")
    dtype = F.when(share(v.rlike("(?U)" + CURRENCY)), "currency").when(share(v.rlike("(?U)" + ISO_DATE)), "date").when(share(v.rlike("(?U)" + NUMBER)), "number").when(share(F.lower(v).isin(BOOLEAN)), "boolean").otherwise("text")
    types = head.groupBy("position").agg(dtype.alias("dtype"))
    firsts = full.groupBy("position", F.lower("value").alias("k")).agg(F.min(F.struct("row", "value")).alias("f"))
    top = firsts.withColumn("_n", F.row_number().over(Window.partitionBy("position").orderBy("f.row", "k"))).where(F.col("_n") <= SAMPLES)
    samples = top.groupBy("position").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.substring("f.value", 1, 120).alias("value")))), lambda x: x["value"]).alias("samples"))
    out = base.join(types, "position", "left").join(samples, "position", "left")
    return out.select("position", "column", F.coalesce("dtype", F.lit("empty")).alias("dtype"), "non_empty", "distinct_values", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def row_chunks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(ord, first_row, last_row, body): batches of 40 rows as ' | '-joined lines under the header."""
    line = F.concat_ws(" | ", *columns)
    b = rows.select("row", line.alias("line")).groupBy(F.floor((F.col("row") - 1) / ROWS).cast("int").alias("ord"))
    b = b.agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("t"))
    return b.select("ord", "first_row", "last_row", X.clean(F.concat(F.lit(" | ".join(columns) + "\n"), "t")).alias("body"))
