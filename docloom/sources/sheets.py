"""Tables out of sheets, and tables as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import DEFAULT


def padded(row: Column, width: Column) -> Column:
    """A row filled up with blanks and cut to a width."""
    return F.slice(F.concat(row, F.array_repeat(F.lit(""), width.cast("int"))), F.lit(1), F.greatest(width.cast("int"), F.lit(0)))


def sheet_tables(rows: DataFrame, most: int | None = DEFAULT.sheet_rows) -> DataFrame:
    """(doc, sheet, row_no, cells) -> (doc, sheet, island, headers, rows, note): rows between blank ones make a table.

    The first row is the header; a group of one row is no table. Rows beyond `most` of a sheet are not
    read, as a limit of the source (None: all are). note says if over 40 % of more than 10 cells are blank.
    """
    keys = ["doc", "sheet"]
    order = Window.partitionBy(*keys).orderBy("row_no")
    trimmed = F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))))
    df = rows.withColumn("cells", trimmed).withColumn("blank", ~F.exists("cells", lambda c: c != ""))
    df = (df if most is None else df.where(F.col("row_no") <= most)).withColumn("island", F.sum(F.col("blank").cast("long")).over(order)).where("NOT blank")
    held = df.groupBy(*keys, "island").agg(F.array_sort(F.collect_list(F.struct("row_no", "cells"))).alias("held"), F.max(F.size("cells")).alias("width")).where(F.size("held") > 1)
    all_rows = F.transform("held", lambda r: padded(r["cells"], F.col("width")))
    held = held.withColumn("all", all_rows)
    blanks = F.aggregate(F.flatten("all"), F.lit(0), lambda n, c: n + (c == "").cast("int"))
    cells = F.size(F.flatten("all"))
    note = F.when((cells > 10) & (blanks / cells > 0.4), F.lit("many blank cells"))
    return held.select(*keys, "island", F.col("all")[0].alias("headers"), F.expr("slice(all, 2, size(all) - 1)").alias("rows"), note.alias("note"))


def markdown(headers: Column, rows: Column, most: int = DEFAULT.preview_rows) -> Column:
    """Header, rule and at most 25 rows, padded or cut to the header's width; nothing without headers."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    body = F.transform(F.slice(rows, 1, most), lambda r: line(padded(r, F.size(headers))))
    rule = line(F.transform(headers, lambda h: F.lit("---")))
    return F.when(F.coalesce(F.size(headers), F.lit(0)) > 0, F.array_join(F.concat(F.array(line(headers), rule), body), "\n")).otherwise("")


def json_rows(headers: Column, rows: Column, most: int = DEFAULT.preview_rows) -> Column:
    """Each row as JSON by header; of equal headers the last counts."""
    last = lambda r: F.transform(
        F.array_distinct(headers), lambda h: F.struct(h.alias("key"), F.element_at(F.filter(F.arrays_zip(headers.alias("h"), padded(r, F.size(headers)).alias("v")), lambda x: x["h"] == h), -1)["v"].alias("value"))
    )
    return F.transform(F.slice(rows, 1, most), lambda r: F.to_json(F.map_from_entries(last(r))))


def summary_text(name: Column, description: Column, headers: Column, rows: Column) -> Column:
    """The text of a table's summary chunk: what is known of it, its columns and first 3 rows."""
    parts = F.array(
        F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit("Table summary: "), description)),
        F.when(F.size(headers) > 0, F.concat(F.lit("Columns: "), F.array_join(headers, ", "))),
        F.when(F.size(rows) > 0, F.array_join(F.transform(F.slice(rows, 1, DEFAULT.summary_rows), lambda r: F.array_join(r, " | ")), "\n")),
    )
    return F.array_join(F.array_compact(parts), "\n")


def grid(df: DataFrame, key: str) -> DataFrame:
    """A typed DataFrame as a table of strings, one row per row: nulls become blanks."""
    columns = [c for c in df.columns if c != key]
    return df.select(key, F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("cells"))
