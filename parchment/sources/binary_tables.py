"""Tables of old binary word-processor files, from their text with cell marks.

A cell ends with \\x07; a row ends with \\x07 right before \\r. Everything here works on decoded text
or on numbers that a reader of the file format delivers.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The opcode of a table definition, twips between edges, and header widths for reshaping.
TABLE_DEFINITION = 0xD608
LEAST_COLUMNS, MOST_COLUMNS = 5, 24
#: Words that make a row a header.
HEADER_WORDS = ("구분", "항목", "일자", "성명", "내용", "비고", "item", "date", "name", "total")


def cell_mark_rows(c: Column) -> Column:
    """Rows of cells of a text with cell marks; text outside of rows is left out."""
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"[\x00-\x06\x08-\x1f]", " "), r"\s+", " "))
    ended = F.split(c, "\x07\r", -1)
    rows = F.slice(ended, 1, F.greatest(F.size(ended) - 1, F.lit(0)))
    # Before a row's first cell stands what follows the paragraph before it.
    first = lambda r: F.element_at(F.split(r, "[\r\n]", -1), -1)
    cells = lambda r: F.split(r, "\x07", -1)
    return F.transform(rows, lambda r: F.transform(F.concat(F.array(first(F.element_at(cells(r), 1))), F.slice(cells(r), F.lit(2), F.greatest(F.size(cells(r)) - 1, F.lit(0)))), clean))


def is_header(row: Column) -> Column:
    """A row that has a header word and no more numbers than texts."""
    numbers = F.size(F.filter(row, lambda x: x.rlike(r"^[\d,.%()\-]+$")))
    named = F.exists(row, lambda x: F.exists(F.array(*[F.lit(w) for w in HEADER_WORDS]), lambda w: F.lower(x).contains(w)))
    return named & (2 * numbers <= F.size(row))


def header_rows(rows: Column) -> Column:
    """How many rows from the first on are headers, one at least."""
    flags = F.transform(rows, is_header)
    first_plain = F.array_position(flags, F.lit(False))
    return F.greatest(F.lit(1), F.when(first_plain == 0, F.size(rows)).otherwise(first_plain - 1).cast("int"))


def reshaped(row: Column) -> Column:
    """One long row as rows of a divisor's width (5 to 24), the first whose first row is a header;
    null if there is none."""
    n = F.size(row)
    widths = F.filter(F.sequence(F.lit(LEAST_COLUMNS), F.lit(MOST_COLUMNS)), lambda w: (n % w == 0) & (n > w))
    fits = F.filter(widths, lambda w: is_header(F.slice(row, F.lit(1), w)))
    width = F.get(fits, 0)
    return F.when(width.isNotNull(), F.transform(F.sequence(F.lit(0), (n / width - 1).cast("int")), lambda i: F.slice(row, i * width + 1, width)))


def table_definitions(grpprl: bytes) -> Iterator[list[int]]:
    """Column edges (twips) of the table definitions in a property list: opcode, size, number of
    columns, one edge more than columns. A cut-off definition ends the search."""
    mark = struct.pack("<H", TABLE_DEFINITION)
    at = grpprl.find(mark)
    while at >= 0 and at + 5 <= len(grpprl):
        columns = grpprl[at + 4]
        end = at + 5 + 2 * (columns + 1)
        if end > len(grpprl):
            return
        if columns:
            yield list(struct.unpack_from(f"<{columns + 1}h", grpprl, at + 5))
        at = grpprl.find(mark, end)


def attach_definitions(rows: DataFrame, definitions: DataFrame) -> DataFrame:
    """Rows (document_id, position, n_columns) with the definition (document_id, number, n_columns,
    edges) that stands for them: the n-th run of rows of one width takes the n-th of that width, and
    the last one goes on for further runs."""
    w = Window.partitionBy("document_id").orderBy("position")
    new = F.coalesce((F.col("n_columns") != F.lag("n_columns").over(w)).cast("int"), F.lit(0))
    runs = rows.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
    first = runs.groupBy("document_id", "n_columns", "__run").agg(F.min("position").alias("__from"))
    first = first.withColumn("__n", F.row_number().over(Window.partitionBy("document_id", "n_columns").orderBy("__from")))
    listed = definitions.groupBy("document_id", "n_columns").agg(F.sort_array(F.collect_list(F.struct("number", "edges"))).alias("__d"))
    chosen = first.join(listed, ["document_id", "n_columns"], "left").select("document_id", "n_columns", "__run", F.get("__d", F.least(F.col("__n"), F.size("__d")) - 1)["edges"].alias("edges"))
    return runs.join(chosen, ["document_id", "n_columns", "__run"]).drop("__new", "__run")


def master_edges(rows: DataFrame, group_cols: list[str], tolerance: int = 60) -> DataFrame:
    """(…, column, from, to): the columns between all edges of a table's rows, edges within a
    tolerance counting as one."""
    edges = rows.select(*group_cols, F.explode("edges").alias("edge")).distinct()
    w = Window.partitionBy(*group_cols).orderBy("edge")
    marked = edges.withColumn("__n", F.coalesce((F.col("edge") - F.lag("edge").over(w) > tolerance).cast("int"), F.lit(0))).withColumn("__c", F.sum("__n").over(w))
    lines = marked.groupBy(*group_cols, "__c").agg(F.min("edge").alias("edge"))
    order = Window.partitionBy(*group_cols).orderBy("edge")
    out = lines.withColumn("to", F.lead("edge").over(order)).withColumn("column", F.row_number().over(order) - 1)
    return out.where("to IS NOT NULL").select(*group_cols, "column", F.col("edge").alias("from"), "to")
