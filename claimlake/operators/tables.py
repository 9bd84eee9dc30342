"""Page tables: spans, cells, rows and the headers that describe a cell."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlake.functions.rows import rows_of
from claimlake.functions.binding import let
from claimlake.functions.text import process_text
from claimlake.functions.titles import table_no
from claimlake.functions.multisets import last_before, piece, run_starts
from claimlake.operators.outline import outline, section_chain

TABLE_TYPE = (
    "type STRING, caption STRING, "
    "table ARRAY<ARRAY<STRUCT<id: STRING, value: STRING, is_header: BOOLEAN, column_span: STRING, row_span: STRING>>>"
)
#: Cells, and headers of cells, that a task puts together at a time.
CELLS, HEADERS = 10_000, 200_000
#: Row layouts that a task remembers, and the longest one among them.
ROWS, ROW = 10_000, 200
_SLOT = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("last", T.BooleanType())])
_GRIDS = T.ArrayType(T.ArrayType(T.ArrayType(_SLOT)))


def layout_of(table: Column) -> Column:
    """Row layout ``1x2,1x1;...`` (columns x rows of each cell) of a table that is not a plain grid, else null."""
    rows = table["table"]
    plain = F.forall(
        rows,
        lambda r: (F.size(r) == F.size(rows[0]))
        & F.forall(r, lambda c: c["column_span"].isin("1") & c["row_span"].isin("1")),
    )
    spans = lambda c: F.concat_ws("x", F.coalesce(c["column_span"], F.lit("?")), F.coalesce(c["row_span"], F.lit("?")))
    layout = F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, spans), ",")), ";")
    return F.when((F.size(rows) > 0) & ~F.coalesce(plain, F.lit(False)), layout)


def _expand(layout: str) -> list | None:
    """Grid of ``(cell number, is last slot of the cell)``; None when the table does not fit its width.

    A cell takes the first free slot of its row. Columns spanned are filled to the right, rows spanned only
    below that first slot. Every slot must be covered in the end.
    """
    try:
        rows = [[tuple(int(n) for n in cell.split("x")) for cell in row.split(",") if cell] for row in layout.split(";")]
    except ValueError:
        return None
    width = sum(cols for cols, _ in rows[0])
    grid: list[list[int | None]] = [[None] * width for _ in rows]
    number = 0
    for i, row in enumerate(rows):
        for cols, depth in row:
            if cols > 0 or depth > 0:
                free = next((j for j, slot in enumerate(grid[i]) if slot is None), width)
                if free == width and depth > 0:
                    return None
                for j in range(free, min(free + cols, width)):
                    grid[i][j] = number
                for below in range(i, min(i + depth, len(rows))):
                    grid[below][free] = number
            number += 1
    last_slot = {cell: (i, j) for i, row in enumerate(grid) for j, cell in enumerate(row)}
    if None in last_slot:
        return None
    return [
        [{"cell": cell, "last": last_slot[cell] == (i, j)} for j, cell in enumerate(row)] for i, row in enumerate(grid)
    ]


def _parsed_row(row: str) -> tuple[list[tuple[int, int]], bool]:
    """The cells of one row of a layout as columns and rows, and whether none of them reaches below its row."""
    cells = [tuple(int(n) for n in cell.split("x")) for cell in row.split(",") if cell]
    return cells, all(depth == 1 for _, depth in cells)


def _flat_row(cells: list[tuple[int, int]], width: int) -> tuple[list[int], list[bool]] | None:
    """Cell numbers within a row and last marks of its slots, where no cell reaches below its row; None as in ``_expand``."""
    slots: list[int] = []
    for k, (cols, _) in enumerate(cells):
        if len(slots) >= width:
            return None
        # without any columns a cell still takes its first slot
        slots += [k] * min(max(cols, 1), width - len(slots))
    if len(slots) < width:
        return None
    return slots, [j + 1 == width or slots[j + 1] != k for j, k in enumerate(slots)]


def _grids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The grids of batches of layouts, put together as flat lists. Rows of one look are worked out once."""
    short = lru_cache(ROWS)(_parsed_row)
    parsed = lambda row: short(row) if len(row) <= ROW else _parsed_row(row)
    narrow = lru_cache(ROWS)(lambda row, width: _flat_row(parsed(row)[0], width))
    flat = lambda row, width: narrow(row, width) if max(len(row), width) <= ROW else _flat_row(parsed(row)[0], width)

    def grid(layout: str) -> tuple[list[int], list[bool], int, int] | None:
        """Cells, last marks, height and width."""
        rows = layout.split(";")
        try:
            if not all(parsed(row)[1] for row in rows):
                slots = _expand(layout)
                return slots and ([s["cell"] for row in slots for s in row], [s["last"] for row in slots for s in row], len(slots), len(slots[0]))
        except ValueError:
            return None
        width = sum(cols for cols, _ in parsed(rows[0])[0])
        cells, lasts, number = [], [], 0
        for row in rows:
            if (made := flat(row, width)) is None:
                return None
            cells += [number + k for k in made[0]]
            lasts += made[1]
            number += len(parsed(row)[0])
        return cells, lasts, len(rows), width

    for batch in batches:
        cells, lasts, row_ends, table_ends, page_ends, known, wanted = [], [], [0], [0], [0], [], []
        for page in batch.to_pylist():
            wanted.append(page is not None)
            for layout in page or ():
                made = None if layout is None else grid(layout)
                known.append(made is not None)
                if made is not None:
                    cells += made[0]
                    lasts += made[1]
                    row_ends += [row_ends[-1] + made[3] * (i + 1) for i in range(made[2])]
                table_ends.append(len(row_ends) - 1)
            page_ends.append(len(table_ends) - 1)
        slots = pa.StructArray.from_arrays([pa.array(cells, pa.int32()), pa.array(lasts, pa.bool_())], ["cell", "last"])
        rows = pa.ListArray.from_arrays(pa.array(row_ends, pa.int32()), slots)
        nulls = lambda there: pa.array([not x for x in there], pa.bool_())
        tables_ = pa.ListArray.from_arrays(pa.array(table_ends, pa.int32()), rows, mask=nulls(known))
        yield pa.ListArray.from_arrays(pa.array(page_ends, pa.int32()), tables_, mask=nulls(wanted))


@F.arrow_udf(_GRIDS)
def _expand_all(layouts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _grids_of(layouts)


def expand_spans(layouts: Column) -> Column:
    """Grids for an array of layouts; pages where no layout needs work send nothing to Python."""
    needed = F.exists(layouts, lambda t: t.isNotNull())
    return _expand_all(F.when(needed, layouts))


def fill_grid(table: Column, layout: Column, spans: Column) -> Column:
    """Grid of ``struct(id, value, is_header, last)``; null for a malformed table."""
    cell = lambda c, last: F.struct(
        c["id"].alias("id"), process_text(c["value"]).alias("value"), c["is_header"].alias("is_header"), last.alias("last")
    )
    complete = F.forall(
        table["table"],
        lambda r: F.forall(r, lambda c: c["id"].isNotNull() & c["value"].isNotNull() & c["is_header"].isNotNull()),
    )
    plain = F.transform(table["table"], lambda r: F.transform(r, lambda c: cell(c, F.lit(True))))
    slots = lambda flat: F.transform(spans, lambda r: F.transform(r, lambda s: cell(flat[s["cell"]], s["last"])))
    spanned = let(F.flatten(table["table"]), slots)
    return F.when(complete, F.when(layout.isNull(), plain).otherwise(spanned))


def cell_text(c: Column) -> Column:
    """Text of a cell, marked when it is a header."""
    return F.when(c["is_header"], F.concat(F.lit("[H] "), c["value"])).otherwise(c["value"])


def row_text(row: Column) -> Column:
    return F.array_join(F.transform(row, cell_text), " | ")


def grid_text(grid: Column) -> Column:
    return F.array_join(F.transform(grid, row_text), "\n")


def tables(parsed: DataFrame) -> DataFrame:
    """One row per table element: ``(page_id, title, table_key, pos, status, caption, grid)``."""
    only = F.filter("elements", lambda e: e["kind"] == "table")
    return parsed.transform(rows_of, ["page_id", "title"], only, "e").select(
        "page_id", "title", F.col("e.key").alias("table_key"), "e.pos", "e.status", "e.caption", "e.grid"
    )


def table_grid(parsed: DataFrame) -> DataFrame:
    """Dense grid, one row per slot: ``(page_id, table_key, row, col, cell_id, value, is_header, is_last)``."""
    rows = tables(parsed).where("status = 'ok'").transform(rows_of, ["page_id", "table_key"], "grid", "r", "row")
    return rows.transform(rows_of, ["page_id", "table_key", "row"], "r", "c", "col").select(
        "page_id", "table_key", "row", "col", F.col("c.id").alias("cell_id"), "c.value", "c.is_header", F.col("c.last").alias("is_last")
    )


def table_status(parsed: DataFrame) -> DataFrame:
    """``(page_id, table_key, status)`` of every table, malformed ones included."""
    return tables(parsed).select("page_id", "table_key", "status")


def cells(grid: DataFrame) -> DataFrame:
    """One row per cell; a cell that covers several slots stands at its last one."""
    text = F.when(F.col("is_header"), F.concat(F.lit("[H] "), F.col("value"))).otherwise(F.col("value"))
    return grid.where("is_last").select("page_id", "table_key", "cell_id", "row", "col", "is_header", text.alias("text"))


def table_rows(parsed: DataFrame) -> DataFrame:
    """Row texts, id rows and ``id;;;text`` rows, with a flag for rows made of headers only."""
    rows = tables(parsed).where("status = 'ok'").transform(rows_of, ["page_id", "table_key"], "grid", "r", "row")
    return rows.select(
        "page_id",
        "table_key",
        "row",
        row_text(F.col("r")).alias("text"),
        F.array_join(F.transform("r", lambda c: c["id"]), " | ").alias("ids"),
        F.array_join(F.transform("r", lambda c: F.concat_ws(";;;", c["id"], c["value"])), " | ").alias("joint"),
        F.forall("r", lambda c: c["is_header"]).alias("is_header_row"),
    )


def table_text(parsed: DataFrame) -> DataFrame:
    """Whole-table texts: rows joined by a line break."""
    ok = tables(parsed).where("status = 'ok'")
    return ok.select("page_id", "table_key", "caption", grid_text(F.col("grid")).alias("text"))


def _header_runs(line: Column) -> Column:
    """``struct(headers, before, first)`` of a row or column: its headers in order, the last one before each place, and
    for each header the first one of its run of neighbours."""
    numbered = F.transform(line, lambda c, i: F.struct(i.alias("at"), c["id"].alias("id"), cell_text(c).alias("text"), c["is_header"].alias("h")))
    packed = lambda headers, size: F.struct(
        F.transform(headers, lambda h: F.struct(h["id"].alias("id"), h["text"].alias("text"))).alias("headers"),
        last_before(F.transform(headers, lambda h: h["at"]), size).alias("before"),
        run_starts(headers, lambda h, last: h["at"] != last["at"] + 1).alias("first"),
    )
    return let(F.filter(numbered, lambda c: c["h"]), F.size(line), packed)


def _nearest_run(line: Column, at: Column) -> Column:
    """The last run of headers before ``at``, nearest header first: a slice of the headers of its line."""
    run = lambda k: F.when(k >= 0, F.reverse(piece(line["headers"], F.get(line["first"], k), k - F.get(line["first"], k) + 1))).otherwise(F.array())
    return let(F.coalesce(F.get(line["before"], at), F.lit(-1)), run)


def header_context(grid: Column, wanted: Column | None = None) -> Column:
    """Per cell (only those with ``wanted`` ids, if given) ``struct(id, row, col, is_header, text, row_headers,
    col_headers)``, computed within the table from one pass over each row and column."""
    by_row = F.transform(grid, _header_runs)
    width = F.sequence(F.lit(0), F.size(grid[0]) - 1)
    by_col = F.transform(width, lambda j: _header_runs(F.transform(grid, lambda r: r[j])))
    packed = F.struct(by_row.alias("by_row"), by_col.alias("by_col"))
    # evaluate the header lists once per table: a one-element array binds them to a lambda variable
    return F.flatten(F.transform(F.array(packed), lambda p: _contexts(grid, p, wanted)))


def _contexts(grid: Column, p: Column, wanted: Column | None) -> Column:
    asked = lambda c: c["last"] if wanted is None else c["last"] & F.array_contains(wanted, c["id"])
    placed = lambda r, i: F.transform(r, lambda c, j: F.struct(c.alias("c"), i.alias("i"), j.alias("j")))
    slots = F.filter(F.flatten(F.transform(grid, placed)), lambda s: asked(s["c"]))
    return F.transform(
        slots,
        lambda s: F.struct(
            s["c"]["id"].alias("id"), s["i"].alias("row"), s["j"].alias("col"), s["c"]["is_header"].alias("is_header"), cell_text(s["c"]).alias("text"),
            _nearest_run(p["by_row"][s["i"]], s["j"]).alias("row_headers"), _nearest_run(p["by_col"][s["j"]], s["i"]).alias("col_headers"),
            s["c"]["last"].alias("last"),
        ),
    )


def _cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of a batch of tables, some at a time: a cell's headers are given as places among all slots until then."""
    for batch in batches:
        rows = pc.list_flatten(batch.column("grid"))
        slots = pc.list_flatten(rows)
        ids, is_header, last = (slots.field(slots.type.get_field_index(name)) for name in ("id", "is_header", "last"))
        marked = pc.binary_join_element_wise(pa.scalar("[H] "), slots.field(slots.type.get_field_index("value")), "")
        texts = pc.if_else(is_header, marked, slots.field(slots.type.get_field_index("value")))
        headers = pa.StructArray.from_arrays([ids, marked], ["id", "text"])
        heads, lasts = is_header.to_pylist(), last.to_pylist()
        heights, widths = pc.list_value_length(batch.column("grid")).to_pylist(), pc.list_value_length(rows).to_pylist()

        def built(found: list, left: tuple[list, list], over: tuple[list, list]) -> pa.RecordBatch:
            table, slot, row, col = (pa.array(x, pa.int32()) for x in zip(*found))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), headers.take(pa.array(places, pa.int32()))) for places, ends in (left, over)]
            own = {name: batch.column(name).take(table) for name in ("page_id", "title", "table_key")}
            return pa.RecordBatch.from_pydict(
                own | {"cell_id": ids.take(slot), "row": row, "col": col, "is_header": is_header.take(slot), "text": texts.take(slot)}
                | {"sections": batch.column("sections").take(table), "row_headers": lists[0], "col_headers": lists[1]}
            )

        found, left, over = [], ([], [0]), ([], [0])
        base = first_row = 0
        for table, height in enumerate(heights):
            width = widths[first_row] if height else 0
            # for each column the last run of headers so far, as its first and its last row
            runs = [(0, -1)] * width
            for i in range(height):
                start, end = 0, -1
                for j in range(width):
                    at = base + i * width + j
                    if lasts[at]:
                        found.append((table, at, i, j))
                        above = base + j
                        left[0].extend(range(base + i * width + end, base + i * width + start - 1, -1))
                        over[0].extend(range(above + runs[j][1] * width, above + (runs[j][0] - 1) * width, -width))
                        left[1].append(len(left[0]))
                        over[1].append(len(over[0]))
                    if heads[at]:
                        start, end = start if end == j - 1 and end >= start else j, j
                        runs[j] = (runs[j][0] if runs[j][1] == i - 1 and i else i, i)
                    if len(found) >= CELLS or len(left[0]) + len(over[0]) >= HEADERS:
                        if found:
                            yield built(found, left, over)
                        found, left, over = [], ([], [0]), ([], [0])
            base += height * width
            first_row += height
        if found:
            yield built(found, left, over)


def cell_context(parsed: DataFrame) -> DataFrame:
    """Every cell with its row headers, column headers and the sections around its table.

    All headers of all cells are quadratic in the length of a table, so they are never put together: a table is one row
    that a task reads cell by cell, and what it hands on holds a bounded number of headers.
    """
    only = F.filter("elements", lambda e: (e["kind"] == "table") & (e["status"] == "ok"))
    around = lambda o, e: F.transform(section_chain(o, e["pos"]), lambda s: F.struct(s["key"].alias("id"), s["text"].alias("text")))
    placed = lambda o, found: F.transform(found, lambda e: F.struct(e["key"].alias("table_key"), around(o, e).alias("sections"), e["grid"].alias("grid")))
    whole = parsed.transform(rows_of, ["page_id", "title"], let(outline(), only, placed), "e").select("page_id", "title", "e.*")
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema if f.name in ("page_id", "title", "table_key"))
    return whole.mapInArrow(
        _cell_rows,
        f"{own}, cell_id string, row int, col int, is_header boolean, text string, sections {whole.schema['sections'].dataType.simpleString()}, "
        "row_headers array<struct<id:string,text:string>>, col_headers array<struct<id:string,text:string>>",
    )


def table_of_cell(cells_: DataFrame, ids: DataFrame) -> DataFrame:
    """Table of a cell id ``(page_id, local_id)``: by membership, and by the number in the id."""
    known = cells_.select("page_id", F.col("cell_id").alias("local_id"), "table_key")
    number = table_no(F.concat(F.lit("_"), F.col("local_id")))
    return ids.join(known, ["page_id", "local_id"], "left").withColumn(
        "table_by_number", F.when(number.isNotNull(), F.concat(F.lit("table_"), number.cast("string")))
    )
