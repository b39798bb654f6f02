"""Messy spreadsheets of differing layouts -> one clean task table.

Input are the *rows* of any number of sheets, ``(source_file, sheet, row_no, headers, values)``:
``values`` are the row's texts by column, ``headers`` the texts of the sheet's header row.  Because
every sheet is just rows of that one schema, files and sheets of any layout are normalised by one plan.

Plan shape.  All decisions of a sheet (header mapping N1, layout N2, category N7) are expressions over its
header array, evaluated once per sheet on the distinct headers, and joined to the rows (AQE measures the
sheets and picks the join; a crowded sheet is split by its skew handling).  All tasks of a row (one, or in a
day grid one per filled cell) are an array built from its own values: cells are neither exploded nor put together, and no
window or aggregate holds a row's cells or a sheet's rows.

Tables in the long form ``(source_file, sheet, row_no, col_no, header, value)``, one row per cell, are taken
too; ``rows_of_cells`` puts their rows together first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as RU

SHEET_KEY = ["source_file", "sheet"]
ROW_KEY = ["source_file", "sheet", "row_no"]
FIELDS = [f for f, _ in RU.HEADER_ALIASES]
TASK_COLUMNS = ["source_file", "sheet", "row_no", "col_no", "name", "category", "topic", "difficulty",
                "platform", "problem_link", "resource_link", "scheduled_date", "status"]

# N10 fixed format list, tried in order (pandas reads 01/02/2026 month first,
# 13/02/2026 day first; both are covered by trying M/d before d/M).
DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy", "d/M/yyyy", "MMMM d yyyy", "MMM d yyyy",
                "d MMMM yyyy", "yyyy-M-d", "yyyy/M/d", "M-d-yyyy", "d-M-yyyy", "MMMM d, yyyy", "MMM d, yyyy",
                "d MMM yyyy", "M/d/yy", "yyyyMMdd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS"]


# --- cell-level helpers ----------------------------------------------------

def is_blank(v: Column) -> Column:
    """NULL, empty, or 'nan'/'none' in any case after trimming."""
    return v.isNull() | F.lower(F.trim(v)).isin(*RU.BLANK_VALUES)


def clean(v: Column) -> Column:
    """Trimmed value, '' for blanks."""
    return F.when(is_blank(v), F.lit("")).otherwise(F.trim(v))


def repair_link(v: Column) -> Column:
    """Not starting with http but containing '.' -> https:// + link
    without leading slashes."""
    return (F.when((v != "") & ~v.startswith("http") & v.contains("."),
                   F.concat(F.lit("https://"), F.regexp_replace(v, "^/+", "")))
            .otherwise(v))


def platform_of(link: Column) -> Column:
    """First platform key contained in the lower-cased link, else Custom."""
    return RU.first_label(F.coalesce(link, F.lit("")), RU.PLATFORM_RULES, RU.DEFAULT_PLATFORM)


def _shape(fmt: str) -> str:
    """A regular expression that every text of a date format matches."""
    out = ""
    for token, _ in re.findall(r"('[^']*'|M{3,}|([A-Za-z])\2*|.)", fmt):
        if token[0] == "'":
            out += re.escape(token[1:-1])
        elif token.startswith("MMM"):
            out += r"[\p{L}.]+"
        else:
            out += r"[+-]?\d+" if token.isalpha() else re.escape(token)
    return rf"\A{out}\z"


def parse_date(v: Column) -> Column:
    """First format of ``DATE_FORMATS`` that parses, else NULL.  A text is only parsed by formats whose
    shape it has: a parse that fails costs an exception."""
    t = F.trim(v)
    return F.coalesce(*[F.when(t.rlike(_shape(f)), F.try_to_date(t, f)) for f in DATE_FORMATS])


def difficulty_named(v: Column) -> Column:
    """N11, named-column layout: easy/medium/hard capitalised,
    must/high/critical -> High, anything else -> Medium."""
    lv = F.lower(v)
    return (F.when(lv.isin(*RU.LAYOUT_A_DIFFICULTY_KEEP), F.initcap(lv))
            .when(lv.isin(*RU.HIGH_PRIORITY_WORDS), "High").otherwise("Medium"))


def difficulty_topic_list(v: Column) -> Column:
    """N11, topic-list layout: must/high/critical -> High, optional/low -> Low, else Medium."""
    lv = F.lower(v)
    return (F.when(lv.isin(*RU.HIGH_PRIORITY_WORDS), "High")
            .when(lv.isin(*RU.LOW_PRIORITY_WORDS), "Low").otherwise("Medium"))


def header_category(h_low: Column, whole_word: bool = False) -> Column:
    """N7 header part for one header: Aptitude, Verbal or NULL."""
    out = None
    for keys, label in RU.HEADER_CATEGORY_RULES:
        cond = RU.contains_any(h_low, keys, lowered=True, whole_word=whole_word)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def day_grid_category(h_low: Column, whole_word: bool = False) -> Column:
    """Category of a day-grid column from its header, else N7 on the
    header text alone, else DSA."""
    by_header = RU.first_label(h_low, RU.DAY_GRID_HEADER_RULES, F.lit(None).cast("string"), lowered=True,
                               whole_word=whole_word)
    return F.coalesce(by_header, RU.sheet_category(h_low, whole_word), F.lit(RU.DEFAULT_CATEGORY))


# --- rows --------------------------------------------------------------------

def rows_of_cells(cells: DataFrame) -> DataFrame:
    """Rows of a long table of cells; a row without a cell for a column of its sheet has NULL there."""
    width = F.max("col_no").alias("_w")
    entries = F.map_from_entries(F.collect_set(F.struct("col_no", "header")))
    sheets = (cells.groupBy(*SHEET_KEY).agg(width, entries.alias("_m"))
              .select(*SHEET_KEY, F.transform(F.sequence(F.lit(1), "_w"), lambda k: F.col("_m")[k]).alias("headers")))
    values = F.map_from_entries(F.collect_list(F.struct("col_no", "value")))
    rows = cells.groupBy(*ROW_KEY).agg(values.alias("_v")).join(sheets, SHEET_KEY)
    return rows.select(*ROW_KEY, "headers", F.transform("headers", lambda _, k: F.col("_v")[k + 1]).alias("values"))


def _rows(table: DataFrame) -> DataFrame:
    return table if "values" in table.columns else rows_of_cells(table)


# --- per-sheet decisions ---------------------------------------------------

def sheet_headers(table: DataFrame) -> DataFrame:
    """One row per sheet that has a row: (source_file, sheet, headers)."""
    return _rows(table).select(*SHEET_KEY, "headers").distinct()


def _found(position: Column) -> Column:
    return F.when(position > 0, position)


def _first_in(words: list[str]) -> Column:
    """First column, in sheet order, whose folded header is one of ``words``."""
    return _found(F.array_position(F.transform("_hl", lambda h: h.isin(*words)), True)).cast("int")


def sheet_decisions(headers: DataFrame, whole_word: bool = False) -> DataFrame:
    """N1 + N2 + N7 from the header array alone: adds the mapped column of every field (``map_<field>``), the
    topic-list and day-grid columns, the layout and the sheet category; ``_h`` and ``_hl`` are the trimmed and
    the folded headers.

    Field mapping: the first alias in list order that a header equals wins;
    among headers equal after folding the last column wins.  Topic-list columns: first in sheet order.
    """
    d = (headers.withColumn("_h", F.transform("headers", lambda h: F.trim(F.coalesce(h, F.lit("")))))
         .withColumn("_hl", F.transform("_h", F.lower)).withColumn("_back", F.reverse("_hl")))

    def last_of(alias: str) -> Column:
        at = F.array_position("_back", alias)
        return F.when(at > 0, (F.size("_hl") - at + 1).cast("int"))

    day = F.filter("_h", lambda h: (F.lower(h) == "day") | F.lower(h).startswith("day "))
    hcat = F.filter(F.transform("_hl", lambda h: header_category(h, whole_word)), lambda c: c.isNotNull())
    d = d.select("*", *[F.coalesce(*[last_of(a) for a in aliases]).alias(f"map_{field}") for field, aliases in RU.HEADER_ALIASES],
                 _first_in(RU.TOPIC_LIST_TOPIC_HEADERS).alias("topic_col"), _first_in(RU.TOPIC_LIST_LINK_HEADERS).alias("link_col"),
                 _first_in(RU.TOPIC_LIST_PRIORITY_HEADERS).alias("priority_col"), F.get(day, F.lit(0)).alias("day_header"),
                 F.coalesce(RU.sheet_category(F.col("sheet"), whole_word), F.get(hcat, F.lit(0)),
                            F.lit(RU.DEFAULT_CATEGORY)).alias("category"))
    layout = (F.when(F.col("map_name").isNotNull(), "A").when(F.col("topic_col").isNotNull(), "B")
              .when(F.col("day_header").isNotNull(), "C").otherwise("D"))
    return d.withColumn("layout", layout).drop("_back")


def header_map(headers: DataFrame) -> DataFrame:
    """One row per (sheet, mapped field) with its column and header."""
    d = sheet_decisions(headers)
    stack = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"map_{f}").alias("col_no")) for f in FIELDS]))
    m = d.select(*SHEET_KEY, "_h", stack).filter(F.col("col_no").isNotNull())
    return m.select(*SHEET_KEY, "col_no", "field", F.get("_h", F.col("col_no") - 1).alias("header"))


def sheet_layouts(headers: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """N2 + N7: one row per sheet with its layout (A named, B topic list,
    C day grid, D unknown), the special columns of B and C and the category."""
    d = sheet_decisions(headers)
    return d.select(*SHEET_KEY, "layout", "category", "topic_col", "link_col", "priority_col", "day_header")


# --- all layouts in one projection -------------------------------------------

def normalise(table: DataFrame, use_category_column: bool = False, whole_word: bool = False) -> DataFrame:
    """N3-N6 + N13: every sheet's rows as one task table, status Pending.
    ``use_category_column`` (Q12) and ``whole_word`` (Q16) switch the kept
    quirks off.

    A, B and D sheets give one task per row, day grids (C) one per filled cell beside a filled day."""
    rows = _rows(table).select(*ROW_KEY, "headers", "values")
    d = sheet_decisions(sheet_headers(rows), whole_word)
    d = d.withColumn("_cats", F.when(F.col("layout") == "C", F.transform("_hl", lambda h: day_grid_category(h, whole_word))))
    d = d.drop("headers", "_hl").withColumnsRenamed({k: f"_{k}" for k in SHEET_KEY})
    same = [rows[k].eqNullSafe(d[f"_{k}"]) for k in SHEET_KEY]
    c = rows.drop("headers").join(d, same[0] & same[1]).drop(*[f"_{k}" for k in SHEET_KEY])
    lay = F.col("layout")

    def at(col_no) -> Column:
        return F.get("values", (F.col(col_no) if isinstance(col_no, str) else col_no) - 1)

    filled = F.filter(F.transform(F.slice("values", F.lit(1), F.size("_h")), lambda v, k: F.struct(k.alias("k"), v.alias("v"))),
                      lambda x: ~is_blank(x["v"]))
    c = c.select(
        *ROW_KEY, "layout", "category", "_h", "_cats", *[at(f"map_{f}").alias(f"f_{f}") for f in FIELDS],
        at("topic_col").alias("b_topic"), at("link_col").alias("b_link"), at("priority_col").alias("b_prio"),
        F.when(lay == "C", at(_found(F.array_position("_h", F.col("day_header"))))).alias("c_day"),
        F.when(lay == "C", F.filter(filled, lambda x: F.get("_h", x["k"]) != F.col("day_header"))).alias("c_cells"),
        F.when(lay == "D", F.transform(filled, lambda x: F.trim(x["v"]))).alias("d_vals"))

    a_name = F.trim(F.coalesce("f_name", F.lit("")))
    a_plink = repair_link(clean(F.col("f_problem_link")))
    a_rlink = repair_link(clean(F.col("f_resource_link")))
    a_platform = clean(F.col("f_platform"))
    a_category = F.col("category")
    if use_category_column:  # Q12 option: a mapped category column overrides the sheet's
        a_category = F.when(clean(F.col("f_category")) != "", clean(F.col("f_category"))).otherwise(a_category)
    b_name = F.trim(F.coalesce("b_topic", F.lit("")))
    b_link = repair_link(clean(F.col("b_link")))
    d_link = F.coalesce(F.get(F.filter("d_vals", lambda v: v.startswith("http")), F.lit(0)), F.lit(""))
    none_date = F.lit(None).cast("date")

    def task(name, category, topic, difficulty, platform, problem_link, resource_link, date=none_date, col_no=F.lit(None).cast("int")):
        text = (name, category, topic, difficulty, platform, problem_link, resource_link)
        names = ("name", "category", "topic", "difficulty", "platform", "problem_link", "resource_link")
        return F.struct(col_no.cast("int").alias("col_no"), *[v.cast("string").alias(n) for n, v in zip(names, text)],
                        date.alias("scheduled_date"))

    one = (F.when(lay == "A", F.when(~is_blank(a_name), F.array(task(
               a_name, a_category, clean(F.col("f_topic")), difficulty_named(clean(F.col("f_difficulty"))),
               F.when(a_platform != "", a_platform).otherwise(platform_of(a_plink)), a_plink, a_rlink,
               F.when(is_blank(F.col("f_date")), none_date).otherwise(parse_date(F.col("f_date")))))))
           .when(lay == "B", F.when(~is_blank(b_name), F.array(task(
               b_name, F.col("category"), b_name, difficulty_topic_list(F.trim(F.coalesce("b_prio", F.lit("")))),
               platform_of(b_link), b_link, b_link))))
           .when(lay == "D", F.when(F.size("d_vals") > 0, F.array(task(
               F.get("d_vals", F.lit(0)), F.col("category"), F.coalesce(F.get("d_vals", F.lit(1)), F.lit("")), F.lit("Medium"),
               platform_of(d_link), d_link, d_link))))
           .otherwise(F.when(~is_blank(F.col("c_day")), F.transform("c_cells", lambda x: task(
               F.trim(x["v"]), F.get("_cats", x["k"]), F.get("_h", x["k"]), F.lit("Medium"),
               F.lit(RU.DEFAULT_PLATFORM), F.lit(""), F.lit(""), col_no=x["k"] + 1)))))
    return (c.select(*ROW_KEY, F.inline(one)).withColumn("status", F.lit("Pending")).select(*TASK_COLUMNS))


def upload_summary(table: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per file, the sheet list ``file::sheet`` (sorted, file without its folder) and the task count."""
    name = F.regexp_replace("source_file", "^.*/", "")
    sheets = (table.select(*SHEET_KEY).distinct().groupBy("source_file")
              .agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("::", name, "sheet"))), ",")
                   .alias("sheets")))
    counts = tasks.groupBy("source_file").agg(F.count(F.lit(1)).alias("tasks"))
    return sheets.join(counts, "source_file", "left").fillna(0, subset=["tasks"])
