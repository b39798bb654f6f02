"""File sources and JSON columns.

* S2 sheets: each CSV file is one sheet.  Files are read as lines by many tasks, whatever their size; a
  line's place comes from its block (``_metadata.file_block_start``) and its order there, and fields are cut by
  one regular expression, so no Python runs.  A file in which a quoted field spans lines is put together first (one task a file).  ``.xlsx``
  workbooks are parsed per file in ``mapInPandas`` when openpyxl is installed.  Sheets that cannot be
  read are listed in a report.
* S3 task lists and S4 feeds are JSON/XML read with explicit schemas (type
  inference turned a title "T1" into a timestamp), in an order that does not depend on how
  Spark packs files into tasks.
* S5/S6/S8 are column functions (``from_json``/``to_json``/``regexp_extract``).
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# A row of a sheet: its texts by column, beside the texts of the header row.
ROWS_SCHEMA = T.StructType([
    T.StructField("source_file", T.StringType()), T.StructField("sheet", T.StringType()),
    T.StructField("row_no", T.LongType()), T.StructField("headers", T.ArrayType(T.StringType())),
    T.StructField("values", T.ArrayType(T.StringType())),
])
REPORT_COLUMNS = ["source_file", "sheet", "error"]

try:  # optional: real Excel workbooks
    import openpyxl  # noqa: F401
    HAVE_OPENPYXL = True
except Exception:  # pragma: no cover - not installed here
    HAVE_OPENPYXL = False

# --- S2: CSV sheets ---------------------------------------------------------

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_FIELD = rf'{_QUOTED}[^,]*+|[^,]*+'
#: A line whose last field opens a quote that the line does not close.
_OPEN = rf'\A(?:,(?:{_QUOTED}[^,]*+|(?!")[^,]*+))*+,"[^"]*+(?:""[^"]*+)*+\z'
_FIELD_IN_TEXT = rf'(?:{_QUOTED}[^,\n]*+|[^,\n]*+)'
_RECORD = rf'\n({_FIELD_IN_TEXT}(?:,{_FIELD_IN_TEXT})*+)'


def _unquoted(x: Column) -> Column:
    bare = F.regexp_replace(x, r'(?s)\A"([^"]*+(?:""[^"]*+)*+)"(.*)\z', "$1$2")
    return F.when(x.startswith('"'), F.replace(bare, F.lit('""'), F.lit('"'))).otherwise(x)


def csv_fields(record: str | Column) -> Column:
    """The fields of one CSV record as an array: quotes count at the start of a field only, ``""`` is a quote."""
    c = F.col(record) if isinstance(record, str) else record
    raw = F.regexp_extract_all(F.concat(F.lit(","), c), F.lit(f",({_FIELD})"), F.lit(1))
    return F.transform(raw, _unquoted)


def _stripped(texts: Column) -> Column:
    return F.transform(texts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def _file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, block, mid, line): lines of all files; (block, mid) orders the lines of a file."""
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return spark.read.text(path).select(
        decoded.alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"), F.col("value").alias("line"))


def _sheet_name(source_file: str | Column = "source_file") -> Column:
    return F.regexp_replace(F.regexp_extract(source_file, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def csv_sheets(spark: SparkSession, path: str) -> DataFrame:
    """One row per CSV file: (source_file, sheet, headers, spans, error); ``spans``: a quoted field runs over lines."""
    lines = _file_lines(spark, path)
    line = F.concat(F.lit(","), F.col("line"))
    facts = lines.groupBy("source_file").agg(
        F.min_by("line", F.struct("block", "mid")).alias("first"),
        F.max(F.when(F.col("line").contains('"'), line.rlike(_OPEN)).otherwise(F.lit(False))).alias("spans"),
        F.max(~F.is_valid_utf8("line")).alias("broken"))
    first = F.regexp_replace("first", "^\ufeff", "")
    return facts.select("source_file", _sheet_name().alias("sheet"),
                        _stripped(csv_fields(first)).alias("headers"), "spans",
                        F.when(F.col("broken"), F.lit("not UTF-8 text")).alias("error"))


def csv_rows(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    """Rows of every CSV file under ``path`` beside their headers (``ROWS_SCHEMA``).

    ``row_no`` is the byte offset of the line's block in the file plus its place in the block: unique in the sheet and in
    file order; in a file of one block it is the line's number, the header's being 0.  A window numbers the lines
    of one block (``spark.sql.files.maxPartitionBytes`` at most), so no task holds a whole file.
    """
    own = Window.partitionBy("source_file", "block").orderBy("mid")
    sheets = csv_sheets(spark, path).drop("sheet")
    numbered = _file_lines(spark, path).withColumn("place", F.row_number().over(own) - 1)
    if on_error == "fail":
        name = F.concat(F.lit("Failed to read "), "source_file", F.lit(": "), "error")
        sheets = sheets.filter(F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(name).cast("boolean")))
    else:
        sheets = sheets.filter(F.col("error").isNull())
    both = numbered.join(sheets.drop("error"), "source_file")
    single = both.filter(~F.col("spans")).select(
        "source_file", (F.col("block") + F.col("place")).alias("row_no"), "headers", F.col("line").alias("record"))
    # files whose records run over lines: the text again, cut at the line ends outside quotes
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "mid", "line"))), lambda x: x["line"]), "\n")
    spanning = (both.filter("spans").groupBy("source_file").agg(text.alias("text"))
                .select("source_file", F.regexp_extract_all(F.concat(F.lit("\n"), "text"), F.lit(_RECORD), F.lit(1)).alias("records"))
                .select("source_file", _stripped(csv_fields(F.regexp_replace(F.get("records", F.lit(0)), "^\ufeff", ""))).alias("headers"), F.posexplode("records").alias("row_no", "record"))
                .withColumn("row_no", F.col("row_no").cast("long")))
    rows = single.unionByName(spanning.select(single.columns)).filter("row_no > 0")
    return rows.select("source_file", _sheet_name().alias("sheet"), "row_no", "headers", csv_fields("record").alias("values"))


# --- S2: workbooks ----------------------------------------------------------

WORKBOOKS = "*.xls[xm]"
_BOOK_SCHEMA = T.StructType([*ROWS_SCHEMA.fields, T.StructField("error", T.StringType())])


def _text(v) -> str | None:
    return None if v is None else str(v)


def _book_rows(on_error: str):
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.name for f in _BOOK_SCHEMA.fields]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                if not HAVE_OPENPYXL:
                    raise ImportError(f"{os.path.basename(path)}: reading workbooks needs openpyxl on the executors")
                import openpyxl as ox
                try:
                    book = ox.load_workbook(io.BytesIO(content), read_only=True, data_only=True)
                except Exception as e:  # noqa: BLE001
                    if on_error == "fail":
                        raise ValueError(f"Failed to read {os.path.basename(path)}: {e}") from e
                    yield pd.DataFrame([(path, None, None, None, None, str(e))], columns=names)
                    continue
                for ws in book.worksheets:  # a sheet that cannot be read is reported, the others go on
                    try:
                        records = [[_text(v) for v in r] for r in ws.iter_rows(values_only=True)]
                    except Exception as e:  # noqa: BLE001
                        yield pd.DataFrame([(path, ws.title, None, None, None, str(e))], columns=names)
                        continue
                    headers = [(h or "").strip() for h in records[0]] if records else []
                    yield pd.DataFrame([(path, ws.title, None, headers, None, None)] + [
                        (path, ws.title, k, headers, r, None) for k, r in enumerate(records[1:], start=1)], columns=names)
    return parse


def _books(spark: SparkSession, path: str, on_error: str) -> DataFrame:
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInPandas(_book_rows(on_error), _BOOK_SCHEMA)


def _is_workbook(path: str) -> bool:
    return path.lower().endswith((".xlsx", ".xlsm"))


def read_sheets(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    """The rows of every sheet of every file under ``path`` (glob allowed), as ``ROWS_SCHEMA``.

    A path that ends in ``.xlsx``/``.xlsm`` names workbooks, any other one CSV files.
    ``on_error='fail'`` fails the job on an unreadable file, as an upload of a
    corrupt file fails; ``'skip'`` drops that file and keeps the others (``sheet_report`` lists it).  A bad sheet
    of a readable workbook is skipped in either case, as an upload skips it.
    ``source_file`` is the full path, so equal file names in two folders stay apart.
    """
    if _is_workbook(path):
        return _books(spark, path, on_error).filter("error is null and row_no is not null").drop("error")
    return csv_rows(spark, path, on_error)


def sheet_report(spark: SparkSession, path: str) -> DataFrame:
    """Every sheet found, with its error or NULL: (source_file, sheet, error).  An unreadable workbook has a NULL sheet."""
    if _is_workbook(path):
        return _books(spark, path, "skip").filter("row_no is null").select(REPORT_COLUMNS)
    return csv_sheets(spark, path).select(REPORT_COLUMNS)


TASK_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in (
    "name", "category", "topic", "difficulty", "platform", "problem_link", "resource_link", "scheduled_date")])
IMPORT_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("mode", T.StringType()),
    T.StructField("filename", T.StringType()), T.StructField("filenames", T.ArrayType(T.StringType())),
    T.StructField("tasks", T.ArrayType(TASK_SCHEMA)),
])


def _placed(df: DataFrame, order: str = "time") -> DataFrame:
    """Adds ``seq``, the source order of each row of a file scan: a comparable struct of the file's time, its path, the
    block in the file and the row's place in the block.  ``order='path'`` leaves the time out.

    A window numbers the rows of one block (``spark.sql.files.maxPartitionBytes`` at most), so the order is the same
    however files are packed into tasks and whatever is recomputed.
    """
    own = Window.partitionBy("_path", "_block").orderBy("_mid")
    time = [F.col("_time").alias("time")] if order == "time" else []
    seq = F.struct(*time, F.col("_path").alias("path"), F.col("_block").alias("block"), F.row_number().over(own).alias("row"))
    return (df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
                      F.col("_metadata.file_modification_time").alias("_time"), F.monotonically_increasing_id().alias("_mid"))
            .withColumn("seq", seq).drop("_path", "_block", "_time", "_mid"))


def read_import_requests(spark: SparkSession, path: str, order: str = "time") -> DataFrame:
    """S3: import requests (one JSON object per line): user_id, mode, filename, filenames, tasks and their order ``seq``."""
    req = _placed(spark.read.schema(IMPORT_SCHEMA).json(path), order)
    name = F.coalesce("filename", F.lit("import"))
    return req.select("user_id", F.coalesce("mode", F.lit("add")).alias("mode"), name.alias("filename"),
                      F.when(F.size("filenames") > 0, F.col("filenames")).otherwise(F.array(name)).alias("filenames"), "tasks", "seq")


def request_tasks(requests: DataFrame) -> DataFrame:
    """S3: one row per task of the requests; ``seq`` orders all tasks of a user over any number of requests,
    ``pos`` those of one request."""
    t = requests.select("user_id", "mode", "filename", F.col("seq").alias("_at"), F.posexplode("tasks").alias("pos", "t"))
    return (t.select("user_id", "mode", "filename", "pos", F.struct(F.col("_at").alias("request"), "pos").alias("seq"), "t.*")
            .withColumn("scheduled_date", F.try_to_date(F.col("scheduled_date"), "yyyy-MM-dd")))


def request_files(requests: DataFrame) -> DataFrame:
    """S3 for the ledger (I3): one (user_id, filename) row per file that a request names, or its own name."""
    return requests.select("user_id", F.explode("filenames").alias("filename"), "seq")


def read_task_lists(spark: SparkSession, path: str, order: str = "time") -> DataFrame:
    """S3: the tasks of all import requests under ``path`` in first-wins order (``seq``)."""
    return request_tasks(read_import_requests(spark, path, order))


ITEM_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("score", T.LongType()),
    T.StructField("tag_list", T.ArrayType(T.StringType())),
    T.StructField("public_reactions_count", T.LongType()),
])
# What the download knows of an item: its run, kind and source, and the queried tag's place. Fields of the
# item, or folders ``run=.../kind=.../source=.../tag_no=...`` of the landed files.
FEED_SCHEMA = T.StructType([*ITEM_SCHEMA.fields, T.StructField("run", T.StringType()), T.StructField("kind", T.StringType()),
                            T.StructField("source", T.StringType()), T.StructField("tag_no", T.IntegerType())])
RSS_SCHEMA = T.StructType([T.StructField("title", T.StringType()), T.StructField("link", T.StringType())])


def _item_columns() -> list[Column]:
    return [F.col("url"), F.col("title"), F.coalesce("score", "public_reactions_count", F.lit(0)).alias("score"),
            F.try_element_at("tag_list", F.lit(1)).alias("tag_hint")]


def read_json_feed(spark: SparkSession, path: str, source: str, multi_line: bool = True, order: str = "path") -> DataFrame:
    """Landed JSON feed items of one source -> ``articles`` rows, ``seq`` in feed order.
    ``multi_line``: each file is one JSON array (an API response); otherwise
    one item per line.  What cannot be parsed is dropped, the rest of the source stays."""
    df = _placed(spark.read.schema(ITEM_SCHEMA).option("multiLine", str(multi_line).lower()).json(path), order)
    return df.filter(F.coalesce("title", "url").isNotNull()).select("seq", F.lit(source).alias("source"), *_item_columns())


def read_feeds(spark: SparkSession, path: str, order: str = "path") -> DataFrame:
    """Landed items of all sources and runs, one per line -> ``articles`` rows with run, kind, source and the queried tag's place
    (``tag_no``, from 0), ``seq`` in feed order, ready for ``feed_items``.  Lines that cannot be parsed are dropped."""
    df = _placed(spark.read.schema(FEED_SCHEMA).json(path), order)
    return df.filter(F.coalesce("title", "url").isNotNull()).select("seq", "run", "kind", "source", "tag_no", *_item_columns())


def read_rss(spark: SparkSession, path: str, source: str, order: str = "path") -> DataFrame:
    """RSS ``<item>`` elements with an explicit schema, ``seq`` in feed order."""
    df = _placed(spark.read.format("xml").option("rowTag", "item").schema(RSS_SCHEMA).load(path), order)
    return df.select("seq", F.lit(source).alias("source"),
                     F.col("link").alias("url"), "title", F.lit(0).cast("long").alias("score"),
                     F.lit(None).cast("string").alias("tag_hint"))


ARTICLE_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("title", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("score", T.LongType()),
    T.StructField("tag", T.StringType()),
]))


def decode_articles(col: str | Column) -> Column:
    """JSON array text -> array of article structs; bad JSON -> empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.from_json(c, ARTICLE_SCHEMA, {"mode": "PERMISSIVE"}),
                      F.array().cast(ARTICLE_SCHEMA))


def encode_articles(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Per group, the ordered article list as one JSON array text."""
    arr = F.array_sort(F.collect_list(F.struct(*[F.col(o) for o in order],
                                               F.struct("title", "url", "source", "score", "tag").alias("a"))))
    return df.groupBy(*group).agg(F.to_json(F.transform(arr, lambda x: x["a"])).alias("articles_json"))


RESOURCE_JSON = T.StructType([T.StructField(k, T.StringType()) for k in ("youtube", "article", "practice")])


def first_json_block(col: str | Column) -> Column:
    """The first ``{...}`` block (non-greedy, across lines) parsed into
    ``{youtube, article, practice}``; no block or bad JSON -> NULL fields."""
    c = F.col(col) if isinstance(col, str) else col
    block = F.regexp_extract(c, r"(?s)(\{.*?\})", 1)
    return F.from_json(F.when(block != "", block), RESOURCE_JSON, {"mode": "PERMISSIVE"})


def rows_as_json(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Each row as one JSON object text, after the columns of ``keep``."""
    return df.select(*keep, F.to_json(F.struct(*df.columns)).alias("json"))
