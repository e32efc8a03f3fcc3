"""Delimited text and JSON documents as records, with every unreadable piece told by its line.

files: (path, content), a whole text in a row; `files()` reads them. Clean tables of any size are
better read with `spark.read.csv`, which splits them; what is here reads dialects that it does not:
quotes that open within a cell, carriage returns as line ends, and errors by line.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

ROW = [T.StructField("line", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())]
#: Rows, and about how many characters of them, that a Python worker hands on together.
ROWS, CHARACTERS = 10_000, 2_000_000


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the text files under path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def _pieces(delimiter: str) -> re.Pattern:
    d = re.escape(delimiter)
    return re.compile(rf'"(?P<quoted>(?:[^"]|"")*)(?P<closed>"?)|(?P<next>{d})|(?P<end>\r\n|\r|\n)|(?P<plain>[^"\r\n{d}]+)')


def _rows(text: str, pattern: re.Pattern) -> Iterator[tuple[int, list[str] | None, str | None]]:
    cells, cell, line, start = [], "", 1, 1
    blank = lambda: not any(c.strip() for c in (*cells, cell))
    for piece in pattern.finditer(text):
        kind = piece.lastgroup
        if kind == "plain":
            cell += piece[0]
        elif kind == "next":
            cells.append(cell)
            cell = ""
        elif kind == "end":
            if not blank():
                yield start, [*cells, cell], None
            line += 1
            cells, cell, start = [], "", line
        elif piece["closed"]:
            breaks = re.sub("[\r\n]", "\n", piece["quoted"].replace('""', '"'))
            cell, line = cell + breaks, line + breaks.count("\n")
        else:
            yield start, None, "unterminated quoted field"
            return
    if not blank():
        yield start, [*cells, cell], None


def _batches(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """rows (path, line, cells, error) in lists of at most ROWS, and of CHARACTERS or little more."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(map(len, row[2] or ())) + len(str(row[0]))
        if len(held) >= ROWS or size >= CHARACTERS:
            yield held
            held, size = [], 0
    if held:
        yield held


def rows(files: DataFrame, delimiter: str | Column = ",") -> DataFrame:
    """(path, line, cells, error): the rows of each file with the line on which they start.

    A quote may open anywhere in a cell; two of them within quotes are one; a line end within quotes
    is a line feed. Blank rows are left out. Text after an unclosed quote is lost and told as one error.
    Null contents have no rows. The delimiter may be a column: each file's own. Rows go on while a file is
    read, so that a worker holds one file's text and a few rows, never the rows of many files.
    """
    kind = T.StructType([files.schema["path"], *ROW])
    types = [to_arrow_type(files.schema["path"].dataType), pa.int32(), pa.list_(pa.string()), pa.string()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns: dict[str, re.Pattern] = {}

        def read() -> Iterator[tuple]:
            for batch in batches:
                for path, text, d in zip(*batch.columns, strict=True):
                    own = d.as_py()
                    if own not in patterns:
                        patterns[own] = _pieces(own)
                    name = path.as_py()
                    for row in _rows(text.as_py() or "", patterns[own]):
                        yield name, *row

        for held in _batches(read()):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=kind.names)

    own = F.lit(delimiter) if isinstance(delimiter, str) else delimiter
    return files.select("path", "content", own.alias("delimiter")).mapInArrow(parse, kind)


def records(rows: DataFrame) -> DataFrame:
    """(path, line, record, error) of rows(): the first row of a file names the columns, short rows are
    padded with empty cells, cells beyond the header are dropped."""
    head = rows.where("cells IS NOT NULL").groupBy("path").agg(F.min_by("cells", "line").alias("_names"), F.min("line").alias("_first"))
    body = rows.join(head, "path", "left").where("error IS NOT NULL OR line > _first")
    padded = F.transform("_names", lambda _, i: F.coalesce(F.try_element_at("cells", i + 1), F.lit("")))
    # of columns with one name the last counts
    entries = F.arrays_zip(F.col("_names").alias("k"), padded.alias("v"))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice("_names", i + 2, F.size("_names")), lambda n: n == e["k"]))
    return body.select("path", "line", F.when(F.col("error").isNull(), F.map_from_entries(last)).alias("record"), "error")


def _object(text: Column) -> Column:
    """struct(record, error) of a JSON text that should be an object."""
    value = F.try_parse_json(text)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    error = F.when(value.isNull(), "malformed JSON").when(~is_object, "not a JSON object")
    return F.struct(F.when(error.isNull(), F.from_json(text, "map<string,string>")).alias("record"), error.alias("error"))


def json_lines(files: DataFrame) -> DataFrame:
    """(path, line, record, error): a JSON object for each line; blank lines don't count."""
    cut = files.select("path", F.posexplode(F.split("content", "\r\n|\r|\n")).alias("n", "text")).where(F.trim("text") != "")
    return cut.select("path", (F.col("n") + 1).alias("line"), _object(F.col("text")).alias("o")).select("path", "line", "o.record", "o.error")


def json_array(files: DataFrame) -> DataFrame:
    """(path, line, record, error): the elements of a document that is one JSON array, with their
    place as line; a document that is none is one error."""
    parsed = files.select("path", "content", F.from_json("content", "array<string>").alias("elements"), F.schema_of_variant(F.try_parse_json("content")).startswith("ARRAY").alias("is_array"))
    good = parsed.where("is_array").select("path", F.posexplode("elements").alias("n", "text")).select("path", (F.col("n") + 1).alias("line"), _object(F.col("text")).alias("o"))
    bad = parsed.where("NOT coalesce(is_array, false)").select("path", F.lit(1).alias("line"), F.struct(F.lit(None).cast("map<string,string>").alias("record"), F.lit("not a JSON array").alias("error")).alias("o"))
    return good.unionByName(bad).select("path", "line", "o.record", "o.error")
