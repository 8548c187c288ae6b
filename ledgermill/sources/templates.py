"""Template-driven import of tabular files, and exports."""

from __future__ import annotations

import csv
import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.operators.relational import numbered


def read_csv(spark: SparkSession, path: str, header_row: int = 0) -> DataFrame:
    """All cells as strings, empty ones null. ``header_row``: lines of each file before its header; then files are split like any text, so
    cells hold no line breaks, and each file has its own header. Columns that a file lacks are null."""
    if not header_row:
        return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    # rows of a file's first split follow each other in number
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    firsts = lines.filter("start = 0").groupBy("file").agg(F.min("n").alias("first"))
    placed = lines.join(firsts, "file").withColumn("place", F.when(F.col("start") == 0, F.col("n") - F.col("first")))
    heads = placed.filter(F.col("place") == header_row).select("file", F.col("value").alias("head"))
    body = placed.filter((F.coalesce("place", F.lit(header_row + 1)) > header_row) & (F.col("value") != ""))
    kinds = [header_names(r["head"]) for r in heads.select("head").distinct().collect()]  # a row for each kind of file
    if not kinds:
        raise ValueError("no file has a header there")
    names, width = list(dict.fromkeys(n for k in sorted(kinds) for n in k)), max(map(len, kinds))
    # a file's columns by their places; every line is read once, whatever its header
    cells = F.from_csv("value", F.lit(", ".join(f"c{i} string" for i in range(width))), {"escape": '"'})
    places = F.udf(lambda head: [header_names(head).index(n) if n in header_names(head) else None for n in names], "array<int>", useArrow=True)
    heads = heads.select("file", places("head").alias("places"))
    rows = body.select("file", cells.alias("_c")).join(heads, "file").select("places", F.array(*[F.col(f"_c.c{i}") for i in range(width)]).alias("cells"))
    return rows.select(*[F.get("cells", F.get("places", F.lit(i))).alias(n) for i, n in enumerate(names)])


def header_names(head: str) -> list[str]:
    """The columns of a header line; names that repeat, whatever their case, and empty ones get their place, as in files that start with their header."""
    found = next(csv.reader([head]))
    low = [n.lower() for n in found]
    return [f"_c{i}" if not n else f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(found)]


def write_with_header(lines: DataFrame, path: str, above: list[str]) -> None:
    """Text files of the lines (one column), each below the given ones."""

    def run(parts):
        yield pd.DataFrame({"line": above})
        yield from parts

    lines.mapInPandas(run, "line string").write.text(path)


_CELL = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def workbook(rows: list[list[str | None]]) -> bytes:
    """An XLSX file of one sheet of text cells."""
    cell = lambda v: "<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
    sheet = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/></Types>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_CELL[1:-1]}"><sheetData>{sheet}</sheetData></worksheet>')
    return out.getvalue()


_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _first_sheet_file(z: zipfile.ZipFile, names: list[str]) -> str:
    """The file of the sheet that the workbook lists first; without such a list the sheet with the smallest number."""
    from xml.etree import ElementTree

    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(names):
        first = next(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_CELL}sheet"), None)
        files = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        if first is not None and (file := files.get(first.get(_RELATION))):
            return file.removeprefix("/") if file.startswith("/") else f"xl/{file}"
    return min((n for n in names if n.startswith("xl/worksheets/") and n.endswith(".xml")), key=lambda n: (len(n), n))


def first_sheet(content: bytes) -> list[list[str | None]]:
    """Cells of a workbook's first sheet as texts, row by row; empty ones null."""
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{_CELL}t"))
        shared = [text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_CELL}si")] if "xl/sharedStrings.xml" in names else []
        sheet = _first_sheet_file(z, names)
        out = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{_CELL}row"):
            cells: list[str | None] = []
            for c in row.iter(f"{_CELL}c"):
                letters = "".join(x for x in c.get("r", "") if x.isalpha())
                at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else len(cells)
                cells += [None] * (at + 1 - len(cells))
                value = c.find(f"{_CELL}v")
                found = text(c) if c.get("t") == "inlineStr" else None if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text
                cells[at] = found or None
            out.append(cells)
        return out


def read_workbooks(files: DataFrame, names: list[str], header_row: int = 0) -> DataFrame:
    """Rows of the first sheet of each XLSX file (path, content, as read by ``binaryFile``): the named columns of the header in row ``header_row``;
    missing ones and empty cells are null. A workbook is read by one task, as it can't be split."""
    schema = pa.schema([(n, pa.string()) for n in names])

    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows = first_sheet(content)
                head = rows[header_row] if len(rows) > header_row else []
                at = [head.index(n) if n in head else -1 for n in names]
                cells = [[r[i] if 0 <= i < len(r) else None for i in at] for r in rows[header_row + 1 :]]
                cells = [r for r in cells if any(v is not None for v in r)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in cells], pa.string()) for i in range(len(names))], schema=schema)

    return files.select("content").mapInArrow(run, ", ".join(f"`{n}` string" for n in names))


def parsed_map(text: Column) -> Column:
    """A template's JSON map of columns."""
    return F.from_json(text, "map<string,string>")


def import_rows(rows: DataFrame, batch: str, order: str, column_map: dict[str, str]) -> DataFrame:
    """batch, row_index (from 1 in the order, which tells a batch's rows apart), payload (JSON of the mapped columns), status and error_message of each row.
    A batch is numbered by ranges, so a large one isn't in one task."""
    placed = numbered(rows, [order], "row_index", within=[batch])
    mapped = map_columns(placed, {**column_map, batch: "_batch", "row_index": "_index"}, check=list(column_map.values()))
    payload = F.to_json(F.struct(*[F.col(t) for t in dict.fromkeys(column_map.values())]))
    return mapped.select(F.col("_batch").alias(batch), F.col("_index").alias("row_index"), payload.alias("payload"), "status", "error_message")


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def batch_counters(rows: DataFrame, batch: str = "batch_id") -> DataFrame:
    status = F.col("status")
    return rows.groupBy(batch).agg(F.count("*").alias("total_rows"), F.count_if(status == "SUCCESS").alias("success_rows"), F.count_if(status == "ERROR").alias("error_rows"), F.min("row_index").alias("first_index"), F.max("row_index").alias("last_index"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """name and type (file, directory) of what is in a folder; nothing for a missing one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(f.getPath().getName(), "directory" if f.isDirectory() else "file") for f in (files.listStatus(at) if files.exists(at) else [])]
    return spark.createDataFrame(found, "name string, type string")


def map_columns(rows: DataFrame, column_map: dict[str, str], strict: bool = False, check: list[str] | None = None) -> DataFrame:
    """Columns by the template's source -> target map; a missing source is null. Of several sources of a target the first value that isn't
    null counts; with ``strict`` the last source counts, even if null. Adds ``status`` (a row without a value in the targets, or in those to ``check``, is an ERROR) and ``error_message``."""
    sources: dict[str, list[Column]] = {}
    for source, target in column_map.items():
        sources.setdefault(target, []).append(F.col(f"`{source}`") if source in rows.columns else F.lit(None).cast("string"))
    mapped = rows.select(*[(cs[-1] if strict else F.coalesce(*cs)).alias(t) for t, cs in sources.items()])
    filled = F.lit(False)
    for t in check or sources:
        filled = filled | (F.col(t).isNotNull() & (F.col(t).cast("string") != ""))
    return mapped.withColumn("status", F.when(filled, "SUCCESS").otherwise("ERROR")).withColumn("error_message", F.when(filled, None).otherwise("empty row"))


def write_quoted_csv(df: DataFrame, path: str) -> None:
    """Every cell quoted, quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def write_report(rows: DataFrame, path: str, filters: dict[str, str], generated_at: Column) -> None:
    """A JSON document for each row (say, a batch with its arrays of events, intakes and jobs), a line each, with the filters it was made by and the time."""
    told = F.struct(*[F.lit(v).alias(k) for k, v in filters.items()]).alias("filters")
    rows.select(F.to_json(F.struct(told, generated_at.alias("generatedAt"), *rows.columns)).alias("value")).write.mode("overwrite").text(path)


def write_artifacts(extractions: DataFrame, path: str) -> None:
    """The raw text and the normalized document (raw_text, payload; JSON text) of every extraction (request_id), as the first version of an artifact each, a folder for each type. The folders of
    both types are replaced; rows without a value are left out."""
    artifact = lambda kind, text, document: F.struct(F.lit(kind).alias("artifact_type"), F.lit(1).alias("artifact_version"), text.alias("content_text"), document.alias("content_json"))
    none = F.lit(None).cast("string")
    both = F.explode(F.array(artifact("RAW_TEXT", F.col("raw_text"), none), artifact("NORMALIZED_JSON", none, F.col("payload")))).alias("a")
    rows = extractions.select("request_id", both).select("request_id", "a.*").filter(F.coalesce("content_text", "content_json").isNotNull())
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("artifact_type").parquet(path)


def extracted_texts(files: DataFrame, extractors: list) -> DataFrame:
    """path, text_0, text_1 ... of files (path, content, as read by ``binaryFile``): what each extractor, a function from bytes to a text, finds; null where it fails. The library brings none of its own;
    ``forms.usable_text`` chooses between the first two."""
    schema = pa.schema([("path", pa.string()), *((f"text_{i}", pa.string()) for i in range(len(extractors)))])

    def tried(extract, content: bytes) -> str | None:
        try:
            return extract(content)
        except Exception:  # whatever a library raises on a damaged file
            return None

    def run(batches):
        for batch in batches:
            contents = batch.column("content").to_pylist()
            texts = [pa.array([None if c is None else tried(e, c) for c in contents], pa.string()) for e in extractors]
            yield pa.RecordBatch.from_arrays([batch.column("path").cast(pa.string()), *texts], schema=schema)

    return files.select("path", "content").mapInArrow(run, ", ".join(f"{f.name} string" for f in schema))
