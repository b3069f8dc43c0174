"""Files as rows: one relation of cells for tables, trees, arrays and databases, and texts for pages.

Files are found and listed by Spark (binaryFile), read where they lie, and never gathered on the driver. A
file that cannot be read gives one row with its status: unsupported, never_opened, extractor_missing,
unreadable. Names of columns and headers may clash with each other; a repeated header makes the table unreadable.
"""

from __future__ import annotations

import csv
import io
import os
import re
import sqlite3
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.schema import FORMATS, NEVER_OPENED, UNSUPPORTED
from probatum.session import importable
from probatum.sources.pages import PAGE_READERS
from probatum.sources.statistics_files import r_frame, stata
from probatum.sources.trees import load_json, load_yaml, walk

CELLS = (
    "path string, status string, address_kind string, table_name string, row_ord long, column string, pointer string, "
    "index array<int>, raw string, native_type string, is_container boolean"
)


def listed(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, suffix, format, length, sha256, content) of every file under a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    importable(spark)
    files = reader.load(root)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.select("path", suffix.alias("suffix"), format_of(suffix).alias("format"), "length", F.sha2("content", 256).alias("sha256"), "content")


def format_of(suffix: Column) -> Column:
    out = F.when(suffix.isin(*NEVER_OPENED), "never_opened").when(suffix.isin(*UNSUPPORTED), "unsupported")
    for s, f in FORMATS.items():
        out = out.when(suffix == s, f)
    return out.otherwise("unsupported")


def is_lfs_pointer(content: Column) -> Column:
    return F.decode(F.substring(content, 1, 60), "utf-8").startswith("version https://git-lfs")


def sniff(header: str, suffix: str) -> str:
    """The delimiter of a table: by suffix, else the commonest of comma, tab, semicolon and pipe in its header."""
    if suffix == "tsv":
        return "\t"
    return max(",\t;|", key=lambda d: (header.count(d), -",\t;|".index(d)))


def _shortest(value) -> str:
    text = repr(float(value)) if not isinstance(value, str) else value
    return text[:-2] if text.endswith(".0") else text


def render(value) -> tuple[str | None, str, bool]:
    """(text, type, is a container) of a typed value: true and false in words, whole floats without their point."""
    if value is None:
        return None, "null", False
    if isinstance(value, bool):
        return str(value).lower(), "bool", False
    if isinstance(value, (list, dict, tuple)):
        return None, "container", True
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace"), "bytes", False
    if isinstance(value, float):
        return _shortest(value), "float", False
    if hasattr(value, "isoformat"):
        return value.isoformat(), "date", False
    return str(value), "int" if isinstance(value, int) else "string", False


def _table_rows(header: list[str], rows, kind: str, name: str | None, wanted: frozenset[str] | None = None) -> Iterator[tuple]:
    if len(set(header)) != len(header):
        raise ValueError("repeated column")
    kept = [(i, column) for i, column in enumerate(header) if wanted is None or column in wanted]
    for n, row in enumerate(rows):
        for i, column in kept:
            raw, native, container = render(row[i] if i < len(row) else "")
            yield ("ok", kind, name, n, column, None, None, raw, native, container)


def _delimited(content: bytes, suffix: str, wanted: frozenset[str] | None = None) -> Iterator[tuple]:
    text = content.decode("utf-8-sig")
    first = text.split("\n", 1)[0]
    rows = csv.reader(io.StringIO(text, newline=""), delimiter=sniff(first, suffix))
    header = [h.strip() for h in next(rows, [])]
    yield from _table_rows(header, ([c.strip() for c in r] for r in rows if r), "table", None, wanted)


def _tree(content: bytes, suffix: str, wanted: frozenset[str] | None = None) -> Iterator[tuple]:
    text = content.decode("utf-8")
    for leaf in walk(load_json(text) if suffix == "json" else load_yaml(text)):
        yield ("ok", "pointer", None, None, None, leaf["pointer"], None, leaf["raw"], leaf["native_type"], leaf["is_container"])


def _columnar(content: bytes, suffix: str, wanted: frozenset[str] | None = None) -> Iterator[tuple]:
    """Only the wanted columns are decoded, a batch of rows at a time."""
    import pyarrow as pa
    import pyarrow.feather as feather
    import pyarrow.parquet as parquet

    source = io.BytesIO(content)
    if suffix == "parquet":
        file = parquet.ParquetFile(source)
        names = file.schema_arrow.names
    else:
        names = pa.ipc.open_file(source).schema.names
    if len(set(names)) != len(names):
        raise ValueError("repeated column")
    kept = [n for n in names if wanted is None or n in wanted]
    batches = file.iter_batches(columns=kept) if suffix == "parquet" else feather.read_table(source, columns=kept).to_batches()
    rows = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))))
    yield from _table_rows(kept, rows, "table", None)


def _array(content: bytes, suffix: str, wanted: frozenset[str] | None = None) -> Iterator[tuple]:
    import numpy as np

    held = np.load(io.BytesIO(content), allow_pickle=False)
    arrays = {None: held} if suffix == "npy" else {k: held[k] for k in held.files}
    for name, array in arrays.items():
        kind = str(array.dtype)
        for index in np.ndindex(array.shape):
            value = array[index]
            raw = str(value).removesuffix(".0") if array.dtype.kind == "f" else render(value.item())[0]
            yield ("ok", "array", name, None, None, None, [int(i) for i in index], raw, kind, False)


def _sqlite(content: bytes, suffix: str, wanted: frozenset[str] | None = None) -> Iterator[tuple]:
    with tempfile.NamedTemporaryFile(suffix=".db", delete=False) as f:  # read within this task and removed
        f.write(content)
    try:
        con = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
        names = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') ORDER BY name")]
        for name in names:
            quoted = '"' + name.replace('"', '""') + '"'
            held = [d[0] for d in con.execute(f"SELECT * FROM {quoted} LIMIT 0").description]  # noqa: S608
            kept = [h for h in held if wanted is None or h in wanted]
            if kept:
                named = ", ".join('"' + h.replace('"', '""') + '"' for h in kept)
                yield from _table_rows(kept, con.execute(f"SELECT {named} FROM {quoted}"), "table", name)  # noqa: S608
        con.close()
    finally:
        os.unlink(f.name)


def _sheet(content: bytes, suffix: str, wanted: frozenset[str] | None = None) -> Iterator[tuple]:
    try:
        import openpyxl
    except ImportError as e:
        raise ModuleNotFoundError("no workbook reader installed") from e
    book = openpyxl.load_workbook(io.BytesIO(content), read_only=True, data_only=True)
    for sheet in book.worksheets:
        rows = sheet.iter_rows(values_only=True)
        header = next(rows, ())
        kept = [i for i, h in enumerate(header) if h is not None]
        yield from _table_rows([str(header[i]) for i in kept], ([r[i] if i < len(r) else None for i in kept] for r in rows), "table", sheet.title, wanted)


def _frame(reader: Callable) -> Callable:
    def read(content: bytes, suffix: str, wanted: frozenset[str] | None = None) -> Iterator[tuple]:
        header, columns = reader(content, wanted)
        yield from _table_rows(header, zip(*columns), "table", None)

    return read


def _spss(content: bytes, suffix: str, wanted: frozenset[str] | None = None) -> Iterator[tuple]:
    import pyreadstat  # where it is installed

    with tempfile.NamedTemporaryFile(suffix=f".{suffix}") as f:  # read within this task and removed
        f.write(content)
        f.flush()
        data, meta = pyreadstat.read_sav(f.name, output_format="dict", usecols=None if wanted is None else list(wanted))
    yield from _table_rows(list(data), zip(*data.values()), "table", None)


READERS = {"stata": _frame(stata), "r_frame": _frame(r_frame), "spss": _spss, "table": _delimited, "tree": _tree, "columnar": _columnar, "array": _array, "sqlite": _sqlite, "sheet": _sheet}


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in CELLS.split(", ")]
    for batch in batches:
        for path, suffix, form, content, columns in zip(batch["path"], batch["suffix"], batch["format"], batch["content"], batch["wanted"]):
            rows: list[tuple] = []
            status = None
            if form not in READERS:
                status = form if form in ("never_opened", "unsupported") else "text"
            else:
                try:
                    for row in READERS[form](bytes(content), suffix, None if columns is None else frozenset(columns)):
                        rows.append((path, *row))
                        if len(rows) >= 50_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                except ModuleNotFoundError:
                    status = "extractor_missing"
                except Exception:  # noqa: BLE001
                    rows, status = [], "unreadable"
            if status:
                rows.append((path, status, *[None] * 9))
            if rows:
                yield pd.DataFrame(rows, columns=names).astype({"row_ord": "Int64"})


def cells(files: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The cells of files(path, suffix, format, content), one row each, and a status row for files without any.

    wanted(path, columns array) names the columns of tables that addresses ask for: no other is read. A path
    that wanted does not name is read whole.
    """
    f = files.select("path", "suffix", "format", "content")
    f = f.withColumn("wanted", F.lit(None).cast("array<string>")) if wanted is None else f.join(wanted.select("path", F.col("columns").alias("wanted")), "path", "left")
    return f.mapInPandas(_read, CELLS)


def page_texts(files: DataFrame, readers: dict[str, tuple[str, Callable[[bytes], str]]] | None = None) -> DataFrame:
    """(path, extractor, text) of pages and documents by suffix; text is null where it cannot be read.

    readers(suffix to name and function) stand before the built-in ones: a program of one's own for PDF files, say.
    """
    chosen = PAGE_READERS | (readers or {})
    known = files.filter(F.col("suffix").isin(*chosen))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, suffix, content in zip(b["path"], b["suffix"], b["content"]):
                name, reader = chosen[suffix]
                try:
                    out.append((path, name, reader(bytes(content))))
                except Exception:  # noqa: BLE001
                    out.append((path, name, None))
            yield pd.DataFrame(out, columns=["path", "extractor", "text"])

    return known.select("path", "suffix", "content").mapInPandas(run, "path string, extractor string, text string")


def ledger_lines(spark: SparkSession, root: str) -> DataFrame:
    """(ledger, n, raw, prev_hash, seq, readable, event): JSONL ledgers, split at line feeds only, blank lines left out."""
    texts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root)
    lines = F.filter(F.transform(F.split(F.decode("content", "utf-8"), "\n"), lambda x: F.trim(F.regexp_replace(x, "\r$", ""))), lambda x: x != "")
    rows = texts.select(F.col("path").alias("ledger"), F.posexplode(lines).alias("n", "raw"))
    event = F.try_parse_json("raw")
    get = lambda path, kind: F.try_variant_get(event, path, kind)
    return rows.select(
        "ledger", F.col("n").cast("long").alias("n"), "raw", get("$.prev_hash", "string").alias("prev_hash"), get("$.seq", "long").alias("seq"),
        event.isNotNull().alias("readable"), get("$.event", "string").alias("event"), get("$.timestamp", "string").alias("timestamp"),
    )


def shallowest_results(files: DataFrame, depth: int = 3, most: int = 20, largest: int = 50 << 20) -> DataFrame:
    """Result files a survey opens: the shallowest first, at most `most` of bounded size: the limit is the feature."""
    deep = F.size(F.split("path", "/"))
    least = files.agg(F.min(deep)).first()[0] or 0
    kept = files.withColumn("depth", deep - least).filter((F.col("depth") < depth) & (F.col("length") <= largest))
    return kept.filter(F.col("format").isin("tree", "table", "columnar", "array", "sqlite", "sheet")).orderBy("depth", "path").limit(most).drop("content")


def suffix_of(path: str) -> str:
    m = re.search(r"\.([A-Za-z0-9]+)$", path)
    return m[1].lower() if m else ""


def holds_text(content: bytes) -> bool:
    """Whether the first 8 KiB of a file without a suffix are text."""
    head = content[:8192]
    if b"\x00" in head:
        return False
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as e:
        return e.start >= len(head) - 3
    return True


def is_zip(content: bytes) -> bool:
    return zipfile.is_zipfile(io.BytesIO(content))
