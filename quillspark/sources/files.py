"""File sources: delimited text with declared columns, and one-document-per-file text.

No schema inference. A file with a header is read by column name: its columns may stand in any order, and columns that
are not asked for are left out; a missing column is an error, and so is a value that doesn't fit its declared type.
Whole-text files are listed and read by tasks and keyed by file name, never opened per row: the driver holds no list of
them, of which there may be millions. Only in a store that tasks can't open (see ``task_filesystem``) Spark's ``binaryFile``
source reads them, and the driver lists them for it.

Delimited files are split by lines, so that a large file is read by many tasks; ``multi_line`` allows line breaks inside
quoted fields, at the price of one task per file. ``encoding`` names another character set than UTF-8; one whose line
break isn't the byte 0x0A (UTF-16, UTF-32) needs ``multi_line``.
"""

from __future__ import annotations

import csv
import os
import re
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_strip
from ..session import hadoop_path

# Options that make CSV/TSV round-trip arbitrary text (quotes, newlines, outer spaces). On read, an
# unquoted empty field is null and a quoted empty field ("") is the empty string: the null marker is
# moved off the empty string to a control character that text fields do not hold.
TEXT_SAFE = {"quote": '"', "escape": '"', "nullValue": "\u0001"}
TEXT_SAFE_WRITE = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

RATED_CORPUS_SCHEMA = T.StructType(
    [
        T.StructField("essay_id", T.LongType()),
        T.StructField("essay_set", T.IntegerType()),
        T.StructField("essay", T.StringType()),
        T.StructField("domain1_score", T.DoubleType()),
    ]
    + [T.StructField(f"rater{r}_trait{t}", T.DoubleType()) for r in (1, 2) for t in (1, 2, 3, 4)]
)

INDEX_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("prompt_id", T.StringType()),
    T.StructField("proficiency_level", T.StringType()),
])

LANGUAGE_SCHEMA = T.StructType([
    T.StructField("Filename", T.StringType()),
    T.StructField("Language", T.StringType()),
])


def _typed(name: str, kind: T.DataType):
    raw = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return raw
    blank = raw.isNull() | (F.trim(raw) == "")
    number = F.trim(raw).try_cast("double") if isinstance(kind, T.IntegralType) else None  # "3.0" is the integer 3
    value = (F.when(number == F.floor(number), number).cast(kind) if number is not None else F.trim(raw).try_cast(kind))
    if isinstance(kind, T.LongType):
        value = F.coalesce(F.trim(raw).try_cast(kind), value)
    bad = F.raise_error(F.concat(F.lit(f"column {name}: not a {kind.simpleString()}: "), raw)).cast(kind)
    return F.when(blank, F.lit(None).cast(kind)).otherwise(F.coalesce(value, bad)).alias(name)


def read_header(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> list[str]:
    """Column names of a delimited file (of a folder: of one of its files)."""
    if encoding.upper() == "UTF-8":
        first = spark.read.text(path).first()
    else:  # the CSV reader decodes; one field a line, no quotes
        plain = {"encoding": encoding, "sep": "\u0001", "quote": "", "multiLine": "true"}
        first = spark.read.schema("line string").options(**plain).csv(path).first()
    if first is None:
        raise ValueError(f"{path} is empty: it has no header")
    return next(csv.reader([first[0].lstrip("\ufeff")], delimiter=sep))


def file_order() -> Column:
    """Where a row stands in the files it is read from: file path, start of its split, place in the task.

    Sorts rows of one read as the lines stand in the files (several files by path). For a frame that comes straight from a
    file source; a task reads its splits, and the lines of each, in order.
    """
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", header: bool = False,
                   multi_line: bool = False, encoding: str = "UTF-8", order: str | None = None) -> DataFrame:
    """Columns of ``schema``: by name if the file has a header, else by position.

    Every file of a folder must have the same header (Spark compares each with the first). ``order`` names a column for
    the row's place in the files (see :func:`file_order`).
    """
    reader = spark.read.options(**TEXT_SAFE).option("sep", sep).option("multiLine", str(multi_line).lower()).option("mode", "FAILFAST")
    reader = reader.option("encoding", encoding)
    place = [file_order().alias(order)] if order else []
    if not header:
        return reader.schema(schema).csv(path).select("*", *place)
    names = read_header(spark, path, sep, encoding)
    if missing := [f.name for f in schema.fields if f.name not in names]:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(names)}")
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = reader.option("header", "true").option("enforceSchema", "false").schema(text).csv(path)
    return raw.select(*[_typed(f.name, f.dataType) for f in schema.fields], *place)


def read_rated_corpus(spark: SparkSession, path: str, sep: str = "\t", multi_line: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """Rated corpus (tab-separated with header): the declared columns, whatever others there are."""
    return read_delimited(spark, path, RATED_CORPUS_SCHEMA, sep=sep, header=True, multi_line=multi_line, encoding=encoding)


def read_index(spark: SparkSession, path: str, multi_line: bool = False, order: str | None = None) -> DataFrame:
    """Headerless index: ``path, prompt_id ('P3'), proficiency_level``."""
    return read_delimited(spark, path, INDEX_SCHEMA, header=False, multi_line=multi_line, order=order)


def read_languages(spark: SparkSession, path: str) -> DataFrame:
    """Language table with header: ``Filename, Language``, whatever other columns there are."""
    return read_delimited(spark, path, LANGUAGE_SCHEMA, header=True)


def task_filesystem(path: str):
    """``(file system, path)`` for files that tasks read or write themselves: a folder that all executors share."""
    from pyarrow import fs

    if path.startswith("file:"):  # as Hadoop takes it: nothing in it is encoded
        return fs.LocalFileSystem(), "/" + path[5:].strip("/")
    return fs.FileSystem.from_uri(path)


def task_folder(spark: SparkSession, path: str) -> str | None:
    """``path`` in full, if it is a folder that tasks can open; a pattern, a single file and any other store are Spark's."""
    from pyarrow import fs

    if re.search(r"[{}\[\]*?\\]", path):
        return None
    store, p = hadoop_path(spark, path)
    folder = store.makeQualified(p).toString()
    try:
        target, root = task_filesystem(folder)
        return folder if target.get_file_info(root).type == fs.FileType.Directory else None
    except Exception:  # a store that only Spark's readers know
        return None


def _decoded(c):
    """A percent-encoded path part as text (a plus sign stands for itself)."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


#: Names of files that Spark's text reader unpacks.
PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst)$"
#: Splits of small files that a task reads at most, one after the other.
SPLITS = 256
#: Names in a batch of a listing; bytes of texts in a batch of files, but for one that is longer.
NAMES, BYTES = 5_000, 4 << 20


def _size(kind: str, block: bytes) -> int:
    """Bytes that a block of LZ4 or Snappy unpacks to; a block of LZ4 doesn't say, so its steps are added up."""
    at = size = shift = 0
    if kind == "snappy":
        while True:
            size |= (block[at] & 127) << shift
            if block[at] < 128:
                return size
            at, shift = at + 1, shift + 7

    def length(n):
        nonlocal at
        while n >= 15:
            n, at = n + block[at], at + 1
            if block[at - 1] < 255:
                break
        return n

    while at < len(block):
        token, at = block[at], at + 1
        literals = length(token >> 4)
        at, size = at + literals, size + literals
        if at < len(block):
            at += 2
            size += 4 + length(token & 15)
    return size


def unpacked(name: str, content: bytes) -> bytes:
    """What a packed file holds, by the end of its name, packed as Hadoop's codecs do it."""
    import bz2
    import gzip
    import zlib

    import pyarrow as pa

    kind, parts, at = name.rpartition(".")[2], [], 0
    if kind == "gz":
        return gzip.decompress(content)
    if kind == "bz2":
        return bz2.decompress(content)
    if kind == "zst":
        return pa.input_stream(pa.py_buffer(content), compression="zstd").read()
    if kind == "deflate":
        while content:
            z = zlib.decompressobj()
            parts.append(z.decompress(content))
            if not z.eof:
                raise EOFError(f"{name} is cut off")
            content = z.unused_data
        return b"".join(parts)
    codec = pa.Codec("lz4_raw" if kind == "lz4" else kind)

    def number():
        nonlocal at
        if at + 4 > len(content):
            raise EOFError(f"{name} is cut off")
        at += 4
        return int.from_bytes(content[at - 4:at], "big")

    while at < len(content):  # runs of blocks, each run after the number of its bytes, each block after its own packed
        left = number()
        while left > 0:
            end = number() + at
            block, at = content[at:end], end
            parts.append(codec.decompress(block, decompressed_size=_size(kind, block), asbytes=True))
            left -= len(parts[-1])
    return b"".join(parts)


def _entries(target, folder: str):
    """``(path, whether it is a folder)`` of what Spark's readers see in a folder; those of a local one come one by one."""
    from pyarrow import fs

    def seen(name):
        return not (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"))

    if isinstance(target, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for x in found:
                if seen(x.name) and not (x.is_symlink() and not os.path.exists(x.path)):
                    yield x.path, x.is_dir()
    else:
        for x in target.get_file_info(fs.FileSelector(folder)):
            if seen(x.base_name):
                yield x.path, x.type == fs.FileType.Directory


def _walk(target, folder: str, into, whole=lambda name: False):
    """``(path, whether it is a folder)`` of the files below a folder. ``into``: folders to look into, by name; ``whole``: those
    that are given as they are."""
    folders = [folder]
    while folders:
        for path, is_folder in _entries(target, folders.pop()):
            name = path.rpartition("/")[2]
            if not is_folder or whole(name):
                yield path, is_folder
            elif into(name):
                folders.append(path)


def _batched(rows, names, kinds, size):
    """Arrow batches of rows; ``size`` of a row: the share of a batch that it takes."""
    import pyarrow as pa

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    held, share = [], 0.0
    for row in rows:
        if held and share + size(row) > 1:
            yield batch()
            held, share = [], 0.0
        held.append(row)
        share += size(row)
    if held:
        yield batch()


def read_in_tasks(spark: SparkSession, folder: str, name_partition: str | None, unpack: bool) -> DataFrame:
    """``(source, content)``: path and bytes of every file in a folder that tasks can open, listed and read by tasks.

    One task lists the folder, as Spark's driver would, but keeps no list: the names are dealt to the tasks that read, by
    their hash. With ``name_partition`` the folders of that name are dealt first and listed where they were dealt to, all
    that is below them. The frame is not to be broadcast: its planned size is that of the names, so a merge hint is set.
    """
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def listed(batches):
        import pyarrow as pa

        target, root = task_filesystem(folder)
        for _ in batches:
            if name_partition:
                found = _walk(target, root, lambda name: True, lambda name: name.startswith(f"{name_partition}="))
            else:  # other folders than partitions hold no files of this one
                found = _walk(target, root, lambda name: "=" in name)
            yield from _batched(found, ["source", "folder"], [pa.string(), pa.bool_()], lambda row: 1 / NAMES)

    def below(batches):
        import pyarrow as pa

        target, _ = task_filesystem(folder)
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        found = (x for path, is_folder in rows for x in (_walk(target, path, lambda name: True) if is_folder else [(path, False)]))
        yield from _batched(found, ["source", "folder"], [pa.string(), pa.bool_()], lambda row: 1 / NAMES)

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        target, _ = task_filesystem(folder)
        opened = (lambda path: open(path, "rb")) if isinstance(target, fs.LocalFileSystem) else target.open_input_file
        packed = re.compile(PACKED)

        def files():
            for path in (path for b in batches for path in b.column(0).to_pylist()):
                with opened(path) as f:
                    content = f.read()
                if content or not name_partition:
                    yield path, unpacked(path, content) if unpack and content and packed.search(path) else content

        yield from _batched(files(), ["source", "content"], [pa.string(), pa.binary()], lambda row: max(len(row[1]) / BYTES, 1 / NAMES))

    names = spark.range(0, 1, 1, 1).select(F.lit(folder).alias("root")).mapInArrow(listed, "source string, folder boolean")
    if name_partition:
        names = names.repartition(n, "source").mapInArrow(below, "source string, folder boolean")
    return names.select("source").repartition(n, "source").mapInArrow(read, "source string, content binary").hint("merge")


def list_names(files: DataFrame) -> DataFrame:
    """``file_name`` of every file behind a frame of a file source, files of no bytes included (its rows leave them out).

    The driver has listed the folder to plan the read; this takes that list, one name a file, from its file index. The names
    stay inside the JVM.
    """
    spark = files.sparkSession
    jvm = spark._jvm
    paths = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(files._jdf.inputFiles())
    paths = spark._jsparkSession.createDataset(paths, jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(paths.toDF(), spark).select(_decoded(F.substring_index("value", "/", -1)).alias("file_name"))


def few_tasks(files: DataFrame) -> DataFrame:
    """``files`` with its splits dealt to fewer tasks: Spark counts 4 MB for each file, so few small ones make a split."""
    splits, least = files.rdd.getNumPartitions(), 4 * files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(max(least, -(-splits // SPLITS))) if splits > least else files


@contextmanager
def few_listing_tasks(spark: SparkSession):
    """While a source is made: many folders are listed by some tasks a core, not by Spark's ten thousand."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 8 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_by_spark(spark: SparkSession, path: str, name_partition: str | None, encoding: str) -> tuple[DataFrame, DataFrame]:
    """Names of all files and ``(source, value)`` of those that have bytes, by Spark's readers: the driver lists them."""
    utf8 = encoding.upper() == "UTF-8"
    reader = lambda: spark.read.option("recursiveFileLookup", str(name_partition is not None).lower())
    with few_listing_tasks(spark):
        raw = reader().format("binaryFile").load(path)
    names = list_names(raw)
    source = F.col("_metadata.file_path" if name_partition else "_metadata.file_name").alias("source")
    files = raw.select(source, (F.col("content").cast("string") if utf8 else F.decode("content", encoding)).alias("value"))
    packed = names.where(F.col("file_name").rlike(PACKED)) if utf8 else None
    if packed is not None and not packed.isEmpty():
        with few_listing_tasks(spark):
            unpacked = reader().option("pathGlobFilter", "*.{gz,bz2,deflate,lz4,snappy,zst}").text(path, wholetext=True)
        files = files.where(~F.col("source").rlike(PACKED)).unionByName(unpacked.select(source, "value"))
    return names, few_tasks(files)


def read_text_files(spark: SparkSession, path: str, strip: bool = True, name_partition: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """One row per file: ``(file_name, text)``.

    ``strip`` removes Python whitespace from both ends, as reading an essay file does. With
    ``name_partition`` the document name is taken from that partition directory
    (``{path}/{name_partition}=<name>/part-*``, the layout Spark's writers produce) instead of the
    file name; the folders are not taken for partitions, of which there may be millions. A file of no
    bytes is an empty text (in the partition layout, whose writers end each text by a line break, it gives no row). Names are
    taken from the path as they are written: ``007`` stays ``007``, spaces come back. Files whose names begin with a point or
    an underscore are passed over, packed ones unpacked (UTF-8 only). Bytes that are no text of ``encoding`` are an error, but
    for UTF-8, where they come as replacement characters when a text is used.

    The files are listed and read when the frame is, by tasks (see ``read_in_tasks``). What tasks can't open Spark reads, with
    the list of files in the driver: about 1.3 KB of its heap for each (see ``read_by_spark``).
    """
    if folder := task_folder(spark, path):
        utf8 = encoding.upper() == "UTF-8"
        files = read_in_tasks(spark, folder, name_partition, unpack=utf8)
        files = files.select("source", (F.col("content").cast("string") if utf8 else F.decode("content", encoding)).alias("value"))
        names, in_path = None, lambda c: c
    else:
        names, files = read_by_spark(spark, path, name_partition, encoding)
        in_path = _decoded
    text = (py_strip(F.col("value")) if strip else F.col("value")).alias("text")
    if name_partition:
        name = _decoded(in_path(F.regexp_extract("source", f"/{name_partition}=([^/]*)/[^/]*$", 1)))  # a partition value is encoded
        return files.select(name.alias("file_name"), text)
    texts = files.select(in_path(F.substring_index("source", "/", -1)).alias("file_name"), text)
    if names is None:
        return texts
    return names.distinct().join(texts, "file_name", "left").select("file_name", F.coalesce("text", F.lit("")).alias("text"))


def read_prompt_files(spark: SparkSession, path: str, name_partition: str | None = None) -> DataFrame:
    """Prompt texts ``P{i}.txt`` -> ``(prompt_id, prompt)``."""
    files = read_text_files(spark, path, name_partition=name_partition)
    pid = F.regexp_extract("file_name", r"^P(\d+)\.txt$", 1)
    return files.select(F.nullif(pid, F.lit("")).cast("int").alias("prompt_id"), F.col("text").alias("prompt"))


TEMPLATE_VANILLA_SCHEMA = T.StructType([
    T.StructField("prompt_id", T.IntegerType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("msg_system", T.StringType()),
    T.StructField("msg_user_instruction_template", T.StringType()),
])

TEMPLATE_MTS_SCHEMA = T.StructType(
    [T.StructField("prompt_id", T.IntegerType()), T.StructField("prompt", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ("msg_system_template", "msg_user_retrieval_template", "msg_user_score_template")]
    + [T.StructField(f"{p}_{k}", T.StringType()) for p in ("trait", "description", "rubric") for k in (1, 2, 3, 4)]
)


def read_templates(spark: SparkSession, path: str, method: str = "mts", fmt: str = "csv", multi_line: bool = True) -> DataFrame:
    """Scoring templates (one row per prompt) from CSV with header, parquet or a spreadsheet (``xlsx``)."""
    schema = TEMPLATE_MTS_SCHEMA if method == "mts" else TEMPLATE_VANILLA_SCHEMA
    if fmt == "parquet":
        return spark.read.parquet(path).select(*[f.name for f in schema.fields])
    if fmt == "xlsx":
        from .spreadsheets import read_xlsx

        return read_xlsx(spark, path, schema)
    return read_delimited(spark, path, schema, header=True, multi_line=multi_line)
