"""Files under paths, listed and read by tasks.

The driver knows the given paths and how many folders a round has; names of files are rows. A round lists its folders in many tasks
and leaves the folders for the next one, so there are as many rounds as levels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.session import stored

LISTED = "path string, rest array<string>, size bigint"
FOLDERS_A_TASK = 256
#: Bytes and files that a task reads on average.
READ_BYTES = 32 << 20
READ_FILES = 4096
_MAGIC = re.compile(r"[*?\[{]")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Hadoop writes it, and the path in it."""
    if re.match("(file:)?/", path):
        return fs.LocalFileSystem(), re.sub("^(file:)?/+", "/", path)
    return fs.FileSystem.from_uri(path)


def glob_pattern(glob: str) -> re.Pattern:
    """A glob of names with ``* ? [..] {a,b}``."""
    out, depth, i = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        elif c == "[" and "]" in glob[i + 2:]:
            end = glob.index("]", i + 2)
            out.append("[" + re.sub("^[!^]", "^", glob[i + 1:end]) + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)))
        i += 1
    return re.compile("(?s:" + "".join(out) + ")")


def _hidden(name: str) -> bool:
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _listed(pattern: str, recursive: bool):
    """A round: what lies in each folder, or fits the next part of its glob."""
    wanted = glob_pattern(pattern)

    def taken(path: str, info: fs.FileInfo) -> bool:
        name = path.rsplit("/", 1)[-1]
        return info.size > 0 and not _hidden(name) and wanted.fullmatch(name) is not None

    def inside(path: str, rest: list[str]) -> Iterator[tuple[str, list[str], int | None]]:
        files, name = opened(path)
        info = files.get_file_info(name)
        if info.type == fs.FileType.File:
            if not rest and taken(path, info):
                yield path, [], info.size
        elif info.type == fs.FileType.Directory:
            part = glob_pattern(rest[0]) if rest else None
            for child in files.get_file_info(fs.FileSelector(name)):
                under = f"{path.rstrip('/')}/{child.base_name}"
                if part is not None and not part.fullmatch(child.base_name):
                    continue
                if child.type == fs.FileType.Directory:
                    # folders of partitions belong to the folder they lie in
                    if part is not None or not _hidden(child.base_name) and (recursive or "=" in child.base_name):
                        yield under, rest[1:], None
                elif len(rest) < 2 and taken(under, child):
                    yield under, [], child.size

    schema = pa.schema([("path", pa.string()), ("rest", pa.list_(pa.string())), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list = []
            for path, rest in zip(batch.column("path").to_pylist(), batch.column("rest").to_pylist()):
                for row in inside(path, rest):
                    rows.append(row)
                    if len(rows) == READ_FILES:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)
    return run


def listed_files(spark: SparkSession, path: str | list[str], pattern: str, recursive: bool = False) -> DataFrame:
    """``path, size`` of the files under ``path`` (a folder, file or glob, or several) whose name fits ``pattern``, as Spark's readers
    list them: empty and hidden files are left out, and only ``recursive`` goes into folders other than those of partitions."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    roots = []
    for one in [path] if isinstance(path, str) else path:
        given = hadoop(one)
        parts = given.getFileSystem(conf).makeQualified(given).toString().split("/")
        fixed = next((i for i, p in enumerate(parts) if _MAGIC.search(p)), len(parts))
        root = "/".join(parts[:fixed])
        files, name = opened(root or "/")
        if files.get_file_info(name).type == fs.FileType.NotFound:
            raise FileNotFoundError(root)
        roots.append((root, parts[fixed:]))
    todo, folders, found = spark.createDataFrame(roots, "path string, rest array<string>"), len(roots), None
    while folders:
        tasks = max(min(folders, spark.sparkContext.defaultParallelism), -(-folders // FOLDERS_A_TASK))
        step = stored(todo.repartition(tasks).mapInArrow(_listed(pattern, recursive), LISTED), "listed")
        files = step.where("size IS NOT NULL").select("path", "size")
        found = files if found is None else found.unionByName(files)
        todo = step.where("size IS NULL").select("path", "rest")
        folders = todo.count()
    return found


def dealt(files: DataFrame) -> DataFrame:
    """The files in parts of about READ_BYTES and at most READ_FILES on average."""
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    parts = max(-(-total["bytes"] // READ_BYTES), -(-total["n"] // READ_FILES), min(total["n"], files.sparkSession.sparkContext.defaultParallelism), 1)
    return files.repartition(parts)


_PLAIN = re.compile(r"[^A-Za-z0-9\-_.!~*'(),;:$&+=@/\u0080-\U0010ffff]")


def uri(path: str) -> str:
    """The path as ``_metadata.file_path`` gives it."""
    return _PLAIN.sub(lambda m: f"%{ord(m.group()):02X}", path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("source_path", pa.string()), ("file_name", pa.string()), ("raw", pa.string())])

    def given(rows: list) -> pa.RecordBatch:
        paths, texts = zip(*rows)
        # bytes as they are, like Spark's text reader
        raw = pa.array(texts, pa.large_binary()).cast(pa.binary()).view(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(paths), pa.array([p.rsplit("/", 1)[-1] for p in paths]), raw], schema=schema)

    rows, held = [], 0
    for batch in batches:
        for path in batch.column("path").to_pylist():
            files, name = opened(path)
            with files.open_input_stream(name) as stream:
                text = stream.read()
            rows.append((uri(path), text))
            held += len(text)
            if held >= 4 << 20:
                yield given(rows)
                rows, held = [], 0
    if rows:
        yield given(rows)


def whole_texts(files: DataFrame) -> DataFrame:
    """``source_path, file_name, raw``: each file as one row."""
    return dealt(files).mapInArrow(_read, "source_path string, file_name string, raw string")


#: Bytes of lines that are read at a time.
BLOCK = 4 << 20
_END = re.compile(rb"\r\n|\n|\r")


def _cut(text: bytes) -> list[bytes]:
    """The lines of a text that ends with a line's end."""
    return text.replace(b"\r\n", b"\n").replace(b"\r", b"\n").split(b"\n")[:-1]


def _blocks(path: str, start: int, end: int) -> Iterator[list[bytes]]:
    """The lines that begin in ``[start, end)`` of a file, some at a time. Lines end with a line feed, a carriage return or both."""
    files, name = opened(path)
    with files.open_input_file(name) as stream:
        held, at = b"", max(start - 1, 0)
        stream.seek(at)
        begun = first = start == 0
        while at < end or not begun:
            block = stream.read(BLOCK)
            held += block
            if not begun:
                # the line that the split begins in belongs to the split before; a last carriage return may be half of a line's end
                found = _END.search(held)
                if found and (found.end() < len(held) or not block):
                    held, at, begun = held[found.end():], at + found.end(), True
                elif not block:
                    return
                else:
                    continue
            if at >= end:
                return
            whole = len(held) if not block else max(held.rfind(b"\n"), held.rfind(b"\r", 0, -1)) + 1
            text, held = held[:whole], held[whole:]
            if not block and text and text[-1:] not in (b"\n", b"\r"):
                text += b"\n"
            if at + len(text) > end:
                text = text[:_END.search(text, max(end - at - 1, 0)).end()]
                at = end
            at = max(at, at + len(text)) if at < end else end
            if text:
                lines = _cut(text)
                if first and lines[0].startswith(b"\xef\xbb\xbf"):
                    lines[0] = lines[0][3:]  # a mark of the byte order
                first = False
                yield lines
            if not block:
                return


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["source_path", "split", "value"]

    def given(rows: list) -> pa.RecordBatch:
        paths, splits, values = zip(*rows)
        sizes = [len(v) for v in values]
        texts = pa.array([x for v in values for x in v], pa.binary()).view(pa.string())
        index = pa.array([i for i, n in enumerate(sizes) for _ in range(n)], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(paths).take(index), pa.array(splits, pa.int64()).take(index), texts], names)

    rows, held = [], 0
    for batch in batches:
        for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "split", "until"))):
            for lines in _blocks(path, start, end):
                rows.append((uri(path), start, lines))
                held += sum(map(len, lines)) + 16 * len(lines)
                if held >= BLOCK:
                    yield given(rows)
                    rows, held = [], 0
    if rows:
        yield given(rows)


def lines_of(files: DataFrame, split_bytes: int, then, schema: str) -> DataFrame:
    """``then`` over batches of ``source_path, split, value``: the lines of the files, those of a split (``split_bytes`` long, named by
    its place) one after another in one task."""
    cut = files.selectExpr("path", "size", f"explode(sequence(0L, size - 1, {split_bytes}L)) AS split").selectExpr(
        "path", "split", f"least(size, split + {split_bytes}) AS until", "least(size - split, {0}) AS size".format(split_bytes))
    return dealt(cut).mapInArrow(lambda batches: then(_lines(batches)), schema)
