"""Word files as a block stream in document order: ``doc_id, block_idx, kind, style, text, cells``.

``word_blocks(spark, path)`` reads from every file system that Spark reads; a file must fit a
row. ``spark.dataSource.register(BlockSource)``, then ``spark.read.format("blocks").load(folder)``
reads a folder that all workers see under the same path, a partition a file.
"""

from __future__ import annotations

import glob
import io
import os
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "doc_id string, block_idx bigint, kind string, style string, text string, cells array<array<string>>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def _text(node: ElementTree.Element) -> str:
    parts = []
    for x in node.iter():
        if x.tag == f"{_W}t":
            parts.append(x.text or "")
        elif x.tag in (f"{_W}br", f"{_W}cr"):
            parts.append("\n")
        elif x.tag == f"{_W}tab":
            parts.append("\t")
    return "".join(parts)


def _styles(archive: zipfile.ZipFile) -> dict[str, str]:
    if "word/styles.xml" not in archive.namelist():
        return {}
    root = ElementTree.fromstring(archive.read("word/styles.xml"))
    return {s.get(f"{_W}styleId"): n.get(f"{_W}val") for s in root.iter(f"{_W}style") if (n := s.find(f"{_W}name")) is not None}


def read_blocks(path: str, content: bytes | None = None) -> Iterator[tuple]:
    """Paragraphs and tables of one file, or of its content."""
    with zipfile.ZipFile(path if content is None else io.BytesIO(content)) as archive:
        styles = _styles(archive)
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    doc, no = os.path.basename(path), 0
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            mark = node.find(f"{_W}pPr/{_W}pStyle")
            style = "Normal" if mark is None else styles.get(mark.get(f"{_W}val"), mark.get(f"{_W}val"))
            yield doc, no, "para", style, _text(node), None
        elif node.tag == f"{_W}tbl":
            cells = [["\n".join(_text(p) for p in cell.findall(f"{_W}p")) for cell in row.findall(f"{_W}tc")] for row in node.findall(f"{_W}tr")]
            yield doc, no, "table", None, None, cells
        else:
            continue
        no += 1


def word_blocks(spark: SparkSession, path: str, pattern: str = "*.docx") -> DataFrame:
    """The block stream of all Word files below ``path``, which may be a shared store."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = [field.split(" ", 1)[0] for field in SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.list_(pa.string()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(read_blocks(where, content))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    return files.mapInArrow(run, SCHEMA)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        files = [self.path] if os.path.isfile(self.path) else sorted(glob.glob(os.path.join(self.path, "**", "*.docx"), recursive=True))
        return [_File(f) for f in files]

    def read(self, partition: _File) -> Iterator[tuple]:
        yield from read_blocks(partition.path)


class BlockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])
