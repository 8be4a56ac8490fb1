"""A Python data source of positioned words: spark.read.format("document_words").option("decoder", "module:function").load(path).

The decoder is a plug: a function that gives (page, seq, text, x0, x1, top, bottom, bold) of a document's bytes. Each file
is a partition of its own; one that can't be decoded gives one row with its error and stops nothing. The files must be
readable at their path on every machine; other stores are read by sources.files.read_binaries and decode_words.
"""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docfacts.sources.files import MAGIC, MAX_BINARY

SCHEMA = "file string, page int, seq int, text string, x0 double, x1 double, top double, bottom double, bold boolean, error string"


def plug(name: str) -> Callable[[bytes], Iterator[tuple]]:
    """The function that "module:function" names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def refusal(content: bytes) -> str | None:
    """empty, too_large or not_pdf, first failure first, or None."""
    return "empty" if not content else "too_large" if len(content) > MAX_BINARY else None if content.startswith(MAGIC) else "not_pdf"


class DocumentWords(DataSource):
    """Options: path (a file, or a folder whose files with ``suffix`` are read, sub-folders too), decoder, suffix (.pdf)."""

    @classmethod
    def name(cls) -> str:
        return "document_words"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DocumentWordsReader:
        return DocumentWordsReader(self.options)


class DocumentWordsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.decoder, self.suffix = options["path"], options["decoder"], options.get("suffix", ".pdf")

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.path):
            return [InputPartition(self.path)]
        found = [os.path.join(folder, f) for folder, _, names in os.walk(self.path) for f in names if f.lower().endswith(self.suffix)]
        return [InputPartition(f) for f in sorted(found)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None or partition.value is None:  # an empty folder has one empty partition
            return
        file = partition.value
        lost = lambda why: (file, *[None] * 8, why)
        with open(file, "rb") as f:
            content = f.read(MAX_BINARY + 1)
        if why := refusal(content):
            yield lost(why)
            return
        try:
            rows = [(file, *w, None) for w in plug(self.decoder)(content)]
        except Exception as problem:  # noqa: BLE001
            rows = [lost(f"{type(problem).__name__}: {problem}"[:200])]
        yield from rows


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(DocumentWords)
