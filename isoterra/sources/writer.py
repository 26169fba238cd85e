"""Square and change files on a shared file system: each file by one task, under another name until it is whole."""

from __future__ import annotations

import lzma
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from isoterra.sources import osm


def write_texts(text: DataFrame, folder: str, ending: str, compress: bool = False) -> DataFrame:
    """Write square, text rows as folder/SQUARE.ending; returns square, path, size as the files are written.

    folder is a path or URI that all executors share. A file is written beside its place and moved there, so that a reader
    or a lost task never leaves half of one; a task that runs again puts the same file there. `compress`: xz, with .xz
    added to the name. An empty text is a file without bytes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        files.create_dir(root, recursive=True)
        for b in batches:
            done = []
            for square, body in zip(b["square"], b["text"], strict=True):
                path = f"{root}/{square}.{ending}" + (".xz" if compress else "")
                part = f"{path}.{TaskContext.get().taskAttemptId()}.part"
                data = lzma.compress(body.encode()) if compress else body.encode()
                with files.open_output_stream(part) as out:
                    out.write(data)
                files.move(part, path)
                done.append((square, path, len(data)))
            yield pd.DataFrame(done, columns=["square", "path", "size"])

    return text.select("square", "text").mapInPandas(run, "square string, path string, size long")


def write_squares(elements: DataFrame, folder: str, compress: bool = True) -> DataFrame:
    """Elements as square files; the same elements give the same bytes."""
    return write_texts(osm.square_texts(elements), folder, "osm", compress)


def write_changes(elements: DataFrame, folder: str) -> DataFrame:
    """Elements with an op as change files."""
    return write_texts(osm.change_texts(elements), folder, "osc")


def blank_squares(square: DataFrame, folder: str) -> DataFrame:
    """Files of squares that hold nothing yet."""
    body = '<?xml version="1.0" encoding="UTF-8"?>\n<osm version="0.6">\n</osm>\n'
    return write_texts(square.selectExpr("square", f"'{body}' AS text"), folder, "osm", True)
