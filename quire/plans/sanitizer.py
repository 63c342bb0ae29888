"""What is taken out of documents: all removals of actions in one walk, then the structures, in one pass over the files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.operators import actions
from quire.session import batched, shipped
from quire.sources.edit import Editor
from quire.sources.writer import Options


class Sanitizer:
    """Calls can be chained; their order doesn't matter and repeating one changes nothing."""

    def __init__(self):
        self.subtypes: set[str] = set()
        self.steps: dict[str, Callable[[Editor], None]] = {}

    def _step(self, name: str, step: Callable[[Editor], None]) -> Sanitizer:
        self.steps[name] = step
        return self

    def remove_javascript(self) -> Sanitizer:
        self.subtypes |= set(actions.JAVASCRIPT)
        return self

    def remove_external_access(self) -> Sanitizer:
        self.subtypes |= set(actions.EXTERNAL)
        return self

    def remove_multimedia(self) -> Sanitizer:
        self.subtypes |= set(actions.MULTIMEDIA)
        return self._step("multimedia", lambda e: e.remove_annotations(set(actions.MULTIMEDIA_ANNOTATIONS)))

    def remove_attachments(self) -> Sanitizer:
        return self._step("attachments", Editor.remove_attachments)

    def remove_thumbnails(self) -> Sanitizer:
        return self._step("thumbnails", lambda e: e.remove_keys("/Thumb", catalog_only=False))

    def remove_search_index(self) -> Sanitizer:
        def step(e: Editor) -> None:
            if isinstance(info := e.get(e.root.get("/PieceInfo")), dict):
                info.pop("/SearchIndex", None)

        return self._step("search index", step)

    def remove_web_capture(self) -> Sanitizer:
        def step(e: Editor) -> None:
            e.remove_keys("/SpiderInfo")
            if isinstance(names := e.get(e.root.get("/Names")), dict):
                names.pop("/IDS", None), names.pop("/URLS", None)

        return self._step("web capture", step)

    def remove_private_app_data(self) -> Sanitizer:
        return self._step("private data", lambda e: e.remove_keys("/PieceInfo", catalog_only=False))

    def remove_collection(self) -> Sanitizer:
        return self._step("collection", lambda e: e.remove_keys("/Collection"))

    def edit(self, e: Editor) -> None:
        """One document."""
        if self.subtypes:
            e.remove_actions(self.subtypes)
        for step in self.steps.values():
            step(e)

    def apply(self, files: DataFrame, options: Options = Options()) -> DataFrame:
        """``path, content, problem`` of files sanitized; a file that can't be read has no content."""
        return edited(files, self.edit, options)


def edited(files: DataFrame, change: Callable[[Editor], None], options: Options = Options(), password: str = "") -> DataFrame:
    """Each file of ``path, content`` changed by itself; narrow, a file at a time."""
    if problem := options.problem():
        raise ValueError(problem)

    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("problem", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                out = why = None
                try:
                    e = Editor(batch.column(1)[i].as_py() or b"", password.encode())
                    change(e)
                    out = e.bytes(options)
                except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError) as x:
                    why = f"{type(x).__name__}: {x}"
                yield batch.column(0)[i].as_py(), out, why

    return shipped(files).select("path", "content").mapInArrow(lambda batches: batched(rows(batches), schema), "path string, content binary, problem string")


def flagged(rows: DataFrame, wanted: Sanitizer) -> DataFrame:
    """Rows of the table of actions that the sanitizer would take out, as one filter."""
    return rows.where(rows["subtype"].isin(*sorted(wanted.subtypes)))
