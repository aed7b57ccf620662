"""One object for a table of documents, and its results as temporary views for SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from .operators import cache, diff, lint, resolve, segment, stamp
from .session import ship


class DocFrame:
    """A version of a corpus: rows with key columns and ``text``. Other columns are not read."""

    def __init__(self, documents: DataFrame, keys: list[str], text: str = "text"):
        ship(documents.sparkSession)
        self.keys, self.documents = keys, documents.select(*keys, documents[text].alias("text"))

    @cached_property
    def blocks(self) -> DataFrame:
        return segment.blocks(self.documents, self.keys)

    @cached_property
    def markers(self) -> DataFrame:
        return segment.markers(self.blocks, self.keys)

    def lint(self) -> DataFrame:
        return lint.sorted_findings(lint.marker_findings(self.markers, self.keys), self.keys)

    def diff(self, later: DocFrame, check_collections: bool = False) -> DataFrame:
        sides = (diff.id_index(v.blocks, self.keys) for v in (self, later))
        return diff.findings(diff.compare(*sides, self.keys), self.keys, check_collections)

    def resolve(self, later: DocFrame, **setting) -> DataFrame:
        """Where the ids of this version are in a later one."""
        return resolve.resolve(resolve.anchors(self.blocks, self.keys), later.blocks, self.keys, **setting)

    def stamp(self) -> DocFrame:
        return DocFrame(stamp.stamp(self.blocks, self.keys), self.keys)

    def restamp(self) -> DocFrame:
        return DocFrame(stamp.restamp(self.blocks, self.keys), self.keys)

    def chunks(self, strict: bool = False) -> DataFrame:
        return cache.chunks(self.blocks, lint.marker_findings(self.markers, self.keys), self.keys, strict)

    def register(self, prefix: str = "") -> None:
        """Temporary views blocks, markers and findings."""
        for name, df in (("blocks", self.blocks), ("markers", self.markers), ("findings", self.lint())):
            df.createOrReplaceTempView(prefix + name)
