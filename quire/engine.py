"""Facade: named capabilities over a library, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quire.operators import graph, library, merge, search
from quire.operators.search_index import SearchIndex
from quire.session import importable


@dataclass
class Engine:
    """A library's relations and the operations on them.

    sources: job_id, kind, source_id, text · index: a kept index of them, which is read in their place · items: job_id, folder_ids, deleted, ... · folders: folder_id, parent_id
    """

    spark: SparkSession
    sources: DataFrame | None = None
    items: DataFrame | None = None
    folders: DataFrame | None = None
    index: SearchIndex | None = None
    scopes: list[str] = field(default_factory=lambda: [f"read:{k}" for k in search.KINDS])

    def __post_init__(self) -> None:
        importable(self.spark)

    def _capabilities(self) -> dict[str, Callable[..., DataFrame]]:
        return {
            "search_library": self.search_library, "list_items": lambda: library.live(self.items), "folder_counts": lambda include_trash=False: library.folder_counts(self.items, self.folders, include_trash),
            "folder_ancestors": lambda: library.ancestors(self.folders), "view": lambda filters, sort_by, direction="asc": library.view(self.items, filters, sort_by, direction, "job_id"),
            "similarity_graph": lambda papers, k=2, threshold=0.0: graph.similarity_edges(papers, k, threshold), "anchor_quotes": lambda quotes, texts: merge.anchored(quotes, texts),
        }

    def search_library(self, query: str = "", limit: int = 30, offset: int = 0, kinds: list[str] | None = None, folder_items: DataFrame | None = None) -> DataFrame:
        granted = search.allowed_kinds(self.scopes, kinds)
        if self.index is not None:
            return self.index.search(query, limit, offset, granted, folder_items)
        return search.search(self.sources, query, limit, offset, granted, folder_items)

    def names(self) -> list[str]:
        return sorted(self._capabilities())

    def call(self, name: str, **args: object) -> DataFrame:
        """Runs a capability by name; unknown names and arguments are errors."""
        try:
            return self._capabilities()[name](**args)
        except KeyError:
            raise ValueError(f"no capability {name!r}; there are {self.names()}") from None
