"""A site's pipeline: transformers, filters and emitters, put together by configuration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import is_true

Transformer = Callable[[DataFrame], DataFrame]
Filter = Callable[[DataFrame], Column]
Emitter = Callable[[DataFrame], DataFrame]


def remove_drafts(pages: DataFrame) -> Column:
    return ~is_true(F.col("draft"))


def explicit_publish(pages: DataFrame) -> Column:
    return is_true(F.col("publish"))


@dataclass
class Pipeline:
    """Transformers run in order; a page stays if all filters hold; each emitter sees all pages that stay.

    Filters are columns, so Spark joins them and pushes them down as far as they go.
    """

    transformers: list[Transformer] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)
    emitters: dict[str, Emitter] = field(default_factory=dict)

    def transform(self, pages: DataFrame) -> DataFrame:
        for t in self.transformers:
            pages = pages.transform(t)
        return pages

    def kept(self, pages: DataFrame) -> DataFrame:
        for f in self.filters:
            pages = pages.filter(f(pages))
        return pages

    def dropped(self, pages: DataFrame) -> DataFrame:
        keep = F.lit(True)
        for f in self.filters:
            keep = keep & F.coalesce(f(pages), F.lit(False))
        return pages.filter(~keep)

    def counted(self, pages: DataFrame) -> tuple[DataFrame, dict[str, Observation]]:
        """The pages that stay, and for each step an observation of how many passed it, which the first action on them fills: no pass of its own."""
        seen = {"read": Observation()}
        pages = self.transform(pages.observe(seen["read"], F.count(F.lit(1)).alias("n")))
        for k, f in enumerate(self.filters):
            seen[f"filter {k}"] = Observation()
            pages = pages.filter(f(pages)).observe(seen[f"filter {k}"], F.count(F.lit(1)).alias("n"))
        return pages, seen

    def run(self, pages: DataFrame) -> dict[str, DataFrame]:
        out = self.kept(self.transform(pages))
        return {name: emit(out) for name, emit in self.emitters.items()}


def rendered(pages: DataFrame, all_files: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """What a component shows of each page, given what it looks up among all files by ``key``."""
    return pages.join(all_files, key).select(*columns)
