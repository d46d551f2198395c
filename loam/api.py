"""The engine's methods over one memory table; each gives a DataFrame and nothing is collected."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from loam.operators import governance, lifecycle, memory, retrieval, search, writes


@dataclass
class Engine:
    """``memories``: id, text, category, scope, importance, timestamp_ms, metadata."""

    memories: DataFrame
    as_of_ms: int = memory.AS_OF_MS

    def rows(self, scopes: list[str] | None = None) -> DataFrame:
        return memory.normalised(self.memories.where(memory.in_scopes(scopes)), self.as_of_ms)

    def recall(self, queries: DataFrame, scopes: list[str] | None = None, limit: int = 3, profile: str = "simple", active: bool = True, vectors: DataFrame | None = None) -> DataFrame:
        """(query_id, id, rank, score): statistics are those of all memories; scopes and activity are tested before the best
        ones are taken. With ``vectors`` (id, vec) and a column ``vec`` of the queries recall is hybrid."""
        rows = self.rows(None)
        allowed = retrieval.allowed_ids(rows, scopes, self.as_of_ms if active else None)
        if vectors is not None:
            return retrieval.recall(self.memories, vectors, queries, rows, self.as_of_ms, limit, allowed)
        hits = retrieval.bm25_arm(self.memories, queries, limit, allowed)
        if profile == "simple":
            return search.simple_chain(hits, rows, self.as_of_ms, limit)
        return search.lifecycle_chain(hits, lifecycle.decay(rows, self.as_of_ms), self.as_of_ms, limit)

    def trace(self, queries: DataFrame, scopes: list[str] | None = None, limit: int = 3) -> DataFrame:
        """(query_id, stage, n, low, high) of a recall's stages."""
        hits = retrieval.bm25_arm(self.memories, queries, limit, retrieval.allowed_ids(self.rows(None), scopes, self.as_of_ms))
        return search.trace([("search", hits, "score"), ("final", search.simple_chain(hits, self.rows(None), self.as_of_ms, limit), "score")])

    def promote(self, ids: DataFrame) -> DataFrame:
        """(id, metadata) of the ids as durable memories."""
        return writes.patched(self.rows(None), writes.patches_of(ids, writes.promotion(self.as_of_ms)), self.as_of_ms)

    def archive(self, ids: DataFrame) -> DataFrame:
        return writes.patched(self.rows(None), writes.patches_of(ids, writes.archival(self.as_of_ms)), self.as_of_ms)

    def change(self, changes: DataFrame) -> DataFrame:
        """The memories after manual changes (id, text, new_id)."""
        return writes.updated(self.memories, changes, self.as_of_ms)

    def context(self, queries: DataFrame, scopes: list[str] | None = None, **budget) -> DataFrame:
        return search.packed(self.recall(queries, scopes, limit=10), self.memories, **budget)

    def list(self, scopes: list[str] | None = None, category: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        return memory.listed(self.memories, scopes, category, limit, offset)

    def stats(self) -> DataFrame:
        return memory.stats(self.memories)

    def inspect(self, prefix: str) -> DataFrame:
        return memory.by_prefix(self.rows(), prefix)

    def govern(self, scopes: list[str] | None = None) -> DataFrame:
        return governance.review_candidates(self.rows(scopes))

    def conflicts(self) -> DataFrame:
        return governance.conflicts(self.memories)

    def compact(self) -> DataFrame:
        return memory.exact_duplicates(self.memories)

    def ingest(self, new: DataFrame) -> DataFrame:
        return writes.ingested(new, self.memories)

    def update(self, decisions: DataFrame) -> DataFrame:
        return writes.decided(self.memories, decisions, self.as_of_ms)

    def forget(self, ids: DataFrame) -> Engine:
        from loam.sources.io import delete

        return Engine(delete(self.memories, ids), self.as_of_ms)
