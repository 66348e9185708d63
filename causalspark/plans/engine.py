"""The engine's tables over one data directory, shared by the registered queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from causalspark.operators import causality, incidents
from causalspark.session import write_table
from causalspark.sources.testmap import Sample

_STORED: dict[tuple, DataFrame] = {}


class Engine(Sample):
    """Source tables (from the adapter) plus the derived tables that many queries read.

    Episodes, the resource and edge snapshots and ``links`` are stored tables, as ingestion,
    the change-log merge and the batch rebuild leave them: written once per session to the shared checkpoint
    folder, then only read.
    """

    def stored(self, name: str, build) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.directory, name)
        if key not in _STORED:
            folder = "".join(c if c.isalnum() else "_" for c in self.directory)
            _STORED[key] = write_table(build(), f"{folder}/{name}")
        return _STORED[key]

    @cached_property
    def episodes(self) -> DataFrame:
        return self.stored("episodes", lambda: Sample.episodes.fget(self))

    @cached_property
    def edges(self) -> DataFrame:
        return self.stored("edges", lambda: Sample.edges.fget(self))

    @cached_property
    def resources(self) -> DataFrame:
        return self.stored("resources", lambda: Sample.resources.fget(self))

    @cached_property
    def links(self) -> DataFrame:
        return self.stored("links", lambda: causality.build_causality(self.episodes, self.edges))

    @cached_property
    def named_links(self) -> DataFrame:
        return causality.named_links(self.links, self.episodes)

    @cached_property
    def incidents(self) -> DataFrame:
        return incidents.sessionize_incidents(self.episodes, gap_min=INCIDENT_GAP_MIN)

    @cached_property
    def incident_members(self) -> DataFrame:
        return incidents.session_members(self.episodes, gap_min=INCIDENT_GAP_MIN)


# The sample has few events per resource, so the sample queries use a wide session gap.
INCIDENT_GAP_MIN = 720
