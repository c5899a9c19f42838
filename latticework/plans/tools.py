"""A thin dispatcher: tools by name, with plain parameters, for whatever front end calls them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from latticework.errors import ConfigError, SymbolNotFound
from latticework.operators import calls as C
from latticework.operators import search, traverse
from latticework.plans import commands


def _path(topology: commands.Topology, source: str, target: str, max_depth: int = 20, direction: str = "down") -> DataFrame:
    ends = []
    for name in (source, target):
        found = search.resolve_target(topology.nodes, name).orderBy("id").first()
        if found is None:
            raise SymbolNotFound(name)
        ends.append(found.id)
    hops = traverse.find_path(topology.edges, *ends, max_depth=max_depth, direction=direction)
    return hops.join(topology.nodes.select("id", "name", "file", "line", "repo"), hops["node"] == topology.nodes["id"]).drop("id").orderBy("hop")


def _diff(topology: commands.Topology, before: DataFrame) -> DataFrame:
    return C.key_diff(before, topology.calls)


TOOLS: dict[str, Callable[..., DataFrame]] = {"path": _path, "network": commands.network, "diff": _diff, "explain": commands.explain}


def call(topology: commands.Topology, name: str, **parameters) -> DataFrame:
    if name not in TOOLS:
        raise ConfigError(f"no tool {name}; there are {', '.join(sorted(TOOLS))}")
    return TOOLS[name](topology, **parameters)
