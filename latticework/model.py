"""The property graph's schemas, kinds, flags and masks."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F


class NodeKind(IntEnum):
    REPO = 0
    DEPLOYABLE = 1
    MODULE = 2
    SYMBOL = 3
    ENDPOINT = 4
    SURFACE = 5
    INFRA_CONFIG = 6
    RESOURCE = 7


class EdgeKind(IntEnum):
    CONTAINS = 0
    CALLS = 1
    IMPORTS = 2
    DEPENDS_ON = 3
    EXPOSES = 4
    CONSUMES = 5
    CONFIGURES = 6
    RESOLVES = 7
    CONNECTS = 8
    PUBLISHES = 9
    SUBSCRIBES = 10


NODE_FLAGS = {"entry": 1, "public": 2, "deprecated": 4, "generated": 8, "test": 16}
EDGE_FLAGS = {"cross_repo": 1, "async": 2, "inferred": 4}
CROSS_REPO = EDGE_FLAGS["cross_repo"]

ALL_EDGES = 0x07FF
SERVICE_EDGES = 1 << 3 | 1 << 4 | 1 << 5
CODE_EDGES = 1 << 1 | 1 << 2

SUB_FUNCTION, SUB_TYPE = 0, 1
SUB_HTTP, SUB_WEBSOCKET, SUB_QUEUE = 0, 1, 3

#: Schemas, as DDL.
NODES = "id bigint, kind tinyint, sub_kind tinyint, flags int, name string, file string, line int, parent bigint, repo int"
EDGES = "src bigint, dst bigint, kind tinyint, confidence smallint, flags int"
NETWORK_CALLS = "file string, line int, net_kind string, callee_fqn string, address_source string, confidence string, repo string, seq bigint"

#: Ranks of how a call's kind was found out.
CONFIDENCE_RANK = {"type_confirmed": 4, "llm_classified": 3, "import_resolved": 2, "heuristic": 1}


def kinds_of(mask: int) -> list[int]:
    """The edge kinds of a mask: a list, so that a filter on it reaches the scan."""
    return [k for k in range(16) if mask >> k & 1]


def mask_of(*kinds: int) -> int:
    return sum(1 << k for k in set(kinds))


def in_mask(kind: Column, mask: int) -> Column:
    return kind.isin(kinds_of(mask)) if mask & ALL_EDGES != ALL_EDGES else F.lit(True)


def has_flag(flags: Column, flag: int) -> Column:
    return flags.bitwiseAND(flag) != 0


def quantised(confidence: Column) -> Column:
    """A confidence from 0 to 1 as 0 to 255, cut off."""
    return F.floor(confidence.cast("double") * 255).cast("smallint")
