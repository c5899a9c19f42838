"""What can go wrong, by name."""


class LatticeworkError(Exception):
    """Base of all errors raised on purpose."""


class CorruptGraph(LatticeworkError):
    """Stored nodes and edges do not fit together."""


class VersionMismatch(LatticeworkError):
    """A stored graph has another format version."""


class NoIndex(LatticeworkError):
    """Nothing has been built at a path."""


class RepoNotFound(LatticeworkError):
    """No such repository in the catalogue."""


class SymbolNotFound(LatticeworkError):
    """A target names no node."""


class ParseError(LatticeworkError):
    """A source cannot be parsed."""


class ConfigError(LatticeworkError):
    """A rule or catalogue file is wrong."""
