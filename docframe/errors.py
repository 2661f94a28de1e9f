"""Exceptions: one base class and a class for each kind of failure."""


class DocframeError(Exception):
    """Base of all errors that docframe raises."""


class SchemaNotFoundError(DocframeError):
    """A table folder has no schema file."""


class SchemaInvalidError(DocframeError):
    """A schema file is malformed."""


class ParseError(DocframeError):
    """A document cannot be parsed."""


class QueryParseError(DocframeError):
    """A statement is not in the dialect."""


class QueryExecutionError(DocframeError):
    """A statement names something that does not exist or cannot be run."""


class DatabaseConfigError(DocframeError):
    """A database configuration is malformed."""


class JournalRecoveryError(DocframeError):
    """A journal of an interrupted write cannot be read."""
