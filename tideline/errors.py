"""The errors of the pipeline."""


class PipelineError(Exception):
    """Base of all errors here."""


class MissingMetadata(PipelineError):
    """A batch lacks metadata that a rule asks for."""


class ConfigurationError(PipelineError):
    """A setting is absent or contradicts another."""


class SchemaError(PipelineError):
    """Columns or types are not what an operator needs."""


class StorageError(PipelineError):
    """A table, queue or load failed."""


class InternalError(PipelineError):
    """A state that should not arise."""


class DownstreamClosed(PipelineError):
    """An output takes no more batches."""
