"""DataFrame operators for document retrieval, request admission and guarded SQL on Spark."""

from fathomdoc.config import Settings

__all__ = ["Settings"]
