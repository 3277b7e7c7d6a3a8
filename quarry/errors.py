"""Errors, each with a machine-readable type and an HTTP-like status."""

from __future__ import annotations

from typing import Any


class QuarryError(Exception):
    error_type, status = "engine_error", 500

    def __init__(self, message: str, detail: dict[str, Any] | None = None) -> None:
        super().__init__(message)
        self.detail = detail or {}

    def to_dict(self) -> dict[str, Any]:
        return {"type": self.error_type, "reason": str(self), **({"detail": self.detail} if self.detail else {})}


class ConfigurationError(QuarryError):
    error_type = "configuration_error"


class StorageError(QuarryError):
    error_type = "storage_error"


class BackendNotAvailableError(QuarryError):
    error_type, status = "backend_not_available", 501


class IndexNotFoundError(QuarryError):
    error_type, status = "index_not_found", 404


class IndexAlreadyExistsError(QuarryError):
    error_type, status = "index_already_exists", 409


class MappingError(QuarryError):
    error_type, status = "mapping_error", 400


class InvalidQueryError(QuarryError):
    error_type, status = "invalid_query", 400


class UnsupportedFeatureError(InvalidQueryError):
    error_type = "unsupported_feature"


class PluginError(QuarryError):
    error_type = "plugin_error"


class IngestError(QuarryError):
    error_type, status = "ingest_error", 400
