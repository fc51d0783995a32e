"""Intermediate tables: those of the engine's own, under the name that the operators here use."""

from ..functions.tables import Scope, delete, persisted, scope, shared_dir, small_batches, temporary

__all__ = ["Scope", "delete", "persisted", "scope", "shared_dir", "small_batches", "temporary"]
