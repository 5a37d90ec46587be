"""Detection and redaction of sensitive text as Spark plans."""

from __future__ import annotations

from importlib import import_module

#: Names offered here, and the modules that hold them; loaded when asked for, so that Python workers need not.
_HOMES = {
    "Config": "umbra.config", "CustomRule": "umbra.config", "ModelConfig": "umbra.config", "Sanitizer": "umbra.plans.sanitize",
    "MATCHES": "umbra.operators.detect", "DetectorSpec": "umbra.operators.specs", "sanitize_text": "umbra.plans.single",
    "SanitizedText": "umbra.plans.single", "Match": "umbra.plans.single",
}
__all__ = sorted(_HOMES)


def __getattr__(name: str):
    if name in _HOMES:
        return getattr(import_module(_HOMES[name]), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
