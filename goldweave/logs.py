"""Debug logging of runs: silent unless the environment says PIPELINE_DEBUG=1."""

from __future__ import annotations

import logging
import os
import sys

_log = logging.getLogger("pipeline")


def enabled() -> bool:
    on = os.environ.get("PIPELINE_DEBUG", "0").strip() == "1"
    _log.setLevel(logging.DEBUG if on else logging.CRITICAL)
    if on and not _log.handlers:
        handler = logging.StreamHandler(sys.stderr)
        handler.setFormatter(logging.Formatter("%(asctime)s [PIPELINE] %(levelname)s %(message)s", "%Y-%m-%dT%H:%M:%S"))
        _log.addHandler(handler)
    return on


def event(stage: str, message: str) -> None:
    if enabled():
        _log.info("[%s] %s", stage, message)


def error(stage: str, why: Exception) -> None:
    if enabled():
        _log.error("[%s] ERROR: %s", stage, why, exc_info=True)
