"""A log file that is rotated by size to one older file."""

from __future__ import annotations

import logging
from logging.handlers import RotatingFileHandler

from .config import Config


def start(config: Config) -> logging.Handler | None:
    """Log statements of all sessions of this process to the configured file; their texts are never logged."""
    if not config.log_enabled or not config.log_file:
        return None
    handler = RotatingFileHandler(config.log_file, maxBytes=config.log_max_size, backupCount=1, encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log = logging.getLogger("engram")
    log.setLevel(logging.WARNING if config.log_level == "warn" else config.log_level.upper())
    log.addHandler(handler)
    return handler
