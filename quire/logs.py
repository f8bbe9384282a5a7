"""Logging of a command or a service: to the console, to a file if one is named, and to handlers of the caller's."""

from __future__ import annotations

import logging
import os
from collections.abc import Iterable

FORMAT = "%(asctime)s %(levelname)s %(name)s: %(message)s"


def configure(level: int = logging.INFO, file: str | None = None, handlers: Iterable[logging.Handler] = ()) -> logging.Logger:
    """Sets up the library's logger anew, so that calling it twice writes no line twice; what tasks log goes to their executors' own files."""
    logger = logging.getLogger("quire")
    for old in list(logger.handlers):
        logger.removeHandler(old)
        old.close()
    made: list[logging.Handler] = [logging.StreamHandler()]
    if file:
        os.makedirs(os.path.dirname(os.path.abspath(file)), exist_ok=True)
        made.append(logging.FileHandler(file, encoding="utf-8"))
    for handler in [*made, *handlers]:
        handler.setFormatter(logging.Formatter(FORMAT))
        logger.addHandler(handler)
    logger.setLevel(level)
    logger.propagate = False
    return logger
