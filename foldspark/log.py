"""Levels and output of the engine's messages: trace, debug, info, warn, error, on Python's logging."""

from __future__ import annotations

import logging
from collections.abc import Callable

TRACE = 5
LEVELS = {"trace": TRACE, "debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR}
COLOURS = {"trace": "37", "debug": "36", "info": "32", "warn": "33", "error": "31"}
logger = logging.getLogger("foldspark")


class Coloured(logging.Formatter):
    def __init__(self, colour: bool):
        super().__init__("%(asctime)s [%(levelname)s] %(message)s")
        self.colour = colour

    def format(self, record: logging.LogRecord) -> str:
        name = next((n for n, level in LEVELS.items() if level == record.levelno), "info")
        text = super().format(record)
        return f"\x1b[{COLOURS[name]}m{text}\x1b[0m" if self.colour else text


def set_level(name: str, stream=None, colour: bool | None = None) -> None:
    """Messages below the level are dropped; the others go to the stream (standard error), coloured on a terminal."""
    logging.addLevelName(TRACE, "TRACE")
    logger.setLevel(LEVELS[name])
    handler = logging.StreamHandler(stream)
    handler.setFormatter(Coloured(handler.stream.isatty() if colour is None else colour))
    logger.handlers[:] = [handler]
    logger.propagate = False


def on(level: str, message: Callable[[], str]) -> None:
    """Log a message that is made only if its level is on."""
    if logger.isEnabledFor(LEVELS[level]):
        logger.log(LEVELS[level], message())
