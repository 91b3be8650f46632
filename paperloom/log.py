"""One logger a name, with one handler and no propagation."""

from __future__ import annotations

import logging


def get_logger(name: str = "paperloom", level: int = logging.INFO) -> logging.Logger:
    """Asking again for a name gives the same logger and adds no handler."""
    logger = logging.getLogger(name)
    logger.setLevel(level)
    logger.propagate = False
    if not logger.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        logger.addHandler(handler)
    return logger
