"""Structured logging on the driver: JSON or text lines, the current document and step in each, files that rotate."""

from __future__ import annotations

import contextlib
import contextvars
import json
import logging
import logging.handlers
import re
import sys
import traceback
from datetime import datetime, timezone

_ROOT = "factloom"
_context: contextvars.ContextVar[dict] = contextvars.ContextVar("factloom_context", default={})


@contextlib.contextmanager
def context(**values: str):
    """document_id, run_id, step, agent ... that every line inside carries; inner ones add to outer ones."""
    token = _context.set(_context.get() | {k: v for k, v in values.items() if v is not None})
    try:
        yield
    finally:
        _context.reset(token)


def told(record: logging.LogRecord) -> dict:
    """What a line says: when, how grave, who, what; then, where there is any, the context, the record's data and the traceback."""
    error = record.exc_info[1] if record.exc_info else None
    optional = {"context": _context.get(), "data": getattr(record, "data", None), "exception": "".join(traceback.format_exception(error)).rstrip() if error else ""}
    when = datetime.fromtimestamp(record.created, timezone.utc)
    return {"timestamp": when.isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()} | {k: v for k, v in optional.items() if v}


def _as_text(line: dict) -> str:
    where = "".join(f" {k}={v}" for k, v in line.get("context", {}).items())
    return "{timestamp:.19} {level} {logger}{where} - {message}".format(**line, where=where) + (f"\n{line['exception']}" if "exception" in line else "")


#: How a line is written, by style.
STYLES = {"json": lambda line: json.dumps(line, default=str, ensure_ascii=False), "text": _as_text}


class Lines(logging.Formatter):
    def __init__(self, style: str):
        super().__init__()
        self._write = STYLES["json" if style == "json" else "text"]

    def format(self, record: logging.LogRecord) -> str:
        return self._write(told(record))


def size_of(text: str) -> int:
    """'10MB' as bytes."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([KMG]?)B?\s*", text.upper())
    if not m:
        raise ValueError(f"no size: {text}")
    return int(float(m[1]) * 1024 ** " KMG".index(m[2] or " "))


def setup(level: str = "INFO", style: str = "json", file: str = "", rotation: str = "10MB", retention: int = 30) -> logging.Logger:
    """Lines to stderr and, if asked, to a file on the driver that starts anew at a size, ``retention`` old ones kept. Replaces what was set up before."""
    log = logging.getLogger(_ROOT)
    for handler in list(log.handlers):
        log.removeHandler(handler)
        handler.close()
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stderr)]
    if file:
        handlers.append(logging.handlers.RotatingFileHandler(file, maxBytes=size_of(rotation), backupCount=retention, encoding="utf-8"))
    for handler in handlers:
        handler.setFormatter(Lines(style))
        log.addHandler(handler)
    log.setLevel(level)
    log.propagate = False
    return log


def get(name: str) -> logging.Logger:
    return logging.getLogger(f"{_ROOT}.{name}")
