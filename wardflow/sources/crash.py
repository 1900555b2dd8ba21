"""A log of a job that failed: one text file, named by the time, in a folder of the driver."""

from __future__ import annotations

import platform
import sys
import traceback
from collections.abc import Mapping
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark import __version__ as spark_version


def write_crash_log(error: BaseException, folder: str | Path, context: Mapping[str, Any] | None = None, now: datetime | None = None) -> Path | None:
    """The file written; None if it could not be, in which case the error is printed to stderr. Logs of the same second are numbered."""
    now = now or datetime.now()
    told = "".join(traceback.format_exception(error))
    facts = {"time": now.isoformat(), "Spark": spark_version, "Python": platform.python_version(), "platform": platform.platform()} | {f"context {k}": v for k, v in (context or {}).items()}
    text = "".join(f"{k}: {v}\n" for k, v in facts.items()) + "\n" + told
    try:
        at = Path(folder)
        at.mkdir(parents=True, exist_ok=True)
        n = 0
        while True:
            path = at / f"{now:%Y%m%d-%H%M%S}{f'-{n}' if n else ''}.log"
            try:
                with path.open("x", encoding="utf-8") as f:
                    f.write(text)
                return path.resolve()
            except FileExistsError:
                n += 1
    except OSError as own:
        print(f"no crash log could be written to {folder}: {own}\n{told}", file=sys.stderr)
        return None
