"""Deterministic sinks: CSV, JSON, Markdown, GraphML, digests and run status."""

from __future__ import annotations

import json
import math
import platform
import time
from collections.abc import Callable
from dataclasses import asdict, is_dataclass
from datetime import date, datetime, timezone
from enum import Enum
from xml.sax.saxutils import escape, quoteattr

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import file_digest


def compatible(x: object) -> object:
    """A value as JSON has it: enums by value, instants as ISO text, what is not finite as null."""
    if isinstance(x, Enum):
        return compatible(x.value)
    if is_dataclass(x) and not isinstance(x, type):
        return compatible(asdict(x))
    if hasattr(x, "asDict"):
        return compatible(x.asDict())
    if isinstance(x, dict):
        return {str(k): compatible(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set, frozenset)):
        return [compatible(v) for v in (sorted(x) if isinstance(x, (set, frozenset)) else x)]
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    return x.isoformat() if isinstance(x, (date, datetime)) else x


def _cell(x: object) -> str:
    if x is None or (isinstance(x, float) and not math.isfinite(x)):
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return f"{x:.10g}"
    if isinstance(x, datetime):
        return x.replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%S") + (f".{x.microsecond // 1000:03d}" if x.microsecond else "") + "Z"
    text = json.dumps(compatible(x), sort_keys=True) if isinstance(x, (dict, list)) else str(x)
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n\r') else text


def write_csv(df: DataFrame, path: str, keys: list[str]) -> str:
    """A small result as CSV ordered by its keys, row by row from the driver's iterator,
    with its SHA-256 beside it.  Large results belong in Parquet."""
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        f.write(",".join(df.columns) + "\n")
        for row in df.orderBy(*keys).toLocalIterator():
            f.write(",".join(map(_cell, row)) + "\n")
    return write_digest(path)


def write_json(value: object, path: str) -> str:
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        json.dump(compatible(value), f, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False)
        f.write("\n")
    return write_digest(path)


def write_digest(path: str) -> str:
    digest = file_digest(path)
    with open(f"{path}.sha256", "w", encoding="utf-8", newline="\n") as f:
        f.write(f"{digest}  {path.rpartition('/')[2]}\n")
    return digest


def markdown(title: str, sections: dict[str, DataFrame | str], limit: int = 200) -> str:
    """A report: texts as they are, frames as tables of at most ``limit`` rows."""
    out = [f"# {title}"]
    for name, body in sections.items():
        out += ["", f"## {name}", ""]
        if isinstance(body, str):
            out.append(body)
            continue
        out += ["| " + " | ".join(body.columns) + " |", "|" + " --- |" * len(body.columns)]
        out += ["| " + " | ".join(_cell(x).replace("|", "\\|") for x in row) + " |" for row in body.limit(limit).collect()]
    return "\n".join(out) + "\n"


def graphml(edges: DataFrame, source: str = "source", target: str = "target", weight: str = "weight") -> str:
    """An undirected weighted graph, nodes and edges in name order."""
    rows = sorted((tuple(sorted((r[source], r[target]))), r[weight]) for r in edges.select(source, target, weight).collect())
    nodes = sorted({n for pair, _ in rows for n in pair})
    out = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '  <key id="w" for="edge" attr.name="weight" attr.type="double"/>', '  <graph edgedefault="undirected">']
    out += [f"    <node id={quoteattr(n)}/>" for n in nodes]
    out += [f"    <edge source={quoteattr(a)} target={quoteattr(b)}><data key=\"w\">{escape(_cell(w))}</data></edge>" for (a, b), w in rows]
    return "\n".join([*out, "  </graph>", "</graphml>"]) + "\n"


def provenance(spark, inputs: list[str], outputs: list[str]) -> dict:
    return {
        "spark": spark.version, "pyspark": pyspark.__version__, "python": platform.python_version(), "system": platform.platform(),
        "session": {k: spark.conf.get(k) for k in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled")},
        "inputs": {p: file_digest(p) for p in inputs}, "outputs": {p: file_digest(p) for p in outputs},
    }


def timed_stages(stages: list[tuple[str, Callable]], context: dict) -> list[dict]:
    """Run stages in order over one context, each to its end, with wall times.  A frame
    that a stage returns is counted, since frames are lazy."""
    out = []
    for name, stage in stages:
        began = time.monotonic()
        result = stage(context)
        rows = result.agg(F.count("*")).first()[0] if isinstance(result, DataFrame) else None
        context[name] = result
        out.append({"stage": name, "seconds": time.monotonic() - began, "rows": rows})
    return out


def on_alert(batch: DataFrame, notify: Callable[[dict], None]) -> int:
    """Hand each alert row to the caller's function; nothing is sent by itself."""
    n = 0
    for row in batch.toLocalIterator():
        notify(compatible(row))
        n += 1
    return n
