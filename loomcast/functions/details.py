"""What an exception says about the fields of a structured output, as JSON and as rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed limits: causes that are followed, characters of an input and of a raw response.
MOST_CAUSES = 10
INPUT_CHARS = 100
RAW_CHARS = 1000
DETAIL = "struct<depth: int, error_type: string, message: string, raw: string, fields: array<struct<path: string, type: string, msg: string, input: string>>>"


def _fields(error: BaseException) -> list[dict]:
    given = getattr(error, "errors", None)
    try:
        found = given() if callable(given) else given or []
        return [{"path": " -> ".join(map(str, f.get("loc", ()))), "type": f.get("type"), "msg": f.get("msg"), "input": str(f.get("input"))[:INPUT_CHARS]} for f in found]
    except Exception:  # an error of a foreign shape has no fields
        return []


def error_detail(error: BaseException) -> str:
    """The error and what caused it, each with the fields that it names, as JSON (an array of DETAIL)."""
    out, now = [], error
    while now is not None and len(out) < MOST_CAUSES:
        raw = next((str(r)[:RAW_CHARS] for k in ("raw", "body", "response") if (r := getattr(now, k, None)) is not None), None)
        out.append({"depth": len(out), "error_type": type(now).__name__, "message": str(now), "raw": raw, "fields": _fields(now)})
        now = now.__cause__
    return json.dumps(out, default=str)


def validation_errors(attempts: DataFrame) -> DataFrame:
    """item_id, generation, attempt, depth, error_type, path, type, msg, input, raw: a row for each field that
    an attempt's error, or a cause of it, names. Attempts without a detail have none."""
    details = attempts.select("item_id", "generation", "attempt", F.explode(F.from_json("error_detail", f"array<{DETAIL}>")).alias("d"))
    fields = details.select("item_id", "generation", "attempt", "d.depth", "d.error_type", "d.raw", F.explode("d.fields").alias("f"))
    return fields.select("item_id", "generation", "attempt", "depth", "error_type", "f.path", "f.type", "f.msg", "f.input", "raw")
