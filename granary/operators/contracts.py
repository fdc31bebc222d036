"""Contracts of structured answers: strict schemas, checked in Spark, with diagnostics that only name what the schema names.

An answer is a JSON text. It holds if it is an object with all required fields of their types, no other fields, and values within
their bounds; else each problem is told by the path in the schema and a stable code. Unknown fields are never named: their names
are part of the answer.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from dataclasses import field as data_field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ERRORS = 20
RETRIED = frozenset((408, 429, 500, 502, 503, 504))


@dataclass(frozen=True)
class Field:
    """``kind``: string, number, boolean, array or object. ``items`` holds the fields of an object, or the one field of an array."""

    kind: str
    items: dict = data_field(default_factory=dict)
    choices: tuple[str, ...] = ()
    least: float | None = None
    most: float | None = None
    length: int | None = None


def text(length: int | None = None, choices: tuple[str, ...] = ()) -> Field:
    return Field("string", length=length, choices=choices)


def rows(**fields: Field) -> Field:
    return Field("array", {"": Field("object", fields)})


SCORE = Field("number", least=0, most=100)
TEXTS = Field("array", {"": text()})
STAGES = ("EARLY_SIGNAL", "PROCUREMENT", "AWARD", "CLOSED", "UNKNOWN")
TYPES = ("NEW_BUILD", "RETROFIT", "MAINTENANCE", "SOFTWARE", "EQUIPMENT", "MIXED", "UNKNOWN")
EVIDENCE = rows(field=text(), value=text(), source_title=text(), source_url=text(), quote=text(300))
CANDIDATES = Field("object", {"candidates": rows(title=text(), url=text(), summary=text(), source_name=text(), published=text()), "expanded_queries": TEXTS})
SEARCHES = Field("object", {"queries": TEXTS})
TRIAGE = Field("object", {"decisions": rows(id=text(), worth_research=Field("boolean"), score=SCORE, reason=text())})
RESEARCH = Field("object", {
    "title": text(), "is_real_project": Field("boolean"), "warehouse_relevance": SCORE, "owner": text(), "province": text(), "city": text(), "published": text(),
    "budget_text": text(), "deadline": text(), "stage": text(choices=STAGES), "project_type": text(choices=TYPES), "technical_scope": TEXTS, "summary": text(), "opportunity_reason": text(),
    "entry_point": text(), "source_urls": TEXTS, "evidence": EVIDENCE,
})
_TYPES = {"string": str, "boolean": bool, "array": list, "object": dict}


def problems(schema: Field, value, path: str = "") -> list[tuple[str, str]]:  # noqa: ANN001
    """(path, code) of what does not fit, in the schema's order, unknown fields last."""
    here = path or "$"
    at = lambda k: f"{path}.{k}" if path else str(k)
    if schema.kind == "number":
        if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value:
            return [(here, "float_type")]
        if schema.least is not None and value < schema.least:
            return [(here, "greater_than_equal")]
        return [(here, "less_than_equal")] if schema.most is not None and value > schema.most else []
    if not isinstance(value, _TYPES[schema.kind]):
        return [(here, {"string": "string_type", "boolean": "bool_type", "array": "list_type", "object": "model_type"}[schema.kind])]
    if schema.kind == "string":
        if schema.choices and value not in schema.choices:
            return [(here, "literal_error")]
        return [(here, "string_too_long")] if schema.length is not None and len(value) > schema.length else []
    if schema.kind == "array":
        return [p for i, x in enumerate(value) for p in problems(schema.items[""], x, at(i))]
    if schema.kind == "object":
        out = []
        for k, f in schema.items.items():
            out += problems(f, value[k], at(k)) if k in value else [(at(k), "missing")]
        return out + [(at("[unknown_field]"), "extra_forbidden") for k in value if k not in schema.items]
    return []


def diagnosed(schema: Field, answer: str | None) -> list[tuple[str, str]]:
    if not (answer or "").strip():
        return [("$", "empty_response")]
    try:
        value = json.loads(answer)
    except (ValueError, RecursionError):
        return [("$", "json_invalid")]
    return problems(schema, value)[:MOST_ERRORS]


def checked(answers: DataFrame, schema: Field, key: str = "id", payload: str = "payload") -> DataFrame:
    """key, valid, errors (array<struct<path, type>>, 20 at most) of each answer."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [diagnosed(schema, x) for x in pdf[payload]]
            yield pd.DataFrame({key: pdf[key], "valid": [not f for f in found], "errors": [[{"path": p, "type": t} for p, t in f] for f in found]})

    kind = answers.schema[key].dataType.simpleString()
    return answers.select(key, payload).mapInPandas(run, f"`{key}` {kind}, valid boolean, errors array<struct<path:string,type:string>>")


def spark_type(schema: Field) -> str:
    """The schema as a Spark type, to read valid answers with ``from_json``."""
    if schema.kind == "object":
        return "struct<" + ",".join(f"{k}:{spark_type(f)}" for k, f in schema.items.items()) + ">"
    if schema.kind == "array":
        return f"array<{spark_type(schema.items[''])}>"
    return {"string": "string", "number": "double", "boolean": "boolean"}[schema.kind]


def strict_schema(schema: Field) -> dict:
    """The schema as JSON Schema for providers: all fields required, no others allowed."""
    if schema.kind == "object":
        return {"type": "object", "properties": {k: strict_schema(f) for k, f in schema.items.items()}, "required": list(schema.items), "additionalProperties": False}
    if schema.kind == "array":
        return {"type": "array", "items": strict_schema(schema.items[""])}
    limits = {"minimum": schema.least, "maximum": schema.most, "maxLength": schema.length, "enum": list(schema.choices) or None}
    return {"type": schema.kind} | {k: v for k, v in limits.items() if v is not None}


def parsed(answers: DataFrame, schema: Field, key: str = "id", payload: str = "payload") -> DataFrame:
    """key and ``data`` of the answers that hold."""
    valid = checked(answers, schema, key, payload).where("valid").select(key)
    return answers.join(valid, key, "left_semi").select(key, F.from_json(payload, spark_type(schema)).alias("data"))


def retry_feedback(errors: list[tuple[str, str]], research: bool = False) -> str:
    """What a second request says about the first answer. Its sentences."""
    told = "\n".join(f"{i}. {path}: {code}" for i, (path, code) in enumerate(errors, 1))
    rule = "没有证据时使用 evidence=[]，提供的每条 Evidence 必须完整。" if research else ""
    return f"\n上次返回的 JSON 有以下结构错误（字段路径: 错误类型）：\n{told}\n请只修正 JSON 结构和字段类型，不要增加任何来源材料中不存在的新事实。未知事实继续使用空字符串、空数组或 UNKNOWN；必填字段仍须明确返回。{rule}返回完整 JSON，不要解释。"


def attempts(answers: DataFrame, schema: Field, key: str = "id") -> DataFrame:
    """Answers (key, attempt from 0, status, payload) to key, outcome and attempt: the first of at most two that holds, else a stable reason.

    A refusal that a second try cannot mend ends the request; ``status`` is null where the network failed.
    """
    numbered = answers.withColumn("_id", F.struct(key, "attempt"))
    told = checked(numbered.select(F.to_json("_id").alias("id"), "payload"), schema).select("id", "valid")
    rows_ = numbered.withColumn("id_", F.to_json("_id")).join(told.withColumnRenamed("id", "id_"), "id_")
    fatal = F.col("status").isNotNull() & (F.col("status") != 200) & ~F.col("status").isin(*RETRIED)
    reason = F.when(F.col("status").isNull(), "provider_network_error").when(F.col("status") != 200, F.concat(F.lit("provider_http_"), F.col("status").cast("string"))).when(~F.col("valid"), "invalid_structured_output").otherwise("ok")
    judged = rows_.where("attempt < 2").select(key, "attempt", reason.alias("_reason"), fatal.alias("_fatal"))
    ends = F.struct(F.when((F.col("_reason") == "ok") | F.col("_fatal"), F.col("attempt")).otherwise(F.lit(9) - F.col("attempt")).alias("o"), F.col("_reason").alias("outcome"), "attempt")
    return judged.groupBy(key).agg(F.min(ends).alias("e")).select(key, "e.outcome", "e.attempt")


def provider(choice: str, search: str, keys: dict[str, str]) -> tuple[str, str]:
    """(model, search) that a configuration stands for: a named model, and its own search, the dedicated one, or the existing sources.

    ``auto`` takes the dedicated search where there is a key for it, then the model's own.
    """
    model = choice if choice in ("openai", "glm") else "glm"
    if search == "auto":
        search = "glm_web" if keys.get("glm") else "native" if keys.get(model) else "existing"
    return model, search if search in ("glm_web", "native", "existing") else "existing"


def request_body(model: str, name: str, instructions: str, prompt: str, schema: Field, search: bool = False) -> dict:
    """Body of a request for a structured answer, in the form that a model's interface takes."""
    strict = strict_schema(schema)
    if model == "openai":
        body = {"model": name, "instructions": instructions, "input": prompt, "text": {"format": {"type": "json_schema", "name": "answer", "schema": strict, "strict": True}}}
        return body | ({"tools": [{"type": "web_search"}]} if search else {})
    told = f"{instructions}\n{json.dumps(strict, ensure_ascii=False)}"
    body = {"model": name, "messages": [{"role": "system", "content": told}, {"role": "user", "content": prompt}], "response_format": {"type": "json_object"}, "stream": False}
    return body | ({"tools": [{"type": "web_search", "web_search": {"enable": True}}]} if search else {})


def safe_code(message: str) -> str:
    """An error message as a code that may be logged; what is none becomes ``value_error``."""
    return message if re.fullmatch(r"[a-z0-9_]{1,50}", message or "") else "value_error"
