"""Prompts as column expressions: templates are compiled when the plan is made."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"\{\{\s*([\w.]+)\s*\}\}|\{%\s*for (\w+) in (\w+)\s*%\}|\{%\s*endfor\s*%\}")
EXAMPLE = "array<struct<generated_caption string, crawl_caption string, context string, summary string, expected_output string>>"


def _value(name: str, local: dict[str, Column]) -> Column:
    first, *rest = name.split(".")
    out = local[first] if first in local else F.col(first)
    for field in rest:
        out = out.getField(field) if not (first == "loop" and field == "index") else out
    return F.coalesce(out.cast("string"), F.lit(""))


def _loop(name: str, body: str, local: dict[str, Column]):
    return lambda x, i: compiled(body, {**local, name: x, "loop": i + 1})


def compiled(template: str, local: dict[str, Column] | None = None) -> Column:
    """Values {{ a.b }} and loops {% for x in xs %}, in which {{ loop.index }} counts from 1; nulls are empty."""
    local, parts, at, depth = local or {}, [], 0, 0
    body: tuple[int, str, str] | None = None
    for m in _TAG.finditer(template):
        if m[2]:
            depth += 1
            if depth == 1:
                parts.append(F.lit(template[at : m.start()]))
                body = (m.end(), m[2], m[3])
        elif m[1]:
            if not depth:
                parts += [F.lit(template[at : m.start()]), _value(m[1], local)]
                at = m.end()
        else:
            depth -= 1
            if depth < 0:
                raise ValueError("endfor without for")
            if depth == 0 and body:
                start, name, items = body
                inner = template[start : m.start()]
                rows = local.get(items, F.col(items)) if items in local else F.col(items)
                each = F.transform(rows, _loop(name, inner, local))
                parts.append(F.coalesce(F.array_join(each, ""), F.lit("")))
                at = m.end()
    if depth:
        raise ValueError("for without endfor")
    parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def composed(evidence: DataFrame, examples: list[dict] = ()) -> DataFrame:
    """The values that templates use: every field of the evidence with '' for what is missing, and the examples with null contexts."""
    or_empty = lambda c: F.coalesce(F.col(c), F.lit("")) if c in evidence.columns else F.lit("")
    summary = evidence.schema["article_summary"].dataType.names if "article_summary" in evidence.columns else []
    part = lambda c: F.coalesce(F.col(f"article_summary.{c}_summary"), F.lit("")) if f"{c}_summary" in summary else F.lit("")
    shown = F.array(*(F.struct(F.lit(e.get("generated_caption", "")).alias("generated_caption"), F.lit(e.get("crawl_caption", "")).alias("crawl_caption"), F.lit(None).cast("string").alias("context"), F.lit(str(e.get("article_summary", ""))).alias("summary"), F.lit(e.get("expected_output", "")).alias("expected_output")) for e in examples)) if examples else F.array().cast(EXAMPLE)
    plain = ("article", "generated_caption", "crawl_caption", "question_answer", "name_entity_keyword", "related_phrases", "context")
    return evidence.select("query_id", *(or_empty(c).alias(c) for c in plain), F.struct(*(part(c).alias(c) for c in ("raw", "restruct", "fact"))).alias("summary"), shown.alias("examples"))


def rendered(composed_: DataFrame, template: str) -> DataFrame:
    return composed_.select("query_id", compiled(template).alias("prompt"))


def zipped(examples: Column, contexts: Column) -> Column:
    """Examples with their contexts; a context that is missing is null."""
    return F.arrays_zip(examples.alias("example"), contexts.alias("context"))
