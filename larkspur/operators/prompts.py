"""Prompts from templates with named parameters."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import operator

#: Templates by name; the names and parameters are fixed values.
TEMPLATES = {
    "file_conversion": "Convert this {file_type} file, {file_path}, to {target_format}. Keep what it says and how it is laid out.\n\n{content}",
    "content_enhancement": "Make this text from {file_path} clearer and correct its language. Keep its meaning and tone.\n\n{content}",
    "text_summarization": "Say in a few sentences what matters in this text from {file_path}.\n\n{content}",
    "code_analysis": "Explain this code from {file_path}, name its problems, how complex it is, and what could be faster.\n\n{content}",
}


def parameters(template: str) -> list[str]:
    """The names that a template asks for, in order; positional and empty ones are an error."""
    names = [name for _, name, _, _ in string.Formatter().parse(template) if name is not None]
    if any(not n.isidentifier() for n in names):
        raise ValueError("templates have named parameters")
    return list(dict.fromkeys(names))


def templates(own: dict[str, str] | None = None) -> dict[str, str]:
    """The defaults, or instead of them a user's own."""
    return dict(own) if own else dict(TEMPLATES)


def filled(template: str, values: dict[str, Column]) -> Column:
    """The template as a Column; a null value is empty text, and braces are written twice."""
    if missing := [p for p in parameters(template) if p not in values]:
        raise ValueError(f"missing parameters: {', '.join(missing)}")
    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        parts += [F.lit(text)] if text else []
        parts += [F.coalesce(values[name].cast("string"), F.lit(""))] if name is not None else []
    return F.concat(*parts) if parts else F.lit("")


@operator(category="rag")
def prompts(rows: DataFrame, template: str, own: dict[str, str] | None = None, name: str = "prompt") -> DataFrame:
    """The rows with a prompt of the named template, whose parameters are columns of the rows."""
    known = templates(own)
    if template not in known:
        raise ValueError(f"unknown template {template}")
    return rows.withColumn(name, filled(known[template], {c: F.col(c) for c in rows.columns if c in parameters(known[template])}))
