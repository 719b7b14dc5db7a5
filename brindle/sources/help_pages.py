"""Help pages to catalog entries: each page is a head and titled chapters, and each kind of page keeps some of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.sources import html as H

# Titles of chapters, marks in their texts.
TITLES = {"syntax": "Синтаксис:", "parameters": "Параметры:", "returns": "Возвращаемое значение:", "variant_description": "Описание варианта метода:", "description": "Описание:", "example": "Пример:", "related": "См. также:", "note": "Примечание:", "usage": "Использование:"}
VARIANT, MAIN, TYPE, READ_ONLY, OPTIONAL = "Вариант синтаксиса:", "Основная", "Тип:", "Только чтение", "необязательный"
_CHAPTER = {title: key for key, title in TITLES.items()}


def _inside(html: str, tag: str, kind: str | None = None) -> list[tuple[str, dict]]:
    """Text and attributes of the elements of a name (and class)."""
    out, stack = [], []
    for what, name, x in H._Events(html).events:
        if what == "open" and name == tag and (kind is None or x.get("class") == kind):
            stack.append([[], x])
        elif what == "close" and name == tag and stack:
            parts, attributes = stack.pop()
            out.append((H.one_space("".join(parts)), attributes))
        elif what == "text":
            for parts, _ in stack:
                parts.append(x)
    return out


def two_names(title: str) -> tuple[str, str]:
    m = re.fullmatch(r"(.*)\(([^()]*)\)[^()]*", title, re.S)
    if m and re.fullmatch(r"[A-Za-z0-9.\s]+", m[2].strip()):
        return m[1].strip(), m[2].strip()
    return title.strip(), ""


def head(html: str) -> tuple[str, str]:
    found = _inside(html, "p", "V8SH_heading") or _inside(html, "p", "V8SH_title")
    return two_names(found[0][0]) if found and found[0][0] else ("", "")


def value_info(html: str) -> tuple[str, str] | None:
    """(type, description) of a value chapter: up to the first full stop behind the mark is the type."""
    _, mark, rest = H.markdown(html).partition(TYPE)
    name, _, description = rest.strip().partition(".")
    return (name.strip(), description.strip()) if mark and name.strip() else None


def parameters(html: str) -> list[dict]:
    out = []
    for text, _ in _inside(html, "div", "V8SH_rubric"):
        m = re.match(r"<([^>]*)>(.*)", text, re.S)
        if text:
            out.append({"name": m[1].strip() if m else text, "required": not (m and OPTIONAL in m[2])})
    return out


def page(html: str) -> dict:
    """All that any kind of page keeps."""
    parts = H.chapters(html)
    ru, en = head(parts[0][1] if parts else "")
    out = {"name_ru": ru, "name_en": en, "description": "", "value_type": "", "value_description": "", "return_type": "", "readonly": False, "example": None, "note": None, "related": [], "signatures": []}

    def signature() -> dict:
        if not out["signatures"]:
            out["signatures"].append({"name": MAIN, "syntax": "", "description": "", "parameters": []})
        return out["signatures"][-1]

    for title, body in parts[1:]:
        if title.startswith(VARIANT):
            out["signatures"].append({"name": title[len(VARIANT) :].strip(), "syntax": "", "description": "", "parameters": []})
            continue
        key = _CHAPTER.get(title)
        if key == "syntax":
            signature()["syntax"] = H.text_of(body)
        elif key == "parameters":
            signature()["parameters"] = parameters(body)
        elif key == "variant_description":
            signature()["description"] = H.markdown(body)
        elif key == "returns":
            out["return_type"] = (value_info(body) or ("", ""))[0]
        elif key == "description":
            out["description"] = H.markdown(body)
            out["value_type"], out["value_description"] = value_info(body) or ("", "")
        elif key == "example":
            text = re.sub(r"(?i)<br\s*/?>", "\n", body)
            out["example"] = "".join(x for w, _, x in H._Events(text).events if w == "text").strip().replace("\xa0", " ")
        elif key == "note":
            out["note"] = H.markdown(body)
        elif key == "usage":
            out["readonly"] = H.text_of(body).startswith(READ_ONLY)
        elif key == "related":
            out["related"] = [{"name": t.replace(" ,", ","), "href": a.get("href") or ""} for t, a in _inside(body, "a") if t]
    return out


PAGE = (
    "name_ru string, name_en string, description string, value_type string, value_description string, return_type string, readonly boolean, example string, note string, "
    "related array<struct<name: string, href: string>>, signatures array<struct<name: string, syntax: string, description: string, parameters: array<struct<name: string, required: boolean>>>>"
)


def parse(pages: DataFrame, key: str = "html_path", html: str = "html") -> DataFrame:
    """``key`` and the columns of ``PAGE``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([{key: k, **page(x or "")} for k, x in zip(frame[key], frame[html], strict=True)], columns=[key, *page("")])

    return pages.select(key, html).mapInPandas(run, f"{key} string, {PAGE}")


def role(path_column: str = "html_path"):
    """What a page is, by its path: property, constructor, method, or a type or enumeration page."""
    p = F.col(path_column)
    return F.when(p.contains("/properties/"), "property").when(p.contains("/ctors/"), "constructor").when(p.contains("/methods/"), "method").otherwise("object")


def catalog_tables(parsed: DataFrame, key: str = "html_path") -> dict[str, DataFrame]:
    """Methods and properties of parsed pages: methods need a signature; names that begin like a tag are placeholders."""
    rows = parsed.withColumn("role", role(key)).where(~F.col("name_ru").startswith("<"))
    methods = rows.where("role = 'method' and size(signatures) > 0").select(key, F.lower("name_ru").alias("method_lower"), F.col("name_ru").alias("method_name"), "name_en", "description", "return_type", "signatures")
    properties = rows.where("role = 'property'").select(key, F.lower("name_ru").alias("property_lower"), "name_ru", "name_en", F.col("value_type").alias("type_name"), F.col("value_description").alias("description"), "readonly")
    return {"methods": methods, "properties": properties}
