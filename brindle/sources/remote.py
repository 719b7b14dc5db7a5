"""A remote index behind JSON-RPC, as an interface: what is asked, how answers are trusted, and the exact filter behind its fuzzy search.

``Remote`` is given a function that posts a request and returns the payload; the transport is the caller's.  Answers are kept for each question; after a failure the source
isn't healthy, and a validation that relies on it is refused.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.operators import joins as J

PAGE = 400


def global_exports(hits: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Of ``hits(asked, name, path, args)`` of a fuzzy search those that answer it: the very name, exported, in a common module that its description marks as global.

    ``descriptions(path, source)``: XML files of common modules.
    """
    exact = hits.where((F.lower("name") == F.lower("asked")) & F.col("args").contains(") Экспорт") & X.common_module(F.col("path")))
    marked = descriptions.where(F.col("source").contains("<Global>true</Global>")).select(X.module_of_xml(F.col("path")).alias("path")).where("path is not null")
    return J.known(exact, marked, ["path"]).select("asked").distinct()


def body(payload: str) -> dict | None:
    """The JSON that an answer holds; None unless it can be trusted whole."""
    line = payload if payload.lstrip().startswith("{") else next((x[5:].strip() for x in payload.splitlines() if x.startswith("data:") and x[5:].strip()), "")
    try:
        outer = json.loads(json.loads(line)["result"]["content"][0]["text"])
        inner = outer.get("result", outer) if isinstance(outer, dict) else outer
        inner = json.loads(inner) if isinstance(inner, str) else inner
    except (ValueError, KeyError, IndexError, TypeError):
        return None
    cut = "response_truncated" in outer or any(k in inner for k in ("rows_truncated", "rows_elided_already_delivered")) or inner.get("truncated") is True
    return None if cut else inner


class Remote:
    """Questions to one repository of a remote index."""

    def __init__(self, post: Callable[[str, dict], str], repo: str):
        self.post, self.repo, self.healthy = post, repo, True
        self.kept: dict[tuple, dict | None] = {}
        answer = self.ask("get_stats", repo=repo)
        if answer and re.search("Неизвестный repo", str(answer.get("message", ""))):
            raise ValueError(answer["message"])  # anything that isn't recognised must not block

    def ask(self, tool: str, **options) -> dict | None:
        key = (tool, *sorted((k, str(v)) for k, v in options.items()))
        if key not in self.kept:
            try:
                self.kept[key] = body(self.post(tool, options))
            except OSError:
                self.healthy = False
                return None
        return self.kept[key]

    def objects(self, meta_type: str) -> set[str] | None:
        """Lower-case names of a kind, page by page until a short one; None if any page can't be trusted."""
        names: list[str] = []
        while True:
            page = self.ask("sql", repo=self.repo, query=f"SELECT full_name FROM metadata_objects WHERE meta_type = '{meta_type}' ORDER BY full_name LIMIT {PAGE} OFFSET {len(names)}")
            if page is None or "rows" not in page:
                return None
            names += [r[0] for r in page["rows"]]
            if len(page["rows"]) < PAGE:
                return {n.partition(".")[2].lower() or n.lower() for n in names}

    def object_table(self, spark: SparkSession, meta_types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
        """``objects(collection, name_lower)`` of the collections that can be told of, and ``unknown(collection)``."""
        found = {c: self.objects(m) for c, m in meta_types.items()}
        rows = [(c, n) for c, names in found.items() if names is not None for n in sorted(names)]
        return spark.createDataFrame(rows, "collection string, name_lower string"), spark.createDataFrame([(c,) for c, names in found.items() if names is None], "collection string")
