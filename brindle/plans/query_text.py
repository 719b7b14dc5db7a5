"""Front end of the bilingual query language: text to relational rows.

One regular expression cuts the text into tokens; the nesting depth of all tokens is summed up at once.  What stands at one depth is then cut up by
tables: a package at semicolons, a statement at UNION, a query at the words of ``CLAUSES``, its sources at commas and joins.  Expressions aren't parsed: the names
that they mention are matches of a pattern over the kinds of tokens, and an OR counts by its depth.  The result are flat rows: queries, their sources, their joins,
and the fields each clause mentions.  What the subset doesn't know makes the whole text fail, and a text that fails yields no rows: rules stay silent on
what is not understood.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keywords in both languages.
KEYWORDS = {
    "SELECT": "ВЫБРАТЬ", "ALLOWED": "РАЗРЕШЕННЫЕ", "DISTINCT": "РАЗЛИЧНЫЕ", "TOP": "ПЕРВЫЕ", "INTO": "ПОМЕСТИТЬ", "FROM": "ИЗ", "WHERE": "ГДЕ",
    "HAVING": "ИМЕЮЩИЕ", "TOTALS": "ИТОГИ", "ON": "ПО", "UNION": "ОБЪЕДИНИТЬ", "ALL": "ВСЕ", "JOIN": "СОЕДИНЕНИЕ", "LEFT": "ЛЕВОЕ",
    "RIGHT": "ПРАВОЕ", "FULL": "ПОЛНОЕ", "INNER": "ВНУТРЕННЕЕ", "OUTER": "ВНЕШНЕЕ", "AS": "КАК", "AND": "И", "OR": "ИЛИ", "NOT": "НЕ",
    "DROP": "УНИЧТОЖИТЬ", "CASE": "ВЫБОР", "WHEN": "КОГДА", "THEN": "ТОГДА", "ELSE": "ИНАЧЕ", "END": "КОНЕЦ", "HIERARCHY": "ИЕРАРХИЯ",
    "IN": "В", "IS": "ЕСТЬ", "NULL": "NULL", "LIKE": "ПОДОБНО", "BETWEEN": "МЕЖДУ", "AUTOORDER": "АВТОУПОРЯДОЧИВАНИЕ",
}
PAIRS = {"GROUP BY": "СГРУППИРОВАТЬ ПО", "ORDER BY": "УПОРЯДОЧИТЬ ПО", "INDEX BY": "ИНДЕКСИРОВАТЬ ПО", "FOR UPDATE": "ДЛЯ ИЗМЕНЕНИЯ"}
# Kinds of metadata that can be a source, and the collection of a dump that holds their fields.
KINDS = {
    "CATALOG": ("СПРАВОЧНИК", "Catalogs"), "DOCUMENT": ("ДОКУМЕНТ", "Documents"), "DOCUMENTJOURNAL": ("ЖУРНАЛДОКУМЕНТОВ", "DocumentJournals"),
    "CONSTANT": ("КОНСТАНТА", None), "ENUM": ("ПЕРЕЧИСЛЕНИЕ", None), "CHARTOFCHARACTERISTICTYPES": ("ПЛАНВИДОВХАРАКТЕРИСТИК", "ChartsOfCharacteristicTypes"),
    "CHARTOFACCOUNTS": ("ПЛАНСЧЕТОВ", "ChartsOfAccounts"), "CHARTOFCALCULATIONTYPES": ("ПЛАНВИДОВРАСЧЕТА", "ChartsOfCalculationTypes"),
    "INFORMATIONREGISTER": ("РЕГИСТРСВЕДЕНИЙ", "InformationRegisters"), "ACCUMULATIONREGISTER": ("РЕГИСТРНАКОПЛЕНИЯ", "AccumulationRegisters"),
    "ACCOUNTINGREGISTER": ("РЕГИСТРБУХГАЛТЕРИИ", "AccountingRegisters"), "CALCULATIONREGISTER": ("РЕГИСТРРАСЧЕТА", "CalculationRegisters"),
    "BUSINESSPROCESS": ("БИЗНЕСПРОЦЕСС", "BusinessProcesses"), "TASK": ("ЗАДАЧА", "Tasks"), "EXCHANGEPLAN": ("ПЛАНОБМЕНА", "ExchangePlans"),
    "SEQUENCE": ("ПОСЛЕДОВАТЕЛЬНОСТЬ", None), "FILTERCRITERION": ("КРИТЕРИЙОТБОРА", None), "EXTERNALDATASOURCE": ("ВНЕШНИЙИСТОЧНИКДАННЫХ", None),
}
# Virtual tables, and the slot of their filter where the signature is known.
VIRTUAL = {
    "BALANCE": ("ОСТАТКИ", 1), "TURNOVERS": ("ОБОРОТЫ", 3), "BALANCEANDTURNOVERS": ("ОСТАТКИИОБОРОТЫ", 4), "DRCRTURNOVERS": ("ОБОРОТЫДТКТ", None),
    "SLICELAST": ("СРЕЗПОСЛЕДНИХ", 1), "SLICEFIRST": ("СРЕЗПЕРВЫХ", 1), "RECORDSWITHEXTDIMENSIONS": ("ДВИЖЕНИЯССУБКОНТО", None),
    "EXTDIMENSIONS": ("СУБКОНТО", None), "ACTUALACTIONPERIOD": ("ФАКТИЧЕСКИЙПЕРИОДДЕЙСТВИЯ", None), "SCHEDULEDATA": ("ДАННЫЕГРАФИКА", None),
    "BASE": ("БАЗАНАЧИСЛЕНО", None), "": ("ОСТАТКИИОБОРОТЫДТКТ", None),
}
DEPTH = 32

_WORDS = {w: k for k, ru in KEYWORDS.items() for w in (k, ru)}
_TWO = {w: k for k, ru in PAIRS.items() for w in (k, ru)}
_KIND = {w: k for k, (ru, _) in KINDS.items() for w in (k, ru)}
VIRTUAL_SLOT = {w: slot for k, (ru, slot) in VIRTUAL.items() for w in (k, ru) if w}
#: Words that open a clause, and the order in which clauses may come; those of one number come in any order.
CLAUSES = {"SELECT": 0, "INTO": 1, "FROM": 2, "WHERE": 3, "GROUP BY": 4, "HAVING": 4, "ORDER BY": 4, "TOTALS": 4, "FOR UPDATE": 4, "AUTOORDER": 4, "INDEX BY": 5}
JOINS = ("LEFT", "RIGHT", "FULL", "INNER", "JOIN")
_NEVER_NAMES = {*CLAUSES, *JOINS, "UNION", "OUTER", "ON", "AS"} - {"FOR UPDATE", "AUTOORDER"}
_TOKEN = re.compile(r'(?P<skip>\s+|//[^\n]*)|(?P<text>"(?:[^"]|"")*"?)|(?P<param>&\w*)|(?P<number>\d[\d.]*)|(?P<word>[^\W\d]\w*)|(?P<sign>.)', re.S)
#: Over one letter for each token: n a name, k a word of the language that may be a name beside a dot, t a percent sign, d a number.
_MENTIONED = re.compile(r"(?:n|k(?=\.))(?:\.[nk])*")
_PATH = re.compile(r"(?:n|td)(?:\.(?:n|td))*")


class NotUnderstood(ValueError):
    """The text is not of the known subset."""


def tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, byte offset): kind is a keyword, or ``name``, ``text``, ``param``, ``number``, or the sign itself."""
    out, at, byte = [], 0, 0
    for m in _TOKEN.finditer(text):
        byte += len(text[at : m.start()].encode())
        at = m.start()
        kind, word = m.lastgroup, m[0]
        if kind == "skip":
            continue
        if kind == "word":
            kind = _WORDS.get(word.upper(), "name")
            pair = f"{out[-1][1]} {word}".upper() if out else ""
            if pair in _TWO:
                out[-1] = (_TWO[pair], f"{out[-1][1]} {word}", out[-1][2])
                continue
        out.append((word if kind == "sign" else kind, word, byte))
    return out


class Reader:
    """Reads one package of queries into ``queries``, ``sources`` and ``fields`` rows."""

    def __init__(self, text: str):
        self.t = tokens(text)
        self.codes = "".join(self._code(kind) for kind, _, _ in self.t)
        steps = [(kind == "(") - (kind == ")") for kind, _, _ in self.t]
        # Depth outside of both parentheses of a pair.
        self.depth = [d - (s > 0) for d, s in zip(accumulate(steps), steps, strict=True)]
        self.queries: list[dict] = []
        self.sources: list[dict] = []
        self.fields: list[dict] = []
        if any(d < 0 for d in self.depth):
            raise NotUnderstood("a parenthesis too many")
        for part in self.cut(range(len(self.t)), {";"}):
            if part:
                self.statement(part, None)
        if not self.queries:
            raise NotUnderstood("no query")

    @staticmethod
    def _code(kind: str) -> str:
        return {"name": "n", "number": "d", "%": "t", ".": "."}.get(kind, "k" if kind in KEYWORDS and kind not in _NEVER_NAMES else " ")

    def cut(self, span: range, kinds: set[str] | tuple) -> list[range]:
        """Pieces of a span between tokens of these kinds that stand at the depth of its first token."""
        if not span:
            return [span]
        level = self.depth[span[0]]
        at = [i for i in span if self.depth[i] == level and self.t[i][0] in kinds]
        return [range(a, b) for a, b in zip([span.start, *(i + 1 for i in at)], [*at, span.stop], strict=True)]

    def opened(self, span: range, kinds) -> list[tuple[int, range]]:
        """Tokens of these kinds at the depth of the span's first one, each with what follows until the next."""
        level = self.depth[span[0]]
        at = [i for i in span if self.depth[i] == level and self.t[i][0] in kinds]
        return [(i, range(i + 1, j)) for i, j in pairwise([*at, span.stop])]

    def kind(self, i: int, span: range) -> str:
        return self.t[i][0] if i in span else ""

    def without(self, span: range, *kinds: str) -> range:
        """The span behind one token of these kinds, if it begins so."""
        return span[1:] if span and self.t[span[0]][0] in kinds else span

    def path(self, span: range) -> tuple[list[str], range]:
        """The dotted name that a span begins with, and the rest."""
        m = _PATH.match(self.codes, span.start, span.stop) if span else None
        if not m:
            raise NotUnderstood("a name expected")
        return "".join(self.t[i][1] for i in range(*m.span())).split("."), span[m.end() - m.start() :]

    def statement(self, span: range, parent: int | None) -> None:
        for n, part in enumerate(self.cut(span, {"UNION"})):
            self.query(self.without(part, "ALL") if n else part, parent)

    def query(self, span: range, parent: int | None) -> None:
        if not span:
            raise NotUnderstood("an empty query")
        q = {"query": len(self.queries), "parent": parent, "offset": self.t[span[0]][2], "into": None, "dropped": None, "indexed": [], "into_offset": None}
        self.queries.append(q)
        if self.t[span[0]][0] == "DROP":
            (q["dropped"], *more), rest = self.path(span[1:])
            if more or rest:
                raise NotUnderstood("DROP takes one name")
            return
        clauses = self.opened(span, CLAUSES)
        order = [CLAUSES[self.t[i][0]] for i, _ in clauses]
        if not clauses or clauses[0][0] != span[0] or order[0] or any(b < a or a == b != 4 for a, b in pairwise(order)):
            raise NotUnderstood("clauses out of order")
        for i, body in clauses:
            self.clause(q, self.t[i][0], body)

    def clause(self, q: dict, opens: str, body: range) -> None:
        if opens == "SELECT":
            body = self.without(self.without(body, "ALLOWED"), "DISTINCT")
            self.mention(body[2:] if self.kind(body.start, body) == "TOP" else body, q["query"], "select")
        elif opens == "INTO":
            (name, *more), rest = self.path(body)
            if more or rest:
                raise NotUnderstood("INTO takes one name")
            q |= {"into": name, "into_offset": self.t[body[0]][2]}
        elif opens == "FROM":
            if not body:
                raise NotUnderstood("nothing to select from")
            joins = self.opened(body, JOINS)
            for part in self.cut(range(body.start, joins[0][0] if joins else body.stop), {","}):
                self.source(part, q["query"], None, None)
            self.joined(joins, q["query"])
        elif opens == "WHERE":
            self.mention(body, q["query"], "where")
        elif opens == "INDEX BY":
            sets = self.kind(body.start, body) == "name" and self.t[body[0]][1].upper() in ("НАБОРАМ", "SETS")
            q["indexed"] = ["".join(self.t[i][1] for i in range(*m.span())) for m in _MENTIONED.finditer(self.codes, body[1 if sets else 0 :].start, body.stop)]
            if not sets and "." not in self.codes[body.start : body.stop] and len(q["indexed"]) != len(self.cut(body, {","})):
                raise NotUnderstood("fields to index by")

    def joined(self, joins: list[tuple[int, range]], query: int) -> None:
        """Joins begin with a side, OUTER and JOIN, or with JOIN alone; then come a source and a condition."""
        at, how = None, "INNER"
        for i, body in joins:
            if self.t[i][0] != "JOIN":
                if at is not None or self.without(body, "OUTER"):
                    raise NotUnderstood("JOIN expected")
                at, how = i, self.t[i][0]
                continue
            parts = self.cut(body, {"ON"}) if body else []
            if not parts or len(parts) > 2:
                raise NotUnderstood("what to join")
            row = self.source(parts[0], query, how.lower(), self.t[i if at is None else at][2])
            if len(parts) == 2:
                level = self.depth[i]
                ors = [self.depth[k] for k in parts[1] if self.t[k][0] == "OR"]
                row |= {"has_on": True, "on_or": bool(ors), "on_top_or": level in ors}
                self.mention(parts[1], query, "on", row["source"])
            at, how = None, "INNER"
        if at is not None:
            raise NotUnderstood("JOIN expected")

    def source(self, span: range, query: int, how: str | None, at: int | None) -> dict:
        if not span:
            raise NotUnderstood("a source expected")
        first, offset = self.t[span[0]], self.t[span[0]][2]
        row = {
            "query": query, "source": len(self.sources), "join_kind": how, "join_offset": offset if at is None else at, "table_kind": None, "meta_kind": None, "name": None, "sub_table": None,
            "has_parens": False, "empty_slots": [], "alias": None, "offset": offset, "has_on": False, "on_or": False, "on_top_or": False,
        }
        self.sources.append(row)
        if first[0] == "(":
            inside, rest = self.parentheses(span)
            if not inside or self.t[inside[0]][0] != "SELECT" or self.depth[inside[0]] > DEPTH:
                raise NotUnderstood("a subquery expected")
            row["table_kind"] = "subquery"
            self.statement(inside, query)
        elif first[0] == "param":
            row |= {"table_kind": "parameter", "name": first[1]}
            rest = span[1:]
        else:
            parts, rest = self.path(span)
            meta = _KIND.get(parts[0].upper()) if len(parts) > 1 else None
            row |= {"table_kind": "meta", "meta_kind": meta, "name": parts[1], "sub_table": (parts + [None])[2] if len(parts) > 2 else None} if meta else {"table_kind": "temp", "name": ".".join(parts)}
            if meta and self.kind(rest.start, rest) == "(":
                inside, rest = self.parentheses(rest)
                slots = self.cut(inside, {","})
                row |= {"has_parens": True, "empty_slots": [not x for x in slots] if inside else []}
                for n, slot in enumerate(slots):
                    self.mention(slot, query, "param", row["source"], n)
        named = self.without(rest, "AS")
        if named and len(named) == 1 and self.codes[named[0]] in ("nk" if named != rest else "n"):
            row["alias"] = self.t[named[0]][1]
        elif rest:
            raise NotUnderstood("an alias expected")
        return row

    def parentheses(self, span: range) -> tuple[range, range]:
        """What is between the parenthesis that a span begins with and its partner, and what is behind that."""
        level = self.depth[span[0]]
        for i in span[1:]:
            if self.depth[i] == level and self.t[i][0] == ")":
                return range(span[1], i), range(i + 1, span.stop)
        raise NotUnderstood("no closing parenthesis")

    def mention(self, span: range, query: int, part: str, source: int | None = None, slot: int | None = None) -> None:
        for m in _MENTIONED.finditer(self.codes, span.start, span.stop) if span else ():
            path = "".join(self.t[i][1] for i in range(*m.span()))
            self.fields.append({"query": query, "part": part, "source": source, "slot": slot, "path": path, "offset": self.t[m.start()][2]})


QUERY = "query int, parent int, offset int, into string, dropped string, indexed array<string>, into_offset int"
SOURCE = (
    "query int, source int, join_kind string, join_offset int, table_kind string, meta_kind string, name string, sub_table string, has_parens boolean, "
    "empty_slots array<boolean>, alias string, offset int, has_on boolean, on_or boolean, on_top_or boolean"
)
FIELD = "query int, part string, source int, slot int, path string, offset int"


def parse(texts: DataFrame, key: str = "text_id", text: str = "text") -> DataFrame:
    """``key, understood, queries, sources, fields`` for each text; arrays are empty where it isn't understood."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, x in zip(frame[key], frame[text], strict=True):
                try:
                    r = Reader(x or "")
                    rows.append((k, True, r.queries, r.sources, r.fields))
                except NotUnderstood:
                    rows.append((k, False, [], [], []))
            yield pd.DataFrame(rows, columns=[key, "understood", "queries", "sources", "fields"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, understood boolean, queries array<struct<{_colon(QUERY)}>>, sources array<struct<{_colon(SOURCE)}>>, fields array<struct<{_colon(FIELD)}>>")


def _colon(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (x.split(" ", 1) for x in schema.split(", ")))


def relation(parsed: DataFrame, name: str, key: str = "text_id") -> DataFrame:
    """``queries``, ``sources`` or ``fields`` of parsed texts as rows."""
    return parsed.select(key, F.explode(name).alias("row")).select(key, "row.*")


def is_register(meta_kind):
    return meta_kind.endswith("REGISTER")


def collection_of(meta_kind):
    pairs = [x for k, (_, c) in KINDS.items() if c for x in (F.lit(k), F.lit(c))]
    return F.create_map(*pairs)[meta_kind]
