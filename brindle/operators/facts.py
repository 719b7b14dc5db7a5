"""Positioned facts of program text: declarations, calls, member accesses, constructors, assignments, directives, query texts.

A module is cut into tokens by one regular expression and read once, left to right; every fact is a row with the byte offset, line and
character column where it stands.  Text in strings and comments, and blocks between deletion marks, yields no facts; binary content yields none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Words of the language that matter here, in both spellings.
PROC = {"процедура", "функция", "procedure", "function"}
END_PROC = {"конецпроцедуры", "конецфункции", "endprocedure", "endfunction"}
NEW = {"новый", "new"}
FOR = {"для", "for"}
EACH = {"каждого", "each"}
VAR = {"перем", "var"}
EXPORT = {"экспорт", "export"}
VAL = {"знач", "val"}
OPENS = {"тогда", "then", "иначе", "else", "цикл", "do", "попытка", "try", "исключение", "except"}
ENDS = {"конецесли", "endif", "конеццикла", "enddo", "конецпопытки", "endtry"}
OTHER = {
    "если", "if", "иначеесли", "elsif", "пока", "while", "по", "to", "из", "in", "возврат", "return", "продолжить", "continue", "прервать", "break",
    "и", "and", "или", "or", "не", "not", "истина", "true", "ложь", "false", "неопределено", "undefined", "null", "вызватьисключение", "raise", "перейти", "goto",
    "добавитьобработчик", "addhandler", "удалитьобработчик", "removehandler", "асинх", "async", "ждать", "await",
}
NO_CONTEXT = {"насерверебезконтекста", "наклиентенасерверебезконтекста", "atservernocontext", "atclientatservernocontext"}
QUERY_HEADS = {"ВЫБРАТЬ", "SELECT", "УНИЧТОЖИТЬ", "DROP"}
WORDS = PROC | END_PROC | NEW | FOR | EACH | VAR | EXPORT | VAL | OPENS | ENDS | OTHER

_DELETED = re.compile(r"(?im)^[ \t]*#(?:удаление|delete)\b.*?(?:^[ \t]*#(?:конецудаления|enddelete)\b[^\n]*|\Z)", re.S)
_TOKEN = re.compile(
    r'(?P<space>\s+)|(?P<comment>//[^\n]*)|(?P<text>"(?:[^"\n]|""|\n[ \t]*(?://[^\n]*\n[ \t]*)*\|)*"?)|(?P<date>\'[^\'\n]*\'?)|(?P<mark>(?:#[ \t]*|[&~])[^\W\d]\w*[^\n]*)|(?P<number>\d[\d.]*)|(?P<word>[^\W\d]\w*)|(?P<sign>.)', re.S
)


def without_deleted(source: str) -> str:
    """Blocks between deletion marks become blanks of the same length; line breaks stay."""
    return _DELETED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


_JOINT = re.compile(r'""|\n[ \t]*(?://[^\n]*\n[ \t]*)*\|')


def pieces(raw: str) -> list[tuple[int, str]]:
    """Parts of a string literal as (byte in it, value): doubled quotes are one, continuation bars and comments between lines go, and each begins a part of its own."""
    end, at, out = len(raw) - (len(raw) > 1 and raw.endswith('"')), 1, []
    for m in _JOINT.finditer(raw, 1, end):
        out += [(at, raw[at : m.start()]), (m.start(), m[0][0])]
        at = m.end()
    return [(len(raw[:i].encode()), x) for i, x in [*out, (at, raw[at:end])] if x]


def literal(raw: str) -> str:
    return "".join(x for _, x in pieces(raw))


class Module:
    """Reads one module into ``rows``: (kind, name, member, object, byte, line, col, end_byte, n_args, flag, extra, scope).

    ``scope`` is the number of the row of the procedure around a fact; ``extra`` of a member access is the line and column of the member.
    """

    def __init__(self, source: str):
        self.rows: list[tuple] = []
        self.scope: int | None = None
        self.t: list[tuple[str, str, int, int, int, int]] = []  # kind, text, byte, line, col, end byte
        if "\0" in source[:8192]:
            return
        text, byte, line, col = without_deleted(source), 0, 1, 1
        for m in _TOKEN.finditer(text):
            raw, size = m[0], len(source[m.start() : m.end()].encode())  # a blanked block keeps its characters, not its bytes
            if m.lastgroup not in ("space", "comment"):
                self.t.append((m.lastgroup, raw, byte, line, col, byte + size))
            byte += size
            breaks = raw.count("\n")
            line, col = (line + breaks, len(raw) - raw.rfind("\n")) if breaks else (line, col + len(raw))
        self.read()
        self.queries()

    def add(self, kind: str, name: str, at: int, member=None, owner=None, end=None, n_args=None, flag=None, extra=None) -> None:
        _, _, byte, line, col, _ = self.t[at]
        self.rows.append((kind, name, member, owner, byte, line, col, end, n_args, flag, extra, self.scope))

    def is_sign(self, at: int, sign: str) -> bool:
        return 0 <= at < len(self.t) and self.t[at][0] == "sign" and self.t[at][1] == sign

    def is_word(self, at: int, words: set[str] | None = None) -> bool:
        if not (0 <= at < len(self.t)) or self.t[at][0] != "word":
            return False
        low = self.t[at][1].lower()
        return low in words if words is not None else low not in WORDS

    def close(self, at: int) -> tuple[int, int]:
        """Position of the parenthesis that closes the one at ``at``, and the arguments between: omitted ones count."""
        depth, commas, some = 0, 0, False
        for i in range(at, len(self.t)):
            if self.t[i][0] == "sign":
                sign = self.t[i][1]
                if sign in "([":
                    depth += 1
                elif sign in ")]":
                    depth -= 1
                    if not depth:
                        return i, commas + 1 if some or commas else 0
                elif sign == "," and depth == 1:
                    commas += 1
                    continue
            some = some or i > at
        return len(self.t) - 1, commas + 1 if some else 0

    def read(self) -> None:
        directive, starts = None, True
        i = 0
        while i < len(self.t):
            kind, text, byte, _, _, end = self.t[i]
            low = text.lower()
            if kind == "mark":
                if text[0] == "&":
                    word = re.match(r"&(\w+)", text)[1]
                    self.add("directive", word, i)
                    directive = word
                starts = True
            elif kind == "word" and low in PROC and self.is_word(i + 1):
                close, _ = self.close(i + 2)
                parameters, previous = [], None
                for j in range(i + 3, close):
                    if self.t[j][0] == "word" and self.t[j][1].lower() not in VAL and (self.is_sign(j - 1, ",") or self.is_sign(j - 1, "(") or previous):
                        parameters.append(self.t[j][1])
                    previous = self.t[j][0] == "word" and self.t[j][1].lower() in VAL
                export = self.is_word(close + 1, EXPORT)
                self.scope, inside = None, len(self.rows)
                self.add("proc", self.t[i + 1][1], i, end=None, n_args=len(parameters), flag=export, extra=",".join([directive or "", low, *map(str.lower, parameters)]))
                directive, i, starts, self.scope = None, close + export, True, inside
            elif kind == "word" and low in END_PROC:
                self.leave(end)
                starts = True
            elif kind == "word" and low in VAR:
                j = i + 1
                while self.is_word(j):
                    export = self.is_word(j + 1, EXPORT)
                    self.add("assign", self.t[j][1], j, flag=True, extra="export" if export else None)
                    j += 1 + export
                    if not self.is_sign(j, ","):
                        break
                    j += 1
                i, starts = j - 1, False
            elif kind == "word" and low in FOR:
                j = i + 1 + self.is_word(i + 1, EACH)
                if self.is_word(j):
                    self.add("loop", self.t[j][1], j)
                i, starts = j, False
            elif kind == "word" and low in NEW:
                if self.is_word(i + 1):
                    self.add("new", self.t[i + 1][1], i + 1)
                    i += 1
                starts = False
            elif kind == "word" and low not in WORDS:
                self.name(i, starts)
                starts = False
            else:
                starts = kind == "sign" and text == ";" or kind == "word" and low in OPENS | ENDS
            i += 1
        if self.t:
            self.leave(self.t[-1][5])

    def leave(self, end: int) -> None:
        """A procedure, if any is open, ends here."""
        if self.scope is not None:
            row = self.rows[self.scope]
            self.rows[self.scope], self.scope = (*row[:7], end, *row[8:]), None

    def name(self, i: int, starts: bool) -> None:
        if self.is_sign(i - 1, "."):
            return
        text = self.t[i][1]
        if self.is_sign(i + 1, "("):
            self.add("call", text, i, n_args=self.close(i + 1)[1])
        elif self.is_sign(i + 1, ".") and i + 2 < len(self.t) and self.t[i + 2][0] == "word":
            member, call = self.t[i + 2], self.is_sign(i + 3, "(")
            self.add("dot", text, i, member=member[1], end=member[2], flag=call, extra=f"{member[3]}:{member[4]}")
            if not call and self.is_sign(i + 3, ".") and i + 4 < len(self.t) and self.t[i + 4][0] == "word" and self.is_sign(i + 5, "("):
                method = self.t[i + 4]
                self.rows.append(("manager_call", text, method[1], member[1], method[2], method[3], method[4], None, self.close(i + 5)[1], None, None, self.scope))
        elif starts and self.is_sign(i + 1, "="):
            self.add("assign", text, i, flag=False)

    def queries(self) -> None:
        """String literals, those joined by + as one, that begin like a query; ``extra`` has (text offset, module byte, length) of each piece."""
        i = 0
        while i < len(self.t):
            if self.t[i][0] != "text":
                i += 1
                continue
            first, text, spans = i, "", []
            while True:
                for byte, value in pieces(self.t[i][1]):
                    spans.append(f"{len(text.encode())}:{self.t[i][2] + byte}:{len(value.encode())}")
                    text += value
                if self.is_sign(i + 1, "+") and i + 2 < len(self.t) and self.t[i + 2][0] == "text":
                    i += 2
                    continue
                break
            head = re.match(r"\s*(\w*)", text)[1].upper()
            if head in QUERY_HEADS:
                self.add("query", text, first, extra=",".join(spans))
            i += 1


COLUMNS = ["kind", "name", "member", "owner", "byte", "line", "col", "end_byte", "n_args", "flag", "extra", "scope"]
SCHEMA = "kind string, name string, member string, owner string, byte long, line int, col int, end_byte long, n_args int, flag boolean, extra string, scope int"


def extract(modules: DataFrame, key: str = "module_id", source: str = "source") -> DataFrame:
    """``key, emit_ord`` and the columns of ``SCHEMA``: all facts of all modules. A null source has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, n, *row) for k, text in zip(frame[key], frame[source], strict=True) for n, row in enumerate(Module(text or "").rows)]
            yield pd.DataFrame(rows, columns=[key, "emit_ord", *COLUMNS]).astype({"n_args": "Int32", "scope": "Int32", "end_byte": "Int64", "flag": "boolean"})

    kind = modules.schema[key].dataType.simpleString()
    return modules.select(key, source).mapInPandas(run, f"{key} {kind}, emit_ord int, {SCHEMA}")
