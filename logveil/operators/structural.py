"""Detectors that read the layout of a text: delimited exports, and three PowerShell shapes.

Each yields ``(start, end, label)`` in code points.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import values as V

Found = Iterator[tuple[int, int, str]]

_ADDRESS, _MAILBOX = re.compile(V.FULL_IP), re.compile(V.FULL_EMAIL)
_HEADER = re.compile(V.HEADERISH)
_PARAMETER, _ITEM, _NOUN = re.compile(V.PS_PARAMETER), re.compile(V.PS_ITEM), re.compile(V.PS_NAME_CMDLET)
_RULER, _ENCODED = re.compile(V.PS_RULER), re.compile(V.PS_ENCODED)
_NOT_LETTER = re.compile(r"[^a-z]")
_BLANK = " \t"
ENCODED_LIMIT = 1 << 18


def _parameters() -> dict[str, str]:
    """Labels of parameters: the listed names, their plurals, and two irregular ones."""
    listed = {name: label for label, names in V.PS_PARAMETERS.items() for name in names.split()}
    plural = {f"{name}s": label for name, label in listed.items() if f"{name}s" not in listed}
    return listed | plural | {"identities": "USER", "mailboxes": "USER"}


PARAMETERS = _parameters()
NOUNS = {noun: label for label, nouns in V.PS_NOUNS.items() for noun in nouns.split()}


def _plain(name: str) -> str:
    return _NOT_LETTER.sub("", name.lower())


def _any_in(words: list[str], name: str) -> bool:
    return any(w in name for w in words)


def column_label(header: str) -> str | None:
    """What the cells under a column name hold."""
    name = _plain(header)
    if not name or _any_in(V.CSV_EXCLUDE, name):
        return None
    for label, words in (("USER", V.CSV_USER), ("DOMAIN", V.CSV_DOMAIN), ("HOST", V.CSV_HOST)):
        if _any_in(words, name):
            return label
    return None


def column_label_column(header: Column) -> Column:
    """``column_label`` as an expression."""
    name = F.regexp_replace(F.lower(header), "[^a-z]", "")

    def has(words: list[str]) -> Column:
        return name.rlike("|".join(words))

    out = F.when((name == "") | has(V.CSV_EXCLUDE), F.lit(None).cast("string"))
    for label, words in (("USER", V.CSV_USER), ("DOMAIN", V.CSV_DOMAIN), ("HOST", V.CSV_HOST)):
        out = out.when(has(words), label)
    return out


def cells(line: str, delimiter: str) -> list[tuple[int, int]]:
    """Where the cells of a line lie; of a quoted cell, what is inside the quotes."""
    out = []
    at, end = 0, len(line)
    while at <= end:
        if line.startswith('"', at):
            close = at + 1
            while (close := line.find('"', close)) >= 0 and line.startswith('""', close):
                close += 2
            close = end if close < 0 else close
            out.append((at + 1, close) if at + 1 <= close else (at + 1, at + 1))
            after = line.find(delimiter, close)
        else:
            after = line.find(delimiter, at)
            out.append((at, end if after < 0 else after))
        if after < 0:
            break
        at = after + 1
    return out


def _lines(text: str) -> Iterator[tuple[int, str]]:
    at = 0
    for line in text.split("\n"):
        yield at, line.rstrip("\r")
        at += len(line) + 1


def _trimmed(line: str, start: int, end: int) -> tuple[int, int]:
    cell = line[start:end]
    left = len(cell) - len(cell.lstrip(_BLANK))
    return start + left, max(start + left, start + len(cell.rstrip(_BLANK)))


def _precise(value: str) -> bool:
    """Addresses and mailboxes keep the label that their own rule gives."""
    return bool(_ADDRESS.fullmatch(value) or _MAILBOX.fullmatch(value))


def delimited(text: str) -> Found:
    """Cells under sensitive column names, where the first line is a convincing header."""
    head, newline, _ = text.partition("\n")
    head = head.rstrip("\r")
    if not newline or head.lstrip().startswith(("{", "[")):
        return
    delimiter = max("\t,", key=lambda d: (head.count(d), d == ","))
    if head.count(delimiter) < 3:
        return
    names = [head[a:b].strip() for a, b in cells(head, delimiter)]
    labels = [column_label(n) for n in names]
    if sum(bool(_HEADER.match(n)) for n in names) < 0.8 * len(names) or not any(labels):
        return
    rows = _lines(text)
    next(rows)
    for offset, row in rows:
        if not row.strip():
            continue
        for (a, b), label in zip(cells(row, delimiter), labels, strict=False):
            if label:
                a, b = _trimmed(row, a, b)
                if a < b and not _precise(row[a:b]):
                    yield offset + a, offset + b, label


def parameters(text: str) -> Found:
    """Arguments of parameters that name a person, machine, resource or address; each item of a list by itself."""
    for m in _PARAMETER.finditer(text):
        name = m[1].lower().replace("-", "")
        label = PARAMETERS.get(name)
        if label is None and name in V.PS_CONTEXT_PARAMETERS:
            noun = _NOUN.search(text[text.rfind("\n", 0, m.start()) + 1 : m.start()])
            label = noun and NOUNS.get(noun[1].lower())
        at = m.end()
        while label:
            if text[at : at + 1] in ('"', "'"):
                a, b = at + 1, text.find(text[at], at + 1)
                if b < 0:
                    break
                at = b + 1
            elif item := _ITEM.match(text, at):
                a, b = item.span()
                at = b
            else:
                break
            if a < b and not _precise(text[a:b]):
                yield a, b, label
            if text[at : at + 1] != ",":
                break
            at += 1
            while text[at : at + 1] in (" ", "\t"):
                at += 1


def table_label(name: str, siblings: list[str]) -> str | None:
    """What a column of a printed table holds; bare names are read from the columns beside them."""
    plain = _plain(name)
    if not plain:
        return None
    if _any_in(V.PS_COLUMN_USER, plain):
        return "USER"
    if _any_in(V.PS_COLUMN_HOST, plain):
        return "HOST"
    if plain not in V.PS_COLUMN_CONTEXT:
        return column_label(name)
    for label, words in ((None, V.PS_SOFTWARE_TABLE), ("USER", V.PS_ACCOUNT_TABLE), ("HOST", V.PS_MACHINE_TABLE)):
        if any(_any_in(words, s) for s in siblings):
            return label
    return None


def tables(text: str) -> Found:
    """Cells of tables whose columns a row of dashes marks, under sensitive names."""
    if "--" not in text:
        return
    columns: list[tuple[int, int, str | None]] = []
    above = ""
    for number, (offset, line) in enumerate(_lines(text)):
        ruled = bool(_RULER.match(line))
        if ruled or not line.strip():
            columns = []
        if ruled and number and above.strip():
            begins = [d.start() for d in re.finditer("-{2,}", line)]
            bounds = [(a, b - 1) for a, b in zip(begins, [*begins[1:], 10**9 + 1], strict=True)]
            names = [above[a:b].strip() for a, b in bounds]
            beside = [_plain(n) for n in names]
            columns = [(a, b, table_label(n, beside)) for (a, b), n in zip(bounds, names, strict=True)]
        elif not ruled:
            for a, b, label in columns:
                if not label or a >= len(line):
                    continue
                a, b = _trimmed(line, a, min(b, len(line)))
                # a value wider than its column is taken whole
                while b < len(line) and line[b] not in _BLANK:
                    b += 1
                while a > 0 and line[a - 1] not in _BLANK:
                    a -= 1
                value = line[a:b]
                if value and not _precise(value) and re.search("[A-Za-z0-9]", value):
                    yield offset + a, offset + b, label
        above = line


def decode_command(blob: str) -> str:
    """The command in a base64 argument (UTF-16LE, else UTF-8), or nothing where it isn't mostly printable."""
    try:
        raw = base64.b64decode(blob + "=" * (-len(blob) % 4), validate=True)
    except ValueError:
        return ""
    for encoding in ("utf-16-le", "utf-8"):
        try:
            out = raw.decode(encoding)
        except UnicodeDecodeError:
            continue
        if out and sum(c >= " " or c in "\n\t" for c in out) >= 0.9 * len(out):
            return out
    return ""


def encoded(text: str, sensitive: Callable[[str], bool]) -> Found:
    """Encoded commands that would be masked if they were typed out."""
    for m in _ENCODED.finditer(text):
        if len(m[1]) <= ENCODED_LIMIT:
            command = decode_command(m[1])
            if command and sensitive(command):
                yield m.start(1), m.end(1), "ENCODED"
