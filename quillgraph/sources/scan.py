"""Symbols and captures out of source text: Python by its own parser, TypeScript by a scanner.

Both give, for one file, symbols (kind, name, start_line, end_line, snippet, byte) and captures
(role, name, qualifier, source, row, byte, variant); lines count from 1.  A file that does not parse
as Python gives nothing.  The scanner knows strings, templates, comments, regular expressions and
brackets; it does no error recovery and reads TSX like TypeScript.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.text import clip

FOUND = "path string, what string, kind string, name string, qualifier string, source string, start_line int, end_line int, byte int, variant int, snippet string"
_ARROW = pa.schema([(n, {"string": pa.string(), "int": pa.int32()}[t]) for n, t in (x.split() for x in FOUND.split(", "))])


def _row(what: str, kind: str | None, name: str, start: int, end: int, byte: int, **more) -> dict:
    return {"what": what, "kind": kind, "name": name, "qualifier": None, "source": None, "start_line": start, "end_line": end, "byte": byte, "variant": 0, "snippet": None} | more


#: Where a statement begins that continues none before it.
_TOP = re.compile(r"\n(?=(?:def|class|async[ \t]+def)[ \t]|@)")
#: A file is read in parts of about so many characters or tokens, since its tree and tokens take many times its size.
PART, PART_TOKENS = 1 << 16, 1 << 16


def _python_trees(text: str) -> Iterator[tuple[str, ast.Module]]:
    """Consecutive parts of a module and their trees.

    A part ends before a line that begins a statement of its own, and only where it parses alone, so inside no string
    or bracket; where it does not parse it is tried again at twice the length, so a text without such places is one part.
    """
    begin, most, n = 0, PART, len(text)
    while begin < n or not n:
        m = _TOP.search(text, begin + most)
        end = m.end() if m else n
        part = text[begin:end]
        try:
            tree = ast.parse(part)
        except (SyntaxError, ValueError, RecursionError):
            if m is None:
                raise
            most *= 2
            continue
        yield part, tree
        if end == n:
            return
        begin, most = end, PART


def scan_python(text: str) -> list[dict]:
    """Functions and classes at any depth, from their `def` or `class` line on; calls and base classes as captures."""
    try:
        return [r for part in python_parts(text) for r in part]
    except (SyntaxError, ValueError, RecursionError):
        return []


def python_parts(text: str) -> Iterator[list[dict]]:
    """The rows of a module part by part, in order; raises what `ast.parse` does where the module does not parse."""
    line = byte = 0
    for part, tree in _python_trees(text):
        raw = part.encode()
        rows = _python_rows(tree, raw)
        for r in rows:
            r["start_line"], r["end_line"], r["byte"] = r["start_line"] + line, r["end_line"] + line, r["byte"] + byte
        yield rows
        line, byte = line + len(raw.splitlines()), byte + len(raw)


def _python_rows(tree: ast.Module, raw: bytes) -> list[dict]:
    lines = raw.splitlines(keepends=True)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            begin = starts[node.lineno - 1] + node.col_offset
            end = starts[node.end_lineno - 1] + node.end_col_offset
            kind = "class_definition" if isinstance(node, ast.ClassDef) else "function_definition"
            out.append(_row("symbol", kind, node.name, node.lineno, node.end_lineno, begin, snippet=clip(raw[begin:end].decode(errors="replace"))))
            for base in node.bases if isinstance(node, ast.ClassDef) else ():
                if isinstance(base, ast.Name):
                    out.append(_row("extends", None, base.id, base.lineno, base.lineno, starts[base.lineno - 1] + base.col_offset))
        elif isinstance(node, ast.Call):
            f = node.func
            at = dict(start=f.lineno, end=f.lineno, byte=starts[f.lineno - 1] + f.col_offset)
            if isinstance(f, ast.Name):
                out.append(_row("call", None, f.id, **at))
            elif isinstance(f, ast.Attribute):
                out.append(_row("call", None, f.attr, **at, qualifier=f.value.id if isinstance(f.value, ast.Name) else None))
        elif isinstance(node, ast.ImportFrom) and node.level:
            source = "./" + "../" * (node.level - 1) + (node.module or "").replace(".", "/")
            for a in node.names:
                out.append(_row("import", None, a.name, node.lineno, node.lineno, starts[node.lineno - 1] + node.col_offset, source=source + ".py", variant=1, qualifier=a.asname))
    return sorted(out, key=lambda r: (r["byte"], r["what"]))


_WORD = re.compile(r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*")
_NUMBER = re.compile(r"\d[\w.]*")
_BLANK = re.compile(r"\s+")
#: After these words or signs a slash begins a regular expression.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "instanceof", "else", "do", "yield", "await"}
_OPEN, _CLOSE = "([{", ")]}"
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "new", "await", "super", "import", "with", "do", "else", "throw", "delete", "void", "yield", "in", "of", "case", "instanceof"}
_MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "async", "override", "get", "set", "declare", "accessor"}


def tokenize(text: str) -> list[tuple[str, str, int]]:
    """(type, text, offset): words, numbers, strings (with quotes), templates, regular expressions and signs; no blanks or comments."""
    return list(tokens(text))


def tokens(text: str) -> Iterator[tuple[str, str, int]]:
    """The same, one after the other."""
    i, n = 0, len(text)
    last = ("", "", 0)
    templates: list[int] = []  # open brackets inside each ${ }
    depth = 0

    def template(at: int) -> int:
        """From inside a template to its end or its next ${."""
        while at < n:
            if text[at] == "\\":
                at += 2
            elif text[at] == "`":
                return at + 1
            elif text.startswith("${", at):
                templates.append(depth)
                return at + 2
            else:
                at += 1
        return n

    while i < n:
        c, token = text[i], None
        if m := _BLANK.match(text, i):
            i = m.end()
        elif text.startswith("//", i):
            end = text.find("\n", i)
            i = n if end < 0 else end
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i = n if end < 0 else end + 2
        elif m := _WORD.match(text, i):
            token = ("word", m[0], i)
            i = m.end()
        elif m := _NUMBER.match(text, i):
            token = ("number", m[0], i)
            i = m.end()
        elif c in "'\"":
            j = i + 1
            while j < n and text[j] != c and text[j] != "\n":
                j += 2 if text[j] == "\\" else 1
            token = ("string", text[i : j + 1], i)
            i = j + 1
        elif c == "`":
            token = ("template", "`", i)
            i = template(i + 1)
        elif c == "}" and templates and templates[-1] == depth:
            templates.pop()
            i = template(i + 1)
        elif c == "/" and (last[0] in {"", "sign"} and last[1] not in {")", "]", "}"} or last[0] == "word" and last[1] in _BEFORE_REGEX):
            j, inside = i + 1, False
            while j < n and text[j] != "\n" and (inside or text[j] != "/"):
                inside = text[j] == "[" or inside and text[j] != "]"
                j += 2 if text[j] == "\\" else 1
            m = re.compile(r"[a-z]*").match(text, min(j + 1, n))
            token = ("regex", text[i : m.end()], i)
            i = m.end()
        else:
            sign = "=>" if text.startswith("=>", i) else "..." if text.startswith("...", i) else "?." if text.startswith("?.", i) else c
            depth += (c in _OPEN) - (c in _CLOSE)
            token = ("sign", sign, i)
            i += len(sign)
        if token:
            last = token
            yield token


class _Places:
    """Lines and bytes of a text's offsets."""

    def __init__(self, text: str):
        self.text, self.lines = text, [0, *[m.end() for m in re.finditer("\n", text)]]
        self.bytes = None if text.isascii() else [0, *accumulate(len(text[i : i + 1024].encode()) for i in range(0, len(text), 1024))]

    def line(self, offset: int) -> int:
        return bisect_right(self.lines, offset)

    def byte(self, offset: int) -> int:
        return offset if self.bytes is None else self.bytes[offset >> 10] + len(self.text[offset & ~1023 : offset].encode())



class _Script:
    """A script, or the part of it that these tokens are."""

    def __init__(self, text: str, part: list[tuple[str, str, int]], places: _Places):
        self.text, self.t = text, part
        self.line, self.byte = places.line, places.byte
        self.pair: dict[int, int] = {}
        stack: list[int] = []
        for k, (kind, s, _) in enumerate(self.t):
            if kind == "sign" and s in _OPEN:
                stack.append(k)
            elif kind == "sign" and s in _CLOSE and stack:
                self.pair[stack.pop()] = k
        self.out: list[dict] = []
        self.heads: set[int] = set()  # names that declare a member, not call one

    def at(self, k: int) -> str:
        return self.t[k][1] if 0 <= k < len(self.t) else ""

    def is_word(self, k: int) -> bool:
        return 0 <= k < len(self.t) and self.t[k][0] == "word"

    def close(self, k: int) -> int:
        return self.pair.get(k, len(self.t) - 1)

    def type_arguments(self, k: int) -> int:
        """Past <...> that begins at k, if it does; past all tokens if a statement or bracket ends before, as then it is a comparison."""
        if self.at(k) != "<":
            return k
        depth = 0
        while k < len(self.t):
            s = self.at(k)
            if s == ";" or s in _CLOSE and s:
                return len(self.t)
            depth += (s == "<") - (s == ">")
            k = self.close(k) + 1 if s in _OPEN and s else k + 1
            if not depth:
                break
        return k

    def body(self, k: int, *, until: str = "{") -> int | None:
        """Index of the next `until` at this depth, before a semicolon."""
        while k < len(self.t):
            s = self.at(k)
            if s == until:
                return k
            if s == ";" or s in _CLOSE and s:
                return None
            k = self.close(k) + 1 if s in _OPEN and s else k + 1
        return None

    def statement_end(self, k: int) -> int:
        """Last token of a statement that has no body of its own: at its semicolon, or where a line ends it."""
        last = k
        while k < len(self.t):
            s = self.at(k)
            if s == ";":
                return k
            if s in _CLOSE and s:
                return last
            if k > last and self.line(self.t[k][2]) > self.line(self.t[last][2] + len(self.at(last)) - 1) and self.at(last) not in {"=", ",", "=>", "+", "-", "*", "|", "&", "?", ":", ".", "<", "(", "||", "&&"} and s not in {".", "?", ":", "|", "&", "+", "*", "=", "=>", ",", "?.", "(", "["}:
                return last
            last = self.close(k) if s in _OPEN and s else k
            k = last + 1
        return last

    def symbol(self, kind: str, name: str, first: int, last: int) -> None:
        a, (_, s, b) = self.t[first][2], self.t[last]
        self.out.append(_row("symbol", kind, name, self.line(a), self.line(b + len(s) - 1), self.byte(a), snippet=clip(self.text[a : b + len(s)])))

    def capture(self, what: str, k: int, **more) -> None:
        a = self.t[k][2]
        row = self.line(a)
        self.out.append(_row(what, None, self.at(k), row, row, self.byte(a), **more))

    def names(self, k: int, stop: set[str], what: str) -> int:
        """Capture the plain or generic names of a comma list; qualified ones are passed over."""
        while k < len(self.t) and self.at(k) not in stop:
            if self.is_word(k) and self.at(k + 1) not in {".", "("} and self.at(k - 1) != ".":
                self.capture(what, k)
                k = self.type_arguments(k + 1)
            elif self.at(k) == "<":
                k = self.type_arguments(k)
            elif self.at(k) in _OPEN:
                k = self.close(k) + 1
            else:
                k += 1
        return k

    def heritage(self, k: int, end: int) -> None:
        k = self.type_arguments(k)
        while k < end:
            if self.at(k) == "extends":
                k = self.names(k + 1, {"{", "implements"}, "extends")
            elif self.at(k) == "implements":
                k = self.names(k + 1, {"{"}, "implements")
            else:
                k += 1

    def imports(self, k: int) -> None:
        """An import statement with a clause; each bound name with its source."""
        end = k + 1
        while end < len(self.t) and self.t[end][0] != "string" and self.at(end) != ";":
            end += 1
        if end >= len(self.t) or self.t[end][0] != "string" or self.at(end - 1) != "from":
            return
        source = self.at(end)[1:-1]
        i = k + 2 if self.at(k + 1) == "type" and self.at(k + 2) not in {"from", ","} else k + 1
        while i < end - 1:
            if self.at(i) == "{":
                stop, j = self.close(i), i + 1
                while j < stop:
                    if self.at(j) == "type" and self.is_word(j + 1) and self.at(j + 1) != "as":
                        j += 1
                    if self.is_word(j):
                        local = self.at(j + 2) if self.at(j + 1) == "as" else None
                        self.capture("import", j, source=source, variant=1, qualifier=local)
                    while j < stop and self.at(j) != ",":
                        j += 1
                    j += 1
                i = stop + 1
            elif self.at(i) == "*":
                self.capture("import", i + 2, source=source, variant=2)
                i += 3
            elif self.is_word(i):
                self.capture("import", i, source=source, variant=3)
                i += 1
            else:
                i += 1

    def members(self, first: int, last: int) -> None:
        """Methods of a class body: a name, perhaps type parameters, an argument list and a body."""
        k, begin = first + 1, first + 1
        while k < last:
            s = self.at(k)
            if s == "@" and self.is_word(k + 1):
                k += 2
                k = self.close(k) + 1 if self.at(k) == "(" else k
                begin = k
            elif self.is_word(k) and s in _MODIFIERS and self.at(k + 1) not in {"(", "=", ";", ":", "<", "?"}:
                k += 1
            elif s in {"*", "#"}:
                k += 1
            elif self.is_word(k) and (a := self.type_arguments(k + 1)) < last and self.at(a) == "(":
                self.heads.add(k)
                body = self.method_body(self.close(a) + 1, last)
                if body is not None:
                    self.symbol("method_definition", self.at(k), begin, self.close(body))
                    k = self.close(body) + 1
                else:
                    k = self.statement_end(a) + 1
                begin = k
            else:
                k = self.statement_end(k) + 1
                begin = k

    def method_body(self, k: int, last: int) -> int | None:
        """The body's brace after an argument list and perhaps a return type."""
        if self.at(k) == "{":
            return k
        if self.at(k) != ":":
            return None
        k += 1
        while k < last:
            s = self.at(k)
            if s == "{" and self.at(k - 1) not in {":", "|", "&", "=>", "<", ","}:
                return k
            if s == ";":
                return None
            k = self.type_arguments(k) if s == "<" else self.close(k) + 1 if s in _OPEN and s else k + 1
        return None

    def run(self) -> list[dict]:
        for k, (kind, s, _) in enumerate(self.t):
            if kind != "word" or self.at(k - 1) in {".", "?."}:
                if kind == "word":
                    self.call(k)
                continue
            following = self.at(k + 1)
            if s == "function" and (name := k + 2 if following == "*" else k + 1) and self.is_word(name):
                first = k - 1 if self.at(k - 1) == "async" else k
                declared = first == 0 or self.at(first - 1) in {"", ";", "{", "}", "export", "default", "declare"} or self.line(self.t[first - 1][2]) < self.line(self.t[first][2])
                body = self.body(name + 1)
                if declared and body is not None:
                    self.symbol("function_declaration", self.at(name), first, self.close(body))
            elif s == "class" and self.is_word(k + 1) and following not in {"extends", "implements"}:
                body = self.body(self.type_arguments(k + 2))
                if body is not None:
                    self.symbol("class_declaration", following, k, self.close(body))
                    self.heritage(k + 2, body)
                    self.members(body, self.close(body))
            elif s == "class" and (body := self.body(k + 1)) is not None:
                self.heritage(k + 1, body)
                self.members(body, self.close(body))
            elif s == "interface" and self.is_word(k + 1) and (body := self.body(self.type_arguments(k + 2))) is not None:
                self.symbol("interface_declaration", following, k, self.close(body))
                self.heritage(k + 2, body)
                self.heads.update(range(body + 1, self.close(body)))
            elif s == "type" and self.is_word(k + 1) and self.at(self.type_arguments(k + 2)) == "=":
                self.symbol("type_alias_declaration", following, k, self.statement_end(self.type_arguments(k + 2) + 1))
            elif s == "enum" and self.is_word(k + 1) and self.at(k + 2) == "{":
                self.symbol("enum_declaration", following, k, self.close(k + 2))
            elif s in {"const", "let"} and self.is_word(k + 1) and following != "enum":
                last = self.statement_end(k + 1)
                for name in self.declared(k + 1, last):
                    self.symbol("lexical_declaration", self.at(name), k, last)
            elif s == "import" and following not in {"(", "."}:
                self.imports(k)
            else:
                self.call(k)
        return sorted(self.out, key=lambda r: (r["byte"], r["what"], r["name"]))

    def declared(self, k: int, last: int) -> list[int]:
        """The plain names that a const or let binds."""
        out, fresh = [], True
        while k <= last:
            if fresh and self.is_word(k):
                out.append(k)
            fresh = self.at(k) == ","
            k = self.type_arguments(k) if self.at(k) == "<" and not fresh and self.type_arguments(k) <= last else self.close(k) + 1 if self.at(k) in _OPEN and self.at(k) else k + 1
        return out

    def call(self, k: int) -> None:
        """A called or constructed name, with its object if that is a plain name."""
        a = self.type_arguments(k + 1) if self.at(k + 1) == "<" else k + 1
        if a != k + 1 and self.at(a) != "(":
            return
        before = self.at(k - 1)
        member = before in {".", "?."}
        head = k - 2 if member else k
        made = self.at(head - 1) == "new"
        if k in self.heads or self.at(a) != "(" and (not made or self.at(a) in {".", "?."}):
            return
        if not member and (self.at(k) in _NOT_METHODS or before == "function" or self.at(k - 2) == "function" and before == "*"):
            return
        plain = member and self.is_word(head) and self.at(head - 1) not in {".", "?."} and self.at(head) not in {"this", "super"}
        self.capture("call", k, qualifier=self.at(head) if plain else None)


    def whole(self) -> bool:
        """Whether what may be type arguments ends among these tokens."""
        for k, (kind, s, _) in enumerate(self.t):
            if kind == "sign" and s == "<" and self.type_arguments(k) == len(self.t):
                while k < len(self.t) and self.at(k) != ";" and not (self.at(k) in _CLOSE and self.at(k)):
                    k = self.close(k) + 1 if self.at(k) in _OPEN and self.at(k) else k + 1
                if k >= len(self.t):
                    return False
        return True


def scan_script(text: str) -> list[dict]:
    return [r for part in script_parts(text) for r in part]


#: Words that begin a statement wherever they stand at the top of a script on a line of their own.
_TOP_WORDS = {"export", "function", "class", "interface", "enum", "const", "let", "import", "abstract", "declare"}


def script_parts(text: str) -> Iterator[list[dict]]:
    """The rows of a script part by part, in order.

    A part ends outside of all brackets, behind a closing brace and before a statement on a new line, and only where no
    import clause and no type argument is open, so that what is read of it does not depend on what follows.
    """
    places, part, depth, importing, most = _Places(text), [], 0, False, PART_TOKENS
    for token in tokens(text):
        kind, s, at = token
        if len(part) >= most and not depth and not importing and kind == "word" and s in _TOP_WORDS and part[-1][:2] == ("sign", "}") and places.line(at) > places.line(part[-1][2]):
            script = _Script(text, part, places)
            if script.whole():
                yield script.run()
                part, most = [], PART_TOKENS
            else:
                most *= 2
        part.append(token)
        if kind == "sign":
            depth = depth + 1 if s in _OPEN else max(0, depth - 1) if s in _CLOSE else depth
        importing = kind == "word" and s == "import" or importing and kind != "string" and s != ";"
    yield _Script(text, part, places).run()


def extract(files: DataFrame) -> DataFrame:
    """FOUND rows of files (path, content, lang): symbols and captures of each, one file at a time and a large one in parts.

    The files are dealt out anew, as a few large ones may stand in one partition.
    """

    def parts(path: str, text: str | None, lang: str) -> Iterator[pa.RecordBatch]:
        scan = {"python": python_parts, "typescript": script_parts}.get(lang)
        for rows in scan(text) if scan and text is not None else ():
            yield pa.RecordBatch.from_pylist([{"path": path} | r for r in rows], schema=_ARROW)

    def run(batches):
        for batch in batches:
            small = []  # of many small files, batches are put together
            for i in range(len(batch)):
                path, text, lang = (batch.column(k)[i].as_py() for k in range(3))
                found = parts(path, text, lang)
                if lang == "python":  # a file that does not parse to its end gives nothing
                    try:
                        found = list(found)
                    except (SyntaxError, ValueError, RecursionError):
                        continue
                for rows in found:
                    small.append(rows)
                    if sum(map(len, small)) >= 4096 or len(small) >= 256:
                        yield from pa.Table.from_batches(small).combine_chunks().to_batches()
                        small = []
            if small:
                yield from pa.Table.from_batches(small).combine_chunks().to_batches()

    spread = 2 * files.sparkSession.sparkContext.defaultParallelism
    return files.select("path", "content", "lang").repartition(spread).mapInArrow(run, FOUND)


def symbols_of(found: DataFrame) -> DataFrame:
    """kind, name, path, lines, snippet and position of the symbols that have a name."""
    return found.where("what = 'symbol' AND name <> ''").select("kind", "name", "path", "start_line", "end_line", "snippet", "byte")


def captures_of(found: DataFrame) -> DataFrame:
    """Captures in the form that the resolver reads."""
    from pyspark.sql import functions as F

    return found.where("what <> 'symbol'").select("path", F.col("what").alias("role"), "name", "qualifier", "source", F.col("start_line").alias("row"), "byte", "variant")
