"""Front matter: the part of YAML that pages use, and TOML.

YAML by indentation: nested maps and lists, flow maps and lists, plain and quoted scalars over several lines, text blocks, comments, and
anchors with their aliases.  Scalars stay text, so dates and numbers are as written; null, ~ and nothing are None.
Tags, merge keys and several documents are not read: ValueError, as for whatever is no YAML.
"""

from __future__ import annotations

import re
import tomllib

_KEY = re.compile(r"""(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|([^\s#&*!|>'"%@`\[\]{},?-][^#]*?|[?:-][^\s#][^#]*?))\s*:(?=\s|$)""")
_ESCAPES = {"n": "\n", "t": "\t", '"': '"', "\\": "\\", "/": "/", "0": "\0", "r": "\r", " ": " "}


def parse_front(text: str, kind: str = "yaml") -> dict:
    """Front matter as a dict of None, text, lists and dicts.  ValueError for what can't be read."""
    if kind == "toml":
        return {k: _texts(v) for k, v in tomllib.loads(text).items()}
    out = _Yaml(text).document()
    if out is None:
        return {}
    if not isinstance(out, dict):
        raise ValueError("front matter is no map")
    return out


def _texts(value):
    if isinstance(value, dict):
        return {k: _texts(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_texts(v) for v in value]
    return {True: "true", False: "false"}[value] if isinstance(value, bool) else str(value)


def _bare(line: str) -> str:
    """A line without its comment, which begins at a # behind white space and outside of quotes."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            if c == "\\" and quote == '"':
                continue
            quote = "" if c == quote and not (quote == '"' and line[i - 1] == "\\") else quote
        elif c in "\"'" and (i == 0 or line[i - 1] in " \t[{,:-"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i].rstrip()
    return line.rstrip()


class _Yaml:
    def __init__(self, text: str):
        self.raw = text.splitlines()
        self.at, self.anchors = 0, {}

    def _next(self) -> tuple[int, str] | None:
        """Indentation and content of the next line that has some."""
        while self.at < len(self.raw):
            line = _bare(self.raw[self.at])
            if line.strip():
                if "\t" in line[: len(line) - len(line.lstrip())]:
                    raise ValueError(f"line {self.at + 1}: a tab in the indentation")
                return len(line) - len(line.lstrip(" ")), line.strip()
            self.at += 1
        return None

    def document(self):
        first = self._next()
        if first is None:
            return None
        out = self.block(first[0])
        if self._next() is not None:
            raise ValueError(f"line {self.at + 1}: neither key nor item")
        return out

    def block(self, indent: int):
        """What stands at this indentation: a list, a map, or text."""
        _, line = self._next()
        if line == "-" or line.startswith("- "):
            return self.items(indent)
        if _KEY.match(line):
            return self.map(indent)
        self.at += 1
        return self.value(line, indent - 1)

    def items(self, indent: int) -> list:
        out = []
        while (here := self._next()) and here[0] == indent and (here[1] == "-" or here[1].startswith("- ")):
            rest = here[1][1:].lstrip()
            inner = indent + len(here[1]) - len(rest)
            if rest and _KEY.match(rest) or rest.startswith("- "):
                self.raw[self.at] = " " * inner + rest  # a map or list within the item starts on its line
                out.append(self.block(inner))
            else:
                self.at += 1
                out.append(self.value(rest, indent))
        if here and here[0] > indent:
            raise ValueError(f"line {self.at + 1}: an item is indented unlike the others")
        return out

    def map(self, indent: int) -> dict:
        out: dict = {}
        while (here := self._next()) and here[0] == indent:
            found = _KEY.match(here[1])
            if not found:
                raise ValueError(f"line {self.at + 1}: a key is missing")
            key = _unescaped(found[1]) if found[1] is not None else found[2].replace("''", "'") if found[2] is not None else found[3]
            if key in out:
                raise ValueError(f"line {self.at + 1}: {key} stands twice")
            self.at += 1
            out[key] = self.value(here[1][found.end() :].strip(), indent, True)
        if here and here[0] > indent:
            raise ValueError(f"line {self.at + 1}: a key is indented unlike the others")
        return out

    def value(self, text: str, indent: int, of_key: bool = False):
        """A value that begins with ``text``; what is indented more than ``indent`` belongs to it."""
        if text.startswith("*"):
            if text[1:] not in self.anchors:
                raise ValueError(f"line {self.at}: nothing is called {text[1:]}")
            return self.anchors[text[1:]]
        if text.startswith("&"):
            name, _, rest = text[1:].partition(" ")
            self.anchors[name] = self.value(rest.strip(), indent, of_key)
            return self.anchors[name]
        if text.startswith("!"):
            raise ValueError(f"line {self.at}: tags are not read")
        if re.fullmatch(r"[|>][+-]?\d?[+-]?", text):
            return self.literal(text, indent)
        if not text:
            here = self._next()
            if here and (here[0] > indent or of_key and here[0] == indent and (here[1] == "-" or here[1].startswith("- "))):
                return self.block(here[0])
            return None
        if text[0] in "[{\"'":
            while not _closed(text):
                if self.at >= len(self.raw):
                    raise ValueError("brackets or quotes don't match")
                more = self.raw[self.at].strip() if text[0] in "\"'" else _bare(self.raw[self.at]).strip()
                text, self.at = f"{text} {more}" if more else text, self.at + 1
            out, end = _flow(text, 0, self.anchors)
            if text[end:].strip():
                raise ValueError(f"line {self.at}: more behind a value")
            return out
        if re.search(r":\s", text) or text.endswith(":"):
            raise ValueError(f"line {self.at}: a map within a value")
        while (here := self._next()) and here[0] > indent:  # plain text goes on
            if _KEY.match(here[1]):
                raise ValueError(f"line {self.at + 1}: a key below a value")
            text, self.at = f"{text} {here[1]}", self.at + 1
        return _plain(text)

    def literal(self, sign: str, indent: int) -> str:
        lines, own = [], None
        while self.at < len(self.raw):
            line = self.raw[self.at]
            if line.strip():
                depth = len(line) - len(line.lstrip(" "))
                own = depth if own is None else own
                if depth <= indent or depth < own:
                    break
            lines.append(line[own or 0 :] if line.strip() else "")
            self.at += 1
        while lines and not lines[-1]:
            lines.pop()
        if sign[0] == "|":
            return "\n".join(lines)
        return re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(lines)).replace("\n\n", "\n")


def _plain(text: str) -> str | None:
    return None if text in ("", "~", "null", "Null", "NULL") else text


def _unescaped(text: str) -> str:
    return re.sub(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", lambda m: _ESCAPES.get(m[1]) or (chr(int(m[1][1:], 16)) if len(m[1]) > 1 else m[1]), text)


def _closed(text: str) -> bool:
    """Whether the quote or bracket that begins ``text`` ends in it."""
    try:
        _flow(text, 0, None)
    except IndexError:
        return False
    return True


def _flow(text: str, i: int, anchors: dict | None):
    """(value, end) of the flow value at ``i``; IndexError where the text ends within it."""
    while text[i] in " \t":
        i += 1
    if text[i] in "\"'":
        quote, end = text[i], i + 1
        while text[end] != quote or quote == "'" and text[end + 1 : end + 2] == "'":
            end += 2 if text[end] == "\\" and quote == '"' or text[end] == quote else 1
        inner = text[i + 1 : end]
        return (_unescaped(inner) if quote == '"' else inner.replace("''", "'")), end + 1
    if text[i] in "[{":
        many, close, out, i = text[i] == "[", "]" if text[i] == "[" else "}", [], i + 1
        while True:
            while text[i] in " \t":
                i += 1
            if text[i] == close:
                break
            item, i = _flow(text, i, anchors)
            while text[i] in " \t":
                i += 1
            if text[i] == ":":
                after = i + 1
                if text[after] in ",]}":
                    value, i = None, after
                else:
                    value, i = _flow(text, after, anchors)
                item = (item, value) if not many else {item: value}
                while text[i] in " \t":
                    i += 1
            elif not many:
                item = (item, None)
            out.append(item)
            if text[i] == ",":
                i += 1
            elif text[i] != close:
                raise ValueError("a comma is missing")
        return (out if many else dict(out)), i + 1
    end = i
    while text[end] not in ",]}" and not (text[end] == ":" and text[end + 1] in " ,]}"):
        end += 1
    plain = text[i:end].strip()
    if plain.startswith("*") and anchors is not None:
        if plain[1:] not in anchors:
            raise ValueError(f"nothing is called {plain[1:]}")
        return anchors[plain[1:]], end
    return _plain(plain), end
