"""Patterns of linear-time matchers, translated for Java's matcher.

What both have in common is spelled so that it means the same: lines end at \\n only, ``$`` is the end of the text, classes are
ASCII, ``\\C`` is any character (of bytes seen as Latin-1: any byte), names of groups are dropped.  What linear-time
matchers lack (lookaround, back-references, possessive quantifiers) is rejected.
"""

from __future__ import annotations

import re
from functools import lru_cache

from wideleaf.errors import InvalidArgument

# The named ASCII classes, and the escapes of one letter.
_POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": "\\u0000-\\u007f", "blank": "\\u0009\\u0020", "cntrl": "\\u0000-\\u001f\\u007f", "digit": "0-9", "graph": "\\u0021-\\u007e", "lower": "a-z",
    "print": "\\u0020-\\u007e", "punct": "\\u0021-\\u002f\\u003a-\\u0040\\u005b-\\u0060\\u007b-\\u007e", "space": "\\u0009-\\u000d\\u0020", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_PERL = {"d": "0-9", "w": "0-9A-Za-z_", "s": "\\u0009\\u000a\\u000c\\u000d\\u0020"}
_LETTERS = {"a": 7, "f": 12, "t": 9, "n": 10, "r": 13, "v": 11}
_REPEAT = re.compile(r"\{(\d+)(,(\d*))?\}")
_ANY = "(?s:.)"
_EDGE = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
_INSIDE = "(?:(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<![0-9A-Za-z_])(?![0-9A-Za-z_]))"
_MOST_REPEATS = 1000


def _literal(code: int) -> str:
    c = chr(code)
    return c if c.isascii() and c.isalnum() or code > 0xFFFF else f"\\u{code:04x}"


class _Reader:
    def __init__(self, text: str):
        self.text, self.at, self.groups = text, 0, 0

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self, n: int = 1) -> str:
        out = self.peek(n)
        if len(out) < n:
            raise InvalidArgument("a pattern ends too early")
        self.at += n
        return out

    def alternatives(self, flags: frozenset, depth: int) -> str:
        """Up to the closing parenthesis or the end."""
        if depth > 200:
            raise InvalidArgument("a pattern is nested too deeply")
        out, opened = [], 0
        while self.at < len(self.text) and self.peek() != ")":
            if self.peek() == "|":
                # Flags set in the middle hold for the alternatives that follow, too: each is wrapped by itself.
                self.at += 1
                out += [")" * opened, "|"]
                opened = 0
                if "i" in flags and depth >= 0:
                    out.append("(?iu:")
                    opened = 1
                continue
            if m := re.compile(r"\(\?([imsU]*)(?:-([imsU]*))?([:)])").match(self.text, self.at):
                self.at = m.end()
                made = frozenset((flags | set(m[1])) - set(m[2] or ""))
                if m[3] == ":":
                    inner = self.alternatives(made, depth + 1)
                    if self.peek() != ")":
                        raise InvalidArgument("a group isn't closed")
                    self.at += 1
                    out.append(self.repeated(f"(?{self.case(made)}:{inner})", flags))
                else:
                    if ("i" in made) != ("i" in flags):
                        out.append(f"(?{self.case(made)}:")
                        opened += 1
                    flags = made
                continue
            out.append(self.repeated(self.atom(flags, depth), flags))
        return "".join(out) + ")" * opened

    @staticmethod
    def case(flags: frozenset) -> str:
        return "iu" if "i" in flags else "-i"

    def repeated(self, atom: str, flags: frozenset) -> str:
        c, m = self.peek(), _REPEAT.match(self.text, self.at)
        if c and c in "*+?":
            self.at += 1
        elif m:
            low, high = int(m[1]), int(m[3]) if m[3] else None
            if low > _MOST_REPEATS or high is not None and not low <= high <= _MOST_REPEATS:
                raise InvalidArgument("a bad repeat count")
            c = m[0]
            self.at = m.end()
        else:
            return atom
        lazy = self.peek() == "?"
        self.at += lazy
        if (self.peek() and self.peek() in "*+?") or _REPEAT.match(self.text, self.at):
            raise InvalidArgument("a repeat of a repeat")
        return f"(?:{atom}){c}" + "?" * (lazy != ("U" in flags))

    def atom(self, flags: frozenset, depth: int) -> str:
        c = self.take()
        if c == "(":
            if self.peek() == "?":
                m = re.compile(r"\?P?<(\w+)>").match(self.text, self.at)
                if not m:
                    raise InvalidArgument("back-references and lookaround aren't offered")
                self.at = m.end()
            self.groups += 1
            inner = self.alternatives(flags, depth + 1)
            if self.peek() != ")":
                raise InvalidArgument("a group isn't closed")
            self.at += 1
            return f"({inner})"
        if c == "[":
            return self.characters()
        if c == ".":
            return _ANY if "s" in flags else "[^\\u000a]"
        if c == "^":
            return "(?:\\A|(?<=\\u000a))" if "m" in flags else "\\A"
        if c == "$":
            return "(?=\\u000a|\\z)" if "m" in flags else "\\z"
        if c in "*+?":
            raise InvalidArgument("a repeat of nothing")
        if c == "\\":
            return self.escape()
        return _literal(ord(c))

    def escape(self) -> str:
        c = self.take()
        if c == "C":
            return _ANY
        if c == "Q":
            end = self.text.find("\\E", self.at)
            end = len(self.text) if end < 0 else end
            quoted = self.text[self.at : end]
            self.at = min(len(self.text), end + 2)
            # A repeat after the quoted text belongs to its last character.
            *first, last = [_literal(ord(x)) for x in quoted] or [""]
            return "".join(first) + (self.repeated(last, frozenset()) if last else "")
        if c in "AbBz":
            return {"A": "\\A", "z": "\\z", "b": _EDGE, "B": _INSIDE}[c]
        if (found := self.perl(c)) is not None:
            return f"[{found}]" if c.islower() else f"[^{found}]"
        if c in "pP":
            return self.unicode(c)
        return _literal(self.code(c))

    def perl(self, c: str) -> str | None:
        return _PERL.get(c.lower())

    def unicode(self, c: str) -> str:
        name = self.take()
        if name == "{":
            end = self.text.find("}", self.at)
            if end < 0:
                raise InvalidArgument("a class name isn't closed")
            name = self.text[self.at : end]
            self.at = end + 1
        negative = (c == "P") != name.startswith("^")
        name = name.lstrip("^")
        if not re.fullmatch(r"[A-Z][A-Za-z_]*", name):
            raise InvalidArgument(f"no class {name}")
        return f"\\{'P' if negative else 'p'}{{{name if len(name) <= 2 else 'Is' + name}}}" if name != "Any" else ("[^\\u0000-\U0010ffff]" if negative else _ANY)

    def code(self, c: str) -> int:
        """The character that the escape of ``c`` stands for."""
        if c in _LETTERS:
            return _LETTERS[c]
        if c == "x":
            m = re.compile(r"\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2})").match(self.text, self.at)
            if not m or int(m[1] or m[2], 16) > 0x10FFFF:
                raise InvalidArgument("a bad escape of a number")
            self.at = m.end()
            return int(m[1] or m[2], 16)
        if c in "01234567":
            m = re.compile("[0-7]{0,2}").match(self.text, self.at)
            if c != "0" and not m[0]:
                raise InvalidArgument("back-references and lookaround aren't offered")
            self.at = m.end()
            return int(c + m[0], 8)
        if c.isascii() and not c.isalnum():
            return ord(c)
        raise InvalidArgument(f"no escape \\{c}")

    def characters(self) -> str:
        negative = self.peek() == "^"
        self.at += negative
        items, others, first = [], [], True
        while first or self.peek() != "]":
            first = False
            if m := re.compile(r"\[:(\^?)(\w+):\]").match(self.text, self.at):
                if m[2] not in _POSIX:
                    raise InvalidArgument(f"no class {m[2]}")
                self.at = m.end()
                (others if m[1] else items).append(f"[^{_POSIX[m[2]]}]" if m[1] else _POSIX[m[2]])
                continue
            c = self.take()
            if c == "\\":
                c = self.take()
                if (found := self.perl(c)) is not None:
                    (items if c.islower() else others).append(found if c.islower() else f"[^{found}]")
                    continue
                if c in "pP":
                    others.append(self.unicode(c))
                    continue
                low = self.code(c)
            else:
                low = ord(c)
            high = low
            if self.peek() == "-" and self.peek(2)[1:] not in ("]", ""):
                self.at += 1
                c = self.take()
                high = self.code(self.take()) if c == "\\" else ord(c)
                if high < low:
                    raise InvalidArgument("a range of characters is upside down")
            items.append(_literal(low) if low == high else f"{_literal(low)}-{_literal(high)}")
        self.at += 1
        parts = ([f"[{''.join(items)}]"] if items else []) + others
        if not negative:
            return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
        return f"[^{''.join(items)}]" if not others else f"(?:(?!{'|'.join(parts)}){_ANY})"


@lru_cache(maxsize=1000)
def translate(pattern: str) -> tuple[str, int]:
    """The pattern for Java, and how many groups it captures."""
    reader = _Reader(pattern)
    out = reader.alternatives(frozenset(), 0)
    if reader.at < len(pattern):
        raise InvalidArgument("a parenthesis closes nothing")
    return out, reader.groups


def python(java: str) -> str:
    """The same for Python's matchers, which call the end of a text differently."""
    return java.replace("\\z", "\\Z")
