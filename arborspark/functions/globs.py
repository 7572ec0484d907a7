"""Ignore patterns compiled to regular expressions that Java, Python and RE2 read alike.

The dialect follows .gitignore with these peculiarities: a pattern with an inner slash isn't anchored, ``[!a]`` is a
plain class of ``!`` and ``a``, and backslashes count as slashes but for ``\\#`` and ``\\!`` at the beginning of a line.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class IgnoreRule:
    regex: str  # without its end anchor
    negated: bool
    dir_only: bool
    by_name: bool
    static_prefix: str

    def pattern(self, end: str = r"\z") -> str:
        """The whole pattern; RE2 and Python want another end anchor than Java."""
        return self.regex + end


class BadPattern(ValueError):
    """A pattern that isn't a valid regular expression; it disables all rules of its file."""


def glob_regex(glob: str) -> str:
    """The body of a glob: ``**/``, ``**``, ``*``, ``?`` and character classes."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            if glob.startswith("**/", i):
                out.append("(?:.*/)?")
                i += 3
                continue
            double = glob.startswith("**", i)
            out.append(".*" if double else "[^/]*")
            i += 2 if double else 1
            continue
        if c == "[":
            end = glob.find("]", i + 1)
            if end <= i + 1 or glob[i + 1 : end] == "^":
                raise BadPattern(glob)
            inner = glob[i + 1 : end]
            out.append("[" + inner.replace("[", "\\[").replace("&", "\\&") + "]")
            i = end + 1
            continue
        out.append("[^/]" if c == "?" else re.sub(r"([.()+|^${}\]\\])", r"\\\1", c))
        i += 1
    return "".join(out)


def parse_rule(raw: str) -> IgnoreRule | None:
    """One line of an ignore file; None for a blank line, a comment or nothing but marks."""
    line = raw.strip()
    if not line or line[0] == "#":
        return None
    literal = line[:2] in ("\\#", "\\!")
    line = line[1:] if literal else line
    negated = not literal and line[0] == "!"
    line = (line[1:] if negated else line).replace("\\", "/").strip()
    dir_only = line.endswith("/")
    line = line.rstrip("/") if dir_only else line
    anchored = line.startswith("/")
    line = line[1:] if anchored else line
    if not line:
        return None
    by_name = not anchored and not dir_only and "/" not in line
    body = glob_regex(line)
    regex = f"^{body}" if by_name else ("^" if anchored else "^(?:.*/)?") + body + ("/.*" if dir_only else "")
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            re.compile(regex)
    except re.error as e:
        raise BadPattern(raw) from e
    prefix = re.split(r"[*?\[]", line, maxsplit=1)[0].strip("/")
    return IgnoreRule(regex, negated, dir_only, by_name, prefix)


def compile_rules(lines: Iterable[str]) -> list[IgnoreRule]:
    """All rules of one ignore file, in order; none at all if one pattern is invalid."""
    try:
        return [r for r in map(parse_rule, lines) if r is not None]
    except BadPattern:
        return []
