"""Translate user regexes to Java's dialect, keeping Unicode classes, end anchors and case folding."""
from __future__ import annotations


class RegexError(ValueError):
    """The pattern is invalid or uses look-around or back-references."""


def to_java(pattern: str, multiline: bool = False) -> str:
    """Case-insensitive, Unicode, `$` only at the very end (unless multiline)."""
    out, i, in_class, depth = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                raise RegexError("trailing backslash")
            n = pattern[i + 1]
            if not in_class and n in "123456789":
                raise RegexError("back-references are not supported")
            out.append("\\z" if n == "z" else c + n)
            i += 2
            continue
        if c == "[":
            in_class += 1
        elif c == "]" and in_class:
            in_class -= 1
        elif not in_class:
            if c == "(":
                depth += 1
                if pattern.startswith(("(?=", "(?!", "(?<=", "(?<!"), i):
                    raise RegexError("look-around is not supported")
                if pattern.startswith("(?P<", i):
                    out.append("(?<")
                    i += 4
                    continue
            elif c == ")":
                depth -= 1
                if depth < 0:
                    raise RegexError("unopened group")
            elif c == "$" and not multiline:
                c = "\\z"
        out.append(c)
        i += 1
    if depth or in_class:
        raise RegexError("unclosed group or class")
    return ("(?idUum)" if multiline else "(?idUu)") + "".join(out)


def words_of(pattern: str) -> list[str]:
    """Candidate words cut from the pattern text: runs of word characters longer than one byte."""
    cut = "".join(c if c.isalnum() or c == "_" else " " for c in pattern)
    return list(dict.fromkeys(w.lower() for w in cut.split() if len(w.encode()) > 1))
