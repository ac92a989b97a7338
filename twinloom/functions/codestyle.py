"""Ten style measurements of a code snippet.

The regular expressions below are fixed values: they define what is measured.
They run in Python's engine inside Arrow batches, once per distinct snippet;
their repeated groups overflow the stack of the JVM's engine on long lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np

# Names of the measurements.
NAMES = (
    "function_naming_consistency",
    "variable_naming_consistency",
    "class_naming_consistency",
    "constant_naming_consistency",
    "indentation_consistency",
    "avg_function_length",
    "avg_nesting_depth",
    "comment_ratio",
    "avg_function_name_length",
    "avg_variable_name_length",
)

# Naming styles in order of precedence, and declarations by language.
STYLES = (
    ("camelCase", r"^[a-z]+(?:[A-Z][a-z]*)*$"),
    ("snake_case", r"^[a-z]+(?:_[a-z]+)+$"),
    ("PascalCase", r"^[A-Z][a-z]+(?:[A-Z][a-z]*)*$"),
    ("UPPER_SNAKE_CASE", r"^[A-Z]+(?:_[A-Z]+)+$"),
)
_ACCESS = r"^\s*(?:public|private|protected)?\s*"
_TYPES = r"(?:[\w<>\[\]\*&]+\s+)+"
DECLARATIONS = {
    "function": {"py": r"^\s*def\s+(\w+)\s*\(", "c": _ACCESS + r"(?:static\s+)?" + _TYPES + r"(\w+)\s*\("},
    "variable": {"py": r"^\s*(\w+)\s*=\s*[^=]", "c": r"^\s*" + _TYPES + r"(\w+)\s*(?:=|;|\[|\()"},
    "class": {"py": r"^\s*class\s+(\w+)\s*(?:\(|:)?", "c": _ACCESS + r"(?:class|struct|interface)\s+(\w+)"},
    "constant": {
        "py": r"^\s*([A-Z][A-Z_0-9]*)\s*=\s*",
        "c": r"^\s*#define\s+([A-Z][A-Z_0-9]*)\b",
        "java": _ACCESS + r"static\s+final\s+[\w<>\[\]]+\s+([A-Z][A-Z_0-9]*)\s*=",
    },
}
_BODY_START = {
    "py": r"^\s*def\s+\w+\s*\(.*\):",
    "c": r"^\s*" + _TYPES + r"\w+\s*\(.*\)\s*\{",
    "java": _ACCESS + r"(?:static\s+)?(?:[\w<>\[\]\.&]+\s+)+\w+\s*\(.*\)\s*\{",
}
LANGUAGES = ("c", "cpp", "java", "py")

_style = [(n, re.compile(p)) for n, p in STYLES]
_declared = {k: {lang: re.compile(p, re.MULTILINE) for lang, p in v.items()} for k, v in DECLARATIONS.items()}
_body = {lang: re.compile(p) for lang, p in _BODY_START.items()}


def naming_style(name: str) -> str:
    return next((n for n, p in _style if p.match(name)), "Other")


def _for_language(options: dict, language: str):
    """A language's own entry, else for C++ and Java that of C."""
    return options.get(language, options.get("c")) if language in LANGUAGES else None


def declared_names(code: str, language: str, kind: str) -> list[str]:
    pattern = _for_language(_declared[kind], language)
    return pattern.findall(code) if pattern else []


def _consistency(names: list[str]) -> float:
    return max(Counter(map(naming_style, names)).values()) / len(names) if names else 0.0


def _mean(values: list[float]) -> float:
    return sum(values) / len(values) if values else 0.0


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def indentation_consistency(lines: list[str]) -> float:
    """Share of the commonest indent width (a tab is four columns); 1 where nothing is indented."""
    widths = Counter()
    for line in lines:
        body = line.lstrip()
        if body and line != body and not body.startswith(("#", "//", "/*", "*")):
            widths[len(line[: len(line) - len(body)].replace("\t", " " * 4))] += 1
    return max(widths.values()) / widths.total() if widths else 1.0


def _python_body(lines: list[str], start: int) -> int:
    at = _indent(lines[start])
    stop = next((i for i in range(start + 1, len(lines)) if lines[i].strip() and _indent(lines[i]) <= at), len(lines))
    return stop - start


def function_lengths(lines: list[str], language: str) -> list[int]:
    """Lines of each function from its head up to the dedent or the closing line, which doesn't count."""
    pattern = _for_language(_body, language)
    starts = [i for i, line in enumerate(lines) if pattern and pattern.match(line)]
    if language == "py":
        return [_python_body(lines, i) for i in starts]
    # running balance of braces: a body ends on the first later line where it is back at its start or below
    balance = np.concatenate(([0], np.cumsum([line.count("{") - line.count("}") for line in lines], dtype=np.int64)))
    out = []
    for i in starts:
        closed = np.flatnonzero(balance[i + 2 :] <= balance[i])
        out.append(int(closed[0]) + 1 if len(closed) else len(lines) - i)
    return out


def _python_depths(lines: list[str]) -> list[int]:
    levels, depths = [], []
    for line in lines:
        body = line.strip()
        if body and not body.startswith("#"):
            at = _indent(line)
            levels = [x for x in levels if x <= at]
            if at > (levels[-1] if levels else 0):
                levels.append(at)
            depths.append(len(levels))
    return depths


def nesting_depths(lines: list[str], language: str) -> list[int]:
    if language == "py":
        return _python_depths(lines)
    kept = [line for line in lines if line.strip() and not line.strip().startswith(("//", "/*", "*"))]
    return np.maximum(np.cumsum([line.count("{") - line.count("}") for line in kept], dtype=np.int64), 0).tolist()


def _python_comments(lines: list[str]) -> list[bool]:
    inside, out = False, []
    for body in lines:
        if body.startswith("#"):
            out.append(True)
        elif body.startswith(("'''", '"""')):
            inside ^= body.count("'''") % 2 == 1 or body.count('"""') % 2 == 1
            out.append(True)
        else:
            out.append(inside)
    return out


def _block_comments(lines: list[str]) -> list[bool]:
    inside, out = False, []
    for body in lines:
        out.append(inside or body.startswith(("/*", "//")))
        if inside or body.startswith("/*"):
            inside = "*/" not in body
    return out


def comment_ratio(lines: list[str], language: str) -> float:
    bodies = [s for line in lines if (s := line.strip())]
    return _mean([float(x) for x in (_python_comments if language == "py" else _block_comments)(bodies)])


def style_vector(code: str | None, language: str | None) -> list[float] | None:
    """The ten measurements in the order of NAMES; null for null code; an unknown language has no names or functions."""
    if code is None:
        return None
    language = language or ""
    lines = code.splitlines()
    names = {k: declared_names(code, language, k) for k in DECLARATIONS}
    length: Callable[[str], float] = lambda k: _mean([len(n) for n in names[k]])
    return [
        *(_consistency(names[k]) for k in ("function", "variable", "class", "constant")),
        indentation_consistency(lines),
        _mean(function_lengths(lines, language)),
        _mean(nesting_depths(lines, language)),
        comment_ratio(lines, language),
        length("function"),
        length("variable"),
    ]
