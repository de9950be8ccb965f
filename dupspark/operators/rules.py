"""Ignore rules: globs become regular expressions at plan time, paths are judged by columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

#: The patterns that hold below every root.
DEFAULTS = (".git/", ".hg/", ".svn/", "build/", "dist/", "out/", "target/", "bin/", "*.o", "*.class", "*.pyc", "*.pyo", "node_modules/", "vendor/", ".venv/", ".DS_Store", "Thumbs.db", "*.swp", "*~", ".idea/", ".vscode/")
NONE, IGNORED, WHITELISTED = "NONE", "IGNORED", "WHITELISTED"


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """A regular expression whose dot takes any character and whose final $ is the end of the text, not the line before it."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"bad pattern {pattern!r}: {e}") from e
    slashes = len(pattern) - 1 - len(pattern[:-1].rstrip("\\")) if pattern.endswith("$") else 1
    if slashes % 2 == 0:
        pattern = pattern[:-1] + r"\z"
    return f"(?s{'i' if ignore_case else ''}){pattern}"


@dataclass(frozen=True)
class Rule:
    regex: str
    negated: bool
    only_directories: bool
    source: str


def glob_regex(glob: str, directory: bool) -> str:
    """The body of a glob: ** crosses directories, * and ? stay inside one, [..] and escapes are kept."""
    token = re.compile(r"(\\.)|(\*\*/?)|(\*)|(\?)|\[([!^]?)((?:\\.|[^\]\\])*)(\]?)|(.)", re.DOTALL)
    body = glob[:-1] if directory and glob.endswith("/") else glob
    out = []
    for escaped, stars, star, one, negation, inside, closed, plain in (m.groups(default="") for m in token.finditer(body)):
        if escaped:
            out.append(re.escape(escaped[1]))
        elif stars:
            out.append("(?:.*/)?" if stars.endswith("/") else ".*")
        elif star:
            out.append("[^/]*")
        elif one:
            out.append("[^/]")
        elif plain:
            out.append(re.escape(plain))
        elif closed and inside:
            out.append(f"[{'^' if negation else ''}{inside.replace('[', chr(92) + '[').replace('&&', '&' + chr(92) + '&')}]")
        else:
            out.append(re.escape("[" + negation + inside + closed))
    return "".join(out)


def parse_rule(line: str) -> Rule | None:
    """A line of an ignore file; None for a comment or an empty line. ! negates, a leading / anchors, a trailing / means directories."""
    text = line.rstrip("\r\n").lstrip(" \t\v\f")
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[1:].lstrip() if negated else text
    anchored = text.startswith("/")
    text = text[1:] if anchored else text
    directory = text.rstrip().endswith("/")
    text = text.rstrip() if directory else text
    if not text:
        return None
    start, end = ("^" if anchored else "(^|/)"), (r"(/|\z)" if directory else r"\z")
    return Rule(f"(?s){start}{glob_regex(text, directory)}{end}", negated, directory, line.rstrip("\r\n"))


def parse_rules(lines) -> list[Rule]:
    return [r for r in map(parse_rule, lines) if r]


@dataclass(frozen=True)
class Context:
    """A directory and the rules that its ignore file states; contexts are given from the root down."""

    base: str
    rules: tuple[Rule, ...]


def relative(path: Column, base: str) -> Column:
    """The path below base without leading slashes; null where it isn't below base."""
    top = base.rstrip("/")
    below = F.regexp_replace(F.substring(path, len(top) + 1, 1 << 30), "^/+", "")
    return F.when(F.lit(top == "") | (path == F.lit(top)) | F.startswith(path, F.lit(top + "/")), below)


def verdict(path: Column, is_dir: Column, contexts: list[Context], strict: bool = False) -> Column:
    """NONE, IGNORED or WHITELISTED for one path: the last matching rule of the deepest context wins.

    strict: parents are asked after their children and overrule them.
    """
    order = list(reversed(contexts)) if strict else list(contexts)
    said = F.lit(NONE)
    for context in order:
        below = relative(path, context.base)
        for rule in context.rules:
            hit = F.coalesce(below.rlike(rule.regex), F.lit(False))
            if rule.only_directories:
                hit = hit & is_dir
            said = F.when(hit, F.lit(WHITELISTED if rule.negated else IGNORED)).otherwise(said)
    return said


def ancestors(path: Column) -> Column:
    """All proper directory prefixes of a relative path, the longest last: a/b/c has a and a/b."""
    parts = F.split(path, "/")
    return F.transform(F.slice(F.sequence(F.lit(0), F.size(parts)), 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def survives(path: Column, contexts: list[Context], strict: bool = False) -> Column:
    """Whether neither a file nor any directory above it is ignored; path is relative to the scan's root."""
    gone = F.exists(ancestors(path), lambda d: verdict(d, F.lit(True), contexts, strict) == IGNORED)
    return ~gone & (verdict(path, F.lit(False), contexts, strict) != IGNORED)
