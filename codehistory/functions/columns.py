"""Expressions on paths, dates, authors and counts. All run inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a path is for; the first kind that matches wins.
WORK_KINDS = (
    ("build/CI", r"(^|/)(build\.gradle|settings\.gradle|extensions\.gradle|pom\.xml|Makefile|Dockerfile|docker-compose|Jenkinsfile|bitbucket-pipelines|\.gitlab-ci|package\.json|tsconfig|webpack|babel|vite\.config|jest\.config|\.eslintrc|eslint\.config)|(^|/)(ci-cd|\.github|\.circleci|scripts|gradle)/"),
    ("deploy/config", r"(^|/)(charts?|helm|k8s|kubernetes|terraform|deploy|conf|config|configs|local-conf)/|\.(properties|env)$|(^|/)(mounts\.template|entrypoint\.sh|nginx)|application.*\.(ya?ml|properties)$"),
    ("tests", r"(^|/)(tests?|spec|__tests__|__mocks__|e2e)/|\.(test|spec)\.[jt]sx?$|Test\.java$|_test\.py$|\.stories\.[jt]sx?$"),
    ("docs", r"\.(md|rst|adoc)$|(^|/)docs?/"),
)
PRODUCT = "product code"
KINDS = {"build/CI": "days_build", "deploy/config": "days_config", "tests": "days_tests", "docs": "days_docs", PRODUCT: "days_product"}

# How a heading names a region.
UNNAMED = "(unnamed region)"
DECLARED = r"(?U)\b(?:function|class|interface|type|enum|struct|trait|def|const|let|var)\s+([A-Za-z_$][\w$]*)"
CALLED = r"(?U)([A-Za-z_$][\w$]*)\s*\("
WORD = r"(?U)[A-Za-z_$][\w$]*"
TICKET = r"(?U)\b([A-Z][A-Z0-9]{1,9})-\d+\b"


def glob_regex(patterns: tuple[str, ...]) -> str:
    """One anchored regex for some globs: * and ? cross slashes, [..] and [!..] are classes."""

    def one(glob: str) -> str:
        out, i = "", 0
        while i < len(glob):
            c = glob[i]
            end = glob.find("]", i + 2) if c == "[" else -1
            if c == "*":
                out += ".*"
            elif c == "?":
                out += "."
            elif end > 0:
                body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
                out += f"[{'^' + body[1:] if body[0] == '!' else body}]"
                i = end
            else:
                out += re.escape(c)
            i += 1
        return out

    return "(?s)^(?:" + "|".join(map(one, patterns)) + ")$"


def like_globs(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a text is like some glob. Those with stars at their ends alone need no regex, which costs a row more than all else that is asked of it."""
    plain = [p for p in patterns if not set("*?[") & set(p.removeprefix("*").removesuffix("*"))]

    def one(p: str) -> Column:
        word = p.removeprefix("*").removesuffix("*")
        if p.startswith("*"):
            return text.contains(word) if p[1:].endswith("*") else text.endswith(word)
        return text.startswith(word) if p.endswith("*") else text == word

    rest = tuple(p for p in patterns if p not in plain)
    return reduce(lambda a, b: a | b, [*map(one, plain), *([text.rlike(glob_regex(rest))] if rest else [])])


def is_bot(author: Column, patterns: tuple[str, ...]) -> Column:
    """Whether an author (null as empty) is automation; case does not matter."""
    return like_globs(F.lower(F.coalesce(author, F.lit(""))), tuple(p.lower() for p in patterns)) if patterns else F.lit(False)


def excluded(path: Column, patterns: tuple[str, ...]) -> Column:
    return like_globs(path, patterns) if patterns else F.lit(False)


def resolve_rename(path: Column) -> Column:
    """The path after a rename in braces or in full; an empty new part leaves a doubled slash."""
    braced = F.regexp_replace(path, r"^([^{]*)\{[^}]*? => ([^}]*?)(?: => [^}]*)?\}(.*)$", "$1$2$3")
    return F.when(~path.contains(" => "), path).when(path.contains("{"), braced).otherwise(F.split(path, " => ")[1])


def module(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def repo_name(path: Column) -> Column:
    return F.substring_index(path, "/", -2)


def work_kind(path: Column) -> Column:
    kinds = reduce(lambda w, k: w.when(path.rlike(f"(?i){k[1]}"), k[0]), WORK_KINDS[1:], F.when(path.rlike(f"(?i){WORK_KINDS[0][1]}"), WORK_KINDS[0][0]))
    return kinds.otherwise(PRODUCT)


def day(date: Column) -> Column:
    return F.substring(date, 1, 10)


def month(date: Column) -> Column:
    return F.substring(date, 1, 7)


def rint(x: Column, digits: int = 2) -> Column:
    """Half-even rounding of x * 10^digits."""
    return F.rint(x * 10**digits) / 10**digits


def ratio(a: Column, b: Column, digits: int = 2) -> Column:
    """a / b, rounded; null where b is 0 or null."""
    return rint(a / F.when(b != 0, b), digits)


def rework(added: Column, deleted: Column) -> Column:
    """Lines written over: per row, then summed."""
    return 2 * F.least(added, deleted)


def debt(rework_: Column, lines: Column, commits: Column) -> Column:
    return rint(rework_ / F.when(lines != 0, lines) * F.log2(1 + commits))


def days_between(born: Column, last: Column) -> Column:
    return F.floor((F.unix_timestamp(F.to_timestamp(last)) - F.unix_timestamp(F.to_timestamp(born))) / 86400)


def region_symbol(heading: Column) -> Column:
    found = lambda p: F.nullif(F.regexp_extract(heading, p, 1), F.lit(""))
    words = F.try_element_at(F.regexp_extract_all(heading, F.lit(WORD), F.lit(0)), F.lit(-1))
    return F.when(F.coalesce(heading, F.lit("")) == "", UNNAMED).otherwise(F.coalesce(found(DECLARED), found(CALLED), words, F.substring(F.trim(heading), 1, 60)))


def tickets(subject: Column) -> Column:
    """Tracker projects in a subject, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(subject, F.lit("")), F.lit(TICKET), F.lit(1)))
