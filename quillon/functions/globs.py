"""Path patterns: globs to anchored regular expressions, scope lists, and the filters made of them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders and files that hold other people's code.
LIBRARY = r"(^|/)(node_modules|\.venv|venv|site-packages|dist|build|target|vendor|\.git)(/|$)|(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|Cargo\.lock|poetry\.lock)$"
#: File extensions by language.
EXTENSIONS = {
    "python": ("py", "pyi"),
    "typescript": ("ts", "tsx", "mts", "cts"),
    "javascript": ("js", "jsx", "mjs", "cjs"),
    "java": ("java",),
    "kotlin": ("kt", "kts"),
    "graphql": ("graphql", "gql"),
    "rust": ("rs",),
    "go": ("go",),
    "markdown": ("md",),
    "text": ("txt",),
}


def glob_regex(glob: str) -> str:
    """`**/` stands for any number of folders, `**` for the rest, `*` and `?` stay within a folder, `[!..]` negates."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            negated = body[0] == "!"
            out.append(("[^/" if negated else "[") + body[negated:].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&") + "]")
            i = end + 1
        else:
            out.append(re.escape(glob[i]))
            i += 1
    return "^" + "".join(out) + "$"


@dataclass
class Scope:
    """Globs to keep and globs to leave out."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    path_regex: str | None = None

    @classmethod
    def parse(cls, patterns: str | list[str], path_regex: str | None = None) -> Scope:
        """`!x` or `-x` excludes and `+x` includes; a bare name means that file or folder at any depth, `x/` its subtree."""
        scope = cls(path_regex=path_regex)
        parts = re.split(r"[,\n]", patterns) if isinstance(patterns, str) else patterns
        for p in (x.strip().replace("\\", "/").removeprefix("./") for x in parts):
            if p:
                (scope.exclude if p[0] in "!-" else scope.include).extend(expand(p.lstrip("!-+")))
        return scope

    @classmethod
    def of_languages(cls, languages: list[str]) -> Scope:
        return cls([f"**/*.{e}" for lang in languages for e in EXTENSIONS[lang]])

    def filter(self, path: Column) -> Column:
        """(no includes, or one matches) and no exclude matches, and the path regex is found. A bad regex is an error."""
        some = lambda globs: reduce(lambda a, b: a | b, [path.rlike(glob_regex(g)) for g in globs])
        ok = some(self.include) if self.include else F.lit(True)
        if self.exclude:
            ok = ok & ~some(self.exclude)
        if self.path_regex:
            re.compile(self.path_regex)
            ok = ok & path.rlike(self.path_regex)
        return ok


def expand(pattern: str) -> list[str]:
    if pattern.endswith("/"):
        return [f"{pattern}**", f"**/{pattern}**"]
    if not re.search(r"[*?\[]", pattern):
        return [pattern, f"{pattern}/**"] if "/" in pattern else [f"**/{pattern}", f"**/{pattern}/**"]
    return [pattern] if "/" in pattern else [f"**/{pattern}"]


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def is_library(path: Column) -> Column:
    return path.rlike(LIBRARY)


def language(path: Column) -> Column:
    ext, out = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)), None
    for lang, names in EXTENSIONS.items():
        out = (F if out is None else out).when(ext.isin(*names), lang)
    return out.otherwise("other")
