"""Source text to code of the same length: what stands in comments and strings becomes spaces, line ends stay.

Rules are by language: `#` starts a comment in Python and GraphQL only, `//` in brace languages only; plain quotes end with
their line, so a stray one hides no more than that; `${…}` in a template is code.
"""

from __future__ import annotations

import re

HASH = re.compile(r"#[^\n]*|(?:'''(?:\\.|[^\\])*?(?:'''|\Z))|(?:\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z))|'(?:\\.|[^'\\\n])*(?:'|$)|\"(?:\\.|[^\"\\\n])*(?:\"|$)", re.S | re.M)
BRACE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?(?:\"\"\"|\Z)|'(?:\\.|[^'\\\n])*(?:'|$)|\"(?:\\.|[^\"\\\n])*(?:\"|$)|[`{}/]", re.S | re.M)
TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*(?:`|\$\{|\Z)", re.S)
PATTERN = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
BEFORE_PATTERN = re.compile(r"(?:^|[(,=:\[!&|?{};<>+~]|\b(?:return|typeof|case|in|of))\s*\Z")


def spaces(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def code(text: str, language: str) -> str:
    if language in ("python", "graphql"):
        return HASH.sub(lambda m: spaces(m[0]), text)
    return _brace(text, language)


def _brace(text: str, language: str) -> str:
    script = language in ("javascript", "typescript")
    out, at, depths = [], 0, []  # open braces within each template expression that is being read
    while m := BRACE.search(text, at):
        out.append(text[at : m.start()])
        at, mark = m.end(), m[0]
        template = mark == "`" and script
        if mark == "{" and depths:
            depths[-1] += 1
        elif mark == "}" and depths:
            depths[-1] -= 1
            if depths[-1] < 0:
                depths.pop()
                template = True
        if template:
            part = TEMPLATE.match(text, at)
            out.append(spaces(mark + part[0]))
            at = part.end()
            if part[0].endswith("${"):
                depths.append(0)
        elif mark == "/":
            found = PATTERN.match(text, m.start()) if script and BEFORE_PATTERN.search(text[max(0, m.start() - 40) : m.start()].rsplit("\n", 1)[-1]) else None
            out.append(spaces(found[0]) if found else mark)
            at = found.end() if found else at
        else:
            out.append(mark if mark in "{}`" else spaces(mark))
    out.append(text[at:])
    return "".join(out)
