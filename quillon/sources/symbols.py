"""Symbols, imports, bindings and name tokens of source files: stateful scanners, one file at a time, and their tables.

A file is read once, by `scan_file`, into one nested row; `extracts` runs it over a corpus. Files are at most as long as the
corpus allows, so a task holds one of them. Known differences from a plain line scan: a constructor is a member named as
its container, `constructor`, `init` or `__init__`; imports in parentheses count; positions are those of the names.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import globs, lexer

NAME = r"[A-Za-z_$][\w$]*"
#: Most lines of a declaration before its body.
HEADER_LINES = 80
SCRIPT = ("javascript", "typescript")
BRACES = (*SCRIPT, "java", "kotlin")
LANGUAGES = ("python", *BRACES, "graphql")
TYPE_KINDS = {"class": "class", "interface": "interface", "enum": "enum", "record": "struct", "struct": "struct", "type": "type", "namespace": "type", "module": "type", "object": "class"}

#: Words that are no names, frameworks' annotations and bases, and endings of modules.
KEYWORDS = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield self cls super".split(),
    "script": "abstract as async await break case catch class const constructor continue debugger declare default delete do else enum export extends false finally for from function get if implements import in instanceof interface keyof let namespace new null of private protected public readonly return satisfies set static super switch this throw true try type typeof undefined var void while yield any boolean never number string unknown".split(),
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends false final finally float for if implements import instanceof int interface long native new null package private protected public record return short static strictfp super switch synchronized this throw throws transient true try var void volatile while".split(),
    "kotlin": "abstract as break by catch class companion const constructor continue data do else enum false finally for fun if import in init inline interface internal is lateinit null object open operator override package private protected public return sealed super suspend this throw true try typealias val var vararg when where while".split(),
}
SPRING = {
    "SpringRoute": "RequestMapping ExceptionHandler".split(),
    "SpringBean": "Bean Service Repository Controller RestController Configuration ConfigurationProperties".split(),
    "SpringEvent": ["EventListener"],
    "SpringScheduled": ["Scheduled"],
    "SpringAop": "Aspect Pointcut Before After Around AfterReturning AfterThrowing Transactional Async Cacheable CacheEvict CachePut PreAuthorize PostAuthorize".split(),
}
SPRING_ENDS = {"Mapping": "SpringRoute", "Component": "SpringBean", "EventListener": "SpringEvent"}
PYTHON_DECORATORS, PYTHON_DECORATOR_ENDS = ["receiver", "action"], ("login_required", "permission_required", "csrf_exempt", "cache_page")
PYTHON_BASES = "Model DjangoObjectType ObjectType APIView View ViewSet Serializer Form Admin".split()
MODULE_ENDS = "ts tsx js jsx mjs cjs".split()
WRAPPERS = "memo forwardRef lazy observer connect styled".split()

SYMBOL = "name string, qualified_name string, kind string, start_line int, start_column int, end_line int, end_column int, container_name string, container_ord int, extends_names array<string>, implements_names array<string>, markers array<string>, signature string, symbol_ord long"
IMPORT = "local_name string, imported_name string, kind string, specifier string, candidates array<string>, line int"
TOKEN = "name string, line int, column int, receiver string, is_call boolean, is_new boolean, in_type boolean, enclosing_ord int, container_ord int"
BINDING = "variable string, type_name string, line int, scope_ord int"
SELECTION = "name string, line int, column int, node int, parent int, root string, enclosing_ord int"
PARTS = {"symbols": SYMBOL, "imports": IMPORT, "tokens": TOKEN, "bindings": BINDING, "selections": SELECTION}
SCHEMA = "rel_path string, language string, " + ", ".join(f"{k} array<struct<{v}>>" for k, v in PARTS.items())


@dataclass
class Symbol:
    name: str
    qualified: str
    kind: str
    start: int
    end: int
    container: Symbol | None = None
    extends: list[str] = field(default_factory=list)
    implements: list[str] = field(default_factory=list)
    markers: list[str] = field(default_factory=list)
    signature: str = ""


class Source:
    """A text, its code, its lines, and the partners of its brackets."""

    def __init__(self, text: str, language: str):
        self.text, self.language, self.code = text, language, lexer.code(text, language)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def place(self, at: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.starts, at) - 1
        return line, at - self.starts[line]

    def line_end(self, at: int) -> int:
        end = self.code.find("\n", at)
        return len(self.code) if end < 0 else end

    def lines(self) -> Iterator[tuple[int, str, int, int]]:
        """(start, code, braces open, other brackets open) of each line, as they stand at its start."""
        braces = others = 0
        for at in self.starts:
            line = self.code[at : self.line_end(at)]
            yield at, line, braces, others
            braces = max(0, braces + line.count("{") - line.count("}"))
            others = max(0, others + sum(line.count(c) for c in "([") - sum(line.count(c) for c in ")]"))

    def closing(self, at: int) -> int:
        """Where the bracket that opens at `at` closes, or the end."""
        depth, pair = 0, {"{": "}", "(": ")", "[": "]"}[self.code[at]]
        for m in re.compile(re.escape(self.code[at]) + "|" + re.escape(pair)).finditer(self.code, at):
            depth += 1 if m[0] != pair else -1
            if depth == 0:
                return m.start()
        return max(len(self.code) - 1, 0)

    def body(self, at: int) -> tuple[int, int | None]:
        """(end of the declaration's head, where its body's brace is or None) of a declaration that starts at `at`."""
        depth, lines, last = 0, 0, ""
        for m in re.compile(r"[(){}\[\];\n]|=>|[^\s(){}\[\];=]+|=").finditer(self.code, at):
            c = m[0]
            if c in ("(", "["):
                depth += 1
            elif c in (")", "]"):
                depth -= 1
                if depth < 0:
                    return m.start(), None
            elif depth == 0 and c == "{":
                return m.start(), m.start()
            elif depth == 0 and c in (";", "}"):
                return m.start(), None
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
            elif c == "\n":
                lines += 1
                follows = self.code[m.end() : m.end() + 400].lstrip()
                goes_on = re.match(r"[{:.?|&)=]|(extends|implements|throws|where|permits)\b", follows) or re.search(r"(=>|[=,<|&:(+\-]|\b(?:extends|implements|throws))$", last)
                if lines > HEADER_LINES or (depth == 0 and last and not goes_on):
                    return m.start(), None
                continue
            last = c
        return len(self.code), None

    def signature(self, at: int, end: int) -> str:
        return re.sub(r"\s+", " ", self.text[self.starts[self.place(at)[0]] : end]).strip()[:400]


def split_top(text: str, marks: str = ",") -> list[str]:
    """Parts between marks that stand in no brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{<":
            depth += 1
        elif c in ")]}>" and text[i - 1 : i + 1] != "=>":
            depth -= 1
        elif depth == 0 and c in marks:
            out.append(text[last:i])
            last = i + 1
    return [x.strip() for x in [*out, text[last:]] if x.strip()]


def type_names(text: str, marks: str = ",&|") -> list[str]:
    """Plain dotted names of a list of types, without generics, calls and brackets."""
    found = (re.match(rf"(?:[\w$]+\s+)*?({NAME}(?:\.{NAME})*)\s*(?:[<(\[]|\?|by\b|$)", x) for x in split_top(text, marks))
    return list(dict.fromkeys(m[1] for m in found if m))


def markers_of(annotations: list[str], language: str, bases: list[str] = []) -> list[str]:
    out = set()
    for a in annotations:
        if language == "python":
            if a in PYTHON_DECORATORS or a.endswith(PYTHON_DECORATOR_ENDS):
                out.add("PythonFramework")
        elif language in ("java", "kotlin"):
            out.update([next((m for end, m in SPRING_ENDS.items() if a.endswith(end)), None) or next((m for m, names in SPRING.items() if a in names), None)])
    if language == "python" and any(b.rsplit(".", 1)[-1] in PYTHON_BASES for b in bases):
        out.add("PythonFramework")
    return sorted(out - {None})


def python_symbols(s: Source) -> list[Symbol]:
    out, scopes, notes, last = [], [], [], 0  # scopes: (indent, symbol)

    def close(indent: int) -> None:
        while scopes and scopes[-1][0] >= indent:
            scopes.pop()[1].end = last

    for at, line, braces, others in s.lines():
        if braces or others or not line.strip():
            last = at + len(line.rstrip()) if line.strip() else last
            continue
        indent = len(line) - len(line.lstrip(" \t"))
        close(indent)
        last = at + len(line.rstrip())
        owner = next((x for _, x in reversed(scopes) if x.kind == "class"), None)
        if m := re.match(r"\s*@\s*([\w.]+)", line):
            notes.append(m[1])
        elif m := re.match(r"\s*class\s+([A-Za-z_]\w*)\s*(\()?", line):
            end = s.closing(at + m.start(2)) if m[2] else at + m.end()
            bases = [b for b in split_top(s.code[at + m.end() : end]) if "=" not in b] if m[2] else []
            bases = type_names(",".join(bases), ",")
            found = Symbol(m[1], m[1], "class", at + m.start(1), last, owner, bases, [], markers_of(notes, "python", bases), s.signature(at, end + 1))
            out.append(found)
            scopes.append((indent, found))
            notes = []
        elif m := re.match(r"\s*(?:async\s+)?def\s+([A-Za-z_]\w*)", line):
            kind = ("constructor" if m[1] == "__init__" else "method") if owner else "function"
            opened = s.code.find("(", at + m.end())
            end = s.closing(opened) if opened >= 0 else at + len(line)
            found = Symbol(m[1], f"{owner.name}.{m[1]}" if owner else m[1], kind, at + m.start(1), last, owner, markers=markers_of(notes, "python"), signature=s.signature(at, end + 1))
            out.append(found)
            scopes.append((indent, found))
            notes = []
        else:
            notes = []
            m = re.match(rf"\s*((?:(self|cls)\.)?({NAME}))\s*(:[^=]+)?=(?!=)\s*(lambda\b)?", line)
            if not m:
                continue
            inner = scopes[-1][1] if scopes else None
            direct, upper = inner is not None and inner.kind == "class", m[3].isupper()
            if m[2] and owner or not m[2] and (m[5] or direct or inner is None or m[4] or upper):
                holder = owner if m[2] or direct else None
                out.append(Symbol(m[3], f"{holder.name}.{m[3]}" if holder else m[3], "function" if m[5] and not m[2] else "constant", at + m.start(3), at + len(line.rstrip()), holder, signature=s.signature(at, at + len(line))))
    close(-1)
    return out


MODIFIERS = r"(?:(?:export|default|declare|public|private|protected|internal|static|abstract|final|sealed|non-sealed|open|override|async|readonly|data|inner|suspend|inline|value|operator|infix|tailrec|external|synchronized|native|lateinit|companion|strictfp|transient|volatile|annotation|accessor)\s+)*"
TYPE = re.compile(rf"\s*{MODIFIERS}(?:const\s+(?=enum))?(@?interface|class|enum|record|struct|type|namespace|module|object)\s+(?:class\s+)?({NAME})\s*(?=[<({{:=]|$|\w)")
VARIABLE = re.compile(rf"\s*(export\s+)?(?:default\s+)?(?:declare\s+)?(?:const|let|var|val)\s+({NAME})\b")
MEMBER_VALUE = re.compile(rf"\s*{MODIFIERS}(?:val\s+|var\s+|const\s+val\s+)?(#?{NAME})[?!]?\s*(?::[^=;(]*(?:\([^)]*\)\s*=>[^=;]*)?)?=(?![=>])\s*(.*)")
JAVA_FIELD = re.compile(rf"\s*{MODIFIERS}[\w$<>\[\],.? ]+?\s({NAME})\s*(=[^(]*|(?:,\s*{NAME}\s*)*);\s*$")
JAVA_VALUE = re.compile(rf"\s*{MODIFIERS}[\w$<>\[\],.?]+(?:\s*<[^()=]*>)?\s+({NAME})\s*=(?!=)")
KOTLIN_FIELD = re.compile(rf"\s*{MODIFIERS}(?:const\s+)?(?:val|var)\s+(?:<[^>]*>\s*)?({NAME})")
SCRIPT_METHOD = re.compile(rf"\s*{MODIFIERS}(?:(?:get|set)\s+(?=[\w$#]))?\*?\s*(#?{NAME})[?!]?\s*(?:<[^()]*>)?\s*\(")
SCRIPT_FUNCTION = re.compile(rf"\s*{MODIFIERS}function\s*\*?\s*({NAME})\s*[<(]")
KOTLIN_FUN = re.compile(rf"\s*{MODIFIERS}fun\s+(?:<[^>]*>\s*)?(?:[\w$<>?, ]+\.)?({NAME})\s*\(")
JAVA_CALLABLE = re.compile(rf"\s*{MODIFIERS}(?:<[^()]*>\s*)?(?:([\w$<>\[\],.?]+(?:\s*<[^()]*>)?(?:\[\])*)\s+)?({NAME})\s*\(")
UPPER = re.compile(rf"\s*{MODIFIERS}(?:(?:const|let|var|val)\s+)?(?:[\w$<>\[\]]+\s+)?([A-Z][A-Z0-9_$]+)\s*(?::[^=]+)?=(?!=)")
ANNOTATION = re.compile(r"\s*@(?!interface\b)([A-Za-z_][\w.]*)")


def _is_function(value: str) -> bool:
    return bool(re.match(rf"(?:async\s+)?(?:function\b|(?:<[^()]*>\s*)?\([^=]*=>|\([^)]*\)\s*(?::[^=]*)?=>|{NAME}\s*=>)", value)) or bool(re.match(r"(?:async\s*)?\(", value)) and "=>" in value


def _relations(kind: str, head: str, language: str) -> tuple[list[str], list[str]]:
    flat, before = re.sub(r"\s+", " ", head), None
    while flat != before:
        before, flat = flat, re.sub(r"<[^<>]*>", "", flat)
    if kind == "type" and "=" in flat:
        return type_names(flat.split("=", 1)[1], "&|"), []
    if language == "kotlin":
        while (new := re.sub(r"\([^()]*\)", "", flat)) != flat:
            flat = new
        return (type_names(flat.split(":", 1)[1], ",") if ":" in flat else []), []
    a = re.search(r"\bextends\b(.*?)(?=\bimplements\b|\bpermits\b|$)", flat)
    b = re.search(r"\bimplements\b(.*?)(?=\bextends\b|\bpermits\b|$)", flat)
    return type_names(a[1]) if a else [], type_names(b[1]) if b else []


def brace_symbols(s: Source) -> list[Symbol]:
    out, types, notes, package, lang = [], [], [], "", s.language  # types: (depth of the body, where it closes, symbol)
    banned = set(KEYWORDS["script" if lang in SCRIPT else lang]) - {"get", "set", "of", "from", "type", "constructor", "init", "string", "number", "any"}
    for at, line, depth, others in s.lines():
        while types and at > types[-1][1]:
            types.pop()
        if m := re.match(r"\s*package\s+([\w.]+)", line):
            package = m[1]
            continue
        if others or not line.strip():
            continue
        shift = 0
        while m := ANNOTATION.match(line, shift):
            notes.append(m[1].rsplit(".", 1)[-1])
            shift = m.end()
            if line[shift : shift + 1] == "(":
                shift = s.closing(at + shift) - at + 1
        if shift >= len(line) or not line[shift:].strip():
            continue
        at, line = at + shift, line[shift:]
        owner = types[-1][2] if types else None
        inside = owner is not None and depth == types[-1][0]
        annotations, notes = notes, []

        def add(name: str, pos: int, kind: str, value: bool = False, extends=(), implements=()) -> tuple[Symbol, int | None]:
            head, brace = s.body(at)
            end = s.closing(brace) + 1 if brace is not None and (not value or kind in ("function", "method")) else head  # noqa: B023
            base = f"{owner.qualified}." if owner and kind not in ("function", "variable") else ""  # noqa: B023
            found = Symbol(name, base + name, kind, pos, end, owner if base else None, list(extends), list(implements), markers_of(annotations, lang), s.signature(at, head))  # noqa: B023
            out.append(found)
            return found, brace

        if (m := TYPE.match(line)) and not (m[1] in ("type", "record", "module", "object", "struct") and m[2] in banned) and not (m[1] == "type" and "=" not in s.code[at : s.line_end(at)] and "<" not in line):
            head, brace = s.body(at)
            kind = TYPE_KINDS[m[1].lstrip("@")]
            end = s.line_end(at) if m[1] == "type" else head
            extends, implements = _relations(kind, s.code[at + m.end(2) : max(end, at + m.end(2))], lang)
            found, brace = add(m[2], at + m.start(2), kind, False, extends, implements)
            if brace is not None and m[1] != "type":
                types.append((depth + 1, s.closing(brace), found))
            continue
        if depth == 0 and lang in SCRIPT and (m := VARIABLE.match(line)):
            head, _ = s.body(at + m.end())
            value = re.sub(r"^[^=]*?=(?!>)\s*", "", s.code[at + m.end() : s.line_end(max(head, at + m.end()))], count=1).strip()
            wrapped = m[2][0].isupper() and re.match(rf"(?:{NAME}\.)?(?:{'|'.join(WRAPPERS)})\b", value)
            if "=" in s.code[at + m.end() : s.line_end(at)] and (_is_function(value) or wrapped):
                add(m[2], at + m.start(2), "function", True)
                continue
        if inside and (m := MEMBER_VALUE.match(line)) and m[1] not in banned and lang in SCRIPT:
            head, _ = s.body(at)
            value = s.code[at + m.start(2) : max(head, at + m.start(2))]
            add(m[1], at + m.start(1), "method" if _is_function(value.strip()) else "constant", True)
            continue
        if inside and lang in SCRIPT and (m := SCRIPT_METHOD.match(line)) and (m[1] not in banned or m[1] == "constructor"):
            add(m[1], at + m.start(1), "constructor" if m[1] == "constructor" else "method")
            continue
        if inside and lang == "java" and (m := JAVA_FIELD.match(line)) and m[1] not in banned and "(" not in line:
            add(m[1], at + m.start(1), "constant", True)
            continue
        if inside and lang == "java" and (m := JAVA_VALUE.match(line)) and m[1] not in banned:
            add(m[1], at + m.start(1), "constant", True)
            continue
        if inside and lang == "kotlin" and (m := KOTLIN_FIELD.match(line)):
            add(m[1], at + m.start(1), "constant", True)
            continue
        if inside and lang == "kotlin" and (m := re.match(rf"\s*{MODIFIERS}(constructor|init)\s*[({{]", line)):
            add(m[1], at + m.start(1), "constructor")
            continue
        callable_ = KOTLIN_FUN.match(line) if lang == "kotlin" else SCRIPT_FUNCTION.match(line) if lang in SCRIPT else None
        if callable_:
            add(callable_[1], at + callable_.start(1), "method" if inside else "function")
            continue
        if inside and lang == "java" and (m := JAVA_CALLABLE.match(line)) and m[2] not in banned and (m[1] is None) == (m[2] == owner.name) and m[1] not in ("new", "return", "throw", "else"):
            add(m[2], at + m.start(2), "constructor" if m[2] == owner.name else "method")
            continue
        if depth == 0 and (m := VARIABLE.match(line)) and (m[1] or m[2].isupper() or lang == "kotlin"):
            add(m[2], at + m.start(2), "constant" if "const" in line.split("=")[0] or "val" in line.split("=")[0].split() or m[2].isupper() else "variable", True)
        elif m := UPPER.match(line):
            add(m[1], at + m.start(1), "constant", True)
    return out


GRAPHQL_KINDS = {"type": "type", "interface": "interface", "input": "type", "union": "type", "enum": "enum", "scalar": "constant", "directive": "function"}
GRAPHQL_TOP = re.compile(rf"[ \t]*(?:extend\s+)?(?:(type|interface|input|union|enum|scalar|directive)\s+@?({NAME})|(query|mutation|subscription)\b\s*({NAME})?|(fragment)\s+({NAME})\s+on\s+({NAME}))")


def graphql_symbols(s: Source) -> tuple[list[Symbol], list[tuple]]:
    """Symbols, and selections (name, at, node, parent node or -1, root type, enclosing symbol) of operations and fragments."""
    out, picks, at = [], [], 0
    while m := re.compile(r"^" + GRAPHQL_TOP.pattern + r"|^[ \t]*\{", re.M).search(s.code, at):
        head, brace = s.body(m.end() - 1 if m[0].endswith("{") else m.end())
        rest = re.compile(rf"(?:\s*[=|]\s*\|?\s*{NAME})+").match(s.code, m.end()) if m[1] == "union" else None
        end = s.closing(brace) + 1 if brace is not None and m[1] not in ("union", "scalar", "directive") else rest.end() if rest else s.line_end(m.end())
        at = max(end, m.end())
        if m[1]:
            text = s.code[m.end() : head]
            implements = re.findall(NAME, text.split("implements", 1)[1].split("@")[0]) if "implements" in text else re.findall(NAME, rest[0]) if rest else []
            found = Symbol(m[2], m[2], GRAPHQL_KINDS[m[1]], m.start(2), end, None, [], implements, [], s.signature(m.start(), max(head, m.end())))
            out.append(found)
            if brace is None or m[1] in ("union", "scalar", "directive"):
                continue
            inner = re.compile(rf"({NAME})\s*(?=[(:@]|\s|\}})")
            pos, close = brace + 1, end - 1
            while f := inner.search(s.code, pos, max(pos, close + 1)):
                if f.start() >= close:
                    break
                after = f.end()
                if s.code[after : after + 1] == "(":
                    after = s.closing(after) + 1
                kind = re.compile(rf"\s*:\s*[\[\s]*({NAME})[\]!]*").match(s.code, after)
                stop = kind.end() if kind else after
                while d := re.compile(rf"\s*@{NAME}|\s*=\s*\S+").match(s.code, stop):
                    stop = s.closing(d.end()) + 1 if s.code[d.end() : d.end() + 1] == "(" else d.end()
                out.append(Symbol(f[1], f"{m[2]}.{f[1]}", "constant" if m[1] == "enum" else "method", f.start(1), stop, found, [kind[1]] if kind else [], [], [], s.text[f.start() : stop].strip()[:400]))
                pos = stop
            continue
        if brace is None and not m[0].endswith("{"):
            continue
        brace = m.end() - 1 if m[0].endswith("{") and not m[3] and not m[5] else brace
        end = s.closing(brace) + 1
        at = max(at, end)
        found = None
        if m[5]:
            found = Symbol(m[6], m[6], "type", m.start(6), end, None, [m[7]], [], [], s.signature(m.start(), brace))
        elif m[4]:
            found = Symbol(m[4], m[4], "function", m.start(4), end, None, [], [], ["GraphQLOperation"], s.signature(m.start(), brace))
        if found:
            out.append(found)
        root = m[7] or {"mutation": "Mutation", "subscription": "Subscription"}.get(m[3] or "", "Query")
        stack, last = [(-1, root)], -1
        for t in re.compile(rf"\{{|\}}|\(|\.\.\.\s*(?:on\s+({NAME}))?\s*({NAME})?|@\s*{NAME}|({NAME})(\s*:)?").finditer(s.code, brace, end):
            if t.start() < (stack[-1][2] if len(stack[-1]) > 2 else 0):
                continue
            if t[0] == "{":
                stack.append((last, stack[-1][1] if last == -1 else None))
            elif t[0] == "}":
                stack.pop() if len(stack) > 1 else None
            elif t[0] == "(":
                stack[-1] = (*stack[-1][:2], s.closing(t.start()) + 1)
            elif t[1]:  # a condition on a type: its fields start from there
                picks.append((t[1], t.start(1), len(picks), -2, t[1], found))
                last = len(picks) - 1
            elif t[3] and not t[4]:
                parent, top = stack[-1][0], stack[-1][1]
                picks.append((t[3], t.start(3), len(picks), parent, top if parent == -1 else None, found))
                last = len(picks) - 1
    return out, picks


def _module(path: str) -> list[str]:
    return [f"{path}.py", f"{path}/__init__.py"] if path else ["__init__.py"]


def python_imports(s: Source, rel_path: str) -> list[tuple]:
    """(local name, imported name or None for a module, kind, specifier, candidate files, line)."""
    out = []
    for m in re.finditer(r"^[ \t]*(?:from\s+(\.*[\w.]*)\s+import\s+(\([^)]*\)|[^\n;]+)|import\s+([^\n;(]+))", s.code, re.M):
        line = s.place(m.start())[0]
        if m[3]:
            for part in split_top(m[3]):
                if found := re.fullmatch(r"([\w.]+)(?:\s+as\s+(\w+))?", part):
                    out.append((found[2] or found[1], None, "module", found[1], _module(found[1].replace(".", "/")), line))
            continue
        dots = len(m[1]) - len(m[1].lstrip("."))
        base = rel_path.split("/")[:-1]
        base = base[: max(0, len(base) - dots + 1)] if dots else []
        path = "/".join([*base, *(x for x in m[1].lstrip(".").split(".") if x)])
        for part in split_top(m[2].strip("()")):
            if found := re.fullmatch(r"(\w+)(?:\s+as\s+(\w+))?", part):
                module = not m[1].strip(".")
                out.append((found[2] or found[1], None if module else found[1], "module" if module else "named", m[1], _module(f"{path}/{found[1]}".lstrip("/")) if module else _module(path), line))
    return out


def script_candidates(rel_path: str, specifier: str) -> list[str]:
    if not specifier.startswith("."):
        return []
    parts = rel_path.split("/")[:-1]
    for p in specifier.split("/"):
        if p == "..":
            parts = parts[:-1]
        elif p not in ("", "."):
            parts.append(p)
    base = "/".join(parts)
    if re.search(r"[^/.]\.[^/.]+$", base):
        return [base]
    return [f"{base}.{e}" for e in MODULE_ENDS] + [f"{base}/index.{e}" for e in MODULE_ENDS]


def script_imports(s: Source, rel_path: str) -> list[tuple]:
    """ES imports and re-exports, default, named, namespace or for their effect, and require calls."""
    out = []
    for m in re.finditer(rf"^[ \t]*(?:(import|export)\b(?:\s+type\b)?\s*([\w$*{{][^;'\"`()]*?)\s*\bfrom\s*|(import)\s*|(?:const|let|var)\s+({NAME}|\{{[^}}]*\}})\s*=\s*require\s*\(\s*)['\"]([^'\"\n]+)['\"]", s.text, re.M):
        if s.code[m.start() : m.end()].strip()[:3] == "":
            continue
        line, files = s.place(m.start() + len(m[0]) - len(m[0].lstrip()))[0], script_candidates(rel_path, m[5])
        if m[3]:
            out.append((None, None, "effect", m[5], files, line))
            continue
        for part in split_top(m[2] or m[4]):
            if part.startswith("{"):
                for one in split_top(part.strip("{}")):
                    names = re.split(r"\s+as\s+|\s*:\s*", re.sub(r"^type\s+", "", one))
                    out.append((names[-1], names[0], "named", m[5], files, line))
            elif found := re.match(rf"\*(?:\s+as\s+({NAME}))?", part):
                out.append((found[1], None, "namespace", m[5], files, line))
            else:
                out.append((part, None if m[4] else "default", "namespace" if m[4] else "default", m[5], files, line))
    return out


RECEIVER = re.compile(rf"(?:({NAME})\s*(\((?:[^()]|\([^()]*\))*\))?\s*[?!]{{0,2}}|[)\]])\s*\.\s*\Z")


def tokens(s: Source, rel_path: str) -> list[tuple]:
    """(name, at, receiver, call, new, in a type): names in code that are no keywords, keys or markup of plain elements."""
    lang = s.language
    skipped, markup = set(KEYWORDS["script" if lang in SCRIPT else lang]), rel_path.endswith((".tsx", ".jsx"))
    out = []
    for m in re.finditer(rf"(?<![\w$]){NAME}", s.code):
        name, at, end = m[0], m.start(), m.end()
        if name in skipped:
            continue
        before, after = s.code[max(0, at - 160) : at], s.code[end : end + 40]
        if lang != "python" and re.match(r"\??:(?!:)", after) and not re.search(r"[?]\s*\Z", before):
            continue
        if markup and (re.search(r"</?\Z", before) and name[0].islower() or re.match(r"=[\"'{]", s.text[end : end + 2])):
            continue
        line = before.rsplit("\n", 1)[-1]
        receiver, dotted = None, re.search(r"(?<!\.)\.\s*\Z", before)
        if dotted:
            r = RECEIVER.search(before)
            receiver = r[1] if r and r[1] and (not r[2] or r[1] == "super") and (r[1] not in skipped or r[1] in ("this", "self", "cls", "super")) else ""
        if lang == "python":
            in_type = bool(re.search(r"->\s*\Z", line) or re.search(r":\s*\Z", line) and re.match(r"\s*([,)=\-;]|$|\n)", after))
        else:
            in_type = bool(re.search(r"\b(as|satisfies|implements|extends|keyof)\s+\Z", line) or re.search(r":\s*\Z", line) and re.match(r"\s*([=,);}\[<]|$|\n)", after))
        out.append((name, at, receiver, bool(re.match(r"\s*\(", after) or lang != "python" and re.match(r"<[\w$, .]*>\(", after)), bool(re.search(r"\bnew\s+\Z", line)), in_type))
    if lang == "python":  # names by reflection
        for m in re.finditer(r"\b(?:(?:getattr|setattr|hasattr)\s*\(\s*(\w+)\s*,\s*|(?:globals|locals)\s*\(\s*\)\s*\[\s*)(['\"])([A-Za-z_]\w*)\2", s.text):
            if s.code[m.start()] != " ":
                out.append((m[3], m.start(3), m[1], False, False, False))
    return out


def bindings(s: Source) -> list[tuple]:
    """(variable, type name, at): what assignments of new objects, annotations and parameters say of a name's type."""
    dotted = rf"{NAME}(?:\.{NAME})*"
    rules = {
        "python": [rf"(?:\b(?:self|cls)\.)?\b({NAME})\s*(?::[^=\n]+)?=\s*(?:await\s+)?({dotted})\s*\(", rf"\b({NAME})\s*:\s*({dotted})\s*(?=[=,)\n]|$)"],
        "kotlin": [rf"\b({NAME})\s*:\s*({dotted})", rf"\bva[lr]\s+({NAME})\s*=\s*({dotted})\s*\("],
        "java": [rf"\b({NAME})\s*=\s*new\s+({dotted})", rf"(?<![\w.])(?P<t>[A-Z][\w$]*)(?:<[^<>()]*>)?\s+(?P<v>{NAME})\s*(?=[=;,)])"],
    }.get(s.language, [rf"\b({NAME})\s*(?::[^=\n;]+)?=\s*new\s+({dotted})", rf"\b({NAME})\??\s*:\s*({dotted})\s*(?=[=,);}}\n]|$)"])
    out = []
    for rule in rules:
        for m in re.finditer(rule, s.code, re.M):
            variable, kind = (m["v"], m["t"]) if "v" in m.groupdict() else (m[1], m[2])
            out.append((variable, kind.rsplit(".", 1)[-1], m.start()))
    return sorted(out, key=lambda x: x[2])


def embedded_graphql(text: str) -> str | None:
    """A script's text with all but its GraphQL templates blanked, or None if it has none."""
    out, last = [], 0
    for m in re.finditer(r"(?:\b(?:gql|graphql)\b|GraphQL[^\n`]*)\s*(?:<[^>`]*>)?\(?\s*`([^`]*)`", text):
        out += [lexer.spaces(text[last : m.start(1)]), re.sub(r"\$\{[^}]*\}", lambda x: lexer.spaces(x[0]), m[1])]
        last = m.end(1)
    return "".join([*out, lexer.spaces(text[last:])]) if out else None


def scan_file(rel_path: str, text: str, language: str) -> dict:
    """The nested row of one file. Symbols are in the order of their names' places; the rest refers to them by ordinal."""
    s = Source(text, language)
    picks, graphql = [], None
    if language == "python":
        found, imports = python_symbols(s), python_imports(s, rel_path)
    elif language == "graphql":
        (found, picks), imports, graphql = graphql_symbols(s), [], s
    else:
        found, imports = brace_symbols(s), script_imports(s, rel_path) if language in SCRIPT else []
        if language in SCRIPT and (inner := embedded_graphql(text)):
            graphql = Source(inner, "graphql")
            more, picks = graphql_symbols(graphql)
            found += more
    found.sort(key=lambda x: (x.start, x.qualified))
    place = {id(x): i for i, x in enumerate(found)}
    bodies = [(x.start, x.end, i) for i, x in enumerate(found) if x.kind not in ("constant", "variable")]

    class Owners:
        """Innermost bodies around rising positions."""

        def __init__(self):
            self.k, self.open = 0, []

        def __call__(self, at: int) -> int | None:
            while self.k < len(bodies) and bodies[self.k][0] <= at:
                self.open.append(bodies[self.k])
                self.k += 1
            self.open = [b for b in self.open if b[1] > at]
            return min(self.open, key=lambda b: (b[1] - b[0], -b[0]))[2] if self.open else None

    def container(i: int | None) -> int | None:
        while i is not None and found[i].kind not in ("class", "interface", "struct", "enum", "type"):
            i = place.get(id(found[i].container)) if found[i].container is not None else None
        return i

    rows, owner = [], Owners()
    names = tokens(s, rel_path) if language != "graphql" else []
    for name, at, receiver, call, new, in_type in sorted(names, key=lambda x: x[1]):
        i = owner(at)
        rows.append((name, *s.place(at), receiver, call, new, in_type, i, container(i)))
    if graphql:
        owner = Owners()
        for m in re.finditer(rf"\.\.\.\s*(?!on\b)({NAME})|@\s*({NAME})|\bon\s+({NAME})|:\s*[\[\s]*({NAME})|(?:implements|&|\||=)\s*({NAME})", graphql.code):
            k = m.lastindex
            i = owner(m.start(k))
            rows.append((m[k], *graphql.place(m.start(k)), None, False, False, k > 2, i, container(i)))
    bound, owner = [], Owners()
    for variable, kind, at in bindings(s) if language != "graphql" else []:
        i = owner(at)
        bound.append((variable, kind, s.place(at)[0], container(i) if re.match(r"(self|cls)\.", s.code[at : at + 5]) else i))
    symbols = []
    for i, x in enumerate(found):
        (a, b), (c, d) = s.place(x.start), s.place(max(x.end, x.start))
        symbols.append((x.name, x.qualified, x.kind, a, b, c, d, x.container.name if x.container else None, place.get(id(x.container)) if x.container else None, x.extends, x.implements, x.markers, x.signature, i))
    selections = [(n, *graphql.place(at), node, parent, root, place.get(id(f)) if f else None) for n, at, node, parent, root, f in picks]
    return {"symbols": symbols, "imports": imports, "tokens": rows, "bindings": bound, "selections": selections}


def extracts(corpus: DataFrame) -> DataFrame:
    """corpus(rel_path, text) to one nested row a file of a known language. Null texts are left out. Write it before use."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [{"rel_path": p, "language": lang, **scan_file(p, t, lang)} for p, t, lang in zip(pdf["rel_path"], pdf["text"], pdf["language"])]
            yield pd.DataFrame(rows, columns=["rel_path", "language", *PARTS])

    rows = corpus.select("rel_path", "text", globs.language(F.col("rel_path")).alias("language")).where(F.col("language").isin(*LANGUAGES) & F.col("text").isNotNull())
    return rows.mapInPandas(run, SCHEMA)
