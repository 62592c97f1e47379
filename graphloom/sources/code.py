"""Code structure: classes, functions, imports and calls of source files.

``parse(path, content)`` gives one file record; ``parse_files`` runs it over a DataFrame of
files. Python is read with the standard library's syntax tree. The other languages are read
by a scanner: comments and strings are blanked (positions stay), declarations found by
patterns, bodies by matching braces. Where this differs from a full grammar (macros,
preprocessor branches, declarations spread in unusual ways) a symbol may be missed.

Languages are entries of ``REGISTRY``; ``register_language`` adds more. With ``strict`` the
narrower historic rules hold: ``from m import a`` without alias makes no import, decorated
methods and JavaScript class methods are left out.
"""

from __future__ import annotations

import ast
import bisect
import functools
import itertools
import os
import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from graphloom.functions.columns import LANGUAGES, ignored, language

FUNCTION = "struct<name:string,qualified_name:string,file_path:string,start_line:bigint,end_line:bigint,parameters:array<string>,return_type:string,is_method:boolean,class_name:string,calls:array<string>>"
CLASS = f"struct<name:string,qualified_name:string,file_path:string,start_line:bigint,end_line:bigint,bases:array<string>,methods:array<{FUNCTION}>>"
FILE = f"repo_name string, pos bigint, path string, language string, size bigint, classes array<{CLASS}>, functions array<{FUNCTION}>, imports array<struct<source_file:string,imported_name:string,module_path:string,alias:string>>"


def _function(path, name, start, end, parameters, returns, owner, calls) -> dict:
    return {
        "name": name, "qualified_name": f"{owner}.{name}" if owner else name, "file_path": path, "start_line": start, "end_line": end, "parameters": parameters, "return_type": returns,
        "is_method": bool(owner), "class_name": owner, "calls": list(dict.fromkeys(c for c in calls if c)),
    }


def _class(path, name, start, end, bases, methods) -> dict:
    return {"name": name, "qualified_name": name, "file_path": path, "start_line": start, "end_line": end, "bases": list(dict.fromkeys(bases)), "methods": methods}


def _import(path, name, module, alias=None) -> dict:
    return {"source_file": path, "imported_name": name, "module_path": module, "alias": alias}


# --- Python


def _dotted(node: ast.expr) -> str:
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return f"{head}.{node.attr}" if head else node.attr
    if isinstance(node, ast.Name):
        return node.id
    return _dotted(node.func) if isinstance(node, ast.Call) else ""


def _python_function(path: str, node, owner: str | None) -> dict:
    a = node.args
    names = [x.arg for x in [*a.posonlyargs, *a.args]] + ([a.vararg.arg] if a.vararg else []) + [x.arg for x in a.kwonlyargs] + ([a.kwarg.arg] if a.kwarg else [])
    calls = sorted((n for n in ast.walk(node) if isinstance(n, ast.Call)), key=lambda n: (n.lineno, n.col_offset))
    return _function(path, node.name, node.lineno, node.end_lineno, names, ast.unparse(node.returns) if node.returns else None, owner, [_dotted(c.func) for c in calls])


_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def parse_python(path: str, text: str, strict: bool) -> tuple[list, list, list]:
    tree = ast.parse(text)
    classes, functions, imports = [], [], []

    def visit(node: ast.AST, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                methods = [_python_function(path, m, child.name) for m in child.body if isinstance(m, _DEFS) and not (strict and m.decorator_list)]
                names = [n for b in [*child.bases, *[k.value for k in child.keywords]] for n in sorted((x for x in ast.walk(b) if isinstance(x, (ast.Name, ast.Attribute))), key=lambda x: (x.end_lineno, x.end_col_offset))]
                bases = [n.id if isinstance(n, ast.Name) else n.attr for n in names]
                classes.append(_class(path, child.name, child.lineno, child.end_lineno, bases + (["metaclass"] if strict and child.keywords else []), methods))
                visit(child, True)
            elif isinstance(child, _DEFS):
                if not in_class:
                    functions.append(_python_function(path, child, None))
                visit(child, in_class)
            elif isinstance(child, ast.Import):
                imports.extend(_import(path, x.name.split(".")[-1], x.name, x.asname) for x in child.names)
            elif isinstance(child, ast.ImportFrom):
                module = "." * child.level + (child.module or "")
                imports.extend(_import(path, x.name, module, x.asname) for x in child.names if not strict or x.asname or x.name == "*")
            else:
                visit(child, in_class)

    visit(tree, False)
    return classes, functions, imports


# --- languages with braces


@dataclass
class Rules:
    """Patterns of a language. ``type``: groups name and heads (bases); ``function``: name, parameters, returns; ``method`` the same inside a type's body."""

    type: str
    function: str
    method: str = ""
    bases: str = ""
    imports: list[tuple[str, Callable[[re.Match], list[tuple[str, str, str | None]]]]] = field(default_factory=list)
    keywords: frozenset = frozenset()
    parameter: Callable[[str], str] = lambda p: p
    separator: str = r"\."
    line_comment: str = "//"
    quotes: str = "\"'`"


_WORDS = frozenset("if for while switch catch return else do new function typeof sizeof await async super this match in and or not defined throw throws case delete yield with fn func def impl loop synchronized assert static_cast dynamic_cast reinterpret_cast const_cast alignof decltype".split())

#: Of these, what some languages use as names of functions.
_NAMES = frozenset({"new", "delete", "match", "in", "and", "or", "not", "case", "loop", "with", "default"})


@functools.cache
def _blanked(line_comment: str, marks: str) -> re.Pattern:
    quotes = "".join(re.escape(q) for q in marks)
    # a Rust lifetime ('a) isn't a string: a quote needs its partner in the line, except back quotes
    return re.compile(rf"{line_comment}[^\n]*|/\*.*?(?:\*/|\Z)|([{quotes.replace('`', '')}])(?:\\.|(?!\1)[^\\\n])*\1" + (r"|`(?:\\.|[^`\\])*`" if "`" in marks else ""), re.S)


@functools.cache
def _called(separator: str) -> re.Pattern:
    return re.compile(rf"(?<![\w$])([A-Za-z_$][\w$]*(?:\s*(?:{separator})\s*[A-Za-z_$][\w$]*)*)(!?)\s*(?:::<[^>]*>)?\(")


@functools.cache
def _words(keywords: frozenset, but: frozenset = frozenset()) -> frozenset:
    return (_WORDS | keywords) - but


@functools.cache
def _brackets(opening: str, closing: str) -> re.Pattern:
    return re.compile(f"[{re.escape(opening)}{re.escape(closing)}]")


def blank(text: str, rules: Rules) -> str:
    """``text`` with comments and the inside of strings as spaces; lines and positions stay."""
    rx = _blanked(rules.line_comment, rules.quotes)
    return rx.sub(lambda m: re.sub(r"[^\n]", " ", m.group()) if not m.group(1) else m.group(1) + " " * (len(m.group()) - 2) + m.group(1), text)


def _close(text: str, at: int, opening: str = "{", closing: str = "}") -> int:
    """Position of the bracket that closes the one at ``at``; the end if none does."""
    depth = 0
    for m in _brackets(opening, closing).finditer(text, at):
        depth += 1 if m.group() == opening else -1
        if not depth:
            return m.start()
    return len(text) - 1


def _split(params: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in params:
        depth += (c in "(<[{") - (c in ")>]}")
        if c == "," and depth <= 0:
            out.append(part)
            part = ""
        else:
            part += c
    return [p.strip() for p in [*out, part] if p.strip()]


class Scanner:
    def __init__(self, path: str, text: str, rules: Rules):
        self.path, self.raw, self.rules = path, text, rules
        self.text = blank(text, rules)
        self.lines = [m.start() for m in re.finditer("\n", text)]

    def line(self, at: int) -> int:
        return bisect.bisect_left(self.lines, at) + 1

    def calls(self, a: int, b: int) -> list[str]:
        found, words = [], _words(self.rules.keywords)
        for m in _called(self.rules.separator).finditer(self.text[a:b]):
            name = re.sub(r"\s+", "", m.group(1))
            before = self.text[max(0, a + m.start() - 9) : a + m.start()].split()
            if name in words or (before and before[-1] in ("new", "function", "fn", "func")):
                continue
            found.append(name)
        return found

    def function(self, m: re.Match, base: int, owner: str | None) -> tuple[dict, int] | None:
        name = m.group("name")
        if name in _words(self.rules.keywords, _NAMES):
            return None
        opening = base + m.end() - 1
        if self.text[opening] == "{":
            end = _close(self.text, opening)
        else:
            end = opening
        params = [self.rules.parameter(p) for p in _split(m.groupdict().get("params") or "")]
        returns = (m.groupdict().get("returns") or "").strip() or None
        start = base + m.start("name")
        head = self.text[base + m.start() : start]
        first = base + m.start() + len(head) - len(head.lstrip())
        return _function(self.path, name, self.line(first), self.line(end), [p for p in params if p], returns, owner, self.calls(opening, end + 1)), end

    def types(self) -> tuple[list[dict], list[tuple[int, int]]]:
        classes, spans = [], []
        for m in re.finditer(self.rules.type, self.text, re.M):
            opening = m.end() - 1
            end = _close(self.text, opening) if self.text[opening] == "{" else opening
            head = m.groupdict().get("head") or ""
            head = re.sub(r"<[^<>]*>", "", head)
            bases = [b for b in re.findall(r"[A-Za-z_$][\w$]*", re.sub(self.rules.bases, " ", head))] if self.rules.bases else []
            methods = self.members(opening + 1, end, m.group("name")) if self.rules.method else []
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            classes.append(_class(self.path, m.group("name"), self.line(start), self.line(end), bases, methods))
            spans.append((opening, end))
        return classes, spans

    def members(self, a: int, b: int, owner: str) -> list[dict]:
        """Functions at the top level of a body."""
        out, at = [], a
        rx = re.compile(self.rules.method, re.M)
        while at < b:
            m = rx.search(self.text, at, b)
            brace = self.text.find("{", at, b)
            if m is None:
                break
            if 0 <= brace < m.start():  # a nested body first
                at = _close(self.text, brace) + 1
                continue
            made = self.function(m, 0, owner)
            if made is None:
                at = m.end() - 1 if self.text[m.end() - 1] == "{" else m.end()
                if self.text[at : at + 1] == "{":
                    at = _close(self.text, at) + 1
                continue
            out.append(made[0])
            at = max(made[1] + 1, m.end())
        return out

    def imports(self) -> list[dict]:
        found = []
        for pattern, make in self.rules.imports:
            # strings were blanked: match in the raw text where the blanked one has code
            for m in re.finditer(pattern, self.raw, re.M):
                if self.text[m.start() : m.end()].strip():
                    found += [(m.start(), k, _import(self.path, *x)) for k, x in enumerate(make(m))]
        return [x for _, _, x in sorted(found, key=lambda t: t[:2])]


def _tail(module: str) -> str:
    return re.split(r"[/.]|::", module.rstrip("/"))[-1] or module


def _js_import(m: re.Match) -> list[tuple[str, str, str | None]]:
    what, module = (m.group("what") or "").strip(), m.group("module")
    out = []
    named = re.search(r"\{([^}]*)\}", what)
    for item in (named.group(1).split(",") if named else []):
        words = item.replace("type ", "").split()
        if words:
            out.append((words[0], module, words[2] if len(words) == 3 else None))
    rest = re.sub(r"\{[^}]*\}", "", what)
    for item in rest.split(","):
        words = item.split()
        if words[:1] == ["*"]:
            out.append(("*", module, words[-1] if len(words) == 3 else None))
        elif words:
            out.append((words[-1], module, None))
    return out or [(_tail(module), module, None)]


def _go_imports(m: re.Match) -> list[tuple[str, str, str | None]]:
    return [(_tail(p), p, a or None) for a, p in re.findall(r'(?:^|[\s(;])([\w.]*)\s*"([^"]+)"', m.group("what"))]


def _use(m: re.Match) -> list[tuple[str, str, str | None]]:
    def walk(prefix: str, tree: str) -> Iterator[tuple[str, str, str | None]]:
        for part in _split(tree):
            group = re.match(r"(.*?)\{(.*)\}$", part, re.S)
            if group:
                yield from walk(prefix + group.group(1).strip(), group.group(2))
            else:
                name, _, alias = part.partition(" as ")
                full = (prefix + name.strip()).removesuffix("::self")
                yield _tail(full), full, alias.strip() or None

    return list(walk("", m.group("what").strip()))


_NAME = r"(?P<name>[A-Za-z_$][\w$]*)"
_GENERIC = r"(?:\s*<[^<>(){};]*(?:<[^<>]*>[^<>(){};]*)*>)?"
_PARAMS = r"\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)"
_js = lambda p: re.sub(r"^(?:public|private|protected|readonly|\s)+", "", re.split(r"[:=?]", p)[0]).replace("...", "").strip()
_JS_IMPORTS = [(r"^\s*import\s+(?:(?P<what>[^'\";]*?)\s+from\s+)?['\"](?P<module>[^'\"]+)['\"]", _js_import)]
_last_word = lambda p: (re.findall(r"[A-Za-z_]\w*", re.sub(r"=.*|\[.*?\]", "", p)) or [""])[-1]
_first_word = lambda p: (re.findall(r"[A-Za-z_]\w*", p.replace("mut ", "").replace("&", "")) or [""])[0]

_C_FUNCTION = r"^[ \t]*(?!(?:return|else|typedef|if|for|while|switch|do)\b)(?P<returns>[A-Za-z_][\w \t:<>,]*?[\s*&]+)(?:[A-Za-z_]\w*::)*(?P<name>~?[A-Za-z_]\w*)\s*" + _PARAMS + r"\s*(?:const|noexcept|override|final|\s)*\{"
_INCLUDE = [(r"^\s*#\s*include\s*(?P<what>[<\"][^>\"]+[>\"])", lambda m: [(_tail(m.group("what")[1:-1].removesuffix(".h")), m.group("what")[1:-1], None)])]

REGISTRY: dict[str, Rules] = {
    "javascript": Rules(
        type=r"\bclass\s+" + _NAME + r"(?P<head>[^{;]*)\{", bases=r"\bextends\b", function=r"\bfunction\s*\*?\s+" + _NAME + r"\s*" + _PARAMS + r"\s*\{",
        method=r"(?:^|(?<=[;{}]))[ \t]*(?:(?:static|async|get|set)\s+)*[*#]?" + _NAME + r"\s*" + _PARAMS + r"\s*\{", imports=_JS_IMPORTS, parameter=_js,
    ),
    "typescript": Rules(
        type=r"\b(?:class|interface)\s+" + _NAME + r"(?P<head>[^{;]*)\{", bases=r"\b(?:extends|implements)\b", function=r"\bfunction\s*\*?\s+" + _NAME + _GENERIC + r"\s*" + _PARAMS + r"\s*(?::\s*(?P<returns>[^{;=]+?))?\s*[{;]",
        method=r"(?:^|(?<=[;{}]))[ \t]*(?:(?:public|private|protected|static|async|readonly|abstract|override|get|set)\s+)*[*#]?" + _NAME + _GENERIC + r"\s*" + _PARAMS + r"\s*(?::\s*(?P<returns>[^{;=]+?))?\s*[{]", imports=_JS_IMPORTS, parameter=_js,
    ),
    "java": Rules(
        type=r"\b(?:class|interface|enum)\s+" + _NAME + r"(?P<head>[^{;]*)\{", bases=r"\b(?:extends|implements|permits)\b", function=r"(?!)",
        method=r"(?:^|(?<=[;{}]))[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*(?:<[^>]+>\s*)?(?P<returns>[A-Za-z_][\w.<>,\[\] ?]*?\s+)?(?<!new )" + _NAME + r"\s*" + _PARAMS + r"\s*(?:throws\s+[\w., ]+)?\s*[{;]",
        imports=[(r"^\s*import\s+(?:static\s+)?(?P<what>[\w.]+(?:\.\*)?)\s*;", lambda m: [(_tail(m.group("what")) if not m.group("what").endswith("*") else "*", m.group("what").removesuffix(".*"), None)])], parameter=_last_word, quotes="\"'",
    ),
    "go": Rules(
        type=r"^[ \t]*(?:type\s+)?" + _NAME + r"\s+struct\s*(?P<head>)\{", function=r"^func\s+" + _NAME + _GENERIC.replace("<", r"\[").replace(">", r"\]") + r"\s*" + _PARAMS + r"\s*(?P<returns>[^{\n]*)\{",
        imports=[(r"^import\s+(?P<what>\((?:[^()]*)\)|[\w.]*\s*\"[^\"]+\")", _go_imports)], parameter=_first_word, keywords=frozenset({"struct", "interface", "map", "chan", "go", "defer", "range", "select"}),
    ),
    "rust": Rules(
        type=r"\b(?:struct|enum|union|trait)\s+" + _NAME + r"(?P<head>[^{;(]*)[{;(]", function=r"\bfn\s+" + _NAME + _GENERIC + r"\s*" + _PARAMS + r"\s*(?:->\s*(?P<returns>[^{;]+?))?\s*(?:where[^{;]*)?[{;]",
        imports=[(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<what>[^;]+);", _use), (r"^\s*extern\s+crate\s+(?P<what>\w+(?:\s+as\s+\w+)?)\s*;", _use)], parameter=_first_word, separator=r"\.|::", quotes='"',
    ),
    "c": Rules(type=r"\b(?:struct|union|enum)\s+" + _NAME + r"(?P<head>[^{;()=]*)\{", function=_C_FUNCTION, imports=_INCLUDE, parameter=_last_word, separator=r"\.|->", quotes="\"'"),
    "cpp": Rules(
        type=r"\b(?:class|struct|union|enum(?:\s+class)?)\s+" + _NAME + r"(?P<head>[^{;()=]*)\{", bases=r"\b(?:public|private|protected|virtual|final)\b|::?", function=_C_FUNCTION,
        method=r"(?:^|(?<=[;{}:]))[ \t]*(?P<returns>(?:[A-Za-z_][\w:<>,*& \t]*?[ \t*&]+)?)(?P<name>~?[A-Za-z_]\w*)\s*" + _PARAMS + r"\s*(?:const|noexcept|override|final|\s)*(?::[^{;]*)?\{", imports=_INCLUDE, parameter=_last_word, separator=r"\.|->|::", quotes="\"'",
    ),
}
REGISTRY["tsx"] = REGISTRY["typescript"]


def register_language(name: str, rules: Rules, endings: list[str]) -> None:
    """Add a language, or replace one, on the driver; workers get it with the function that uses it."""
    REGISTRY[name] = rules
    for e in endings:
        LANGUAGES[e if e.startswith(".") else f".{e}"] = name


def _go_methods(s: Scanner, classes: list[dict]) -> list[dict]:
    rx = re.compile(r"^func\s*\(\s*\w*\s*\*?\s*(?P<owner>\w+)(?:\[[^\]]*\])?\s*\)\s*" + _NAME + r"\s*" + _PARAMS + r"\s*(?P<returns>[^{\n]*)\{", re.M)
    by_name = {c["name"]: c for c in classes}
    loose = []
    for m in rx.finditer(s.text):
        made = s.function(m, 0, m.group("owner"))
        if made:
            (by_name[m.group("owner")]["methods"] if m.group("owner") in by_name else loose).append(made[0])
    return loose


def _rust_impls(s: Scanner, classes: list[dict]) -> list[tuple[int, int]]:
    by_name = {c["name"]: c for c in classes}
    spans = []
    for m in re.finditer(r"\bimpl" + _GENERIC + r"\s+(?:(?P<trait>[\w:]+)" + _GENERIC + r"\s+for\s+)?&?" + _NAME + r"[^{;]*\{", s.text):
        end = _close(s.text, m.end() - 1)
        spans.append((m.end() - 1, end))
        name = m.group("name")
        if name not in by_name:
            by_name[name] = _class(s.path, name, s.line(m.start()), s.line(end), [], [])
            classes.append(by_name[name])
        if m.group("trait"):
            base = m.group("trait").split("::")[-1]
            if base not in by_name[name]["bases"]:
                by_name[name]["bases"].append(base)
        rx = re.compile(s.rules.function, re.M)
        by_name[name]["methods"] += [made[0] for f in rx.finditer(s.text, m.end(), end) if (made := s.function(f, 0, name))]
    return spans


def parse_braces(path: str, text: str, name: str, strict: bool) -> tuple[list, list, list]:
    rules = REGISTRY[name]
    s = Scanner(path, text, rules)
    classes, spans = s.types()
    if name == "javascript" and strict:
        for c in classes:
            c["methods"] = []
    loose: list[dict] = []
    if name == "go":
        loose = _go_methods(s, classes)
    elif name == "rust":
        traits = [(m.end() - 1, _close(s.text, m.end() - 1)) for m in re.finditer(r"\btrait\s+\w+[^{;]*\{", s.text)]
        spans = _rust_impls(s, classes) + traits
    functions = []
    for m in re.finditer(rules.function, s.text, re.M):
        at = m.start("name")
        if any(a < at < b for a, b in spans):
            continue
        made = s.function(m, 0, None)
        if made:
            functions.append(made[0])
    return classes, functions + loose, s.imports()


def parse(path: str, content: bytes | str, languages: list[str] | None = None, strict: bool = False) -> dict | None:
    """A file record, or None if the language isn't known or wanted, or the text can't be read."""
    ending = re.search(r"(\.[^./]*)$", path)
    name = LANGUAGES.get(ending.group(1).lower()) if ending else None
    wanted = None if languages is None else {*languages, *(["tsx"] if "typescript" in languages else [])}
    if name is None or (wanted is not None and name not in wanted):
        return None
    raw = content.encode() if isinstance(content, str) else bytes(content)
    text = raw.decode("utf-8", "replace")
    try:
        classes, functions, imports = parse_python(path, text, strict) if name == "python" else parse_braces(path, text, name, strict)
    except (SyntaxError, ValueError, RecursionError):
        return None
    return {"path": path, "language": name, "size": len(raw), "classes": classes, "functions": functions, "imports": imports}


#: Files that are parsed and turned to Arrow together, and Python sources for which a process is forked.
FILES_AT_ONCE, PYTHON_AT_ONCE = 500, 2000


def _forked(work: Callable[[], list]) -> list:
    """The result of ``work``, done in a child process."""
    back, to = os.pipe()
    child = os.fork()
    if not child:
        try:
            os.close(back)
            try:
                made = (True, work())
            except BaseException as e:  # said again in the parent
                made = (False, f"{type(e).__name__}: {e}")
            with os.fdopen(to, "wb") as out:
                pickle.dump(made, out, pickle.HIGHEST_PROTOCOL)
        finally:
            os._exit(0)
    os.close(to)
    with os.fdopen(back, "rb") as said:
        data = said.read()
    os.waitpid(child, 0)
    if not data:
        raise RuntimeError("the process that parses Python sources ended without a result")
    good, made = pickle.loads(data)
    if not good:
        raise RuntimeError(f"parsing Python sources: {made}")
    return made


def _parse_some(files: list[tuple[str, bytes]], languages: list[str] | None, strict: bool) -> Iterator[dict]:
    """The records of a batch of files, those of other languages first.

    Python's parser keeps every name it ever met until its process ends, so that a worker that lives
    on would grow with all files it has seen: Python sources are parsed in forked processes.
    """
    kind = lambda path: LANGUAGES.get("." + path.rpartition("/")[2].rpartition(".")[2].lower())
    yield from (r for p, c in files if kind(p) != "python" and (r := parse(p, c, languages, strict)))
    python = [(p, c) for p, c in files if kind(p) == "python"]
    for k in range(0, len(python), PYTHON_AT_ONCE):
        yield from _forked(lambda some=python[k : k + PYTHON_AT_ONCE]: [r for p, c in some if (r := parse(p, c, languages, strict))])


def parse_files(files: DataFrame, repo_name: str, languages: list[str] | None = None, ignore: list[str] | None = None, strict: bool = False) -> DataFrame:
    """File records from (path, content). Ignored and unknown paths are dropped before their content is touched."""
    schema = StructType.fromDDL(FILE)
    arrow = to_arrow_schema(schema)
    wanted = files.where(language(F.col("path")).isNotNull())
    if ignore:
        wanted = wanted.where(~ignored(F.col("path"), ignore))
    registry, endings = dict(REGISTRY), dict(LANGUAGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        REGISTRY.update(registry)
        LANGUAGES.update(endings)
        for batch in batches:
            files = [(p, c) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()) if c is not None]
            for some in itertools.batched(_parse_some(files, languages, strict), FILES_AT_ONCE):
                yield from pa.Table.from_pylist([{"repo_name": repo_name, "pos": 0, **r} for r in some], arrow).to_batches()

    parsed = wanted.select("path", "content").mapInArrow(run, schema)
    # a path is one record, so its rank is only a tie rule between files: the path's hash keeps it stable without a global sort
    return parsed.withColumn("pos", F.xxhash64("path"))


def read_directory(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all files below ``root``, paths relative to it."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    prefix = base.removeprefix("file://").removeprefix("file:")
    return raw.select(F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^\\Q" + prefix + "\\E/", "").alias("path"), "content")
