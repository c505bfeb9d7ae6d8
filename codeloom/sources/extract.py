"""Extraction: source files to symbols, calls, references and imports, in one Arrow stage.

Python goes through its own parser. Other languages go through a scanner that knows strings, comments and brackets
and a few patterns per language: no grammar library is needed, and names, containers, calls and imports come out,
but unusual layouts may be missed. ``register`` adds a language or replaces its extractor.
"""

from __future__ import annotations

import ast
import heapq
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codeloom.functions.text import is_test_path
from codeloom.schemas import FILE_MAP


@dataclass(frozen=True)
class Language:
    name: str
    suffixes: tuple[str, ...]
    extract: Callable[[str, str], dict]


@dataclass
class Collected:
    """One file's rows; ids are numbered in the order of definition."""

    path: str
    doc: str | None = None
    symbols: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    refs: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    seen: dict[str, int] = field(default_factory=dict)

    def add(self, name: str, containers: list[str], kind: str, start: int, end: int, **more) -> str:
        qualname = ".".join([*containers, name])
        n = self.seen[qualname] = self.seen.get(qualname, 0) + 1
        symbol = {"id": f"{self.path}::{qualname}" + (f"#{n}" if n > 1 else ""), "name": name, "qualname": qualname, "kind": kind, "params": [], "returns": None, "start_line": start, "end_line": end, "decorated": False, "exported": False, "doc": None}
        self.symbols.append(symbol | more)
        return symbol["id"]

    def call(self, caller: str | None, text: str, line: int) -> None:
        parts = re.split(r"(::|->|\.)", text)
        self.calls.append({"caller_id": caller, "text": text, "name": parts[-1], "receiver": "".join(parts[:-2]) or None, "line": line})


def short(doc: str | None, limit: int = 100) -> str | None:
    """The first line of a doc text."""
    line = (doc or "").strip().split("\n")[0].strip()
    return None if not line else line if len(line) <= limit else line[: limit - 1].rstrip() + "…"


# Python


class _Python(ast.NodeVisitor):
    def __init__(self, out: Collected):
        self.out, self.inside, self.owner = out, [], None

    def define(self, node, kind: str) -> None:
        params = []
        if kind == "function":
            a = node.args
            plain = [(p.arg, p) for p in [*a.posonlyargs, *a.args]] + ([("*" + a.vararg.arg, a.vararg)] if a.vararg else []) + [(p.arg, p) for p in a.kwonlyargs] + ([("**" + a.kwarg.arg, a.kwarg)] if a.kwarg else [])
            params = [{"name": n, "type": ast.unparse(p.annotation) if p.annotation else None} for n, p in plain]
            kind = "method" if self.inside else kind
        returns = ast.unparse(node.returns) if getattr(node, "returns", None) else None
        here = self.out.add(node.name, self.inside, kind, node.lineno, node.end_lineno, params=params, returns=returns, decorated=bool(node.decorator_list), doc=short(ast.get_docstring(node)))
        for d in node.decorator_list:
            self.visit(d)
        before = self.inside, self.owner
        self.owner = here
        self.inside = [*self.inside, node.name] if isinstance(node, ast.ClassDef) else self.inside
        for child in node.body:
            self.visit(child)
        self.inside, self.owner = before

    def visit_FunctionDef(self, node):
        self.define(node, "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node):
        self.define(node, "class")

    def visit_Call(self, node):
        if isinstance(node.func, ast.Name | ast.Attribute):
            self.out.call(self.owner, re.sub(r"\s+", " ", ast.unparse(node.func)), node.lineno)
        self.generic_visit(node)

    def visit_Import(self, node):
        for a in node.names:
            self.out.imports.append({"name": a.asname or a.name.split(".")[0], "source": a.name})

    def visit_ImportFrom(self, node):
        base = "." * node.level + (node.module or "")
        for a in node.names:
            if a.name != "*":
                self.out.imports.append({"name": a.asname or a.name, "source": base + ("" if base.endswith(".") else ".") + a.name})


def python(path: str, text: str) -> dict:
    tree, out = ast.parse(text), Collected(path)
    out.doc = short(ast.get_docstring(tree))
    _Python(out).visit(tree)
    return vars(out)


# Other languages: patterns over text whose strings and comments are blanked


CALL = r"(?:\bnew\s+)?([A-Za-z_$][\w$]*(?:\s*(?:\.|::|->|\?\.)\s*[A-Za-z_$][\w$]*)*)\s*(?:::<[^>()]*>|<[\w\s,]+>)?\("


@dataclass(frozen=True)
class Patterns:
    """``defs``: (kind, pattern with a group name, params and owner where there are any); ``types`` open containers."""

    defs: tuple[tuple[str, str], ...]
    imports: Callable[[str], list[tuple[str, str]]]
    comment: str = r"//[^\n]*|/\*.*?\*/"
    style: str = "c"
    exported: str = r"(?!)"
    refs: bool = False
    ends: str = "brace"
    call: str = CALL


STRINGS = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`'
CONTROL = frozenset("if for while switch catch return else do match loop select".split())
KEYWORDS = frozenset("import if for while switch catch return sizeof match fn func function new await typeof else do class def elif unless until when super loop move in not and or assert yield throw raise delete defer go select case defn defun define defmodule cond let lambda ns".split())
BRACKET_CALL = r"\(\s*([A-Za-z_][\w.!?*-]*)"


def blanked(text: str, comment: str) -> str:
    """Strings and comments as spaces of equal length, lines kept."""
    return re.sub(f"{STRINGS}|{comment}", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def closing(text: str, start: int) -> int:
    """Where the block of the first bracket after ``start`` ends; the end of a statement without one."""
    open_at = text.find("{", start)
    semicolon = text.find(";", start)
    if open_at < 0 or 0 <= semicolon < open_at:
        return semicolon if semicolon >= 0 else len(text)
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, open_at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return len(text)


def indent_of(text: str, start: int) -> str:
    line = text.rfind("\n", 0, start) + 1
    return re.compile(r"[ \t]*").match(text, line)[0]


def ruby_end(text: str, start: int, after: int) -> int:
    """The "end" on the indentation of the definition."""
    m = re.compile(rf"^{indent_of(text, start)}end\b", re.M | re.I).search(text, start)
    return m.end() if m else len(text)


def indented_end(text: str, start: int, after: int) -> int:
    """Before the next line that isn't indented further than the definition."""
    m = re.compile(rf"\n(?=[ \t]{{0,{len(indent_of(text, start))}}}\S)").search(text, after)
    return m.start() if m else len(text)


def bracket_end(text: str, start: int, after: int) -> int:
    """The bracket that closes the one before the definition's keyword."""
    depth, at = 0, text.rfind("(", 0, start + 1)
    for m in re.compile(r"[()]").finditer(text, max(at, 0)):
        depth += 1 if m[0] == "(" else -1
        if depth <= 0:
            return m.start()
    return len(text)


ENDS = {"brace": lambda text, start, after: closing(text, after), "end": ruby_end, "indent": indented_end, "bracket": bracket_end}


def parameters(text: str, style: str) -> list[dict]:
    out = []
    for part in re.split(r",(?![^<(\[]*[>)\]])", text):
        part = re.sub(r"=.*", "", part, flags=re.S).strip()
        if not part or part == "void":
            continue
        if style in ("rust", "ts"):
            name, _, kind = part.partition(":")
            out.append({"name": re.sub(r"^(?:&?(?:mut\s+)?|(?:public|private|protected|readonly)\s+)*", "", name.strip()).rstrip("?"), "type": " ".join(kind.split()) or None})
        elif style == "go":
            name, _, kind = part.partition(" ")
            out.append({"name": name, "type": kind.strip() or None})
        elif style == "c":
            m = re.match(r"(.*?[\s*&]+)(\w+)(?:\[\w*\])?$", part, re.S)
            out.append({"name": m[2], "type": re.sub(r"\s+", " ", m[1]).strip()} if m else {"name": part, "type": None})
        else:
            out.append({"name": part, "type": None})
    return out


def doc_above(text: str, start: int, mark: str) -> str | None:
    """The first line of the comment lines right above a definition; decorators between don't part them."""
    found = None
    for line in reversed(text[:start].split("\n")[:-1]):
        m = re.match(rf"\s*(?:{mark})\s?(.*?)(?:\*/)?\s*$", line)
        if m:
            found = m[1] or found
        elif not re.match(r"\s*(?:@|#\[)", line):
            break
    return found


def owners(spans: list[tuple[int, int, str]]) -> Callable[[int], str | None]:
    """Which of the spans (start, end, name) holds a place: the shortest. The spans' ends cut the text into stretches, each
    of which has one owner, so a place is looked up by a binary search."""
    ends = sorted({x for s, e, _ in spans for x in (s, e + 1)})
    starting: dict[int, list] = defaultdict(list)
    for s, e, name in spans:
        starting[s].append((e - s, e, name))
    held, names = [], []  # held: a heap of the spans that are open, the shortest first
    for at in ends:
        for x in starting[at]:
            heapq.heappush(held, x)
        while held and held[0][1] < at:
            heapq.heappop(held)
        names.append(held[0][2] if held else None)

    def owner(at: int) -> str | None:
        i = bisect_right(ends, at) - 1
        return names[i] if i >= 0 else None

    return owner


def scanner(rules: Patterns) -> Callable[[str, str], dict]:
    compiled = [(kind, re.compile(p, re.M)) for kind, p in rules.defs]

    def extract(path: str, text: str) -> dict:
        out, code = Collected(path), blanked(text, rules.comment)
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        line = lambda at: bisect_right(starts, at)
        mark = r"//[/!]?|/\*+!?|\*(?!/)" if rules.comment.startswith("//") else "#+|--+|%+|;+|'|\"|!"
        head = re.match(rf"(?:#![^\n]*\n)?\s*(?:{mark})\s*([^\n]*)", text)
        out.doc = short(head[1].removesuffix("*/")) if head else None
        spans: dict[int, tuple] = {}
        for kind, pattern in compiled:
            for m in pattern.finditer(code):
                g = m.groupdict()
                if g["name"] in CONTROL or m.start("name") in spans:
                    continue
                end = ENDS[rules.ends](code, m.start(), m.end("params") if g.get("params") is not None else m.end("name"))
                spans[m.start("name")] = (m.start(), end, kind, g, m)
        open_spans, placed = [], []
        for at in sorted(spans, key=lambda a: (spans[a][0], -spans[a][1])):
            start, end, kind, g, m = spans[at]
            open_spans = [o for o in open_spans if o[1] >= at]
            holders = [o for o in open_spans if o[2] in ("class", "interface", "enum", "struct", "record", "trait", "impl", "namespace")]
            containers, makes_method = [o[3] for o in holders], any(o[2] != "namespace" for o in holders)
            name = g["name"]
            if g.get("owner"):
                containers, makes_method = [*containers, *re.split(r"::|[.:]", g["owner"])], True
            open_spans.append((at, end, kind, name))
            if kind in ("impl", "namespace"):
                continue
            real = "method" if kind == "function" and makes_method else kind
            params = parameters(g["params"], rules.style) if g.get("params") is not None else []
            above = doc_above(text, start, mark)
            here = out.add(name, containers, real, line(at), line(min(end, max(len(text) - 1, 0))), params=params, returns=" ".join(g["returns"].split()) if g.get("returns") else None, exported=bool(re.search(rules.exported, m[0])), decorated=bool(re.search(r"^\s*(?:@|#\[)\S[^\n]*\s*$", text[:start].rstrip("\n").rsplit("\n", 1)[-1])) if start else False, doc=short(above))
            if kind in ("function",):
                placed.append((at, end, here))
        owner = owners(placed)
        for m in re.finditer(rules.call, code):
            name = re.sub(r"\s+|\?", "", m[1])
            last = re.split(r"::|->|\.", name)[-1]
            if (last != name or last not in KEYWORDS) and m.end(1) - len(last) not in spans:
                out.call(owner(m.start(1)), name, line(m.start(1)))
        if rules.refs:
            values = re.sub(r"^\s*import\b[^;\n]*", lambda m: " " * len(m[0]), code, flags=re.M)
            before = r"[(,\[=]" if rules.style == "ts" else r"[(,\[:=]"  # after a colon stand types there
            for m in re.finditer(before + r"\s*([A-Za-z_$][\w$]*)\s*(?=[,)\]}\n;])", values):
                out.refs.append({"caller_id": owner(m.start(1)), "name": m[1], "line": line(m.start(1))})
        out.imports = [{"name": n, "source": s} for n, s in rules.imports(text)]
        return vars(out)

    return extract


def js_imports(text: str) -> list[tuple[str, str]]:
    out = []
    for m in re.finditer(r"""^\s*import\s+(?:type\s+)?([^'"]+?)\s+from\s+['"]([^'"]+)['"]""", text, re.M):
        names = re.search(r"\{(.*?)\}", m[1], re.S)
        default = re.match(r"([\w$]+)", m[1])
        out += [(default[1], f"{m[2]}/{default[1]}")] if default else []
        for part in names[1].split(",") if names else []:
            name, _, alias = (x.strip() for x in part.partition(" as "))
            out += [(alias or name, f"{m[2]}/{name}")] if name else []
    return out


def rust_imports(text: str) -> list[tuple[str, str]]:
    def expand(prefix: str, tree: str) -> Iterator[tuple[str, str]]:
        depth, start, parts = 0, 0, []
        for i, c in enumerate(tree + ","):
            depth += (c == "{") - (c == "}")
            if c == "," and not depth:
                parts.append(tree[start:i].strip())
                start = i + 1
        for p in filter(None, parts):
            if p.endswith("}") and "{" in p:
                head, _, rest = p.partition("{")
                yield from expand(prefix + head, rest[:-1])
                continue
            path, _, alias = (x.strip() for x in p.partition(" as "))
            whole = (prefix + path).removesuffix("::self") if path == "self" or path.endswith("::self") else prefix + path
            if path != "*" and not path.endswith("::*"):
                yield alias or whole.split("::")[-1], whole

    return [x for m in re.finditer(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", text, re.M) for x in expand("", " ".join(m[1].split()))]


def last_part(pattern: str) -> Callable[[str], list[tuple[str, str]]]:
    """Imports by a pattern with a source and perhaps an alias: bound by the last segment."""

    def find(text: str) -> list[tuple[str, str]]:
        found = [(m.groupdict().get("alias"), m["source"]) for m in re.finditer(pattern, text, re.M)]
        return [(a or next((x for x in reversed(re.split(r"[./:]", s)) if x and x not in ("h", "hpp")), s), s) for a, s in found]

    return find


def go_imports(text: str) -> list[tuple[str, str]]:
    block = "\n".join(m[1] or m[2] for m in re.finditer(r"^import\s+(?:\(([^)]*)\)|([^\n]+))", text, re.M))
    return last_part(r'^\s*(?:(?P<alias>[\w.]+)\s+)?"(?P<source>[^"]+)"')(block)


NAME = r"(?P<name>[A-Za-z_$][\w$]*)"
PARAMS = r"\s*\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)"
C_FUNCTION = rf"^[ \t]*(?!return|else|typedef|new|delete|using)(?:[\w:<>,]+[\s*&]+)+(?:(?P<owner>[\w:]+)::)?~?{NAME}{PARAMS}\s*(?:const|noexcept|override)?\s*(?=\{{)"
JS_DEFS = (
    ("class", rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{NAME}"),
    ("interface", rf"^[ \t]*(?:export\s+)?interface\s+{NAME}"),
    ("enum", rf"^[ \t]*(?:export\s+)?(?:const\s+)?enum\s+{NAME}"),
    ("function", rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{NAME}\s*(?:<[^>(]*>)?{PARAMS}(?:\s*:\s*(?P<returns>[^{{\n]+))?"),
    ("function", rf"^[ \t]*(?:export\s+)?(?:const|let|var)\s+{NAME}\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\s*)?\((?P<params>[^()]*)\)(?:\s*:\s*(?P<returns>[^={{\n]+))?\s*(?:=>)?\s*(?=\{{|\S)"),
    ("function", rf"^[ \t]+(?:(?:public|private|protected|static|async|readonly|get|set|override)\s+)*{NAME}\s*(?:<[^>(]*>)?{PARAMS}(?:\s*:\s*(?P<returns>[^{{\n;]+))?\s*(?=\{{)"),
    ("variable", rf"^(?:export\s+)?(?:const|let)\s+{NAME}\s*(?::[^=\n]+)?=\s*(?!\s*(?:async\s*)?(?:\(|function))"),
)
LANGUAGES: list[Language] = [
    Language("python", ("py", "pyi"), python),
    Language("rust", ("rs",), scanner(Patterns((("impl", r"^[ \t]*impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<name>\w+)"), ("namespace", rf"^[ \t]*(?:pub\s+)?mod\s+{NAME}\s*(?=\{{)"), *((k, rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?{k}\s+{NAME}") for k in ("struct", "enum", "trait")), ("function", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|const|unsafe|extern)\s+)*fn\s+{NAME}\s*(?:<[^>(]*>)?{PARAMS}(?:\s*->\s*(?P<returns>[^{{;\n]+))?")), rust_imports, style="rust", exported=r"\bpub\b"))),
    Language("c", ("c", "h"), scanner(Patterns((("struct", rf"^[ \t]*(?:typedef\s+)?struct\s+{NAME}\s*(?=\{{)"), ("function", C_FUNCTION)), last_part(r'^\s*#\s*include\s*[<"](?P<source>[^>"]+)[>"]')))),
    Language("cpp", ("cpp", "cc", "cxx", "hpp", "hh", "hxx"), scanner(Patterns((("namespace", rf"^[ \t]*namespace\s+{NAME}"), *((k, rf"^[ \t]*{k}\s+{NAME}[^;{{()]*(?=\{{)") for k in ("struct", "class")), ("function", C_FUNCTION)), last_part(r'^\s*#\s*include\s*[<"](?P<source>[^>"]+)[>"]')))),
    Language("javascript", ("js", "jsx", "mjs", "cjs"), scanner(Patterns(JS_DEFS, js_imports, style="js", exported=r"\bexport\b", refs=True))),
    Language("typescript", ("ts", "mts", "cts"), scanner(Patterns(JS_DEFS, js_imports, style="ts", exported=r"\bexport\b", refs=True))),
    Language("tsx", ("tsx",), scanner(Patterns(JS_DEFS, js_imports, style="ts", exported=r"\bexport\b", refs=True))),
    Language("go", ("go",), scanner(Patterns((*((k, rf"^[ \t]*type\s+{NAME}\s+{k}\b") for k in ("struct", "interface")), ("function", rf"^func\s+(?:\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*)?{NAME}{PARAMS}(?P<returns>[^{{\n]*)(?=\{{)")), go_imports, style="go"))),
    Language("java", ("java",), scanner(Patterns((*((k, rf"^[ \t]*(?:(?:public|private|protected|static|final|abstract)\s+)*{k}\s+{NAME}") for k in ("class", "interface", "enum", "record")), ("function", rf"^[ \t]+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*(?:(?P<returns>[\w<>\[\], ?]+)\s+)?{NAME}{PARAMS}\s*(?:throws [\w, ]+)?(?=\{{|;)")), last_part(r"^\s*import\s+(?:static\s+)?(?P<source>[\w.]+)\s*;"), exported=r"(?!)"))),
    Language("ruby", ("rb", "rake"), scanner(Patterns((("class", rf"^[ \t]*class\s+{NAME}"), ("namespace", rf"^[ \t]*module\s+{NAME}"), ("function", rf"^[ \t]*def\s+(?:self\.)?{NAME}[?!]?(?:{PARAMS})?")), lambda text: [], comment=r"#[^\n]*", style="plain", ends="end"))),
]


# Languages that are read by general rules, by how a definition ends, and their suffixes.
GENERIC = {
    "brace": {
        "php": ("php",), "csharp": ("cs",), "kotlin": ("kt", "kts"), "swift": ("swift",), "scala": ("scala", "sc"), "perl": ("pl", "pm"), "r": ("r",), "dart": ("dart",), "zig": ("zig",), "gleam": ("gleam",), "groovy": ("groovy", "gradle"),
        "solidity": ("sol",), "bash": ("sh", "bash", "zsh"), "powershell": ("ps1",), "tcl": ("tcl",), "d": ("d",), "hare": ("ha",), "odin": ("odin",), "haxe": ("hx",), "nix": ("nix",), "vue": ("vue",), "svelte": ("svelte",),
    },
    "end": {"lua": ("lua",), "julia": ("jl",), "elixir": ("ex", "exs"), "fortran": ("f90", "f95"), "pascal": ("pas",), "ada": ("adb", "ads"), "crystal": ("cr",), "vim": ("vim",), "cmake": ("cmake",)},
    "indent": {"haskell": ("hs",), "erlang": ("erl", "hrl"), "ocaml": ("ml",), "ocaml_interface": ("mli",), "nim": ("nim",), "sql": ("sql",), "elm": ("elm",), "fsharp": ("fs",), "gdscript": ("gd",), "mojo": ("mojo",), "starlark": ("bzl",)},
    "bracket": {"clojure": ("clj",), "racket": ("rkt",), "scheme": ("scm",), "commonlisp": ("lisp",), "elisp": ("el",)},
}
WORDS_BEFORE = r"^[ \t(]*(?:(?:pub|public|private|protected|internal|static|final|abstract|async|override|open|local|export|inline|virtual|recursive|pure|sealed|data|create|or replace)\s+)*"
SYMBOL = r"(?:(?P<owner>[A-Za-z_]\w*(?:[.:]+[A-Za-z_]\w*)*?)(?:::|[.:]))?(?P<name>[A-Za-z_][\w?!'-]*)"
PLAIN = r"(?P<name>[A-Za-z_][\w.-]*)"


def generic(ends: str) -> Callable[[str, str], dict]:
    """An extractor by words that most languages share: what follows one that means a type or a function is defined. Where
    functions have no word, a name at the margin with parameters and a sign of a body defines one."""
    word = "-?" if ends == "bracket" else ""
    types = tuple((kind, rf"{WORDS_BEFORE}(?:{w})\s+{PLAIN}") for kind, w in (("interface", "interface|protocol"), ("struct", "struct|record"), ("trait", "trait"), ("class", "class|module|object|enum|contract|defmodule|namespace|impl")))
    functions = [("function", rf"{WORDS_BEFORE}(?:function|func|fun|fn|def{word}|defp|defn-?|defun|define|sub|proc|procedure|subroutine|method|macro)(?![\w-])!?\s*\(?\s*{SYMBOL}(?:{PARAMS})?")]
    if ends == "brace":
        functions.append(("function", rf"{WORDS_BEFORE}(?:[\w<>\[\]?,.]+\s+)+{NAME}{PARAMS}\s*(?=\{{)"))
        functions.append(("function", r"^[ \t]*(?P<name>[A-Za-z_][\w-]*)\s*\((?P<params>)\)\s*(?=\{)"))
    if ends == "indent":
        functions.append(("function", r"^(?P<name>[a-z_]\w*)(?:\((?P<params>[^()\n]*)\))?[^=:\n]*(?:->|(?<![:=])=(?!=))"))
    comment = r"//[^\n]*|/\*.*?\*/|(?<!\S)#[^\n]*" if ends == "brace" else r"(?<!\S)(?:#|--|%|;|!)[^\n]*"
    return scanner(Patterns((*types, *functions), last_part(r"^\s*(?:use|using|import|require|include|open|source|from)\s+[(\"']?(?P<source>[\w./:\\]+)"), comment=comment, style="plain", ends=ends, call=BRACKET_CALL if ends == "bracket" else CALL))


LANGUAGES += [Language(name, suffixes, generic(ends)) for ends, group in GENERIC.items() for name, suffixes in group.items()]


def register(language: Language) -> None:
    """Add a language, or replace the one of its name."""
    LANGUAGES[:] = [x for x in LANGUAGES if x.name != language.name] + [language]


def language_of(path: str) -> Language | None:
    suffix = path.rsplit(".", 1)[-1].lower()
    return next((x for x in LANGUAGES if suffix in x.suffixes), None)


def extract_file(path: str, data: bytes) -> dict:
    """One FILE_MAP row. What can't be read or parsed is a row with an error and no symbols."""
    import hashlib

    language = language_of(path)
    row = {"path": path, "language": language.name if language else None, "error": None, "doc": None, "content_hash": hashlib.sha256(data).hexdigest()[:16], "symbols": [], "calls": [], "refs": [], "imports": []}
    try:
        found = language.extract(path, data.decode("utf-8", "replace")) if language else {}
    except Exception as e:  # noqa: BLE001  whatever a file holds, it is a row
        return row | {"error": f"{type(e).__name__}: {e}"[:200]}
    return row | {k: found[k] for k in ("doc", "symbols", "calls", "refs", "imports") if k in found}


def extract(files: DataFrame, root: str | None = None) -> DataFrame:
    """FILE_MAP rows of ``files``: (path, content binary), or (path) with files read below ``root``, a folder that all
    executors see. One row of output per file, whatever happens to it."""
    arrow = to_arrow_schema(StructType.fromDDL(FILE_MAP))
    columns = ["path", "content"] if "content" in files.columns else ["path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    data = r["content"] if "content" in r else (Path(root) / r["path"]).read_bytes()
                    rows.append(extract_file(r["path"], data or b""))
                except OSError as e:
                    rows.append({"path": r["path"], "error": f"OSError: {e.strerror}", "content_hash": "unreadable", "symbols": [], "calls": [], "refs": [], "imports": []})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select(*columns).mapInArrow(run, FILE_MAP)


def tables(maps: DataFrame) -> dict[str, DataFrame]:
    """The engine's tables from FILE_MAP rows."""
    s = maps.select("path", "language", F.explode("symbols").alias("s")).select("path", "language", "s.*").withColumn("test", is_test_path(F.col("path")))
    return {
        "files": maps.select("path", "language", "error", "doc", "content_hash"),
        "symbols": s,
        "raw_calls": maps.select("path", F.explode("calls").alias("c")).select("path", "c.*"),
        "raw_refs": maps.select("path", F.explode("refs").alias("r")).select("path", "r.*").withColumn("receiver", F.lit(None).cast("string")),
        "imports": maps.select("path", F.posexplode("imports").alias("ordinal", "i")).select("path", "i.*", "ordinal"),
    }


def source_lines(files: DataFrame, root: str | None = None) -> DataFrame:
    """(path, line, text) of ``files``: (path, content), or (path) read below ``root`` by the executors. Bytes that are no
    UTF-8 are replaced; files that can't be read have no lines."""
    if "content" not in files.columns:
        from codeloom.sources.discover import contents

        files = contents(files, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("line", pa.int32()), ("text", pa.string())])
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                lines = (data or b"").decode("utf-8", "replace").splitlines()
                yield pa.RecordBatch.from_pydict({"path": [path] * len(lines), "line": range(1, len(lines) + 1), "text": lines}, schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, line int, text string")
