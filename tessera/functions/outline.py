"""The outline of a source file: its outermost definitions, who calls what, what it imports; one pass, with a stack of blocks.

Comments, strings and nesting are known, grammars are not: a definition is recognised by its keywords where a statement
begins, a call by a name before a parenthesis that isn't a definition's, a type's or a pattern's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: How files of a language are read; others have no outline.
BRACES = ["rust", "javascript", "typescript", "tsx", "go", "java", "c", "cpp", "kotlin", "swift", "php"]
_SCRIPTS = ("javascript", "typescript", "tsx")
#: Languages whose statements may end with a line.
_LINES = (*_SCRIPTS, "go", "kotlin", "swift")
_NESTED = ("rust", "kotlin", "swift")  # block comments within block comments

_NAME = r"[^\W\d][\w$]*"
_TOKEN = re.compile(rf"(?P<space>\s+)|(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<id>[#$@]?{_NAME}|\${_NAME}|\$)|(?P<num>\d[\w.]*)|(?P<op>::|->|=>|\?\.|==|!=|<=|>=|&&|\|\||\?\?|\.\.\.|.)", re.DOTALL)
_RAW = re.compile(r'b?r(#*)"')
_CPP_RAW = re.compile(r'(?:u8|[uUL])?R"([^()\\\s]{0,16})\(')
_CHAR = re.compile(r"b?'(?:\\[^\n]{1,10}?|[^\\'\n])'")
_QUOTED = {q: re.compile(rf"{q}(?:\\.|[^{q}\\\n])*{q}", re.DOTALL) for q in "\"'"}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_BEFORE_REGEX = ["return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield"]
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_NO_CALL = ["if", "for", "while", "switch", "return", "catch", "else", "do", "case", "new", "throw", "try", "as", "in", "const", "type", "static"]
_NO_CALL_IN = {
    "rust": ["match", "fn", "loop", "move", "unsafe", "async", "mut", "ref", "pub", "let", "extern", "where", "await", "dyn", "impl", "Fn", "FnMut", "FnOnce"],
    "go": ["func", "go", "defer", "select", "chan", "map", "range", "interface", "struct", "var"],
    "java": ["synchronized", "instanceof", "super", "this"],
    "c": ["sizeof", "alignof", "typeof", "defined", "__attribute__"],
    "kotlin": ["fun", "when", "is", "val", "var", "constructor"],
    "swift": ["func", "guard", "where", "is", "let", "var", "init"],
    "php": ["function", "fn", "foreach", "elseif", "match", "array", "list", "isset", "unset", "empty", "and", "or", "use"],
    "javascript": ["function", "typeof", "of", "await", "yield", "var", "let", "with", "delete", "void", "instanceof", "async"],
}
_ALIKE = {"typescript": "javascript", "tsx": "javascript", "cpp": "c"}
_LEADS = (".", "?.", "::", "->")
_GO_ON = [".", "?.", ",", "+", "-", "*", "/", "%", "=", "==", "!=", "<=", ">=", "&&", "||", "??", "?", ":", ")", "]", "}", "=>", "(", "[", "<", ">", "|", "&", "^", "instanceof", "in", "of", "as", "satisfies", "extends", "implements"]
_NOT_AN_END = ["return", "typeof", "new", "await", "case", "else", "in", "of", "extends", "implements", "from", "as"]


@dataclass
class Chunk:
    name: str | None
    kind: str
    start_line: int
    end_line: int
    visibility: str | None


@dataclass
class Outline:
    chunks: list[Chunk] = field(default_factory=list)
    calls: list[tuple[str, str]] = field(default_factory=list)  # function or <module>, callee
    imports: list[str] = field(default_factory=list)  # the statements' texts


@dataclass
class _Token:
    kind: str  # id, num, str, op
    text: str
    at: int
    line: int


def _block_end(source: str, at: int, nested: bool) -> int:
    depth, at = 1, at + 2
    while depth:
        close = source.find("*/", at)
        if close < 0:
            return len(source)
        inner = source.find("/*", at, close) if nested else -1
        depth, at = (depth + 1, inner + 2) if inner >= 0 else (depth - 1, close + 2)
    return at


def _string_end(source: str, at: int, language: str) -> int:
    """Where the string that begins at `at` ends; `at` if none does."""
    c = source[at]
    if language in ("rust", "cpp", "c") and c in "bruULR":
        if language == "rust" and (m := _RAW.match(source, at)):
            end = source.find('"' + m[1], m.end())
            return len(source) if end < 0 else end + 1 + len(m[1])
        if language == "cpp" and (m := _CPP_RAW.match(source, at)):
            end = source.find(f'){m[1]}"', m.end())
            return len(source) if end < 0 else end + len(m[1]) + 2
        if language == "rust" and source[at : at + 2] in ('b"', "b'"):
            return max(_string_end(source, at + 1, language), at)
        return at
    if c == "`" and language == "go":
        end = source.find("`", at + 1)
        return len(source) if end < 0 else end + 1
    if c == '"' and language in ("java", "kotlin", "swift") and source.startswith('"""', at):
        end = source.find('"""', at + 3)
        return len(source) if end < 0 else end + 3
    if c == '"' and language in ("rust", "php"):  # may span lines
        m = re.compile(r'"(?:\\.|[^"\\])*"', re.DOTALL).match(source, at)
        return m.end() if m else at
    if c == "'" and language == "rust":
        m = _CHAR.match(source, at)
        return m.end() if m else at
    if c in _QUOTED and (m := _QUOTED[c].match(source, at)):
        return m.end()
    return at


def lex(source: str, language: str) -> list[_Token]:
    """The tokens that count: names, numbers, strings, signs. What a template says between its braces is lexed too."""
    out: list[_Token] = []
    at, line, n = 0, 1, len(source)
    templates: list[int] = []  # depth of braces at which a template goes on
    depth = 0

    def template(at: int) -> int:
        """From inside a template: to its end, or behind the next opening of code."""
        while at < n and source[at] != "`":
            if source[at] == "\\":
                at += 1
            elif source.startswith("${", at):
                templates.append(depth)
                return at + 2
            at += 1
        return at + 1

    while at < n:
        c, begin = source[at], at
        if language in _SCRIPTS and (c == "`" or (c == "}" and templates and templates[-1] == depth)):
            if c == "}":
                templates.pop()
            at = template(at + 1)
            out.append(_Token("str", "``", begin, line))
            line += source.count("\n", begin, at)
            continue
        if c in "\"'`brRuUL" and (end := _string_end(source, at, language)) > at:
            out.append(_Token("str", source[at:end], at, line))
            line += source.count("\n", at, end)
            at = end
            continue
        if c == "/" and language in _SCRIPTS and not source.startswith(("//", "/*"), at):
            last = out[-1] if out else None
            if (last is None or (last.kind == "op" and last.text not in (")", "]", "}")) or last.text in _BEFORE_REGEX) and (m := _REGEX.match(source, at)):
                out.append(_Token("str", m[0], at, line))
                at = m.end()
                continue
        if c == "#" and (language in ("c", "cpp") and (not out or source[source.rfind("\n", 0, at) + 1 : at].isspace() or source[at - 1] == "\n" or at == 0)):
            while True:  # a preprocessor line, and those it goes on in
                end = source.find("\n", at)
                end = n if end < 0 else end
                goes_on = source[end - 1 : end] == "\\"
                line += 1 if end < n else 0
                at = min(n, end + 1)
                if not goes_on or at >= n:
                    break
            continue
        if c == "#" and language == "php" and not source.startswith("#[", at):
            at = n if (end := source.find("\n", at)) < 0 else end
            continue
        m = _TOKEN.match(source, at)
        kind, at = m.lastgroup, m.end()
        if kind == "block":
            at = _block_end(source, begin, language in _NESTED)
        elif kind in ("id", "num", "op"):
            out.append(_Token(kind, m[0], begin, line))
            depth += (m[0] == "{") - (m[0] == "}")
        line += source.count("\n", begin, at)
    return out


def _matched(tokens: list[_Token]) -> list[int]:
    """For each bracket the place of its other end (for an opening one without an end the last token)."""
    out, open_ = list(range(len(tokens))), []
    for i, t in enumerate(tokens):
        if t.kind == "op" and t.text in _PAIRS:
            open_.append(i)
        elif t.kind == "op" and t.text in ")]}":
            while open_ and _PAIRS[tokens[open_[-1]].text] != t.text:
                out[open_.pop()] = i
            if open_:
                out[i] = open_[-1]
                out[open_.pop()] = i
    for i in open_:
        out[i] = len(tokens) - 1
    return out


@dataclass
class _Found:
    """A definition: where its name's part ends, where it ends, what its block is."""

    name: str | None
    kind: str
    start: int
    after: int
    end: int
    visibility: str | None = None
    chunk: bool = True
    function: bool = False
    block: str = ""  # what its braces hold: members, types, or statements


class _Reader:
    def __init__(self, source: str, language: str):
        if language == "php":
            source = source.replace("<?php", "    ;", 1)
        self.source, self.language = source, language
        self.t = lex(source, language)
        self.n = len(self.t)
        self.match = [*_matched(self.t), *[self.n] * 8]  # what follows the last token has no other end
        self.no_call = {*_NO_CALL, *_NO_CALL_IN[_ALIKE.get(language, language)]}

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < self.n and self.t[i].kind != "str" else ""

    def name(self, i: int) -> bool:
        return 0 <= i < self.n and self.t[i].kind == "id"

    def slice(self, a: int, b: int) -> str:
        """The source from token a up to token b."""
        return self.source[self.t[a].at : self.t[b].at + len(self.t[b].text)] if a <= b < self.n else ""

    def angles(self, i: int) -> int:
        """Behind <...> if it begins at i, else i."""
        depth, j = 0, i
        while j < self.n and (depth or self.text(j) == "<"):
            depth += (self.text(j) == "<") - (self.text(j) == ">")
            j = self.match[j] + 1 if self.text(j) in _PAIRS else j + 1
        return j

    def body(self, i: int, stop: tuple[str, ...] = (";",)) -> tuple[int, bool]:
        """From i to the end of the next block, or to what stops the header before; and whether there is a block."""
        while i < self.n:
            s = self.text(i)
            if s == "{":
                return self.match[i], True
            if s in stop or s in (")", "]", "}"):
                return (i if s in stop else i - 1), False
            i = self.match[i] + 1 if s in _PAIRS else i + 1
        return self.n - 1, False

    def statement(self, i: int) -> int:
        """The last token of the statement at i: by a semicolon, by the end of its block, or by a line that can't go on."""
        while i < self.n:
            s = self.text(i)
            if s == ";":
                return i
            if s in (")", "]", "}"):
                return i - 1
            i = self.match[i] if s in _PAIRS else i
            if self.language in _LINES and self.ended(i):
                return i
            i += 1
        return self.n - 1

    def ended(self, i: int) -> bool:
        """Whether a statement may end with token i because the next one stands on another line."""
        if i + 1 >= self.n or self.t[i + 1].line == self.t[i].line + self.t[i].text.count("\n"):
            return False
        can_end = self.t[i].kind != "op" or self.text(i) in (")", "]", "}")
        follows = self.text(i + 1) in (_GO_ON if self.language != "go" else [])
        return can_end and self.text(i) not in _NOT_AN_END and not follows

    def begins(self, i: int) -> bool:
        """Whether a statement may begin with token i."""
        return i == 0 or self.text(i - 1) in (";", "{", "}") or (self.language in _LINES and self.ended(i - 1)) or (self.language == "rust" and self.text(i - 1) == "]") or (self.language == "cpp" and self.text(i - 1) == ":" and self.text(i - 2) in ("public", "private", "protected"))

    # -- definitions, by language

    def definition(self, i: int, block: str) -> _Found | None:
        if self.language == "rust":
            return self.rust(i)
        if self.language in _SCRIPTS:
            return self.script(i, block)
        if self.language == "go":
            return self.go(i)
        if self.language in ("c", "cpp"):
            return self.c(i, block)
        return self.managed(i, block)

    def rust(self, i: int) -> _Found | None:
        start, seen = i, None
        if self.text(i) == "pub":
            i = self.match[i + 1] + 1 if self.text(i + 1) == "(" else i + 1
            seen = re.sub(r"\s+", "", self.slice(start, i - 1))
        while self.text(i) in ("async", "unsafe", "default", "extern") or (self.text(i) == "const" and self.text(i + 1) in ("fn", "async", "unsafe", "extern")):
            i += 2 if self.text(i) == "extern" and i + 1 < self.n and self.t[i + 1].kind == "str" else 1
        word = self.text(i)
        if word == "impl":
            a = self.angles(i + 1)
            end, has = self.body(a)
            b = next((j for j in range(a, end + 1) if self.text(j) in ("{", "where")), end)
            if not has:
                return None
            return _Found(re.sub(r"\s+", " ", self.slice(a, b - 1)), "impl", start, b, end, seen, block="members")
        kinds = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "mod": "module", "const": "const", "type": "type"}
        if word not in kinds or not self.name(i + 1):
            return None
        name = self.text(i + 1)
        if word in ("const", "type"):
            return _Found(name, kinds[word], start, i + 2, self.statement(i), seen)
        end, has = self.body(i + 2)
        if word == "struct" and not has:
            end = self.statement(i)
        if word == "fn":
            return _Found(name, "function", start, self.angles(i + 2), end, seen, chunk=has, function=True)
        return _Found(name, kinds[word], start, i + 2, end, seen, block={"struct": "types", "enum": "types", "trait": "members", "mod": ""}[word])

    def script(self, i: int, block: str) -> _Found | None:
        start, exported = i, self.text(i) == "export"
        if block == "members":
            return self.member(i)
        if exported:
            i += 2 if self.text(i + 1) == "default" else 1
        while self.text(i) in ("async", "abstract", "declare") and self.name(i + 1):
            i += 1
        word = self.text(i)
        abstract = not exported and any(self.text(j) in ("abstract", "declare") for j in range(start, i))
        if word == "function":
            star = self.text(i + 1) == "*"
            at = i + 1 + star
            name = self.text(at) if self.name(at) else None
            end, has = self.body(self.match[self.angles(at + 1)] + 1 if name else self.match[at] + 1)
            if not name and not exported:
                return None
            return _Found(name, "export" if exported else "function", start, self.angles(at + 1) if name else at, end, chunk=has and (exported or not star), function=has and name is not None and not star)
        if word in ("class", "interface", "enum", "namespace", "module") and self.name(i + 1) and not (word == "module" and self.text(i + 1) == "."):
            end, has = self.body(i + 2)
            if has:
                kind = {"class": "members", "interface": "types", "enum": "types"}.get(word, "")
                name = self.text(i + 1) if word == "class" and not abstract else None
                return _Found(name if exported else self.text(i + 1), "export" if exported else word, start, i + 2, end, chunk=exported or (word == "class" and not abstract), block=kind)
        if word in ("const", "let") and (self.name(i + 1) or self.text(i + 1) in ("{", "[")):
            if word == "const" and self.text(i + 1) == "enum":
                return None
            end = self.statement(i)
            name = self.text(i + 1) if self.name(i + 1) else self.slice(i + 1, self.match[i + 1])
            return _Found(name, "export" if exported else "const", start, i + 2 if self.name(i + 1) else self.match[i + 1] + 1, end)
        if exported:
            return _Found(None, "export", start, start + 1, self.statement(start))
        return None

    def member(self, i: int) -> _Found | None:
        """A method: a name, parentheses, a block."""
        start = i
        while self.text(i) in ("static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "*") and self.text(i + 1) not in ("(", "=", ":", ";", "?"):
            i += 1
        if self.text(i) == "[":
            at, name = self.match[i] + 1, self.slice(i, self.match[i])
        elif self.name(i) or (i < self.n and self.t[i].kind == "str"):
            at, name = i + 1, self.t[i].text
        else:
            return None
        at = self.angles(at + (self.text(at) == "?"))
        if self.text(at) != "(":
            return None
        end, has = self.body(self.match[at] + 1)
        return _Found(name, "function", start, at, end, chunk=False, function=has)

    def go(self, i: int) -> _Found | None:
        if self.text(i) == "func":
            at = self.match[i + 1] + 1 if self.text(i + 1) == "(" else i + 1
            if not self.name(at):
                return None
            params = at + 1 if self.text(at + 1) == "(" else (self.match[at + 1] + 1 if self.text(at + 1) == "[" else at + 1)
            end, line = self.match[params], self.t[min(self.match[params], self.n - 1)].line
            j = end + 1
            while j < self.n and self.t[j].line == line:  # results, then the block
                if self.text(j) == "{":
                    if self.text(j - 1) in ("interface", "struct"):
                        j = self.match[j] + 1
                        continue
                    end = self.match[j]
                    break
                j = self.match[j] + 1 if self.text(j) in _PAIRS else j + 1
                end = j - 1
            return _Found(self.text(at), "function", i, params, end, function=True)
        if self.text(i) == "type" and (self.name(i + 1) or self.text(i + 1) == "("):
            end = self.statement(i + 1)
            return _Found(self.text(i + 1) if self.name(i + 1) else None, "type", i, i + 2 if self.name(i + 1) else i + 1, end, block="types")
        return None

    def c(self, i: int, block: str) -> _Found | None:
        start = i
        if self.text(i) == "template":
            i = self.angles(i + 1)
        if self.text(i) == "extern" and i + 2 < self.n and self.t[i + 1].kind == "str" and self.text(i + 2) == "{":
            return _Found(None, "", start, i + 2, self.match[i + 2], chunk=False)
        j = i
        while self.text(j) in ("static", "const", "typedef", "inline", "constexpr", "extern", "volatile"):
            j += 1
        if self.text(j) == "namespace" or (self.text(j) == "enum" and self.language == "cpp"):
            end, has = self.body(j + 1)
            if has:
                return _Found(None, "", start, j + 1, end, chunk=False, block="types" if self.text(j) == "enum" else "")
        if self.text(j) in ("struct", "class", "union") and self.name(j + 1):
            end, has = self.body(j + 2, (";", "(", "=", ","))
            if has and (self.text(j) != "class" or self.language == "cpp"):
                return _Found(self.text(j + 1), self.text(j), j, j + 2, end, chunk=self.text(j) != "union", block="members" if self.language == "cpp" else "types")
        # a type, a name, parentheses, a block; without a block it is a declaration, whose parentheses call nothing
        k, name = j, None
        while k < self.n and self.text(k) not in ("(", ";", "=", "{", "}", ",", ")"):
            if self.text(k) in self.no_call and self.text(k) not in ("const", "static", "type"):
                return None
            if self.name(k):
                name = k
            k = self.angles(k) if self.text(k) == "<" else k + 1
        if self.text(k) != "(" or name is None or name != k - 1:
            return None
        typed = name > j and not (name - 1 == j and self.text(j) == "~")
        member = block == "members" or self.text(name - 1) in ("::", "~")
        if not (typed or member):
            return None
        end, has = self.body(self.match[k] + 1)
        said = self.text(name)
        if has:
            return _Found(said, "function", start, self.match[end], end, function=True)
        if typed and block in ("", "members", "types") and self.text(name - 1) not in (".", "->", "::"):
            return _Found(said, "declaration", start, k, k, chunk=False)
        return None

    def managed(self, i: int, block: str) -> _Found | None:
        """Java, Kotlin, Swift and PHP: modifiers and annotations, then a keyword and a name, or in Java a method."""
        start, seen = i, None
        modifiers = ["public", "private", "protected", "internal", "open", "fileprivate", "static", "final", "abstract", "sealed", "data", "override", "suspend", "synchronized", "native", "default", "strictfp", "transient", "volatile", "inline", "mutating", "non", "-"]
        while self.text(i) in modifiers or (self.text(i).startswith("@") and self.text(i + 1) != "interface"):
            seen = seen or (self.text(i) if self.text(i) in ("public", "private", "protected", "internal", "open", "fileprivate") else None)
            i += 1
            while self.text(i) == "." and self.name(i + 1):
                i += 2
            if self.text(i) == "(" and self.text(i - 1) not in modifiers:
                i = self.match[i] + 1
        word = self.text(i)
        if word in ("class", "interface", "enum", "record", "trait", "object", "protocol", "struct", "extension") and self.name(i + 1):
            end, has = self.body(i + 2)
            kind = word if has else None
            if has:
                matched = word in ("class", "interface") or self.language != "java"
                return _Found(self.text(i + 1), kind, start, i + 2, end, seen, chunk=matched, block="members")
        if word in ("fun", "func", "function") and self.language != "java" and self.name(self.angles(i + 1)):
            at = self.angles(i + 1)
            while self.text(at + 1) == "." and self.name(at + 2):
                at += 2
            params = self.angles(at + 1)
            end, has = self.body(self.match[params] + 1) if self.text(params) == "(" else (at, False)
            if self.language == "kotlin" and not has:
                end = self.statement(params)
            return _Found(self.text(at), "function", start, params, end, seen, function=True)
        if self.language == "java" and block == "members":
            at = self.angles(i)
            while at < self.n and (self.name(at) or self.text(at) in (".", "[", "]", "...", "?")) and self.text(at + 1) != "(":
                at = self.angles(at + 1) if self.text(at + 1) == "<" else at + 1
            if self.name(at) and self.text(at + 1) == "(" and self.text(at) not in self.no_call:
                end, has = self.body(self.match[at + 1] + 1)
                return _Found(self.text(at), "function", start, self.match[end] if has else at + 1, end, seen, chunk=at > i, function=has)
        return None

    # -- imports and calls

    def imported(self, i: int) -> int | None:
        """The last token of an import that begins at i."""
        s = self.text(i)
        if self.language == "rust":
            j = i
            if s == "pub":
                j = self.match[i + 1] + 1 if self.text(i + 1) == "(" else i + 1
            return self.statement(j) if self.text(j) == "use" else None
        if s == "import" and self.language in (*_SCRIPTS, "go", "java", "kotlin", "swift") and self.text(i + 1) not in ("(", ".") or (s == "import" and self.language == "go"):
            return self.match[i + 1] if self.text(i + 1) == "(" else self.statement(i)
        if s == "use" and self.language == "php":
            return self.statement(i)
        return None

    def callee(self, i: int) -> str | None:
        """What is called by the parenthesis at i: names, and what leads to them."""
        j = i - 1
        if self.text(j) == ">":  # generic arguments
            before = self.before_angles(j)
            if before is None:
                return None
            j = before
            if self.language in _SCRIPTS:  # types of arguments aren't part of what is called
                return self.led(j, j)
        last = i - 1
        if self.language == "rust" and self.text(j) == "!" and self.name(j - 1):
            j, last = j - 1, j - 1
        return self.led(j, last)

    def before_angles(self, j: int) -> int | None:
        """The token before the <...> that ends at j; None if it isn't a list of arguments."""
        depth, k = 0, j
        while k >= 0 and (self.name(k) or self.text(k) in ("<", ">", ",", "::", "&", ".", "[", "]", "?", "*")):
            depth += (self.text(k) == ">") - (self.text(k) == "<")
            if not depth:
                break
            k -= 1
        if depth or k <= 0 or not (self.text(k - 1) == "::" or self.name(k - 1)):
            return None
        return k - 1 - (self.text(k - 1) == "::")

    def led(self, j: int, last: int) -> str | None:
        """The name at j with what leads to it, up to token `last`."""
        if not self.name(j) or (self.text(j) in self.no_call and self.text(j - 1) not in _LEADS) or (self.text(j).startswith("@") and self.language not in _SCRIPTS):
            return None
        while self.text(j - 1) in _LEADS:
            k = j - 2
            if self.text(k) in ("?", "!"):
                k -= 1
            while k > 0 and self.text(k) in (")", "]") and self.match[k] < k:
                k = self.match[k] - 1
                if self.text(k) == "?":
                    k -= 1
                if self.text(k) == ">" and (before := self.before_angles(k)) is not None:
                    k = before
            if k >= 0 and (self.name(k) or self.t[k].kind in ("str", "num") or self.text(k) in ("(", "[")):
                j = k
            elif k + 1 < j and self.text(k + 1) in ("(", "["):
                j = k + 1
                break
            else:
                break
        if self.text(j - 1) in ("new", "fn", "function", "func", "fun"):
            return None
        said = self.slice(j, last)
        path = said.split("::")
        return "::".join(path[-2:]).lstrip("@") if len(path) > 2 else said.lstrip("@")

    def pattern(self, i: int) -> bool:
        """Whether the parentheses at i belong to a pattern (Rust)."""
        after = self.text(self.match[i] + 1)
        return self.language == "rust" and after in ("=>", "=", "|", "if")

    def read(self) -> Outline:
        out = Outline()
        scopes: list[tuple[int, str | None, str]] = []  # last token, function, what its block holds
        outermost, skip, i = -1, -1, 0
        while i < self.n:
            while scopes and i > scopes[-1][0]:
                scopes.pop()
            s = self.text(i)
            if self.language == "rust" and s == "#" and self.text(i + 1) in ("[", "!"):
                at = i + 1 + (self.text(i + 1) == "!")
                i = self.match[at] + 1 if self.text(at) == "[" else i + 1
                continue
            if self.begins(i) and (self.name(i) or s in ("*", "[", "~") or (self.t[i].kind == "str" and scopes and scopes[-1][2] == "members")):
                end = self.imported(i)
                if end is not None:
                    out.imports.append(self.slice(i, end))
                    i = end + 1
                    continue
                found = self.definition(i, scopes[-1][2] if scopes else "")
                if found is not None:
                    if found.chunk and i > outermost:
                        out.chunks.append(Chunk(found.name, found.kind, self.t[found.start].line, self.last_line(found.end), found.visibility))
                        outermost = found.end
                    within = scopes[-1][1] if scopes else None
                    if found.kind != "declaration":
                        scopes.append((found.end, found.name if found.function else within, found.block))
                    i = found.after
                    if self.text(i) == "(":
                        skip = i
                    continue
            if s == "{" and scopes and i > 0:
                # an inner block holds statements; the block of a definition holds what that says
                if not (scopes[-1][0] == self.match[i]):
                    scopes.append((self.match[i], scopes[-1][1], "types" if scopes[-1][2] == "types" else ""))
            elif s in ("(", "[", "{") and i != skip:
                macro = self.language == "rust" and self.text(i - 1) == "!" and self.name(i - 2)
                types = bool(scopes) and scopes[-1][2] == "types"
                if macro or (s == "(" and not types):
                    if s == "(" and not macro and self.pattern(i):
                        i = self.match[i] + 1
                        continue
                    name = self.callee(i)
                    if name:
                        out.calls.append((next((f for _, f, _ in reversed(scopes) if f), None) or "<module>", name))
                    if macro and name:
                        i = self.match[i] + 1
                        continue
            i += 1
        return out

    def last_line(self, i: int) -> int:
        t = self.t[min(i, self.n - 1)]
        return t.line + t.text.count("\n")


def outline(source: str | None, language: str) -> Outline:
    """The outline of a file in one of BRACES; what doesn't lex as the language gives less, never an error."""
    return _Reader(source or "", language).read()
