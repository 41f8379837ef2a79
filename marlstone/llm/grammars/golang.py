"""A recursive-descent recogniser for Go source files: tokens with automatic semicolons, then the published grammar.

As in the ECMAScript recogniser, a line whose shape was accepted before as a whole statement is taken at once.
"""

from __future__ import annotations

import re

KEYWORDS = frozenset("""break case chan const continue default defer else fallthrough for func go goto if import interface map package range return
select struct switch type var""".split())
ENDERS = frozenset(["i", "n", "s", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())

_ESC = r"""\\(?:[abfnrtv\\]|[0-3][0-7]{2}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U00(?:0[0-9a-fA-F]|10)[0-9a-fA-F]{4}|%s)"""
_NUMBER = r"0[xX](?:_?[0-9a-fA-F])+(?:\.(?:[0-9a-fA-F](?:_?[0-9a-fA-F])*)?)?(?:[pP][+-]?\d+)?i?|0[bB](?:_?[01])+i?|0[oO](?:_?[0-7])+i?|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?i?"
#: One token, with what follows a number at once, or one character that is none; the blanks after it are skipped.
_TOKEN = re.compile(
    r"([^\W\d]\w*|\n|//[^\n]*|/\*[\s\S]*?\*/"
    rf"|(?>{_NUMBER})\w*"
    rf"|\"(?:[^\"\\\n]|{_ESC % chr(34)})*\"|`[^`]*`|'(?:[^'\\\n]|{_ESC % chr(39)})'"
    r"|<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[\s\S])[ \t\r]*"
)
_WHOLE_NUMBER = re.compile(_NUMBER)
_SIGNS = frozenset("<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ - + * / % & | ^ < > = ! ( ) [ ] { } , ; . : ~".split())
_OPEN = {"(": ")", "[": "]", "{": "}"}
_CLOSE = frozenset(_OPEN.values())


class Bad(ValueError):
    pass


#: token -> its kind, else the kind by its first character.
_FIXED = {w: w for w in (*KEYWORDS, *_SIGNS)} | dict.fromkeys(" \t\r", "") | {"\n": "\n"}
_FIRST = dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_", "i")


def _kind(w: str) -> str:
    """A line's end for what holds one, nothing for other comments."""
    c = w[0]
    if w[:2] == "//":
        return ""
    if w[:2] == "/*":
        return "\n" if "\n" in w else ""
    if c in "\"`'" and len(w) > 1:
        return "n" if c == "'" else "s"
    if c == "." or c.isdecimal():
        if _WHOLE_NUMBER.fullmatch(w) is None:
            raise Bad("number")
        if len(w) > 1 and c == "0" and w.isdigit() and set(w) & set("89"):
            raise Bad("octal")
        return "n"
    if not c.isalnum():
        raise Bad("character")
    return "i"


_KNOWN: set[str] = set()


def _lex(text: str, limit: int | None = None) -> tuple[list[str], list[str], dict[int, int], list[tuple[int, int]], bool]:
    """Tokens, matching brackets, lines, and whether the text was read to its end; with a limit about so many tokens are read."""
    kinds: list[str] = []
    words: list[str] = []
    close: dict[int, int] = {}
    stack: list[int] = []
    lines: list[tuple[int, int]] = []
    fixed, first = _FIXED.get, _FIRST.get
    pos, begin = 0, 0
    if text.startswith("﻿"):
        pos = 1
    if "\0" in text or "﻿" in text[1:]:
        raise Bad("character")
    found = _TOKEN.findall(text, pos) if limit is None else (m[1] for m in _TOKEN.finditer(text, pos))
    for w in found:
        if limit is not None and len(kinds) > limit:
            return kinds, words, close, lines, False
        k = fixed(w)
        if k is None:
            k = first(w[0]) or _kind(w)
        if not k:
            continue
        if k == "\n":
            if kinds and kinds[-1] in ENDERS:
                kinds.append(";")
                words.append("\n")
            if len(kinds) > begin:
                lines.append((begin, len(kinds)))
                begin = len(kinds)
            continue
        if k in _OPEN:
            stack.append(len(kinds))
        elif k in _CLOSE:
            if not stack or _OPEN[kinds[stack[-1]]] != k:
                raise Bad("bracket")
            close[stack.pop()] = len(kinds)
        kinds.append(k)
        words.append(w)
    if stack:
        raise Bad("bracket")
    if kinds and kinds[-1] in ENDERS:
        kinds.append(";")
        words.append("\n")
    if len(kinds) > begin:
        lines.append((begin, len(kinds)))
    return kinds, words, close, lines, True


class Parser:
    """Over the first tokens of a text only, the parser runs out of them (IndexError, KeyError) unless it refuses before."""

    def __init__(self, tokens: tuple[list[str], list[str], dict[int, int], list[tuple[int, int]], bool]):
        self.k, self.w, self.close, lines, whole = tokens
        if whole:
            self.k.append("eof")
            self.w.append("")
        self.p = 0
        self.level = 0  # below 0: a brace begins a block, not a composite literal
        self.fn = 0
        self.line: dict[int, tuple[str, int]] = {}
        for a, b in lines:
            if self.k[b - 1] == ";" and b - a <= 60:
                self.line[a] = (" ".join(self.k[a:b]), b)

    def bad(self):
        raise Bad(f"token {self.p} {self.w[self.p]!r}")

    def eat(self, k: str) -> bool:
        if self.k[self.p] == k:
            self.p += 1
            return True
        return False

    def need(self, k: str) -> None:
        if self.k[self.p] != k:
            self.bad()
        self.p += 1

    def end(self) -> None:
        """A semicolon, or the closer it may be left out before."""
        if not self.eat(";") and self.k[self.p] not in (")", "}"):
            self.bad()

    def attempt(self, f) -> bool:
        p, level = self.p, self.level
        try:
            f()
            return True
        except Bad:
            self.p, self.level = p, level
            return False

    # -- files and declarations
    def file(self) -> None:
        self.need("package")
        self.need("i")
        self.top_end()
        while self.k[self.p] == "import":
            self.p += 1
            self.group(self.import_spec)
            self.top_end()
        while self.k[self.p] != "eof":
            k = self.k[self.p]
            if k == "func":
                self.func_decl()
            elif k in ("var", "const", "type"):
                self.declaration()
            else:
                self.bad()
            self.top_end()

    def top_end(self) -> None:
        if self.k[self.p] != "eof":
            self.need(";")

    def group(self, spec) -> None:
        if self.eat("("):
            while not self.eat(")"):
                spec()
                self.end()
        else:
            spec()

    def import_spec(self) -> None:
        if self.k[self.p] in ("i", "."):
            self.p += 1
        self.need("s")

    def declaration(self) -> None:
        k = self.k[self.p]
        self.p += 1
        self.group({"var": self.var_spec, "const": self.const_spec, "type": self.type_spec}[k])

    def names(self) -> None:
        self.need("i")
        while self.eat(","):
            self.need("i")

    def var_spec(self) -> None:
        self.names()
        if self.k[self.p] != "=":
            self.type()
        if self.eat("="):
            self.expressions()

    def const_spec(self) -> None:
        self.names()
        if self.k[self.p] not in ("=", ";", ")"):
            self.type()
            if self.k[self.p] != "=":
                self.bad()
        if self.eat("="):
            self.expressions()

    def type_spec(self) -> None:
        self.need("i")
        if self.k[self.p] == "[" and self.k[self.p + 1] == "i" and self.attempt(self.type_params_then_type):
            return
        self.eat("=")
        self.type()

    def type_params_then_type(self) -> None:
        self.type_params()
        self.eat("=")
        self.type()

    def type_params(self) -> None:
        self.need("[")
        while not self.eat("]"):
            self.names()
            self.constraint()
            if self.k[self.p] != "]":
                self.need(",")

    def constraint(self) -> None:
        while True:
            self.eat("~")
            self.type()
            if not self.eat("|"):
                return

    def func_decl(self) -> None:
        self.need("func")
        if self.k[self.p] == "(":
            self.params()
        self.need("i")
        if self.k[self.p] == "[":
            self.type_params()
        self.signature()
        if self.k[self.p] == "{":
            self.body()

    def signature(self) -> None:
        self.params()
        if self.k[self.p] == "(":
            self.params()
        else:
            self.attempt_type()

    def attempt_type(self) -> None:
        if self.k[self.p] in ("i", "*", "[", "map", "chan", "func", "struct", "interface", "<-", "("):
            self.type()

    def params(self) -> None:
        self.need("(")
        named = plain = 0
        groups = 0
        while not self.eat(")"):
            # name Type, name ...Type, or Type; a name alone waits for a later type.
            if self.k[self.p] == "i" and self.k[self.p + 1] not in (",", ")", "."):
                if self.k[self.p + 1] == "[":
                    p = self.p
                    if self.attempt(self.lone_type):
                        plain += 1
                    else:
                        self.p = p + 1
                        self.type()
                        named += 1
                else:
                    self.p += 1
                    self.eat("...")
                    self.type()
                    named += 1
            else:
                if self.k[self.p] == "i" and self.k[self.p + 1] in (",", ")"):
                    self.p += 1
                    groups += 1
                else:
                    self.eat("...")
                    self.type()
                    plain += 1
            if self.k[self.p] != ")":
                self.need(",")
        if named and plain:
            self.bad()

    def lone_type(self) -> None:
        self.type()
        if self.k[self.p] not in (",", ")"):
            self.bad()

    # -- types
    def type(self) -> None:
        k = self.k[self.p]
        if k == "i":
            self.p += 1
            if self.eat("."):
                self.need("i")
            if self.k[self.p] == "[" and self.k[self.p + 1] != "]":
                self.attempt(self.type_args)
        elif k == "*":
            self.p += 1
            self.type()
        elif k == "(":
            self.p += 1
            self.type()
            self.need(")")
        elif k == "[":
            self.p += 1
            if not self.eat("]"):
                if not self.eat("..."):
                    save, self.level = self.level, 1
                    self.expression()
                    self.level = save
                self.need("]")
            self.type()
        elif k == "map":
            self.p += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif k == "chan":
            self.p += 1
            self.eat("<-")
            self.type()
        elif k == "<-":
            self.p += 1
            self.need("chan")
            self.type()
        elif k == "func":
            self.p += 1
            self.signature()
        elif k == "struct":
            self.p += 1
            self.need("{")
            while not self.eat("}"):
                self.field()
                self.end()
        elif k == "interface":
            self.p += 1
            self.need("{")
            while not self.eat("}"):
                if self.k[self.p] == "i" and self.k[self.p + 1] == "(":
                    self.p += 1
                    self.signature()
                else:
                    self.constraint()
                self.end()
        else:
            self.bad()

    def type_args(self) -> None:
        self.need("[")
        self.type()
        while self.eat(","):
            if self.k[self.p] == "]":
                break
            self.type()
        self.need("]")

    def field(self) -> None:
        if self.k[self.p] == "*" or self.k[self.p] == "i" and self.k[self.p + 1] in (";", "}", ".", "s"):
            self.eat("*")
            self.need("i")
            if self.eat("."):
                self.need("i")
            if self.k[self.p] == "[":
                self.type_args()
        elif self.k[self.p] == "i" and self.k[self.p + 1] == "[" and self.attempt(self.embedded_generic):
            pass
        else:
            self.names()
            self.type()
        self.eat("s")

    def embedded_generic(self) -> None:
        self.p += 1
        self.type_args()
        if self.k[self.p] not in (";", "}", "s"):
            self.bad()

    # -- statements
    def body(self) -> None:
        save, self.level = self.level, 0
        self.fn += 1
        self.block()
        self.fn -= 1
        self.level = save

    def block(self) -> None:
        self.need("{")
        self.statements()
        self.need("}")

    def statements(self) -> None:
        while self.k[self.p] not in ("}", "case", "default", "eof"):
            line = self.line.get(self.p) if self.level == 0 else None
            if line is not None and line[0] in _KNOWN:
                self.p = line[1]
                continue
            self.statement()
            if not self.eat(";") and self.k[self.p] not in ("}", "case", "default"):
                self.bad()
            if line is not None and self.p == line[1] and len(_KNOWN) < 100_000:
                _KNOWN.add(line[0])

    def statement(self) -> None:
        k = self.k[self.p]
        if k in ("var", "const", "type"):
            self.declaration()
        elif k == "{":
            self.block()
        elif k == "if":
            self.if_()
        elif k == "for":
            self.for_()
        elif k == "switch":
            self.switch()
        elif k == "select":
            self.p += 1
            self.need("{")
            while not self.eat("}"):
                if not self.eat("default"):
                    self.need("case")
                    self.simple()
                self.need(":")
                self.statements()
        elif k == "return":
            self.p += 1
            if self.k[self.p] not in (";", "}"):
                self.expressions()
        elif k in ("break", "continue", "goto"):
            self.p += 1
            self.eat("i")
        elif k == "fallthrough":
            self.p += 1
        elif k in ("go", "defer"):
            self.p += 1
            a = self.p
            self.expression()
            if self.k[self.p - 1] != ")" or self.k[a] == "(" and self.close[a] == self.p - 1:
                self.bad()
        elif k == ";":
            return
        elif k == "i" and self.k[self.p + 1] == ":":
            self.p += 2
            if self.k[self.p] not in ("}", "case", "default"):
                self.statement()
        else:
            self.simple()

    def simple(self, ranging: bool = False) -> str:
        """simple statement; says range where a range clause stood."""
        if ranging and self.eat("range"):
            self.expression()
            return "range"
        a = self.p
        n = self.expressions()
        k = self.k[self.p]
        if k in ASSIGN:
            if n > 1 and k not in ("=", ":="):
                self.bad()
            if k == ":=":
                for i in range(a, self.p):
                    if (i - a) % 2 == 0 and self.k[i] != "i" or (i - a) % 2 and self.k[i] != ",":
                        self.bad()
            self.p += 1
            if ranging and self.eat("range"):
                self.expression()
                return "range"
            if k == ":=" and self.level < 0 and self.k[self.p] != "eof":
                pass
            self.expressions()
            return "assign"
        if n > 1:
            self.bad()
        if k in ("++", "--"):
            self.p += 1
            return "step"
        if k == "<-":
            self.p += 1
            self.expression()
            return "send"
        return "expr"

    def if_(self) -> None:
        self.need("if")
        save, self.level = self.level, -1
        kind = "none"
        if self.k[self.p] == "{":
            self.bad()
        if self.k[self.p] != ";":
            kind = self.simple()
        if self.eat(";"):
            kind = self.simple()
        if kind != "expr":
            self.bad()
        self.level = save
        self.block()
        if self.eat("else"):
            if self.k[self.p] == "if":
                self.if_()
            else:
                self.block()

    def for_(self) -> None:
        self.need("for")
        save, self.level = self.level, -1
        if self.k[self.p] != "{":
            kind = "none"
            if self.k[self.p] != ";":
                kind = self.simple(True)
            if kind != "range" and self.k[self.p] == ";":
                self.p += 1
                if self.k[self.p] != ";":
                    if self.k[self.p] == "{":
                        self.bad()
                    if self.simple() != "expr":
                        self.bad()
                self.need(";")
                if self.k[self.p] != "{":
                    self.simple()
            elif kind not in ("range", "expr"):
                self.bad()
        self.level = save
        self.block()

    def switch(self) -> None:
        self.need("switch")
        save, self.level = self.level, -1
        if self.k[self.p] != "{":
            if self.k[self.p] != ";":
                self.simple()
            if self.eat(";") and self.k[self.p] != "{":
                self.simple()
        self.level = save
        self.need("{")
        while not self.eat("}"):
            if not self.eat("default"):
                self.need("case")
                self.type_or_expression()
                while self.eat(","):
                    self.type_or_expression()
            self.need(":")
            inner, self.level = self.level, 0
            self.statements()
            self.level = inner

    # -- expressions
    def expressions(self) -> int:
        n = 1
        self.expression()
        while self.eat(","):
            self.expression()
            n += 1
        return n

    def type_or_expression(self) -> None:
        if self.k[self.p] in ("[", "map", "chan", "struct", "interface", "func"):
            self.operand_tail()
            self.binary_tail(0)
        else:
            self.expression()

    def expression(self) -> None:
        self.binary(0)

    def binary(self, least: int) -> None:
        self.unary()
        self.binary_tail(least)

    def binary_tail(self, least: int) -> None:
        while True:
            level = BINARY.get(self.k[self.p])
            if level is None or level <= least:
                return
            self.p += 1
            self.binary(level)

    def unary(self) -> None:
        k = self.k[self.p]
        if k in ("+", "-", "!", "^", "&", "*", "~"):
            self.p += 1
            self.unary()
        elif k == "<-":
            if self.k[self.p + 1] == "chan":
                self.operand_tail()
            else:
                self.p += 1
                self.unary()
        else:
            self.operand_tail()

    def operand_tail(self) -> None:
        k = self.k[self.p]
        literal = False
        if k == "i":
            self.p += 1
            literal = True
        elif k in ("n", "s"):
            self.p += 1
        elif k == "(":
            self.p += 1
            save, self.level = self.level, 1
            self.type_or_expression()
            self.level = save
            self.need(")")
        elif k == "func":
            self.p += 1
            self.signature()
            if self.k[self.p] == "{":
                self.body()
        elif k in ("[", "map", "chan", "struct", "interface", "<-"):
            self.type()
            if self.k[self.p] == "{" and k in ("[", "map", "struct"):
                self.literal()
            elif self.k[self.p] != "(" and not self.type_place():
                self.bad()
        else:
            self.bad()
        while True:
            k = self.k[self.p]
            if k == ".":
                self.p += 1
                if self.eat("("):
                    if not self.eat("type"):
                        self.type()
                    self.need(")")
                    literal = False
                else:
                    self.need("i")
            elif k == "[":
                save, self.level = self.level, 1
                self.p += 1
                self.index()
                self.level = save
            elif k == "(":
                save, self.level = self.level, 1
                self.p += 1
                while not self.eat(")"):
                    self.type_or_expression()
                    self.eat("...")
                    if self.k[self.p] != ")":
                        self.need(",")
                self.level = save
                literal = False
            elif k == "{" and literal and self.level >= 0:
                self.literal()
                literal = False
            else:
                return

    def type_place(self) -> bool:
        return self.k[self.p] in (",", ")", ":", "]")

    def index(self) -> None:
        if self.k[self.p] == "]":
            self.bad()
        colons = 0
        if self.k[self.p] != ":":
            self.type_or_expression()
        while self.k[self.p] in (":", ","):
            c = self.k[self.p]
            self.p += 1
            if c == ":":
                colons += 1
                if self.k[self.p] not in (":", "]"):
                    self.expression()
                elif colons == 2:
                    self.bad()
            elif self.k[self.p] != "]":
                self.type()
        if colons > 2:
            self.bad()
        self.need("]")

    def literal(self) -> None:
        self.need("{")
        save, self.level = self.level, 1
        while not self.eat("}"):
            self.element()
            if self.eat(":"):
                self.element()
            if self.k[self.p] != "}":
                self.need(",")
        self.level = save

    def element(self) -> None:
        if self.k[self.p] == "{":
            self.literal()
        else:
            self.expression()


#: Tokens after which texts of other languages are refused.
HEAD = 40


def check_go(text: str) -> bool:
    head = _lex(text, HEAD)
    try:
        Parser(head).file()
        return True
    except (IndexError, KeyError):
        if head[4]:
            raise
    Parser(_lex(text)).file()
    return True
