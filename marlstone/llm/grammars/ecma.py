"""A recursive-descent recogniser for ECMAScript modules and TypeScript.

It follows the published grammars: a token list is made first (with regular expression literals told from division by
the token before), brackets are matched, then statements are parsed. Lines whose shape was accepted before as a whole
statement, in the same kind of function, are taken at once: the grammar sees token kinds only, so an equal shape parses
equally.
"""

from __future__ import annotations

import re

#: Reserved words in module code (fixed values).
RESERVED = frozenset("""break case catch class const continue debugger default delete do else enum export extends false finally for function if import in
instanceof new null return super switch this throw true try typeof var void while with yield let static implements interface package private protected public await""".split())
#: TypeScript lets these name things; they are words of strict code only.
TS_FREE = frozenset("implements interface package private protected public static let".split())
PREFIX = frozenset("delete void typeof ! ~ + - ++ -- await".split())
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
BINARY = {"??": 1, "||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "===": 6, "!==": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "in": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "**": 11}
#: After these a slash begins a regular expression.
NO_REGEX_AFTER = frozenset(["i", "n", "s", "t", "r", ")", "]", "}", "this", "super", "null", "true", "false", "#"])

_TOKEN = re.compile(
    r"""(?P<sp>[ \t\f\v\xa0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]+)|(?P<nl>\r\n|[\n\r\u2028\u2029])|(?P<lc>//[^\n\r\u2028\u2029]*)|(?P<bc>/\*[\s\S]*?\*/)
|(?P<id>[A-Za-z_$][\w$]*)|(?P<nm>(?:0|[1-9]\d*(?:_\d+)*)n|0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|0[bB][01]+(?:_[01]+)*n?|(?:(?:0|[1-9]\d*(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?)
|(?P<st>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')
|(?P<pu>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#])|(?P<tp>`)""",
    re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029]|\[(?:[^\]\\\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029])*\])+/([A-Za-z]*)")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_IDENT = re.compile(r"[\w$\u200c\u200d]+|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\})")
_ESCAPE = re.compile(r"\\(?:u(?![0-9a-fA-F]{4}|\{0*(?:10|[0-9a-fA-F])?[0-9a-fA-F]{1,4}\})|x(?![0-9a-fA-F]{2})|[1-9]|0\d)")
_OPEN = {"(": ")", "[": "]", "{": "}"}
_CLOSE = frozenset(_OPEN.values())


class Bad(ValueError):
    pass


_NUMBER = r"""(?:0|[1-9]\d*(?:_\d+)*)n|0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|0[bB][01]+(?:_[01]+)*n?|(?:(?:0|[1-9]\d*(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?"""
_WHOLE_NUMBER = re.compile(_NUMBER)
#: Signs that begin a template, and slashes that are no comment's.
_TIED = re.compile(r"`|(?<!/)/(?!/)")
#: One token, with what follows a number at once, or one character that is none; for lines without templates, divisions and regular expressions. The blanks after it are skipped.
_PLAIN = re.compile(
    r"""([A-Za-z_$][\w$]*|[ \t\f\v]*[\n\r][ \t\f\v\n\r]*|//[^\n\r\u2028\u2029]*|/\*[\s\S]*?\*/"""
    rf"""|(?>{_NUMBER})[\w$]*"""
    r"""|"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'"""
    r"""|>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|<<|>>|\*\*|[\s\S])[ \t]*"""
)
_SIGNS = frozenset(">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= %= &= |= ^= << >> ** { } ( ) [ ] ; , < > + - * % & | ^ ! ~ ? : = . @ #".split())


#: token -> its kind, else the kind by its first character: " " for comments and blanks, "\n" for what holds a line's end, "odd" for what is no token.
_FIXED = {w: w for w in (*RESERVED, *_SIGNS)} | dict.fromkeys("\"'\\", "odd") | dict.fromkeys(" \t\f\v", " ")
_FIRST = dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$", "i") | dict.fromkeys("0123456789.", "n") | dict.fromkeys("\"'", "s") | dict.fromkeys("\n\r \t\f\v", "\n") | {"/": " "}


def _escapes(w: str) -> None:
    if _ESCAPE.search(w):
        i = 0
        while (e := _ESCAPE.search(w, i)) is not None:
            back = len(w[: e.start()]) - len(w[: e.start()].rstrip("\\"))
            if back % 2 == 0:
                raise Bad("escape")
            i = e.start() + 1


def _lex(text: str, limit: int | None = None) -> tuple[list[str], list[str], list[bool], bool]:
    """kinds, words, newline-before, and whether the text was read to its end; with a limit about so many tokens are read."""
    kinds: list[str] = []
    words: list[str] = []
    fresh: list[bool] = []
    nl = False
    pos, n = 0, len(text)
    if text.startswith("#!"):
        pos = len(text.split("\n", 1)[0])
    match = _TOKEN.match
    fixed, first = _FIXED.get, _FIRST.get
    stack: list[str] = []
    heads: list[bool] = []  # of each open parenthesis: does it follow if, while, for or with?
    head = False
    inside, tied = 0, 0  # open templates, and where the lines end that are read token by token
    while pos < n:
        if limit is not None and len(kinds) > limit:
            return kinds, words, fresh, False
        m = match(text, pos)
        if m is None:
            w = _word(text, pos)
            kinds.append("i")
            words.append(w)
            fresh.append(nl)
            nl = False
            pos += len(w)
            continue
        g = m.lastgroup
        end = m.end()
        if g == "sp" or g == "lc":
            pos = end
            continue
        if g == "nl":
            nl = True
            pos = end
            if limit is not None or inside or pos < tied:
                continue
            # Lines whose tokens do not depend on what is before them, at once.
            stop = _TIED.search(text, pos)
            tied = n if stop is None else text.rfind("\n", pos, stop.start()) + 1
            if tied <= pos:
                continue
            found = _PLAIN.findall(text, pos, tied)
            marks = [fixed(w) or first(w[0], "odd") for w in found]
            if "odd" in marks:
                continue
            for k, w in zip(marks, found):
                if k == "\n":
                    nl = True
                elif k != " ":
                    if k in _OPEN:
                        stack.append(k)
                        if k == "(":
                            heads.append(bool(kinds) and kinds[-1] in ("if", "while", "for", "with"))
                    elif k in _CLOSE:
                        if not stack or _OPEN[stack.pop()] != k:
                            raise Bad("bracket")
                        if k == ")":
                            head = heads.pop()
                    elif k == "s":
                        if "\\" in w:
                            _escapes(w)
                    elif k == "n" and not _WHOLE_NUMBER.fullmatch(w):
                        raise Bad("number")
                    kinds.append(k)
                    words.append(w)
                    fresh.append(nl)
                    nl = False
            pos = tied
            continue
        if g == "bc":
            if "\n" in m[0]:
                nl = True
            pos = end
            continue
        w = m[0]
        if g == "id":
            if end < n and (text[end] > "\x7f" or text[end] == "\\"):
                w = _word(text, pos)
                end = pos + len(w)
                k = "i"
            else:
                k = w if w in RESERVED else "i"
        elif g == "nm":
            if end < n and (text[end].isalnum() or text[end] in "_$"):
                raise Bad("number")
            k = "n"
        elif g == "st":
            if "\\" in w:
                _escapes(w)
            k = "s"
        elif g == "pu":
            k = w
            if w[0] == "/":
                p = kinds[-1] if kinds else ""
                if p not in NO_REGEX_AFTER or p == "}" and nl or p == ")" and head:
                    r = _REGEX.match(text, pos)
                    if r is None:
                        if p != "}":
                            raise Bad("regex")
                    else:
                        if len(set(r[1])) != len(r[1]) or set(r[1]) - set("dgimsuvy"):
                            raise Bad("flags")
                        k, w, end = "r", r[0], r.end()
            elif w in "([{":
                stack.append(w)
                if w == "(":
                    heads.append(bool(kinds) and kinds[-1] in ("if", "while", "for", "with"))
            elif w in ")]}":
                if not stack:
                    raise Bad("bracket")
                o = stack.pop()
                if w == ")" and heads:
                    head = heads.pop()
                if o == "${":
                    if w != "}":
                        raise Bad("bracket")
                    kinds.append("}$")
                    words.append(w)
                    fresh.append(nl)
                    nl = False
                    pos = _template(text, end, stack, kinds, words, fresh)
                    inside -= kinds[-1] == "t"
                    continue
                if _OPEN[o] != w:
                    raise Bad("bracket")
        else:
            kinds.append("`")
            words.append("`")
            fresh.append(nl)
            nl = False
            pos = _template(text, end, stack, kinds, words, fresh)
            inside += kinds[-1] == "${"
            continue
        kinds.append(k)
        words.append(w)
        fresh.append(nl)
        nl = False
        pos = end
    if stack:
        raise Bad("bracket")
    return kinds, words, fresh, True


def _template(text: str, pos: int, stack: list[str], kinds: list[str], words: list[str], fresh: list[bool]) -> int:
    m = _TEMPLATE.match(text, pos)
    if m is None:
        raise Bad("template")
    if m[1] == "`":
        kinds.append("t")
    else:
        stack.append("${")
        kinds.append("${")
    words.append(m[1])
    fresh.append(False)
    return m.end()


def _word(text: str, pos: int) -> str:
    out, i = "", pos
    while i < len(text) and (m := _IDENT.match(text, i)):
        out += m[0]
        i = m.end()
    plain = re.sub(r"\\u(?:\{([0-9a-fA-F]+)\}|([0-9a-fA-F]{4}))", lambda m: chr(int(m[1] or m[2], 16)), out).replace("$", "_")
    if not plain or not plain.replace("\u200c", "").replace("\u200d", "").isidentifier():
        raise Bad("character")
    return out


def _layout(tokens: tuple[list[str], list[str], list[bool], bool]) -> tuple[dict[int, int], dict[int, tuple[str, int]]]:
    """Matching brackets, and shape and end of the line that begins at a token."""
    kinds, words, fresh, whole = tokens
    close: dict[int, int] = {}
    stack: list[int] = []
    for i, k in enumerate(kinds):
        if k in _OPEN:
            stack.append(i)
        elif k in _CLOSE:
            if not stack or _OPEN[kinds[stack[-1]]] != k:
                raise Bad("bracket")
            close[stack.pop()] = i
    if stack and whole:
        raise Bad("bracket")
    line: dict[int, tuple[str, int]] = {}
    starts = [i for i, new in enumerate(fresh) if new and i]
    if whole and kinds:
        starts.append(len(kinds))
    for a, b in zip([0, *starts], starts):
        if kinds[b - 1] == ";" and b - a <= 60:
            line[a] = (" ".join([w if k == "i" and w in _SPECIAL else k for k, w in zip(kinds[a:b], words[a:b])]), b)
    return close, line


_KNOWN: dict[str, bool] = {}
#: Ends of a text that stand after its last token, so that looking ahead never leaves it.
AHEAD = 5


class Parser:
    """Over the first tokens of a text only, the parser runs out of them (IndexError, KeyError) unless it refuses before."""

    def __init__(self, tokens: tuple[list[str], list[str], list[bool], bool], layout: tuple[dict, dict], ts: bool):
        self.k, self.w, self.nl = ([*x] for x in tokens[:3])
        self.ts = ts
        if tokens[3]:
            # As many as the grammar looks ahead.
            self.k += ["eof"] * AHEAD
            self.w += [""] * AHEAD
            self.nl += [True] * AHEAD
        self.p = 0
        self.fn = self.asyn = self.gen = self.loop = self.brk = False
        self.ambient = False
        self.labels: list[str] = []
        self.cover = -1
        self.no_in = False
        self.no_cond_type = False
        # Replaced, never changed: both grammars share them.
        self.close, self.line = layout

    # -- helpers
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

    def word(self, *names: str) -> bool:
        return self.k[self.p] == "i" and self.w[self.p] in names

    def semi(self) -> None:
        if self.k[self.p] == ";":
            self.p += 1
        elif self.k[self.p] not in ("}", "eof", "}$") and not self.nl[self.p]:
            self.bad()

    def ident(self) -> None:
        k = self.k[self.p]
        if k == "i" or (self.ts and k in TS_FREE) or (k == "await" and self.ts and not self.asyn and self.fn) or (k == "yield" and self.ts and not self.gen):
            self.p += 1
        else:
            self.bad()

    def is_ident(self, i: int | None = None) -> bool:
        k = self.k[self.p if i is None else i]
        return k == "i" or (self.ts and k in TS_FREE)

    def name(self) -> None:
        """IdentifierName: any word."""
        if self.k[self.p] == "i" or self.k[self.p] in RESERVED:
            self.p += 1
        else:
            self.bad()

    def is_name(self, i: int) -> bool:
        return self.k[i] == "i" or self.k[i] in RESERVED

    def attempt(self, f):
        """f at this place; the place is restored and False returned where it fails."""
        save = (self.p, self.cover)
        try:
            r = f()
            return True if r is None else r
        except Bad:
            self.p, self.cover = save
            return False

    # -- statements
    def module(self) -> None:
        while self.k[self.p] != "eof":
            self.statement(top=True)

    def block(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.statement()

    def statement(self, top: bool = False, single: bool = False) -> None:
        p = self.p
        line = self.line.get(p)
        if line is not None:
            key = f"{self.ts:d}{self.fn:d}{self.asyn:d}{self.gen:d}{self.loop:d}{self.brk:d}{top:d}{single:d}{self.ambient:d}{line[0]}"
            if key in _KNOWN:
                self.p = line[1]
                return
        self._statement(top, single)
        if line is not None and self.p == line[1] and not self.labels and len(_KNOWN) < 100_000:
            _KNOWN[key] = True

    def _statement(self, top: bool, single: bool) -> None:
        k, p = self.k[self.p], self.p
        f = _STATEMENTS.get(k)
        if k == "import" and self.k[p + 1] in ("(", "."):
            f = None
        if k == "let" and self.ts and not (self.is_ident(p + 1) or self.k[p + 1] in ("[", "{")):
            f = None
        if f is not None:
            if single and k in ("class", "const", "let", "function", "import", "export"):
                self.bad()
            if k in ("import", "export"):
                if not top:
                    self.bad()
            f(self)
            return
        if k == "@":
            self.decorators()
            if self.k[self.p] == "export":
                if not top:
                    self.bad()
                self.export()
            else:
                if self.ts and self.word("abstract"):
                    self.p += 1
                self.klass(True)
            return
        if self.ts and self.ts_statement(top):
            return
        if k == "i" and self.w[p] == "async" and self.k[p + 1] == "function" and not self.nl[p + 1]:
            if single:
                self.bad()
            self.p += 1
            self.function(True, True)
            return
        if (k == "i" or (self.ts and k in TS_FREE)) and self.k[p + 1] == ":":
            self.p += 2
            self.labels.append(self.w[p])
            self.statement(single=single)
            self.labels.pop()
            return
        self.expression()
        self.semi()

    def var(self, semi: bool = True) -> None:
        kind = self.k[self.p]
        self.p += 1
        if kind == "const" and self.ts and self.k[self.p] == "enum":
            self.enum()
            return
        self.declarators(kind)
        if semi:
            self.semi()

    def declarators(self, kind: str, in_for: bool = False) -> int:
        n = 0
        while True:
            pattern = self.k[self.p] in ("[", "{")
            self.binding()
            if self.ts:
                self.eat("!")
                if self.eat(":"):
                    self.type()
            n += 1
            if self.eat("="):
                self.assign()
            elif in_for and (self.k[self.p] == "in" or self.word("of")):
                return n
            elif (kind == "const" or pattern) and not self.ambient:
                self.bad()
            if not self.eat(","):
                return n

    def binding(self) -> None:
        k = self.k[self.p]
        if k == "[":
            self.p += 1
            while not self.eat("]"):
                if self.eat(","):
                    continue
                rest = self.eat("...")
                self.binding()
                if not rest and self.eat("="):
                    self.assign_in()
                if self.k[self.p] != "]":
                    if rest:
                        self.bad()
                    self.need(",")
        elif k == "{":
            self.p += 1
            while not self.eat("}"):
                if self.eat("..."):
                    self.binding()
                    if self.k[self.p] != "}":
                        self.bad()
                    continue
                i = self.p
                self.prop_name()
                if self.eat(":"):
                    self.binding()
                elif not self.is_ident(i) or self.p != i + 1:
                    self.bad()
                if self.eat("="):
                    self.assign_in()
                if self.k[self.p] != "}":
                    self.need(",")
        else:
            self.ident()

    def assign_in(self) -> None:
        save, self.no_in = self.no_in, False
        self.assign()
        self.no_in = save

    def prop_name(self) -> str:
        k = self.k[self.p]
        if k == "[":
            self.p += 1
            self.assign_in()
            self.need("]")
        elif k in ("s", "n") or self.is_name(self.p):
            self.p += 1
        elif k == "#":
            self.p += 1
            self.name()
        else:
            self.bad()
        return k

    def condition(self) -> None:
        self.need("(")
        self.expression_in()
        self.need(")")

    def expression_in(self) -> None:
        save, self.no_in = self.no_in, False
        self.expression()
        self.no_in = save

    def body(self) -> None:
        self.statement(single=True)

    def loop_body(self) -> None:
        save = self.loop, self.brk
        self.loop = self.brk = True
        self.body()
        self.loop, self.brk = save

    def s_block(self) -> None:
        self.block()

    def s_empty(self) -> None:
        self.p += 1

    def s_if(self) -> None:
        self.p += 1
        self.condition()
        self.body()
        if self.eat("else"):
            self.body()

    def s_for(self) -> None:
        self.p += 1
        wait = self.eat("await")
        if wait and self.fn and not self.asyn:
            self.bad()
        self.need("(")
        k = self.k[self.p]
        if k == ";":
            self.p += 1
        else:
            self.no_in = True
            start = self.p
            if k in ("var", "let", "const"):
                self.p += 1
                n = self.declarators(k, True)
                kind = "decl" if n == 1 else "many"
            else:
                self.cover = -1
                kind = self.expression(pattern_ok=True)
            self.no_in = False
            if self.k[self.p] == "in" or self.word("of"):
                of = self.k[self.p] == "i"
                if kind not in ("decl", "id", "member", "obj", "arr"):
                    self.bad()
                self.cover = -1
                self.p += 1
                if of:
                    self.assign()
                else:
                    self.expression()
                self.need(")")
                self.loop_body()
                return
            if self.cover >= start or wait:
                self.bad()
            self.need(";")
        if not self.eat(";"):
            self.expression()
            self.need(";")
        if not self.eat(")"):
            self.expression()
            self.need(")")
        self.loop_body()

    def s_while(self) -> None:
        self.p += 1
        self.condition()
        self.loop_body()

    def s_do(self) -> None:
        self.p += 1
        self.loop_body()
        self.need("while")
        self.condition()
        self.eat(";")

    def s_jump(self) -> None:
        k = self.k[self.p]
        self.p += 1
        if self.k[self.p] == "i" and not self.nl[self.p]:
            if self.w[self.p] not in self.labels:
                self.bad()
            self.p += 1
        elif not (self.loop if k == "continue" else self.brk):
            self.bad()
        self.semi()

    def s_return(self) -> None:
        if not self.fn:
            self.bad()
        self.p += 1
        if self.k[self.p] not in (";", "}", "eof") and not self.nl[self.p]:
            self.expression()
        self.semi()

    def s_throw(self) -> None:
        self.p += 1
        if self.nl[self.p]:
            self.bad()
        self.expression()
        self.semi()

    def s_try(self) -> None:
        self.p += 1
        self.block()
        done = False
        if self.eat("catch"):
            done = True
            if self.eat("("):
                self.binding()
                if self.ts and self.eat(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.eat("finally"):
            done = True
            self.block()
        if not done:
            self.bad()

    def s_switch(self) -> None:
        self.p += 1
        self.condition()
        self.need("{")
        save, self.brk, seen = self.brk, True, False
        while not self.eat("}"):
            if self.eat("default"):
                if seen:
                    self.bad()
                seen = True
            else:
                self.need("case")
                self.expression()
            self.need(":")
            while self.k[self.p] not in ("case", "default", "}"):
                self.statement()
        self.brk = save

    def s_function(self) -> None:
        self.function(True, False)

    def s_class(self) -> None:
        self.klass(True)

    def s_debugger(self) -> None:
        self.p += 1
        self.semi()

    # -- modules
    def module_name(self) -> None:
        if self.k[self.p] == "s":
            self.p += 1
        else:
            self.name()

    def attributes(self) -> None:
        if (self.k[self.p] == "with" or self.word("assert")) and self.k[self.p + 1] == "{" and not (self.nl[self.p] and self.k[self.p] == "i"):
            self.p += 2
            while not self.eat("}"):
                self.module_name()
                self.need(":")
                self.need("s")
                if self.k[self.p] != "}":
                    self.need(",")

    def from_clause(self) -> None:
        if not self.word("from"):
            self.bad()
        self.p += 1
        self.need("s")
        self.attributes()

    def imports(self) -> None:
        self.p += 1
        if self.eat("s"):
            self.attributes()
            self.semi()
            return
        if self.ts and self.word("type") and (self.k[self.p + 1] in ("{", "*") or self.k[self.p + 1] == "i" and (self.w[self.p + 1] != "from" or self.k[self.p + 2] == "i")):
            self.p += 1
        if self.k[self.p] not in ("{", "*"):
            self.ident()
            if self.ts and self.eat("="):
                if self.word("require") and self.k[self.p + 1] == "(":
                    self.p += 2
                    self.need("s")
                    self.need(")")
                else:
                    self.ident()
                    while self.eat("."):
                        self.name()
                self.semi()
                return
            if not self.eat(","):
                self.from_clause()
                self.semi()
                return
        if self.eat("*"):
            if not self.word("as"):
                self.bad()
            self.p += 1
            self.ident()
        else:
            self.specifiers(True)
        self.from_clause()
        self.semi()

    def specifiers(self, importing: bool) -> bool:
        """True where a name stands that only a from clause allows."""
        odd = False
        self.need("{")
        while not self.eat("}"):
            if self.ts and self.word("type") and self.k[self.p + 1] not in (",", "}") and not (self.w[self.p + 1] == "as" and self.k[self.p + 2] in (",", "}")):
                self.p += 1
            i = self.p
            self.module_name()
            plain = self.is_ident(i)
            if self.word("as") :
                self.p += 1
                if importing:
                    self.ident()
                else:
                    self.module_name()
            elif importing and not plain:
                self.bad()
            odd |= not plain
            if self.k[self.p] != "}":
                self.need(",")
        return odd

    def export(self) -> None:
        self.p += 1
        k = self.k[self.p]
        if k == "*":
            self.p += 1
            if self.word("as"):
                self.p += 1
                self.module_name()
            self.from_clause()
            self.semi()
        elif k == "{" or (self.ts and self.word("type") and self.k[self.p + 1] in ("{", "*")):
            if k != "{":
                self.p += 1
                if self.eat("*"):
                    if self.word("as"):
                        self.p += 1
                        self.module_name()
                    self.from_clause()
                    self.semi()
                    return
            odd = self.specifiers(False)
            if odd or self.word("from"):
                self.from_clause()
            self.semi()
        elif k == "default":
            self.p += 1
            k = self.k[self.p]
            if k == "function":
                self.function(False, False)
            elif k == "i" and self.w[self.p] == "async" and self.k[self.p + 1] == "function" and not self.nl[self.p + 1]:
                self.p += 1
                self.function(False, True)
            elif k in ("class", "@") or (self.ts and self.word("abstract") and self.k[self.p + 1] == "class"):
                self.decorators()
                if k == "i":
                    self.p += 1
                self.klass(False)
            elif self.ts and k == "interface" and self.ts_statement(False):
                pass
            else:
                self.assign()
                self.semi()
        elif k in ("var", "let", "const"):
            self.var()
        elif k == "function":
            self.function(True, False)
        elif k == "class":
            self.klass(True)
        elif k == "@":
            self.decorators()
            if self.ts and self.word("abstract"):
                self.p += 1
            self.klass(True)
        elif k == "i" and self.w[self.p] == "async" and self.k[self.p + 1] == "function" and not self.nl[self.p + 1]:
            self.p += 1
            self.function(True, True)
        elif self.ts and k == "=":
            self.p += 1
            self.expression()
            self.semi()
        elif self.ts and k == "import":
            self.imports()
        elif self.ts and self.word("as") and self.w[self.p + 1] == "namespace":
            self.p += 2
            self.ident()
            self.semi()
        elif not (self.ts and self.ts_statement(True)):
            self.bad()

    # -- functions and classes
    def function(self, named: bool, asyn: bool, expr: bool = False) -> None:
        self.need("function")
        gen = self.eat("*")
        if self.k[self.p] != "(" and not (self.ts and self.k[self.p] == "<"):
            self.ident()
        elif named:
            self.bad()
        self.signature_body(asyn, gen, optional_body=self.ts and not expr)

    def signature_body(self, asyn: bool, gen: bool, optional_body: bool = False, method: bool = False) -> None:
        save = self.fn, self.asyn, self.gen, self.loop, self.brk, self.labels, self.no_in
        self.fn, self.asyn, self.gen, self.loop, self.brk, self.labels, self.no_in = True, asyn, gen, False, False, [], False
        if self.ts:
            self.type_params()
        self.params()
        if self.ts and self.eat(":"):
            self.return_type()
        if optional_body and self.k[self.p] != "{":
            self.fn, self.asyn, self.gen, self.loop, self.brk, self.labels, self.no_in = save
            self.semi()
            return
        self.block()
        self.fn, self.asyn, self.gen, self.loop, self.brk, self.labels, self.no_in = save

    def params(self) -> None:
        self.need("(")
        while not self.eat(")"):
            self.decorators()
            rest = self.eat("...")
            if self.ts:
                while (self.k[self.p] in ("public", "private", "protected") or self.word("readonly", "override")) and (self.is_ident(self.p + 1) or self.k[self.p + 1] in ("{", "[", "this")):
                    self.p += 1
                if self.k[self.p] == "this":
                    self.p += 1
                else:
                    self.binding()
                self.eat("?")
                if self.eat(":"):
                    self.type()
            else:
                self.binding()
            if not rest and self.eat("="):
                self.assign_in()
            if self.k[self.p] != ")":
                if rest and not self.ambient:
                    self.bad()
                self.need(",")

    def decorators(self) -> None:
        while self.eat("@"):
            if self.eat("("):
                self.expression_in()
                self.need(")")
            else:
                self.ident()
                while self.eat("."):
                    self.name()
                if self.ts and self.k[self.p] == "<":
                    self.attempt(self.type_args)
                if self.k[self.p] == "(":
                    self.arguments()

    def klass(self, named: bool) -> None:
        self.need("class")
        if self.k[self.p] not in ("{", "extends") and not (self.ts and self.k[self.p] == "implements") and not (self.ts and self.k[self.p] == "<"):
            self.ident()
        elif named:
            self.bad()
        if self.ts:
            self.type_params()
        if self.eat("extends"):
            self.lhs()
            if self.ts and self.k[self.p] == "<":
                self.type_args()
        if self.ts and self.eat("implements"):
            self.type()
            while self.eat(","):
                self.type()
        self.need("{")
        while not self.eat("}"):
            if not self.eat(";"):
                self.member()

    def member(self) -> None:
        self.decorators()
        if self.k[self.p] == "static" and self.k[self.p + 1] == "{":
            self.p += 1
            save = self.fn, self.asyn, self.gen, self.loop, self.brk
            self.fn, self.asyn, self.gen, self.loop, self.brk = True, False, False, False, False
            self.block()
            self.fn, self.asyn, self.gen, self.loop, self.brk = save
            return
        ends = ("(", "=", ";", "}", "?", "!", ":", "<") if self.ts else ("(", "=", ";", "}")

        def modifier(*names: str) -> bool:
            w = self.w[self.p]
            if w in names and self.is_name(self.p) and self.k[self.p + 1] not in ends and not (self.nl[self.p + 1] and w not in ("static", "public", "private", "protected", "abstract", "readonly", "override", "declare")):
                self.p += 1
                return True
            return False

        if self.ts:
            while modifier("public", "private", "protected", "static", "abstract", "readonly", "override", "declare", "accessor"):
                pass
        else:
            modifier("static")
            modifier("accessor")
        if self.ts and self.k[self.p] == "[" and self.is_ident(self.p + 1) and self.k[self.p + 2] == ":":
            self.index_signature()
            self.semi()
            return
        asyn = modifier("async")
        gen = self.eat("*")
        if not asyn and not gen and modifier("get", "set"):
            self.prop_name()
            self.signature_body(False, False, self.ts, True)
            return
        self.prop_name()
        if self.ts:
            if self.k[self.p] in ("?", "!"):
                self.p += 1
        if self.k[self.p] == "(" or (self.ts and self.k[self.p] == "<"):
            self.signature_body(asyn, gen, self.ts, True)
            return
        if asyn or gen:
            self.bad()
        if self.ts and self.eat(":"):
            self.type()
        if self.eat("="):
            save = self.fn, self.asyn
            self.fn, self.asyn = True, False
            self.assign_in()
            self.fn, self.asyn = save
        self.semi()

    # -- expressions
    def expression(self, pattern_ok: bool = False) -> str:
        kind = self.assign(pattern_ok)
        while self.eat(","):
            self.assign()
            kind = "other"
        return kind

    def arrow_ahead(self) -> bool:
        """At "(": is this the head of an arrow function?"""
        c = self.close[self.p] + 1
        if self.k[c] == "=>":
            return not self.nl[c]
        return False

    def arrow_rest(self, asyn: bool) -> None:
        """From => on."""
        if self.nl[self.p]:
            self.bad()
        self.need("=>")
        if self.k[self.p] == "{":
            save = self.fn, self.asyn, self.gen, self.loop, self.brk, self.labels, self.no_in
            self.fn, self.asyn, self.gen, self.loop, self.brk, self.labels, self.no_in = True, asyn, False, False, False, [], False
            self.block()
            self.fn, self.asyn, self.gen, self.loop, self.brk, self.labels, self.no_in = save
        else:
            save = self.fn, self.asyn, self.gen
            self.fn, self.asyn, self.gen = True, asyn, False
            self.assign()
            self.fn, self.asyn, self.gen = save

    def arrow_params(self, asyn: bool) -> None:
        save = self.asyn, self.no_in
        self.asyn, self.no_in = asyn, False
        self.params()
        self.asyn, self.no_in = save

    def typed_arrow(self, asyn: bool) -> None:
        self.type_params()
        self.arrow_params(asyn)
        if self.eat(":"):
            self.return_type()
        self.arrow_rest(asyn)

    def assign(self, pattern_ok: bool = False) -> str:
        k = self.k[self.p]
        if k == "yield" and self.gen:
            self.p += 1
            if not self.nl[self.p]:
                if self.eat("*"):
                    self.assign()
                elif self.k[self.p] not in (")", "]", "}", ",", ";", ":", "eof", "in", "}$") and not self.word("of"):
                    self.assign()
            return "other"
        if k == "i" or (self.ts and k in TS_FREE):
            n = self.k[self.p + 1]
            if n == "=>":
                self.p += 1
                self.arrow_rest(False)
                return "other"
            if self.w[self.p] == "async" and k == "i" and not self.nl[self.p + 1]:
                if n == "i" and self.k[self.p + 2] == "=>":
                    self.p += 2
                    self.arrow_rest(True)
                    return "other"
                if n == "(" or (self.ts and n == "<"):
                    if n == "(" and self.k[self.close[self.p + 1] + 1] == "=>":
                        self.p += 1
                        self.arrow_params(True)
                        self.arrow_rest(True)
                        return "other"
                    if self.ts:
                        def head():
                            self.p += 1
                            self.typed_arrow(True)
                        if (n == "<" or self.k[self.close[self.p + 1] + 1] == ":") and self.attempt(head):
                            return "other"
        elif k == "(":
            if self.arrow_ahead():
                self.arrow_params(False)
                self.arrow_rest(False)
                return "other"
            if self.ts and self.k[self.close[self.p] + 1] == ":":
                def whole():
                    middle, self.middle = self.middle, False
                    try:
                        self.typed_arrow(False)
                    finally:
                        self.middle = middle
                    if middle and self.k[self.p] != ":":
                        self.bad()
                if self.attempt(whole):
                    return "other"
        elif k == "<" and self.ts and self.attempt(lambda: self.typed_arrow(False)):
            return "other"
        start = self.p
        saved, self.cover = self.cover, -1
        kind = self.conditional()
        op = self.k[self.p]
        if op == ">" and self.ts:
            op = self.w[self.p]
        if op in ASSIGN:
            if op == "=":
                if kind not in ("id", "member", "obj", "arr"):
                    self.bad()
            elif kind not in ("id", "member"):
                self.bad()
            self.cover = -1
            self.p += 1
            self.assign()
            kind = "other"
        if self.cover >= 0 and not pattern_ok and self.depth_literal == 0:
            self.bad()
        if self.cover < 0:
            self.cover = saved
        return kind

    depth_literal = 0

    def conditional(self) -> str:
        kind = self.binary(0)
        if self.k[self.p] == "?":
            self.p += 1
            save, self.no_in, middle, self.middle = self.no_in, False, self.middle, True
            self.assign()
            self.no_in, self.middle = save, middle
            self.need(":")
            self.assign()
            return "other"
        return kind

    middle = False  # between ? and : of a conditional

    def binary(self, least: int) -> str:
        if self.k[self.p] == "#" and self.is_name(self.p + 1) and self.k[self.p + 2] == "in":
            self.p += 2
            kind = "other"
        else:
            first = self.k[self.p]
            kind = self.unary()
            if self.k[self.p] == "**" and first in PREFIX and first not in ("++", "--") and kind == "unary":
                self.bad()
        mixed = ""
        while True:
            op = self.k[self.p]
            if op == "i" and self.ts and self.w[self.p] in ("as", "satisfies") and not self.nl[self.p] and least < 7:
                self.p += 1
                if self.k[self.p] == "const":
                    self.p += 1
                else:
                    self.type()
                if kind not in ("id", "member"):
                    kind = "other"
                continue
            level = BINARY.get(op)
            if level is None or level <= least and not (op == "**" and least == 11) or (op == "in" and self.no_in):
                return kind
            if op in ("??", "||", "&&") and level <= 2:
                if mixed and ("??" in (op, mixed)) and op != mixed:
                    self.bad()
                mixed = op
            self.p += 1
            self.binary(level if op != "**" else 10)
            kind = "other"

    def unary(self) -> str:
        k = self.k[self.p]
        if k in PREFIX:
            if k == "await":
                if self.fn and not self.asyn:
                    if not self.ts:
                        self.bad()
                    return self.postfix()
                self.p += 1
                self.unary()
                return "unary"
            self.p += 1
            kind = self.unary()
            if k in ("++", "--"):
                if kind not in ("id", "member"):
                    self.bad()
                return "other"
            if k == "delete" and kind == "id":
                self.bad()
            return "unary"
        if self.ts and k == "<":
            self.p += 1
            self.type()
            self.need(">")
            self.unary()
            return "other"
        return self.postfix()

    def postfix(self) -> str:
        kind = self.lhs()
        if self.k[self.p] in ("++", "--") and not self.nl[self.p]:
            if kind not in ("id", "member"):
                self.bad()
            self.p += 1
            return "other"
        return kind

    def arguments(self) -> None:
        self.need("(")
        save, self.no_in = self.no_in, False
        depth, self.depth_literal = self.depth_literal, 0
        while not self.eat(")"):
            self.eat("...")
            self.assign()
            if self.k[self.p] != ")":
                self.need(",")
        self.no_in, self.depth_literal = save, depth

    def lhs(self) -> str:
        k = self.k[self.p]
        if k == "new":
            self.p += 1
            if self.eat("."):
                if self.w[self.p] != "target" or not self.fn:
                    self.bad()
                self.p += 1
                kind = "other"
            else:
                if self.k[self.p] == "import":
                    self.bad()
                if self.k[self.p] == "new":
                    self.lhs()
                else:
                    self.primary()
                    self.tail(False)
                if self.ts and self.k[self.p] == "<":
                    self.attempt(self.type_args)
                if self.k[self.p] == "(":
                    self.arguments()
                kind = "other"
        elif k == "super":
            self.p += 1
            if self.k[self.p] not in (".", "[", "("):
                self.bad()
            kind = "other"
        elif k == "import":
            self.p += 1
            if self.eat("."):
                if self.w[self.p] != "meta":
                    self.bad()
                self.p += 1
            else:
                if self.k[self.p] != "(":
                    self.bad()
            kind = "other"
        else:
            kind = self.primary()
        return self.tail(True, kind)

    def tail(self, calls: bool, kind: str = "other") -> str:
        optional = False
        while True:
            k = self.k[self.p]
            if k == ".":
                self.p += 1
                self.eat("#")
                self.name()
                kind = "other" if optional else "member"
            elif k == "?.":
                if not calls:
                    self.bad()
                optional = True
                self.p += 1
                n = self.k[self.p]
                if n == "(":
                    self.arguments()
                elif n == "[":
                    self.p += 1
                    self.expression_in()
                    self.need("]")
                elif n == "<" and self.ts:
                    self.type_args()
                    self.arguments()
                else:
                    self.eat("#")
                    self.name()
                kind = "other"
            elif k == "[":
                self.p += 1
                self.expression_in()
                self.need("]")
                kind = "other" if optional else "member"
            elif k == "(" and calls:
                self.arguments()
                kind = "other"
            elif k == "`":
                if optional:
                    self.bad()
                self.template()
                kind = "other"
            elif self.ts and k == "!" and not self.nl[self.p]:
                self.p += 1
            elif self.ts and k in ("<", "<<") and calls and self.attempt(self.call_type_args):
                kind = "other"
            else:
                return kind

    def call_type_args(self) -> None:
        self.type_args()
        k = self.k[self.p]
        if k in ("(", "`"):
            return
        if k in (")", "]", ":", ";", ",", ".", "?.", "==", "===", "!=", "!==", "&&", "||", "??", "^", "&", "|", "}", "eof", "=>", "?", "=") or self.nl[self.p]:
            return
        self.bad()

    def template(self) -> None:
        self.need("`")
        while not self.eat("t"):
            self.need("${")
            self.expression_in()
            self.need("}$")

    def primary(self) -> str:
        k, p = self.k[self.p], self.p
        if k == "i" or (self.ts and k in TS_FREE):
            if k == "i" and self.w[p] == "async" and self.k[p + 1] == "function" and not self.nl[p + 1]:
                self.p += 1
                self.function(False, True, True)
                return "other"
            self.p += 1
            return "id"
        if k in ("n", "s", "r", "this", "null", "true", "false"):
            self.p += 1
            return "other"
        if k == "(":
            self.p += 1
            save, self.no_in = self.no_in, False
            depth, self.depth_literal = self.depth_literal, 0
            kind = self.expression()
            self.no_in, self.depth_literal = save, depth
            self.need(")")
            return kind if kind in ("id", "member") else "other"
        if k == "[":
            self.p += 1
            save, self.no_in = self.no_in, False
            self.depth_literal += 1
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.assign()
                if self.k[self.p] != "]":
                    self.need(",")
            self.depth_literal -= 1
            self.no_in = save
            return "arr"
        if k == "{":
            self.object()
            return "obj"
        if k == "`":
            self.template()
            return "other"
        if k == "function":
            self.function(False, False, True)
            return "other"
        if k in ("class", "@"):
            self.decorators()
            self.klass(False)
            return "other"
        if k == "await" and self.ts:
            self.p += 1
            return "id"
        self.bad()

    def object(self) -> None:
        self.p += 1
        save, self.no_in = self.no_in, False
        self.depth_literal += 1
        while not self.eat("}"):
            if self.eat("..."):
                self.assign()
            else:
                self.property()
            if self.k[self.p] != "}":
                self.need(",")
        self.depth_literal -= 1
        self.no_in = save

    def property(self) -> None:
        p = self.p
        ends = (",", ":", "(", "}", "=", "<") if self.ts else (",", ":", "(", "}", "=")
        asyn = self.word("async") and self.k[p + 1] not in ends and not self.nl[p + 1]
        if asyn:
            self.p += 1
        gen = self.eat("*")
        if not asyn and not gen and self.word("get", "set") and self.k[p + 1] not in ends:
            self.p += 1
            self.prop_name()
            self.signature_body(False, False, method=True)
            return
        i = self.p
        if self.k[i] == "#":
            self.bad()
        self.prop_name()
        k = self.k[self.p]
        if k == "(" or (self.ts and k == "<"):
            self.signature_body(asyn, gen, method=True)
        elif asyn or gen:
            self.bad()
        elif k == ":":
            self.p += 1
            self.assign()
        elif self.p == i + 1 and (self.is_ident(i) or self.k[i] == "await" and self.ts or self.k[i] == "yield" and self.ts):
            if k == "=":
                self.p += 1
                self.assign()
                self.cover = p
        else:
            self.bad()

    # -- TypeScript
    def ts_statement(self, top: bool) -> bool:
        k, w, p = self.k[self.p], self.w[self.p], self.p
        if k == "enum":
            self.enum()
            return True
        n = self.k[p + 1]
        if k == "interface" and self.is_ident(p + 1) and not self.nl[p + 1]:
            self.p += 2
            self.type_params()
            if self.eat("extends"):
                self.type()
                while self.eat(","):
                    self.type()
            self.object_type()
            return True
        if k != "i":
            return False
        if w == "type" and self.is_ident(p + 1) and not self.nl[p + 1] and self.k[p + 2] in ("=", "<"):
            self.p += 2
            self.type_params()
            self.need("=")
            self.type()
            self.semi()
            return True
        if w == "abstract" and n == "class" and not self.nl[p + 1]:
            self.p += 1
            self.klass(True)
            return True
        if w == "declare" and not self.nl[p + 1] and (n in ("var", "let", "const", "function", "class", "enum", "interface", "import") or n == "i" and self.w[p + 1] in ("type", "module", "namespace", "abstract", "global", "async")):
            self.p += 1
            save, self.ambient = self.ambient, True
            if self.word("global"):
                self.p += 1
                self.module_body()
            else:
                self.statement(top=False)
            self.ambient = save
            return True
        if w in ("namespace", "module") and not self.nl[p + 1] and (n == "i" or w == "module" and n == "s"):
            self.p += 2
            if n == "i":
                while self.eat("."):
                    self.name()
            if self.k[self.p] != "{" and self.ambient:
                self.semi()
                return True
            self.module_body()
            return True
        if w == "global" and n == "{" and self.ambient:
            self.p += 1
            self.module_body()
            return True
        return False

    def module_body(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.statement(top=True)

    def enum(self) -> None:
        self.need("enum")
        self.ident()
        self.need("{")
        while not self.eat("}"):
            self.prop_name()
            if self.eat("="):
                self.assign_in()
            if self.k[self.p] != "}":
                self.need(",")

    def type_params(self) -> None:
        if not self.eat("<"):
            return
        if self.k[self.p] == ">":
            self.bad()
        while True:
            while (self.k[self.p] in ("const", "in") or self.word("out")) and self.is_name(self.p + 1) and self.k[self.p + 1] != "extends":
                self.p += 1
            self.ident()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if not self.eat(",") or self.k[self.p] == ">":
                break
        self.need(">")

    def split(self, first: str) -> None:
        """Turns >>, >>>, >= and << into their first character and the rest."""
        k = self.k[self.p]
        if k != first and k.startswith(first) and k != "=>":
            self.k[self.p : self.p + 1] = [first, k[1:]]
            self.w[self.p : self.p + 1] = [first, k[1:]]
            self.nl[self.p : self.p + 1] = [self.nl[self.p], False]
            self.close = {a + (a > self.p): b + (b > self.p) for a, b in self.close.items()}
            self.line = {}

    def type_args(self) -> None:
        self.split("<")
        self.need("<")
        while True:
            self.type()
            if not self.eat(","):
                break
        self.split(">")
        self.need(">")

    def return_type(self) -> None:
        p = self.p
        if self.word("asserts") and (self.is_ident(p + 1) or self.k[p + 1] == "this") and not self.nl[p + 1]:
            self.p += 2
            if self.word("is"):
                self.p += 1
                self.type()
            return
        if (self.is_ident() or self.k[p] == "this") and self.k[p + 1] == "i" and self.w[p + 1] == "is" and not self.nl[p + 1]:
            self.p += 2
        self.type()

    def type(self) -> None:
        if self.k[self.p] == "<" or self.k[self.p] == "(" and self.function_type_ahead():
            self.type_params()
            self.params()
            self.need("=>")
            self.return_type()
            return
        if self.k[self.p] == "new" or self.word("abstract") and self.k[self.p + 1] == "new":
            self.eat("i")
            self.need("new")
            self.type_params()
            self.params()
            self.need("=>")
            self.type()
            return
        self.union_type()
        if not self.no_cond_type and self.k[self.p] == "extends" and not self.nl[self.p]:
            self.p += 1
            save, self.no_cond_type = self.no_cond_type, True
            self.type()
            self.no_cond_type = save
            self.need("?")
            save, self.no_cond_type = self.no_cond_type, False
            self.type()
            self.need(":")
            self.type()
            self.no_cond_type = save

    def function_type_ahead(self) -> bool:
        return self.k[self.p] == "(" and self.k[self.close[self.p] + 1] == "=>"

    def union_type(self) -> None:
        if self.k[self.p] in ("|", "&"):
            self.p += 1
        while True:
            self.operator_type()
            if self.k[self.p] not in ("|", "&"):
                return
            self.p += 1

    def operator_type(self) -> None:
        if self.k[self.p] == "i" and self.w[self.p] in ("keyof", "unique", "readonly", "infer") and self.k[self.p + 1] not in (",", ")", "]", "}", ";", ">", "=", "|", "&", "<", ".", "[", "=>") or self.word("keyof", "readonly") and self.k[self.p + 1] in ("(", "["):
            infer = self.w[self.p] == "infer"
            self.p += 1
            self.operator_type()
            if infer and self.k[self.p] == "extends":
                self.attempt(self.infer_bound)
            return
        if self.k[self.p] == "(" and self.function_type_ahead() or self.k[self.p] == "new":
            self.type()
            return
        self.postfix_type()

    def infer_bound(self) -> None:
        self.p += 1
        save, self.no_cond_type = self.no_cond_type, True
        self.type()
        self.no_cond_type = save
        if self.k[self.p] == "?":
            self.bad()

    def postfix_type(self) -> None:
        k = self.k[self.p]
        if k == "(":
            self.p += 1
            save, self.no_cond_type = self.no_cond_type, False
            self.type()
            self.no_cond_type = save
            self.need(")")
        elif k == "[":
            self.p += 1
            while not self.eat("]"):
                self.eat("...")
                if self.is_name(self.p) and (self.k[self.p + 1] == ":" or self.k[self.p + 1] == "?" and self.k[self.p + 2] == ":"):
                    self.p += 1
                    self.eat("?")
                    self.need(":")
                self.eat("...")
                self.type()
                self.eat("?")
                if self.k[self.p] != "]":
                    self.need(",")
        elif k == "{":
            self.object_type()
        elif k in ("s", "n", "true", "false", "null", "void", "this"):
            self.p += 1
        elif k == "-":
            self.p += 1
            self.need("n")
        elif k == "`":
            self.p += 1
            while not self.eat("t"):
                self.need("${")
                self.type()
                self.need("}$")
        elif k == "typeof":
            self.p += 1
            if self.k[self.p] == "import":
                self.postfix_type()
            else:
                if self.k[self.p] == "this":
                    self.p += 1
                else:
                    self.ident()
                while self.eat("."):
                    self.eat("#")
                    self.name()
                if self.k[self.p] == "<" and not self.nl[self.p]:
                    self.type_args()
        elif k == "import":
            self.p += 1
            self.need("(")
            self.type()
            if self.eat(","):
                self.assign()
            self.need(")")
            while self.eat("."):
                self.name()
            if self.k[self.p] == "<":
                self.type_args()
        else:
            self.ident()
            while self.eat("."):
                self.name()
            if self.k[self.p] in ("<", "<<") and not self.nl[self.p]:
                self.type_args()
        while self.k[self.p] == "[" and not self.nl[self.p]:
            self.p += 1
            if not self.eat("]"):
                self.type()
                self.need("]")

    def index_signature(self) -> None:
        self.need("[")
        self.ident()
        self.need(":")
        self.type()
        self.need("]")
        if self.eat(":"):
            self.type()

    def object_type(self) -> None:
        self.need("{")
        save, self.no_cond_type = self.no_cond_type, False
        while not self.eat("}"):
            self.type_member()
            if self.k[self.p] in (";", ","):
                self.p += 1
            elif self.k[self.p] != "}" and not self.nl[self.p]:
                self.bad()
        self.no_cond_type = save

    def type_member(self) -> None:
        k = self.k[self.p]
        if k in ("(", "<"):
            self.type_params()
            self.params()
            if self.eat(":"):
                self.return_type()
            return
        if k == "new" and self.k[self.p + 1] in ("(", "<"):
            self.p += 1
            self.type_member()
            return
        ends = ("(", "<", ":", "?", ",", ";", "}")
        if k in ("+", "-"):
            self.p += 1
            if not self.word("readonly"):
                self.bad()
        if self.word("readonly") and self.k[self.p + 1] not in ends:
            self.p += 1
        if self.word("get", "set") and self.k[self.p + 1] not in ends:
            self.p += 1
        if self.k[self.p] == "[":
            if self.is_ident(self.p + 1) and self.k[self.p + 2] == ":":
                self.index_signature()
                return
            if self.is_ident(self.p + 1) and self.k[self.p + 2] == "in":
                self.p += 3
                self.type()
                if self.word("as"):
                    self.p += 1
                    self.type()
                self.need("]")
                if self.k[self.p] in ("+", "-"):
                    self.p += 1
                    if self.k[self.p] != "?":
                        self.bad()
                self.eat("?")
                if self.eat(":"):
                    self.type()
                return
        self.prop_name()
        self.eat("?")
        if self.k[self.p] in ("(", "<"):
            self.type_params()
            self.params()
            if self.eat(":"):
                self.return_type()
        elif self.eat(":"):
            self.type()


_SPECIAL = frozenset("async of get set from as type abstract declare namespace module readonly keyof infer is asserts satisfies global override accessor unique out require target meta".split())

_STATEMENTS = {
    "{": Parser.s_block, ";": Parser.s_empty, "if": Parser.s_if, "for": Parser.s_for, "while": Parser.s_while, "do": Parser.s_do, "break": Parser.s_jump, "continue": Parser.s_jump,
    "return": Parser.s_return, "throw": Parser.s_throw, "try": Parser.s_try, "switch": Parser.s_switch, "function": Parser.s_function, "class": Parser.s_class, "debugger": Parser.s_debugger,
    "var": Parser.var, "let": Parser.var, "const": Parser.var, "import": Parser.imports, "export": Parser.export,
}


#: Tokens after which most texts of other languages are refused.
HEAD = 24


def _takes(tokens: tuple, layout: tuple, ts: bool) -> bool | None:
    """None where the tokens end before the grammar can tell."""
    try:
        Parser(tokens, layout, ts).module()
    except Bad:
        return False
    except (IndexError, KeyError):
        if tokens[3]:
            raise
        return None
    return True


def check_ecma(text: str) -> tuple[bool, bool]:
    """(is it an ECMAScript module, is it TypeScript): tokens are made once, and what is the first is the second too."""
    try:
        tokens = _lex(text, HEAD)
        layout = _layout(tokens)
        js = _takes(tokens, layout, False)
        if js:
            return True, True
        ts = None
        if js is False and (ts := _takes(tokens, layout, True)) is not None:
            return False, ts
        tokens = _lex(text)
        layout = _layout(tokens)
        if js is None and _takes(tokens, layout, False):
            return True, True
        return False, bool(_takes(tokens, layout, True))
    except Bad:
        return False, False
