import json
import re
import tomllib
import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm.grammars import accepts, ecma
from marlstone.llm.syntax import failed, parse_files, parse_rates, rank_languages, verdict

GOOD = {
    "javascript": [
        "a = b\n/re/g.test(x)", "x = a / b / c", "if (x) /re/.exec(y)", "let {a, b: [c = 1], ...d} = e; [a, b] = [b, a]; ({a, b} = c);", "for await (const x of y) {}",
        "class A extends B { #x = 1; static { this.z = 1 } get a() { return this.#x } async *g() { yield* x } has(o) { return #x in o } }", "label: for (;;) { continue label }",
        "export default class {}\nexport * as ns from 'x'; import d, * as e from 'z'; import j from './a.json' with { type: 'json' };", "`a${`b${c}`}d`; tag`x${1}`", "a?.b?.[c]?.(d) ?? e",
        "x = y ? (a) : b => c", "var x = {get, set, async, get a() { return 1 }, async *d() {}, [e]: 1, if: 5}", "x = a\n++b", "0.5; .5e3; 1_000; 0xff; 10n; 1..toString()", "a = {b: 1}\n[c]", "var a = /[/]\\//u",
        "import.meta.url; await import('x')", "#!/usr/bin/env node\nx", "const s = '<<<<<<< HEAD';", "",
    ],
    "typescript": [
        "let x: number = 1; const y: Array<Map<string, number>> = []; let z!: string;", "interface A<T extends B = C> extends D { a?: string; readonly c: T[]; (x: number): string; [k: string]: any; m<T>(x: T): void }",
        "type X = { [K in keyof T]?: T[K] }; type Y<T> = T extends (infer U)[] ? U : never; type Z = `a${B}`; type T1 = [a: string, b?: number, ...c: X[]]", "enum A { B = 1, C = 'x' }",
        "abstract class A<T> extends B<T> implements C { private readonly x: number = 1; constructor(private a: string) { super() } abstract foo(): void; static x?: string }",
        "const f = async <T,>(x: T): Promise<T> => x;", "let a = x as unknown as string; let b = <string>y; let d = a!.b; x satisfies Y", "declare module 'x' { export function f(): void; }", "import type { A } from 'b'; import x = require('y'); export = z;",
        "@Dec() class A { @Prop() x: string }", "f<string>(x); a < b; a > b;", "x = y ? (a) : b => c", "let a: A<B<C<D>>> = 1; let b = x >> 2", "if (a < b && c > d) {}",
    ],
    "go": [
        "package a\n\nimport (\n\t\"fmt\"\n\tb \"c\"\n)\n\ntype T struct {\n\tA, B int `json:\"a\"`\n\t*C\n}\n\nfunc (s *T) M(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[1]; ok && v > 2 {\n\t\treturn\n\t}\n\tfor i := 0; i < 10; i++ {\n\t}\n\tswitch x := y.(type) {\n\tcase int, *string:\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-c:\n\t}\n\tgo f(x...)\n\ta := []T{{1, 2}, {A: 3}}\n\te := a[1:2:3]\n\treturn 1, nil\n}\n",
        "package a\nfunc F[T any, U ~int|~string](x T) (T, error) { return G[int, string]{}, nil }\nfunc noBody(x int)\n", "package x\nvar a = 'x'\nvar c = `raw\n\"`\nvar d = 0x1F + 1e3 + 1_000\n", "package p\nfunc f() { if x := g(); x != nil { return }; for ; ; { }; switch { case a > b: } }\n",
    ],
    "python": ["match x:\n    case {'a': [1, *_]}: pass\n", "type A[T] = list[T]\n", "x = '<<<<<<< HEAD'\n", "return 1\n"],
    "json": ['{"a": [1, 2.5e3, null, true, "\\u00e9"]}', "3"],
    "toml": ["a = 1\n[b]\nc = 'x'\n[[d]]\ne = 2020-01-01\n"],
}
BAD = {
    "javascript": ["let a = ;", "const x;", "x = = 1", "return 1", "const rows == [];", "with (a) {}", "012", "x = {a = 1}", "1 = 2", "f() = 1", "a ?? b || c", "-a ** b", "break", "export { if }", "'abc", "`abc", "x = [1 2]", "foo(a b)", "let a; if (a) { } }",
                   "@@ -1 +1 @@", "import os\nimport re", "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> b", "x = “a”", "interface X { a: string }", "import { a } from 'b' c", "async () => await", "const {a};", "export const f = async (x) => {\n  return x;\n"],
    "typescript": ["let x: = 1", "interface A { a: string b: number }", "type X = ;", "enum { A }", "class A { x: }", "let x: Array<string = 1", "rows :: number", "const p = { a: 28, ...packet ;"],
    "go": ["package", "package a\nvar rows = = 1", "func f() {}", "package a\nfunc f() { x := }", "package a\nimport fmt", "package a\nx := 1", "package a\nvar s = \"abc", "package a\nfunc f()\n{\n}", "package a\nfunc f() { x := []int{\n1,\n2\n}\n}", "package a\nfunc {{.Name}}() {}"],
    "python": ["print 'x'\n", "def f(:\n", "x = (1\n", "<<<<<<< HEAD\n", "  x = 1\ny = 2\n"],
    "json": ["{'a': 1}", "[1,]", "NaN", '{"a": 1} x', "// c\n1", '"a\nb"', ""],
    "toml": ["a = \n", "[a\n", "a = 1\na = 2\n", "a = 'x\n"],
}


@pytest.mark.parametrize("language", sorted(GOOD))
def test_accepts_and_refuses(language):
    assert [x for x in GOOD[language] if not accepts(language, x)] == []
    assert [x for x in BAD[language] if accepts(language, x)] == []


def test_typescript_takes_javascript():
    assert [x for x in GOOD["javascript"] if not accepts("typescript", x)] == []


@given(st.text(alphabet="{}[]()'\"`/\\;:,.=<>+-*!?ab1 \n\t#@$", max_size=60))
@settings(max_examples=300, deadline=None)
def test_no_input_breaks_a_parser(text):
    for k in GOOD:
        with warnings.catch_warnings():
            warnings.simplefilter('ignore')
            assert accepts(k, text) in (True, False)


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=4), c, max_size=3), max_leaves=8))
@settings(max_examples=100, deadline=None)
def test_json_round_trip(value):
    text = json.dumps(value, ensure_ascii=False)
    assert accepts("json", text)
    assert accepts("javascript", f"x = {json.dumps(value)};")


def test_a_text_may_end_anywhere():
    for text in ("a:", "export", "declare :", "type", "async", "abstract", "import", "a: b:"):
        for language in ("javascript", "typescript"):
            assert accepts(language, text) is (text in ("type", "async", "abstract")), (language, text)
    assert verdict("a.ts", "a:")[4] == "corrupt"


def test_lines_read_at_once_give_the_tokens_of_each(monkeypatch):
    """Texts of plain lines, and of plain lines between templates, slashes and numbers that are none."""
    odd = ["x = a / b", "`a${", "b", "}c`", "/re/.test(x)", "// c / d", "/* e", "*/", "1a", "x = 1.a", "'a\\\nb'", "if (x)", "/y/.z", "é = 1", "a ? b : c", "'\\u12'"]
    pieces = [*GOOD["javascript"], *GOOD["typescript"], *BAD["javascript"], *odd]
    texts = ["\n".join(pieces[i : i + n]) for n in (1, 2, 3, 5) for i in range(len(pieces))]

    def tokens():
        out = []
        for t in texts:
            try:
                out.append(ecma._lex(t))
            except ecma.Bad:
                out.append(None)
        return out

    at_once = tokens()
    monkeypatch.setattr(ecma, "_TIED", re.compile(""))
    assert at_once == tokens() and sum(x is not None for x in at_once) > 100


def test_memo_depends_on_context():
    assert accepts("javascript", "function f() {\n  return x;\n}\n")
    assert not accepts("javascript", "return x;\n")
    assert accepts("javascript", "for (;;) {\n  break;\n}\n") and not accepts("javascript", "if (a) {\n  break;\n}\n")
    assert accepts("javascript", "async function f() {\n  const a = await b;\n}\n") and not accepts("javascript", "function f() {\n  const a = await b;\n}\n")


def test_deep_nesting_and_long_texts():
    """Depth decides nothing: what is refused flat is refused deep, and the other way round."""
    for n in (300, 3_000, 30_000):
        deep = "[" * n + "]" * n
        for language, text in {"javascript": f"x = {deep}", "typescript": f"x = {deep}", "json": deep, "toml": f"a = {deep}"}.items():
            assert accepts(language, text) is True, (language, n)
            assert accepts(language, text[:-1]) is False and accepts(language, text + "]") is False, (language, n)
    assert accepts("go", "package a\nvar x = " + "(" * 3000 + "1" + ")" * 3000 + "\n") is True and accepts("go", "package a\nvar x = " + "(" * 3000 + ")" * 3000 + "\n") is False
    assert accepts("json", "[" * 200_000) is False and accepts("javascript", "x=" + "!" * 5_000 + "@@@") is False and accepts("toml", "a=" + "[" * 5_000) is False
    assert accepts("json", '{"a":[1,' * 50_000 + "2" + "]}" * 50_000) is True and accepts("json", '{"a":[1,' * 50_000 + "]}" * 50_000) is False
    assert verdict("a.json", "[" * 200_000)[4] == "corrupt" and verdict("a.js", "x=" + "[" * 5_000)[4] == "corrupt"
    assert accepts("python", "x = " + "(" * 300 + ")" * 300) is False and accepts("python", "x = " + "-" * 100_000 + "1") is None
    assert verdict("a.py", "x = " + "-" * 100_000 + "1")[4] != "valid" and accepts("python", "x = 1" + " + 1" * 50_000) is True
    assert accepts("go", "package a\n" + "var x = 1\n" * 30000)


def test_first_tokens_decide_as_the_whole():
    """Texts longer than the tokens read first, valid and broken at the far end."""
    for language, line in {"javascript": "f(a, [b, c], {d: e});\n", "typescript": "let x: Map<string, number[]> = f(a) as any;\n", "go": "var x = f(a, b)\n"}.items():
        text = ("package a\n" if language == "go" else "") + line * 200
        assert accepts(language, text) is True and accepts(language, text + "x = = 1\n") is False and accepts(language, text + "f((\n") is False


def test_verdicts(spark):
    rows = [("1", "p", "a.py", "x = 1"), ("2", "p", "b.py", "package a\n\nfunc f() {}\n"), ("3", "p", "c.js", "let a = ;;;("), ("4", "p", "d.ts", None), ("5", "p", "e.go", " \n"), ("6", "q", "f.txt", "x"), ("7", None, None, "x"), ("2", "p", "b.py", "package a\n\nfunc f() {}\n")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "file_id string, project string, path string, text string, status string")
    got = {r.file_id: (r.language, r.parsed_as, r.status) for r in parse_files(df).collect()}
    assert got["1"] == ("python", "python", "valid") and got["2"] == ("python", "go", "wrong_ending") and got["3"] == ("javascript", None, "corrupt")
    assert got["4"][2] == got["5"][2] == "empty" and got["6"][2] == got["7"][2] == "unchecked"
    rates = {(r.project, r.language): (r.files, r.failed, r.wrong_ending) for r in parse_rates(parse_files(df)).collect()}
    assert rates == {("p", "python"): (2, 1, 1), ("p", "javascript"): (1, 1, 0)}
    assert parse_files(df.limit(0)).count() == 0
    matrix = {r.file_id: (r.language, r.accepted) for r in parse_files(df).where("status <> 'empty'").collect()}
    assert matrix["2"] == ("python", ["go"]) and matrix["3"] == ("javascript", []) and set(matrix) == {"1", "2", "3", "6", "7"}
    assert {r.file_id for r in failed(parse_files(df)).collect()} == {"2", "3"}
    assert rank_languages("package a\nfunc f() {\n}\n")[0] == "go"
    assert verdict("a.toml", "a = 1")[4] == "valid" and tomllib.loads("a = 1")
