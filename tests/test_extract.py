from marlstone.sources import extract as ex


def kinds(facts, tag):
    return {(f.get("kind"), f.get("qualified_name") or f.get("target_name")) for f in facts if f["tag"] == tag}


def test_python():
    src = "import os\nfrom .m import a as b\n@deco()\nclass C:\n    def m(self, x=call()):\n        self.k()\n        os.path.join(x)\nasync def f():\n    pass\n"
    facts = ex.python_facts("f1", "p/a.py", src)
    assert kinds(facts, "symbol") == {("class", "C"), ("method", "C.m"), ("async-function", "f")}
    assert {f["name"]: f["signature"] for f in facts if f["tag"] == "symbol"} == {"C": None, "m": "self, x=call()", "f": ""}
    assert {f["target_name"] for f in facts if f.get("kind") == "contains"} == {"C", "C.m", "f"}
    assert {("calls", "self.k"), ("calls", "os.path.join"), ("import", "os"), ("import", "m.a")} <= kinds(facts, "edge")
    assert ("calls", "deco") not in kinds(facts, "edge") and ("calls", "call") not in kinds(facts, "edge")
    assert [f["name"] for f in ex.python_facts("f", "a.py", "def f(:\n")] == ["python-syntax-error"]


def test_javascript():
    facts = ex.javascript_facts("f", "a/b.ts", "import x from './y';\nexport class K {}\nconst go = async (a) => 1;\nfunction h() {}\n")
    assert kinds(facts, "symbol") == {("class", "K"), ("function", "go"), ("function", "h")}
    assert {f["name"]: f["signature"] for f in facts if f["tag"] == "symbol"} == {"K": None, "go": "(a)", "h": "()"}
    assert ("import", "./y") in kinds(facts, "edge")


def test_go():
    src = 'package a\nimport (\n\t"fmt"\n\tq "x/y"\n)\ntype T struct{ A int }\ntype I interface { M() error }\nfunc (t *T) Run(n func()) { fmt.Println(); helper(); n() }\nfunc helper() {}\n'
    facts = ex.go_facts("f", "a.go", src)
    assert kinds(facts, "symbol") == {("struct", "T"), ("interface", "I"), ("interface-method", "I.M"), ("method", "T.Run"), ("function", "helper")}
    calls = {f["target_name"]: f for f in facts if f.get("kind") == "calls"}
    assert calls["helper"]["target_id"] and calls["fmt.Println"]["target_id"] is None and calls["n"]["confidence"] == "syntax-shadowed-unresolved"
    assert {("go-import-alias", "fmt=fmt"), ("go-import-alias", "q=x/y")} <= kinds(facts, "edge")
    assert ex.go_facts("f", "a.go", "package a\nfunc f( {")[0]["name"] == "go-unbalanced"


def test_boundaries_are_conservative():
    ok = "from fastapi import FastAPI\napp = FastAPI()\n@app.get('/x')\ndef f(): pass\n"
    assert ex.python_boundaries("a.py", ok) == [("http-route", "GET /x", 4)]
    assert ex.python_boundaries("a.py", ok.replace("app = FastAPI()", "app = FastAPI()\napp = other()")) == []
    assert ex.python_boundaries("a.py", "app.get('/x')\n") == []
    assert ex.javascript_boundaries("a.js", "const app = express();\napp.post('/y', h);\n") == [("http-route", "POST /y", 2)]


def test_entry_lines():
    assert ex.entry_line("x/main.py", "import a\nif __name__ == '__main__':\n    a.run()\n") == 2
    assert ex.entry_line("x/other.py", "#!/bin/sh\n") is None
    assert ex.entry_line("main.go", "package main\n\nfunc main() {}\n") == 3
    assert ex.entry_line("server.js", "const app = x();\napp.listen(3)\n") == 2


def test_structure_digest_ignores_bodies():
    a, b, c = (ex.python_structure_digest(s) for s in ("def f(x):\n    return 1\n", "def f(x):\n    return 2\n", "def f(y):\n    return 1\n"))
    d = [ex.python_structure_digest(t) for t in ("class A:\n    x: int = 1\n", "class A:\n    x: str = 1\n", "class A:\n    x: int = 2\n", "class A(k=1):\n    x: int = 1\n")]
    assert d[0] == d[2] and len({d[0], d[1], d[3]}) == 3
    assert a == b != c and ex.python_structure_digest("def (") is None


def test_extract_survives_nulls_and_failures(spark):
    df = spark.createDataFrame([("1", "a.py", "def f(): pass"), ("2", "b.py", None), ("3", None, "x"), ("4", "c.py", "("), ("5", "d.go", "")], "file_id string, path string, text string")
    tags = {(r.file_id, r.tag) for r in ex.extract(df).collect()}
    assert tags == {("1", "symbol"), ("1", "edge"), ("4", "diagnostic")}
