"""Call resolution by its rules, on a fixture with literal expectations: Go is left out, Python resolves bare, bound and self calls, scripts by name."""

import datetime as dt

import pytest

import __spark_entry__ as entry

T = dt.datetime(2025, 1, 1)
SYMBOLS = "id string, project string, file_id string, path string, name string, qualified_name string, kind string, line int, end_line int, analyzer string, confidence string, parent_id string, signature string, exported boolean, recorded_at timestamp, deleted_at timestamp"
RELATIONS = "id string, project string, source_id string, target_id string, target_name string, kind string, path string, line int, analyzer string, confidence string, receiver_type_hint string, recorded_at timestamp"


def sym(i, name, file="f1", parent=None, project="p", qualified=None):
    return (i, project, file, f"{file}.py", name, qualified or name, "function", 1, 9, "python-ast", "exact", parent, None, True, T, None)


def call(i, name, analyzer="python-ast", source="m1", path="a.py", target=None, project="p"):
    return (i, project, source, target, name, "calls", path, 1, analyzer, "heuristic", None, T)


def binding(i, name, target, path="a.py", line=1):
    return (i, "p", "f0", target, name, "import", path, line, "python-ast", "exact", f"binding:{name}", T)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("calls"))
    symbols = [sym("m1", "run", parent="K"), sym("m2", "stop", parent="K"), sym("m3", "stop", "f2", parent="L"), sym("K", "K"), sym("one", "lonely", "f2"), sym("d1", "double", "f1"), sym("d2", "double", "f2"),
               sym("b1", "bound", "f1"), sym("b2", "bound", "f2"), sym("x1", "lonely", "f9", project="q"), sym("w", "tail", "f3", qualified="whole.tail"), sym("t", "end", "f3")]
    calls = [call("bare", "lonely"), call("two", "double"), call("go", "lonely", "go-syntax"), call("dotted", "some.lonely"), call("self", "self.stop"), call("cls", "cls.stop", source="K"), call("deep", "self.model.stop"),
             call("viaimport", "bound"), call("member", "mod.double"), call("unbound", "nomod.double"), call("script", "whole.tail", "javascript-regex"), call("scripttail", "some.where.end", "javascript-regex"),
             call("scripttwo", "any.double", "javascript-regex"), call("known", "lonely", target="one"), call("otherpath", "bound", path="z.py"), call("other", "lonely", project="q")]
    imports = [binding("i1", "bound", "f1", line=1), binding("i2", "bound", "f2", line=2), binding("i3", "mod", "f2")]
    spark.createDataFrame(symbols, SYMBOLS).write.parquet(f"{d}/symbols.parquet")
    spark.createDataFrame(calls + imports, RELATIONS).write.parquet(f"{d}/relationships.parquet")
    return d


@pytest.mark.parametrize("name, want", [
    ("join02_unique_calls", {("bare", "one"), ("script", "w"), ("other", "x1")}),
    ("join02_last_part_calls", {("scripttail", "t")}),
    ("join03_bound_calls", {("viaimport", "b2"), ("member", "d2")}),
    ("join04_self_calls", {("self", "m2")}),
])
def test_rules(spark, folder, name, want):
    assert {tuple(r) for r in entry.queries()[name](spark, folder).select("ref_id", "target").collect()} == want


def test_bindings(spark, folder):
    assert {(r.path, r.binding, r.target) for r in entry.queries()["join03_import_bindings"](spark, folder).collect()} == {("a.py", "bound", "f2"), ("a.py", "mod", "f2")}
