import hashlib

from pyspark.sql import functions as F

from marlstone.functions import paths as fp
from marlstone.functions import redact as fr
from marlstone.functions import text as ft
from marlstone.functions.keys import clean_key, clean_path


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first().y


def test_keys_and_paths(spark):
    assert one(spark, " \u00a0a b\n", clean_key("x")) == "a b"
    assert one(spark, "\t ", clean_key("x")) is None
    assert one(spark, ".\\src\\a.py", clean_path("x")) == "src/a.py"
    assert one(spark, "a/../b", fp.safe_path("x")) is None
    assert one(spark, "./a//b.py", fp.safe_path("x")) == "a/b.py"


def test_stable_id_matches_hashlib(spark):
    want = "symbol_" + hashlib.sha1("symbol\x1fa.py\x1fNone\x1f3".encode()).hexdigest()[:16]
    got = spark.createDataFrame([("a.py", None, 3)], "p string, q string, n int").select(ft.stable_id("symbol", "p", "q", "n").alias("i")).first().i
    assert got == want


def test_tokens(spark):
    assert one(spark, "getHTTPResponse_codeX", ft.split_tokens("x")) == ["get", "httpresponse", "code", "x"]
    assert one(spark, "v2Store", ft.token_set("x")) == ["v2", "store"]


def test_lines_follow_splitlines(spark):
    for t in ["", "a", "a\n", "a\r\nb", "a\u2028b\x0bc", "a\n\n", "\n"]:
        assert one(spark, t, ft.source_lines("x")) == t.splitlines(), repr(t)


def test_language_and_roles(spark):
    assert one(spark, "a/LICENSE.txt", fp.language_of("x")) == "License"
    assert one(spark, "docs/ReadMe", fp.language_of("x")) == "Markdown"
    assert one(spark, "a/b.TSX", fp.language_of("x")) == "TypeScript"
    assert one(spark, "a/.hidden", fp.language_of("x")) is None
    assert one(spark, "src/user_store.py", fp.file_role("x")) == "persistence"
    assert one(spark, "tests/main.py", fp.file_role("x")) == "test"
    assert one(spark, "x/y/z/w/a.py", fp.module_view("x")) == "x/y/z"
    assert one(spark, "packages/y/z/a.py", fp.module_view("x")) == "packages/y"
    assert one(spark, "/w/source-slice/src/a.py", fp.slice_path("x")) == "src/a.py"


def test_redaction_families(spark):
    cases = {
        "k = 'ghp_" + "a" * 24 + "'": "ghp_",
        "password: hunter22": "hunter22",
        "url = postgres://u:pw123@host/x": "pw123",
        "Authorization: Bearer abc.def": "abc.def",
        "-----BEGIN RSA PRIVATE KEY-----\nAAAA\n-----END RSA PRIVATE KEY-----": "AAAA",
    }
    for text, secret in cases.items():
        assert secret not in one(spark, text, fr.redact_text("x"))
    plain = "for token in tokens: total += len(token)"
    assert one(spark, plain, fr.redact_opaque("x")) == plain


def test_record_redaction_keeps_structure(spark):
    df = spark.createDataFrame([(("glpat-" + "a" * 14, "password=abc def"), [None])], "r struct<id:string,snippet:string>, l array<string>")
    out = df.select(*[fr.redact_record(F.col(f.name), f.dataType, f.name).alias(f.name) for f in df.schema.fields]).first()
    assert out.r.id == "[REDACTED]" and "abc" not in out.r.snippet and out.l == [None]


def test_remotes(spark):
    assert one(spark, "https://user:tok@git.example/a/b.git?x=1", fp.clean_remote("x")) == "https://git.example/a/b.git"
    assert one(spark, "git@git.example:a/b.git", fp.clean_remote("x")) == "git@git.example:a/b.git"
    assert one(spark, "tok@git.example:a/b.git", fp.clean_remote("x")) == "git.example:a/b.git"
    assert one(spark, "https://Git.Example/A/b.git/", fp.remote_identity("x")) == "git.example/a/b"
    assert one(spark, "https://u:p@git.example/a", fp.remote_identity("x")) == ""


def test_head_and_tail_and_json(spark):
    t = one(spark, "ä" * 400, ft.head_and_tail("x", F.lit(101)))
    assert len(t.encode()) <= 101 and "..." in t
    assert one(spark, ' {"b": 1, "a": 2} ', ft.single_json_object("x")) == '{"a":2,"b":1}'
    assert one(spark, '{"a": 1} trailing', ft.single_json_object("x")) is None
