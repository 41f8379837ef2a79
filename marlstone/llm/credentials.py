"""Credentials in source code and configuration: where they begin, and the text with only their values replaced.

Method: the words of the collection are counted over all texts and make a dictionary. Literals in telling places (assigned
to a secret-like name, in an authorisation header, the user part of a URL, a login option, a note that says a password
works, the form of a provider's token) are candidates; their runs of letters are segmented into dictionary words by
Viterbi, and what no word explains is the residual. A candidate is a secret where its residual reaches the threshold its
context sets, and never without one. Only private keys count without a residual, at their BEGIN line, when key material
follows. Placeholders, masks, UUIDs, references to variables, files or names are none; digest forms are none where the
context is only a header, a note or a token form, and count where a secret-like name holds them (an API key may be
hexadecimal; names of digests and commits are not secret-like).

Thresholds (``need``): STRICT characters of the strict residual (letters no word explains; long numbers) anywhere; in
places that announce a secret, a value of mixed kinds needs LOOSE characters of the loose residual (digits and signs count
as well, a word never).

The dictionary is not bounded: the runs' substrings meet it in a join. Every stage is distributed, a text is read whole,
and a value that fills a third of all rows is scored once.

Null and empty texts hold nothing; a repeated row gives its places again (distinct rows in the query). Extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import Workspace

#: A word stands in at least so many texts and has so many letters.
MIN_DOCS = 3
SHORTEST, LONGEST = 3, 40
STRICT, LOOSE = 8, 2
REPLACEMENT = "REDACTED"

# -- the dictionary


def corpus_words(texts: DataFrame) -> DataFrame:
    """(word, n): words and the number of texts they stand in, counted with map-side combine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[str, int] = {}
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["word", "n"])
        for b in batches:
            for t in b.column(0).to_pylist():
                for w in set(map(str.lower, _WORDS.findall(t))) if t else ():
                    count[w] = count.get(w, 0) + 1
            if len(count) > 200_000:
                yield batch()
                count = {}
        yield batch()

    return texts.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_DOCS)


#: Words of running text and of names: no digit on either side, so that random strings give few.
_WORDS = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z]{3,40}(?![A-Za-z0-9+/=])|(?<=_)[a-z]{3,40}(?=_|\b)")
_RUNS = re.compile(r"[A-Za-z]+|\d+")
_SOLID = re.compile(r"[A-Za-z0-9]+")
#: Changes between letters and digits without a sign between them that make a value random.
TURNS = 5
LETTER = 7.0


def unexplained(run: str, cost: dict[str, float]) -> int:
    """Letters of a run that the cheapest segmentation leaves over: words cost their surprise, single letters a fixed price."""
    n = len(run)
    best = [0.0] + [math.inf] * n
    left = [0] * (n + 1)
    top = max(map(len, cost), default=0)
    for i in range(n):
        c = best[i] + LETTER
        if c < best[i + 1]:
            best[i + 1], left[i + 1] = c, left[i] + 1
        for j in range(i + SHORTEST, min(n, i + top) + 1):
            w = cost.get(run[i:j])
            if w is not None and best[i] + w < best[j]:
                best[j], left[j] = best[i] + w, left[i]
    return left[n]


def surprise(n: int, total: float) -> float:
    return min(12.0, -math.log(n / total))


def letter_runs(value: str) -> list[str]:
    """The runs to segment, in lower case; one or two different letters explain themselves."""
    return [r.lower() for r in _RUNS.findall(value) if not r.isdigit() and len(set(r)) > 2]


def residuals(value: str, letters: int) -> tuple[int, int]:
    """(strict, loose) residual of a value whose runs leave so many letters unexplained."""
    runs = _RUNS.findall(value)
    numbers = [r for r in runs if r.isdigit()]
    strict = letters + sum(len(r) for r in numbers if len(r) > 4 and len(set(r)) > 2)
    short = sum(len(r) for r in numbers if len(r) <= 4)
    if len(runs) - len(_SOLID.findall(value)) >= TURNS:
        # Letters and digits in turns, as in hexadecimal: no run of them is a word, however short.
        strict += short + sum(len(r) for r in runs if not r.isdigit() and len(set(r)) <= 2)
    elif strict >= 4 and sum(map(len, numbers)) >= 3:
        strict += short
    return strict, letters + sum(map(len, numbers)) + sum(not c.isalnum() and c not in "_-./: " for c in value)


# -- contexts

_NAME = r"[A-Za-z_$][\w$.\-]*"
#: name = "value" in the forms of code and configuration; a value may go on as + "value".
#: The match begins at the telling part of the name; what of the name stands before it is read backwards.
_ASSIGN = re.compile(r"""(?P<name>(?:[pP](?:ass|ASS|wd|WD|arola)|(?<=[pP])(?:wd|WD)|PWD|[sS](?:ecret|ECRET|enha|ENHA)|[tT](?:oken|OKEN)|[cC](?:ontrase|ONTRASE|redential|REDENTIAL)|[kK](?:ey|EY|ennwort|ENNWORT)|[aA](?:uth|UTH)|[mM](?:dp|DP))[\w$.\-]*)["'`]?\]?\s*(?::\s*(?:string|str|String)\s*=|:=|=>|[:=])\s*(?:[bruf]{0,2}|String\.raw)(?P<q>["'`])(?P<value>(?:(?!(?P=q))[^\n\\]|\\.)*)(?P=q)""")
_MORE = re.compile(r"""\s*(?:\+|\.|\\\n)\s*(["'`])((?:(?!\1)[^\n\\]|\\.)*)\1""")
_BARE = re.compile(rf"""(?m)^[ \t]*(?:export[ \t]+|set[ \t]+|ENV[ \t]+|-[ \t]+)?(?P<name>{_NAME})(?:[ \t]*=[ \t]*|:[ \t]+)(?P<value>[^\s"'`{{\[(<$][^\s"'`]*)[ \t]*(?:#.*)?\r?$""")
_SECRET_NAME = re.compile(r"pass(?:word|wd|wort|phrase|code)|passw|pwd|secret|token|contrase|kennwort|senha|parola|motdepasse|mdp$|dbpass|userpass|pass$|credential|api_?key|access_?key|signing_?key|encryption_?key|private_?key|secret_?key|auth_?key|master_?key|client_?key|webhook_?key|service_?key|account_?key|shared_?key|auth$")
_OTHER_NAME = re.compile(r"(?:kind|hint|name|type|file|path|dir|folder|count|limit|len|length|size|id|ids|url|uri|host|env|var|ref|label|title|field|column|header|regex|pattern|prefix|suffix|format|policy|rule|rules|sha\d*|digest|hash|checksum|salt|iv|nonce|public|expiry|ttl|timeout|index|table|class|method|scope|scopes|issuer|endpoint|algorithm|alg|placeholder|example|help|text|message|msg|description|error)s?$")
_TAIL = re.compile(r"(?:[_\-.]?(?:main|prod|production|old|new|dev|test|staging|live|backup|a|b|\d+))+$")
#: Forms of providers' tokens (fixed values).
_TOKENS = re.compile(
    r"(?<![A-Za-z0-9_\-/+])(?:(?:AKIA|ASIA|AIDA|AROA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_\-]{18,}|xox[abeoprs]-[A-Za-z0-9\-]{16,}|npm_[A-Za-z0-9]{30,}"
    r"|(?:sk|rk|pk)[-_](?:live|test|proj|ant|svcacct)[-_][A-Za-z0-9_\-]{16,}|sk-[A-Za-z0-9]{24,}|[a-z]{2,5}_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{30,}|ya29\.[A-Za-z0-9_\-]{20,}|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}"
    r"|hf_[A-Za-z0-9]{30,}|pypi-[A-Za-z0-9_\-]{32,}|dop_v1_[a-f0-9]{40,}|shp(?:at|ss|ca|pa)_[a-fA-F0-9]{30,}|eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})(?![A-Za-z0-9_])")
_URL = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.\-]{1,20}://(?P<user>[^\s/:@\"'`<>]*):(?P<value>[^\s/@\"'`<>]{3,})@(?=[\w\[$<{])")
_HEADER = re.compile(r"(?i)\b(?P<kind>bearer|basic|token)[ \t]+(?P<value>[A-Za-z0-9+/=_\-.~]{12,})")
_LOGIN = re.compile(r"(?:(?<=\s)-u[ \t]*|--user[ =])[\"']?(?P<user>[\w.\-]+):(?P<value>[^\s\"'`:]{4,})")
_SQL = re.compile(r"(?i)\b(?:identified[ \t]+(?:with[ \t]+\w+[ \t]+)?by|with[ \t]+password|set[ \t]+password[ \t]*=|encrypted[ \t]+password)[ \t]+'(?P<value>[^'\n]{4,})'")
_PART = re.compile(r"(?i)(?:^|[;,&? \"'`])(?P<name>pwd|password|passwd|pass|accountkey|sharedaccesskey|secret|api_?key|access_?token|sig)=(?P<value>[^;,&\s\"'`]{4,})")
_NOTE = re.compile(r"(?i)\b(?:pw|password|passwd|pass|passwort|login|key|token|secret|passphrase|credentials?)\b[^:;.\n`'\"]*(?::[ \t]+)?(?P<q>[`'\"]?)(?P<value>[^\s`'\"]{8,})(?P=q)")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----(?P<body>(?:\\[nr]|\s|[\"'+,#*|>`]|//|Proc-Type:[^\n]*|DEK-Info:[^\n]*)*(?P<value>[A-Za-z0-9+/=]{16,}(?:(?:\\[nr]|[\s\"'+,#*|>`\\]|//)*[A-Za-z0-9+/=]{4,})*))")
_PLACEHOLDER = re.compile(
    r"(?i)^(?:.*(?:\$\{|\$\(|\{\{|%\(|<[^>]*>|\[[^\]]*\]|example|placeholder|changeme|change[-_ ]?me|your[-_ ]|insert|redacted|dummy|sample|fixme|todo|xxxx|\*{3,}|\.\.\.|…|process\.env|os\.environ|getenv|env\[|secretref|secret_ref|not[-_ ]?a[-_ ]?real|fake|replace|123456|abcdef|qwerty|test[-_]?only|null|none|undefined).*|\$\w+|%\w+%|@\w+@|/[\w./\-]*|~?/?(?:run|etc|var)/.*|[\w.\-]+/[\w./\-]+\.\w+|vault:.*|ref:.*|env:.*|file:.*|ssm:.*|arn:.*|op://.*)$")
_UUID = re.compile(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
_DIGEST = re.compile(r"^(?:sha(?:1|224|256|384|512)|md5|blake\w*)[-:=]?[A-Za-z0-9+/=]{16,}$|^[0-9a-f]{32}$|^[0-9a-f]{40}$|^[0-9a-f]{56}$|^[0-9a-f]{64}$|^[0-9a-f]{96}$|^[0-9a-f]{128}$", re.I)


#: What a text must hold, in lower case, before its patterns are tried; each follows from its pattern.
_TOKEN_MARKS = ("akia", "asia", "aida", "aroa", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "npm_", "sk-", "sk_", "rk-", "rk_", "pk-", "pk_", "_live_", "_test_", "aiza", "ya29.", "sg.", "hf_", "pypi-", "dop_v1_", "shpat_", "shpss_", "shpca_", "shppa_", "eyj")
_PART_MARKS = ("pwd=", "password=", "passwd=", "pass=", "accountkey=", "sharedaccesskey=", "secret=", "api_key=", "apikey=", "access_token=", "accesstoken=", "sig=")
_NAME_MARKS = ("pass", "pwd", "parola", "secret", "senha", "token", "contrase", "credential", "key", "kennwort", "auth", "mdp")


@lru_cache(maxsize=100_000)
def secret_name(name: str) -> bool:
    """Does the name say that its value is a secret?"""
    flat = name.split(".")[-1] if not name.isupper() else name
    low = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", flat).lower().replace("-", "_")
    low = _TAIL.sub("", low).strip("_")
    if not _SECRET_NAME.search(low) and not _SECRET_NAME.search(low.replace("_", "")):
        return False
    last = low.rsplit("_", 1)[-1]
    return not (_OTHER_NAME.fullmatch(last) and not _SECRET_NAME.search(last))


def password_shape(v: str) -> bool:
    """Mixed like a chosen password: letters of both cases or a sign, and a digit, without spaces."""
    if len(v) < 6 or any(c.isspace() for c in v) or not v.isprintable():
        return False
    kinds = any(c.islower() for c in v) + any(c.isupper() for c in v) + any(c.isdigit() for c in v) + any(not c.isalnum() and c not in "_-./:" for c in v)
    return kinds >= 3 and any(c.isdigit() for c in v)


@dataclass
class Candidate:
    """A place whose value is a secret if its residual reaches ``need`` (strict) or ``loose`` (loose, None: strict only)."""

    line: int
    parts: list[tuple[int, int]]
    value: str
    need: int
    loose: int | None = None


def _placeholder(v: str) -> bool:
    return len(set(v)) <= 3 or bool(_PLACEHOLDER.match(v))


_NAMES_ONLY = re.compile(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|[a-z]+(?:[-_.][a-z0-9]+)*|[a-z]+(?:[A-Z][a-z]+)*")


def _announced(v: str) -> tuple[int, int | None] | None:
    """Thresholds of a value in a place that announces a secret, None where it can be none."""
    if len(v) < 6 or any(c.isspace() for c in v) or _placeholder(v) or _UUID.match(v):
        return None
    return STRICT, LOOSE if password_shape(v) and not _NAMES_ONLY.fullmatch(v) else None


def _unannounced(v: str) -> tuple[int, int | None] | None:
    if len(v) < 6 or any(c.isspace() for c in v) or _placeholder(v) or _UUID.match(v) or _DIGEST.match(v):
        return None
    return STRICT, None


def _name_at(text: str, i: int) -> int:
    """Where the name begins that goes on at i."""
    while i and (text[i - 1].isalnum() or text[i - 1] in "_$.-"):
        i -= 1
    return i


def candidates(text: str | None) -> list[Candidate]:
    """The telling places of a text, in order; a literal split over several strings is one."""
    if not text:
        return []
    out: list[tuple[list[tuple[int, int]], str, int, int | None]] = []
    keys: list[tuple[int, int, int]] = []
    if "PRIVATE KEY" in text:
        keys = [(m.start(), m.start("value"), m.end("value")) for m in _PEM.finditer(text)]

    def add(start: int, value: str, need: tuple[int, int | None] | None, parts: list[tuple[int, int]] | None = None) -> None:
        if need is not None:
            out.append((parts or [(start, start + len(value))], value, *need))

    low = text.lower()
    has = lambda marks: any(map(low.__contains__, marks))
    for m in _TOKENS.finditer(text) if has(_TOKEN_MARKS) else ():
        if not _placeholder(m[0]):
            out.append(([m.span()], re.sub(r"^[A-Za-z]+[-_.]", "", m[0]), STRICT, None))
    if "://" in text and "@" in text:
        for m in _URL.finditer(text):
            v = m["value"]
            need = _announced(v)
            if not _placeholder(v) and password_like(v):
                need = STRICT, LOOSE
            add(m.start("value"), v, need)
    for m in _HEADER.finditer(text) if has(("bearer", "basic", "token ", "token\t")) else ():
        v = m["value"]
        if m["kind"].lower() == "basic":
            if (word := _basic(v)) is not None:
                out.append(([m.span("value")], word, STRICT, LOOSE))
        else:
            add(m.start("value"), v, _unannounced(v))
    for pattern, marks in ((_LOGIN, ("-u", "--user")), (_SQL, ("identified", "password"))):
        for m in pattern.finditer(text) if has(marks) else ():
            add(m.start("value"), m["value"], _announced(m["value"]))
    for m in _PART.finditer(text) if has(_PART_MARKS) else ():
        if secret_name(m["name"]):
            add(m.start("value"), m["value"], _announced(m["value"]))
    chains: list[tuple[int, int]] = []
    for m in _ASSIGN.finditer(text) if has(_NAME_MARKS) else ():
        i = _name_at(text, m.start())
        while i < m.start() and not (text[i].isalpha() or text[i] in "_$"):
            i += 1
        if secret_name(text[i : m.start()] + m["name"]):
            parts, at = [m.span("value")], m.end()
            whole = m["value"]
            while more := _MORE.match(text, at):
                parts.append(more.span(2))
                whole += more[2]
                at = more.end()
            parts = [p for p in parts if p[0] < p[1]]
            if parts:
                add(parts[0][0], whole, _announced(whole), parts)
                if len(parts) > 1:
                    chains.append((parts[0][0], parts[-1][1]))
    for m in _BARE.finditer(text):
        v = m["value"].rstrip(";,")
        if secret_name(m["name"]) and not re.search(r"[()\[\]{}]|^\w+\.\w+$", v):
            add(m.start("value"), v, _announced(v))
    for m in _NOTE.finditer(text) if has(("pw", "pass", "login", "key", "token", "secret", "credential")) else ():
        v = m["value"].rstrip(".,;:")
        if not re.search(r"[()\[\]{}=<>]|://", v) and (m["q"] or ":" in text[m.start() : m.start("value")]) and _in_prose(text, m.start()):
            add(m.start("value"), v, (STRICT, LOOSE) if password_strong(v) else _unannounced(v))
    found = []
    at = line = 0
    out += [([(v, e)], "", 0, None) for _, v, e in keys]
    begins = {v: b for b, v, _ in keys}
    chain_of = lambda s: next((a for a, e in chains if a <= s < e), s)
    placed = sorted(((begins.get(parts[0][0], chain_of(parts[0][0])), parts, v, need, loose) for parts, v, need, loose in out), key=lambda c: (c[0], c[1]))
    for s, parts, v, need, loose in placed:
        if need and any(b <= parts[0][0] < e for b, _, e in keys):
            continue
        line += text.count("\n", at, s)
        at = s
        found.append(Candidate(line + 1, parts, v, need, loose))
    return found


def passes(c: Candidate, letters: int) -> bool:
    strict, loose = residuals(c.value, letters)
    return strict >= c.need or c.loose is not None and loose >= c.loose


def replace_spans(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], REPLACEMENT]
        at = max(at, e)
    return "".join(out) + text[at:]


class Finder:
    """The same verdicts on single texts, with a dictionary at hand."""

    def __init__(self, words: dict[str, int]):
        total = float(sum(words.values())) or 1.0
        self.cost = {w: surprise(n, total) for w, n in words.items()}

    def find(self, text: str | None) -> list[Candidate]:
        return [c for c in candidates(text) if passes(c, sum(unexplained(r, self.cost) for r in letter_runs(c.value)))]

    def places(self, text: str | None) -> list[int]:
        return sorted({c.line for c in self.find(text)})

    def redact(self, text: str) -> str:
        return replace_spans(text, [p for c in self.find(text) for p in c.parts])


def _in_prose(text: str, at: int) -> bool:
    """Is the place in a comment or in a line of running text?"""
    line = text[text.rfind("\n", 0, at) + 1 : at]
    return bool(re.match(r"\s*(?://|#|--|/?\*|<!--|;)", line)) or not re.search(r"[=(){};]|\"", line)


def password_like(v: str) -> bool:
    return len(v) >= 6 and any(c.isdigit() for c in v) and any(c.isalpha() for c in v)


def password_strong(v: str) -> bool:
    return password_shape(v) and any(c.isdigit() for c in v) and any(not c.isalnum() and c not in "_-./:" for c in v) or password_shape(v) and "_" in v and v[-1] in "!?$%*#&"


def _basic(v: str) -> str | None:
    """The password of a basic authorisation."""
    try:
        user, colon, word = base64.b64decode(v, validate=True).decode("utf-8").partition(":")
    except (binascii.Error, ValueError):
        return None
    return word if colon and user and len(word) >= 4 and word.isprintable() and not _placeholder(word) else None


_CANDIDATE = "record_table string, record_id string, tid bigint, line_no int, starts array<int>, ends array<int>, value string, runs array<string>, need int, loose int"


def literal_candidates(texts: DataFrame) -> DataFrame:
    """texts (record_table, record_id, text) -> one row per candidate; tid tells texts of one record apart."""
    names = [f.split()[0] for f in _CANDIDATE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32()]
        for b in batches:
            rows = []
            for t, i, h, x in zip(*(b.column(k).to_pylist() for k in range(4))):
                for c in candidates(x):
                    # Without letters to explain the verdict is known here; what cannot reach its threshold goes no further.
                    runs = letter_runs(c.value)
                    if passes(c, sum(map(len, runs))):
                        rows.append((t, i, h, c.line, [p[0] for p in c.parts], [p[1] for p in c.parts], c.value, runs, c.need, c.loose))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return texts.select("record_table", "record_id", F.xxhash64("text").alias("tid"), "text").where("text is not null and text <> ''").mapInArrow(run, _CANDIDATE)


def run_residuals(ws: Workspace, runs: DataFrame, words: DataFrame) -> DataFrame:
    """runs (run), distinct -> (run, letters): the letters no word explains; each run meets the words it holds in a join."""
    total = float(words.agg(F.sum("n")).first()[0] or 1)
    names = words.select(F.col("word").alias("run"))
    plain = runs.join(names, "run", "left_semi").select("run", F.lit(0).alias("letters"))
    rest = runs.join(names, "run", "left_anti")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.column(0).to_pylist():
                subs = list({r[i:j] for i in range(len(r)) for j in range(i + SHORTEST, min(len(r), i + LONGEST) + 1)})
                yield pa.RecordBatch.from_arrays([pa.array([r] * len(subs), pa.string()), pa.array(subs, pa.string())], ["run", "word"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = [unexplained(r, {w["word"]: surprise(w["n"], total) for w in ws_ or ()}) for r, ws_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(left, pa.int32())], ["run", "letters"])

    # The words of one run are bounded by its own substrings.
    held = rest.mapInArrow(parts, "run string, word string").join(words, "word").groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("held"))
    return plain.unionByName(rest.join(held, "run", "left").select("run", "held").mapInArrow(solve, "run string, letters int"))


def accepted_candidates(texts: DataFrame) -> DataFrame:
    """The candidates that are secrets."""
    ws = Workspace(texts.sparkSession, "credentials")
    words = ws.write(corpus_words(texts), "words")
    found = ws.write(literal_candidates(texts), "candidates")
    # A value is scored once, however often it stands.
    values = found.select("value", "runs").groupBy("value").agg(F.first("runs").alias("runs"))
    pieces = ws.write(values.select("value", F.explode_outer("runs").alias("run")), "pieces")
    scored = run_residuals(ws, pieces.where("run is not null").select("run").distinct(), words)
    letters = pieces.join(scored, "run", "left").groupBy("value").agg(F.sum(F.coalesce("letters", F.lit(0))).cast("int").alias("letters"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [residuals(v, n) for v, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in both], pa.int32()), pa.array([y for _, y in both], pa.int32())], ["value", "strict", "free"])

    return found.join(letters.mapInArrow(settle, "value string, strict int, free int"), "value").where("strict >= need or free >= loose")


def find_credentials(texts: DataFrame) -> DataFrame:
    """texts (record_table, record_id, text) -> (record_table, record_id, line_no), one row per place."""
    return accepted_candidates(texts).select("record_table", "record_id", "line_no")


def redact_credentials(texts: DataFrame) -> DataFrame:
    """texts with every secret value replaced by one word, all else as it was; null stays null."""
    keyed = texts.select("record_table", "record_id", "text").withColumn("tid", F.xxhash64("text"))
    spans = accepted_candidates(texts).select("record_table", "record_id", "tid", "starts", "ends").distinct().groupBy("record_table", "record_id", "tid").agg(
        F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [x if x is None or not s else replace_spans(x, list(zip(s, e))) for x, s, e in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["record_table", "record_id", "text"])

    # The spans of one record are bounded by its own text.
    return keyed.join(spans, ["record_table", "record_id", "tid"], "left").select("record_table", "record_id", "text", "starts", "ends").mapInArrow(run, "record_table string, record_id string, text string")
