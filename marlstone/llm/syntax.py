"""Source files that do not parse: which, why, and at what rate per project and language.

Method: each text is ranked against all supported languages by its tokens (the words and signs its lines begin with, and
operators that tell them apart), then every one of the six grammars is tried on it. The set of grammars that take a text
gives the verdict: the language of the path among them -> valid; another one, the first in the order of the ranking -> a
wrong ending; none -> corrupt; the own grammar's parser overflowing -> too deep, a case as well. Empty texts parse nowhere
and are no cases; a file whose path names no supported language is ranked and parsed too, but never a case.

One Arrow pass, no shuffle for the verdicts; the rates are two aggregations with map-side combine. Repeated rows give
their verdict again, null columns are passed on, and no text is too long.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grammars import ENDINGS, verdicts

#: What lines begin with, as far as it tells the languages apart.
_FIRST = {
    "python": ["def", "elif", "except", "from", "with", "pass", "raise", "class", "import", "@", "self", "None", "print"],
    "javascript": ["const", "let", "var", "function", "export", "module", "}", "return", "await", "class", "import", "this"],
    "typescript": ["interface", "type", "enum", "declare", "abstract", "private", "public", "readonly", "export", "const", "import", "}"],
    "go": ["package", "func", "defer", "go", "}", "type", "var", "import", "return", "switch", "case"],
    "json": ['"', "{", "}", "]"],
    "toml": ["["],
}
_POINTS: dict[str, list[str]] = {}
for _k, _words in _FIRST.items():
    for _w in _words:
        _POINTS.setdefault(_w, []).append(_k)
#: Operators and forms, counted anywhere.
_SIGNS = {"python": ["):\n", " not ", " is None"], "javascript": ["=>", "===", ");\n"], "typescript": ["=>", ": string", ": number", ": boolean", "<string"], "go": [":=", "err != nil", "*"], "json": ['": '], "toml": ["]\n", " = "]}
_BEGIN = re.compile(r"\n[ \t]*([A-Za-z_]\w*|[^\s\w])")


def rank_languages(text: str) -> list[str]:
    """All languages in the order of their tokens' points, ties in the order of ENDINGS."""
    score = dict.fromkeys(ENDINGS.values(), 0)
    for w, n in Counter(_BEGIN.findall("\n" + text)).items():
        for k in _POINTS.get(w, ()):
            score[k] += n
    for k, signs in _SIGNS.items():
        score[k] += sum(map(text.count, signs))
    return sorted(score, key=lambda k: -score[k])


def verdict(path: str | None, text: str | None) -> tuple[str | None, str | None, list[str], str | None, str]:
    """(language of the path, first of the ranking, grammars that take the text in its order, the one it is read as, status)."""
    own = next((v for k, v in ENDINGS.items() if path and path.endswith(k)), None)
    if not text or not text.strip():
        return own, None, [], None, "empty"
    order = rank_languages(text)
    said = verdicts(text)
    taken = [k for k in order if said[k]]
    first = taken[0] if taken else None
    if own is None:
        return None, order[0], taken, first, "unchecked"
    if said[own]:
        return own, order[0], taken, own, "valid"
    return own, order[0], taken, first, "wrong_ending" if taken else "corrupt" if said[own] is False else "too_deep"


def parse_files(files: DataFrame) -> DataFrame:
    """files (file_id, project, path, text) -> (file_id, project, path, language, ranked, accepted, parsed_as, status)."""
    names = ["file_id", "project", "path", "language", "ranked", "accepted", "parsed_as", "status"]
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [verdict(p, t) for p, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), *[pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]], names)

    return files.select("file_id", "project", "path", "text").mapInArrow(run, "file_id string, project string, path string, language string, ranked string, accepted array<string>, parsed_as string, status string")


def failed(parsed: DataFrame) -> DataFrame:
    """The files whose own grammar does not take them."""
    return parsed.where(F.col("status").isin(FAILED))


FAILED = ["wrong_ending", "corrupt", "too_deep"]


def parse_rates(parsed: DataFrame) -> DataFrame:
    """(project, language, files, failed, wrong_ending, rate): files with text of the supported endings."""
    bad = F.col("status").isin(FAILED)
    return (
        parsed.where("language is not null and status <> 'empty'")
        .groupBy("project", "language")
        .agg(F.count_distinct("file_id").alias("files"), F.count_distinct(F.when(bad, F.col("file_id"))).alias("failed"),
             F.count_distinct(F.when(F.col("status") == "wrong_ending", F.col("file_id"))).alias("wrong_ending"))
        .withColumn("rate", F.col("failed") / F.col("files"))
    )
