import random

import pytest
from tokenizers import Tokenizer

from marlstone.llm import mixing as mx
from marlstone.llm import tokens as tk

ODD = ["", None, " ", "   a", "a   ", "\n\n\n x\t", "don't they'll I'M", "naïve 日本語 ไทย 🎉👩‍💻", "x" * 5000, "1234567890" * 50, "<|endoftext|> a", "\u0000\ufffd", "a" + " " * 300 + "b", "if (x) {\r\n\treturn;\r\n}"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizer_and_decode_back(spark, reference):
    rng = random.Random(1)
    texts = [*ODD, *("".join(rng.choice(["the ", "Token", " 42", "é", "\n", " — ", "。"]) for _ in range(rng.randrange(80))) for _ in range(60))]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    for block in (200, 10_000_000):
        enc = tk.encode_corpus(df, block_chars=block)
        got = {r.doc_id: r.ids for r in enc.collect()}
        assert got == {i: reference(t) for i, t, _ in rows}
    assert {r.doc_id: r.text for r in tk.decode_corpus(enc).collect()} == {i: t or "" for i, t, _ in rows}
    counts = {r.doc_id: r.n_tokens for r in tk.token_counts(df.select("doc_id", "text"), "text").collect()}
    assert counts == {i: len(g or []) for i, g in got.items()}


def test_repeated_documents_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id bigint, text string")
    assert [r.ids for r in tk.encode_corpus(df).collect()] == [tk.encode_text("a b")] * 2
    assert tk.encode_corpus(df.limit(0)).count() == 0


def test_positions_pack():
    import numpy as np

    for at in ([], [0], [5, 5], [2, 0, 1], [3, 400, 70_000, 70_001], list(range(0, 3000, 7))):
        a = np.array(at, np.int64)
        assert tk._unpack(tk._pack(a)).tolist() == at


def test_fit_is_exact_or_best(spark):
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randrange(1, 40): rng.randrange(1, 6) for _ in range(rng.randrange(1, 7))}
        budget = rng.randrange(0, sum(n * c for n, c in counts.items()) + 5)
        take = mx.fit(counts, budget)
        assert all(0 <= take[n] <= counts[n] for n in take)
        total = sum(n * k for n, k in take.items())
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        best = max(s for s in sums if s <= budget)
        assert total <= budget and (total == best or best - total <= max(counts))


def test_mixture(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["Big", "big ", "small", None, "other"]) if i % 7 else "small", rng.choice([0, 5, 5, 5, rng.randrange(1, 400)])) for i in range(3000)] + [(9000, "big", 40_000), (9001, "big", 30_000)]
    sized = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3), ("gone", 0.2, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    rows = mx.mix_sources(sized, targets).collect()
    cap, tok = {"big": 1, "small": 3}, {}
    for r in rows:
        assert 1 <= r.repeats <= cap[r.source] and r.n_tokens > 0
        tok[r.source] = tok.get(r.source, 0) + r.n_tokens * r.repeats
    assert len({r.doc_id for r in rows}) == len(rows)
    assert abs(tok["big"] / sum(tok.values()) - 0.625) < 0.001
    assert rows == mx.mix_sources(sized, targets).collect() or sorted(map(tuple, rows)) == sorted(map(tuple, mx.mix_sources(sized, targets).collect()))
    shares = {r.source: r for r in mx.mixture_shares(mx.mix_sources(sized, targets), targets).collect()}
    assert shares["gone"].tokens == 0 and shares["gone"].actual_share == 0
    assert mx.mix_sources(sized.limit(0), targets).count() == 0 and mx.mix_sources(sized, targets.limit(0)).count() == 0


def test_documents_of_any_length_are_fitted(spark):
    """Lengths beyond any fixed program size count like all others, and a long document never overshoots a share."""
    rng = random.Random(9)
    docs = [(i, "a", rng.choice([7, 11, 20_000, 50_003, 400_001])) for i in range(400)] + [(1000 + i, "b", rng.randrange(1, 90)) for i in range(3000)]
    sized = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id bigint, source string, n_tokens bigint, part string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    rows = mx.mix_sources(sized, targets).collect()
    tok = {s: sum(r.n_tokens * r.repeats for r in rows if r.source == s) for s in "ab"}
    assert tok["b"] == sum(n for _, s, n in docs if s == "b")
    sums = 1
    for _, source, n in docs:
        sums |= sums << n if source == "a" and n <= tok["b"] else 0
    assert tok["a"] == (sums & ((1 << tok["b"] + 1) - 1)).bit_length() - 1
    take = mx.fit({3: 2, 1_000_000: 5, 70_000: 9}, 3_140_006)
    assert sum(n * k for n, k in take.items()) == 3_140_006


def test_a_length_that_holds_most_rows_is_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(mx, "PART", 10)
    sized = spark.range(1000).selectExpr("id as doc_id", "'a' as source", "cast(5 as bigint) as n_tokens").unionByName(spark.range(1).selectExpr("5000 as doc_id", "'b' as source", "cast(2501 as bigint) as n_tokens"))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    rows = mx.mix_sources(sized, targets).collect()
    assert sum(r.source == "a" for r in rows) == 500 and {r.repeats for r in rows} == {1}
