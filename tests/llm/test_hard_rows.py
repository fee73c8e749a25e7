"""Every operator on nulls, empty and very long texts, repeated rows and ids, ids as text, clashing names, and no rows at all."""

from __future__ import annotations

import public_tokenizers as P
import pytest

from foldspark.llm import bpe, mixing, ngram_join, pii, quality_rules, quality_score, secret_scan, token_count, toxicity
from foldspark.llm.common import shared_dir

LONG = "word " * 120_000 + "mail a@b.com secret=abcdef0123456789x " + "y" * 300_000
TEXTS = [None, "", " \n\t", "one", "the same text of six words", "the same text of six words", LONG, "line\n" * 80, "é 😀 ‮", "zounds and more"]
EXTRA = "n_tokens long, score double, spans string, blob string, kind int, copies int, component_id long, held_out boolean, key string, n int, `meta.k` int, `a b` int"


def scanned(d):
    ledger = secret_scan.Ledger(d.sparkSession, shared_dir(d.sparkSession))
    ledger.update(d)
    return secret_scan.digest(secret_scan.findings(d, ledger.read()))


OPERATORS = {
    "op1": lambda d, y: token_count.count_tokens(d, P.path("piece_bpe_32k.model")),
    "op2": lambda d, y: bpe.round_trip(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN),
    "op4": lambda d, y: toxicity.score(d, toxicity.train(d, y)),
    "op5": lambda d, y: quality_score.score(d, y),
    "op6": lambda d, y: ngram_join.join(d),
    "op7": lambda d, y: scanned(d),
    "op8": lambda d, y: quality_rules.apply_rules(d, y),
    "op9": lambda d, y: mixing.mix(d, total=400),
    "op10": lambda d, y: pii.digest(pii.find(d)),
}


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(f"d{i}", t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[4]), (None, TEXTS[4]), (None, None), ("d3", "one"), ("d3", "another text"), ("d3", None)]
    docs = spark.createDataFrame([(i, t, ("en", None, "de")[k % 3], ("a", None)[k % 2], *[None] * 10, 1, 2) for k, (i, t) in enumerate(rows)], f"doc_id string, text string, lang string, source string, {EXTRA}")
    labels = spark.createDataFrame([(f"d{i}", i % 2, int(i == 9)) for i in range(10)] + [(None, 1, 1), ("d1", None, None), ("none", 1, 0)], "doc_id string, quality int, toxic int")
    return docs.repartition(3).persist(), labels, rows


@pytest.mark.parametrize("name", OPERATORS)
def test_hard_rows(tables, name):
    docs, labels, rows = tables
    out = OPERATORS[name](docs, labels).collect()
    ids = sorted(str(r["doc_id"]) for r in out)
    if name == "op9":
        assert out and set(ids) <= {str(i) for i, _ in rows} and out[0].__fields__ == [*docs.columns, "copy"]
    else:
        assert ids == sorted(str(i) for i, _ in rows)
    assert OPERATORS[name](docs.limit(0), labels).collect() == []
    if name == "op6":
        by = {}
        for r in out:
            by.setdefault(r["doc_id"], set()).add(r["component_id"])
        assert by["d4"] == by["d5"] == {"d4"} and by["d0"] == {"d0"} and by[None] == {None}
    if name == "op7":
        assert {r["n_assign"] for r in out if r["doc_id"] == "d6"} == {1}
    if name == "op1":
        assert {(r["n_words"], r["n_tokens"]) for r in out if r["doc_id"] in ("d0", "d1", "d2")} == {(0, 0)} and all(r["n_words"] == 120_004 for r in out if r["doc_id"] == "d6")
    if name == "op10":
        assert {r["n_email"] for r in out if r["doc_id"] == "d6"} == {1}


def test_filters_keep_all_columns(tables):
    docs, labels, rows = tables
    ledger = secret_scan.Ledger(docs.sparkSession, shared_dir(docs.sparkSession))
    for out in (toxicity.without_toxic(docs, toxicity.train(docs, labels)), ngram_join.one_of_each(docs), secret_scan.redacted(docs, ledger), mixing.mix(docs, number_col=None)):
        assert out.dtypes == docs.dtypes and out.count() > 0
    assert sorted(str(r["doc_id"]) for r in secret_scan.redacted(docs, ledger).collect()) == sorted(str(i) for i, _ in rows)
