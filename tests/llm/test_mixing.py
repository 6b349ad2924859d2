import os

import pytest

from examloom.llm.bpe import default_vocabulary, encoder
from examloom.llm.mixing import emit_copies, mix_sources

pytestmark = pytest.mark.skipif(not os.path.exists(default_vocabulary()), reason="no vocabulary files here")
DOCS = "doc_id long, text string, source string, copies int, tokens int"
TARGETS = "source string, target_share double, max_repeats int"


def _n(t):
    return len(encoder(default_vocabulary()).encode(t))


def test_rates_caps_and_report(spark):
    docs = [(i, f"big document number {i} with words", "big", 1, 1) for i in range(2000)]
    docs += [(5000 + i, f"small text {i} here", "small", 1, 1) for i in range(300)] + [(9000, "tiny one", "tiny", 1, 1), (9001, "tiny one", "tiny", 1, 1), (9002, "tiny one", "big", 1, 1)]
    docs += [(9100, None, "big", 1, 1), (9101, "", "big", 1, 1), (9102, "no source text", None, 1, 1), (9103, "other", "unlisted", 1, 1)]
    targets = spark.createDataFrame([("big", 0.6, 4), ("small", 0.3, 10), ("tiny", 0.05, 3), ("none", 0.05, 5), ("zero", None, None)], TARGETS)
    mixture, report = mix_sources(spark.createDataFrame(docs, DOCS), targets)
    rows, rep = {r.doc_id: r for r in mixture.collect()}, {r.source: r for r in report.collect()}
    total = sum(_n(d[1]) for d in docs)
    text = {d[0]: d[1] for d in docs}
    assert all(_n(text[k]) == r.tokens for k, r in rows.items())
    used = {}
    for k, r in rows.items():
        used[text[k]] = used.get(text[k], 0) + r.copies
    assert used.get("tiny one", 0) <= 3 and None not in used and "" not in used
    assert abs(rep["big"].mixed_tokens - 0.6 * total) < 0.05 * total and abs(rep["small"].mixed_tokens - 0.3 * total) < 0.05 * total
    assert rep["small"].most_copies <= 10 and rep["small"].rate > 1
    assert [s for s in ("big", "small", "tiny", "none", "zero") if rep[s].cannot_fill] == ["tiny", "none"]
    # the documents of tiny repeat one text: too few documents, and fewer texts still
    assert {s for s in rep if rep[s].short_of_texts} == {"tiny", "none"} and all(r.deficit == max(0.0, r.wanted_tokens - r.mixed_tokens) for r in rep.values())
    assert abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9
    again = {r.doc_id: r.copies for r in mix_sources(spark.createDataFrame(docs, DOCS).repartition(9), targets)[0].collect()}
    assert again == {k: r.copies for k, r in rows.items()}
    full = emit_copies(spark.createDataFrame(docs, DOCS).drop("copies"), mixture)
    assert full.count() == sum(r.copies for r in rows.values())


def test_empty(spark):
    mixture, report = mix_sources(spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 2)], TARGETS))
    assert mixture.count() == 0 and report.first().mixed_tokens == 0 and report.first().actual_share is None


def test_repeated_texts_are_short_without_their_documents_being(spark):
    docs = [(i, "the same words again and again", "copies", 1, 1) for i in range(50)] + [(100 + i, f"document number {i} of many words", "own", 1, 1) for i in range(50)]
    targets = spark.createDataFrame([("copies", 0.5, 2), ("own", 0.5, 2)], TARGETS)
    rep = {r.source: r for r in mix_sources(spark.createDataFrame(docs, DOCS), targets)[1].collect()}
    assert not rep["copies"].cannot_fill and rep["copies"].short_of_texts and rep["copies"].deficit > 0 and rep["copies"].most_copies == 2
    assert not rep["own"].cannot_fill and not rep["own"].short_of_texts
