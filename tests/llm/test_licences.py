"""Licence scans: base phrases against brute force, templates planted whole, changed, cut and repeated."""

from __future__ import annotations

import random
import re

from taxaflow.llm import licences
from taxaflow.llm.licence_texts import PHRASES, TEMPLATES
from taxaflow.llm.queries import op13_licences

SF = "/root/testdata/sf0.001"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = dict(reversed(TEMPLATES))  # the first text of each label


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))


def _brute(text):
    words, found = _words(text), []
    for label, phrase in PHRASES:
        p = phrase.split()
        found += [(k, label) for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
    at = [k for k, _ in found]
    return (len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found})))


def _digest(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in licences.digest(docs).orderBy("doc_id").collect()]


def test_base_equals_brute_force_on_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in op13_licences(spark, SF).collect())
    assert got == sorted((r.doc_id, _brute(r.text)) for r in docs)
    assert any(b[1] for _, b in got)


def test_base_equals_brute_force_on_odd_texts(spark):
    rng = random.Random(5)
    pool = ["cc", "by", "CC-BY", "general", "public", "license", "All", "rights", "reserved", "x", "é", "\x00", "the", "gnu", "under", "licensed", "K"]
    texts = [None, "", "  ", "cc cc by by", "ALL RIGHTS\nRESERVED all rights reserved.", "é" * 10, "cc by" * 3]
    texts += [rng.choice([" ", "-", "\n"]).join(rng.choices(pool, k=rng.randrange(60))) for _ in range(400)]
    texts.append("all rights reserved cc by " * 60_000)
    for r, text in zip(_digest(spark, texts), texts):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == _brute(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score == 1 or not r.n_base)


def test_planted_templates_are_found_and_named(spark):
    rng = random.Random(1)
    noise = lambda n: " ".join(rng.choices("lorem ipsum the of a software to under license copy with".split(), k=n))
    cases = []
    for label, text in TEMPLATES:
        words = text.split()
        changed = [w if k % 17 != 11 or len(words) < 40 else "Jane Doe" for k, w in enumerate(words)]
        cases += [(label, text), (label, noise(80) + "\n" + text + "\n" + noise(80)), (label, noise(9) + " " + " ".join(changed))]
    for (label, _), r in zip(cases, _digest(spark, [c[1] for c in cases])):
        assert label in r.labels.split(","), (label, r)
    assert [r.labels for r in _digest(spark, [noise(4000), TEXTS["mit"][:200], "", None])] == [""] * 4


def test_spans_are_places_of_words(spark):
    text = "one two " + TEXTS["mit"] + " three " + TEXTS["isc"]
    n = len(_words(TEXTS["mit"]))
    spans = licences.Templates().scan([w.encode() for w in _words(text)])[1]
    assert [(s[0], s[1], s[2]) for s in spans] == [("mit", 2, 2 + n), ("isc", 3 + n, len(_words(text)))]
    assert all(s[3] == 1.0 for s in spans)
    thrice = licences.Templates().scan([w.encode() for w in _words((TEXTS["mit"] + " x ") * 3)])[1]
    assert [s[1] for s in thrice] == [0, n + 1, 2 * n + 2]


def test_texts_that_share_most_words_are_told_apart(spark):
    got = [r.labels for r in _digest(spark, [TEXTS["bsd-2-clause"], TEXTS["bsd-3-clause"], TEXTS["lgpl"], TEXTS["gpl"]])]
    assert got == ["bsd-2-clause", "bsd-3-clause", "gpl,lgpl", "gpl"]


def test_matching_statistics_and_chains_equal_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        templates = [(f"t{k}", " ".join(rng.choices("abcd", k=rng.randrange(5, 14)))) for k in range(3)]
        words = rng.choices(["a", "b", "c", "d", "z"], k=60)
        machine = licences.Templates(templates, [("p", "a b")])
        noted = {}
        keep = machine._note
        machine._note = lambda m, s, n, at: (noted.__setitem__(at, max(n, noted.get(at, 0))), keep(m, s, n, at))[1]
        base, spans, score = machine.scan([w.encode() for w in words])
        every = [t.split() for _, t in templates] + [["a", "b"]]
        stands = lambda s: any(t[k : k + len(s)] == s for t in every for k in range(len(t)))
        for at, n in noted.items():
            longest = max((k for k in range(at + 1) if stands(words[at - k : at])), default=0)
            assert n == longest
        assert [b for _, b in base] == [k for k in range(59) if words[k : k + 2] == ["a", "b"]]
        for label, text in templates:
            t = text.split()
            whole = any(words[k : k + len(t)] == t for k in range(60))
            assert not whole or score == 1.0


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "cc by", "x", 3), (1, "cc by", "x", 3), (None, None, None, None)], "doc_id long, text string, scan string, n_words int")
    assert [r.n_base for r in licences.digest(docs).collect()] == [1, 1, 0]
    assert licences.digest(docs.where("doc_id > 5")).count() == 0
    assert licences.scan(docs, into="_s").columns == [*docs.columns, "_s"]
    assert [r.labels for r in licences.digest(docs, [], []).collect()] == ["", "", ""]
