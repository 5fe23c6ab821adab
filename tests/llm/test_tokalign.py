"""Alignment between two tokenizers against a brute-force one made of plain loops."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from taxaflow.llm import tokalign
from taxaflow.llm.queries import op12_tokalign

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in plain):
        table[chr(256 + k)] = b
    return table


def _brute(rows):
    a = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    letters = _letters()

    def ends(pieces):
        at, out = 0, []
        for p in pieces:
            at += len(p)
            out.append(at)
        return out

    done, counts = [], Counter()
    for key, text in rows:
        groups, links = [], []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(letters[c] for c in a.id_to_token(k)) for k in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends_a, ends_b = ends(bytes_a), ends(bytes_b)
                i = j = 0
                for e in sorted(set(ends_a) & set(ends_b)):
                    p, q = i, j
                    while p < len(ends_a) and ends_a[p] <= e:
                        p += 1
                    while q < len(ends_b) and ends_b[q] <= e:
                        q += 1
                    groups.append((ids_a[i:p], ids_b[j:q]))
                    for x in range(i, p):
                        for y in range(j, q):
                            if max(ends_a[x] - len(bytes_a[x]), ends_b[y] - len(bytes_b[y])) < min(ends_a[x], ends_b[y]):
                                links.append((ids_a[x], ids_b[y]))
                    i, j = p, q
        counts.update(links)
        done.append((key, groups, links))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for key, groups, links in done:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append(
            (key, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
             sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
             hashlib.sha256(text.encode()).hexdigest() if text else "")
        )
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_alignment_equals_brute_force_on_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = _brute([tuple(r) for r in docs.collect()])
    assert _got(op12_tokalign(spark, SF)) == want
    assert any(w[3] < w[1] for w in want)


@pytest.mark.parametrize("head", [0, 7, 60])
def test_pairs_that_are_not_broadcast_are_joined(spark, head):
    rng = random.Random(head)
    pool = [" ", "  ", "\n", "a", "the", "The", "é", "日本", "▁", "😀", "<s>", "<|endoftext|>", "<0x41>", "\x00", "​", "ing", "1234", "　", "ﬁ", "\t", "'ll"]
    texts = [None, "", " ", "▁", "<0x0A>", "</s>", "x" * 2000, " " * 300, "\r\n", *["same text twice"] * 3]
    texts += ["".join(rng.choices(pool, k=rng.randrange(1, 40))) for _ in range(150)]
    rows = [(k // 2, t) for k, t in enumerate(texts)] + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert _got(tokalign.digest(docs, head=head)) == _brute(rows)


def test_threshold_keeps_at_most_the_head(spark):
    rng = random.Random(2)
    counts = [int(rng.paretovariate(0.5)) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(counts)), "pair long, n long")
    for head in (0, 1, 10, 100, 2999, 3000, 5000):
        least = tokalign._threshold(df, head)
        assert sum(n >= least for n in counts) <= head or not least
        assert (least == 0) == (head >= 3000)


def test_groups_as_text_long_texts_and_empty_tables(spark):
    long = "Texts of many words, ½ of them odd. " * 40_000
    docs = spark.createDataFrame([(1, "a b", "x"), (2, long, "x")], "doc_id long, text string, n_a string")
    got = {r.doc_id: r for r in tokalign.align(docs, groups=True).collect()}
    assert hashlib.sha256(got[1].groups.encode()).hexdigest() == got[1].groups_sha256
    assert got[2].n_links == got[2].n_a + got[2].n_b - got[2].n_groups
    assert sum(got[2].exact_times) + sum(got[2].others_times) == got[2].n_links
    assert tokalign.digest(docs.where("doc_id > 9")).collect() == []
    assert tokalign.digest(docs.where("doc_id = 1").withColumn("text", docs.text.substr(9, 1))).first().groups_sha256 == ""
