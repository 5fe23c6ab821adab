"""Personal data by bootstrapped contextual extraction.

Base spans (the seeds) are found by exact patterns per kind: email, ip, card (Luhn) and phone. Their contexts
(the word before, the two and the three words before, the word after) become lexical patterns; labels' marks
(``MARKS``) are words of their own, so ``mail:x``, ``<x>`` and ``ip = x`` have contexts as well. Everything that
merely looks like an identifier is a further instance. Spark scores the pattern-instance graph in a few rounds: a
pattern's score is the trusted share of *all* its occurrences in the corpus, identifiers or not; an instance's trust
is the noisy-or of the reliable patterns around it. Patterns that end with a score of ``RELIABLE`` and ``SUPPORT``
different trusted instances discover identifiers that the seeds missed. Common words score near zero, as they
mostly stand before ordinary words, so clean text is left alone.

Offsets are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, fresh, give_back, slices

KINDS = ("email", "ip", "card", "phone")
RELIABLE = 0.8
SUPPORT = 5
ROUNDS = 3
#: Patterns in one broadcast; more are counted in several passes over the texts.
MAX_PATTERNS = 200_000
#: Marks that stand as words of their own in contexts.
MARKS = ":=<>\""
#: Characters around a span in which its context is sought; a word that reaches beyond them is left out.
_CONTEXT = 128

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")
#: Looks like an identifier of a kind, whatever the seeds say of it.
_LOOSE = {
    "email": re.compile(
        r"[A-Za-z0-9._%+-]{1,64}\s?(?:@|[\[(]\s?at\s?[\])])\s?[A-Za-z0-9-]{1,63}"
        r"(?:\s?(?:\.|[\[(]\s?dot\s?[\])])\s?[A-Za-z0-9-]{1,63}){0,8}"
    ),
    "ip": re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,5}(?:\.[0-9]{1,5}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7})(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])[(+]?[0-9][\x20().0-9-]{5,18}[0-9](?![0-9])"),
}

Span = tuple[str, int, int]
#: Words before a span -> the first letter of such patterns; ``3`` stands for the word after.
_BEFORE = {1: "1", 2: "2", 3: "4"}


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if not k % 2 else (2 * d if d < 5 else 2 * d - 9)
    return not total % 10


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the run of local characters before it: leftmost matches without trying every start."""
    floor, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > floor and text[first - 1] in _LOCAL:
            first -= 1
        found = _DOMAIN.match(text, at + 1) if first < at else None
        if found:
            yield first, found.end()
        floor = found.end() if found else at + 1
        at = text.find("@", floor)


def base_spans(text: str) -> list[Span]:
    """The seeds of one text, by kind as listed, then by start."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text) if "." in text else ():
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start():
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def _may_hold(kind: str, text: str, digits: bool) -> bool:
    """What every text with a loose span of the kind has."""
    if kind == "email":
        return "@" in text or "[" in text or "(" in text
    return digits or (kind == "ip" and ":" in text)


def loose_spans(text: str, base: list[Span]) -> list[Span]:
    """What looks like an identifier and touches no seed; earlier kinds and leftmost spans go first."""
    out: list[Span] = []
    digits = _DIGIT.search(text) is not None
    kinds = [k for k in KINDS if _may_hold(k, text, digits)]
    if not kinds:
        return out
    taken = bytearray(len(text))
    for _, a, b in base:
        taken[a:b] = b"\1" * (b - a)
    for kind in kinds:
        for m in _LOOSE[kind].finditer(text):
            a, b = m.span()
            if taken.find(1, a, b) < 0:
                taken[a:b] = b"\1" * (b - a)
                out.append((kind, a, b))
    return out


def words_of(text: str) -> list[str]:
    """Lower-case words, each mark a word of its own."""
    text = text.lower()
    for mark in MARKS:
        if mark in text:
            text = text.replace(mark, f" {mark} ")
    return text.split()


def contexts(text: str, a: int, b: int) -> list[str]:
    """The patterns around a span: the word, two words and three words before, and the word after."""
    first, stop = max(0, a - _CONTEXT), min(len(text), b + _CONTEXT)
    before, after = words_of(text[first:a]), words_of(text[b:stop])
    if first and not text[first - 1].isspace():
        before = before[1:]
    if stop < len(text) and not text[stop].isspace():
        after = after[:-1]
    out = [f"{_BEFORE[n]} {' '.join(before[-n:])}" for n in _BEFORE if len(before) >= n]
    return [*out, f"3 {after[0]}"] if after else out


def _edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        seen: Counter = Counter()
        for text in batch.column(0).to_pylist():
            if text:
                base = base_spans(text)
                for spans, seed in ((base, True), (loose_spans(text, base), False)):
                    for kind, a, b in spans:
                        for pattern in contexts(text, a, b):
                            seen[kind, pattern, text[a:b], seed] += 1
        if seen:
            columns = list(zip(*seen))
            yield pa.record_batch(
                [pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2]), pa.array(columns[3]), pa.array(list(seen.values()), pa.int64())],
                names=["kind", "pattern", "value", "seed", "n"],
            )
    give_back()


def _passes(patterns: DataFrame, columns: list[str]) -> Iterator[list]:
    """The patterns in sets of about ``MAX_PATTERNS``, one in the driver at a time; none: one empty set."""
    n = max(1, -(-patterns.count() // MAX_PATTERNS))
    for k in range(n):
        yield patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(n)) == k).select(*columns).collect()


def _totals(docs: DataFrame, patterns: DataFrame, work: Workspace) -> DataFrame:
    """``pattern, total``: how often each pattern's words occur in all texts, whatever stands beside them."""
    out = None
    for part in _passes(patterns, ["pattern"]):
        names = [r[0] for r in part]
        words = {p[2:] for p in names if p[0] in "13"}
        pairs, triples = ({tuple(p[2:].split(" ")) for p in names if p[0] == c} for c in "24")
        shared = docs.sparkSession.sparkContext.broadcast((words, pairs, triples, {p[-1] for p in pairs | triples}))
        counted = docs.select("text").mapInArrow(_occurrences(shared), "pattern string, total long")
        counted = work.cut(counted.groupBy("pattern").agg(F.sum("total").alias("total")))
        shared.unpersist()
        out = counted if out is None else out.union(counted)
    return out.groupBy("pattern").agg(F.sum("total").alias("total"))


def _occurrences(shared):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, triples, last = shared.value
        one: Counter = Counter()
        more: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                said = words_of(text) if text else []
                one.update(filter(words.__contains__, said))
                if last and not last.isdisjoint(said):
                    for k in [k for k, w in enumerate(said) if w in last]:
                        more.update(p for p in (tuple(said[max(0, k - 1) : k + 1]),) if p in pairs)
                        more.update(p for p in (tuple(said[max(0, k - 2) : k + 1]),) if p in triples)
        names = [f"{k} {w}" for w in one for k in (1, 3)] + [f"{_BEFORE[len(p)]} {' '.join(p)}" for p in more]
        values = [c for c in one.values() for _ in (1, 3)] + list(more.values())
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(values, pa.int64())], names=["pattern", "total"])

    return rows


def bootstrap(docs: DataFrame, work: Workspace | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``docs(text)`` -> reliable patterns ``kind, pattern, score, support``.

    Null and empty texts have no instances; an empty table has no patterns; repeated texts count as often as
    they stand there, but support counts different values.
    """
    work = work or Workspace(docs.sparkSession, "pii")
    found = docs.select("text").mapInArrow(_edges, "kind string, pattern string, value string, seed boolean, n long")
    graph = work.cut(found.groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed"), F.sum("n").alias("n")))
    wide = graph.groupBy("kind", "pattern").agg(F.count("*").alias("values")).where(F.col("values") >= SUPPORT)
    wide = work.cut(wide.select("kind", "pattern"))
    total = work.cut(_totals(docs, wide.select("pattern").distinct(), work))
    graph = work.cut(graph.join(wide, ["kind", "pattern"]).join(total, "pattern"))
    trust = work.cut(graph.groupBy("kind", "value").agg(F.max(F.col("seed").cast("double")).alias("trust")))
    for _ in range(rounds):
        scored = _scores(graph, trust)
        doubt = graph.where(~F.col("seed")).join(scored, ["kind", "pattern"]).groupBy("kind", "value")
        doubt = doubt.agg((1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.999999)))))).alias("new"))
        after = work.cut(
            trust.join(doubt, ["kind", "value"], "left").select(
                "kind", "value", F.greatest("trust", F.coalesce("new", F.lit(0.0))).alias("trust")
            )
        )
        work.drop(trust)
        trust = after
    return _scores(graph, trust)


def _scores(graph: DataFrame, trust: DataFrame) -> DataFrame:
    rated = graph.join(trust, ["kind", "value"]).groupBy("kind", "pattern")
    rated = rated.agg(
        (F.sum(F.col("n") * F.col("trust")) / F.max("total")).alias("score"),
        F.count_if(F.col("trust") >= RELIABLE).alias("support"),
    )
    return rated.where((F.col("score") >= RELIABLE) & (F.col("support") >= SUPPORT))


_SPANS = T.StructType(
    [
        T.StructField("base", T.ArrayType(T.StringType())),
        T.StructField("all", T.ArrayType(T.StringType())),
    ]
)
_ARROW = pa.struct([("base", pa.list_(pa.string())), ("all", pa.list_(pa.string()))])


def all_spans(text: str, patterns: frozenset[tuple[str, str]]) -> tuple[list[Span], list[Span]]:
    """Seeds, and seeds with discoveries, both by kind as listed, then by start."""
    base = base_spans(text)
    more = []
    if patterns:
        more = [s for s in loose_spans(text, base) if any((s[0], p) in patterns for p in contexts(text, s[1], s[2]))]
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def extract(docs: DataFrame, work: Workspace | None = None, into: str = "_pii") -> DataFrame:
    """``docs`` with a column ``into(base, all)``: seeds, and seeds with discoveries, as ``kind:start:end``.

    Null and empty texts have none; rows and other columns stay. Patterns beyond ``MAX_PATTERNS`` are looked for in
    further passes over the texts, each of which adds its discoveries.
    """
    work = work or Workspace(docs.sparkSession, "pii")
    patterns, kept = work.cut(bootstrap(docs, work)), docs.columns
    for part in _passes(patterns, ["kind", "pattern"]):
        shared = docs.sparkSession.sparkContext.broadcast(frozenset(map(tuple, part)))
        if docs.columns == kept:
            docs = docs.withColumn(into, F.arrow_udf(_found(shared), _SPANS)("text"))
        else:
            docs = work.cut(docs).withColumn(into, F.arrow_udf(_added(shared), _SPANS)("text", into))
    return docs


def _order(span: str) -> tuple[int, int]:
    kind, first, _ = span.split(":")
    return KINDS.index(kind), int(first)


def _found(shared):
    def found(text: pa.Array) -> pa.Array:
        rows = []
        for x in text:
            both = all_spans(x.as_py() or "", shared.value)
            rows.append(dict(zip(("base", "all"), ([f"{k}:{a}:{b}" for k, a, b in part] for part in both))))
        return pa.array(rows, _ARROW)

    return found


def _added(shared):
    new = _found(shared)

    def added(text: pa.Array, before: pa.Array) -> pa.Array:
        rows = [{"base": x["base"], "all": sorted({*x["all"], *y["all"]}, key=_order)} for x, y in zip(new(text).to_pylist(), before.to_pylist())]
        return pa.array(rows, _ARROW)

    return added


def _redacted(text: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(text.to_pylist(), spans.to_pylist()):
        if x and y:
            kept, at = [], 0
            for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in y)):
                if b <= at:
                    continue
                kept += [x[at : max(a, at)], f"[{kind.upper()}]" if a >= at else ""]
                at = b
            x = "".join(kept) + x[at:]
        out.append(x)
    return pa.array(out, pa.string())


def redact(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """Every row of ``docs``; each span is replaced by its kind in brackets and ``n_chars`` counted anew there.

    Null and empty texts, and those without spans, stay as they are; columns of any name stay.
    """
    mark = fresh("_pii", docs)
    found = extract(docs, work, mark)
    hit = F.size(f"{mark}.all") > 0
    text = F.when(hit, F.arrow_udf(_redacted, T.StringType())("text", f"{mark}.all")).otherwise(F.col("text"))
    found = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(hit, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return found.select(docs.columns)


def _of_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.startswith(f"{kind}:"))).cast("long")


def digest(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """``doc_id``, the number of base spans of each kind, their digest, and all spans; a row per row of ``docs``."""
    found = extract(docs.select("doc_id", "text"), work).select("doc_id", "_pii.base", "_pii.all")
    return found.select(
        "doc_id",
        *(_of_kind("base", k).alias(f"n_{k}") for k in KINDS),
        F.sha2(F.concat_ws(",", "base"), 256).alias("base_sha256"),
        F.concat_ws(",", "all").alias("spans"),
    )
