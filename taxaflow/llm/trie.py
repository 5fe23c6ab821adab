"""A prefix trie over rebuilt conversations, by composable fingerprints instead of rebuilt texts.

Conversation c is rebuilt as the first h turns of its base (c - c % 100) and its own turns after its first h. Every turn
has a *reference*, the residues of a hash of role and text modulo three primes. A sequence of turns has a fingerprint, an
element of a monoid: (sum of reference_j * B^j, number of turns), composed by (s, m) * (t, n) = (s + B^m t, m + n). Running
sums over original turns give the fingerprint of every original prefix; that of a rebuilt prefix is the product of the
base's head and the own suffix, which is made symbolically: (S_own(i) - S_own(h)) * B^(nb - h) added to S_base(nb). No
text is rebuilt, or read again, after its turn has a reference.

*Equality is verified.* All turns of one reference are compared text by text where they lie, and every group of prefixes
must have one reference as its last turn. A group's fingerprint and last turn determine that of its parents, so by
induction all members of a group are equal turn by turn. If either fails, all is done anew with other hashes.

*Subtrees.* The smallest member of a node owns it. The nodes of one owner are a path, a stretch of depths, and the trie is
a tree of paths, one at most for each conversation. Totals of paths are summed by pointer doubling (a round for each
doubling of the tree's height); inside a path, sums from the deepest node upwards are distributed running sums, so a
conversation with a third of all turns lies in many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.order import hot_join, numbered
from .common import Workspace, give_back

#: Residues are below 2^31, so products fit in a long; together they are 93 bits.
PRIMES = (2147483647, 2147483629, 2147483587)
BASES = (1103515245, 214013017, 1664525011)
#: Heads are at most one turn shorter than this.
HEADS = 6
FAMILY = 100
#: Conversation ids joined to one text before a node's hash is streamed over them.
BLOCK = 50_000
ATTEMPTS = 5

_K = range(len(PRIMES))
_LONGS = T.StructType([T.StructField(f"v{k}", T.LongType()) for k in _K])


def _power(base: int, prime: int, e: np.ndarray) -> np.ndarray:
    out, square, e = np.ones(len(e), np.int64), base, e.copy()
    while e.any():
        out = np.where(e & 1, out * square % prime, out)
        square, e = square * square % prime, e >> 1
    return out


def _raise(*columns: pa.Array) -> pa.Array:
    """Residues times B to the last column."""
    *values, e = (c.to_numpy(zero_copy_only=False) for c in columns)
    made = [v * _power(b, p, e) % p for v, b, p in zip(values, BASES, PRIMES)]
    return pa.StructArray.from_arrays([pa.array(m) for m in made], names=[f"v{k}" for k in _K])


def _terms(prefix: str, exponent: str) -> Column:
    return F.arrow_udf(_raise, _LONGS)(*(f"{prefix}{k}" for k in _K), exponent)


def _shifted(value: Column, k: int, back: Column) -> Column:
    """``value`` times B^-back for ``back`` of 0 to ``HEADS`` - 1."""
    inverse = pow(BASES[k], -1, PRIMES[k])
    factors = F.array(*(F.lit(pow(inverse, n, PRIMES[k])).cast("long") for n in range(HEADS)))
    return F.pmod(F.pmod(value, F.lit(PRIMES[k])) * F.get(factors, back), F.lit(PRIMES[k]))


def _references(conversations: DataFrame, seed: int) -> DataFrame:
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.select(
        "*", F.length("text").cast("long").alias("size"),
        *(F.pmod(F.xxhash64(F.lit(seed * len(PRIMES) + k), "role", "text"), F.lit(PRIMES[k])).alias(f"c{k}") for k in _K),
    )


def _clashes(turns: DataFrame) -> bool:
    """Whether two turns of one reference differ."""
    sides = turns.groupBy(*(f"c{k}" for k in _K)).agg(*(f(c).alias(f"{c}_{f.__name__}") for c in ("role", "text") for f in (F.min, F.max)))
    return bool(sides.where("role_min <> role_max or text_min <> text_max").limit(1).count())


def _members(turns: DataFrame, work: Workspace) -> DataFrame:
    """Rebuilt prefixes: one row for each conversation and depth, from 0."""
    c, s = [f"c{k}" for k in _K], [f"s{k}" for k in _K]
    placed = numbered(turns, ["conv_id"], [F.asc_nulls_first("turn"), "role", "text"], "pos", work=work, drop=["turn", "role", "text"])
    termed = placed.withColumn("t", _terms("c", "pos"))
    termed = termed.select("conv_id", "pos", "size", *c, *(F.col(f"t.v{k}").alias(f"t{k}") for k in _K))
    prefixes = numbered(termed, ["conv_id"], ["pos"], "_n", {x: F.col(f"t{k}") for k, x in enumerate(s)}, work, [f"t{k}" for k in _K])
    prefixes = prefixes.drop("_n").withColumns({x: F.pmod(F.col(x), F.lit(PRIMES[k])) for k, x in enumerate(s)})
    first = F.struct("pos", "size", *c, *s)
    convs = prefixes.groupBy("conv_id").agg(
        F.max("pos").alias("n"), F.sort_array(F.collect_list(F.when(F.col("pos") < HEADS, first))).alias("own")
    )
    convs = work.cut(convs)
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    heads = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("head"))
    built = convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "base", "left")
    built = built.withColumn("nb", F.least(F.coalesce(F.size("head"), F.lit(0)).cast("long"), F.col("h")))
    at = lambda listed, n, k: F.coalesce(F.get(listed, (F.col(n) - 1).cast("int"))[f"s{k}"], F.lit(0))
    built = built.select(
        "conv_id", "h", "nb", (F.col("nb") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
        F.when(F.col("nb") > 0, F.slice("head", F.lit(1), F.col("nb").cast("int"))).alias("head"),
        *(at("head", "nb", k).alias(f"b{k}") for k in _K), *(at("own", "h", k).alias(f"o{k}") for k in _K),
    )
    built = work.cut(built)
    nought = F.lit(0).cast("long")
    ends = (F.col("depth") == F.col("length")).alias("ends")
    roots = built.select("conv_id", nought.alias("depth"), nought.alias("size"), *(nought.alias(x) for x in c), *(nought.alias(f"f{k}") for k in _K), "length")
    head = built.select("conv_id", "length", F.explode("head").alias("x"))
    head = head.select("conv_id", F.col("x.pos").alias("depth"), "x.size", *(f"x.{x}" for x in c), *(F.col(f"x.s{k}").alias(f"f{k}") for k in _K), "length")
    # A conversation's own turns after its first h: the head's product with the own suffix.
    keys = built.select("conv_id", "h", "nb", "length", *(f"{x}{k}" for x in "bo" for k in _K))
    own = hot_join(prefixes, keys, ["conv_id"]).where(F.col("pos") > F.col("h"))
    made = [F.pmod(F.col(f"b{k}") + _shifted(F.col(f"s{k}") - F.col(f"o{k}"), k, (F.col("h") - F.col("nb")).cast("int")), F.lit(PRIMES[k])).alias(f"f{k}") for k in _K]
    own = own.select("conv_id", (F.col("nb") + F.col("pos") - F.col("h")).alias("depth"), "size", *c, *made, "length")
    rows = roots.unionByName(head).unionByName(own)
    return rows.select("conv_id", "depth", "size", *c, *(f"f{k}" for k in _K), ends)


def _nodes(conversations: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Verified nodes ``owner, depth, n_convs, size, f*, p*`` (p: the parent's fingerprint), and the members."""
    key = ["depth", *(f"f{k}" for k in _K)]
    for seed in range(ATTEMPTS):
        turns = _references(conversations, seed)
        if _clashes(turns):
            continue
        members = work.cut(_members(turns, work))
        same = [f(f"c{k}").alias(f"{f.__name__}{k}") for k in _K for f in (F.min, F.max)]
        found = members.groupBy(*key).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), F.max("size").alias("size"), *same)
        found = found.withColumns({f"c{k}": F.col(f"min{k}") for k in _K}).withColumn("t", _terms("c", "depth"))
        found = found.withColumn("mixed", F.exists(F.array(*(F.col(f"min{k}") != F.col(f"max{k}") for k in _K)), lambda x: x))
        parents = [F.pmod(F.col(f"f{k}") - F.col(f"t.v{k}"), F.lit(PRIMES[k])).alias(f"p{k}") for k in _K]
        nodes = work.cut(found.select("owner", *key, "n_convs", "size", *(f"c{k}" for k in _K), *parents, "mixed"))
        if not nodes.where("mixed").limit(1).count():
            return nodes.drop("mixed"), members
    raise ValueError(f"{ATTEMPTS} families of hashes all gave different prefixes one fingerprint")


def _totals(paths: DataFrame, work: Workspace) -> DataFrame:
    """``owner, saved, leaves``: sums over each path and all paths below it, by pointer doubling.

    ``paths(owner, up, saved, leaves)``: ``up`` is the owner of the path it hangs from, null at the top. After round k a
    path has the sums of the paths less than 2^k below it, and ``up`` is its ancestor 2^k above.
    """
    state = paths.select("owner", "up", "saved", "leaves")
    while state.where(F.col("up").isNotNull()).limit(1).count():
        below = state.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("owner"))
        below = below.agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        above = state.select(F.col("owner").alias("up"), F.col("up").alias("next"))
        moved = hot_join(state.where(F.col("up").isNotNull()), above, ["up"], "left").drop("up").withColumnRenamed("next", "up")
        top = state.where(F.col("up").isNull())
        both = moved.select(*state.columns).unionByName(top).join(below, "owner", "left")
        add = lambda a: (F.col(a) + F.coalesce(F.col(f"more_{a}"), F.lit(0))).alias(a)
        state = work.cut(both.select("owner", "up", add("saved"), add("leaves")))
    return state.select("owner", "saved", "leaves")


def _hash_rows(key: list[str]):
    """One hash for each key over its pieces in order; rows are sorted, and one hash state is alive at a time."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, done = None, None, []
        for batch in batches:
            for *k, piece in zip(*(batch.column(x).to_pylist() for x in (*key, "ids"))):
                if k != at:
                    if at is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(piece.encode())
            yield out(done)
            done = []
        if at is not None:
            yield out([(*at, state.hexdigest())])
        give_back()

    def out(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done)) or [[]] * (len(key) + 1)
        kinds = [pa.int64()] * len(key) + [pa.string()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=[*key, "ends_sha256"])

    return rows


def _ends(members: DataFrame, key: list[str], work: Workspace) -> DataFrame:
    """``depth, f*, ends_sha256`` of nodes where conversations end.

    Ids are put in order by range, and joined to texts of ``BLOCK`` ids in many tasks; only these meet in the one stream
    that a hash over an ordered list is.
    """
    ended = numbered(members.where("ends").select(*key, "conv_id"), key, ["conv_id"], "at", work=work)
    blocks = ended.groupBy(*key, F.floor((F.col("at") - 1) / BLOCK).alias("block"))
    blocks = blocks.agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    lined = blocks.repartition(*key).sortWithinPartitions(*key, "block")
    return lined.mapInArrow(_hash_rows(key), ", ".join(f"{k} long" for k in key) + ", ends_sha256 string")


def prefix_trie(conversations: DataFrame, work: Workspace | None = None) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` -> one row per node: ``conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256``.

    Turns go by number, null first; turns that share a number by role and text. Null roles and texts are empty; rows of a
    null conv_id take no part; repeated rows are turns of their own; very long texts are hashed whole. Conversations
    rebuilt without a turn end at the root. Other columns are ignored; an empty table has no node, not even a root.
    """
    work = work or Workspace(conversations.sparkSession, "trie")
    key = ["depth", *(f"f{k}" for k in _K)]
    nodes, members = _nodes(conversations, work)
    parent = [(F.col("depth") - 1).alias("depth"), *(F.col(f"p{k}").alias(f"f{k}") for k in _K)]
    kids = nodes.where("depth > 0").groupBy(*parent).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, key, "left").fillna({"n_children": 0})
    nodes = work.cut(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("size")))
    top = F.min_by(F.struct("depth", *(f"p{k}" for k in _K)), "depth").alias("top")
    paths = nodes.groupBy("owner").agg(top, F.sum("saved").alias("saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    hung = paths.select("owner", "saved", "leaves", (F.col("top.depth") - 1).alias("depth"), *(F.col(f"top.p{k}").alias(f"f{k}") for k in _K))
    hung = hot_join(hung, nodes.select(F.col("owner").alias("up"), *key), key, "left")
    paths = work.cut(hung.select("owner", "up", F.col("depth").alias("at"), "saved", "leaves"))
    totals = _totals(paths, work).select("owner", F.col("saved").alias("all_saved"), F.col("leaves").alias("all_leaves"))
    below = paths.where(F.col("up").isNotNull()).select("owner", "up", "at").join(totals, "owner")
    below = below.groupBy(F.col("up").alias("owner"), F.col("at").alias("depth")).agg(F.sum("all_saved").alias("b_saved"), F.sum("all_leaves").alias("b_leaves"))
    begins = paths.where(F.col("up").isNotNull()).select("owner", (F.col("at") + 1).alias("depth"), "up")
    hashed = nodes.join(below, ["owner", "depth"], "left").join(begins, ["owner", "depth"], "left").join(_ends(members, key, work), key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    sums = {"saved_tokens": F.col("saved") + zero("b_saved"), "n_leaves": (F.col("n_children") == 0).cast("long") + zero("b_leaves")}
    hashed = hashed.select("owner", "depth", "n_convs", "n_children", "up", "ends_sha256", *(v.alias(f"_{k}") for k, v in sums.items()))
    summed = numbered(hashed, ["owner"], [F.desc("depth")], "_n", {k: F.col(f"_{k}") for k in sums}, work, [f"_{k}" for k in sums])
    return summed.select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("up", "owner")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


_CRC_STEP = "CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END"


def _crc_table() -> str:
    steps = "CAST(i AS BIGINT)"
    out = f"SELECT i, {steps} AS c FROM range(256) t(i)"
    for _ in range(8):
        out = f"SELECT i, {_CRC_STEP.format(c='c')} AS c FROM ({out})"
    return f"SELECT list(c ORDER BY i) AS crc FROM ({out})"


#: DuckDB twin: prefixes as joined hashes of turns; a node's subtree is all nodes whose key begins with its own.
ORACLE = f"""
WITH t AS MATERIALIZED ({_crc_table()}),
turns AS (SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c FROM turns),
convs AS (SELECT c, c - c % 100 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: xor(a >> 8, crc[CAST(xor(a, b) & 255 AS INT) + 1])), 4294967295) % 6 AS h FROM ids, t),
head AS (SELECT convs.c, role, text, pos AS d FROM convs JOIN turns ON turns.c = base AND pos <= h),
nb AS (SELECT convs.c, h, count(head.d) AS nb FROM convs LEFT JOIN head USING (c) GROUP BY ALL),
built AS (SELECT * FROM head UNION ALL
    SELECT nb.c, role, text, nb + pos - h FROM nb JOIN turns ON turns.c = nb.c AND pos > h),
lengths AS (SELECT nb.c, count(d) AS n FROM nb LEFT JOIN built USING (c) GROUP BY 1),
members AS (SELECT c, d, text, string_agg(sha256(len(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d) AS k FROM built
    UNION ALL SELECT c, 0, '', '' FROM ids),
nodes AS (SELECT k, d, count(*) AS n_convs, min(c) AS conv_id, max(length(text)) AS size,
    coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = n), '') AS ends
    FROM members JOIN lengths USING (c) GROUP BY k, d),
kids AS (SELECT a.k, count(b.k) AS n_children FROM nodes a LEFT JOIN nodes b ON b.d = a.d + 1 AND left(b.k, 64 * a.d) = a.k GROUP BY 1),
sums AS (SELECT a.k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.size) AS saved
    FROM nodes a JOIN nodes b ON left(b.k, 64 * a.d) = a.k JOIN kids ON kids.k = b.k GROUP BY 1)
SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, a.n_convs, n_children, n_leaves,
    CAST(saved AS BIGINT) AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM nodes a JOIN kids USING (k) JOIN sums USING (k) LEFT JOIN nodes p ON p.d = a.d - 1 AND p.k = left(a.k, 64 * p.d)"""
