"""Similarity join on word shingles by token-combination prefixes.

Tokens are the 64-bit hashes of a document's distinct shingles. All documents order their tokens alike: by how many
documents have them, rarest first, then by hash. Two sets with Jaccard similarity t or more share one token in the
first n - ceil(t n) + 1 of each, and 1 + m tokens if those prefixes are extended by m. Rare tokens of a prefix are
index keys by themselves. Frequent ones are dealt to m groups by hash and indexed in pairs within a group: if two
documents share 1 + m tokens and none is rare, two of them lie in one group. So no link is lost, and a passage that
half of the corpus has does not make a key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from .common import LOWER, UPPER, bound_batches, col, forget, release, settled, typed, written

SHINGLE = 5
#: Jaccard similarity from which documents link, in hundredths.
LEAST = 80
#: Tokens in so many documents or more are of the frequent class.
FREQUENT = 32
#: Extension of a prefix, and number of groups of frequent tokens, per token of a set.
EXTENSION = 0.04
BATCH_BYTES = 2 << 20
PART_TOKENS = 1 << 20
#: Members of a block, probes that are held against it at a time, and documents from which a component has groups of its own.
BLOCK, PROBES, LARGE = 128, 512, 32
#: Rows of a table of components up to which it is sent to every executor (24 bytes each).
BROADCAST_ROWS = 300_000
#: Rounds of likely pairs before the exact one, and partners a document has in each of them.
ROUNDS, PARTNERS = 2, 2
SALTS = 8

_U = np.uint64
_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ODD = np.random.default_rng(77).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * _U(2) + _U(1)
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)]), dtype=np.uint64) for b in (_U(_BASE), _U(_INVERSE))]
    return _powers[0][:n], _powers[1][:n]


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text. Fewer words than a shingle are one token together; no words, none."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace").translate(_TO_LOWER), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    edge = np.diff(np.concatenate([[True], _IS_SPACE[raw], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _power(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)])
    word = _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    n = len(word)
    if n < SHINGLE:
        return _mix((word * _ODD[:n]).sum(dtype=np.uint64, keepdims=True) + _U(n))
    out = np.zeros(n - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        out += word[k : n - SHINGLE + 1 + k] * _ODD[k]
    return np.unique(_mix(out))


def _set_id(s: np.ndarray) -> int:
    """A signed 64-bit id of a set of tokens; equal sets have equal ids."""
    return int(_mix(_mix(s).sum(dtype=np.uint64, keepdims=True) + np.array([len(s)], np.uint64) * _U(_BASE))[0].astype(np.int64))


def _batch_sets(texts: pa.ChunkedArray) -> tuple[list[np.ndarray], list[int], list[int], np.ndarray, np.ndarray]:
    """Sets and ids of the texts of a batch, the first place of each distinct set, and the batch's tokens with their documents."""
    sets = [shingles(t) for t in texts.to_pylist()]
    ids = [_set_id(s) if len(s) else 0 for s in sets]
    first: dict[int, int] = {}
    for k, i in enumerate(ids):
        if len(sets[k]):
            first.setdefault(i, k)
    own = [sets[k] for k in first.values()]
    tokens, counts = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return sets, ids, [*first.values()], tokens, counts


def _count_tokens(bits: int):
    """Per batch: its tokens, cut to 32 bits below the part's bits, and their counts, by part."""
    schema = pa.schema([("part", pa.int32()), ("batch", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        _, _, _, tokens, counts = _batch_sets(table["text"])
        part = (tokens >> _U(64 - bits)).astype(np.int64)
        keys = ((tokens >> _U(32 - bits)) & _U(0xFFFFFFFF)).astype(np.uint32)
        cut = np.flatnonzero(np.diff(part)) + 1
        spans = [(a, b) for a, b in zip([0, *cut], [*cut, len(part)], strict=True) if b > a]
        batch = table["batch"][0].as_py()
        release()
        return pa.Table.from_arrays(
            [
                pa.array([int(part[a]) for a, _ in spans], pa.int32()), pa.array([batch] * len(spans), pa.int32()),
                pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([counts[a:b].astype(np.uint32).tobytes() for a, b in spans], pa.binary()),
            ],
            schema=schema,
        )

    return run


def _levels(table: pa.Table) -> pa.Table:
    """Per part: for each batch, a byte per token that orders tokens by the number of documents; exact up to 191, then by powers of two."""
    keys = [np.frombuffer(x, np.uint32) for x in table["keys"].to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table["counts"].to_pylist()]).astype(np.int64)
    all_keys = np.concatenate(keys)
    order = np.argsort(all_keys, kind="stable")
    sorted_keys = all_keys[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    docs = np.add.reduceat(counts[order], starts)
    level = np.where(docs < 192, docs, 192 + np.log2(np.maximum(docs, 1))).astype(np.uint8)
    out = np.empty(len(all_keys), np.uint8)
    out[order] = np.repeat(level, np.diff(np.concatenate([starts, [len(sorted_keys)]])))
    release()
    pieces = np.split(out, np.cumsum([len(k) for k in keys])[:-1])
    return pa.Table.from_arrays(
        [table["batch"].combine_chunks(), table["part"].combine_chunks(), pa.array([p.tobytes() for p in pieces], pa.binary())], ["batch", "part", "levels"]
    )


def keys_of(tokens: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The index keys of a set: rare tokens of its extended prefix, and pairs of frequent ones within their groups."""
    n = len(tokens)
    prefix = n - -(-LEAST * n // 100) + 1
    if n == 1:
        return tokens[level > 1].view(np.int64)
    size = int(np.floor(np.log(n) / np.log(1.25) + 1e-9))
    groups = [max(1, int(EXTENSION * 1.25 ** (c - 1))) for c in (size, size + 1)]
    longest = min(n, prefix + groups[1])
    if (level == 1).sum() >= longest:
        return np.zeros(0, np.int64)
    order = np.lexsort((tokens, level))[:longest]
    tokens, level = tokens[order], level[order]
    out = [tokens[(level > 1) & (level < FREQUENT)]]
    for c, m in zip((size, size + 1), groups, strict=True):
        own = tokens[: prefix + m][level[: prefix + m] >= FREQUENT]
        if len(own) < 2:
            continue
        group = (_mix(own + _U(c)) % _U(m)).astype(np.int64)
        place = np.lexsort((own, group))
        own, group = own[place], group[place]
        cut = [0, *(np.flatnonzero(np.diff(group)) + 1), len(group)]
        for a, b in zip(cut, cut[1:], strict=False):
            if b - a > 1:
                i, j = np.triu_indices(b - a, 1)
                out.append(_mix(own[a:b][i] * _U(3) + _mix(own[a:b][j] + _U(c))))
    return np.unique(np.concatenate(out)).view(np.int64)


def _index(left: pa.Table, right: pa.Table) -> pa.Table:
    """Per batch: a row per document, and for the first of each distinct set its keys and, if it has any, its tokens."""
    sets, ids, first, tokens, _ = _batch_sets(left["text"])
    parts = sorted(zip(right["part"].to_pylist(), right["levels"].to_pylist(), strict=True))
    level = np.frombuffer(b"".join(x for _, x in parts), np.uint8)
    keys: list = [None] * len(sets)
    held: list = [None] * len(sets)
    for k in first:
        own = keys_of(sets[k], level[np.searchsorted(tokens, sets[k])])
        if len(own):
            keys[k], held[k] = own, sets[k].tobytes()
    release()
    return pa.Table.from_arrays(
        [
            left["doc_id"].combine_chunks(), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64()),
            pa.array(keys, pa.list_(pa.int64())), pa.array(held, pa.binary()),
        ],
        ["doc_id", "n", "node", "keys", "tokens"],
    )


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= LEAST * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    @F.arrow_udf("boolean")
    def same(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([_linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.bool_())

    one = reps.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    two = reps.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    return pairs.join(one, "a").join(two, "b").where(same("ta", "tb")).select("a", "b")


def _likely(rows: DataFrame) -> DataFrame:
    """Pairs of neighbours under a key, of different components, in the order of size; of each document those that are neighbours most often."""
    both = [F.lag(c).over(Window.partitionBy("key", "salt").orderBy("n", "node")).alias(f"p_{c}") for c in ("node", "n", "comp")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    heads = salted.groupBy("key", "salt").agg(F.min(F.struct("n", "node", "comp")).alias("h")).select("key", F.lit(-1).cast("long").alias("salt"), "h.node", "h.n", "h.comp")
    chain = salted.select("key", "salt", "node", "n", "comp").union(heads.select("key", "salt", "node", "n", "comp")).select("*", *both)
    found = chain.where((F.col("p_comp") != F.col("comp")) & (100 * F.col("p_n") >= LEAST * F.col("n")))
    often = found.groupBy(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")).count()
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("count"), "a"))
    return often.withColumn("rank", rank).where(F.col("rank") <= PARTNERS).select("a", "b")


def _block_links(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between the probes (right) and a block of members (left), one for each component of the block that a probe meets."""
    out_a, out_b = [], []
    if left.num_rows and right.num_rows:
        members = [np.frombuffer(t, np.uint64) for t in left["tokens"].to_pylist()]
        nodes, comps, sizes = left["node"].to_pylist(), left["comp"].to_pylist(), np.array([len(m) for m in members])
        owner = np.repeat(np.arange(len(members)), sizes)
        tokens = np.concatenate(members)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        for node, comp, raw in zip(*(right[c].to_pylist() for c in ("probe", "probe_comp", "probe_tokens")), strict=True):
            probe = np.frombuffer(raw, np.uint64)
            lo, hi = np.searchsorted(tokens, probe, "left"), np.searchsorted(tokens, probe, "right")
            width = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
            both = np.bincount(owner[at], minlength=len(members))
            seen = {comp}
            for k in np.flatnonzero(100 * both >= LEAST * (len(probe) + sizes - both)):
                if comps[k] not in seen:
                    seen.add(comps[k])
                    out_a.append(node)
                    out_b.append(nodes[k])
        release()
    return pa.Table.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])


def _remaining(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """All links between components that meet under any key; rows have key, node, n, comp and the number k of documents under the key.

    Documents are gathered into groups: those of a component of LARGE or more under the commonest of their keys,
    and those of small components under theirs. A group lies under one key, and the documents of a family of near copies
    fall into few groups. Two groups that meet under any key with sizes that fit are held against each other, the group of the
    smaller component as probes against blocks of the other; a group of small components also against itself. So
    neither pairs of documents nor pairs of components become rows.
    """
    best = rows.groupBy("node").agg(F.max(F.struct("k", "key")).alias("home"), F.first("comp").alias("comp"))
    size = best.groupBy("comp").agg(F.count("*").alias("size"))
    big = F.when(F.col("size") >= LARGE, F.col("size")).otherwise(F.lit(0))
    info = settled(
        best.join(size, "comp").withColumn("big", big)
        .select("node", "comp", "big", F.xxhash64("home.key", F.when(F.col("big") > 0, F.col("comp"))).alias("g"))
    )
    met = rows.drop("comp").join(info, "node").groupBy("key", "g").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.first("big").alias("big")
    )
    shared = met.groupBy("key").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).where("c0 <> c1").select("key")
    met = met.join(shared, "key")
    x, y = met.alias("x"), met.alias("y")
    ordered = F.struct("x.big", "x.c0", "x.g") <= F.struct("y.big", "y.c0", "y.g")
    ordered = F.when((F.col("x.big") == 0) & (F.col("y.big") == 0), F.col("x.g") <= F.col("y.g")).otherwise(ordered)
    apart = F.least("x.c0", "y.c0") < F.greatest("x.c1", "y.c1")
    fits = (100 * F.col("x.hi") >= LEAST * F.col("y.lo")) & (100 * F.col("y.hi") >= LEAST * F.col("x.lo"))
    couples = settled(x.join(y, (F.col("x.key") == F.col("y.key")) & ordered & apart & fits).select(F.col("x.g").alias("small"), F.col("y.g").alias("large")).distinct())
    members = info.groupBy("g").agg(F.count("*").alias("members"))
    tokens = reps.select("node", "tokens")
    # every block of members is held against every block of probes: no task holds more than BLOCK of the ones and about PROBES of the others
    sized = couples.join(members.select(F.col("g").alias("large"), F.ceil(F.col("members") / BLOCK).cast("long").alias("blocks")), "large")
    asking = sized.join(members.select(F.col("g").alias("small"), F.col("members").alias("asking")), "small")
    shape = settled(asking.groupBy("large").agg(F.first("blocks").alias("blocks"), F.ceil(F.sum("asking") / PROBES).cast("long").alias("turns")))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    place = lambda node, n: F.pmod(F.xxhash64(node), F.col(n))
    larger = info.select("node", "comp", F.col("g").alias("large")).join(shape, "large").join(tokens, "node").select(
        "large", place("node", "blocks").alias("block"), each("turns").alias("turn"), "node", "comp", "tokens"
    )
    probes = couples.join(shape, "large").join(info.select(F.col("g").alias("small"), "node", F.col("comp").alias("probe_comp")), "small").join(tokens, "node").select(
        F.col("large").alias("to_large"), each("blocks").alias("to_block"), place("node", "turns").alias("to_turn"),
        F.col("node").alias("probe"), "probe_comp", F.col("tokens").alias("probe_tokens"),
    )
    return larger.groupBy("large", "block", "turn").cogroup(probes.groupBy("to_large", "to_block", "to_turn")).applyInArrow(_block_links, "a long, b long")


def _with(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows left-joined to a table with one row per key. A key may have a large share of the rows, so a table of BROADCAST_ROWS at most goes to them; a larger
    one meets them in a sort-merge join, whose hot partitions adaptive execution splits."""
    table = settled(table)
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, key, "left")


def similar_sets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: component_id is the smallest id that links reach.

    Documents with equal sets are one node. Two rounds verify likely pairs (neighbours under a key) and
    join what links into components; the last step holds all components that meet under a key against each other, so
    the partners kept in the first rounds save work and decide nothing. Token counts cover all documents; they go to
    32-bit keys by part and come back as one byte per token, aligned with the tokens of a batch, so
    counting moves 4 bytes per token. A hot token is one entry per batch, a hot set one row per batch.

    Nulls: a null text has no words and links with nothing; rows with a null id get no component id of their own, and
    nulls don't count as smallest. Rows that share an id are one document if their texts are equal, else two that
    share the id. Ids may have any type that can be ordered. Other columns are left out, whatever their names. An empty table gives an empty one.
    """
    spark = df.sparkSession
    bound_batches(spark)
    docs = df.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    indexed = typed("doc_id", docs.schema["doc_id"].dataType, "n long, node long, keys array<long>, tokens binary")
    volume = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_batches = max(volume // BATCH_BYTES + 1, 2 * min(tasks, volume // (1 << 18) + 1))
    bits = max(1, (max(volume // 6 // PART_TOKENS, min(tasks, volume // (1 << 20))) or 1).bit_length())
    dealt = docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_batches)).cast("int"))
    counted = dealt.groupBy("batch").applyInArrow(_count_tokens(bits), "part int, batch int, keys binary, counts binary")
    levels = counted.groupBy("part").applyInArrow(_levels, "batch int, part int, levels binary")
    index = dealt.groupBy("batch").cogroup(levels.groupBy("batch")).applyInArrow(_index, indexed)
    index = written(index, "shingle-index")
    del counted, levels
    forget(spark)
    held = index.where("keys IS NOT NULL").dropDuplicates(["node"]).select("node", "n", "keys", "tokens")
    reps = written(held, "shingle-sets")
    keyed = reps.select("node", "n", F.explode("keys").alias("key"))
    live = keyed.join(keyed.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), "key")
    rows = written(live.select("key", "node", "n", "k"), "shingle-keys")
    del held, live
    forget(spark)
    links, comps = None, None
    for _ in range(ROUNDS):
        now = rows.withColumn("comp", F.col("node")) if comps is None else rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        found = settled(_verified(_likely(now), reps))
        links = found if links is None else links.union(found)
        comps = settled(components(links).withColumnRenamed("root", "comp"))
        forget(spark)
    now = rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    links = links.union(settled(_remaining(now, reps)))
    comps = components(links).withColumnRenamed("root", "comp")
    slim = _with(index.select("doc_id", F.col("n").alias("n_shingles"), "node"), comps, "node").withColumn("comp", F.coalesce("comp", "node"))
    least = slim.where("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count("*").alias("c")).where("c > 1").select("comp", "least")
    out = _with(slim, least, "comp")
    own = F.when((F.col("n_shingles") > 0) & F.col("least").isNotNull(), F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def op8_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar_sets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Shingles of sets over lists of words; links over an inverted index of shingles; components by a recursive union.
OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END) AS g
  FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 80 * (p.n + q.n - o)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT DISTINCT x AS a, x AS b FROM e
  UNION
  SELECT r.a, e.y FROM r JOIN e ON r.b = e.x
), m AS (
  SELECT a, min(b) AS least FROM r GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, coalesce(m.least, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""
