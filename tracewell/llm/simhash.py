"""Near duplicates by SimHash: ball hashing meets in the middle, then components.

Each fingerprint emits itself and all fingerprints within half the radius. Two fingerprints
within the radius share at least one of these variants, so grouping by variant finds every
link without comparing pairs.

Only distinct fingerprints are shuffled: thousands of copies are one. The members of one
variant's group then differ from it in few bits, so a group has at most as many members as
the ball has points, whatever the corpus holds.

Defined results: null and empty texts have fingerprint zero, linked like any other; repeated
rows are copies of each other; a null id takes part but is never a component's name unless
its group has no other; empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.components import components
from tracewell.llm.text import LOWER, SPACE, mixed, pieces, tidy, words
from tracewell.session import cut_lineage

SEED = 42
#: shingles summed in byte counters before they could overflow
BLOCK = 255


def shingle_hashes(
    data: np.ndarray, offs: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of every shingle of all rows, first shingle of each row and the total)."""
    data = LOWER[data]
    data[SPACE[data]] = 0x20
    starts, ends, first = words(data, offs, SPACE_OUT)
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    word = np.repeat(first[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
    last = np.minimum(word + size, np.repeat(first[1:], count)) - 1
    # a shingle is one stretch of the buffer where single spaces stand between its words
    wide = np.zeros(len(starts) + 1, np.int64)
    if len(starts):
        wide[1:-1] = np.cumsum(starts[1:] != ends[:-1] + 1)
        wide[-1] = wide[-2] if len(starts) > 1 else 0
    loose = np.flatnonzero(wide[last] != wide[word]) if len(word) else word
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(raw[a:b], SEED) for a, b in zip(starts[word].tolist(), ends[last].tolist())],
        dtype=np.uint64,
    )
    for i in loose.tolist():
        text = b" ".join(raw[starts[w] : ends[w]] for w in range(word[i], last[i] + 1))
        hashes[i] = digest(text, SEED)
    return hashes, bounds


SPACE_OUT = ~SPACE


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each row a fingerprint whose bits are set in over half of its hashes."""
    count = np.diff(bounds)
    out = np.zeros(len(count), np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    blocks = -(-count[full] // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])[:-1]
    inner = np.arange(blocks.sum()) - np.repeat(first, blocks)
    block_start = np.repeat(bounds[:-1][full], blocks) + inner * BLOCK
    lanes = np.uint64(0x0101010101010101)
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & lanes, block_start)
        per_bit = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            bit = (2 * per_bit[:, byte] > count[full]).astype(np.uint64)
            out[full] |= bit << np.uint64(8 * byte + k)
    return out


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3
) -> DataFrame:
    """doc_id, mark (a hash of the text) and fp (64 bits as a long) of every row; one narrow pass."""

    @tidy
    def hashed(batches):
        for batch in batches:
            found = [
                majority(*shingle_hashes(data, offs, size))
                for _, _, data, offs in pieces(batch.column(2))
            ]
            fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
            columns = [batch.column(0), batch.column(1), pa.array(fp.view(np.int64))]
            yield pa.record_batch(columns, ["doc_id", "mark", "fp"])

    chosen = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), mark_of(text_col).alias("mark"), F.col(text_col).alias("text")
    )
    return chosen.mapInArrow(hashed, "doc_id long, mark long, fp long")


def mark_of(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def ball(half: int) -> list[int]:
    """Masks of up to `half` of 64 bits, as signed longs."""
    masks = [
        sum(1 << b for b in bits) for k in range(half + 1) for bits in combinations(range(64), k)
    ]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) with a < b that connect all distinct fingerprints within the radius.

    All members of a variant's group are within twice the half radius of each other; a star
    around the smallest keeps the group connected. For an odd radius the pairs of a group,
    bounded by the ball, are compared and only those within the radius linked.
    """
    half = (radius + 1) // 2
    masks = F.array(*[F.lit(m) for m in ball(half)])
    variants = fps.select("fp", F.explode(masks).alias("mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant")
    )
    groups = variants.groupBy("variant").agg(F.collect_set("fp").alias("members"))
    groups = groups.where(F.size("members") > 1)
    if radius % 2 == 0:
        edges = groups.select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
    else:
        edges = groups.select(F.explode("members").alias("a"), "members").select(
            "a", F.explode("members").alias("b")
        )
        edges = edges.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return edges.where(F.col("a") < F.col("b")).distinct()


def grouped(hashed: DataFrame, radius: int) -> DataFrame:
    """fp and root of every fingerprint, and first: the least (no id, doc_id, mark) of its rows."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    distinct = cut_lineage(hashed.groupBy("fp").agg(F.min(row).alias("first")))
    found = components(links(distinct.select("fp"), radius))
    return distinct.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first"
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 3,
    radius: int = 2,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest id of the group)."""
    hashed = cut_lineage(fingerprints(docs, id_col, text_col, size))
    named = grouped(hashed, radius)
    smallest = named.groupBy("root").agg(F.min("first").alias("least"))
    named = named.join(smallest, "root").select("fp", F.col("least.doc_id").alias("component_id"))
    return hashed.join(named, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def one_of_each(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 3,
    radius: int = 2,
) -> DataFrame:
    """One row of each group, its smallest id (and least mark), with all columns of `docs`.

    Rows that are equal in id and text are one document, so one of them stays.
    """
    hashed = cut_lineage(fingerprints(docs, id_col, text_col, size))
    return _only(docs, grouped(hashed, radius).groupBy("root").agg(F.min("first").alias("least")), id_col, text_col)


def _only(docs: DataFrame, least: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `docs` with the ids and marks of `least`, each once."""
    stay = least.select(F.col("least.doc_id").alias("stay_id"), F.col("least.mark").alias("stay_mark"))
    # the input's columns are one struct, so no name of theirs meets one of these
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).select(
        "row", F.col(f"row.`{id_col}`").cast("long").alias("row_id"), mark_of(f"row.`{text_col}`").alias("row_mark")
    )
    same = F.col("row_id").eqNullSafe(F.col("stay_id")) & (F.col("row_mark") == F.col("stay_mark"))
    kept = rows.join(stay, same, "left_semi").dropDuplicates(["row_id", "row_mark"])
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


# Near duplicates by similarity ---------------------------------------------------------------
#
# Texts that share 80 % of their shingles differ in about 15 % of a SimHash's bits, far beyond any
# ball that can be emitted. So the join is by prefixes: with all shingles in one order, two sets
# of that similarity share a shingle within their first fifth. Any order is right; common shingles
# come last, so that a passage of many texts is in few prefixes.

#: counters by which shingles are ordered, and rows they are summed in
SLOTS, SLOT_PARTS = 1 << 20, 64
#: members of a bucket up to which all its pairs are candidates at once
BUCKET = 64


def slot_counts(docs: DataFrame, size: int) -> np.ndarray:
    """How many shingles of all texts fall on each counter; `docs` has text."""
    step = SLOTS // SLOT_PARTS

    @tidy
    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, data, offs in pieces(batch.column(0)):
                hashes, _ = shingle_hashes(data, offs, size)
                total += np.bincount((hashes & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        parts = [total[k * step : (k + 1) * step].tobytes() for k in range(SLOT_PARTS)]
        yield pa.record_batch([pa.array(range(SLOT_PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    def summed(table: pa.Table) -> pa.Table:
        total = np.zeros(step, np.int64)
        for counts in table.column("counts"):
            total += np.frombuffer(counts.as_py(), np.int64)
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, counts binary"
    found = docs.select("text").mapInArrow(run, schema).groupBy("part").applyInArrow(summed, schema).collect()
    out = np.zeros(SLOTS, np.int64)  # a fixed number of counters
    for r in found:
        out[r.part * step : (r.part + 1) * step] = np.frombuffer(bytes(r.counts), np.int64)
    return out


def forms(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """doc_id, mark, form, n, prefix of every row; `docs` has doc_id, mark and text.

    The form is a hash of the set of shingles: rows of one form are copies of each other. n is the
    size of the set, prefix those shingles of which similar sets share at least one.
    """
    schema = "doc_id long, mark long, form long, n int, prefix array<long>"
    order = docs.sparkSession.sparkContext.broadcast(slot_counts(docs, size))

    @tidy
    def run(batches):
        for batch in batches:
            for row, end, data, offs in pieces(batch.column(2)):
                hashes, bounds = shingle_hashes(data, offs, size)
                rows = end - row
                own = np.repeat(np.arange(rows), np.diff(bounds))
                rank = order.value[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)]
                by = np.lexsort((hashes, rank, own))
                own, hashes = own[by], hashes[by]
                new = np.ones(len(own), bool)
                new[1:] = (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])
                own, hashes = own[new], hashes[new]
                form = np.zeros(rows, np.uint64)
                np.add.at(form, own, mixed(hashes))
                n = np.bincount(own, minlength=rows)
                place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                length = n - np.ceil(similarity * n - 1e-6).astype(np.int64) + (n > 0)
                kept = hashes[place < length[own]] >> np.uint64(20)
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(row, rows), batch.column(1).slice(row, rows), pa.array(form.view(np.int64)),
                        pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(kept.astype(np.int64))),
                    ],
                    ["doc_id", "mark", "form", "n", "prefix"],
                )

    return docs.mapInArrow(run, schema)


def buckets(kinds: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame]:
    """(token, form, n, at, prior) of tokens that 2 to `bucket` prefixes hold, and of more common ones.

    prior: the form's token before, of those that other prefixes hold too.
    """
    rows = kinds.select("form", "n", F.posexplode("prefix").alias("at", "token"))
    counted = rows.groupBy("token").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    prior = F.lag("token").over(Window.partitionBy("form").orderBy("at"))
    shared = cut_lineage(rows.join(counted, "token").withColumn("prior", prior))
    return shared.where(F.col("members") <= bucket).drop("members"), shared.where(F.col("members") > bucket).drop("members")


def may_link(l: str, r: str, similarity: float):
    """Whether two members of a bucket can be similar if its token is the first they share.

    With the same token before, they also met there, so it is not the first.
    """
    rest = F.least(F.col(f"{l}.n") - F.col(f"{l}.at"), F.col(f"{r}.n") - F.col(f"{r}.at"))
    first = F.coalesce(F.col(f"{l}.prior") != F.col(f"{r}.prior"), F.lit(True))
    return (rest >= similarity / (1 + similarity) * (F.col(f"{l}.n") + F.col(f"{r}.n")) - 1e-6) & first


def paired(left: DataFrame, right: DataFrame, condition) -> DataFrame:
    """Distinct pairs (a, b), a < b, of forms with a common token."""
    met = left.alias("l").join(right.alias("r"), (F.col("l.token") == F.col("r.token")) & condition)
    return met.select(F.least("l.form", "r.form").alias("a"), F.greatest("l.form", "r.form").alias("b")).distinct()


def compared(pairs: DataFrame, kinds: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """a, b and their similarity, on whole sets."""
    pairs = cut_lineage(pairs)
    wanted = pairs.select(F.col("a").alias("form")).union(pairs.select(F.col("b").alias("form"))).distinct()
    where = kinds.join(wanted, "form").select("form", "first.*").alias("r")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.mark") == F.col("r.mark"))
    texts = chosen.alias("l").join(where, same).select("r.form", "l.text")
    sets = cut_lineage(shingle_sets(texts, size).dropDuplicates(["form"]))
    both = pairs.join(sets.select(F.col("form").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("form").alias("b"), F.col("shingles").alias("y")), "b"
    )
    common = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("all"))
    return cut_lineage(common.select("a", "b", (F.col("common") / (F.col("all") - F.col("common"))).alias("similarity")))


def similar_pairs(kinds: DataFrame, chosen: DataFrame, size: int, similarity: float, bucket: int) -> DataFrame:
    """Links (a, b) of similar forms that connect all of them.

    In small buckets all pairs are compared. In a large one every member is compared with the
    centre; those similar to it are connected. The others are compared with all members whose
    distance to the centre does not rule them out (it is a metric); such a bucket is joined by
    its token, so its rows are never one task's alone.
    """
    few, many = buckets(kinds, bucket)
    near = may_link("l", "r", similarity)
    pairs = paired(few, few, (F.col("l.form") < F.col("r.form")) & near)
    # the member with the fewest shingles of its own is what copies with edits have in common
    own = many.groupBy("form").agg((-F.count(F.lit(1)) / F.first("n")).alias("own"))
    rank = F.min(F.struct("own", F.xxhash64("form").alias("rank"), F.col("form").alias("centre")))
    centres = cut_lineage(many.join(own, "form").groupBy("token").agg(rank.alias("least")).select("token", "least.centre"))
    met = many.join(centres, "token").where("form != centre")
    pairs = pairs.union(met.select(F.least("form", "centre"), F.greatest("form", "centre"))).distinct()
    found = compared(pairs, kinds, chosen, size)
    known = found.select("a", "b", "similarity").union(found.select("b", "a", "similarity")).toDF("form", "centre", "similarity")
    far = 1 - F.coalesce("similarity", F.lit(1.0))  # the centre itself is at 0
    members = cut_lineage(
        many.join(centres, "token").join(known, ["form", "centre"], "left").select("token", "form", "n", "at", "prior", far.alias("far"))
    )
    away = 1 - similarity + 1e-9
    open_ones = members.where(F.col("far") > away)
    if not open_ones.isEmpty():
        # of two open members the pair is made once
        once = (F.col("r.far") <= away) | (F.col("l.form") < F.col("r.form"))
        rest = paired(open_ones, members, once & near & (F.abs(F.col("l.far") - F.col("r.far")) <= away))
        new = rest.join(found, ["a", "b"], "left_anti")
        found = found.union(compared(new, kinds, chosen, size))
    return found.where(F.col("similarity") >= similarity - 1e-12).select("a", "b")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """form and its distinct shingles, as 64-bit hashes; `docs` has form and text."""

    @tidy
    def run(batches):
        for batch in batches:
            for row, end, data, offs in pieces(batch.column(1)):
                hashes, bounds = shingle_hashes(data, offs, size)
                sets = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(bounds, bounds[1:])]
                yield pa.record_batch(
                    [batch.column(0).slice(row, end - row), pa.array(sets, pa.list_(pa.int64()))], ["form", "shingles"]
                )

    return docs.mapInArrow(run, "form long, shingles array<long>")


def fingerprint_links(chosen: DataFrame, kinds: DataFrame, size: int, radius: int) -> DataFrame:
    """Links (a, b) of forms whose fingerprints are equal or within the radius.

    A form has the fingerprint of its first row; forms of one fingerprint hang on the least of them.
    """
    first = kinds.select("form", "first.doc_id", "first.mark")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.mark") == F.col("r.mark"))
    marked = fingerprints(chosen, size=size).alias("l").join(first.alias("r"), same).select("r.form", "l.fp").distinct()
    marked = cut_lineage(marked)
    least = cut_lineage(marked.groupBy("fp").agg(F.min("form").alias("least")))
    copies = marked.join(least, "fp").where("form != least").select(F.col("least").alias("a"), F.col("form").alias("b"))
    near = links(least.select("fp"), radius)
    near = near.join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b")
    return copies.union(near.select(F.least("x", "y"), F.greatest("x", "y")))


def one_of_similar(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    similarity: float = 0.8,
    bucket: int = BUCKET,
    fp_size: int = 3,
    radius: int | None = None,
) -> DataFrame:
    """One row of each group of similar texts, its smallest id, with all columns of `docs`.

    Links join all texts whose sets of shingles have a Jaccard similarity of at least
    `similarity`, on the whole sets; groups are the components of links. With `radius`, fingerprints
    within so many bits of each other are links too, as in `near_duplicates`.
    """
    chosen = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), mark_of(text_col).alias("mark"), F.col(text_col).alias("text")
    )
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    kinds = cut_lineage(
        forms(chosen, size, similarity).groupBy("form").agg(
            F.min(row).alias("first"), F.first("n").alias("n"), F.first("prefix").alias("prefix")
        )
    )
    edges = similar_pairs(kinds, chosen, size, similarity, bucket)
    if radius is not None:
        edges = edges.union(fingerprint_links(chosen, kinds, fp_size, radius)).distinct()
    found = components(edges)
    named = kinds.join(found, F.col("form") == F.col("node"), "left").select(F.coalesce("root", "form").alias("root"), "first")
    return _only(docs, named.groupBy("root").agg(F.min("first").alias("least")), id_col, text_col)
