"""Near-duplicates: a multi-index Hamming join over b-bit MinHash signatures, confirmed on full sets.

A text's set holds its distinct five-word shingles.  Texts with equal sets form one
class, so copies never meet as pairs.  A class has a signature of 32 values of 16 bits.
It is split into 8 chunks of 4 values; two signatures that differ in at most 15 values
have, by pigeonhole, a chunk with at most one difference, and all such chunks are
found by enumerating the four ways to leave one value of a chunk out.  Every pair under
the distance threshold therefore meets under one of 32 keys.  (A pair of similarity 0.75
exceeds 15 differences with probability 0.2 %; it still meets under a key unless
all 8 chunks have two differences, which has probability 2e-5.)

Within a key all members are checked against its most central class, which also tells how
each departs from it.  Links give components.  Where a key's members are in several
components, the most central member outside the largest one leads next, as long as such rounds
bring components together; each round is linear.  What is then left across components is
checked too, every pair once, under the first key it shares and only if the departures from the
leader do not prove it too far apart.  A join tests pairs one by one, so members of keys of more
than ``WIDE`` classes meet in blocks instead: those of one leader once, however many keys they share,
a block of ``BLOCK`` against another at a time in numpy.  So no link that could join components is lost, whatever
a group's size, and rounds only save work.  Links are confirmed on full sets: hashes first, then
the words of every common shingle as bytes.

Defined cases: null or empty texts, and texts of spaces, have an empty set and are
linked with nothing; fewer than five words are one shingle; a row without id is linked
with nothing and has no component; rows that repeat an id are one vertex; texts of any
length are hashed whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import renamed, table
from tessera.llm.components import connected_components
from tessera.llm.textkernel import SHINGLE, buffers, fmix, shingle_hashes, shingles, text_groups, words
from tessera.plans.scratch import discard, materialize

CHUNKS, PER_CHUNK, BITS = 8, 4, 16
#: Least similarity in hundredths.
PERCENT = 75
#: Members of larger keys meet in blocks of so many.
WIDE, BLOCK = 32, 1024
#: A further round of leaders must have closed this share of what was open.
GAIN = 1 / 8

_rng = np.random.Generator(np.random.PCG64(4))
_A = _rng.integers(1, 2**63, CHUNKS * PER_CHUNK, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(1, 2**63, CHUNKS * PER_CHUNK, dtype=np.uint64)
_SIG = [f"s{i}" for i in range(CHUNKS)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, CHUNKS) of int64: each holds PER_CHUNK values of BITS bits.  Sets must not be empty."""
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    x = np.concatenate(sets)
    out = np.zeros((len(sets), CHUNKS), dtype=np.uint64)
    for k in range(CHUNKS * PER_CHUNK):
        low = np.minimum.reduceat((x ^ _B[k]) * _A[k], first)
        out[:, k // PER_CHUNK] |= (fmix(low) & np.uint64((1 << BITS) - 1)) << np.uint64(BITS * (k % PER_CHUNK))
    return out.view(np.int64)


def sets_of(raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    h, first = words(raw, at)
    return [shingles(h[first[i] : first[i + 1]]) for i in range(len(at) - 1)]


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, h1, h2, s0..s7): set size, a 128-bit sum over the set, the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, raw = buffers(batch.column(1))
            rows = batch.num_rows
            n, h1, h2, sig = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64), np.zeros((rows, CHUNKS), np.int64)
            for i, j in text_groups(at):
                sets = sets_of(raw, at[i : j + 1])
                n[i:j] = [len(s) for s in sets]
                full = [k for k in range(j - i) if len(sets[k])]
                for k in full:
                    h1[i + k] = fmix(sets[k] ^ _A[0]).sum(dtype=np.uint64)
                    h2[i + k] = fmix(sets[k] ^ _A[1]).sum(dtype=np.uint64)
                if full:
                    sig[[i + k for k in full]] = signatures([sets[k] for k in full])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), *(pa.array(np.ascontiguousarray(sig[:, c])) for c in range(CHUNKS))],
                names=["id", "n", "h1", "h2", *_SIG],
            )

    kind = dict(docs.dtypes)[id_col]
    return renamed(docs, id=id_col, text=text_col).mapInArrow(run, f"id {kind}, n long, h1 long, h2 long, " + ", ".join(f"{s} long" for s in _SIG))


def _lane(v: int, others: bool = False) -> Column:
    """Mask of value ``v`` of a chunk, or of all others."""
    mask = ((1 << BITS) - 1) << (BITS * v)
    mask = ((1 << 64) - 1) ^ mask if others else mask
    return F.lit(mask - (1 << 64) if mask >> 63 else mask)


def keys() -> Column:
    """All keys of a signature: each chunk with one of its values left out."""
    return F.array(*(F.xxhash64(F.lit(c * PER_CHUNK + v), F.col(_SIG[c]).bitwiseAND(_lane(v, True))) for c in range(CHUNKS) for v in range(PER_CHUNK)))


def first_shared(u: str, v: str, at: str) -> Column:
    """Whether two signatures share no key before key number ``at``."""
    out = F.lit(True)
    for c in range(CHUNKS):
        x = F.col(f"{u}.{_SIG[c]}").bitwiseXOR(F.col(f"{v}.{_SIG[c]}"))
        apart = reduce(lambda p, q: p + q, ((x.bitwiseAND(_lane(k)) != 0).cast("int") for k in range(PER_CHUNK))) >= 2
        out &= (F.col(at) < (c + 1) * PER_CHUNK) | apart  # no key of a chunk gone by
        for k in range(PER_CHUNK - 1):  # nor an earlier one of this chunk
            out &= ~F.col(at).between(c * PER_CHUNK + k + 1, (c + 1) * PER_CHUNK - 1) | (x.bitwiseAND(_lane(k, True)) != 0)
    return out


#: Bitmaps, as 64-bit words, of what a text lacks of its leader's set (gone) and has besides (new).
_MAP = 8
_GONE, _NEW = [[f"{name}{i}" for i in range(_MAP)] for name in ("gone", "new")]


def bitmap(x: np.ndarray) -> np.ndarray:
    at = (x >> np.uint64(55)).astype(np.int64)
    out = np.zeros(_MAP, np.uint64)
    np.bitwise_or.at(out, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return out.view(np.int64)


def texts_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, text) of the documents in ``pairs``."""
    need = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    return materialize(docs.join(need.hint("merge"), "id", "left_semi"), "near-texts")


def same_words(a: bytes, b: bytes, ha: np.ndarray, hb: np.ndarray) -> bool:
    """Whether shingles of equal hash (``ha`` and ``hb`` in text order) have equal words."""
    wa, wb = a.lower().split(), b.lower().split()  # bytes: only A-Z change, and only 0x20 and 0x09-0x0D part
    (ua, ia), (ub, ib) = np.unique(ha, return_index=True), np.unique(hb, return_index=True)
    _, x, y = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    return all(wa[i : i + SHINGLE] == wb[j : j + SHINGLE] for i, j in zip(ia[x].tolist(), ib[y].tolist(), strict=True))


def compared(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, link, na, nb, n_new, gone, new) of each pair: whether the full sets are similar enough, and how b's set departs from a's."""
    both = pairs.hint("merge").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    both = both.hint("merge").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def hashed(raw: np.ndarray) -> np.ndarray:
        return shingle_hashes(words(raw, np.array([0, len(raw)]))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            (at_a, raw_a), (at_b, raw_b) = buffers(batch.column(2)), buffers(batch.column(3))
            ids = batch.column(0).to_pylist()
            counts, bits = np.zeros((batch.num_rows, 4), np.int64), np.zeros((batch.num_rows, 2 * _MAP), np.int64)
            for i in range(batch.num_rows):
                if held is None or ids[i] != last or not np.array_equal(held[0], raw_a[at_a[i] : at_a[i + 1]]):
                    part = raw_a[at_a[i] : at_a[i + 1]].copy()
                    whole = hashed(part)
                    last, held = ids[i], (part, whole, np.unique(whole))
                ha, sa = held[1:]
                hb = hashed(raw_b[at_b[i] : at_b[i + 1]])
                sb = np.unique(hb)
                new = np.setdiff1d(sb, sa, assume_unique=True)
                common = len(sb) - len(new)
                link = common > 0 and 100 * common >= PERCENT * (len(sa) + len(sb) - common)
                link = link and same_words(held[0].tobytes(), raw_b[at_b[i] : at_b[i + 1]].tobytes(), ha, hb)
                counts[i] = link, len(sa), len(sb), len(new)
                bits[i, :_MAP], bits[i, _MAP:] = bitmap(np.setdiff1d(sa, sb, assume_unique=True)), bitmap(new)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts[:, 0] > 0), *(pa.array(np.ascontiguousarray(counts[:, c])) for c in (1, 2, 3)), *(pa.array(np.ascontiguousarray(bits[:, c])) for c in range(2 * _MAP))],
                names=["a", "b", "link", "na", "nb", "n_new", *_GONE, *_NEW],
            )

    kind = dict(texts.dtypes)["id"]
    return both.mapInArrow(run, f"a {kind}, b {kind}, link boolean, na long, nb long, n_new long, " + ", ".join(f"{x} long" for x in _GONE + _NEW))


def may_link(u: str, v: str) -> Column:
    """Whether two texts with the same leader can be similar enough, from how they depart from it.

    Their common part is the leader's set less what either lacks, plus what both have besides.  The
    union of two bitmaps never counts more than is lacking, and common bits, with what shares a bit of
    its own bitmap, never count less than is had in common; so no similar pair is refused.
    """
    bits = lambda x: reduce(lambda p, q: p + q, [F.bit_count(w) for w in x])
    c = lambda side, name: F.col(f"{side}.{name}")
    lacking = bits([c(u, g).bitwiseOR(c(v, g)) for g in _GONE])
    besides = bits([c(u, w).bitwiseAND(c(v, w)) for w in _NEW])
    hidden = F.least(*(c(s, "n_new") - bits([c(s, w) for w in _NEW]) for s in (u, v)))
    common = F.least(c(u, "na") - lacking + besides + hidden, c(u, "nb"), c(v, "nb"))
    return (100 + PERCENT) * common >= PERCENT * (c(u, "nb") + c(v, "nb"))


def unrefused(u: pa.StructArray, v: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of two blocks of one leader that differ in component and that ``may_link`` does not refuse."""
    column = lambda side, name: side.field(name).to_numpy(zero_copy_only=False)
    maps = lambda side, names: np.stack([column(side, x).view(np.uint64) for x in names])
    bits = lambda x: np.bitwise_count(x).sum(axis=0, dtype=np.int64)
    both = pa.concat_arrays([u.field("comp"), v.field("comp")]).dictionary_encode().indices.to_numpy()
    cu, cv = both[: len(u)], both[len(u) :]
    (gu, wu), (gv, wv) = ((maps(x, _GONE), maps(x, _NEW)) for x in (u, v))
    hu, hv = column(u, "n_new") - bits(wu), column(v, "n_new") - bits(wv)
    lack_u, lack_v = column(u, "na") - bits(gu), bits(gv)
    nu, nv = column(u, "nb"), column(v, "nb")
    out = []
    for i in range(0, len(u), 64):
        part = slice(i, i + 64)
        shared = np.zeros((len(nu[part]), len(v)), np.int64)  # bits that both lack or have besides
        for x, y in [*zip(gu, gv, strict=True), *zip(wu, wv, strict=True)]:
            shared += np.bitwise_count(x[part, None] & y)
        common = lack_u[part, None] - lack_v + shared + np.minimum(hu[part, None], hv)
        common = np.minimum(common, np.minimum(nu[part, None], nv))
        a, b = np.nonzero(((100 + PERCENT) * common >= PERCENT * (nu[part, None] + nv)) & (cu[part, None] != cv))
        out.append((a + i, b))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def block_pairs(members: DataFrame) -> DataFrame:
    """(a, b) of ``members`` (key, cid, comp, major and the departures from the key's leader) that may link across components."""
    minor = F.col("comp") != F.col("major")
    rows = members.select("key", minor.alias("minor"), "cid", F.struct("cid", "comp", "na", "nb", "n_new", *_GONE, *_NEW).alias("row"))
    number = rows.groupBy("key", "minor").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    number = rows.join(number, ["key", "minor"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    blocks = materialize(number.groupBy("key", "minor", "block").agg(F.collect_list("row").alias("rows")), "near-blocks")
    u, v = (blocks.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("minor", "block"))) for side in "uv")
    meet = u.where("minor_u").join(v, "key").where("NOT minor_v OR block_u <= block_v")
    for side in "uv":  # all blocks of a key in one task would be its pairs in one task
        of = blocks.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("minor", "block", "rows")))
        meet = meet.hint("merge").join(of, ["key", f"minor_{side}", f"block_{side}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one, two = (batch.column(c)[i].values for c in (0, 1))
                a, b = unrefused(one, two)
                yield pa.RecordBatch.from_arrays([one.field("cid").take(pa.array(a)), two.field("cid").take(pa.array(b))], names=["a", "b"])

    kind = dict(members.dtypes)["cid"]
    out = meet.select("rows_u", "rows_v").mapInArrow(run, f"a {kind}, b {kind}")
    out = materialize(out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "near-block-pairs")
    discard(blocks)
    return out


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, component) after ``links`` have joined components; only components are walked."""
    of = lambda side: labels.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
    if links.isEmpty():
        return labels
    edges = links.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    up = connected_components(edges).withColumnRenamed("id", "was").withColumnRenamed("component", "now")
    out = labels.join(up, labels.component == F.col("was"), "left").select("id", F.coalesce("now", "component").alias("component"))
    return materialize(out, "near-labels")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``."""
    rows = renamed(docs, id=id_col, text=text_col)
    sketch = materialize(sketches(docs, id_col, text_col), "near-sketches")
    classes = sketch.where("n > 0 AND id IS NOT NULL").groupBy("n", "h1", "h2").agg(F.min("id").alias("cid"), *(F.min(s).alias(s) for s in _SIG))
    classes = materialize(classes, "near-classes")
    keyed = materialize(classes.select("cid", F.posexplode(keys()).alias("at", "key")), "near-keys")
    sizes = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "near-sizes")
    shared = materialize(keyed.join(sizes, "key"), "near-members")
    discard(keyed, sizes)
    # the class that shares most keys with most others leads: a text that others were made from, rather than one of them
    central = shared.groupBy("cid").agg((F.sum("m") + F.pmod(F.xxhash64("cid"), F.lit(1 << 20)) / F.lit(float(1 << 20))).alias("central"))
    central = materialize(central, "near-central")
    members = materialize(shared.join(central, "cid"), "near-ranked")
    discard(shared, central)
    leaders = materialize(members.groupBy("key").agg(F.max_by("cid", "central").alias("lead")), "near-leaders")
    star = members.join(leaders, "key").where("cid <> lead")
    star = materialize(star.select(F.col("lead").alias("a"), F.col("cid").alias("b")).distinct(), "near-star")
    texts = texts_of(rows, star)  # all members of keys are in it, so it serves later pairs too
    hub = materialize(compared(texts, star), "near-hub")
    labels = members.select(F.col("cid").alias("id")).distinct().withColumn("component", F.col("id"))
    labels = _relabelled(materialize(labels, "near-labels"), hub.where("link").select("a", "b"))

    leads = leaders.select(F.col("lead").alias("cid")).distinct().join(classes.select("cid", "n"), "cid")
    own = leads.select(F.col("cid").alias("lead"), "cid", F.col("n").alias("na"), F.col("n").alias("nb"), *(F.lit(0).cast("long").alias(x) for x in ["n_new", *_GONE, *_NEW]))
    known = hub.drop("link").withColumnsRenamed({"a": "lead", "b": "cid"}).unionByName(own)  # a leader departs in nothing from itself
    known = materialize(known.join(classes.select("cid", *_SIG), "cid"), "near-known")
    tried = hub.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def majors(placed: DataFrame) -> DataFrame:
        """Keys that are not yet of one component, with their largest."""
        open_keys = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        share = placed.join(open_keys, "key", "left_semi").groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
        return materialize(share.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("major")), "near-major")

    def opened() -> DataFrame:
        """Members of keys that are not yet of one component, with the key's largest component and their departures from its leader.

        Of two members one leads, so they have been compared.
        """
        placed = materialize(members.where("m > 2").join(labels, members.cid == labels.id).select("key", "at", "m", "cid", "central", F.col("component").alias("comp")), "near-placed")
        major = majors(placed)
        found = placed.join(major, "key").join(leaders, "key")
        out = materialize(found.join(known, ["lead", "cid"]), "near-open")
        discard(placed, major)
        return out

    def wide() -> DataFrame:
        """Members of wide keys, once for each leader, as members of a key."""
        held = materialize(now.where(F.col("m") > WIDE).select(F.col("lead").alias("key"), "cid", "comp").distinct(), "near-wide")
        major = majors(held)
        out = materialize(held.join(major, "key").join(known.withColumnRenamed("lead", "key"), ["key", "cid"]), "near-wide-open")
        discard(held, major)
        return out

    def untried(pairs: DataFrame) -> DataFrame:
        return materialize(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "near-across")

    def across(u: DataFrame, v: DataFrame, *more: Column) -> DataFrame:
        """Pairs of different components that may link."""
        met = u.alias("u").join(v.alias("v"), reduce(lambda p, q: p & q, more, (F.col("u.key") == F.col("v.key")) & (F.col("u.comp") != F.col("v.comp")) & may_link("u", "v")))
        return met.select(F.least("u.cid", "v.cid").alias("a"), F.greatest("u.cid", "v.cid").alias("b"))

    now, last = opened(), None
    while True:
        minor = now.where("comp <> major")
        size = minor.count()
        if size == 0 or (last is not None and size > (1 - GAIN) * last):
            break
        last = size
        next_lead = minor.groupBy("key").agg(F.max_by("cid", "central").alias("cid"))
        pairs = untried(across(minor.join(materialize(next_lead, "near-next"), ["key", "cid"], "left_semi"), now))
        linked = materialize(compared(texts, pairs).select("a", "b", "link"), "near-round")
        tried = tried.unionByName(linked.select("a", "b"))
        labels = _relabelled(labels, linked.where("link").select("a", "b"))
        discard(now)
        now = opened()
    if size:
        # a pair shows up under the first key it shares, and from one side only
        once = ((F.col("v.comp") == F.col("u.major")) | (F.col("u.cid") < F.col("v.cid"))) & first_shared("u", "v", "u.at")
        narrow, large = now.where(F.col("m") <= WIDE), wide()
        pairs = untried(across(narrow.where("comp <> major"), narrow, once).unionByName(block_pairs(large)))
        discard(large)
        linked = materialize(compared(texts, pairs).where("link").select("a", "b"), "near-last")
        labels = _relabelled(labels, linked)

    home = classes.join(labels, classes.cid == labels.id, "left").select("n", "h1", "h2", F.coalesce("component", "cid").alias("comp"))
    home = materialize(home, "near-home")
    discard(classes, members, leaders, star, texts, hub, known, now)
    out = sketch.select("id", "n", "h1", "h2").join(home, ["n", "h1", "h2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words)
), sizes AS (
    SELECT doc_id, count(*) AS n, sum(hash(s)::HUGEINT) AS h FROM shingle GROUP BY doc_id
), class AS (
    SELECT n, h, min(doc_id) AS c FROM sizes GROUP BY n, h
), member AS (
    SELECT s.doc_id, c.c, s.n FROM sizes s JOIN class c USING (n, h)
), kept AS (
    SELECT s.doc_id, s.s, m.n FROM shingle s JOIN member m ON m.doc_id = s.doc_id AND m.c = s.doc_id
), link AS (
    SELECT x.doc_id AS a, y.doc_id AS b FROM kept x JOIN kept y ON x.s = y.s AND x.doc_id <> y.doc_id
    GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach(a, b) AS (
    SELECT c, c FROM class UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), component AS (
    SELECT a, min(b) AS component FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(m.n, 0)::BIGINT AS n_shingles, coalesce(k.component, d.doc_id) AS component_id, coalesce(k.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN member m USING (doc_id) LEFT JOIN component k ON k.a = m.c
"""
