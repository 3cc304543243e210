"""Removal of every byte covered by a LENGTH-byte string that starts anywhere else too.

Any LENGTH-byte string holds LENGTH - GRAM + 1 grams of GRAM bytes; its anchor is the leftmost of
its least-hashed grams. Equal strings have equal anchors at equal offsets, so only places with an
anchor gram that occurs elsewhere need a look. A place's context is all that strings anchored there
can reach: `left` bytes before and `right` bytes from the gram's start, cut at the text's ends.

1. Anchor grams are counted over all texts. A Bloom filter of bounded size keeps the places whose
   gram may repeat.
2. Places are grouped by gram. If all contexts of a gram are equal, or a context occurs twice, all
   strings in it are repeated and it is covered as a whole.
3. The other contexts are fetched once for each distinct context and dealt by gram into blocks of
   bounded size. A block's contexts are suffix-sorted from the gram rightward and, reversed, leftward
   (suffix_sort: prefix polynomial hashes, binary search, mergesort). The neighbours in both orders
   give the farthest reach to either side; the two outermost strings are looked up among the gram's
   contexts and compared byte for byte. Only where one of them isn't repeated are the strings
   between looked up one by one.
4. A gram with over GROUP distinct contexts isn't collected anywhere. Its strings are split by their
   offset into halves, and the contexts by the bytes that all strings of a half share: groups of up
   to GROUP go to step 3 for their half, a context whose bytes for the half occur twice is covered
   there (compared byte for byte, by group-bys with map-side combining) and one of its kind goes on,
   and what is still crowded is halved again, down to single strings.
5. Covered spans are united for each distinct text; only texts with a span are shuffled to them.

Texts are told apart by a 128-bit hash. No group, however hot, meets in one task.

Rows: null text is empty; texts under LENGTH bytes can't be covered. Identical texts cover each
other; repeated ids don't matter, as spans go by text. An empty table gives an empty result. Only
named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bloom, discard, materialize, maybe, slices
from tidemark.llm.suffix_sort import Text, merge_sort

LENGTH = 400
GRAM = 128
#: Contexts of one gram that one task may hold.
GROUP = 4096
#: Grams with more contexts than that whose list is broadcast (8 bytes each); beyond, they are joined by shuffle.
CROWDED = 50_000
#: Bytes of contexts sorted at once.
BLOCK = 4 << 20
#: Bytes of texts scanned at once.
SLICE = 64 << 10
#: Bytes of texts moved at once when spans are cut.
MOVED = 1 << 20
#: Bits of an anchor key that hold the place; the others hold the gram's hash.
_PLACE_BITS = np.uint64(25)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each full window of width values, by doubling."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:]) if len(values) > done else values[:0]
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(raws: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place in it, gram hash) of the anchors of all length-byte strings, in order."""
    size = np.array([len(r) for r in raws], np.int64)
    start = np.concatenate([[0], np.cumsum(size)])[:-1].astype(np.int64)
    joined = b"".join(raws)
    n = len(joined)
    if n < length or not (size >= length).any():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    if n >> int(_PLACE_BITS) and len(raws) == 1:
        half = n // 2
        a, b = anchors([joined[: half + length - 1]], length, gram), anchors([joined[half:]], length, gram)
        at, first = np.unique(np.concatenate([a[1], b[1] + half]), return_index=True)
        return np.zeros(len(at), np.int64), at, np.concatenate([a[2], b[2]])[first]
    if n >> int(_PLACE_BITS):
        half = len(raws) // 2
        a, b = anchors(raws[:half], length, gram), anchors(raws[half:], length, gram)
        return np.concatenate([a[0], b[0] + half]), np.concatenate([a[1], b[1]]), np.concatenate([a[2], b[2]])
    grams = _mix(Text(joined).hashes(np.arange(n - gram + 1), gram))
    width = length - gram + 1
    keys = (grams >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    least = _sliding_minimum(keys, width)  # of the grams of each string
    inside = np.zeros(n + 1, np.int64)
    whole = size >= length
    np.add.at(inside, start[whole], 1)
    np.add.at(inside, (start + size - length + 1)[whole], -1)
    chosen = least[np.flatnonzero(np.cumsum(inside)[: len(least)] > 0)]
    at = (chosen & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    text = np.searchsorted(start, at, "right") - 1
    # texts without bytes share a start; the last of them is the one with bytes
    return text, at - start[text], grams[at]


def _scan(length: int, gram: int, kind: str, found: np.ndarray | None):
    """mapInArrow over (text): anchor grams, places (found: whose gram may be in it) or contexts."""
    reach = length - gram

    def run(batches):
        for whole in batches:
            for batch in slices(whole, SLICE):
                raws = [b"" if t is None else t.encode() for t in batch.column(0).to_pylist()]
                text, at, grams = anchors(raws, length, gram)
                if found is not None:
                    keep = maybe(found, grams)
                    text, at, grams = text[keep], at[keep], grams[keep]
                signed = pa.array(grams.view(np.int64), pa.int64())
                if kind == "grams":
                    yield pa.RecordBatch.from_arrays([signed], names=["gram"])
                    continue
                size = np.array([len(r) for r in raws], np.int64)
                left, right = np.minimum(at, reach), np.minimum(size[text] - at, length)
                own = [raws[t][p - a : p + b] for t, p, a, b in zip(text.tolist(), at.tolist(), left.tolist(), right.tolist(), strict=True)]
                context = pa.array([_context_hash(x, a) for x, a in zip(own, left.tolist(), strict=True)], pa.int64())
                columns, names = [signed, context, pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))], ["gram", "context", "left", "right"]
                if kind == "contexts":
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(own, pa.binary())], names=[*names, "bytes"])
                    continue
                keys = {t: text_key(raws[t]) for t in np.unique(text).tolist()}
                k1, k2 = (pa.array([keys[t][k] for t in text.tolist()], pa.int64()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([*columns, k1, k2, pa.array(at.astype(np.int32))], names=[*names, "k1", "k2", "at"])

    return run


def text_key(raw: bytes) -> tuple[int, int]:
    """128-bit hash as two signed integers."""
    whole = xxhash.xxh3_128_digest(raw)
    return int.from_bytes(whole[:8], "little", signed=True), int.from_bytes(whole[8:], "little", signed=True)


def _context_hash(raw: bytes, left: int) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(raw, seed=left), "little", signed=True)


def _covered(gram: np.ndarray, left: np.ndarray, right: np.ndarray, raws: list[bytes], lone: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How far left and right of its gram each context is covered (-1, -1: not at all).

    Contexts come gram by gram; lone says which occur once. gram holds numbers that don't decrease.
    """
    n = len(raws)
    size = left + right
    joined = b"".join(raws)
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    text = Text(joined)
    order, common = merge_sort(text, start + left, right, gram)
    far_right = np.zeros(n, np.int64)
    np.maximum.at(far_right, order, common)
    np.maximum.at(far_right, order[:-1], common[1:])
    turned = Text(joined[::-1])
    order, common = merge_sort(turned, len(joined) - start - left, left, gram)
    far_left = np.zeros(n, np.int64)
    np.maximum.at(far_left, order, common)
    np.maximum.at(far_left, order[:-1], common[1:])

    begin = np.searchsorted(gram, gram, "left")
    end = np.searchsorted(gram, gram, "right")

    def repeated(who: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """Whether the string that starts offset bytes before who's gram is also in another context of the gram."""
        asked, back = np.unique(np.stack([begin[who], offset], 1), axis=0, return_inverse=True)
        count = (end[asked[:, 0]] - asked[:, 0]).astype(np.int64)
        ask = np.repeat(np.arange(len(asked)), count)
        member = asked[ask, 0] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        off = asked[ask, 1]
        fits = (left[member] >= off) & (right[member] >= length - off)
        ask, member, off = ask[fits], member[fits], off[fits]
        at = start[member] + left[member] - off
        hashes = text.hashes(at, length)
        by = np.lexsort((hashes, ask))
        ask, member, at, hashes = ask[by], member[by], at[by], hashes[by]
        fresh = np.concatenate([[True], (ask[1:] != ask[:-1]) | (hashes[1:] != hashes[:-1])])
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(ask)), 0)) if len(ask) else np.empty(0, np.int64)
        hits: set[tuple[int, int]] = set()
        edges = np.append(np.flatnonzero(fresh), len(ask)) if len(ask) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            same = text.same(at[first[a:b]], at[a:b], np.full(b - a, length))
            if same.all():
                hit = range(a, b)
            else:  # a hash collision: compare the bytes themselves
                seen: dict[bytes, list[int]] = {}
                for k in range(a, b):
                    seen.setdefault(joined[at[k] : at[k] + length], []).append(k)
                hit = [k for ks in seen.values() if len(ks) > 1 for k in ks]
            hits.update((int(ask[k]), int(member[k])) for k in hit)
        return np.array([pair in hits for pair in zip(back.ravel().tolist(), who.tolist(), strict=True)], bool)

    low, high = np.maximum(length - far_right, 0), far_left  # offsets of strings that may repeat
    out_left, out_right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    ask = np.flatnonzero(lone & (low <= high))
    if not len(ask):
        return out_left, out_right
    # the two outermost strings of each; below, every string between, where one of them isn't repeated
    ends = repeated(np.concatenate([ask, ask]), np.concatenate([high[ask], low[ask]]))
    up, down = ends[: len(ask)], ends[len(ask) :]
    out_left[ask[up]] = high[ask[up]]
    out_right[ask[down]] = length - low[ask[down]]
    rest = ask[~(up & down)]
    if len(rest):
        count = high[rest] - low[rest] + 1
        who = np.repeat(rest, count)
        offset = low[who] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        hit = repeated(who, offset)
        np.maximum.at(out_left, who[hit], offset[hit])
        np.maximum.at(out_right, who[hit], length - offset[hit])
    return out_left, out_right


def _blocks(length: int):
    """mapInArrow over contexts in order of part and context: sorts blocks of whole parts.

    A part is a gram, or what shares more bytes around a crowded one. home is the context's own left reach.
    """
    columns = ("part", "gram", "context", "home", "left", "right", "bytes")

    def solve(rows: dict[str, list]) -> pa.RecordBatch:
        parts = np.array(rows["part"], np.int64)
        numbers = np.cumsum(np.concatenate([[0], parts[1:] != parts[:-1]]))
        left, right = (np.array(rows[c], np.int64) for c in ("left", "right"))
        lone = np.array(rows["n"]) == 1
        a, b = _covered(numbers, left, right, rows["bytes"], lone, length)
        a, b = np.where(lone, a, left), np.where(lone, b, right)
        pick = np.flatnonzero(a >= 0)
        own = [pa.array(np.array(rows[c], np.int64)[pick]) for c in ("gram", "context")]
        reach = [pa.array(x[pick].astype(np.int32)) for x in (np.array(rows["home"], np.int64), a, b)]
        return pa.RecordBatch.from_arrays([*own, *reach], names=["gram", "context", "left", "cover_left", "cover_right"])

    def run(batches):
        done: dict[str, list] = {c: [] for c in (*columns, "n")}  # whole parts, and at the end the one that is coming in
        size = 0
        for whole in batches:
            for batch in slices(whole, BLOCK):
                for row in zip(*[batch.column(c).to_pylist() for c in columns], strict=True):
                    fresh = not done["part"] or done["part"][-1] != row[0]
                    if fresh and size >= BLOCK:
                        yield solve(done)
                        done, size = {c: [] for c in done}, 0
                    if not fresh and (done["context"][-1], done["home"][-1], done["bytes"][-1]) == (row[2], row[3], row[6]):
                        done["n"][-1] += 1
                        continue
                    size += len(row[6])
                    for c, x in zip((*columns, "n"), (*row, 1), strict=True):
                        done[c].append(x)
        if done["part"]:
            yield solve(done)

    return run


_SOLVED = "gram long, context long, left int, cover_left int, cover_right int"


def _sorted_blocks(contexts: DataFrame, length: int) -> DataFrame:
    """Coverage of contexts by the suffix sort; no part has more than a group of distinct contexts."""
    chosen = contexts.select("part", "gram", "context", "home", "left", "right", "bytes")
    return chosen.repartition("part").sortWithinPartitions("part", "context", "home").mapInArrow(_blocks(length), _SOLVED)


def _halved(rows: DataFrame, length: int) -> DataFrame:
    """rows (of offsets low to high) for either half of their offsets, with the bytes that matter there.

    core1 and core2 hash what all strings of the half share. left and right are cut to the strings of
    the half that the context holds; contexts with none go.
    """
    middle = F.shiftright(F.col("low") + F.col("high"), 1)
    halves = F.array(F.struct(F.col("low").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("high").alias("b")))
    return (
        rows.select("gram", "context", "home", "left", "right", "bytes", F.inline(F.filter(halves, lambda x: x.a <= x.b)))
        .withColumn("to", F.least("b", "left"))
        .withColumn("from", F.greatest("a", F.lit(length) - F.col("right")))
        .where("from <= to")
        .withColumn("core", F.expr(f"substring(bytes, left - a + 1, {length} - b + a)"))
        .withColumn("span", F.expr(f"substring(bytes, left - to + 1, {length} - from + to)"))
        .select(
            "gram", "context", "home", F.col("a").alias("low"), F.col("b").alias("high"), F.col("to").alias("left"), (F.lit(length) - F.col("from")).alias("right"), F.col("span").alias("bytes"),
            F.xxhash64("core", F.lit(1)).alias("core1"), F.xxhash64("core", F.lit(2)).alias("core2"), F.xxhash64("span", F.lit(3)).alias("span1"), F.xxhash64("span", F.lit(4)).alias("span2"),
        )
    )


def _narrowed(hot: DataFrame, length: int, reach: int, group: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Coverage of the distinct contexts of crowded grams by halving their offsets, and the written tables it reads."""
    core = ["gram", "low", "high", "core1", "core2"]
    span = [*core, "left", "right", "span1", "span2"]
    rows = hot.select("gram", "context", F.col("left").alias("home"), "left", "right", "bytes", F.lit(0).alias("low"), F.lit(reach).alias("high"))
    covers, written = [], []
    while not rows.isEmpty():
        cuts = _halved(rows, length)
        kinds = cuts.groupBy(*span).agg(F.count(F.lit(1)).alias("same"), F.min(F.struct("context", "home")).alias("first"), (F.min("bytes") == F.max("bytes")).alias("equal"))
        kinds = materialize(kinds, "kinds")
        groups = kinds.groupBy(*core).agg(F.sum("same").alias("n"), F.sum(F.when(F.col("equal"), 1).otherwise(F.col("same"))).alias("size")).where("n > 1")
        # one context of each kind goes on, or all of them where hashes agree but bytes do not
        goes = (F.col("size") > 1) & (~F.col("equal") | (F.struct("context", "home") == F.col("first")))
        known = cuts.join(kinds, span).join(groups, core).withColumn("goes", goes)
        known = known.select(*core, "context", "home", "left", "right", "size", "goes", F.expr("same > 1 and equal").alias("whole"), F.when(F.col("goes"), F.col("bytes")).alias("bytes"))
        known = materialize(known, "halves")
        discard(kinds)
        written.append(known)
        covers.append(known.where("whole").select("gram", "context", F.col("home").alias("left"), F.col("left").alias("cover_left"), F.col("right").alias("cover_right")))
        few = known.where(f"goes and size <= {group}").withColumn("part", F.xxhash64(*core))
        covers.append(_sorted_blocks(few, length))
        rows = known.where(f"goes and size > {group}").where("if(low < high, true, raise_error('strings that differ share 256 bits of hashes'))")
    return covers, written


def spans(docs: DataFrame, text_column: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(k1, k2, spans array of [first, last) byte): covered bytes of each distinct text that has any."""
    texts = docs.select(text_column)
    counts = texts.mapInArrow(_scan(length, gram, "grams", None), "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    repeated = materialize(counts.where("n > 1").select("gram"), "repeated")
    schema = "gram long, context long, left int, right int"
    places = materialize(texts.mapInArrow(_scan(length, gram, "places", bloom(repeated, "gram")), f"{schema}, k1 long, k2 long, at int"), "places")
    discard(repeated)

    grams = places.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("least"), F.max("context").alias("most")).where("n > 1")
    grams = materialize(grams.select("gram", "n", (F.col("least") != F.col("most")).alias("open")), "grams")
    open_grams = grams.where("open")
    fetched = materialize(texts.mapInArrow(_scan(length, gram, "contexts", bloom(open_grams, "gram")), f"{schema}, bytes binary"), "contexts")
    crowded = grams.where(f"n > {group}").select("gram")
    # the filter lets some other grams through, which do no harm if none of them is crowded
    warm = open_grams.where(f"n > {group}").select("gram")
    if crowded.count() <= CROWDED:
        cold, warm = fetched.join(F.broadcast(crowded), "gram", "left_anti"), F.broadcast(warm)
    else:
        cold = fetched.join(open_grams.where(f"n <= {group}").select("gram"), "gram", "left_semi")

    covered = _sorted_blocks(cold.withColumn("part", F.col("gram")).withColumn("home", F.col("left")), length)
    hot = fetched.join(warm, "gram", "left_semi").groupBy("gram", "context", "left", "right", "bytes").agg(F.count(F.lit(1)).alias("n"))
    hot = materialize(hot, "hot")
    twice = hot.where("n > 1").select("gram", "context", "left", F.col("left").alias("cover_left"), F.col("right").alias("cover_right"))
    narrowed, written = _narrowed(hot, length, length - gram, group)
    covers = covered.unionByName(twice)
    for found in narrowed:
        covers = covers.unionByName(found)
    covers = covers.groupBy("gram", "context", "left").agg(F.max("cover_left").alias("cover_left"), F.max("cover_right").alias("cover_right"))
    covers = materialize(covers, "covers")
    discard(fetched, hot, *written)

    closed = places.join(grams.where("not open").select("gram"), "gram", "left_semi").select("k1", "k2", (F.col("at") - F.col("left")).alias("first"), (F.col("at") + F.col("right")).alias("last"))
    opened = places.join(covers, ["gram", "context", "left"]).select("k1", "k2", (F.col("at") - F.col("cover_left")).alias("first"), (F.col("at") + F.col("cover_right")).alias("last"))
    found = closed.unionByName(opened).groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))
    found = materialize(found.select("k1", "k2", F.expr(_MERGE).alias("spans")), "spans")
    discard(places, grams, covers)
    return found


_MERGE = """aggregate(spans, cast(array() as array<struct<first:int,last:int>>), (acc, s) ->
  case when size(acc) > 0 and element_at(acc, -1).last >= s.first
       then concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first, 'last', greatest(element_at(acc, -1).last, s.last))))
       else concat(acc, array(s)) end)"""


def _kept(raw: bytes, covered: list[dict]) -> bytes:
    out, at = [], 0
    for s in covered:
        out.append(raw[at : s["first"]])
        at = s["last"]
    return b"".join([*out, raw[at:]])


def remove(docs: DataFrame, found: DataFrame, text_column: str = "text", as_text: bool = False) -> DataFrame:
    """docs with _rb_kept (remaining bytes, or with as_text their text), _rb_bytes and _rb_spans; text_column is dropped.

    Texts without a span stay where they are; the others meet their spans by the text's hash.
    """
    names = [c for c in docs.columns if c != text_column]
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)
    filter_ = bloom(found, "k1")
    count = len(names)
    kind, arrow = ("string", pa.string()) if as_text else ("binary", pa.binary())

    def keyed(batches):
        for whole in batches:
            for batch in slices(whole, MOVED):
                raws = [b"" if t is None else t.encode() for t in batch.column(count).to_pylist()]
                keys = [text_key(r) for r in raws]
                k1, k2 = (np.array([k[j] for k in keys], np.int64) for j in (0, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:count], pa.array(raws, pa.binary()), pa.array(k1), pa.array(k2), pa.array(maybe(filter_, k1))], names=[*names, "_rb_raw", "k1", "k2", "_rb_maybe"])

    def cut(batches):
        for whole in batches:
            for batch in slices(whole, MOVED):
                raws = batch.column(count).to_pylist()
                kept = [_kept(raw, covered or []) for raw, covered in zip(raws, batch.column(count + 1).to_pylist(), strict=True)]
                kept = [k.decode("utf-8", "ignore") for k in kept] if as_text else kept
                size = pa.array([len(r) for r in raws], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:count], pa.array(kept, arrow), size, batch.column(count + 1)], names=[*names, "_rb_kept", "_rb_bytes", "_rb_spans"])

    rows = docs.select(*names, text_column).mapInArrow(keyed, f"{fields}_rb_raw binary, k1 long, k2 long, _rb_maybe boolean")
    none = F.lit(None).cast("array<struct<first:int,last:int>>")
    kept = F.decode("_rb_raw", "utf-8") if as_text else F.col("_rb_raw")
    clean = rows.where("not _rb_maybe").select(*names, kept.alias("_rb_kept"), F.octet_length("_rb_raw").cast("long").alias("_rb_bytes"), none.alias("_rb_spans"))
    # spans grow with the texts, so they are never broadcast
    touched = rows.where("_rb_maybe").join(found.hint("merge"), ["k1", "k2"], "left").select(*names, "_rb_raw", "spans")
    return clean.unionByName(touched.mapInArrow(cut, f"{fields}_rb_kept {kind}, _rb_bytes long, _rb_spans array<struct<first:int,last:int>>"))


def digest(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **sizes: int) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256)"""
    chosen = docs.select(id_column, text_column)
    cut = remove(chosen, spans(docs, text_column, **sizes), text_column)
    return cut.select(
        id_column,
        F.col("_rb_bytes").alias("n_bytes"),
        (F.col("_rb_bytes") - F.octet_length("_rb_kept")).alias("n_removed"),
        F.coalesce(F.size("_rb_spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.sha2("_rb_kept", 256).alias("kept_sha256"),
    )


def cut_text(docs: DataFrame, text_column: str = "text", **sizes: int) -> DataFrame:
    """docs with the covered bytes cut from the text (null text stays null).

    A character that loses one of its bytes goes as a whole.
    """
    marked = docs.withColumn("_rb_null", F.col(text_column).isNull())
    cut = remove(marked, spans(docs, text_column, **sizes), text_column, as_text=True)
    text = F.when(~F.col("_rb_null"), F.col("_rb_kept")).alias(text_column)
    return cut.select(*[text if c == text_column else F.col(c) for c in docs.columns])


def brute_force(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) by looking at every string; for tests."""
    raws = [b"" if t is None else t.encode() for t in texts]
    seen: dict[bytes, int] = {}
    for raw in raws:
        for k in range(len(raw) - length + 1):
            seen[raw[k : k + length]] = seen.get(raw[k : k + length], 0) + 1
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(raw), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return out
