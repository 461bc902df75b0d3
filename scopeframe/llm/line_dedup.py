"""Line dedup by a segment-partition edit join. DataFrame operations alone.

Lines are parted by line feeds; those of equal bytes are one distinct line, placed by its first document and line number. Two
distinct lines of LEAST bytes or more are near if their bytes are within EDITS edits. An indexed line is split into EDITS + 1
segments, one of which a near line must hold unchanged; a line probes the substrings of its own that may equal a segment of a
line of its length or up to EDITS less, by the multi-match-aware choice of starts. Candidates must have nearly the same letters and hold all but EDITS of PIECES finer segments near
their places, and what is left is verified by a banded bit-parallel automaton: of each number of edits, a word with a bit for each diagonal.

Keys that lines share are found by the counts of the index first, in rows by lines and keys. Only lines that share one have their
letters counted, and lines of a key become pairs only if the parities of those counts allow it.

A key that over HOT lines have in the index doesn't give pairs. All its lines are held against the earliest of them; those that
aren't near it are held against the lines that also have the same count of each letter in one of 2 EDITS + 1 shares of the
letters, as each near line has: in blocks by hash, pairs of which are verified inside a row. So a family of many variants of a
line takes time in proportion to it, lines that merely share a passage seldom meet, and no pairs become rows.

A line is dropped if it isn't the first of its copies, or is near an earlier line. So the decision on a line depends on earlier
lines only, and no chains are followed.

Defined results: a null or empty text is one empty line; empty and short lines are dropped only as exact copies; null ids come
last; different texts without an id, or under one id, are documents of their own, in the order of a hash; of rows that repeat an
id and a text, all but one hold copies only; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

EDITS, LEAST, PIECES = 2, 24, 8
#: Index rows of a key from which its lines go to blocks, and lines of a block.
HOT, BLOCK = 48, 64
#: Pairs are verified in so many tasks at most.
MOST_TASKS = 20_000
LETTERS = "etaoinsrhldcumfpgwybvkxjqz"


def lines_of(docs: DataFrame, row: Column) -> DataFrame:
    """h1 and h2 (128 bits of the line), first (its place in the order of lines: null ids last) and line (binary)."""
    rows = docs.select("doc_id", row.alias("_row"), F.split(F.coalesce("text", F.lit("")), "\n").alias("_l"))
    rows = rows.select("doc_id", "_row", F.posexplode("_l").alias("no", "_s")).withColumn("line", F.col("_s").cast("binary"))
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row", "no")
    return rows.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), place.alias("first"), "line")


def profile(line: Column) -> Column:
    """Counts of the letters, and of other characters."""

    def counted(text: Column) -> Column:
        counts = F.array(*(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in LETTERS))
        return let(counts, lambda x: F.concat(x, F.array(F.length(text) - F.aggregate(x, F.lit(0), lambda t, n: t + n))))

    return let(F.lower(line.cast("string")), counted)


def parities(counts: Column) -> Column:
    """The counts' last bits as one number."""
    bits = F.transform(counts, lambda x, i: F.call_function("shiftleft", x.bitwiseAND(F.lit(1)), i))
    return F.aggregate(bits, F.lit(0), lambda all_, x: all_.bitwiseOR(x))


def marked(line: Column, **others: Column) -> Column:
    """``others``, the line, its profile p and the parities sk of that."""
    return let(profile(line), lambda p: F.struct(*(c.alias(n) for n, c in others.items()), line.alias("line"), p.alias("p"), parities(p).alias("sk")))


def alike(a: Column, b: Column, edits: int) -> Column:
    """Whether two lines (p, sk) may be within ``edits``: an edit changes two counts by one at most."""
    apart = F.aggregate(F.zip_with(a["p"], b["p"], lambda x, y: F.abs(x - y)), F.lit(0), lambda t, x: t + x)
    return F.when(F.bit_count(a["sk"].bitwiseXOR(b["sk"])) <= 2 * edits, apart <= 2 * edits).otherwise(False)


def cut(n: Column, k: Column | int, parts: int) -> Column:
    """Where segment k begins, from 0."""
    return F.call_function("div", n * k, F.lit(parts)).cast("int")


def keys_of(lines: DataFrame, specs: list[tuple[int, int, int]], edits: int) -> DataFrame:
    """lid and k, for each of (less, segment, shift): the hash of the line's bytes that would be the segment of a line of
    ``less`` bytes less, if they lie ``shift`` bytes to the right there. A row a spec, so that compiled code stays short."""
    listed = F.array(*(F.struct(F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for less, i, shift in specs))
    n, i = F.octet_length("line") - F.col("x.less"), F.col("x.i")
    a, b = cut(n, i, edits + 1), cut(n, i + 1, edits + 1)
    return lines.select("lid", "line", F.explode(listed).alias("x")).select("lid", F.xxhash64(n, i, F.substring(F.col("line"), a + F.col("x.shift") + 1, b - a)).alias("k"))


def index_keys(lines: DataFrame, edits: int) -> DataFrame:
    return keys_of(lines, [(0, i, 0) for i in range(edits + 1)], edits)


def probe_keys(lines: DataFrame, edits: int) -> DataFrame:
    """Of the lines of this length and up to ``edits`` less: the starts that both the left and the right side allow. The
    line's own index keys are among them; a key may come twice."""
    starts = lambda less, i: range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1)
    return keys_of(lines, [(less, i, shift) for less in range(edits + 1) for i in range(edits + 1) for shift in starts(less, i)], edits)


def holds_pieces(s: Column, r: Column, edits: int) -> Column:
    """Whether ``r`` holds all but ``edits`` of the finer segments of ``s``, at most ``edits`` bytes from their places. A
    near line must."""
    n = F.octet_length(s)
    hits = F.lit(0)
    for i in range(PIECES):
        a, b = cut(n, i, PIECES), cut(n, i + 1, PIECES)
        from_ = F.greatest(a - edits, F.lit(0))
        around = F.substring(r, from_ + 1, b - from_ + edits)
        hits = hits + F.contains(around, F.substring(s, a + 1, b - a)).cast("int")
    return hits >= PIECES - edits


def within(s: Column, t: Column, edits: int) -> Column:
    """Whether the edit distance is at most ``edits``. Word d has bit k set if the first j bytes of ``t`` and the first
    j + k - edits of ``s`` are within d edits."""
    mask = (1 << (2 * edits + 1)) - 1
    first = F.struct(*(F.lit(sum(1 << (edits + i) for i in range(d + 1)) & mask).alias(f"r{d}") for d in range(edits + 1)))

    def step(acc: Column, j: Column) -> Column:
        c = F.substring(t, j, F.lit(1))
        m = F.lit(0)
        for k in range(2 * edits + 1):
            m = m + F.when(F.substring(s, j + (k - edits), F.lit(1)) == c, 1 << k).otherwise(0)
        return let(F.struct(m.alias("m"), acc.alias("a")), lambda x: _words(x, edits, mask))

    last = F.aggregate(F.sequence(F.lit(1), F.octet_length(t)), first, step)
    at = F.octet_length(s) - F.octet_length(t) + edits
    bit = F.try_element_at(F.array(*(F.lit(1 << k) for k in range(2 * edits + 1))), at + 1)
    return F.when((at < 0) | (at > 2 * edits), False).otherwise(last[f"r{edits}"].bitwiseAND(bit) != 0)


def _words(x: Column, edits: int, mask: int) -> Column:
    m, acc = x["m"], x["a"]
    out: list[Column] = []
    for d in range(edits + 1):
        word = acc[f"r{d}"].bitwiseAND(m)
        if d:
            before = acc[f"r{d - 1}"]
            word = word.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(out[d - 1], 1).bitwiseAND(F.lit(mask)))
        out.append(word)
    return F.struct(*(w.alias(f"r{d}") for d, w in enumerate(out)))


def profile(line: Column) -> Column:
    """Counts of the letters, and of other characters."""

    def counted(text: Column) -> Column:
        counts = F.array(*(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in LETTERS))
        return let(counts, lambda x: F.concat(x, F.array(F.length(text) - F.aggregate(x, F.lit(0), lambda t, n: t + n))))

    return let(F.lower(line.cast("string")), counted)


def parities(counts: Column) -> Column:
    """The counts' last bits as one number."""
    bits = F.transform(counts, lambda x, i: F.call_function("shiftleft", x.bitwiseAND(F.lit(1)), i))
    return F.aggregate(bits, F.lit(0), lambda all_, x: all_.bitwiseOR(x))


def marked(line: Column, **others: Column) -> Column:
    """``others``, the line, its profile p and the parities sk of that."""
    return let(profile(line), lambda p: F.struct(*(c.alias(n) for n, c in others.items()), line.alias("line"), p.alias("p"), parities(p).alias("sk")))


def alike(a: Column, b: Column, edits: int) -> Column:
    """Whether two lines (p, sk) may be within ``edits``: an edit changes two counts by one at most."""
    apart = F.aggregate(F.zip_with(a["p"], b["p"], lambda x, y: F.abs(x - y)), F.lit(0), lambda t, x: t + x)
    return F.when(F.bit_count(a["sk"].bitwiseXOR(b["sk"])) <= 2 * edits, apart <= 2 * edits).otherwise(False)


def cut(n: Column, k: Column | int, parts: int) -> Column:
    """Where segment k begins, from 0."""
    return F.call_function("div", n * k, F.lit(parts)).cast("int")


def keys_of(lines: DataFrame, specs: list[tuple[int, int, int]], edits: int) -> DataFrame:
    """lid and k, for each of (less, segment, shift): the hash of the line's bytes that would be the segment of a line of
    ``less`` bytes less, if they lie ``shift`` bytes to the right there. A row a spec, so that compiled code stays short."""
    listed = F.array(*(F.struct(F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for less, i, shift in specs))
    n, i = F.octet_length("line") - F.col("x.less"), F.col("x.i")
    a, b = cut(n, i, edits + 1), cut(n, i + 1, edits + 1)
    return lines.select("lid", "line", F.explode(listed).alias("x")).select("lid", F.xxhash64(n, i, F.substring(F.col("line"), a + F.col("x.shift") + 1, b - a)).alias("k"))


def index_keys(lines: DataFrame, edits: int) -> DataFrame:
    return keys_of(lines, [(0, i, 0) for i in range(edits + 1)], edits)


def probe_keys(lines: DataFrame, edits: int) -> DataFrame:
    """Of the lines of this length and up to ``edits`` less: the starts that both the left and the right side allow. The
    line's own index keys are among them; a key may come twice."""
    starts = lambda less, i: range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1)
    return keys_of(lines, [(less, i, shift) for less in range(edits + 1) for i in range(edits + 1) for shift in starts(less, i)], edits)


def holds_pieces(s: Column, r: Column, edits: int) -> Column:
    """Whether ``r`` holds all but ``edits`` of the finer segments of ``s``, at most ``edits`` bytes from their places. A
    near line must."""
    n = F.octet_length(s)
    hits = F.lit(0)
    for i in range(PIECES):
        a, b = cut(n, i, PIECES), cut(n, i + 1, PIECES)
        from_ = F.greatest(a - edits, F.lit(0))
        around = F.substring(r, from_ + 1, b - from_ + edits)
        hits = hits + F.contains(around, F.substring(s, a + 1, b - a)).cast("int")
    return hits >= PIECES - edits


def within(s: Column, t: Column, edits: int) -> Column:
    """Whether the edit distance is at most ``edits``, which is 4 at most. Word d has bit k set if the first j bytes of ``t`` and
    the first j + k - edits of ``s`` are within d edits; all words lie side by side in one number."""
    if edits > 4:
        raise ValueError("over 4 edits")
    width = 2 * edits + 1
    mask, each = (1 << width) - 1, sum(1 << d * width for d in range(edits + 1))
    number = lambda x: F.lit(x).cast("long")
    first = sum((sum(1 << edits + i for i in range(d + 1)) & mask) << d * width for d in range(edits + 1))
    bytes_of = lambda x: F.transform(F.when(F.octet_length(x) > 0, F.sequence(F.lit(1), F.octet_length(x))).otherwise(F.array().cast("array<int>")), lambda j: F.substring(x, j, F.lit(1)))

    def run(x: Column) -> Column:
        def step(acc: Column, j: Column) -> Column:
            same = lambda c: sum((F.when(F.get(x["s"], j + (k - edits)) == c, number(1 << k)).otherwise(number(0)) for k in range(width)), number(0))
            kept = acc.bitwiseAND(let(F.get(x["t"], j), same) * each)
            before = acc.bitwiseOR(F.shiftright(acc.bitwiseAND(number(mask * each & ~each)), 1))
            words = kept.bitwiseOR(F.shiftleft(before, width).bitwiseAND(number(mask * each)))
            for d in range(1, edits + 1):
                own = number(mask << (d - 1) * width & ~(1 << d * width - 1))  # the word below, but for its last bit
                words = let(words, lambda w, own=own: w.bitwiseOR(F.shiftleft(w.bitwiseAND(own), width + 1)))
            return words

        n = F.size(x["t"])
        steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, number(first), step)

    last = let(F.struct(bytes_of(s).alias("s"), bytes_of(t).alias("t")), run)
    at = F.octet_length(s) - F.octet_length(t) + edits
    bit = F.try_element_at(F.array(*(number(1 << edits * width + k) for k in range(width))), at + 1)
    return F.when((at < 0) | (at > 2 * edits), False).otherwise(last.bitwiseAND(bit) != 0)


def profile(line: Column) -> Column:
    """Counts of the letters, and of other characters."""

    def counted(text: Column) -> Column:
        counts = F.array(*(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in LETTERS))
        return let(counts, lambda x: F.concat(x, F.array(F.length(text) - F.aggregate(x, F.lit(0), lambda t, n: t + n))))

    return let(F.lower(line.cast("string")), counted)


def parities(counts: Column) -> Column:
    """The counts' last bits as one number."""
    bits = F.transform(counts, lambda x, i: F.call_function("shiftleft", x.bitwiseAND(F.lit(1)), i))
    return F.aggregate(bits, F.lit(0), lambda all_, x: all_.bitwiseOR(x))


def marked(line: Column, **others: Column) -> Column:
    """``others``, the line, its profile p and the parities sk of that."""
    return let(profile(line), lambda p: F.struct(*(c.alias(n) for n, c in others.items()), line.alias("line"), p.alias("p"), parities(p).alias("sk")))


def alike(a: Column, b: Column, edits: int) -> Column:
    """Whether two lines (p, sk) may be within ``edits``: an edit changes two counts by one at most."""
    apart = F.aggregate(F.zip_with(a["p"], b["p"], lambda x, y: F.abs(x - y)), F.lit(0), lambda t, x: t + x)
    return F.when(F.bit_count(a["sk"].bitwiseXOR(b["sk"])) <= 2 * edits, apart <= 2 * edits).otherwise(False)


def cut(n: Column, k: Column | int, parts: int) -> Column:
    """Where segment k begins, from 0."""
    return F.call_function("div", n * k, F.lit(parts)).cast("int")


def shares_of(p: Column, edits: int) -> Column:
    """Hashes of the counts of each share of the letters. Near lines differ in 2 ``edits`` counts at most, so they agree in one of
    the 2 ``edits`` + 1 shares; each share has frequent letters and rare ones."""
    shares = 2 * edits + 1
    return F.array(*(F.xxhash64(F.lit(g), *(F.get(p, F.lit(i)) for i in range(g, len(LETTERS) + 1, shares))) for g in range(shares)))


def keys_of(lines: DataFrame, specs: list[tuple[int, int, int]], edits: int) -> DataFrame:
    """lid and k, for each of (less, segment, shift): the hash of the line's bytes that would be the segment of a line of
    ``less`` bytes less, if they lie ``shift`` bytes to the right there. A row a spec, so that compiled code stays short."""
    listed = F.array(*(F.struct(F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for less, i, shift in specs))
    n, i = F.octet_length("line") - F.col("x.less"), F.col("x.i")
    a, b = cut(n, i, edits + 1), cut(n, i + 1, edits + 1)
    return lines.select("lid", "line", F.explode(listed).alias("x")).select("lid", F.xxhash64(n, i, F.substring(F.col("line"), a + F.col("x.shift") + 1, b - a)).alias("k"))


def index_keys(lines: DataFrame, edits: int) -> DataFrame:
    return keys_of(lines, [(0, i, 0) for i in range(edits + 1)], edits)


def probe_keys(lines: DataFrame, edits: int) -> DataFrame:
    """Of the lines of this length and up to ``edits`` less: the starts that both the left and the right side allow. The
    line's own index keys are among them; a key may come twice."""
    starts = lambda less, i: range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1)
    return keys_of(lines, [(less, i, shift) for less in range(edits + 1) for i in range(edits + 1) for shift in starts(less, i)], edits)


def holds_pieces(s: Column, r: Column, edits: int) -> Column:
    """Whether ``r`` holds all but ``edits`` of the finer segments of ``s``, at most ``edits`` bytes from their places. A
    near line must."""
    n = F.octet_length(s)
    hits = F.lit(0)
    for i in range(PIECES):
        a, b = cut(n, i, PIECES), cut(n, i + 1, PIECES)
        from_ = F.greatest(a - edits, F.lit(0))
        around = F.substring(r, from_ + 1, b - from_ + edits)
        hits = hits + F.contains(around, F.substring(s, a + 1, b - a)).cast("int")
    return hits >= PIECES - edits


def within(s: Column, t: Column, edits: int) -> Column:
    """Whether the edit distance is at most ``edits``. Word d has bit k set if the first j bytes of ``t`` and the first
    j + k - edits of ``s`` are within d edits."""
    mask = (1 << (2 * edits + 1)) - 1
    first = F.struct(*(F.lit(sum(1 << (edits + i) for i in range(d + 1)) & mask).alias(f"r{d}") for d in range(edits + 1)))

    def step(acc: Column, j: Column) -> Column:
        c = F.substring(t, j, F.lit(1))
        m = F.lit(0)
        for k in range(2 * edits + 1):
            m = m + F.when(F.substring(s, j + (k - edits), F.lit(1)) == c, 1 << k).otherwise(0)
        return let(F.struct(m.alias("m"), acc.alias("a")), lambda x: _words(x, edits, mask))

    last = F.aggregate(F.sequence(F.lit(1), F.octet_length(t)), first, step)
    at = F.octet_length(s) - F.octet_length(t) + edits
    bit = F.try_element_at(F.array(*(F.lit(1 << k) for k in range(2 * edits + 1))), at + 1)
    return F.when((at < 0) | (at > 2 * edits), False).otherwise(last[f"r{edits}"].bitwiseAND(bit) != 0)


def _words(x: Column, edits: int, mask: int) -> Column:
    m, acc = x["m"], x["a"]
    out: list[Column] = []
    for d in range(edits + 1):
        word = acc[f"r{d}"].bitwiseAND(m)
        if d:
            before = acc[f"r{d - 1}"]
            word = word.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(out[d - 1], 1).bitwiseAND(F.lit(mask)))
        out.append(word)
    return F.struct(*(w.alias(f"r{d}") for d, w in enumerate(out)))


def middle(s: Column, t: Column) -> tuple[Column, Column]:
    """Both lines without the leading and trailing PIECES-ths of the shorter one that they share; distances stay."""
    n = F.least(F.octet_length(s), F.octet_length(t))
    ns, nt = F.octet_length(s), F.octet_length(t)
    head = tail = F.lit(0)
    same_head = same_tail = F.lit(True)
    half = PIECES // 2
    for i in range(half):
        a, b = cut(n, i, PIECES), cut(n, i + 1, PIECES)
        same_head = same_head & (F.substring(s, a + 1, b - a) == F.substring(t, a + 1, b - a))
        same_tail = same_tail & (F.substring(s, ns - b + 1, b - a) == F.substring(t, nt - b + 1, b - a))
        head, tail = F.when(same_head, b).otherwise(head), F.when(same_tail, b).otherwise(tail)
    return tuple(F.substring(x, head + 1, F.octet_length(x) - head - tail) for x in (s, t))


def let(value: Column, make) -> Column:
    """``make`` of a value that is computed once, however often ``make`` names it."""
    return F.element_at(F.transform(F.array(value), make), 1)


def near(s: Column, t: Column, edits: int) -> Column:
    """Of a shorter line and one not shorter: whether they are within ``edits``."""
    parts = middle(s, t)
    checked = let(F.struct(parts[0].alias("s"), parts[1].alias("t")), lambda x: within(x["s"], x["t"], edits))
    return F.when(holds_pieces(s, t, edits), checked).otherwise(False)


def near_any(a: Column, b: Column, edits: int) -> Column:
    """Whether two lines (line, p, sk) are near, whichever is shorter."""
    swap = F.octet_length(a["line"]) > F.octet_length(b["line"])
    either = F.struct(F.when(swap, b["line"]).otherwise(a["line"]).alias("s"), F.when(swap, a["line"]).otherwise(b["line"]).alias("t"))
    close = F.abs(F.octet_length(a["line"]) - F.octet_length(b["line"])) <= edits
    return F.when(close & alike(a, b, edits), let(either, lambda x: near(x["s"], x["t"], edits))).otherwise(False)


def tasks_for(rows: int, each: int) -> int:
    """Verifying takes long for few bytes, so tasks go by pairs rather than by size."""
    return max(1, min(rows // each, MOST_TASKS))


def later_in_crowds(texts: DataFrame, members: DataFrame, edits: int) -> DataFrame:
    """lid of lines that are near an earlier line with which they share a crowded key. ``texts``: lid and x (first, lid and what
    :func:`marked` adds); ``members``: k and lid.

    Most of a family of variants is near its earliest line, which all members of a key are held against first. What is left is
    held against all members of its finer keys, in pairs of blocks dealt by key and block."""
    crowd = common.materialise(members.join(texts, "lid").select("k", "x"), "crowds", "zstd")
    heads = common.materialise(crowd.groupBy("k").agg(F.min("x").alias("head")), "crowd-heads")
    beside = crowd.join(heads, "k").where("x.lid <> head.lid").select("k", "x", near_any(F.col("head"), F.col("x"), edits).alias("near"))
    beside = common.materialise(beside, "beside-heads", "zstd")
    settled = common.materialise(beside.where("near").select(F.col("x.lid").alias("lid")).distinct(), "settled-lines")
    rest = beside.where("not near").join(settled, F.col("x.lid") == F.col("lid"), "left_anti").select("k", "x")
    rest = common.materialise(rest, "unsettled-lines", "zstd")
    if rest.isEmpty():
        return settled
    shared = lambda df: df.select("k", F.col("x").withField("h", shares_of(F.col("x.p"), edits)).alias("x"))
    finer = lambda df: shared(df).select("x", F.posexplode(F.transform("x.h", lambda h: F.xxhash64("k", h))).alias("g", "k"))
    counted = lambda df, n: finer(df).groupBy("k").agg(F.count("*").alias(n))
    sizes = common.materialise(counted(rest, "u").join(counted(crowd, "n"), "k").where("n > 1"), "finer-keys")
    dealt = lambda n: F.pmod(F.xxhash64("x.lid"), F.ceil(F.col(n) / BLOCK)).cast("int")
    left = finer(rest).join(sizes, "k").groupBy("k", "g", "n", dealt("u").alias("p")).agg(F.collect_list("x").alias("xs"))
    left = left.withColumn("q", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / BLOCK).cast("int") - 1)))
    right = finer(crowd).join(sizes, "k").groupBy("k", dealt("n").alias("q")).agg(F.collect_list("x").alias("ys"))
    left, right = common.materialise(left, "blocks-left", "zstd"), common.materialise(right, "blocks-right", "zstd")
    tasks = tasks_for(sizes.agg(F.sum(F.col("u") * F.col("n"))).first()[0] or 0, (2 * edits + 1) * 8 * BLOCK * BLOCK)
    met = left.repartition(tasks, "k", "q").join(right.repartition(tasks, "k", "q"), ["k", "q"])
    # two lines that agree in several shares are held against one another in the first of them
    here = lambda a, b: F.array_position(F.zip_with(a["h"], b["h"], lambda x, y: x == y), F.lit(True)) == F.col("g") + 1
    apart = lambda a, b: F.bit_count(a["sk"].bitwiseXOR(b["sk"])) > 2 * edits
    held = lambda a, b: F.when((b["first"] >= a["first"]) | apart(a, b), False).when(here(a, b), near_any(a, b, edits)).otherwise(False)
    found = F.filter("xs", lambda a: F.exists("ys", lambda b: held(a, b)))
    return met.select(F.explode(F.transform(found, lambda a: a["lid"])).alias("lid")).unionByName(settled).distinct()


def later_lines(lines: DataFrame, edits: int = EDITS, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """lid of each line that is near an earlier one. ``lines``: lid, line, first, of distinct lines."""
    long = lines.where(F.octet_length("line") >= least)
    counted = index_keys(long, edits).groupBy("k").agg(F.count("*").alias("n"), F.min("lid").alias("only"))
    # a line has its own index keys among its probes, so that a key of more index rows has a hit for each of them
    hits = probe_keys(long, edits).join(counted, "k").where("n > 1 or lid <> only").select("k", "lid", "n", "only").distinct()
    hits = common.materialise(hits, "line-hits")
    wanted = common.materialise(hits.select(F.col("lid").alias("w")).union(hits.where("n = 1").select("only")).distinct(), "candidate-ids")
    texts = long.join(common.small(wanted), F.col("lid") == F.col("w"), "left_semi").select("lid", marked(F.col("line"), first=F.col("first"), lid=F.col("lid")).alias("x"))
    texts = common.materialise(texts, "candidate-lines", "zstd")
    # a key of few index rows gives at most so many pairs a probe, however many probe it
    probes = hits.where(F.col("n") <= hot).join(texts.select("lid", F.col("x.sk").alias("ps")), "lid").select("k", F.col("lid").alias("p"), "ps")
    index = index_keys(texts.select("lid", F.col("x.line").alias("line")), edits).join(texts.select("lid", F.col("x.sk").alias("is")), "lid").withColumnRenamed("lid", "i")
    met = index.join(probes, (index["k"] == probes["k"]) & (F.col("i") != F.col("p")) & (F.bit_count(F.col("is").bitwiseXOR(F.col("ps"))) <= 2 * edits))
    met = common.materialise(met.select(F.least("i", "p").alias("a"), F.greatest("i", "p").alias("b")).distinct(), "line-candidates")
    own = lambda x: texts.select(F.col("lid").alias(x), F.col("x").alias(f"x{x}"))
    tasks = tasks_for(met.count(), 4000)
    pairs = met.join(own("a"), "a").repartition(tasks, "b").join(own("b").repartition(tasks, "b"), "b").where(near_any(F.col("xa"), F.col("xb"), edits))
    found = pairs.select(F.when(F.col("xa.first") < F.col("xb.first"), F.col("b")).otherwise(F.col("a")).alias("lid"))
    crowded = common.materialise(hits.where(F.col("n") > hot).select("k", "lid"), "crowd-keys")
    if not crowded.isEmpty():
        found = found.unionByName(later_in_crowds(texts, crowded, edits))
    return found.distinct()


def dedup(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_lines, n_kept, n_copies, n_near, and the numbers of the dropped lines."""
    text = F.coalesce("text", F.lit(""))
    row = common.row_key(docs, F.col("doc_id"), text)
    distinct = lines_of(docs, row).groupBy("h1", "h2").agg(F.min(F.struct("first", "line")).alias("x"))
    distinct = common.materialise(distinct.select(F.monotonically_increasing_id().alias("lid"), "x.first", "x.line"), "distinct-lines", "zstd")
    later = common.materialise(later_lines(distinct, edits, least), "later-lines")
    # all lines that aren't the first of their copies are copies, so that only first ones need to be told
    said = distinct.select("lid", F.col("first._row").alias("_row"), F.col("first.no").alias("no")).join(later.withColumn("near", F.lit(True)), "lid", "left")
    firsts = said.groupBy("_row").agg(F.count("*").alias("firsts"), F.collect_list(F.when(F.col("near").isNull(), F.col("no"))).alias("kept"))
    rows = docs.select("doc_id", row.alias("_row"), F.size(F.split(text, "\n")).alias("n_lines"))
    # of rows that repeat an id and a text, the first has the first lines
    rows = rows.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("n_lines").alias("n_lines"), F.count("*").alias("times"))
    rows = rows.join(firsts, "_row", "left").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("times"))))
    mine = F.when((F.col("_k") == 1) & F.col("firsts").isNotNull(), F.col("kept")).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("kept", mine).withColumn("firsts", F.when(F.col("_k") == 1, F.coalesce("firsts", F.lit(0))).otherwise(0).cast("long"))
    return rows.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("kept").cast("long").alias("n_kept"), (F.col("n_lines") - F.col("firsts")).alias("n_copies"),
        (F.col("firsts") - F.size("kept")).alias("n_near"), F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), F.col("kept")).alias("dropped"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents"))
