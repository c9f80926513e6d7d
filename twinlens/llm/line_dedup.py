"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

A line is cut into EDITS + 1 segments; a line within EDITS edits of it has one of them unchanged, at a place that the
two lengths and the segment's number bound. Lines are indexed by (length, number, segment) and probe with their own
substrings at these places, for every shorter or equal length that is near enough. Pairs that meet are verified by a
bit-parallel automaton over the band of 2 * EDITS + 1 diagonals, without what both begin and end with.

A line is dropped if an earlier line, in the order of documents and lines, is equal or within EDITS edits. Lines under
an index entry are judged in one array if they are few, and pairs are never made into rows. Entries with more are split:
what a line has besides the shared segment is within EDITS edits as well, so it is cut into segments and indexed in its
turn. What is still large after some levels goes in rounds, HUBS of an entry's lines against all that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.llm.common import reliable, sheltered, small, stored, table

#: Largest edit distance of near-duplicates, and shortest line that is looked at.
EDITS, MIN_CHARS = 2, 20
#: Index entries of so many rows are judged at once; lines of a larger one that a round compares; levels of finer entries.
FEW, HUBS, LEVELS = 512, 16, 2
#: Lines that occur more often than this, and in more than a thousandth of all places, probe once only.
HOT_LINES = 1000
#: Bits of the index's filter for each entry, and at most.
BITS, MAX_BITS = 8, 1 << 26


def _let(value: Column, f) -> Column:
    """f of value, which is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def _common(x: Column, y: Column, n: Column, piece) -> Column:
    """Number of characters, n at most, that piece(text, at, length) finds alike in both from their beginning: by halving
    steps, whole stretches compared at once."""
    steps = F.transform(F.sequence(F.ceil(F.log2(n + 1)).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (piece(x, at, step) == piece(y, at, step)), at + step).otherwise(at))


def _trimmed(x: Column, y: Column) -> Column:
    """struct(x, y) less what both begin and end with, which leaves their edit distance as it is."""
    from_left = lambda c, at, n: F.substring(c, at + 1, n)
    from_right = lambda c, at, n: F.substring(c, F.char_length(c) - at - n + 1, n)

    def cut(piece, rest):
        def run(v: Column) -> Column:
            n = _common(v["x"], v["y"], v["n"], piece)
            both = F.struct(v["x"].alias("x"), v["y"].alias("y"), n.alias("n"))
            return _let(both, lambda w: sized(rest(w["x"], w["n"]), rest(w["y"], w["n"])))

        return run

    def sized(a: Column, b: Column) -> Column:
        return _let(F.struct(a.alias("x"), b.alias("y")), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), F.least(F.char_length(v["x"]), F.char_length(v["y"])).alias("n")))

    whole = lambda c: F.char_length(c)
    front = _let(sized(x, y), cut(from_left, lambda c, n: F.substring(c, n + 1, whole(c))))
    return _let(front, cut(from_right, lambda c, n: F.substring(c, F.lit(1), whole(c) - n)))


def within(x: Column, y: Column, edits: int = EDITS) -> Column:
    """If the edit distance of x and y is at most edits.

    Bit d of row e: the text of y so far can be had from x up to diagonal d with e edits. The rows stand side by side in
    one number; the matches of a character of y with the band's characters of x are bits as well.
    """
    chars = lambda c: F.filter(F.split(c, ""), lambda k: k != "")
    width = 2 * edits + 1
    full = (1 << width) - 1
    start = sum(((((1 << (e + 1)) - 1) << edits) & full) << (width * e) for e in range(edits + 1))

    def step(s: Column, hit: Column) -> Column:
        row = lambda e: F.shiftright(s, width * e).bitwiseAND(F.lit(full))
        new = [row(0).bitwiseAND(hit)]
        for e in range(1, edits + 1):
            before = row(e - 1)
            grown = row(e).bitwiseAND(hit).bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(new[-1], 1))
            new.append(grown.bitwiseAND(F.lit(full)))
        out = new[0]
        for e in range(1, edits + 1):
            out = out.bitwiseOR(F.shiftleft(new[e], width * e))
        return F.when(s == 0, s).otherwise(out)

    def compared(v: Column) -> Column:
        matches = lambda c, j: sum((F.when(F.get(v["x"], j + d) == c, F.lit(1 << d)).otherwise(F.lit(0)) for d in range(width)), F.lit(0))
        return F.aggregate(F.transform(v["y"], matches), F.lit(start), step)

    arrays = lambda v: F.struct(F.concat(F.array_repeat(F.lit(""), edits), chars(v["x"])).alias("x"), chars(v["y"]).alias("y"))
    last = F.shiftright(_let(_let(_trimmed(x, y), arrays), compared), width * edits)
    diagonal = F.char_length(x) - F.char_length(y) + edits
    return F.when(diagonal.between(0, width - 1), F.call_function("shiftright", last, diagonal).bitwiseAND(1) == 1).otherwise(False)


def may_be_within(x: Column, y: Column, edits: int = EDITS, parts: int = 8, n: Column | None = None) -> Column:
    """False only if the distance of x and y is above edits: of so many pieces of x, all but one for each edit are in y,
    shifted by edits at most."""
    n = F.char_length(x) if n is None else n
    size = F.call_function("div", n, F.lit(parts)).cast("int")
    found = F.lit(0)
    for i in range(parts):
        piece = F.substring(x, size * i + 1, size if i < parts - 1 else n - size * (parts - 1))
        around = F.substring(y, F.greatest(size * i + 1 - edits, F.lit(1)), (size if i < parts - 1 else n - size * (parts - 1)) + 2 * edits)
        found = found + F.contains(around, piece).cast("int")
    return found >= parts - edits


def _segment(i: Column, size: Column, edits: int) -> tuple[Column, Column]:
    """Place and length of segment i of a line of size characters; the last ones are longer if need be."""
    over = F.pmod(size, F.lit(edits + 1))
    q, long = F.call_function("div", size - over, F.lit(edits + 1)).cast("int"), edits + 1 - over
    return q * i + F.greatest(i - long, F.lit(0)), q + (i >= long).cast("int")


def _filed(line: Column, n: Column, edits: int) -> Column:
    """The index entries of a line."""
    parts = ((F.lit(i), *_segment(F.lit(i), n, edits)) for i in range(edits + 1))
    return F.array(*(F.xxhash64(i, n, F.substring(line, at + 1, length)) for i, at, length in parts))


def _probes(rows: DataFrame, edits: int, others: bool = False) -> DataFrame:
    """rows (line, n, ...) with the index entries that a line looks up for lines of up to edits characters less: key,
    own, delta, at, length; own for those under which it is filed itself, which are left out for others only."""
    places = []
    for delta in range(edits + 1):
        for i in range(edits + 1):
            for shift in range(max(-i, delta - (edits - i)), min(i, delta + (edits - i)) + 1):
                if delta or shift or not others:
                    places.append(F.struct(F.lit(i).alias("i"), F.lit(delta).alias("delta"), F.lit(shift).alias("shift")))
    # one row for each place: an expression of all keys would be too long to be compiled
    i, delta, shift = (F.col(f"_place.{k}") for k in ("i", "delta", "shift"))
    size = F.col("n") - delta
    start, length = _segment(i, size, edits)
    at = start + shift
    found = rows.withColumn("_place", F.explode(F.array(*places))).withColumns({"at": at, "length": length, "delta": delta, "own": (delta == 0) & (shift == 0)})
    found = found.filter("at >= 0 and at + length <= n and delta <= n")
    # exploded, so that a filter on the key doesn't compute it anew each time it names it
    return found.withColumn("key", F.explode(F.array(F.xxhash64(i, size, F.expr("substring(line, at + 1, length)"))))).drop("_place")


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Lines of (id, text) of min_chars at least: place (id, text's hash, number), line, n, and two hashes."""
    white = F.lit(" \t\x0b\x0c\r")
    outer = F.contains(white, F.substring("raw", 1, 1)) | F.contains(white, F.substring("raw", -1, 1))
    raw = docs.select("id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("no", "raw")).filter(F.octet_length("raw") >= min_chars)
    # exploded, so that what uses the line and its length doesn't compute them anew
    line = raw.select("id", "t", "no", F.explode(F.array(F.when(outer, F.btrim("raw", white)).otherwise(F.col("raw")))).alias("line"))
    sized = line.select("*", F.explode(F.array(F.char_length("line"))).alias("n")).filter(F.col("n") >= min_chars)
    return sized.select(F.struct("id", "t", "no").alias("place"), "line", "n", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))


def _finer(rows: DataFrame, edits: int) -> DataFrame:
    """The next level of rows (key, h, own, delta, at, length, line): what is left of a line without the part that the
    key stands for is within edits as well, so it is cut and probed in its turn under that key."""
    left = F.concat(F.expr("substring(line, 1, at)"), F.expr("substring(line, at + length + 1)"))
    rest = rows.select(F.col("key").alias("under"), "h", F.col("own").alias("filed"), F.col("delta").alias("less"), left.alias("line"))
    found = _probes(rest.withColumn("n", F.char_length("line")), edits).filter("delta = less")
    # what only probed before isn't filed now
    return found.select(F.xxhash64("under", "key").alias("key"), "h", (F.col("filed") & F.col("own")).alias("own"), "delta", "at", "length", "line")


def repeated_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, t, no, exact): the lines of (id, text) to drop; exact if an equal line is earlier.

    t tells texts of one id apart. Rows with equal id and text are one document.
    """
    lines = _lines(docs, min_chars)
    filed = stored(lines.select("place", "h", "g", "n", _filed(F.col("line"), F.col("n"), edits).alias("keys")))
    places = filed.drop("n", "keys")
    firsts = stored(places.groupBy("h", "g").agg(F.min("place").alias("first"), F.count("*").alias("m")))
    total = places.count()
    hot = firsts.filter(F.col("m") > max(HOT_LINES, total // 1000)).select("h", "g", "first")  # a thousand at most

    # a Bloom filter of the index, of bounded size, stops probes for entries that no line has; a full one stops none
    words = min(1 << max(6, (total * (edits + 1) * BITS - 1).bit_length()), MAX_BITS) // 64
    word = F.pmod(F.shiftrightunsigned("key", 12), F.lit(words)).cast("int")
    bits = F.expr("shiftleft(1L, cast(key & 63 as int)) | shiftleft(1L, cast(shiftrightunsigned(key, 6) & 63 as int))")
    found = filed.select(F.explode("keys").alias("key")).groupBy(word.alias("word")).agg(F.bit_or(bits).alias("bits"))
    spark = docs.sparkSession
    each = spark.range(words).join(found, F.col("id") == F.col("word"), "left").select(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")).alias("w"))
    bloom = each.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["bits"]).alias("bits")).scalar()
    once = lines.join(F.broadcast(hot), ["h", "g"], "left").filter("first is null or first = place")
    # each pair of lines meets where the longer one probes
    names = ["key", "h", "own", "delta", "at", "length"]
    probes = stored(_probes(once.select("h", "line", "n"), edits, others=True).select(*names).filter(F.get(bloom, word).bitwiseAND(bits) == bits))
    at, length = _segment(F.col("i"), F.col("n"), edits)
    entries = filed.join(F.broadcast(hot), ["h", "g"], "left").filter("first is null or first = place").select("h", "n", F.posexplode("keys").alias("i", "key"))
    probes = probes.unionByName(entries.select("key", "h", F.lit(True).alias("own"), F.lit(0).alias("delta"), at.alias("at"), length.alias("length")))

    def shared(rows: DataFrame) -> DataFrame:
        """Rows of entries that two lines share, and the number of an entry's rows."""
        keys = rows.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.max("own").alias("filed"))
        keys = reliable(keys.filter("filed and a <> b").select("key"))
        met = rows.join(small(keys, keys.count()), "key", "left_semi").distinct()
        return reliable(met.withColumn("m", F.count("*").over(Window.partitionBy("key"))))

    met = shared(probes)
    wanted = reliable(firsts.join(met.select("h").distinct(), "h", "left_semi").select("h", "g", "first"))
    n = wanted.count()
    of = small(wanted.select(F.col("h").alias("wh"), F.col("g").alias("wg"), F.col("first").alias("wf")), n)
    same = (F.col("h") == F.col("wh")) & (F.col("g") == F.col("wg")) & (F.col("place") == F.col("wf"))
    ids = reliable(wanted.select(F.col("first.id").alias("_i"), F.col("first.t").alias("_t")).distinct())
    some = docs.join(small(ids, n), F.col("id").eqNullSafe(F.col("_i")) & (F.xxhash64("text") == F.col("_t")), "left_semi")
    texts = reliable(_lines(some, min_chars).join(of, same).select("h", "g", F.col("place").alias("first"), "line").dropDuplicates(["h", "g"]))

    def near(pairs: DataFrame, gone: DataFrame) -> DataFrame:
        """(h, g) of the later line of each of the pairs (h, other) that are within reach, and of those gone before."""
        x = texts.select("h", F.col("g").alias("xg"), F.col("first").alias("xf"), F.col("line").alias("x"))
        y = texts.select(F.col("h").alias("other"), F.col("g").alias("yg"), F.col("first").alias("yf"), F.col("line").alias("y"))
        each = pairs.select(F.least("h", "other").alias("h"), F.greatest("h", "other").alias("other")).distinct()
        both = each.join(x, "h").join(y, "other").filter(F.abs(F.char_length("x") - F.char_length("y")) <= edits)
        later = F.when(F.col("xf") > F.col("yf"), F.struct("h", F.col("xg").alias("g"))).otherwise(F.struct(F.col("other").alias("h"), F.col("yg").alias("g")))
        both = both.select(later.alias("l"), "x", "y").select("l.h", "l.g", "x", "y")
        both = both.join(gone, ["h", "g"], "left_anti")
        # the comparison costs more than its bytes tell
        both = both.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8))
        both = both.filter(may_be_within(F.col("x"), F.col("y"), edits))
        found = both.filter(within(F.col("x"), F.col("y"), edits)).select("h", "g").distinct()
        return reliable(gone.unionByName(found).distinct())

    def judged_together(few: DataFrame) -> DataFrame:
        """(h, g) of the lines of entries with few that are within reach of an earlier one of the entry: its lines stand
        in an array, in order, and each is compared with those before it that it can be near to."""
        members = few.groupBy("key", "h").agg(F.max("own").alias("own")).join(texts, "h")
        entry = members.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first", "h", "g", "own", "line", F.char_length("line").alias("n")))).alias("m"))

        def close(x: Column, y: Column) -> Column:
            met = (x["own"] | y["own"]) & (F.abs(x["n"] - y["n"]) <= edits)
            return met & may_be_within(x["line"], y["line"], edits, n=x["n"]) & within(x["line"], y["line"], edits)

        def seen(x: Column, i: Column) -> Column:
            hit = F.exists(F.slice("m", F.lit(1), i), lambda y: close(x, y))
            return F.struct(x["h"].alias("h"), x["g"].alias("g"), hit.alias("hit"))

        return entry.select(F.explode(F.filter(F.transform("m", seen), lambda v: v["hit"])).alias("v")).select("v.h", "v.g").distinct()

    def ranked(many: DataFrame) -> DataFrame:
        """The filed lines of entries with many, by place."""
        rank = F.row_number().over(Window.partitionBy("key").orderBy("first", "h"))
        least = wanted.groupBy("h").agg(F.min("first").alias("first"))
        return many.filter("own").select("key", "h").distinct().join(least, "h").withColumn("rank", rank).select("key", F.col("h").alias("other"), F.col("first").alias("of"), "rank")

    gone, many = reliable(judged_together(met.filter(F.col("m") <= FEW))), reliable(met.filter(F.col("m") > FEW))
    for _ in range(LEVELS):
        if not many.limit(1).count():
            break
        rows = many.drop("m") if "line" in many.columns else many.drop("m").join(texts.select("h", "line").dropDuplicates(["h"]), "h")
        met = shared(_finer(rows, edits))
        gone = reliable(gone.unionByName(judged_together(met.filter(F.col("m") <= FEW))).distinct())
        many = reliable(met.filter(F.col("m") > FEW))
    # what still has many lines: round by round, for lines that are still there
    if many.limit(1).count():
        members, start = reliable(ranked(many)), 0
        while members.filter(F.col("rank") > start).limit(1).count():
            now = members.filter((F.col("rank") > start) & (F.col("rank") <= start + HUBS)).select("key", "other")
            gone = near(many.select("key", "h").join(now, "key").filter("h <> other").select("h", "other"), gone)
            start += HUBS

    seen = places.join(F.broadcast(hot.withColumnRenamed("first", "hf")), ["h", "g"], "left")
    quick = seen.filter("hf is not null").withColumnRenamed("hf", "first")
    slow = seen.filter("hf is null").drop("hf").join(firsts.select("h", "g", "first"), ["h", "g"])
    judged = quick.unionByName(slow).join(small(gone.withColumn("near", F.lit(True)), n), ["h", "g"], "left")
    return judged.filter("place <> first or near").select("place.id", "place.t", "place.no", (F.col("place") != F.col("first")).alias("exact"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with their texts less the dropped lines, and n_lines, n_exact, n_near: lines before, and dropped ones.

    A null text stays null, with no lines; lines shorter than min_chars without their outer white space stay. Rows with
    equal id and text keep the same lines; a null id comes first in the order. Other columns stay; those named like the
    three new ones are replaced. An empty table gives an empty result.
    """
    own = docs.drop("n_lines", "n_exact", "n_near")
    slim = own.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    found = repeated_lines(slim, edits, min_chars)
    by = reliable(found.groupBy("id", "t").agg(F.collect_set("no").alias("_gone"), F.count_if("exact").alias("n_exact"), F.count_if(~F.col("exact")).alias("n_near")))
    by = by.select(F.col("id").alias("_id"), F.col("t").alias("_t"), "_gone", "n_exact", "n_near")
    # both sides grow with the table
    joined = own.join(by, F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text_col)) == F.col("_t")), "left")
    lines = F.split(F.col(text_col), "\n")
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("_gone", i)), "\n")
    return joined.select(
        *(F.when(F.col("_gone").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in own.columns),
        F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_exact", "n_near")),
    )


def op6_line_dedup(spark, sf_dir):
    """Per document: its lines, dropped ones, and the digest of the text that is left."""
    found = dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@sheltered
def line_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated lines go, n_chars follows, and documents that had words but keep none go.

    A null text stays null. Rows with equal id and text are one document and keep the same lines; a null id comes first in
    the order. An empty table gives an empty result.
    """
    had = F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    found = dedup_lines(docs)
    kept = found.filter(F.coalesce(had, F.lit(False)) | ((F.col("n_exact") + F.col("n_near")) == 0))
    changed = F.col("n_exact") + F.col("n_near") > 0
    return kept.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(range(0, len(x))) AS no, unnest(x) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
t AS (SELECT *, trim(raw, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM l),
f AS (SELECT line, length(line) AS n, min({'d': doc_id, 'n': no}) AS first FROM t WHERE length(line) >= 20 GROUP BY line),
p AS (SELECT a.line FROM (SELECT *, n + unnest([-2, -1, 0, 1, 2]) AS m FROM f) a JOIN f b ON a.m = b.n AND b.first < a.first WHERE levenshtein(a.line, b.line) <= 2),
k AS (SELECT t.doc_id, t.no, t.raw, f.line IS NOT NULL AND f.first <> {'d': t.doc_id, 'n': t.no} AS exact, f.line IS NOT NULL AND f.first = {'d': t.doc_id, 'n': t.no} AND f.line IN (SELECT line FROM p) AS near FROM t LEFT JOIN f USING (line)),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (exact) AS n_exact, count(*) FILTER (near) AS n_near, string_agg(raw, chr(10) ORDER BY no) FILTER (NOT exact AND NOT near) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INT) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN g USING (doc_id)
"""
