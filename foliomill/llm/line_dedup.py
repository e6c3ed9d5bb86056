"""Line dedup by a suffix array over sequences of line IDs; later copies of repeated runs are deleted.

The text is all documents' lines, in the order of their documents; a line's ID is a 128-bit
fingerprint, a suffix starts at a line and ends with its document.  The array is built by prefix
doubling over the cluster.  Ranks of one line are the IDs themselves.  In the round of step ``k`` a
suffix's new rank is the place of the pair (its rank, the rank ``k`` lines later) among all such
pairs, found by a range-partitioned sort of the distinct pairs.  Suffixes whose rank has become
unique take no further part, nor do those whose documents end alike, so a round only moves suffixes
whose first ``k`` lines recur; rounds end when there are none.  A suffix's *path*, its ranks of 2,
4, 8, ... lines, compares in the order of the array.

Neighbours in the array share at least as many lines as their paths' common ranks say, and fewer
than twice as many.  Where a suffix and its neighbour are followed, one line on, by neighbours again,
the common prefix is one longer than theirs (the permuted common prefixes); only at the end of such a
chain lines are compared, no more of them than are already known to be equal.  Neighbours with at
least ``min_lines`` common lines form an interval: its first suffix in document order stays, and the
first ``min_lines`` lines of every other are deleted.  Because every suffix of a longer repeated run
lies in such an interval, what goes is the union of the maximal runs that occur earlier, judged on
the input.

Pairs are counted before they are shuffled, and what joins with them is written first, so that a hot
line costs no more than a rare one.  DataFrame functions only.

With ``long_words`` a single line of at least so many words is a run of its own, so that a long
passage between lines of other documents, or a one-line document, goes too while short common
lines stay.  The pipeline uses ``LONG_WORDS``; ``op8_line_dedup`` counts runs of ``MIN_LINES`` only,
as its SQL does.

Edge cases: a null text stays null, with no lines; an empty text is one empty line; runs whose first
``min_lines`` lines are all blank do not count from there; rows that share id and text are one
document and share the outcome, rows that share only the id are ordered by text fingerprint, rows
without id come first; an empty table gives an empty result; other columns are carried along, and
columns named like the two added ones are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import cut, cut_counting, only, ordered, ranked

MIN_LINES = 2
#: Words from which a line counts as a run by itself.
LONG_WORDS = 50
#: Neighbours whose interval is found in one task: two to the power of this.
CHUNK = 16

_NO_LINE = "cast(array() as array<bigint>)"


def _name(x: Column) -> Column:
    """128 bits in two words."""
    return F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(0x5BD1E995), x).alias("b"))


def line_names(docs: DataFrame, min_lines: int, long_words: int | None, id_col: str, text_col: str) -> DataFrame:
    """One row per document: ``d`` (a number in their order), ``id, print, n``, and by line ``names``, ``filled``
    (one of ``min_lines`` lines from here is not blank) and ``long``."""
    text = F.col(text_col)
    rows = docs.filter(text.isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("print"), F.split(text, "\n").alias("lines"))
    words = lambda x: F.length(x) >= 2 * long_words - 1 if long_words else F.lit(False)
    long = lambda x: F.when(words(x), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")) >= (long_words or 0)).otherwise(False)
    rows = rows.select(
        "id", "print", F.transform("lines", _name).alias("names"),
        F.transform("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("filled"), F.transform("lines", long).alias("long"),
    )
    rows = ordered(cut(rows, "line-names"), [F.col("id"), F.col("print")], "d", "line-documents", distinct=["id", "print"])
    some = F.transform("filled", lambda x, i: F.exists(F.slice("filled", i + 1, F.lit(min_lines)), lambda y: y))
    return rows.select("d", "id", "print", F.size("names").alias("n"), "names", some.alias("filled"), "long")


def _doubled(rows: DataFrame, by: list[str], path: Column) -> tuple[DataFrame, int]:
    """A round: ``rows`` with the place of (``by``, ``s``) appended to the path, whether it is
    shared (``kept``), and whether it has to be refined (``live``); and whether any has."""
    pairs = rows.groupBy(*by, "s").agg((F.count(F.lit(1)) > 1).alias("kept"))
    pairs = ordered(pairs, [F.col(c) for c in (*by, "s")], "place", "rank-pairs")
    live = F.col("kept") & (F.size("s") > 0)
    joined = rows.join(pairs, [*by, "s"]).select("d", "n", "pos", "filled", F.concat(path, F.array("place")).alias("path"), "kept", live.alias("live"))
    return cut_counting(joined, "ranks", F.col("live"))


def suffixes(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``places`` (``d, n, pos, a, b, na, nb, filled`` where a repeated line stands, and the next
    line's ID) the suffixes whose first two lines recur, and those whose don't: ``d, n, pos, filled,
    path``."""
    no_line = F.expr(_NO_LINE)
    rows = places.withColumn("s", F.when(F.col("na").isNull(), no_line).otherwise(F.array("na", "nb"))).drop("na", "nb")
    (now, left), done, k = _doubled(rows, ["a", "b"], no_line), [], 2
    alone = now.filter("not kept")
    while left:
        live = now.filter("live")
        done.append(now.filter("not live"))
        every = reduce(DataFrame.union, [*done, live])
        ahead = every.select(F.col("d").alias("of"), (F.col("pos") - k).alias("before"), F.col("path").alias("after"))
        later = F.when(F.col("pos") + k >= F.col("n"), no_line)
        # A line that occurs once has no path: its suffix is unlike any other.
        later = later.otherwise(F.coalesce("after", F.array(-1 - F.col("d"), F.col("pos").cast("long"))))
        rows = live.join(ahead, (F.col("d") == F.col("of")) & (F.col("pos") == F.col("before")), "left")
        rows = cut(rows.select("d", "n", "pos", "filled", "path", F.element_at("path", -1).alias("g"), later.alias("s")), "later-ranks")
        (now, left), k = _doubled(rows, ["g"], F.col("path")), 2 * k
    columns = ["d", "n", "pos", "filled", "path"]
    # Of those done in the first round only the shared ones are wanted; later ones shared two lines before.
    first, rest = (done or [now])[0], [*done[1:], *([now] if done else [])]
    shared = reduce(DataFrame.union, [first.filter("kept"), *rest]).select(columns)
    return shared, alone.select(columns)


def suffix_array(docs: DataFrame, places: DataFrame, min_lines: int) -> DataFrame:
    """``d, n, pos, filled, r, lcp``: place in the suffix array, and lines in common with the suffix
    before it (0 if fewer than ``min_lines`` and two), of the suffixes that share a run with another."""
    shared, alone = suffixes(places)
    rows = shared if min_lines > 1 else shared.union(alone)
    rows = ranked(rows, [F.col("path"), F.col("d"), F.col("pos")], "r", "suffix-array")
    before = rows.select((F.col("r") + 1).alias("r"), F.col("d").alias("bd"), F.col("pos").alias("bp"), F.col("path").alias("bpath"))
    tied = F.coalesce(F.col("path") == F.col("bpath"), F.lit(False))
    levels = F.size(F.filter(F.zip_with("path", "bpath", lambda x, y: x.eqNullSafe(y)), lambda x: x))
    known = F.when(F.col("bpath").isNull() | (levels == 0), 0).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), levels))
    near = rows.join(before, "r", "left").select("d", "n", "pos", "filled", "r", "bd", "bp", tied.alias("tied"), known.alias("known"))
    follow = Window.partitionBy("d").orderBy("pos")
    firm = F.col("tied") | (F.col("known") > 0)
    step = lambda c, by: F.lead(c).over(follow) == F.col(c) + by
    linked = firm & F.lead(firm).over(follow) & step("pos", 1) & step("bd", 0) & step("bp", 1)
    near = near.withColumn("last", ~F.coalesce(linked, F.lit(False)))
    upto = follow.rowsBetween(0, Window.unboundedFollowing)
    near = cut(near.withColumn("end", F.first(F.when(F.col("last"), F.col("pos")), True).over(upto)), "neighbours")
    # What the ends of chains have in common beyond what is known to be equal.
    ends = near.filter("last and not tied and bd is not null").filter("known > 0" if min_lines > 1 else "true")
    names = docs.select("d", "names")
    ends = ends.join(names, "d").join(names.select(F.col("d").alias("bd"), F.col("names").alias("others")), "bd")
    size = F.greatest("known", F.lit(2)).cast("int")
    part = lambda c, at: F.slice(c, (F.col(at) + F.col("known") + 1).cast("int"), size)
    same = F.zip_with(part("names", "pos"), part("others", "bp"), lambda x, y: x["a"].eqNullSafe(y["a"]) & x["b"].eqNullSafe(y["b"]))
    ends = ends.select(F.col("d").alias("of"), F.col("pos").alias("at"), "known", same.alias("same"))
    more = F.array_position("same", False)
    ends = ends.select("of", "at", (F.col("known") + F.when(more > 0, more - 1).otherwise(F.size("same"))).alias("common"))
    lcp = F.when(F.col("tied"), F.col("n") - F.col("pos")).otherwise(F.coalesce(F.col("common") + F.col("end") - F.col("pos"), F.lit(0)))
    # A chain may end in a tie, too.
    tail = near.filter("last and tied").select(F.col("d").alias("of"), F.col("pos").alias("at"), (F.col("n") - F.col("pos")).cast("long").alias("common"))
    found = near.join(ends.union(tail), (F.col("d") == F.col("of")) & (F.col("end") == F.col("at")), "left")
    return cut(found.select("d", "n", "pos", "filled", "r", lcp.cast("long").alias("lcp")), "common-prefixes")


def intervals(array: DataFrame, min_lines: int) -> DataFrame:
    """``array`` with ``interval``: the place where its run of neighbours with at least ``min_lines``
    common lines begins.  A task sees a chunk of the array; chunks hand on one number each."""
    chunk = F.shiftright("r", CHUNK)
    begin = F.when(F.col("lcp") < min_lines, F.col("r"))
    rows = array.withColumn("chunk", chunk)
    inside = F.max(begin).over(Window.partitionBy("chunk").orderBy("r"))
    heads = rows.groupBy("chunk").agg(F.max(begin).alias("head"))
    heads = heads.select(F.col("chunk").alias("of"), F.max("head").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    rows = rows.withColumn("inside", inside).join(heads, F.col("chunk") == F.col("of"))
    return rows.withColumn("interval", F.coalesce("inside", "carried")).drop("chunk", "of", "inside", "carried")


def _places(docs: DataFrame) -> DataFrame:
    """Where lines stand that occur more than once: ``d, n, pos, a, b, na, nb, filled, long, first``
    (the earliest place of the line)."""
    after = lambda i, c: F.get(F.col("names"), i + 1)[c]
    items = F.transform("names", lambda x, i: F.struct(
        x["a"].alias("a"), x["b"].alias("b"), after(i, "a").alias("na"), after(i, "b").alias("nb"),
        F.get("filled", i).alias("filled"), F.get("long", i).alias("long"),
    ))
    lines = docs.select("d", "n", F.posexplode(items).alias("pos", "x")).select("d", "n", "pos", "x.*")
    counts = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("d", "pos")).alias("first"))
    counts = cut(counts.filter("c > 1").select("a", "b", "first"), "repeated-lines")
    return cut(lines.join(counts, ["a", "b"]), "repeated-places")


def later_copies(docs: DataFrame, min_lines: int, long_words: int | None) -> DataFrame:
    """``id, print, starts``: where runs start that also start earlier, and how many lines of them go."""
    places = _places(docs)
    array = cut(intervals(suffix_array(docs, places.drop("long", "first"), min_lines), min_lines), "intervals")
    here = F.struct("d", "pos")
    firsts = cut(array.groupBy("interval").agg(F.min(here).alias("first"), F.max(here).alias("last")).filter("first < last").select("interval", "first"), "firsts")
    later = array.filter("filled").join(firsts, "interval").filter(here > F.col("first")).select("d", "pos", F.lit(min_lines).alias("span"))
    if long_words is not None:
        later = later.union(places.filter("long").filter(here > F.col("first")).select("d", "pos", F.lit(1).alias("span")))
    later = later.groupBy("d").agg(F.collect_set(F.struct("pos", "span")).alias("starts"))
    return later.join(docs.select("d", "id", "print"), "d").select("id", "print", "starts")


def maximal_runs(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, print, pos, lines``: every run of at least ``min_lines`` lines that also starts elsewhere,
    is as long as it can be, and is not the rest of the run a line before."""
    named = line_names(docs, min_lines, None, id_col, text_col)
    array = suffix_array(named, _places(named).drop("long", "first"), min_lines)
    after = array.select((F.col("r") - 1).alias("r"), F.col("lcp").alias("next"))
    rows = array.join(after, "r", "left").select("d", "pos", F.greatest("lcp", F.coalesce("next", F.lit(0))).alias("lines")).filter(F.col("lines") >= min_lines)
    follow = Window.partitionBy("d").orderBy("pos")
    rest = (F.lag("pos").over(follow) == F.col("pos") - 1) & (F.lag("lines").over(follow) == F.col("lines") + 1)
    rows = rows.withColumn("rest", F.coalesce(rest, F.lit(False))).filter("not rest")
    return rows.join(named.select("d", "id", "print"), "d").select("id", "print", "pos", "lines")


def dedup_lines(
    docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = None,
    lines_out: str = "n_lines", removed_out: str = "n_removed",
) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from the text, and the counts
    ``n_lines`` (of the input) and ``n_removed``."""
    text = F.col(text_col)

    def found() -> DataFrame:
        return later_copies(line_names(docs, min_lines, long_words, id_col, text_col), min_lines, long_words)

    found = only(found, "line-runs").select(F.col("id").alias("__id"), F.col("print").alias("__print"), F.col("starts").alias("__starts"))
    kept = docs.drop(lines_out, removed_out)
    joined = kept.join(  # one plan at every size: texts are dealt by id, not met by a broadcast
        found.hint("merge"), F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__print")) & text.isNotNull(), "left"
    )
    lines = F.split(text, "\n")
    covered = F.array_distinct(F.flatten(F.transform("__starts", lambda s: F.sequence(s["pos"], s["pos"] + s["span"] - 1))))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__covered"))
    joined = joined.withColumn("__covered", covered).withColumn("__lines", lines)
    rest = F.array_join(F.transform(stay, lambda i: F.element_at("__lines", i + 1)), "\n")
    out = [F.when(F.col("__covered").isNull(), text).otherwise(rest).alias(c) if c == text_col else F.col(c) for c in kept.columns]
    return joined.select(
        *out,
        F.when(text.isNull(), 0).otherwise(F.size("__lines")).cast("long").alias(lines_out),
        F.when(F.col("__covered").isNull(), 0).otherwise(F.size("__covered")).cast("long").alias(removed_out),
    )
