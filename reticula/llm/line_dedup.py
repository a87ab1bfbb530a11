"""Line deduplication by content-defined chunks of lines. DataFrame functions only.

Lines are hashed.  A document is cut into chunks of lines where a rolling hash over the last
lines' hashes hits a residue, so a boundary depends on nearby content only and moves along when
text is inserted before it.  Chunks are compared globally by hash, then byte by byte.  A run of
adjacent chunks that all stood somewhere before (smaller id) is removed if it has at least
``min_words`` words; the first occurrence stays.

A repeated passage need not have chunk boundaries at its own ends.  So the shortest passages of ``min_words`` words
are compared too: from each line on and up to each line.  Every repeated passage of so many
words is the union of such ones.  Those that the runs of chunks don't cover are removed as well.

Documents are cut and looked up by narrow rows of hashes; the text is shuffled twice, for
the byte comparison and for the removal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import drop
from .common import cut, join_counted

#: Lines in the rolling hash; one boundary in so many lines; least words of what is removed.
WINDOW, DIVISOR, MIN_WORDS = 2, 4, 50


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _words(line: Column) -> Column:
    """White space characters + 1, for a line that has any text: never less than the words."""
    inner = F.trim(line)
    return F.when(inner == "", 0).otherwise(F.length(inner) - F.length(F.translate(inner, " \t\r\x0b\x0c", "")) + 1)


def chunks(docs: DataFrame, min_words: int, window: int, divisor: int) -> DataFrame:
    """(id, row, lo, hi, before, upto, passage, words, key) of every chunk and shortest passage.

    Lines lo to hi of a document, ``key`` their hash; the document has ``before`` words ahead
    of them and ``upto`` words to their end.
    """
    lines = cut(docs.select("id", "row", F.posexplode(F.transform(_lines(F.col("text")), lambda x: F.struct(F.xxhash64(x).alias("h"), _words(x).cast("int").alias("w")))).alias("i", "line"))
                .select("id", "row", "i", "line.h", "line.w"))
    if not lines.where("i = 0").groupBy("id", "row").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        lines = lines.dropDuplicates(["id", "row", "i"])  # rows equal in id and text are one document
    order = Window.partitionBy("id", "row").orderBy("i")
    rolling = F.lit(0).cast("long")
    for k in range(window):  # hash of the last lines, in order
        rolling = F.xxhash64(rolling, F.coalesce(F.lag("h", window - 1 - k).over(order), F.lit(0)))
    numbered = lines.withColumn("upto", F.sum("w").over(order)).withColumn("_ends", F.pmod(rolling, F.lit(divisor)) == 0)
    numbered = numbered.withColumn("_chunk", F.sum(F.coalesce(F.lag("_ends").over(order), F.lit(True)).cast("int")).over(order))
    # A line's place in its chunk goes into the key, so that their order counts; no list is built, however long a chunk is.
    inside = Window.partitionBy("id", "row", "_chunk").orderBy("i")
    numbered = numbered.withColumn("_at", F.row_number().over(inside))
    cut_up = (numbered.groupBy("id", "row", "_chunk")
              .agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.min(F.col("upto") - F.col("w")).alias("before"), F.max("upto").alias("upto"),
                   F.lit(False).alias("passage"), F.sum("w").alias("words"), F.bit_xor(F.xxhash64("_at", "h")).alias("key"))
              .drop("_chunk"))
    return cut_up.union(_passages(lines, min_words))


def _passages(lines: DataFrame, min_words: int) -> DataFrame:
    """Shortest passages of ``min_words`` words from each line on and up to each line, as rows of ``chunks``; blank lines don't count."""
    doc = Window.partitionBy("id", "row")
    # Frames hold at most min_words lines, as each has a word.
    solid = lines.where("w > 0").withColumn("upto", F.sum("w").over(doc.orderBy("i"))).withColumn("before", F.col("upto") - F.col("w"))
    seen = F.collect_list(F.struct("i", "h", "w", "before", "upto"))
    both = solid.select("id", "row", seen.over(doc.orderBy("before").rangeBetween(0, min_words - 1)).alias("on"),
                        seen.over(doc.orderBy("upto").rangeBetween(1 - min_words, 0)).alias("back"))
    first, last = lambda c: F.element_at(c, 1), lambda c: F.element_at(c, -1)
    # Those shortest from both ends are listed once.
    same = last("back")["before"] - first("back")["before"] < min_words
    listed = both.select("id", "row", F.explode(F.array(F.col("on"), F.when(~same, F.col("back")))).alias("z")).where("z is not null")
    words = last("z")["upto"] - first("z")["before"]
    return listed.where(words >= min_words).select(
        "id", "row", first("z")["i"].alias("lo"), last("z")["i"].alias("hi"), first("z")["before"].alias("before"), last("z")["upto"].alias("upto"),
        F.lit(True).alias("passage"), words.alias("words"), F.xxhash64(F.col("z.h")).alias("key"))


def _content(lines: Column, spot: Column) -> Column:
    own = F.slice(lines, spot["lo"] + 1, spot["hi"] - spot["lo"] + 1)
    return F.array_join(F.when(spot["passage"], F.filter(own, lambda x: F.trim(x) != "")).otherwise(own), "\n")


def _with_lines(text: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the lines of a text, which is split once (bound as a variable) and not for each use."""
    return F.element_at(F.transform(F.array(_lines(text)), body), 1)


def _apart() -> Column:
    """No line is shared with the first occurrence."""
    return ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("row") == F.col("first.row")) & (F.col("lo") <= F.col("first.hi")))


def _contents(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(passage, key, place, content) of the chunks ``found``: the one join with the texts."""
    spots = found.groupBy("id", "row").agg(F.collect_set(F.struct("lo", "hi", "passage", "key", "place")).alias("spots"))
    texts = docs.join(spots, docs["id"].eqNullSafe(spots["id"]) & (docs["row"] == spots["row"]))
    each = _with_lines(F.col("text"), lambda lines: F.transform("spots", lambda s: F.struct(s["passage"].alias("passage"), s["key"].alias("key"), s["place"].alias("place"), _content(lines, s).alias("content"))))
    return texts.select(F.explode(each).alias("s")).select("s.*")


def _same_bytes(docs: DataFrame, found: DataFrame, marked: DataFrame) -> DataFrame:
    """Of the later occurrences, those that equal an earlier one of their key byte by byte.

    ``found`` has the later occurrences and the first one of each key.  Where a key has several
    contents, each content has a first occurrence of its own, sought among all of the key.
    """
    groups = cut(_contents(docs, found).groupBy("passage", "key", "content").agg(F.count("*").alias("n")).select("passage", "key", F.sha2("content", 256).alias("_sha")))
    clash = groups.groupBy("passage", "key").agg(F.count("*").alias("n")).where("n > 1").select("passage", "key")
    later = found.where("place <> first")
    if clash.isEmpty():
        return later
    every = _contents(docs, marked.join(clash, ["passage", "key"], "left_semi"))
    own = every.withColumn("own", F.min("place").over(Window.partitionBy("passage", "key", "content"))).select("passage", "place", "own")
    there = (marked.join(clash, ["passage", "key"], "left_semi").join(own, ["passage", "place"]).withColumn("first", F.col("own"))
             .where("place <> first").where(~F.col("passage") | _apart()).select(*found.columns))
    return later.join(clash, ["passage", "key"], "left_anti").select(*found.columns).union(there)


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                  window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """(id, row, spans): the line ranges to remove, by document; ``row`` is the text's hash."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    source = source.select("id", F.xxhash64("text").alias("row"), "text")
    every = cut(chunks(source, min_words, window, divisor))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row", "lo", "hi")
    every = every.withColumn("place", place)
    keys = cut(every.where("words > 0").groupBy("passage", "key").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1"))
    marked = cut(join_counted(every, keys, ["passage", "key"], "n", "left").drop("n")
                 .withColumn("later", F.coalesce(F.col("place") != F.col("first"), F.lit(False)) | (F.col("words") == 0)).where("later or first is not null"))
    drop(every, keys)
    columns = ["id", "row", "lo", "hi", "before", "upto", "words", "passage", "key", "place", "first"]
    later = cut(_runs(marked.where("not passage"), min_words).where("keep_run").select(*columns, "run"))
    # Passages that are repeated, apart from their first occurrence and not inside the runs.
    runs = later.groupBy("id", "row", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).alias("r")
    rest = marked.where("passage and later").where(_apart()).select(*columns).alias("p")
    inside = (F.col("p.id").eqNullSafe(F.col("r.id")) & (F.col("p.row") == F.col("r.row")) & (F.col("p.lo") >= F.col("r.lo")) & (F.col("p.hi") <= F.col("r.hi")))
    later = cut(later.drop("run").union(rest.join(runs, inside, "left_anti")))
    # The first occurrences of those keys, for the comparison.
    wanted = later.where("first is not null").select("passage", "key").distinct()
    firsts = marked.where("place = first").join(wanted, ["passage", "key"], "left_semi").select(*columns)
    found = cut(later.where("first is not null").union(firsts))
    extent = ["id", "row", "lo", "hi", "before", "upto", "words", "passage"]
    checked = cut(_same_bytes(source, found, marked).select(*extent))
    blank = later.where("first is null").select(*extent)
    # Removal after the comparison: runs are found anew, since a chunk may have dropped out.
    runs = _runs(checked.where("not passage").union(blank).withColumn("later", F.lit(True)), min_words).where("keep_run").groupBy("id", "row", "run").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("before").alias("before"), F.max("upto").alias("upto"))
    return _spans(runs.drop("run").union(checked.where("passage").select("id", "row", "lo", "hi", "before", "upto")))


def _spans(ranges: DataFrame) -> DataFrame:
    """(id, row, spans): ranges of lines that overlap or touch in one."""
    order = Window.partitionBy("id", "row").orderBy("lo")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = ranges.withColumn("_fresh", F.coalesce(F.col("lo") > reach + 1, F.lit(True)).cast("int")).withColumn("_span", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("id", "row", "_span").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.max("upto") - F.min("before")).alias("words"))
    return merged.groupBy("id", "row").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "words"))).alias("spans"))


def _runs(marked: DataFrame, min_words: int) -> DataFrame:
    """Rows of ``marked`` with ``later``, in maximal runs of adjacent chunks: ``run`` and ``keep_run``."""
    later = marked.where("later")
    order = Window.partitionBy("id", "row").orderBy("lo")
    fresh = F.coalesce(F.lag("hi").over(order) + 1 != F.col("lo"), F.lit(True)).cast("int")
    numbered = later.withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(order)).drop("_fresh")
    return numbered.withColumn("keep_run", F.sum("words").over(Window.partitionBy("id", "row", "run")) >= min_words)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """Remove repeated runs of lines; the first occurrence (smallest id, then text hash, then line) stays.

    Returns a row per row: the id, ``n_lines``, ``removed_lines``, ``removed_words``,
    ``spans`` (array of lo, hi, words; lines counted from 0) and ``text``, what is left.

    Cases: a null text stays null and has no lines; blank lines alone are never removed, but
    go with the repeated lines around them; a text may become empty; rows equal in id and
    text are one document and lose the same lines; a null id ranks last; a text of any length,
    or one line without end, is read whole; an empty table gives no rows.  Other columns are
    ignored.
    """
    if window < 1 or divisor < 1 or min_words < 1:
        raise ValueError("window, divisor and min_words must be at least 1")
    spans = repeated_runs(docs, id_col, text_col, min_words, window, divisor)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_row"), F.col(text_col).cast("string").alias("_text"))
    joined = rows.join(spans, rows["_id"].eqNullSafe(spans["id"]) & (rows["_row"] == spans["row"]), "left")
    # What is left: the stretches of lines between the spans.
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["hi"] + 1))
    stops = lambda lines: F.concat(F.transform("spans", lambda s: s["lo"]), F.array(F.size(lines)))
    between = lambda lines: F.array_join(F.flatten(F.zip_with(starts, stops(lines), lambda a, b: F.slice(lines, a + 1, b - a))), "\n")
    left = F.when(F.col("spans").isNull(), F.col("_text")).otherwise(_with_lines(F.col("_text"), between))
    total = lambda f: F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + f(s)), F.lit(0).cast("long"))
    count = F.when(F.col("_text").isNull(), 0).otherwise(F.length("_text") - F.length(F.replace(F.col("_text"), F.lit("\n"))) + 1)
    return joined.select(F.col("_id").alias(id_col), count.cast("long").alias("n_lines"), total(lambda s: s["hi"] - s["lo"] + 1).alias("removed_lines"),
                         total(lambda s: s["words"]).alias("removed_words"), F.coalesce("spans", F.expr("cast(array() as array<struct<lo: int, hi: int, words: bigint>>)")).alias("spans"), left.alias("text"))
