"""Line deduplication with a tree of line templates.

A line goes down a tree of fixed depth: by its number of words, then by its first
``DEPTH`` words, with words that hold a digit as ``<*>``.  Within a leaf the rest of the
line is cut into up to ``SEGMENTS`` runs of words.  A run that occurs at its place in
several documents may be constant; one that does not is a variable field, ``<*>``.  A
template is a leaf with constant runs: all that may be, or any set of them, so that a
field whose values recur is still a field.  Templates that recur across documents, and
of which at least ``CONSTANT`` of the words are constant, are dropped in all documents
but the one with the least id.  Lines that are equal word for word need fewer documents.

All of it is grouping, joining and expressions of the JVM.  Lines are narrow rows of
numbers once they are parsed; texts are read again only to put the result together.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.text import SPACES, numbered, whole
from lakewarden.session import work_folder

DEPTH = 3
SEGMENTS = 4
CONSTANT = 0.6
MIN_WORDS = 5
MIN_DOCS = 3
# The place of a whole line among its runs.
WHOLE = SEGMENTS
# The query: fields may recur; equal lines need two documents, lines of fewer than MIN_WORDS words three.
ALL = {"wildcards": True, "same_docs": 2, "short_docs": 3}


def _words(line: Column) -> Column:
    """The words of a line in which blanks are the only spaces; splitting at one character takes no pattern."""
    return F.array_remove(F.split(line, " "), "")


def _masked(words: Column, digits: Column) -> Column:
    """The words, those with a digit as ``<*>``; no word is searched for one in vain."""
    return F.when(digits, F.transform(words, lambda w: F.when(w.rlike("[0-9]"), "<*>").otherwise(w))).otherwise(words)


def _width(n: Column) -> Column:
    """Words in each run but the last of a line."""
    return F.greatest(F.ceil((n - DEPTH) / SEGMENTS), F.lit(1)).cast("int")


def _lines(docs: DataFrame, id_col: str, text_col: str, constant: float, same: bool, short: bool) -> DataFrame:
    """doc_id, line (from 0), n (words), digits (whether a word holds one), runs (place and hash).

    Places from 0 are runs of the rest, hashed with leaf and place.  A short line is one
    run at place 0, if enough of its words are constant.  ``WHOLE`` is the place of all
    words as they stand, for lines in which words with a digit were made fields.
    """
    spaced = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), SPACES.replace(" ", "").replace("\n", ""), whole(text_col))
    lines = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                        F.posexplode(F.split(spaced, "\n")).alias("line", "text"))
    split = lines.select("doc_id", "line", _words(F.col("text")).alias("all"), F.col("text").rlike("[0-9]").alias("digits"))
    worded = split.select("*", _masked(F.col("all"), F.col("digits")).alias("words"))
    n, width = F.size("words"), _width(F.size("words"))
    long, digits = n >= MIN_WORDS, F.col("digits")
    leaf = F.xxhash64(n, F.slice("words", 1, DEPTH))
    runs = [F.when(long & (n > DEPTH + width * k), F.xxhash64(
        leaf, F.lit(k), F.slice("words", width * k + DEPTH + 1, width))) for k in range(SEGMENTS)]
    if short:
        fields = F.size(F.filter("words", lambda w: w == "<*>"))
        runs[0] = F.when(long, runs[0]).when(n - fields >= n * constant, F.xxhash64(n, F.lit(-1), "words"))
    if same:
        runs.append(F.when(digits & (long | F.lit(short)), F.xxhash64(
            n, F.lit(WHOLE), F.col("all"))))
    placed = F.filter(F.array(*[F.struct(F.lit(k).alias("place"), r.alias("run")) for k, r in enumerate(runs)]),
                      lambda r: r["run"].isNotNull())
    kept = worded.filter(long | F.lit(short) & (n > 0))
    return kept.select("doc_id", "line", n.alias("n"), digits.alias("digits"), placed.alias("runs"))


def _templates(parsed: DataFrame, min_docs: int, constant: float, wildcards: bool, same_docs: int | None,
               short_docs: int | None) -> DataFrame:
    """doc_id, line, template and the documents it needs: one row for each template of a line."""
    n = F.col("n")
    sizes = [F.least(_width(n), n - DEPTH - _width(n) * k) for k in range(SEGMENTS)]
    held = [F.col(f"r{k}").isNotNull() for k in range(SEGMENTS)]
    long, found = n >= MIN_WORDS, []
    for subset in range(1, 1 << SEGMENTS):
        inside = [k for k in range(SEGMENTS) if subset >> k & 1]
        fits = reduce(and_, [held[k] for k in inside]) & long & (
            reduce(add, [sizes[k] for k in inside]) + DEPTH >= n * constant)
        if not wildcards:
            fits = reduce(and_, [~held[k] for k in range(SEGMENTS) if k not in inside], fits)
        elif len(inside) > 1:
            # A set that fits without one of its runs recurs only where the smaller set does, and not before it.
            least = reduce(F.least, [sizes[k] for k in inside])
            fits = fits & (reduce(add, [sizes[k] for k in inside]) - least + DEPTH < n * constant)
        # A run's hash holds its leaf and place, so these name the set.
        found.append(F.when(fits, F.struct(F.xxhash64(*[f"r{k}" for k in inside]).alias("template"),
                                           F.lit(min_docs).alias("need"))))
    if short_docs is not None:
        found.append(F.when(~long & held[0], F.struct(F.col("r0").alias("template"), F.lit(short_docs).alias("need"))))
    if same_docs is not None:
        need = F.when(long, F.lit(same_docs)).otherwise(F.lit(short_docs)).alias("need")
        size = reduce(add, [F.when(h, x).otherwise(0) for h, x in zip(held, sizes)])
        found.append(F.when(F.col(f"r{WHOLE}").isNotNull(), F.struct(F.col(f"r{WHOLE}").alias("template"), need)).when(
            long & ~F.col("digits") & (size + DEPTH == n), F.struct(
                F.xxhash64(F.lit(WHOLE), *[f"r{k}" for k in range(SEGMENTS)]).alias("template"), need)))
    some = F.filter(F.array(*found), lambda t: t.isNotNull())
    return parsed.select("doc_id", "line", F.inline(some))


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    min_docs: int = MIN_DOCS, constant: float = CONSTANT, wildcards: bool = False,
                    same_docs: int | None = None, short_docs: int | None = None) -> DataFrame:
    """doc_id and line (from 0) of the lines whose template recurs, without each template's first document.

    By default a line has one template, of all its runs that two documents share, and
    lines of fewer than ``MIN_WORDS`` words are left alone.  With ``wildcards`` each set
    of one or more of those runs with enough words is a template.  A line that is equal
    word for word, digits included, in ``same_docs`` documents recurs, too.  Short lines
    recur in ``short_docs`` documents, equal but for words with a digit if enough words
    are without.  Null counts as empty; rows without an id are left alone.
    """
    spark, folder = docs.sparkSession, work_folder(docs.sparkSession, "lines")
    same_docs = short_docs if same_docs is None and short_docs is not None else same_docs
    _lines(docs, id_col, text_col, constant, same_docs is not None, short_docs is not None).filter(
        "doc_id is not null").write.parquet(f"{folder}/lines")
    lines = spark.read.parquet(f"{folder}/lines")
    # Line, digits and words of the line in one number: these narrow rows are all that moves.
    at = F.col("line") * F.lit(2 ** 32) + F.when(F.col("digits"), F.lit(2 ** 31)).otherwise(F.lit(0)) + F.col("n")
    runs = lines.select("doc_id", at.alias("at"), F.inline("runs"))
    fixed = runs.groupBy("run").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("run")
    grouped = runs.join(fixed, "run").groupBy("doc_id", "at").agg(*[
        F.max(F.when(F.col("place") == k, F.col("run"))).alias(f"r{k}") for k in range(WHOLE + 1)])
    parsed = grouped.select("doc_id", F.shiftright("at", 32).cast("int").alias("line"), (
        F.col("at") % 2 ** 31).cast("int").alias("n"), (F.col("at") % 2 ** 32 >= 2 ** 31).alias("digits"),
        *[f"r{k}" for k in range(WHOLE + 1)])
    # Stored: they are counted and joined.
    _templates(parsed, min_docs, constant, wildcards, same_docs, short_docs).write.parquet(f"{folder}/templates")
    templates = spark.read.parquet(f"{folder}/templates")
    held = templates.groupBy("template", "need", "doc_id").agg(F.lit(1).alias("x")).groupBy("template", "need").agg(
        F.count("*").alias("docs"), F.min("doc_id").alias("first")).filter(F.col("docs") >= F.col("need")).select(
        "template", "first")
    # Stored, too: a template that very many lines have is split only where this side is read.
    held.write.parquet(f"{folder}/held")
    held = spark.read.parquet(f"{folder}/held")
    return templates.join(held, "template").filter("doc_id <> first").select("doc_id", "line").distinct()


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All rows and columns, with the text less its recurring lines, and ``dropped_lines`` beside it.

    A null text stays null; a text of which all lines recur becomes empty.  Rows that
    repeat an id are one document.
    """
    gone = recurring_lines(docs, id_col, text_col, **options).distinct().groupBy("doc_id").agg(
        F.collect_list("line").alias("__lines")).withColumnRenamed("doc_id", "__id")
    rows, number, content = numbered(docs, id_col, text_col)
    joined = rows.join(gone, F.col(number).cast("long") == F.col("__id"), "left")
    # Exploding an array of one element holds the split text, so that each line is found without splitting again.
    held = joined.withColumn("__all", F.explode(F.array(
        F.when(F.col("__lines").isNotNull(), F.split(F.col(content), "\n")))))
    left = F.array_except(F.sequence(F.lit(0), F.size("__all") - 1), F.col("__lines"))
    text = F.when(F.col("__all").isNull(), F.col(content)).otherwise(
        F.array_join(F.transform(left, lambda k: F.get("__all", k)), "\n"))
    out = held.withColumn(content, text).withColumn("__dropped", F.when(F.col("__lines").isNull(), 0).otherwise(F.size("__lines")))
    others = [F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns) if c != "dropped_lines"]
    return out.select(*others, F.col("__dropped").alias("dropped_lines"))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, dropped_lines and the digest of what is left of each text; null counts as empty."""
    left = drop_recurring_lines(docs.select("doc_id", whole("text").alias("text"),
                                            F.size(F.split(whole("text"), "\n")).cast("long").alias("n_lines")), **ALL)
    return left.select("doc_id", "n_lines", F.col("dropped_lines").cast("long").alias("dropped_lines"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
