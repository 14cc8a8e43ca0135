"""Line deduplication by winnowing over line hashes (DataFrame functions only).

A document is the sequence of its lines' hashes (lines split at ``\\n``, blanks
at either end ignored).  Every window of ``min_lines`` lines selects the
smallest line hash in it as its fingerprint, so any run of at least
``min_lines`` equal lines in two places selects the same fingerprint at the
same offset in both.  Fingerprints that occur more than once are joined with
the windows that selected them; a window equal to an earlier one (smaller id,
or same document and earlier line) matches its first occurrence, and matches
are extended both ways over neighbouring windows into maximal runs.  Later runs
are deleted: a line goes if it lies in a run of ``min_lines`` lines that also
starts earlier.

With ``min_words`` a shorter run counts too when it holds that many words (or
``CHARS`` times as many characters, for writing without blanks), or when it is
a whole text that equals an earlier whole text; each such run is a window of its
own.  Without it, runs of fewer than ``min_lines`` lines stay.

Hot windows are counted by partial aggregation, and their occurrences are
spread over ``SALT`` join partitions.

Defined results: a null text has no lines and stays null; an empty text is one
empty line; rows with equal id and equal text are one document and treated
alike; a null id sorts first.  All columns but the text are passed through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.data import materialize

SALT = 16
CHARS = 8


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, key: str, text: str, min_lines: int) -> DataFrame:
    """``(doc, part, at, fp_at, fp, win)``: each window's start line, its
    fingerprint (leftmost smallest line hash) and the hash of all its lines.
    ``part`` is the text's hash, the tie-break between rows of one id."""
    hashed = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("part"),
                         F.transform(_lines(F.col(text)), lambda x: F.xxhash64(F.trim(x))).alias("h"))
    hashed = hashed.where(F.size("h") >= min_lines).dropDuplicates(["doc", "part"])
    got = hashed.select("doc", "part", "h", F.explode(F.sequence(F.lit(0), F.size("h") - min_lines)).alias("at"))
    one = [F.get("h", F.col("at") + i) for i in range(min_lines)]
    least = F.least(*one) if min_lines > 1 else one[0]
    offset = reduce(lambda rest, i: F.when(one[i] == least, i).otherwise(rest), range(min_lines - 1, -1, -1), F.lit(0))
    return got.select("doc", "part", "at", (F.col("at") + offset).alias("fp_at"), least.alias("fp"),
                      F.xxhash64(*one).alias("win"))


def short_windows(docs: DataFrame, key: str, text: str, min_lines: int, min_words: int) -> DataFrame:
    """``(doc, part, at, win, span)``: windows of ``span < min_lines`` lines that
    hold ``min_words`` words, or are a whole text with a word in it (its ``win``
    equals that of whole texts only)."""
    line = F.transform(_lines(F.col(text)), lambda x: F.trim(x))
    size = lambda x: F.greatest(F.size(F.filter(F.split(x, "\\s+"), lambda w: w != "")), F.floor(F.length(x) / CHARS))
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("part"), line.alias("ls")).where("ls is not null")
    rows = rows.select("doc", "part", F.transform("ls", lambda x: F.xxhash64(x)).alias("h"), F.transform("ls", size).alias("w"))

    def of(span: int) -> Column:
        def window(at):
            words = reduce(lambda a, b: a + b, [F.get("w", at + i) for i in range(span)])
            is_long, own = words >= min_words, [F.get("h", at + i) for i in range(span)]
            win = F.when(is_long, F.xxhash64(F.lit(span), *own)).when(
                (F.size("h") == span) & (words > 0), F.xxhash64(F.lit(-span), *own))
            return F.struct(at.alias("at"), win.alias("win"), F.lit(span).alias("span"))
        made = F.transform(F.sequence(F.lit(0), F.size("h") - 1), window)
        return F.filter(made, lambda r: (r["at"] + span <= F.size("h")) & r["win"].isNotNull())

    got = rows.select("doc", "part", F.explode(F.concat(*[of(k) for k in range(1, min_lines)])).alias("r"))
    return got.select("doc", "part", "r.at", "r.win", "r.span").distinct()


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = 3,
         min_words: int | None = None) -> DataFrame:
    """Repeated runs ``(doc, part, start, n_lines, source, source_line)``: lines
    ``start`` to ``start + n_lines - 1`` (from 0) of ``doc`` equal the lines from
    ``source_line`` on of the earlier occurrence ``source``.  Runs of one
    document may overlap when they come from different sources or are of
    different window sizes."""
    made = materialize(windows(docs, key, text, min_lines), "line-windows")
    # selected fingerprints, one row per position whatever the number of windows that chose it
    chosen = made.select("doc", "part", "fp_at", "fp").distinct()
    again = chosen.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp")
    near = made.join(_salted(again), [F.col("fp") == F.col("fp_"), _salt("at", "part") == F.col("salt")]).drop("fp_", "salt")
    near = near.select("doc", "part", "at", "win", F.lit(min_lines).alias("span"))
    if min_words is not None and min_lines > 1:
        near = near.union(materialize(short_windows(docs, key, text, min_lines, min_words), "line-short-windows"))
    first = (near.groupBy("win").agg(F.min(F.struct("doc", "part", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select(F.col("win").alias("win_"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")))
    match = near.join(first, [F.col("win") == F.col("win_"), _salt("at", "part") == F.col("salt")])
    match = match.where(F.struct("doc", "part", "at") != F.col("first")).select(
        "doc", "part", "at", "span", "first", (F.col("at") - F.col("first.at")).alias("shift"))
    # extend both ways: neighbouring windows matched to the same source at the same shift are one run
    by = Window.partitionBy("doc", "part", "first.doc", "first.part", "shift", "span").orderBy("at")
    island = match.withColumn("island", F.col("at") - F.row_number().over(by))
    return (island.groupBy("doc", "part", F.col("first.doc").alias("source"), F.col("first.part").alias("source_part"),
                           "shift", "span", "island")
            .agg(F.min("at").alias("start"), (F.max("at") - F.min("at") + F.col("span")).alias("n_lines"))
            .select("doc", "part", "start", "n_lines", "source", (F.col("start") - F.col("shift")).alias("source_line")))


def _salt(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALT)).cast("int")


def _salted(keys: DataFrame) -> DataFrame:
    return keys.select(F.col("fp").alias("fp_"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = 3,
                        prefix: str = "", min_words: int | None = None) -> DataFrame:
    """``docs`` with the later repeated runs deleted from ``text``, plus
    ``n_lines``, ``n_removed`` (lines) and ``n_runs`` (maximal removed runs), each
    name after ``prefix``; columns of ``docs`` with these names are replaced."""
    found = runs(docs, key, text, min_lines, min_words).select("doc", "part", "start", (F.col("start") + F.col("n_lines")).alias("end"))
    by = Window.partitionBy("doc", "part").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    joined = (found.withColumn("fresh", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
              .withColumn("run", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy("doc", "part", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")))
    gone = joined.groupBy("doc", "part").agg(F.collect_list(F.struct("start", "end")).alias("lines__gone"))
    gone = gone.select(F.col("doc").alias("lines__doc"), F.col("part").alias("lines__part"), "lines__gone")
    made = [f"{prefix}{c}" for c in ("n_lines", "n_removed", "n_runs")]
    own = [c for c in docs.columns if c not in made]
    got = docs.select(*own, F.xxhash64(text).alias("lines__own"))
    got = got.join(gone, [F.col(key).eqNullSafe(F.col("lines__doc")), F.col("lines__own") == F.col("lines__part")], "left")
    # removed positions as one set, then one look-up a kept line: linear in lines, whatever the number of runs
    got = got.withColumn("lines__own", _lines(F.col(text)))
    removed = F.flatten(F.transform("lines__gone", lambda r: F.sequence(r["start"], r["end"] - 1)))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines__own") - 1), removed)
    kept = F.transform(left, lambda i: F.get("lines__own", i))
    n_removed = F.aggregate("lines__gone", F.lit(0), lambda n, r: n + r["end"] - r["start"])
    untouched = F.col("lines__gone").isNull()
    return got.select(
        *[F.when(untouched, F.col(text)).otherwise(F.concat_ws("\n", kept)).alias(text) if c == text
          else F.col(c) for c in own],
        F.when(F.col(text).isNull(), 0).otherwise(F.size("lines__own")).cast("long").alias(made[0]),
        F.coalesce(n_removed, F.lit(0)).cast("long").alias(made[1]),
        F.when(untouched, 0).otherwise(F.size("lines__gone")).cast("long").alias(made[2]))
