"""Line dedup over levelled sorted runs of line hashes, in DataFrame functions alone.

A run is a table of keys (128 bits of hash), hash-partitioned and sorted by key and written as a checkpoint. A batch of
documents is reduced to its keys first, one row a key however often it occurs. The batch is anti-joined with each run by
merging, as both are sorted alike; keys that no run holds are new and get their keeper, the greatest document of the batch that
holds them, while keys that are there already only add to the counts. Then the batch's own run joins level 0. When a level
has `fanout` runs they are compacted into one run of the next level, so a key is rewritten once a level and a batch meets a
logarithmic number of runs.

Whether a line goes depends on counts over all batches, so documents are judged by the compacted runs at the end. A key that holds
a thousandth of all lines or more (there are a thousand at most) is broadcast to the lines; all others meet them by merging.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, materialize, parts, row_key

KEY = ["h1", "h2"]
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key with at least this share of all lines is broadcast, so at most 1 / HOT keys are.
HOT = 0.001


def lines_of(text: Column) -> Column:
    """The text cut at each newline; null or empty: one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40) -> DataFrame:
    """ROW_KEY and `keys` of each row with lines of at least min_chars code points: the lines' hashes and places (h1, h2, pos),
    sorted. White space at a line's ends and the case of A to Z don't count."""
    long_lines = F.filter(F.transform(lines_of(F.col(f"`{text_col}`")), lambda x, i: F.struct(F.btrim(x, F.lit(SPACE)).alias("x"), i.alias("pos"))), lambda s: F.char_length(s["x"]) >= min_chars)
    folded = F.transform(long_lines, lambda s: F.struct(F.translate(s["x"], UPPER, LOWER).alias("x"), s["pos"].alias("pos")))
    keys = F.sort_array(F.transform(folded, lambda s: F.struct(F.xxhash64(s["x"]).alias("h1"), F.xxhash64(F.lit(7), s["x"]).alias("h2"), s["pos"].alias("pos"))))
    return docs.select(*[c.alias(n) for n, c in row_key(id_col, text_col).items()], keys.alias("keys")).where(F.size("keys") > 0)


def _counted(rows: DataFrame) -> DataFrame:
    """One row a key: documents and lines that hold it, and the greatest document (null ids are least)."""
    with_size = rows.withColumn("__size", F.size("keys"))

    def first(x: Column, i: Column) -> Column:
        before = F.get("keys", i - 1)
        return (i == 0) | (x["h1"] != before["h1"]) | (x["h2"] != before["h2"])

    starts = with_size.withColumn("__starts", F.filter(F.transform("keys", lambda x, i: F.when(first(x, i), i)), lambda i: i.isNotNull()))
    each = F.transform("__starts", lambda i, k: F.struct(F.get("keys", i)["h1"].alias("h1"), F.get("keys", i)["h2"].alias("h2"), (F.coalesce(F.get("__starts", k + 1), F.col("__size")) - i).cast("long").alias("lines")))
    flat = starts.select("__n", "__id", F.explode(each).alias("x")).select(F.when(~F.col("__n"), F.col("__id")).alias("id"), "x.*")
    return flat.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.sum("lines").alias("n_lines"), F.max("id").alias("keeper"))


class LineRuns:
    """An index of line keys in levelled sorted runs: h1, h2, n_docs, n_lines, keeper and whether the run brought the key in.

    Runs of one index have equal numbers of partitions, so batches are shuffled to them and they are never shuffled again.
    """

    def __init__(self, fanout: int = 3) -> None:
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def _sorted(self, keys: DataFrame) -> DataFrame:
        """A run. It is made by a plan that isn't adaptive, as the checkpoint of an adaptive one doesn't know that it is partitioned
        and sorted and would be shuffled and sorted again for each batch."""
        spark = keys.sparkSession
        adaptive = spark.conf.get("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            return materialize(keys.repartition(parts(spark), *KEY).sortWithinPartitions(*KEY))
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of keys that no run holds, by merge anti-joins."""
        for run in self.runs():
            keys = keys.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        return keys

    def add(self, rows: DataFrame) -> DataFrame:
        """Adds a batch of line_keys() as a run of its own and returns the run. A key that came with an earlier batch keeps the
        keeper that it has there."""
        if self.runs():
            keys = self._sorted(_counted(rows))
            new = self.unseen(keys.select(*KEY)).withColumn("__new", F.lit(True))
            keys = keys.join(new.hint("merge"), KEY, "left").select(*KEY, "n_docs", "n_lines", F.when(F.col("__new"), F.col("keeper")).alias("keeper"), F.coalesce("__new", F.lit(False)).alias("new"))
        else:
            keys = _counted(rows).withColumn("new", F.lit(True))
        run = self._sorted(keys)
        self._put(run, 0)
        return run

    def _put(self, run: DataFrame, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._sorted(_merged(self.levels[level]))
            self.levels[level] = []
            self._put(merged, level + 1)

    def whole(self) -> DataFrame:
        """One row a key over all runs."""
        return _merged(self.runs())


def _merged(runs: list[DataFrame]) -> DataFrame:
    both = runs[0]
    for r in runs[1:]:
        both = both.unionByName(r)
    return both.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_lines").alias("n_lines"), F.max(F.when(F.col("new"), F.col("keeper"))).alias("keeper"), F.max("new").alias("new"))


def _batches(rows: DataFrame, n: int) -> list[DataFrame]:
    """Rows in n batches of falling ids, cut at quantiles (n numbers at the driver); null ids come last."""
    cuts = rows.where(~F.col("__n")).agg(F.percentile_approx("__id", [i / n for i in range(n - 1, 0, -1)], 1000 * n).alias("q")).first()["q"] if n > 1 else []
    cuts, above, out = list(dict.fromkeys(cuts or [])), F.lit(True), []
    for cut in cuts:
        out.append(rows.where(above & ~F.col("__n") & (F.col("__id") > cut)))
        above = F.col("__id") <= cut
    return [*out, rows.where(F.col("__n") | above)]


def _marked(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """ROW_KEY and the places of the lines that go. rows: line_keys(); repeated: materialized keys with n_lines, keeper and
    kept, whether the keeper's lines stay."""
    total = rows.agg(F.sum(F.size("keys"))).first()[0] or 0
    hot = F.col("n_lines") >= max(1.0, HOT * total)
    lines = rows.select(*ROW_KEY, F.explode("keys").alias("x")).select(*ROW_KEY, "x.*")
    common = F.broadcast(repeated.where(hot).select(*KEY, "keeper", "kept", F.lit(True).alias("__hot")))  # 1 / HOT rows at most
    lines = lines.join(common, KEY, "left")
    rest = lines.where("__hot is null").drop("keeper", "kept").join(repeated.where(~hot).select(*KEY, "keeper", "kept"), KEY)
    found = lines.where("__hot").unionByName(rest)
    own = F.when(~F.col("__n"), F.col("__id"))
    return found.where(~(F.col("kept") & own.eqNullSafe(F.col("keeper")))).groupBy(*ROW_KEY).agg(F.collect_set("pos").alias("__gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3) -> DataFrame:
    """docs, with text_col less its repeated lines and two more columns, n_lines (before) and n_dropped.

    A line of at least min_chars code points (white space at its ends and the case of A to Z don't count) that is found in at least
    min_docs documents stays only in the document of greatest id that holds it, there as often as it stands there. Each row
    is a document; rows of equal greatest ids all keep the line. Null ids are less than all others. A null or empty text is
    one empty line; the text is then empty. Empty table: no rows. Columns named like the new ones are replaced. The number of
    batches and the fan-out change the work, not the result.
    """
    rows = materialize(line_keys(docs, id_col, text_col, min_chars))
    runs = LineRuns(fanout)
    for batch in _batches(rows, batches):
        runs.add(batch)
    return without_lines(docs, _marked(rows, materialize(runs.whole().where(F.col("n_docs") >= min_docs).withColumn("kept", F.lit(True)))), id_col, text_col)


def drop_seen(docs: DataFrame, runs: LineRuns, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40) -> DataFrame:
    """The next batch of a growing corpus: docs without the lines that earlier batches hold or that a row of greater id in
    this batch holds. The batch's keys are then in runs, too. Columns and edge cases as of line_dedup."""
    rows = materialize(line_keys(docs, id_col, text_col, min_chars))
    return without_lines(docs, _marked(rows, runs.add(rows).withColumn("kept", F.col("new"))), id_col, text_col)


def without_lines(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the lines at the places `__gone` of each ROW_KEY; texts are shuffled once, by row."""
    keyed = docs.drop("n_lines", "n_dropped").withColumns(row_key(id_col, text_col)).join(gone, ROW_KEY, "left")
    cut = keyed.withColumn("__lines", lines_of(F.col(f"`{text_col}`")))
    places = F.sequence(F.lit(0), F.size("__lines") - 1)
    cut = cut.withColumn("__kept", F.array_except(places, F.coalesce("__gone", F.array().cast("array<int>"))))
    text = F.array_join(F.transform("__kept", lambda i: F.get("__lines", i)), "\n")
    n_lines, n_dropped = F.size("__lines").cast("long"), (F.size("__lines") - F.size("__kept")).cast("long")
    others = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return cut.select(*others, n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))
