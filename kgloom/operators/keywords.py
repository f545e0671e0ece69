"""Keywords, their frequencies and their co-occurrence."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp
from .iterate import materialize, with_row


#: Bytes of ASCII: those of no word become spaces.
_APART = bytes(c if chr(c).isalnum() and c < 128 or c == 95 else 32 for c in range(256))
_WORD, _WORD_OR_HANGUL = re.compile("[A-Za-z0-9_]+"), re.compile("[A-Za-z0-9_가-힣]+")


def _words(text: str, other: re.Pattern = _WORD) -> list[str]:
    """Words of more than two characters, in order, repeats included; of ASCII, or as `other` has them."""
    found = text.encode().translate(_APART).decode().split() if text.isascii() else other.findall(text)
    return [w for w in found if len(w) > 2]


def _ranked(docs: DataFrame, id_col: str, text_col: str, best: Callable[[list[str]], list[tuple]], columns: str, kind: pa.DataType) -> DataFrame:
    """(id_col, keyword, a number, rank): what `best` names of each document's lower-case texts. Documents are dealt and sorted by id,
    as several rows may hold one's texts, and counted one by one, so a task holds the counts of one document alone."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(done: list[tuple]) -> pa.RecordBatch:
            rows = [(i, *x, r) for i, texts in done for r, x in enumerate(best(texts), 1)]
            return pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], t) for n, t in enumerate((id_kind, pa.string(), kind, pa.int32()))], names)

        at, id_kind, names = None, None, [id_col, *(c.split()[0] for c in columns.split(", "))]
        for b in batches:
            id_kind, done = b.schema.field(0).type, []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if at is None or at[0] != i:
                    done += [at] if at else []
                    at = (i, [])
                at[1].append(text)
            yield told(done)
        if at:
            yield told([at])

    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("__text")
    return docs.repartition(id_col).sortWithinPartitions(id_col).select(id_col, text).mapInArrow(run, f"`{id_col}` {id_type}, {columns}")


def _commonest(lists: list[list[str]], k: int) -> list[tuple[str, int]]:
    """The k most frequent words of a document's lists with their numbers, of equal ones those that stand earlier in a list."""
    if len(lists) == 1:
        return Counter(lists[0]).most_common(k)
    n, first = Counter(), {}
    for ws in lists:
        n.update(ws)
        for at, w in enumerate(ws):
            first[w] = min(first.get(w, at), at)
    return sorted(n.items(), key=lambda x: (-x[1], first[x[0]], x[0]))[:k]


def top_keywords(docs: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, keyword, n, rank): each document's k most frequent lower-case words of more than two ASCII word characters, earlier ones
    first of equal ones."""
    return _ranked(docs, id_col, text_col, lambda texts: _commonest([_words(t) for t in texts], k), "keyword string, n long, rank int", pa.int64())


def weighted_keywords(docs: DataFrame, stopwords: list[str], k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, keyword, score, rank): words without stopwords and pure digits, and pairs of neighbours among the kept
    words (6 to 29 characters) at eight tenths of a word's weight. Hangul counts as letters."""
    stop = frozenset(stopwords)

    def best(texts: list[str]) -> list[tuple[str, float]]:
        kept = [[w for w in _words(t, _WORD_OR_HANGUL) if w not in stop and not w.isdigit()] for t in texts]
        pairs = [[f"{a} {b}" for a, b in pairwise(ws) if 5 < len(a) + 1 + len(b) < 30] for ws in kept]
        both = [(w, float(n)) for w, n in _commonest(kept, k)] + [(p, round(0.8 * n, 6)) for p, n in _commonest(pairs, k)]
        return sorted(both, key=lambda x: -x[1])[:k]

    return _ranked(docs, id_col, text_col, best, "keyword string, score double, rank int", pa.float64())


def field_keywords(field: Column) -> Column:
    """Keywords of a list field: cut at commas, semicolons and bars, trimmed, lower case, more than two characters."""
    return F.filter(F.transform(F.split(F.coalesce(field, F.lit("")), r"[,;|]"), lambda x: F.lower(F.trim(x))), lambda x: F.char_length(x) > 2)


def label_keywords(nodes: DataFrame, k: int = 20) -> DataFrame:
    """The k commonest words of more than two characters in labels, with their frequency per node."""
    w = nodes.select(F.explode(F.split(F.lower("label"), " ")).alias("keyword")).where(F.char_length("keyword") > 2)
    total = nodes.agg(F.count("*").alias("total"))
    n = w.groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(k)
    return with_row(n, total).select("keyword", "n", (F.col("n") / F.col("total")).alias("score"))


def paper_keywords(papers: DataFrame, max_keywords: int = 10, text_keywords: bool = True) -> DataFrame:
    """(paper_ix, keyword), distinct: the keyword field's, and the most frequent words of title and abstract."""
    field = papers.select("paper_ix", F.explode(field_keywords(F.col("keywords"))).alias("keyword")) if "keywords" in papers.columns else None
    text = None
    if text_keywords:
        body = papers.select("paper_ix", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))).alias("text"))
        text = top_keywords(body, max_keywords, "paper_ix").select("paper_ix", "keyword")
    both = field if text is None else text if field is None else field.unionByName(text)
    return both.distinct()


def keyword_nodes(paper_kw: DataFrame, papers: DataFrame, min_frequency: int = 2) -> DataFrame:
    """(keyword, n, size, first_titles): papers per keyword, its size (five per paper, 10 to 50), five titles."""
    n = paper_kw.groupBy("keyword").agg(F.count("*").alias("n"), F.min("paper_ix").alias("first_paper")).where(F.col("n") >= min_frequency)
    rank = F.row_number().over(Window.partitionBy("keyword").orderBy("paper_ix"))
    titles = paper_kw.withColumn("rn", rank).where("rn <= 5").join(papers.select("paper_ix", "title"), "paper_ix").groupBy("keyword").agg(F.transform(F.array_sort(F.collect_list(F.struct("paper_ix", "title"))), lambda x: x["title"]).alias("first_titles"))
    return n.join(titles, "keyword").select("keyword", "n", clamp(F.col("n") * 5.0, 10.0, 50.0).alias("size"), "first_titles")


def cooccurrence(paper_kw: DataFrame, min_frequency: int = 2) -> DataFrame:
    """(a, b, weight): pairs of keywords in one paper, a < b, with the number of papers. Pairs are made inside each
    paper's bounded keyword list and summed before the shuffle."""
    paper_kw = materialize(paper_kw)
    common = paper_kw.groupBy("keyword").agg(F.count("*").alias("n")).where(F.col("n") >= min_frequency).select("keyword")
    lists = paper_kw.join(common, "keyword").groupBy("paper_ix").agg(F.array_sort(F.collect_set("keyword")).alias("ks"))
    pairs = F.flatten(F.transform("ks", lambda a, i: F.transform(F.slice("ks", i + 2, F.size("ks")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return lists.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("weight"))


def keyword_graph(papers: DataFrame, max_keywords: int = 10, min_frequency: int = 2):  # noqa: ANN201
    """Keywords as nodes and their co-occurrence as edges."""
    from .graph import Graph

    kw = materialize(paper_keywords(papers, max_keywords))
    n = keyword_nodes(kw, papers, min_frequency)
    nodes = n.select(F.concat(F.lit("keyword_"), F.regexp_replace("keyword", r"\s+", "_")).alias("id"), F.col("keyword").alias("label"), "size", F.lit("keyword").alias("type"), F.col("n").alias("frequency"), "first_titles")
    key = lambda c: F.concat(F.lit("keyword_"), F.regexp_replace(c, r"\s+", "_"))
    edges = cooccurrence(kw, min_frequency).select(key("a").alias("src"), key("b").alias("dst"), F.col("weight").cast("double").alias("weight"), F.lit("CO_OCCURS").alias("relationship_type"))
    return Graph(nodes, edges)


def field_graph_nodes(papers: DataFrame, last_year: int) -> DataFrame:
    """(id, kind, label, frequency, citations, first_year, last_year, size): keywords, authors and journals of papers."""
    year = F.when(F.col("pub_year").between(1901, last_year), F.col("pub_year"))
    names = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    kinds = [("", "keyword", field_keywords(F.col("keywords"))), ("author:", "author", names(F.col("authors"))), ("journal:", "journal", F.filter(F.array(F.trim(F.coalesce("journal", F.lit("")))), lambda x: x != ""))]

    def item(prefix: str, kind: str):  # noqa: ANN202
        return lambda v: F.struct(F.concat(F.lit(prefix), v).alias("id"), F.lit(kind).alias("kind"), v.alias("label"))

    items = F.concat(*[F.transform(F.array_distinct(values), item(prefix, kind)) for prefix, kind, values in kinds])
    x = papers.select(F.explode(items).alias("x"), year.alias("y"), F.coalesce(F.col("citations").cast("double"), F.lit(0.0)).alias("c")).select("x.*", "y", "c")
    g = x.groupBy("id", "kind", "label").agg(F.count("*").alias("frequency"), F.sum("c").alias("citations"), F.min("y").alias("first_year"), F.max("y").alias("last_year"))
    return g.withColumn("size", clamp(6 * F.log(F.col("frequency") + 1.0) + 0.3 * F.log(F.col("citations") + 1.0), 8.0, 45.0))


#: Request names of the options of a CSV run.
OPTION_NAMES = {"max_keywords": "maxKeywords", "min_frequency": "minFrequency", "include_authors": "includeAuthors", "include_journals": "includeJournals", "max_nodes": "maxNodes", "min_weight": "minWeight"}


def csv_options(given: dict | str | None) -> dict:
    """Options by their own names, with defaults where they are missing or zero; text is read as JSON, unreadable text counts
    as none."""
    if isinstance(given, str):
        try:
            given = json.loads(given)
        except ValueError:
            given = {}
    named = {OPTION_NAMES.get(k, k): v for k, v in (given or {}).items()}
    return named | {"maxKeywords": named.get("maxKeywords") or 10, "minFrequency": named.get("minFrequency") or 2, "includeAuthors": named.get("includeAuthors") is not False, "includeJournals": named.get("includeJournals") is not False}


def csv_graph(papers: DataFrame, name: str, options: dict | str | None = None):  # noqa: ANN201
    """(graph, metadata row) of a paper file: keywords and their co-occurrence, and a title that names the file. papers: title,
    abstract, keywords as strings. A file without rows is an error."""
    o = csv_options(options)
    rows = papers.withColumn("paper_ix", F.monotonically_increasing_id())
    rows = materialize(rows)
    n = rows.count()
    if not n:
        raise ValueError(f"{name} holds no rows")
    meta = papers.sparkSession.createDataFrame([(f"Knowledge Graph from {name}", f"Generated from CSV file with {n} rows", n)], "title string, description string, source_papers long")
    return keyword_graph(rows, o["maxKeywords"], o["minFrequency"]), meta
