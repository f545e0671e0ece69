"""Topical coverage, temporal trends and process/entity/outcome classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import contains_any, first_filled, leading_int
from ..functions.dictionaries import PERIODS, TOPIC_KEYWORDS
from .dictionary import hit_any, hit_count, numbered_patterns, pattern_hits
from .graph import Graph
from .iterate import numbered, with_row


def valid_papers(papers: DataFrame, first: int = 1995, last: int = 2025) -> DataFrame:
    """Papers with a title or an abstract and a year from first to last; the year is the first filled of pub_year, year
    and publication_year."""
    names = [c for c in ("pub_year", "year", "publication_year") if c in papers.columns]
    year = leading_int(F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in names]))
    return papers.withColumn("pub_year", year).where(first_filled("title", "abstract").isNotNull() & F.col("pub_year").between(first, last))


def validation_report(papers: DataFrame) -> DataFrame:
    """One row: papers, valid ones, skipped ones, the rate and whether it is below nine tenths."""
    n, ok = papers.agg(F.count("*").alias("papers")), valid_papers(papers).agg(F.count("*").alias("valid"))
    rate = F.coalesce(F.try_divide(F.col("valid"), F.col("papers")), F.lit(0.0))
    return with_row(n, ok).select("papers", "valid", (F.col("papers") - F.col("valid")).alias("skipped"), rate.alias("rate"), (rate < 0.9).alias("warn"))


def cleaned(title: Column, abstract: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_\s-]", " "), r"\s+", " "))


def topic_matches(papers: DataFrame, topics: dict[str, list[str]] = TOPIC_KEYWORDS) -> DataFrame:
    """(paper_ix, pub_year, topic): each topic with a keyword in the paper, as a whole word. All keywords are found in one pass
    over the text; one row per match leaves."""
    words, places = numbered_patterns(topics)
    hits = pattern_hits(papers.select("paper_ix", "pub_year", cleaned(F.col("title"), F.col("abstract")).alias("__t")), "__t", words)
    flags = [F.when(hit_any("hits", at, whole=True), F.lit(t)) for t, at in places.items()]
    return hits.select("paper_ix", "pub_year", F.explode(F.array_compact(F.array(*flags))).alias("topic"))


def coverage(papers: DataFrame, topics: dict[str, list[str]] = TOPIC_KEYWORDS) -> DataFrame:
    """(topic, n, pct, keywords) of every topic; a paper counts in each of its topics."""
    names = papers.sparkSession.createDataFrame([(t, len(w)) for t, w in topics.items()], "topic string, keywords int")
    total = papers.agg(F.count("*").alias("total"))
    n = topic_matches(papers, topics).groupBy("topic").agg(F.count("*").alias("n"))
    full = with_row(names.join(n, "topic", "left"), total)
    return full.select("topic", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.try_divide(100.0 * F.coalesce("n", F.lit(0)), F.col("total")), F.lit(0.0)).alias("pct"), "keywords")


def _period(year: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, a, b in reversed(PERIODS):
        out = F.when(year.between(a, b), name).otherwise(out)
    return out


def temporal(papers: DataFrame, topics: dict[str, list[str]] = TOPIC_KEYWORDS) -> DataFrame:
    """(period, total, topic, n) for every period and topic."""
    spark = papers.sparkSession
    grid = spark.createDataFrame([(p, t) for p, _, _ in PERIODS for t in topics], "period string, topic string")
    per = papers.groupBy(_period(F.col("pub_year")).alias("period")).agg(F.count("*").alias("total"))
    n = topic_matches(papers, topics).groupBy(_period(F.col("pub_year")).alias("period"), "topic").agg(F.count("*").alias("n"))
    return grid.join(per, "period", "left").join(n, ["period", "topic"], "left").select("period", F.coalesce("total", F.lit(0)).alias("total"), "topic", F.coalesce("n", F.lit(0)).alias("n"))


def chart_series(papers: DataFrame, topics: dict[str, list[str]] = TOPIC_KEYWORDS) -> DataFrame:
    """(topic, pct, series): topics by rising share, each with its counts per period in order."""
    t = temporal(papers, topics).groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("period", "n"))), lambda x: x["n"]).alias("series"))
    return coverage(papers, topics).select("topic", "pct").join(t, "topic").orderBy("pct", "topic")


def topic_statistics(papers: DataFrame, topics: dict[str, list[str]] = TOPIC_KEYWORDS) -> DataFrame:
    return papers.agg(F.count("*").alias("papers"), F.min("pub_year").alias("first_year"), F.max("pub_year").alias("last_year")).withColumn("topics", F.lit(len(topics))).withColumn("keywords", F.lit(sum(map(len, topics.values()))))


#: Topics of the single-label classification, in order; the last is also what a paper without a hit gets.
BEST_TOPICS = {
    "Plant Science": ["plant", "crop", "agriculture", "leaf", "growth", "photosynthesis"],
    "Genetics": ["gene", "genetic", "genome", "dna", "mutation", "transgenic"],
    "Molecular Biology": ["molecular", "protein", "structure", "biochemistry"],
    "Physiology": ["physiology", "metabolism", "enzyme", "pathway", "transport"],
    "Biotechnology": ["biotechnology", "engineering", "synthetic", "biofuel"],
    "Biophysics": ["biophysics", "modeling", "simulation", "thermodynamics"],
    "Ecology & Environment": ["ecology", "climate", "environment", "ecosystem"],
    "Systems Biology": ["systems", "network", "pathway", "integrated"],
}


def _lowered() -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))))


def best_topic(papers: DataFrame, topics: dict[str, list[str]] = BEST_TOPICS) -> DataFrame:
    """(paper_ix, topic, score): the topic of most keyword occurrences (also within words), the first of equal ones; none: the
    last topic. All keywords are counted in one pass over the text."""
    words, places = numbered_patterns(topics)
    hits = pattern_hits(papers.select("paper_ix", _lowered().alias("__t")), "__t", words)
    scores = [F.struct(hit_count("hits", at).alias("score"), F.lit(-i).alias("ord"), F.lit(t).alias("topic")) for i, (t, at) in enumerate(places.items())]
    best = hits.select("paper_ix", F.array_max(F.array(*scores)).alias("b"))
    last = list(topics)[-1]
    return best.select("paper_ix", F.when(F.col("b.score") > 0, F.col("b.topic")).otherwise(last).alias("topic"), F.col("b.score").alias("score"))


def best_topic_counts(papers: DataFrame, topics: dict[str, list[str]] = BEST_TOPICS) -> DataFrame:
    """(topic, n, pct) of every topic, pct to one place."""
    names = papers.sparkSession.createDataFrame([(t,) for t in topics], "topic string")
    n = best_topic(papers, topics).groupBy("topic").agg(F.count("*").alias("n"))
    total = papers.agg(F.count("*").alias("total"))
    pct = F.coalesce(F.round(F.try_divide(100.0 * F.coalesce("n", F.lit(0)), F.col("total")), 1), F.lit(0.0))
    return with_row(names.join(n, "topic", "left"), total).select("topic", F.coalesce("n", F.lit(0)).alias("n"), pct.alias("pct"))


def extreme_topics(papers: DataFrame, topics: dict[str, list[str]] = BEST_TOPICS) -> DataFrame:
    """One row: the most and the least represented topic; of equal ones the last."""
    order = F.create_map(*[F.lit(x) for i, t in enumerate(topics) for x in (t, i)])
    c = best_topic_counts(papers, topics).withColumn("ord", F.element_at(order, F.col("topic")))
    return c.agg(F.max_by("topic", F.struct("n", "ord")).alias("most"), F.min_by("topic", F.struct("n", (-F.col("ord")).alias("o"))).alias("least"))


def year_histogram(papers: DataFrame, first: int = 2000, last: int = 2025) -> DataFrame:
    """(year, n): first four digits of pub_year in range."""
    y = F.regexp_extract(F.col("pub_year").cast("string"), r"\d{4}", 0).try_cast("int")
    return papers.select(y.alias("year")).where(F.col("year").between(first, last)).groupBy("year").agg(F.count("*").alias("n"))


def topic_keyword_counts(papers: DataFrame, topics: dict[str, list[str]] = BEST_TOPICS, k: int = 20) -> DataFrame:
    """The k most frequent keywords; one in two topics counts twice."""
    words, places = numbered_patterns(topics)
    times = [sum(at.count(i) for at in places.values()) for i in range(len(words))]
    hits = pattern_hits(papers.select(_lowered().alias("__t")), "__t", words).select(F.explode("hits").alias("h"))
    named = [F.get(F.array(*map(F.lit, values)), F.col("h.pattern")) for values in (words, times)]
    return hits.groupBy(named[0].alias("keyword")).agg(F.sum(F.col("h.n") * named[1]).alias("n")).orderBy(F.desc("n"), "keyword").limit(k)


def node_class(label: Column, type: Column) -> Column:  # noqa: A002
    """process, outcome or entity, by what label and type contain, in this order."""
    lab, typ = F.lower(F.coalesce(label, F.lit(""))), F.lower(F.coalesce(type, F.lit("")))
    named = F.when(F.contains(typ, F.lit("process")) | contains_any(lab, ["process", "reaction", "synthesis"]), "process").when(F.contains(typ, F.lit("outcome")) | contains_any(lab, ["outcome", "result", "product"]), "outcome").otherwise("entity")
    return F.when(lab == "", "entity").otherwise(named)


def classified(nodes: DataFrame, confidence: float = 0.8) -> DataFrame:
    return nodes.withColumn("peo_type", node_class(F.col("label"), F.col("type"))).withColumn("peo_confidence", F.lit(confidence))


def class_counts(nodes: DataFrame) -> DataFrame:
    """(peo_type, n, pct) of the three classes, pct to two places."""
    names = nodes.sparkSession.createDataFrame([("process",), ("entity",), ("outcome",)], "peo_type string")
    n = classified(nodes).groupBy("peo_type").agg(F.count("*").alias("n"))
    total = nodes.agg(F.count("*").alias("total"))
    pct = F.coalesce(F.round(F.try_divide(100.0 * F.coalesce("n", F.lit(0)), F.col("total")), 2), F.lit(0.0))
    return with_row(names.join(n, "peo_type", "left"), total).select("peo_type", F.coalesce("n", F.lit(0)).alias("n"), pct.alias("pct"))


def class_relationships(graph: Graph) -> DataFrame:
    """One row: edges from process to entity, entity to outcome, process to outcome, and others, between known nodes."""
    c = classified(graph.nodes)
    a, b = c.select(F.col("id").alias("src"), F.col("peo_type").alias("x")), c.select(F.col("id").alias("dst"), F.col("peo_type").alias("y"))
    e = graph.edges.join(a, "src").join(b, "dst")
    pair = F.concat_ws(">", "x", "y")
    named = ["process>entity", "entity>outcome", "process>outcome"]
    return e.agg(*[F.count_if(pair == p).alias(p.replace(">", "_")) for p in named], F.count_if(~pair.isin(named)).alias("other"))


def papers_of_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes as papers: title, abstract and year with their defaults, numbered by id where they have no number."""
    if "paper_ix" not in nodes.columns:
        nodes = numbered(nodes, ["id"], "paper_ix")
    names = set(nodes.columns)
    extra = [F.col(c) for c in ("description", "abstract") if c in names]
    year = F.col("pub_year").cast("int") if "pub_year" in names else F.lit(2020)
    return nodes.select("paper_ix", first_filled("label", *(["name"] if "name" in names else []), F.concat(F.lit("Node "), F.col("id"))).alias("title"), first_filled(*extra, F.lit("")).alias("abstract") if extra else F.lit("").alias("abstract"), F.coalesce(year, F.lit(2020)).alias("pub_year"))
