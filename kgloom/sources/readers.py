"""Readers: CSV, JSON graphs, page texts, byte files, row samples and text chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import first_filled, header_name, node_size, nonzero, clamp
from ..functions.dictionaries import FILE_KINDS
from ..operators.builder import migrated_graph
from ..operators.graph import Graph


def read_csv(spark: SparkSession, path: str, normalise: bool = True) -> DataFrame:
    """All columns as strings; headers normalised or as they are; rows with too few fields dropped, extra fields ignored;
    values trimmed and free of single and double quotes. A row is a line; blank lines count for nothing."""
    options = {"header": True, "mode": "PERMISSIVE", "quote": '"', "escape": "\0", "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    found = spark.read.csv(path, inferSchema=False, **options).columns
    names = [header_name(c) for c in found] if normalise else found
    plain = [f"c{i}" for i in range(len(found))]
    # Spark keeps the line of a row with too few or too many fields
    df = spark.read.csv(path, schema=", ".join(f"{c} string" for c in [*plain, "__bad"]), columnNameOfCorruptRecord="__bad", **options)
    whole = F.col("__bad").isNull() | (F.size(parse_csv_line(F.col("__bad"))) >= len(found))
    read = F.octet_length(F.coalesce("c0", F.lit(""))) >= 0  # Spark refuses to read lines alone, as a count would
    return df.where(whole & read).select(*[F.regexp_replace(F.trim(F.coalesce(F.col(c), F.lit(""))), "['\"]", "").alias(n) for c, n in zip(plain, names, strict=True)])


def parse_csv_line(line: Column) -> Column:
    """Fields of one line: a quote character toggles quoting and goes; values are trimmed."""
    step = F.aggregate(
        F.split(line, ""),
        F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(False).alias("quoted")),
        lambda a, c: F.when(c == '"', F.struct(a["out"].alias("out"), a["cur"].alias("cur"), (~a["quoted"]).alias("quoted")))
        .when((c == ",") & ~a["quoted"], F.struct(F.concat(a["out"], F.array(F.trim(a["cur"]))).alias("out"), F.lit("").alias("cur"), a["quoted"].alias("quoted")))
        .otherwise(F.struct(a["out"].alias("out"), F.concat(a["cur"], c).alias("cur"), a["quoted"].alias("quoted"))),
        lambda a: F.concat(a["out"], F.array(F.trim(a["cur"]))),
    )
    return step


def naive_csv(lines: DataFrame, headers: list[str]) -> DataFrame:
    """Lines cut at every comma; title, abstract and year columns by what the header contains; missing ones empty."""
    low = [h.strip().lower() for h in headers]
    at = lambda *words: next((i for i, h in enumerate(low) if any(w in h for w in words)), None)
    parts = F.split("value", ",")
    pick = lambda i: F.coalesce(F.get(parts, i), F.lit("")) if i is not None else F.lit("")
    return lines.select(pick(at("title")).alias("title"), pick(at("abstract", "summary")).alias("abstract"), pick(at("year", "date")).alias("year"))


#: Column names that stand for a paper's fields.
PAPER_FIELDS = {
    "title": ["title", "paper_title", "article_title"], "abstract": ["abstract", "summary", "description"], "authors": ["authors", "author", "author_names"],
    "journal": ["journal", "venue", "conference", "publication"], "year": ["year", "publication_year", "pub_year"], "keywords": ["keywords", "keyword", "tags", "subjects"], "citations": ["citations", "citation_count", "cited_by"],
}


def papers_of(df: DataFrame) -> DataFrame:
    """A table with any of the known column names as papers, all strings; missing fields are empty."""
    have = {c.lower(): c for c in df.columns}
    pick = lambda names: first_filled(*[F.col(f"`{have[n]}`") for n in names if n in have], F.lit("")) if any(n in have for n in names) else F.lit("")
    return df.select(*[pick(names).alias(field) for field, names in PAPER_FIELDS.items()])


#: What a standard field's header contains.
HEADER_WORDS = {
    "title": ["title", "paper_title", "article_title", "name"], "abstract": ["abstract", "description", "summary"], "authors": ["authors", "author", "writer", "creator"],
    "journal": ["journal", "publication", "venue", "conference"], "year": ["year", "pub_year", "publication_year", "date"], "doi": ["doi", "digital_object_identifier"],
    "keywords": ["keywords", "keyword", "tags", "subjects"], "citations": ["citations", "cited_by", "citation_count"],
}


def header_mapping(headers: list[str]) -> dict[str, str]:
    """Standard field to the first header that contains one of its words."""
    low = [(h, "_".join(h.lower().split())) for h in headers]
    found = {f: next((h for h, x in low if any(w in x for w in words)), None) for f, words in HEADER_WORDS.items()}
    return {f: h for f, h in found.items() if h is not None}


def file_kind(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in FILE_KINDS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.element_at(F.split(F.lower(F.coalesce(name, F.lit(""))), "[.]"), -1)), F.lit("unknown"))


GRAPH_SCHEMA = "nodes array<struct<id:string,label:string,name:string,size:double,type:string,description:string,reference:string>>, edges array<struct<source:string,`from`:string,target:string,to:string,weight:double,value:double,relationship_type:string,relationship:string,label:string,type:string,description:string>>, links array<struct<source:string,`from`:string,target:string,to:string,weight:double,value:double,relationship_type:string,relationship:string,label:string,type:string,description:string>>"


def read_graph_json(spark: SparkSession, path: str, strict: bool = True) -> Graph:
    """Graph files: defaults for missing fields, sizes clamped; strict needs nodes and edges (size 10 to 50, weight at
    least 1), else links count as edges too and a label may be the id (size 8 to 45)."""
    raw = spark.read.schema(GRAPH_SCHEMA).json(path, multiLine=True).withColumn("graph_id", F.element_at(F.split(F.input_file_name(), "/"), -1))
    if strict:
        raw = raw.where("nodes is not null and edges is not null")
    low, high = (10, 50) if strict else (8, 45)
    n = raw.select("graph_id", F.posexplode("nodes").alias("i", "n"))
    default_label = F.concat(F.lit("Node "), F.col("i"))
    label = first_filled("n.label", "n.name", *([] if strict else ["n.id"]), default_label)
    nodes = n.select("graph_id", F.col("i").alias("pos"), first_filled("n.id", F.concat(F.lit("node_"), F.col("i"))).alias("id"), label.alias("label"), clamp(nonzero("n.size", 20), low, high).alias("size"), first_filled("n.type", F.lit("concept")).alias("type"), F.coalesce("n.description", F.lit("")).alias("description"))
    both = F.col("edges") if strict else F.concat(F.coalesce("edges", F.array().cast(raw.schema["edges"].dataType)), F.coalesce("links", F.array().cast(raw.schema["edges"].dataType)))
    e = raw.select("graph_id", F.posexplode(both).alias("i", "e"))
    weight = F.greatest(F.coalesce(F.nullif("e.weight", F.lit(0.0)), F.nullif("e.value", F.lit(0.0)), F.lit(1.0)), F.lit(1.0))
    rel = first_filled("e.relationship_type", "e.type", *([] if strict else ["e.label", "e.relationship"]), F.lit("RELATED_TO"))
    edges = e.select("graph_id", F.col("i").alias("pos"), first_filled("e.source", "e.from").alias("src"), first_filled("e.target", "e.to").alias("dst"), weight.alias("weight"), rel.alias("relationship_type"), F.coalesce("e.description", F.lit("")).alias("description"))
    return Graph(nodes, edges)


def read_file_texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text) of binary files: bytes as UTF-8, control characters as spaces, white space collapsed; under 100
    characters, read again as Latin-1. For the pages of PDF files see pdf.py."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " "), r"\s+", " "))
    utf = clean(F.make_valid_utf8(F.col("content").cast("string")))
    return raw.select("path", F.when(F.char_length(utf) >= 100, utf).otherwise(clean(F.decode("content", "ISO-8859-1"))).alias("text"))


def read_many(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Papers of several CSV files and a status per file; a file that can't be read doesn't stop the others."""
    frames, status = [], []
    for p in paths:
        try:
            df = papers_of(read_csv(spark, p))
            frames.append(df.withColumn("source_file", F.lit(p)))
            status.append((p, "completed", None))
        except Exception as e:  # noqa: BLE001
            status.append((p, "failed", str(e)[:200]))
    papers = None
    for f in frames:
        papers = f if papers is None else papers.unionByName(f)
    empty = spark.createDataFrame([], "title string, abstract string, authors string, journal string, year string, keywords string, citations string, source_file string")
    return papers if papers is not None else empty, spark.createDataFrame(status, "path string, status string, error string")


def migrate_folder(spark: SparkSession, folder: str, store, kind: str | None = None, dry_run: bool = False) -> DataFrame:  # noqa: ANN001
    """Every graph (JSON) and paper (CSV) file of a folder into a store, one graph each: (path, status, error, nodes, edges) per
    file. A file that fails doesn't stop the others; a dry run only counts."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = sorted(x.getPath().getName() for x in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p) if x.isFile())
    status = []
    for name in (n for n in names if (n.endswith(f".{kind}") if kind else n.lower().endswith((".json", ".csv")))):
        path = f"{folder}/{name}"
        try:
            if (kind or name.rpartition(".")[2]).lower() == "json":
                g = read_graph_json(spark, path)
            else:
                g = migrated_graph(papers_of(read_csv(spark, path)).withColumn("row_ix", F.monotonically_increasing_id()))
            found = (g.nodes.count(), g.edges.count())
            if not dry_run:
                store.create(g, name)
            status.append((path, "read" if dry_run else "stored", None, *found))
        except Exception as e:  # noqa: BLE001
            status.append((path, "failed", str(e)[:200], None, None))
    return spark.createDataFrame(status, "path string, status string, error string, nodes long, edges long")


def char_budget_sample(rows: DataFrame, budget: int = 300_000, seed: int = 42, text_col: str = "value", header_chars: int = 0) -> DataFrame:
    """Rows in seeded random order as long as their running length (one more for each) fits the budget; all if all fit.
    A row is one character or more, so no more than `budget` rows can be in it and only those of least hash are ordered in one
    task; rows are cut to the lowest hashes that could fit before."""
    sized = rows.withColumn("__h", F.xxhash64(F.lit(seed), text_col)).withColumn("__n", F.char_length(text_col) + 1)
    total = sized.agg(F.sum("__n").alias("n")).first()["n"] or 0
    if total + header_chars <= budget:
        return rows
    # range buckets of the hash: count lengths by bucket, keep the buckets that can matter
    bucket = F.shiftright(F.col("__h"), 52)
    from pyspark.sql import Window

    counts = sized.groupBy(bucket.alias("b")).agg(F.sum("__n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keep = counts.withColumn("before", before).where(F.col("before") + header_chars < budget).select("b")
    near = sized.withColumn("b", bucket).join(keep, "b", "left_semi").orderBy("__h", text_col).limit(budget)
    run = F.sum("__n").over(Window.orderBy("__h", text_col).rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("__run", run).where(F.col("__run") + header_chars <= budget).select(*rows.columns)


def chunks(docs: DataFrame, text_col: str = "text", size: int = 280_000, overlap: int = 20_000) -> DataFrame:
    """Overlapping pieces of each text: (columns of docs but the text, chunk, text)."""
    n = F.char_length(text_col)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    keep = [c for c in docs.columns if c != text_col]
    return docs.select(*keep, F.col(text_col), F.posexplode(starts).alias("chunk", "__s")).select(*keep, "chunk", F.substring(F.col(text_col), F.col("__s") + 1, F.lit(size)).alias(text_col))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(collection, n) of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("collection"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def normalised_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("size", node_size("size"))
