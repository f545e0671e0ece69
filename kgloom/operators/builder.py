"""Clean graphs from loosely formed nodes and links, and graphs of bibliographies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import alnum, filled, first_filled, nonzero, number, prettified, round_half_up, slug, tokens
from .graph import Graph, connected
from .iterate import materialize, numbered, with_row
from .similarity import best_matches
from .transform import first_edges


#: Fields of loosely keyed objects, and the words that name one when a key contains them; the first counts.
KEY_WORDS = [("source", "source"), ("target", "target"), ("weight", "weight"), ("label", "label"), ("type", "type"), ("size", "size"), ("id", "id"), ("nodes", "nodes"), ("links", "links"), ("edges", "links"), ("relationship", "links"), ("description", "description"), ("domain", "domain"), ("component", "components"), ("trait", "traits"), ("formula", "formula"), ("quantification", "quantification"), ("frequency", "frequency"), ("maturity", "research_maturity"), ("citation", "citation_potential")]


def field_of(key: Column) -> Column:
    """The field that a loosely written key means, else its letters and digits."""
    low = F.lower(key)
    return F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(f)) for w, f in KEY_WORDS], alnum(key))


def entries_of(answers: DataFrame, kind: str, text_col: str = "text") -> DataFrame:
    """(columns of answers but the text, pos, object): the objects (maps of strings) in every top-level list of a JSON answer
    whose key means `kind` (nodes or links). Text around the outermost braces, such as code fences, is passed over; an answer
    without readable JSON gives none."""
    cut = F.regexp_extract(text_col, r"(?s)\{.*\}", 0)
    lists = F.map_filter(F.from_json(cut, "map<string,string>"), lambda k, v: field_of(k) == kind)
    items = F.flatten(F.transform(F.map_values(lists), lambda v: F.coalesce(F.from_json(v, "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))))
    return answers.select(*[c for c in answers.columns if c != text_col], F.posexplode(items).alias("pos", "object"))


def repaired(objects: DataFrame, fields: list[str]) -> DataFrame:
    """Objects (maps of strings) with loosely written keys as columns: the last key that means a field gives it."""
    named = F.transform(F.map_entries("object"), lambda e: F.struct(field_of(e["key"]).alias("f"), e["value"].alias("v")))
    pick = lambda f: F.element_at(F.filter("__n", lambda e: (e["f"] == f) & e["v"].isNotNull()), -1)["v"]
    with_names = objects.withColumn("__n", named)
    has = lambda f: F.size(F.filter("__n", lambda e: (e["f"] == f) & e["v"].isNotNull())) > 0
    return with_names.select(*[c for c in objects.columns if c != "object"], *[F.when(has(f), pick(f)).alias(f) for f in fields])


#: Keys of a malformed link that name its relation, and a node's attributes.
RELATION_WORDS = [
    "regulates", "regulate", "controls", "control", "influences", "influence", "affects", "affect", "drives", "drive", "depends", "depend", "requires", "require", "produces", "produce", "induces", "induce", "limits", "limit",
    "includes", "include", "spans", "span", "relates", "relate", "correlates", "correlate", "connects", "connect", "balances", "balance", "integrates", "integrate", "couples", "couple", "determines", "determine", "predicts", "predict",
    "links", "link", "validates", "validate", "explains", "explain", "causes", "cause", "precedes", "precede", "describes", "describe", "models", "model", "aims", "aim", "characterizes", "characterize",
]
NODE_ATTRIBUTES = ["description", "traits", "components", "formula", "domain", "scale", "quantification", "frequency", "research_maturity", "citation_potential"]
#: Keys that say something about a link and name no node.
LINK_FIELDS = ["source", "target", "weight", "label", "type", "description", "direction", "evidence_level", "relationship"]


def values_of(text: Column) -> Column:
    """What a value of a loosely written object names, as strings: the elements of a JSON list, an object by its id, label or name, else
    the text itself. Empty ones drop out."""
    items = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    name = lambda v: F.coalesce(*[F.try_variant_get(v, p, "string") for p in ("$.id", "$.label", "$.name", "$")])
    one = F.coalesce(*[F.try_variant_get(F.try_parse_json(text), p, "string") for p in ("$.id", "$.label", "$.name")], text)
    return F.filter(F.transform(F.coalesce(F.transform(items, name), F.array(one)), lambda v: F.trim(v)), lambda v: v != "")


def links_of(objects: DataFrame) -> DataFrame:
    """(columns of objects but object, k, src, dst, label, weight, auto, attributes) of link objects (maps of strings). An object with a
    source and a target, in any spelling of these keys, is one link. Any other is read entry by entry: a key that is a relation
    word labels links from the node named before it (by the source field or the last other key) to its values, or, without
    values, the next link; any other key is a node that is linked to its values. Such links have weight 3 and auto set, and
    related_to for a label where no word gives one."""
    fields = ["source", "target", "label", "weight", "description", "direction"]
    named = repaired(objects.withColumn("__o", F.col("object")), fields)
    whole = filled("source").isNotNull() & filled("target").isNotNull()
    level = F.coalesce(F.try_element_at("__o", F.lit("evidence_level")), F.lit("moderate"))
    about = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    given = about("description", F.coalesce("description", F.lit("")), "direction", first_filled("direction", F.lit("unidirectional")), "evidence_level", level)
    link = lambda src, dst, label, weight, auto, attributes: F.struct(src.alias("src"), dst.alias("dst"), label.alias("label"), weight.alias("weight"), F.lit(auto).alias("auto"), attributes.alias("attributes"))
    canonical = F.array(link(F.trim("source"), F.trim("target"), first_filled(F.trim("label"), F.lit("related_to")), nonzero("weight", 3), False, given))
    derived = link(F.lit(""), F.lit(""), F.lit(""), F.lit(3.0), True, about("description", "Derived from a malformed link"))
    entries = F.filter(F.map_entries("__o"), lambda e: ~F.lower(e["key"]).isin(LINK_FIELDS))
    start = F.struct(filled(F.trim("source")).alias("src"), F.lit(None).cast("string").alias("label"), F.array().cast("array<struct<src:string,dst:string,label:string>>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        key, values, word = F.trim(e["key"]), values_of(e["value"]), alnum(e["key"])
        to = lambda src, label: F.concat(acc["out"], F.transform(values, lambda v: F.struct(src.alias("src"), v.alias("dst"), label.alias("label"))))
        state = lambda src, label, out: F.struct(src.alias("src"), label.cast("string").alias("label"), out.alias("out"))
        none, label = F.lit(None), F.coalesce(acc["label"], F.lit("related_to"))
        usable = acc["src"].isNotNull() & (F.size(values) > 0)
        as_word = F.when(usable, state(acc["src"], none, to(acc["src"], word))).otherwise(state(acc["src"], word, acc["out"]))
        as_rest = F.when(usable, state(acc["src"], none, to(acc["src"], label))).otherwise(acc)
        return F.when(word.isin(RELATION_WORDS), as_word).when(key != "", state(key, none, to(key, label))).otherwise(as_rest)

    found = F.aggregate(entries, start, step)["out"]
    mended = F.transform(found, lambda x: link(x["src"], x["dst"], x["label"], F.lit(3.0), True, derived["attributes"]))
    kept = [c for c in objects.columns if c != "object"]
    return named.select(*kept, F.posexplode(F.when(whole, canonical).otherwise(mended)).alias("k", "x")).select(*kept, "k", "x.*")


def graph_of_answers(answers: DataFrame, text_col: str = "text") -> Graph:
    """A clean graph of a model's JSON answers: objects with any spelling of their keys are repaired, malformed links are read entry
    by entry, then built as usual. Nodes and edges have attributes (maps of strings); those that no answer gave have
    auto_generated among them. See build_metadata for the counts."""
    numbered_ = lambda df: materialize(df).withColumn("pos", F.monotonically_increasing_id())
    nodes = numbered_(repaired(entries_of(answers, "nodes", text_col), ["id", "label", "size", "type", *NODE_ATTRIBUTES]))
    links = numbered_(links_of(entries_of(answers, "links", text_col)).drop("pos", "k"))
    raw = nodes.select("pos", "id", "label", F.lit(None).cast("string").alias("name"), F.coalesce(number("size"), number("frequency")).alias("size"), "type")
    g = build(raw, links.select("pos", "src", "dst", "label", "weight"))
    auto = lambda text: F.create_map(F.lit("description"), F.lit(text), F.lit("auto_generated"), F.lit("true"))
    of_node = nodes.select("pos", F.create_map(*[x for a in NODE_ATTRIBUTES for x in (F.lit(a), F.coalesce(a, F.lit("")))]).alias("attributes"))
    of_link = links.select("pos", F.when(F.col("auto"), F.map_concat("attributes", F.create_map(F.lit("auto_generated"), F.lit("true")))).otherwise(F.col("attributes")).alias("attributes"))
    n = g.nodes.join(of_node, "pos", "left").withColumn("attributes", F.coalesce("attributes", auto("Named by a link only")))
    e = g.edges.join(of_link, "pos", "left").withColumn("attributes", F.coalesce("attributes", auto("Added to connect the graph")))
    return Graph(n, e)


def build_metadata(graph: Graph, share: float = 0.6) -> DataFrame:
    """One row about a graph of graph_of_answers: its nodes and edges, those that no answer gave, and the links wanted at least."""
    auto = F.count_if(F.map_contains_key("attributes", "auto_generated"))
    n = graph.nodes.agg(F.count("*").alias("total_entities"), auto.alias("auto_generated_nodes"))
    e = graph.edges.agg(F.count("*").alias("total_relationships"), auto.alias("auto_generated_edges"))
    total = F.col("total_entities")
    wanted = F.least(F.ceil(total * F.lit(share).cast("decimal(4,3)")), F.floor(total * (total - 1) / 2)).cast("long")
    return with_row(n, e).select("total_entities", "total_relationships", "auto_generated_nodes", "auto_generated_edges", wanted.alias("desired_relationships"))


def clean_nodes(raw: DataFrame) -> DataFrame:
    """(pos, id, label, size, type) of raw nodes (pos, id, label, name, size, type): those with any name."""
    label = first_filled("label", "name", "id")
    n = raw.where(label.isNotNull()).select("pos", first_filled("id", slug(label)).alias("id"), label.alias("label"), nonzero("size", 30).alias("size"), first_filled("type", F.lit("concept")).alias("type"))
    w = Window.partitionBy("id").orderBy("pos")
    return n.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def aliases(nodes: DataFrame) -> DataFrame:
    """(alias, id): id, label, slug and bare letters and digits of each; of a name that several bear the first wins."""
    names = F.array_distinct(F.array(F.col("id"), F.col("label"), slug("label"), alnum("label"), alnum("id")))
    a = nodes.select("pos", "id", F.posexplode(names).alias("prio", "alias")).where(filled("alias").isNotNull())
    return a.groupBy("alias").agg(F.min_by("id", F.struct("prio", "pos")).alias("id"))


def resolve(links: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (pos, src, dst, label, weight) with ends as node ids: by name, by slug, by bare letters and digits; and the
    nodes that unknown ends become (size 28, concept, a label made readable)."""
    known = materialize(aliases(nodes))
    ends = links.select(F.explode(F.array("src", "dst")).alias("name")).where(filled("name").isNotNull()).distinct()
    for i, key in enumerate((F.col("name"), slug("name"), alnum("name"))):
        k = known.select(F.col("alias").alias("__a"), F.col("id").alias(f"__id{i}"))
        ends = ends.withColumn("__k", key).join(k, F.col("__k") == F.col("__a"), "left").drop("__a", "__k")
    found = materialize(ends.select("name", F.coalesce("__id0", "__id1", "__id2").alias("known"), F.coalesce("__id0", "__id1", "__id2", F.nullif(slug("name"), F.lit("")), F.col("name")).alias("id")))
    new = found.where("known is null").groupBy("id").agg(F.min("name").alias("name")).select(F.lit(1 << 30).cast("int").alias("pos"), "id", prettified("name").alias("label"), F.lit(28.0).alias("size"), F.lit("concept").alias("type"))
    m = found.select("name", "id")
    a, b = m.select(F.col("name").alias("src"), F.col("id").alias("__s")), m.select(F.col("name").alias("dst"), F.col("id").alias("__d"))
    e = links.join(a, "src").join(b, "dst").select("pos", F.col("__s").alias("src"), F.col("__d").alias("dst"), first_filled("label", F.lit("related_to")).alias("label"), nonzero("weight", 3).alias("weight"))
    return e, new


def densify(nodes: DataFrame, edges: DataFrame, share: float = 0.6) -> DataFrame:
    """Adds links of weight 2 until there are min(ceil(share N), N (N - 1) / 2): pairs in order of falling size. As share is at
    most 1, the pairs of the first two nodes are enough, so what is looked at grows with N."""
    if share > 1:
        raise ValueError("share must be at most 1")
    n, have = nodes.count(), edges.count()
    missing = min(-(-n * int(share * 1000) // 1000), n * (n - 1) // 2) - have
    if missing <= 0:
        return edges
    ranked = numbered(nodes.select("id", "size"), [F.coalesce("size", F.lit(0)).desc(), F.col("id")], "j")
    heads = [F.struct(F.lit(r["j"]).alias("i"), F.lit(r["id"]).alias("src")) for r in ranked.where("j < 2").orderBy("j").collect()]
    old = edges.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()
    pairs = ranked.select(F.col("id").alias("dst"), "j", F.explode(F.array(*heads)).alias("a")).where("a.i < j").select("a.i", "j", "a.src", "dst")
    pairs = pairs.withColumn("lo", F.least("src", "dst")).withColumn("hi", F.greatest("src", "dst")).join(old, ["lo", "hi"], "left_anti")
    extra = numbered(pairs, ["i", "j"], "place").where(F.col("place") < missing).select(F.lit(1 << 30).cast("int").alias("pos"), "src", "dst", F.lit("related_to").alias("label"), F.lit(2.0).alias("weight"))
    return edges.unionByName(extra)


def bridge(nodes: DataFrame, edges: DataFrame, many: int = 8, common: int = 64) -> DataFrame:
    """Links every smaller component to the largest at the pair of labels most alike (Jaccard likeness of words; none shared:
    by id). common and many bound the work at common words, see best_matches."""
    comp = materialize(nodes.select("id", "label").join(connected(Graph(nodes, edges)), "id"))
    sizes = comp.groupBy("component").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    main = sizes.orderBy(F.desc("n"), "component").limit(1).select(F.col("component").alias("main"), F.col("first").alias("main_first"))
    words = materialize(with_row(comp.select("component", F.col("id").alias("key"), tokens("label", "[^a-z0-9]+").alias("ws")), main))
    best = best_matches(words.where("component <> main").withColumnRenamed("component", "grp"), words.where("component = main"), common, many)
    best = best.select(F.col("grp").alias("component"), F.struct((-F.col("likeness")).alias("s"), F.col("a").alias("src"), F.col("b").alias("dst")).alias("x"))
    rest = with_row(sizes, main).where("component <> main").join(best, "component", "left")
    score = F.coalesce(-F.col("x.s"), F.lit(0.0))
    extra = rest.select(F.lit(1 << 30).cast("int").alias("pos"), F.coalesce("x.src", "first").alias("src"), F.coalesce("x.dst", "main_first").alias("dst"), F.lit("contextual_link").alias("label"), F.greatest(F.lit(2.0), round_half_up(F.when(score > 0, score).otherwise(0.3) * 10)).cast("double").alias("weight"))
    return edges.unionByName(extra)


def build(raw_nodes: DataFrame, raw_links: DataFrame) -> Graph:
    """Clean nodes, resolved links without self-loops and repeated pairs, densified and bridged to one component."""
    n = materialize(clean_nodes(raw_nodes))
    e, new = resolve(raw_links, n)
    nodes = materialize(n.unionByName(new))
    edges = materialize(first_edges(e))
    edges = materialize(densify(nodes, edges))
    return Graph(nodes, bridge(nodes, edges))


def bibliography(papers: DataFrame, authors: DataFrame, keywords: DataFrame, wrote: DataFrame, has: DataFrame, limit: int = 100) -> Graph:
    """Papers (first `limit` by id) with their authors and keywords. wrote, has: (src, dst) from author or keyword to paper."""
    p = papers.select("id", F.col("title").alias("label")).orderBy("id").limit(limit)
    ids = p.select(F.col("id").alias("dst"))
    w, h = wrote.select("src", "dst").distinct().join(ids, "dst", "left_semi"), has.select("src", "dst").distinct().join(ids, "dst", "left_semi")
    pick = lambda df, e, t, s: df.select("id", F.col("name").alias("label")).join(e.select(F.col("src").alias("id")), "id", "left_semi").withColumn("type", F.lit(t)).withColumn("size", F.lit(s))
    nodes = p.withColumn("type", F.lit("paper")).withColumn("size", F.lit(10.0)).unionByName(pick(authors, w, "author", 8.0)).unionByName(pick(keywords, h, "keyword", 6.0))
    edges = w.select(F.col("src"), "dst", F.lit(1.0).alias("weight"), F.lit("authored").alias("relationship_type")).unionByName(h.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1.0).alias("weight"), F.lit("contains").alias("relationship_type")))
    return Graph(nodes, edges)


def rows_graph(rows: DataFrame) -> Graph:
    """Rows of a metadata file (row_ix, title, keywords cut at commas, authors cut at semicolons) as papers, keywords and
    authors."""
    key = lambda p, c: F.concat(F.lit(p), F.regexp_replace(F.lower(c), "[^a-z0-9]", "_"))
    split = lambda c, cut: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), cut), lambda x: F.trim(x)), lambda x: x != "")
    paper = F.concat(F.lit("paper_"), F.col("row_ix"))
    k = rows.select(paper.alias("paper"), F.explode(split(F.col("keywords"), ",")).alias("label")).withColumn("id", key("keyword_", F.col("label")))
    a = rows.select(paper.alias("paper"), F.explode(split(F.col("authors"), ";")).alias("label")).withColumn("id", key("author_", F.col("label")))
    one = lambda df, t, s: df.groupBy("id").agg(F.min("label").alias("label")).withColumn("type", F.lit(t)).withColumn("size", F.lit(s))
    nodes = rows.select(paper.alias("id"), first_filled("title", F.lit("Untitled")).alias("label"), F.lit("paper").alias("type"), F.lit(12.0).alias("size")).unionByName(one(k, "keyword", 8.0)).unionByName(one(a, "author", 6.0))
    edges = k.select(F.col("paper").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"), F.lit("contains").alias("relationship_type")).unionByName(a.select(F.col("id").alias("src"), F.col("paper").alias("dst"), F.lit(1.0).alias("weight"), F.lit("authored").alias("relationship_type")))
    return Graph(nodes, edges)


def migrated_graph(rows: DataFrame) -> Graph:
    """Rows (row_ix, title, keywords) as papers of size 25 and keywords of size 15, each pair linked once by HAS_KEYWORD."""
    words = F.filter(F.transform(F.split(F.coalesce("keywords", F.lit("")), "[,;|]"), lambda x: F.trim(x)), lambda x: F.char_length(x) > 2)
    paper = F.concat(F.lit("paper_"), F.col("row_ix"))
    k = rows.select(paper.alias("src"), F.explode(words).alias("label")).withColumn("dst", F.concat(F.lit("keyword_"), F.regexp_replace(F.lower("label"), r"\s+", "_")))
    nodes = rows.where(filled("title").isNotNull()).select(paper.alias("id"), F.trim("title").alias("label"), F.lit("concept").alias("type"), F.lit(25.0).alias("size")).unionByName(k.groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("label")).withColumn("type", F.lit("keyword")).withColumn("size", F.lit(15.0)))
    return Graph(nodes, k.select("src", "dst").distinct().withColumn("weight", F.lit(2.0)).withColumn("relationship_type", F.lit("HAS_KEYWORD")))


def score_labels(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, precision, recall, f1) of found labels against gold ones (doc_id, label), in lower-case letters and digits."""
    g, f = (df.select("doc_id", alnum("label").alias("k")).where("k <> ''").distinct() for df in (gold, found))
    both = g.join(f, ["doc_id", "k"]).groupBy("doc_id").agg(F.count("*").alias("hit"))
    c = g.groupBy("doc_id").agg(F.count("*").alias("g")).join(f.groupBy("doc_id").agg(F.count("*").alias("f")), "doc_id", "full_outer").join(both, "doc_id", "left")
    hit = F.coalesce("hit", F.lit(0))
    p, r = F.coalesce(F.try_divide(hit, F.col("f")), F.lit(0.0)), F.coalesce(F.try_divide(hit, F.col("g")), F.lit(0.0))
    return c.select("doc_id", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))
