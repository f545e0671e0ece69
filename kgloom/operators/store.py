"""Stored graphs: create, merge, update, delete, uploads, analyses, histories."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import first_filled, nonzero
from .graph import Graph, filter_nodes, search_nodes
from .iterate import with_row


def with_defaults(nodes: DataFrame, edges: DataFrame) -> Graph:
    n = nodes.withColumn("size", nonzero("size", 20)).withColumn("type", first_filled("type", F.lit("concept")))
    e = edges.withColumn("weight", nonzero("weight", 1)).withColumn("relationship_type", first_filled("relationship_type", F.lit("RELATED_TO")))
    return Graph(n, e)


def merge_nodes(old: DataFrame, new: DataFrame, strategy: str = "append") -> DataFrame:
    """Nodes matched by label (nodes without one by its lack); all columns of both stay. append: only unmatched ones come in; update: matched ones take the
    greatest size and the new attributes (map) over the old; replace: the new ones alone. Of several new nodes of one label
    the first by id counts; update merges the others into it."""
    has = "attributes" in old.columns and "attributes" in new.columns
    batch = new.groupBy("label").agg(F.min_by(F.struct(*[c for c in new.columns if c != "label"]), "id").alias("x"), F.max("size").alias("size"), *([F.max_by("attributes", "id").alias("attributes")] if has else []))
    changed = {"size", "attributes"} if strategy == "update" and has else {"size"} if strategy == "update" else set()
    batch = batch.select(*[F.col(c) if c == "label" or c in changed else F.col(f"x.{c}").alias(c) for c in new.columns])
    if strategy == "replace":
        return batch
    fresh = batch.join(old.select(F.col("label").alias("__l")), F.col("label").eqNullSafe(F.col("__l")), "left_anti").select(*new.columns)
    if strategy == "append":
        return old.unionByName(fresh, allowMissingColumns=True)
    b = batch.select(F.col("label").alias("__l"), *[F.col(c).alias(f"__{c}") for c in changed])
    none = F.create_map().cast("map<string,string>")
    out = {"size": F.greatest("size", "__size")}
    if has:
        mine, theirs = F.coalesce("attributes", none), F.coalesce("__attributes", none)
        out["attributes"] = F.map_concat(F.map_filter(mine, lambda k, v: ~F.map_contains_key(theirs, k)), theirs)
    matched = old.join(b, F.col("label").eqNullSafe(F.col("__l")), "left").select(*[out[c].alias(c) if c in out else F.col(c) for c in old.columns])
    return matched.unionByName(fresh, allowMissingColumns=True)


def merge_edges(old: DataFrame, new: DataFrame, strategy: str = "append") -> DataFrame:
    """Edges matched by source and target whatever their type; all columns of both stay. update: the summed weight of the new
    edges goes to the first matched one (by type, then the whole row), or to a new edge; else unmatched ones come in with
    the first one's weight. First of several new edges of a pair: the least by type, then the whole row."""
    pair = ["src", "dst"]
    rest = [c for c in new.columns if c not in (*pair, "relationship_type")]
    first = F.min(F.struct("relationship_type", *rest)).alias("x")
    batch = new.groupBy(*pair).agg(first, F.sum("weight").alias("weight"))
    batch = batch.select(*[F.col("weight") if c == "weight" and strategy == "update" else F.col(c) if c in pair else F.col(f"x.{c}").alias(c) for c in new.columns])
    if strategy == "replace":
        return batch
    fresh = batch.join(old.select(*pair), pair, "left_anti").select(*new.columns)
    if strategy == "append":
        return old.unionByName(fresh, allowMissingColumns=True)
    order = [F.col(c) for c in ("relationship_type", *(c for c in old.columns if c not in (*pair, "relationship_type")))]
    ranked = old.withColumn("__first", F.row_number().over(Window.partitionBy(*pair).orderBy(*order)) == 1)
    joined = ranked.join(batch.select(*pair, F.col("weight").alias("__w")), pair, "left")
    added = F.when(F.col("__first"), F.coalesce("__w", F.lit(0.0))).otherwise(F.lit(0.0))
    matched = joined.withColumn("weight", (F.coalesce("weight", F.lit(0.0)) + added).cast(old.schema["weight"].dataType)).select(*old.columns)
    return matched.unionByName(fresh, allowMissingColumns=True)


def update_node(nodes: DataFrame, id: str, **values: object) -> DataFrame:  # noqa: A002
    return nodes.withColumns({c: F.when(F.col("id") == id, F.lit(v).cast(nodes.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def delete_nodes(graph: Graph, ids: DataFrame) -> Graph:
    """Without the nodes and every edge that touches them."""
    gone = ids.select(F.col("id").alias("__id")).distinct()
    e = graph.edges.join(gone, F.col("src") == F.col("__id"), "left_anti").join(gone, F.col("dst") == F.col("__id"), "left_anti")
    return Graph(graph.nodes.join(gone, F.col("id") == F.col("__id"), "left_anti"), e)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Appends the rows of new whose keys are not there yet, one of each."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def latest_status(log: DataFrame) -> DataFrame:
    """The last row of each upload in an append-only log (upload_id, at, status, ...)."""
    w = Window.partitionBy("upload_id").orderBy(F.desc("at"), F.desc("status"))
    return log.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def history(df: DataFrame, kind: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest rows first (created_at, then id), of one analysis type if given."""
    df = df if kind is None else df.where(F.col("analysis_type") == kind)
    return df.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


#: What the rows of each stored table are dealt to buckets by; other tables: by all their columns.
BUCKET_KEYS = {"nodes": ["label"], "edges": ["src", "dst"], "metadata": ["graph_id"], "uploads": ["upload_id"], "analyses": ["analysis_id"], "postings": ["gram"]}


#: Characters of the pieces that labels are indexed by.
GRAM = 3


def grams(text: Column) -> Column:
    """The distinct pieces of GRAM characters of a text in lower case; none of a shorter one."""
    low = F.lower(text)
    starts = F.when(F.char_length(low) >= GRAM, F.sequence(F.lit(1), F.char_length(low) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(low, i, F.lit(GRAM))))


def postings(nodes: DataFrame) -> DataFrame:
    """(gram, label): the labels that hold each piece."""
    return nodes.select("label").where("label is not null").distinct().select(F.explode(grams(F.col("label"))).alias("gram"), "label")


class GraphStore:
    """Graphs under a folder that all executors share.

    Rows of a table lie in buckets by the hash of their key: <root>/data/<table>/<change>/__bucket=<b>. A change writes new
    folders for the buckets it touches and then one small manifest that names the folders of all tables, so readers and
    retried jobs see all of a change or nothing of it, and a small change rewrites little. One writer at a time. The number of
    buckets is fixed by the first change; one that is given for a store that is there has no effect.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.buckets = self.manifest().get("buckets", buckets)

    def _fs(self, path: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def manifest(self) -> dict:
        """The current state: version, batch (the last streamed one) and, for each table, its columns and folders by bucket."""
        fs, p = self._fs(f"{self.root}/manifests")
        names = sorted(x.getPath().getName() for x in fs.listStatus(p) if x.getPath().getName().endswith(".json")) if fs.exists(p) else []
        if not names:
            return {"version": 0, "batch": -1, "tables": {}}
        fs, p = self._fs(f"{self.root}/manifests/{names[-1]}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, state: dict) -> None:
        state = state | {"version": state["version"] + 1}
        final = f"{self.root}/manifests/{state['version']:010d}.json"
        fs, p = self._fs(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        to = self._fs(final)[1]
        if fs.exists(to) or not fs.rename(p, to):
            raise RuntimeError(f"another writer has made version {state['version']}")

    def _bucket(self, table: str, df: DataFrame) -> Column:
        return F.pmod(F.xxhash64(*BUCKET_KEYS.get(table, df.columns)), F.lit(self.buckets)).cast("int")

    def _touched(self, table: str, df: DataFrame) -> list[int]:
        return [r["b"] for r in df.select(self._bucket(table, df).alias("b")).distinct().collect()]  # at most self.buckets numbers

    def read(self, table: str, only: list[int] | None = None) -> DataFrame | None:
        known = self.manifest()["tables"].get(table)
        if known is None:
            return None
        schema = StructType.fromJson(known["schema"])
        paths = [p for b, ps in known["folders"].items() if only is None or int(b) in only for p in ps]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, changes: dict[str, tuple[DataFrame, list[int] | None]], append: bool = False, batch: int | None = None) -> None:
        """Writes tables, then publishes all of them at once. A change is rows and the buckets that they replace (None: all
        of them, an empty list: none, so that they are added); append: all rows are added to what is there."""
        state = self.manifest()
        tables = dict(state["tables"])
        for table, (df, touched) in changes.items():
            folder = f"{self.root}/data/{table}/{uuid.uuid4().hex}"
            df.withColumn("__bucket", self._bucket(table, df)).hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(folder)
            fs, p = self._fs(folder)
            new = {n.partition("=")[2]: [f"{folder}/{n}"] for x in fs.listStatus(p) if (n := x.getPath().getName()).startswith("__bucket=")}
            old = tables.get(table, {"folders": {}, "schema": StructType().jsonValue()})
            kept = old["folders"] if append else {} if touched is None else {b: ps for b, ps in old["folders"].items() if int(b) not in touched}
            schema = StructType.fromJson(old["schema"])
            for f in df.schema.fields:
                schema = schema if f.name in schema.names else schema.add(f.name, f.dataType, True)
            tables[table] = {"schema": schema.jsonValue(), "folders": {b: kept.get(b, []) + new.get(b, []) for b in {*kept, *new}}}
        self._publish(state | {"tables": tables, "buckets": self.buckets, "batch": state["batch"] if batch is None else batch})

    def rewrite(self, table: str) -> None:
        """Joins a table's many small files to one folder of buckets and drops the folders that it lay in before. Readers that
        began earlier may miss them."""
        self.commit({table: (self.read(table), None)})
        kept = {p.rpartition("/")[0] for ps in self.manifest()["tables"][table]["folders"].values() for p in ps}
        fs, p = self._fs(f"{self.root}/data/{table}")
        for x in fs.listStatus(p):
            if f"{self.root}/data/{table}/{x.getPath().getName()}" not in kept:
                fs.delete(x.getPath(), True)

    def upload_csv(self, path: str, table: str = "metadata_collection") -> int:
        """Appends the rows of a CSV file to a table of documents, made if it isn't there, with all columns of both; the number of rows. A
        file without rows is an error."""
        rows = self.spark.read.csv(path, header=True, inferSchema=False)
        n = rows.count() if rows.columns else 0
        if not n:
            raise ValueError("the CSV file is empty or could not be parsed")
        self.commit({table: (rows, None)}, append=True)
        return n

    def ensure(self, table: str, schema: str) -> bool:
        """Makes an empty table if there is none; whether there was one."""
        there = table in self.manifest()["tables"]
        if not there:
            self.commit({table: (self.spark.createDataFrame([], schema), None)})
        return there

    def create(self, graph: Graph, title: str, graph_id: str | None = None) -> str:
        """Adds a graph and its metadata row; defaults fill what is missing."""
        graph_id = graph_id or uuid.uuid4().hex
        g = with_defaults(graph.nodes, graph.edges)
        meta = with_row(g.nodes.agg(F.count("*").alias("node_count")), g.edges.agg(F.count("*").alias("edge_count"))).select(F.lit(graph_id).alias("graph_id"), F.lit(title).alias("title"), "node_count", "edge_count")
        named = lambda df: df.withColumn("graph_id", F.lit(graph_id))
        self.commit({"nodes": (named(g.nodes), None), "edges": (named(g.edges), None), "metadata": (meta, None), **self._posted(g.nodes)}, append=True)
        return graph_id

    def merge(self, graph: Graph, strategy: str = "append", batch: int | None = None) -> None:
        """Merges a graph's nodes and edges in one change; only buckets that it touches are read and rewritten. A numbered
        batch that is in already has no second effect."""
        if batch is not None and self.manifest()["batch"] >= batch:
            return
        g = with_defaults(graph.nodes, graph.edges)
        changes = {}
        for table, df, merged in (("nodes", g.nodes, merge_nodes), ("edges", g.edges, merge_edges)):
            touched = None if strategy == "replace" else self._touched(table, df)
            old = self.read(table, touched)
            changes[table] = (merged(df.limit(0) if old is None else old, df, strategy), touched)
            if table == "nodes":
                known = old if old is not None and strategy != "replace" else df.limit(0)
                changes |= self._posted(df.join(known.select("label").distinct(), "label", "left_anti"))
        self.commit(changes, batch=batch)

    def _posted(self, nodes: DataFrame) -> dict:
        """The change that adds new labels to the index, if there is one."""
        return {"postings": (postings(nodes), [])} if "postings" in self.manifest()["tables"] else {}

    def index_labels(self) -> None:
        """Indexes the labels of all nodes by their pieces; merges and new graphs keep the index up from then on. Labels that have gone
        stay in it until it is made again; a search looks at the nodes."""
        self.commit({"postings": (postings(self.read("nodes")), None)})

    def search(self, query: str, type: str | None = None, limit: int = 20, sort: bool = True) -> DataFrame:  # noqa: A002
        """search_nodes over the stored nodes, by the index if there is one: only the buckets of the query's pieces are read, and of
        the nodes only the buckets of labels that hold all pieces. Queries of fewer than GRAM characters look at all nodes. Without
        sort, the first `limit` nodes by id instead of the largest."""
        rows = self.candidates(query)
        if sort:
            return search_nodes(rows, query, type, limit)
        return filter_nodes(rows, type=type, search=query).orderBy("id").limit(limit).withColumn("score", F.lit(1.0))

    def candidates(self, query: str) -> DataFrame:
        """Nodes that may hold the query in their labels."""
        pieces = self.spark.range(1).select(F.explode(grams(F.lit(query))).alias("gram"))
        wanted = [r["gram"] for r in pieces.collect()]  # one for each character of the query
        if not wanted or "postings" not in self.manifest()["tables"]:
            return self.read("nodes")
        near = self.read("postings", self._touched("postings", pieces)).where(F.col("gram").isin(wanted))
        labels = near.groupBy("label").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted)).select("label")
        return self.read("nodes", self._touched("nodes", labels)).join(labels, "label", "left_semi")

    def create_edge(self, src: str, dst: str, weight: float | None = None, relationship_type: str | None = None) -> None:
        """One more edge, whether the pair has others or not."""
        row = self.spark.createDataFrame([(src, dst, weight or 1.0, relationship_type or "RELATED_TO")], "src string, dst string, weight double, relationship_type string")
        self.commit({"edges": (row, None)}, append=True)

    def update_node(self, id: str, **values: object) -> None:  # noqa: A002
        """Sets columns of a node, and updated_at."""
        nodes = self.read("nodes")
        known = {c: v for c, v in values.items() if c in nodes.columns}
        changed = lambda df: update_node(df, id, **known)
        hit = nodes.where(F.col("id") == id)
        touched = sorted({*self._touched("nodes", hit), *self._touched("nodes", changed(hit))})
        old = self.read("nodes", touched)
        old = old if "updated_at" in old.columns else old.withColumn("updated_at", F.lit(None).cast("timestamp"))
        self.commit({"nodes": (changed(old).withColumn("updated_at", F.when(F.col("id") == id, F.current_timestamp()).otherwise(F.col("updated_at"))), touched)})

    def delete_node(self, id: str) -> None:  # noqa: A002
        """Removes a node and every edge that touches it, in one change."""
        changes = {}
        for table, hit in (("nodes", F.col("id") == id), ("edges", (F.col("src") == id) | (F.col("dst") == id))):
            touched = self._touched(table, self.read(table).where(hit))
            changes[table] = (self.read(table, touched).where(~F.coalesce(hit, F.lit(False))), touched)
        self.commit(changes)

    def set_status(self, upload_id: str, status: str, **about: str) -> None:
        """Adds or updates the record of an upload: the named fields change, the others stay."""
        fields = ("filename", "file_type", "method", "graph_id", "error")
        new = self.spark.createDataFrame([(upload_id, status, *(about.get(f) for f in fields))], "upload_id string, status string, " + ", ".join(f"{f} string" for f in fields))
        new = new.withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})
        touched = self._touched("uploads", new)
        old = self.read("uploads", touched)
        if old is not None:
            o = old.select(*[F.col(c).alias(f"__{c}") for c in old.columns])
            mine = [F.coalesce("__created_at", "created_at").alias(c) if c == "created_at" else F.coalesce(c, F.col(f"__{c}")).alias(c) for c in new.columns]
            new = new.join(o, F.col("upload_id") == F.col("__upload_id"), "left").select(*mine).unionByName(old.where(F.col("upload_id") != upload_id))
        self.commit({"uploads": (new, touched)})

    def save_analysis(self, analysis_id: str, analysis_type: str, graph_id: str | None, parameters: dict, results: dict, processing_time: float | None = None) -> bool:
        """Keeps a result under its id; False if there is one already, which stays."""
        row = self.spark.createDataFrame([(analysis_id, analysis_type, graph_id, json.dumps(parameters), json.dumps(results), processing_time)], "analysis_id string, analysis_type string, graph_id string, parameters string, results string, processing_time double")
        row = row.withColumn("created_at", F.current_timestamp())
        old = self.read("analyses", self._touched("analyses", row))
        if old is not None and not old.where(F.col("analysis_id") == analysis_id).isEmpty():
            return False
        self.commit({"analyses": (row, None)}, append=True)
        return True

    def analyses(self, part_of_id: str) -> DataFrame:
        """Results whose id contains the text."""
        return self.read("analyses").where(F.contains("analysis_id", F.lit(part_of_id)))

    def export_json(self, path: str) -> None:
        """Nodes and edges in the client's form, as JSON lines under <path>/nodes and <path>/edges."""
        self.read("nodes").write.mode("overwrite").json(f"{path}/nodes")
        self.read("edges").withColumnsRenamed({"src": "source", "dst": "target"}).write.mode("overwrite").json(f"{path}/edges")

    def clear(self) -> None:
        known = self.manifest()["tables"]
        self.commit({t: (self.read(t).limit(0), None) for t in ("nodes", "edges", "metadata") if t in known})
