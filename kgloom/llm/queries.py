"""One query opN_<name> for each operator, with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .chat import format_chats, turns_as_events
from .fill_middle import fill_in_middle, restored
from .hnsw import near_duplicates
from .html_text import extract_text
from .line_dedup import line_dedup
from .mixing import mix
from .packing import pack
from .prefix_trie import branched, conversations, prefix_trie
from .quality import fit, score
from .simhash import simhash_groups
from .suffix_dedup import Cut, suffix_dedup
from .token_counts import token_counts
from .winnowing import edited_fingerprints

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = simhash_groups(read_table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return g.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By 400 bytes; n_passages and text are by words: text is what is left without passages of 50 words or more that
    start anywhere else."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    d = suffix_dedup(docs, cuts=(Cut("bytes", 400), Cut("words", 50)), out="cut")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    left = F.col("cut.words.kept").cast("string").alias("text")
    return d.select("doc_id", n_bytes, "cut.bytes.n_removed", "cut.bytes.n_spans", F.sha2("cut.bytes.kept", 256).alias("kept_sha256"), F.col("cut.words.n_spans").alias("n_passages"), left)


# Windows of 400 bytes (as hexadecimal digits) and of 50 words are counted by two hashes; texts are cut into overlapping
# stretches first, as taking a window from a long string costs as much as its place.
ORACLES["op8_suffix_array_dedup"] = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS MATERIALIZED (SELECT r, 256 * c AS c, substr(x, 512 * c + 1, 1310) AS x FROM (SELECT r, x, unnest(range((length(x) // 2 - 399 + 255) // 256)) AS c FROM d WHERE length(x) >= 800)),
h AS MATERIALIZED (SELECT r, c + i AS i, hash(s) AS a, hash(s || '.') AS b FROM (SELECT r, c, i, substr(x, 2 * i + 1, 800) AS s FROM (SELECT r, c, x, unnest(range(least(256, length(x) // 2 - 399))) AS i FROM c))),
twice AS (SELECT a, b FROM h GROUP BY a, b HAVING count(*) > 1),
hit AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM h JOIN twice USING (a, b)),
runs AS MATERIALIZED (SELECT r, min(i) AS b, max(i) + 400 AS e FROM (SELECT r, i, sum(CASE WHEN gap <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS g FROM hit) GROUP BY r, g),
cut AS (SELECT r, sum(e - b)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY r),
edges AS (SELECT r, e AS b, lead(b) OVER (PARTITION BY r ORDER BY b) AS e FROM (SELECT r, b, e FROM runs UNION ALL SELECT r, -1, 0 FROM d)),
kept AS (SELECT r, sha256(unhex(string_agg(substr(x, 2 * b + 1, 2 * (coalesce(e, length(x) // 2) - b)), '' ORDER BY b))) AS kept_sha256 FROM edges JOIN d USING (r) GROUP BY r),
ws AS MATERIALIZED (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS ws, regexp_extract(t, '^[\x20\x09-\x0D]*') AS lead FROM d),
v AS MATERIALIZED (SELECT r, 128 * c AS c, list_transform(ws[128 * c + 1 : 128 * c + 177], lambda y: rtrim(y, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS ws FROM (SELECT r, ws, unnest(range((len(ws) - 49 + 127) // 128)) AS c FROM ws WHERE len(ws) >= 50)),
vh AS MATERIALIZED (SELECT r, c + i AS i, hash(s) AS a, hash(s || '.') AS b FROM (SELECT r, c, i, array_to_string(ws[i + 1 : i + 50], ' ') AS s FROM (SELECT r, c, ws, unnest(range(least(128, len(ws) - 49))) AS i FROM v))),
vtwice AS (SELECT a, b FROM vh GROUP BY a, b HAVING count(*) > 1),
vhit AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM vh JOIN vtwice USING (a, b)),
vruns AS MATERIALIZED (SELECT r, min(i) AS b, max(i) + 50 AS e FROM (SELECT r, i, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS g FROM vhit) GROUP BY r, g),
vcut AS (SELECT r, count(*) AS n_passages FROM vruns GROUP BY r),
vedges AS (SELECT r, e AS b, lead(b) OVER (PARTITION BY r ORDER BY b) AS e FROM (SELECT r, b, e FROM vruns UNION ALL SELECT r, -1, 0 FROM d)),
left_over AS (SELECT r, any_value(lead) || string_agg(array_to_string(ws[b + 1 : coalesce(e, len(ws))], ''), '' ORDER BY b) AS text FROM vedges JOIN ws USING (r) GROUP BY r)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256, coalesce(n_passages, 0) AS n_passages, text
FROM (SELECT r, doc_id, x FROM d) JOIN kept USING (r) JOIN left_over USING (r) LEFT JOIN cut USING (r) LEFT JOIN vcut USING (r)
"""


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), size=2048)


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def _held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def quality_model(docs: DataFrame, labels: DataFrame) -> tuple:
    return fit(docs, labels.where(~_held_out()))


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    s = score(docs, quality_model(docs, read_table(spark, sf_dir, "labels")))
    return s.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    chats = format_chats(turns_as_events(turns))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


ORACLES["op6_chat_formatting"] = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lb;'), chr(10), '&nl;'))
    + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lb;')) + 15 AS chars
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op9_winnowing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read_table(spark, sf_dir, "documents"))


@query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.9)
    return d.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


ORACLES["op2_embedding_near_dedup"] = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS MATERIALIZED (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT id AS vec_id, min(root) AS component_id FROM reach GROUP BY id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
"""


@query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=40, min_docs=5)
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op11_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS x FROM d),
k AS (SELECT *, translate(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
often AS (SELECT k, max(doc_id) AS keeper FROM k WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT r) >= 5),
m AS (SELECT k.*, o.k IS NOT NULL AND k.doc_id IS DISTINCT FROM keeper AS gone FROM k LEFT JOIN often o ON k.k = o.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"), unit="lines", rate=100, spm_rate=50, seed=7)
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


ORACLES["op12_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS us FROM d),
k AS (SELECT *, len(us) AS n, ('0x' || h[1:8])::BIGINT % (len(us) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(us) + 1) AS b FROM u),
p AS (SELECT *, array_to_string(us[1 : least(a, b)], '') AS prefix, array_to_string(us[least(a, b) + 1 : greatest(a, b)], '') AS middle, array_to_string(us[greatest(a, b) + 1 : n], '') AS suffix,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain' WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(branched(conversations(read_table(spark, sf_dir, "conversations")), every=20, most=4))


# A node is the digest of its turns' digests; hexadecimal digits of crc32 come from a table, as there is no function for it.
ORACLES["op13_conversation_trie"] = r"""
WITH RECURSIVE t AS (SELECT conv_id AS c, turn, sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, ''))) AS h, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, h) AS i, h, w FROM t),
bits(n, k, x) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT n, k + 1, CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(x ORDER BY n) AS tab FROM bits WHERE k = 8),
c AS (SELECT DISTINCT c FROM t),
h AS MATERIALIZED (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda j: ascii(substr(c::VARCHAR, j, 1))::BIGINT)), lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1])), 4294967295::BIGINT) % 4 AS h FROM c, crc),
r AS (SELECT h.c, o.i, o.h, o.w FROM h JOIN o ON o.c = h.c - h.c % 20 AND o.i <= h.h UNION ALL SELECT h.c, o.i, o.h, o.w FROM h JOIN o ON o.c = h.c AND o.i > h.h),
q AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, h, w FROM r),
p AS MATERIALIZED (SELECT c, d, sha256(string_agg(h, '') OVER (PARTITION BY c ORDER BY d)) AS p, w FROM q UNION ALL SELECT c, 0, '', 0 FROM c),
n AS MATERIALIZED (SELECT p, d, min(c) AS c, count(*) AS n, any_value(w) AS w FROM p GROUP BY p, d),
up AS MATERIALIZED (SELECT n.p, n.d, any_value(b.p) AS up FROM n JOIN p a ON a.p = n.p AND a.d = n.d AND a.c = n.c JOIN p b ON b.c = a.c AND b.d = a.d - 1 GROUP BY n.p, n.d),
kids AS (SELECT up AS p, d - 1 AS d, count(*) AS k FROM up GROUP BY 1, 2),
f AS MATERIALIZED (SELECT n.*, coalesce(k, 0) AS k, (n.n - 1) * w AS own, (k IS NULL)::BIGINT AS leaf FROM n LEFT JOIN kids ON kids.p = n.p AND kids.d = n.d),
sums AS (SELECT a.p, a.d, sum(f.own) AS saved, sum(f.leaf) AS leaves FROM f JOIN p b ON b.p = f.p AND b.d = f.d AND b.c = f.c JOIN p a ON a.c = b.c AND a.d <= b.d GROUP BY a.p, a.d),
last AS (SELECT c, max(d) AS d FROM p GROUP BY c),
ends AS (SELECT p.p, p.d, sha256(string_agg(p.c::VARCHAR, ',' ORDER BY p.c)) AS e FROM p JOIN last ON last.c = p.c AND last.d = p.d GROUP BY p.p, p.d)
SELECT f.c AS conv_id, f.d::BIGINT AS depth, g.c AS parent_conv_id, f.n::BIGINT AS n_convs, f.k::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(e, sha256('')) AS ends_sha256
FROM f JOIN sums ON sums.p = f.p AND sums.d = f.d LEFT JOIN up ON up.p = f.p AND up.d = f.d LEFT JOIN n g ON g.p = up.up AND g.d = f.d - 1 LEFT JOIN ends ON ends.p = f.p AND ends.d = f.d
"""
