"""An entity graph: mentions by rule, nodes, edges, degrees, neighbours and reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.chunking import _WINDOWS_SQL, OVERLAP, WIDTH, windows
from docloom.sources.scratch import kept

#: A mention: one or more capitalised words of at least four letters.
ENTITY = r"\p{Lu}\p{Ll}{3,}(?: \p{Lu}\p{Ll}{3,})*"
#: Entity kinds by the order in which questions prefer them.
PRIORITY = {"PERSON": 0, "ORG": 1, "PRODUCT": 2, "LAW": 3, "FAC": 4}
#: Pairs of entities that a task makes and counts, about.
PAIRS = 1 << 20
LEGAL = r"(?i)(^| )(act|law|regulation|directive|code)$"


def label(entity: Column) -> Column:
    """A kind by rule: laws by their last word, several words a person, else an organisation."""
    return F.when(entity.rlike(LEGAL), "LAW").when(F.contains(entity, F.lit(" ")), "PERSON").otherwise("ORG")


def mentions(chunks: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, name, label, entity): every mention in order; entity is `LABEL:name in lower case`."""
    found = chunks.select(key, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(ENTITY), F.lit(0))).alias("pos", "name"))
    found = found.withColumn("label", label(F.col("name")))
    return found.select(key, F.col("pos").cast("long"), "name", "label", F.concat("label", F.lit(":"), F.lower("name")).alias("entity"))


def mentioned(text: Column) -> Column:
    """The entities of a text as `mentions` names them, each as often as it is mentioned."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ENTITY), F.lit(0))
    return F.transform(found, lambda n: F.concat(label(n), F.lit(":"), F.lower(n)))


def entities_of(text: Column) -> Column:
    """The distinct entities of a text."""
    return F.array_distinct(mentioned(text))


def mention_counts(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(entity, label, mentions, chunks)."""
    return found.groupBy("entity", "label").agg(F.count("*").alias("mentions"), F.countDistinct(key).alias("chunks"))


def top_entities(found: DataFrame, k: int = 10, key: str = "doc_id") -> DataFrame:
    """The k entities with most mentions; ties by the first place where one is seen."""
    counts = found.groupBy("entity").agg(F.count("*").alias("mentions"), F.min(F.struct(key, "pos")).alias("first"))
    return counts.orderBy(F.desc("mentions"), F.asc("first"), F.asc("entity")).limit(k).select("entity", "mentions")


def best_entity(counts: DataFrame, degree: DataFrame) -> DataFrame:
    """The entity that a question is made about: by kind, then degree, then name; short names are not."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in PRIORITY.items() for x in p]), F.col("label")), F.lit(10))
    named = counts.where(F.length(F.regexp_replace("entity", "^[A-Z]+:", "")) >= 4).join(degree.withColumnRenamed("node", "entity"), "entity", "left")
    return named.withColumn("priority", rank).orderBy("priority", F.desc(F.coalesce("degree", F.lit(0))), "entity").limit(1)


def chunk_edges(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(src, dst, rel, weight): a chunk and an entity by the mentions in it."""
    return found.groupBy(key, "entity").agg(F.count("*").alias("weight")).select(F.concat(F.lit("Chunk:"), F.col(key).cast("string")).alias("src"), F.col("entity").alias("dst"), F.lit("mentions").alias("rel"), "weight")


def cooccurrence(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(src, dst, weight): pairs of entities by the chunks that hold both, src before dst. All entities of a chunk are paired; the size of a chunk bounds its pairs."""
    return _paired(found.groupBy(key).agg(F.sort_array(F.collect_set("entity")).alias("e")), key)


def list_cooccurrence(lists: DataFrame, key: str = "doc_id") -> DataFrame:
    """As cooccurrence, of chunks with their entities as lists (key, entities): a chunk is a row in the shuffle, not a mention."""
    return _paired(lists.groupBy(key).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("entities")))).alias("e")), key)


def _paired(chunks: DataFrame, key: str) -> DataFrame:
    """Counts of pairs of chunks' entities (key, e), which are written first, so that the number of their pairs is known and dealt out: a task that counts them holds no more of them the more chunks there are."""
    held = kept(chunks.where(F.size("e") > 1), "chunk-entities")
    n = F.size("e").cast("long")
    held = held.repartition((held.agg(F.sum(n * (n - 1))).first()[0] or 0) // (2 * PAIRS) + 1, key)
    pairs = held.select(F.posexplode("e").alias("i", "src"), "e").select("src", F.explode(F.expr("slice(e, i + 2, size(e))")).alias("dst"))
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def _chunk_key(df: DataFrame) -> str:
    """Chunks have ids of their own, or a document is one chunk."""
    return "chunk_id" if "chunk_id" in df.columns else "doc_id"


def _name(kind: str, *columns: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.concat_ws("/", *[F.col(c).cast("string") for c in columns]))


def nodes(chunks: DataFrame, found: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(key, type): documents, chunks, tables and entities, each once. chunks: (doc_id, chunk_id); tables: (doc_id, table_name)."""
    out = chunks.select(_name("Document", "doc_id").alias("key"), F.lit("document").alias("type"))
    out = out.union(chunks.select(_name("Chunk", _chunk_key(chunks)), F.lit("chunk")))
    if tables is not None:
        out = out.union(tables.select(_name("Table", "doc_id", "table_name"), F.lit("table")))
    return out.union(found.select("entity", F.lit("entity"))).distinct()


def edges(chunks: DataFrame, found: DataFrame, tables: DataFrame | None = None, lists: DataFrame | None = None) -> DataFrame:
    """(src, dst, rel, weight) of all relations; undirected, each once. A table's entities are those of the chunk that tells of it: tables is (doc_id, table_name, chunk_id); lists has the mentions by chunk, for list_cooccurrence."""
    key, one = _chunk_key(chunks), F.lit(1).cast("long")
    out = chunks.select(_name("Document", "doc_id").alias("src"), _name("Chunk", key).alias("dst"), F.lit("contains").alias("rel"), one.alias("weight")).distinct()
    if tables is not None:
        out = out.union(tables.select(_name("Document", "doc_id"), _name("Table", "doc_id", "table_name"), F.lit("contains"), one).distinct())
        told = found.join(tables.select("doc_id", "table_name", "chunk_id"), "chunk_id").groupBy("doc_id", "table_name", "entity").agg(F.count("*").alias("n"))
        out = out.union(told.select(_name("Table", "doc_id", "table_name"), "entity", F.lit("mentions"), "n"))
    return out.union(chunk_edges(found, key)).union((cooccurrence(found, key) if lists is None else list_cooccurrence(lists, key)).select("src", "dst", F.lit("co_occurs"), "weight"))


def degrees(all_edges: DataFrame) -> DataFrame:
    """(node, degree) of an undirected graph."""
    return all_edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def neighbours(all_edges: DataFrame, focus: DataFrame) -> DataFrame:
    """(node, neighbour, rel, weight) of the nodes in focus (node)."""
    both = all_edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), "rel", "weight").union(all_edges.select("dst", "src", "rel", "weight"))
    return both.join(focus.distinct(), "node")


def listing(all_nodes: DataFrame, kind: str | None = None, text: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of nodes: documents, tables, chunks, entities, each by key; filters by kind and by a part of the key, whatever the case."""
    df = all_nodes if kind is None else all_nodes.where(F.col("type") == kind)
    df = df if not text else df.where(F.contains(F.lower("key"), F.lit(text.lower())))
    order = F.when(F.col("type") == "document", 0).when(F.col("type") == "table", 1).when(F.col("type") == "chunk", 2).otherwise(3)
    return df.orderBy(order, "key").offset(max(0, offset)).limit(min(500, max(1, limit)))


def reach(all_edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(start, node, hops): nodes within a number of hops, each with its least."""
    both = all_edges.select(F.col("src").alias("x"), F.col("dst").alias("y")).union(all_edges.select("dst", "src")).distinct()
    found = start.select(F.col("node").alias("start"), F.col("node"), F.lit(0).alias("hops")).distinct()
    front = found
    for h in range(1, hops + 1):
        new = front.join(both, F.col("node") == F.col("x")).select("start", F.col("y").alias("node"), F.lit(h).alias("hops")).distinct()
        front = new.join(found.select("start", "node"), ["start", "node"], "left_anti")
        found = found.union(front)
    return found


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _windows(spark, sf_dir):
    """The documents' windows of words as chunks."""
    return windows(_docs(spark, sf_dir), WIDTH, OVERLAP).select("doc_id", F.format_string("%d_%d", "doc_id", "window").alias("chunk_id"), "text")


def _degrees(spark, sf_dir):
    """Texts are read once: the chunks' entities are written without them."""
    lists = kept(_windows(spark, sf_dir).select("doc_id", "chunk_id", mentioned(F.col("text")).alias("entities")), "chunk-mentions")
    return degrees(edges(lists.select("doc_id", "chunk_id"), lists.select("chunk_id", F.explode("entities").alias("entity")), lists=lists))


def _places(spark, sf_dir):
    """The star tables as a graph: regions, nations, customers and suppliers."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    edge = lambda df, a, b, rel: df.select(a.alias("src"), b.alias("dst"), F.lit(rel).alias("rel"), F.lit(1).cast("long").alias("weight"))
    return (
        edge(t("nation"), name("R", "n_regionkey"), name("N", "n_nationkey"), "contains")
        .union(edge(t("customer"), name("N", "c_nationkey"), name("C", "c_custkey"), "contains"))
        .union(edge(t("supplier"), name("N", "s_nationkey"), name("S", "s_suppkey"), "contains"))
    )


MENTION_SQL = r"""SELECT doc_id, pos - 1 AS pos, name, label, label || ':' || lower(name) AS entity FROM (
SELECT *, CASE WHEN regexp_matches(name, '(?i)(^| )(act|law|regulation|directive|code)$') THEN 'LAW' WHEN contains(name, ' ') THEN 'PERSON' ELSE 'ORG' END AS label FROM (
SELECT doc_id, unnest(m) AS name, generate_subscripts(m, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '\p{Lu}\p{Ll}{3,}(?: \p{Lu}\p{Ll}{3,})*') AS m FROM documents)))"""
_PLACES_SQL = """SELECT 'R:' || n_regionkey AS src, 'N:' || n_nationkey AS dst, 'contains' AS rel, 1::BIGINT AS weight FROM nation
UNION ALL SELECT 'N:' || c_nationkey, 'C:' || c_custkey, 'contains', 1 FROM customer UNION ALL SELECT 'N:' || s_nationkey, 'S:' || s_suppkey, 'contains', 1 FROM supplier"""
_PAIRS_SQL = f"""{_WINDOWS_SQL}, wi AS (SELECT doc_id, doc_id || '_' || win AS chunk_id, text FROM ch), me AS ({MENTION_SQL.replace("doc_id", "chunk_id").replace("FROM documents", "FROM wi")}),
l AS (SELECT DISTINCT chunk_id, entity FROM me),
co AS (SELECT a.entity AS src, b.entity AS dst, count(*) AS weight FROM l a JOIN l b ON a.chunk_id = b.chunk_id AND a.entity < b.entity GROUP BY ALL)
"""
QUERIES = {
    "entity_mentions": (lambda s, d: mention_counts(mentions(_docs(s, d))), f"SELECT entity, label, count(*) AS mentions, count(DISTINCT doc_id) AS chunks FROM ({MENTION_SQL}) GROUP BY ALL"),
    "top_entities": (lambda s, d: top_entities(mentions(_docs(s, d))), f"SELECT entity, count(*) AS mentions FROM ({MENTION_SQL}) GROUP BY entity ORDER BY mentions DESC, min((doc_id, pos)), entity LIMIT 10"),
    "cooccurrence": (lambda s, d: list_cooccurrence(_windows(s, d).select("chunk_id", entities_of(F.col("text")).alias("entities")), "chunk_id"), _PAIRS_SQL + "SELECT * FROM co"),
    "graph_counts": (
        lambda s, d: nodes(_docs(s, d), mentions(_docs(s, d))).groupBy("type").agg(F.count("*").alias("nodes")),
        f"WITH me AS ({MENTION_SQL}) SELECT 'document' AS type, count(DISTINCT doc_id) AS nodes FROM documents UNION ALL SELECT 'chunk', count(DISTINCT doc_id) FROM documents UNION ALL SELECT 'entity', count(DISTINCT entity) FROM me",
    ),
    "node_degree": (
        _degrees,
        _PAIRS_SQL
        + """, e AS (SELECT DISTINCT 'Document:' || doc_id AS src, 'Chunk:' || chunk_id AS dst FROM wi UNION ALL SELECT DISTINCT 'Chunk:' || chunk_id, entity FROM me UNION ALL SELECT src, dst FROM co)
SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node""",
    ),
    "graph_neighbours": (
        lambda s, d: neighbours(_places(s, d), s.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("N:"), F.col("n_nationkey").cast("string")).alias("node"))),
        f"WITH e AS ({_PLACES_SQL}), b AS (SELECT src AS node, dst AS neighbour, rel, weight FROM e UNION ALL SELECT dst, src, rel, weight FROM e) SELECT * FROM b WHERE node LIKE 'N:%'",
    ),
    "two_hop": (
        lambda s, d: reach(_places(s, d), s.read.parquet(f"{d}/region.parquet").select(F.concat(F.lit("R:"), F.col("r_regionkey").cast("string")).alias("node")), 2).withColumn("hops", F.col("hops").cast("long")),
        f"""WITH RECURSIVE e AS ({_PLACES_SQL}), b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e),
r AS (SELECT 'R:' || r_regionkey AS start, 'R:' || r_regionkey AS node, 0::BIGINT AS hops FROM region UNION SELECT start, y, hops + 1 FROM r JOIN b ON node = x WHERE hops < 2)
SELECT start, node, min(hops) AS hops FROM r GROUP BY ALL""",
    ),
}
