"""Graph operations on node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.nested import existing
from ..sources.store import written
from .ranking import first_per_key, top_k

BUCKETS = 32
#: Letters of the parts by which words find labels.
GRAM = 4
EDGES = "src string, dst string, relation string, o int, bucket int"


def neighbours_within(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, hops, parent): breadth-first tree up to ``depth``; of equal hops the smallest parent."""
    seen = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("hops"), F.lit(None).cast(edges.schema["src"].dataType).alias("parent"))
    front = seen
    for hop in range(1, depth + 1):
        nxt = front.join(edges, F.col("node") == F.col("src")).groupBy("seed", F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        front = nxt.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(hop).alias("hops"), "parent")
        seen = seen.unionByName(front)
    return seen


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree)."""
    o = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    i = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return o.join(i, "node", "full").select("node", z("out_degree"), z("in_degree"))


def node_id(kind: str, label: Column) -> Column:
    return F.concat(F.lit(f"{kind}::"), F.lower(F.trim(label)))


def case_graph(chunks: DataFrame, title: str, court: str, text: str, cite: str, provision: str) -> DataFrame:
    """(src, dst, relation): cases decided by courts, citing citations, interpreting provisions; the first relation of a pair wins."""
    return first_relations(related(chunks, title, court, text, cite, provision)).drop("o")


def first_relations(edges: DataFrame) -> DataFrame:
    """(src, dst, relation, o): of each pair the relation of the least order."""
    return edges.groupBy("src", "dst").agg(F.min_by("relation", "o").alias("relation"), F.min("o").alias("o"))


def related(chunks: DataFrame, title: str, court: str, text: str, cite: str, provision: str) -> DataFrame:
    """(src, dst, relation, o): every relation that chunks state, with its order."""
    case = node_id("Case", F.col(title))
    found = lambda p, g: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    edge = lambda src, dst, rel, o: F.struct(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("relation"), F.lit(o).alias("o"))
    section = lambda x: F.concat(F.lit("section "), x["n"], F.lit(" of "), F.regexp_replace(x["a"], r"\s+", " "))
    pairs = F.arrays_zip(found(provision, 1).alias("n"), found(provision, 2).alias("a"))
    every = F.concat(
        F.array(edge(case, node_id("Court", F.col(court)), "decided_by", 1)),
        F.transform(found(cite, 0), lambda c: edge(case, node_id("Citation", c), "cites", 2)),
        F.transform(pairs, lambda x: edge(case, node_id("Section", section(x)), "interprets", 3)))
    return chunks.select(F.inline(every))


def nodes(edges: DataFrame) -> DataFrame:
    """(id, kind, label)."""
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    part = F.split("id", "::", 2)
    return ids.select("id", part[0].alias("kind"), part[1].alias("label"))


def cases_by_statute(edges: DataFrame, fragment: str) -> DataFrame:
    """(section, cases): cases that interpret sections with the fragment in their label."""
    hit = edges.where((F.col("relation") == "interprets") & F.col("dst").contains(fragment.lower()))
    return hit.groupBy(F.col("dst").alias("section")).agg(F.countDistinct("src").alias("cases"))


def merge(edges: DataFrame, path: str) -> None:
    """Add (src, dst, relation, o) to the stored graph at ``path``; only the buckets of their sources are read and written, and adding edges again, or in another order, changes nothing."""
    spark = edges.sparkSession
    new = written(first_relations(edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())).withColumn("bucket", F.pmod(F.xxhash64("src"), F.lit(BUCKETS)).cast("int")), "edges")
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most BUCKETS numbers
    old = stored(spark, path).where(F.col("bucket").isin(touched))
    # written apart first: a table cannot be read and replaced in one go
    rows = written(first_relations(old.drop("bucket").unionByName(new.drop("bucket"))).withColumn("bucket", F.pmod(F.xxhash64("src"), F.lit(BUCKETS)).cast("int")), "edges")
    rows.repartition("bucket", F.pmod(F.xxhash64("dst"), F.lit(4))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The graph at ``path``, without edges where none has been stored."""
    return existing(spark, path, EDGES)


def _grams(text: Column) -> Column:
    """The different parts of GRAM letters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - GRAM + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(GRAM))))


def seeds(edges: DataFrame, queries: DataFrame, id_col: str, text_col: str, kinds: tuple[str, ...] = ("Case", "Section")) -> DataFrame:
    """(query id, id): nodes of some kinds whose label holds a query's word of ``GRAM`` letters or more.

    A word in a label has its first letters among the label's parts: words and labels meet there, and only these are compared.
    """
    words = queries.select(id_col, F.explode(F.split(F.lower(text_col), " ")).alias("word")).where(F.length("word") >= GRAM).distinct()
    n = nodes(edges).where(F.col("kind").isin(*kinds)).select("id", "label", F.explode(_grams(F.col("label"))).alias("gram"))
    w = words.select("word", F.substring("word", 1, GRAM).alias("gram")).distinct()
    hit = n.join(w, "gram").where(F.col("label").contains(F.col("word"))).select("word", "id")
    return words.join(hit, "word").select(id_col, "id").distinct()


def related_chunks(edges: DataFrame, chunks: DataFrame, queries: DataFrame, id_col: str, text_col: str, title: str, chunk_id: str, k: int) -> DataFrame:
    """(query id, chunk id, rank): the first ``k`` chunks of the cases that a query's words name, that a named case leads to, or that interpret a named section."""
    named = seeds(edges, queries, id_col, text_col)
    cases = named.select(id_col, F.col("id").alias("node")).where(F.col("node").startswith("Case::"))
    ways = edges.select(F.col("src").alias("id"), F.col("dst").alias("node")).unionByName(edges.where("relation = 'interprets'").select(F.col("dst").alias("id"), F.col("src").alias("node")))
    led = named.join(ways, "id").where(F.col("node").startswith("Case::")).select(id_col, "node")
    cases = cases.unionByName(led).distinct()
    # a query takes k chunks at most, so a case gives no more than its first k
    first = top_k(chunks.select(node_id("Case", F.col(title)).alias("node"), chunk_id, (-F.col(chunk_id)).alias("_s")), k, ["node"], "_s", chunk_id).drop("rank")
    return top_k(cases.join(first, "node"), k, [id_col], "_s", chunk_id).select(id_col, chunk_id, "rank")


def _name_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 2))


def starts(edges: DataFrame, queries: DataFrame, id_col: str, title: str) -> DataFrame:
    """(query id, id): the case of a title, else the case that shares most of its words (of these the first by name); queries without either give no row."""
    cases = nodes(edges).where("kind = 'Case'")
    q = queries.select(id_col, F.col(title).alias("_t"), node_id("Case", F.col(title)).alias("id"))
    exact = q.join(cases.select("id"), "id", "left_semi").select(id_col, "id")
    rest = q.join(exact.select(id_col), id_col, "left_anti").select(id_col, F.explode(_name_tokens(F.col("_t"))).alias("token"))
    shared = rest.join(cases.select("id", F.explode(_name_tokens(F.col("label"))).alias("token")), "token").groupBy(id_col, "id").agg(F.count("*").alias("n"))
    return exact.unionByName(first_per_key(shared, [id_col], [F.desc("n"), F.col("id")]).select(id_col, "id"))


def citation_chain(edges: DataFrame, queries: DataFrame, id_col: str, title: str, depth: int = 2) -> DataFrame:
    """(query id, node, label, hops, parent, relation): the breadth-first tree from each query's case.

    Edges are asked for at each step, so they are made once.
    """
    edges = written(edges.select("src", "dst", "relation"), "edges")
    start = written(starts(edges, queries, id_col, title), "starts")
    tree = neighbours_within(edges.select("src", "dst"), start.select("id").distinct(), depth)
    rel = edges.select(F.col("src").alias("parent"), F.col("dst").alias("node"), "relation")
    tree = tree.join(rel, ["parent", "node"], "left").withColumn("label", F.split("node", "::", 2)[1])
    return start.withColumnRenamed("id", "seed").join(tree, "seed").select(id_col, "node", "label", "hops", "parent", "relation")
