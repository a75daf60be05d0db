"""The registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumwright.llm import (
    decontaminate,
    line_dedup,
    mixing,
    pii,
    quality,
    runs,
    simhash,
    suffix_dedup,
    token_counts,
    topk,
    toxicity,
    trie,
    url_filter,
)
from sumwright.llm.shared import held_out, materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Verdicts given by hand.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Words between dots and hyphens of a host that mark its URLs as bad for training.
BAD_WORDS = ("adult", "ads", "bets", "casino", "pills", "spam")


@query("op1_url_filter")
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The tables hold no labels of URLs; hosts with one of :data:`BAD_WORDS` stand for them."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    words = F.split(url_filter.host_of(F.col("url")), "[.-]")
    bad = F.arrays_overlap(words, F.array(*[F.lit(w) for w in BAD_WORDS]))
    labelled = pages.select("url", F.coalesce(bad, F.lit(False)).cast("int").alias("label"))
    return url_filter.judge(pages, url_filter.train(pages, labelled), URL_RULES).drop("url")


SQL_MIX = r"""
    sized AS (SELECT doc_id, source,
        CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
    totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
    ranked AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS w
        FROM totals),
    parts AS (SELECT sum(source_size) OVER () AS t,
        coalesce(sum(3 * source_size) OVER upto, 0) AS c, sum(w) OVER () - coalesce(sum(w) OVER upto, 0) AS rest
        FROM ranked WINDOW upto AS (ORDER BY 3.0 * source_size / w, source NULLS LAST
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    level AS (SELECT max(CAST(t - c AS DOUBLE) / CAST(rest AS DOUBLE)) AS level FROM parts WHERE rest > 0),
    targets AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), level * CAST(w AS DOUBLE)) AS target
        FROM ranked, level),
    rated AS (SELECT s.doc_id, s.size, source_size, target,
        CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0.0 END AS rate,
        CAST(CAST('0x' || left(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 13) AS BIGINT) AS DOUBLE)
          / 4503599627370496.0 AS u
        FROM sized s JOIN targets g ON s.source IS NOT DISTINCT FROM g.source)
"""


@query(
    "op2_mix_sources",
    f"""WITH {SQL_MIX} SELECT doc_id, size, source_size, target,
      size * (CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM rated""",
)
def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    mixed = mixing.plan(docs, weights=(5, 2, 1), max_rate=3)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op3_decontaminate")
def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


@query("op4_quality")
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    described = materialize(quality.described(table(spark, folder, "documents")), "statistics")
    marked = table(spark, folder, "labels").where(~held_out(F.col("doc_id")))
    marked = marked.select("doc_id", F.col("quality").alias("label")).where("label is not null")
    rules = quality.learn(described.join(marked, "doc_id"))
    scores = quality.score_documents(described, rules)
    predicted = (F.col("score") >= 0.3).cast("int")
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def toxic_lexicon(docs: DataFrame, spark: SparkSession, folder: str) -> toxicity.Lexicon:
    """Learned from labelled rows that are not held out; of either label a bounded sample.

    The sample of ids is drawn first and is small enough to be sent to all executors, so that no
    text moves but those of the sample.
    """
    labels = table(spark, folder, "labels").where(~held_out(F.col("doc_id")))
    chosen = toxicity.sample(labels.select("doc_id", F.col("toxic").alias("label")))
    return toxicity.learn(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scores = toxicity.score_documents(docs, toxic_lexicon(docs, spark, folder))
    predicted = (F.col("score") >= 0.5).cast("int")
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


@query("op6_simhash")
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op7_pseudonyms")
def op7_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, key="a key for examples only")


SQL_LINES = r"""
    paged AS (SELECT rowid AS page, doc_id, source, text FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
    lines AS (SELECT page, source, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM paged WHERE text IS NOT NULL),
    bare AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM lines),
    totals AS (SELECT source, count(*) AS pages FROM paged GROUP BY source),
    frequent AS (SELECT b.source, key FROM bare b JOIN totals t ON b.source IS NOT DISTINCT FROM t.source
        WHERE key <> '' GROUP BY b.source, key, pages
        HAVING count(DISTINCT page) >= 2 AND count(DISTINCT page) > pages * CAST(0.05 AS DOUBLE)),
    marked AS (SELECT b.*, f.key IS NOT NULL AS drops FROM bare b
        LEFT JOIN frequent f ON b.source IS NOT DISTINCT FROM f.source AND b.key = f.key),
    kept AS (SELECT page, count(*) AS n_lines, count(*) FILTER (drops) AS n_drops,
        count(*) FILTER (NOT drops AND key <> '') AS n_left,
        string_agg(line, chr(10) ORDER BY nth) FILTER (NOT drops) AS rest FROM marked GROUP BY page)
"""


@query(
    "op8_line_dedup",
    f"""WITH {SQL_LINES} SELECT doc_id, coalesce(n_lines, 0) AS n_lines,
      CASE WHEN n_left > 0 THEN n_drops ELSE 0 END AS n_dropped,
      CASE WHEN n_drops > 0 AND n_left > 0 THEN rest ELSE text END AS text
      FROM paged LEFT JOIN kept USING (page)""",
)
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, ratio=0.05, min_pages=2).drop("source")


SQL_VECTORS = """usable AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


@query(
    "op9_top_k",
    f"""WITH {SQL_VECTORS}, scored AS (SELECT q.vec_id AS query_id, c.vec_id,
        CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
        FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
      ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
        FROM scored)
      SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
)
def op9_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, k=5)


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A new cache for every run, so that each distinct text is encoded once."""
    return token_counts.count_tokens(table(spark, folder, "documents"), "byte_bpe_50k.json", limit=512)


@query("op11_suffix_dedup")
def op11_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.drop_repeats(table(spark, folder, "documents").select("doc_id", "text"), length=100)
    sizes = F.transform("removed", lambda s: s["end"] - s["begin"])
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


# One round of the CRC-32 per byte; 3988292384 is its polynomial.
SQL_TRIE = r"""
    ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
    checked AS (SELECT conv_id, CAST(xor(list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
        lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])),
            lambda a, i: xor(a >> 1, CAST(3988292384 AS BIGINT) * (a & 1)))), CAST(4294967295 AS BIGINT)) % 6 AS BIGINT) AS h FROM ids),
    said AS (SELECT conv_id, turn, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t FROM conversations
        WHERE conv_id IS NOT NULL),
    own AS (SELECT conv_id, list(t ORDER BY turn NULLS FIRST, md5(concat(length(t.role), ':', t.role, t.text))) AS turns
        FROM said GROUP BY conv_id),
    rebuilt AS (SELECT o.conv_id, list_concat(coalesce(b.turns[1:h], []), o.turns[h + 1:]) AS turns
        FROM own o JOIN checked USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
    prefixes AS (SELECT conv_id, len(turns) AS n, unnest(range(len(turns) + 1)) AS depth, turns FROM rebuilt),
    members AS (SELECT conv_id, n, depth, turns[1:depth] AS prefix FROM prefixes),
    nodes AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
        FROM members GROUP BY prefix, depth),
    kids AS (SELECT p.prefix, p.depth, count(c.depth) AS n_children FROM nodes p
        LEFT JOIN nodes c ON c.depth = p.depth + 1 AND c.prefix[1:p.depth] = p.prefix GROUP BY p.prefix, p.depth),
    full_nodes AS (SELECT n.*, n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * length(n.prefix[n.depth].text) END AS own
        FROM nodes n JOIN kids USING (prefix, depth)),
    below AS (SELECT prefix, own, n_children, unnest(range(depth + 1)) AS up FROM full_nodes),
    sums AS (SELECT prefix[1:up] AS prefix, up AS depth, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves,
        CAST(sum(own) AS BIGINT) AS saved_tokens FROM below GROUP BY 1, 2)
"""


@query(
    "op12_conversation_trie",
    f"""WITH {SQL_TRIE} SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves,
      saved_tokens, n.ends_sha256 FROM full_nodes n JOIN sums USING (prefix, depth)
      LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]""",
)
def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations of a block share first turns, so that there are prefixes to count."""
    rebuilt = trie.with_common_heads(trie.paths(table(spark, folder, "conversations")))
    nodes, ends = trie.trie(rebuilt)
    digests = trie.ends_sha256(ends).withColumnsRenamed({"node_conv_id": "conv_id"})
    found = nodes.join(digests, ["conv_id", "depth"], "left")
    digest = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), digest.alias("ends_sha256"),
    )


@query("op13_word_runs")
def op13_word_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    docs = docs.select("doc_id", runs.periodic(F.col("text"), F.col("doc_id")).alias("text"))
    found = runs.find_runs(docs).withColumn("best", runs.strongest(F.col("runs")))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
