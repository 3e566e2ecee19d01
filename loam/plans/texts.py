"""Classification, parsing and segmentation of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions.vectors import top_per_key
from loam.operators import texts
from loam.registry import Registry
from loam.sources.tables import table

REGISTRY = Registry()


@REGISTRY.query(r"""
SELECT item_id, CASE WHEN regexp_matches(text, '(?i)\b(when|yesterday|today|last|ago|before|after|since|recent)\b') THEN 'TEMPORAL' WHEN regexp_matches(text, '(?i)\b(what|who|which|where|how many)\b') THEN 'FACTUAL' ELSE 'SEMANTIC' END AS kind FROM benchmark""")
def query_type(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", texts.first_match(F.col("text"), texts.QUERY_RULES, "SEMANTIC").alias("kind"))


@REGISTRY.query(r"""
SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\b(todo|task|need to|deadline|remind)\b') THEN 'TASK' WHEN regexp_matches(text, '(?i)\b(i am|my name|i prefer|always|never)\b') THEN 'IDENTITY'
 WHEN regexp_matches(text, '(?i)\b(project|repo|release|deploy|sprint)\b') THEN 'PROJECT' ELSE 'SESSION' END AS layer FROM conversations""")
def layer_classify(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.first_match(F.col("text"), texts.LAYER_RULES, "SESSION").alias("layer"))


@REGISTRY.query(r"""
SELECT doc_id, regexp_matches(text, '(?i)\b(token|password|api[_ ]?key|secret)\b') AS secret, regexp_matches(text, '\+\d{1,3} \(\d{3}\) \d{3}-\d{4}') AS phone, regexp_matches(text, '\b\d{16}\b') AS card, regexp_matches(text, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b') AS address FROM documents""")
def safety_patterns(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", *[t.rlike(("(?i)" if k == "secret" else "") + p).alias(k) for k, p in texts.SAFETY_PATTERNS.items()])


@REGISTRY.query("""
WITH w AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN format('${:,.2f}', o_totalprice) WHEN 1 THEN format('{:,}', o_orderkey * 1000) WHEN 2 THEN format('{:.2f}%', (o_orderkey % 10000) / 100.0::DOUBLE)
  WHEN 3 THEN '< 10%' WHEN 4 THEN 'No data' WHEN 5 THEN '--' ELSE '0' END AS x FROM orders)
SELECT o_orderkey AS id, x AS written, TRY_CAST(regexp_replace(x, '[$,\\s]', '', 'g') AS DOUBLE) AS currency,
  CASE WHEN trim(x) = '0' THEN NULL ELSE TRY_CAST(regexp_replace(x, '[%,\\s]', '', 'g') AS DOUBLE) / 100 END AS percent, TRY_CAST(regexp_replace(x, '[,\\s]', '', 'g') AS DOUBLE) AS number FROM w""")
def locale_numbers(spark, sf_dir):
    """Prices, counts and shares of orders as reports write them, and what is read from each."""
    kind, key = F.col("o_orderkey") % 7, F.col("o_orderkey")
    written = (
        F.when(kind == 0, F.concat(F.lit("$"), F.format_number("o_totalprice", 2)))
        .when(kind == 1, F.format_number(key * 1000, 0))
        .when(kind == 2, F.concat(F.format_number(key % 10000 / 100.0, 2), F.lit("%")))
        .when(kind == 3, "< 10%")
        .when(kind == 4, "No data")
        .when(kind == 5, "--")
        .otherwise("0")
    )
    x = F.col("written")
    d = table(spark, sf_dir, "orders").select(key.alias("id"), written.alias("written"))
    return d.select("id", "written", texts.parse_currency(x).alias("currency"), texts.parse_percent(x).alias("percent"), texts.parse_number(x).alias("number"))


@REGISTRY.query("SELECT doc_id, substr(sha256(concat_ws(':', source, lang, n_chars::VARCHAR, doc_id::VARCHAR)), 1, 16) AS dedupe_key FROM documents")
def dedupe_key(spark, sf_dir):
    key = F.substring(F.sha2(F.concat_ws(":", "source", "lang", F.col("n_chars").cast("string"), F.col("doc_id").cast("string")), 256), 1, 16)
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("dedupe_key"))


@REGISTRY.query("""
WITH h AS (SELECT source, count(*) AS n, sum(('0x' || substr(md5(coalesce(text, '')), 1, 15))::HUGEINT)::VARCHAR AS a, sum(('0x' || substr(md5(coalesce(text, '')), 16, 15))::HUGEINT)::VARCHAR AS b FROM documents GROUP BY source)
SELECT source, sha256(concat_ws(':', n::VARCHAR, a, b)) AS now, right(source, 1) = '3' OR source IS NULL AS run FROM h""")
def input_hash(spark, sf_dir):
    """One hash of all inputs of a scope, whatever their order: of their number and the
    sums of two parts of their hashes, which are summed before they are shuffled."""
    part = lambda at: F.sum(F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    per = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").cast("string").alias("n"), part(1).alias("a"), part(16).alias("b"))
    return per.select("source", F.sha2(F.concat_ws(":", "n", "a", "b"), 256).alias("now"), ((F.substring("source", -1, 1) == "3") | F.col("source").isNull()).alias("run"))


@REGISTRY.query("""
WITH w AS (SELECT source, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) > 3)) AS w FROM documents), c AS (SELECT source, w, count(*) AS n FROM w GROUP BY 1, 2)
, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, w) AS r FROM c) SELECT source, string_agg(w, ' ' ORDER BY r) AS label FROM r WHERE r <= 3 GROUP BY source""")
def label_top_words(spark, sf_dir):
    """The three most frequent longer words of each cluster."""
    words = table(spark, sf_dir, "documents").select("source", F.explode(F.split(F.lower("text"), "[^a-z]+", -1)).alias("w")).where("length(w) > 3")
    counts = words.groupBy("source", "w").agg(F.count("*").alias("n"))
    best = top_per_key(counts, ["source"], [F.desc("n"), F.asc("w")], 3, "r")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("r", "w"))), lambda x: x["w"])
    return best.groupBy("source").agg(F.array_join(ordered, " ").alias("label"))


@REGISTRY.query("SELECT conv_id, turn, concat_ws(' | ', role, 'turn ' || turn, text) AS enriched FROM conversations")
def enrichment_prefix(spark, sf_dir):
    text = F.concat_ws(" | ", "role", F.concat(F.lit("turn "), F.col("turn")), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("enriched"))


@REGISTRY.query(r"""
SELECT conv_id, turn, regexp_matches(text, '[0-9]+') AS number, regexp_matches(text, '[a-z,] [A-Z][a-z]+') AS name, regexp_matches(text, '(?i)\b(like|love|prefer|hate)\b') AS preference FROM conversations""")
def durability_signals(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", t.rlike("[0-9]+").alias("number"), t.rlike("[a-z,] [A-Z][a-z]+").alias("name"), t.rlike(r"(?i)\b(like|love|prefer|hate)\b").alias("preference")
    )


@REGISTRY.query("""
WITH n AS (SELECT item_id, array_to_string(string_split(lower(text), ' ')[1:3], ' ') AS name FROM benchmark),
d AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS name FROM (SELECT doc_id, string_split(lower(text), ' ') AS w, unnest(range(1, greatest(len(string_split(text, ' ')) - 1, 2))) AS i FROM documents))
SELECT item_id, doc_id FROM n JOIN d USING (name)""")
def entity_mentions(spark, sf_dir):
    """Documents that hold a name of three words, found by their runs of three."""
    words = lambda: F.split(F.lower("text"), " ", -1)
    names = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(words(), 1, 3), " ").alias("name"))
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.array_join(F.slice(w, i, 3), " "))
    held = F.array_distinct(F.element_at(F.transform(F.array(words()), runs), 1))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(held).alias("name")).join(names, "name").select("item_id", "doc_id")


@REGISTRY.query()
def segment_text(spark, sf_dir):
    return texts.segments(table(spark, sf_dir, "documents"), "doc_id", "text")


@REGISTRY.query()
def chunk_transcript(spark, sf_dir):
    return texts.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@REGISTRY.query()
def context_budget(spark, sf_dir):
    """Turns of each conversation that fit 400 tokens of four characters."""
    c = table(spark, sf_dir, "conversations").withColumn("tokens", F.ceil(F.length("text") / 4))
    return texts.fitting_rows(c, "conv_id", ["turn"], "tokens", 400).select("conv_id", "turn", "tokens")
