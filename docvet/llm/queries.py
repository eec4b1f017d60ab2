"""One query per operator over the whole table it is meant for, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docvet.llm.common import materialise, read_table
from docvet.llm.op1_simhash import simhash_groups
from docvet.llm.op2_pii import KINDS, find_pii, fit_pii, joined_spans
from docvet.llm.op3_html import main_text
from docvet.llm.op4_decontaminate import benchmark_hits, contamination
from docvet.llm.op4_decontaminate import oracle as hit_oracle
from docvet.llm.op5_line_dedup import drop_boilerplate_lines
from docvet.llm.op5_line_dedup import oracle as line_oracle
from docvet.llm.op6_permutation_index import build_index, search
from docvet.llm.op7_shards import minimax_shards
from docvet.llm.op8_bpe import encode_decode, token_digests
from docvet.llm.op9_language import fit_language, identify
from docvet.llm.op10_toxicity import fit_toxicity, toxicity
from docvet.llm.op11_prefix_trie import SPAN, in_order, prefix_trie, turn_symbols
from docvet.llm.op11_prefix_trie import oracle as trie_oracle
from docvet.llm.op12_runs import periodic_runs
from docvet.llm.op13_cross_polytope import embedding_groups

#: The public vocabulary that the contract of the encoding query names.
BPE_FILE = "byte_bpe_50k.json"


def bpe_path(name: str = BPE_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(read_table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    hexa = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups.select("doc_id", hexa.alias("fingerprint"), "component_id", "n_copies")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = find_pii(docs, fit_pii(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"),
        joined_spans(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        "settled",
    )


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = main_text(read_table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), window=13)
    return contamination(hits).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        "contaminated",
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate_lines(docs).select("doc_id", "text", "n_lines", "n_dropped")


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(read_table(spark, sf_dir, "embeddings"))
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, index.table.filter("id % 100 = 0"), k=10)


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = minimax_shards(read_table(spark, sf_dir, "documents"), shards=40, overhead=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_digests(encode_decode(docs, bpe_path(), columns=["doc_id"]), "doc_id")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit_language(docs.filter(~held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, pos, symbol, words) of the contract's rebuilt conversations, and all their ids.

    Conversation c is the first h turns of c - c % 20, then its own behind its first h.
    """
    turns = in_order(turn_symbols(conversations), "conv", F.col("turn").asc_nulls_first(), "symbol")
    turns = materialise(turns, "turns")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % 4).cast("int")
    heads = turns.filter("pos < 3").groupBy(F.col("conv").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("pos", "symbol", "words"))).alias("head"))
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumn("base", F.col("conv") - F.col("conv") % 20)
    taken = F.coalesce(F.slice("head", F.lit(1), h), F.array().cast(heads.schema["head"].dataType))
    convs = materialise(convs.join(heads, "base", "left").select("conv", "n", taken.alias("head")), "rebuilt")
    first = convs.select("conv", F.explode("head").alias("t")).select("conv", "t.pos", "t.symbol", "t.words")
    # turns move up where the other conversation is shorter than h; keyed by stretch, so that a long one is dealt
    stretch = F.floor(F.col("pos") / SPAN)
    moved = convs.select("conv", (h - F.size("head")).alias("up"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / SPAN))).alias("stretch"))
    own = turns.filter(F.col("pos") >= h).withColumn("stretch", stretch).join(moved.filter("up > 0"), ["conv", "stretch"], "left")
    own = own.select("conv", (F.col("pos") - F.coalesce("up", F.lit(0))).alias("pos"), "symbol", "words")
    return first.union(own), convs.select("conv")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    trie = prefix_trie(*rebuilt_turns(read_table(spark, sf_dir, "conversations")))
    return trie.drop("name", "parent")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, where the contract's tenth of the texts repeats a stretch of its words to the end."""
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    keyed = docs.select("doc_id", "text", (code % 10 == 0).alias("planted"), F.floor(code / 10).alias("g"))
    keyed = keyed.withColumn("w", F.when(F.col("planted"), words)).withColumn("n", F.size("w").cast("long"))
    keyed = keyed.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    keyed = keyed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = F.transform("w", lambda w, i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    text = F.array_join(F.transform(place, lambda i: F.get("w", i.cast("int"))), " ")
    return keyed.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(read_table(spark, sf_dir, "documents")), min_length=24, min_exponent=3)
    # the greatest length / period, compared by cross products; of equal ones the first in the list
    better = lambda a, b: F.coalesce(b["length"] * a["period"] > a["length"] * b["period"], F.lit(True))
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", none, lambda a, b: F.when(better(a, b), b).otherwise(a))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(read_table(spark, sf_dir, "embeddings"), threshold=0.95)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_pii": op2_pii,
    "op3_html": op3_html,
    "op4_decontaminate": op4_decontaminate,
    "op5_line_dedup": op5_line_dedup,
    "op6_permutation_index": op6_permutation_index,
    "op7_shards": op7_shards,
    "op8_bpe": op8_bpe,
    "op9_language": op9_language,
    "op10_toxicity": op10_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_runs": op12_runs,
    "op13_cross_polytope": op13_cross_polytope,
}

ORACLE = {"op4_decontaminate": hit_oracle(), "op5_line_dedup": line_oracle(), "op11_prefix_trie": trie_oracle()}
