"""Queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, langid, neighbours, ngram_join, pitman_yor, repeats, sentencepiece_codec, sstable, toxicity, warc
from tessera.llm.common import Stash, crc_mod, documents, ship

PIECE_MODEL, WORD_MODEL = "piece_bpe_32k.model", "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of every whole text through SentencePiece ids."""
    return sentencepiece_codec.round_trip(documents(spark, sf_dir), tokenizer_path(PIECE_MODEL)).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written as sorted-string-table shards and read back."""
    stash = Stash(spark, "op5")
    folder = f"{stash.root}/shards"
    manifest = stash.keep(sstable.write(documents(spark, sf_dir), tokenizer_path(WORD_MODEL), folder), "manifest")
    return sstable.read(spark, manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingles have a Jaccard similarity of 0.75 or more."""
    return ngram_join.join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "n_links")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the bytes of strings of 100 bytes that start earlier."""
    return repeats.remove(documents(spark, sf_dir)).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learnt from three quarters of the documents."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learnt from four fifths of the labels."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(crc_mod("doc_id", 5) != 0))
    scored = toxicity.score(docs, model)
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every whole text under a hierarchical Pitman-Yor model of nine tenths of them."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    n, total = pitman_yor.extent(docs, "text")
    shard = pitman_yor.chunks("text", F.col("file"), F.col("row"), n, total)
    learn = F.coalesce(crc_mod("doc_id", 10) != 0, F.lit(True))
    scored = pitman_yor.score(docs, learn, shard=shard, parts=pitman_yor.parts_for(total))
    return scored.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products found for every vector whose id is divisible by 20."""
    ship(spark)
    return neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, in whatever order of its parts."""
    found = decontaminate.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "item_words", "covered", "longest", F.size("tiles").alias("n_tiles"), F.round(F.col("covered") / F.col("item_words"), 6).alias("coverage"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits of all pages, written to and read from WARC files, with the responses that they stand for."""
    ship(spark)
    stash = Stash(spark, "op7")
    folder = f"{stash.root}/warc"
    names = stash.keep(warc.write(warc.captures(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder), "names")
    names = names.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
    heads = stash.keep(warc.read(spark, names, folder, ("record_id", "warc_type", "uri", "date", "status", "headers")), "heads")
    done = warc.resolve(heads, bodies=warc.read(spark, names, folder, ("record_id", "body")))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return done.select("record_id", "url", "original_id", "outcome", headers.alias("headers"), F.md5("body").alias("body_md5"))


OP7_SQL = r"""
with parts as (
  select page_id, url, md5(coalesce(html, '')) as tag,
    regexp_extract(url, '^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$', 1) as p1,
    regexp_extract(url, '^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$', 2) as p2,
    regexp_extract(url, '^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$', 3) as p3,
    regexp_extract(url, '^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$', 4) as p4
  from pages where page_id is not null),
named as (
  select page_id, tag, case when p1 = '' then trim(url) else
      lower(p1) || '://' ||
      (case when lower(p1) = 'http' then regexp_replace(lower(p2), ':80$', '') when lower(p1) = 'https' then regexp_replace(lower(p2), ':443$', '') else lower(p2) end) ||
      (case when p3 = '' then '/' else p3 end) ||
      (case when p4 = '' then '' else '?' || array_to_string(list_sort(list_filter(string_split(p4, '&'), lambda x: x <> '')), '&') end) end as canon
  from parts),
visits as (
  select page_id, tag, canon, k, 1700000000 + page_id * 60 + k * 864000 as t from named, (select 1 as k union all select 2)),
latest as (
  select v.page_id, v.k, max(o.t * 1.0) as t from visits v join (select canon, 1700000000 + page_id * 60 as t from named) o on o.canon = v.canon and o.t < v.t group by v.page_id, v.k),
paired as (
  select v.*, o.page_id as origin, o.tag as stored from visits v
  left join latest l on l.page_id = v.page_id and l.k = v.k
  left join (select page_id, tag, canon, 1700000000 + page_id * 60 as t from named) o on o.canon = v.canon and o.t = l.t),
judged as (
  select *, case when k = 2 and page_id % 5 = 0 then null when k = 2 and page_id % 3 = 0 then 'other' else tag end as asked from paired)
select 'urn:capture:' || k || ':' || page_id as record_id, canon as url,
  case when origin is null then null else 'urn:capture:0:' || origin end as original_id,
  case when origin is null then 'no_original' when asked is null then 'unchecked' when asked = stored then 'resolved' else 'mismatch' end as outcome,
  case when k = 1 and (origin is not null and asked = stored) then 'content-type=text/html|date=second|etag=W/"' || asked || '"'
       when k = 1 then 'date=second|etag=W/"' || asked || '"|server=x'
       when origin is not null and asked is null then 'content-type=text/html|date=first|etag="' || stored || '"|vary=accept'
       when asked is null then 'vary=accept'
       when origin is not null and asked = stored then 'content-type=text/html|date=first|etag="' || asked || '"|vary=accept'
       else 'etag="' || asked || '"|vary=accept' end as headers,
  case when origin is not null and (asked is null or asked = stored) then stored end as body_md5
from judged
"""

QUERIES = {"op7_warc_revisits": op7_warc_revisits, "op3_decontaminate": op3_decontaminate, "op4_neighbours": op4_neighbours, "op10_pitman_yor": op10_pitman_yor, "op9_toxicity": op9_toxicity, "op8_language": op8_language, "op6_suffix_dedup": op6_suffix_dedup, "op2_ngram_join": op2_ngram_join, "op1_sentencepiece": op1_sentencepiece, "op5_token_shards": op5_token_shards}
ORACLES: dict[str, str] = {"op7_warc_revisits": OP7_SQL}
