"""The queries of problems 4, 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.encoding import encode
from tidemark.llm.mojibake import byte_of, fit_model, recover
from tidemark.llm.packing import CAPACITY, pack_items
from tidemark.llm.splitting import LIMIT, OVERLAP, split_texts
from tidemark.tables import load


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_texts(load(spark, sf_dir, "corpus"), "paper_id", "text").withColumnRenamed("item_id", "paper_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the cuts: a text in several pieces was too long, and it is hard if a cut went through a stretch that no piece could
    have held; every such stretch is cut, as no piece is longer than the limit."""
    by = p4_pieces(spark, sf_dir).filter("n_pieces > 1").groupBy("paper_id").agg(F.max("unbroken").alias("longest"))
    return by.select("paper_id", F.when(F.col("longest") > LIMIT, "hard").otherwise("soft").alias("kind"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(load(spark, sf_dir, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = encode(load(spark, sf_dir, "documents"), "doc_id", "text", lengths_only=True)
    return pack_items(sizes, "doc_id", "n_tokens").withColumnRenamed("item_id", "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recover(load(spark, sf_dir, "documents"), "doc_id", "text")
    md5 = F.md5(F.encode("restored", "utf-8"))
    return found.select("doc_id", F.when(F.col("lost"), "").otherwise(md5).alias("restored_md5")).distinct()


def p9_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents packed by their length in characters, counted again from the containers: pieces and characters placed,
    documents, containers over the capacity, empty numbers, and whether at most a hundredth more containers were needed
    than the characters fill."""
    docs = load(spark, sf_dir, "documents")
    packed = pack_items(docs.select("doc_id", F.length("text").alias("size")), "doc_id", "size")
    loads = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("load"), F.count("*").alias("pieces"))
    whole = packed.groupBy("item_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"))
    split = whole.agg(F.count("*").alias("documents"), F.sum(F.when((F.col("k") > 1) & (F.col("n") <= CAPACITY), 1).otherwise(0)).alias("split_in_vain"))
    sums = loads.agg(F.sum("pieces").alias("pieces"), F.sum("load").alias("characters"), F.sum((F.col("load") > CAPACITY).cast("int")).alias("overfull"), (F.max("container_id") + 1 - F.count("*")).alias("gaps"), (F.count("*") <= F.ceil(F.sum("load") / CAPACITY * 1.01)).alias("tight"))
    return sums.withColumn("one", F.lit(1)).join(split.withColumn("one", F.lit(1)), "one").drop("one")  # one row each


def p10_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paper's text that is not plain ASCII, wrongly decoded as cp1252 here and restored by a model of the documents."""
    papers = load(spark, sf_dir, "corpus").filter("text rlike '[^\\\\x00-\\\\x7f]'").select("paper_id", "text")
    bytes_ = F.encode("text", "utf-8")
    garbled = papers.select("paper_id", _as_cp1252(bytes_).alias("text"))
    model = fit_model(load(spark, sf_dir, "documents"), "text")
    return recover(garbled, "paper_id", "text", model).select(F.col("doc_id").alias("paper_id"), F.md5(F.encode("restored", "utf-8")).alias("restored_md5")).distinct()


def _as_cp1252(bytes_):
    """Bytes read as cp1252; those it leaves undefined become the controls of their number."""
    read = {b: chr(c) for c, b in byte_of("cp1252").items()}
    return F.translate(F.decode(bytes_, "iso-8859-1"), "".join(map(chr, read)), "".join(read.values()))


# the walk from cut to cut, one at a time, each cut looked for by patterns that match as much as they can
_ENDS = {
    "paragraph": r"^((?s:.*)(?:\n[ \t\r]*\n|\r[ \t\r]+\n|\n[ \t]*\r|\r[ \t]*\r))",
    "sentence": r"^((?s:.*)(?:[。！？\n\r]|[.!?…][\"'')\]}»”’]?[ \t\n\r]))",
    "word": r"^((?s:.*)[ \t\n\r。！？])",
}

SQL = {
    "p9_audit": f"""with s as (select doc_id, length(text) n from documents where length(text) > 0)
        select cast(sum((n + {CAPACITY - 1}) // {CAPACITY}) as bigint) pieces, cast(sum(n) as bigint) characters, 0 overfull, cast(0 as bigint) gaps, true tight, count(*) documents, 0 split_in_vain from s""",
    "p10_roundtrip": r"select distinct paper_id, md5(text) restored_md5 from corpus where regexp_matches(text, '[^\x00-\x7f]')",
    "p4_pieces": f"""with recursive t as (select row_number() over () id, paper_id, text, length(text) n from corpus where text <> ''),
        w as (select id, 0::bigint piece_no, 0::bigint b, 0::bigint reach, 0::bigint cut, false done from t
          union all
          select id, piece_no + 1, cut, reach, case when reach >= n then n when p > least_at then p when s > least_at then s when d > cut then d else reach end, reach >= n
          from (select *, length(regexp_extract(x, '{_ENDS["paragraph"]}', 1)) p, length(regexp_extract(x, '{_ENDS["sentence"]}', 1)) s, length(regexp_extract(x, '{_ENDS["word"]}', 1)) d
            from (select *, case when text[reach:reach] = chr(13) and text[reach + 1:reach + 1] = chr(10) then text[1:reach - 1] else text[1:reach] end x
              from (select w.id, piece_no, cut, n, text, least(n, cut + step) reach, cut + step // 2 least_at from
                (select *, case when piece_no = 0 then {LIMIT} else {LIMIT - OVERLAP} end step from w where not done) w join t on t.id = w.id)))),
        p as (select w.id, piece_no - 1 piece_no, greatest(0, case when piece_no = 1 then 0 else b - {OVERLAP} end) "begin", cut "end", count(*) over (partition by w.id) n_pieces from w where piece_no > 0)
        select paper_id, cast(piece_no as int) piece_no, cast(n_pieces as int) n_pieces, cast("begin" as int) "begin", cast("end" as int) "end", text["begin" + 1:"end"] piece, cast(n as int) n_chars,
          cast(case when "end" = n then 0 when l > 0 and r > 0 then l + r else 0 end as int) unbroken
        from (select p.*, paper_id, text, n, length(regexp_extract(text[1:"end"], '([^ \t\n\r。！？]*)$', 1)) l, length(regexp_extract(text["end" + 1:], '^([^ \t\n\r。！？]*)', 1)) r from p join t using (id))""",
    "p4_found": """
        select distinct paper_id, case when list_max(list_transform(regexp_split_to_array(text, '[ \\t\\n\\r。！？]'), lambda x: length(x))) > 1500 then 'hard' else 'soft' end kind
        from corpus where length(text) > 1500""",
}

QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces, "p8_ids": p8_ids, "p9_containers": p9_containers, "p9_audit": p9_audit, "p10_found": p10_found, "p10_roundtrip": p10_roundtrip}
