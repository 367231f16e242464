"""Lines that many documents share are dropped from all of them."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

MIN_DOCS, MIN_CHARS = 10, 1
#: White space that a line's key has none of at its ends.
EDGES = " \t\n\x0b\x0c\r"
#: So many frequent keys (16 bytes each) are sent to all executors; more are joined by shuffle.
BROADCAST_KEYS = 1 << 18


def text_lines(text: Column | str) -> Column:
    """The lines of a whole text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(EDGES)), string.ascii_uppercase, string.ascii_lowercase)


def _hashes(key: str) -> list[Column]:
    """Two independent hashes, 128 bits together."""
    return [F.xxhash64(key).alias("key_a"), F.xxhash64(F.lit(0x5EED), key).alias("key_b")]


def frequent_keys(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key_a, key_b, n_docs): the hashes of keys of ``min_chars`` code points or more that ``min_docs`` documents or more hold.

    A document's equal keys are made one before they are counted, so each task adds up the documents of a key
    before anything is shuffled.
    """
    keys = docs.select(F.explode(F.array_distinct(F.transform(text_lines("text"), line_key))).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select(*_hashes("key")).groupBy("key_a", "key_b").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def drop_shared_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) per row of ``docs`` (doc_id, text; other columns are ignored).

    Lines whose key is frequent leave every document, the first one too; the others stay as they were, in order. A
    null or empty text is one empty line. Every row is a document of its own, so repeated rows, and rows that share a
    doc_id or have none, count as often as they are there. A document that loses all its lines has an empty text. An
    empty table gives an empty result.

    Only positions of dropped lines are shuffled and gathered; whole texts move once, to meet them. What they meet by
    is the row's content (doc_id and 128 bits of its text), which is the same after a task is run again; equal rows
    have equal results, and as the side of the positions has one row each, Spark may split the other side of a
    crowded key.
    """
    identity = ["doc_id", "text_a", "text_b"]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("text_a"), F.xxhash64(F.lit(0x5EED), "text").alias("text_b"))
    frequent = stored(frequent_keys(rows, min_docs, min_chars), "frequent-lines")
    if frequent.count() <= BROADCAST_KEYS:
        frequent = F.broadcast(frequent)
    lines = rows.select(*identity, F.posexplode(F.transform(text_lines("text"), line_key)).alias("pos", "key")).where(F.char_length("key") >= min_chars)
    dropped = lines.select(*identity, "pos", *_hashes("key")).join(frequent, ["key_a", "key_b"], "left_semi").groupBy(*identity).agg(F.collect_set("pos").alias("dropped"))
    dropped = dropped.select(F.col("doc_id").alias("dropped_id"), F.col("text_a").alias("dropped_a"), F.col("text_b").alias("dropped_b"), "dropped")
    same = F.col("doc_id").eqNullSafe(F.col("dropped_id")) & (F.col("text_a") == F.col("dropped_a")) & (F.col("text_b") == F.col("dropped_b"))
    found = rows.join(dropped, same, "left").select("doc_id", text_lines("text").alias("lines"), "dropped")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped")), lambda k: F.get("lines", k))
    intact = F.col("dropped").isNull()
    n_dropped = F.when(intact, 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped")
    return found.select("doc_id", F.size("lines").cast("long").alias("n_lines"), n_dropped, F.array_join(F.when(intact, F.col("lines")).otherwise(kept), "\n").alias("kept_text"))


#: The same for DuckDB, over the driver's tables, whose doc_id is unique.
SQL = f"""
with texts as (select doc_id, string_split(coalesce(text, ''), chr(10)) as own from documents),
lines as (select doc_id, unnest(own) as line, unnest(range(len(own))) as pos from texts),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as key from lines),
frequent as (select key from keyed where length(key) >= {MIN_CHARS} group by key having count(distinct doc_id) >= {MIN_DOCS}),
marked as (select keyed.*, frequent.key is not null as gone from keyed left join frequent using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""
