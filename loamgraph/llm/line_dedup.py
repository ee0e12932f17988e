"""Line dedup by a deletion-neighbourhood join (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.llm.common import stored, words

#: Stands for a null doc_id where ids are compared; it comes before all others.
NO_ID = -(1 << 63)
#: A line's place; places are ordered by it. Rows differ in their doc, their text or, where both are the same, their number alone.
PLACE = ["doc", "text_key", "rid", "line_no"]


def _rows(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc, text_key, text)``: rows alike in ``doc`` and ``text_key`` have the same lines."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _half_keys(w: Column, n: Column) -> Column:
    """Hashes of the two halves of a line, cut as for its own length and for one word less.

    Lines of n and m words at one edit share the first half or the last half as cut for min(n, m): the edit falls on one side.
    """
    keys = []
    for size in (n, n - 1):
        half = F.floor(size / 2).cast("int")
        keys.append(F.xxhash64(size, F.lit("first"), F.slice(w, F.lit(1), half)))
        keys.append(F.xxhash64(size, F.lit("last"), F.slice(w, n - (size - half) + 1, size - half)))
    return F.array(*keys)


def line_keys(docs: DataFrame, *, row: str | None = None) -> DataFrame:
    """``(doc, text_key, rid, line_no, n, k1, k2, halves)``: what the search needs of each line; 128 bits stand for its words.

    ``rid`` tells rows of the table apart: the column ``row``, or a number that holds only within what is stored of this table.
    """
    rid = F.col(row) if row else F.monotonically_increasing_id()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("text_key"), rid.alias("rid"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    rows = rows.select("doc", "text_key", "rid", "line_no", words(F.col("line")).alias("w")).where(F.size("w") > 0).withColumn("n", F.size("w"))
    keys = F.xxhash64("w").alias("k1"), F.xxhash64(F.lit(1), "w").alias("k2"), _half_keys(F.col("w"), F.col("n")).alias("halves")
    return rows.select(*PLACE, "n", *keys)


def classes(lines: DataFrame) -> DataFrame:
    """One row for each different line: its keys, its words' number, its halves, and the place of its earliest copy."""
    first = F.min(F.struct(*PLACE)).alias("at")
    rows = lines.groupBy("k1", "k2").agg(first, F.first("n").alias("n"), F.first("halves").alias("halves"))
    return rows.select("k1", "k2", "n", "halves", "at.*")


def with_half_in_common(distinct: DataFrame, *, min_words: int) -> DataFrame:
    """The rows of ``classes`` that share half of themselves with another; all others are at two edits or more from any line.

    They are put in order of their places and numbered by it (``at``), so that what follows compares places by one number.
    """
    # An edit may take a word off: the shorter line of a pair may have one word less than min_words.
    keys = distinct.where(F.col("n") >= min_words - 1).select("k1", "k2", F.explode("halves").alias("half"))
    shared = keys.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    some = keys.join(shared, "half", "left_semi").select("k1", "k2").distinct()
    rows = distinct.join(some, ["k1", "k2"], "left_semi").select("k1", "k2", "n", *PLACE)
    return rows.orderBy(*PLACE).select(F.monotonically_increasing_id().alias("at"), "k1", "k2", "n", "doc", "text_key", "line_no")


def _texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``(at, n, w)``: the words of the lines at ``places``; documents are matched whole, then only those lines are cut out."""
    wanted = places.groupBy("doc", "text_key").agg(F.collect_list(F.struct("at", "line_no", "n")).alias("wanted"))
    rows = _rows(docs).join(wanted, ["doc", "text_key"]).select(F.split("text", "\n").alias("lines"), F.explode("wanted").alias("x"))
    # Equal rows give their lines more than once.
    return rows.select("x.at", "x.n", words(F.get("lines", F.col("x.line_no"))).alias("w")).dropDuplicates(["at"])


def variants(lines: DataFrame) -> DataFrame:
    """``lines(at, n, w)`` -> ``(size, key, gone, at)``: the whole line (gone 0), and the line without its gone-th word.

    A key is the XOR of the hashes of a variant's (word, place) pairs. Running XORs give the keys of all n variants of a line
    in one pass over its words: before the gap each word keeps its place, behind it each moves up by one.
    """
    w = lines.select("at", "n", F.posexplode("w").alias("k", "word"))
    w = w.select("at", "n", "k", F.xxhash64("word", "k").alias("stay"), F.xxhash64("word", F.col("k") - 1).alias("move"))
    line = Window.partitionBy("at")
    upto = line.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = w.select("at", "n", "k", "stay", F.bit_xor("stay").over(upto).alias("head"), F.bit_xor("move").over(line).alias("all"), F.bit_xor("move").over(upto).alias("moved"))
    gap = F.struct((F.col("n") - 1).alias("size"), F.col("head").bitwiseXOR(F.col("stay")).bitwiseXOR(F.col("all")).bitwiseXOR(F.col("moved")).alias("key"), (F.col("k") + 1).alias("gone"))
    whole = F.struct(F.col("n").alias("size"), F.col("head").alias("key"), F.lit(0).alias("gone"))
    both = F.when(F.col("k") == F.col("n") - 1, F.array(gap, whole)).otherwise(F.array(gap))
    return rows.select("at", F.explode(both).alias("v")).select("v.*", "at")


def candidate_links(rows: DataFrame) -> DataFrame:
    """``variants`` -> ``(at, at2, gone, gone2)``: each line with the earliest line that shares a variant.

    Lines without the same word of the same variant are at one edit from one another, as are the variant itself and all of them. So the
    earliest line of such a group speaks for it: links grow with the lines, never with the square of a group.
    """
    groups = rows.groupBy("size", "key", "gone").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    by_key = groups.groupBy("size", "key").agg(
        F.min(F.when(F.col("gone") == 0, F.col("first"))).alias("whole"),
        F.min(F.when(F.col("gone") > 0, F.struct("first", "gone"))).alias("cut"),
        F.sum("c").alias("c"),
    ).where("c > 1")
    same = rows.join(groups.where("gone > 0 and c > 1").select("size", "key", "gone", F.col("first").alias("at2")), ["size", "key", "gone"])
    same = same.select("at", "at2", "gone", F.col("gone").alias("gone2"))
    mixed = rows.join(by_key.where("whole is not null and cut is not null"), ["size", "key"])
    other = F.when(F.col("gone") > 0, F.struct(F.col("whole").alias("first"), F.lit(0).alias("gone"))).otherwise(F.col("cut"))
    mixed = mixed.select("at", other.alias("other"), "gone").select("at", F.col("other.first").alias("at2"), "gone", F.col("other.gone").alias("gone2"))
    return same.unionByName(mixed).where("at2 < at")


def _without(w: Column, gone: Column) -> Column:
    return F.when(gone == 0, w).otherwise(F.concat(F.slice(w, F.lit(1), F.greatest(gone - 1, F.lit(0))), F.slice(w, gone + 1, F.size(w))))


def line_status(docs: DataFrame, *, min_words: int = 5, row: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, rid, line_no, n, status)``: 'kept', 'copy' or 'near' for every line with a word of every row.

    A line stays unless an earlier one (by doc_id, then place) has the same words ('copy') or is at one word edit from it
    ('near': a word put in, taken out or changed, if the longer line has ``min_words`` words or more, so that
    at least 0.8 of it is common). Copies of a 'near' line are 'near' too. White space between words doesn't count.
    Lines without a word are no rows. A null doc_id comes before all others. Rows with one doc_id, or without any, are told
    apart by a hash of their texts, which also orders them; of rows alike in both any comes first, and the others' lines are copies.
    ``row`` names a column that numbers the rows of ``docs``; without it rows are numbered here.
    """
    lines = stored(line_keys(docs, row=row), "lines")
    distinct = stored(classes(lines), "line-classes")
    places = stored(with_half_in_common(distinct, min_words=min_words), "line-places")
    texts = stored(_texts(docs, places), "line-texts")
    rows = stored(variants(texts), "line-variants")
    links = candidate_links(rows)
    a = texts.select("at", "n", "w")
    b = texts.select(F.col("at").alias("at2"), F.col("n").alias("n2"), F.col("w").alias("w2"))
    links = links.join(a, "at").join(b, "at2").where(F.greatest("n", "n2") >= min_words)
    near = links.where(_without(F.col("w"), F.col("gone")) == _without(F.col("w2"), F.col("gone2"))).select("at").distinct()
    near = places.join(near, "at", "left_semi").select("k1", "k2", F.lit(True).alias("near"))
    judged = distinct.join(near, ["k1", "k2"], "left").select("k1", "k2", F.col("rid").alias("rid1"), F.col("line_no").alias("line1"), F.coalesce("near", F.lit(False)).alias("near"))
    # Stored, so that the join with all lines is a stage of its own and a very common line's copies can be split.
    judged = stored(judged, "line-verdicts")
    first = (F.col("rid") == F.col("rid1")) & (F.col("line_no") == F.col("line1"))
    status = F.when(F.col("near"), F.lit("near")).when(first, "kept").otherwise("copy")
    return lines.join(judged, ["k1", "k2"]).select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "rid", "line_no", "n", status.alias("status"))


def document_lines(docs: DataFrame, *, min_words: int = 5) -> DataFrame:
    """``(doc_id, n_lines, n_copy, n_near, n_kept)`` for each doc_id with a line: its lines with a word, by status."""
    of = lambda s: F.sum((F.col("status") == s).cast("long"))
    rows = line_status(docs, min_words=min_words)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), of("copy").alias("n_copy"), of("near").alias("n_near"), of("kept").alias("n_kept"))


def dedup_lines(docs: DataFrame, *, min_words: int = 5) -> DataFrame:
    """``docs`` with the lines taken out of its texts that ``line_status`` doesn't keep; lines without a word stay. Null texts stay null.

    Rows are numbered and stored first, so that each, whatever its doc_id, loses its own lines and no others. All columns are returned.
    """
    held = stored(docs.withColumn("__rid", F.monotonically_increasing_id()), "line-documents")
    gone = line_status(held, min_words=min_words, row="__rid").where("status <> 'kept'")
    gone = gone.groupBy(F.col("rid").alias("__rid")).agg(F.collect_set("line_no").alias("__gone"))
    rows = held.join(gone, "__rid", "left")
    stay = F.filter(F.split("text", "\n"), lambda x, i: ~F.coalesce(F.array_contains("__gone", i), F.lit(False)))
    return rows.select(*[F.array_join(stay, "\n").alias(c) if c == "text" else F.col(c) for c in docs.columns])


#: ``document_lines(documents)`` in DuckDB's SQL, over the words themselves instead of their hashes.
ORACLE = r"""
WITH raw AS (
  SELECT coalesce(doc_id, -9223372036854775808) AS doc, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no
  FROM documents),
lines AS (SELECT doc, line_no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM raw
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
classes AS (SELECT w, len(w) AS n, min({'doc': doc, 'line_no': line_no}) AS "at" FROM lines GROUP BY w),
variants AS (
  SELECT "at", n, w AS v, 0 AS gone FROM classes WHERE n >= 4
  UNION ALL
  SELECT "at", n, w[:p - 1] || w[p + 1:] AS v, p AS gone
  FROM (SELECT "at", n, w, unnest(range(1, n + 1)) AS p FROM classes WHERE n >= 4)),
near AS (
  SELECT DISTINCT a."at" FROM variants a JOIN variants b ON a.v = b.v
  WHERE b."at" < a."at" AND greatest(a.n, b.n) >= 5 AND (a.gone = b.gone OR a.gone = 0 OR b.gone = 0)),
status AS (
  SELECT l.doc, CASE WHEN c."at" IN (SELECT "at" FROM near) THEN 'near'
                     WHEN c."at".doc = l.doc AND c."at".line_no = l.line_no THEN 'kept' ELSE 'copy' END AS status
  FROM lines l JOIN classes c ON l.w = c.w)
SELECT CASE WHEN doc <> -9223372036854775808 THEN doc END AS doc_id, count(*) AS n_lines,
       sum((status = 'copy')::BIGINT)::BIGINT AS n_copy, sum((status = 'near')::BIGINT)::BIGINT AS n_near,
       sum((status = 'kept')::BIGINT)::BIGINT AS n_kept
FROM status GROUP BY doc
"""
