"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that give them away."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.common import stored

KINDS = ["email", "ip", "card", "phone"]
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive runs and the look-behind find the same matches as plain ones, but in linear time on long runs of digits.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"\w+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``local@domain.tld``, leftmost first, found from their @ signs."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((2 * d - 9 if d > 4 else 2 * d) for d in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """For each of KINDS, the (start, end) code-point spans that hold, leftmost and non-overlapping."""
    out: list[list[tuple[int, int]]] = [list(_emails(text)), [], [], []]
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            out[1].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out[2].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out[3].append(m.span())
    return out


def entities_of(text: str, spans: list[list[tuple[int, int]]]) -> set[str]:
    """The protected entities of a text: each value, what it has in common with others, its kind, and that there is any.

    What values share: an address's domain, the first two parts of an IP address, a card's issuer (six digits), a number's
    country and area (five digits).
    """
    out = set()
    for kind, own in zip(KINDS, spans):
        for s, e in own:
            value = text[s:e].lower()
            digits = "".join(c for c in value if "0" <= c <= "9")
            shared = {"email": value.rpartition("@")[2], "ip": ".".join(value.split(".")[:2]), "card": digits[:6], "phone": digits[:5]}[kind]
            out |= {f"{kind}={value}", f"{kind}~{shared}", kind, "any"}
    return out


def term_of(word: str) -> str:
    """What is counted of a word: itself in lower case, or, with a digit in it, its form: how long it is, and if it is a number.

    Codes and numbers hardly ever come twice; that a text has one of their form does.
    """
    if not word.isalpha() and any(c.isdigit() for c in word):
        return f"{'number' if word.isdigit() else 'code'} {len(word)}"
    return word.lower()


def _hash(s: str) -> int:
    x = xxhash.xxh64_intdigest(s)
    return x - (1 << 64) if x >= 1 << 63 else x


def terms_outside(text: str, spans: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """The places of the terms outside all spans."""
    covered: list[list[int]] = []
    for s, e in sorted(x for own in spans for x in own):
        if covered and s < covered[-1][1]:
            covered[-1][1] = max(e, covered[-1][1])
        else:
            covered.append([s, e])
    terms, c = [], 0
    for m in _TERM.finditer(text):
        while c < len(covered) and covered[c][1] <= m.start():
            c += 1
        if not (c < len(covered) and covered[c][0] < m.end()):
            terms.append((m.start(), m.end()))
    return terms


_ROW = "doc long, text_key long, doc_id long, rid long, base array<array<struct<start:int,end:int>>>, entities array<long>, terms array<long>, term long, n long"
_NAMES = ["doc", "text_key", "doc_id", "rid", "base", "entities", "terms", "term", "n"]
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_TYPES = [*[pa.int64()] * 4, pa.list_(pa.list_(_SPAN)), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64()]
#: Stands for a null doc_id where rows are matched.
_NO_ID = -(1 << 63)
#: Slots of the filter that spares most terms the exact join, and copies of a disclosing term, among which its documents are dealt.
_SLOTS, _SALTS = 1 << 24, 32


def _keyed(docs: DataFrame) -> DataFrame:
    """``(doc, text_key, doc_id, text)``: rows alike in doc and text_key have one id and one text, and so the same spans."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(_NO_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), doc_id.alias("doc_id"), "text")


def read_texts(docs: DataFrame) -> DataFrame:
    """One pass over the whole texts: a row for each document, and rows (term, n) that count documents with a term.

    Document rows have base spans and, where there are any, hashes of their entities and of all different terms outside them; the
    counts are those of a part of a task's documents and are still to be summed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def counted() -> pa.RecordBatch:
            own = [pa.array([_hash(t) for t in held], pa.int64()), pa.array(list(held.values()), pa.int64())]
            out = pa.RecordBatch.from_arrays([*(pa.nulls(len(held), kind) for kind in _TYPES[:-2]), *own], _NAMES)
            held.clear()
            return out

        for b in batches:
            base, entities, terms = [], [], []
            for text in b.column(4).to_pylist():
                text = text or ""
                spans = base_spans(text)
                base.append([[{"start": s, "end": e} for s, e in own] for own in spans])
                entities.append([_hash(x) for x in sorted(entities_of(text, spans))])
                # Only where there are spans do words' places matter.
                own = set(map(term_of, {text[s:e] for s, e in terms_outside(text, spans)} if entities[-1] else set(_TERM.findall(text))))
                terms.append([_hash(x) for x in sorted(own)] if entities[-1] else [])
                held.update(own)
                if len(held) > 1 << 18:
                    yield counted()
            none = pa.nulls(b.num_rows, pa.int64())
            own = [pa.array(x, kind) for x, kind in zip((base, entities, terms), _TYPES[4:7])]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), *own, none, none], _NAMES)
        if held:
            yield counted()

    rows = _keyed(docs).select("doc", "text_key", "doc_id", F.monotonically_increasing_id().alias("rid"), "text")
    return stored(rows.mapInArrow(run, _ROW), "personal-data")


def disclosing(rows: DataFrame, *, threshold: float, support: int) -> DataFrame:
    """``read_texts`` rows -> ``(entity, term, disclosure)``: the terms that reveal a protected entity too strongly.

    Over all documents: PMI(entity; term) = log(N * n(entity, term) / (n(entity) * n(term))), as a share of the
    entity's information log(N / n(entity)). At 1 the term occurs in the entity's documents only and reveals it whole. N, n(entity),
    n(term) and n(entity, term) are numbers of documents with them, wherever in the document they are; terms within base spans don't count.
    A pair must come in ``support`` documents, as what one or two say is no estimate, and in so many that n(entity, term) * PMI reaches the
    logarithm of the number of terms: less could come about by chance for some of so many terms.
    """
    docs = rows.where("rid is not null")
    n_docs = float(docs.count())
    named = docs.where(F.size("entities") > 0)
    mentions = named.select("rid", F.explode("entities").alias("entity"))
    # A pair has no more documents than its entity: rarer ones can't reach the support.
    entities = stored(mentions.groupBy("entity").agg(F.count("*").alias("with_entity")).where(F.col("with_entity") >= support), "entities")
    terms = stored(rows.where("term is not null").groupBy("term").agg(F.sum("n").alias("with_term")), "term-counts")
    n_terms = terms.count()
    most = entities.where(F.col("with_entity") < n_docs).agg(F.max("with_entity")).first()[0] or 0
    # From the threshold, and n(entity, term) <= n(entity): a term of more documents can't reach it with any entity.
    bound = most**threshold * n_docs ** (1 - threshold) + 1e-6
    some = terms.where((F.col("with_term") >= support) & (F.col("with_term") <= bound))
    own = mentions.join(entities, "entity", "left_semi").groupBy("rid").agg(F.collect_list("entity").alias("entities"))
    met = named.select("rid", F.explode("terms").alias("term")).join(some, "term").join(own, "rid")
    pairs = met.select(F.explode("entities").alias("entity"), "term", "with_term").groupBy("entity", "term", "with_term").agg(F.count("*").alias("both")).where(F.col("both") >= support)
    both = pairs.join(entities, "entity").where(F.col("with_entity") < n_docs)
    pmi = F.log(F.lit(n_docs) * F.col("both") / (F.col("with_entity") * F.col("with_term")))
    found = both.withColumn("pmi", pmi).withColumn("disclosure", F.col("pmi") / F.log(F.lit(n_docs) / F.col("with_entity")))
    # Near 1 the logarithms' own error decides: a share is told to nine digits.
    return found.where((F.round("disclosure", 9) >= threshold) & (F.col("both") * F.col("pmi") >= F.log(F.lit(float(max(n_terms, 1)))))).select("entity", "term", "disclosure")


def _occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(doc, text_key, term, start, end)``: all places outside base spans of ``terms(term)``, and of a few others, in all documents.

    The terms' hashes fill a table of fixed size that only spares the join after it most other terms; it never loses one.
    """
    bits = terms.select(F.expr(f"cast(pmod(term, {_SLOTS}) div 32 as int) AS at"), F.expr("shiftleft(1L, cast(pmod(term, 32) as int)) AS bit"))
    bits = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    mask = np.zeros(_SLOTS // 32, np.uint32)
    mask[bits["at"].to_numpy()] = bits["bits"].to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(mask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = held.value, {}

        def hash_if_held(word: str) -> int | None:
            if word not in known:
                if len(known) > 1 << 18:
                    known.clear()
                h = _hash(term_of(word))
                known[word] = h if int(table[(k := h % _SLOTS) >> 5]) >> (k & 31) & 1 else None
            return known[word]

        for b in batches:
            at, out = [], ([], [], [])
            for i, text in enumerate(b.column(2).to_pylist()):
                if text and any(hash_if_held(w) is not None for w in set(_TERM.findall(text))):
                    for s, e in terms_outside(text, base_spans(text)):
                        if (h := hash_if_held(text[s:e])) is not None:
                            at.append(i)
                            for col, x in zip(out, (h, s, e)):
                                col.append(x)
            take = pa.array(at, pa.int64())
            cols = [pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *cols], ["doc", "text_key", "term", "start", "end"])

    return _keyed(docs).select("doc", "text_key", "text").mapInArrow(run, "doc long, text_key long, term long, start int, end int")


def find(docs: DataFrame, *, threshold: float = 0.9, support: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, base array<array<struct<start,end>>>, terms array<struct<start,end,whole>>)``, a row for each row.

    ``base`` has the spans of KINDS; ``terms`` the spans of all occurrences, in all documents, of the terms (``term_of`` words) whose
    disclosure of some entity (``entities_of``) reaches ``threshold``; ``whole``: they occur in its documents only, so generalising them
    would leave nothing. Null texts count as empty and have no spans. Repeated rows each count, and each get their spans; rows without
    doc_id are told apart by their texts. Other columns are not looked at. No rows give no rows.
    """
    rows = read_texts(docs)
    terms = stored(disclosing(rows, threshold=threshold, support=support).groupBy("term").agg(F.max("disclosure").alias("disclosure")), "disclosing-terms")
    places = _occurrences(docs, terms).withColumn("salt", F.pmod(F.xxhash64("doc", "text_key"), F.lit(_SALTS)).cast("int"))
    salted = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    # A merge join: adaptive execution would broadcast this table by its size before the copies.
    marked = places.join(salted.hint("merge"), ["term", "salt"]).groupBy("doc", "text_key", "start", "end").agg(F.max("disclosure").alias("disclosure"))
    marked = marked.groupBy("doc", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end", (F.col("disclosure") > 0.999).alias("whole")))).alias("marks"))
    none = F.array().cast("array<struct<start:int,end:int,whole:boolean>>")
    return rows.where("rid is not null").select("doc", "text_key", "doc_id", "base").join(marked, ["doc", "text_key"], "left").select("doc_id", "base", F.coalesce("marks", none).alias("terms"))


def spans_text(base: list, terms: list) -> tuple[str, str]:
    """The base spans, and all spans, as kind:start:end joined by commas, kind after kind, each by start."""
    own = [f"{kind}:{s['start']}:{s['end']}" for kind, spans in zip(KINDS, base) for s in spans]
    return ",".join(own), ",".join(own + [f"term:{s['start']}:{s['end']}" for s in terms])


def digests(found: DataFrame) -> DataFrame:
    """``find`` rows -> doc_id, a count for each of KINDS, base_sha256, spans, n_term, and n_spans of all kinds."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, terms = b.column(1).to_pylist(), b.column(2).to_pylist()
            texts = [spans_text(x, y) for x, y in zip(base, terms)]
            counts = np.array([[len(own) for own in x] for x in base], np.int64).reshape(-1, len(KINDS))
            cols = [b.column(0), *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array([hashlib.sha256(x.encode()).hexdigest() for x, _ in texts], pa.string()), pa.array([y for _, y in texts], pa.string()), pa.array([len(y) for y in terms], pa.int64()), pa.array([len(y) + int(n) for y, n in zip(terms, counts.sum(axis=1))], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_term", "n_spans"])

    return found.select("doc_id", "base", "terms").mapInArrow(read, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_term long, n_spans long")


def _replaced(text: str | None, base: list | None, terms: list | None) -> str | None:
    if not text:
        return text
    marks = [(s["start"], s["end"], f"[{kind.upper()}]") for kind, spans in zip(KINDS, base or []) for s in spans]
    for s in terms or []:
        term = text[s["start"] : s["end"]]
        general = "" if s["whole"] else "[NUMBER]" if term.isdigit() else "[CODE]" if term_of(term).startswith("code ") else "[NAME]" if term[:1].isupper() else "[TERM]"
        marks.append((s["start"], s["end"], general))
    out, at = [], 0
    for s, e, word in sorted(marks):
        if s >= at:  # a span within another is gone with it
            out += [text[at:s], word]
        at = max(at, e)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with its texts sanitised and all other columns as they are.

    Protected spans become their kind; disclosing terms become [NUMBER], [CODE], [NAME] or [TERM], or go where they reveal the entity
    whole. Rows are matched by doc_id and a hash of the text, so repeated rows fare alike; rows without doc_id too.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    own = docs.select(F.xxhash64("doc_id", key).alias("doc_id"), "text")
    found = find(own, **params).dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("__key"), F.col("base").alias("__base"), F.col("terms").alias("__terms"))

    def of(texts: pa.Array, base: pa.Array, terms: pa.Array) -> pa.Array:
        return pa.array([_replaced(*x) for x in zip(texts.to_pylist(), base.to_pylist(), terms.to_pylist())], pa.string())

    both = docs.withColumn("__key", F.xxhash64("doc_id", key)).join(found, "__key", "left")
    clean = F.arrow_udf(of, "string")("text", "__base", "__terms")
    return both.select(*[clean.alias(c) if c == "text" else F.col(c) for c in docs.columns])
