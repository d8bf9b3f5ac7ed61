"""Operator 10, PII: information-theoretic sanitisation.

Base detectors find e-mail addresses, IP numbers, card numbers and phone
numbers.  Each distinct value is a protected entity.  The terms of the
documents that hold it may reveal it as well: with the documents that hold
the entity, the term, and both counted over the whole corpus, a term
discloses the share

    log2(c(e,t) N / (c(e) c(t))) / log2(N / c(e))

of the entity's information.  Where two or more documents bear it out, terms
that disclose at least ``GENERALISE`` are generalised, and those that disclose
at least ``REMOVE`` are removed, wherever they stand in a document that holds
the entity.  An entity of less than ``LEAST_BITS`` of information (one that a
sixteenth of all documents or more hold) identifies no one, so its terms stay.

A term is a run of letters, digits and non-ASCII characters of any length,
A-Z lower-cased.  The share is reached by terms of at most
c(e) (N / c(e))^(1 - GENERALISE) documents only, so others are left out before
pairs are counted.  Entities of the same documents are counted as one.  As
two documents at least hold both, each pair occurs in another one than the
entity's document with most terms; so pairs come from the other documents,
and that one is only asked for them.  A document of many entities and terms
is therefore not multiplied out for entities that it alone is large for.

Defined results: a null text counts as empty and has no spans.  Repeated
rows and equal texts count as documents of their own and each get a row.
Base spans always stay, also where they overlap; terms that touch one are no
terms.  Very long texts are scanned whole.  An empty table gives no rows.
``sanitise`` keeps all columns, whatever their names; rows without spans are
left as they are, null texts too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SALTS, Scratch, bound_batches, dealt, keyed_join, materialise, slices, spare_name, text_or_empty

KINDS = ("email", "ip", "card", "phone", "term")
LEAST_DOCS = 2
LEAST_BITS = 4.0
GENERALISE = 0.8
REMOVE = 0.95

#: An address from its @ on; the part before it is a run of _LOCAL characters, found backwards, so that long runs without @ cost nothing.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Every number match lies within such a run, and starts where it starts or later.
_NUMBERS = re.compile(r"[+0-9][+0-9 ().\-]{6,}")
#: What every text with a base span has.
MAY_HOLD = r"@|[+0-9][+0-9 ().\-]{6,}"
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What is between terms: ASCII but letters and digits.
BETWEEN = r"[\x00-/:-@\[-`{-\x7f]+"
_TERM = re.compile(r"[^\x00-/:-@\[-`{-\x7f]+")
SLICE_BYTES = 4 << 20
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            last = m.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in order of start, then kind; code points, end exclusive."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for run in _NUMBERS.finditer(text):
        at, part = run.start(), run.group()
        if "." in part:
            found += [("ip", at + m.start(), at + m.end()) for m in _IP.finditer(part) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(part):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", at + m.start(), at + m.end()))
        if "+" in part:
            found += [("phone", at + m.start(), at + m.end()) for m in _PHONE.finditer(part) if 10 <= sum(map(str.isdigit, m.group())) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def terms_outside(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of all terms that no base span touches, in order; one sweep over both."""
    lower, out, at, until = text.translate(_LOWER), [], 0, 0
    for m in _TERM.finditer(text):
        start, end = m.span()
        while at < len(spans) and spans[at][1] < end:  # spans come in order of their start
            until = max(until, spans[at][2])
            at += 1
        if until <= start:
            out.append((lower[start:end], start, end))
    return out


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def _lists(rows: list[list[tuple]], names: tuple[str, ...], kind: pa.DataType) -> pa.Array:
    """Lists of (kind, long, long) as Arrow lists of structs."""
    flat = [x for row in rows for x in row]
    parts = list(zip(*flat, strict=True)) if flat else [(), (), ()]
    ends = [0]
    for row in rows:
        ends.append(ends[-1] + len(row))
    values = pa.StructArray.from_arrays([pa.array(p, t) for p, t in zip(parts, (kind, pa.int64(), pa.int64()), strict=True)], names=list(names))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def hashes(text: Column) -> tuple[Column, Column]:
    """Two independent hashes that stand for a text."""
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def scan(docs: DataFrame) -> DataFrame:
    """(number, doc_id, one, two, base, base_sha256, entities, terms) of every document; terms of those with entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", SLICE_BYTES):
                texts = some.column("text").to_pylist()
                spans = [base_spans(t) for t in texts]
                entities = [sorted({f"{k}:{t[a:b].translate(_LOWER)}" for k, a, b in s}) for t, s in zip(texts, spans, strict=True)]
                terms = [terms_outside(t, s) if s else [] for t, s in zip(texts, spans, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[some.column(c) for c in ("number", "doc_id", "one", "two")], _lists(spans, ("kind", "start", "end"), pa.string()), pa.array([digest(s) for s in spans], pa.string()),
                        pa.array(entities, pa.list_(pa.string())), _lists(terms, ("term", "start", "end"), pa.string()),
                    ],
                    names=["number", "doc_id", "one", "two", "base", "base_sha256", "entities", "terms"],
                )

    places = "array<struct<{}:string,start:bigint,end:bigint>>"
    one, two = hashes(F.col("text"))
    rows = docs.select("number", "doc_id", one.alias("one"), two.alias("two"), "text")
    return rows.mapInArrow(run, f"number long, doc_id long, one long, two long, base {places.format('kind')}, base_sha256 string, entities array<string>, terms {places.format('term')}")


def term_frequencies(docs: DataFrame) -> DataFrame:
    """(term, in_docs): how many documents hold a term, over all documents."""
    lower = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.array_distinct(F.split(lower, BETWEEN))
    return docs.select(F.explode(terms).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("in_docs"))


def protected(found: DataFrame, n_docs: int, scratch: Scratch) -> DataFrame:
    """(number, e1, e2, of_entity, most): the classes of entities that a document holds, and of how many documents a telling term is at most.

    Entities of the same documents are one class, named by two hashes of these.
    """
    held = found.where(F.size("entities") > 0).select("number", F.explode("entities").alias("entity"))
    name = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), F.col("number")))
    entities = held.groupBy("entity").agg(F.count("*").alias("of_entity"), name(1).alias("e1"), name(2).alias("e2"))
    share = F.lit(float(n_docs)) / F.col("of_entity")
    entities = entities.where((F.col("of_entity") >= LEAST_DOCS) & (F.log2(share) >= LEAST_BITS)).withColumn("most", F.col("of_entity") * F.pow(share, F.lit(1 - GENERALISE)) * (1 + 1e-9))
    met = keyed_join(held, scratch.keep(entities), ["entity"], "number")
    return scratch.keep(met.select("number", "e1", "e2", "of_entity", "most").distinct())


def disclosing(docs: DataFrame, found: DataFrame, n_docs: int, scratch: Scratch) -> DataFrame:
    """(number, term, disclosure): the terms of a document that disclose at least GENERALISE of one of its entities; they read from ``scratch``."""
    classes = protected(found, n_docs, scratch)
    most = classes.groupBy("number").agg(F.max("most").alias("most"))
    own = found.join(most, "number").select("number", "most", F.explode(F.array_distinct(F.col("terms.term"))).alias("term"))
    own = scratch.keep(own)
    rare = term_frequencies(docs).where(F.col("in_docs") >= LEAST_DOCS).join(dealt(own.groupBy("term").agg(F.max("most").alias("most"))), "term")
    rare = scratch.keep(rare.where(F.col("in_docs") <= F.col("most")).select("term", "in_docs"))
    telling = scratch.keep(keyed_join(own, rare, ["term"], "number").where(F.col("in_docs") <= F.col("most")).select("number", "term", "in_docs"))

    sized = scratch.keep(classes.join(telling.groupBy("number").agg(F.count("*").alias("n_terms")), "number"))
    largest = scratch.keep(sized.groupBy("e1", "e2").agg(F.max_by("number", F.struct("n_terms", "number")).alias("largest")))
    others = keyed_join(sized, largest, ["e1", "e2"], "number").where(F.col("number") != F.col("largest"))
    pairs = scratch.keep(others.join(dealt(telling), "number").where(F.col("in_docs") <= F.col("most")).select("number", "e1", "e2", "term", "in_docs", "of_entity", "largest"))
    counted = pairs.groupBy("e1", "e2", "term").agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in ("in_docs", "of_entity", "largest")])
    there = telling.select(F.col("number").alias("largest"), "term", F.lit(True).alias("there"))
    counted = counted.join(dealt(there), ["largest", "term"], "left").withColumn("both", F.col("n") + F.when(F.col("there"), 1).otherwise(0))
    n = F.lit(float(n_docs))
    share = F.log2(F.col("both") * n / (F.col("of_entity") * F.col("in_docs"))) / F.log2(n / F.col("of_entity"))
    strong = counted.where(F.col("both") >= LEAST_DOCS).withColumn("disclosure", share).where(F.col("disclosure") >= GENERALISE)
    strong = scratch.keep(strong.select("e1", "e2", "term", "disclosure", "largest", "there"))

    hits = keyed_join(pairs.select("number", "e1", "e2", "term"), strong.select("e1", "e2", "term", "disclosure"), ["e1", "e2", "term"], "number").select("number", "term", "disclosure")
    hits = hits.unionByName(strong.where("there").select(F.col("largest").alias("number"), "term", "disclosure"))
    return hits.groupBy("number", "term").agg(F.max("disclosure").alias("disclosure"))


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scan of all documents, and (number, terms) of those with disclosing terms; both on shared storage.

    Rows are numbered as they are scanned, and the numbers are stored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "pii")
    found = materialise(scan(docs.withColumn("number", F.monotonically_increasing_id())), "pii")
    strong = disclosing(docs, found, found.count(), scratch)
    places = found.where(F.size("entities") > 0).select("number", F.explode("terms").alias("t")).select("number", "t.*")
    hits = places.join(dealt(strong), ["number", "term"])
    grouped = materialise(hits.groupBy("number").agg(F.collect_list(F.struct("start", "end", "disclosure")).alias("terms")), "pii")
    scratch.drop()
    return found.drop("entities", "terms"), grouped


def spans_text(base: Column, terms: Column) -> Column:
    """All spans as kind:start:end, in order of start, then kind, comma-joined."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    made = lambda kind, s: F.struct(s["start"].alias("start"), order[kind].alias("order"), s["end"].alias("end"), kind.alias("kind"))
    own = F.transform(base, lambda s: made(s["kind"], s))
    added = F.transform(F.coalesce(terms, F.array().cast("array<struct<start:bigint,end:bigint,disclosure:double>>")), lambda s: made(F.lit("term"), s))
    parts = F.transform(F.array_sort(F.concat(own, added)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(parts, ",")


def detect(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    found, grouped = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")))
    joined = found.join(grouped, "number", "left")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    n_term = F.when(F.col("terms").isNull(), 0).otherwise(F.size("terms")).cast("long")
    return joined.select("doc_id", *[count(k) for k in KINDS[:4]], "base_sha256", spans_text(F.col("base"), F.col("terms")).alias("spans"), n_term.alias("n_term"))


def cleaned(text: str, spans: list[tuple[str, int, int]], terms: list[tuple[int, int, float]]) -> str:
    """The text with base spans replaced by their kind, strong terms removed and others generalised."""
    marks = [(a, b, f"<{k.upper()}>") for k, a, b in spans]
    marks += [(a, b, "" if d >= REMOVE else "<NUMBER>" if text[a:b].isdigit() else "<NAME>" if text[a].isupper() else "<WORD>") for a, b, d in terms]
    out, at = [], 0
    for a, b, new in sorted(marks):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with sanitised texts and their own columns; n_chars, where there is one, follows the text.

    Equal texts have equal marks, so marks are found again by two hashes of
    the text.  Only texts that may hold a base span are shuffled for that, and
    the rows of one text are dealt to several tasks.
    """
    names = {n: spare_name(docs, n) for n in ("one", "two", "salt", "spans")}
    text = text_or_empty(text_col)
    found, grouped = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")))
    marked = found.where(F.size("base") > 0).join(grouped, "number", "left").groupBy("one", "two").agg(F.max(F.struct("number", F.struct("base", "terms").alias("spans")))["spans"].alias(names["spans"]))
    marked = marked.withColumn(names["salt"], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnsRenamed({n: names[n] for n in ("one", "two")})

    @F.pandas_udf("string")
    def clean(texts: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.Series]:
        for text, marks in texts:
            yield pd.Series(
                [
                    cleaned(t, [(s["kind"], s["start"], s["end"]) for s in b], [(s["start"], s["end"], s["disclosure"]) for s in (d if d is not None else [])]) if b is not None else t
                    for t, b, d in zip(text, marks["base"], marks["terms"], strict=True)
                ],
                dtype=object,
            )

    able = text.rlike(MAY_HOLD)
    asked = docs.where(able).withColumns({names["one"]: hashes(text)[0], names["two"]: hashes(text)[1], names["salt"]: F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")})
    hidden = asked.join(marked, [names["one"], names["two"], names["salt"]], "left")
    hidden = hidden.withColumn(text_col, F.when(F.col(names["spans"]).isNull(), F.col(text_col).cast("string")).otherwise(clean(text, F.col(names["spans"]))))
    if "n_chars" in docs.columns:
        hidden = hidden.withColumn("n_chars", F.when(F.col(names["spans"]).isNull(), F.col("n_chars")).otherwise(F.length(text_col).cast(docs.schema["n_chars"].dataType)))
    own = [F.col(f"`{c}`") for c in docs.columns]
    return docs.where(~able).select(*own).unionByName(hidden.select(*own))
